from __future__ import annotations

import math
import random

import numpy as np

from quillmill.llm import lm, queries
from quillmill.llm.shingles import word_hashes

DOC = "doc_id long, text string, n_words int"


def network(seed=0) -> lm.Network:
    return lm.Network(lm.begin(np.random.default_rng(seed).integers(0, 100, lm.WORDS).astype(float)))


def by_hand(net: lm.Network, window: list[int]) -> np.ndarray:
    """log p of every word for the words around it."""
    hidden = np.maximum(sum(net.window[i][w] for i, w in enumerate(window)) + net.bias, 0).astype(float)
    soft = lambda x: x - np.log(np.exp(x - x.max()).sum()) - x.max()
    first = soft(net.classes @ hidden + net.class_bias)
    return np.concatenate([first[k] + soft(net.words[k] @ hidden + net.word_bias[k]) for k in range(lm.WIDTH)])


def test_probabilities_equal_a_plain_network_and_sum_to_one():
    net, rng = network(), np.random.default_rng(2)
    padded = np.full(34, lm.EDGE)
    padded[2:-2] = rng.integers(0, lm.WORDS, 30)
    at = np.arange(2, 32)
    got = lm.log_probs(net, padded, at)
    for i, place in enumerate(at.tolist()):
        every = by_hand(net, [padded[place + p] for p in lm._PLACES])
        assert abs(np.exp(every).sum() - 1) < 1e-4 and abs(every[padded[place]] - got[i]) < 1e-3


def test_gradient_equals_differences():
    net, rng = network(), np.random.default_rng(3)
    padded = np.full(24, lm.EDGE)
    padded[2:-2] = rng.integers(0, 300, 20)
    at, slope = np.arange(2, 22), np.zeros_like(net.rows)
    for rows, values in lm.gradient(net, padded, at):
        slope[rows] = values
    big = np.argwhere(np.abs(slope) > 4e-3)
    for r, c in big[rng.integers(0, len(big), 20)]:
        before, found = net.rows[r, c], []
        for step in (0.01, -0.01):
            net.rows[r, c] = before + step
            found.append(-lm.log_probs(net, padded, at).mean())
        net.rows[r, c] = before
        assert abs((found[0] - found[1]) / 0.02 - slope[r, c]) < 0.1 * abs(slope[r, c]) + 5e-4


def grammar(rng: random.Random, n: int) -> str:
    out = []
    while len(out) < n:
        i = rng.randrange(20)
        out += [f"noun{i}", f"verb{i}", f"end{i}."]
    return " ".join(out[:n])


def test_learns_what_stands_on_both_sides(spark):
    rng = random.Random(1)
    docs = spark.createDataFrame([(i, grammar(rng, 600), 0) for i in range(300)], DOC).repartition(4)
    model = lm.train(docs)
    good = grammar(rng, 300)
    words = good.split()
    rng.shuffle(words)
    held = spark.createDataFrame([(1, good, 0), (2, " ".join(words), 0), (3, "zzz qqq unheard-of strings xx", 0)], DOC)
    mean = {r["doc_id"]: r["mean_log_prob"] for r in lm.score(held, model).collect()}
    unigram = -math.log(60)
    assert mean[1] > unigram + 0.5 > mean[2] + 0.5 and mean[3] < mean[2]


def test_odd_rows_and_whole_texts(spark):
    model = lm.train(spark.createDataFrame([(1, "a b c a b c", 0), (None, None, 0)], DOC))
    rows = [(1, None, 0), (2, "", 0), (3, " \t\n", 0), (4, "a b c", 0), (4, "a b c", 0), (None, "Aé", 0), (5, "a b c " * 50_000, 0)]
    got = lm.score(spark.createDataFrame(rows, DOC).coalesce(1), model).collect()
    assert [(r["doc_id"], r["n_words"]) for r in got] == [(1, 0), (2, 0), (3, 0), (4, 3), (4, 3), (None, 1), (5, 150_000)]
    assert [r["log_prob"] for r in got[:3]] == [0.0] * 3 and got[0]["mean_log_prob"] is None and got[3]["log_prob"] == got[4]["log_prob"]
    empty = spark.createDataFrame([], DOC)
    assert lm.score(empty, lm.train(empty)).count() == 0


def test_counts_equal_plain_counts(spark):
    texts = ["a b a", "A c\n", None, "", "b " * 1000]
    rows = lm.corpus_counts(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)).collect()
    words = {r["item"]: r["n"] for r in rows if r["kind"] == 0}
    key = lambda w: int(word_hashes([w])[0].view(np.int64)[0])
    assert words == {key(b"a"): 3, key(b"b"): 1001, key(b"c"): 1}
    assert sum(r["n"] for r in rows if r["kind"] == 1 and r["item"] >> 8 == 32 and r["item"] & 255 == ord("b")) == 1001


def test_vocabulary_finds_ranks_and_buckets():
    hashes = np.array([5, 5 + (1 << 20), 77], np.uint64)  # the first two share a slot
    found = lm.Vocabulary(hashes).ids(np.array([5 + (1 << 20), 77, 5, 999], np.uint64))
    assert found[:3].tolist() == [1, 2, 0] and found[3] >= lm.WORDS - lm.WIDTH


def test_query_scores_every_document(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = queries.op8_lm_score(spark, sf_dir).collect()
    want = {r["doc_id"]: len((r["text"] or "").encode().split()) for r in docs.collect()}
    assert {r["doc_id"]: r["n_words"] for r in got} == want and all(r["log_prob"] <= 0 for r in got)


def test_every_position_is_learnt_from_once():
    texts = [b"a b c d e f g " * 40, b"", b"x y z " * 90]
    _, _, owner, begins, _ = lm._sequence(texts, lm.Vocabulary(np.zeros(0, np.uint64)))
    turn = lm.turns(np.array([7, 8, 9]), owner, begins)
    assert len(turn) == 550 and sum(int((turn == number).sum()) for number in range(lm.ROUNDS)) == 550
