from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers

from quillmill.llm import packing, queries

PATH = public_tokenizers.path("word_bpe_49k.json")


def tokens(texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(PATH)
    return [[*library.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]


def fewest(demand: np.ndarray, capacity: int) -> int:
    """Sequences that any packing of these lengths needs: large pieces share none, small ones fill what room these leave."""
    size, best = np.arange(len(demand)), 0
    for k in range(capacity // 2 + 1):
        alone, half, small = size > capacity - k, (size > capacity / 2) & (size <= capacity - k), (size >= k) & (size <= capacity / 2)
        room = demand[half].sum() * capacity - (demand * size)[half].sum()
        best = max(best, demand[alone].sum() + demand[half].sum() + max(0, -(-int((demand * size)[small].sum() - room) // capacity)))
    return int(best)


def check(rows, ids: dict[int, list[int]], capacity: int) -> int:
    """Every id lies in one piece, sequences have no gap and fit; the number of sequences."""
    pieces, sequences = {}, {}
    for r in rows:
        own = ids[r["doc_id"]]
        part = own[r["start"] : r["start"] + r["length"]]
        assert r["doc_tokens"] == len(own) and len(part) == r["length"] > 0
        assert r["ids_crc32"] == zlib.crc32(np.asarray(part, "<u4").tobytes())
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for doc, found in pieces.items():
        at = 0
        for start, length in sorted(found):
            assert start == at
            at += length
        assert at == len(ids[doc])
    assert set(pieces) == set(ids)
    for found in sequences.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_query_places_every_id_once(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    ids = dict(zip([r["doc_id"] for r in docs], tokens([r["text"] for r in docs]), strict=True))
    rows = queries.op10_packing(spark, sf_dir).collect()
    lengths = np.array([n for own in ids.values() for n in [4096] * (len(own) // 4096) + [len(own) % 4096] if n])
    assert check(rows, ids, 4096) <= 1.01 * fewest(np.bincount(lengths, minlength=4097), 4096) + 2


def test_odd_texts(spark):
    texts = [None, "", "word", "Ünïcödé ΣΑΣ \x1c sep", "[MASK] [PAD] <|endoftext|>", "long words " * 9000, "word"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    check(packing.pack(frame, PATH, 512).collect(), dict(enumerate(tokens(texts))), 512)
    assert packing.pack(frame.limit(0), PATH).count() == 0


def test_knapsack_and_solution_hold_the_demand():
    rng = np.random.default_rng(0)
    value = np.concatenate([[0.0], rng.random(30)])
    worth, pattern = packing.knapsack(value, 30)
    best = np.zeros(31)
    for c in range(1, 31):
        best[c] = max(best[c - 1], *(value[s] + best[c - s] for s in range(1, c + 1)))
    assert abs(worth - best[30]) < 1e-9 and abs(pattern @ value - worth) < 1e-9 and pattern @ np.arange(31) <= 30
    for size in (1, 5, 400):
        demand = np.concatenate([[0], rng.integers(0, size, 64)])
        patterns = packing.solve(demand, 64)
        assert sum(p * n for p, n in patterns).tolist() == demand.tolist() if demand.any() else not patterns
        assert all(p @ np.arange(65) <= 64 for p, _ in patterns)
        assert sum(n for _, n in patterns) <= 1.01 * fewest(demand, 64) + 2


def test_a_full_memory_of_words_keeps_the_early_ones_and_all_ids(monkeypatch):
    assert packing.MEMO <= 250_000  # 900,000 took some 210 MB of a worker
    monkeypatch.setattr(packing, "MEMO", 40)
    encoder = packing.WordEncoder(PATH)
    texts = [" ".join(["the", "of", *(f"word{'abcdefghij'[j]}{'abcdefghij'[i % 10]}" for j in range(10))]) + " o'clock" for i in range(30)]
    for text, want in zip(texts, tokens(texts), strict=True):
        assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == want[:-1]
        assert "the" in encoder.memo and len(encoder.memo) <= 40 + 13 and len(encoder.parts) <= 40 + 13
