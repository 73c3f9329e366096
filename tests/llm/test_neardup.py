from __future__ import annotations

import random

import numpy as np
import pytest

from quillmill.llm import neardup, oracles, queries
from quillmill.llm.components import components, joined
from tests.conftest import same_rows

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text: str | None, k: int) -> set[str]:
    words = "".join(c.lower() if c.isascii() else c for c in text or "").translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ")
    words = [w for w in words if w]
    return {" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def groups(rows: list[tuple[int, str | None]], k: int, percent: int) -> dict[int, tuple[int, int]]:
    sets = {i: shingles(t, k) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def corpus() -> list[tuple[int, str | None]]:
    rng, rows, number = random.Random(1), [], 0
    for _ in range(12):  # chains of edits, so that some members are linked through others only
        words = [rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rng.randint(0, 40)) for _ in range(rng.randint(4, 120))]
        for _ in range(rng.randint(1, 14)):
            for _ in range(rng.randint(0, max(1, len(words) // 25))):
                words[rng.randrange(len(words))] = f"new{rng.randint(0, 999)}"
            rows.append((number, " ".join(words)))
            number += 1
    extra = [None, "", "  \t\n", "solo", "Solo", "solo\x0b", "x y", "X Y", "x\ty", "naïve Ünit", "NAÏVE ünit", "a b c d e", "a b c d e", "w " * 3000]
    return rows + [(number + i, t) for i, t in enumerate(extra)]


@pytest.mark.parametrize(("k", "percent"), [(2, 80), (5, 80)])
def test_equals_brute_force(spark, k, percent):
    rows = corpus()
    frame = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOC).repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(frame, k, percent).collect()}
    assert got == {i: (n, c, c == i) for i, (n, c) in groups(rows, k, percent).items()}


def test_a_large_group_is_kept_whole(spark):
    """Copies of one text with edits, most of them linked with the first, some only with others, in several tiles."""
    rng = random.Random(2)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(700):
        words = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4])):
            words[rng.randrange(60)] = f"e{rng.randint(0, 30)}"
        rows.append((i, " ".join(words)))
    frame = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOC).repartition(6)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(frame, 2, 80).collect()}
    assert got == {i: c for i, (_, c) in groups(rows, 2, 80).items()}


def test_empty_table_and_repeated_and_null_keys(spark):
    assert neardup.near_duplicates(spark.createDataFrame([], DOC)).count() == 0
    rows = [(5, "a b c d e f", "en", "s", 1)] * 3 + [(None, "a b c d e f", "en", "s", 1), (7, None, None, None, None)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, DOC)).collect()
    assert len(got) == 5 and {r["component_id"] for r in got if r["doc_id"] != 7} == {5}


def test_query_equals_its_sql(spark, sf_dir, duck):
    same_rows(queries.op1_near_duplicates(spark, sf_dir), duck, oracles.NEAR_DUPLICATES)


def test_odd_sketch_estimates_high_similarities():
    rng = np.random.default_rng(4)
    for share in (1.0, 0.95, 0.9, 0.8):
        a = rng.integers(0, 1 << 63, 1000).astype(np.uint64)
        b = np.concatenate([a[: int(1000 * 2 * share / (1 + share))], rng.integers(0, 1 << 63, 1000).astype(np.uint64)])[:1000]
        sketches = neardup.odd_sketch(np.array([neardup.minhash(np.unique(x)) for x in (a, b)])).view(np.uint64)
        bits = int(np.bitwise_count(sketches[0] ^ sketches[1]).sum())
        assert abs(neardup.estimate(bits) - share) < 0.1 and (share < 0.8 or bits <= neardup.sketch_limit(0.8))


def test_nearest_keeps_the_first_of_each():
    own, other, bits = np.array([1, 1, 1, 2]), np.array([5, 6, 7, 7]), np.array([3, 1, 2, 9])
    assert neardup._nearest(own, other, bits, 1).tolist() == [False, True, False, True]
    assert neardup._nearest(own, other, bits, 2).tolist() == [False, True, True, True]


def test_components_of_a_long_path_and_loops(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 500), (7, 7), (900, 901), (901, 900), (None, 3)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(201), 0), 900: 900, 901: 900}


def test_joined_equals_components_of_all_edges(spark):
    rng = random.Random(6)
    edge = lambda n: spark.createDataFrame([(rng.randrange(90), rng.randrange(90)) for _ in range(n)], "a long, b long")
    first, more = edge(40).where("a != b"), edge(30).where("a != b")
    both = {tuple(r) for r in components(first.union(more)).collect()}
    assert {tuple(r) for r in joined(components(first), more).collect()} == both
    assert {tuple(r) for r in joined(components(first), more.limit(0)).collect()} == {tuple(r) for r in components(first).collect()}
