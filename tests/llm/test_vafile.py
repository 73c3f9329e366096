from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmill.llm import oracles, queries, vafile
from tests.conftest import same_rows

ROW = "vec_id long, embedding array<float>, score int"


def brute(rows, k):
    good = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, _ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, a in good:
        if q % 50 == 0:
            found = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in good if i != q and len(a) == len(b))[:k]
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(found)}
    return out


def test_equals_brute_force_with_ties_nulls_and_short_lists(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in np.round(rng.standard_normal(8), 1)], 0) for i in range(1, 400)]
    rows += [(i, [0.5] * 8, 0) for i in range(400, 520)]  # equal scores
    rows += [(600, None, 0), (650, [None, *[0.1] * 7], 0), (700, [float("nan")] * 8, 0), (750, [float("inf")] * 8, 0), (None, [0.1] * 8, 0), (800, [], 0), (850, [1.0, 2.0], 0), (851, [2.0, 2.0], 0)]
    frame = spark.createDataFrame(rows, ROW).repartition(3)
    got = {tuple(r) for r in vafile.top_k(frame, F.col("vec_id") % 50 == 0).select("query_id", "rank", "vec_id", "score").collect()}
    assert got == brute(rows, 5)
    assert vafile.top_k(spark.createDataFrame([], ROW), F.col("vec_id") % 50 == 0).count() == 0


def test_query_equals_its_sql(spark, sf_dir, duck):
    same_rows(queries.op4_exact_top_k(spark, sf_dir), duck, oracles.TOP_K)


@pytest.mark.parametrize("width", [1, 5, 40])
def test_bounds_hold_for_every_vector_in_the_cells(width):
    rng = np.random.default_rng(width)
    cells, low = rng.integers(0, 256, (200, 16)), rng.integers(-9000, 9000, 200)
    inside = low[:, None] + cells * width + rng.integers(0, width, cells.shape)
    query = rng.integers(-300, 300, (7, 16))
    least, most = vafile.bounds(query.astype(float), low.astype(float), np.full(200, float(width)), cells.astype(float))
    score = query @ inside.T
    assert (least <= score).all() and (score <= most).all()


def test_wide_cells_still_give_exact_results(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in 40 * rng.standard_normal(16)], 0) for i in range(600)]  # a component's cells are wider than 1
    monkeypatch.setattr(vafile, "VECTORS", 150)  # several tiles
    monkeypatch.setattr(vafile, "QUERIES", 5)
    got = {tuple(r) for r in vafile.top_k(spark.createDataFrame(rows, ROW), F.col("vec_id") % 50 == 0).collect()}
    assert got == {t for t in brute([(i, list(np.float32(v)), 0) for i, v, _ in rows], 5)}


def test_approximations_hold_their_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, i, [int(x) for x in rng.integers(-(10**e), 10**e, 9)]) for i, e in enumerate([1, 2, 3, 5, 9, 15])]
    frame = spark.createDataFrame(rows, "row long, id long, v array<long>")
    for r in vafile.approximate(frame).collect():
        for x, cell in zip(rows[r["row"]][2], r["cells"], strict=True):
            floor = r["low"] + (cell + 128) * r["width"]
            assert floor <= x < floor + r["width"]


def test_a_vector_that_most_rows_share_is_approximated_for_few_of_them(spark):
    rows = [(i, [0.5, 0.25] if i % 3 else [0.01 * i, -0.5], 0) for i in range(900)]
    got = {tuple(r) for r in vafile.top_k(spark.createDataFrame(rows, ROW), F.col("vec_id") % 50 == 0).collect()}
    assert got == brute(rows, 5)


def test_repeated_rows_are_candidates_once_each(spark):
    rows = [(0, [1.0, 0.0], 0), (1, [3.0, 0.0], 0), (1, [3.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, [1.0, 1.0], 0)]
    got = [tuple(r) for r in vafile.top_k(spark.createDataFrame(rows, ROW), F.col("vec_id") == 0, k=3).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 3 * 65536), (0, 2, 1, 3 * 65536), (0, 3, 2, 2 * 65536)]


def test_large_components(spark):
    rows = [(i, [9.0e6 - 1000 * (i % 7), 3.0 - i]) for i in range(60)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    exact = {r["vec_id"]: [math.floor(256 * x) for x in r["embedding"]] for r in frame.collect()}
    found = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in vafile.top_k(frame, F.col("vec_id") % 50 == 0, k=3).orderBy("query_id", "rank").collect()]
    want = []
    for q in (0, 50):
        best = sorted((-sum(a * b for a, b in zip(exact[q], v, strict=True)), i) for i, v in exact.items() if i != q)[:3]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert found == want
