from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmill.llm import mixing, queries

DOC = "doc_id long, text string, domain string"
TARGETS = {"high": 0.6, "low": 0.3, "toxic": 0.1}


def corpus(spark, n=600):
    rng = random.Random(3)
    kinds = {"high": "good fine clear".split(), "low": "meh junk spam".split(), "toxic": "bad vile foul".split()}
    rows, labels = [], []
    for i in range(n):
        kind = rng.choices(list(kinds), [0.3, 0.5, 0.2])[0]
        rows.append((i, " ".join(rng.choice(kinds[kind] + ["the", "and"]) for _ in range(rng.randint(5, 60))), kind))
        if i % 3 == 0:
            labels.append((i, kind))
    return spark.createDataFrame(rows, DOC), spark.createDataFrame(labels, "doc_id long, domain string"), rows


def test_expected_totals_match_the_targets(spark):
    docs, labels, rows = corpus(spark)
    got = mixing.mix(docs, labels, TARGETS).collect()
    assert len(got) == len(rows)
    total = np.zeros(3)
    for r in got:
        assert 0 <= r["rate"] <= 1 and r["copies"] in (0, 1) and abs(sum(r["domain_p"]) - 1) < 1e-6
        total += r["tokens"] * r["rate"] * np.array(r["domain_p"])
    np.testing.assert_allclose(total / total.sum(), [0.6, 0.3, 0.1], atol=0.01)
    assert {r["doc_id"]: r["tokens"] for r in got} == {i: len(t.split()) for i, t, _ in rows}
    right = sum(sorted(TARGETS)[int(np.argmax(r["domain_p"]))] == rows[r["doc_id"]][2] for r in got)
    assert right > 0.95 * len(rows)


def test_rates_are_a_least_squares_optimum(spark):
    """No projected gradient step by hand lowers the squared error that fit() reaches."""
    docs, labels, _ = corpus(spark, 300)
    got = mixing.mix(docs, labels, TARGETS, tokens=1e9).collect()  # more than there is: every bound matters
    p, n, rate = (np.array([r[c] for r in got]) for c in ("domain_p", "tokens", "rate"))
    aim = 1e9 * np.array([0.6, 0.3, 0.1])
    assert (rate == 1).all()  # each document adds to totals that are all too small
    assert (n @ p < aim).all()


def test_nulls_empty_texts_repeats_and_empty_tables(spark):
    docs, labels, _ = corpus(spark, 60)
    odd = docs.union(spark.createDataFrame([(1000, None, None), (1001, "", "x"), (None, "good", "x"), (1002, "good good", "x"), (1002, "fine", "x")], DOC))
    got = {r["doc_id"]: r for r in mixing.mix(odd, labels, TARGETS).collect()}
    assert got[1000]["tokens"] == got[1001]["tokens"] == 0 and got[1002]["tokens"] == 3 and None in got
    none = labels.limit(0)
    assert mixing.mix(docs, none, TARGETS).count() == 60
    assert mixing.mix(docs.limit(0), labels, TARGETS).count() == 0


def test_labels_of_a_key_are_one_domain(spark):
    rows = [(1, 1, 0), (1, 0, 1), (2, None, None), (3, 1, None), (None, 1, 0)]
    got = {r["doc_id"]: r["domain"] for r in mixing.domain_of_labels(spark.createDataFrame(rows, "doc_id long, quality int, toxic int")).collect()}
    assert got == {1: "toxic", 2: "low", 3: "high"}


def test_plans_hold_no_python(spark, sf_dir):
    plan = queries.op5_mix_sources(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


@pytest.mark.parametrize("most", [1.0, 3.0])
def test_copies_follow_the_rate(spark, most):
    docs, labels, _ = corpus(spark, 200)
    got = mixing.mix(docs, labels, TARGETS, most=most).collect()
    assert all(int(r["rate"]) <= r["copies"] <= int(r["rate"]) + 1 for r in got)
    assert abs(sum(r["copies"] for r in got) - sum(r["rate"] for r in got)) < 4 * len(got) ** 0.5


def test_the_sample_is_the_smallest_hashes_of_each_domain(spark, monkeypatch):
    monkeypatch.setattr(mixing, "PER_DOMAIN", 60)
    labels = spark.createDataFrame([(i, "high" if i % 10 else "low") for i in range(5000)] + [(9000, "toxic")], "doc_id long, domain string")
    hashed: dict = {}
    for r in labels.withColumn("h", F.xxhash64("doc_id")).orderBy("h").collect():
        hashed.setdefault(r["domain"], []).append(r["doc_id"])
    got: dict = {}
    for r in mixing.sample(labels, {d: len(x) for d, x in hashed.items()}, sorted(hashed)).collect():
        got.setdefault(r["domain"], set()).add(r["_id"])
    assert got == {d: set(x[:60]) for d, x in hashed.items()}


@pytest.mark.parametrize("more", [0.6, 1.0, 1.5])
def test_squared_error_is_that_of_bounded_least_squares(spark, more):
    """Against accelerated projected gradient steps on all rates in numpy, for totals below, at and beyond what there is."""
    docs, labels, _ = corpus(spark, 300)
    members = mixing.mix(docs, labels, TARGETS).select("doc_id", "tokens", F.col("domain_p").alias("p")).cache()
    rows = members.collect()
    a = np.array([np.array(r["p"]) * r["tokens"] for r in rows]).T
    tokens = more * min(a.sum(axis=1) / np.array([0.6, 0.3, 0.1]))
    aim = tokens * np.array([0.6, 0.3, 0.1])
    _, totals, _ = mixing.fit(members, [0.6, 0.3, 0.1], tokens)
    rate = ahead = np.full(a.shape[1], 0.5)
    step = 1 / np.linalg.norm(a @ a.T, 2)
    for i in range(20_000):
        new = np.clip(ahead - step * a.T @ (a @ ahead - aim), 0, 1)
        ahead, rate = new + i / (i + 3) * (new - rate), new
    least = np.linalg.norm(a @ rate - aim)
    assert np.linalg.norm(np.subtract(totals, aim)) <= least + 1e-3 * tokens
