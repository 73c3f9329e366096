from __future__ import annotations

import zlib

from quillmill.llm import langid, queries

DOC = "doc_id long, text string, lang string, source string"


def test_held_out_accuracy_and_columns(spark, sf_dir):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = queries.op7_language_id(spark, sf_dir).collect()
    assert len(got) == len(docs)
    judged = []
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1
        if r["held_out"] and docs[r["doc_id"]]["lang"]:
            judged.append(r["lang_pred"] == docs[r["doc_id"]]["lang"])
    assert sum(judged) >= 0.95 * len(judged)


def test_odd_texts_rejection_and_empty_tables(spark):
    learnt = langid.learn(spark.createDataFrame([(i, "the cat and the dog " * 4, "en", "s") for i in range(5)] + [(9 + i, "le chat et le chien " * 4, "fr", "s") for i in range(5)], DOC))
    assert sorted(learnt) == ["en", "fr"]
    rows = [(1, None, "en", "s"), (2, "", None, None), (3, "12 + 3 = 15 !!", "fr", "s"), (4, "the dog and the cat and the dog", "fr", "s"), (5, "le chien et le chat et le chien", "en", "s"), (6, "q", None, None), (6, "q", None, None), (7, "le chat et " * 30_000, None, None)]
    frame = spark.createDataFrame(rows, DOC)
    got = {r["doc_id"]: (r["lang_pred"], r["accepted"]) for r in langid.identify(frame, learnt).collect()}
    assert [got[i] for i in (1, 2, 3)] == [("und", False)] * 3
    assert got[4] == ("en", True) and got[5] == ("fr", True) and got[7] == ("fr", True)
    assert all(not r["accepted"] for r in langid.identify(frame, learnt, least_margin=10**9).collect())
    assert {r["lang_pred"] for r in langid.identify(frame, {}).collect()} == {"und"}
    assert langid.identify(frame.limit(0), learnt).count() == 0 and langid.learn(frame.limit(0)) == {}


def test_labels_of_held_out_rows_teach_nothing(spark):
    rows = [(1, "the cat", "en", "s"), (2, "le chat", "fr", "s")]
    from pyspark.sql import functions as F

    assert sorted(langid.learn(spark.createDataFrame(rows, DOC), where=F.col("doc_id") != 2)) == ["en"]


def test_mixed_and_foreign_texts_go_and_clean_ones_stay_by_default(spark, sf_dir):
    import random

    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*corpus_pipeline.COLUMNS)
    rng = random.Random(5)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(2, 9)))
    plain = {r["lang"]: r["text"] for r in docs.where("length(text) between 4000 and 20000").orderBy("doc_id").collect() if r["lang"]}
    one, two = sorted(plain)[:2]
    odd = [" ".join(word("abcdefghijklmnopqrstuvwxyz") for _ in range(n)) for n in (200, 2000)] + [" ".join(word("αβγδεζηθικλμνξοπ") for _ in range(n)) for n in (50, 2000)]
    odd += [f"{plain[one][:4000]} {plain[two][:4000]}"]
    rows = [(-1 - i, t, None, "s", len(t)) for i, t in enumerate(odd)]
    frame = docs.union(spark.createDataFrame(rows, docs.schema))
    kept = {r["doc_id"] for r in corpus_pipeline.language_id(spark, frame, sf_dir).collect()}
    assert not [i for i in kept if i < 0]
    labelled = {r["doc_id"] for r in docs.where("lang is not null and length(text) > 200").collect()}
    assert len(labelled - kept) <= 0.02 * len(labelled)
