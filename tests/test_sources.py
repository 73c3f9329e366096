"""Files in and out, the chunk table, search and streaming."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from quillmill.functions.embedding import EmbeddingProvider, HashProvider, embed
from quillmill.operators import costs, index, pages, search
from quillmill.plans.fixtures import fixture
from quillmill.sources import files
from quillmill.streaming.ingest import ingest


def write(path, *lines):
    path.write_text("\n".join(lines), encoding="utf-8")


def test_jsonl_skips_what_is_no_record(spark, tmp_path):
    write(tmp_path / "a.jsonl", json.dumps({"text": "één", "metadata": {"chunk_index": 3}}), "", "# no", "NOT_JSON", json.dumps({"text": "sparse", "metadata": {}}), "[1]", "3")
    rows = files.records(files.read_jsonl(spark, str(tmp_path))).orderBy("text").collect()
    assert [r["text"] for r in rows] == ["sparse", "één"]
    sparse = rows[0]
    assert (sparse["page_number"], sparse["section"], sparse["quality_score"], sparse["document_id"], sparse["chunk_index"]) == (-1, "", 0.0, "unknown", 0)


def test_text_folder_and_lines_out(spark, tmp_path):
    (tmp_path / "in").mkdir()
    write(tmp_path / "in" / "a.txt", "one\ntwo")
    write(tmp_path / "in" / "b.txt", "  ")
    found = files.read_text_dir(spark, str(tmp_path / "in")).collect()
    assert [r["text"] for r in found] == ["one\ntwo"]
    files.write_lines(spark.range(3).orderBy("id"), F.to_json(F.struct("id")), str(tmp_path / "out"), single=True)
    assert [r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()] == ['{"id":0}', '{"id":1}', '{"id":2}']


CHUNK = "chunk_id string, text string, document_id string, embedding array<float>"


def test_collection_upserts_and_deletes(spark, tmp_path):
    table = index.Collection(spark, str(tmp_path / "chunks"), CHUNK)
    assert table.count() == 0
    rows = [("a", "x", "d1", [1.0, 0.0]), ("b", "y", "d1", [0.0, 1.0]), ("c", "z", "d2", [1.0, 1.0])]
    assert table.add(spark.createDataFrame(rows, CHUNK)) == 3
    assert table.add(spark.createDataFrame([("a", "new", "d1", [1.0, 0.0])], CHUNK)) == 1
    assert table.count() == 3 and table.read().where("chunk_id = 'a'").first()["text"] == "new"
    assert [r["score"] for r in index.get_by_ids(table.read(), ["a", "missing"]).collect()] == [1.0]
    assert table.delete("d1") == 2 and table.delete("absent") == 0 and table.count() == 1
    table.clear()
    assert table.count() == 0


def test_search_caps_by_document(spark):
    rows = [("a1", "t", "a", [1.0, 0.0]), ("a2", "t", "a", [0.9, 0.1]), ("b1", "t", "b", [0.5, 0.5]), ("n", "t", None, [-1.0, 0.0])]
    frame = spark.createDataFrame(rows, CHUNK)
    assert [r["chunk_id"] for r in search.search(frame, [1.0, 0.0], 10).orderBy("rerank_rank").collect()] == ["a1", "a2", "b1", "n"]
    assert [r["chunk_id"] for r in search.search(frame, [1.0, 0.0], 2, per_document=1).orderBy("rerank_rank").collect()] == ["a1", "b1"]
    assert search.cap_per_document(search.top_k(frame, [1.0, 0.0]), 0).count() == 0
    assert search.search(frame, [1.0, 0.0], query="  ").count() == 0
    plan = search.top_k(frame, [1.0, 0.0], 2)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_filters_in_the_where_language(spark):
    assert search.RetrievalFilter().where() is None
    assert search.RetrievalFilter(document_id="").where() == {"document_id": {"$eq": ""}}
    assert search.RetrievalFilter(page_number=3, min_page=1).where() == {"page_number": {"$eq": 3}}
    assert search.RetrievalFilter(document_ids=("a", "b"), min_quality=0.5).where() == {"$and": [{"document_id": {"$in": ["a", "b"]}}, {"quality_score": {"$gte": 0.5}}]}
    for bad in ({"$and": {}}, {"x": 3}, {"x": {"$like": 1}}):
        with pytest.raises(ValueError):
            search.predicate(bad)


class Failing(EmbeddingProvider):
    name, dimensions = "failing", 2

    def embed_batch(self, texts):
        raise RuntimeError("no")


def test_embedding_keeps_rows_and_reports_failures(spark):
    frame = spark.createDataFrame([(1, "a"), (2, None)], "id int, text string")
    rows = embed(frame, HashProvider(8)).orderBy("id").collect()
    assert [len(r["embedding"]) for r in rows] == [8, 8] and rows[0]["error"] is None
    assert {(r["embedding"], r["token_count"], r["error"]) for r in embed(frame, Failing(), attempts=1).collect()} == {(None, -1, "no")}


def test_costs(spark):
    row = costs.costs(spark.createDataFrame([("gpt-4", 100, 50)], "model string, input_tokens int, output_tokens int"), costs.price_table(spark)).first()
    assert (row["total_tokens"], row["total_cost"]) == (150, 0.006)


def test_two_pages_stay_as_they_are(spark):
    rows = [("d", 1, "H\nbody\n1"), ("d", 2, "H\nmore\n2")]
    row = pages.filter_headers_footers(spark.createDataFrame(rows, "k string, page_number int, page string"), "k").first()
    assert row["filtered_text"] == "H\nbody\n1\fH\nmore\n2"


def test_repeated_headers_go(spark):
    rows = [("d", i, f"HEADER\nContent {chr(96 + i)}\nFOOTER\n{i}") for i in range(1, 7)]
    row = pages.filter_headers_footers(spark.createDataFrame(rows, "k string, page_number int, page string"), "k").first()
    assert row["pages_processed"] == 6 and row["filtered_text"] == "\n\n".join(f"Content {chr(96 + i)}" for i in range(1, 7))


def test_filters_reach_the_scan(spark, sf_dir, tmp_path):
    fixture(spark, sf_dir, "idx").write.parquet(str(tmp_path / "idx"))
    plan = search.top_k(spark.read.parquet(str(tmp_path / "idx")), [0.1] * 64, 5, where={"document_id": {"$eq": "doc_1"}}).select("chunk_id", "score")
    text = plan._jdf.queryExecution().toString()
    assert "EqualTo(document_id,doc_1)" in text and "chunker_name" not in text.rpartition("ReadSchema")[2]


def test_stream_of_lines_is_stored_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    write(tmp_path / "in" / "a.jsonl", *(json.dumps({"text": f"text {i}", "metadata": {"chunk_id": f"c{i % 4}", "source_path": "d.pdf"}}) for i in range(6)), "NOT_JSON")
    schema = files.records(spark.createDataFrame([], "text string, metadata " + files.META)).schema.simpleString()[len("struct<") : -1] + ",embedding:array<float>,token_count:bigint,error:string,batch:int"
    table = index.Collection(spark, str(tmp_path / "chunks"), ", ".join(x.replace(":", " ", 1) for x in schema.split(",")))
    for _ in range(2):
        ingest(spark, str(tmp_path / "in"), table, HashProvider(4), str(tmp_path / "check")).awaitTermination()
    assert table.count() == 4


def test_pages_cleaned_one_by_one_equal_whole_texts(spark):
    import random

    from quillmill.functions import text as T

    rng = random.Random(5)
    bits = ["Head of all", "Page 3", "12", "", " ", "\x01", "\x01 ", "\t", "\u00a0 wide", "  begins late and goes on to forty signs", "short line", "- item", "end.", "exam-", "ple here", "e\u0301\ufb01n", "\u2014", "\r", "x\x0cy", "\u0301mark", "a", "\n\n", "\u00adsoft"]
    rows = [(f"k{k}", n, None if rng.random() < 0.03 else "\n".join(rng.choice(bits) for _ in range(rng.randrange(7)))) for k in range(150) for n in range(1, rng.choice([1, 2, 3, 4, 6]) + 1)]
    frame = spark.createDataFrame(rows, "k string, page_number int, page string")
    whole = pages.filter_headers_footers(frame, "k").select("k", "pages_processed", T.normalize(F.col("filtered_text")).alias("x")).select("k", "pages_processed", T.repair_wraps(F.col("x")).alias("text"))
    own = pages.clean_pages(frame, "k").select("k", "pages_processed", "clean_text")
    assert sorted(map(tuple, own.collect())) == sorted(map(tuple, whole.collect()))
    # Nothing but the joining of pages is left to do on a whole document.
    plan = own._jdf.queryExecution().executedPlan().toString()
    assert plan.index("ArrowEvalPython") > plan.index("ObjectHashAggregate")
