"""The ways through the library from end to end, settings, token counts and the command line."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from quillmill import engine
from quillmill.__main__ import main
from quillmill.functions.embedding import HashProvider, embed
from quillmill.functions.tokens import TokenCounter, count_tokens
from quillmill.operators import search
from quillmill.operators.index import Collection
from quillmill.settings import EmbeddingError, PermanentEmbeddingError, Settings, ValidationError
from quillmill.sources import files


def test_clean_chunk_index_and_search(spark, tmp_path):
    (tmp_path / "in").mkdir()
    page = "REPORT\n{}\nPage {}"
    for name in ("first_report", "second"):
        (tmp_path / "in" / f"{name}.txt").write_text("\f".join(page.format(f"{name} part {i} " + "says something new. " * 12, i) for i in range(1, 5)))
    cleaned = engine.clean_texts(files.read_text_dir(spark, str(tmp_path / "in")))
    assert [r["pages_processed"] for r in cleaned.collect()] == [4, 4]
    assert cleaned.where("clean_text like '%REPORT%' or clean_text like '%Page%'").count() == 0
    files.write_lines(engine.chunk_lines(cleaned, text="clean_text", chunker="sliding", settings=Settings(CHUNK_SIZE=40, CHUNK_OVERLAP=10)), F.col("line"), str(tmp_path / "lines"))
    collection, provider = Collection(spark, str(tmp_path / "index"), engine.RECORD), HashProvider(16)
    stats = engine.index_directory(spark, str(tmp_path / "lines"), collection, provider, "*.txt")
    assert stats.success and stats.stored == stats.read == collection.count() > 4
    again = engine.index_directory(spark, str(tmp_path / "lines"), collection, provider, "*.txt")
    assert again.stored == stats.stored == collection.count()
    # What cleaning found out about a document is in its chunks, so that searches can ask for it.
    score = {r["source_path"].rsplit("/")[-1]: round(r["score"], 4) for r in cleaned.select("source_path", F.col("quality.overall_score").alias("score")).collect()}
    stored = collection.read().select("source_file", "quality_score", "quality_level").distinct().collect()
    assert {r["source_file"].rsplit("/")[-1]: round(r["quality_score"], 4) for r in stored} == score and all(r["quality_level"] for r in stored)
    # Ids come from paths, so which chunk is first differs from run to run; some chunks have equal texts.
    text = collection.read().orderBy("chunk_id").first()["text"]
    equal = collection.read().where(F.col("text") == text).count()
    assert engine.retrieve(collection, text, provider, threshold=0.9, where=search.RetrievalFilter(min_quality=0.1).where()).count() == equal > 0
    alone = collection.read().groupBy("text").count().where("count = 1").orderBy("text").first()["text"]
    assert engine.retrieve(collection, alone, provider, threshold=0.9).count() == 1
    best = engine.retrieve(collection, text, provider, threshold=0.9).collect()
    assert best[0]["text"] == text and best[0]["score"] == 1.0
    assert engine.retrieve(collection, " ", provider).count() == 0
    assert engine.index_directory(spark, str(tmp_path / "in"), collection, provider).read == 0
    with pytest.raises(ValidationError):
        engine.index_directory(spark, str(tmp_path / "missing"), collection, provider)


def test_settings():
    assert Settings.load({"TOP_K": "9", "top_k": "1", "OTHER": "x"}) == Settings(TOP_K=9)
    with pytest.raises(ValidationError):
        Settings.load({"TOP_K": "many"})


class Words(TokenCounter):
    def count(self, texts):
        return [len(t.split()) for t in texts]


def test_token_counts(spark):
    frame = spark.createDataFrame([(1, "a b"), (2, None), (3, "")], "i int, t string")
    assert [r["n"] for r in frame.select("i", count_tokens(F.col("t"), Words()).alias("n")).orderBy("i").collect()] == [2, 0, 0]


class Refusing(HashProvider):
    """Refuses texts with "bad", and counts its calls in a file, as it works in other processes."""

    def __init__(self, log, error):
        super().__init__(8)
        self.log, self.error = log, error

    def embed_batch(self, texts):
        with open(self.log, "a") as f:
            f.write("x")
        if any("bad" in t for t in texts):
            raise self.error("refused")
        return super().embed_batch(texts)


@pytest.mark.parametrize("error, calls", [(PermanentEmbeddingError, 1), (EmbeddingError, 2)])
def test_only_errors_that_may_pass_are_tried_again(spark, tmp_path, error, calls):
    log = tmp_path / "calls"
    frame = spark.createDataFrame([("bad",)], "text string").coalesce(1)
    row = embed(frame, Refusing(str(log), error), attempts=2).collect()[0]
    assert (row["embedding"], row["token_count"], row["error"]) == (None, -1, "refused")
    assert log.read_text() == "x" * calls


def test_filter_summary():
    assert search.RetrievalFilter(section="", min_page=0).summary() == "RetrievalFilter(section='', min_page=0)"
    assert search.RetrievalFilter().summary() == "RetrievalFilter()"


def test_filter_helpers():
    assert search.for_page_range(2, 4) == search.RetrievalFilter(min_page=2, max_page=4).where()
    assert search.for_document("d") == search.RetrievalFilter(document_id="d").where()
    assert search.RetrievalFilter().is_empty() and not search.RetrievalFilter(section="").is_empty()
    assert search.valid(None) and search.valid({"$or": [search.for_section("s"), search.for_source_file("f")]})
    assert not any(map(search.valid, ([], "x", {"a": 1}, {"$and": {}}, {"a": {"$no": 1}})))


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    assert main(["cost", "--model", "gpt-4", "--input-tokens", "100", "--output-tokens", "50"]) == 0
    assert "$0.006000 total" in capsys.readouterr().out
    assert main(["cost", "--list-models"]) == 0
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("one two three four five six seven eight nine ten. " * 12)
    count = {}
    for size in (20, 60):
        assert main(["chunk", str(tmp_path / "in"), str(tmp_path / f"out{size}"), "--chunker", "sliding", "--chunk-size", str(size), "--overlap", "5", "--clean"]) == 0
        count[size] = spark.read.text(str(tmp_path / f"out{size}")).count()
    assert count[20] > count[60] > 0
    monkeypatch.setenv("INDEX_DIR", str(tmp_path / "index"))
    assert main(["index", str(tmp_path / "missing")]) == 1
    cleaned = tmp_path / "cleaned"
    assert main(["clean", str(tmp_path / "in"), str(cleaned), "--text-files"]) == 0
    assert [r["name"] for r in files.read_texts(spark, "name", str(cleaned / "texts")).collect()] == ["a"]
    report = json.loads(spark.read.text(str(cleaned / "reports")).first()[0])
    assert set(report) == {"source", "quality_level", "overall_score", "word_count", "passed", "warnings", "failed_checks"}
    assert report["word_count"] == 120
    monkeypatch.setenv("INDEX_DIR", str(tmp_path / "index"))
    assert main(["index", str(tmp_path / "out20")]) in (0, 1)
    assert main(["search", "one two", "--document-id", "none", "--min-quality", "0.5"]) == 0
