"""Streaming ingestion of chunk lines into a collection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillmill.functions.embedding import EmbeddingProvider, embed
from quillmill.operators.index import Collection
from quillmill.sources.files import parse_lines, records


def ingest(spark: SparkSession, path: str, collection: Collection, provider: EmbeddingProvider, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Upserts the chunks of new ``*.jsonl`` files. Upserts by id make a batch that is tried again harmless."""
    lines = spark.readStream.schema("value string").option("pathGlobFilter", "*.jsonl").text(path)

    def store(batch: DataFrame, number: int) -> None:
        raw = parse_lines(batch).where("status = 'ok'").select("raw.text", "raw.metadata")
        chunks = embed(records(raw).where("trim(text) != ''"), provider).where("error is null")
        collection.add(chunks.withColumn("batch", F.lit(number)))

    writer = lines.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
