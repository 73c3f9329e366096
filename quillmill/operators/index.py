"""The table of chunks: upsert, delete, lookup, statistics, and its snapshots on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmill.functions.text import is_blank


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows with the same key the one that came last."""
    newest = Window.partitionBy(key).orderBy(F.desc(order))
    return df.withColumn("_rn", F.row_number().over(newest)).where("_rn = 1").drop("_rn")


def upsert(base: DataFrame, updates: DataFrame, key: str = "chunk_id", order: str | None = None) -> DataFrame:
    """base with updates in place of rows of the same key; ``order`` says which of several updates wins."""
    new = latest(updates, key, order) if order else updates
    return base.join(new.select(key), key, "left_anti").unionByName(new)


def delete_document(df: DataFrame, document_id: str) -> DataFrame:
    return df.where(F.col("document_id").isNull() | (F.col("document_id") != document_id))


def get_by_ids(df: DataFrame, ids: list[str]) -> DataFrame:
    """Rows with these ids, score 1; ids that aren't there give nothing."""
    return df.where(F.col("chunk_id").isin(ids)).withColumn("score", F.lit(1.0))


def stats(chunks: DataFrame, text: str = "text") -> DataFrame:
    """One row: chunks_read, chunks_skipped (blank texts) and chunks_stored."""
    blank = is_blank(F.col(text))
    return chunks.agg(F.count("*").alias("chunks_read"), F.count_if(blank).alias("chunks_skipped"), F.count_if(~blank).alias("chunks_stored"))


class Collection:
    """A chunk table kept as Parquet snapshots below a path; a write makes a new snapshot and then drops the old."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), root, jvm.org.apache.hadoop.fs.Path

    def _snapshots(self) -> list[str]:
        fs, root, make = self._fs()
        if not fs.exists(root):
            return []
        return sorted(s.getPath().toString() for s in fs.listStatus(root) if fs.exists(make(f"{s.getPath().toString()}/_SUCCESS")))

    def read(self) -> DataFrame:
        found = self._snapshots()
        return self.spark.read.schema(self.schema).parquet(found[-1]) if found else self.spark.createDataFrame([], self.schema)

    def _replace(self, df: DataFrame) -> None:
        fs, _, make = self._fs()
        old = self._snapshots()
        number = int(old[-1].rpartition("v")[2]) + 1 if old else 0
        df.write.mode("overwrite").parquet(f"{self.path}/v{number:08d}")
        for path in old:
            fs.delete(make(path), True)

    def add(self, chunks: DataFrame, order: str | None = None) -> int:
        """Upserts chunks; returns how many rows were submitted."""
        names = self.read().columns
        self._replace(upsert(self.read(), (latest(chunks, "chunk_id", order) if order else chunks.dropDuplicates(["chunk_id"])).select(*names)))
        return chunks.count()

    def delete(self, document_id: str) -> int:
        """Deletes a document's chunks; returns how many there were."""
        gone = self.read().where(F.col("document_id") == document_id).count()
        if gone:
            self._replace(delete_document(self.read(), document_id))
        return gone

    def clear(self) -> None:
        self._replace(self.spark.createDataFrame([], self.schema))

    def count(self) -> int:
        return self.read().count()
