"""The ways through the library from end to end: clean, chunk, index, retrieve. Each is one plan over DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions import quality as Q
from quillmill.functions import text as T
from quillmill.functions.embedding import EmbeddingProvider, embed
from quillmill.operators import chunking as C
from quillmill.operators import pages as P
from quillmill.operators import search as S
from quillmill.operators.index import Collection
from quillmill.settings import Settings, ValidationError
from quillmill.sources import files

#: Columns of an index that index_chunks() writes.
RECORD = "chunk_id string, text string, document_id string, chunk_index int, source_file string, page_number int, section string, char_start int, char_end int, word_count int, quality_score double, chunker_name string, document_title string, total_chunks int, quality_level string, embedding array<float>"


def clean(pages: DataFrame, key: str = "source_path") -> DataFrame:
    """(key, clean_text, pages_processed, quality struct, ok) from pages (key, page_number, page): headers and footers go,
    the rest is normalized and its wraps repaired. ok: there is text and its level isn't low or reject."""
    repaired = P.clean_pages(pages, key).select(key, "pages_processed", "clean_text")
    judged = repaired.withColumn("quality", Q.report(F.col("clean_text")))
    return judged.withColumn("ok", Q.gate(F.col("clean_text"), F.col("quality.quality_level")))


def clean_texts(docs: DataFrame, key: str = "source_path", text: str = "text") -> DataFrame:
    """clean() of whole texts, whose pages are cut at form feeds."""
    return clean(P.split_pages(docs, key, text), key)


def chunk_lines(docs: DataFrame, key: str = "source_path", text: str = "text", chunker: str = "semantic", settings: Settings | None = None) -> DataFrame:
    """(line) a JSON line for each chunk of (key, text).

    Where docs come from clean(), their quality and number of pages go into every chunk's metadata; otherwise these are 0.0,
    an empty level and 0.
    """
    settings = settings or Settings.load()
    if chunker not in C.CHUNKERS:
        raise ValidationError(f"unknown chunker {chunker!r}")
    options = {"size": settings.CHUNK_SIZE} | ({"overlap": settings.CHUNK_OVERLAP} if chunker == "sliding" else {})
    judged, paged = "quality" in docs.columns, "pages_processed" in docs.columns
    score = F.coalesce(F.col("quality.overall_score"), F.lit(0.0)) if judged else F.lit(0.0)
    level = F.coalesce(F.col("quality.quality_level"), F.lit("")) if judged else F.lit("")
    n_pages = F.coalesce(F.col("pages_processed"), F.lit(0)).cast("int") if paged else F.lit(0)
    rows = docs.select(F.col(key).alias("source_path"), F.col(text).alias("text"), F.length(text).alias("chars"), n_pages.alias("pages"), score.alias("score"), level.alias("level"))
    chunks = C.chunk(rows, chunker=chunker, **options)
    full = C.with_metadata(chunks, "source_path", F.col("chars"), F.col("pages"), F.col("score"), F.col("level"))
    return full.select(C.to_json_line().alias("line"))


@dataclass
class IndexStats:
    read: int = 0
    skipped: int = 0
    failed: int = 0
    stored: int = 0

    @property
    def success(self) -> bool:
        return self.stored > 0 and not self.failed


def index_chunks(raw: DataFrame, collection: Collection, provider: EmbeddingProvider) -> IndexStats:
    """Embeds and upserts parsed lines (text, metadata); blank texts are skipped, failed batches counted.

    Texts are embedded once: the result is written before it is counted.
    """
    from quillmill.runtime import materialize, release

    records = files.records(raw)
    vectors = materialize(embed(records.where(~T.is_blank(F.col("text"))), provider))
    read = records.count()
    kept, failed = vectors.agg(F.count_if(F.col("error").isNull()), F.count_if(F.col("error").isNotNull())).first()
    if kept:
        collection.add(vectors.where("error is null"))
    release(vectors)
    return IndexStats(read, read - kept - failed, failed, kept)


def index_directory(spark: SparkSession, path: str, collection: Collection, provider: EmbeddingProvider, pattern: str = "*.jsonl") -> IndexStats:
    """index_chunks() of every valid line of the files below path. A path that isn't there is an error, no files give zeros."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        raise ValidationError(f"no such path: {path}")
    return index_chunks(files.read_jsonl(spark, path, pattern), collection, provider)


def retrieve(collection: Collection, query: str, provider: EmbeddingProvider, k: int | None = None, threshold: float | None = None, where: S.RetrievalFilter | None = None, per_document: int = 0, settings: Settings | None = None) -> DataFrame:
    """The best chunks for a query text; k and threshold come from the settings unless given. A blank query gives no rows."""
    settings = settings or Settings.load()
    vector = [0.0] * provider.dimensions if not query.strip() else provider.embed_batch([query_text(query)])[0][0]
    return S.search(collection.read(), vector, settings.TOP_K if k is None else k, settings.SIMILARITY_THRESHOLD if threshold is None else threshold, where, per_document, query=query)


def query_text(query: str) -> str:
    """The query as normalize_for_embedding() would have it, on the driver."""
    import re

    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", query)).strip()
