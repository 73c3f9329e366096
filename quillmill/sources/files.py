"""Reading and writing of documents, pages and chunk lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions import text as T
from quillmill.runtime import prepare

META = "struct<chunk_id:string,document_id:string,source_path:string,source_file:string,document_title:string,chunk_index:int,total_chunks:int,char_start:int,char_end:int,page_estimate:int,page_number:int,section:string,word_count:int,quality_score:double,quality_level:string,chunker_name:string>"
LINE = f"struct<text:string,metadata:{META}>"


def parse_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """Adds status ("blank", "comment", "malformed" or "ok"), and raw (struct, null unless ok), to lines of JSON."""
    line = T.strip(F.col(value))
    parsed = F.try_parse_json(line)
    status = F.when(F.col(value).isNull() | (line == ""), "blank").when(line.startswith("#"), "comment").when(parsed.isNull() | ~line.startswith("{"), "malformed").otherwise("ok")
    return lines.withColumn("status", status).withColumn("raw", F.when(F.col("status") == "ok", F.from_json(line, LINE)))


def read_jsonl(spark: SparkSession, path: str, pattern: str = "*.jsonl") -> DataFrame:
    """Valid lines as (file, text, metadata); a path that isn't there is an error of Spark's reader."""
    lines = spark.read.text(path, pathGlobFilter=pattern).select("value", F.col("_metadata.file_path").alias("file"))
    return parse_lines(lines).where("status = 'ok'").select("file", "raw.text", "raw.metadata")


def records(raw: DataFrame, text: Column | None = None, meta: str = "metadata") -> DataFrame:
    """Chunk records from parsed lines, with aliases and defaults for what lines lack. A field that is null counts as absent."""
    m = lambda name: F.col(f"{meta}.{name}")
    path = F.coalesce(m("source_path"), m("source_file"), F.lit(""))
    document = F.coalesce(m("document_id"), F.when(path != "", T.stem(path)), F.lit("unknown"))
    index = F.coalesce(m("chunk_index"), F.lit(0))
    return raw.select(
        F.coalesce(m("chunk_id"), T.uuid5_chunk_id(document, index)).alias("chunk_id"),
        (F.col("text") if text is None else text).alias("text"),
        document.alias("document_id"),
        index.alias("chunk_index"),
        path.alias("source_file"),
        F.coalesce(m("page_estimate"), m("page_number"), F.lit(-1)).alias("page_number"),
        F.coalesce(m("section"), F.lit("")).alias("section"),
        F.coalesce(m("char_start"), F.lit(0)).alias("char_start"),
        F.coalesce(m("char_end"), F.lit(0)).alias("char_end"),
        F.coalesce(m("word_count"), F.lit(0)).alias("word_count"),
        F.coalesce(m("quality_score"), F.lit(0.0)).alias("quality_score"),
        F.coalesce(m("chunker_name"), F.lit("")).alias("chunker_name"),
        F.coalesce(m("document_title"), F.lit("")).alias("document_title"),
        F.coalesce(m("total_chunks"), F.lit(-1)).alias("total_chunks"),
        F.coalesce(m("quality_level"), F.lit("")).alias("quality_level"),
    )


FLAT = ["document_id", "chunk_index", "source_file", "page_number", "section", "char_start", "char_end", "word_count", "quality_score", "chunker_name"]


def flat_metadata(extra: dict[str, Column]) -> Column:
    """Map of a record's ten fields as strings; extra entries override those of the same name."""
    fields = {**{c: F.col(c) for c in FLAT}, **extra}
    return F.create_map(*[x for k, v in fields.items() for x in (F.lit(k), F.coalesce(v.cast("string"), F.lit("")))])


def read_text_dir(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """(source_path, text) of the files right below path that aren't blank, each read whole."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter=pattern)
    return files.select(F.col("_metadata.file_path").alias("source_path"), F.col("value").alias("text")).where(~T.is_blank(F.col("text")))


def read_pdf_pages(spark: SparkSession, path: str) -> DataFrame:
    """(source_path, page_number, page, error) of PDF files; needs PyMuPDF on the executors. A file that fails has one row."""
    prepare(spark)

    def run(batches):
        import pandas as pd
        import pymupdf

        for pdf in batches:
            rows = []
            for source, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    with pymupdf.open(stream=content, filetype="pdf") as doc:
                        rows += [(source, i + 1, page.get_text(), None) for i, page in enumerate(doc)]
                except Exception as e:  # noqa: BLE001  the error is part of the result
                    rows.append((source, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["source_path", "page_number", "page", "error"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").load(path)
    return files.select("path", "content").mapInPandas(run, "source_path string, page_number int, page string, error string")


def write_lines(df: DataFrame, line: Column, path: str, single: bool = False) -> None:
    """Writes one line a row; ``single`` gives one file, in the order of df."""
    out = df.select(line.alias("value"))
    (out.coalesce(1) if single else out).write.mode("overwrite").text(path)


def write_texts(df: DataFrame, name: str, text: str, path: str) -> None:
    """Clean texts below path, in a folder for each name. Rows of a name are brought together, so that it has one file."""
    df.select(F.col(name), F.col(text).alias("value")).repartition(name).write.mode("overwrite").partitionBy(name).text(path, lineSep="\0")


def read_texts(spark: SparkSession, name: str, path: str) -> DataFrame:
    """(name, text) as write_texts() left them; a name is a string, whatever it looks like."""
    found = spark.read.schema(f"value string, `{name}` string").text(path, lineSep="\0")
    return found.select(name, F.col("value").alias("text"))
