"""Pages of documents: splitting, statistics, and headers and footers that repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions import text as T
from quillmill.functions.text import count_words, is_blank, is_page_number, strip


def split_pages(df: DataFrame, key: str, text: str, delimiter: str = "\f") -> DataFrame:
    """(key, page_number from 1, page) of every page that isn't blank; pages are numbered after blank ones are dropped."""
    pages = F.filter(F.split(F.col(text), delimiter), lambda p: ~is_blank(p))
    return df.select(key, F.posexplode(pages).alias("pos", "page")).select(key, (F.col("pos") + 1).alias("page_number"), "page")


def page_stats(pages: DataFrame, text: str = "page") -> DataFrame:
    n = count_words(F.col(text))
    return pages.withColumns({"char_count": F.coalesce(F.length(text), F.lit(0)), "word_count": n, "is_empty": n == 0})


def join_pages(pages: DataFrame, key: str, delimiter: str = "\f") -> DataFrame:
    """(key, full_text, total_words): a document's pages in their order, which are as many as it has."""
    parts = F.array_sort(F.collect_list(F.struct("page_number", "page")))
    return pages.groupBy(key).agg(F.array_join(F.transform(parts, lambda p: p["page"]), delimiter).alias("full_text"), F.sum(count_words(F.col("page"))).alias("total_words"))


def scanned(pages: DataFrame, key: str, least_words: int = 5, fraction: float = 0.7) -> DataFrame:
    """(key, total_pages, empty_pages, is_scanned): empty pages have fewer than least_words words."""
    counts = pages.groupBy(key).agg(F.count("*").alias("total_pages"), F.count_if(count_words(F.col("page")) < least_words).alias("empty_pages"))
    return counts.withColumn("is_scanned", (F.col("total_pages") > 0) & (F.col("empty_pages") / F.col("total_pages") >= fraction))


def repeating_lines(pages: DataFrame, key: str, location: str, lines: int = 3, threshold: float = 0.4, least_pages: int = 3) -> DataFrame:
    """(key, line, n) of the first ("header") or last ("footer") lines of pages that repeat on enough of them.

    Partial counts by document and line; a document of fewer than least_pages pages has none.
    """
    every = F.filter(F.transform(F.split("page", "\n"), strip), lambda x: x != "")
    last = lambda own: F.slice(own, F.greatest(F.size(own) - lines + 1, F.lit(1)), lines)
    edge = F.slice(every, 1, lines) if location == "header" else T.let(every, last)
    total = pages.groupBy(key).agg(F.count("*").alias("_pages")).where(F.col("_pages") >= least_pages)
    counts = pages.select(key, F.explode(edge).alias("line")).where(F.length("line") > 2).groupBy(key, "line").agg(F.count("*").alias("n"))
    return counts.join(total, key).where(F.col("n") >= F.col("_pages") * threshold).select(key, "line", "n")


def page_number_lines(pages: DataFrame, key: str) -> DataFrame:
    """Distinct (key, line) that are page numbers."""
    return pages.select(key, F.explode(F.split("page", "\n")).alias("line")).where(is_page_number(F.col("line"))).select(key, strip(F.col("line")).alias("line")).distinct()


def filter_headers_footers(pages: DataFrame, key: str, page_numbers: bool = True) -> DataFrame:
    """(key, filtered_text, pages_processed): lines that repeat at the edges of pages, and page numbers, are gone.

    pages: (key, page_number, page). Lines to remove are found by aggregates and taken out by an anti join; pages left blank
    go, the others are joined by a blank line. Documents of fewer than three pages stay as they are, joined by form feeds.
    """
    total = pages.groupBy(key).agg(F.count("*").alias("pages_processed"))
    gone = _gone(pages, key, total, page_numbers)
    lines = pages.select(key, "page_number", F.posexplode(F.split("page", "\n")).alias("pos", "raw")).withColumn("line", strip(F.col("raw")))
    kept = lines.join(gone, [key, "line"], "left_anti")
    rows = kept.groupBy(key, "page_number").agg(F.array_sort(F.collect_list(F.struct("pos", "raw"))).alias("rows"))
    cleaned = rows.select(key, "page_number", F.array_join(F.transform("rows", lambda r: r["raw"]), "\n").alias("page"))
    texts = cleaned.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("page_number", "page"))).alias("parts"))
    whole = lambda sep, keep: F.array_join(F.transform(F.filter("parts", keep), lambda p: p["page"]), sep)
    joined = total.join(texts, key, "left")
    text = F.when(F.col("pages_processed") < 3, whole("\f", lambda p: F.lit(True))).otherwise(whole("\n\n", lambda p: ~is_blank(p["page"])))
    return joined.select(key, F.coalesce(text, F.lit("")).alias("filtered_text"), "pages_processed")


def _gone(pages: DataFrame, key: str, total: DataFrame, page_numbers: bool) -> DataFrame:
    """Distinct (key, line) that filter_headers_footers() takes out."""
    gone = repeating_lines(pages, key, "header").select(key, "line").union(repeating_lines(pages, key, "footer").select(key, "line"))
    if page_numbers:
        gone = gone.union(page_number_lines(pages, key).join(total.where("pages_processed >= 3"), key, "left_semi").select(key, "line"))
    return gone.distinct()


def clean_pages(pages: DataFrame, key: str) -> DataFrame:
    """(key, clean_text, pages_processed): filter_headers_footers(), normalize() and repair_wraps() of whole documents.

    A document may have more text than a few copies of it leave memory for, so all but the joining is done page by page. That
    gives the same: pages are joined by a blank line, which no step but the stripping looks across, and a page's line ends
    at its edges become a part of it. Documents of fewer than three pages are one page, cut by form feeds, throughout.
    """
    total = pages.groupBy(key).agg(F.count("*").alias("pages_processed"))
    few = F.col("_few")
    own = pages.join(total.select(key, (F.col("pages_processed") < 3).alias("_few")), key)
    pieces = F.when(few, F.array("page")).otherwise(F.split("page", "\n"))
    lines = own.where("page is not null").select(key, "_few", "page_number", F.posexplode(pieces).alias("pos", "raw"))
    kept = lines.withColumn("line", F.when(~few, strip(F.col("raw")))).join(_gone(pages, key, total, True), [key, "line"], "left_anti")
    unit = F.when(few, 0).otherwise(F.col("page_number")).alias("unit")
    rows = kept.groupBy(key, "_few", unit).agg(F.array_sort(F.collect_list(F.struct("page_number", "pos", "raw"))).alias("rows"))
    page = F.call_function("array_join", F.transform("rows", lambda r: r["raw"]), F.when(few, "\f").otherwise("\n"))
    filled = rows.select(key, "_few", "unit", page.alias("page")).where(few | ~is_blank(F.col("page")))
    normal = filled.select(key, "unit", T.normalize(F.col("page"), skip=("whitespace",)).alias("_x"))  # lambda functions take no Python UDF
    inside = F.regexp_replace(T.inner_whitespace(F.col("_x")), r"\A\n+|\n+\z", "")
    parts = normal.select(key, "unit", inside.alias("_x")).where("_x != ''")
    # The first page that isn't blank loses the white space before it as well, which may make its first line a short one.
    blank = is_blank(F.col("_x"))
    begin = F.when(~blank & F.substring("_x", 1, 1).rlike(T.W), T.repair_wraps(T.lstrip(F.col("_x"))))
    parts = parts.select(key, "unit", T.repair_wraps(F.col("_x")).alias("page"), blank.alias("blank"), begin.alias("begin"), F.lit(None).cast("long").alias("n"))
    # A document's number of pages comes as a row of its own: a join would sort whole texts.
    rows = parts.union(total.select(key, F.lit(None), F.lit(None), F.lit(None), F.lit(None), "pages_processed"))
    text = F.expr(r"listagg(page, '\n\n') within group (order by unit)").alias("text")
    first = F.min(F.when(~F.col("blank"), F.struct("unit", F.when(F.col("begin").isNotNull(), F.col("page")).alias("page"), "begin"))).alias("first")
    joined = rows.groupBy(key).agg(text, first, F.max("n").alias("pages_processed"))
    old, new = F.length(T.lstrip(F.col("first.page"))), F.col("first.begin")
    own = strip(F.col("text"))
    clean = F.when(F.col("text").isNull(), "").when(new.isNull(), own).otherwise(strip(F.concat(new, F.substring(T.lstrip(F.col("text")), old + 1, F.lit((1 << 31) - 1)))))
    return joined.select(key, clean.alias("clean_text"), "pages_processed")


def number_pages(df: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """(key, page_number, page) from rows that are pages already, numbered in their order."""
    return df.select(key, F.row_number().over(Window.partitionBy(key).orderBy(order)).alias("page_number"), F.col(text).alias("page"))
