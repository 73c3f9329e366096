"""Chunkers as Column expressions over one text, and the metadata of chunks.

Packing is sequential, so each chunker folds over counts of words only and emits runs (first, last); texts are cut out after.
A chunk is struct(chunk_index, text, char_start, char_end, word_count). Chunks of fewer than ``least`` words are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions import text as T

SIZE, OVERLAP, LEAST, MOST = 512, 50, 20, 1024
_ALL = (1 << 31) - 1
_RUNS = "array<struct<first:int,last:int>>"


def _numbered(chunks: Column, least: int) -> Column:
    valid = F.filter(chunks, lambda c: c["word_count"] >= least)
    return F.transform(valid, lambda c, i: F.struct(i.alias("chunk_index"), c["text"].alias("text"), c["char_start"].alias("char_start"), c["char_end"].alias("char_end"), c["word_count"].alias("word_count")))


def _chunk(text: Column, start: Column) -> Column:
    return T.let(text, lambda text: _chunk_of(text, start))


def _chunk_of(text: Column, start: Column) -> Column:
    return F.struct(T.strip(text).alias("text"), start.cast("int").alias("char_start"), (start + F.length(text)).cast("int").alias("char_end"), T.count_words(text).alias("word_count"))


def _placed_chunk(text: Column, start: Column, words: Column) -> Column:
    """_chunk() of a text that is stripped and counted already."""
    return F.struct(text.alias("text"), start.cast("int").alias("char_start"), (start + F.length(text)).cast("int").alias("char_end"), words.cast("int").alias("word_count"))


def sliding(text: Column, size: int = SIZE, overlap: int = OVERLAP, least: int = LEAST) -> Column:
    """Windows of ``size`` words, each beginning size - overlap words after the one before."""
    step = max(1, size - overlap)
    return T.let(T.words(text), lambda own: _numbered(_windows(text, own, size, step), least))


def _windows(text: Column, own: Column, size: int, step: int) -> Column:
    n = F.size(own)
    last = F.when(n <= size, 0).otherwise(F.ceil((n - size) / step)).cast("int")
    starts = F.when(n > 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    # Words joined by a space are stripped and counted already.
    part = lambda j, length: F.slice(own, j * step + 1, length)
    joined = lambda words: F.array_join(words, " ")
    windows = F.transform(starts, lambda j: F.struct(F.get(own, j * step).alias("word"), joined(part(j, size)).alias("text"), joined(part(j, step)).alias("moved"), F.least(n - j * step, F.lit(size)).alias("n")))
    locate = lambda what, text: F.call_function("locate", what, text)
    kind = "array<struct<text:string,char_start:int,char_end:int,word_count:int>>"

    def place(acc: Column, w: Column) -> Column:
        # contains() passes quickly over a text that lacks a stretch, locate() doesn't.
        rest = acc["rest"]
        found = F.struct(locate(w["word"], rest).alias("word"), F.when(rest.contains(w["moved"]), locate(w["moved"], rest)).otherwise(0).alias("moved"))
        return T.let(found, lambda at: placed(acc, w, at))

    def placed(acc: Column, w: Column, at: Column) -> Column:
        start = F.when(at["word"] > 0, acc["cursor"] + at["word"] - 1).otherwise(acc["cursor"])
        # The cursor moves on, and what is searched begins later, only past a stretch that the text has word for word.
        some, end = at["moved"] > 0, at["moved"] - 1 + F.length(w["moved"])
        cursor = F.when(some, acc["cursor"] + end).otherwise(acc["cursor"]).cast("int")
        rest = F.when(some, F.substring(acc["rest"], end + 1, F.lit(_ALL))).otherwise(acc["rest"])
        out = F.array_append(acc["out"], _placed_chunk(w["text"], start, w["n"]))
        return F.struct(cursor.alias("cursor"), rest.alias("rest"), out.alias("out"))

    return F.aggregate(windows, F.struct(F.lit(0).alias("cursor"), text.alias("rest"), F.array().cast(kind).alias("out")), place, lambda acc: acc["out"])


def pack_runs(counts: Column, size: int, overlap: int) -> Column:
    """Runs (first, last) of consecutive items with ``size`` words at most where an item itself isn't longer.

    overlap: items of a run that the next begins with, 0 or 1.
    """
    state = F.struct(F.lit(0).alias("i"), F.lit(0).alias("start"), F.lit(0).alias("words"), F.lit(0).alias("before"), F.array().cast(_RUNS).alias("out"))

    def step(a: Column, w: Column) -> Column:
        flush = (a["words"] + w > size) & (a["words"] > 0)
        start = F.when(flush, a["i"] - overlap).otherwise(a["start"])
        words = F.when(flush, a["before"] if overlap else F.lit(0)).otherwise(a["words"]) + w
        out = F.when(flush, F.array_append(a["out"], F.struct(a["start"].alias("first"), (a["i"] - 1).alias("last")))).otherwise(a["out"])
        return F.struct((a["i"] + 1).alias("i"), start.alias("start"), words.alias("words"), w.alias("before"), out.alias("out"))

    def end(a: Column) -> Column:
        return F.when(a["i"] > 0, F.array_append(a["out"], F.struct(a["start"].alias("first"), (a["i"] - 1).alias("last")))).otherwise(a["out"])

    return F.aggregate(counts, state, step, end)


def _texts(items: Column, runs: Column, sep: str) -> Column:
    return F.transform(runs, lambda r: F.array_join(F.slice(items, r["first"] + 1, r["last"] - r["first"] + 1), sep))


def _placed(texts: Column, base: Column) -> Column:
    """Chunks whose offsets add up the lengths of the texts before them, with one character between two."""
    before = lambda texts, g: F.aggregate(F.slice(texts, F.lit(1), g), F.lit(0), lambda a, x: a + F.length(x) + 1)
    return T.let(texts, lambda texts: F.transform(texts, lambda t, g: _chunk(t, base + before(texts, g))))


def by_sentence(text: Column, size: int = SIZE, overlap: int = 1, least_sentence: int = 3, least: int = LEAST) -> Column:
    """Sentences packed greedily; a chunk begins with the last sentence of the one before."""
    kept = F.filter(T.sentences(text), lambda s: T.count_words(s) >= least_sentence)
    return _numbered(_placed(T.let(kept, lambda own: _packed(own, size, overlap)), F.lit(0)), least)


def _packed(sentences: Column, size: int, overlap: int) -> Column:
    return _texts(sentences, pack_runs(F.transform(sentences, T.count_words), size, overlap), " ")


def merge_short(paragraphs: Column, shorter_than: int = 20) -> Column:
    """Paragraphs of few words are appended to the one before."""
    return F.transform(_merged(paragraphs, shorter_than), lambda p: p["text"])


def _merged(paragraphs: Column, shorter_than: int | None) -> Column:
    """Array of struct(text, w): merge_short()'s paragraphs (None: all as they are) and their words, which are counted once."""
    counted = F.transform(paragraphs, lambda p: F.struct(p.alias("text"), T.count_words(p).alias("w")))
    if shorter_than is None:
        return counted

    def group(own: Column, first: Column, last: Column) -> Column:
        whole = lambda part: F.struct(F.array_join(F.transform(part, lambda p: p["text"]), "\n\n").alias("text"), F.aggregate(part, F.lit(0), lambda a, p: a + p["w"]).alias("w"))
        return T.let(F.slice(own, first + 1, last - first), whole)

    def groups(own: Column) -> Column:
        begins = F.array_compact(F.transform(own, lambda p, i: F.when((i == 0) | (p["w"] >= shorter_than), i)))
        return T.let(begins, lambda begins: F.transform(begins, lambda first, g: group(own, first, F.coalesce(F.get(begins, g + 1), F.size(own)))))

    return T.let(counted, groups)


def split_large(paragraph: Column, size: int = SIZE) -> Column:
    """A long paragraph's sentences packed without overlap; an array of texts."""
    return T.let(T.sentences(paragraph), lambda own: _packed(own, size, 0))


def paragraph_runs(paragraphs: Column, size: int, most: int, detect_headers: bool = True) -> Column:
    """Runs (first, last, large, base, words) of paragraphs (text, w), which are stripped; one of more than ``most`` words is a run
    of its own, marked large. base: where a run begins, with one character between two paragraphs."""
    kind = "array<struct<first:int,last:int,large:boolean,base:int,words:int>>"
    run = lambda a, b, large, base, words: F.struct(a.alias("first"), b.alias("last"), F.lit(large).alias("large"), base.alias("base"), words.alias("words"))
    items = F.transform(paragraphs, lambda p: F.struct(p["w"].alias("w"), (F.length(p["text"]) + 1).alias("n"), (T.is_header(p["text"]) if detect_headers else F.lit(False)).alias("header")))
    state = F.struct(*[F.lit(0).alias(c) for c in ("i", "at", "start", "base", "words")], F.array().cast(kind).alias("out"))
    own = lambda a: run(a["start"], a["i"] - 1, False, a["base"], a["words"])

    def step(a: Column, p: Column) -> Column:
        some, large = a["i"] > a["start"], p["w"] > most
        flush = some & (large | p["header"] | (a["words"] + p["w"] > size))
        out = F.when(flush, F.array_append(a["out"], own(a))).otherwise(a["out"])
        out = F.when(large, F.array_append(out, run(a["i"], a["i"], True, a["at"], p["w"]))).otherwise(out)
        start = F.when(large, a["i"] + 1).when(flush, a["i"]).otherwise(a["start"])
        base = F.when(large, a["at"] + p["n"]).when(flush, a["at"]).otherwise(a["base"])
        words = F.when(large, 0).when(flush, p["w"]).otherwise(a["words"] + p["w"])
        return F.struct((a["i"] + 1).alias("i"), (a["at"] + p["n"]).alias("at"), start.alias("start"), base.alias("base"), words.alias("words"), out.alias("out"))

    return F.aggregate(items, state, step, lambda a: F.when(a["i"] > a["start"], F.array_append(a["out"], own(a))).otherwise(a["out"]))


def semantic(text: Column, size: int = SIZE, most: int = MOST, least: int = LEAST, merge: int | None = 20, detect_headers: bool = True) -> Column:
    """Paragraphs packed greedily, short ones merged first, very long ones cut by sentences; headers begin a chunk."""
    return T.let(_merged(T.paragraphs(text), merge), lambda own: _numbered(_grouped(own, size, most, detect_headers), least))


def _grouped(own: Column, size: int, most: int, detect_headers: bool) -> Column:
    runs = paragraph_runs(own, size, most, detect_headers)
    whole = lambda r: F.array_join(F.transform(F.slice(own, r["first"] + 1, r["last"] - r["first"] + 1), lambda p: p["text"]), "\n\n")
    chunks = lambda r: F.when(r["large"], _placed(split_large(F.get(own, r["first"])["text"], size), r["base"])).otherwise(F.array(T.let(whole(r), lambda t: _placed_chunk(t, r["base"], r["words"]))))
    return F.flatten(F.transform(runs, chunks))


CHUNKERS = {"sliding": sliding, "sentence": by_sentence, "semantic": semantic}
NAMES = {"sliding": "SlidingWindowChunker", "sentence": "SentenceSplitter", "semantic": "SemanticChunker"}


def chunk(df: DataFrame, text: str = "text", chunker: str = "semantic", **options) -> DataFrame:
    """df with its text replaced by one row a chunk: the chunk's fields, total_chunks, total_words and chunker_name.

    Narrow: a document's chunks come from its own row. size and overlap are honoured for every chunker.
    """
    rest = [c for c in df.columns if c != text]
    folded = df.select(*rest, CHUNKERS[chunker](F.coalesce(F.col(text), F.lit("")), **options).alias("_chunks"))
    totals = folded.select(*rest, "_chunks", F.size("_chunks").alias("total_chunks"), F.aggregate("_chunks", F.lit(0), lambda a, c: a + c["word_count"]).alias("total_words"))
    return totals.select(*rest, "total_chunks", "total_words", F.lit(NAMES[chunker]).alias("chunker_name"), F.explode("_chunks").alias("_c")).select(*rest, "total_chunks", "total_words", "chunker_name", "_c.*")


def with_metadata(chunks: DataFrame, source: str, total_chars: Column, total_pages: Column, quality_score: Column, quality_level: Column) -> DataFrame:
    """Adds chunk_id, source_path, document_title, page_estimate, char_count and the document's quality to chunk rows."""
    path = F.col(source)
    added = {"chunk_id": T.sha_chunk_id(path, F.col("chunk_index")), "source_path": path, "document_title": T.title(path), "page_estimate": T.page_estimate(F.col("char_start"), total_chars, total_pages), "char_count": F.length("text"), "quality_score": quality_score, "quality_level": quality_level}
    return chunks.withColumns(added)


METADATA = ["chunk_id", "source_path", "document_title", "chunk_index", "total_chunks", "char_start", "char_end", "page_estimate", "word_count", "char_count", "quality_score", "quality_level", "chunker_name"]


def to_json_line(text: str = "text") -> Column:
    """The JSON line of a chunk row: its text and its metadata."""
    return F.to_json(F.struct(F.col(text).alias("text"), F.struct(*METADATA).alias("metadata")))
