"""Chunkers against restatements in plain Python."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from quillmill.operators import chunking as C
from quillmill.functions import text as T

END = re.compile(r"((?<![A-Z][a-z])(?<!\d)[.!?][\"')\]]?)(?=\s+[A-Z0-9])")


def sentences(text: str) -> list[str]:
    return [s.strip() for s in END.sub("\\1\0", text).split("\0") if s.strip()]


def count(text: str) -> int:
    return len(text.split())


def greedy(items: list[str], size: int, overlap: int) -> list[tuple[int, int]]:
    out, start, words = [], 0, 0
    for i, item in enumerate(items):
        n = count(item)
        if words and words + n > size:
            out.append((start, i))
            start, words = (i - 1, count(items[i - 1])) if overlap else (i, 0)
        words += n
    return [*out, (start, len(items))] if items else []


def numbered(chunks, least: int):
    made = [(t.strip(), at, at + len(t), count(t)) for t, at in chunks]
    return [(i, *c) for i, c in enumerate(c for c in made if c[3] >= least)]


def by_sentence(text: str, size: int, least: int):
    own, at, out = [s for s in sentences(text) if count(s) >= 3], 0, []
    for a, b in greedy(own, size, 1):
        joined = " ".join(own[a:b])
        out.append((joined, at))
        at += len(joined) + 1
    return numbered(out, least)


def is_header(p: str) -> bool:
    p = p.strip()
    return bool(p) and len(p) <= 120 and bool(re.match(r"#{1,6}\s+[^\n]|\d+\.\d*\s+[A-Z]|(?i:chapter|section|part)\s+\d", p) or re.match(r"[A-Z][A-Z\s]{4,}(?=\n|\Z)", p))


def semantic(text: str, size: int, most: int, least: int, merge):
    paragraphs = [p.strip() for p in re.split(r"\n{2,}", text.strip()) if p.strip()]
    if merge is not None:
        merged: list[str] = []
        for p in paragraphs:
            if merged and count(p) < merge:
                merged[-1] += "\n\n" + p
            else:
                merged.append(p)
        paragraphs = merged
    out, parts, words, at = [], [], 0, 0

    def flush():
        nonlocal parts, words, at
        if parts:
            out.append(("\n\n".join(parts), at))
            at += sum(map(len, parts)) + len(parts)
        parts, words = [], 0

    for p in paragraphs:
        n = count(p)
        if n > most:
            flush()
            inner, own = at, sentences(p)
            for a, b in greedy(own, size, 0):
                out.append((" ".join(own[a:b]), inner))
                inner += len(" ".join(own[a:b])) + 1
            at += len(p) + 1
            continue
        if parts and (is_header(p) or words + n > size):
            flush()
        parts.append(p)
        words += n
    flush()
    return numbered(out, least)


def sliding(text: str, size: int, overlap: int, least: int):
    words, step, cursor, out, i = text.split(), max(1, size - overlap), 0, [], 0
    while words:
        part = words[i : i + size]
        found = text.find(part[0], cursor)
        out.append((" ".join(part), found if found >= 0 else cursor))
        moved = " ".join(words[i : i + step])
        if (at := text.find(moved, cursor)) >= 0:
            cursor = at + len(moved)
        if i + size >= len(words):
            break
        i += step
    return numbered(out, least)


def texts() -> list[str]:
    rng, out = random.Random(5), ["", "  ", "One.", "A b c.", "word " * 200]
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(1, 90)):
            sentence = " ".join(rng.choice(["Alpha", "beta", "gamma's", "Dr", "é", "x1", "9", "delta"]) for _ in range(rng.randint(1, 14)))
            parts.append(sentence + rng.choice([". ", "! ", '." ', "? ", ".\n", "\n\n", "\n\nSECTION 4\n\n", "  "]))
        out.append("".join(parts))
    return out


FIELDS = ["chunk_index", "text", "char_start", "char_end", "word_count"]


@pytest.mark.parametrize(
    ("column", "plain"),
    [
        (lambda t: C.by_sentence(t, 40, 1, 3, 5), lambda t: by_sentence(t, 40, 5)),
        (lambda t: C.semantic(t, 60, 120, 5, 20), lambda t: semantic(t, 60, 120, 5, 20)),
        (lambda t: C.semantic(t, 30, 40, 1, None), lambda t: semantic(t, 30, 40, 1, None)),
        (lambda t: C.sliding(t, 25, 7, 3), lambda t: sliding(t, 25, 7, 3)),
    ],
    ids=["sentence", "semantic", "semantic-unmerged", "sliding"],
)
def test_chunks_equal_plain_python(spark, column, plain):
    docs = spark.createDataFrame(list(enumerate(texts())), "id int, text string").repartition(4)
    got = {r["id"]: [tuple(c[f] for f in FIELDS) for c in r["chunks"]] for r in docs.select("id", column(F.col("text")).alias("chunks")).collect()}
    for i, text in enumerate(texts()):
        assert got[i] == plain(text), i


def test_metadata_of_chunks(spark):
    docs = spark.createDataFrame([("in/annual_report.pdf", "Word " * 30)], "path string, text string")
    made = C.with_metadata(C.chunk(docs, chunker="sliding"), "path", F.lit(150), F.lit(3), F.lit(0.85), F.lit("high")).first()
    assert (made["document_title"], made["quality_score"], made["quality_level"], made["page_estimate"], made["total_chunks"]) == ("Annual Report", 0.85, "high", 1, 1)
    assert len(made["chunk_id"]) == 16


def test_let_binds_inside_lambdas(spark):
    row = spark.sql("SELECT array(1, 2) AS a").select(T.let(F.size("a"), lambda n: F.transform("a", lambda x: x + n)).alias("y")).first()
    assert row["y"] == [3, 4]


def seconds(spark, text: str, chunks) -> float:
    import time

    frame = spark.createDataFrame([(text,)], "text string").select(F.size(chunks(F.col("text"))).alias("n"))
    began = time.time()
    assert frame.head()["n"] > 0
    return time.time() - began


def test_a_window_is_searched_for_once(spark):
    # A search of the text for the window's first word and one for the stretch that the next begins after.
    assert str(C.sliding(F.col("t"), 60, 15)).count("locate") == 2


def test_many_short_paragraphs_are_merged_in_little_time(spark):
    text = "\n\n".join(f"some words {i}" for i in range(100_000))
    assert seconds(spark, text, lambda t: C.semantic(t)) < 15
