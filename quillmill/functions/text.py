"""Cleaning, splitting and naming of texts as Column expressions.

White space everywhere means the characters that Python's str.split() splits on; Spark's trim() and Java's \\s know fewer. A
null text gives null, but for counts, which are 0.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space for use inside a character class of Java's regular expressions; W is such a class.
INNER = r"\t-\r\x1c-\x20\x85\p{Z}"
W = f"[{INNER}]"
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
SENTENCE_END = rf"((?<![A-Z][a-z])(?<!\p{{Nd}})[.!?][\"')\]]?)(?={W}+[A-Z0-9])"
BULLET = rf"^{W}*(?:[•‣◦⁃∙]|[-*]|\p{{Nd}}+[.)]|[a-zA-Z][.)]) "
PAGE_NUMBER = rf"^(?:\p{{Nd}}+|[Pp]age{W}+\p{{Nd}}+|-{W}*\p{{Nd}}+{W}*-|\p{{Nd}}+{W}*/{W}*\p{{Nd}}+)\z"
SECTION = rf"^(?:#{{1,6}}{W}+[^\n]|[A-Z][A-Z{INNER}]{{4,}}(?=\n|\z)|\p{{Nd}}+\.\p{{Nd}}*{W}+[A-Z]|(?i:Chapter|Section|Part){W}+\p{{Nd}})"


def let(value: Column, body) -> Column:
    """body(value), with value computed once for each row however often body names it, inside lambda functions as well."""
    return F.get(F.transform(F.array(value), body), 0)


def strip(c: Column) -> Column:
    """Only a text that begins or ends with white space goes through the regular expression, which looks at every character."""
    edge = lambda own, at: F.substring(own, at, 1).rlike(W)
    return let(c, lambda own: F.when(edge(own, 1) | edge(own, -1), F.regexp_replace(own, rf"\A{W}+|{W}+\z", "")).otherwise(own))


def lstrip(c: Column) -> Column:
    return F.regexp_replace(c, rf"\A{W}+", "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, rf"{W}+\z", "")


def words(c: Column) -> Column:
    """Array of the words between white space."""
    return F.array_remove(F.split(c, f"{W}+"), "")


def count_words(c: Column) -> Column:
    return F.coalesce(F.when(c.isNotNull(), F.size(words(c))), F.lit(0))


def is_blank(c: Column) -> Column:
    return c.isNull() | ~c.rlike(f"[^{INNER}]")


# Normalization: one function a step, in the order in which normalize() applies them.


def unicode_form(c: Column, form: str = "NFC") -> Column:
    """NFC, NFD, NFKC or NFKD. The only step that Spark has no function for: an Arrow UDF that lets ASCII texts pass."""
    if form not in ("NFC", "NFD", "NFKC", "NFKD"):
        raise ValueError(f"unknown form {form!r}")

    @F.pandas_udf(StringType())
    def normalized(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize(form, t))

    return normalized(c)


def ligatures(c: Column) -> Column:
    for old, new in LIGATURES.items():
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def soft_hyphens(c: Column) -> Column:
    return F.replace(c, F.lit("­"), F.lit(""))


def quotes(c: Column) -> Column:
    return F.translate(c, "“”‘’", "\"\"''")


def dashes(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("–"), F.lit("-")), F.lit("—"), F.lit("--"))


def control_chars(c: Column) -> Column:
    """Form feeds go too, which joins the words on either side of a page break."""
    return F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")


def inner_whitespace(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r"\n{3,}", "\n\n")


def whitespace(c: Column) -> Column:
    return strip(inner_whitespace(c))


STEPS = {"unicode_NFC": unicode_form, "ligatures": ligatures, "soft_hyphens": soft_hyphens, "quotes": quotes, "dashes": dashes, "control_chars": control_chars, "whitespace": whitespace}


def normalize(c: Column, skip: tuple[str, ...] = ()) -> Column:
    for name, step in STEPS.items():
        if name not in skip:
            c = step(c)
    return c


def normalize_changes(c: Column, skip: tuple[str, ...] = ()) -> Column:
    """Array of the steps that change the text, in order."""

    def changed(before: Column, names: list[str]) -> Column:
        if not names:
            return F.array().cast("array<string>")
        own = STEPS[names[0]](before)
        rest = lambda after: changed(after, names[1:])
        if names[0] == "unicode_NFC":  # lambda functions take no Python UDF, which Spark evaluates once of its own accord
            return F.concat(F.array(F.when(own != before, F.lit(names[0]))), let(own, rest))
        return let(own, lambda after: F.concat(F.array(F.when(after != before, F.lit(names[0]))), rest(after)))

    return F.array_compact(changed(c, [n for n in STEPS if n not in skip]))


def reduction_percent(before: Column, after: Column) -> Column:
    return F.when(F.length(before) == 0, 0.0).otherwise((1 - F.length(after) / F.length(before)) * 100)


def normalize_for_embedding(c: Column) -> Column:
    return whitespace(c)


# Line wraps.


def join_hyphens(c: Column) -> Column:
    return F.regexp_replace(c, "([a-zA-Z])-\n([a-zA-Z])", "$1$2")


def count_hyphens(c: Column) -> Column:
    return F.regexp_count(c, F.lit("([a-zA-Z])-\n([a-zA-Z])"))


def mark_soft_wraps(c: Column, shorter_than: int = 40, preserve_bullets: bool = True) -> Column:
    """Lines without trailing white space; one that wraps softly gets one space. Lines stay separate."""
    wrapped = lambda lines: F.transform(lines, lambda line, i: _wrapped(lines, line, i, shorter_than, preserve_bullets)["text"])
    return F.array_join(let(F.split(c, "\n"), wrapped), "\n")


def count_soft_wraps(c: Column, shorter_than: int = 40, preserve_bullets: bool = True) -> Column:
    soft = lambda lines: F.transform(lines, lambda line, i: _wrapped(lines, line, i, shorter_than, preserve_bullets)["soft"])
    return F.size(F.filter(let(F.split(c, "\n"), soft), lambda s: s))


def _wrapped(lines: Column, line: Column, i: Column, shorter_than: int, preserve_bullets: bool) -> Column:
    own, following = rstrip(line), strip(F.coalesce(F.get(lines, i + 1), F.lit("")))
    bullet = own.rlike(BULLET) if preserve_bullets else F.lit(False)
    soft = (own != "") & ~bullet & (F.length(own) < shorter_than) & (following != "") & ~following.rlike("^[•*-]") & ~own.rlike(r"[.!?:;]\z")
    return F.struct(F.when(soft, F.concat(own, F.lit(" "))).otherwise(own).alias("text"), soft.alias("soft"))


def repair_wraps(c: Column) -> Column:
    return mark_soft_wraps(join_hyphens(c))


# Predicates and splits.


def is_page_number(line: Column) -> Column:
    return strip(line).rlike(PAGE_NUMBER)


def is_section_header(paragraph: Column) -> Column:
    return let(strip(paragraph), is_header)


def is_header(own: Column) -> Column:
    """is_section_header() of a paragraph that is stripped already."""
    return (own != "") & (F.length(own) <= 120) & own.rlike(SECTION)


def sentences(c: Column) -> Column:
    parts = F.split(F.regexp_replace(c, SENTENCE_END, "$1\0"), "\0")
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def paragraphs(c: Column) -> Column:
    return F.filter(F.transform(F.split(strip(c), r"\n{2,}"), strip), lambda p: p != "")


# Small helpers.


def squeeze(c: Column) -> Column:
    """Tabs and runs of spaces become one space; line ends stay."""
    return strip(F.regexp_replace(F.translate(c, "\t", " "), " +", " "))


def truncate(c: Column, most: int, suffix: str = "...") -> Column:
    """The first characters and the suffix, ``most`` in all; if the suffix alone is longer, as many are cut from the end."""
    keep = most - len(suffix)
    head = F.substring(c, 1, keep) if keep >= 0 else F.substring(c, F.lit(1), F.greatest(F.length(c) + keep, F.lit(0)))
    return F.when(F.length(c) <= most, c).otherwise(F.concat(head, F.lit(suffix)))


# Names and ids.


def stem(path: Column) -> Column:
    """The file's name without its last suffix; a name that begins with its only dot stays whole."""
    name = F.regexp_replace(path, "^.*/", "")
    return F.regexp_replace(name, r"(?<=.)\.[^.]+$", "")


def title(path: Column) -> Column:
    """The stem with spaces for underscores and hyphens, every run of letters capitalized."""
    spaced = F.translate(stem(path), "_-", "  ")
    return F.array_join(F.transform(F.split(spaced, r"(?<=[^\p{L}])(?=\p{L})"), lambda part: F.concat(F.upper(F.substring(part, 1, 1)), F.lower(F.substring(part, 2, 1 << 30)))), "")


def sha_chunk_id(source: Column, index: Column) -> Column:
    return F.substring(F.sha2(F.concat(source, F.lit("::"), index.cast("string")), 256), 1, 16)


def uuid5_chunk_id(document: Column, index: Column) -> Column:
    """The name-based UUID (version 5) of ``document::index`` in the URL namespace."""
    space = F.unhex(F.lit("6ba7b8119dad11d180b400c04fd430c8"))
    h = F.sha1(F.concat(space, F.encode(F.concat(document, F.lit("::"), index.cast("string")), "UTF-8")))
    variant = F.lower(F.hex((F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(63)).bitwiseOR(128)))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(19, 2), F.lit("-"), part(21, 12))


def page_estimate(start: Column, chars: Column, pages: Column) -> Column:
    return F.when((pages <= 0) | (chars <= 0), 1).otherwise(F.greatest(F.lit(1), (start / chars * pages).cast("int") + 1))
