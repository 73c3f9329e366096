"""Document quality as Column expressions: six checks, their mean and a level."""

from __future__ import annotations

import operator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmill.functions.text import INNER, W, count_words


@dataclass(frozen=True)
class Limits:
    words: int = 50
    density: float = 0.3
    shortest: float = 2.5
    longest: float = 15.0
    punctuation: float = 0.2
    uppercase: float = 0.5
    non_ascii: float = 0.15


def report(text: Column, limits: Limits = Limits()) -> Column:
    """Struct of text_length, word_count, overall_score, quality_level, passed, warning and checks. Null counts as empty."""
    t = F.coalesce(text, F.lit(""))
    n = count_words(t)
    # Classes of characters are counted by removing runs, which is faster than matching one by one.
    length = F.length(t)
    chars = F.length(F.regexp_replace(t, f"{W}+", ""))
    least = F.greatest(length, F.lit(1))
    letters = length - F.length(F.regexp_replace(t, r"\p{L}+", ""))
    density, average = chars / least, chars / F.greatest(n, F.lit(1))
    punctuation = F.length(F.regexp_replace(t, rf"[\p{{L}}\p{{N}}_{INNER}]+", "")) / least
    upper = F.when(letters == 0, 0.0).otherwise(F.length(F.regexp_replace(t, r"\P{Lu}+", "")) / letters)
    foreign = F.length(F.regexp_replace(t, r"[\x00-\x7F]+", "")) / least
    fits = (average >= limits.shortest) & (average <= limits.longest)
    falling = lambda ratio, most: F.greatest(F.lit(0.0), 1 - ratio / most)
    rows = [
        ("word_count", n >= limits.words, F.least(F.lit(1.0), n / limits.words), n.cast("double"), limits.words),
        ("word_density", density >= limits.density, F.least(F.lit(1.0), density / limits.density), F.round(density, 3), limits.density),
        ("avg_word_len", fits, F.when(fits, 1.0).otherwise(0.3), F.round(average, 2), limits.shortest),
        ("punct_ratio", punctuation <= limits.punctuation, falling(punctuation, limits.punctuation), F.round(punctuation, 3), limits.punctuation),
        ("uppercase_ratio", upper <= limits.uppercase, falling(upper, limits.uppercase), F.round(upper, 3), limits.uppercase),
        ("non_ascii_ratio", foreign <= limits.non_ascii, falling(foreign, limits.non_ascii), F.round(foreign, 3), limits.non_ascii),
    ]
    checks = F.array(*[F.struct(F.lit(name).alias("name"), passed.alias("passed"), score.cast("double").alias("score"), value.cast("double").alias("value"), F.lit(float(limit)).alias("threshold")) for name, passed, score, value, limit in rows])
    mean = reduce(operator.add, [score for _, _, score, _, _ in rows]) / len(rows)
    level = F.when(mean >= 0.8, "high").when(mean >= 0.6, "medium").when(mean >= 0.4, "low").otherwise("reject")
    return F.struct(length.alias("text_length"), n.alias("word_count"), F.round(mean, 4).alias("overall_score"), level.alias("quality_level"), (level != "reject").alias("passed"), checks.alias("checks"))


def failed(checks: Column) -> Column:
    return F.filter(checks, lambda c: ~c["passed"])


def gate(clean_text: Column, level: Column, allow_low: bool = False) -> Column:
    """Whether a cleaned document may go on: it has text and its level isn't low or reject."""
    barred = ["reject"] if allow_low else ["low", "reject"]
    return clean_text.isNotNull() & (clean_text != "") & ~level.isin(barred)


#: What is said of a level.
WARNINGS = {
    "medium": "Medium quality document - review before production use",
    "low": "Low quality document - may produce poor RAG results",
    "reject": "Document quality too low - consider excluding from index",
}


def warnings(level: Column) -> Column:
    """Array of what is to be said of this level: nothing of a high one."""
    said = reduce(lambda other, item: F.when(level == item[0], F.lit(item[1])).otherwise(other), WARNINGS.items(), F.lit(None).cast("string"))
    return F.array_compact(F.array(said))


def report_json(source: Column, quality: Column) -> Column:
    """A line of JSON for a document's report() with its warnings and the checks that it failed."""
    bad = F.transform(failed(quality["checks"]), lambda c: F.struct(c["name"].alias("name"), c["value"].alias("value"), c["threshold"].alias("threshold")))
    same = [quality[c].alias(c) for c in ("quality_level", "overall_score", "word_count", "passed")]
    return F.to_json(F.struct(source.alias("source"), *same, warnings(quality["quality_level"]).alias("warnings"), bad.alias("failed_checks")))


def summary(quality: Column) -> Column:
    """A readable line for a report()."""
    status = F.when(quality["passed"], "PASS").otherwise("FAIL")
    return F.format_string("[%s] Quality=%s (%.2f) | Words=%d | Failed checks: %d", status, quality["quality_level"], quality["overall_score"], quality["word_count"], F.size(failed(quality["checks"])))
