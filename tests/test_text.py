"""Cleaning and naming expressions against Python's own string functions."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
import uuid

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmill.functions import quality as Q
from quillmill.functions import text as T

MIXED = st.text(alphabet=st.sampled_from(list("abZé 1.-\n\t\r\x0b\x0c\x1c\x85\xa0\u2003\u2028ﬁﬆ\xad“”’–—•e\u0301\x01")), max_size=40)
FEW = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


def column(spark, texts, *exprs):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [tuple(r)[1:] for r in frame.select("i", *exprs).orderBy("i").collect()]


def normal(t: str) -> str:
    t = unicodedata.normalize("NFC", t)
    for old, new in T.LIGATURES.items():
        t = t.replace(old, new)
    t = t.replace("\xad", "").translate(str.maketrans("“”‘’", "\"\"''")).replace("–", "-").replace("—", "--")
    t = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "", t)
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", t)).strip()


@FEW
@given(st.lists(MIXED, min_size=20, max_size=40))
def test_like_python(spark, texts):
    c = F.col("t")
    got = column(spark, texts, T.normalize(c), T.strip(c), T.count_words(c), T.is_blank(c), T.words(c), T.truncate(c, 10), T.truncate(c, 2))
    for text, row in zip(texts, got, strict=True):
        cut = lambda most: text if len(text) <= most else text[: most - 3] + "..."  # noqa: B023, E731
        assert row == (normal(text), text.strip(), len(text.split()), not text.strip(), text.split(), cut(10), cut(2))


def test_unicode_forms(spark):
    texts = ["ascii", "é e\u0301", "ﬁ Å", None]
    for form in ("NFC", "NFD", "NFKC", "NFKD"):
        assert column(spark, texts, T.unicode_form(F.col("t"), form)) == [(None if t is None else unicodedata.normalize(form, t),) for t in texts]


def test_fixed_expectations(spark):
    c = F.col("t")
    assert column(spark, ["  hello   world  "], T.normalize(c), T.normalize_changes(c))[0] == ("hello world", ["whitespace"])
    assert column(spark, ["iden-\ntical"], T.repair_wraps(c), T.count_hyphens(c))[0] == ("identical", 1)
    assert column(spark, ["/data/annual_report.pdf", "o'neil_v3a.txt", ".hidden", "a/b.tar.gz"], T.title(c), T.stem(c)) == [("Annual Report", "annual_report"), ("O'Neil V3A", "o'neil_v3a"), (".Hidden", ".hidden"), ("B.Tar", "b.tar")]


def test_ids_equal_the_standard_library(spark):
    names = ["doc", "päth/x.pdf", ""]
    got = column(spark, names, T.sha_chunk_id(F.col("t"), F.lit(7)), T.uuid5_chunk_id(F.col("t"), F.lit(7)))
    assert got == [(hashlib.sha256(f"{n}::7".encode()).hexdigest()[:16], str(uuid.uuid5(uuid.NAMESPACE_URL, f"{n}::7"))) for n in names]


def test_null_texts(spark):
    c = F.col("t")
    assert column(spark, [None], T.normalize(c), T.count_words(c), T.is_blank(c), T.sentences(c))[0] == (None, 0, True, None)
    report = column(spark, [None], Q.report(c))[0][0]
    assert (report["word_count"], report["quality_level"], report["passed"]) == (0, "low", True)


def test_report_line_and_summary(spark):
    c = F.col("t")
    line, said = column(spark, ["short text"], Q.report_json(F.lit("a.pdf"), Q.report(c)), Q.summary(Q.report(c)))[0]
    report = json.loads(line)
    assert report["source"] == "a.pdf" and report["warnings"] == ([Q.WARNINGS[report["quality_level"]]] if report["quality_level"] != "high" else [])
    assert [x["name"] for x in report["failed_checks"]] == ["word_count"] and report["failed_checks"][0]["threshold"] == 50
    assert said == f"[PASS] Quality={report['quality_level']} ({report['overall_score']:.2f}) | Words=2 | Failed checks: 1"
