"""Language identification by compression (operator 7).

For each language a raw-content dictionary is made of a bounded sample of labelled texts. Of every text the letters of all
its words, in lower case, are compressed with each dictionary in blocks of BLOCK bytes, so that a text's own repetitions
don't hide the language; the language whose dictionary leaves the fewest bytes is its prediction. LEVEL is one at which the
coder finds the matches of a whole dictionary, whatever its size. The score compares the sizes: it is the share that the best
language would get if each byte saved per hundred bytes of text (at most EVIDENCE of them) doubled the odds. Rejected are texts
whose margin is below ``least_margin`` bytes or below ``least_share`` of the smallest size, whatever their length, and texts of
which blocks with more than ``most_foreign`` of the bytes are told apart, by the same share, as another language. LEAST_SHARE
comes from held-out labelled rows at sf0.01 (188 right ones have 0.067 or more, the wrong one 0; random letters 0.057 at most).
Languages mixed inside one block are rejected by the margin only. op7 keeps the prediction of rejected texts too.

The sample: of each language the PER_LANGUAGE texts with the smallest hash of their id are cut, whole, into pieces of
PIECE characters, and the PIECES pieces with the smallest hash, from wherever in these texts, are its dictionary. Only this
sample is bounded; predictions read whole texts. A text that is null or has no letter is ``und`` with score 0, as is every
text where nothing was learned. Ties go to the language with the most labelled rows, then to the alphabetically first.
Repeated rows are predicted each, alike; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.runtime import prepare

PER_LANGUAGE, PIECE, PIECES, EVIDENCE, LEVEL, BLOCK = 200, 500, 200, 400, 12, 1024
#: Results that a worker remembers of texts that have occurred.
MEMO = 50_000
LEAST_SHARE, MOST_FOREIGN = 0.06, 0.2
UNKNOWN = "und"


def learn(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", where: Column | None = None) -> dict[str, bytes]:
    """Dictionary content by language, most frequent first, from rows with a label and a text (and ``where``, if given).

    Choosing the rows reads only keys and labels; each partition passes on PER_LANGUAGE keys, and PIECES pieces, a language.
    """
    rows = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(key).isNotNull())
    if where is not None:
        rows = rows.where(where)
    order = Window.partitionBy(lang).orderBy(F.xxhash64(F.col(key).cast("string")), F.col(key))
    ids = [r[0] for r in rows.select(F.col(lang), F.col(key)).withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= PER_LANGUAGE).select(key).collect()]
    if not ids:
        return {}
    chosen = rows.where(F.col(key).isin(sorted(set(ids)))).select(F.col(lang).alias("lang"), F.col(key).cast("string").alias("key"), F.col(text).alias("text"))
    last = F.floor((F.greatest(F.length("text"), F.lit(1)) - 1) / PIECE).cast("int")
    cut = chosen.withColumn("i", F.explode(F.sequence(F.lit(0), last))).select("lang", "key", "i", F.substring("text", F.col("i") * PIECE + 1, F.lit(PIECE)).alias("piece"))
    # Repeated rows of a key give the same piece more than once; which rows share a place here makes no difference.
    by_hash = Window.partitionBy("lang").orderBy(F.xxhash64("key", "i"), "key", "i", "piece")
    found = cut.withColumn("rn", F.row_number().over(by_hash)).where(F.col("rn") <= PIECES).select("lang", "rn", "piece").collect()
    out: dict[str, bytes] = {}
    for row in sorted(found):
        out[row["lang"]] = out.get(row["lang"], b"") + letters(row["piece"]) + b" "
    count = dict(rows.groupBy(lang).count().collect())
    return {k: out[k] for k in sorted(out, key=lambda k: (-count[k], k))}


@cache
def _others():
    import regex

    return regex.compile(r"[^\p{L}\p{M}']+").sub, regex.compile(r"\p{L}").search


@cache
def _latin() -> bytes:
    """Of each character below U+0100 itself, if letters() keeps it, or a space."""
    return bytes(c if _others()[1](chr(c)) or c == ord("'") else 32 for c in range(256))


def letters(text: str) -> bytes:
    """The text's words in lower case, without digits and symbols."""
    text = text.lower()
    try:
        data = text.encode("latin-1").translate(_latin())
    except UnicodeEncodeError:
        return _others()[0](" ", text).strip().encode()
    return b" ".join(filter(None, data.split(b" "))).decode("latin-1").encode()


class Classifier:
    def __init__(self, content: dict[str, bytes]):
        import zstandard

        self.langs = list(content)
        self.memo: dict[tuple[bytes, float], tuple[str, float, int, float, float]] = {}
        self.coders = []
        for lang in self.langs:
            dictionary = zstandard.ZstdCompressionDict(content[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            dictionary.precompute_compress(level=LEVEL)
            self.coders.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_content_size=False, write_checksum=False, write_dict_id=False))

    def predict(self, text: str | None) -> tuple[str, float, int]:
        """Language, score and margin in bytes to the second best."""
        return self.judge(text)[:3]

    def judge(self, text: str | None, least_share: float = LEAST_SHARE) -> tuple[str, float, int, float, float]:
        """Language, score, margin in bytes, margin as a share of the smallest size, share of bytes in blocks of other languages."""
        if not self.langs or not text or not _others()[1](text):
            return UNKNOWN, 0.0, 0, 0.0, 0.0
        # Copies of a text may be a large part of the input.
        name = (hashlib.blake2b(text.encode(), digest_size=16).digest(), least_share)
        if (found := self.memo.get(name)) is None:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            found = self.memo[name] = self._judge(letters(text), least_share)
        return found

    def _judge(self, data: bytes, least_share: float) -> tuple[str, float, int, float, float]:
        blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
        each = np.array([[len(c.compress(b)) for b in blocks] for c in self.coders], float)
        sizes = each.sum(axis=1)
        best = int(sizes.argmin())
        margin = int(np.partition(sizes, 1)[1] - sizes[best]) if len(sizes) > 1 else len(data)
        least = each.min(axis=0)
        foreign = each[best] - least >= np.maximum(least_share * least, 1)
        lengths = np.fromiter(map(len, blocks), np.int64, len(blocks))
        weight = np.exp2((sizes[best] - sizes) * (100.0 / max(100, min(len(data), EVIDENCE))))
        return self.langs[best], float(weight[best] / weight.sum()), margin, float(margin / sizes[best]), float(lengths[foreign].sum() / len(data))


def identify(df: DataFrame, content: dict[str, bytes], least_margin: int = 1, text: str = "text", least_share: float = LEAST_SHARE, most_foreign: float = MOST_FOREIGN) -> DataFrame:
    """df with lang_pred (string), score (double) and accepted (boolean) added, which must not be names of its columns.

    content: what learn() returns, PIECE * PIECES characters a language at most. No shuffle.
    """
    from pyspark.sql.types import BooleanType, DoubleType, StringType, StructType

    prepare(df.sparkSession)
    names, new = df.columns, ["lang_pred", "score", "accepted"]
    if clash := set(new) & set(names):
        raise ValueError(f"columns in use: {sorted(clash)}")
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = Classifier(content)
        for batch in batches:
            found = [classifier.judge(t, least_share) for t in batch.column(at).to_pylist()]
            accepted = [x[0] != UNKNOWN and x[2] >= least_margin and x[3] >= least_share and x[4] <= most_foreign for x in found]
            columns = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array(accepted, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*names, *new])

    schema = StructType([*df.schema.fields]).add("lang_pred", StringType()).add("score", DoubleType()).add("accepted", BooleanType())
    return df.mapInArrow(run, schema)
