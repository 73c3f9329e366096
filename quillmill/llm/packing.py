"""Packing token sequences by cutting-stock column generation (operator 10).

Every document is tokenized whole, closed with an end id and cut at multiples of the sequence length; what remains is one
shorter piece. Lengths of pieces are counted in units of GRAIN tokens. A linear program over patterns (how many pieces of
each length share a sequence) covers that histogram with the fewest sequences: a revised simplex method whose entering
columns come from a knapsack dynamic program on the dual prices. The whole part of each pattern's use is kept, the rest of
the histogram is packed best-fit. Pieces are ranked within their length by counts per partition and a running sum over
partitions, and a rank decides the pattern, the sequence and the slot. Only the histogram (at most capacity / GRAIN rows)
reaches the driver, so that its work doesn't grow with the number of documents.

Null texts count as empty: they have the end id alone. Repeated rows are packed once each. An empty table gives no rows.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmill.runtime import materialize, prepare, release

GRAIN = 8
#: Words whose ids a worker remembers before it forgets the later half: frequent words come early and stay.
MEMO = 250_000
#: The linear program stops when its value is proved to be within this share of the least, or after so many columns;
#: less than one sequence is never worth a step.
GAP, COLUMNS = 5e-4, 4000
#: Share of the best prices so far in the prices that a new column is sought for.
SMOOTH = 0.9


#: The parts of a tokenizer file that words can be encoded apart under; any other file is left to the library, text by text.
NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: Words of these characters, in lower case, are cut by the pattern below as by PATTERN; all letters from U+00DF on are letters to both.
_PLAIN = re.compile(r"[!-~ß-öø-ſ]+\Z").match
_CUT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|[^a-z0-9ß-öø-ſ]+").findall


class WordEncoder:
    """Ids of a vocabulary whose pattern never joins characters across white space.

    Each distinct word between white space is cut by the pattern, and each distinct part is encoded by the ``tokenizers``
    library once; words of other characters go to it as they stand. Texts with special strings or separators that the two
    sides see differently go to the library whole, and so does every text where the file's parts are not those above.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.marks = ["\x1c", "\x1d", "\x1e", "\x1f", *(t["content"] for t in spec["added_tokens"])]
        first, *rest = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        by_pattern = first.get("pattern") == {"Regex": PATTERN} and bool(first.get("invert")) and [x.get("type") for x in rest] == ["ByteLevel"] and not rest[0].get("use_regex", True) and not rest[0].get("add_prefix_space", True)
        self.by_word = (spec["normalizer"] or {}).get("normalizers") == NORMALIZER and by_pattern and not spec["post_processor"]
        suffix, vocabulary = spec["model"].get("end_of_word_suffix"), self.library.get_vocab()
        self.closes = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.closes[[i for w, i in vocabulary.items() if suffix and w.endswith(suffix)]] = True
        self.by_word &= bool(suffix) and spec["model"].get("unk_token") is None
        self.memo: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _encoded(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, "<u4") for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        if len(self.parts) > MEMO:
            self.parts = dict(islice(self.parts.items(), MEMO // 2))
        cut = [_CUT(w) if _PLAIN(w) else None for w in words]
        new = list(set(chain.from_iterable(x for x in cut if x)).difference(self.parts))
        if new:
            # Many at once, as one text; the last id of each part is one that ends a part.
            ids = np.concatenate(self._encoded([" ".join(new[i : i + 64]) for i in range(0, len(new), 64)]))
            data, ends = ids.tobytes(), (4 * (np.flatnonzero(self.closes[ids]) + 1)).tolist()
            self.parts.update(zip(new, map(data.__getitem__, map(slice, [0, *ends], ends)), strict=True))
        part = self.parts.__getitem__
        self.memo.update((w, b"".join(map(part, x)) if len(x) > 1 else part(x[0])) for w, x in zip(words, cut, strict=True) if x)
        others = [w for w, x in zip(words, cut, strict=True) if not x]
        self.memo.update(zip(others, (x.tobytes() for x in self._encoded(others)), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        if len(self.memo) > MEMO:
            self.memo = dict(islice(self.memo.items(), MEMO // 2))
        found: list[list[str] | None] = []
        for text in texts:
            if not self.by_word or any(map(text.__contains__, self.marks)):
                found.append(None)
            elif text.isascii():
                found.append(text.lower().split())
            else:  # the library's lower case knows no final sigma
                found.append(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower().split())
        if new := list(set().union(*filter(None, found)).difference(self.memo)):
            self._learn(new)
        word = self.memo.__getitem__
        return [self._encoded([t])[0].tobytes() if w is None else b"".join(map(word, w)) for t, w in zip(texts, found, strict=True)]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, units int, part int, local_rank long"


def pieces(df: DataFrame, path: str, capacity: int, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece, ranked among the pieces of its length in its partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, encode = TaskContext.get().partitionId(), np.zeros(capacity // GRAIN + 2, np.int64), encoder(path).encode
        end = np.uint32(end_id).tobytes()
        for batch in batches:
            rows: list[tuple] = []
            keys = batch.column(0).to_pylist()
            for doc, ids in zip(keys, encode([t or "" for t in batch.column(1).to_pylist()]), strict=True):
                ids += end
                total = len(ids) // 4
                for start in range(0, total, capacity):
                    own = ids[4 * start : 4 * (start + capacity)]
                    length = len(own) // 4
                    units = -(-length // GRAIN)
                    rows.append((doc, start, length, zlib.crc32(own), total, units, part, int(seen[units])))
                    seen[units] += 1
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i in (5, 6) else pa.int64()) for i, c in enumerate(columns)], [x.split()[0] for x in PIECE.split(", ")])

    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, PIECE)


def knapsack(value: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable pattern for prices by length in units (index 0 unused), and its value."""
    best, took = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        options = value[1 : c + 1] + best[c - 1 :: -1]
        i = int(options.argmax())
        if options[i] > best[c - 1] + 1e-12:
            best[c], took[c] = options[i], i + 1
        else:
            best[c], took[c] = best[c - 1], 0
    pattern, c = np.zeros(capacity + 1, np.int64), capacity
    while c > 0:
        pattern[took[c]] += took[c] > 0
        c -= max(1, int(took[c]))
    return float(best[capacity]), pattern


def solve(demand: np.ndarray, capacity: int, gap: float = GAP, most: int = COLUMNS) -> list[tuple[np.ndarray, int]]:
    """Patterns (pieces by length in units) and how often each is used; together they hold the demand exactly."""
    sizes = np.flatnonzero(demand[1:]) + 1
    left, out = demand.astype(np.int64).copy(), []
    if len(sizes):
        # One row for each length; the first basis fills a sequence with one length.
        per = capacity // sizes
        basis = np.diag(per.astype(float))
        inverse, x = np.diag(1.0 / per), demand[sizes] / per
        centre, least = sizes / capacity, float(sizes @ demand[sizes]) / capacity
        for step in range(most):
            if step % 200 == 199:  # clears what rounding has gathered
                inverse = np.linalg.inv(basis)
                x = np.maximum(inverse @ demand[sizes], 0)
            price = inverse.sum(0)
            # Prices swing from basis to basis; those between them and the best seen lead to better columns.
            gain, share = 0.0, SMOOTH
            while gain <= 1 + 1e-9:
                mixed = share * centre + (1 - share) * price
                value = np.full(capacity + 1, -1.0)
                value[sizes] = mixed
                worth, pattern = knapsack(value, capacity)
                gain = float(price @ pattern[sizes])
                bound = float(mixed @ demand[sizes]) / max(worth, 1e-9)  # prices over worth are feasible in the dual program
                if bound > least:
                    least, centre = bound, mixed / worth
                if share == 0:
                    break
                share = 0.0 if share < 0.3 else share - 0.3
            if gain <= 1 + 1e-9 or x.sum() - least < max(gap * x.sum(), 1):
                break
            column = pattern[sizes].astype(float)
            move = inverse @ column
            able = move > 1e-9
            if not able.any():
                break
            ratio = np.where(able, x / np.where(able, move, 1), np.inf)
            row = int(ratio.argmin())
            amount = ratio[row]
            x -= amount * move
            x[row] = amount
            np.maximum(x, 0, out=x)
            basis[:, row] = column
            inverse[row] /= move[row]
            others = np.arange(len(sizes)) != row
            inverse[others] -= np.outer(move[others], inverse[row])
        for i, use in enumerate(np.floor(x + 1e-9).astype(np.int64)):
            pattern = np.zeros(capacity + 1, np.int64)
            pattern[sizes] = np.rint(basis[:, i]).astype(np.int64)
            has = pattern > 0
            use = min(int(use), int((left[has] // pattern[has]).min())) if has.any() else 0
            if use > 0:
                out.append((pattern, use))
                left -= use * pattern
    # What is left: the longest pieces first, each sequence filled with the longest that still fit.
    while left[1:].any():
        pattern, room = np.zeros(capacity + 1, np.int64), capacity
        for size in (np.flatnonzero(left[1:]) + 1)[::-1].tolist():
            take = min(room // size, int(left[size]))
            pattern[size] = take
            room -= take * size
        has = pattern > 0
        use = int((left[has] // pattern[has]).min())
        out.append((pattern, use))
        left -= use * pattern
    return out


def seats(patterns: list[tuple[np.ndarray, int]]) -> tuple[np.ndarray, int]:
    """Rows (units, first rank, sequence base, pieces each, slot base), sorted by units and rank; the number of sequences."""
    rows, given, base = [], {}, 0
    for pattern, use in patterns:
        slot = 0
        for size in np.flatnonzero(pattern).tolist():
            each = int(pattern[size])
            rows.append((size, given.get(size, 0), base, each, slot))
            given[size] = given.get(size, 0) + each * use
            slot += each
        base += use
    return np.asarray(sorted(rows), np.int64).reshape(-1, 5), base


def pack(df: DataFrame, path: str, capacity: int = 4096, end_id: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Places every piece of every document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    if capacity % GRAIN:
        raise ValueError(f"capacity must be a multiple of {GRAIN}")
    prepare(df.sparkSession)
    cut = materialize(pieces(df, path, capacity, end_id, key, text))
    by_part = materialize(cut.groupBy("units", "part").agg(F.count("*").alias("n")))
    histogram = {r["units"]: r["n"] for r in by_part.groupBy("units").agg(F.sum("n").alias("n")).collect()}
    demand = np.zeros(capacity // GRAIN + 1, np.int64)
    for units, n in histogram.items():
        demand[units] = n
    demand[-1] = 0  # these fill a sequence each
    table, sequences = seats(solve(demand, capacity // GRAIN))
    before = Window.partitionBy("units").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = materialize(by_part.select("units", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift")))
    release(by_part)
    ranked = cut.join(shifts, ["units", "part"]).withColumn("rank", F.col("local_rank") + F.col("shift")).drop("local_rank", "shift", "part")
    full, wide = capacity // GRAIN, 1 << 40
    places = table[:, 0] * wide + table[:, 1] if len(table) else np.zeros(0, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units, rank = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 6))
            sequence, slot, short = sequences + rank, np.zeros(len(rank), np.int64), units < full
            if short.any():
                row = table[np.searchsorted(places, units[short] * wide + rank[short], "right") - 1]
                at = rank[short] - row[:, 1]
                sequence[short], slot[short] = row[:, 2] + at // row[:, 3], row[:, 4] + at % row[:, 3]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:6], pa.array(sequence), pa.array(slot)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "slot"])

    placed = ranked.select("units", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank").mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, slot long")
    within = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(within), F.lit(0)).cast("long")).drop("slot")
