"""Near duplicates by MinHash and odd sketches (operator 1).

Texts with the same shingle set are one class. The MinHash samples of a class are cut into bands; classes that agree on a
band are candidates. The samples are also folded into an odd sketch: sample i with value v flips one bit, so that the XOR of
two sketches has at most two bits set for each sample on which the classes differ. Its population count thus bounds the
number of equal samples, and a candidate whose count would need fewer equal samples than links at the threshold ever have
(DEVIATIONS below the mean) is dropped; all others are confirmed on the full sets.

In a band each class is first held against the smallest of its bucket. Classes that are then outside of their bucket's largest
component are held against all members of other components, and the PARTNERS nearest in each tile are confirmed, which joins
most of a large group. Those that are outside still meet a component only once, whatever the number of bands: in tiles of
about TILE x TILE classes with their full sets, where sketches decide which are compared and only links become rows. So no link
is lost, the members of a component are never held against each other, and rows grow with the members of a group.

With 50 bands of 6 samples a link at 0.8 is missed with probability 3e-7, and a pair at 0.1 meets with 5e-5.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.llm.components import components, joined
from quillmill.llm.shingles import mix, shingle_sets
from quillmill.runtime import materialize, prepare, release

BANDS, ROWS, SKETCH_BITS, DEVIATIONS, TILE, PARTNERS = 50, 6, 2048, 5, 512, 2
#: Keys of texts that are read again for the full sets are broadcast up to this many, else joined by a shuffle.
BROADCAST_KEYS = 1_000_000
_SAMPLES, _STRIDE, _TEXTS = BANDS * ROWS, 4096, 4_000_000


@cache
def _hashes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    seed = mix(np.arange(1, 3 * _SAMPLES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (seed[:_SAMPLES] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (seed[_SAMPLES : 2 * _SAMPLES] >> np.uint64(32)).astype(np.uint32), seed[2 * _SAMPLES :]


def minhash(hashes: np.ndarray) -> np.ndarray:
    """The samples of a set that isn't empty."""
    factor, shift, _ = _hashes()
    short, out = (hashes >> np.uint64(32)).astype(np.uint32), np.full(_SAMPLES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(short), _STRIDE):
        value = np.multiply.outer(factor, short[i : i + _STRIDE])
        value += shift[:, None]
        np.minimum(out, value.min(axis=1), out=out)
    return out


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """SKETCH_BITS parities, as 64-bit words; samples: a row for each set."""
    bit = (mix(samples.astype(np.uint64) + _hashes()[2]) % np.uint64(SKETCH_BITS)).astype(np.int64)
    rows = len(samples)
    odd = np.bincount((bit + np.arange(rows)[:, None] * SKETCH_BITS).ravel(), minlength=rows * SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8).reshape(rows, SKETCH_BITS), axis=1).view(np.int64)


def sketch_limit(similarity: float) -> int:
    """Bits in which the sketches of a link may differ."""
    differ = _SAMPLES * (1 - similarity)
    return math.ceil(2 * (differ + DEVIATIONS * math.sqrt(differ * similarity) + 1))


def estimate(different_bits: int) -> float:
    """The similarity that a population count of the XOR of two sketches stands for."""
    return 1 + SKETCH_BITS / (4 * _SAMPLES) * math.log(max(1 - 2 * different_bits / SKETCH_BITS, 1e-9))


SIGNED = "doc_id long, n_shingles long, low long, high long, bands array<long>, sketch array<long>"


def _lists(rows: np.ndarray, present: np.ndarray) -> pa.Array:
    width = rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(present * width)]), pa.int32()), pa.array(rows.ravel().view(np.int64)))


def signatures(df: DataFrame, words: int, key: str, text: str) -> DataFrame:
    """A row for each document: size and digest of its shingle set, band keys and odd sketch (empty lists for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = mix(np.arange(1, BANDS + 1, dtype=np.uint64))
        for batch in batches:
            texts = [(t or "").encode().lower() for t in batch.column(1).to_pylist()]
            begin = 0
            while begin < len(texts):
                end, size = begin + 1, len(texts[begin])
                while end < len(texts) and size + len(texts[end]) < _TEXTS:
                    size, end = size + len(texts[end]), end + 1
                sets = shingle_sets(texts[begin:end], words)
                present = np.array([len(s) > 0 for s in sets])
                samples = np.array([minhash(s) for s in sets if len(s)], np.uint32).reshape(-1, _SAMPLES)
                keys = np.zeros((len(samples), BANDS), np.uint64) + salt
                for i in range(ROWS):
                    keys = mix(keys * np.uint64(0x2545F4914F6CDD1D) + samples.reshape(-1, BANDS, ROWS)[:, :, i])
                low = np.array([np.bitwise_xor.reduce(mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5))) if len(s) else 0 for s in sets], np.uint64)
                high = np.array([np.add.reduce(mix(s)) if len(s) else 0 for s in sets], np.uint64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, end - begin), pa.array([len(s) for s in sets], pa.int64()), pa.array(low.view(np.int64)), pa.array(high.view(np.int64)), _lists(keys, present), _lists(odd_sketch(samples), present)], [x.split()[0] for x in SIGNED.split(", ")])
                begin = end

    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, SIGNED)


def _sets(df: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column(1).to_pylist()):
                found = shingle_sets([(text or "").encode().lower()], words)[0]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([found.view(np.int64)], pa.list_(pa.int64()))], ["id", "hashes"])

    return df.mapInArrow(run, "id long, hashes array<long>")


def _differing(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, x: total + x)


def _by_sketch(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) that can be links by size and sketch."""
    side = lambda c: classes.select(F.col("doc_id").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("sketch").alias(f"sketch_{c}"))
    near = pairs.join(side("a"), "a").join(side("b"), "b")
    near = near.where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
    return near.where(_differing("sketch_a", "sketch_b") <= sketch_limit(percent / 100)).select("a", "b", "n_a", "n_b")


def _nearest(own: np.ndarray, other: np.ndarray, bits: np.ndarray, most: int) -> np.ndarray:
    """Which pairs are among the first ``most`` of their own, by bits."""
    order = np.lexsort((other, bits, own))
    starts = np.flatnonzero(np.diff(own[order], prepend=-1))
    place = np.arange(len(order)) - np.repeat(starts, np.diff(starts, append=len(order)))
    keep = np.zeros(len(own), bool)
    keep[order[place < most]] = True
    return keep


def _outside(shared: DataFrame, reached: DataFrame) -> DataFrame:
    """(band, doc_id, component, main, members, others) of the members of buckets in several components, but their first.

    main is the bucket's largest component, others the number of members that aren't in it.
    """
    component = reached.select(F.col("id").alias("doc_id"), "component")
    label = materialize(shared.where("n > 2 and doc_id != first").join(component, "doc_id", "left").select("band", "doc_id", F.coalesce("component", "doc_id").alias("component")))
    sizes = label.groupBy("band", "component").agg(F.count("*").alias("n")).groupBy("band").agg(F.max(F.struct("n", F.col("component").alias("main"))).alias("most"), F.sum("n").alias("members"))
    mixed = sizes.select("band", "most.main", "members", (F.col("members") - F.col("most.n")).alias("others")).where("others > 0")
    out = materialize(label.join(mixed, "band"))
    release(label)
    return out


def _blocks(n: str) -> Column:
    return F.ceil(F.col(n) / TILE).cast("int")


def _side(rows: DataFrame, asks: bool, own: str, other: str) -> DataFrame:
    """Rows with ``tile``: its own block (of ``own`` rows) with each block of the other side (of ``other`` rows); few have more
    than one. asks says which side it is."""
    block = F.pmod(F.xxhash64("doc_id", F.lit(asks)), _blocks(own)).cast("int")
    first, rest = rows.withColumn("y", F.lit(0)), rows.where(_blocks(other) > 1).withColumn("y", F.explode(F.sequence(F.lit(1), _blocks(other) - 1)))
    pair = (block, F.col("y")) if asks else (F.col("y"), block)
    return first.union(rest).withColumn("tile", F.xxhash64(*pair)).withColumn("asks", F.lit(asks)).drop("y")


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole tiles, from rows that are sorted by their first two columns."""
    held: pa.Table | None = None
    for batch in batches:
        now = pa.Table.from_batches([batch])
        rows = pa.concat_tables([held, now]) if held is not None else now
        if not rows.num_rows:
            continue
        values = [rows.column(i).to_numpy() for i in (0, 1)]
        cuts = [0, *(np.flatnonzero((np.diff(values[0]) != 0) | (np.diff(values[1]) != 0)) + 1).tolist()]
        for begin, end in zip(cuts, cuts[1:], strict=False):
            yield rows.slice(begin, end - begin)
        held = rows.slice(cuts[-1])  # the last tile may go on in the next batch
    if held is not None:
        yield held


def _words64(rows: pa.Table, column: str) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of lists, and where each list begins and ends."""
    lists = rows.column(column).combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    return lists.flatten().to_numpy().view(np.uint64), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy().astype(np.int64))])


def _candidates(rows: pa.Table, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows that ask and rows asked in a tile that can be links by component, size and sketch, and the bits that differ."""
    limit = sketch_limit(percent / 100)
    asks, ids, component, n = (rows.column(c).to_numpy() for c in ("asks", "doc_id", "component", "n_shingles"))
    sketch = _words64(rows, "sketch")[0].reshape(len(ids), -1)
    left, right = np.flatnonzero(asks), np.flatnonzero(~asks)
    for at in range(0, len(left), 64):
        x = left[at : at + 64]
        i, j = np.nonzero((component[x][:, None] != component[right]) & (100 * np.minimum(n[x][:, None], n[right]) >= percent * np.maximum(n[x][:, None], n[right])))
        i, j = x[i], right[j]
        bits = np.bitwise_count(sketch[i] ^ sketch[j]).sum(axis=1, dtype=np.int64)
        near = bits <= limit
        yield i[near], j[near], bits[near]


def _nearest_outside(outside: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, n_a, n_b) of a class outside its bucket's main component with its PARTNERS nearest classes of other
    components in each tile of the bucket."""
    rows = outside.join(classes.select("doc_id", "n_shingles", "sketch"), "doc_id")
    tiles = _side(rows.where("component != main"), True, "others", "members").union(_side(rows, False, "members", "others"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in _tiles(batches):
            ids, n = tile.column("doc_id").to_numpy(), tile.column("n_shingles").to_numpy()
            for i, j, bits in _candidates(tile, percent):
                best = _nearest(i, j, bits, PARTNERS)
                i, j = i[best], j[best]
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (ids[i], ids[j], n[i], n[j])], ["a", "b", "n_a", "n_b"])

    tiles = tiles.select("band", "tile", "asks", "doc_id", "component", "n_shingles", "sketch")
    return tiles.repartition("band", "tile").sortWithinPartitions("band", "tile").mapInArrow(run, "a long, b long, n_a long, n_b long").distinct()


def _links_outside(outside: DataFrame, classes: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) between classes outside a main component and classes that share a bucket of it, on the full sets.

    A class meets a main component once, however many buckets they share, and passes on a link to each component at most.
    """
    met = outside.select("main", "doc_id", "component").distinct()
    count = met.groupBy("main").agg(F.count("*").alias("members"), F.count_if(F.col("component") != F.col("main")).alias("others"))
    wanted = materialize(met.select(F.col("doc_id").alias("id")).distinct())
    few = wanted.count() <= BROADCAST_KEYS
    again = texts.join(F.broadcast(wanted) if few else wanted, texts.doc_id == wanted.id, "left_semi")
    sets = materialize(_sets(again, words).dropDuplicates(["id"]))
    rows = materialize(met.join(count, "main")).join(classes.select("doc_id", "n_shingles", "sketch"), "doc_id").join(sets.withColumnRenamed("id", "doc_id"), "doc_id")
    tiles = _side(rows.where("component != main"), True, "others", "members").union(_side(rows, False, "members", "others"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in _tiles(batches):
            ids, component = tile.column("doc_id").to_numpy(), tile.column("component").to_numpy()
            values, at = _words64(tile, "hashes")
            found = []
            for i, j, bits in _candidates(tile, percent):
                order = np.lexsort((bits, i))
                i, j = i[order], j[order]
                for x in np.unique(i):
                    other, done = j[i == x], set()
                    own = values[at[x] : at[x + 1]].view(np.int64)
                    own = np.sort(own)
                    for begin in range(0, len(other), 256):
                        some = np.array([y for y in other[begin : begin + 256].tolist() if component[y] not in done], np.int64)
                        if not len(some):
                            continue
                        parts = [values[at[y] : at[y + 1]].view(np.int64) for y in some.tolist()]
                        flat, sizes = np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))
                        place = np.minimum(np.searchsorted(own, flat), len(own) - 1)
                        both = np.add.reduceat(own[place] == flat, np.concatenate([[0], np.cumsum(sizes)[:-1]]), dtype=np.int64)
                        for y in some[100 * both >= percent * (len(own) + sizes - both)].tolist():
                            if component[y] not in done:
                                done.add(component[y])
                                found.append((ids[x], ids[y]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in zip(*found, strict=True)], ["a", "b"])

    tiles = tiles.select("main", "tile", "asks", "doc_id", "component", "n_shingles", "sketch", "hashes")
    links = materialize(tiles.repartition("main", "tile").sortWithinPartitions("main", "tile").mapInArrow(run, "a long, b long").distinct())
    release(sets, wanted)
    return links


def _confirmed(near: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b, n_a, n_b) that are links on the full sets."""
    near = materialize(near)
    wanted = materialize(near.select(F.col("a").alias("id")).union(near.select(F.col("b").alias("id"))).distinct())
    few = wanted.count() <= BROADCAST_KEYS
    again = texts.join(F.broadcast(wanted) if few else wanted, texts.doc_id == wanted.id, "left_semi")
    sets = materialize(_sets(again, words))
    side = lambda c: sets.select(F.col("id").alias(c), F.col("hashes").alias(f"set_{c}"))
    full = near.join(side("a"), "a").join(side("b"), "b")
    links = materialize(full.withColumn("both", F.size(F.array_intersect("set_a", "set_b"))).where(f"100 * both >= {percent} * (n_a + n_b - both)").select("a", "b").distinct())
    release(near, sets, wanted)
    return links


def near_duplicates(df: DataFrame, words: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of df.

    Words are runs of characters other than ASCII white space, with A-Z in lower case. Documents are linked if 100 * shared
    shingles >= percent * all shingles of the two; component_id is the smallest key that links lead to. A text without words,
    or null, is linked with nothing. Rows with the same key get the same component only if their texts do; null keys are not
    supported as representatives and form components of their own text class. Empty tables give no rows.
    """
    prepare(df.sparkSession)
    signed = materialize(signatures(df, words, key, text))
    some = signed.where("n_shingles > 0 and doc_id is not null")
    by_set = materialize(some.groupBy("n_shingles", "low", "high").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")))
    classes = materialize(some.join(by_set.select("rep", "low", "high"), (F.col("doc_id") == F.col("rep")) & (some.low == by_set.low) & (some.high == by_set.high), "left_semi").select("doc_id", "n_shingles", "bands", "sketch").dropDuplicates(["doc_id"]))
    texts = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))

    member = classes.select("doc_id", F.explode("bands").alias("band"))
    # Written first, so that the join is a stage of its own, whose hot bands Spark can split.
    buckets = materialize(member.groupBy("band").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1"))
    shared = materialize(member.join(buckets, "band").select("band", "first", "doc_id", "n"))
    starred = shared.where("doc_id != first").select(F.col("doc_id").alias("a"), F.col("first").alias("b")).distinct()
    links = _confirmed(_by_sketch(starred, classes, percent), texts, words, percent)
    reached = materialize(components(links))

    for last in (False, True):
        outside = _outside(shared, reached)
        more = _links_outside(outside, classes, texts, words, percent) if last else _confirmed(_nearest_outside(outside, classes, percent), texts, words, percent)
        release(outside)
        if more.isEmpty():
            continue
        after = materialize(joined(reached, more))
        release(more, reached)
        reached = after
    release(shared, buckets, links, classes)

    named = by_set.join(reached, by_set.rep == reached.id, "left").select("n_shingles", "low", "high", F.coalesce("component", "rep").alias("component_id"), "rep", "copies").where("copies > 1 or component_id != rep").drop("rep", "copies")
    out = signed.select("doc_id", "n_shingles", "low", "high").join(named, ["n_shingles", "low", "high"], "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))
