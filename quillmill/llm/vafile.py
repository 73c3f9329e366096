"""Exact top-k inner products by a vector-approximation file (operator 4).

1. Distinct vectors are written once, and beside them the approximation file: a vector's least component, the width of its
   cells and a cell of CELL_BITS bits for each component, a byte each. No later step reads all exact vectors.
2. Tiles of cells and queries, both of bounded size, give for each query and cell row the least and greatest inner product
   that a vector in these cells can have. A tile passes on the rows whose greatest value reaches its kth least value.
3. The kth least value over all tiles cuts these candidates again. Exact vectors are read in the order of the greatest values:
   the first k of each query, then all whose greatest value still reaches the kth exact result, so that the kth is certain.

Of equal vectors only the k + 1 smallest keys can be among any k best without the query's own, so no others are approximated,
however many rows share a vector. Where many *different* vectors lie within each other's cells all of them are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.runtime import materialize, prepare, release

QUERIES, VECTORS, CELL_BITS = 4096, 16384, 8
#: Queries whose bounds a task holds at once.
BLOCK = 64
FOUND = "query long, row long, least double, most double"


def bounds(query: np.ndarray, low: np.ndarray, width: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of each query with any integer vector in each row of cells."""
    all_, up, down = query.sum(1), np.maximum(query, 0).sum(1), np.minimum(query, 0).sum(1)
    corner = np.outer(all_, low) + (query @ cells.T) * width
    slack = 1e-12 * np.outer(up - down, np.abs(low) + width * (1 << CELL_BITS))  # more than rounding can take away
    return corner + np.outer(down, width - 1) - slack, corner + np.outer(up, width - 1) + slack


def candidates(tile: pa.Table, k: int) -> pa.Table:
    """(query, row, least, most) of a tile's rows that may be among the k best of its queries."""
    asks = tile.column("q").is_valid()
    rows, queries = tile.filter(pc.invert(asks)), tile.filter(asks)
    found: list[list[np.ndarray]] = [[], [], [], []]
    if len(rows) and len(queries):
        matrix = lambda t, c: t.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(t), -1)
        column = lambda t, c: t.column(c).to_numpy()
        cells, vectors = matrix(rows, "cells") + 128, matrix(queries, "q")
        low, width = column(rows, "low").astype(np.float64), column(rows, "width").astype(np.float64)
        key, number, asked, numbers = column(rows, "id"), column(rows, "row"), column(queries, "id"), column(queries, "row")
        for begin in range(0, len(queries), BLOCK):
            least, most = bounds(vectors[begin : begin + BLOCK], low, width, cells)
            own = asked[begin : begin + BLOCK, None] == key[None, :]
            least[own] = most[own] = -np.inf
            floor = np.partition(least, -k, axis=1)[:, -k] if len(rows) > k else np.full(len(least), -np.inf)
            q, r = np.nonzero((most >= floor[:, None]) & ~own)
            for to, x in zip(found, (numbers[begin + q], number[r], least[q, r], most[q, r]), strict=True):
                to.append(x)
    kinds = [np.int64, np.int64, np.float64, np.float64]
    return pa.table({c: np.concatenate(x) if x else np.empty(0, t) for c, x, t in zip(("query", "row", "least", "most"), found, kinds, strict=True)})


def scaled(embedding: str, scale: int) -> Column:
    """Components as floor(scale * x), or null for a vector that is null or has null or non-finite components."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(F.col(embedding).isNotNull() & ~bad, F.transform(embedding, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def approximate(vectors: DataFrame, bits: int = CELL_BITS) -> DataFrame:
    """The approximation file of (row, id, v): row, id, n components, low, width, and cells as bytes less 128."""
    low = F.array_min("v")
    # Halved first, as the range of components near the ends of 64 bits doesn't fit into them.
    width = F.floor((F.array_max("v") / 2 - low / 2) / (1 << (bits - 1))).cast("long") + 1
    bounded = vectors.select("row", "id", "v", F.size("v").alias("n"), low.alias("low"), width.alias("width"))
    cell = lambda x: F.least(F.floor((x - F.col("low")) / F.col("width")), F.lit((1 << bits) - 1))
    return bounded.select("row", "id", "n", "low", "width", F.transform("v", lambda x: (cell(x) - 128).cast("byte")).alias("cells"))


def _kth(df: DataFrame, value: str, k: int) -> DataFrame:
    """(query, kth): the kth greatest value of each query that has k."""
    order = Window.partitionBy("query").orderBy(F.desc(value))
    best = df.select("query", value).withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= k)
    return best.groupBy("query").agg(F.min(value).alias("kth"), F.count("*").alias("n")).where(F.col("n") == k).select("query", "kth")


def _reaching(df: DataFrame, kth: DataFrame) -> DataFrame:
    return df.join(kth, "query", "left").where(F.col("kth").isNull() | (F.col("most") >= F.col("kth"))).drop("kth")


def top_k(df: DataFrame, is_query: Column, k: int = 5, scale: int = 256, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k rows with the largest inner product for each row where is_query holds.

    Components become floor(scale * x). All rows but those with the query's own key are candidates; equal scores go to the
    smaller key. Vectors that are null, empty or hold null or non-finite components take no part, nor do null keys. Only
    vectors of one length are compared with each other. Repeated rows are candidates once each, and rows that share a query's
    key are ranked together. A pair whose score doesn't fit into 64 bits has none and is left out; components beyond 2^52 are
    not supported. An empty table or one without queries gives no rows. Other columns are not read.
    """
    prepare(df.sparkSession)
    read = df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("asks"), scaled(embedding, scale).alias("v")).where(F.size("v") > 0)
    rows = materialize(read.groupBy("id", "v").agg(F.count("*").alias("copies"), F.count_if("asks").alias("asked")).withColumn("row", F.monotonically_increasing_id()))
    same = Window.partitionBy(F.xxhash64("v"), "v").orderBy("id")
    cells = materialize(approximate(rows.withColumn("_rn", F.row_number().over(same)).where(F.col("_rn") <= k + 1)))
    asks = rows.where("asked > 0")
    groups, blocks = max(1, -(-cells.count() // VECTORS)), max(1, -(-asks.count() // QUERIES))
    mixed, each = F.xxhash64("row"), lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    no = lambda t: F.lit(None).cast(t)
    held = cells.select("row", "id", "n", "low", "width", "cells", no("array<long>").alias("q"), F.pmod(mixed, F.lit(groups)).cast("int").alias("g"), each(blocks).alias("b"))
    put = asks.select("row", "id", F.size("v").alias("n"), no("long").alias("low"), no("long").alias("width"), no("array<byte>").alias("cells"), F.col("v").alias("q"), each(groups).alias("g"), F.pmod(mixed, F.lit(blocks)).cast("int").alias("b"))
    found = materialize(held.union(put).groupBy("n", "g", "b").applyInArrow(lambda tile: candidates(tile, k), FOUND))
    near = materialize(_reaching(found, _kth(found, "least", k)))
    release(found, cells)

    # try_: sums beyond 64 bits give null rather than an error.
    product = F.aggregate(F.zip_with("v", "q", F.try_multiply), F.lit(0).cast("long"), F.try_add)
    vector = rows.select("row", F.col("id").alias("vec_id"), "v", "copies")
    query = rows.select(F.col("row").alias("query"), F.col("id").alias("query_id"), F.col("v").alias("q"), "asked")

    def exact(pairs: DataFrame) -> DataFrame:
        return pairs.select("query", "row").join(vector, "row").join(query, "query").withColumn("score", product).where("score is not null").select("query", "query_id", "vec_id", "score", (F.col("copies") * F.col("asked")).alias("times"))

    turn = near.withColumn("_rn", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("most"), "row")))
    first = materialize(exact(turn.where(F.col("_rn") <= k)))
    rest = _reaching(turn.where(F.col("_rn") > k), _kth(first, "score", k))
    times = F.explode(F.sequence(F.lit(1), F.least(F.col("times"), F.lit(k)).cast("int")))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    scored = first.union(exact(rest)).select("query_id", "vec_id", "score", times.alias("_copy"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
