"""Packing by optimal length buckets.

1. One pass counts the tokens of each document and stores a narrow table.
2. The global histogram of lengths goes to the driver: at most 1024 + 128 for each doubling beyond, whatever the input.
   Lengths up to 1024 are exact; longer ones share a cell with others within 1/128 of them, and a cell keeps its
   largest length and its sum, so the padding computed is exact for every boundary that is tried.
3. Dynamic programming chooses the boundaries with the least padding among all cell maxima.
4. Inside each bucket, documents are numbered over the whole table by shards of bounded size and a running sum of shard
   sizes; each `budget // boundary` in a row are a batch. A bucket has one batch at most that isn't full.

Rules: null text has no token; the boundary of a bucket is at least one token. A document longer than the budget is a batch
of its own. Order in a bucket is by shard, length, id (nulls last) and text hash; wholly repeated rows are told apart by
their position.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricewatch.llm.shared import n_words, stored

BUCKETS, BUDGET, SHARD_ROWS = 16, 32768, 1024
EXACT, STEPS = 1024, 128


def cell(length: Column) -> Column:
    """Cell of a length in the histogram: itself up to EXACT, then STEPS cells for each doubling."""
    power = F.floor(F.log2(F.greatest(length, F.lit(1)).cast("double")))
    width = F.pow(F.lit(2.0), power) / STEPS
    return F.when(length <= EXACT, length.cast("long")).otherwise((EXACT + power * STEPS + F.floor(length / width)).cast("long"))


def boundaries(top: np.ndarray, count: np.ndarray, total: np.ndarray, buckets: int) -> list[int]:
    """Upper bounds of at most `buckets` ranges of cells, in order, that minimise the sum of count * bound - total.

    top: largest length of each cell, rising. count: documents. total: sum of their lengths. O(buckets * cells^2), in numpy.
    """
    n = len(top)
    if n == 0:
        return []
    top = np.maximum(np.asarray(top, dtype=np.int64), 1)
    c, t = np.concatenate([[0], np.cumsum(count)]).astype(float), np.concatenate([[0], np.cumsum(total)]).astype(float)
    best, cuts = np.full(n + 1, np.inf), []
    best[0] = 0.0
    for _ in range(min(buckets, n)):
        new, cut = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=np.int64)
        for j in range(1, n + 1):
            cost = best[:j] + (c[j] - c[:j]) * top[j - 1] - (t[j] - t[:j])
            cut[j] = np.argmin(cost)
            new[j] = cost[cut[j]]
        cuts.append(cut)
        if new[n] >= best[n]:
            cuts.pop()
            break
        best = new
    out, j = [], n
    for cut in reversed(cuts):
        if j == 0:
            break
        out.append(int(top[j - 1]))
        j = int(cut[j])
    return out[::-1]


def pack(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET, id_col: str = "doc_id", text_col: str = "text",
         length: Column | None = None) -> DataFrame:
    """doc_id, n_tokens, bucket, bucket_len, batch, slot: one row for each input row; (bucket, batch) names a batch.

    length: tokens of a row; words by default. A batch has at most budget // bucket_len rows, each padded to bucket_len.
    """
    n = F.coalesce((n_words(F.col(text_col)) if length is None else length).cast("long"), F.lit(0).cast("long"))
    rows = stored(docs.select(F.col(id_col).alias("doc_id"), n.alias("n_tokens"), F.xxhash64(text_col).alias("h"))
                  .withColumn("row", F.monotonically_increasing_id()), "lengths")
    histogram = (rows.groupBy(cell(F.col("n_tokens")).alias("cell"))
                 .agg(F.max("n_tokens").alias("top"), F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("total"))
                 .orderBy("cell").toPandas())
    bounds = boundaries(histogram["top"].to_numpy(), histogram["n"].to_numpy(), histogram["total"].to_numpy(), buckets)
    sizes, low = [], -1
    for b in bounds:
        inside = (histogram["top"] > low) & (histogram["top"] <= b)
        sizes.append(int(histogram["n"][inside].sum()))
        low = b
    if not bounds:
        bounds, sizes = [1], [0]
    bucket, bound, shards = F.lit(len(bounds) - 1), F.lit(bounds[-1]), F.lit(-(-sizes[-1] // SHARD_ROWS) or 1)
    for i in range(len(bounds) - 2, -1, -1):
        fits = F.col("n_tokens") <= bounds[i]
        bucket, bound = F.when(fits, F.lit(i)).otherwise(bucket), F.when(fits, F.lit(bounds[i])).otherwise(bound)
        shards = F.when(fits, F.lit(-(-sizes[i] // SHARD_ROWS) or 1)).otherwise(shards)
    placed = rows.withColumns({"bucket": bucket.cast("int"), "bucket_len": bound.cast("long"),
                               "shard": F.pmod(F.xxhash64("doc_id", "h"), shards.cast("long"))})
    before = placed.groupBy("bucket", "shard").agg(F.count(F.lit(1)).alias("n"))
    before = before.select("bucket", "shard", (F.sum("n").over(Window.partitionBy("bucket").orderBy("shard")) - F.col("n")).alias("before"))
    inside = Window.partitionBy("bucket", "shard").orderBy("n_tokens", F.asc_nulls_last("doc_id"), "h", "row")
    place = F.col("before") + F.row_number().over(inside) - 1
    per_batch = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(budget) / F.col("bucket_len")))
    return (placed.join(before, ["bucket", "shard"]).withColumn("place", place)
            .select("doc_id", "n_tokens", "bucket", "bucket_len", F.floor(F.col("place") / per_batch).alias("batch"),
                    F.pmod("place", per_batch).alias("slot")))
