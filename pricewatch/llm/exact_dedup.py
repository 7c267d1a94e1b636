"""Exact deduplication by a heavy-hitter split, in DataFrame functions only.

1. One pass over the texts writes a narrow table: document, digest of the normalised text, length, row number.
2. Misra-Gries counting (`freqItems`) over 60-bit prefixes of the digests finds at most `1 / support` candidates; no digest
   above that share of the rows can be missed.
3. The candidates are verified by an exact grouped count over whole digests. The winners of those that are frequent
   indeed, at most `1 / support` rows, are broadcast and decide their groups on the map side.
4. All other digests, each below that share, are decided by one ordinary shuffle.

Rules: null text is empty; texts are equal if they are so without white space. Of equal texts the longest in code points
stays, then the smallest id (nulls last), then the least hash of the original text; wholly repeated rows keep one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricewatch.llm.shared import SPACE, stored

#: Share of all rows above which a digest counts as frequent; 1 / SUPPORT bounds the broadcast.
SUPPORT = 1 / 512


def _keys(text) -> dict:
    plain = F.coalesce(text.cast("string"), F.lit(""))
    return {"__digest": F.unhex(F.sha2(F.translate(plain, SPACE, ""), 256)), "__chars": F.char_length(plain),
            "__raw": F.xxhash64(plain)}


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """One row for each input row: doc_id, keep_id, group_size, kept, and the keys __digest, __chars, __raw."""
    base = stored(docs.select(F.col(id_col).alias("doc_id"), *[c.alias(n) for n, c in _keys(F.col(text_col)).items()])
                  .withColumn("__row", F.monotonically_increasing_id())
                  .withColumn("__prefix", F.conv(F.substring(F.hex("__digest"), 1, 15), 16, 10).cast("long")), "digests")
    total = base.count()
    candidates = base.freqItems(["__prefix"], support).select(F.explode("__prefix_freqItems").alias("__prefix"))
    best = F.min(F.struct((-F.col("__chars")).alias("c"), F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("d"),
                          F.col("__raw").alias("r"), F.col("__row").alias("n")))
    winners = (base.join(F.broadcast(candidates), "__prefix", "left_semi").groupBy("__digest")
               .agg(best.alias("w"), F.count(F.lit(1)).alias("group_size")).where(F.col("group_size") > total * support)
               .select("__digest", F.col("w.d").alias("keep_id"), "group_size", F.col("w.n").alias("__keep_row")))
    marked = base.join(F.broadcast(winners), "__digest", "left")
    columns = ["doc_id", "keep_id", "group_size", "kept", "__digest", "__chars", "__raw"]
    frequent = marked.where("__keep_row is not null").withColumn("kept", F.col("__row") == F.col("__keep_row"))
    group = Window.partitionBy("__digest")
    first = group.orderBy(F.desc("__chars"), F.asc_nulls_last("doc_id"), "__raw", "__row")
    rest = (marked.where("__keep_row is null").drop("keep_id", "group_size")
            .withColumn("kept", F.row_number().over(first) == 1)
            .withColumn("keep_id", F.first("doc_id").over(first))
            .withColumn("group_size", F.count(F.lit(1)).over(group)))
    return frequent.select(*columns).union(rest.select(*columns))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """The rows of `docs` that stay, with all their columns."""
    keys = _keys(F.col(text_col))
    kept = stored(decisions(docs, id_col, text_col, support).where("kept")
                  .select(F.col("doc_id").alias("__id"), "__digest", "__chars", "__raw"), "kept")
    keyed = docs.withColumns({"__id": F.col(id_col), **keys})
    on = [keyed[c].eqNullSafe(kept[c]) for c in ("__id", *keys)]
    return keyed.join(kept, on, "left_semi").dropDuplicates(["__id", *keys]).select(*docs.columns)
