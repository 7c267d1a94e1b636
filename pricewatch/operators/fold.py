"""Cooldowns: of a history, the rows that are a given time apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import written
from .chains import on_chain
from .skew import HOT_MIN_ROWS, HistoryScan, join_groups


def spaced_pick(df: DataFrame, keys: list[str], time: str, ties: list[str], seconds: int, out: str = "picked",
                since: str | None = None, eligible: Column | None = None,
                hot_min_rows: int = HOT_MIN_ROWS) -> DataFrame:
    """Mark the rows a cooldown lets through: the first, then each first row at least `seconds` after the last one
    let through. `since` names a column with the time of an earlier pick; rows that are not `eligible` never pass.

    Only the distinct moments of a key decide. One scan against time over the moments and, `seconds` later, their questions gives
    each moment the first one that may follow it. It also counts both: where as many questions are passed as moments, all earlier moments
    are at least `seconds` before, so that this one always passes. The chains of pointers between those are followed
    (`chains.on_chain`), and the moments on them are joined to the rows.
    """
    span = seconds * 1_000_000
    base = F.lit(None).cast("bigint") if since is None else F.unix_micros(F.col(since))
    ok = F.lit(True) if eligible is None else F.coalesce(eligible, F.lit(False))
    late = base.isNull() | (F.col("_at") - base >= span)
    rows = written(df.withColumn("_at", F.unix_micros(F.col(time))).withColumn("_may", ok & late))
    moments = written(rows.where("_may and _at is not null").select(*keys, "_at").distinct())
    asked = moments.select(*keys, (-F.col("_at") - span).alias("_back"), F.lit(1).alias("_asks"), "_at", F.lit(None).cast("bigint").alias("_value"))
    both = moments.select(*keys, (-F.col("_at")).alias("_back"), F.lit(0).alias("_asks"), "_at", F.col("_at").alias("_value")).unionByName(asked)

    def build(rows: DataFrame, scan: HistoryScan) -> DataFrame:
        values = {"_next": ("last", F.col("_value")), "_open": ("sum", (1 - 2 * F.col("_asks")).cast("bigint"))}
        return scan.add(rows, values, include_current=True).select(F.struct(*keys).alias("_k"), F.col("_at").alias("_rank"), "_asks", "_next", "_open")

    scanned = written(HistoryScan(keys, "_back", ["_asks"], hot_min_rows).apply(both, build))
    picks = on_chain(scanned.where("_asks = 1"), scanned.where("_asks = 0 and _open = 0"))
    found = picks.select("_k.*", F.col("_rank").alias("_at"), F.lit(True).alias("_on"))
    # a row without a time passes if nothing was let through before
    marked = written(join_groups(rows, found, [*keys, "_at"]).withColumn("_on", F.when(F.col("_at").isNull(), F.col("_may")).otherwise(F.col("_may") & F.col("_on").isNotNull())))
    timed = F.col("_on") & F.col("_at").isNotNull()
    first = F.row_number().over(Window.partitionBy(*keys, "_at").orderBy(*(ties or [time]))) == 1
    plain = marked.where(~F.coalesce(timed, F.lit(False))).withColumn(out, F.col("_on"))
    return plain.unionByName(marked.where(timed).withColumn(out, first)).drop("_at", "_may", "_on")
