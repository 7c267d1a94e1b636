"""Ordered scans and joins that survive hot keys.

A window over `partitionBy(key)` sends all rows of one key to one task. That is right for ordinary keys and
fatal when one key holds a third of the data. The helpers here find the hot keys first (one pre-aggregated
count; their number is bounded) and treat only those differently:

* `HistoryScan` cuts the history of a hot key into blocks of equal numbers of rows, scans every block on its own and adds
  what the earlier blocks carry in. The results are those of the plain window.
* `salted_join` spreads the hot keys of an equi-join over several tasks.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import written

HOT_MIN_ROWS = 1_000_000
HOT_MAX_KEYS = 10_000
BLOCK_ROWS = 250_000
BLOCK = "_block"


@dataclass(frozen=True)
class HotKeys:
    """The keys with most rows of a table, null keys included, and how many rows they have."""

    keys: list[str]
    table: DataFrame | None
    rows: int

    def part(self, df: DataFrame, hot: bool) -> DataFrame:
        """The rows of the hot keys, or those of all others. A null key is equal to itself here."""
        if self.table is None:
            return df.where(F.lit(not hot))
        few = F.broadcast(self.table.select(_group(self.keys)))
        return df.withColumn("_group", _group(self.keys)).join(few, ["_group"], "left_semi" if hot else "left_anti").drop("_group")


def hot_keys(df: DataFrame, keys: list[str], min_rows: int = HOT_MIN_ROWS, max_keys: int = HOT_MAX_KEYS) -> HotKeys:
    """The keys with more than `min_rows` rows.

    Counting reads the key columns only and is pre-aggregated in every task. The result never exceeds `max_keys` rows, so it
    may be held by the driver and broadcast; any key left out has at most 1/`max_keys` of the table.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > min_rows)
    rows = counts.orderBy(F.col("n").desc()).limit(max_keys).collect()
    table = df.sparkSession.createDataFrame([r[:-1] for r in rows], df.select(*keys).schema) if rows else None
    return HotKeys(keys, table, sum(r["n"] for r in rows))


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """First `n` rows of every key in a total order.

    `row_number() <= n` is cut to `n` rows per key and task before the shuffle (window group limit), so a hot
    key costs `n` rows per task.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


@dataclass(frozen=True)
class HistoryScan:
    """Running values over the history of each key, in (time, tie-breakers) order."""

    keys: list[str]
    time: str
    ties: list[str]
    hot_min_rows: int = HOT_MIN_ROWS
    block_rows: int = BLOCK_ROWS
    hot: HotKeys | None = None
    blocked: bool = False

    @property
    def order(self) -> list[str]:
        return [self.time, *self.ties]

    def with_hot_keys(self, df: DataFrame) -> "HistoryScan":
        """This scan with the hot keys of `df` counted once, for all operators that run over the same history."""
        return replace(self, hot=hot_keys(df, self.keys, self.hot_min_rows))

    def apply(self, df: DataFrame, build: Callable[[DataFrame, "HistoryScan"], DataFrame]) -> DataFrame:
        """Run `build(rows, scan)` on the ordinary keys with plain windows and on the hot keys in blocks.

        Blocks are the parts of a range partitioning by key, time and tie-breakers, whose bounds Spark samples: a block has about
        `block_rows` rows, however they lie in time.
        """
        hot = self.hot if self.hot is not None else hot_keys(df, self.keys, self.hot_min_rows)
        if hot.table is None:
            return build(df, self)
        parts = max(2, -(-hot.rows // self.block_rows))
        blocks = hot.part(df, True).repartitionByRange(parts, *self.keys, *self.order).withColumn(BLOCK, F.spark_partition_id())
        hot_part = build(written(blocks), replace(self, blocked=True)).drop(BLOCK)
        return build(hot.part(df, False), self).unionByName(hot_part)

    def add(self, df: DataFrame, values: dict[str, tuple[str, Column]], include_current: bool,
            extra_keys: list[str] | None = None) -> DataFrame:
        """Add running values: name -> (kind, expression), kind one of min, max, sum, last, first.

        `last` and `first` skip nulls. With `include_current` false the current row is left out.
        """
        keys = [*self.keys, *(extra_keys or [])]
        parts = [*keys, BLOCK] if self.blocked else keys
        frame = Window.partitionBy(*parts).orderBy(*self.order).rowsBetween(
            Window.unboundedPreceding, 0 if include_current else -1
        )
        here = {name: _running(kind, expr).over(frame) for name, (kind, expr) in values.items()}
        if not self.blocked:
            return df.withColumns(here)
        # Totals of every block, then what all earlier blocks carry into each block: one row per key and block.
        df = written(df)
        position = F.struct(*[F.col(c) for c in self.order])
        totals = df.groupBy(*parts).agg(
            *[_total(kind, expr, position).alias(name) for name, (kind, expr) in values.items()]
        )
        before = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
        carry = totals.select(
            *parts, *[_running(kind, F.col(name)).over(before).alias(f"_c_{name}") for name, (kind, _) in values.items()]
        )
        merged = {name: _merge(kind, F.col(f"_c_{name}"), F.col(name)) for name, (kind, _) in values.items()}
        out = join_groups(df.withColumns(here), carry, parts).withColumns(merged)
        return out.drop(*[f"_c_{name}" for name in values])

    def any_in(self, df: DataFrame, name: str, test: Column, extra_keys: list[str]) -> DataFrame:
        """Add whether any row of the (key, extra keys) group passes the test."""
        keys = [*self.keys, *extra_keys]
        if not self.blocked:
            return df.withColumn(name, F.max(test).over(Window.partitionBy(*keys)))
        df = written(df)
        return join_groups(df, df.groupBy(*keys).agg(F.max(test).alias(name)), keys)


def _group(keys: list[str]) -> Column:
    """The keys as one struct, which equals another one with the same nulls."""
    return F.struct(*keys).alias("_group")


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """Left join of rows with one row for each group; null keys are equal to each other."""
    other = groups.select(_group(keys), *[c for c in groups.columns if c not in keys])
    return rows.withColumn("_group", _group(keys)).join(other, ["_group"], "left").drop("_group")


def _running(kind: str, expr: Column) -> Column:
    if kind == "last":
        return F.last(expr, ignorenulls=True)
    if kind == "first":
        return F.first(expr, ignorenulls=True)
    return {"min": F.min, "max": F.max, "sum": F.sum}[kind](expr)


def _total(kind: str, expr: Column, position: Column) -> Column:
    if kind == "last":
        return F.max_by(expr, F.when(expr.isNotNull(), position))
    if kind == "first":
        return F.min_by(expr, F.when(expr.isNotNull(), position))
    return _running(kind, expr)


def _merge(kind: str, carry: Column, here: Column) -> Column:
    if kind == "min":
        return F.least(carry, here)
    if kind == "max":
        return F.greatest(carry, here)
    if kind == "sum":
        return F.when(carry.isNull(), here).when(here.isNull(), carry).otherwise(carry + here)
    return F.coalesce(here, carry) if kind == "last" else F.coalesce(carry, here)


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], how: str, salt_by: Column, salts: int = 64,
                hot_min_rows: int = HOT_MIN_ROWS) -> DataFrame:
    """Equi-join (inner, left, left_semi, left_anti) whose hot left keys are spread over `salts` tasks.

    Only right rows of hot keys are repeated. The salt comes from row content (`salt_by`), never from a random
    number, so a retried task agrees with the first attempt.
    """
    hot = hot_keys(left.where(reduce(and_, [left[k].isNotNull() for k in keys])), keys, hot_min_rows)
    if hot.table is None:
        return left.join(right, keys, how)
    # left rows with a null key match nothing and need not meet in one task
    never = reduce(or_, [left[k].isNull() for k in keys])
    cold = hot.part(left.where(~never), False).join(right, keys, how)
    salted_left = hot.part(left, True).withColumn("_salt", F.pmod(F.xxhash64(salt_by), F.lit(salts)).cast("int"))
    copies = hot.part(right, True).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    joined = cold.unionByName(salted_left.join(copies, [*keys, "_salt"], how).drop("_salt"))
    return joined.unionByName(left.where(never), allowMissingColumns=True) if how in ("left", "left_anti") else joined
