"""Connected components of a graph in tables, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewatch.llm.shared import stored


def _to_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    return edges.join(least, "u")


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", rounds: int = 60) -> DataFrame:
    """(node, root) of every node of an edge, root being the least node of its component. No edges: no rows.

    Each round is two grouped minima and two joins; both inputs of a join are stored tables, so that adaptive execution
    can split the rows of a hub. The rounds needed grow with the logarithm of the longest chain; the number of rounds is
    a guard against endless loops, and running into it is an error, never a result.
    """
    now = stored(edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
                 .where("u <> v").distinct(), "edges")
    mark = _mark(now)
    for _ in range(rounds):
        if mark[0] == 0:
            break
        both = stored(now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v"))), "both")
        least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = stored(_to_least(both.where("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v"))
                       .where("u <> v").distinct(), "large")
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = _to_least(large, least).select(F.explode(F.array(
            F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))
        )).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        now = stored(small, "edges")
        last, mark = mark, _mark(now)
        if mark == last:
            break
    else:
        raise RuntimeError("components did not converge")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
    return row[0], row[1]
