"""Chains: rules by which each chosen row decides which row is chosen next.

A cooldown, a daily reminder and a baseline that only some rows replace all read "from a chosen row go on to the first later row
that passes a test against it". Followed row by row that is a loop over the whole history of a key. Here it is two parallel steps:

* `first_below` finds the next row of every row at once, whether chosen or not, by a tree of block minima: FANOUT ranks make a
  node, FANOUT nodes a node of the next level. A search climbs until a node holds a passing row and goes down to it again. Each
  level is one equi-join with arrays of at most FANOUT entries.
* `on_chain` follows the pointers from the start rows by jumps of doubled length, which only rows that such a jump can reach keep.

Groups of up to SHORT rows need neither: their rows fit in one bounded array, over which the rule runs as a fold expression.

Rows are addressed by a group `_k` (a struct, so that null parts are equal) and a rank `_rank` within it, from 1. The number of
levels and rounds grows with the logarithm of the longest group, and no task ever holds one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import written

FANOUT = 32
#: Rows of a group up to which it is followed in one array.
SHORT = 2048
#: Tests of a node: (column with the value of a row, column with the bound that it must be below to pass).
Tests = list[tuple[str, str]]


def _passing(tests: Tests, after: Column | None = None) -> Column:
    """First offset in `_kids` whose value is below one of the bounds, after an offset if there is one."""
    def ok(kid):
        hit = F.lit(False)
        for value, bound in tests:
            hit = hit | F.coalesce(kid[value] < F.col(bound), F.lit(False))
        return hit if after is None else hit & (kid["off"] > after)

    return F.array_min(F.transform(F.filter("_kids", ok), lambda kid: kid["off"]))


def _at_level(rows: DataFrame, node: Column, level: DataFrame) -> DataFrame:
    return rows.withColumn("_node", node).join(level, ["_k", "_node"], "left")


def first_below(rows: DataFrame, tests: Tests, out: str = "_next") -> DataFrame:
    """Add the least rank after a row's own of a row of its group that passes one of the tests; null if there is none.

    `rows` must be materialised: it is read at every level.
    """
    longest = rows.agg(F.max("_rank")).first()[0]
    if longest is None:
        return rows.withColumn(out, F.lit(None).cast("long"))
    values = sorted({v for v, _ in tests})
    levels, own, last = [], rows.select("_k", F.col("_rank").cast("long").alias("_at"), *values), int(longest)
    while True:
        kid = F.struct((F.col("_at") % FANOUT).alias("off"), *values)
        node = written(own.groupBy("_k", F.call_function("div", F.col("_at"), F.lit(FANOUT).cast("long")).alias("_node")).agg(
            F.collect_list(kid).alias("_kids"), *[F.min(v).alias(v) for v in values]))
        levels.append(node.select("_k", "_node", "_kids"))
        if last < FANOUT:
            break
        own, last = node.select("_k", F.col("_node").alias("_at"), *values), last // FANOUT
    found = rows.withColumns({"_hit": F.lit(None).cast("long"), "_level": F.lit(-1)})
    size = lambda n: F.lit(FANOUT ** n).cast("long")
    div = lambda a, b: F.call_function("div", a, b)
    for n, level in enumerate(levels):
        # rows that have their hit already meet the node all the same, so that none gathers under a null key
        found = _at_level(found, div(F.col("_rank").cast("long"), size(n + 1)), level)
        off = _passing(tests, div(F.col("_rank").cast("long"), size(n)) % FANOUT)
        found = found.withColumn("_off", F.when(F.col("_level") < 0, off)).withColumns({
            "_hit": F.coalesce("_hit", F.col("_node") * FANOUT + F.col("_off")),
            "_level": F.when(F.col("_off").isNotNull(), F.lit(n)).otherwise(F.col("_level"))}).drop("_node", "_kids", "_off")
    for n in range(len(levels) - 2, -1, -1):
        below = F.col("_level") > n
        found = _at_level(found, F.when(below, F.col("_hit")).otherwise(-1 - F.col("_rank").cast("long")), levels[n])
        found = found.withColumn("_hit", F.when(below, F.col("_node") * FANOUT + _passing(tests)).otherwise(F.col("_hit"))).drop("_node", "_kids")
    return found.withColumnRenamed("_hit", out).drop("_level")


def on_chain(pointers: DataFrame, start: DataFrame) -> DataFrame:
    """(_k, _rank) of the rows that are reached from the start rows (_k, _rank) by following _next of `pointers` (_k, _rank, _next).

    Jumps of 1, 2, 4 and more steps are made one after the other, each only for the start rows and the rows that such a jump reaches, as no
    other row is that many steps or a multiple of them from a start row; where chains flow together these soon become few. Jumps
    end at the next start row. Then the longest jumps are followed first.
    """
    flags = [F.lit(None).cast("long").alias("_next"), F.lit(False).alias("_start"), F.lit(True).alias("_hit")]

    def kept(jumps: DataFrame) -> DataFrame:
        hit = jumps.where("_next is not null").select("_k", F.col("_next").cast("long").alias("_rank"), *flags)
        joined = jumps.withColumn("_hit", F.lit(False)).unionByName(hit)
        return written(joined.groupBy("_k", "_rank").agg(F.max("_next").alias("_next"), F.max("_start").alias("_start"), F.max("_hit").alias("_hit"))
                       .where("_next is not null and (_start or _hit)").drop("_hit"))

    number = [F.col("_rank").cast("long").alias("_rank")]
    marked = written(start.select("_k", *number).distinct())
    jump = kept(pointers.where("_next is not null").select("_k", *number, F.col("_next").cast("long").alias("_next"), F.lit(False).alias("_start"))
                .unionByName(marked.select("_k", "_rank", *flags[:1], F.lit(True).alias("_start"))))
    jumps = []
    while not jump.isEmpty():
        jumps.append(jump)
        onward = jump.where("not _start").select("_k", F.col("_rank").alias("_next"), F.col("_next").alias("_far"))
        jump = kept(written(jump.join(onward, ["_k", "_next"]).select("_k", "_rank", F.col("_far").alias("_next"), "_start")))
    for jump in reversed(jumps):
        step = marked.join(jump, ["_k", "_rank"]).select("_k", F.col("_next").alias("_rank"))
        marked = written(marked.union(step).distinct())
    return marked


def chosen(rows: DataFrame, tests: Tests, start: Column, roots: DataFrame | None = None, out: str = "_on") -> DataFrame:
    """Add whether a row is on the chain of its group. `rows` has _k, _rank, the columns of the tests, and is materialised.

    Chains begin at the rows that pass `start`, and at `roots`: rows of rank 0 for groups in which what came earlier decides, with
    the bounds of the tests alone.
    """
    names = sorted({c for pair in tests for c in pair})
    nodes = rows.select("_k", F.col("_rank").cast("long").alias("_rank"), *names, F.coalesce(start, F.lit(False)).alias("_start"))
    if roots is not None:
        nodes = nodes.unionByName(roots.withColumn("_start", F.lit(True)), allowMissingColumns=True)
    long = rows.groupBy("_k").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SHORT).select("_k")
    if long.isEmpty():
        on = _in_arrays(nodes, tests)
    else:
        long = written(long)
        nodes = written(nodes)
        few, many = nodes.join(long, ["_k"], "left_anti"), written(nodes.join(long, ["_k"], "left_semi"))
        on = _in_arrays(few, tests).unionByName(on_chain(first_below(many, tests), many.where("_start")))
    return rows.join(on.withColumn(out, F.lit(True)), ["_k", "_rank"], "left").withColumn(out, F.coalesce(out, F.lit(False)))


def _in_arrays(nodes: DataFrame, tests: Tests) -> DataFrame:
    """(_k, _rank) of the rows on the chains of groups of at most SHORT rows."""
    names = sorted({c for pair in tests for c in pair})
    bounds = [bound for _, bound in tests]
    listed = nodes.groupBy("_k").agg(F.array_sort(F.collect_list(F.struct("_rank", "_start", *names))).alias("_rows"))
    types = {c: nodes.schema[c].dataType for c in bounds}
    none = F.struct(F.array().cast("array<bigint>").alias("on"), *[F.lit(None).cast(types[c]).alias(c) for c in bounds])

    def step(acc, row):
        hit = row["_start"]
        for value, bound in tests:
            hit = hit | F.coalesce(row[value] < acc[bound], F.lit(False))
        taken = F.struct(F.concat(acc["on"], F.array(row["_rank"])).alias("on"), *[row[c].alias(c) for c in bounds])
        return F.when(hit, taken).otherwise(acc)

    return listed.select("_k", F.explode(F.aggregate("_rows", none, step)["on"]).alias("_rank"))
