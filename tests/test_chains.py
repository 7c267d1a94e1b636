import bisect
import random
from datetime import datetime, timedelta
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from pricewatch.operators import alerts, chains, fold, health, history
from pricewatch.operators.skew import BLOCK, HistoryScan, hot_keys, salted_join
from pricewatch.session import written
from test_history import OBS, T0, plain_alerts, plain_bounds


@pytest.mark.parametrize("n, fanout", [(1, 32), (31, 32), (200, 4), (2100, 32)])
def test_first_below(spark, monkeypatch, n, fanout):
    monkeypatch.setattr(chains, "FANOUT", fanout)
    rnd = random.Random(n)
    draw = lambda: rnd.choice([None, rnd.randrange(50), rnd.randrange(2000)])
    rows = [(k, i, draw(), draw(), draw(), draw()) for k in ("a", None) for i in range(1, n + 1)]
    df = spark.createDataFrame(rows, "k string, _rank long, v long, q long, w long, r long").withColumn("_k", F.struct("k")).drop("k")
    got = {(r["_k"].k, r["_rank"]): r["_next"] for r in chains.first_below(written(df), [("v", "q"), ("w", "r")]).collect()}
    less = lambda x, y: x is not None and y is not None and x < y
    for k, i, _, q, _, r in rows:
        later = (j for z, j, v, _, w, _ in rows if z == k and j > i and (less(v, q) or less(w, r)))
        assert got[(k, i)] == next(later, None)


def test_on_chain(spark):
    rnd = random.Random(4)
    step = {("a", i): (i + rnd.randint(1, 4)) for i in range(1, 500)} | {("b", 1): 2}
    rows = [(k, i, t) for (k, i), t in step.items()]
    df = spark.createDataFrame(rows, "k string, _rank long, _next long").withColumn("_k", F.struct("k")).drop("k")
    start = spark.createDataFrame([("a", 3), ("b", 1), ("c", 7)], "k string, _rank long").withColumn("_k", F.struct("k")).drop("k")
    got = sorted((r["_k"].k, r["_rank"]) for r in chains.on_chain(df, start).collect())
    want, at = [("b", 1), ("b", 2), ("c", 7)], 3
    while at is not None:
        want.append(("a", at))
        at = step.get(("a", at))
    assert got == sorted(want)


def dense(n, seed=5, minutes=7):
    """One offer in daily mode, checked every few minutes, always under its target: one segment without a cut after the first row."""
    rnd = random.Random(seed)
    return [("k", T0 + timedelta(minutes=minutes * i), i, D(60 if i == 0 else 50 if i == 1 else 61 + rnd.randrange(30)), D(100), True, False) for i in range(n)]


@pytest.mark.parametrize("n", [1_500, 100_000])
def test_one_long_segment_equals_fold(spark, n):
    rows = dense(n)
    got = {r.seq: r.sent for r in alerts.alert_decisions(spark.createDataFrame(rows, OBS)).collect()}
    want = {seq: sent for (_, seq), (sent, _) in plain_alerts(rows).items()}
    assert got == want and sum(want.values()) > n / 400


def test_no_python_in_the_plans(spark):
    obs = spark.createDataFrame(dense(400), OBS)
    cycles = spark.createDataFrame([("t", T0 + timedelta(minutes=i), i, "s", 100 - i % 50) for i in range(300)],
                                   "tracker string, cycle_at timestamp, seq bigint, signature string, row_count bigint")
    spaced = fold.spaced_pick(cycles, ["tracker"], "cycle_at", ["seq"], 3600)
    for df in (alerts.alert_decisions(obs), health.row_count_alerts(cycles), spaced):
        plan = df._jdf.queryExecution().toString()
        assert "MapInPandas" not in plan and "InArrow" not in plan and "Python" not in plan


def test_jump_tables_shrink_where_chains_flow_together(spark, monkeypatch):
    """Pointers of a dense cooldown: all tables of jumps together have a few times the rows, not rows times rounds."""
    n, rnd, sizes = 20_000, random.Random(8), []
    at = sorted(rnd.sample(range(40 * n), n))
    target = [bisect.bisect_left(at, t + 1_000) for t in at]
    df = written(spark.createDataFrame([(("a",), t, at[j] if j < n else None) for t, j in zip(at, target)], "_k struct<k:string>, _rank long, _next long"))

    def counted(table):
        table = written(table)
        sizes.append(table.count())
        return table

    monkeypatch.setattr(chains, "written", counted)
    start = spark.createDataFrame([(("a",), at[0])], "_k struct<k:string>, _rank long")
    got = sorted(r["_rank"] for r in chains.on_chain(df, start).collect())
    want, i = [], 0
    while i < n:
        want.append(at[i])
        i = target[i]
    assert got == want and sum(sizes) < 5 * n


def test_cooldown_of_odd_rows(spark):
    """Rows at one moment, without a time or a key: of a moment one row passes, without a time all before the first pick."""
    rows = [("a", T0, 2, True), ("a", T0, 1, True), ("a", T0, 0, False), ("a", None, 3, True), ("a", None, 4, False), (None, T0, 5, True), (None, None, 6, True),
            ("a", T0 + timedelta(minutes=15), 7, True), ("a", T0 + timedelta(minutes=29), 8, True), ("a", T0 + timedelta(minutes=30), 9, None), ("a", T0, 1, True)]
    df = spark.createDataFrame(rows, "k string, ts timestamp, seq bigint, ok boolean")
    out = fold.spaced_pick(df, ["k"], "ts", ["seq"], 900, eligible=F.col("ok")).collect()
    assert len(out) == len(rows) and sorted(r.seq for r in out if r.picked) == [1, 3, 5, 6, 7]


def test_long_cooldown_island(spark):
    rows = [("a", T0 + timedelta(minutes=i), i) for i in range(20_000)] + [(None, T0 + timedelta(minutes=40 * i), i) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, ts timestamp, seq bigint")
    got = {(r.k, r.seq) for r in fold.spaced_pick(df, ["k"], "ts", ["seq"], 900).where("picked").collect()}
    assert got == {("a", i) for i in range(0, 20_000, 15)} | {(None, i) for i in range(300)}
    assert {r.seq for r in fold.spaced_pick(df, ["k"], "ts", ["seq"], 3600).where("picked and k is null").collect()} == set(range(0, 300, 2))


@pytest.mark.parametrize("hot", [1_000_000, 100])
def test_cooldown_goes_on_from_earlier_picks(spark, hot):
    rows = [("a", T0 + timedelta(minutes=7 * i), i, T0 - timedelta(minutes=20), i % 3 > 0) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, ts timestamp, seq bigint, since timestamp, ok boolean")
    got = {r.seq for r in fold.spaced_pick(df, ["k"], "ts", ["seq"], 3600, since="since", eligible=F.col("ok"), hot_min_rows=hot).where("picked").collect()}
    last, want = T0 - timedelta(minutes=20), set()
    for _, ts, seq, _, ok in rows:
        if ok and ts - last >= timedelta(hours=1):
            want.add(seq)
            last = ts
    assert got == want


@pytest.mark.parametrize("hot, signatures, short", [(1_000_000, 2, 2048), (1_000_000, 2, 40), (200, 1, 2048)])
def test_row_counts_equal_fold(spark, monkeypatch, hot, signatures, short):
    monkeypatch.setattr(chains, "SHORT", short)
    rnd = random.Random(signatures)
    rows, at = [], T0 + timedelta(hours=8)
    for i in range(600):
        at += timedelta(minutes=rnd.choice([1, 5, 30]))
        rows.append(("t", at, i, f"s{i * signatures // 600}", rnd.choice([0, 3, rnd.randrange(100), 60, 40, 30])))
    df = spark.createDataFrame(rows, "tracker string, cycle_at timestamp, seq bigint, signature string, row_count bigint")
    got = {r.seq: (r.expected, r.streak) for r in health.row_count_alerts(df, hot_min_rows=hot).collect()}
    base, streak, sig, want = 0, 0, None, {}
    for _, _, i, s, n in rows:
        if s == sig and base > 0 and base - n >= max(6, -(-base // 3)):
            streak += 1
        else:
            base, streak = n, 0
        sig = s
        want[i] = (base, streak)
    assert got == want


def test_one_hot_key_on_one_day_runs_in_many_tasks(spark):
    """Blocks hold equal numbers of rows, whatever their times: a day, a single moment, or a null key."""
    n = 40_000
    df = spark.range(n).select(
        F.when(F.col("id") % 4 == 0, None).otherwise("k").alias("offer_key"),
        F.timestamp_micros(F.lit(1_767_225_600_000_000) + (F.col("id") * 7919 % n) * 1_000_000).alias("observed_at"), F.col("id").alias("seq"),
        (F.pmod(F.xxhash64("id"), F.lit(500)) + 1).cast("decimal(18,4)").alias("price"), F.lit(100).cast("decimal(18,4)").alias("target_price"))
    scan = HistoryScan(["offer_key"], "observed_at", ["seq"], hot_min_rows=5_000, block_rows=4_000)
    sizes = {}

    def build(rows, s):
        if s.blocked:
            sizes.update({(r.offer_key, r[BLOCK]): r["count"] for r in rows.groupBy("offer_key", BLOCK).count().collect()})
        return s.add(rows, {"low": ("min", F.col("price")), "n": ("sum", F.lit(1))}, True)

    got = scan.apply(df, build)
    assert len(sizes) >= 10 and max(sizes.values()) < 12_000 and {k for k, _ in sizes} == {"k", None}
    plain = HistoryScan(["offer_key"], "observed_at", ["seq"]).apply(df, lambda r, s: s.add(r, {"low": ("min", F.col("price")), "n": ("sum", F.lit(1))}, True))
    assert got.exceptAll(plain).isEmpty() and got.count() == n
    same = df.withColumn("observed_at", F.lit(datetime(2026, 1, 1)))
    assert scan.apply(same, build).exceptAll(HistoryScan(["offer_key"], "observed_at", ["seq"]).apply(same, build)).isEmpty()


def test_hot_keys_counted_once(spark):
    rows = [("k", T0 + timedelta(minutes=i), i, D(90 + i % 20), D(100), True, False) for i in range(300)] + [("c", T0, 0, D(5), D(100), False, False)]
    df = spark.createDataFrame(rows, OBS)
    scan = HistoryScan(["offer_key"], "observed_at", ["seq"], hot_min_rows=100, block_rows=40).with_hot_keys(df)
    assert scan.hot.rows == 300
    decided = alerts.alert_reasons(alerts.alert_decisions(history.price_bounds(df, scan=scan), scan=scan), scan)
    assert {(r.offer_key, r.seq): (r.sent, r.reason) for r in decided.collect()} == plain_alerts(rows)
    bounds = plain_bounds(rows)
    assert all((r.min_price, r.max_price) == bounds[(r.offer_key, r.seq)][:2] for r in decided.collect())
    none = hot_keys(df, ["offer_key"], 1000)
    assert none.table is None and none.part(df, True).isEmpty() and none.part(df, False).count() == 301


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_with_null_keys(spark, how):
    left = spark.createDataFrame([(None if i % 2 else i % 3, i) for i in range(600)], "k int, id int")
    right = spark.createDataFrame([(0, "a"), (2, "c"), (None, "n")], "k int, v string")
    a = sorted(map(tuple, left.join(right, ["k"], how).collect()), key=str)
    assert sorted(map(tuple, salted_join(left, right, ["k"], how, F.col("id"), 4, hot_min_rows=50).collect()), key=str) == a
