import random
from collections import namedtuple
from datetime import datetime, timedelta, timezone
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from pricewatch.operators import alerts, fold, history
from pricewatch.operators.skew import HistoryScan

T0 = datetime(2026, 1, 1)
OBS = ("offer_key string, observed_at timestamp, seq bigint, price decimal(18,4), target_price decimal(18,4), "
       "notify_once_in_24h boolean, forced_sent boolean")


def random_history(seed, n, keys=6, minutes=400, prices=(60, 160), spikes=True, forced=0.03):
    rnd = random.Random(seed)
    rows, clock = [], {}
    for seq in range(n):
        k = f"k{rnd.randrange(keys)}"
        clock[k] = clock.get(k, T0) + timedelta(minutes=rnd.choice([0, 0, 30, rnd.randrange(1, minutes), 1440 if rnd.random() < 0.1 else 60]))
        p = D(rnd.randrange(*prices))
        if spikes and rnd.random() < 0.15:
            p += D(rnd.choice([50_000, 700_000, 3_000_000]))
        rows.append((k, clock[k], seq, p, D(rnd.choice([100, 100, 100, 110])), int(k[1]) % 2 == 0, rnd.random() < forced))
    rnd.shuffle(rows)
    return rows


def plain_bounds(rows):
    out, state = {}, {}
    for k, ts, seq, p, target, _, _ in sorted(rows, key=lambda r: (r[1], r[2])):
        last, lo, hi, lo_at, hi_at = state.get(k, (None,) * 5)
        refs = [target] if target > 0 else []
        if last is not None and last > 0 and not (last > target * 5 and last - target >= 50000):
            refs.append(last)
        ref = max(refs) if refs else None
        absurd = ref is not None and p > ref * 5 and p - ref >= 50000
        if not (absurd and lo is not None):
            if lo is None or p < lo:
                lo, lo_at = p, ts
            if hi is None or p > hi:
                hi, hi_at = p, ts
        state[k] = (p, lo, hi, lo_at, hi_at)
        out[(k, seq)] = (lo, hi, lo_at, hi_at)
    return out


Row = namedtuple("Row", "price target_price at notify_once_in_24h forced_sent")


def plain_alerts(rows):
    out, state = {}, {}
    for k, ts, seq, p, target, daily, forced in sorted(rows, key=lambda r: (r[1], r[2])):
        at = int(ts.replace(tzinfo=timezone.utc).timestamp()) * 1_000_000
        state[k], res = alerts.alert_step(state.get(k, (None, None, False)), Row(p, target, at, daily, forced))
        out[(k, seq)] = res
    return out


SMALL_BLOCKS = HistoryScan(["offer_key"], "observed_at", ["seq"], hot_min_rows=20, block_rows=15)


@pytest.mark.parametrize("scan", [None, SMALL_BLOCKS])
def test_price_bounds_equals_fold(spark, scan):
    rows = random_history(1, 900)
    got = history.price_bounds(spark.createDataFrame(rows, OBS), scan=scan).collect()
    want = plain_bounds(rows)
    assert len(got) == len(rows)
    for r in got:
        assert (r.min_price, r.max_price, r.min_price_at, r.max_price_at) == want[(r.offer_key, r.seq)]


def test_price_bounds_spike_with_state(spark):
    state = spark.createDataFrame(
        [("k", D("10448.99"), D("10448.99"), D("12398.40"), T0, T0, False)],
        "offer_key string, last_price decimal(18,4), min_price decimal(18,4), max_price decimal(18,4), "
        "min_price_at timestamp, max_price_at timestamp, was_below_target boolean")
    obs = spark.createDataFrame([("k", T0 + timedelta(hours=1), 1, D("3210448.99"), D(9500), True, False)], OBS)
    r = history.price_bounds(obs, state).first()
    assert (r.min_price, r.max_price, r.min_price_at) == (D("10448.99"), D("12398.40"), T0)


@pytest.mark.parametrize("seed,scan,minutes,prices", [
    (2, None, 400, (60, 160)), (3, SMALL_BLOCKS, 400, (60, 160)), (4, None, 90, (90, 99)), (5, SMALL_BLOCKS, 90, (90, 99))])
def test_alert_decisions_equal_fold(spark, seed, scan, minutes, prices):
    rows = random_history(seed, 900, minutes=minutes, prices=prices, spikes=False)
    decided = alerts.alert_decisions(spark.createDataFrame(rows, OBS), scan=scan)
    got = {(r.offer_key, r.seq): (r.sent, r.reason) for r in alerts.alert_reasons(decided, scan).collect()}
    want = plain_alerts(rows)
    assert len(got) == len(rows) and sum(s for s, _ in want.values()) > 30
    assert got == want


def test_alert_state_continues(spark):
    rows = sorted(random_history(7, 400, spikes=False), key=lambda r: (r[1], r[2]))
    cut = 200
    first, second = spark.createDataFrame(rows[:cut], OBS), spark.createDataFrame(rows[cut:], OBS)
    bounds = history.price_bounds(first)
    state = history.state_after(alerts.alert_decisions(bounds))
    got = {(r.offer_key, r.seq): r.sent for r in alerts.alert_decisions(second, state).collect()}
    want = plain_alerts(rows)
    assert got == {k: want[k][0] for k in got} and len(got) == 200
    both = {(r.offer_key, r.seq): (r.min_price, r.max_price) for r in history.price_bounds(second, state).collect()}
    plain = plain_bounds(rows)
    assert both == {k: plain[k][:2] for k in both}


@pytest.mark.parametrize("hot", [1_000_000, 20])
def test_spaced_pick(spark, hot):
    rnd = random.Random(11)
    rows, t = [], T0
    for seq in range(500):
        t += timedelta(minutes=rnd.choice([0, 5, 20, 30, 70]))
        rows.append(("a" if rnd.random() < 0.8 else "b", t, seq))
    df = spark.createDataFrame(rows, "k string, ts timestamp, seq bigint")
    got = {(r.k, r.seq): r.picked for r in fold.spaced_pick(df, ["k"], "ts", ["seq"], 3600, hot_min_rows=hot).collect()}
    last, want = {}, {}
    for k, ts, seq in rows:
        ok = k not in last or (ts - last[k]).total_seconds() >= 3600
        want[(k, seq)] = ok
        if ok:
            last[k] = ts
    assert got == want


def test_stock_return(spark):
    cycles = [("w", "bengurme", T0 + timedelta(hours=i), i, o) for i, o in enumerate(
        ["ok", "out_of_stock", "failed", "empty_search", "ok", "ok", "out_of_stock"])]
    cycles += [("v", "amazon", T0, 0, "out_of_stock"), ("v", "amazon", T0 + timedelta(hours=1), 1, "ok")]
    c = spark.createDataFrame(cycles, "watch_key string, site string, observed_at timestamp, seq bigint, outcome string")
    o = spark.createDataFrame([("w", 4, 0, "A", D(9), "u1"), ("w", 4, 1, "B", D(5), "u2"), ("w", 4, 2, "C", D(5), "u3"), ("v", 1, 0, "V", D(1), "u")],
                              "watch_key string, seq bigint, offer_pos int, title string, price decimal(18,4), url string")
    for hot in (None, 3):
        got = alerts.stock_return(c, o, hot_min_rows=hot).collect()
        assert [(r.watch_key, r.seq, r.title) for r in got] == [("w", 4, "B")]
    state = {r.watch_key: r for r in history.watch_state_after(
        c.withColumns({"reason": F.lit("x"), "status_code": F.lit(0)}),
        spark.createDataFrame([("v", 1, "k1"), ("w", 4, "k2")], "watch_key string, seq bigint, offer_key string")).collect()}
    assert state["w"].last_out_of_stock_at == T0 + timedelta(hours=6) and state["w"].offer_keys == []
    assert state["v"].last_out_of_stock_at == T0 and state["v"].offer_keys == ["k1"] and state["v"].last_missing_at is None


def test_missing_is_marked_only_with_an_alert_memory(spark):
    at = lambda h: T0 + timedelta(hours=h)
    outcomes = {"w": ["ok", "out_of_stock", "out_of_stock", "ok", "failed"], "v": ["out_of_stock", "ok"], "u": ["ok", "ok"]}
    rows = [(k, "bengurme", at(i), i, o, "x", 0) for k, all_ in outcomes.items() for i, o in enumerate(all_)]
    cycles = spark.createDataFrame(rows, "watch_key string, site string, observed_at timestamp, seq bigint, outcome string, reason string, status_code int")
    alerted = spark.createDataFrame([("w", at(0), 0), ("u", at(1), 1)], "watch_key string, observed_at timestamp, seq bigint")
    none = spark.createDataFrame([], "watch_key string, seq bigint, offer_key string")
    state = {r.watch_key: r for r in history.watch_state_after(cycles, none, alerted).collect()}
    assert {k: r.last_missing_at for k, r in state.items()} == {"w": at(1), "v": None, "u": None}
    assert {k: r.last_out_of_stock_at for k, r in state.items()} == {"w": None, "v": None, "u": None}
    elsewhere = {r.watch_key: r for r in history.watch_state_after(cycles, none, alerted, sites=[]).collect()}
    assert {k: r.last_out_of_stock_at for k, r in elsewhere.items()} == {"w": at(2), "v": at(0), "u": None}
    assert state["w"].last_error == "x" and state["v"].last_error is None


def test_reset_scope(spark):
    obs = spark.createDataFrame(
        [("w", "k", T0 + timedelta(hours=h), h, D(90), D(100), True) for h in (0, 2)],
        "watch_key string, offer_key string, observed_at timestamp, seq bigint, price decimal(18,4), target_price decimal(18,4), notify_once_in_24h boolean")
    gone = spark.createDataFrame([("w", T0 + timedelta(hours=1))], "watch_key string, missing_at timestamp")
    count = lambda scope: alerts.decisions_by_epoch(alerts.clear_alerts_after_missing(obs, gone, scope)).where("sent").count()
    assert (count("watch"), count("offer")) == (1, 2)
    kept = alerts.decisions_by_epoch(history.price_bounds(alerts.clear_alerts_after_missing(obs, gone, "offer"))).collect()
    assert {r.offer_key for r in kept} == {"k"} and all(r.min_price_at == T0 for r in kept)
