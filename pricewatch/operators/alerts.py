"""Which price and stock alerts are due.

A price alert is due when the price is at or under the target and
* nothing was alerted yet, or the price is lower than the last alerted one, or
* in daily mode: the last alert is at least 24 hours old, or
* otherwise: the row before was above the target.

The rule refers to its own earlier alerts, yet most of it needs no sequential loop. Some rows alert whatever
happened before them; they cut the history into independent segments. Inside a segment the last alerted price is
the running minimum, a window. In daily-mode segments that last 24 hours or longer without such a cut each row points to the one
that would alert next, had it alerted itself, and the chain of pointers is followed (`chains`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .. import fixed
from ..session import written
from .chains import chosen
from .history import KEYS, TIES, TIME, offer_scan
from .skew import HistoryScan, top_per_key

DAY_MICROS = fixed.DAY_SECONDS * 1_000_000


def alert_step(state, row):
    """The rule for one row: `step(state, row) -> (state, (sent, reason))`. Decide on the old state, then update.

    `state` is (last alerted price, last alerted microseconds, row before was at or under target).
    `row` has price, target_price, at (microseconds), notify_once_in_24h, forced_sent. Used by the streams.
    """
    last_price, last_at, was_below = state
    below = row.price <= row.target_price
    reason = "none"
    if row.forced_sent:
        reason = "forced"
    elif below:
        if last_price is None:
            reason = "first"
        elif row.price < last_price:
            reason = "lower"
        elif row.notify_once_in_24h:
            if last_at is not None and row.at - last_at >= DAY_MICROS:
                reason = "daily"
        elif not was_below:
            reason = "reentry"
    sent = reason not in ("none", "forced")
    if sent or reason == "forced":
        last_price, last_at = row.price, row.at
    return (last_price, last_at, below), (sent, reason)


def alert_decisions(obs: DataFrame, state: DataFrame | None = None, scan: HistoryScan | None = None) -> DataFrame:
    """Add `sent` to every observation.

    `obs`: offer_key, observed_at, seq (unique per offer), price, target_price, notify_once_in_24h and optionally
    forced_sent (a stock alert of the same check already told the user). `state`: what earlier runs left.
    """
    if "forced_sent" not in obs.columns:
        obs = obs.withColumn("forced_sent", F.lit(False))
    obs = obs.withColumn("forced_sent", F.coalesce("forced_sent", F.lit(False)))
    columns = obs.columns
    if state is not None:
        obs = obs.join(
            state.select(
                *KEYS,
                F.col("last_alerted_price").alias("_prior_price"),
                F.unix_micros("last_alerted_at").alias("_prior_at"),
                F.col("was_below_target").alias("_prior_below"),
            ),
            KEYS,
            "left",
        )
    money = obs.schema["price"].dataType
    price, daily, forced = F.col("price"), F.col("notify_once_in_24h"), F.col("forced_sent")
    at, below, cut = F.col("_at"), F.col("_below"), F.col("_cut")

    def build(rows: DataFrame, scan: HistoryScan) -> DataFrame:
        if state is None:
            rows = rows.withColumns(
                {
                    "_prior_price": F.lit(None).cast(money),
                    "_prior_at": F.lit(None).cast("bigint"),
                    "_prior_below": F.lit(False),
                }
            )
        rows = rows.withColumns({"_below": price <= F.col("target_price"), "_at": F.unix_micros(F.col(TIME))})
        told = below | forced  # only these rows can set the alert memory
        rows = scan.add(
            rows,
            {
                "_was_below": ("last", below),
                "_told_at": ("last", F.when(told, at)),
                "_told_min": ("min", F.when(told, price)),
            },
            include_current=False,
        )
        was_below = F.coalesce("_was_below", "_prior_below", F.lit(False))
        told_at = F.greatest(F.col("_told_at"), F.col("_prior_at"))
        told_min = F.least(F.col("_told_min"), F.col("_prior_price"))
        # Rows that alert, or are recorded as alerted, whatever came before them.
        stale = daily & (at - told_at >= DAY_MICROS)
        sure = below & (told_min.isNull() | (price < told_min) | stale | (~daily & ~was_below))
        rows = rows.withColumn("_cut", forced | F.coalesce(sure, F.lit(False)))
        rows = scan.add(
            rows,
            {
                "_segment": ("sum", cut.cast("bigint")),
                "_cut_at": ("last", F.when(cut, at)),
                "_cut_price": ("last", F.when(cut, price)),
            },
            include_current=True,
        )
        rows = rows.withColumns(
            {"_cut_at": F.coalesce("_cut_at", "_prior_at"), "_cut_price": F.coalesce("_cut_price", "_prior_price")}
        )
        rows = scan.add(rows, {"_low": ("min", F.when(told, price))}, include_current=False, extra_keys=["_segment"])
        memory = F.least(F.col("_low"), F.col("_cut_price"))
        rows = rows.withColumn("_lower", below & F.coalesce(price < memory, F.lit(False)))
        # Segments in which a day passes after the cut although no gap is that long need the sequential rule.
        due = daily & below & ~cut & F.coalesce(at - F.col("_cut_at") >= DAY_MICROS, F.lit(False))
        rows = scan.any_in(rows, "_due", due, ["_segment"])
        # Of the rows at one moment only strictly falling prices can alert; the others need not enter the fold.
        # One running value for each mode, so that this window needs no other order than those before and after it.
        moment = Window.partitionBy(*KEYS, "_segment", TIME).orderBy(*TIES).rowsBetween(Window.unboundedPreceding, -1)
        modes = [daily, ~daily, daily.isNull()]
        seen = F.coalesce(*[F.when(mode, F.min(F.when(told & mode, price)).over(moment)) for mode in modes])
        can_alert = told & (seen.isNull() | (price < seen) | cut)
        # what is left out of `can_alert` never alerts, and changes nothing
        rows = rows.withColumn("_fold", F.col("_due") & can_alert)
        rows = scan.add(rows, {"_rank": ("sum", F.col("_fold").cast("bigint"))}, True, ["_segment"])
        rows = written(rows.select(*columns, "_segment", "_at", "_cut", "_cut_at", "_cut_price", "_lower", "_fold", "_rank"))
        simple = rows.where(~F.col("_fold")).withColumn("sent", ~forced & (cut | F.col("_lower")))
        dense = rows.where("_fold")
        if dense.isEmpty():
            return simple.select(*columns, "sent")
        return simple.select(*columns, "sent").unionByName(_dense_segments(dense).select(*columns, "sent"))

    return (scan or offer_scan()).apply(obs, build)


def _dense_segments(rows: DataFrame) -> DataFrame:
    """Add `sent` to rows that can all set the alert memory. After a row that alerted, the first lower price alerts, or the first
    daily row a day later."""
    at, price = F.col("_at"), F.col("price")
    rows = rows.withColumns({
        "_k": F.struct(*KEYS, "_segment"), "_price": price, "_late": F.when(F.col("notify_once_in_24h"), -at),
        "_less": price, "_day": 1 - at - DAY_MICROS})
    # the first segment of an offer has no row that cuts: its memory is that of the state
    memory = rows.groupBy("_k").agg(F.max("_cut").alias("c"), F.max("_cut_price").alias("p"), F.max("_cut_at").alias("t")).where("not c")
    roots = memory.select("_k", F.lit(0).cast("long").alias("_rank"), F.col("p").cast(rows.schema["price"].dataType).alias("_less"),
                          (1 - F.col("t") - DAY_MICROS).alias("_day"))
    told = chosen(rows, [("_price", "_less"), ("_late", "_day")], F.col("_cut"), roots)
    return told.withColumn("sent", F.col("_on") & ~F.col("forced_sent"))


def alert_reasons(decided: DataFrame, scan: HistoryScan | None = None) -> DataFrame:
    """Name why each alert of `alert_decisions` was sent: first, lower, daily, reentry, forced or none."""
    price, forced = F.col("price"), F.col("forced_sent")

    def build(rows: DataFrame, scan: HistoryScan) -> DataFrame:
        rows = scan.add(
            rows, {"_last_alert": ("last", F.when(F.col("sent") | forced, price))}, include_current=False
        )
        reason = (
            F.when(forced, F.lit("forced"))
            .when(~F.col("sent"), F.lit("none"))
            .when(F.col("_last_alert").isNull(), F.lit("first"))
            .when(price < F.col("_last_alert"), F.lit("lower"))
            .when(F.col("notify_once_in_24h"), F.lit("daily"))
            .otherwise(F.lit("reentry"))
        )
        return rows.withColumn("reason", reason).drop("_last_alert")

    return (scan or offer_scan()).apply(decided, build)


def stock_return(cycles: DataFrame, offers: DataFrame, sites: list[str] | None = None,
                 hot_min_rows: int | None = None) -> DataFrame:
    """First success of a watch after it was out of stock: one stock alert on the cheapest offer of that check.

    `cycles`: watch_key, site, observed_at, seq, outcome. `offers`: watch_key, seq, offer_pos, title, price, url.
    Failures and empty searches in between do not clear the memory. Only the configured sites take part.
    """
    wanted = fixed.STOCK_RETURN_SITES if sites is None else sites
    options = {} if hot_min_rows is None else {"hot_min_rows": hot_min_rows}
    scan = HistoryScan(["watch_key"], "observed_at", ["seq"], **options)
    known = F.when(F.col("outcome").isin("ok", "out_of_stock"), F.col("outcome"))

    def build(rows: DataFrame, scan: HistoryScan) -> DataFrame:
        return scan.add(rows, {"_before": ("last", known)}, include_current=False)

    back = scan.apply(cycles.where(F.col("site").isin(wanted)), build).where(
        (F.col("outcome") == "ok") & (F.col("_before") == "out_of_stock")
    ).drop("_before")
    cheapest = top_per_key(offers, ["watch_key", "seq"], [F.col("price"), F.col("offer_pos")])
    return back.join(cheapest.drop("offer_pos"), ["watch_key", "seq"])


def mark_forced(obs: DataFrame, returns: DataFrame) -> DataFrame:
    """Observations of a check with a stock alert: their price alert is suppressed and recorded as sent."""
    marks = returns.select("watch_key", "seq", F.lit(True).alias("_back"))
    return obs.join(marks, ["watch_key", "seq"], "left").withColumn(
        "forced_sent", F.coalesce("_back", F.lit(False))
    ).drop("_back")


def clear_alerts_after_missing(obs: DataFrame, missing: DataFrame, reset_scope: str = "watch") -> DataFrame:
    """Effect of a vanished item or price on the alert memory: an `epoch` of each observation, for `decisions_by_epoch`.

    With scope `watch` (the default) only the watch entry is cleared; offer entries keep their memory, so an item
    that returns at the same price is not alerted again before the usual rules say so: the epoch is 0. With scope `offer`
    the memory of the offers restarts at every disappearance: the epoch counts the disappearances up to an observation.
    Offer keys, and so the price bounds, stay as they are. `missing`: watch_key, missing_at.
    """
    if reset_scope == "watch":
        return obs.withColumn("epoch", F.lit(0).cast("bigint"))
    # a disappearance comes before the observations of its moment
    marks = missing.select("watch_key", F.col("missing_at").alias(TIME), F.lit(1).alias("_gone"))
    both = obs.withColumn("_gone", F.lit(0)).unionByName(marks, allowMissingColumns=True)
    both = both.withColumn("_order", F.lit(1) - F.col("_gone"))
    scan = HistoryScan(["watch_key"], TIME, ["_order", "seq"])
    counted = scan.apply(both, lambda r, s: s.add(r, {"epoch": ("sum", F.col("_gone").cast("bigint"))}, True))
    return counted.where("_gone = 0").drop("_gone", "_order")


def decisions_by_epoch(obs: DataFrame, state: DataFrame | None = None, **options) -> DataFrame:
    """`alert_decisions` whose memory restarts with each epoch of an offer; the memory in `state` belongs to epoch 0."""
    own = F.when(F.col("epoch") == 0, F.col("offer_key").cast("string")).otherwise(F.concat_ws("#", "offer_key", "epoch"))
    keyed = obs.withColumns({"_offer_key": F.col("offer_key"), "offer_key": own})
    if state is not None:
        state = state.withColumn("offer_key", F.col("offer_key").cast("string"))
    return alert_decisions(keyed, state, **options).withColumn("offer_key", F.col("_offer_key")).drop("_offer_key")
