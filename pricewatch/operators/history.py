"""Price history per offer: running bounds with a spike guard, and the state that remains after the last row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed
from .skew import HistoryScan, top_per_key

KEYS = ["offer_key"]
TIME = "observed_at"
TIES = ["seq"]


def offer_scan(**options) -> HistoryScan:
    return HistoryScan(KEYS, TIME, TIES, **options)


def is_spike(price: Column, target: Column, last_price: Column) -> Column:
    """Price more than 5 times, and at least 50,000 above, the larger of target and last price.

    A last price that is itself such a spike over the target does not count as a reference.
    """
    ratio, amount = F.lit(fixed.SPIKE_RATIO), F.lit(fixed.SPIKE_AMOUNT)
    usable_target = F.when(target > 0, target)
    last_ok = (last_price > 0) & (target.isNull() | ~((last_price > target * ratio) & (last_price - target >= amount)))
    ref = F.greatest(usable_target, F.when(last_ok, last_price))
    return F.coalesce((price > ref * ratio) & (price - ref >= amount), F.lit(False))


def price_bounds(obs: DataFrame, state: DataFrame | None = None, scan: HistoryScan | None = None) -> DataFrame:
    """Add min_price, max_price, min_price_at, max_price_at, last_price (of the row before), was_below, is_absurd.

    Spikes do not move the bounds unless no bounds exist yet. `state` holds what earlier runs left per offer.
    One shuffle on the offer key serves all running values.
    """
    prior = ["last_price", "min_price", "max_price", "min_price_at", "max_price_at", "was_below_target"]
    if state is not None:
        obs = obs.join(state.select(*KEYS, *[F.col(c).alias(f"_prior_{c}") for c in prior]), KEYS, "left")

    def build(rows: DataFrame, scan: HistoryScan) -> DataFrame:
        if state is None:
            rows = rows.withColumns({f"_prior_{c}": F.lit(None).cast(_prior_type(obs, c)) for c in prior})
        below = F.col("price") <= F.col("target_price")
        rows = scan.add(
            rows, {"last_price": ("last", F.col("price")), "was_below": ("last", below)}, include_current=False
        )
        rows = rows.withColumns(
            {
                "_first": F.col("last_price").isNull() & F.col("_prior_min_price").isNull(),
                "last_price": F.coalesce("last_price", "_prior_last_price"),
                "was_below": F.coalesce("was_below", "_prior_was_below_target", F.lit(False)),
            }
        )
        rows = rows.withColumn("is_absurd", is_spike(F.col("price"), F.col("target_price"), F.col("last_price")))
        counts = F.col("_first") | ~F.col("is_absurd")
        position = [F.col(c) for c in scan.order]
        low = F.when(counts, F.struct(F.col("price").alias("p"), *position))
        high = F.when(counts, F.struct((-F.col("price")).alias("p"), *position))
        rows = scan.add(rows, {"_low": ("min", low), "_high": ("min", high)}, include_current=True)
        old_low = F.coalesce(F.col("_prior_min_price") <= F.col("_low.p"), F.col("_low").isNull())
        old_high = F.coalesce(F.col("_prior_max_price") >= -F.col("_high.p"), F.col("_high").isNull())
        money = obs.schema["price"].dataType
        return rows.withColumns(
            {
                "min_price": F.when(old_low, F.col("_prior_min_price")).otherwise(F.col("_low.p")),
                "min_price_at": F.when(old_low, F.col("_prior_min_price_at")).otherwise(F.col(f"_low.{TIME}")),
                "max_price": F.when(old_high, F.col("_prior_max_price")).otherwise((-F.col("_high.p")).cast(money)),
                "max_price_at": F.when(old_high, F.col("_prior_max_price_at")).otherwise(F.col(f"_high.{TIME}")),
            }
        ).drop("_first", "_low", "_high", *[f"_prior_{c}" for c in prior])

    return (scan or offer_scan()).apply(obs, build)


def _prior_type(obs: DataFrame, column: str) -> str:
    if column.endswith("_at"):
        return "timestamp"
    return "boolean" if column == "was_below_target" else obs.schema["price"].dataType.simpleString()


def latest(obs: DataFrame) -> DataFrame:
    """Last row of every offer."""
    return top_per_key(obs, KEYS, [F.col(TIME).desc(), *[F.col(t).desc() for t in TIES]])


def current_offers(obs: DataFrame) -> DataFrame:
    """Last row of every offer with its bounds over the whole history."""
    return latest(price_bounds(obs))


def state_after(decided: DataFrame) -> DataFrame:
    """State row of every offer after the last observation, from the output of `alert_decisions` over `price_bounds`.

    Only successful observations touch offer state.
    """
    last = latest(decided)
    alerts = decided.where(F.col("sent") | F.coalesce(F.col("forced_sent"), F.lit(False))).groupBy(*KEYS).agg(
        F.max(F.struct(F.col(TIME), *[F.col(t) for t in TIES], F.col("price"))).alias("a")
    )
    return last.join(alerts, KEYS, "left").select(
        *KEYS,
        F.col("price").alias("last_price"),
        "min_price",
        "max_price",
        "min_price_at",
        "max_price_at",
        F.col(TIME).alias("last_checked_at"),
        (F.col("price") <= F.col("target_price")).alias("was_below_target"),
        F.col("a.price").alias("last_alerted_price"),
        F.col(f"a.{TIME}").alias("last_alerted_at"),
    )


def watch_state_after(cycles: DataFrame, offers: DataFrame, alerts: DataFrame | None = None, sites: list[str] | None = None) -> DataFrame:
    """Watch state after its last check: error fields, last time out of stock, keys of the offers of that check.

    `cycles`: watch_key, site, observed_at, seq, outcome, reason, status_code. `offers`: watch_key, seq, offer_key.
    `alerts`: watch_key, observed_at, seq of checks that left an alert memory in the watch entry.
    On the sites with stock alerts (see `stock_return`) a success clears the out-of-stock memory; on all others it stays.
    Failures and empty searches keep it. `last_missing_at` is the last check at which the item or its price vanished while
    the entry held an alert memory; vanishing clears that memory, so a second one in a row leaves no mark.
    """
    from ..functions.checks import missing_price_error

    keys = ["watch_key"]
    wanted = fixed.STOCK_RETURN_SITES if sites is None else sites
    pos = F.struct("observed_at", "seq")
    missing = (F.col("outcome") == "out_of_stock") | (
        (F.col("outcome") == "failed") & missing_price_error(F.col("reason"))
    )
    state = cycles.groupBy(*keys).agg(
        F.max(F.struct("observed_at", "seq", "outcome", "reason", "status_code", "site")).alias("last"),
        F.max(F.when(F.col("outcome") == "out_of_stock", pos)).alias("oos"),
        F.max(F.when(F.col("outcome") == "ok", pos)).alias("ok"),
    )
    failed = F.col("last.outcome") == "failed"
    kept = ~F.col("last.site").isin(wanted) | F.col("ok").isNull() | (F.col("oos") > F.col("ok"))
    state = state.select(
        *keys,
        F.col("last.seq").alias("seq"),
        F.col("last.observed_at").alias("last_checked_at"),
        F.col("last.outcome").alias("last_outcome"),
        F.when(failed, F.col("last.reason")).alias("last_error"),
        F.when(failed, F.col("last.status_code")).alias("last_error_status"),
        F.when(F.coalesce(kept, F.lit(True)), F.col("oos.observed_at")).alias("last_out_of_stock_at"),
    )
    if alerts is None:
        state = state.withColumn("last_missing_at", F.lit(None).cast("timestamp"))
    else:
        marks = cycles.where(missing).select(*keys, "observed_at", "seq", F.lit("missing").alias("kind")).union(
            alerts.select(*keys, "observed_at", "seq", F.lit("alert")))
        scan = HistoryScan(keys, "observed_at", ["seq"])
        after = scan.apply(marks, lambda r, s: s.add(r, {"_before": ("last", F.col("kind"))}, include_current=False))
        stamped = after.where("kind = 'missing' and _before = 'alert'").groupBy(*keys).agg(F.max("observed_at").alias("last_missing_at"))
        state = state.join(stamped, keys, "left")
    # The offers of one check of one watch are at most the scan limit, so this list is bounded.
    keys_of_check = offers.groupBy("watch_key", "seq").agg(F.sort_array(F.collect_set("offer_key")).alias("offer_keys"))
    return state.join(keys_of_check, ["watch_key", "seq"], "left").withColumn(
        "offer_keys", F.coalesce("offer_keys", F.array().cast("array<string>"))
    ).drop("seq")
