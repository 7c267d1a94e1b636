"""Rewrites of the keyed state tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed
from .health import recent_errors

HISTORY_FIELDS = ["min_price", "max_price", "min_price_at", "max_price_at"]
ALERT_FIELDS = ["last_alerted_price", "last_alerted_at"]


def _cleared(df: DataFrame, columns: list[str]) -> DataFrame:
    types = {f.name: f.dataType for f in df.schema.fields}
    return df.withColumns({c: F.lit(None).cast(types[c]) for c in columns})


def reset_price_history(state: DataFrame, summary: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Forget all bounds. Returns the state, the summary with its range set to the price, and the cleared fields."""
    filled = sum((F.col(c).isNotNull().cast("bigint") for c in HISTORY_FIELDS), F.lit(0).cast("bigint"))
    count = state.agg(F.coalesce(F.sum(filled), F.lit(0)).alias("cleared"))
    rows = summary.withColumns({"min_price": F.col("price"), "max_price": F.col("price")})
    return _cleared(state, HISTORY_FIELDS), rows, count


def reset_alert_memory(state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Forget sent alerts and make every watch due. Returns the state and the number of changed rows."""
    fields = [*ALERT_FIELDS, "last_checked_at"]
    changed = F.coalesce(*[F.when(F.col(c).isNotNull(), F.lit(True)) for c in fields], F.lit(False))
    return _cleared(state, fields), state.agg(F.count_if(changed).alias("changed"))


def without_keys(watch_state: DataFrame, removed: DataFrame) -> DataFrame:
    """Watch state whose offer_keys no longer name the removed offers."""
    kept = (
        watch_state.select("watch_key", F.posexplode("offer_keys").alias("pos", "offer_key"))
        .join(removed.select("offer_key").distinct(), ["offer_key"], "left_anti")
        # At most the scan limit of one check per watch.
        .groupBy("watch_key")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "offer_key")))["offer_key"].alias("_kept"))
    )
    return watch_state.join(kept, ["watch_key"], "left").withColumn(
        "offer_keys", F.coalesce("_kept", F.array().cast("array<string>"))
    ).drop("_kept")


def purge_condition(offer_state: DataFrame, watch_state: DataFrame, summary: DataFrame, version: int,
                    site: str = "amazon", seller: str = "Amazon") -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Versioned removal of cached used-condition offers of one site.

    Returns offer state, watch state, summary and the number of removed offers; nothing changes when `version`
    says that the purge already ran.
    """
    if version >= fixed.PURGE_VERSION:
        return offer_state, watch_state, summary, offer_state.limit(0).agg(F.count(F.lit(1)).alias("removed"))
    used = (F.col("site") == site) & F.coalesce("is_warehouse", F.lit(False))
    gone = offer_state.where(used)
    rows = summary.where(~((F.col("seller") == seller) & F.coalesce("is_warehouse", F.lit(False))))
    return (
        offer_state.where(~F.coalesce(used, F.lit(False))),
        without_keys(watch_state, gone),
        rows,
        gone.agg(F.count(F.lit(1)).alias("removed")),
    )


def apply_watch_changes(cards: DataFrame, changes: DataFrame) -> DataFrame:
    """Apply add, update and delete rows to the cards.

    `changes`: op, card_pos (target of update and delete, order of adds) and the card columns. Unset options of an
    update keep the card's value. Added cards follow the last existing one.
    """
    options = [c for c in cards.columns if c != "card_pos"]
    edits = changes.where("op in ('update', 'delete')").select(
        "card_pos", "op", *[F.col(c).alias(f"_new_{c}") for c in options]
    )
    kept = (
        cards.join(edits, ["card_pos"], "left")
        .where("op is null or op = 'update'")
        .select("card_pos", *[F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) for c in options])
    )
    last = cards.agg(F.coalesce(F.max("card_pos"), F.lit(-1)).alias("n")).scalar()
    adds = changes.where("op = 'add'").select((F.col("card_pos") + last + 1).cast("int").alias("card_pos"), *options)
    return kept.withColumn("card_pos", F.col("card_pos").cast("int")).unionByName(adds)


def prune_expired(df: DataFrame, as_of: Column, time: str = "created_at", hours: int = 24) -> DataFrame:
    return recent_errors(df, as_of, time, hours)
