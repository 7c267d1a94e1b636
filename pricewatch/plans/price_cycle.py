"""One price cycle over tables: watches and offers in; alerts, state and summary out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.urls import condition, site_label
from ..operators import alerts, history, matching, offers, summary


@dataclass
class Cycle:
    decided: DataFrame
    state: DataFrame
    rows: DataFrame


def run_cycle(watches: DataFrame, page_offers: DataFrame, offer_state: DataFrame, watch_state: DataFrame, as_of: Column) -> Cycle:
    """Due watches take the offers of their pages; the others contribute their cached rows.

    `watches`: output of `valid_watches` with watch_key. `page_offers`: page_url, site, seq, title, price, url,
    is_warehouse.
    """
    judged = offers.due_watches(watches, watch_state, as_of)
    due = judged.where("due")
    routed = offers.offers_for_watches(due, page_offers)
    kept = matching.exclude_offers(routed)
    keyed = kept.withColumns(
        {
            "offer_key": offers.offer_join_key(
                F.col("site"), F.coalesce(F.nullif("tracking_id", F.lit("")), F.col("name")), F.col("url"), F.col("size"),
                condition(F.col("is_warehouse")),
            ),
            "observed_at": as_of,
            "seller": site_label(F.col("site")),
            "product_title": F.coalesce(F.nullif("title", F.lit("")), F.nullif("name", F.lit("")), F.col("watch_url")),
            "product_url": F.col("url"),
        }
    )
    bounded = history.price_bounds(keyed, offer_state)
    decided = alerts.alert_decisions(bounded, offer_state)
    fresh = offers.with_group(decided)
    columns = ["seller", "product_title", "product_url", "price", "target_price", "min_price", "max_price", "search_group",
               "search_group_label", "is_warehouse", "tracking_id"]
    not_due = judged.where("not due").drop("due", "last_checked_at").withColumn("seller", site_label(F.col("site")))
    cached = offers.carry_not_due(not_due, watch_state, offer_state)
    rows = fresh.select(*columns, F.col("seq").cast("bigint").alias("seq")).unionByName(
        cached.select(*columns, F.lit(1 << 60).alias("seq"))
    )
    return Cycle(decided, history.state_after(decided), summary.with_difference(offers.dedup_offers(rows)))


def inspect(page_offers: DataFrame, watch_row: DataFrame) -> DataFrame:
    """Offers of a page under a temporary rule: filters only, no state and no alerts."""
    return matching.exclude_offers(offers.offers_for_watches(watch_row, page_offers))
