"""Offers: routing to watches, deduplication with tie rules, enrichment, and the cheapest of several sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed
from ..functions.labels import variant_group_label
from ..functions.text import fold_text, item_key, strip, text_or_empty
from ..functions.urls import canonical_url, condition, offer_identity
from .history import is_spike
from .skew import salted_join, top_per_key


# --- keys -------------------------------------------------------------------
def money_text(c: Column) -> Column:
    """Shortest decimal text of an amount."""
    return F.regexp_replace(c.cast("decimal(18,4)").cast("string"), r"\.?0+$", "")


def watch_key(site: Column, owner: Column, url: Column, size: Column) -> Column:
    return item_key(F.lit("watch"), site, owner, url, size)


def offer_key(site: Column, owner: Column, url: Column, size: Column, is_used: Column) -> Column:
    return item_key(F.lit("watch_offer"), site, owner, url, size, condition(is_used))


def offer_join_key(*parts: Column) -> Column:
    """Physical key of the same parts: a hash that different parts cannot share in practice."""
    return F.sha2(F.concat_ws("\x1f", *[text_or_empty(p) for p in parts]), 256)


def search_group(site: Column, tracking_id: Column, name: Column, url: Column, target: Column) -> Column:
    owner = F.coalesce(F.nullif(tracking_id, F.lit("")), F.nullif(name, F.lit("")), url)
    return item_key(F.lit("watch_result_group"), site, owner, money_text(target))


# --- joins ------------------------------------------------------------------
def offers_for_watches(watches: DataFrame, offers: DataFrame, hot_min_rows: int = 1_000_000) -> DataFrame:
    """Route every offer to the watches of its page: inner join on site and canonical page URL.

    A link is brought to its canonical form once, not for each of its offers, and offers are joined by the link as it is written. A link
    that many offers come from is a hot key of the offer side and is salted.
    """
    w = watches.withColumn("_page", canonical_url(F.col("url"))).withColumnRenamed("url", "watch_url")
    o = offers.withColumn("_link", text_or_empty(F.col("page_url")))
    links = o.select("site", "_link").distinct().withColumn("_page", canonical_url(F.col("_link")))
    found = links.join(w, ["site", "_page"]).drop("_page")
    return salted_join(o, found, ["site", "_link"], "inner", F.col("seq"), hot_min_rows=hot_min_rows).drop("_link")


def with_offer_state(offers: DataFrame, state: DataFrame) -> DataFrame:
    return offers.join(state, ["offer_key"], "left")


def with_watch_state(watches: DataFrame, state: DataFrame) -> DataFrame:
    return watches.join(state, ["watch_key"], "left")


def due_watches(watches: DataFrame, state: DataFrame, as_of: Column,
                global_seconds: int = fixed.DEFAULT_INTERVAL_SECONDS) -> DataFrame:
    """Add `due`: never checked, or the watch's own interval (minutes), else the global one, has passed."""
    minutes = F.col("check_interval_minutes")
    wait = F.when(minutes > 0, minutes * 60).otherwise(F.lit(global_seconds))
    elapsed = (F.unix_micros(as_of) - F.unix_micros("last_checked_at")) / F.lit(1_000_000)
    known = state.select("watch_key", "last_checked_at")
    return watches.join(known, ["watch_key"], "left").withColumn(
        "due", F.col("last_checked_at").isNull() | (elapsed >= wait)
    )


def carry_not_due(watches: DataFrame, watch_state: DataFrame, offer_state: DataFrame) -> DataFrame:
    """Cached summary rows of watches that are not due: the offers of their last check, else their own entry."""
    cached = (
        watches.join(watch_state.select("watch_key", "offer_keys"), ["watch_key"], "left")
        .withColumn(
            "offer_key",
            F.explode(
                F.when(F.coalesce(F.size("offer_keys"), F.lit(0)) > 0, F.col("offer_keys")).otherwise(
                    F.array(F.col("watch_key"))
                )
            ),
        )
        .drop("offer_keys")
    )
    s = offer_state.select(
        "offer_key",
        F.col("last_price").alias("price"),
        F.col("min_price").alias("_min"),
        F.col("max_price").alias("_max"),
        F.col("title").alias("_title"),
        F.col("url").alias("_url"),
        F.col("is_warehouse").alias("_used"),
    )
    rows = cached.join(s, ["offer_key"]).where(F.col("price").isNotNull())
    spike = is_spike(F.col("price"), F.col("target_price"), F.col("price")) & F.col("_min").isNotNull() & F.col(
        "_max"
    ).isNotNull()
    title = F.coalesce(F.nullif("_title", F.lit("")), F.nullif("name", F.lit("")), F.col("url"))
    label = F.coalesce(F.nullif(strip(text_or_empty(F.col("name"))), F.lit("")), title)
    return rows.select(
        "watch_key",
        "offer_key",
        F.col("seller"),
        title.alias("product_title"),
        F.coalesce(F.nullif("_url", F.lit("")), F.col("url")).alias("product_url"),
        "price",
        "target_price",
        F.when(spike, F.col("_min")).otherwise(F.least("_min", "price")).alias("min_price"),
        F.when(spike, F.col("_max")).otherwise(F.greatest("_max", "price")).alias("max_price"),
        search_group(F.col("site"), F.col("tracking_id"), F.col("name"), F.col("url"), F.col("target_price")).alias(
            "search_group"
        ),
        label.alias("search_group_label"),
        F.coalesce("_used", F.lit(False)).alias("is_warehouse"),
        "tracking_id",
    )


def last_value_by(pairs: DataFrame, key: str, value: str, ordinal: str) -> DataFrame:
    """Lookup table in which the last non-empty value of a key wins (sellers or variant labels by product code)."""
    filled = pairs.where((text_or_empty(F.col(key)) != "") & (text_or_empty(F.col(value)) != ""))
    return filled.groupBy(F.upper(key).alias(key)).agg(F.max_by(value, ordinal).alias(value))


def enrich_cards(cards: DataFrame, details: DataFrame, depot_search: bool = False) -> DataFrame:
    """Complete search cards with what their product pages say.

    `cards`: card_pos, title, url, price (may be null), is_warehouse, matches. `details`: card_url, detail_pos,
    title, url, price, is_warehouse, stock_quantity; a failed page has no rows. A priced card stays and takes the
    low-stock count and the used offers of its page; an unpriced card takes every offer of its page. The card's
    title wins. In a used-goods search only used cards count and pages add nothing.
    """
    stock = F.lit(None).cast("int").alias("stock_quantity")

    def out(df, title, url, price, used, qty, kind, pos):
        return df.select(
            F.col("card_pos"), F.lit(kind).alias("kind"), pos.cast("int").alias("detail_pos"), title.alias("title"),
            url.alias("url"), price.alias("price"), used.alias("is_warehouse"), qty.alias("stock_quantity"),
        )

    c = {n: F.col(n) for n in ("title", "url", "price", "is_warehouse")}
    priced = cards.where(F.col("price").isNotNull())
    if depot_search:
        own = priced.where("is_warehouse")
        return out(own, c["title"], c["url"], c["price"], c["is_warehouse"], stock, 0, F.lit(0))
    own = out(priced.where("not is_warehouse"), c["title"], c["url"], c["price"], c["is_warehouse"], stock, 0, F.lit(0))
    wanted = cards.where("matches").select(
        "card_pos", F.col("url").alias("card_url"), F.col("title").alias("card_title"), F.col("price").alias("card_price"),
        F.col("is_warehouse").alias("card_used"),
    )
    found = wanted.join(details, ["card_url"])
    title = F.coalesce(F.nullif("card_title", F.lit("")), F.col("title"))
    url = F.coalesce(F.nullif("url", F.lit("")), F.col("card_url"))
    d = {n: F.col(n) for n in ("price", "is_warehouse", "stock_quantity", "detail_pos")}
    with_price = found.where(F.col("card_price").isNotNull())
    counted = top_per_key(
        with_price.where("not is_warehouse and stock_quantity is not null"), ["card_pos"], [F.col("detail_pos")]
    )
    low_stock = out(counted, F.col("card_title"), F.col("card_url"), F.col("card_price"), F.lit(False),
                    d["stock_quantity"], 1, d["detail_pos"])
    used = out(with_price.where("is_warehouse"), title, url, d["price"], d["is_warehouse"], d["stock_quantity"], 2,
               d["detail_pos"])
    whole = out(found.where(F.col("card_price").isNull()), title, url, d["price"], d["is_warehouse"],
                d["stock_quantity"], 3, d["detail_pos"])
    return own.unionByName(low_stock).unionByName(used).unionByName(whole)


def with_size_summary(pages: DataFrame, sizes: DataFrame) -> DataFrame:
    """Attach the separate size records of a product by its id; products without records stay."""
    return pages.join(sizes, ["product_id"], "left")


def lower_of(embedded: DataFrame, visible: DataFrame, keys: list[str]) -> DataFrame:
    """Per variant the cheaper of two sources, the first on a tie; `outcome` is failed when neither has a price."""
    e = embedded.select(*keys, F.struct("price", "title", "seller").alias("_e"))
    v = visible.select(*keys, F.struct("price", "title", "seller").alias("_v"))
    both = e.join(v, keys, "full")
    second = F.col("_v.price").isNotNull() & (F.col("_e.price").isNull() | (F.col("_v.price") < F.col("_e.price")))
    best = F.when(second, F.col("_v")).otherwise(F.col("_e"))
    return both.select(
        *keys,
        best["price"].alias("price"),
        best["title"].alias("title"),
        best["seller"].alias("seller"),
        F.when(best["price"].isNull(), F.lit("failed")).otherwise(F.lit("ok")).alias("outcome"),
    )


def page_outcome(variants: DataFrame, page: str = "page_id") -> DataFrame:
    """A page fails only when all its variants failed."""
    ok = F.max((F.col("outcome") == "ok").cast("int")) == 1
    return variants.groupBy(page).agg(F.when(ok, F.lit("ok")).otherwise(F.lit("failed")).alias("outcome"))


# --- deduplication ----------------------------------------------------------
def dedup_offers(rows: DataFrame) -> DataFrame:
    """Cheapest row per card and offer identity, the earliest on a tie; rows without a link are never merged."""
    ident = offer_identity(F.col("product_url"), F.col("is_warehouse"))
    keyed = rows.withColumns(
        {"_ident": ident, "_card": text_or_empty(F.col("tracking_id")), "_own": F.when(ident == "", F.col("seq"))}
    )
    return top_per_key(keyed, ["_card", "_ident", "_own"], [F.col("price"), F.col("seq")]).drop("_ident", "_card", "_own")


def dedup_results(rows: DataFrame) -> DataFrame:
    """Cheapest row per link and condition; on a tie one with a known stock count, then the earliest."""
    return top_per_key(rows, ["url", "is_warehouse"],
                       [F.col("price"), F.col("stock_quantity").isNull(), F.col("seq")])


def dedup_candidates(rows: DataFrame) -> DataFrame:
    """Cheapest candidate per identity, else link, else folded title. Sort by price and seq where the order is shown."""
    key = F.coalesce(F.nullif("identity", F.lit("")), F.nullif("url", F.lit("")), fold_text(F.col("title")))
    return top_per_key(rows.withColumn("_key", key), ["_key"], [F.col("price"), F.col("seq")]).drop("_key")


def dedup_by_difference(rows: DataFrame) -> DataFrame:
    """Row with the smallest signed difference per card and offer identity."""
    ident = offer_identity(F.col("product_url"), F.col("is_warehouse"))
    keyed = rows.withColumns(
        {"_ident": ident, "_card": strip(text_or_empty(F.col("tracking_id"))), "_own": F.when(ident == "", F.col("seq"))}
    )
    return top_per_key(keyed, ["_card", "_ident", "_own"], [F.col("difference"), F.col("seq")]).drop(
        "_ident", "_card", "_own"
    )


def dedup_variants(rows: DataFrame) -> DataFrame:
    """First row per folded variant, seller, price and folded title."""
    keyed = rows.withColumns(
        {
            "_v": fold_text(text_or_empty(F.col("variant"))),
            "_s": fold_text(text_or_empty(F.col("seller"))),
            "_t": fold_text(text_or_empty(F.col("title"))),
        }
    )
    return top_per_key(keyed, ["_v", "_s", "price", "_t"], [F.col("seq")]).drop("_v", "_s", "_t")


def best_offer(offers: DataFrame, keys: list[str]) -> DataFrame:
    """Cheapest offer per key, the earliest on a tie."""
    return top_per_key(offers, keys, [F.col("price"), F.col("seq")])


def scan_limit(rows: DataFrame, page: str, position: str, n: int = fixed.SCAN_LIMIT) -> DataFrame:
    """First `n` cards of every page, `n` kept within 1..100."""
    return top_per_key(rows, [page], [F.col(position)], max(1, min(int(n or 1), fixed.SCAN_LIMIT_MAX)))


def with_group(rows: DataFrame) -> DataFrame:
    """Group key and label of all results of one watch; no group without a name or title."""
    label = F.coalesce(F.nullif(strip(text_or_empty(F.col("name"))), F.lit("")), variant_group_label(F.col("product_title")))
    key = search_group(F.col("site"), F.col("tracking_id"), F.col("name"), F.col("watch_url"), F.col("target_price"))
    return rows.withColumns({"search_group": F.when(label != "", key).otherwise(F.lit("")), "search_group_label": label})
