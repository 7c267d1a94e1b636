"""The published summary: order, merge of partial results, groups, titles and counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import AtomicType

from ..functions.labels import variant_group_label
from ..functions.money import is_target_hit
from ..functions.text import casefold, item_key, strip, text_or_empty
from ..functions.urls import canonical_url, condition, detect_site, is_search_url, title_from_url, url_keys
from ..session import cut_lineage
from .offers import money_text
from .skew import top_per_key


def with_difference(rows: DataFrame) -> DataFrame:
    return rows.withColumn("difference", F.col("price") - F.col("target_price")).withColumn(
        "is_target_hit", is_target_hit(F.col("price"), F.col("target_price"))
    )


# --- order ------------------------------------------------------------------
def summary_order() -> list[Column]:
    """Stored order: seller, size of the difference, price."""
    return [casefold(F.col("seller")), F.abs("difference"), F.col("price"), F.col("seq")]


def stock_order() -> list[Column]:
    return [casefold(F.col("seller")), casefold(F.col("product_title")), F.col("product_url")]


def open_row_order() -> list[Column]:
    """Order of the view: seller, signed difference, title."""
    return [casefold(F.col("seller")), F.col("difference"), casefold(F.col("product_title")), F.col("seq")]


def sort_summary(rows: DataFrame) -> DataFrame:
    return rows.orderBy(*summary_order())


def sort_stock(rows: DataFrame) -> DataFrame:
    return rows.orderBy(*stock_order())


def sort_open_rows(rows: DataFrame) -> DataFrame:
    return rows.orderBy(*open_row_order())


def number_rows(rows: DataFrame, order: list[Column], name: str = "no") -> DataFrame:
    """1..n in a global order without bringing the rows into one task.

    The rows are range sorted and materialised with their partition and position in it; the number of rows in
    earlier partitions, one small row per partition, completes the number.
    """
    placed = cut_lineage(rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    sizes = placed.groupBy("_part").count()
    # One row per partition, so this single-task window is bounded by the number of partitions.
    earlier = F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_part", F.coalesce(earlier, F.lit(0)).alias("_off"))
    position = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(offsets), ["_part"]).withColumn(name, (F.col("_off") + position + 1).cast("bigint")).drop(
        "_part", "_at", "_off"
    )


# --- merge ------------------------------------------------------------------
def merge_summary(prev: DataFrame, fresh: DataFrame, prev_stock: DataFrame, fresh_stock: DataFrame,
                  removed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Publish fresh rows without hiding rows still pending.

    A previous price row stays unless its identity is fresh or removed, or its link is newly out of stock. A
    previous stock row stays unless its link is fresh in either. `removed` has a column `identity`.

    Each table comes as one tagged union over one exchange by canonical link: which tags a link and an identity have are maxima over
    windows that this exchange serves. Rows of a link are few, as both sides hold one for each card and condition; rows without a link
    match nothing and are spread by their content.
    """
    def keyed(rows: DataFrame, tag: str, key_only: bool = False) -> DataFrame:
        linked = rows.withColumns({"_url": canonical_url(F.col("product_url")), "_tag": F.lit(tag)})
        return linked.select("_url", "_tag") if key_only else linked

    def tagged(*parts: DataFrame) -> DataFrame:
        rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        plain = [f.name for f in rows.schema if isinstance(f.dataType, AtomicType)]
        spread = F.concat(F.lit("\x00"), F.pmod(F.xxhash64(*plain), F.lit(4096)).cast("string"))
        return rows.withColumn("_at", F.when(F.col("_url") != "", F.col("_url")).otherwise(spread))

    def any_of(*tags: str, keys: tuple = ()) -> Column:
        return F.max(F.col("_tag").isin(*tags)).over(Window.partitionBy("_at", *keys))

    def chosen(rows: DataFrame, columns: list[str]) -> DataFrame:
        return rows.where((F.col("_tag") == "fresh") | ((F.col("_tag") == "prev") & ~F.col("_gone"))).select(*columns)

    tid = text_or_empty(F.col("tracking_id"))
    ident = F.concat_ws("|", F.nullif(tid, F.lit("")), F.col("_url"), condition(F.col("is_warehouse")))
    rows = tagged(keyed(prev, "prev"), keyed(fresh, "fresh"), keyed(fresh_stock, "stock", True)).withColumn("_id", ident)
    gone = F.when(F.col("_url") == "", F.lit(False)).otherwise(any_of("stock") | any_of("fresh", keys=("_id",)))
    kept = rows.withColumn("_gone", gone)
    if removed is not None:
        taken = removed.select(F.col("identity").alias("_id"), F.lit("prev").alias("_tag")).where("_id != ''")
        kept = kept.join(taken.distinct(), ["_id", "_tag"], "left_anti")
    stock = tagged(keyed(prev_stock, "prev"), keyed(fresh_stock, "fresh"), keyed(fresh, "row", True))
    stock = stock.withColumn("_gone", F.when(F.col("_url") == "", F.lit(False)).otherwise(any_of("fresh", "row")))
    return chosen(kept, prev.columns), chosen(stock, prev_stock.columns)


# --- groups -----------------------------------------------------------------
def infer_groups(rows: DataFrame) -> DataFrame:
    """Add group_key and group_label.

    Rows with a search group keep it (old group names are rewritten by seller and label). Other rows are grouped
    by seller, target and the part of the title before the variant, if more than one row shares them.
    """
    label = variant_group_label(F.col("product_title"))
    own = strip(text_or_empty(F.col("search_group")))
    keyed = rows.withColumns(
        {
            "_seller": casefold(text_or_empty(F.col("seller"))),
            "_target": money_text(F.col("target_price")),
            "_label": label,
            "_low": casefold(label),
            "_own": own,
        }
    )
    keys = ["_seller", "_target", "_low"]
    shared = (
        keyed.where("_own = '' and _low != ''").groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    )
    given = F.coalesce(F.nullif(strip(text_or_empty(F.col("search_group_label"))), F.lit("")), F.col("_label"))
    named = F.col("_own").startswith("watch_result_group_") | F.col("_own").startswith("state_result_group_")
    inferred = F.when(
        F.col("_n").isNotNull(), item_key(F.lit("inferred_variant_group"), F.col("_seller"), F.col("_label"), F.col("_target"))
    )
    return (
        keyed.join(shared, keys, "left")
        .withColumns(
            {
                "group_key": F.when((F.col("_own") != "") & named, F.col("_own"))
                .when(F.col("_own") != "", item_key(F.lit("dashboard_result_group"), F.col("_seller"), given))
                .otherwise(inferred),
                "group_label": F.when(F.col("_own") != "", given).when(F.col("_n").isNotNull(), F.col("_label")),
            }
        )
        .drop(*keys, "_label", "_own", "_n")
    )


def collapse_groups(rows: DataFrame) -> DataFrame:
    """Add group_size and group_first (sort key of the first row); groups of one fall back to ungrouped.

    Rows stay rows: a group of any size is never gathered into one list.
    """
    first = F.struct(
        casefold(F.col("seller")).alias("seller"),
        F.col("difference").alias("difference"),
        casefold(F.col("product_title")).alias("title"),
        F.col("seq").alias("seq"),
    )
    groups = (
        rows.where(F.col("group_key").isNotNull())
        .groupBy("group_key")
        .agg(F.count(F.lit(1)).alias("group_size"), F.min(first).alias("group_first"),
             F.min_by("group_label", "seq").alias("_label"))
        .where("group_size > 1")
    )
    joined = rows.join(groups, ["group_key"], "left")
    in_group = F.col("group_size").isNotNull()
    return joined.withColumns(
        {
            "group_key": F.when(in_group, F.col("group_key")),
            "group_label": F.when(in_group, F.coalesce(F.nullif("_label", F.lit("")), F.lit("Arama sonuçları"))),
        }
    ).drop("_label")


def sort_groups(rows: DataFrame) -> DataFrame:
    """Ungrouped rows first, then groups by their first row and label, rows in view order."""
    return rows.orderBy(
        F.col("group_key").isNotNull(), F.col("group_first"), casefold(F.col("group_label")), F.col("group_key"),
        *open_row_order()
    )


def stock_by_seller(rows: DataFrame) -> DataFrame:
    """Stock gaps with the size of their seller's group, sellers in order."""
    named = rows.withColumn("seller", F.coalesce(F.nullif(text_or_empty(F.col("seller")), F.lit("")), F.lit("Diğer")))
    sizes = named.groupBy("seller").agg(F.count(F.lit(1)).alias("group_size"))
    return named.join(sizes, ["seller"]).orderBy(*stock_order())


def attach_groups(rows: DataFrame, state: DataFrame, cards: DataFrame) -> DataFrame:
    """Give rows without a group the group of the watch that found their link.

    `state`: seq, site, configured_url, url, watch_name, title, include_variations, search_group,
    search_group_label. `cards`: url, include_variations (one row per card link). Only search pages, variation
    watches and entries with a stored group count. Within a source the first entry with a label names the group;
    for a link the last entry wins.
    """
    # Links and titles repeat over the entries: of entries with equal texts only the first (for a name) or the last (for a link) can
    # count, so texts are worked on once for each combination, not for each entry.
    own = ["site", "configured_url", "include_variations", "search_group"]
    linked = state.where(strip(text_or_empty(F.col("url"))) != "")
    variations = cards.where("include_variations").select(
        detect_site(F.col("url")).alias("site"), canonical_url(F.col("url")).alias("_source"), F.lit(True).alias("_var")
    ).where("site is not null").distinct()
    group = strip(text_or_empty(F.col("search_group")))

    def eligible(entries: DataFrame) -> DataFrame:
        source_site = F.coalesce(F.nullif(strip(text_or_empty(F.col("site"))), F.lit("")), detect_site(F.col("configured_url")))
        found = entries.withColumns({"configured_url": strip(text_or_empty(F.col("configured_url"))), "site": source_site}).where(
            "configured_url != '' and site is not null")
        found = found.withColumn("_source", canonical_url(F.col("configured_url"))).join(variations, ["site", "_source"], "left")
        return found.where(
            F.coalesce("include_variations", F.lit(False))
            | F.coalesce("_var", F.lit(False))
            | (F.col("site").isin("amazon", "hepsiburada") & is_search_url(F.col("configured_url")))
            | (group != "")
        )

    named_entries = linked.groupBy(*own, "watch_name", "title", "search_group_label").agg(F.min("seq").alias("seq"))
    links = linked.groupBy(*own, "url").agg(F.max("seq").alias("seq"))
    name = strip(text_or_empty(F.col("watch_name")))
    label = F.coalesce(F.nullif(name, F.lit("")), variant_group_label(F.col("title")))
    named = F.coalesce(F.nullif(name, F.lit("")), F.col("configured_url"))
    meta = eligible(named_entries).where(label != "").select(
        "site",
        "configured_url",
        F.col("seq").alias("_from"),
        F.coalesce(F.nullif(group, F.lit("")), item_key(F.lit("state_result_group"), F.col("site"), named)).alias("_group"),
        F.coalesce(F.nullif(text_or_empty(F.col("search_group_label")), F.lit("")), label).alias("_glabel"),
    )
    source = ["site", "configured_url"]
    first = top_per_key(meta, source, [F.col("_from")])
    by_link = eligible(links).select(*source, "seq", canonical_url(F.col("url")).alias("_link")).join(first, source).where(
        F.col("seq") >= F.col("_from")
    )
    last = by_link.groupBy("_link").agg(F.max_by(F.struct("_group", "_glabel"), "seq").alias("_m"))
    joined = rows.withColumn("_link", canonical_url(F.col("product_url"))).join(last, ["_link"], "left")
    keep = text_or_empty(F.col("search_group")) != ""
    return joined.withColumns(
        {
            "search_group": F.when(keep, F.col("search_group")).otherwise(F.coalesce("_m._group", "search_group")),
            "search_group_label": F.when(keep, F.col("search_group_label")).otherwise(
                F.coalesce("_m._glabel", "search_group_label")
            ),
        }
    ).drop("_link", "_m")


def learned_titles(cards: DataFrame, summary: DataFrame, stock: DataFrame, state: DataFrame) -> DataFrame:
    """Display name of every card: its own name, else the first title known for one of its links, else the words
    of its first link, else its ordinal. `cards`: card_pos, name, urls. Sources are consulted in argument order,
    each in `seq` order; links count with and without their query."""

    def titles(df, url, title, rank):
        return df.select(F.lit(rank).alias("rank"), "seq", F.col(url).alias("url"), strip(text_or_empty(F.col(title))).alias("title"))

    known = (
        titles(summary, "product_url", "product_title", 0)
        .unionByName(titles(stock, "product_url", "product_title", 1))
        .unionByName(titles(state, "configured_url", "title", 2))
        .where("title != ''")
        .withColumn("key", F.explode(url_keys(F.col("url"))))
    )
    first = known.groupBy("key").agg(F.min_by("title", F.struct("rank", "seq")).alias("title"))
    links = cards.select("card_pos", F.posexplode("urls").alias("url_pos", "url")).select(
        "card_pos", "url_pos", F.posexplode(url_keys(F.col("url"))).alias("key_pos", "key")
    )
    found = links.join(first, ["key"]).groupBy("card_pos").agg(
        F.min_by("title", F.struct("url_pos", "key_pos")).alias("_title")
    )
    first_url = F.try_element_at("urls", F.lit(1))
    return cards.join(found, ["card_pos"], "left").select(
        "card_pos",
        F.coalesce(
            F.nullif(strip(text_or_empty(F.col("name"))), F.lit("")),
            F.col("_title"),
            F.when(first_url.isNotNull(), title_from_url(first_url)),
            F.concat(F.lit("Takip "), (F.col("card_pos") + 1).cast("string")),
        ).alias("display_name"),
    )


# --- counts -----------------------------------------------------------------
def summary_counts(rows: DataFrame, stock: DataFrame) -> DataFrame:
    """One row: rows, deals, rows above target, new and used offers, stock gaps."""
    hit = is_target_hit(F.col("price"), F.col("target_price"))
    used = F.coalesce("is_warehouse", F.lit(False))
    gaps = stock.agg(F.count(F.lit(1)).alias("n")).scalar()
    return rows.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if(hit).alias("deal_count"),
        F.count_if(~hit).alias("above_count"),
        F.count_if(~used).alias("new_count"),
        F.count_if(used).alias("used_count"),
    ).withColumn("stock_count", gaps)


def deals(rows: DataFrame) -> DataFrame:
    return rows.where(is_target_hit(F.col("price"), F.col("target_price")))


def above_target(rows: DataFrame) -> DataFrame:
    return rows.where(~is_target_hit(F.col("price"), F.col("target_price")))


def duplicate_count(rows: DataFrame, unique: DataFrame) -> DataFrame:
    n = unique.agg(F.count(F.lit(1)).alias("n")).scalar()
    return rows.agg((F.count(F.lit(1)) - n).alias("duplicates"))
