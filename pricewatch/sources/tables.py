"""Sources and sinks: watch cards, state, summaries, pages, messages, alerts, failures."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import BinaryType

from .. import fixed
from ..functions.charset import decode_page
from ..functions.checks import optional_int, optional_price, parse_flag, required_text
from ..functions.dates import duration_text
from ..functions.labels import default_group
from ..functions.money import format_money, format_signed, parse_money
from ..functions.text import item_key, repair_mojibake, split_terms, strip, text_or_empty
from ..functions.urls import detect_site, needs_name, site_label
from ..operators.offers import dedup_offers, money_text
from ..operators.summary import number_rows, stock_order, summary_order

CARD = ("name string, `group` string, target_price string, minimum_price string, exclude_terms string, size string, "
        "include_variations string, notify_once_in_24H string, active string, check_interval_minutes string, "
        "url_1 string, url_2 string, url_3 string, url_4 string, url_5 string")
OPTIONS = (f"takip_edilenler array<struct<{CARD.replace(' string', ':string')}>>, channels array<string>, "
           "keywords array<string>, exclude_keywords array<string>, telegram_enabled string, "
           "telegram_saved_messages_enabled string, interval_seconds string")
SUMMARY = ("rows array<struct<seller:string,product_title:string,product_url:string,price:string,target:string,"
           "min_price:string,max_price:string,search_group:string,search_group_label:string,is_warehouse:boolean,"
           "tracking_id:string>>, stock_rows array<struct<seller:string,product_title:string,product_url:string,"
           "target:string,reason:string>>")
OFFER_STATE = ("last_price decimal(18,4), min_price decimal(18,4), max_price decimal(18,4), min_price_at timestamp, "
               "max_price_at timestamp, last_checked_at timestamp, was_below_target boolean, "
               "last_alerted_price decimal(18,4), last_alerted_at timestamp")


def read_options(spark: SparkSession, path: str) -> DataFrame:
    """Options document; a missing or broken file gives no rows."""
    try:
        df = spark.read.schema(OPTIONS + ", _corrupt string").json(
            path, multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt"
        )
    except AnalysisException:
        return spark.createDataFrame([], OPTIONS)
    return df.where("_corrupt is null").drop("_corrupt")


def read_watch_cards(spark: SparkSession, path: str) -> DataFrame:
    """One row per card with its position."""
    return read_options(spark, path).select(F.posexplode("takip_edilenler").alias("card_pos", "c")).select("card_pos", "c.*")


def read_channel_settings(spark: SparkSession, path: str) -> DataFrame:
    """Channels, keywords and exclusions with defaults, and the two flags."""
    terms = lambda c: F.flatten(F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), split_terms))
    default = F.array(*[F.lit(c) for c in fixed.DEFAULT_CHANNELS])
    return read_options(spark, path).select(
        F.when(F.size(terms("channels")) > 0, terms("channels")).otherwise(default).alias("channels"),
        terms("keywords").alias("keywords"),
        terms("exclude_keywords").alias("exclude_keywords"),
        parse_flag(F.col("telegram_enabled"), False).alias("enabled"),
        parse_flag(F.col("telegram_saved_messages_enabled"), True).alias("saved_messages_enabled"),
    )


def _card_rows(cards: DataFrame, hosts: list[tuple[str, str]] | None) -> DataFrame:
    """Active cards with their distinct supported links and one error column."""
    urls = F.array_distinct(F.filter(F.array(*[strip(text_or_empty(F.col(f))) for f in fixed.WATCH_URL_FIELDS]), lambda u: u != ""))
    rows = cards.where(parse_flag(F.col("active"), True)).withColumn("urls", urls).where(F.size("urls") > 0)
    rows = rows.withColumn("supported", F.filter("urls", lambda u: detect_site(u, hosts).isNotNull()))
    name = strip(text_or_empty(F.col("name")))
    shown = F.when(name == "", F.lit("adsız ürün")).otherwise(name)
    target = required_text(F.col("target_price"), "target_price", F.concat(F.lit("Takip edilen ("), shown, F.lit(")")))
    price, least = parse_money(target["value"]), optional_price(F.col("minimum_price"))
    minutes = optional_int(F.col("check_interval_minutes"), "check_interval_minutes", 1, 1440)
    search = F.exists("supported", lambda u: needs_name(u))
    error = F.coalesce(
        F.when((name == "") & search, F.lit("Arama linkleri için name alanı zorunlu. Ürün linklerinde boş bırakılabilir.")),
        target["error"],
        F.when(price.isNull(), F.concat(F.lit("Fiyat ayrıştırılamadı: "), target["value"])),
        least["error"],
        F.when(least["value"] > price, F.concat(F.lit("Takip edilen ("), shown, F.lit(") için minimum fiyat hedef fiyattan büyük olamaz."))),
        minutes["error"],
    )
    return rows.withColumns(
        {
            "name": name, "target": price, "least": least["value"], "minutes": minutes["value"].cast("int"), "error": error,
            "sites": F.transform("supported", lambda u: detect_site(u, hosts)),
            "size": strip(text_or_empty(F.col("size"))),
        }
    )


def expand_watches(cards: DataFrame, hosts: list[tuple[str, str]] | None = None) -> DataFrame:
    """One row per distinct supported link of every active card, with defaults, tracking id and `error`.

    An unsupported link drops its row, not the card. Rows of a card with an error carry it instead of being lost.
    """
    rows = _card_rows(cards, hosts)
    tracking = item_key(
        F.lit("tracking_card"), F.col("name"), money_text(F.col("target")), F.col("size"), F.array_join(F.array_sort("supported"), "|")
    )
    return rows.withColumn("tracking_id", tracking).select("*", F.posexplode("supported").alias("url_pos", "url")).select(
        "tracking_id", "name", detect_site(F.col("url"), hosts).alias("site"), "url", F.col("target").alias("target_price"),
        F.col("least").alias("minimum_price"), split_terms(F.col("exclude_terms")).alias("excluded_terms"),
        default_group(F.col("group"), F.col("sites")).alias("group"), "size",
        parse_flag(F.col("include_variations"), False).alias("include_variations"),
        F.lit(fixed.SCAN_LIMIT).alias("max_items_to_scan"), F.col("minutes").alias("check_interval_minutes"),
        parse_flag(F.col("notify_once_in_24H"), True).alias("notify_once_in_24h"), "card_pos", "url_pos", "error",
    )


def valid_watches(watches: DataFrame) -> DataFrame:
    return watches.where(F.col("error").isNull()).drop("error")


def rejected_links(cards: DataFrame, hosts: list[tuple[str, str]] | None = None) -> DataFrame:
    """Links of active cards that no site supports."""
    rows = _card_rows(cards, hosts)
    return rows.select("card_pos", "name", F.explode(F.array_except("urls", "supported")).alias("url"))


def config_signature(watches: DataFrame) -> DataFrame:
    """One digest of the active rules and their places. Each rule is hashed in its task, and the digests are summed in eight parts, so
    that no task gathers the rules and their order of arrival doesn't matter."""
    text = F.concat_ws(
        ":", "card_pos", "url_pos", "site", "url", F.col("target_price").cast("string"), F.col("minimum_price").cast("string"),
        F.array_join("excluded_terms", ","), "size", F.col("include_variations").cast("string"),
    )
    rows = watches.select(F.sha2(text, 256).alias("h"))
    parts = [F.coalesce(F.sum(F.conv(F.substring("h", 8 * i + 1, 8), 16, 10).cast("decimal(10,0)")), F.lit(0)).cast("string") for i in range(8)]
    return rows.agg(F.sha2(F.concat_ws(",", F.count(F.lit(1)).cast("string"), *parts), 256).alias("signature"))


def read_offer_state(spark: SparkSession, path: str) -> DataFrame:
    """Keyed offer state; no table yet means no state."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], f"offer_key string, {OFFER_STATE}")


def read_watch_state(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return spark.createDataFrame(
            [], "watch_key string, offer_keys array<string>, last_checked_at timestamp, last_out_of_stock_at timestamp, "
                "last_missing_at timestamp, last_error string, last_error_status int")


def read_json_state(spark: SparkSession, path: str) -> DataFrame:
    """State document of key -> record: one row per record, other entries skipped."""
    docs = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    entry = docs.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
    return entry.where((F.col("key") != "_meta") & F.schema_of_variant("value").startswith("OBJECT")).select("key", "value")


def read_summary(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Published rows and stock gaps of a summary document; rows without a readable price are skipped."""
    doc = spark.read.schema(SUMMARY).json(path, multiLine=True)
    money = lambda c: parse_money(F.col(c))
    rows = doc.select(F.posexplode("rows").alias("seq", "r")).select("seq", "r.*").select(
        "seq", *[text_or_empty(F.col(c)).alias(c) for c in ("seller", "product_title", "product_url")],
        money("price").alias("price"), money("target").alias("target_price"),
        F.coalesce(money("min_price"), money("price")).alias("min_price"), F.coalesce(money("max_price"), money("price")).alias("max_price"),
        *[text_or_empty(F.col(c)).alias(c) for c in ("search_group", "search_group_label")],
        F.coalesce("is_warehouse", F.lit(False)).alias("is_warehouse"), text_or_empty(F.col("tracking_id")).alias("tracking_id"),
    )
    stock = doc.select(F.posexplode("stock_rows").alias("seq", "r")).select("seq", "r.*").select(
        "seq", *[text_or_empty(F.col(c)).alias(c) for c in ("seller", "product_title", "product_url")],
        money("target").alias("target_price"), text_or_empty(F.col("reason")).alias("reason"),
    )
    return rows.where("price is not null and target_price is not null"), stock.where("target_price is not null")


def read_pages(spark: SparkSession, path: str, column: str = "html", content_type: str | None = None) -> DataFrame:
    """Archived pages as text. Bytes are decoded by the header in the column `content_type`, if it is named, the byte order mark and
    the page's own declaration; text has damaged encoding repaired."""
    pages = spark.read.parquet(path)
    if isinstance(pages.schema[column].dataType, BinaryType):
        return pages.withColumn(column, decode_page(F.col(column), None if content_type is None else F.col(content_type)))
    return pages.withColumn(column, repair_mojibake(F.col(column)))


def read_messages(spark: SparkSession, path: str, schema: str, channels: list[str] | None = None) -> DataFrame:
    """Stream of new message files, limited to the listened channels."""
    stream = spark.readStream.schema(schema).parquet(path)
    return stream if channels is None else stream.where(F.col("channel").isin(channels))


# --- sinks ------------------------------------------------------------------
def shown_summary(rows: DataFrame) -> DataFrame:
    """Deduplicated, sorted and numbered rows in display form."""
    unique = dedup_offers(rows).withColumn("difference", F.col("price") - F.col("target_price"))
    money = lambda c: format_money(F.col(c), True)
    return number_rows(unique, summary_order()).select(
        "no", "seller", "product_title", "product_url", money("price").alias("price"), money("target_price").alias("target"),
        format_signed(F.col("difference"), True).alias("difference"), money("min_price").alias("min_price"),
        money("max_price").alias("max_price"), F.concat(money("min_price"), F.lit(" / "), money("max_price")).alias("price_range"),
        (F.col("price") <= F.col("target_price")).alias("is_target_hit"), "search_group", "search_group_label", "is_warehouse", "tracking_id",
    )


def write_summary(rows: DataFrame, stock: DataFrame, folder: str, checked_at: Column, previous_run: DataFrame | None = None,
                  cycle_seconds: float | None = None, scan_seconds: float | None = None) -> None:
    """Replace the published summary: tables rows, stock_rows and run. Missing durations keep their previous value."""
    spark = rows.sparkSession
    shown_summary(rows).write.mode("overwrite").parquet(f"{folder}/rows")
    number_rows(stock, stock_order()).write.mode("overwrite").parquet(f"{folder}/stock_rows")
    count = lambda name: spark.read.parquet(f"{folder}/{name}").agg(F.count(F.lit(1)).alias("n")).scalar()

    def kept(value, name):
        new = F.lit(value).cast("double")
        if previous_run is None:
            return new
        return F.coalesce(new, previous_run.agg(F.max(name).alias("x")).scalar())

    run = spark.range(1).select(
        checked_at.alias("checked_at"), count("rows").alias("row_count"), count("stock_rows").alias("stock_row_count"),
        kept(cycle_seconds, "cycle_duration_seconds").alias("cycle_duration_seconds"),
        kept(scan_seconds, "scan_duration_seconds").alias("scan_duration_seconds"),
    )
    run = run.withColumns(
        {f"{k}_duration_minutes": duration_text(F.col(f"{k}_duration_seconds")) for k in ("cycle", "scan")}
    )
    run.write.mode("overwrite").parquet(f"{folder}/run")


def merge_state(state: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Keyed upsert: the update's record replaces the stored one."""
    return state.join(updates.select(key), [key], "left_anti").unionByName(updates, allowMissingColumns=True)


def write_state(state: DataFrame, updates: DataFrame, key: str, target: str) -> None:
    """Write the merged state to a new place, never over the one being read."""
    merge_state(state, updates, key).write.mode("overwrite").parquet(target)


def alert_rows(decided: DataFrame) -> DataFrame:
    """Price alerts with title, body and link. `decided` adds seller, product_title, product_url, offer_seller, site."""
    note = F.when((F.col("site") == "hepsiburada") & (text_or_empty(F.col("offer_seller")) != ""), F.concat(F.lit(" ("), "offer_seller", F.lit(")")))
    body = F.concat(
        F.lit("Site: "), "seller", F.lit("\n"), "product_title", F.lit("\nGuncel fiyat: "), format_money(F.col("price"), True),
        F.coalesce(note, F.lit("")), F.lit("\nHedef fiyat: "), format_money(F.col("target_price"), True),
    )
    return decided.where("sent").select(
        F.lit("price").alias("kind"), F.concat("seller", F.lit(" fiyat alarmi")).alias("title"), body.alias("body"),
        F.col("product_url").alias("url"), "observed_at",
    )


def stock_alert_rows(returns: DataFrame) -> DataFrame:
    """Stock alerts with title, body and link. `returns` (of `stock_return` or its stream): site, title, price, url, observed_at."""
    seller = site_label(F.col("site"))
    body = F.concat(F.lit("Site: "), seller, F.lit("\n"), text_or_empty(F.col("title")), F.lit("\nStok yeniden geldi.\nGuncel fiyat: "),
                    format_money(F.col("price"), True))
    return returns.select(F.lit("stock").alias("kind"), F.concat(seller, F.lit(" stok alarmi")).alias("title"), body.alias("body"), "url", "observed_at")


def _filled(lines: list[str], **values: Column) -> Column:
    """Lines of a message with the values in their places."""
    text = F.lit("\n".join(lines))
    for name, value in values.items():
        text = F.replace(text, F.lit(f"{{{name}}}"), value.cast("string"))
    return text


def row_count_alert_rows(counts: DataFrame, sender: str = "", keep: list[str] | None = None) -> DataFrame:
    """Health alerts of `row_count_alerts`: the rows that alert, with title, body and an empty link. `sender` begins the title, `keep` are
    columns that stay."""
    body = _filled(fixed.SUMMARY_WARNING_LINES, expected=F.col("expected"), found=F.col("row_count"), missing=F.col("expected") - F.col("row_count"))
    return counts.where("alert").select(
        *(keep or []), F.lit("health").alias("kind"), F.lit(f"{sender} {fixed.SUMMARY_WARNING}".strip()).alias("title"), body.alias("body"),
        F.lit("").alias("url"), F.col("cycle_at").alias("observed_at"))


def search_failure_alert_rows(totals: DataFrame, lines: DataFrame, sender: str = "") -> DataFrame:
    """Health alerts of `search_failure_alerts`. `lines` is `failure_lines` of the same events by tracker and cycle."""
    said = totals.where("alert").join(lines, ["tracker", "cycle_at"])
    head = _filled(fixed.SEARCH_WARNING_LINES, pages=F.col("pages"), links=F.col("links"))
    body = F.left(F.concat(head, F.lit("\n"), F.array_join("lines", "\n")), F.lit(fixed.MESSAGE_LIMIT))
    return said.select(
        F.lit("health").alias("kind"), F.lit(f"{sender} {fixed.SEARCH_WARNING}".strip()).alias("title"), body.alias("body"),
        F.lit("").alias("url"), F.col("cycle_at").alias("observed_at"))


def write_alerts(alerts: DataFrame, path: str) -> None:
    alerts.write.mode("append").parquet(path)


def write_failures(events: DataFrame, path: str) -> None:
    """Append failure events: created_at, context, page, message, failed_links."""
    events.write.mode("append").parquet(path)
