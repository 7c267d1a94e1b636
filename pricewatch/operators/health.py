"""Health of the watching itself: failures, falling row counts, error reports, message statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed
from ..functions.dates import quiet_hours, within_hours
from ..functions.text import (
    clean_error, error_links, item_key, keyword_caption, preview, strip, text_or_empty, unique_text,
)
from ..functions.urls import detect_site, first_url, site_label
from ..session import written
from .chains import chosen
from .fold import spaced_pick
from .skew import HOT_MIN_ROWS, HistoryScan, top_per_key


def drop_threshold(expected: Column) -> Column:
    """Loss of rows that counts as a drop: a third of the expected rows, at least 6."""
    return F.greatest(F.lit(fixed.DROP_MIN_DELTA), F.ceil(expected / F.lit(fixed.DROP_RATIO))).cast("bigint")


def row_count_alerts(cycles: DataFrame, zone: str = "Europe/Istanbul", hot_min_rows: int = HOT_MIN_ROWS) -> DataFrame:
    """Follow the number of summary rows per tracker; add expected, streak and alert.

    `cycles`: tracker, cycle_at, seq, signature, row_count. A new signature restarts the baseline. A drop keeps the
    baseline and raises the streak; any other row becomes the baseline. An alert needs a streak of 5, an hour
    outside the quiet ones, and an hour since the last alert.

    A count at or above every count since the signature changed cannot be a drop under any baseline, so the rule restarts
    there; pieces between such rows are independent. In a piece of several rows each one points to the row that would replace it
    as baseline, and the chain of these pointers is followed (`chains`).
    """
    least, ratio = fixed.DROP_MIN_DELTA, fixed.DROP_RATIO
    count = F.col("row_count").cast("bigint")
    work = ["_cut", "_piece", "_fold", "_rank"]

    def build(rows: DataFrame, scan: HistoryScan) -> DataFrame:
        rows = scan.add(rows, {"_sig": ("last", F.col("signature"))}, include_current=False)
        rows = rows.withColumn("_new", ~F.col("_sig").eqNullSafe(F.col("signature")))
        rows = scan.add(rows, {"_run": ("sum", F.col("_new").cast("bigint"))}, include_current=True)
        rows = scan.add(rows, {"_most": ("max", F.col("row_count"))}, include_current=False, extra_keys=["_run"])
        rows = rows.withColumn("_cut", F.col("_new") | F.coalesce(F.col("row_count") >= F.col("_most"), F.lit(True)))
        rows = scan.add(rows, {"_piece": ("sum", F.col("_cut").cast("bigint"))}, include_current=True)
        rows = scan.any_in(rows.drop("_sig", "_run", "_most", "_new"), "_fold", ~F.col("_cut"), ["_piece"])
        rows = written(scan.add(rows, {"_rank": ("sum", F.lit(1).cast("bigint"))}, True, ["_piece"]))
        alone = rows.where(~F.col("_fold")).withColumns({"expected": count, "streak": F.lit(0).cast("bigint")})
        pieces = rows.where("_fold")
        if pieces.isEmpty():
            return alone.drop(*work)
        drop = F.greatest(F.lit(least), F.ceil(count / F.lit(ratio))).cast("bigint")
        pieces = pieces.withColumns({"_k": F.struct("tracker", "_piece"), "_value": -count,
                                     "_bound": F.when(count > 0, drop - count).otherwise(F.lit((1 << 63) - 1))})
        based = written(chosen(pieces, [("_value", "_bound")], F.col("_cut")).drop("_k", "_value", "_bound"))
        base = {"expected": ("last", F.when(F.col("_on"), count)), "_base_rank": ("last", F.when(F.col("_on"), F.col("_rank")))}
        based = scan.add(based, base, True, ["_piece"]).withColumn("streak", F.col("_rank") - F.col("_base_rank"))
        return alone.drop(*work).unionByName(based.drop("_on", "_base_rank", *work))

    folded = HistoryScan(["tracker"], "cycle_at", ["seq"], hot_min_rows).apply(cycles, build)
    loud = (F.col("streak") >= fixed.DROP_STREAK) & ~quiet_hours(F.col("cycle_at"), zone)
    return spaced_pick(
        folded, ["tracker"], "cycle_at", ["seq"], fixed.HOUR_SECONDS, "alert",
        eligible=loud, hot_min_rows=hot_min_rows,
    )


def search_failure_totals(events: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct affected pages and failed links."""
    page = F.nullif(text_or_empty(F.col("page")), F.lit(""))
    return events.groupBy(*keys).agg(
        F.count_distinct(page).alias("pages"), F.coalesce(F.sum("failed_links"), F.lit(0)).cast("bigint").alias("links")
    )


def search_failure_alerts(events: DataFrame, zone: str = "Europe/Istanbul") -> DataFrame:
    """Totals per check cycle and whether they are reported: 4 pages or 6 links, not quiet, once per hour.

    `events`: tracker, cycle_at, page, failed_links.
    """
    totals = search_failure_totals(events, ["tracker", "cycle_at"])
    loud = ((F.col("pages") >= fixed.FAILURE_MIN_PAGES) | (F.col("links") >= fixed.FAILURE_MIN_LINKS)) & ~quiet_hours(
        F.col("cycle_at"), zone
    )
    return spaced_pick(totals, ["tracker"], "cycle_at", [], fixed.HOUR_SECONDS, "alert", eligible=loud)


def failure_lines(events: DataFrame, keys: list[str], n: int = 8) -> DataFrame:
    """First `n` event lines per group and how many more there are. The list holds at most `n` entries."""
    line = F.concat(F.lit("- "), F.coalesce(F.nullif(text_or_empty(F.col("page")), F.lit("")), F.lit("-")),
                    F.lit(": erisim hatasi, link="), F.coalesce("failed_links", F.lit(0)).cast("string"))
    head = top_per_key(events.withColumn("_line", line), keys, [F.col("seq")], n)
    lists = head.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("seq", "_line"))).alias("_l"))
    sizes = events.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    more = F.when(F.col("_n") > n, F.array(F.format_string("- +%d ek arama kaydi", F.col("_n") - n)))
    return lists.join(sizes, keys).select(
        *keys, F.concat(F.col("_l._line"), F.coalesce(more, F.array().cast("array<string>"))).alias("lines")
    )


def daily_error_notice(errors: DataFrame, zone: str = "Europe/Istanbul") -> DataFrame:
    """First failure per watch and local day in the reporting hour. `errors`: watch_key, observed_at, seq."""
    local = F.from_utc_timestamp("observed_at", zone)
    hour = errors.withColumn("_day", F.to_date(local)).where(F.hour(local) == fixed.ERROR_NOTICE_HOUR)
    return top_per_key(hour, ["watch_key", "_day"], [F.col("observed_at"), F.col("seq")]).drop("_day")


def cooldown_remaining(blocked_at: Column, as_of: Column, seconds: int = 0) -> Column:
    """Seconds left of a cooldown that began at `blocked_at`."""
    elapsed = F.floor((F.unix_micros(as_of) - F.unix_micros(blocked_at)) / F.lit(1_000_000))
    return F.coalesce(F.greatest(F.lit(0), F.lit(seconds) - elapsed), F.lit(0)).cast("bigint")


def recent_errors(events: DataFrame, as_of: Column, time: str = "created_at", hours: int = 24) -> DataFrame:
    """Events of the trailing hours, boundary included; unreadable times are dropped."""
    return events.where(within_hours(F.col(time), as_of, hours))


def error_count(events: DataFrame, as_of: Column, time: str = "created_at", hours: int = 24) -> DataFrame:
    return recent_errors(events, as_of, time, hours).agg(F.count(F.lit(1)).alias("errors"))


def health_summary(state: DataFrame, as_of: Column, interval_seconds: int = fixed.DEFAULT_INTERVAL_SECONDS) -> DataFrame:
    """One row: last and next check, errors of the last 24 hours."""
    failing = (text_or_empty(F.col("last_error")) != "") & within_hours(F.col("last_checked_at"), as_of)
    return state.agg(
        F.max("last_checked_at").alias("last_check"),
        (F.max("last_checked_at") + F.expr(f"interval {int(interval_seconds)} seconds")).alias("next_check"),
        F.count_if(failing).alias("errors"),
    )


def error_context(errors: DataFrame, links: DataFrame) -> DataFrame:
    """Which watch an error belongs to: by key, else by the first watch that has one of its links.

    `errors`: state_key, site, url, configured_url, last_error. `links`: pos, site, name, url (one row per card
    link, pos in configuration order).
    """
    url = strip(text_or_empty(F.col("url")))
    name = strip(text_or_empty(F.col("name")))
    shown = F.coalesce(F.nullif(name, F.lit("")), url)
    site = F.coalesce(detect_site(url), F.lower(strip(F.coalesce(F.nullif("site", F.lit("")), F.lit("urun")))))
    label = F.when(detect_site(url).isNotNull(), site_label(detect_site(url))).otherwise(_site_name(site))
    ctx = links.select(
        item_key(F.lit("watch"), site, name, url).alias("ctx_key"),
        F.col("pos"),
        F.struct(
            F.concat(label, F.lit(": "), shown).alias("title"),
            F.concat(F.lit("Takip edilen: "), shown).alias("meta"),
            url.alias("url"),
            F.when(name != "", F.array(name)).otherwise(F.array().cast("array<string>")).alias("keywords"),
        ).alias("ctx"),
        url.alias("ctx_url"),
    )
    # Of links with one key the last one describes it, at the place of the first.
    by_key = ctx.groupBy("ctx_key").agg(
        F.max_by(F.struct("ctx", "ctx_url"), "pos").alias("v"), F.min("pos").alias("pos")
    ).select("ctx_key", "pos", "v.ctx", "v.ctx_url")
    e = errors.withColumn(
        "_urls",
        unique_text(
            F.concat(
                F.transform(error_links(F.col("last_error")), lambda p: p["url"]),
                F.array(text_or_empty(F.col("url")), text_or_empty(F.col("configured_url"))),
            )
        ),
    )
    direct = e.join(by_key.select(F.col("ctx_key").alias("state_key"), F.col("ctx").alias("_direct")), ["state_key"], "left")
    by_url = (
        e.select("state_key", F.explode("_urls").alias("ctx_url"))
        .join(by_key.select("ctx_url", "pos", "ctx"), ["ctx_url"])
        .groupBy("state_key")
        .agg(F.min_by("ctx", "pos").alias("_by_url"))
    )
    return direct.join(by_url, ["state_key"], "left").withColumn("context", F.coalesce("_direct", "_by_url")).drop(
        "_urls", "_direct", "_by_url"
    )


def _site_name(site: Column) -> Column:
    return F.when(site.isin(*[s for s in fixed.SITE_LABELS if s != "bengurme"]), site_label(site)).otherwise(
        F.lit(fixed.ERROR_SITE_FALLBACK)
    )


def error_details(state: DataFrame, links: DataFrame, as_of: Column, limit: int | None = 4) -> DataFrame:
    """Distinct error reports of the last 24 hours in state order, at most `limit`; each with up to 4 failed links.

    `state` adds seq and last_checked_at to the columns of `error_context`.
    """
    failing = state.where((text_or_empty(F.col("last_error")) != "") & within_hours(F.col("last_checked_at"), as_of))
    rows = error_context(failing, links)
    failed = F.slice(error_links(F.col("last_error")), 1, 4)
    words = F.coalesce(F.col("context.keywords"), F.array().cast("array<string>"))
    caption = F.when(F.size(words) > 0, keyword_caption(words)).otherwise(F.lit(""))
    meta = F.coalesce(F.col("context.meta"), F.nullif(caption, F.lit("")), F.lit("Takip edilen link kontrol edilirken hata oluştu."))
    add = (caption != "") & ~F.contains(F.lower(meta), F.lit("keyword"))
    url = F.coalesce(
        F.try_element_at(failed, F.lit(1))["url"],
        F.nullif(F.coalesce(F.col("context.url"), F.col("url")), F.lit("")),
        first_url(F.col("last_error")),
    )
    shaped = rows.select(
        "seq",
        F.coalesce(F.col("context.title"), _site_name(F.lower(text_or_empty(F.col("site"))))).alias("title"),
        F.when(add, F.concat(meta, F.lit(" · "), caption)).otherwise(meta).alias("meta"),
        clean_error(F.col("last_error")).alias("message"),
        url.alias("url"),
        F.transform(failed, lambda p: p["url"]).alias("failed_links"),
    )
    first = top_per_key(shaped, ["title", "meta", "message", "url", "failed_links"], [F.col("seq")]).orderBy("seq")
    return first if limit is None else first.limit(limit)


def channel_stats(messages: DataFrame, alerts: DataFrame) -> DataFrame:
    """One row per channel: messages, last message, alerts, last alert, distinct keywords."""
    m = messages.groupBy("channel").agg(F.count(F.lit(1)).alias("messages"), F.max("ts").alias("last_check"))
    a = alerts.groupBy("channel").agg(
        F.count(F.lit(1)).alias("notifications"),
        F.count_distinct("keyword").alias("keywords"),
        F.max("ts").alias("last_notification"),
    )
    zero = F.lit(0).cast("bigint")
    return m.join(a, ["channel"], "left").withColumns(
        {"notifications": F.coalesce("notifications", zero), "keywords": F.coalesce("keywords", zero)}
    )


def recent_notifications(alerts: DataFrame, k: int = 5, keys: list[str] | None = None) -> DataFrame:
    """Newest `k` alerts, overall or per key, with a 180 character preview."""
    shown = alerts.withColumn("message", preview(F.col("text"), 180)).drop("text")
    newest = [F.col("ts").desc(), F.col("message_id").desc()]
    return top_per_key(shown, keys, newest, k) if keys else shown.orderBy(*newest).limit(k)


def keep_last(keys: DataFrame, order: list[Column], n: int = fixed.SEEN_MESSAGES) -> DataFrame:
    """Newest `n` rows: each task keeps its own `n`, only those meet."""
    return keys.orderBy(*order).limit(n)


def match_replies(replies: DataFrame, prompts: DataFrame, hours: int = fixed.REPLY_HOURS) -> DataFrame:
    """Replies joined to the prompt they answer: same chat, reply id is the source or the prompt message, and the
    prompt is at most `hours` old. The oldest such prompt wins.

    `replies`: chat_id, message_id, ts, reply_to_id, ... `prompts`: chat_id, source_message_id, prompt_message_id,
    created_at, ...
    """
    ids = F.array_distinct(F.filter(F.array("source_message_id", "prompt_message_id"), lambda i: i.isNotNull()))
    p = prompts.withColumn("reply_to_id", F.explode(ids))
    r = replies.where(F.col("reply_to_id").isNotNull())
    near = r.join(p, ["chat_id", "reply_to_id"]).where(
        (F.col("created_at") <= F.col("ts")) & within_hours(F.col("created_at"), F.col("ts"), hours)
    )
    return top_per_key(near, ["chat_id", "message_id"], [F.col("created_at"), F.col("source_message_id")])


