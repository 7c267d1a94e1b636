"""Registered queries of health rules on cycles so dense that cooldowns decide, with their DuckDB statements."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fold, health
from ..sources import tables
from . import tables as t
from .queries import SQL_ALERT, SQL_DROP, SQL_STREAK, query


@query("""WITH RECURSIVE m AS (SELECT event_type, ts, min(event_id) AS event_id FROM events GROUP BY ALL),
p AS (SELECT m.event_type, m.ts, m.event_id, n.ts AS next_ts FROM m ASOF LEFT JOIN m n ON n.event_type = m.event_type AND n.ts >= m.ts + INTERVAL 15 MINUTE),
f AS (SELECT p.* FROM p WHERE (event_type, ts) IN (SELECT (event_type, min(ts)) FROM m GROUP BY event_type)
  UNION ALL SELECT p.* FROM f JOIN p ON p.event_type = f.event_type AND p.ts = f.next_ts)
SELECT event_type, event_id FROM f""")
def cooldown_picks(spark, folder):
    """Notices of each kind at least 15 minutes apart: the kinds come every few minutes, so that the rule bites all the time."""
    events = t.load(spark, folder, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"), "event_id")
    picked = fold.spaced_pick(events, ["event_type"], "ts", ["event_id"], 900)
    return picked.where("picked").select("event_type", "event_id")


def cycles(spark, folder, minutes: int):
    """Events of each kind in cycles of some minutes."""
    at = F.window("ts", f"{minutes} minutes")["start"]
    return t.load(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp")).groupBy(F.col("event_type").alias("tracker"), at.alias("cycle_at"))


SQL_DENSE = f"""WITH RECURSIVE h AS (SELECT event_type AS tracker, time_bucket(INTERVAL 10 MINUTE, ts) AS cycle_at, count(*) * 10 AS row_count,
    (day(ts) - 1) // 10 AS signature FROM events GROUP BY ALL),
c AS (SELECT *, row_number() OVER (PARTITION BY tracker ORDER BY cycle_at) AS rn FROM h),
b AS (SELECT tracker, rn, cycle_at, row_count, signature, row_count AS base, 0 AS streak, false AS alert, CAST(NULL AS TIMESTAMP) AS last_alert FROM c WHERE rn = 1
  UNION ALL
  SELECT c.tracker, c.rn, c.cycle_at, c.row_count, c.signature,
    CASE WHEN c.signature = b.signature AND {SQL_DROP} THEN b.base ELSE c.row_count END, {SQL_STREAK}, {SQL_ALERT},
    CASE WHEN {SQL_ALERT} THEN c.cycle_at ELSE b.last_alert END
  FROM b JOIN c ON c.tracker = b.tracker AND c.rn = b.rn + 1)"""


def dense_counts(spark, folder):
    rows = cycles(spark, folder, 10).agg((F.count(F.lit(1)) * 10).alias("row_count")).withColumns({
        "seq": F.unix_seconds("cycle_at"), "signature": F.floor((F.dayofmonth("cycle_at") - 1) / 10).cast("string")})
    return health.row_count_alerts(rows, zone="UTC")


@query(SQL_DENSE + "SELECT tracker, cycle_at, row_count, base AS expected, CAST(streak AS BIGINT) AS streak, alert FROM b")
def row_count_alerts_dense(spark, folder):
    return dense_counts(spark, folder).select("tracker", "cycle_at", "row_count", "expected", "streak", "alert")


@query(SQL_DENSE + """SELECT tracker, cycle_at AS observed_at, 'health' AS kind, 'x özet uyarısı' AS title,
  split_part(body, chr(10), 2) || split_part(body, chr(10), 3) || split_part(body, chr(10), 4) AS said FROM (
    SELECT *, chr(10) || 'Beklenen ürün sayısı: ' || base || chr(10) || 'Bu tur bulunan ürün sayısı: ' || row_count || chr(10) || 'Fark: -' || (base - row_count) AS body
    FROM b WHERE alert)""")
def health_alert_rows(spark, folder):
    """Health alerts of falling row counts: the lines of the message that hold numbers."""
    lines = F.split("body", "\n")
    rows = tables.row_count_alert_rows(dense_counts(spark, folder), "x", ["tracker"])
    return rows.select("tracker", "observed_at", "kind", "title", F.concat(lines[1], lines[2], lines[3]).alias("said"))


@query("""WITH RECURSIVE tot AS (SELECT time_bucket(INTERVAL 30 MINUTE, ts) AS cycle_at, count(DISTINCT user_id % 40) AS pages, count(*) AS links FROM events GROUP BY 1),
m AS (SELECT cycle_at FROM tot WHERE (pages >= 4 OR links >= 6) AND hour(cycle_at) BETWEEN 8 AND 21),
p AS (SELECT m.cycle_at, n.cycle_at AS next_at FROM m ASOF LEFT JOIN m n ON n.cycle_at >= m.cycle_at + INTERVAL 1 HOUR),
f AS (SELECT * FROM p WHERE cycle_at = (SELECT min(cycle_at) FROM m) UNION ALL SELECT p.* FROM f JOIN p ON p.cycle_at = f.next_at)
SELECT cycle_at, pages, links, cycle_at IN (SELECT cycle_at FROM f) AS alert FROM tot""")
def search_failure_alerts_dense(spark, folder):
    """All events as failures in cycles of half an hour: an hour must pass between two reports."""
    events = t.load(spark, folder, "events").select(
        F.lit("all").alias("tracker"), F.window(F.col("ts").cast("timestamp"), "30 minutes")["start"].alias("cycle_at"),
        F.concat(F.lit("page "), F.col("user_id") % 40).alias("page"), F.lit(1).alias("failed_links"))
    return health.search_failure_alerts(events, zone="UTC").select("cycle_at", "pages", "links", "alert")
