"""Registered queries: every operator bound to the driver's tables, with the same result stated as DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import dates, money, urls
from ..operators import alerts, health, history, maintenance, matching, offers, summary
from . import tables as t

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn

    return register


# --- shared SQL -------------------------------------------------------------
SQL_OBS = """
obs AS (
  SELECT l_partkey AS offer_key, CAST(l_shipdate AS TIMESTAMP) AS observed_at, l_orderkey, l_linenumber, l_suppkey,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS price,
         CAST(CAST(p_retailprice AS DECIMAL(18,2)) * 20 AS DECIMAL(18,2)) AS target_price,
         p_size % 2 = 0 AS daily, p_name, l_quantity, l_returnflag, l_linestatus
  FROM lineitem JOIN part ON l_partkey = p_partkey)
"""
SQL_W = "PARTITION BY offer_key ORDER BY observed_at, l_orderkey, l_linenumber, l_suppkey"
SQL_BOUNDS = f"""
{SQL_OBS},
prev AS (SELECT *, lag(price) OVER w AS last_price, lag(price <= target_price) OVER w AS pb, row_number() OVER w AS rn
         FROM obs WINDOW w AS ({SQL_W})),
ref AS (SELECT *, CASE WHEN last_price IS NULL OR (last_price > target_price * 5 AND last_price - target_price >= 50000)
                       THEN target_price ELSE greatest(target_price, last_price) END AS rp FROM prev),
flag AS (SELECT *, price > rp * 5 AND price - rp >= 50000 AS is_absurd FROM ref),
run AS (SELECT *, min(CASE WHEN rn = 1 OR NOT is_absurd THEN price END) OVER w AS min_price,
               max(CASE WHEN rn = 1 OR NOT is_absurd THEN price END) OVER w AS max_price
        FROM flag WINDOW w AS ({SQL_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
chg AS (SELECT *, lag(min_price) OVER w AS pmin, lag(max_price) OVER w AS pmax FROM run WINDOW w AS ({SQL_W})),
bounds AS (SELECT *, last_value(CASE WHEN pmin IS NULL OR pmin <> min_price THEN observed_at END IGNORE NULLS) OVER w AS min_price_at,
                  last_value(CASE WHEN pmax IS NULL OR pmax <> max_price THEN observed_at END IGNORE NULLS) OVER w AS max_price_at
           FROM chg WINDOW w AS ({SQL_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
"""
SQL_SUMMARY = f"""
{SQL_BOUNDS},
cur AS (SELECT * FROM bounds QUALIFY row_number() OVER (PARTITION BY offer_key
          ORDER BY observed_at DESC, l_orderkey DESC, l_linenumber DESC, l_suppkey DESC) = 1),
summ AS (SELECT offer_key, s_name AS seller, p_name AS product_title, l_suppkey, l_returnflag, observed_at, price, target_price,
           min_price, max_price, CAST(price - target_price AS DECIMAL(18,2)) AS difference, price <= target_price AS is_target_hit
         FROM cur JOIN supplier ON l_suppkey = s_suppkey)
"""


# --- history and alerts -----------------------------------------------------
def bounded(spark, folder, scan=None):
    return history.price_bounds(t.observations(spark, folder), scan=scan)


def scan_of_lines(spark, folder):
    """Scan of the observations with its hot keys counted once, on the key column alone."""
    return history.offer_scan().with_hot_keys(t.load(spark, folder, "lineitem").select(F.col("l_partkey").alias("offer_key")))


@query(f"""WITH {SQL_BOUNDS}
SELECT offer_key, observed_at, l_orderkey, l_linenumber, l_suppkey, price, min_price, max_price, min_price_at, max_price_at,
       coalesce(pb, false) AS was_below, is_absurd FROM bounds""")
def price_bounds(spark, folder):
    return bounded(spark, folder).select(
        "offer_key", "observed_at", *t.order_of_lines(), "price", "min_price", "max_price", "min_price_at",
        "max_price_at", "was_below", "is_absurd",
    )


SQL_HIT = """(o.price <= o.target_price AND (f.lap IS NULL OR o.price < f.lap OR
      (CASE WHEN o.daily THEN o.observed_at - f.lat >= INTERVAL 24 HOUR ELSE NOT f.below END)))"""


def fold_tables(order: str) -> str:
    """Tables o (observations numbered) and f (alert memory after each), by the rule row after row. Needs obs and WITH RECURSIVE."""
    return f"""
o AS (SELECT *, row_number() OVER (PARTITION BY offer_key ORDER BY {order}) AS rn FROM obs),
f AS (
  SELECT offer_key, rn, price <= target_price AS below, price <= target_price AS sent,
         CASE WHEN price <= target_price THEN price END AS lap, CASE WHEN price <= target_price THEN observed_at END AS lat
  FROM o WHERE rn = 1
  UNION ALL
  SELECT o.offer_key, o.rn, o.price <= o.target_price, {SQL_HIT}, CASE WHEN {SQL_HIT} THEN o.price ELSE f.lap END,
         CASE WHEN {SQL_HIT} THEN o.observed_at ELSE f.lat END
  FROM f JOIN o ON o.offer_key = f.offer_key AND o.rn = f.rn + 1)"""


def alert_fold(obs: str, order: str, cols: str) -> str:
    return f"""WITH RECURSIVE {obs}, {fold_tables(order)}
SELECT {cols}, f.sent FROM o JOIN f ON o.offer_key = f.offer_key AND o.rn = f.rn
"""


@query(alert_fold(SQL_OBS, "observed_at, l_orderkey, l_linenumber, l_suppkey",
                  "o.offer_key, o.observed_at, o.l_orderkey, o.l_linenumber, o.l_suppkey, o.price"))
def alert_decisions(spark, folder):
    decided = alerts.alert_decisions(t.observations(spark, folder))
    return decided.select("offer_key", "observed_at", *t.order_of_lines(), "price", "sent")


SQL_EVENT_OBS = """obs AS (SELECT user_id AS offer_key, ts AS observed_at, event_id,
  CAST(value AS DECIMAL(18,2)) AS price, CAST(60 AS DECIMAL(18,2)) AS target_price, user_id % 3 > 0 AS daily FROM events)"""


@query(alert_fold(SQL_EVENT_OBS, "observed_at, event_id", "o.offer_key, o.event_id, o.price"))
def alert_decisions_dense(spark, folder):
    """Histories with several checks a day, where the daily rule depends on its own earlier alerts."""
    e = t.load(spark, folder, "events").select(
        F.col("user_id").alias("offer_key"),
        F.col("ts").cast("timestamp").alias("observed_at"),
        F.col("event_id").alias("seq"),
        F.col("value").cast(t.MONEY).alias("price"),
        F.lit(60).cast(t.MONEY).alias("target_price"),
        (F.col("user_id") % 3 > 0).alias("notify_once_in_24h"),
    )
    return alerts.alert_decisions(e).select("offer_key", F.col("seq").alias("event_id"), "price", "sent")


LAST_LINE = "observed_at DESC, l_orderkey DESC, l_linenumber DESC, l_suppkey DESC"
LINE_ORDER = "observed_at, l_orderkey, l_linenumber, l_suppkey"


@query(f"""WITH RECURSIVE {SQL_BOUNDS}, {fold_tables(LINE_ORDER)},
memory AS (SELECT offer_key, arg_max(lap, rn) AS last_alerted_price, arg_max(lat, rn) AS last_alerted_at FROM f WHERE sent GROUP BY 1),
now AS (SELECT * FROM bounds QUALIFY row_number() OVER (PARTITION BY offer_key ORDER BY {LAST_LINE}) = 1)
SELECT offer_key, price AS last_price, min_price, max_price, min_price_at, max_price_at, observed_at AS last_checked_at,
       price <= target_price AS was_below_target, last_alerted_price, last_alerted_at FROM now LEFT JOIN memory USING (offer_key)""")
def state_after(spark, folder):
    scan = scan_of_lines(spark, folder)
    return history.state_after(alerts.alert_decisions(bounded(spark, folder, scan), scan=scan))


SQL_GONE = "gone AS (SELECT DISTINCT l_partkey AS watch_key, CAST(l_shipdate AS TIMESTAMP) AS missing_at FROM lineitem WHERE l_quantity = 13)"


@query(f"""WITH RECURSIVE {SQL_OBS}, {SQL_GONE},
keyed AS (SELECT obs.* EXCLUDE (offer_key), offer_key AS own, offer_key || '#' ||
  (SELECT count(*) FROM gone WHERE watch_key = offer_key AND missing_at <= observed_at) AS offer_key FROM obs),
{fold_tables(LINE_ORDER).replace("FROM obs)", "FROM keyed)")}
SELECT o.own AS offer_key, o.observed_at, o.l_orderkey, o.l_linenumber, o.l_suppkey, f.sent FROM o JOIN f ON o.offer_key = f.offer_key AND o.rn = f.rn""")
def alerts_after_missing(spark, folder):
    """Scope `offer`: the alert memory of an offer restarts whenever its item vanished."""
    obs = t.observations(spark, folder).withColumn("watch_key", F.col("offer_key"))
    gone = t.lines(spark, folder).where("l_quantity = 13").select(F.col("l_partkey").alias("watch_key"), F.col("observed_at").alias("missing_at")).distinct()
    decided = alerts.decisions_by_epoch(alerts.clear_alerts_after_missing(obs, gone, "offer"))
    return decided.select("offer_key", "observed_at", *t.order_of_lines(), "sent")


@query(alert_fold(SQL_OBS, LINE_ORDER, "o.offer_key, o.observed_at, o.l_orderkey, o.l_linenumber, o.l_suppkey"))
def alerts_after_missing_watch(spark, folder):
    """Scope `watch`: offers keep their memory."""
    obs = t.observations(spark, folder).withColumn("watch_key", F.col("offer_key"))
    gone = t.lines(spark, folder).where("l_quantity = 13").select(F.col("l_partkey").alias("watch_key"), F.col("observed_at").alias("missing_at")).distinct()
    decided = alerts.decisions_by_epoch(alerts.clear_alerts_after_missing(obs, gone, "watch"))
    return decided.select("offer_key", "observed_at", *t.order_of_lines(), "sent")


@query(f"""WITH RECURSIVE {SQL_BOUNDS}, {fold_tables(LINE_ORDER)}
SELECT o.offer_key, o.observed_at, o.l_orderkey, o.l_linenumber, o.l_suppkey, b.min_price, b.max_price, b.min_price_at, f.sent
FROM o JOIN f ON o.offer_key = f.offer_key AND o.rn = f.rn
JOIN bounds b ON b.offer_key = o.offer_key AND b.rn = o.rn WHERE o.observed_at >= TIMESTAMP '{t.FIRST_HALF} 00:00:00'""")
def alerts_from_state(spark, folder):
    """The later half of the history, decided on the state that the first half left: equal to deciding on all of it."""
    obs = t.observations(spark, folder)
    early = F.col("observed_at") < F.lit(t.FIRST_HALF).cast("timestamp")
    scan = scan_of_lines(spark, folder)
    state = history.state_after(alerts.alert_decisions(history.price_bounds(obs.where(early), scan=scan), scan=scan))
    decided = alerts.alert_decisions(history.price_bounds(obs.where(~early), state, scan), state, scan)
    return decided.select("offer_key", "observed_at", *t.order_of_lines(), "min_price", "max_price", "min_price_at", "sent")


SQL_CYCLES = """cyc AS (
  SELECT l_partkey AS watch_key, CAST(l_shipdate AS TIMESTAMP) AS observed_at, l_orderkey, l_linenumber, l_suppkey,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS price,
         CASE WHEN l_quantity = 13 THEN 'failed' WHEN l_linestatus = 'O' AND l_returnflag = 'A' THEN 'out_of_stock' ELSE 'ok' END AS outcome
  FROM lineitem)"""


def cycles_of_lines(spark, folder):
    outcome = (
        F.when(F.col("l_quantity") == 13, "failed")
        .when((F.col("l_linestatus") == "O") & (F.col("l_returnflag") == "A"), "out_of_stock")
        .otherwise("ok")
    )
    seq = F.struct("observed_at", *t.order_of_lines())
    return t.lines(spark, folder).select(
        F.col("l_partkey").alias("watch_key"), "observed_at", seq.alias("seq"), outcome.alias("outcome"), "price",
        *t.order_of_lines(),
    )


@query(f"""WITH {SQL_CYCLES},
prev AS (SELECT *, last_value(CASE WHEN outcome IN ('ok','out_of_stock') THEN outcome END IGNORE NULLS) OVER (
    PARTITION BY watch_key ORDER BY observed_at, l_orderkey, l_linenumber, l_suppkey
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM cyc)
SELECT watch_key, observed_at, l_orderkey, l_linenumber, l_suppkey, price FROM prev
WHERE outcome = 'ok' AND before = 'out_of_stock'""")
def stock_return(spark, folder):
    c = cycles_of_lines(spark, folder)
    cycles = c.select("watch_key", F.lit("bengurme").alias("site"), "observed_at", "seq", "outcome")
    found = c.select("watch_key", "seq", F.lit(0).alias("offer_pos"), "price", *t.order_of_lines())
    return alerts.stock_return(cycles, found).select("watch_key", "observed_at", *t.order_of_lines(), "price")


@query(f"""WITH {SQL_CYCLES},
c AS (SELECT *, row_number() OVER (PARTITION BY watch_key ORDER BY {LINE_ORDER}) AS rn, watch_key % 2 = 0 AS returns,
        outcome = 'out_of_stock' OR (outcome = 'failed' AND l_suppkey % 2 = 0) AS missing, outcome = 'ok' AND price < 20000 AS alerted FROM cyc),
m AS (SELECT *, last_value(CASE WHEN missing THEN 0 WHEN alerted THEN 1 END IGNORE NULLS) OVER (PARTITION BY watch_key ORDER BY rn
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS memory FROM c),
pos AS (SELECT watch_key, max(rn) AS rn, max(CASE WHEN outcome = 'out_of_stock' THEN rn END) AS oos, max(CASE WHEN outcome = 'ok' THEN rn END) AS ok,
          max(CASE WHEN outcome = 'out_of_stock' THEN observed_at END) AS oos_at, max(CASE WHEN missing AND memory = 1 THEN observed_at END) AS last_missing_at
        FROM m GROUP BY 1)
SELECT watch_key, observed_at AS last_checked_at, outcome AS last_outcome,
  CASE WHEN outcome = 'failed' THEN CASE WHEN l_suppkey % 2 = 0 THEN 'Fiyat bulunamadı' ELSE 'x' END END AS last_error,
  CASE WHEN outcome = 'failed' THEN CAST(500 + l_linenumber AS INTEGER) END AS last_error_status,
  CASE WHEN NOT returns OR ok IS NULL OR oos > ok THEN oos_at END AS last_out_of_stock_at, last_missing_at,
  CASE WHEN outcome = 'ok' THEN 'k' || l_suppkey ELSE '' END AS offer_keys
FROM pos JOIN c USING (watch_key, rn)""")
def watch_state_after(spark, folder):
    """Even watches are of a site with stock alerts, odd ones are not."""
    vanished = F.col("l_suppkey") % 2 == 0
    c = cycles_of_lines(spark, folder).withColumns({
        "site": F.when(F.col("watch_key") % 2 == 0, "bengurme").otherwise("amazon"),
        "reason": F.when(vanished, "Fiyat bulunamadı").otherwise("x"), "status_code": (500 + F.col("l_linenumber")).cast("int")})
    told = c.where("outcome = 'ok' and price < 20000").select("watch_key", "observed_at", "seq")
    found = c.where("outcome = 'ok'").select("watch_key", "seq", F.concat(F.lit("k"), "l_suppkey").alias("offer_key"))
    return history.watch_state_after(c, found, told).withColumn("offer_keys", F.array_join("offer_keys", ","))


# --- offers -----------------------------------------------------------------
def offer_rows(spark, folder):
    rows = t.lines(spark, folder, spread=True)
    return rows.select(
        F.col("l_partkey").cast("string").alias("tracking_id"),
        F.concat(F.lit("https://Shop.example.org/p/"), "l_suppkey", F.lit("/")).alias("product_url"),
        F.concat(F.lit("https://shop.example.org/p/"), "l_partkey", F.lit("/"), "l_suppkey").alias("url"),
        (F.col("l_returnflag") == "R").alias("is_warehouse"),
        F.nullif("l_quantity", F.lit(1)).cast("int").alias("stock_quantity"),
        "price",
        F.struct("observed_at", *t.order_of_lines()).alias("seq"),
        "observed_at",
        *t.order_of_lines(),
        "l_partkey",
    )


SQL_OFFERS = """off AS (SELECT CAST(l_partkey AS VARCHAR) AS tracking_id, 'https://Shop.example.org/p/' || l_suppkey || '/' AS product_url,
  'https://shop.example.org/p/' || l_partkey || '/' || l_suppkey AS url, l_returnflag = 'R' AS is_warehouse,
  CAST(nullif(l_quantity, 1) AS INTEGER) AS stock_quantity, CAST(l_extendedprice AS DECIMAL(18,2)) AS price,
  CAST(l_shipdate AS TIMESTAMP) AS observed_at, l_orderkey, l_linenumber, l_suppkey, l_partkey FROM lineitem)"""
SQL_SEQ = "observed_at, l_orderkey, l_linenumber, l_suppkey"


@query(f"""WITH {SQL_OFFERS} SELECT tracking_id, product_url, is_warehouse, price, {SQL_SEQ} FROM off
QUALIFY row_number() OVER (PARTITION BY tracking_id, lower(product_url), is_warehouse ORDER BY price, {SQL_SEQ}) = 1""")
def dedup_offers(spark, folder):
    return offers.dedup_offers(offer_rows(spark, folder)).select(
        "tracking_id", "product_url", "is_warehouse", "price", "observed_at", *t.order_of_lines()
    )


@query(f"""WITH {SQL_OFFERS} SELECT url, is_warehouse, stock_quantity, price, {SQL_SEQ} FROM off
QUALIFY row_number() OVER (PARTITION BY url, is_warehouse ORDER BY price, stock_quantity IS NULL, {SQL_SEQ}) = 1""")
def dedup_results(spark, folder):
    return offers.dedup_results(offer_rows(spark, folder)).select(
        "url", "is_warehouse", "stock_quantity", "price", "observed_at", *t.order_of_lines()
    )


@query(f"""WITH {SQL_OFFERS} SELECT l_partkey, price, {SQL_SEQ} FROM off
QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY price, {SQL_SEQ}) = 1""")
def best_offer(spark, folder):
    return offers.best_offer(offer_rows(spark, folder), ["l_partkey"]).select(
        "l_partkey", "price", "observed_at", *t.order_of_lines()
    )


@query(f"""WITH {SQL_OFFERS} SELECT url, price, {SQL_SEQ} FROM off
QUALIFY row_number() OVER (PARTITION BY url ORDER BY price, {SQL_SEQ}) = 1""")
def dedup_candidates(spark, folder):
    rows = offer_rows(spark, folder).withColumns({"identity": F.lit(""), "title": F.col("tracking_id")})
    return offers.dedup_candidates(rows).select("url", "price", "observed_at", *t.order_of_lines())


@query(f"""WITH {SQL_OBS} SELECT offer_key, l_suppkey, l_returnflag = 'R' AS is_warehouse,
  CAST(price - target_price AS DECIMAL(18,2)) AS difference, observed_at, l_orderkey, l_linenumber FROM obs
QUALIFY row_number() OVER (PARTITION BY offer_key, l_suppkey, l_returnflag = 'R' ORDER BY price - target_price, {SQL_SEQ}) = 1""")
def dedup_by_difference(spark, folder):
    rows = t.observations(spark, folder).select(
        "offer_key", "l_suppkey", (F.col("l_returnflag") == "R").alias("is_warehouse"),
        F.col("offer_key").cast("string").alias("tracking_id"),
        F.concat(F.lit("https://shop.example.org/p/"), "l_suppkey").alias("product_url"),
        (F.col("price") - F.col("target_price")).cast(t.MONEY).alias("difference"),
        F.struct("observed_at", *t.order_of_lines()).alias("seq"), "observed_at", "l_orderkey", "l_linenumber",
    )
    return offers.dedup_by_difference(rows).drop("tracking_id", "product_url", "seq")


@query(f"""WITH {SQL_OBS} SELECT p_name, l_suppkey, price, observed_at, l_orderkey, l_linenumber, offer_key FROM obs
QUALIFY row_number() OVER (PARTITION BY p_name, l_suppkey, price ORDER BY {SQL_SEQ}, offer_key) = 1""")
def dedup_variants(spark, folder):
    rows = t.observations(spark, folder).select(
        F.col("p_name").alias("variant"), F.col("l_suppkey").cast("string").alias("seller"), "price",
        F.initcap("p_name").alias("title"), F.struct("observed_at", *t.order_of_lines(), "offer_key").alias("seq"),
        "p_name", "l_suppkey", "observed_at", "l_orderkey", "l_linenumber", "offer_key",
    )
    return offers.dedup_variants(rows).drop("variant", "seller", "title", "seq")


@query(f"""WITH {SQL_OFFERS} SELECT l_suppkey, {SQL_SEQ.replace(', l_suppkey', '')}, l_partkey, price FROM off
QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY {SQL_SEQ}, l_partkey) <= 60""")
def scan_limit(spark, folder):
    rows = offer_rows(spark, folder).withColumn("pos", F.struct("seq", "l_partkey"))
    return offers.scan_limit(rows, "l_suppkey", "pos").select(
        "l_suppkey", "observed_at", "l_orderkey", "l_linenumber", "l_partkey", "price"
    )


@query(f"""WITH {SQL_OBS} SELECT o.offer_key, o.observed_at, o.l_orderkey, o.l_linenumber, o.l_suppkey, o.price, p.p_brand
FROM obs o JOIN part p ON o.offer_key = p.p_partkey""")
def offers_for_watches(spark, folder):
    page = F.concat(F.lit("https://shop.example.org/p/"), F.col("l_partkey"), F.lit("/#top"))
    rows = t.lines(spark, folder).withColumns({"site": F.lit("org"), "page_url": page})
    watches = t.parts(spark, folder).select(
        F.lit("org").alias("site"), F.concat(F.lit("HTTPS://SHOP.example.org/p/"), "p_partkey").alias("url"), "p_brand"
    )
    return offers.offers_for_watches(watches, rows).select(
        F.col("l_partkey").alias("offer_key"), "observed_at", *t.order_of_lines(), "price", "p_brand"
    )


@query(f"""WITH {SQL_OBS},
e AS (SELECT offer_key, l_suppkey, min(price) AS price FROM obs WHERE l_returnflag = 'A' GROUP BY ALL),
v AS (SELECT offer_key, l_suppkey, min(price) AS price FROM obs WHERE l_returnflag <> 'A' GROUP BY ALL)
SELECT offer_key, l_suppkey, least(e.price, v.price) AS price,
  CASE WHEN e.price IS NOT NULL AND (v.price IS NULL OR e.price <= v.price) THEN 'embedded' ELSE 'visible' END AS title
FROM e FULL JOIN v USING (offer_key, l_suppkey)""")
def lower_of(spark, folder):
    rows = t.observations(spark, folder).groupBy("offer_key", "l_suppkey", (F.col("l_returnflag") == "A").alias("a"))
    best = rows.agg(F.min("price").alias("price")).withColumn("seller", F.lit(""))
    e = best.where("a").withColumn("title", F.lit("embedded"))
    v = best.where("not a").withColumn("title", F.lit("visible"))
    return offers.lower_of(e, v, ["offer_key", "l_suppkey"]).select("offer_key", "l_suppkey", "price", "title")


@query("""WITH c AS (SELECT p_partkey AS card_pos, CASE WHEN p_size % 3 > 0 THEN CAST(p_retailprice AS DECIMAL(18,2)) END AS price,
    p_size % 5 = 0 AS is_warehouse, p_size % 4 > 0 AS matches FROM part),
d AS (SELECT l_partkey AS card_pos, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_suppkey) AS detail_pos,
    CAST(l_extendedprice AS DECIMAL(18,2)) AS price, l_returnflag = 'R' AS is_warehouse, CAST(nullif(l_quantity, 1) AS INTEGER) AS stock FROM lineitem)
SELECT card_pos, 0 AS kind, 0 AS detail_pos, price, false AS is_warehouse, CAST(NULL AS INTEGER) AS stock_quantity FROM c WHERE price IS NOT NULL AND NOT is_warehouse
UNION ALL SELECT * FROM (SELECT c.card_pos, 1, d.detail_pos, c.price, false, d.stock FROM c JOIN d USING (card_pos)
  WHERE c.matches AND c.price IS NOT NULL AND NOT d.is_warehouse AND d.stock IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY c.card_pos ORDER BY d.detail_pos) = 1)
UNION ALL SELECT c.card_pos, 2, d.detail_pos, d.price, true, d.stock FROM c JOIN d USING (card_pos) WHERE c.matches AND c.price IS NOT NULL AND d.is_warehouse
UNION ALL SELECT c.card_pos, 3, d.detail_pos, d.price, d.is_warehouse, d.stock FROM c JOIN d USING (card_pos) WHERE c.matches AND c.price IS NULL""")
def enrich_cards(spark, folder):
    from pyspark.sql import Window

    url = lambda k: F.concat(F.lit("https://www.amazon.com.tr/dp/"), F.col(k))
    cards = t.load(spark, folder, "part").select(
        F.col("p_partkey").alias("card_pos"), F.col("p_name").alias("title"), url("p_partkey").alias("url"),
        F.when(F.col("p_size") % 3 > 0, F.col("p_retailprice").cast(t.MONEY)).alias("price"),
        (F.col("p_size") % 5 == 0).alias("is_warehouse"), (F.col("p_size") % 4 > 0).alias("matches"),
    )
    order = Window.partitionBy("l_partkey").orderBy("observed_at", *t.order_of_lines())
    details = offer_rows(spark, folder).select(
        url("l_partkey").alias("card_url"), F.row_number().over(order).alias("detail_pos"), F.lit("").alias("title"),
        F.lit("").alias("url"), "price", "is_warehouse", "stock_quantity",
    )
    return offers.enrich_cards(cards, details).drop("title", "url")


# --- summary ----------------------------------------------------------------
def summary_rows(spark, folder):
    """One row per part: its last observation, its bounds and its seller."""
    current = history.current_offers(t.observations(spark, folder))
    sellers = t.load(spark, folder, "supplier").select("s_suppkey", F.col("s_name").alias("seller"))
    rows = current.join(sellers, current.l_suppkey == sellers.s_suppkey).select(
        "offer_key", "seller", F.col("p_name").alias("product_title"), "l_suppkey", "l_returnflag", "observed_at", "price",
        "target_price", "min_price", "max_price",
        F.concat(F.lit("https://shop.example.org/p/"), "offer_key").alias("product_url"),
        F.lit("").alias("tracking_id"), (F.col("l_returnflag") == "R").alias("is_warehouse"), F.col("offer_key").alias("seq"),
    )
    return summary.with_difference(rows).withColumn("difference", F.col("difference").cast(t.MONEY))


SUMMARY_COLUMNS = ["offer_key", "seller", "product_title", "price", "target_price", "difference", "min_price", "max_price",
                   "is_target_hit"]


@query(f"""WITH {SQL_SUMMARY} SELECT {', '.join(SUMMARY_COLUMNS)},
  row_number() OVER (ORDER BY lower(seller), abs(difference), price, offer_key) AS no FROM summ""")
def summary_numbered(spark, folder):
    rows = summary_rows(spark, folder).select(*SUMMARY_COLUMNS, "seq")
    return summary.number_rows(rows, summary.summary_order()).drop("seq")


@query(f"WITH {SQL_SUMMARY} SELECT {', '.join(SUMMARY_COLUMNS)} FROM summ")
def summary_sorted(spark, folder):
    return summary.sort_summary(summary_rows(spark, folder)).select(*SUMMARY_COLUMNS)


@query(f"""WITH {SQL_SUMMARY} SELECT count(*) AS row_count, count_if(is_target_hit) AS deal_count,
  count_if(NOT is_target_hit) AS above_count, count_if(l_returnflag <> 'R') AS new_count, count_if(l_returnflag = 'R') AS used_count,
  (SELECT count(*) FROM lineitem WHERE l_linestatus = 'O' AND l_returnflag = 'A') AS stock_count FROM summ""")
def summary_counts(spark, folder):
    gaps = t.lines(spark, folder).where("l_linestatus = 'O' and l_returnflag = 'A'")
    return summary.summary_counts(summary_rows(spark, folder), gaps)


@query("SELECT count(*) - count(DISTINCT (l_partkey, l_suppkey, l_returnflag = 'R')) AS duplicates FROM lineitem")
def duplicate_count(spark, folder):
    rows = offer_rows(spark, folder)
    return summary.duplicate_count(rows, offers.dedup_offers(rows))


@query(f"""WITH {SQL_SUMMARY} SELECT offer_key, seller, product_title, price, difference FROM summ WHERE is_target_hit""")
def deals(spark, folder):
    return summary.deals(summary_rows(spark, folder)).select("offer_key", "seller", "product_title", "price", "difference")


def merge_inputs(spark, folder):
    rows = offer_rows(spark, folder).withColumn(
        "product_url", F.concat(F.lit("https://shop.example.org/p/"), "l_partkey", F.lit("?s="), "l_suppkey")
    ).withColumn("tracking_id", F.lit(""))
    late = F.col("observed_at") >= F.lit(t.FIRST_HALF).cast("timestamp")
    gap = (F.col("l_partkey") % 7 == 0) & ~F.col("is_warehouse")
    prev, fresh = offers.dedup_offers(rows.where(~late & ~gap)), offers.dedup_offers(rows.where(late & ~gap))
    cut = lambda df: df.select("tracking_id", "product_url", "is_warehouse", "price", "l_partkey", "l_suppkey")
    stock = lambda df: df.where(gap).select("product_url", "l_partkey", "l_suppkey").distinct()
    removed = rows.where("l_suppkey % 10 = 0").select(
        urls.row_identity(F.col("tracking_id"), F.col("product_url"), F.col("is_warehouse")).alias("identity")
    ).distinct()
    return cut(prev), cut(fresh), stock(rows.where(~late)), stock(rows.where(late)), removed


SQL_MERGE = f"""{SQL_OFFERS},
base AS (SELECT *, observed_at >= TIMESTAMP '{t.FIRST_HALF}' AS late, l_partkey % 7 = 0 AND NOT is_warehouse AS gap FROM off),
p AS (SELECT l_partkey, l_suppkey, is_warehouse, min(price) AS price FROM base WHERE NOT late AND NOT gap GROUP BY ALL),
fr AS (SELECT l_partkey, l_suppkey, is_warehouse, min(price) AS price FROM base WHERE late AND NOT gap GROUP BY ALL),
ps AS (SELECT DISTINCT l_partkey, l_suppkey FROM base WHERE NOT late AND gap),
fs AS (SELECT DISTINCT l_partkey, l_suppkey FROM base WHERE late AND gap)"""


@query(f"""WITH {SQL_MERGE} SELECT * FROM p WHERE (l_partkey, l_suppkey, is_warehouse) NOT IN (SELECT (l_partkey, l_suppkey, is_warehouse) FROM fr)
  AND (l_partkey, l_suppkey) NOT IN (SELECT (l_partkey, l_suppkey) FROM fs) AND l_suppkey % 10 <> 0 UNION ALL SELECT * FROM fr""")
def merge_summary(spark, folder):
    rows, _ = summary.merge_summary(*merge_inputs(spark, folder))
    return rows.select("l_partkey", "l_suppkey", "is_warehouse", "price")


@query(f"""WITH {SQL_MERGE} SELECT * FROM ps WHERE (l_partkey, l_suppkey) NOT IN (SELECT (l_partkey, l_suppkey) FROM fr)
  AND (l_partkey, l_suppkey) NOT IN (SELECT (l_partkey, l_suppkey) FROM fs) UNION ALL SELECT * FROM fs""")
def merge_stock(spark, folder):
    _, stock = summary.merge_summary(*merge_inputs(spark, folder))
    return stock.select("l_partkey", "l_suppkey")


def grouped(spark, folder):
    """Summary rows with a rough target, so that parts of one seller share it."""
    rows = summary_rows(spark, folder).withColumns(
        {
            "seller": F.concat(F.lit("Seller "), (F.col("l_suppkey") % 5).cast("string")),
            "target_price": (F.floor(F.col("target_price") / 5000) * 5000).cast(t.MONEY),
            "search_group": F.lit(""),
            "search_group_label": F.lit(""),
        }
    )
    return summary.infer_groups(rows)


SQL_GROUPS = f"""{SQL_SUMMARY},
g AS (SELECT offer_key, 'Seller ' || (l_suppkey % 5) AS seller, product_title, difference,
        CAST(floor(target_price / 5000) * 5000 AS BIGINT) AS target FROM summ),
gc AS (SELECT *, count(*) OVER (PARTITION BY seller, target, product_title) AS n FROM g),
gk AS (SELECT *, CASE WHEN n > 1 THEN 'inferred_variant_group_' || replace(lower(seller), ' ', '_') || '_' ||
         replace(product_title, ' ', '_') || '_' || target END AS group_key FROM gc)"""


@query(f"WITH {SQL_GROUPS} SELECT offer_key, seller, group_key, CASE WHEN n > 1 THEN product_title END AS group_label FROM gk")
def infer_groups(spark, folder):
    return grouped(spark, folder).select("offer_key", "seller", "group_key", "group_label")


@query(f"""WITH {SQL_GROUPS} SELECT offer_key, seller, group_key, CASE WHEN n > 1 THEN product_title END AS group_label,
  CASE WHEN n > 1 THEN n END AS group_size FROM gk""")
def collapse_groups(spark, folder):
    rows = summary.sort_groups(summary.collapse_groups(grouped(spark, folder)))
    return rows.select("offer_key", "seller", "group_key", "group_label", "group_size")


@query("""SELECT s_name AS seller, l_partkey, l_orderkey, l_linenumber, CAST(l_shipdate AS TIMESTAMP) AS observed_at,
  count(*) OVER (PARTITION BY s_name) AS group_size
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_linestatus = 'O' AND l_returnflag = 'A'""")
def stock_by_seller(spark, folder):
    sellers = t.load(spark, folder, "supplier").select("s_suppkey", F.col("s_name").alias("seller"))
    rows = t.lines(spark, folder).where("l_linestatus = 'O' and l_returnflag = 'A'")
    gaps = rows.join(sellers, rows.l_suppkey == sellers.s_suppkey).select(
        "seller", "l_partkey", "l_orderkey", "l_linenumber", "observed_at",
        F.col("l_partkey").cast("string").alias("product_title"), F.col("l_orderkey").cast("string").alias("product_url"),
    )
    return summary.stock_by_seller(gaps).drop("product_title", "product_url")


@query("""WITH st AS (SELECT *, l_partkey % 50 AS src, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC) AS rn
  FROM lineitem WHERE l_partkey % 50 % 2 = 0 OR l_partkey % 50 % 5 = 0),
first AS (SELECT src, min((l_orderkey, l_linenumber, l_partkey, l_suppkey)) AS pos FROM st GROUP BY 1),
lab AS (SELECT src, p_name AS label FROM first JOIN part ON p_partkey = struct_extract_at(pos, 3))
SELECT s_suppkey, CASE WHEN rn IS NOT NULL THEN 'state_result_group_zara_https_www_zara_com_tr_w' || st.src ELSE '' END AS search_group,
  coalesce(lab.label, '') AS search_group_label
FROM supplier LEFT JOIN st ON l_suppkey = s_suppkey AND rn = 1 LEFT JOIN lab ON lab.src = st.src""")
def attach_groups(spark, folder):
    names = t.parts(spark, folder).select("p_partkey", F.col("p_name").alias("title"))
    rows = t.lines(spark, folder)
    source = F.col("l_partkey") % 50
    state = rows.join(names, rows.l_partkey == names.p_partkey).select(
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("seq"), F.lit("").alias("site"),
        F.concat(F.lit("https://www.zara.com/tr/w"), source).alias("configured_url"),
        F.concat(F.lit("https://shop.example.org/o/"), "l_suppkey").alias("url"), F.lit("").alias("watch_name"), "title",
        (source % 5 == 0).alias("include_variations"), F.lit("").alias("search_group"), F.lit("").alias("search_group_label"),
    )
    number = F.col("p_partkey") % 50
    cards = t.parts(spark, folder).select(F.concat(F.lit("https://www.zara.com/tr/w"), number, F.lit("#top")).alias("url"),
                                          (number % 2 == 0).alias("include_variations"))
    view = t.load(spark, folder, "supplier").select(
        "s_suppkey", F.concat(F.lit("https://shop.example.org/o/"), "s_suppkey", F.lit("/#x")).alias("product_url"),
        F.lit("").alias("search_group"), F.lit("").alias("search_group_label"),
    )
    return summary.attach_groups(view, state, cards).select("s_suppkey", "search_group", "search_group_label")


SQL_SOURCE = """CASE WHEN l_suppkey % 3 = 2 OR l_returnflag = 'N' THEN 2 WHEN l_suppkey % 3 = 1 OR l_returnflag = 'A' THEN 1 ELSE 0 END"""


@query(f"""WITH f AS (SELECT l_suppkey, arg_min(p_name, ({SQL_SOURCE}, l_orderkey, l_linenumber, l_partkey)) AS title
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
SELECT s_suppkey AS card_pos, CASE WHEN s_suppkey % 5 = 0 THEN s_name ELSE coalesce(title, 'O' || s_suppkey) END AS display_name
FROM supplier LEFT JOIN f ON l_suppkey = s_suppkey""")
def learned_titles(spark, folder):
    """Every line is known from one of the three sources."""
    link = lambda k: F.concat(F.lit("https://shop.example.org/o"), F.col(k))
    cards = t.load(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("card_pos"), F.when(F.col("s_suppkey") % 5 == 0, F.col("s_name")).alias("name"),
        F.array(F.concat(link("s_suppkey"), F.lit("?ref=x"))).alias("urls"),
    )
    names = t.parts(spark, folder).select("p_partkey", F.col("p_name").alias("product_title"))
    rows = t.lines(spark, folder)
    known = rows.join(names, rows.l_partkey == names.p_partkey).select(
        F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("seq"), link("l_suppkey").alias("product_url"), "product_title",
        F.expr(SQL_SOURCE).alias("source"),
    )
    state = known.where("source = 2").select("seq", F.col("product_url").alias("configured_url"), F.col("product_title").alias("title"))
    return summary.learned_titles(cards, known.where("source = 0"), known.where("source = 1"), state)


@query("""WITH st AS (SELECT l_partkey, CAST(arg_max(l_extendedprice, (l_shipdate, l_orderkey, l_linenumber, l_suppkey)) AS DECIMAL(18,2)) AS price,
  CAST(min(l_extendedprice) AS DECIMAL(18,2)) AS lo, CAST(max(l_extendedprice) AS DECIMAL(18,2)) AS hi FROM lineitem GROUP BY 1),
w AS (SELECT p_partkey, p_partkey % 100 AS grp, CAST(CAST(p_retailprice AS DECIMAL(18,2)) * 20 AS DECIMAL(18,2)) AS target FROM part)
SELECT p_partkey, l_partkey, price,
  CASE WHEN price > target * 5 AND price - target >= 50000 THEN lo ELSE least(lo, price) END AS min_price,
  CASE WHEN price > target * 5 AND price - target >= 50000 THEN hi ELSE greatest(hi, price) END AS max_price
FROM w JOIN st ON l_partkey IN (p_partkey, p_partkey + 1)""")
def carry_not_due(spark, folder):
    pos = F.struct("observed_at", *t.order_of_lines())
    state = t.lines(spark, folder).groupBy("l_partkey").agg(
        F.max_by("price", pos).alias("last_price"), F.min("price").alias("min_price"), F.max("price").alias("max_price")
    ).select(
        F.col("l_partkey").cast("string").alias("offer_key"), "last_price", "min_price", "max_price",
        F.lit("").alias("title"), F.lit("").alias("url"), F.lit(False).alias("is_warehouse"),
    )
    watches = t.parts(spark, folder).select(
        F.col("p_partkey").cast("string").alias("watch_key"), "target_price", F.col("p_name").alias("name"),
        F.lit("org").alias("site"), F.lit("").alias("tracking_id"), F.lit("u").alias("url"), F.lit("S").alias("seller"),
    )
    kept = watches.select("watch_key", F.array("watch_key", (F.col("watch_key").cast("bigint") + 1).cast("string")).alias("offer_keys"))
    rows = offers.carry_not_due(watches, kept, state)
    return rows.select(
        F.col("watch_key").cast("bigint").alias("p_partkey"), F.col("offer_key").cast("bigint").alias("l_partkey"),
        "price", "min_price", "max_price",
    )


@query("""WITH m AS (SELECT max(ts) AS as_of FROM events), u AS (SELECT user_id, max(ts) AS last_checked_at FROM events GROUP BY 1)
SELECT user_id, last_checked_at, epoch_us(as_of) - epoch_us(last_checked_at) >= (60 + user_id) * 60000000 AS due FROM u, m""")
def due_watches(spark, folder):
    events = t.load(spark, folder, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    as_of = events.agg(F.max("ts").alias("x")).scalar()
    state = events.groupBy(F.col("user_id").alias("watch_key")).agg(F.max("ts").alias("last_checked_at"))
    watches = state.select("watch_key", (F.col("watch_key") + 60).alias("check_interval_minutes"))
    return offers.due_watches(watches, state, as_of).select(
        F.col("watch_key").alias("user_id"), "last_checked_at", "due"
    )


# --- matching ---------------------------------------------------------------
@query("""WITH x AS (SELECT l_partkey, l_orderkey, l_linenumber, l_suppkey, CAST(l_shipdate AS TIMESTAMP) AS observed_at,
  CAST(l_extendedprice AS DECIMAL(18,2)) AS price, CAST(CAST(p_retailprice AS DECIMAL(18,2)) * 2 AS DECIMAL(18,2)) AS lo, p_name
  FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT l_partkey, l_orderkey, l_linenumber, l_suppkey, observed_at, price,
  CASE WHEN price < lo THEN 'minimum fiyat filtresi: ' || replace(format('{:,}', CAST(trunc(price) AS BIGINT)), ',', '.') || ' TL < '
         || replace(format('{:,}', CAST(trunc(lo) AS BIGINT)), ',', '.') || ' TL'
       WHEN contains(p_name, 'rod') THEN 'hariç tut filtresi: rod' WHEN contains(p_name, 'old') THEN 'hariç tut filtresi: OLD' END AS reason FROM x""")
def exclude_offers(spark, folder):
    watch = t.parts(spark, folder)
    rows = t.lines(spark, folder, spread=True)
    joined = rows.join(watch, rows.l_partkey == watch.p_partkey).withColumns(
        {"title": F.col("p_name"), "excluded_terms": F.array(F.lit("rod"), F.lit("OLD"))}
    )
    return matching.exclude_offers(joined, keep_rejected=True).select(
        "l_partkey", *t.order_of_lines(), "observed_at", "price", "reason"
    )


def _phrase_values() -> str:
    return ", ".join(f"('w{i}', '{p}', {len(p.split())})" for i, p in enumerate(t.PHRASES))


@query(f"""WITH w(watch_key, phrase, spec) AS (VALUES {_phrase_values()}),
m AS (SELECT p_partkey AS result_id, watch_key, spec, max(spec) OVER (PARTITION BY p_partkey) AS top
      FROM part JOIN w ON contains(' ' || p_name || ' ', ' ' || phrase || ' '))
SELECT result_id, watch_key, spec AS specificity FROM m WHERE spec = top""")
def assign_most_specific(spark, folder):
    watches = spark.createDataFrame([(f"w{i}", p) for i, p in enumerate(t.PHRASES)], "watch_key string, name string")
    results = t.parts(spark, folder).select(F.col("p_partkey").alias("result_id"), F.col("p_name").alias("title"))
    return matching.assign_most_specific(results, watches).select("result_id", "watch_key", "specificity")


SQL_FOLD = "replace(strip_accents(replace(lower(text), 'ß', 'ss')), 'ı', 'i')"
SQL_KEYWORD = "CASE " + " ".join(f"WHEN contains(f, '{k}') THEN '{k}'" for k in t.KEYWORDS) + " END"
SQL_HITS = f"""fold AS (SELECT doc_id AS message_id, source AS channel, to_timestamp(1704067200 + doc_id * 60)::TIMESTAMP AS ts, text, {SQL_FOLD} AS f FROM documents),
hits AS (SELECT *, {SQL_KEYWORD} AS keyword FROM fold WHERE {SQL_KEYWORD} IS NOT NULL AND NOT contains(f, '@'))"""


@query(f"WITH {SQL_HITS} SELECT message_id, {SQL_KEYWORD} AS keyword FROM fold WHERE {SQL_KEYWORD} IS NOT NULL")
def match_keywords(spark, folder):
    return matching.match_keywords(t.messages(spark, folder), t.KEYWORDS).select("message_id", "keyword")


@query(f"WITH {SQL_HITS} SELECT message_id FROM fold WHERE NOT contains(f, '@')")
def drop_excluded(spark, folder):
    return matching.drop_excluded(t.messages(spark, folder), t.EXCLUDED).select("message_id")


def hits(spark, folder):
    return matching.keyword_hits(t.messages(spark, folder), t.KEYWORDS, t.EXCLUDED)


@query(f"WITH {SQL_HITS} SELECT message_id, channel, keyword FROM hits")
def keyword_hits(spark, folder):
    return hits(spark, folder).select("message_id", "channel", "keyword")


@query(rf"""WITH {SQL_HITS} SELECT message_id, channel, keyword, ts, left(trim(regexp_replace(text, '[\s\x85\xA0]+', ' ', 'g')), 180) AS message
FROM hits QUALIFY row_number() OVER (PARTITION BY channel ORDER BY ts DESC, message_id DESC) <= 5""")
def recent_notifications(spark, folder):
    rows = health.recent_notifications(hits(spark, folder), 5, ["channel"])
    return rows.select("message_id", "channel", "keyword", "ts", "message")


@query(f"""WITH {SQL_HITS}, m AS (SELECT channel, count(*) AS messages, max(ts) AS last_check FROM fold GROUP BY 1),
a AS (SELECT channel, count(*) AS notifications, count(DISTINCT keyword) AS keywords, max(ts) AS last_notification FROM hits GROUP BY 1)
SELECT channel, messages, last_check, coalesce(notifications, 0) AS notifications, coalesce(keywords, 0) AS keywords, last_notification
FROM m LEFT JOIN a USING (channel)""")
def channel_stats(spark, folder):
    return health.channel_stats(t.messages(spark, folder), hits(spark, folder)).select(
        "channel", "messages", "last_check", "notifications", "keywords", "last_notification"
    )


@query("SELECT doc_id AS message_id FROM documents ORDER BY doc_id DESC LIMIT 5000")
def keep_last(spark, folder):
    return health.keep_last(t.messages(spark, folder).select("message_id"), [F.col("message_id").desc()])


@query("""SELECT u.conv_id AS chat_id, u.turn AS message_id, p.turn AS source_message_id FROM conversations u JOIN conversations p
ON u.conv_id = p.conv_id AND p.turn = u.turn - 1 WHERE u.role = 'user' AND p.role = 'assistant'""")
def match_replies(spark, folder):
    turns = t.load(spark, folder, "conversations").withColumn("ts", F.timestamp_seconds(F.lit(1_704_067_200) + F.col("turn") * 60))
    replies = turns.where("role = 'user'").select(
        F.col("conv_id").alias("chat_id"), F.col("turn").alias("message_id"), "ts", (F.col("turn") - 1).alias("reply_to_id")
    )
    prompts = turns.where("role = 'assistant'").select(
        F.col("conv_id").alias("chat_id"), F.col("turn").alias("source_message_id"),
        F.lit(None).cast("bigint").alias("prompt_message_id"), F.col("ts").alias("created_at"),
    )
    return health.match_replies(replies, prompts).select("chat_id", "message_id", "source_message_id")


# --- health -----------------------------------------------------------------
def hourly(spark, folder):
    hour = F.date_trunc("hour", F.col("ts").cast("timestamp"))
    return t.load(spark, folder, "events").groupBy(F.col("event_type").alias("tracker"), hour.alias("cycle_at")).agg(
        (F.count(F.lit(1)) * 10).alias("row_count")
    ).select("tracker", "cycle_at", F.unix_seconds("cycle_at").alias("seq"), "row_count",
             F.floor((F.dayofmonth("cycle_at") - 1) / 10).cast("string").alias("signature"))


SQL_DROP = "(b.base > 0 AND b.base - c.row_count >= greatest(6, (b.base + 2) // 3))"
SQL_STREAK = f"(CASE WHEN c.signature <> b.signature OR NOT {SQL_DROP} THEN 0 ELSE b.streak + 1 END)"
SQL_ALERT = f"""({SQL_STREAK} >= 5 AND hour(c.cycle_at) >= 8 AND hour(c.cycle_at) < 22
  AND (b.last_alert IS NULL OR c.cycle_at - b.last_alert >= INTERVAL 1 HOUR))"""


@query(f"""WITH RECURSIVE h AS (SELECT event_type AS tracker, date_trunc('hour', ts) AS cycle_at, count(*) * 10 AS row_count,
    (day(date_trunc('hour', ts)) - 1) // 10 AS signature FROM events GROUP BY ALL),
c AS (SELECT *, row_number() OVER (PARTITION BY tracker ORDER BY cycle_at) AS rn FROM h),
b AS (SELECT tracker, rn, cycle_at, row_count, signature, row_count AS base, 0 AS streak, false AS alert, CAST(NULL AS TIMESTAMP) AS last_alert FROM c WHERE rn = 1
  UNION ALL
  SELECT c.tracker, c.rn, c.cycle_at, c.row_count, c.signature,
    CASE WHEN c.signature = b.signature AND {SQL_DROP} THEN b.base ELSE c.row_count END, {SQL_STREAK}, {SQL_ALERT},
    CASE WHEN {SQL_ALERT} THEN c.cycle_at ELSE b.last_alert END
  FROM b JOIN c ON c.tracker = b.tracker AND c.rn = b.rn + 1)
SELECT tracker, cycle_at, row_count, base AS expected, CAST(streak AS BIGINT) AS streak, alert FROM b""")
def row_count_alerts(spark, folder):
    return health.row_count_alerts(hourly(spark, folder), zone="UTC").select(
        "tracker", "cycle_at", "row_count", "expected", "streak", "alert"
    )


def failure_events(spark, folder):
    return t.failures(spark, folder).select(
        F.lit("all").alias("tracker"), F.date_trunc("hour", "created_at").alias("cycle_at"),
        F.concat(F.lit("page "), F.col("user_id") % 40).alias("page"), F.lit(1).alias("failed_links"), F.col("event_id").alias("seq"),
    )


SQL_TOTALS = """tot AS (SELECT date_trunc('hour', ts) AS cycle_at, count(DISTINCT user_id % 40) AS pages, count(*) AS links
  FROM events WHERE event_type = 'error' GROUP BY 1)"""


@query(f"WITH {SQL_TOTALS} SELECT cycle_at, pages, links FROM tot")
def search_failure_totals(spark, folder):
    return health.search_failure_totals(failure_events(spark, folder), ["cycle_at"])


@query(f"WITH {SQL_TOTALS} SELECT cycle_at, pages, links, (pages >= 4 OR links >= 6) AND hour(cycle_at) BETWEEN 8 AND 21 AS alert FROM tot")
def search_failure_alerts(spark, folder):
    return health.search_failure_alerts(failure_events(spark, folder), zone="UTC").select("cycle_at", "pages", "links", "alert")


@query("""WITH e AS (SELECT date_trunc('day', ts) AS cycle_at, user_id % 40 AS page, event_id,
  row_number() OVER (PARTITION BY date_trunc('day', ts) ORDER BY event_id) AS rn, count(*) OVER (PARTITION BY date_trunc('day', ts)) AS n
  FROM events WHERE event_type = 'error')
SELECT cycle_at, string_agg('- page ' || page || ': erisim hatasi, link=1', ';' ORDER BY rn) ||
  CASE WHEN max(n) > 8 THEN ';- +' || (max(n) - 8) || ' ek arama kaydi' ELSE '' END AS lines FROM e WHERE rn <= 8 GROUP BY 1""")
def failure_lines(spark, folder):
    events = failure_events(spark, folder).withColumn("cycle_at", F.date_trunc("day", "cycle_at"))
    return health.failure_lines(events, ["cycle_at"]).withColumn("lines", F.array_join("lines", ";"))


@query("""SELECT user_id AS watch_key, ts AS observed_at, event_id AS seq FROM events WHERE event_type = 'error' AND hour(ts) = 11
QUALIFY row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) = 1""")
def daily_error_notice(spark, folder):
    errors = t.failures(spark, folder).select(
        F.col("user_id").alias("watch_key"), F.col("created_at").alias("observed_at"), F.col("event_id").alias("seq")
    )
    return health.daily_error_notice(errors, zone="UTC")


@query("""SELECT count(*) AS errors FROM events WHERE event_type = 'error' AND ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR""")
def rolling_error_count(spark, folder):
    as_of = t.load(spark, folder, "events").agg(F.max("ts").cast("timestamp").alias("x")).scalar()
    return health.error_count(t.failures(spark, folder), as_of)


def user_state(spark, folder):
    e = t.load(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    last = e.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("m"))
    link = F.concat(F.lit("https://shop.example.org/u/"), "user_id")
    return last.select(
        F.concat(F.lit("state "), "user_id").alias("state_key"), "user_id", F.col("user_id").alias("seq"), F.lit("org").alias("site"),
        F.lit("").alias("url"), link.alias("configured_url"), F.col("m.ts").alias("last_checked_at"),
        F.when(F.col("m.event_type") == "error", F.concat(F.lit("timeout | "), link)).alias("last_error"),
    )


SQL_LAST = """last AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1),
m AS (SELECT max(ts) AS as_of FROM events)"""


@query(f"""WITH {SQL_LAST} SELECT max(ts) AS last_check, max(ts) + INTERVAL 60 SECOND AS next_check,
  count_if(event_type = 'error' AND ts >= as_of - INTERVAL 24 HOUR) AS errors FROM last, m""")
def health_summary(spark, folder):
    as_of = t.load(spark, folder, "events").agg(F.max("ts").cast("timestamp").alias("x")).scalar()
    return health.health_summary(user_state(spark, folder), as_of)


@query(f"""WITH {SQL_LAST} SELECT user_id AS seq, 'Ürün kontrolü: Watch ' || user_id AS title,
  'Takip edilen: Watch ' || user_id || ' · Aranan keyword: Watch ' || user_id AS meta, 'timeout' AS message,
  'https://shop.example.org/u/' || user_id AS url FROM last, m WHERE event_type = 'error' AND ts >= as_of - INTERVAL 24 HOUR""")
def error_details(spark, folder):
    as_of = t.load(spark, folder, "events").agg(F.max("ts").cast("timestamp").alias("x")).scalar()
    state = user_state(spark, folder)
    links = state.select(
        F.col("user_id").alias("pos"), F.lit("org").alias("site"), F.concat(F.lit("Watch "), "user_id").alias("name"),
        F.col("configured_url").alias("url"),
    )
    return health.error_details(state, links, as_of, limit=None).select("seq", "title", "meta", "message", "url")


# --- links ------------------------------------------------------------------
SQL_CANON = r"""regexp_replace(regexp_extract(url, '^(https?)://', 1) || '://' || lower(regexp_extract(url, '^https?://([^/?#]*)', 1)) ||
  regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/+$', '') || regexp_extract(url, '^[^#?]*(\?[^#]*)', 1)"""


@query(f"SELECT page_id, url, {SQL_CANON} AS canonical FROM pages")
def canonical_urls(spark, folder):
    return t.load(spark, folder, "pages").select("page_id", "url", urls.canonical_url(F.col("url")).alias("canonical"))


@query("""SELECT page_id, url, CASE WHEN contains(h, 'spam-farm') THEN 'spam' WHEN contains(h, '.example.org') THEN 'org'
  WHEN contains(h, '.example.net') THEN 'net' END AS site FROM (SELECT *, lower(regexp_extract(url, '^https?://([^/?#]*)', 1)) AS h FROM pages)""")
def detect_site(spark, folder):
    return t.load(spark, folder, "pages").select("page_id", "url", urls.detect_site(F.col("url"), t.SITES).alias("site"))


@query(r"""SELECT page_id, regexp_extract(url, '^([^?#]*)', 1) AS bare,
  nullif(regexp_extract(url, '[?&]ref=([^&#]*)', 1), '') AS ref FROM pages""")
def query_parts(spark, folder):
    u = F.col("url")
    return t.load(spark, folder, "pages").select(
        "page_id", F.element_at(urls.url_keys(u), -1).alias("bare"), urls.query_value(u, "ref").alias("ref")
    )


# --- money and text ---------------------------------------------------------
@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_shipdate AS TIMESTAMP) AS observed_at,
  CAST(l_extendedprice AS DECIMAL(18,4)) AS tr, CAST(l_extendedprice AS DECIMAL(18,4)) AS en,
  CAST(trunc(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(18,4)) AS dots,
  replace(format('{:,}', CAST(trunc(CAST(l_extendedprice AS DECIMAL(18,2))) AS BIGINT)), ',', '.') || ' TL' AS shown FROM lineitem""")
def money_texts(spark, folder):
    """Prices written in several notations and read back."""
    rows = t.lines(spark, folder, spread=True)
    english = F.format_number("price", 2)
    turkish = F.concat(F.translate(english, ",.", ".,"), F.lit(" TL"))
    shown = money.format_money(F.col("price"), True)
    return rows.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "observed_at", money.parse_money(turkish).alias("tr"),
        money.parse_money(english).alias("en"),
        F.coalesce(money.parse_money(shown), F.lit(0)).cast("decimal(18,4)").alias("dots"), shown.alias("shown"),
    )


@query("""SELECT event_id, CASE WHEN s < 10 THEN 'az önce' WHEN s < 60 THEN s || ' sn önce' WHEN s < 3600 THEN (s // 60) || ' dk önce'
  WHEN s < 86400 THEN (s // 3600) || ' sa önce' ELSE (s // 86400) || ' gün önce' END AS age,
  CASE WHEN r >= 60 THEN (r // 60) || ' dk ' || (r % 60) || ' sn' ELSE r || ' sn' END AS took
FROM (SELECT event_id, CAST(floor((epoch_us((SELECT max(ts) FROM events)) - epoch_us(ts)) / 1000000) AS BIGINT) AS s, event_id % 500 AS r FROM events)""")
def time_texts(spark, folder):
    e = t.load(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    as_of = e.agg(F.max("ts").alias("x")).scalar()
    return e.select(
        "event_id", dates.relative_time(F.col("ts"), as_of).alias("age"), dates.duration_text(F.col("event_id") % 500).alias("took")
    )


# --- maintenance ------------------------------------------------------------
def kept_state(spark, folder):
    decided = bounded(spark, folder).withColumns(
        {"sent": F.col("price") <= F.col("target_price"), "forced_sent": F.lit(False)}
    )
    return history.state_after(decided)


@query("SELECT count(*) * 4 AS cleared FROM (SELECT DISTINCT l_partkey FROM lineitem JOIN part ON l_partkey = p_partkey)")
def reset_price_history(spark, folder):
    return maintenance.reset_price_history(kept_state(spark, folder), summary_rows(spark, folder))[2]


@query("SELECT count(DISTINCT l_partkey) AS changed FROM lineitem JOIN part ON l_partkey = p_partkey")
def reset_alert_memory(spark, folder):
    return maintenance.reset_alert_memory(kept_state(spark, folder))[1]


@query("""WITH used AS (SELECT DISTINCT l_partkey, l_suppkey, l_returnflag = 'R' AS u FROM lineitem)
SELECT l_partkey AS watch_key, count_if(NOT u) AS kept FROM used GROUP BY 1""")
def purge_condition(spark, folder):
    rows = t.lines(spark, folder).select("l_partkey", "l_suppkey", (F.col("l_returnflag") == "R").alias("is_warehouse")).distinct()
    keyed = rows.withColumns({"offer_key": F.concat_ws("/", "l_partkey", "l_suppkey", "is_warehouse"), "site": F.lit("amazon")})
    watch = keyed.groupBy(F.col("l_partkey").alias("watch_key")).agg(F.collect_set("offer_key").alias("offer_keys"))
    seen = keyed.select(F.lit("Amazon").alias("seller"), "is_warehouse")
    _, state, _, _ = maintenance.purge_condition(keyed, watch, seen, version=0)
    return state.select("watch_key", F.size("offer_keys").cast("bigint").alias("kept"))


@query("""WITH st AS (SELECT l_partkey AS offer_key, CAST(arg_max(l_extendedprice, (l_shipdate, l_orderkey, l_linenumber, l_suppkey)) AS DECIMAL(18,2)) AS last_price
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
SELECT offer_key, last_price, CAST(NULL AS DECIMAL(18,2)) AS min_price, CAST(NULL AS TIMESTAMP) AS max_price_at FROM st""")
def reset_price_history_state(spark, folder):
    state, _, _ = maintenance.reset_price_history(kept_state(spark, folder), summary_rows(spark, folder))
    return state.select("offer_key", "last_price", "min_price", "max_price_at")


@query("""WITH used AS (SELECT DISTINCT l_partkey, l_suppkey, l_returnflag = 'R' AS u FROM lineitem)
SELECT l_partkey, l_suppkey, u AS is_warehouse FROM used WHERE NOT u""")
def purge_condition_offers(spark, folder):
    rows = t.lines(spark, folder).select("l_partkey", "l_suppkey", (F.col("l_returnflag") == "R").alias("is_warehouse")).distinct()
    keyed = rows.withColumns({"offer_key": F.concat_ws("/", "l_partkey", "l_suppkey", "is_warehouse"), "site": F.lit("amazon")})
    watch = keyed.groupBy(F.col("l_partkey").alias("watch_key")).agg(F.collect_set("offer_key").alias("offer_keys"))
    offers_left, _, _, _ = maintenance.purge_condition(keyed, watch, keyed.withColumn("seller", F.lit("Amazon")), version=0)
    return offers_left.select("l_partkey", "l_suppkey", "is_warehouse")
