"""Registered queries over column functions: inputs are texts written from the driver's rows, results are stated in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed
from ..functions import checks, dates, labels, money, text, urls
from ..operators import evidence, maintenance, offers, summary
from . import tables as t
from .queries import query

KEY = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate"
KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]
SQL_PRICE = "CAST(l_extendedprice AS DECIMAL(18,2))"
SQL_WHOLE = f"CAST(trunc({SQL_PRICE}) AS BIGINT)"
SQL_DOTS = f"replace(format('{{:,}}', {SQL_WHOLE}), ',', '.')"
SQL_CENTS = f"lpad(CAST(CAST(({SQL_PRICE} - trunc({SQL_PRICE})) * 100 AS INTEGER) AS VARCHAR), 2, '0')"


def rows_of(spark, folder):
    """lineitem with its price as display text, `12.345,67`, and the number of a case from 0 to 4."""
    price = F.col("l_extendedprice").cast(t.MONEY)
    shown = F.translate(F.format_number(price, 2), ",.", ".,")
    return t.load(spark, folder, "lineitem").withColumns({
        "price": price, "shown": shown, "qty": F.col("l_quantity").cast("int"), "kind": (F.col("l_orderkey") % 5).cast("int")})


def pick(*cases):
    """The case of a row."""
    return F.element_at(F.array(*[c if not isinstance(c, str) else F.lit(c) for c in cases]), F.col("kind") + 1)


@query(f"""SELECT {KEY},
  CASE l_orderkey % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN true ELSE false END AS flag,
  CASE WHEN l_quantity BETWEEN 5 AND 40 THEN CAST(l_quantity AS BIGINT) END AS bounded,
  CASE WHEN l_quantity NOT BETWEEN 5 AND 40 THEN 'adet 5 ile 40 arasında olmalı.' END AS bounded_error,
  CASE l_orderkey % 5 WHEN 0 THEN CAST(l_quantity AS BIGINT) WHEN 2 THEN 7 END AS optional,
  CASE l_orderkey % 5 WHEN 1 THEN 'adet tam sayı olmalı.' WHEN 3 THEN 'adet tam sayı olmalı.' END AS optional_error,
  {SQL_WHOLE} AS form_price, {SQL_DOTS} AS input_text,
  CASE WHEN l_orderkey % 5 IN (0, 3) THEN {SQL_WHOLE} WHEN l_orderkey % 5 = 4 THEN CAST({SQL_PRICE} AS DECIMAL(18,2)) END AS reply,
  {SQL_PRICE} BETWEEN 50 AND 1000000 AS in_range,
  CASE l_orderkey % 5 WHEN 0 THEN 'a,b' WHEN 1 THEN '' WHEN 2 THEN 'x y' WHEN 3 THEN 'a,b,c' ELSE 'q' END AS terms FROM lineitem""")
def form_values(spark, folder):
    rows = rows_of(spark, folder)
    qty = F.col("qty").cast("string")
    bounded = checks.bounded_int(F.concat(F.lit(" "), qty), "adet", 10, 5, 40)
    optional = checks.optional_int(pick(qty, "x", " 7 ", F.concat(qty, F.lit(".5")), ""), "adet")
    whole = F.translate(F.format_number(F.col("price").cast("bigint"), 0), ",", ".")
    reply = money.target_reply(pick(F.concat(whole, F.lit(" TL")), "bilmem", "-5", whole, F.col("shown")))
    return rows.select(
        *KEYS, checks.parse_flag(pick(" True ", "hayır", "1", F.lit(None).cast("string"), "off"), True).alias("flag"),
        bounded["value"].alias("bounded"), bounded["error"].alias("bounded_error"), optional["value"].alias("optional"),
        optional["error"].alias("optional_error"), money.price_from_form(F.concat("shown", F.lit(" TL"))).alias("form_price"),
        money.price_input_text(F.col("shown")).alias("input_text"), reply.cast(t.MONEY).alias("reply"),
        money.price_in_range(F.col("price")).alias("in_range"),
        F.array_join(text.split_terms(pick("a, b", " , ", "x y\n", "a\nb,c", "q,")), ",").alias("terms"))


@query(f"""SELECT {KEY}, {SQL_DOTS} || ' TL' AS plain, '+' || {SQL_DOTS} || ' TL' AS signed, '-' || {SQL_DOTS} || ' TL' AS minus,
  {SQL_DOTS} || ' TL / ' || replace(format('{{:,}}', {SQL_WHOLE} + 1), ',', '.') || ' TL' AS range,
  CASE WHEN l_orderkey % 2 = 0 THEN '+' ELSE '-' END || {SQL_DOTS} || ' TL' AS difference,
  CAST(CASE WHEN l_orderkey % 2 = 0 THEN {SQL_PRICE} ELSE -{SQL_PRICE} END AS DECIMAL(18,2)) AS read_back,
  CASE WHEN length(l_comment_like) > 20 THEN rtrim(substr(l_comment_like, 1, 17)) || '...' ELSE l_comment_like END AS short
FROM (SELECT *, repeat('ab ', CAST(l_quantity AS INTEGER) % 9) || 'z' AS l_comment_like FROM lineitem)""")
def display_texts(spark, folder):
    rows = rows_of(spark, folder)
    shown, price = F.col("shown"), F.col("price")
    signed = F.when(F.col("l_orderkey") % 2 == 0, price).otherwise(-price)
    more = F.translate(F.format_number(price + 1, 2), ",.", ".,")
    words = F.concat(F.expr("repeat('ab ', qty % 9)"), F.lit("z"))
    return rows.select(
        *KEYS, money.display_money(shown).alias("plain"), money.display_money(shown, True).alias("signed"),
        money.display_money(F.concat(F.lit("-"), shown), True).alias("minus"),
        money.display_range(F.concat(shown, F.lit(" / "), more)).alias("range"), money.format_signed(signed, True).alias("difference"),
        money.difference_from_text(F.concat(F.when(signed < 0, "-").otherwise("+"), shown, F.lit(" TL"))).cast(t.MONEY).alias("read_back"),
        text.shorten(words, 20).alias("short"))


@query("""SELECT event_id, CASE event_id % 5 WHEN 3 THEN NULL WHEN 1 THEN date_trunc('second', ts) - INTERVAL 3 HOUR WHEN 4 THEN date_trunc('day', ts)
    ELSE date_trunc('second', ts) END AS parsed,
  strftime(ts + INTERVAL 3 HOUR, '%Y-%m-%d %H:%M:%S') AS local, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S.%fZ') AS utc,
  hour(ts + INTERVAL 3 HOUR) >= 22 OR hour(ts + INTERVAL 3 HOUR) < 8 AS quiet FROM events""")
def iso_times(spark, folder):
    """Times as text: without offset, in another zone, with Z, unreadable, and a bare date."""
    ts = F.col("ts").cast("timestamp")
    iso = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    rows = t.load(spark, folder, "events").withColumn("kind", (F.col("event_id") % 5).cast("int"))
    written = pick(iso, F.concat(iso, F.lit("+03:00")), F.concat(iso, F.lit("Z")), F.concat(iso, F.lit(" x")), F.date_format(ts, "yyyy-MM-dd"))
    return rows.select("event_id", dates.parse_iso(written).alias("parsed"), dates.local_stamp(ts).alias("local"),
                       dates.utc_stamp(F.date_trunc("second", ts)).alias("utc"), dates.quiet_hours(ts).alias("quiet"))


@query("""SELECT page_id, rtrim(url, '.,;)]}') AS first, rtrim(url, '.,;:!?)]}>''"') || ' https://a.example.org/x?y=1 HTTP://B.example.org/z' AS all_links FROM pages""")
def links_in_text(spark, folder):
    rows = t.load(spark, folder, "pages")
    said = F.concat(F.lit("Bak "), F.col("url"), F.lit(", ve (https://a.example.org/x?y=1). Son: HTTP://B.example.org/z!"))
    return rows.select("page_id", urls.first_url(said).alias("first"), F.array_join(urls.all_urls(said), " ").alias("all_links"))


@query("""WITH p AS (SELECT p_partkey, p_partkey % 6 AS k, lpad(CAST(p_partkey AS VARCHAR), 10, '0') AS a, replace(p_name, ' ', '+') AS words, p_name FROM part)
SELECT p_partkey, k IN (0, 4) AS search, k IN (1, 2, 3, 5) AS product,
  CASE k WHEN 0 THEN p_name WHEN 4 THEN p_name ELSE '' END AS name,
  CASE k WHEN 3 THEN 'HB' || p_partkey WHEN 5 THEN 'HB' || p_partkey ELSE '' END AS code,
  CASE k WHEN 1 THEN a WHEN 2 THEN a END AS asin,
  CASE k WHEN 0 THEN 'https://www.amazon.com.tr/s?k=' || words WHEN 4 THEN 'https://www.hepsiburada.com/ara?q=' || words END AS clean,
  CASE k WHEN 1 THEN 'https://www.amazon.com.tr/dp/' || a || '?th=1' WHEN 2 THEN 'https://www.amazon.com.tr/dp/' || a END AS variation,
  CASE WHEN k IN (1, 2) THEN k = 1 END AS same
FROM p""")
def marketplace_links(spark, folder):
    """Search and product links of both marketplaces, with parameters that do and do not matter."""
    a, words = F.lpad(F.col("p_partkey").cast("string"), 10, "0"), F.replace("p_name", F.lit(" "), F.lit("+"))
    rows = t.load(spark, folder, "part").withColumn("kind", (F.col("p_partkey") % 6).cast("int"))
    code = F.col("p_partkey").cast("string")
    rows = rows.withColumn("url", pick(
        F.concat(F.lit("https://www.amazon.com.tr/s?k="), words, F.lit("&ref=nb_sb_noss")),
        F.concat(F.lit("https://www.amazon.com.tr/Urun-Adi/dp/"), a, F.lit("?th=1&tag=x")),
        F.concat(F.lit("https://www.amazon.com.tr/gp/product/"), a, F.lit("/ref=sr_1_1?qid=5")),
        F.concat(F.lit("https://www.hepsiburada.com/urun-adi-p-HB"), code, F.lit("?magaza=S")),
        F.concat(F.lit("https://www.hepsiburada.com/ara?q="), words, F.lit("&sayfa=2")),
        F.concat(F.lit("https://www.hepsiburada.com/urun-adi-pm-hb"), code)))
    u, kind = F.col("url"), F.col("kind")
    other = F.concat(F.lit("https://www.amazon.com.tr/dp/"), a, F.lit("?th=1"))
    return rows.select(
        "p_partkey", urls.is_search_url(u).alias("search"), urls.is_product_url(u).alias("product"), urls.query_name(u).alias("name"),
        urls.product_code(u).alias("code"), urls.asin(u).alias("asin"), F.when(kind.isin(0, 4), urls.clean_search_url(u)).alias("clean"),
        F.when(kind.isin(1, 2), urls.variation_url(u, urls.asin(u))).alias("variation"),
        F.when(kind.isin(1, 2), urls.same_variation(u, other)).alias("same"))


@query("""WITH p AS (SELECT p_partkey, p_name, p_partkey % 5 AS k, str_split(p_name, ' ') AS w FROM part)
SELECT p_partkey, true AS own_name, len(w) >= 2 AS two_words, k = 0 AS with_accent, k NOT IN (1, 2, 4) AS available,
  length(p_name) >= 8 AS good, CASE k WHEN 0 THEN 'Moda' WHEN 1 THEN 'G' WHEN 2 THEN 'Diğer' WHEN 3 THEN 'Moda' ELSE 'Diğer' END AS default_group,
  CASE k WHEN 0 THEN 'Kanal' WHEN 1 THEN 'kullanici' WHEN 2 THEN '-100' ELSE 'Bilinmeyen kanal' END AS channel,
  CASE WHEN k = 1 THEN 'https://t.me/kullanici/' || p_partkey ELSE '' END AS link FROM p""")
def title_tests(spark, folder):
    rows = t.load(spark, folder, "part").withColumn("kind", (F.col("p_partkey") % 5).cast("int"))
    name, none = F.col("p_name"), F.lit(None).cast("string")
    words = F.split(name, " ")
    title = F.concat(F.lit("Yeni! "), F.upper(name), F.lit(" (kutu)"))
    two = F.array_join(F.slice(words, 1, 2), "-")
    username = pick("", "kullanici", "", none, "")
    sites = F.when(F.col("kind").isin(0, 3), F.array(F.lit("amazon"), F.lit("zara"))).otherwise(F.array(F.lit("amazon")))
    return rows.select(
        "p_partkey", text.title_matches(title, name).alias("own_name"), (text.title_matches(title, two) & (F.size(words) >= 2)).alias("two_words"),
        text.title_matches(pick(F.concat(F.lit("Çok şık "), name), name, name, name, name), F.lit("cok SIK")).alias("with_accent"),
        labels.text_available(pick("Stokta", "OutOfStock", "Sold Out!", "son 3 adet", "unavailable")).alias("available"),
        labels.good_title(name).alias("good"), labels.default_group(pick("", " G ", "", "", ""), sites, "Diğer").alias("default_group"),
        text.channel_label(pick("Kanal", "", "", none, ""), username, pick("-100", "-100", "-100", none, none)).alias("channel"),
        text.message_link(username, F.col("p_partkey")).alias("link"))


@query("""SELECT doc_id, doc_id % 5 = 0 AS age, doc_id % 5 = 1 AS bot, doc_id % 5 IN (0, 3) AS normal_empty, doc_id % 5 IN (3, 4) AS missing,
  doc_id % 5 IN (1, 2) AS blocked FROM documents""")
def page_gates(spark, folder):
    """Marks of gates inside whole documents."""
    rows = t.load_spread(spark, folder, "documents", "doc_id").withColumn("kind", (F.col("doc_id") % 5).cast("int"))
    body = F.coalesce("text", F.lit(""))
    mark = pick("18 yaşından büyük müsünüz", "CAPTCHA: are you a robot", "", "Amazon arama sayfasında okunabilir fiyat bulunamadı", "Ürün STOKTA DEĞİL")
    rows = rows.withColumns({"mark": mark, "page": F.concat(body, F.lit(" "), mark, F.lit(" "), body)})
    rows = rows.withColumn("folded", text.fold_text(F.col("page")))
    page, folded = F.col("page"), F.col("folded")
    outcome = F.when(F.col("kind") == 0, "empty_search").otherwise("failed")
    return rows.select(
        "doc_id", checks.age_gate(page, folded).alias("age"), checks.bot_gate(F.lit("amazon"), page, folded).alias("bot"),
        checks.empty_search_is_normal(outcome, page, folded).alias("normal_empty"), checks.missing_price_error(page, folded).alias("missing"),
        checks.block_error(F.when(F.col("kind") == 2, fixed.BLOCK_STATUS[0]).otherwise(200), F.col("mark")).alias("blocked"))


# --- operators over rows ----------------------------------------------------
@query("""WITH p AS (SELECT upper('hb' || l_partkey) AS code, 's' || l_suppkey AS seller, (l_orderkey, l_linenumber, l_suppkey, l_shipdate) AS seq FROM lineitem
  WHERE CAST(l_quantity AS INTEGER) % 3 <> 0)
SELECT code, arg_max(seller, seq) AS seller FROM p GROUP BY 1""")
def seller_lookup(spark, folder):
    """The last seller named for a product code; blank names don't count."""
    rows = t.load(spark, folder, "lineitem").select(
        F.concat(F.lit("hb"), "l_partkey").alias("code"),
        F.when(F.col("l_quantity").cast("int") % 3 == 0, "").otherwise(F.concat(F.lit("s"), "l_suppkey")).alias("seller"),
        F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate").alias("seq"))
    return offers.last_value_by(rows, "code", "seller", "seq").select("code", "seller")


@query(f"""WITH n AS (SELECT l_partkey, {SQL_PRICE} AS price, l_orderkey, l_linenumber, l_suppkey, l_shipdate, l_quantity FROM lineitem WHERE l_returnflag <> 'R'),
u AS (SELECT l_partkey, {SQL_PRICE} AS price, l_orderkey, l_linenumber, l_suppkey, l_shipdate, l_linestatus FROM lineitem WHERE l_returnflag = 'R'),
v AS (SELECT * FROM u WHERE l_linestatus = 'F' AND NOT EXISTS (SELECT 1 FROM n WHERE n.l_partkey = u.l_partkey AND n.price = u.price)
  QUALIFY row_number() OVER (PARTITION BY l_partkey, price ORDER BY l_orderkey, l_linenumber, l_suppkey, l_shipdate) = 1)
SELECT l_partkey AS page_id, l_orderkey, l_linenumber, price, false AS is_warehouse, CAST(l_quantity AS INTEGER) AS stock_quantity FROM n
UNION ALL SELECT l_partkey, l_orderkey, l_linenumber, price, true, NULL FROM v""")
def split_new_used(spark, folder):
    """Returned lines are used offers; half of them lack the wording and don't count."""
    rows = t.load(spark, folder, "lineitem").select(
        F.col("l_partkey").alias("page_id"), F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate").alias("seq"), F.lit("t").alias("title"),
        F.col("l_extendedprice").cast(t.MONEY).alias("price"), F.col("l_quantity").cast("int").alias("stock_quantity"), "l_returnflag",
        F.when(F.col("l_linestatus") == "F", "Amazon Depo, kullanılmış ürün").otherwise("Amazon, kullanılmış").alias("text"))
    used = rows.where("l_returnflag = 'R'").select("page_id", "seq", "title", "text", "price")
    found = evidence.split_new_used(rows.where("l_returnflag <> 'R'").select("page_id", "seq", "title", "price", "stock_quantity"), used)
    return found.select("page_id", "seq.l_orderkey", "seq.l_linenumber", "price", "is_warehouse", "stock_quantity")


SQL_CONTEXT = "CASE WHEN l_orderkey % 7 = 0 THEN 'member' WHEN l_orderkey % 7 = 1 THEN 'ref' WHEN l_orderkey % 7 = 2 THEN 'noise' ELSE 'plain' END"


@query(f"""WITH e AS (SELECT l_partkey, l_suppkey, {SQL_PRICE} AS price, {SQL_CONTEXT} AS c FROM lineitem),
r AS (SELECT * FROM e WHERE c <> 'noise' AND price BETWEEN 50 AND 1000000),
g AS (SELECT l_partkey, l_suppkey, max(CASE WHEN c = 'ref' THEN price END) AS top, min(CASE WHEN c = 'member' THEN price END) AS mp FROM r GROUP BY ALL)
SELECT l_partkey, l_suppkey, coalesce(any_value(mp), min(price)) AS price FROM r JOIN g USING (l_partkey, l_suppkey)
WHERE top IS NULL OR c = 'member' OR price >= top * 0.5 GROUP BY ALL""")
def reference_floor(spark, folder):
    """Member, reference, instalment and plain prices of a seller: noise goes, member prices win, rows far under the reference go."""
    context = F.expr(SQL_CONTEXT)
    words = F.when(context == "member", fixed.MEMBER_WORDS[0]).when(context == "ref", fixed.REFERENCE_PRICE_NAMES[0]).when(
        context == "noise", "9 TAKSİT ile").otherwise("fiyat")
    rows = t.load(spark, folder, "lineitem").select("l_partkey", "l_suppkey", F.col("l_extendedprice").cast(t.MONEY).alias("price"), words.alias("context"))
    return evidence.reference_floor(evidence.drop_noise_prices(rows), ["l_partkey", "l_suppkey"])


@query("""SELECT p_partkey AS card_pos, CASE WHEN p_partkey % 4 = 1 THEN 'yeni' ELSE p_name END AS name,
  CASE WHEN p_partkey % 4 = 1 THEN CAST(p_size + 1 AS INTEGER) ELSE CAST(p_size AS INTEGER) END AS size FROM part WHERE p_partkey % 4 <> 2
UNION ALL SELECT (SELECT max(p_partkey) FROM part) + 1 + s_suppkey, s_name, NULL FROM supplier""")
def apply_watch_changes(spark, folder):
    """A quarter of the cards is updated, a quarter deleted, and every supplier adds one."""
    cards = t.load(spark, folder, "part").select(F.col("p_partkey").cast("int").alias("card_pos"), F.col("p_name").alias("name"), F.col("p_size").cast("int").alias("size"))
    edits = cards.where("card_pos % 4 in (1, 2)").select(
        F.when(F.col("card_pos") % 4 == 1, "update").otherwise("delete").alias("op"), "card_pos", F.lit("yeni").alias("name"), (F.col("size") + 1).cast("int").alias("size"))
    adds = t.load(spark, folder, "supplier").select(F.lit("add").alias("op"), F.col("s_suppkey").cast("int").alias("card_pos"), F.col("s_name").alias("name"),
                                                    F.lit(None).cast("int").alias("size"))
    changed = maintenance.apply_watch_changes(cards, edits.unionByName(adds))
    return changed.withColumn("card_pos", F.col("card_pos").cast("bigint"))


@query("""WITH m AS (SELECT max(ts) AS as_of FROM events) SELECT event_id FROM events, m WHERE ts >= as_of - INTERVAL 48 HOUR""")
def prune_expired(spark, folder):
    rows = t.load(spark, folder, "events").select("event_id", F.col("ts").cast("timestamp").alias("created_at"))
    return maintenance.prune_expired(rows, rows.agg(F.max("created_at").alias("x")).scalar(), hours=48).select("event_id")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (ORDER BY lower(s_name), lower(p_name), l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate) AS no
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey""")
def stock_numbered(spark, folder):
    """Stock rows numbered in the order of the stock view."""
    names = t.load(spark, folder, "part").select("p_partkey", F.col("p_name").alias("product_title"))
    sellers = t.load(spark, folder, "supplier").select("s_suppkey", F.col("s_name").alias("seller"))
    rows = t.load(spark, folder, "lineitem")
    gaps = rows.join(names, rows.l_partkey == names.p_partkey).join(sellers, rows.l_suppkey == sellers.s_suppkey).select(
        "seller", "product_title", F.lit("").alias("product_url"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate").alias("seq"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    order = [*summary.stock_order()[:2], F.col("seq")]
    return summary.number_rows(gaps, order).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "no")
