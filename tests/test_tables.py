import json
import tempfile
from datetime import datetime
from decimal import Decimal as D

from pyspark.sql import functions as F

from pricewatch.operators import matching, offers, skew, summary
from pricewatch.plans import price_cycle
from pricewatch.sources import published, tables

T0 = datetime(2026, 1, 1)


def cards(spark, *items):
    folder = tempfile.mkdtemp(prefix="spark-")
    with open(folder + "/options.json", "w") as f:
        json.dump({"takip_edilenler": list(items), "keywords": ["a, b"], "telegram_enabled": True}, f)
    return folder + "/options.json"


def test_watches(spark):
    path = cards(
        spark,
        {"name": "Tab", "target_price": "40.000 TL", "exclude_terms": "kılıf, koruyucu", "url_1": "https://www.amazon.com.tr/dp/B000000001",
         "url_2": "https://nope.org/x", "url_3": "https://www.hepsiburada.com/a-p-HB1"},
        {"name": "", "target_price": 100, "url_1": "https://www.amazon.com.tr/s?k=x"},
        {"name": "Kapalı", "active": False, "target_price": 1, "url_1": "https://www.zara.com/a"},
        {"name": "Kazak", "target_price": 100, "minimum_price": 200, "url_1": "https://www.zara.com/a"},
        {"name": "Tab", "target_price": 40000, "url_1": "https://www.amazon.com.tr/dp/B000000001"})
    w = tables.expand_watches(tables.read_watch_cards(spark, path))
    rows = w.orderBy("card_pos", "url_pos").collect()
    assert [(r.card_pos, r.site, r.error is None) for r in rows] == [
        (0, "amazon", True), (0, "hepsiburada", True), (1, "amazon", False), (3, "zara", False), (4, "amazon", True)]
    assert rows[0].tracking_id == rows[1].tracking_id != rows[4].tracking_id
    assert rows[0].excluded_terms == ["kılıf", "koruyucu"] and rows[0].max_items_to_scan == 60 and rows[3].group == "Moda"
    assert [r.url for r in tables.rejected_links(tables.read_watch_cards(spark, path)).collect()] == ["https://nope.org/x"]
    s = tables.read_channel_settings(spark, path).first()
    assert s.keywords == ["a", "b"] and len(s.channels) == 11 and s.enabled and s.saved_messages_enabled
    assert tables.read_watch_cards(spark, path + ".missing").count() == 0
    assert len(tables.config_signature(w.where("error is null")).first().signature) == 64


def test_summary_round_trip(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    rows = spark.createDataFrame(
        [(1, "Amazon", "A", "https://e.org/a", D("100.9"), D(90), D(80), D(120), "", "", False, "t"), (2, "Amazon", "A", "https://e.org/a", D(95), D(90), D(80), D(120), "", "", False, "t"),
         (3, "Amazon", "A", "https://e.org/a?c=b", D(50), D(90), D(80), D(120), "", "", False, "t")],
        "seq bigint, seller string, product_title string, product_url string, price decimal(18,4), target_price decimal(18,4), min_price decimal(18,4), "
        "max_price decimal(18,4), search_group string, search_group_label string, is_warehouse boolean, tracking_id string")
    stock = spark.createDataFrame([("B", "t", "u", D(5), "yok")], "seller string, product_title string, product_url string, target_price decimal(18,4), reason string")
    tables.write_summary(rows, stock, folder, F.lit("x"), cycle_seconds=75)
    got = spark.read.parquet(folder + "/rows").orderBy("no").collect()
    assert [(r.no, r.price, r.difference, r.is_target_hit) for r in got] == [(1, "95 TL", "+5 TL", False), (2, "50 TL", "-40 TL", True)]
    run = spark.read.parquet(folder + "/run")
    assert (run.first().row_count, run.first().stock_row_count, run.first().cycle_duration_minutes) == (2, 1, "1 dk 15 sn")
    out = tempfile.mkdtemp(prefix="spark-")
    tables.write_summary(rows, stock, out, F.lit("y"), previous_run=run)
    assert spark.read.parquet(out + "/run").first().cycle_duration_seconds == 75


def test_exclude_and_specific(spark):
    o = spark.createDataFrame([("S11", D(1000)), ("S11 koruyucu kılıf", D(20000)), ("S11 tablet", D(20000))], "title string, price decimal(18,4)").withColumns(
        {"minimum_price": F.lit(10000).cast("decimal(18,4)"), "excluded_terms": F.array(*map(F.lit, ["kılıf", "koruyucu"]))})
    reasons = [r.reason for r in matching.exclude_offers(o, keep_rejected=True).collect()]
    assert reasons == ["minimum fiyat filtresi: 1.000 TL < 10.000 TL", "hariç tut filtresi: kılıf", None]
    res = spark.createDataFrame([(1, "Apple iPhone 17 Pro 256 GB"), (2, "Apple iPhone 17 Pro Max 256 GB")], "result_id int, title string")
    w = spark.createDataFrame([("p", "iPhone 17 Pro"), ("m", "iPhone 17 Pro Max")], "watch_key string, name string")
    assert sorted((r.result_id, r.watch_key) for r in matching.assign_most_specific(res, w).collect()) == [(1, "p"), (2, "m")]


def test_long_keyword_list(spark):
    words = [f"kelime{i}" for i in range(300)] + ["şapka"]
    df = spark.createDataFrame([(1, "Yeni ŞAPKA kelime7 geldi"), (2, "yok"), (3, "sapka @x")], "id int, text string")
    assert [(r.id, r.keyword) for r in matching.keyword_hits(df, words, ["@"]).collect()] == [(1, "kelime7")]


def test_salted_join_equals_join(spark):
    left = spark.range(1000).select(F.when(F.col("id") < 700, 0).otherwise(F.col("id") % 50).alias("k"), F.col("id"))
    right = spark.range(60).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("inner", "left", "left_semi", "left_anti"):
        a = sorted(map(tuple, left.join(right.where("k != 3"), ["k"], how).collect()), key=str)
        b = sorted(map(tuple, skew.salted_join(left, right.where("k != 3"), ["k"], how, F.col("id"), 4, hot_min_rows=100).collect()), key=str)
        assert a == b, how


def test_price_cycle(spark):
    path = cards(spark, {"name": "Tab", "target_price": "100", "url_1": "https://www.zara.com/a"}, {"name": "Eski", "target_price": "50", "url_1": "https://www.zara.com/b"})
    w = tables.valid_watches(tables.expand_watches(tables.read_watch_cards(spark, path))).withColumn(
        "watch_key", offers.watch_key(F.col("site"), F.col("tracking_id"), F.col("url"), F.col("size")))
    pages = spark.createDataFrame([("https://www.zara.com/a/", "zara", 1, "Tablet", D(90), "https://www.zara.com/a", False),
                                   ("https://www.zara.com/a", "zara", 2, "Tablet", D(120), "https://www.zara.com/a2", False)],
                                  "page_url string, site string, seq bigint, title string, price decimal(18,4), url string, is_warehouse boolean")
    old = w.where("name = 'Eski'").select("watch_key").first()[0]
    ws = spark.createDataFrame([(old, ["k"], T0, None, None, None, None)], tables.read_watch_state(spark, "/nope").schema)
    st = tables.read_offer_state(spark, "/nope")
    os = spark.createDataFrame([("k", D(60), D(55), D(70), T0, T0, T0, False, None, None)], st.schema).withColumns(
        {"title": F.lit("Eski ürün"), "url": F.lit("https://www.zara.com/b"), "is_warehouse": F.lit(False)})
    cyc = price_cycle.run_cycle(w, pages, os, ws, F.lit(T0).cast("timestamp"))
    assert sorted((r.product_title, r.price, r.is_target_hit) for r in cyc.rows.collect()) == [
        ("Eski ürün", 60, False), ("Tablet", 90, True), ("Tablet", 120, False)]
    assert [r.price for r in cyc.decided.where("sent").collect()] == [90] and cyc.state.count() == 2


def test_json_documents(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    with open(folder + "/state.json", "w") as f:
        json.dump({"_meta": {"x": 1}, "k1": {"last_price": "10", "offer_keys": ["a"]}, "k2": 5}, f)
    got = tables.read_json_state(spark, folder + "/state.json")
    assert [(r.key, r.p) for r in got.select("key", F.try_variant_get("value", "$.last_price", "string").alias("p")).collect()] == [("k1", "10")]
    row = {"seller": "A", "product_title": "t", "product_url": "u", "price": "1.500 TL", "target": "2.000 TL"}
    with open(folder + "/summary.json", "w") as f:
        json.dump({"rows": [row, {**row, "price": "yok"}], "stock_rows": [{"seller": "B", "target": "5 TL", "reason": "r"}]}, f)
    rows, stock = tables.read_summary(spark, folder + "/summary.json")
    assert [(r.price, r.min_price, r.target_price) for r in rows.collect()] == [(1500, 1500, 2000)]
    assert [(r.target_price, r.reason) for r in stock.collect()] == [(5, "r")]


def test_merge_and_groups(spark):
    ddl = "seq bigint, tracking_id string, product_url string, is_warehouse boolean, price decimal(18,4)"
    prev = spark.createDataFrame([(1, "", "https://e.org/a", False, D(200)), (2, "", "https://e.org/b", False, D(8899)), (3, "", "https://e.org/c", False, D(1))], ddl)
    fresh = spark.createDataFrame([(9, "", "https://e.org/b", True, D(8787))], ddl)
    stock = "product_url string"
    rows, gaps = summary.merge_summary(prev, fresh, spark.createDataFrame([("https://e.org/b/",), ("https://e.org/z",)], stock), spark.createDataFrame([("https://e.org/c",)], stock))
    assert sorted(r.seq for r in rows.collect()) == [1, 2, 9]
    assert sorted(r.product_url for r in gaps.collect()) == ["https://e.org/c", "https://e.org/z"]


def test_number_rows(spark):
    df = spark.range(1000).select(((F.col("id") * 37) % 1000).alias("v"))
    got = summary.number_rows(df, [F.col("v")]).collect()
    assert all(r.no == r.v + 1 for r in got) and len(got) == 1000


def test_watch_changes(spark):
    from pricewatch.operators import maintenance

    c = spark.createDataFrame([(0, "a", "1"), (1, "b", "2"), (2, "c", "3")], "card_pos int, name string, target_price string")
    ch = spark.createDataFrame([("update", 0, None, "9"), ("delete", 1, None, None), ("add", 0, "d", "4")],
                               "op string, card_pos int, name string, target_price string")
    got = maintenance.apply_watch_changes(c, ch).orderBy("card_pos").collect()
    assert [tuple(r) for r in got] == [(0, "a", "9"), (2, "c", "3"), (3, "d", "4")]


def test_mark_forced(spark):
    from pricewatch.operators import alerts

    obs = spark.createDataFrame([("w", 1), ("w", 2), ("v", 1)], "watch_key string, seq bigint")
    back = spark.createDataFrame([("w", 2)], "watch_key string, seq bigint")
    got = {(r.watch_key, r.seq): r.forced_sent for r in alerts.mark_forced(obs, back).collect()}
    assert got == {("w", 1): False, ("w", 2): True, ("v", 1): False}


# --- published tables -------------------------------------------------------
ROW = "seller string, product_title string, product_url string, price decimal(18,4), is_warehouse boolean, tracking_id string"
STOCK = "seller string, product_title string, product_url string, reason string"
EVENT = "event string, " + ROW + ", reason string, identity string"


def shop(i, price):
    return ("row", "s", f"p{i}", f"https://x.org/{i}", D(price), False, "", None, None)


def test_published_summary_is_idempotent(spark, tmp_path):
    table = published.summary_tables(spark, str(tmp_path), ROW, STOCK, buckets=8)
    batches = [
        [shop(i, 10 + i) for i in range(30)],
        [shop(3, 1), shop(40, 5), ("stock", "s", "p7", "https://x.org/7", None, None, None, "yok", None),
         ("removed", None, None, None, None, None, None, None, "https://x.org/9|normal")],
        [shop(7, 2)],
    ]
    want, gaps = {}, set()
    for n, events in enumerate(batches):
        df = spark.createDataFrame(events, EVENT)
        before = table.versions()
        assert published.publish_events(table, df, n)
        for e in events:
            link = e[3]
            if e[0] == "row":
                want[link] = e[4]
                gaps.discard(link)
            elif e[0] == "stock":
                want.pop(link, None)
                gaps.add(link)
            else:
                want.pop(e[8].split("|")[0], None)
        state = lambda: ({r.product_url: r.price for r in table.read("rows").collect()}, {r.product_url for r in table.read("stock").collect()})
        assert state() == (want, gaps)
        now = table.versions()
        assert not published.publish_events(table, df, n) and table.versions() == now and state() == (want, gaps)
        changed = {b for (t, b), v in now.items() if v == n} | {b for t, b in set(before) - set(now)}
        assert len(changed) <= len(events) and (n == 0 or all(now[k] == v for k, v in before.items() if k[1] not in changed))
    table.expire(keep=1)
    assert table.batches() == [2] and {r.product_url: r.price for r in table.read("rows").collect()} == want


def test_a_batch_that_was_cut_off_is_written_anew(spark, tmp_path):
    table = published.BucketedTables(spark, str(tmp_path), {"state": "k string, v int"}, buckets=4)
    first = spark.createDataFrame([(f"k{i}", i) for i in range(20)], "k string, v int")
    assert published.merge_keyed(table, "state", first, "k", 0)
    # data of batch 1 without a manifest: readers don't see it
    spark.createDataFrame([("x", 1, 2)], "k string, v int, _bucket int").write.partitionBy("_bucket").parquet(f"{tmp_path}/data/state/version=1")
    assert table.read("state").count() == 20
    more = spark.createDataFrame([("k3", 300), ("new", 1)], "k string, v int")
    assert published.merge_keyed(table, "state", more, "k", 1) and not published.merge_keyed(table, "state", more, "k", 1)
    got = {r.k: r.v for r in table.read("state").collect()}
    assert got == {**{f"k{i}": i for i in range(20)}, "k3": 300, "new": 1}
    touched = {b for (_, b), v in table.versions().items() if v == 1}
    assert 1 <= len(touched) <= 2 and table.read("state", [99]).count() == 0


def test_publisher_in_a_stream(spark, tmp_path):
    table = published.summary_tables(spark, str(tmp_path / "t"), ROW, STOCK, buckets=4)
    for i in range(3):
        spark.createDataFrame([shop(i, 5), shop(9, i)], EVENT).coalesce(1).write.parquet(f"{tmp_path}/in/part={i}")
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/part=*")
    q = stream.writeStream.foreachBatch(published.publisher(table)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.product_title for r in table.read("rows").collect()} == {"p0", "p1", "p2", "p9"} and len(table.batches()) == 3


def test_events_are_made_once(spark, tmp_path):
    """A batch reads its events for buckets and for the merge; what makes them runs once."""
    table = published.summary_tables(spark, str(tmp_path), ROW, STOCK, buckets=4)
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    df = spark.createDataFrame([shop(i, 10 + i) for i in range(30)], EVENT)
    assert published.publish_events(table, df.mapInArrow(count, df.schema), 0)
    assert made.value == 30 and table.read("rows").count() == 30
