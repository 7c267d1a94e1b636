from decimal import Decimal as D

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from pricewatch.functions import checks, dates, labels, money, text, urls


def values(spark, build, rows, ddl="a string"):
    df = spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], ddl)
    return [r["x"] for r in df.select(build(*[df[c] for c in df.columns]).alias("x")).collect()]


def test_parse_money(spark):
    rows = ["1.500", "40.000 TL", "40000", "fiyat belli değil", "1.234,56", "1,234.56", "1,234", "12.5", "0.123",
            "1.234.567", "-5,5", "", None, "12.", "8.999,00 TL", "1,2,3"]
    want = [1500, 40000, 40000, None, D("1234.56"), D("1234.56"), D("1.234"), D("12.5"), 123, 1234567, D("-5.5"), None,
            None, 12, 8999, None]
    assert values(spark, money.parse_money, rows) == want


def plain_parse(raw):
    """The rule of parse_money in plain Python."""
    s = "".join(ch for ch in raw if ch in "0123456789,.-")
    if "," in s and "." in s:
        s = s.replace(".", "").replace(",", ".") if s.rfind(",") > s.rfind(".") else s.replace(",", "")
    elif "," in s:
        s = s.replace(",", ".")
    elif "." in s:
        head, *rest = s.split(".")
        if all(len(g) == 3 for g in rest):
            s = head + "".join(rest)
    try:
        return D(s)
    except Exception:  # noqa: BLE001
        return None


def test_parse_money_property(spark):
    @settings(max_examples=1, deadline=None, suppress_health_check=list(HealthCheck))
    @given(st.lists(st.text("0123456789.,- TL", max_size=9), min_size=400, max_size=600))
    def check(rows):
        got = values(spark, money.parse_money, rows)
        for r, g in zip(rows, got):
            w = plain_parse(r)
            if w is not None and -w.as_tuple().exponent > 4:
                continue
            assert g == w, r

    check()


def test_money_text(spark):
    assert values(spark, lambda a: money.format_money(a.cast("decimal(18,4)"), True), ["1500.75", "1234567", "12"]) == [
        "1.500 TL", "1.234.567 TL", "12 TL"]
    assert values(spark, lambda a: money.format_signed(a.cast("decimal(18,4)")), ["1500.75", "-1500.75", "0"]) == [
        "+1.500", "-1.500", "+0"]
    assert values(spark, money.display_money, ["1.500,75", "-", "", "yok"]) == ["1.500 TL", "-", "-", "yok"]
    assert values(spark, lambda a: money.display_money(a, True), ["+125,90", "-3.000 TL"]) == ["+125 TL", "-3.000 TL"]
    assert values(spark, money.display_range, ["1.500,75 / 2.000,01", None]) == ["1.500 TL / 2.000 TL", "- / -"]
    assert values(spark, money.target_reply, ["40.000 TL", "0", "x", "-5"]) == [40000, None, None, None]
    assert values(spark, money.listing_price, ["18.049,00 TL", "12.5", "10", "2.000.000 TL"]) == [18049, 125, None, None]
    assert values(spark, money.price_from_form, ["1.500,99"]) == [1500]
    assert values(spark, money.number_or_text, ["12", "1.5", "abc"]) == [(12, None, None), (None, 1.5, None), (None, None, "abc")]
    assert values(spark, money.difference_from_text, ["-1.250 TL", "+75", None]) == [-1250, 75, 0]


def test_fold(spark):
    rows = ["İSTANBUL  Çanta", "ısı  ŞIK", "Straße Café ﬁt ½", "a b"]
    assert values(spark, text.fold_text, rows) == ["istanbul canta", "isi sik", "strasse cafe fit 1⁄2", "a b"]
    assert values(spark, text.fold_text_full, rows) == values(spark, text.fold_text, rows)
    assert values(spark, text.key_text, ["  Şa-ha_ne! X", "__a__"]) == ["a_ha_ne_x", "a"]
    assert values(spark, text.repair_mojibake, ["Ã§anta &amp; kÄ±lÄ±f", "temiz", None]) == ["çanta & kılıf", "temiz", ""]
    assert values(spark, text.split_terms, ["kılıf, koruyucu\nçizilmez,,"]) == [["kılıf", "koruyucu", "çizilmez"]]
    assert values(spark, text.shorten, ["a " * 60])[0].endswith("...")
    assert values(spark, text.squash, [" A  B "]) == ["a b"]


def test_phrases(spark):
    title = "Apple iPhone 17 Pro Max 256 GB"
    got = values(spark, text.title_matches, [(title, "iPhone 17 Pro"), (title, "iPhone 17 Pr"), (title, "")], "a string, b string")
    assert got == [True, False, False]
    assert values(spark, text.specificity, ["S11+", "iphone 17 pro", ""]) == [1, 3, 0]


def test_error_text(spark):
    err = "ürün | https://a.b/c?x | Hata https://d.e/f oldu; ikinci https://a.b/z."
    assert values(spark, text.clean_error, [err, "", "https://x.y/z"])[1:] == ["Hata ayrıntısı kaydedilmemiş.", "[link]"]
    links = values(spark, text.error_links, [err])[0]
    assert [r["url"] for r in links] == ["https://a.b/c?x", "https://a.b/z"]
    assert values(spark, text.unique_text, [(["A", "a ", "", "B"],)], "a array<string>") == [["A", "B"]]
    assert values(spark, text.keyword_caption, [(["a"],), (["a", "b"],), ([],)], "a array<string>") == [
        "Aranan keyword: a", "Aranan keywordler: a, b", "Aranan keyword belirtilmemiş"]


def test_dates(spark):
    got = values(spark, dates.parse_iso, ["2026-01-02T03:04:05+03:00", "2026-01-02 03:04:05", "x", None])
    assert [str(g) if g else None for g in got[2:]] == [None, None]
    assert values(spark, lambda a: dates.utc_stamp(dates.parse_iso(a)), ["2026-01-02T03:04:05+03:00"])[0].startswith(
        "2026-01-02T00:04:05")
    assert values(spark, dates.duration_text, ["75", "600", "9", "-4", None]) == [
        "1 dk 15 sn", "10 dk 0 sn", "9 sn", "0 sn", "-"]
    at = F.lit("2026-01-02 10:00:00").cast("timestamp")
    rows = ["2026-01-02 09:59:55", "2026-01-02 09:59:20", "2026-01-02 09:50:00", "2026-01-02 05:00:00", "2025-12-30 00:00:00", None]
    assert values(spark, lambda a: dates.relative_time(a.cast("timestamp"), at), rows) == [
        "az önce", "40 sn önce", "10 dk önce", "5 sa önce", "3 gün önce", "-"]
    assert values(spark, lambda a: dates.quiet_hours(a.cast("timestamp"), "UTC"),
                  ["2026-01-02 22:00:00", "2026-01-02 07:59:00", "2026-01-02 08:00:00"]) == [True, True, False]


def test_canonical_urls(spark):
    rows = [
        "https://www.amazon.com.tr/x/dp/B000000001?th=1",
        "https://www.amazon.com.tr/gp/product/B000000001?smid=A1",
        "HTTPS://Shop.Example.org/A/b/?page=2#top",
        "/rel/path",
        "",
        None,
        "https://e.org/a/;x?q",
    ]
    assert values(spark, urls.canonical_url, rows) == [
        "https://www.amazon.com.tr/dp/b000000001",
        "https://www.amazon.com.tr/dp/b000000001",
        "https://shop.example.org/A/b?page=2",
        "/rel/path",
        "",
        "",
        "https://e.org/a;x?q",
    ]
    assert values(spark, lambda a: urls.offer_identity(a, F.lit(True)), [rows[0], ""]) == [
        "https://www.amazon.com.tr/dp/b000000001|warehouse", ""]


def test_sites(spark):
    rows = ["https://www.amazon.com.tr/s?k=x", "https://www2.hm.com/p", "https://nope.org", "https://m.network.com.tr/a"]
    assert values(spark, urls.detect_site, rows) == ["amazon", "hm", None, "network"]
    assert values(spark, lambda a: urls.site_label(a), ["beymenclub", "foo"]) == ["Beymen Club", "Foo"]
    rows = ["https://www.amazon.com.tr/s?k=x", "https://www.amazon.com.tr/dp/B000000001?k=1",
            "https://www.hepsiburada.com/ara?q=x", "https://www.hepsiburada.com/tablet-p-HBC1", "https://zara.com/a"]
    assert values(spark, urls.is_search_url, rows) == [True, False, True, False, False]
    assert values(spark, urls.query_name, ["https://a/s?k=edifier+m60", "https://a/s?k=&q=%C3%A7", "https://a/"]) == [
        "edifier m60", "ç", ""]
    assert values(spark, urls.first_url, ["Buna bakar mısın? https://www.amazon.com.tr/dp/B0B2PSDNV1?th=1"]) == [
        "https://www.amazon.com.tr/dp/B0B2PSDNV1?th=1"]
    assert values(spark, urls.all_urls, ["(https://a.b/c), http://d.e!"]) == [["https://a.b/c", "http://d.e"]]


def test_product_links(spark):
    assert values(spark, urls.product_code, ["https://x/y-pm-hbc12ab?z", "https://hm/productpage.0123.html", "x"]) == [
        "HBC12AB", "0123", ""]
    assert values(spark, urls.canonical_listing_url, [
        "/tablet-s11-p-HBC1?x=1", "https://www.hepsiburada.com/yorumlar-p-HBC1", "https://o.com/a-p-HB1"]) == [
        "https://www.hepsiburada.com/tablet-s11-p-HBC1", "", ""]
    assert values(spark, urls.variation_url, ["/x/dp/B000000001/ref=1?th=1&psc=1&tag=z", "/dp/B000000001?tag=z"]) == [
        "https://www.amazon.com.tr/dp/B000000001?th=1&psc=1", "https://www.amazon.com.tr/dp/B000000001"]
    assert values(spark, urls.clean_search_url, ["https://www.amazon.com.tr/s?k=a+b&ref=x&i=el"]) == [
        "https://www.amazon.com.tr/s?k=a+b&i=el"]
    assert values(spark, urls.url_variants, ["https://www.hepsiburada.com/a-p-HB1?x=1"])[0] == [
        "https://www.hepsiburada.com/a-p-HB1?x=1", "https://www.hepsiburada.com/a-p-HB1",
        "https://www.hepsiburada.com/a-p-HB1?magaza=Hepsiburada", "https://www.hepsiburada.com/a-pm-HB1"]
    assert values(spark, urls.url_variants, ["https://www.amazon.com.tr/s?k=a&ref=z"])[0] == [
        "https://www.amazon.com.tr/s?k=a&ref=z", "https://www.amazon.com.tr/-/tr/s?k=a&ref=z",
        "https://www.amazon.com.tr/s?k=a", "https://www.amazon.com.tr/-/tr/s?k=a"]
    assert values(spark, urls.is_depot_search, ["https://www.amazon.com.tr/s?i=warehouse-deals&k=x", "https://www.amazon.com.tr/s?k=x"]) == [True, False]
    assert values(spark, urls.title_from_url, ["https://x.com/a/kirmizi-kazak-p123.html", "https://www.zara.com/", "https://www.foo.org"]) == [
        "Kirmizi Kazak", "Zara ürünü", "FOO ürünü"]
    assert values(spark, urls.url_keys, ["https://a/b?c#d", "https://a/b"]) == [["https://a/b?c#d", "https://a/b"], ["https://a/b"]]


def test_sizes(spark):
    rows = [("S (US S)", "s"), ("EU 38 / US 8", "38"), ("XL", "L"), ("M", ""), ("27", "27 eu")]
    assert values(spark, labels.size_matches, rows, "a string, b string") == [True, True, False, True, True]
    assert values(spark, labels.text_available, ["Tükendi", "InStock", "https://schema.org/OutOfStock", "0", "S"]) == [
        False, True, False, False, True]


def test_labels(spark):
    assert values(spark, labels.title_with_part, [("Tablet", "Gümüş"), ("Tablet gumus", "Gümüş")], "a string, b string") == [
        "Tablet / Gümüş", "Tablet gumus"]
    assert values(spark, labels.display_title, [("Kazak", "Mavi", "M"), ("Kazak", "kazak", ""), ("K", "M", "m")],
                  "a string, b string, c string") == ["Kazak / Mavi / M", "Kazak", "K / M"]
    assert values(spark, labels.capacity_label, ["8 GB RAM 128 GB", "12/256 GB", "8 GB", "x", "1 tb"]) == [
        "128 GB", "256 GB", "8 GB", "", "1 TB"]
    assert values(spark, labels.colour_label, ["Mint Yeşili", "gümüş-rengi", "altın"]) == ["Mint Yeşili", "Gümüş", ""]
    assert values(spark, labels.clean_label, ["Renk / Mavi / mavi / 128 GB / fiyat 5"]) == ["Mavi / 128 GB"]
    assert values(spark, labels.infer_seller, ["Teknosa Apple iPhone 17", "Apple iPhone", "Foo bar"]) == [
        "Teknosa", "Hepsiburada", "Hepsiburada"]
    assert values(spark, labels.good_title, ["Sepete ekle şimdi", "12345678", "Samsung S11", "kısa"]) == [False, False, True, False]
    assert values(spark, labels.variant_group_label, ["A / B / C", "A — B", " A "]) == ["A", "A", "A"]
    assert values(spark, labels.clean_display_title, ["Samsung Galaxy S11 Tablet / Samsung Galaxy Tab / Gri / gri"]) == [
        "Samsung Galaxy S11 Tablet / Gri"]
    assert values(spark, labels.ordered_variant_label, [(["Wi-Fi", "gri", "128 GB"], "x 256 GB siyah")], "a array<string>, b string") == [
        "128 GB / Gri / Wi-Fi"]
    assert values(spark, labels.clean_colour, ["Renk: Mavi seçili", "renk"]) == ["Mavi", ""]


def test_checks(spark):
    assert values(spark, checks.parse_flag, ["Evet", "0", None, " on "]) == [True, False, False, True]
    got = values(spark, lambda a: checks.bounded_int(a, "n", 60, 10, 100), ["5", None, "x", "20"])
    assert [(g["value"], g["error"]) for g in got] == [
        (None, "n 10 ile 100 arasında olmalı."), (60, None), (None, "n tam sayı olmalı."), (20, None)]
    got = values(spark, lambda a: checks.optional_int(a, "n", 1, 9), ["", None, "x", "20", "3"])
    assert [g["value"] for g in got] == [None, None, None, None, 3] and got[0]["error"] is None and got[3]["error"]
    assert values(spark, checks.age_gate, ["<b>Yaş doğrulaması</b>", "x"]) == [True, False]
    rows = [("amazon", "captcha robot"), ("nordbron", "captcha robot product-detail_price"), ("hm", "Access Denied"), ("zara", "x")]
    assert values(spark, checks.bot_gate, rows, "a string, b string") == [True, False, True, False]
    rows = [("failed", "Amazon arama sayfasında okunabilir fiyat bulunamadı."), ("failed", "captcha page"), ("empty_search", "")]
    assert values(spark, checks.empty_search_is_normal, rows, "a string, b string") == [True, False, True]
    assert values(spark, lambda a: checks.block_error(F.lit(200), a), ["Amazon bot korumasi", "x"]) == [True, False]
    assert values(spark, checks.missing_price_error, ["Fiyat yakalanamadı", "captcha"]) == [True, False]


def test_fold_text_on_every_letter_of_its_blocks(spark):
    from pricewatch.functions import text

    letters = [chr(c) for block in text._BLOCKS for c in block] + [chr(c) for c in range(0xA0)]
    rows = spark.createDataFrame([(x,) for c in letters for x in (c, f"a{c}b {c}")], "s string")
    for r in rows.select("s", text.fold_text(F.col("s")).alias("f")).collect():
        assert r.f == text.fold_word(r.s), r.s


def test_long_keyword_lists_use_the_same_rule(spark):
    from pricewatch.operators import matching

    words = [f"kelime{i}x" for i in range(400)] + ["ÇANTA", "canta"]
    rows = spark.createDataFrame([(1, "bir kelime399x ve kelime12x"), (2, "Sırt çantası"), (3, "yok"), (4, None)], "id int, text string")
    assert [(r.id, r.keyword) for r in matching.match_keywords(rows, words).orderBy("id").collect()] == [(1, "kelime12x"), (2, "ÇANTA")]
    assert matching.keyword_hits(rows, words, ["sirt"]).count() == 1 and matching.match_keywords(rows, []).count() == 0


def test_long_lists_are_not_cut(spark):
    from pricewatch.functions import labels, urls

    parts = " / ".join(f"deger{i}" for i in range(10_500))
    got = spark.createDataFrame([(f"Urun / {parts}",)], "t string").select(labels.clean_display_title(F.col("t")).alias("t")).first().t
    assert got.endswith("deger10499")
    word = "a" * 5000
    got = spark.createDataFrame([(f"https://shop.example.org/{word}-p-1",)], "u string").select(urls.title_from_url(F.col("u")).alias("t")).first().t
    assert got == "A" + word[1:]


@pytest.mark.parametrize("content, header, text", [
    ("İstanbul çay".encode("utf-8"), None, "İstanbul çay"),
    ("İstanbul çay".encode("utf-8"), "text/html; charset=ISO-8859-1", "İstanbul çay"),
    ("İstanbul çay".encode("iso-8859-9"), "text/html; charset=iso-8859-9", "İstanbul çay"),
    ('<meta charset="windows-1254">İstanbul çay'.encode("cp1254"), "text/html", '<meta charset="windows-1254">İstanbul çay'),
    ("<meta http-equiv='x' content='text/html; charset=iso-8859-9'>ığüş".encode("iso-8859-9"), None, "<meta http-equiv='x' content='text/html; charset=iso-8859-9'>ığüş"),
    (b"\xef\xbb\xbfa", None, "a"), (b"\xff\xfea\x00", "text/html", "a"), (b"\xfe\xff\x00a", None, "a"),
    ("é".encode("latin-1"), None, "é"), ("é".encode("latin-1"), "text/html; charset=no-such", "é"),
    ("SÃO".encode("latin-1"), "text/html; charset=iso-8859-1", "SÃO"), (b"", None, ""), (b"\xff", "text/html; charset=utf-8", "�")])
def test_charset(content, header, text):
    from pricewatch.functions.charset import page_text

    assert page_text(content, header) == text


def test_pages_of_bytes(spark, tmp_path):
    from pricewatch.sources import tables

    rows = [(1, "ş".encode("iso-8859-9"), "text/html; charset=iso-8859-9"), (2, "ş".encode(), None), (3, None, "x")]
    spark.createDataFrame(rows, "page_id int, html binary, type string").write.parquet(str(tmp_path / "p"))
    assert {r.page_id: r.html for r in tables.read_pages(spark, str(tmp_path / "p"), "html", "type").collect()} == {1: "ş", 2: "ş", 3: None}


def test_config_signature_knows_no_order(spark):
    from pricewatch.sources import tables

    schema = ("card_pos int, url_pos int, site string, url string, target_price decimal(18,4), minimum_price decimal(18,4), excluded_terms array<string>, "
              "size string, include_variations boolean")
    rows = [(i, 0, "s", f"u{i}", None, None, ["a"], "", False) for i in range(50)]
    sign = lambda r, n=3: tables.config_signature(spark.createDataFrame(r, schema).repartition(n)).first()[0]
    plan = tables.config_signature(spark.createDataFrame(rows, schema))._jdf.queryExecution().toString()
    assert sign(rows) == sign(rows[::-1], 7) and "collect_list" not in plan
    assert len({sign(rows), sign(rows[1:]), sign(rows + rows[:1]), sign([(1, *rows[0][1:]), (0, *rows[1][1:]), *rows[2:]]), sign([])}) == 5


def test_page_gates_fold_a_page_once(spark):
    from pricewatch.plans.column_queries import page_gates

    plan = page_gates(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    # one fold tests once for letters that become several
    assert plan.count("translate(") == 1


def test_money_from_text_without_regular_replacement(spark):
    df = spark.createDataFrame([(x,) for x in ("1.234 TL", "-12,50TL", "+1 000,5 TL", "T.L5", "TTLL5", "TL", "12-5", "", None, "5,", ",5")], "a string")
    out = df.select(money.money_from_text(df.a).alias("x"))
    assert [r.x for r in out.collect()] == [1234, D("-12.5"), D("1000.5"), None, None, None, None, None, None, 5, None]
    assert "regexp_replace" not in out._jdf.queryExecution().optimizedPlan().toString()
