import json
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from pricewatch.operators import dom, evidence, listing, variants

PAGES = "page_id bigint, site string, url string, html string"


def parsed(spark, *pages):
    rows = [(i, *p) for i, p in enumerate(pages)]
    return dom.parse_pages(spark.createDataFrame(rows, PAGES))


def one(spark, html, build, site="nordbron", url="https://shop.example.org/a"):
    return parsed(spark, (site, url, html)).select(build.alias("x")).first()["x"]




def test_tree(spark):
    html = ("<html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><!-- x -->"
            "<div class='a b'><p id=q>one <b>two</b><br>three</p></div><div style='display: none'><i>four</i></div></body></html>")
    row = parsed(spark, ("s", "u", html)).first()
    assert row.tokens == ["T", "one", "two", "three", "four"]
    by_tag = {n.tag: n for n in row.nodes}
    assert (by_tag["p"].t0, by_tag["p"].t1) == (1, 4) and by_tag["i"].hidden and not by_tag["b"].hidden
    assert by_tag["b"].parent == by_tag["p"].pos and by_tag["p"].last == by_tag["br"].pos
    assert row.scripts[0].text == "var t='</p>';"
    text = lambda s: dom.node_text(F.col("tokens"), dom.first(F.col("nodes"), s))
    for s, want in [(".a b", "two"), ("div.b #q", "one two three"), ("p[id='q']", "one two three"), ("[style*='none']", "four"), ("div", "one two three")]:
        assert one(spark, html, text(s)) == want, s


def test_json_objects(spark):
    html = """<script type="application/ld+json">{"a": 1, "b": [{"c": true}, {"d": {"e": "x"}}], "t": ["p", "q"]}</script>
    <script>window.S = {"k": {"z": 2.50}}; other = notjson; var p = [{"m": "n"}];</script><script type="application/json">{broken</script>"""
    rows = dom.json_objects(parsed(spark, ("s", "u", html))).orderBy("ord").collect()
    assert [(r.source, r.path, r.text) for r in rows] == [
        ("ld+json", [], {"a": "1", "t": "p\x1fq"}), ("ld+json", ["b"], {"c": "true"}), ("ld+json", ["b"], {}),
        ("ld+json", ["b", "d"], {"e": "x"}), ("window.S", [], {}), ("window.S", ["k"], {"z": "2.5"}), ("p", [], {"m": "n"})]
    assert rows[3].above == [0, 2] and rows[1].item and not rows[3].item


def test_title_and_prices(spark):
    assert one(spark, "<h1> </h1><meta property='og:title' content='Og'>", evidence.page_title(F.col("nodes"), F.col("tokens"))) == "Og"
    assert one(spark, "<meta itemprop=price content='x'><meta name='twitter:data1' content='1.250,50 TL'>", evidence.meta_price(F.col("nodes"))) == D("1250.5")
    sel = ["[class*='product-detail_price']", "[class*='price']"]
    assert one(spark, "<b class='old-price'>çok</b><i class='x product-detail_price_1' content='99,90'>1</i>", evidence.selector_price(F.col("nodes"), F.col("tokens"), sel)) == D("99.9")
    html = '<script>{"price": "120.50", "amount": 99}</script> 1.100,00 TL'
    assert one(spark, html, evidence.script_price(F.col("html"))) == 99
    assert one(spark, "<p>2 ve üzeri için 1.499 TL</p><p>Sepette 1.299,90 TL</p>", evidence.basket_price(dom.page_text(F.col("tokens")))) == D("1299.9")
    assert one(spark, "<p>Değiş tokuş olmadan 12.499,90 TL</p>", evidence.no_trade_in_price(dom.page_text(F.col("tokens")))) == D("12499.9")
    assert one(spark, "<p>Stokta sadece 3 adet kaldı.</p>", evidence.low_stock_quantity(dom.page_text(F.col("tokens")))) == 3
    assert one(spark, "x", evidence.visible_price(F.lit("32.19900 TL"))) == D("32199")


def test_jsonld(spark):
    doc = {"@graph": [{"@type": ["Thing", "Product"], "name": " A ", "offers": {"@type": "AggregateOffer", "lowPrice": "150,00",
           "offers": [{"price": 90}]}}, {"@type": "Product", "name": "B", "offers": [{"offers": [{"price": "140"}, {"price": "135.5"}]}, {"price": ""}]},
           {"@type": "Offer", "price": 1}]}
    html = f'<script type="application/ld+json">{json.dumps(doc)}</script>'
    assert one(spark, html, evidence.jsonld_price(F.col("objects"))) == D("135.5")
    assert one(spark, html, evidence.jsonld_title(F.col("objects"))) == "A"


def test_resolve_price_by_site_order(spark):
    ld = '<script type="application/ld+json">{"@type":"Product","name":"N","offers":{"price":"200"}}</script>'
    meta = "<meta property='product:price:amount' content='300'>"
    basket = "<p>Sepette 150 TL</p>"
    p = parsed(spark, ("network", "u0", ld + meta + basket), ("network", "u1", meta), ("trendyol", "u2", "<b>1.234,50 TL</b>"),
               ("trendyol", "u3", ld + meta), ("trendyol", "u4", "yok"), ("amazon", "u5", ld + "<div id=apex_desktop><span class=a-price><span class=a-price-whole>1.099,</span><span class=a-price-fraction>9</span></span></div>"),
               ("amazon", "u6", "<input name='items[0.base][customerVisiblePrice][amount]' value='50.0'><div class=a-accordion-active><input name='items[0.base][customerVisiblePrice][amount]' value='60.0'></div>"))
    ev = None
    for site in ("network", "trendyol", "amazon"):
        e = evidence.extract_evidence(p, site)
        ev = e if ev is None else ev.unionByName(e)
    got = {r.url: (r.kind, r.price) for r in evidence.resolve_price(ev).collect()}
    assert got == {"u0": ("basket", 150), "u1": ("meta", 300), "u2": ("script", D("1234.5")), "u3": ("jsonld", 200),
                   "u5": ("split", D("1099.9")), "u6": ("active_row", 60)}
    outcome = {r.url: r.outcome for r in evidence.page_outcomes(p, evidence.resolve_price(ev)).collect()}
    assert outcome["u4"] == "failed" and outcome["u0"] == "ok"
    evidence.register_site("my", ["meta"])
    mine = parsed(spark, ("my", "u", meta))
    assert evidence.resolve_price(evidence.extract_evidence(mine, "my")).first().price == 300


def test_marketplace_texts(spark):
    t = lambda f, s: one(spark, "x", f(F.lit(s)))
    assert t(evidence.clean_text_prices, "Fiyat 18.399 TL " + "ürün hakkında uzun bir açıklama metni " * 3 + "9 x 2.044 TL taksit 100 TL kupon kazan") == [18399]
    assert t(evidence.member_prices, "18.999 TL Premium ile 500 TL indirim 18.049,50 TL") == []
    assert t(evidence.member_prices, "Premium ile 18.099 TL") == [18099]
    assert t(evidence.cart_prices, "Sepete özel fiyat 17.500 TL, sonra 20.000 TL") == [17500]
    got = one(spark, "<a aria-label='Fiyat: 1.250,00 TL'>x</a>", evidence.prefer_member_price(F.lit("900 TL"), F.col("nodes")))
    assert got == [1250]


def test_reference_floor(spark):
    rows = [(1, D(1000), "finalPrice"), (1, D(400), "prices x"), (1, D(600), "prices y"), (2, D(1000), "finalPrice"), (2, D(300), "Premium ile"), (3, D(70), "z")]
    ev = spark.createDataFrame(rows, "page_id int, price decimal(18,4), context string")
    assert {r.page_id: r.price for r in evidence.reference_floor(ev, ["page_id"]).collect()} == {1: 600, 2: 300, 3: 70}
    assert evidence.drop_noise_prices(ev.withColumn("context", F.lit("Aylık taksit"))).count() == 0


def test_split_new_used(spark):
    n = spark.createDataFrame([(1, 0, "T", D(100), 3)], "page_id int, seq int, title string, price decimal(18,4), stock_quantity int")
    u = spark.createDataFrame([(1, 0, "T", "İkinci El Amazon Depo", D(100)), (1, 1, "T", "ikinci el amazon depo", D(80)), (1, 2, "T", "ikinci el amazon depo", D(80)),
                               (1, 3, "T", "ikinci el başka", D(50))], "page_id int, seq int, title string, text string, price decimal(18,4)")
    assert sorted((r.price, r.is_warehouse) for r in evidence.split_new_used(n, u).collect()) == [(80, True), (100, False)]


def offers_of(spark, site, html, size, url="https://shop.example.org/p"):
    v = variants.explode_variants(parsed(spark, (site, url, html)), site)
    req = spark.createDataFrame([(0, site, site.title(), size)], "page_id bigint, site string, label string, size string")
    offers, outcome = variants.apply_size(v, req)
    return [(r.title, r.price) for r in offers.orderBy("seq").collect()], tuple(outcome.select("outcome", "reason").first())


ZARA = """<script type="application/ld+json">{"@type":"Product","name":"POLO","color":"sarı","hasVariant":[
 {"@type":"Product","size":"M (US M)","offers":{"price":"1290","availability":"https://schema.org/LimitedAvailability","url":"https://z/m"}},
 {"@type":"Product","size":"L (US L)","offers":{"price":"1290","availability":"https://schema.org/OutOfStock"}},
 {"@type":"Product","size":"S","offers":{"price":"1190","availability":"InStock"}}]}</script>"""


def test_zara_variants(spark):
    assert offers_of(spark, "zara", ZARA, "M") == ([("POLO / sarı / M", 1290)], ("ok", None))
    assert offers_of(spark, "zara", ZARA, "L") == ([], ("out_of_stock", "Zara beden stokta değil: L"))
    assert offers_of(spark, "zara", ZARA, "XXL")[1] == ("out_of_stock", "Zara beden bulunamadı: XXL")
    assert offers_of(spark, "zara", ZARA, "")[0] == [("POLO / sarı / S", 1190)]


def test_bengurme_variants(spark):
    doc = {"title": "Üzüm", "variants": [{"title": "250 gram", "price": 27500, "available": True}, {"title": "500 gram", "price": 45000, "available": True},
                                         {"title": "1 kg", "price": "950,00", "available": True}, {"title": "2 kg", "price": 180000, "available": False}]}
    want = [("Üzüm / 250 gram", 275), ("Üzüm / 500 gram", 450), ("Üzüm / 1 kg", 950)]
    assert offers_of(spark, "bengurme", json.dumps(doc), "")[0] == want
    assert offers_of(spark, "bengurme", f"<script>product = {json.dumps(doc)};</script>", "500 gram")[0] == want[1:2]
    assert offers_of(spark, "bengurme", json.dumps(doc), "2 kg")[1] == ("out_of_stock", "Bengurme beden stokta değil: 2 kg")


def test_hm_variants(spark):
    doc = {"product": {"name": "Kazak", "colorName": "Mavi", "price": {"formattedValue": "399,99 TL"}, "sizes": [
        {"name": "S", "inStock": True}, {"name": "M", "inStock": False}]}}
    html = f'<script type="application/json">{json.dumps(doc)}</script>'
    assert offers_of(spark, "hm", html, "")[0] == [("Kazak / Mavi / S", D("399.99"))]
    assert offers_of(spark, "hm", html, "m") == ([], ("out_of_stock", "Hm beden stokta değil: m"))
    doc = {"name": "Bere", "price": 199, "sizes": {"S": 0, "L": 4}}
    html = f"<script>window.__HM_STATE__ = {json.dumps(doc)};</script>"
    assert offers_of(spark, "hm", html, "")[0] == [("Bere / L", 199)]


def state(spark, html, want, records=None):
    p = parsed(spark, ("network", "u", html))
    req = spark.createDataFrame([(0, want)], "page_id bigint, requested string")
    r = variants.size_state(p, req, records).first()
    return r.found, r.available


def test_size_state(spark):
    html = """<script>var product = {"Sizes":[{"ValueText":"XS","NoStock":false},{"ValueText":"M","NoStock":false},{"ValueText":"L","NoStock":true}]}; var m = {};</script>"""
    assert [state(spark, html, s) for s in ("xs", "M", "l", "XXL", "")] == [(True, True), (True, True), (True, False), (False, False), (True, True)]
    html = "<select name='beden'><option value='XL (EU XL)'>XL (EU XL)</option><option value='M' disabled>M</option></select>"
    assert [state(spark, html, s) for s in ("xl", "M", "S")] == [(True, True), (True, False), (False, False)]
    rec = spark.createDataFrame([(0, "S", True, 27), (0, "XL", True, 6), (0, "XXL", False, 0)], "page_id bigint, size string, in_stock boolean, stock_quantity int")
    assert [state(spark, "", s, rec) for s in ("s", "XL", "xxl")] == [(True, True), (True, True), (True, False)]


CARD = """<div data-component-type="s-search-result" data-asin="{asin}" {extra}><h2><a href="/x/dp/{asin}?th=1&tag=z"><span>{title}</span></a></h2>{body}</div>"""
PRICE = """<span class="a-price"><span class="a-offscreen">{}</span></span>"""


def test_search_cards(spark):
    html = "<div class='s-main-slot'>" + "".join([
        CARD.format(asin="B000000001", extra="", title="Edifier M60", body="<span class='a-price a-text-price'><span class=a-offscreen>9.999,00 TL</span></span>" + PRICE.format("8.899,00 TL")
                    + "<div>Diğer satın alma seçenekleri 8.787,77 TL İkinci El ürün</div>"),
        CARD.format(asin="B000000001", extra="", title="Edifier M60 kopya", body=PRICE.format("8.899,00 TL")),
        CARD.format(asin="B000000002", extra="style='display:none'", title="Gizli", body=PRICE.format("5,00 TL")),
        CARD.format(asin="B000000003", extra="", title="Fiyatsız", body=""),
        "<h3>Yardıma mı ihtiyacınız var?</h3>",
        CARD.format(asin="B000000004", extra="", title="Sonraki", body=PRICE.format("5,00 TL"))]) + "</div>"
    got = listing.search_cards(parsed(spark, ("amazon", "u", html))).orderBy("pos", "is_warehouse").collect()
    url = "https://www.amazon.com.tr/dp/B00000000{}?th=1"
    assert [(r.title, r.url, r.price, r.is_warehouse) for r in got] == [
        ("Edifier M60", url.format(1), D("8899"), False), ("Edifier M60", url.format(1), D("8787.77"), True), ("Fiyatsız", url.format(3), None, False)]
    assert listing.search_cards(parsed(spark, ("amazon", "u", html)), limit=1).count() == 2


def test_listing_cards(spark):
    card = "<li class=productCard><a href='/samsung-galaxy-tab-s10-{c}-p-HBC{i}'>Samsung Galaxy Tab S10 FE+ 8GB 128GB {n}</a><img alt='Samsung Tab {cap} GB {n}'><div>{p}</div></li>"
    rows = [("gumus", 1, "Gümüş", 128, "Premium ile 18.099 TL"), ("mavi", 2, "Mavi", 128, "Premium ile 18.049 TL"), ("gri", 3, "Gri", 128, "18.399 TL"), ("mavi", 4, "Mavi", 256, "22.923,32 TL")]
    html = "<ul>" + "".join(card.format(c=c, i=i, n=n, cap=cap, p=p) for c, i, n, cap, p in rows) + "</ul><footer><a href='/altbilgi-urun-p-HBC9'>x</a></footer>"
    got = listing.listing_cards(parsed(spark, ("hepsiburada", "https://www.hepsiburada.com/ara?q=x", html)), 10).orderBy("price").collect()
    assert [r.price for r in got] == [18049, 18099, 18399, D("22923.32")]
    assert [r.title.split(" / ", 1)[1] for r in got] == ["128 GB / Mavi", "128 GB / Gümüş", "128 GB / Gri", "256 GB / Mavi"]
    doc = {"items": [{"name": "Philips Hue lamba", "url": "/philips-hue-p-HBC7", "price": "1.500,00 TL", "merchantName": "Işıkçı", "renk": "Beyaz"}]}
    html = f"<script type='application/json'>{json.dumps(doc)}</script>"
    r = listing.listing_cards(parsed(spark, ("hepsiburada", "https://www.hepsiburada.com/ara?q=x", html))).first()
    assert (r.title, r.price, r.seller) == ("Philips Hue lamba / Beyaz", 1500, "Işıkçı")


def test_listing_offers(spark):
    doc = {"variants": [{"sku": "HBC1", "renk": "Gri", "variantListing": [
        {"listingId": "a", "merchantName": "Hepsiburada", "finalPriceOnSale": 10499.25, "prices": [{"formattedPrice": "10.499,25", "value": 10499.25}]},
        {"listingId": "b", "merchantName": "JetKlik", "minimumPrice": 12358.43, "finalPriceOnSale": 12358.43, "prices": [{"value": 900, "name": "kupon"}]}]},
        {"sku": "HBC2", "variantListing": [{"listingId": "c", "merchantName": "Ucuz", "finalPriceOnSale": 99}]}]}
    html = f"<h1>Govee Lamba</h1><script>window.S = {json.dumps(doc)};</script>"
    p = parsed(spark, ("hepsiburada", "https://www.hepsiburada.com/govee-p-HBC1", html))
    assert [(r.seller, r.price) for r in listing.listing_offers(p).orderBy("price").collect()] == [("Hepsiburada", D("10499.25")), ("JetKlik", D("12358.43"))]
    assert listing.variant_labels(p).first().label == "Gri"
    bare = parsed(spark, ("hepsiburada", "https://www.hepsiburada.com/", html))
    assert listing.listing_offers(bare).count() == 3


def test_variant_links_and_labels(spark):
    html = "<div class='variant-list'><a href='/urun-a-p-HBC2?x=1'>256</a><a href='/urun-a-pm-HBC2'>256</a><a href='/urun-b-p-HBC3'>512</a></div><div><div><div><div><a href='/diger-p-HBC4'>benzer</a></div></div></div></div><p>Renk</p><p>Mavi</p><p>Kapasite: 128 GB</p><p>Ürün bilgileri</p><p>Beden: L</p>"
    p = parsed(spark, ("hepsiburada", "https://www.hepsiburada.com/urun-p-HBC1?y=2", html))
    root = "https://www.hepsiburada.com/urun"
    assert [r.url for r in listing.variant_links(p).orderBy("pos").collect()] == [root + "-p-HBC1", root + "-a-p-HBC2", root + "-b-p-HBC3"]
    r = listing.variant_labels(p).first()
    assert (r.label, r.capacity, r.colour) == ("Mavi / 128 GB", "128 GB", "Mavi")


def test_colour_links_and_used_list(spark):
    html = "<ul id=variation_color_name><li title='Renk: Mavi' data-defaultasin=B000000001><a href='/dp/B000000001?th=1'>x</a></li><li class=swatchUnavailable data-defaultasin=B000000002 title=Gri></li></ul><p>İkinci el</p>"
    p = parsed(spark, ("amazon", "https://www.amazon.com.tr/dp/B000000001", html))
    assert [(r.label, r.url) for r in listing.colour_links(p).collect()] == [("Mavi", "https://www.amazon.com.tr/dp/B000000001?th=1")]
    assert listing.used_offer_links(p).first().used_url == "https://www.amazon.com.tr/gp/offer-listing/B000000001?condition=used"


def test_member_price_context_reaches_past_many_amounts(spark):
    for n in (3, 12, 16):
        text = "premium ile kupon" + "1TL" * n + " 99TL"
        row = spark.createDataFrame([(text,)], "t string").select(evidence.member_prices(F.col("t")).alias("p")).first()
        assert D("99") not in [x for x in row.p or []], n


def test_price_inside_the_row_needs_no_shuffle(spark):
    page = '<html><h1>Ürün adı uzun</h1><script type="application/ld+json">{"@type":"Product","offers":{"price":"12.5"}}</script><p class="own">77 TL</p></html>'
    parsed = dom.parse_pages(spark.createDataFrame([(1, "network", "https://x.org/1", page), (2, "network", "https://x.org/2", "<p>yok</p>")],
                                                   "page_id bigint, site string, url string, html string"))
    rows = evidence.priced_pages(parsed, "network")
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString().replace("BroadcastExchange", "")
    assert [(r.page_id, r.kind, r.price) for r in rows.collect()] == [(r.page_id, r.kind, r.price) for r in evidence.resolve_price(evidence.extract_evidence(parsed, "network")).collect()]


def test_a_site_brings_its_own_extractor(spark):
    page = '<html><p class="own">fiyat 77 lira</p></html>'
    own = lambda nodes, tokens, objects, html: F.regexp_extract(html, r"fiyat (\d+) lira", 1).try_cast("decimal(18,4)")
    evidence.register_site("ozel", ["meta", "spoken"], extractors={"spoken": own})
    try:
        parsed = dom.parse_pages(spark.createDataFrame([(1, "ozel", "https://x.org/1", page)], "page_id bigint, site string, url string, html string"))
        assert [(r.kind, r.price) for r in evidence.priced_pages(parsed, "ozel").collect()] == [("spoken", D(77))]
    finally:
        del evidence.REGISTRY["ozel"]


def test_json_in_escaped_strings(spark):
    inner = json.dumps({"sku": "K1", "title": 'Kutu "büyük"', "offers": [{"price": 41.5, "note": json.dumps({"deep": 1})}]})
    page = "<script>self.push([1," + json.dumps("7:" + inner + "\n") + "]); var broken = \"{\\\"a\\\": \"; var x = \"plain\";</script>"
    parsed = dom.parse_pages(spark.createDataFrame([(1, "s", "u", page)], "page_id bigint, site string, url string, html string"))
    rows = dom.json_objects(parsed).orderBy("ord").collect()
    assert [(r.source, r.text.get("sku"), r.text.get("price"), r.text.get("deep")) for r in rows] == [
        ("escaped", "K1", None, None), ("escaped", None, "41.5", None), ("escaped", None, None, "1")]


def test_long_scripts_are_scanned_once():
    import time

    begun = time.time()
    assert list(dom._payloads("", [{"type": "", "text": '"' + "\\\"a" * 300_000}])) == []
    assert time.time() - begun < 20


def test_references_without_a_semicolon(spark):
    html = "<a href='/x?a=1&lt=2'>k</a><h1>a&amp;&amp &lt;b&gt &am &#65;&#66 &amp;lt</h1><script>var s = 'x&amp';</script>"
    pages = spark.createDataFrame([(1, "s", "u", html)], PAGES)
    title = lambda parsed: evidence.extract_titles(parsed).first().title
    assert title(dom.parse_pages(pages)) == "a&& <b> &am AB &lt"
    assert dom.parse_pages(pages, open_references=False).first().scripts[0].text == "var s = 'x&amp';"
    assert title(dom.parse_pages(pages, open_references=False)) == "a&&amp <b&gt &am A&#66 &lt"
