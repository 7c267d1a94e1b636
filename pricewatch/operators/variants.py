"""Variants of a product page (colour, size, weight), their stock, and the choice of a requested size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed
from ..functions.labels import clean_size, display_title, size_matches, text_available
from ..functions.money import MONEY, parse_money
from ..functions.text import contains_any, fold_text, let, lets, one_space, rec, text_or_empty
from .dom import node_text
from .evidence import _below, is_type, offers_price, own_price, relative_path
from .skew import top_per_key

# --- Fixed values: field names of product data ------------------------------
NAME_KEYS = ["name", "title", "productName"]
COLOUR_KEYS = ["color", "colorName", "colour", "colourName", "swatchColorName"]
URL_KEYS = ["url", "link", "productUrl"]
PRICE_HOLDERS = ["prices", "price", "priceInfo", "currentPrice", "salePrice", "redPrice", "whitePrice", "offers"]
PRICE_VALUES = ["formattedValue", "formattedPrice", "currentPrice", "salePrice", "redPrice", "whitePrice", "price",
                "value", "amount"]
SIZE_HOLDERS = ["sizes", "sizeVariants", "variantSizes", "skus", "stock", "availability"]
SIZE_NAMES = ["name", "size", "sizeName", "label", "displayName", "value"]
VARIANT_HOLDERS = ["colors", "colourVariants", "colorVariants", "articles", "variants", "products"]
STOCK_KEYS = ["available", "inStock", "isAvailable", "stock", "stockLevel", "quantity", "availability"]
ZARA_PRICE_STEPS = ["offers", "priceSpecification", "price", "lowPrice", "highPrice"]


def field(o: Column, keys: list[str]) -> Column:
    """First non-empty scalar field."""
    return F.coalesce(*[F.nullif(o["text"][k], F.lit("")) for k in keys])


def children(objects: Column, p: Column, step: str, item: bool | None = None) -> Column:
    """Objects directly under a field of `p`; `item` asks for list items or for the field's own object."""
    rule = lambda o: (
        (o["parent"] == p["ord"]) & (F.element_at(o["path"], -1) == step)
        & (F.lit(True) if item is None else (o["item"] == item))
    )
    return F.filter(objects, rule)


def mapped(objects: Column, p: Column, step: str) -> Column:
    """Objects that are the values of a map under a field of `p`."""
    return F.filter(
        objects,
        lambda o: ~o["item"] & (F.try_element_at(o["above"], F.lit(-2)) == p["ord"])
        & (F.try_element_at(o["path"], F.lit(-2)) == step),
    )


def scalar_available(text: Column, kind: Column, words: list[str] | None = None) -> Column:
    """Availability of a scalar: a flag, a number above zero, or wording."""
    return (
        F.when(text.isNull(), F.lit(True))
        .when(kind == "b", text == "true")
        .when(kind == "n", text.try_cast("double") > 0)
        .otherwise(text_available(text, words))
    )


def object_available(o: Column) -> Column:
    """First stock field of an object, else the wording of all its fields."""
    names = F.filter(F.array(*[F.lit(k) for k in STOCK_KEYS]), lambda k: F.map_contains_key(o["text"], k))

    def rule(key):
        words = F.array_join(F.map_values(o["text"]), " ")
        value = F.when(key.isNull(), words).otherwise(o["text"][key])
        kind = F.when(key.isNull(), F.lit("s")).otherwise(o["kind"][key])
        return lets(scalar_available, value, kind)

    return let(F.try_element_at(names, F.lit(1)), rule)


# --- one extractor per data layout ------------------------------------------
def _zara(objects: Column, url: Column) -> Column:
    products = F.filter(objects, lambda o: (o["source"] == "ld+json") & is_type(o, "product"))
    holders = F.filter(products, lambda p: F.exists(objects, lambda o: (o["parent"] == p["ord"]) & (F.element_at(o["path"], -1) == "hasVariant")))
    chosen = _first_filled(holders, products)
    keys = ["price", "lowPrice", "highPrice"]

    def size_of(v):
        named = F.regexp_extract(text_or_empty(v["text"]["name"]), r"\b([A-Z]{1,3}\s*\([^)]*\)|[A-Z]{1,3})\b", 1)
        return clean_size(F.coalesce(field(v, ["size", "skuSize", "productSize"]), named))

    def row(p, v):
        colour = one_space(text_or_empty(F.coalesce(field(v, ["color"]), field(p, ["color"]))))
        return lets(lambda c, z, offers: shaped(p, v, c, z, offers), colour, size_of(v), children(objects, v, "offers"))

    def without_tail(name, part):
        tail = F.concat(F.lit(" - "), part)
        cut = (part != "") & fold_text(name).endswith(fold_text(tail))
        return F.when(cut, F.substr(name, F.lit(1), F.length(name) - F.length(tail))).otherwise(name)

    def shaped(p, v, colour, size, offers):
        name = clean_size(F.coalesce(field(p, ["name"]), field(v, ["name"]), F.lit("Zara ürünü")))
        name = let(let(name, lambda n: without_tail(n, size)), lambda n: without_tail(n, colour))
        stock = fold_text(F.array_join(F.transform(offers, lambda o: text_or_empty(o["text"]["availability"])), " "))
        offer_url = field(F.try_element_at(F.filter(offers, lambda o: ~o["item"]), F.lit(1)), ["url"])
        price = F.coalesce(offers_price(objects, v, keys, ZARA_PRICE_STEPS), offers_price(objects, p, keys, ZARA_PRICE_STEPS))
        return rec(
            title=display_title(name, colour, size), colour=colour, size=size,
            sizes=F.array(size), price=price.cast(MONEY),
            available=(~contains_any(stock, fixed.ZARA_SOLD_OUT_WORDS)),
            url=F.coalesce(field(v, ["url"]), offer_url, url), seller=F.lit("Zara"))

    def rows(p):
        parts = _first_filled(children(objects, p, "hasVariant"), F.array(p))
        return F.transform(parts, lambda v: row(p, v))

    return F.flatten(F.transform(chosen, rows))


def _holder_price(objects: Column, p: Column) -> Column:
    """Price of a product record: plain values or nested price objects of its price fields, in field order."""
    holders = F.array(*[F.lit(k) for k in PRICE_HOLDERS])
    inner = F.filter(objects, lambda o: _below(o, p))
    nested = F.transform(
        inner, lambda o: rec(holder=F.try_element_at(relative_path(o, p), F.lit(1)), price=own_price(o, PRICE_VALUES))
    )

    def by_holder(rows):
        def price(k):
            below = F.array_min(F.transform(F.filter(rows, lambda r: r["holder"] == k), lambda r: r["price"]))
            return F.coalesce(parse_money(F.nullif(p["text"][k], F.lit(""))), below)

        return F.try_element_at(F.array_compact(F.transform(holders, price)), F.lit(1))

    return let(nested, by_holder)


def _holder_sizes(objects: Column, p: Column) -> Column:
    """Array of (rank, size, available) of a product record: from a list of texts, of records, or a map. Only the
    first of the size fields that has any counts."""
    words = ["benzer urunler", "stokta yok", "tukendi", "out of stock", "sold out", "unavailable", "not available"]
    holders = F.array(*[F.lit(k) for k in SIZE_HOLDERS])

    def size(rank, name, available):
        return rec(rank=rank.cast("bigint"), size=clean_size(name), available=available)

    def holder(o, back):
        return F.array_position(holders, F.try_element_at(o["path"], F.lit(back)))

    texts = F.flatten(
        F.transform(
            F.filter(holders, lambda k: F.coalesce(p["kind"][k] == "l", F.lit(False))),
            lambda k: F.transform(
                F.split(p["text"][k], "\x1f"), lambda t: size(F.array_position(holders, k), t, F.lit(True))
            ),
        )
    )
    own = F.filter(objects, lambda o: (o["parent"] == p["ord"]) & (holder(o, -1) > 0))
    listed = F.transform(
        F.filter(own, lambda o: o["item"]), lambda o: size(holder(o, -1), field(o, SIZE_NAMES), object_available(o))
    )
    flat = F.flatten(
        F.transform(
            F.filter(own, lambda o: ~o["item"]),
            lambda o: F.transform(
                F.map_entries(o["text"]),
                lambda e: size(holder(o, -1), e["key"], scalar_available(e["value"], o["kind"][e["key"]], words)),
            ),
        )
    )
    deep = F.filter(
        objects, lambda o: ~o["item"] & (F.try_element_at(o["above"], F.lit(-2)) == p["ord"]) & (holder(o, -2) > 0)
    )
    by_key = F.transform(
        deep,
        lambda o: size(holder(o, -2), F.coalesce(field(o, SIZE_NAMES), F.element_at(o["path"], -1)), object_available(o)),
    )
    return F.filter(F.concat(texts, listed, flat, by_key), lambda x: x["size"] != "")


def _first_filled(a: Column, b: Column) -> Column:
    return let(a, lambda x: F.when(F.size(x) > 0, x).otherwise(b))


def _with_sizes(rows: DataFrame, owner: str, name: str) -> DataFrame:
    """Add the sizes of the first field that has any, null when none has."""
    found = _holder_sizes(F.col("objects"), F.col(owner))

    def first(sizes):
        rank = F.array_min(F.transform(sizes, lambda x: x["rank"]))
        return let(rank, lambda r: F.when(r.isNotNull(), F.filter(sizes, lambda x: x["rank"] == r)))

    return rows.withColumn(name, let(found, first))


def _hm_variants(parsed: DataFrame) -> DataFrame:
    """Product records, then their colour variants, then the sizes of each, one explode after the other."""
    objects, p, v = F.col("objects"), F.col("p"), F.col("v")
    named = F.filter(objects, lambda o: field(o, NAME_KEYS).isNotNull())
    rows = parsed.select("page_id", "site", F.col("url").alias("page_url"), "objects", F.posexplode(named).alias("pi", "p"))
    parts = F.concat(*[F.concat(children(objects, p, k, item=True), mapped(objects, p, k)) for k in VARIANT_HOLDERS])
    rows = rows.withColumns({"base": _holder_price(objects, p), "parts": parts})
    rows = _with_sizes(rows, "p", "base_sizes")
    rows = rows.where(F.col("base").isNotNull() | F.col("base_sizes").isNotNull() | (F.size("parts") > 0))
    rows = rows.select("page_id", "site", "page_url", "objects", "pi", "p", "base", F.posexplode(F.concat(F.array("p"), "parts")).alias("vi", "v"))
    rows = rows.withColumn("price", F.coalesce(_holder_price(objects, v), F.col("base")).cast(MONEY))
    rows = _with_sizes(rows, "v", "found")
    bare = F.array(rec(rank=F.lit(0).cast("bigint"), size=F.lit(""), available=F.lit(True)))
    rows = rows.withColumns(
        {
            "name": one_space(F.coalesce(field(v, NAME_KEYS), field(p, NAME_KEYS))),
            "colour": one_space(text_or_empty(F.coalesce(field(v, COLOUR_KEYS), field(p, COLOUR_KEYS)))),
            "raw": F.coalesce(field(v, URL_KEYS), field(p, URL_KEYS)),
            "found": F.coalesce("found", bare),
        }
    ).select("page_id", "site", "page_url", "pi", "vi", "name", "colour", "raw", "price", F.posexplode("found").alias("si", "s"))
    root = F.regexp_extract("page_url", "^[a-z]+://[^/?#]+", 0)
    raw = F.col("raw")
    link = F.when(raw.rlike("^https?://"), raw).when(raw.startswith("/"), F.concat(root, raw)).otherwise(F.col("page_url"))
    return rows.select(
        "page_id", "site", F.struct("pi", "vi", "si").alias("seq"), display_title(F.col("name"), F.col("colour"), F.col("s.size")).alias("title"),
        "colour", F.col("s.size").alias("size"), F.array("s.size").alias("sizes"), "price", F.col("s.available").alias("available"),
        link.alias("url"), F.lit("H&M").alias("seller"),
    )


def _bengurme(objects: Column, url: Column) -> Column:
    products = F.filter(objects, lambda p: F.size(children(objects, p, "variants", item=True)) > 0)

    def label_of(v):
        shown = one_space(text_or_empty(field(v, ["public_title", "title"])))
        options = F.filter(
            F.transform(F.array(*[v["text"][f"option{i}"] for i in (1, 2, 3)]), lambda x: one_space(text_or_empty(x))),
            lambda x: (x != "") & ~fold_text(x).isin(fixed.DEFAULT_VARIANT_NAMES),
        )
        return let(shown, lambda x: F.when(fold_text(x).isin(fixed.DEFAULT_VARIANT_NAMES), F.array_join(options, " / ")).otherwise(x))

    def row(p, v):
        title = one_space(F.coalesce(field(p, ["title", "name"]), F.lit("Ben Gurme ürünü")))
        return lets(lambda a, b: shaped(v, a, b), title, label_of(v))

    def shaped(v, title, label):
        raw, kind = v["text"]["price"], v["kind"]["price"]
        price = F.when(kind == "n", raw.try_cast(MONEY) / 100).otherwise(parse_money(F.nullif(raw, F.lit(""))))
        flag, fkind = v["text"]["available"], v["kind"]["available"]
        available = (
            F.when(fkind == "b", flag == "true")
            .when(F.coalesce(flag, F.lit("")) != "", ~fold_text(flag).isin("false", "0", "no"))
            .when(v["kind"]["inventory_quantity"] == "n", v["text"]["inventory_quantity"].try_cast("double") > 0)
            .otherwise(F.lit(True))
        )
        shown = F.when((label != "") & ~F.contains(fold_text(title), fold_text(label)), F.concat(title, F.lit(" / "), label)).otherwise(title)
        sizes = F.concat(F.array(label), F.array_compact(F.array(*[v["text"][f"option{i}"] for i in (1, 2, 3)])))
        return rec(
            title=shown, colour=F.lit(""), size=label, sizes=sizes,
            price=price.cast(MONEY), available=available, url=url, seller=F.lit("Ben Gurme"))

    return F.flatten(F.transform(products, lambda p: F.transform(children(objects, p, "variants", item=True), lambda v: row(p, v))))


LAYOUTS = {"zara": _zara, "bengurme": _bengurme}


def explode_variants(parsed: DataFrame, site: str) -> DataFrame:
    """One row per variant of the pages of a site: page_id, seq, title, colour, size, sizes, price, available, url,
    seller. Missing prices, colours and links come from the product; whole-number prices of the shop system that
    counts in minor units are divided by 100."""
    if site == "hm":
        return _hm_variants(parsed.where(F.col("site") == site))
    rows = LAYOUTS[site](F.col("objects"), F.col("url"))
    return parsed.where(F.col("site") == site).select("page_id", "site", F.posexplode(rows).alias("seq", "v")).select(
        "page_id", "site", "seq", "v.*"
    )


def apply_size(variants: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Offers of the requested size, and one outcome per page.

    `requests`: page_id, site, label, size. With a size: the available, priced variants that match; none gives
    out_of_stock with the reason not found, not available, or no price. Without: all available priced variants,
    for site zara only the cheapest.
    """
    v = requests.withColumnRenamed("size", "requested").join(variants.drop("site"), ["page_id"], "left")
    asked = F.trim(text_or_empty(F.col("requested"))) != ""
    fits = F.col("seq").isNotNull() & (~asked | F.coalesce(F.exists("sizes", lambda s: size_matches(s, F.col("requested"))), F.lit(False)))
    v = v.withColumns({"_asked": asked, "_fits": fits})
    good = F.col("_fits") & F.col("available") & F.col("price").isNotNull()
    first = ["page_id", "_t", "price", "_u"]
    offers = v.where(good).withColumns({"_t": fold_text(F.col("title")), "_u": fold_text(text_or_empty(F.col("url")))})
    offers = top_per_key(offers, first, [F.col("seq")])
    single = (F.col("site") == "zara") & ~F.col("_asked")
    cheapest = offers.where(single).groupBy("page_id").agg(F.min(F.struct("price", "seq")).alias("_best"))
    offers = (
        offers.join(cheapest, ["page_id"], "left")
        .where(F.col("_best").isNull() | (F.col("seq") == F.col("_best.seq")))
        .select("page_id", "site", "seq", "title", "colour", "size", "price", "url", "seller")
    )
    flags = v.groupBy("page_id", "site", "label", "requested", "_asked").agg(
        F.bool_or("_fits").alias("found"),
        F.bool_or(F.col("_fits") & F.col("available")).alias("stock"),
        F.bool_or(good).alias("ok"),
    )
    size = F.trim(F.col("requested"))
    missing = (
        F.when(~F.coalesce("found", F.lit(False)), F.concat("label", F.lit(" beden bulunamadı: "), size))
        .when(~F.coalesce("stock", F.lit(False)), F.concat("label", F.lit(" beden stokta değil: "), size))
        .otherwise(F.concat("label", F.lit(" beden fiyatı bulunamadı: "), size))
    )
    none = F.when(F.col("site") == "hm", F.lit("failed")).otherwise(F.lit("out_of_stock"))
    ok = F.coalesce("ok", F.lit(False))
    outcome = flags.select(
        "page_id",
        F.when(ok, F.lit("ok")).when(F.col("_asked"), F.lit("out_of_stock")).otherwise(none).alias("outcome"),
        F.when(ok, F.lit(None)).when(F.col("_asked"), missing).otherwise(
            F.concat("label", F.lit(" sayfasından stokta ürün fiyatı bulunamadı."))
        ).alias("reason"),
    )
    return offers, outcome


# --- is a size on the page, and available -----------------------------------
def _state(rows: Column) -> Column:
    """(found, available) over an array of availability flags."""
    return rec(found=(F.size(rows) > 0), available=F.exists(rows, lambda a: a))


def json_size_state(objects: Column, requested: Column) -> Column:
    sized = F.filter(objects, lambda o: o["source"].isin("ld+json", "json"))

    def named(entries, names):
        hit = F.filter(entries, lambda e: F.replace(fold_text(e["key"]), F.lit("_"), F.lit("")).isin(names))
        return F.try_element_at(hit, F.lit(1))

    def size_of(o):
        return clean_size(text_or_empty(named(F.map_entries(o["text"]), fixed.SIZE_FIELDS)["value"]))

    def stock_of(o):
        e = named(F.map_entries(o["text"]), fixed.STOCK_FIELDS)
        return F.when(e.isNotNull(), scalar_available(e["value"], o["kind"][e["key"]])).otherwise(
            text_available(F.array_join(F.map_values(o["text"]), " "))
        )

    hits = F.filter(sized, lambda o: (size_of(o) != "") & size_matches(size_of(o), requested))
    return _state(F.transform(hits, stock_of))


def dom_size_state(nodes: Column, tokens: Column, requested: Column) -> Column:
    def words(n):
        parent = F.try_element_at(nodes, n["parent"] + 1)
        return fold_text(
            F.concat_ws(
                " ", n["tag"], n["attrs"]["id"], F.array_join(n["classes"], " "),
                *[n["attrs"][a] for a in ("name", "data-testid", "data-test-id", "data-size", "aria-label")],
                parent["tag"], parent["attrs"]["id"], parent["attrs"]["name"], F.array_join(parent["classes"], " "),
            )
        )

    def fits(n):
        texts = F.array(n["attrs"]["data-size"], n["attrs"]["value"], node_text(tokens, n))
        return F.exists(texts, lambda x: F.coalesce((x != "") & size_matches(x, requested), F.lit(False)))

    def stock(n):
        off = F.map_contains_key(n["attrs"], "disabled") | F.coalesce(fold_text(n["attrs"]["aria-disabled"]) == "true", F.lit(False))
        return ~off & text_available(F.concat(words(n), F.lit(" "), node_text(tokens, n)))

    hits = F.filter(nodes, lambda n: n["tag"].isin(fixed.SIZE_TAGS) & contains_any(words(n), fixed.SIZE_CONTEXT_WORDS) & fits(n))
    return _state(F.transform(hits, stock))


def embedded_size_state(objects: Column, requested: Column) -> Column:
    """Authoritative size records of the shop that assigns its product to a script variable."""
    roots = F.filter(objects, lambda o: (o["source"] == "product") & (F.size(o["path"]) == 0))
    sizes = F.flatten(F.transform(roots, lambda p: children(objects, p, "Sizes", item=True)))
    hits = F.filter(sizes, lambda s: size_matches(text_or_empty(s["text"]["ValueText"]), requested))
    return _state(F.transform(hits, lambda s: ~F.coalesce(s["text"]["NoStock"], F.lit("")).isin("true", "1")))


def size_state(parsed: DataFrame, requests: DataFrame, records: DataFrame | None = None) -> DataFrame:
    """found and available of the requested size per page.

    Authoritative records decide when they know the size: those embedded in the page, or `records` (page_id,
    size, in_stock, stock_quantity) read separately. Otherwise any JSON size record or size control that is found
    and available counts. `requests`: page_id, requested.
    """
    p = parsed.join(requests, ["page_id"])
    nodes, tokens, objects, want = F.col("nodes"), F.col("tokens"), F.col("objects"), clean_size(F.col("requested"))
    out = p.select(
        "page_id", want.alias("_want"), embedded_size_state(objects, want).alias("_e"),
        json_size_state(objects, want).alias("_j"), dom_size_state(nodes, tokens, want).alias("_d"),
    )
    if records is not None:
        want_of = requests.select("page_id", clean_size(F.col("requested")).alias("_w"))
        known = records.join(want_of, ["page_id"]).where(size_matches(F.col("size"), F.col("_w"))).groupBy("page_id").agg(
            F.lit(True).alias("_rf"),
            F.bool_or(F.col("in_stock") & (F.col("stock_quantity").isNull() | (F.col("stock_quantity") > 0))).alias("_ra"),
        )
        out = out.join(known, ["page_id"], "left")
    else:
        out = out.withColumns({"_rf": F.lit(False), "_ra": F.lit(False)})
    blank = F.col("_want") == ""
    sure = F.coalesce("_rf", F.lit(False)) | F.col("_e.found")
    return out.select(
        "page_id",
        (blank | sure | F.col("_j.found") | F.col("_d.found")).alias("found"),
        F.when(blank, F.lit(True))
        .when(F.coalesce("_rf", F.lit(False)), F.coalesce("_ra", F.lit(False)))
        .when(F.col("_e.found"), F.col("_e.available"))
        .otherwise(F.col("_j.available") | F.col("_d.available"))
        .alias("available"),
    )
