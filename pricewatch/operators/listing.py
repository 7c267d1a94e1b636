"""Result pages and marketplace listings: cards, sellers, variant links and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed
from ..functions.labels import (
    capacity_label, clean_colour, clean_label, clean_variant_value, colour_label, good_title, infer_seller,
    ordered_variant_label, title_with_part,
)
from ..functions.money import MONEY, listing_price, parse_money, price_in_range
from ..functions.text import contains_any, fold_text, key_text, let, lets, one_space, rec, strip, text_or_empty
from ..functions.urls import canonical_listing_url, product_code, used_listing_url, variation_url
from .dom import first, inside, node_text, page_text, select
from .evidence import (
    _below, has_used_wording, is_member_context, lines_before_details, page_title, prefer_member_price, reference_floor, relative_path,
    used_card_price,
)
from .offers import dedup_candidates, last_value_by
from .skew import top_per_key
from .variants import children, field

# --- Fixed values: places on result pages -----------------------------------
CARD_SELECTORS = ["div.s-main-slot div[data-component-type='s-search-result'][data-asin]",
                  "div.s-main-slot div[data-cel-widget^='search_result_'][data-asin]",
                  "div[data-component-type='s-search-result'][data-asin]"]
CARD_TITLES = ["h2 a span", "h2 span", "a.a-link-normal h2 span", "[data-cy='title-recipe'] span", "a.a-link-normal span"]
CARD_LINKS = ["h2 a[href]", "a[href*='/dp/']", "a[href*='/gp/product/']", "a[href]"]
SWATCHES = ["#inline-twister-row-color_name li", "[id*='inline-twister-row-color'] li", "#variation_color_name li",
            "#variation_color li", "[id*='variation_color'] li"]
SELLER_KEYS = ["merchantName", "merchant_name", "sellerName", "seller_name"]
LINK_KEYS = ["url", "productUrl", "product_url", "link", "href"]
LISTING_NAME_KEYS = ["name", "title", "productName", "product_name"]
LISTING_PRICE_KEYS = ["finalPrice", "final_price", "salePrice", "sale_price", "currentPrice", "current_price",
                      "discountedPrice", "price", "formattedPrice", "formatted_price", "amount"]
OFFER_PRICE_FIELDS = ["finalPriceOnSale", "finalPrice", "final_price", "salePrice", "sale_price", "currentPrice",
                      "current_price", "discountedPrice", "price", "amount"]
MEMBER_VALUE_KEYS = ["value", "amount", "price", "finalPrice", "finalPriceOnSale", "minimumPrice"]
VARIANT_VALUE_KEYS = ["variantName", "variantValue", "variantValueName", "selectedValue", "optionValue", "displayName",
                      "label", "text", "name", "value", "color", "colour", "renk", "capacity", "storage", "depolama"]
FIELD_NAME_KEYS = ["fieldName", "attributeName", "propertyName", "optionName", "name", "label", "displayName"]


def _sub(nodes: Column, card: Column) -> Column:
    return F.filter(nodes, lambda n: inside(n, card))


# --- search cards -----------------------------------------------------------
def search_cards(parsed: DataFrame, limit: int = fixed.SCAN_LIMIT, depot_search: bool = False) -> DataFrame:
    """Cards of result pages in page order: page_id, pos, title, url, price, is_warehouse.

    Only visible cards with a code, a title and a link, before the heading that starts other results, the first
    `limit` of them. A card may give a new and a used offer; equal (link, condition) pairs count once. Cards
    without a price stay, with a null price.
    """
    nodes, tokens = F.col("nodes"), F.col("tokens")
    stop = F.array_position(F.transform(tokens, lambda x: contains_any(fold_text(x), fixed.SEARCH_STOP_HEADINGS)), True)
    before = F.when(stop > 0, stop - 1)
    chosen = F.array().cast(parsed.schema["nodes"].dataType)
    for s in reversed(CARD_SELECTORS):
        found = F.filter(select(nodes, s), lambda c: before.isNull() | (c["t0"] <= before))
        chosen = F.when(F.size(found) > 0, found).otherwise(chosen)
    cards = parsed.select("page_id", "tokens", "nodes", F.posexplode(chosen).alias("at", "card"))
    card = F.col("card")
    cards = cards.where((F.trim(card["attrs"]["data-asin"]) != "") & ~card["hidden"]).withColumn("sub", _sub(nodes, card))
    sub = F.col("sub")
    titles = [F.nullif(node_text(tokens, first(sub, s)), F.lit("")) for s in CARD_TITLES]
    titles += [F.nullif(strip(first(sub, f"[{a}]")["attrs"][a]), F.lit("")) for a in ("aria-label", "title", "alt")]
    href = F.coalesce(*[first(sub, s)["attrs"]["href"] for s in CARD_LINKS])
    rows = cards.select(
        "page_id", "at", F.coalesce(*titles).alias("title"),
        F.when(strip(href) != "", variation_url(strip(href), F.trim(card["attrs"]["data-asin"]))).alias("url"),
        _card_price(sub, tokens).alias("primary"), node_text(tokens, card).alias("text"),
    ).where("title is not null and url is not null")
    rows = top_per_key(rows, ["page_id"], [F.col("at")], max(1, int(limit)))
    used = used_card_price(F.col("text"))
    primary_used = F.lit(depot_search) & has_used_wording(F.col("text")) & (used.isNull() | (used == F.col("primary")))
    offer = lambda price, flag: rec(price=price.cast(MONEY), is_warehouse=flag)
    offers = F.filter(
        F.array(
            offer(F.col("primary"), primary_used),
            offer(F.when(~used.eqNullSafe(F.col("primary")), used), F.lit(True)),
        ),
        lambda o: o["price"].isNotNull(),
    )
    none = F.array(offer(F.lit(None), F.lit(False)))
    out = rows.select("page_id", "at", "title", "url", F.posexplode(F.when(F.size(offers) > 0, offers).otherwise(none)).alias("k", "o"))
    out = out.select("page_id", F.struct("at", "k").alias("pos"), "title", "url", "o.price", "o.is_warehouse")
    return top_per_key(out, ["page_id", "url", "is_warehouse"], [F.col("pos")]).withColumn("pos", F.col("pos.at"))


def _card_price(sub: Column, tokens: Column) -> Column:
    """Visible main amount of a card: never struck through, never hidden."""
    prices = F.filter(
        select(sub, ".a-price"),
        lambda p: ~F.array_contains(p["classes"], "a-text-price") & ~F.coalesce(p["attrs"]["data-a-strike"] == "true", F.lit(False)) & ~p["hidden"],
    )
    off, whole, part = select(sub, ".a-offscreen"), select(sub, ".a-price-whole"), select(sub, ".a-price-fraction")

    def one(p):
        o = F.try_element_at(F.filter(off, lambda n: inside(n, p)), F.lit(1))
        w = F.try_element_at(F.filter(whole, lambda n: inside(n, p)), F.lit(1))
        f = F.try_element_at(F.filter(part, lambda n: inside(n, p)), F.lit(1))
        wt = F.regexp_replace(node_text(tokens, w), r"[^\d.]", "")
        ft = F.coalesce(F.nullif(F.regexp_replace(node_text(tokens, f), r"\D", ""), F.lit("")), F.lit("00"))
        split = F.when(~w["hidden"] & (wt != ""), parse_money(F.concat(wt, F.lit(","), F.rpad(F.substring(ft, 1, 2), 2, "0"))))
        return F.coalesce(F.when(~o["hidden"], parse_money(node_text(tokens, o))), split)

    return F.try_element_at(F.array_compact(F.transform(prices, one)), F.lit(1))


def used_offer_links(parsed: DataFrame) -> DataFrame:
    """Link of the dedicated used-offer list of a product page, empty when the page shows no sign of one."""
    links = F.transform(select(F.col("nodes"), "a[href*='offer-listing']"), lambda n: strip(n["attrs"]["href"]))
    return parsed.select("page_id", used_listing_url(links, page_text(F.col("tokens")), F.col("url")).alias("used_url"))


# --- listing cards ----------------------------------------------------------
def listing_cards(parsed: DataFrame, limit: int = 24) -> DataFrame:
    """Offers of a listing page, cheapest first: page_id, title, price, url, seller.

    A product link counts with its nearest card that shows a price; pages without any card fall back to the JSON
    records of the page.
    """
    nodes, tokens = F.col("nodes"), F.col("tokens")
    footers = select(nodes, "footer")
    links = F.filter(
        select(nodes, "a[href]"),
        lambda a: a["attrs"]["href"].rlike(fixed.LISTING_URL_PATTERN) & ~F.exists(footers, lambda f: inside(a, f)),
    )
    rows = parsed.select("page_id", "tokens", "nodes", F.posexplode(links).alias("seq", "link"))
    link = F.col("link")
    above = F.slice(F.reverse(F.filter(nodes, lambda n: inside(link, n))), 1, 8)

    def is_card(n):
        shape = contains_any(fold_text(F.array_join(n["classes"], " ")), ["productcard", "productlistcontent"])
        text = one_space(node_text(tokens, n))
        priced = text.rlike(fixed.LISTING_PRICE_PATTERN) | F.exists(
            nodes, lambda x: inside(x, n) & F.coalesce(x["attrs"]["aria-label"].rlike(r"(?i)fiyat\s*:"), F.lit(False))
        )
        return (shape | n["tag"].isin("article", "li")) & priced & (F.length(text) <= 2600)

    rows = rows.withColumn("card", F.try_element_at(F.filter(above, is_card), F.lit(1))).where(F.col("card").isNotNull())
    card = F.col("card")
    rows = rows.withColumns({"sub": _sub(nodes, card), "text": node_text(tokens, card)})
    sub = F.col("sub")

    def shown(n):
        return one_space(F.coalesce(F.nullif(n["attrs"]["title"], F.lit("")), F.nullif(n["attrs"]["aria-label"], F.lit("")), node_text(tokens, n)))

    options = [one_space(text_or_empty(link["attrs"]["title"]))]
    options += [shown(first(sub, s)) for s in ("[data-test-id^='title'] a", "[data-test-id^='title']", "a[class*='title']", "h2", "h3")]
    options.append(shown(link))
    title = F.try_element_at(F.filter(F.array(*options), lambda x: x.isNotNull() & good_title(x)), F.lit(1))
    href = link["attrs"]["href"]
    url = F.when(href.rlike("^https?://"), href).otherwise(F.concat(F.lit(fixed.LISTING_BASE), href))
    found = rows.select(
        "page_id", "seq", title.alias("title"), F.array_min(prefer_member_price(F.col("text"), sub)).alias("price"),
        url.alias("url"), card_words(F.col("text"), sub).alias("card_text"),
    ).where("title is not null and price is not null")
    fallback = _json_cards(parsed).join(found.select("page_id").distinct(), ["page_id"], "left_anti")
    cards = found.unionByName(fallback).withColumns({"code": product_code(F.col("url")), "identity": F.lit("")})
    sellers = last_value_by(_seller_pairs(parsed), "key", "seller", "ordinal").withColumnRenamed("key", "_k")
    labels = last_value_by(_label_pairs(parsed), "key", "label", "ordinal").withColumnRenamed("key", "_k")
    keyed = cards.withColumn("_k", F.concat_ws(":", "page_id", "code")).join(sellers, ["_k"], "left").join(labels, ["_k"], "left")
    label = ordered_variant_label(F.split(text_or_empty(F.col("label")), " / "), F.col("title"), F.col("url"), F.col("card_text"))
    full = keyed.select(
        "page_id", "seq", "price", "url", "identity", F.coalesce("seller", infer_seller(F.col("title"))).alias("seller"),
        title_with_search_label(F.col("title"), label).alias("title"),
    )
    best = dedup_candidates(full.withColumn("identity", F.concat_ws(":", "page_id", "url")))
    return top_per_key(best, ["page_id"], [F.col("price"), F.col("seq")], max(1, int(limit))).drop("identity")


def card_words(text: Column, sub: Column) -> Column:
    """Text of a card and of its captions of up to 180 characters."""
    captions = F.flatten(F.transform(sub, lambda n: F.array(*[n["attrs"][a] for a in ("alt", "title", "aria-label")])))
    short = F.filter(captions, lambda c: F.coalesce(F.length(c).between(1, 180), F.lit(False)))
    return one_space(F.concat(text, F.lit(" "), F.array_join(short, " ")))


def title_with_search_label(title: Column, label: Column) -> Column:
    """Title and variant label; a colour that ends the title moves into the label."""
    def join(clean, shown):
        colour = F.try_element_at(F.filter(F.split(shown, " / "), lambda v: colour_label(v) != ""), F.lit(1))

        def without(c):
            n = F.length(clean) - F.length(c)
            ends = fold_text(clean).endswith(fold_text(c)) & (n > 1) & F.substr(clean, n, F.lit(1)).rlike(r"[\s,/-]")
            return F.when(ends, F.regexp_replace(F.substr(clean, F.lit(1), n), r"[\s,/-]+$", ""))

        base = F.coalesce(let(colour, without), clean)
        return F.when(shown == "", clean).otherwise(title_with_part(base, shown))

    return lets(join, one_space(text_or_empty(title)), clean_label(label))


def _object_link(o: Column) -> Column:
    """Product link of a JSON record: a named field, else any field that holds one."""
    named = F.filter(F.array(*[o["text"][k] for k in LINK_KEYS]), lambda v: F.coalesce(v.rlike(fixed.LISTING_URL_PATTERN), F.lit(False)))
    any_field = F.transform(
        F.filter(F.map_values(o["text"]), lambda v: v.rlike(fixed.LISTING_URL_PATTERN)),
        lambda v: F.regexp_extract(v, fixed.LISTING_URL_PATTERN, 0),
    )
    link = F.coalesce(F.try_element_at(named, F.lit(1)), F.try_element_at(any_field, F.lit(1)))
    return F.when(link.rlike("^https?://"), link).otherwise(F.concat(F.lit(fixed.LISTING_BASE), link))


def _json_cards(parsed: DataFrame) -> DataFrame:
    o = F.col("o")
    rows = parsed.select("page_id", F.explode("objects").alias("o")).select(
        "page_id", o["ord"].alias("seq"), one_space(field(o, LISTING_NAME_KEYS)).alias("title"),
        F.coalesce(*[listing_price(F.nullif(o["text"][k], F.lit(""))) for k in LISTING_PRICE_KEYS]).alias("price"),
        _object_link(o).alias("url"), F.lit("").alias("card_text"),
    )
    return rows.where(F.col("url").isNotNull() & F.col("price").isNotNull() & good_title(F.col("title")))


def _seller_pairs(parsed: DataFrame) -> DataFrame:
    """(page and product code, seller, ordinal) of the JSON records with a product link."""
    o, objects = F.col("o"), F.col("objects")
    rows = parsed.select("page_id", "objects", F.explode("objects").alias("o"))
    listed = F.try_element_at(children(objects, o, "listing", item=False), F.lit(1))
    seller = F.coalesce(field(listed, SELLER_KEYS), field(o, SELLER_KEYS))
    return rows.select(
        F.concat_ws(":", "page_id", product_code(_object_link(o))).alias("key"), one_space(seller).alias("seller"), o["ord"].alias("ordinal")
    ).where(F.col("seller").isNotNull() & ~F.col("key").endswith(":"))


def _label_pairs(parsed: DataFrame) -> DataFrame:
    o = F.col("o")
    rows = parsed.select("page_id", "objects", F.explode("objects").alias("o"))
    return rows.select(
        F.concat_ws(":", "page_id", product_code(_object_link(o))).alias("key"),
        object_variant_label(F.col("objects"), o).alias("label"), o["ord"].alias("ordinal"),
    ).where((F.col("label") != "") & ~F.col("key").endswith(":"))


# --- variant labels ---------------------------------------------------------
def object_variant_label(objects: Column, o: Column) -> Column:
    """Label of the values of a JSON record and the records inside it that are named like variant fields."""
    inner = F.concat(
        F.array(o),
        F.filter(
            objects,
            lambda x: _below(x, o) & ~F.exists(relative_path(x, o), lambda k: k.isin("variantListing", "listing", "listings", "prices", "minimumPrices")),
        ),
    )

    def values(x):
        named = F.exists(F.array(*[x["text"][k] for k in FIELD_NAME_KEYS]), lambda v: F.coalesce(fold_text(v).isin(fixed.VARIANT_FIELDS), F.lit(False)))
        always = F.array(*[x["text"][k] for k in VARIANT_VALUE_KEYS if k not in ("name", "label", "displayName", "text", "value")])
        field_values = F.when(named, F.array(*[x["text"][k] for k in VARIANT_VALUE_KEYS]))
        return F.concat(always, F.coalesce(field_values, F.array().cast("array<string>")))

    raw = F.filter(F.flatten(F.transform(inner, values)), lambda v: v.isNotNull())
    clean = F.filter(
        F.transform(raw, clean_variant_value),
        lambda v: (v != "") & ~contains_any(fold_text(v), ["http", "www", "hepsiburada", "hbc"]) & ~v.rlike(fixed.LISTING_PRICE_PATTERN),
    )
    return clean_label(F.array_join(F.slice(F.array_distinct(clean), 1, 4), " / "))


def line_variant_labels(tokens: Column) -> Column:
    """Values that follow a variant field name in the text before the product description, within 80 lines."""
    return let(lines_before_details(tokens), _line_values)


def _line_values(lines: Column) -> Column:
    names = sorted(fixed.VARIANT_FIELDS, key=len, reverse=True)
    pattern = "^(" + "|".join(names) + ")(?=$|[ :])"

    def value(line, i):
        low = F.regexp_replace(fold_text(line), "[ :]+$", "")
        return let(low, lambda x: lets(lambda a, b: _named_value(lines, line, i, a, b), x, F.regexp_extract(x, pattern, 1)))

    return F.filter(F.transform(F.slice(lines, 1, 80), value), lambda v: F.coalesce(v != "", F.lit(False)))


def _named_value(lines: Column, line: Column, i: Column, low: Column, name: Column) -> Column:
    following = clean_variant_value(F.try_element_at(lines, i + 2))
    after_colon = clean_variant_value(F.regexp_replace(line, "^[^:]*:", ""))
    after_name = clean_variant_value(F.substr(line, F.length(name) + 1))
    return (
        F.when(name == "", F.lit(""))
        .when(low == name, following)
        .when(low.startswith(F.concat(name, F.lit(":"))), after_colon)
        .otherwise(after_name)
    )


def variant_labels(parsed: DataFrame) -> DataFrame:
    """Label of the selected variant of a page: from its lines, else from the JSON record of its product code."""
    objects, code = F.col("objects"), product_code(F.col("url"))
    own = F.filter(objects, lambda o: (F.upper(o["text"]["sku"]) == code) & (code != ""))
    embedded = F.coalesce(F.try_element_at(F.transform(own, lambda o: object_variant_label(objects, o)), F.lit(1)), F.lit(""))
    lines = clean_label(F.array_join(line_variant_labels(F.col("tokens")), " / "))
    label = F.when(lines != "", lines).otherwise(embedded)
    return parsed.select("page_id", label.alias("label"), capacity_label(label).alias("capacity"), colour_label(label).alias("colour"))


# --- sellers of one product -------------------------------------------------
def listing_evidence(parsed: DataFrame) -> DataFrame:
    """Price evidence of the seller records of the selected product: page_id, listing, seller, url, price, context.

    Only the records under the entry whose code is the page's own count, so another variant's price cannot enter.
    A page whose link has no code gives all its seller records.
    """
    objects, code = F.col("objects"), product_code(F.col("url"))
    selected = F.slice(
        F.filter(objects, lambda o: (F.upper(o["text"]["sku"]) == code) & (F.size(children(objects, o, "variantListing", item=True)) > 0)), 1, 1
    )
    listings = F.flatten(F.transform(selected, lambda o: children(objects, o, "variantListing", item=True)))
    loose = F.filter(objects, lambda o: text_or_empty(o["text"]["listingId"]) != "")
    listings = F.when(code != "", listings).otherwise(loose)
    rows = parsed.select("page_id", "url", "objects", F.explode(listings).alias("o"))
    rows = rows.where(text_or_empty(F.col("o.text.merchantName")) != "")
    o = F.col("o")
    entry = lambda price, context: rec(price=price.try_cast(MONEY), context=context)
    plain = [entry(o["text"][k], F.lit(k)) for k in OFFER_PRICE_FIELDS]

    def words(x):
        short = F.map_filter(x["text"], lambda k, v: (x["kind"][k] == "s") & (F.length(v) <= 120))
        return F.array_join(F.map_values(short), " ")

    priced = F.transform(children(objects, o, "prices", item=True), lambda x: entry(x["text"]["value"], F.concat(F.lit("prices "), words(x))))
    least = F.transform(
        F.filter(
            children(objects, o, "minimumPrices", item=True),
            lambda x: is_member_context(words(x)) | F.contains(F.replace(key_text(words(x)), F.lit("_"), F.lit(" ")), F.lit("non segmented price")),
        ),
        lambda x: entry(x["text"]["value"], F.concat(F.lit("minimumPrices "), words(x))),
    )
    inner = F.concat(F.array(o), F.filter(objects, lambda x: _below(x, o)))
    member = F.flatten(
        F.transform(
            F.filter(inner, lambda x: is_member_context(words(x))),
            lambda x: F.array(*[entry(x["text"][k], words(x)) for k in MEMBER_VALUE_KEYS]),
        )
    )
    everything = F.filter(F.concat(F.array(*plain), priced, least, member), lambda e: price_in_range(e["price"]))
    last = [entry(o["text"]["minimumPrice"], F.lit("minimumPrice"))]
    usable = F.when(F.size(everything) > 0, everything).otherwise(F.filter(F.array(*last), lambda e: price_in_range(e["price"])))
    return rows.select(
        "page_id", "url", o["ord"].alias("listing"), one_space(o["text"]["merchantName"]).alias("seller"), F.explode(usable).alias("e")
    ).select("page_id", "url", "listing", "seller", "e.price", "e.context")


def listing_offers(parsed: DataFrame) -> DataFrame:
    """Sellers of the selected product, cheapest first: page_id, title, price, seller."""
    from .evidence import drop_noise_prices

    evidence = drop_noise_prices(listing_evidence(parsed))
    priced = reference_floor(evidence, ["page_id", "url", "listing", "seller"])
    titles = parsed.select("page_id", F.coalesce(page_title(F.col("nodes"), F.col("tokens")), F.lit("Hepsiburada ürünü")).alias("title"))
    rows = priced.join(titles, ["page_id"]).withColumns(
        {
            "identity": F.concat_ws(":", "page_id", product_code(F.col("url")), fold_text(F.col("seller"))),
            "seq": F.col("listing"),
        }
    )
    return dedup_candidates(rows).select("page_id", "title", "price", "seller")


# --- variant links ----------------------------------------------------------
def variant_links(parsed: DataFrame, limit: int = 8) -> DataFrame:
    """Distinct variant pages of a product page, its own link first: page_id, pos, url.

    A link counts when it, or one of its three nearest ancestors, mentions variant words.
    """
    nodes, tokens = F.col("nodes"), F.col("tokens")

    def words(n):
        return F.concat_ws(
            " ", n["attrs"]["title"], n["attrs"]["aria-label"], n["attrs"]["data-test-id"], F.array_join(n["classes"], " "), node_text(tokens, n)
        )

    def about_variants(a):
        near = F.slice(F.reverse(F.filter(nodes, lambda n: inside(a, n))), 1, 3)
        return contains_any(fold_text(F.concat_ws(" ", words(a), F.array_join(F.transform(near, words), " "))), fixed.VARIANT_CONTEXT_WORDS)

    links = F.filter(select(nodes, "a[href]"), lambda a: a["attrs"]["href"].rlike(fixed.LISTING_URL_PATTERN) & about_variants(a))
    urls = F.concat(F.array(F.col("url")), F.transform(links, lambda a: a["attrs"]["href"]))
    rows = parsed.where(product_code(F.col("url")) != "").select(
        "page_id", F.posexplode(F.transform(urls, canonical_listing_url)).alias("pos", "url")
    )
    coded = rows.withColumn("_code", product_code(F.col("url"))).where("_code != ''")
    distinct = top_per_key(coded, ["page_id", "_code"], [F.col("pos")]).drop("_code")
    return top_per_key(distinct, ["page_id"], [F.col("pos")], max(1, int(limit)))


def colour_links(parsed: DataFrame, limit: int = fixed.SCAN_LIMIT) -> DataFrame:
    """Colour variations of a product page: page_id, pos, label, url; from the page's state data, else its swatches."""
    nodes, tokens, objects = F.col("nodes"), F.col("tokens"), F.col("objects")
    state = F.filter(
        objects,
        lambda o: (F.size(o["path"]) >= 2) & (F.element_at(o["path"], -1) == "color_name") & (F.element_at(o["path"], -2) == "sortedDimValuesForAllDims")
        & fold_text(o["text"]["dimensionValueState"]).isin("available", "selected"),
    )
    from_state = F.transform(
        state,
        lambda o: rec(
            label=clean_colour(o["text"]["dimensionValueDisplayText"]),
            url=variation_url(
                F.coalesce(F.nullif(o["text"]["pageLoadURL"], F.lit("")), F.when(fold_text(o["text"]["dimensionValueState"]) == "selected", F.col("url"))),
                o["text"]["defaultAsin"],
            )),
    )

    def swatch(n):
        a = F.try_element_at(F.filter(nodes, lambda x: inside(x, n) & (x["tag"] == "a")), F.lit(1))
        img = F.try_element_at(F.filter(nodes, lambda x: inside(x, n) & (x["tag"] == "img")), F.lit(1))
        names = F.array(*[clean_colour(x["attrs"][k]) for x in (n, a, img) for k in ("title", "aria-label", "alt")], clean_colour(node_text(tokens, n)))
        code = F.coalesce(*[F.nullif(x["attrs"][k], F.lit("")) for x in (n, a) for k in ("data-asin", "data-defaultasin")])
        return rec(label=F.try_element_at(F.filter(names, lambda x: x != ""), F.lit(1)), url=variation_url(a["attrs"]["href"], code))

    found = F.array().cast("array<struct<label:string,url:string>>")
    for s in reversed(SWATCHES):
        usable = F.filter(select(nodes, s), lambda n: ~F.arrays_overlap(n["classes"], F.array(F.lit("swatchUnavailable"), F.lit("a-button-unavailable"))))
        found = F.when(F.size(usable) > 0, F.transform(usable, swatch)).otherwise(found)
    good = lambda arr: F.filter(arr, lambda v: (F.coalesce(v["label"], F.lit("")) != "") & (v["url"] != ""))
    chosen = F.when(F.size(good(from_state)) > 0, good(from_state)).otherwise(good(found))
    rows = parsed.select("page_id", F.posexplode(chosen).alias("pos", "v")).select("page_id", "pos", "v.label", "v.url")
    return top_per_key(top_per_key(rows, ["page_id", "url"], [F.col("pos")]), ["page_id"], [F.col("pos")], max(1, limit))

