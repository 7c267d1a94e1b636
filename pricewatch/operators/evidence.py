"""Price evidence of pages: all candidates of all kinds in one pass, then rules as data choose among them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .. import fixed
from ..functions.money import MONEY, listing_price, parse_money, price_in_range
from ..functions.text import contains_any, fold_text, let, lets, one_space, rec, strip, text_or_empty
from .dom import first, inside, node_text, page_text, select

# --- Fixed values: where sites show titles and prices -----------------------
TITLE_SELECTORS = ["#productTitle", "#title", "h1[data-test-id='title']", "h1.pr-new-br", "h1.product-name", "h1",
                   "meta[property='og:title']"]
FASHION_SELECTORS = [".product-detail__price", ".product-price", ".price-current", ".current-price", ".new-price",
                     ".discount-price", ".sales-price", "[data-testid='price']", "[itemprop='price']"]
PRICE_SELECTORS = {
    "trendyol": [".product-price-container .prc-dsc", ".product-price-container .prc-slg", ".prc-dsc", ".prc-slg",
                 "[data-testid='price-current-price']", "[itemprop='price']"],
    "network": FASHION_SELECTORS,
    "beymenclub": FASHION_SELECTORS,
    "nordbron": ["[class*='product-detail_price']", "[class*='price']", "[itemprop='price']"],
    "bengurme": ["[data-product-price]", ".product__price", ".product-price", ".price-item--sale", ".price-item",
                 "[itemprop='price']"],
    "hepsiburada": ["[data-test-id='price-current-price']", "[data-test-id='price-current-price'] span",
                    "[data-test-id='price']", "[itemprop='price']", "#offering-price", ".product-price", ".price"],
    "amazon": ["#corePriceDisplay_desktop_feature_div .a-price .a-offscreen",
               "#corePriceDisplay_desktop_feature_div .aok-offscreen", "#corePrice_feature_div .a-price .a-offscreen",
               "#corePrice_feature_div .aok-offscreen",
               "#corePriceDisplay_desktop_feature_div span[data-a-color='price'] .a-offscreen",
               "#corePrice_feature_div span[data-a-color='price'] .a-offscreen",
               "#tp_price_block_total_price_ww .a-offscreen", ".apexPriceToPay .a-offscreen", "#priceblock_ourprice",
               "#priceblock_dealprice"],
}
MAIN_PRICE_BLOCKS = ["#corePriceDisplay_desktop_feature_div", "#corePrice_feature_div", "#apex_desktop"]
DEFAULT_KINDS = ["jsonld", "meta", "selector", "script"]
POLICIES = {
    "trendyol": ["jsonld", "meta", "selector", "script", "text_first"],
    "nordbron": DEFAULT_KINDS,
    "bengurme": DEFAULT_KINDS,
    "network": ["basket", *DEFAULT_KINDS],
    "beymenclub": ["basket", *DEFAULT_KINDS],
    "amazon": ["active_row", "split", "no_trade_in", "selector", "jsonld", "meta"],
    "hm": ["jsonld", "meta", "text_min"],
    "hepsiburada": ["member", "selector", "listing_text"],
}


@dataclass
class Site:
    """What is needed to read a site: the order in which kinds of evidence count, its selectors, and extractors of its own.

    An extractor takes the columns nodes, tokens, objects and html of a parsed page and gives a price column.
    """

    kinds: list[str]
    selectors: list[str] = field(default_factory=list)
    extractors: dict[str, Callable[[Column, Column, Column, Column], Column]] = field(default_factory=dict)


REGISTRY: dict[str, Site] = {s: Site(k, PRICE_SELECTORS.get(s, [])) for s, k in POLICIES.items()}


def register_site(name: str, kinds: list[str], selectors: list[str] | None = None,
                  extractors: dict[str, Callable[[Column, Column, Column, Column], Column]] | None = None) -> None:
    """Plug in a site or replace its rules. `kinds` may name the built-in kinds of evidence and those of `extractors`."""
    REGISTRY[name] = Site(list(kinds), list(selectors or []), dict(extractors or {}))


# --- expressions over one parsed page ---------------------------------------
def page_title(nodes: Column, tokens: Column) -> Column:
    """First non-empty title of the ordered places."""
    out = []
    for s in TITLE_SELECTORS:
        raw = let(
            first(nodes, s), lambda n: F.coalesce(F.when(n["tag"] == "meta", n["attrs"]["content"]), node_text(tokens, n))
        )
        out.append(F.nullif(strip(raw), F.lit("")))
    return F.coalesce(*out)


def meta_price(nodes: Column) -> Column:
    out = []
    for attr, value in fixed.PRICE_META:
        tag = first(nodes, f"meta[{attr}='{value}']")
        out.append(parse_money(F.nullif(tag["attrs"]["content"], F.lit(""))))
    return F.coalesce(*out)


def _shown(nodes: Column, tokens: Column, selector: str) -> Column:
    def text(n):
        raw = [F.nullif(strip(n["attrs"][a]), F.lit("")) for a in ("content", "value")]
        return F.nullif(F.coalesce(*raw, node_text(tokens, n)), F.lit(""))

    return let(first(nodes, selector), text)


def selector_price(nodes: Column, tokens: Column, selectors: list[str], parse=parse_money) -> Column:
    """Amount of the first selector whose first element holds a readable one; attributes count before text."""
    return F.coalesce(*[parse(_shown(nodes, tokens, s)) for s in selectors]) if selectors else F.lit(None).cast(MONEY)


def visible_price(c: Column) -> Column:
    """Amount of visible text in which the fraction may directly follow the whole part."""
    joined = r"(?i)^.*?(\d{1,3}(?:\.\d{3})+)(\d{2})\s*TL.*$"

    def amount(x):
        dots = F.contains(x, F.lit("TL")) & ~F.contains(x, F.lit(",")) & F.contains(x, F.lit("."))
        return parse_money(F.when(dots, F.replace(x, F.lit("."), F.lit(""))).otherwise(F.nullif(x, F.lit(""))))

    return let(F.regexp_replace(strip(text_or_empty(c)), joined, "$1,$2 TL"), amount)


def script_price(html: Column) -> Column:
    """Lowest amount of the first pattern that finds any."""
    out = []
    for p in fixed.SCRIPT_PRICE_PATTERNS:
        out.append(F.array_min(F.transform(F.regexp_extract_all(html, F.lit(p), F.lit(1)), parse_money)))
    return F.coalesce(*out)


def pattern_prices(text: Column, patterns: list[str]) -> Column:
    """All amounts that the patterns find in the text."""
    return F.flatten(F.array(*[F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(1)), parse_money) for p in patterns]))


def basket_price(text: Column) -> Column:
    return F.array_min(pattern_prices(text, fixed.BASKET_PATTERNS))


def no_trade_in_price(text: Column) -> Column:
    def amount(low):
        part = [F.nullif(F.regexp_extract(low, fixed.NO_TRADE_IN_PATTERN, i), F.lit("")) for i in (1, 2, 3)]
        return visible_price(F.concat(part[0], F.lit(","), F.coalesce(part[1], part[2], F.lit("00")), F.lit(" TL")))

    return let(fold_text(text), amount)


def active_row_price(nodes: Column) -> Column:
    """Amount posted by the active buying row, else the lowest posted amount."""
    inputs = F.filter(
        nodes, lambda n: (n["tag"] == "input") & (n["attrs"]["name"] == "items[0.base][customerVisiblePrice][amount]")
    )
    active = F.filter(
        nodes,
        lambda n: (n["attrs"]["data-csa-c-is-in-initial-active-row"] == "true")
        | F.array_contains(n["classes"], "a-accordion-active"),
    )
    def amounts(rows):
        return F.array_compact(F.transform(rows, lambda n: visible_price(n["attrs"]["value"])))

    def choose(posted, rows):
        chosen = F.filter(posted, lambda n: F.exists(rows, lambda a: inside(n, a) | (n["pos"] == a["pos"])))
        return F.coalesce(F.try_element_at(amounts(chosen), F.lit(1)), F.array_min(amounts(posted)))

    return lets(choose, inputs, active)


def prices_of(nodes: Column) -> Column:
    """Price elements that are not struck through."""
    return F.filter(
        select(nodes, ".a-price"),
        lambda n: ~F.array_contains(n["classes"], "a-text-price")
        & ~F.coalesce(n["attrs"]["data-a-strike"] == "true", F.lit(False)),
    )


def split_price(nodes: Column, tokens: Column, around: Column | None = None) -> Column:
    """First amount shown as separate whole and fraction parts, strike-through prices left out."""
    prices = prices_of(nodes)
    if around is not None:
        prices = let(around, lambda blocks: F.filter(prices_of(nodes), lambda p: F.exists(blocks, lambda a: inside(p, a))))
    return lets(
        lambda ps, wholes, fractions: _first_split(tokens, ps, wholes, fractions),
        prices, select(nodes, ".a-price-whole"), select(nodes, ".a-price-fraction"),
    )


def _first_split(tokens: Column, prices: Column, wholes: Column, fractions: Column) -> Column:
    def amount(p):
        whole = F.try_element_at(F.filter(wholes, lambda w: inside(w, p)), F.lit(1))
        fraction = F.try_element_at(F.filter(fractions, lambda w: inside(w, p)), F.lit(1))
        w = F.nullif(F.regexp_replace(node_text(tokens, whole), r"[^\d.]", ""), F.lit(""))
        f = F.coalesce(F.nullif(F.regexp_replace(node_text(tokens, fraction), r"\D", ""), F.lit("")), F.lit("00"))
        return visible_price(F.concat(w, F.lit(","), F.rpad(F.substring(f, 1, 2), 2, "0"), F.lit(" TL")))

    return F.try_element_at(F.array_compact(F.transform(prices, amount)), F.lit(1))


def main_split_price(nodes: Column, tokens: Column) -> Column:
    return F.coalesce(*[split_price(nodes, tokens, F.slice(select(nodes, b), 1, 1)) for b in MAIN_PRICE_BLOCKS])


# --- JSON -------------------------------------------------------------------
def _below(o: Column, p: Column) -> Column:
    return F.array_contains(o["above"], p["ord"])


def relative_path(o: Column, p: Column) -> Column:
    return F.slice(o["path"], F.size(p["path"]) + 1, F.size(o["path"]) - F.size(p["path"]))


def is_type(o: Column, name: str) -> Column:
    types = F.split(F.lower(F.coalesce(o["text"]["@type"], F.lit(""))), "\x1f")
    return F.array_contains(types, name)


def own_price(o: Column, keys: list[str]) -> Column:
    """First readable amount among the fields of an object."""
    names = F.array(*[F.lit(k) for k in keys])
    amounts = F.transform(names, lambda k: parse_money(F.nullif(o["text"][k], F.lit(""))))
    return F.try_element_at(F.array_compact(amounts), F.lit(1))


def offers_price(objects: Column, p: Column, keys: list[str] | None = None, steps: list[str] | None = None) -> Column:
    """Lowest price of the offers of an object, at any depth of nested offers; an offer's own price hides deeper ones."""
    keys = keys or fixed.OFFER_PRICE_KEYS
    steps = steps or ["offers"]
    def on_chain(path):
        allowed = F.array(*[F.lit(s) for s in steps])
        return (F.try_element_at(path, F.lit(1)) == "offers") & (F.size(F.array_except(path, allowed)) == 0)

    chain = F.filter(objects, lambda o: _below(o, p) & let(relative_path(o, p), on_chain))
    rows = F.transform(chain, lambda o: rec(price=own_price(o, keys), ord=o["ord"], above=o["above"]))

    def lowest(priced):
        top = F.filter(priced, lambda o: ~F.exists(priced, lambda q: F.array_contains(o["above"], q["ord"])))
        return F.array_min(F.transform(top, lambda o: o["price"]))

    return let(F.filter(rows, lambda r: r["price"].isNotNull()), lowest)


def jsonld_products(objects: Column) -> Column:
    """Array of (title, price) of the objects typed Product."""
    typed = F.filter(objects, lambda o: (o["source"] == "ld+json") & is_type(o, "product"))
    return F.transform(
        typed,
        lambda p: rec(
            title=F.nullif(strip(text_or_empty(p["text"]["name"])), F.lit("")),
            price=offers_price(objects, p)),
    )


def jsonld_title(objects: Column) -> Column:
    return F.try_element_at(F.filter(F.transform(jsonld_products(objects), lambda p: p["title"]), lambda t: t.isNotNull()), F.lit(1))


def jsonld_price(objects: Column) -> Column:
    return F.array_min(F.transform(jsonld_products(objects), lambda p: p["price"]))


# --- marketplace texts ------------------------------------------------------
#: Characters of context on either side of an amount.
CONTEXT_CHARS = 56


def _amounts(text: Column, pattern: str) -> Column:
    """Array of (amount, before, after): every match of the pattern with up to CONTEXT_CHARS characters on either side.

    The text is cut before each match, so the surroundings come from the neighbouring pieces.
    """
    pieces = F.split(F.regexp_replace(text, pattern, "\x1e$1\x1f"), "\x1e")
    return let(pieces, _around)


def _around(pieces: Column) -> Column:
    reach = CONTEXT_CHARS + 1  # every piece after the first holds an amount, so at least one character

    def joined(some):
        return F.replace(F.array_join(some, ""), F.lit("\x1f"), F.lit(""))

    def one(piece, i):
        rest = F.regexp_replace(piece, "^[^\x1f]*\x1f", "")
        before = joined(F.slice(pieces, F.greatest(F.lit(1), i - reach + 1), F.least(i, F.lit(reach))))
        after = F.concat(rest, joined(F.slice(pieces, i + 2, F.lit(reach))))
        return rec(
            amount=F.substring_index(piece, "\x1f", 1),
            before=F.right(before, F.lit(CONTEXT_CHARS)),
            after=F.left(after, F.lit(CONTEXT_CHARS)),
            i=i)

    return F.filter(F.transform(pieces, one), lambda m: m["i"] > 0)


def clean_text_prices(text: Column) -> Column:
    """Amounts of a text without instalments, coupons and the like around them."""

    def judged(m):
        since_last = F.regexp_replace(m["before"], "(?is)^.*TL", "")
        near = F.concat(fold_text(since_last), F.lit(" "), fold_text(F.left(m["after"], F.lit(24))))
        wide = fold_text(F.concat(F.right(m["before"], F.lit(48)), m["amount"], F.left(m["after"], F.lit(48))))
        noise = contains_any(near, fixed.INSTALMENT_WORDS) | contains_any(wide, fixed.COUPON_WORDS)
        return F.when(~noise, listing_price(m["amount"]))

    found = _amounts(one_space(text_or_empty(text)), fixed.LISTING_PRICE_PATTERN)
    return F.array_compact(F.transform(found, judged))


def _after_marker(text: Column, markers: list[str], window: int = 160) -> Column:
    """First accepted amount within the window after each occurrence of a marker; campaign amounts are skipped."""
    import re

    clean = F.translate(one_space(text_or_empty(text)), "’`´", "'''")
    words = "|".join(re.escape(m) for m in markers)
    windows = F.regexp_extract_all(clean, F.lit(rf"(?iu)(?=((?:{words}).{{0,{window}}}))"), F.lit(1))

    def judged(m):
        campaign = contains_any(fold_text(F.concat(m["before"], m["amount"], m["after"])), fixed.CAMPAIGN_WORDS)
        return F.when(~campaign, listing_price(m["amount"]))

    def pick(raw):
        return let(F.substring(raw, 1, window), in_window)

    def in_window(segment):
        firsts = [
            F.try_element_at(F.array_compact(F.transform(_amounts(segment, p), judged)), F.lit(1))
            for p in (fixed.LISTING_PRICE_PATTERN, fixed.LISTING_PRICE_LIKE_PATTERN)
        ]
        return F.coalesce(*firsts)

    return F.array_compact(F.transform(windows, pick))


def member_prices(text: Column) -> Column:
    """Amounts offered to members."""
    return _after_marker(text, fixed.MEMBER_WORDS)


def cart_prices(text: Column) -> Column:
    """Amounts that apply in the cart."""
    return _after_marker(text, fixed.CART_WORDS)


def is_member_context(c: Column) -> Column:
    return contains_any(F.translate(fold_text(c), "’`´", "'''"), [w.replace("ö", "o").replace("ü", "u") for w in fixed.MEMBER_WORDS])


def label_price(nodes: Column) -> Column:
    """Amount in an accessibility label of the form `fiyat: ... TL`."""
    labels = F.transform(F.filter(nodes, lambda n: n["attrs"]["aria-label"].isNotNull()), lambda n: one_space(n["attrs"]["aria-label"]))
    found = F.transform(labels, lambda x: listing_price(F.nullif(F.regexp_extract(x, r"(?i)fiyat\s*:\s*([^,]+(?:,\d{2})?\s*TL)", 1), F.lit(""))))
    return F.try_element_at(F.array_compact(found), F.lit(1))


def prefer_member_price(text: Column, nodes: Column) -> Column:
    """Accepted amounts of a card: the lowest member price, else the labelled one, else the lowest cart price, else all."""
    lowest = F.coalesce(F.array_min(member_prices(text)), label_price(nodes), F.array_min(cart_prices(text)))
    return let(lowest, lambda x: F.when(x.isNotNull(), F.array(x)).otherwise(clean_text_prices(text)))


def drop_noise_prices(evidence: DataFrame) -> DataFrame:
    """Evidence rows whose context names no instalment, coupon or shipping cost."""
    return evidence.where(~contains_any(fold_text(text_or_empty(F.col("context"))), fixed.BLOCKED_PRICE_WORDS))


def reference_floor(evidence: DataFrame, keys: list[str]) -> DataFrame:
    """Price per group of evidence rows (price, context).

    Member prices win. Else, when named reference prices exist, rows under half of the highest one are dropped.
    The lowest remaining row is the price.
    """
    context = text_or_empty(F.col("context"))
    rows = evidence.where(price_in_range(F.col("price"))).withColumns(
        {"_member": is_member_context(context), "_ref": fold_text(context).isin(fixed.REFERENCE_PRICE_NAMES)}
    )
    tops = rows.groupBy(*keys).agg(
        F.max(F.when(F.col("_ref"), F.col("price"))).alias("_top"), F.min(F.when(F.col("_member"), F.col("price"))).alias("_mp")
    )
    kept = rows.join(tops, keys).where(
        F.col("_top").isNull() | F.col("_member") | (F.col("price") >= F.col("_top") * F.lit(fixed.REFERENCE_FLOOR_RATIO))
    )
    return kept.groupBy(*keys).agg(F.coalesce(F.min("_mp"), F.min("price")).alias("price"))


def low_stock_quantity(text: Column) -> Column:
    """Explicit `only N left` number above zero."""
    n = F.regexp_extract(fold_text(text), fixed.LOW_STOCK_PATTERN, 1).try_cast("int")
    return F.when(n > 0, n)


# --- used offers ------------------------------------------------------------
def has_used_wording(text: Column) -> Column:
    low = fold_text(text)
    return F.contains(low, F.lit("diger satin alma secenekleri")) & F.contains(low, F.lit("ikinci el urun"))


def has_depot_wording(text: Column) -> Column:
    low = fold_text(text)
    return F.contains(low, F.lit("amazon depo")) & contains_any(low, ["ikinci el", "kullanilmis", "used"])


def used_card_price(text: Column) -> Column:
    """Used price of a result card: both wordings must be present in the same text."""
    amount = parse_money(F.nullif(F.regexp_extract(fold_text(text), fixed.USED_PRICE_PATTERN, 1), F.lit("")))
    return F.when(has_used_wording(text), amount)


def split_new_used(normal: DataFrame, used: DataFrame) -> DataFrame:
    """Offers of a page and its verified used offers: a used row needs the wording of both the seller and the
    condition in its own text and a price that no new offer of the page has; equal used prices count once.

    `normal`: page_id, seq, title, price, stock_quantity. `used`: page_id, seq, title, text, price.
    """
    from .skew import top_per_key

    verified = used.where(has_depot_wording(F.col("text")) & F.col("price").isNotNull())
    own = verified.join(normal.select("page_id", "price").distinct(), ["page_id", "price"], "left_anti")
    once = top_per_key(own, ["page_id", "price"], [F.col("seq")])
    none = F.lit(None)
    n = normal.select("page_id", "seq", "title", "price", none.cast("string").alias("seller"), F.lit(False).alias("is_warehouse"), "stock_quantity")
    u = once.select("page_id", "seq", "title", "price", F.lit("Amazon Depo").alias("seller"), F.lit(True).alias("is_warehouse"),
                    none.cast("int").alias("stock_quantity"))
    return n.unionByName(u)


# --- evidence table ---------------------------------------------------------
def extract_titles(parsed: DataFrame) -> DataFrame:
    return parsed.select("page_id", "url", page_title(F.col("nodes"), F.col("tokens")).alias("title"))


def _evidence(site: str) -> tuple[Column, Column]:
    """Array of (kind, rank, price) of all kinds that the site's rules name, in their order, and the page's title."""
    rules = REGISTRY[site]
    nodes, tokens, objects, html = (F.col(c) for c in ("nodes", "tokens", "objects", "html"))
    text = page_text(tokens)
    parse = visible_price if site == "amazon" else parse_money
    prices = {
        "jsonld": lambda: jsonld_price(objects),
        "meta": lambda: meta_price(nodes),
        "selector": lambda: selector_price(nodes, tokens, rules.selectors, parse),
        "script": lambda: script_price(html),
        "text_first": lambda: F.try_element_at(pattern_prices(text, [fixed.TEXT_PRICE_PATTERN]), F.lit(1)),
        "text_min": lambda: F.array_min(pattern_prices(text, [fixed.HM_TEXT_PRICE_PATTERN])),
        "basket": lambda: basket_price(text),
        "active_row": lambda: active_row_price(nodes),
        "split": lambda: main_split_price(nodes, tokens),
        "no_trade_in": lambda: no_trade_in_price(text),
        "member": lambda: F.array_min(F.concat(cart_prices(text), member_prices(text))),
        "listing_text": lambda: F.array_min(clean_text_prices(F.array_join(lines_before_details(tokens), " "))),
    }
    prices |= {k: lambda build=build: build(nodes, tokens, objects, html) for k, build in rules.extractors.items()}
    rows = F.array(*[rec(kind=F.lit(k), rank=F.lit(i), price=prices[k]().cast(MONEY)) for i, k in enumerate(rules.kinds)])
    return rows, F.coalesce(jsonld_title(objects), page_title(nodes, tokens))


def extract_evidence(parsed: DataFrame, site: str) -> DataFrame:
    """All price evidence of the pages of one site, one row per kind: page_id, site, url, kind, rank, price, title.

    Every kind the site's rules name is computed in the same projection over the parsed page.
    """
    rows, title = _evidence(site)
    found = parsed.where(F.col("site") == site).select("page_id", "site", "url", title.alias("title"), F.explode(rows).alias("e"))
    return found.select("page_id", "site", "url", "e.kind", "e.rank", "e.price", "title").where(F.col("price").isNotNull())


def priced_pages(parsed: DataFrame, site: str) -> DataFrame:
    """`resolve_price(extract_evidence(...))` chosen inside the page's row, without a join or a shuffle."""
    rows, title = _evidence(site)
    best = F.try_element_at(F.filter(rows, lambda e: e["price"].isNotNull()), F.lit(1))
    found = parsed.where(F.col("site") == site).select("page_id", "site", "url", title.alias("title"), best.alias("e"))
    return found.where("e is not null").select("page_id", "site", "url", "e.kind", "e.price", "title")


def lines_before_details(tokens: Column) -> Column:
    """Visible text pieces before the product description."""
    stop = F.array_position(F.transform(tokens, lambda x: contains_any(fold_text(x), fixed.DETAIL_STOP_WORDS)), True)
    return let(
        stop.cast("int"),
        lambda at: F.slice(tokens, F.lit(1), F.when(at > 0, at - 1).otherwise(F.size(tokens))),
    )


def policy_table(spark: SparkSession) -> DataFrame:
    """Site, kind and priority of all registered sites; bounded by the registry."""
    rows = [(s, k, i) for s, r in REGISTRY.items() for i, k in enumerate(r.kinds)]
    return spark.createDataFrame(rows, "site string, kind string, priority int")


def resolve_price(evidence: DataFrame) -> DataFrame:
    """One price per page: the lowest of the first kind, in the site's order, that has any."""
    policy = F.broadcast(policy_table(evidence.sparkSession))
    best = F.min(F.struct("priority", "price", "kind", "title", "url"))
    return evidence.join(policy, ["site", "kind"]).groupBy("page_id", "site").agg(best.alias("b")).select(
        "page_id", "site", "b.url", "b.kind", "b.price", "b.title"
    )


def page_outcomes(parsed: DataFrame, resolved: DataFrame) -> DataFrame:
    """Outcome per page: protected and priceless pages are failures, never exceptions."""
    from ..functions.checks import age_gate, bot_gate

    rows = parsed.select(
        "page_id", "site", "url", age_gate(F.col("html")).alias("_age"), bot_gate(F.col("site"), F.col("html")).alias("_bot")
    ).join(resolved.select("page_id", "kind", "price", "title"), ["page_id"], "left")
    reason = (
        F.when(F.col("_age"), F.lit("Yaş doğrulaması gerekiyor."))
        .when(F.col("_bot"), F.lit("bot korumasi nedeniyle captcha sayfasi dondu."))
        .when(F.col("price").isNull(), F.lit("sayfasından fiyat bulunamadı."))
    )
    return rows.withColumns(
        {"reason": reason, "outcome": F.when(reason.isNull(), F.lit("ok")).otherwise(F.lit("failed"))}
    ).drop("_age", "_bot")

