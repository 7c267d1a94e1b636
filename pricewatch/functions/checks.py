"""Validation as data: every check gives a value column and an error column instead of raising."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import fixed
from .money import parse_money
from .text import contains_any, fold_text, key_text, let, rec, strip, text_or_empty


def parse_flag(c: Column, default: bool = False) -> Column:
    """Null takes the default; otherwise true only for the accepted words."""
    word = F.lower(strip(c.cast("string")))
    return F.when(c.isNull(), F.lit(default)).otherwise(word.isin(fixed.TRUE_WORDS))


def _checked(value: Column, error: Column) -> Column:
    return rec(value=F.when(error.isNull(), value), error=error)


def bounded_int(c: Column, name: str, default: int, low: int, high: int) -> Column:
    """Struct(value, error); null takes the default."""
    def checked(value):
        error = F.when(value.isNull(), F.lit(f"{name} tam sayı olmalı.")).when(
            ~value.between(low, high), F.lit(f"{name} {low} ile {high} arasında olmalı.")
        )
        return _checked(value, error)

    given = strip(c.cast("string")).try_cast("bigint")
    return let(F.when(c.isNull(), F.lit(default).cast("bigint")).otherwise(given), checked)


def optional_int(c: Column, name: str, low: int | None = None, high: int | None = None) -> Column:
    """Struct(value, error); null and blank are allowed."""
    def checked(text):
        value = text.try_cast("bigint")
        error = F.when((text != "") & value.isNull(), F.lit(f"{name} tam sayı olmalı."))
        if low is not None:
            error = error.when(~value.between(low, high), F.lit(f"{name} {low} ile {high} arasında olmalı."))
        return _checked(value, error)

    return let(strip(text_or_empty(c)), checked)


def optional_price(c: Column, name: str = "price") -> Column:
    text = strip(text_or_empty(c))
    value = parse_money(text)
    return _checked(value, F.when((text != "") & value.isNull(), F.concat(F.lit("Fiyat ayrıştırılamadı: "), text)))


def required_text(c: Column, name: str, context: Column | None = None) -> Column:
    text = strip(text_or_empty(c))
    where = F.lit("") if context is None else context
    return _checked(text, F.when(text == "", F.concat(where, F.lit(f" için {name} alanı zorunlu."))))


# --- page and error gates ---------------------------------------------------
# A page that goes through several gates is folded once: `folded` is its `fold_text`, in a column of an earlier stage.
def age_gate(html: Column, folded: Column | None = None) -> Column:
    return contains_any(fold_text(html) if folded is None else folded, fixed.AGE_WORDS)


def bot_gate(site: Column, html: Column, folded: Column | None = None) -> Column:
    """True for a protection page of the given site."""
    text, low = fold_text(html) if folded is None else folded, F.lower(html)
    generic = F.contains(low, F.lit("captcha")) & F.contains(low, F.lit("robot"))
    nordbron_ok = (site == "nordbron") & F.contains(low, F.lit("product-detail_price"))
    return (
        F.when(site == "zara", F.contains(text, F.lit("bm-verify")) & F.contains(text, F.lit("_sec/verify")))
        .when(site == "hm", contains_any(text, fixed.BOT_WORDS["hm"]))
        .when((site == "hepsiburada") & contains_any(text, fixed.BOT_WORDS["hepsiburada"]), F.lit(True))
        .otherwise(generic & ~nordbron_ok)
    )


def amazon_protection(html: Column) -> Column:
    return contains_any(fold_text(html), fixed.AMAZON_PROTECTION_WORDS)


def usable_page(site: Column, html: Column, url: Column) -> Column:
    """True when the page shows the marks of the content that is expected of its site."""
    from .urls import path, query

    low, text = F.lower(html), fold_text(html)

    def has(c, *words):
        return contains_any(c, list(words))

    amazon_search = F.regexp_replace(path(url), "/+$", "").endswith("/s")
    listing_search = (F.lower(F.regexp_replace(path(url), "/+$", "")) == "/ara") | has(F.lower(query(url)), "q=")
    listing_product = F.lower(path(url)).rlike("-p-|-pm-")
    return (
        F.when(site == "amazon", has(low, "amazon") & ~amazon_protection(html)
               & (~amazon_search | has(low, *fixed.AMAZON_SEARCH_PAGE_WORDS)))
        .when((site == "hepsiburada") & listing_search, has(low, "hepsiburada") & has(low, "ara", "ürün", "urun"))
        .when(site == "hepsiburada", listing_product & has(low, "sepete ekle", "satıcı", "satici", "stok kodu"))
        .when(site == "beymenclub", has(html, "BEYMEN.productMain", "m-priceWrapper", "o-productDetail"))
        .when(site == "bengurme",
              (F.ltrim(html).startswith("{") & has(html, '"variants"')) | has(text, "shopify", "sepete ekle", "tukendi")
              | (has(text, "product") & has(text, "variants")))
        .when(site == "zara", has(text, "application/ld+json", "product-detail-info", "product-detail-size-selector",
                                  "hasvariant", "price__amount"))
        .otherwise(F.lit(True))
    )


def missing_price_error(text: Column, folded: Column | None = None) -> Column:
    """True for errors that mean the item or its price vanished."""
    return contains_any(fold_text(text) if folded is None else folded, fixed.MISSING_PRICE_WORDS)


def empty_search_is_normal(outcome: Column, text: Column, folded: Column | None = None) -> Column:
    """Classify a failed search: an empty result is normal, anything else is a failure."""
    normal = (outcome == "empty_search") | contains_any(fold_text(text) if folded is None else folded, fixed.EMPTY_SEARCH_WORDS)
    return F.coalesce(normal, F.lit(False))


def block_error(status: Column, text: Column) -> Column:
    marked = contains_any(key_text(text_or_empty(text)), fixed.BLOCK_KEY_WORDS)
    return F.coalesce(status.isin(fixed.BLOCK_STATUS), F.lit(False)) | marked
