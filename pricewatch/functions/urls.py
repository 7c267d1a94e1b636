"""URL columns: canonical keys, site detection, link rules. All regular expressions over the text, no parsing UDF.

`try_parse_url` gives null for malformed links, which must be kept, so the parts are cut by pattern instead.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import fixed
from .text import casefold, contains_any, fold_text, let, lets, one_space, strip, text_or_empty

_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def scheme(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, _PARTS, 1))


def host(c: Column) -> Column:
    """Authority part in lower case."""
    return casefold(F.regexp_extract(text_or_empty(c), _PARTS, 2))


def path(c: Column) -> Column:
    return F.regexp_extract(text_or_empty(c), _PARTS, 3)


def query(c: Column) -> Column:
    return F.regexp_extract(text_or_empty(c), _PARTS, 4)


def before_query(c: Column) -> Column:
    return F.substring_index(c, "?", 1)


def first_url(c: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(text_or_empty(c), r"https?://\S+", 0), r"[.,;)\]}]+$", "")


def all_urls(c: Column) -> Column:
    found = F.regexp_extract_all(text_or_empty(c), F.lit(r"(?i)(https?://[^\s<>]+)"), F.lit(1))
    return F.transform(found, lambda u: F.regexp_replace(u, r"""[.,;:!?)\]}>'"]+$""", ""))


# --- query strings ----------------------------------------------------------
def _decoded(c: Column) -> Column:
    return F.coalesce(F.try_url_decode(c), c)


def _encoded(c: Column) -> Column:
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def query_params(c: Column) -> Column:
    """Array of (key, value) in order, decoded; parameters without a value have an empty one."""
    parts = F.filter(F.split(query(c), "&"), lambda p: p != "")
    return F.transform(
        parts,
        lambda p: F.struct(
            _decoded(F.substring_index(p, "=", 1)).alias("key"),
            _decoded(F.when(F.contains(p, F.lit("=")), F.regexp_replace(p, "^[^=]*=", "")).otherwise(F.lit(""))).alias(
                "value"
            ),
        ),
    )


def query_value(c: Column, key: str) -> Column:
    """First non-empty value of a parameter, else null."""
    hits = F.filter(query_params(c), lambda p: (p["key"] == key) & (p["value"] != ""))
    return F.try_element_at(hits, F.lit(1))["value"]


def kept_query(c: Column, names: list[str]) -> Column:
    """Query string with only the named parameters, re-encoded, in their order."""
    kept = F.filter(query_params(c), lambda p: p["key"].isin(names))
    return F.array_join(F.transform(kept, lambda p: F.concat(_encoded(p["key"]), F.lit("="), _encoded(p["value"]))), "&")


def query_name(c: Column) -> Column:
    """Search words of a link, cut at 160 characters."""
    values = [F.nullif(one_space(query_value(c, k)), F.lit("")) for k in fixed.QUERY_NAME_PARAMS]
    return F.substring(F.coalesce(*values, F.lit("")), 1, 160)


# --- sites ------------------------------------------------------------------
def detect_site(c: Column, hosts: list[tuple[str, str]] | None = None) -> Column:
    """Site of the first host fragment that matches, in list order; null when no site supports the link."""
    def first_match(h):
        rule = F.lit(None).cast("string")
        for fragment, site in reversed(fixed.SITE_HOSTS if hosts is None else hosts):
            rule = F.when(F.contains(h, F.lit(fragment)), F.lit(site)).otherwise(rule)
        return rule

    return let(host(c), first_match)


def site_label(c: Column, labels: dict[str, str] | None = None) -> Column:
    rule = F.initcap(c)
    for site, label in (fixed.SITE_LABELS if labels is None else labels).items():
        rule = F.when(c == site, F.lit(label)).otherwise(rule)
    return rule


def is_amazon(c: Column) -> Column:
    return F.contains(host(c), F.lit("amazon."))


def is_listing_site(c: Column) -> Column:
    return F.contains(host(c), F.lit("hepsiburada"))


def is_listing_product(c: Column) -> Column:
    return is_listing_site(c) & path(c).rlike(fixed.LISTING_URL_PATTERN)


def is_search_url(c: Column) -> Column:
    """True for result pages of the two marketplaces, which need a watch name."""
    product_path = path(c).rlike("/dp/|/gp/product/")
    amazon = is_amazon(c) & (
        (F.regexp_replace(path(c), "/+$", "") == "/s") | (query_value(c, "k").isNotNull() & ~product_path)
    )
    return amazon | (is_listing_site(c) & ~is_listing_product(c))


needs_name = is_search_url


def is_product_url(c: Column) -> Column:
    return (is_amazon(c) & path(c).rlike("/dp/|/gp/product/")) | is_listing_product(c)


def is_depot_search(c: Column) -> Column:
    """True only for the explicit used-goods search category."""
    hits = F.filter(
        query_params(c),
        lambda p: p["key"].isin("i", "s") & (F.replace(fold_text(p["value"]), F.lit("-"), F.lit(" ")) == "warehouse deals"),
    )
    return F.regexp_replace(path(c), "/+$", "").endswith("/s") & (F.size(hits) > 0)


# --- canonical forms --------------------------------------------------------
def absolute_url(c: Column, base: str = fixed.AMAZON_BASE) -> Column:
    return (
        F.when(c.rlike("^https?://"), c)
        .when(c.startswith("/"), F.concat(F.lit(base), c))
        .otherwise(F.concat(F.lit(base + "/"), c))
    )


def asin(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, "/(?:dp|gp/product)/([A-Z0-9]{10})", 1), F.lit(""))


def canonical_product_url(c: Column, fallback: Column | None = None) -> Column:
    def canon(full):
        code = asin(full) if fallback is None else F.coalesce(asin(full), F.nullif(fallback, F.lit("")))
        return F.coalesce(F.concat(F.lit(fixed.AMAZON_BASE + "/dp/"), code), before_query(full))

    return let(absolute_url(c), canon)


def canonical_url(c: Column) -> Column:
    """Stable URL key: product code form for the first marketplace; elsewhere lower scheme and host, no fragment,
    no trailing slash, query kept because it selects the variant."""

    def canon(url):
        root = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+", 0)

        def with_root(r):
            rest = F.substring_index(F.substr(url, F.length(r) + 1), "#", 1)
            rest = F.regexp_replace(rest, r"/+(;[^/?]*)?(\?|$)", "$1$2")
            plain = F.concat(casefold(r), F.regexp_replace(rest, r"[?;]$", ""))
            amazon = F.contains(F.lower(r), F.lit("amazon."))
            return (
                F.when(amazon, casefold(canonical_product_url(url))).when(r == "", _rootless(url)).otherwise(plain)
            )

        return let(root, with_root)

    return let(strip(text_or_empty(c)), canon)


def _rootless(url: Column) -> Column:
    """A link without scheme but with the first marketplace's host still has a product code."""
    named = F.contains(F.lower(F.regexp_extract(url, "^//([^/?#]*)", 1)), F.lit("amazon."))
    return F.when(named, casefold(canonical_product_url(url))).otherwise(url)


def condition(is_used: Column) -> Column:
    return F.when(F.coalesce(is_used, F.lit(False)), F.lit("warehouse")).otherwise(F.lit("normal"))


def offer_identity(url: Column, is_used: Column) -> Column:
    """Canonical URL and condition, empty for offers without a link."""
    return let(
        canonical_url(url),
        lambda canon: F.when(canon == "", F.lit("")).otherwise(F.concat(canon, F.lit("|"), condition(is_used))),
    )


def row_identity(tracking_id: Column, url: Column, is_used: Column) -> Column:
    tid = text_or_empty(tracking_id)
    return let(
        offer_identity(url, is_used),
        lambda ident: F.when((ident != "") & (tid != ""), F.concat(tid, F.lit("|"), ident)).otherwise(ident),
    )


def product_code(c: Column) -> Column:
    """Marketplace product code, upper case, or the article number of a product page; empty when absent."""
    code = F.nullif(F.upper(F.regexp_extract(text_or_empty(c), "(?i)-(?:p|pm)-([A-Z0-9]+)", 1)), F.lit(""))
    return F.coalesce(code, F.regexp_extract(text_or_empty(c), r"productpage\.(\d+)\.html", 1))


def canonical_listing_url(c: Column) -> Column:
    """Product link of the listing marketplace without query; empty for other hosts and review pages."""
    def canon(full, p):
        product = F.regexp_extract(p, fixed.LISTING_URL_PATTERN, 0)
        ok = (
            scheme(full).isin("http", "https")
            & host(full).isin(fixed.LISTING_HOSTS)
            & ~contains_any(fold_text(p), fixed.REVIEW_PATH_WORDS)
        )
        return F.when(ok, F.concat(F.lit(fixed.LISTING_BASE), F.nullif(product, F.lit(""))))

    base = F.lit(fixed.LISTING_BASE)
    full = let(strip(text_or_empty(c)), lambda r: F.when(r.startswith("/"), F.concat(base, r)).otherwise(r))
    return F.coalesce(let(full, lambda u: lets(canon, u, path(u))), F.lit(""))


def variation_url(c: Column, code: Column | None = None) -> Column:
    """Product link that keeps only the parameters selecting a variation or an offer."""
    def join(raw, alt, canon, kept):
        with_params = F.concat(F.lit(fixed.AMAZON_BASE), path(canon), F.lit("?"), kept)
        return F.when((raw == "") & (alt == ""), F.lit("")).when(kept == "", canon).otherwise(with_params)

    def parts(raw, alt):
        full = F.when(raw == "", F.lit("")).otherwise(absolute_url(raw))
        return let(full, lambda f: lets(join, raw, alt, canonical_product_url(f, alt), kept_query(f, fixed.VARIATION_PARAMS)))

    return lets(parts, text_or_empty(c), text_or_empty(code) if code is not None else F.lit(""))


def same_variation(a: Column, b: Column) -> Column:
    va, vb = variation_url(a, asin(a)), variation_url(b, asin(b))
    return (va != "") & (vb != "") & (va == vb)


def _with_query(c: Column, q: Column) -> Column:
    return F.concat(F.substring_index(before_query(c), "#", 1), F.lit("?"), q)


def clean_search_url(c: Column) -> Column:
    """Search link with only its stable parameters."""
    bare = F.regexp_replace(path(c), "/+$", "")
    kept = kept_query(c, fixed.SEARCH_PARAMS)
    fragment = F.regexp_extract(text_or_empty(c), _PARTS, 5)
    tail = F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise(F.lit(""))
    amazon = F.when(is_amazon(c) & bare.isin("/s", "/-/tr/s") & (kept != ""), F.concat(_with_query(c, kept), tail))
    q_only = kept_query(c, ["q"])
    listing_search = (F.lower(bare) == "/ara") | F.contains(F.lower(query(c)), F.lit("q="))
    listing = F.when(
        is_listing_site(c) & listing_search & (q_only != ""),
        F.concat(scheme(c), F.lit("://"), F.regexp_extract(c, _PARTS, 2), F.lit("/ara?"), q_only),
    )
    return F.coalesce(amazon, listing, c)


def url_variants(c: Column) -> Column:
    """Ordered distinct alternates under which a page may be archived."""

    def locale(u):
        bare = F.regexp_replace(path(u), "/+$", "")
        q = F.when(query(u) != "", F.concat(F.lit("?"), query(u))).otherwise(F.lit(""))
        root = F.concat(F.regexp_extract(u, _PARTS, 1), F.lit("://"), F.regexp_extract(u, _PARTS, 2))
        return F.when(is_amazon(u) & (bare == "/s"), F.concat(root, F.lit("/-/tr/s"), q)).when(
            is_amazon(u) & (bare == "/-/tr/s"), F.concat(root, F.lit("/s"), q)
        ).otherwise(u)

    kept = kept_query(c, fixed.VARIATION_PARAMS)
    canon = canonical_product_url(c)
    product = F.when(path(c).rlike("/dp/|/gp/product/"),
                     F.when(kept == "", canon).otherwise(F.concat(canon, F.lit("?"), kept))).otherwise(c)
    clean = clean_search_url(c)
    amazon = F.array(product, locale(product), c, locale(c), clean, locale(clean))
    bare = before_query(c)
    is_search = (F.lower(F.regexp_replace(path(c), "/+$", "")) == "/ara") | F.contains(F.lower(query(c)), F.lit("q="))
    coded = F.lower(path(bare)).rlike("-p-|-pm-")
    shop = F.when(coded, F.concat(F.substring_index(bare, "#", 1), F.lit("?magaza=Hepsiburada")))
    pm = F.when(F.contains(bare, F.lit("-pm-")), F.regexp_replace(bare, "^(.*?)-pm-", "$1-p-"))
    p = F.when(F.contains(bare, F.lit("-p-")), F.regexp_replace(bare, "^(.*?)-p-", "$1-pm-"))
    listing = F.when(is_search, F.array(c, clean)).otherwise(F.array(c, bare, shop, pm, p))
    chosen = F.when(is_amazon(c), amazon).when(is_listing_site(c), listing).otherwise(F.array(c))
    return F.array_distinct(F.filter(chosen, lambda u: u.isNotNull() & (u != "")))


def url_keys(c: Column) -> Column:
    """The link itself and the link without query and fragment."""
    url = strip(text_or_empty(c))
    bare = F.substring_index(F.substring_index(url, "#", 1), "?", 1)
    return F.when(url == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.array(url, bare)))


def title_from_url(c: Column, hosts: list[tuple[str, str]] | None = None) -> Column:
    """Readable name of a link: the words of its last path part, else the site, else the host."""
    url = strip(text_or_empty(c))
    last = F.substring_index(F.regexp_replace(path(url), "/+$", ""), "/", -1)
    slug = F.replace(F.replace(F.substring_index(last, "-p", 1), F.lit(".html"), F.lit("")), F.lit("-"), F.lit(" "))
    words = F.filter(F.split(one_space(slug), " "), lambda w: w != "")
    named = F.array_join(
        F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w))))), " "
    )
    bare_host = F.upper(F.substring_index(F.regexp_replace(host(url), r"^www\.", ""), ".", 1))
    return (
        F.when((F.size(words) > 0) & ~strip(slug).startswith("productpage."), named)
        .when(detect_site(url, hosts).isNotNull(), F.concat(site_label(detect_site(url, hosts)), F.lit(" ürünü")))
        .otherwise(F.concat(F.when(bare_host == "", F.lit("Ürün")).otherwise(bare_host), F.lit(" ürünü")))
    )


def used_listing_url(links: Column, page_text: Column, source_url: Column) -> Column:
    """First link to a used-offer list, else one built from the product code when the text mentions used goods."""

    def is_used(u):
        params = F.filter(
            query_params(u),
            lambda p: (F.lower(p["key"]) == "condition") & F.lower(p["value"]).isin("used", "secondhand"),
        )
        return F.contains(path(u), F.lit("offer-listing")) & (F.size(params) > 0)

    hits = F.filter(F.transform(links, lambda u: absolute_url(u)), is_used)
    built = F.when(
        F.contains(fold_text(page_text), F.lit("ikinci el")),
        F.concat(F.lit(fixed.AMAZON_BASE + "/gp/offer-listing/"), asin(source_url), F.lit("?condition=used")),
    )
    return F.coalesce(F.try_element_at(hits, F.lit(1)), built, F.lit(""))
