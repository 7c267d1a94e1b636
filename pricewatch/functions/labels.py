"""Titles, sizes, stock words and variant labels."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from .. import fixed
from .text import contains_any, fold_text, let, lets, one_space, rec, strip, text_or_empty


# --- sizes and stock --------------------------------------------------------
def clean_size(c: Column) -> Column:
    return one_space(F.regexp_replace(text_or_empty(c), r"\([^)]*\)", " "))


def size_tokens(c: Column) -> Column:
    return _tokens(fold_text(clean_size(c)))


def _tokens(folded: Column) -> Column:
    found = F.regexp_extract_all(folded, F.lit("([a-z0-9]+)"), F.lit(1))
    return F.array_except(found, F.array(*[F.lit(w) for w in fixed.SIZE_UNIT_WORDS]))


def size_matches(candidate: Column, requested: Column) -> Column:
    """Equal after folding, or every requested token among the candidate's; an empty request always matches."""
    def test(have, want):
        wanted, held = _tokens(want), _tokens(have)
        subset = let(wanted, lambda w: (F.size(w) > 0) & (F.size(F.array_except(w, held)) == 0))
        return (want == "") | (have == want) | subset

    return lets(test, fold_text(clean_size(candidate)), fold_text(clean_size(requested)))


def text_available(c: Column, words: list[str] | None = None) -> Column:
    """False for sold-out wording."""
    bad = fixed.SOLD_OUT_WORDS if words is None else words
    return let(fold_text(text_or_empty(c)), lambda x: ~x.isin(fixed.SOLD_OUT_EXACT) & ~contains_any(x, bad))


def value_available(v: Column) -> Column:
    """Availability of one variant value: a flag, a count above zero, or text without sold-out wording."""
    kind = F.schema_of_variant(v)
    as_text = F.try_variant_get(v, "$", "string")
    number = F.try_variant_get(v, "$", "double")
    return (
        F.when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean"))
        .when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), number > 0)
        .otherwise(text_available(as_text))
    )


# --- titles -----------------------------------------------------------------
def title_with_part(title: Column, part: Column) -> Column:
    """Append ` / part` unless the folded title already holds it."""
    def join(t, p):
        return F.when((p == "") | F.contains(fold_text(t), fold_text(p)), t).otherwise(F.concat(t, F.lit(" / "), p))

    return lets(join, one_space(text_or_empty(title)), one_space(text_or_empty(part)))


def display_title(name: Column, colour: Column, size: Column) -> Column:
    """Name, colour and size joined by ` / `, without blanks and repeats."""
    def join(first, c, s, lf, lc, ls):
        keep_c = (c != "") & (lc != lf)
        keep_s = (s != "") & (ls != lf) & ~(keep_c & (ls == lc))
        return F.concat_ws(" / ", first, F.when(keep_c, c), F.when(keep_s, s))

    def folded(first, c, s):
        return lets(join, first, c, s, fold_text(first), fold_text(c), fold_text(s))

    return lets(folded, *[one_space(text_or_empty(x)) for x in (name, colour, size)])


def clean_colour(c: Column) -> Column:
    """Colour caption without its field name and selection mark; empty when it names no colour."""
    text = one_space(text_or_empty(c))
    text = F.regexp_replace(text, r"(?i)^(?:renk|color|colour)\s*[:\-]\s*", "")
    text = F.regexp_replace(text, r"(?iu)\s*(?:seçili|selected)\s*$", "")
    bare = ["renk", "color", "colour", "secenek"]
    return let(text, lambda x: F.when((F.length(x) > 80) | fold_text(x).isin(bare), F.lit("")).otherwise(x))


def variant_group_label(title: Column) -> Column:
    def before_part(t):
        return (
            F.when(F.contains(t, F.lit(" / ")), F.substring_index(t, " / ", 1))
            .when(F.contains(t, F.lit(" — ")), F.substring_index(t, " — ", 1))
            .otherwise(t)
        )

    return strip(let(strip(text_or_empty(title)), before_part))


def good_title(c: Column) -> Column:
    return let(
        strip(text_or_empty(c)),
        lambda t: (F.length(t) >= 8) & ~t.rlike(r"^\d+$") & ~contains_any(fold_text(t), fixed.BAD_TITLE_WORDS),
    )


def default_group(group: Column, sites: Column, fallback: str = "") -> Column:
    """The given group, else the fashion group when a fashion site is among the card's sites."""
    g = strip(text_or_empty(group))
    fashion = F.exists(sites, lambda s: s.isin(fixed.FASHION_SITES))
    return F.when(g != "", g).when(F.coalesce(fashion, F.lit(False)), F.lit(fixed.FASHION_GROUP)).otherwise(
        F.lit(fallback)
    )


def infer_seller(title: Column) -> Column:
    """Words before the first known brand among the first five words, else the marketplace itself."""
    def owner(words):
        head = F.transform(F.slice(words, 1, 5), fold_text)
        brand = F.array_min(F.array_compact(F.transform(head, lambda w, i: F.when(w.isin(fixed.BRANDS), i))))
        return let(brand, lambda i: F.when(i > 0, F.array_join(F.slice(words, F.lit(1), i), " ")))

    words = F.filter(F.split(one_space(text_or_empty(title)), " "), lambda w: w != "")
    return F.coalesce(let(words, owner), F.lit(fixed.DEFAULT_SELLER))


# --- variant labels ---------------------------------------------------------
def clean_variant_value(c: Column) -> Column:
    """One variant value without trailing page text; empty for field names, prices and other noise."""
    cut = F.regexp_replace(
        one_space(text_or_empty(c)), r"(?su)\b(?:" + "|".join(fixed.VARIANT_CUT_WORDS) + r")\b.*$", ""
    )
    def judged(v, low):
        noise = (
            (F.length(v) > 48)
            | low.isin(fixed.VARIANT_FIELDS)
            | low.isin(fixed.VARIANT_FORBIDDEN)
            | contains_any(low, fixed.VARIANT_NOISE_WORDS)
        )
        return F.when(noise, F.lit("")).otherwise(v)

    v = one_space(F.btrim(cut, F.lit(" :-")))
    return let(v, lambda x: lets(judged, x, fold_text(x)))


def _first_spellings(values: Column) -> Column:
    def distinct(clean, low):
        return F.filter(clean, lambda v, i: F.array_position(low, F.element_at(low, i + 1)) == i + 1)

    clean = F.filter(values, lambda v: v.isNotNull() & (v != ""))
    return let(clean, lambda c: lets(distinct, c, F.transform(c, fold_text)))


def clean_label(c: Column) -> Column:
    """Distinct clean values of a ` / ` separated label."""
    return F.array_join(_first_spellings(F.transform(F.split(text_or_empty(c), r"\s*/\s*"), clean_variant_value)), " / ")


def clean_display_title(c: Column) -> Column:
    """Title with its variant parts cleaned; parts that repeat the beginning of the title are dropped."""
    parts = F.filter(F.transform(F.split(one_space(text_or_empty(c)), r"\s*/\s*"), one_space), lambda p: p != "")
    return let(parts, _display_title)


def _display_title(parts: Column) -> Column:
    first = F.coalesce(F.try_element_at(parts, F.lit(1)), F.lit(""))
    bag = let(fold_text(first), lambda low: contains_and(low, ["nordbron", "stark", "sirt cantasi"]))
    base = F.when(bag, F.lit("Nordbron Stark Sırt Çantası")).otherwise(first)
    return let(base, lambda b: lets(lambda b2, low: _with_parts(b2, low, parts), b, fold_text(b)))


def _with_parts(base: Column, low: Column, parts: Column) -> Column:
    def repeats(v):
        lv = fold_text(v)
        two = F.slice(F.split(lv, " "), 1, 2)
        begins = (F.size(two) == 2) & (two == F.slice(F.split(low, " "), 1, 2))
        return (F.length(v) >= 12) & ~v.rlike(r"\d") & (((lv != "") & F.contains(low, lv)) | begins)

    rest = F.filter(
        F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts), F.lit(1))), clean_variant_value), lambda v: (v != "") & ~repeats(v)
    )
    return F.concat_ws(" / ", base, F.nullif(F.array_join(_first_spellings(rest), " / "), F.lit("")))


def contains_and(text: Column, words: list[str]) -> Column:
    rule = F.lit(True)
    for w in words:
        rule = rule & F.contains(text, F.lit(w))
    return rule


def capacity_label(c: Column) -> Column:
    """Last capacity of the text, preferring terabytes and values of 32 and more; empty when there is none."""
    pattern = r"(?i)(?<!\d)(?:\d+\s*/\s*)?(\d+)\s*(GB|TB)\b"
    text = one_space(text_or_empty(c))
    sizes = F.arrays_zip(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("n"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("u"),
    )
    def last(found):
        preferred = F.filter(found, lambda s: (F.upper(s["u"]) == "TB") | (s["n"].try_cast("bigint") >= 32))
        return F.coalesce(F.try_element_at(preferred, F.lit(-1)), F.try_element_at(found, F.lit(-1)))

    def label(s):
        return F.concat(s["n"].try_cast("bigint").cast("string"), F.lit(" "), F.upper(s["u"]))

    return F.coalesce(let(let(sizes, last), label), F.lit(""))


def colour_label(c: Column) -> Column:
    """First known colour word of the text in its display spelling; empty when there is none."""
    raw = one_space(text_or_empty(c))
    text = fold_text(F.translate(F.coalesce(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))), raw), "-_", "  "))

    def named(x):
        rule = F.lit("")
        for word, label in reversed(fixed.COLOURS):
            rule = F.when(x.rlike(rf"(^|\W){re.escape(word)}($|\W)"), F.lit(label)).otherwise(rule)
        return rule

    return let(text, named)


def ordered_variant_label(values: Column, *fallback: Column) -> Column:
    """Capacity, colour, then up to two other values; the fallback texts fill in a missing capacity or colour."""
    clean = F.filter(F.transform(values, clean_variant_value), lambda v: v != "")
    judged = F.transform(
        clean, lambda v: rec(v=v, cap=capacity_label(v), col=colour_label(v))
    )
    extra = F.concat_ws(" ", *[F.translate(text_or_empty(t), "-_", "  ") for t in fallback]) if fallback else F.lit("")

    def label(rows, cap, col):
        caps = F.concat(F.transform(F.filter(rows, lambda r: r["cap"] != ""), lambda r: r["cap"]), F.array(cap))
        cols = F.concat(
            F.transform(F.filter(rows, lambda r: (r["cap"] == "") & (r["col"] != "")), lambda r: r["col"]), F.array(col)
        )
        others = F.transform(F.filter(rows, lambda r: (r["cap"] == "") & (r["col"] == "")), lambda r: r["v"])
        some = lambda a: F.slice(F.filter(a, lambda x: x != ""), 1, 1)
        return F.array_join(F.concat(some(caps), some(cols), F.slice(_first_spellings(others), 1, 2)), " / ")

    return clean_label(let(extra, lambda x: lets(label, judged, capacity_label(x), colour_label(x))))
