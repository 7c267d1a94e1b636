"""Text columns: folding, keys, shortening, term lists, phrase tests.

Everything here is a built-in expression of the JVM, except `repair_mojibake` and
`fold_text_full`, which need Python codecs and run as Arrow batches. `let` and `lets` are
lambda functions, which Spark evaluates outside whole-stage code generation: they save
repeated work within an expression; for keys of very large tables use `withColumn` stages.
"""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

from .. import fixed


#: Blocks folded natively: Latin, combining marks, Greek, Cyrillic, punctuation, sub- and superscripts, enclosed and full-width
#: letters. `fold_text_full` covers the rest of Unicode.
_BLOCKS = (range(0x00A0, 0x0530), range(0x1AB0, 0x1ABE), range(0x1D00, 0x2190), range(0x2460, 0x24EB), range(0x2C60, 0x2C80),
           range(0xA640, 0xA69E), range(0xA720, 0xA7FF), range(0xFB00, 0xFB07), range(0xFF01, 0xFF5F))


def fold_word(word: str) -> str:
    """`fold_text` of one word in Python, for constants and for the tables below."""
    flat = unicodedata.normalize("NFKD", word.casefold())
    return " ".join("".join(c for c in flat if not unicodedata.combining(c)).replace("ı", "i").split())


def _letters() -> tuple[str, str, dict[str, str]]:
    """What single letters fold to: a translate table (letters without a counterpart vanish), and those that become several."""
    one, gone, several = {}, [], {}
    for code in (c for block in _BLOCKS for c in block):
        ch = chr(code)
        if ch.isspace():
            continue
        base = fold_word(ch)
        if " " in unicodedata.normalize("NFKD", ch.casefold()):
            several[ch] = "".join(c for c in unicodedata.normalize("NFKD", ch.casefold()) if not unicodedata.combining(c))
        elif base == "":
            gone.append(ch)
        elif len(base) > 1:
            several[ch] = base
        elif base != ch:
            one[ch] = base
    return "".join(one) + "".join(gone), "".join(one.values()), several


def _as_ranges(chars) -> str:
    """Character class with neighbours merged into ranges; a long enumeration is slow to test."""
    runs: list[list[int]] = []
    for code in sorted(map(ord, chars)):
        if runs and code - runs[-1][1] <= 1:
            runs[-1][1] = code
        else:
            runs.append([code, code])
    return "[" + "".join(f"\\u{lo:04x}-\\u{hi:04x}" for lo, hi in runs) + "]"


_SPACES = "".join(chr(c) for c in range(0x3001) if chr(c).isspace() and chr(c) != " ")
_FROM, _TO, _WIDE = _letters()
#: The look-ahead spares ASCII characters the test against every range of the class, which costs about a microsecond each.
_WIDE_CLASS = r"(?=[^\x00-\x7f])" + _as_ranges(_WIDE)


def let(value: Column, build) -> Column:
    """Evaluate `value` once and use it several times in `build(value)`.

    Without it, every use repeats the whole expression, and nested uses multiply.
    """
    return F.element_at(F.transform(F.array(value), lambda v: build(v)), 1)


def rec(**fields: Column) -> Column:
    """Struct with fixed field names; an alias inside a lambda may lose its name."""
    return F.named_struct(*[x for name, c in fields.items() for x in (F.lit(name), c)])


def lets(build, *values: Column) -> Column:
    """`let` for several values: `build(v1, v2, ...)`."""
    packed = rec(**{f"v{i}": v for i, v in enumerate(values)})
    return let(packed, lambda s: build(*[s[f"v{i}"] for i in range(len(values))]))


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(" " + _SPACES))


def one_space(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(c, _SPACES, " " * len(_SPACES)), " {2,}", " "))


def casefold(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def squash(c: Column) -> Column:
    """Case-insensitive text with single spaces."""
    return one_space(casefold(c))


def fold_text(c: Column) -> Column:
    """Case, accent and dotless-i insensitive text with single spaces.

    Covers the scripts of _BLOCKS natively; `fold_text_full` covers all of Unicode.
    """
    # white space first: it lines up with the blanks, and what has no counterpart vanishes
    source, target = "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + _SPACES + _FROM, "abcdefghijklmnopqrstuvwxyz" + " " * len(_SPACES) + _TO

    def flat(low):
        return F.trim(F.regexp_replace(F.when(low.rlike(_WIDE_CLASS), _spelled_out(low)).otherwise(low), " {2,}", " "))

    return let(F.translate(c, source, target), flat)


def _spelled_out(raw: Column) -> Column:
    """Text with the letters that fold to several replaced; one pass, for the rare text that has any."""
    table = F.str_to_map(F.lit("\x1e".join(f"{k}\x1f{v}" for k, v in _WIDE.items())), F.lit("\x1e"), F.lit("\x1f"))
    return let(table, lambda m: F.array_join(F.transform(F.split(raw, ""), lambda ch: F.coalesce(F.try_element_at(m, ch), ch)), ""))


@F.pandas_udf(StringType())
def fold_text_full(s: pd.Series) -> pd.Series:
    """`fold_text` with the full Unicode decomposition."""

    return s.map(lambda v: None if v is None else fold_word(v))


@F.pandas_udf(StringType())
def repair_mojibake(s: pd.Series) -> pd.Series:
    """Unescape entities and undo UTF-8 read as Latin-1, as long as each round removes damage."""
    marks = fixed.MOJIBAKE_MARKS

    def damage(v):
        return sum(v.count(m) for m in marks)

    def one(v):
        text = html.unescape(v or "")
        left = damage(text)
        for _ in range(3):
            if left == 0:
                break
            try:
                better = text.encode("latin-1").decode("utf-8")
            except UnicodeError:
                break
            now = damage(better)
            if now >= left:
                break
            text, left = better, now
        return text

    return s.map(one)


def key_text(c: Column) -> Column:
    """ASCII letters and digits joined by single underscores, lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(c, "[^a-zA-Z0-9]+", "_"), "^_+|_+$", ""))


def item_key(*parts: Column) -> Column:
    """Display key of several parts. Join on the raw columns, not on this: different parts can share a key."""
    return key_text(F.concat_ws("_", *[text_or_empty(p) for p in parts]))


def shorten(c: Column, n: int = 90) -> Column:
    clean = one_space(text_or_empty(c))
    cut = F.concat(F.regexp_replace(F.substring(clean, 1, n - 3), r"\s+$", ""), F.lit("..."))
    return F.when(F.length(clean) <= n, clean).otherwise(cut)


def short_link(c: Column, n: int = 74) -> Column:
    clean = strip(text_or_empty(c))
    cut = F.concat(F.regexp_replace(F.substring(clean, 1, n - 3), r"\s+$", ""), F.lit("..."))
    return F.when(clean == "", F.lit("-")).when(F.length(clean) <= n, clean).otherwise(cut)


def preview(c: Column, n: int = 1024) -> Column:
    return F.substring(one_space(text_or_empty(c)), 1, n)


def pad_cell(c: Column, width: int, align: str = "left") -> Column:
    text = shorten(c, width)
    return F.lpad(text, width, " ") if align == "right" else F.rpad(text, width, " ")


def request_label(source: Column, name: Column | None = None, detail: Column | None = None) -> Column:
    """Source, name and detail joined by bars; long parts are cut at 61 characters."""
    parts = [F.when(strip(text_or_empty(source)) == "", F.lit("İstek")).otherwise(strip(text_or_empty(source)))]
    for part in (name, detail):
        if part is not None:
            text = strip(text_or_empty(part))
            cut = F.when(F.length(text) > 64, F.concat(F.substring(text, 1, 61), F.lit("..."))).otherwise(text)
            parts.append(F.when(text != "", cut))
    return F.concat_ws(" | ", *parts)


def split_terms(c: Column) -> Column:
    """Comma or line separated list without blanks."""
    parts = F.transform(F.split(text_or_empty(c), r"[,\n\r\x0b\x0c\x1c-\x1e\u0085\u2028\u2029]"), strip)
    return F.filter(parts, lambda x: x != "")


def unique_text(arr: Column) -> Column:
    """First spelling of every text, ignoring case; blanks dropped."""
    clean = F.filter(F.transform(arr, lambda x: strip(text_or_empty(x))), lambda x: x != "")
    low = F.transform(clean, casefold)
    return F.filter(clean, lambda x, i: F.array_position(low, casefold(x)) == i + 1)


def contains_any(text: Column, words: list[str]) -> Column:
    """True when the text holds one of the words; one alternation instead of one scan per word."""
    if not words:
        return F.lit(False)
    import re

    return F.coalesce(text.rlike("|".join(re.escape(w) for w in words)), F.lit(False))


def match_phrase(c: Column) -> Column:
    """Folded words of ASCII letters and digits, separated by single spaces."""
    return F.trim(F.regexp_replace(fold_text(c), "[^a-z0-9]+", " "))


def title_matches(title: Column, phrase: Column) -> Column:
    """Whole-word phrase test; an empty phrase never matches."""
    pad = lambda x: F.concat(F.lit(" "), x, F.lit(" "))
    return let(match_phrase(phrase), lambda p: (p != "") & F.contains(pad(match_phrase(title)), pad(p)))


def specificity(c: Column) -> Column:
    """Number of words of a watch name; symbols stay part of their word."""
    return F.size(F.filter(F.split(fold_text(c), " "), lambda x: x != ""))


def keyword_caption(arr: Column) -> Column:
    label = F.when(F.size(arr) == 1, F.lit(fixed.ONE_KEYWORD)).otherwise(F.lit(fixed.MANY_KEYWORDS))
    return F.when(F.coalesce(F.size(arr), F.lit(0)) <= 0, F.lit(fixed.NO_KEYWORD)).otherwise(
        F.concat(label, F.lit(": "), F.array_join(arr, ", "))
    )


def clean_error(c: Column) -> Column:
    """Error text without link segments; remaining links masked."""
    text = strip(text_or_empty(c))
    parts = F.filter(F.transform(F.split(text, r"\|"), strip), lambda x: x != "")
    spoken = F.filter(parts, lambda x: ~x.rlike("^https?://"))
    body = F.when(F.size(spoken) > 0, F.array_join(spoken, " | ")).otherwise(text)
    body = one_space(F.regexp_replace(body, r"https?://\S+", "[link]"))
    return F.when(body == "", F.lit(fixed.NO_ERROR_DETAIL)).otherwise(body)


def error_links(c: Column) -> Column:
    """Distinct (url, message) pairs of the `;` separated segments that hold a link."""
    from .urls import first_url

    parts = F.filter(F.transform(F.split(text_or_empty(c), ";"), strip), lambda x: x != "")
    pairs = F.transform(parts, lambda x: F.struct(first_url(x).alias("url"), clean_error(x).alias("message")))
    return F.array_distinct(F.filter(pairs, lambda p: p["url"] != ""))


def message_link(username: Column, message_id: Column) -> Column:
    name = text_or_empty(username)
    return F.when(name == "", F.lit("")).otherwise(F.concat(F.lit("https://t.me/"), name, F.lit("/"), message_id))


def channel_label(title: Column, username: Column, chat_id: Column) -> Column:
    return F.coalesce(F.nullif(title, F.lit("")), F.nullif(username, F.lit("")), chat_id.cast("string"),
                      F.lit("Bilinmeyen kanal"))
