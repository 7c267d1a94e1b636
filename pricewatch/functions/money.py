"""Money columns. Amounts are decimal(18,4) throughout, never floating point."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import fixed
from .text import let, one_space, strip, text_or_empty

MONEY = "decimal(18,4)"


def parse_money(c: Column) -> Column:
    """Amount from display text, or null.

    With both marks present the last one is the decimal mark. A comma alone is a decimal mark. Dots alone
    separate thousands when every later group has three characters, otherwise the dot is the decimal mark.
    """
    return let(F.regexp_replace(c.cast("string"), "[^0-9,.-]", ""), _amount)


def _amount(raw: Column) -> Column:
    comma, dot = F.contains(raw, F.lit(",")), F.contains(raw, F.lit("."))
    no_dots, no_commas = F.replace(raw, F.lit("."), F.lit("")), F.replace(raw, F.lit(","), F.lit(""))
    text = (
        F.when(comma & dot & ~raw.rlike(r",[^.]*$"), no_commas)
        .when(comma, F.replace(no_dots, F.lit(","), F.lit(".")))
        .when(raw.rlike(r"^[^.]*(\.[^.]{3})+$"), no_dots)
        .otherwise(raw)
    )
    return text.try_cast(MONEY)


def _thousands(whole: Column) -> Column:
    return F.translate(F.format_number(whole, 0), ",", ".")


def format_money(c: Column, currency: bool = False) -> Column:
    """Whole amount, cut toward zero, with dots between thousands."""
    whole = c.cast("bigint")
    text = F.when((c < 0) & (whole == 0), F.lit("-0")).otherwise(_thousands(whole))
    return F.concat(text, F.lit(" TL")) if currency else text


def format_signed(c: Column, currency: bool = False) -> Column:
    return F.concat(F.when(c >= 0, F.lit("+")).otherwise(F.lit("-")), format_money(F.abs(c), currency))


def money_from_text(c: Column) -> Column:
    """Amount from text the display functions wrote: dots are always thousands."""
    plain = F.translate(F.replace(strip(text_or_empty(c)), F.lit("TL"), F.lit("")), ", +.", ".")
    return let(plain, lambda x: F.when(x.rlike(r"^-?\d+(\.\d*)?$"), x.try_cast(MONEY)))


def display_money(c: Column, signed: bool = False) -> Column:
    """Rewrite display text as whole liras; text that is no amount passes through."""
    text = strip(text_or_empty(c))
    return let(text, lambda x: let(money_from_text(x), lambda amount: _display(x, amount, signed)))


def _display(text: Column, amount: Column, signed: bool) -> Column:
    body = F.concat(_thousands(F.abs(amount).cast("bigint")), F.lit(" TL"))
    if signed:
        minus = (amount < 0) | text.startswith("-")
        body = F.concat(F.when(minus, F.lit("-")).otherwise(F.lit("+")), body)
    return F.when(amount.isNotNull(), body).when(text == "", F.lit("-")).otherwise(text)


def display_range(c: Column, low: Column | None = None, high: Column | None = None) -> Column:
    dash = F.lit("-")
    lo = F.coalesce(low, dash) if low is not None else dash
    hi = F.coalesce(high, dash) if high is not None else dash
    text = F.coalesce(F.nullif(text_or_empty(c), F.lit("")), F.concat(lo, F.lit(" / "), hi))
    parts = F.filter(F.transform(F.split(text, "/"), strip), lambda x: x != "")
    shown = F.array_join(F.transform(parts, lambda x: display_money(x)), " / ")
    return F.when(F.size(parts) == 0, dash).otherwise(shown)


def difference_from_text(c: Column) -> Column:
    """Signed difference of a stored row, zero when unreadable."""
    raw = F.regexp_replace(F.coalesce(F.nullif(text_or_empty(c), F.lit("")), F.lit("0")), "[^0-9,.-]", "")
    text = F.replace(F.replace(raw, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    return F.coalesce(text.try_cast(MONEY), F.lit(0).cast(MONEY))


def is_target_hit(price: Column, target: Column, difference: Column | None = None,
                  flag: Column | None = None) -> Column:
    """The stored flag, else price at or under target, else a difference at or under zero."""
    tests = [] if flag is None else [flag]
    tests.append(price <= target)
    if difference is not None:
        tests.append(difference <= 0)
    return F.coalesce(*tests, F.lit(False))


def price_from_form(c: Column) -> Column:
    """Whole units of an entered price."""
    return parse_money(c).cast("bigint")


def price_input_text(c: Column) -> Column:
    def shown(text):
        amount = let(parse_money(text), format_money)
        return F.when(text == "", F.lit("")).otherwise(F.coalesce(amount, text))

    return let(strip(text_or_empty(c)), shown)


def number_or_text(c: Column) -> Column:
    """Struct(whole, number, text): digits as a whole number, else a number, else the text itself."""
    text = strip(text_or_empty(c))
    whole = F.when(text.rlike(r"^\d+$"), text.try_cast("bigint"))
    number = F.when(whole.isNull(), text.try_cast("double"))
    return F.struct(
        whole.alias("whole"),
        number.alias("number"),
        F.when((text != "") & whole.isNull() & number.isNull(), text).alias("text"),
    )


def target_reply(c: Column) -> Column:
    """Target price of a reply: must be a readable amount above zero."""
    return let(parse_money(F.nullif(strip(text_or_empty(c)), F.lit(""))), lambda amount: F.when(amount > 0, amount))


def price_in_range(c: Column, low=fixed.LISTING_MIN_PRICE, high=fixed.LISTING_MAX_PRICE) -> Column:
    return c.between(F.lit(low), F.lit(high))


def listing_price(c: Column) -> Column:
    """Marketplace amount text: dots without a comma are always thousands; must lie in the accepted range."""
    def amount_text(clean):
        found = F.regexp_extract(clean, fixed.LISTING_PRICE_PATTERN, 1)
        return F.coalesce(F.nullif(found, F.lit("")), clean)

    def amount(text):
        only_dots = F.contains(text, F.lit(".")) & ~F.contains(text, F.lit(","))
        return parse_money(F.when(only_dots, F.replace(text, F.lit("."), F.lit(""))).otherwise(text))

    text = let(one_space(text_or_empty(c)), amount_text)
    return let(let(text, amount), lambda a: F.when(price_in_range(a), a))
