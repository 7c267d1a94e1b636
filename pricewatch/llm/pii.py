"""Personal data by anchor expansion.

An Aho-Corasick automaton runs once over each text and reports anchors: at-signs, plus signs, digits, URL schemes and cues
of identifiers. At each anchor a small deterministic parser expands to the left or right, finds the boundaries and validates.
Nothing else of the text is looked at. Within a kind, spans are leftmost and never overlap; kinds are independent.

Kinds. email, ip, card and phone follow fixed rules (see the parsers); failing matches are dropped and not tried again.
Added by this method: url (scheme, host and path; the boundary leaves out closing punctuation), iban (cue or two letters and
two digits at a word start, valid by its remainder of 97) and account (a cue such as "account", then 6 to 20 letters and digits
with at least 5 digits).

Rules: null text is empty; offsets are code points, ends exclusive; output is one row for each input row, in any number of
repeats.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewatch.llm.shared import map_texts

BASE = ("email", "ip", "card", "phone")
ADDED = ("url", "iban", "account")
KINDS = BASE + ADDED
# Anchors.
SCHEMES = ("http://", "https://", "ftp://", "HTTP://", "HTTPS://", "www.")
CUES = ("account", "Account", "acct", "Acct", "IBAN", "iban", "passport", "Passport", "customer id", "Customer ID", "SSN", "ssn")

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DIGITS = frozenset("0123456789")
_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").match
_ip = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)").match
_card = re.compile(r"[0-9](?:[ -]?[0-9])+").match
_phone = re.compile(r"\+[0-9][ ().0-9-]+[0-9]").match
_url = re.compile(r"[A-Za-z]*:?/{0,2}[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+(?::[0-9]{1,5})?(?:[/?#][^\s<>\"'`|\\^{}]*)?").match
_iban = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}").match
_gap = re.compile(r"(?:\s*(?:number|no|nr|id|num)\b)?[\s.:#=-]{0,4}", re.IGNORECASE).match
_account = re.compile(r"[A-Z0-9](?:-?[A-Za-z0-9]){5,19}(?![A-Za-z0-9])").match


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def iban_valid(text: str) -> bool:
    moved = text[4:] + text[:4]
    return 15 <= len(text) <= 34 and int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for word, kind in [("@", "at"), ("+", "plus"), *[(d, "digit") for d in "0123456789"], *[(s, "scheme") for s in SCHEMES],
                       *[(c, "cue") for c in CUES]]:
        a.add_word(word, (kind, len(word)))
    a.make_automaton()
    return a


def find(text: str, anchors: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all spans, by start, then kind in the order of KINDS."""
    spans: list[tuple[int, int, str]] = []
    done = dict.fromkeys(KINDS, 0)
    run = -2  # the last digit seen: parsers of digits start at the first of a run
    for last, (anchor, size) in anchors.iter(text):
        at = last - size + 1
        if anchor == "digit":
            first, run = run != at - 1, at
            if not first:
                continue
            if at >= done["ip"] and (m := _ip(text, at)):
                done["ip"] = m.end()
                if all(len(v := p.lstrip("0")) <= 3 and int(v or 0) <= 255 for p in m.groups()):
                    spans.append((at, m.end(), "ip"))
            if at >= done["card"] and (m := _card(text, at)):
                done["card"] = m.end()
                digits = m.group().replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    spans.append((at, m.end(), "card"))
            if at >= 2 and at - 2 >= done["iban"] and text[at - 2:at].isalpha() and (at == 2 or not text[at - 3].isalnum()):
                _take_iban(text, at - 2, spans, done)
        elif anchor == "plus":
            if m := _phone(text, at):
                if 9 <= sum(c in _DIGITS for c in m.group()) <= 15:
                    spans.append((at, m.end(), "phone"))
        elif anchor == "at":
            start, low = at, done["email"]
            while start > low and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _domain(text, at + 1)):
                done["email"] = m.end()
                spans.append((start, m.end(), "email"))
        elif anchor == "scheme":
            if at >= done["url"] and (at == 0 or not text[at - 1].isalnum()) and (m := _url(text, at)):
                end = at + len(m.group().rstrip(".,;:!?)]"))
                if end > at + size:
                    done["url"] = end
                    spans.append((at, end, "url"))
        elif at >= done["account"] and (at == 0 or not text[at - 1].isalnum()):
            start = _gap(text, last + 1).end()
            if start > last + 1 and (m := _account(text, start)) and sum(c in _DIGITS for c in m.group()) >= 5:
                done["account"] = m.end()
                spans.append((start, m.end(), "account"))
    order = {k: i for i, k in enumerate(KINDS)}
    return sorted(spans, key=lambda s: (s[0], order[s[2]], s[1]))


def _take_iban(text: str, at: int, spans: list, done: dict) -> None:
    if not (m := _iban(text, at)):
        return
    end = m.end()
    while end - at >= 15:  # the longest valid one that ends at a boundary
        if (end == len(text) or not text[end].isalnum()) and iban_valid(text[at:end].replace(" ", "")):
            done["iban"] = end
            spans.append((at, end, "iban"))
            return
        end -= 1


def spans(docs: DataFrame, keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """The columns in `keep` (doc_id by default) and spans array<struct<start, stop, kind>>."""

    def make():
        anchors = automaton()
        kind = pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("kind", pa.string())])

        def work(texts: list[str]) -> list[pa.Array]:
            return [pa.array([[{"start": a, "stop": b, "kind": k} for a, b, k in find(t, anchors)] for t in texts], type=pa.list_(kind))]

        return work

    return map_texts(docs, keep or ["doc_id"], text_col, [("spans", "array<struct<start:int,stop:int,kind:string>>")], make)


def mask(text: str, found: list[tuple[int, int, str]]) -> str:
    """The text with each span replaced by its kind in angle brackets; overlapping spans become one, named by the first."""
    out, at = [], 0
    for start, stop, kind in found:
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, stop)
    return "".join(out) + text[at:]


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows with personal data masked in the text; null stays null, n_chars follows if there is such a column."""

    def make():
        anchors = automaton()
        return lambda texts: [pa.array([mask(t, find(t, anchors)) for t in texts], type=pa.string())]

    others = [c for c in docs.columns if c != text_col]
    marked = docs.withColumn("__null", F.col(text_col).isNull())
    out = map_texts(marked, [*others, "__null"], text_col, [("__masked", "string")], make)
    out = out.withColumn(text_col, F.when(~F.col("__null"), F.col("__masked")))
    if "n_chars" in others and text_col == "text":
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.char_length(F.coalesce(text_col, F.lit(""))).cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)
