r"""Chat formatting with masks aligned by offsets.

A conversation is rendered whole by one template, encoded once, and the token spans (code points) are intersected with the
sorted spans of the assistant turns by binary search. A token is under the loss mask if it overlaps an assistant text; what
the mask covers of the text is cut to the turn, so markers never count.

Template: `<|im_start|>ROLE\nTEXT<|im_end|>\n` for each turn. Control strings inside roles and texts (those of this template
and of other common ones) get a backslash after their first character, backslashes are doubled, and a newline in a role has a
backslash before it, so a reader gets back exactly what was written.

Rules: turns are ordered by turn, then role, then text, nulls first; null roles and texts are empty; a null conv_id is one
conversation of its own; repeated rows are repeated turns. Rows of a conversation meet in one group, as its text is one
string; conversations are independent.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricewatch.llm.shared import slices

START, END = "<|im_start|>", "<|im_end|>"
# Control strings of common chat templates.
CONTROL = (START, END, "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")

_control = re.compile("|".join(map(re.escape, CONTROL)))
_escaped = re.compile(r"\\(.)", re.DOTALL)
_header = re.compile(r"((?:[^\\\n]|\\.)*)\n", re.DOTALL)


def escape(text: str) -> str:
    doubled = text.replace("\\", "\\\\")
    return _control.sub(lambda m: m.group()[0] + "\\" + m.group()[1:], doubled)


def unescape(text: str) -> str:
    return _escaped.sub(r"\1", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the span of each turn's escaped text in it."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head = f"{START}{escape(role)}".replace("\n", "\\\n") + "\n"
        body = escape(text)
        spans.append((at + len(head), at + len(head) + len(body)))
        piece = f"{head}{body}{END}\n"
        out.append(piece)
        at += len(piece)
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts read back from a formatted conversation."""
    turns = []
    for piece in formatted.split(START)[1:]:
        head = _header.match(piece)
        turns.append((unescape(head.group(1)), unescape(piece[head.end():-len(END) - 1])))
    return turns


def loss_mask(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """For tokens with rising starts and ends, whether each overlaps one of the sorted, disjoint spans."""
    if not spans or not len(starts):
        return np.zeros(len(starts), dtype=bool)
    low, high = np.array([a for a, _ in spans]), np.array([b for _, b in spans])
    at = np.searchsorted(high, starts, side="right")  # the first span that ends after the token's start
    inside = at < len(spans)
    return inside & (low[np.minimum(at, len(spans) - 1)] < ends) & (ends > starts)


def covered(text: str, starts: np.ndarray, ends: np.ndarray, mask: np.ndarray, spans: list[tuple[int, int]]) -> list[str]:
    """Of each span, in order, the parts of the text under masked tokens, joined."""
    out = []
    a, b = starts[mask], ends[mask]
    for low, high in spans:
        first, last = np.searchsorted(b, low, side="right"), np.searchsorted(a, high, side="left")
        parts, at = [], low
        for s, e in zip(a[first:last].tolist(), b[first:last].tolist()):
            s, e = max(s, at), min(e, high)
            if e > s:
                parts.append((s, e))
                at = e
        out.append("".join(text[s:e] for s, e in parts))
    return out


def format_chats(turns: DataFrame, tokenizer: str) -> DataFrame:
    """conv_id, formatted, turns array<struct<role, start, stop>>, ids, starts, stops array<int>, mask array<boolean>.

    turns: conv_id, turn, role, text. tokenizer: path of a file of the `tokenizers` library that reports offsets.
    """
    spark = turns.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        vocabulary = spark.sparkContext.broadcast(f.read())
    empty = F.lit("")
    row = F.struct("turn", F.coalesce(F.col("role").cast("string"), empty).alias("role"), F.coalesce(F.col("text").cast("string"), empty).alias("text"))
    talks = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("t"))
    talks = talks.select("conv_id", F.col("t.role").alias("roles"), F.col("t.text").alias("texts"))
    ints = T.ArrayType(T.IntegerType())
    place = T.StructType([T.StructField("role", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())])
    schema = T.StructType([
        talks.schema["conv_id"], T.StructField("formatted", T.StringType()), T.StructField("turns", T.ArrayType(place)),
        T.StructField("ids", ints), T.StructField("starts", ints), T.StructField("stops", ints),
        T.StructField("mask", T.ArrayType(T.BooleanType()))])
    arrow_place = pa.struct([("role", pa.string()), ("start", pa.int32()), ("stop", pa.int32())])

    def run(batches):
        from tokenizers import Tokenizer

        encoder = Tokenizer.from_str(vocabulary.value)
        encoder.encode_special_tokens = True
        for batch in batches:
            for part in slices(batch, rows=128):
                made = [render(list(zip(r, t))) for r, t in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
                encoded = [encoder.encode(text, add_special_tokens=False) for text, _ in made]
                offsets = [np.array(e.offsets, dtype=np.int64).reshape(-1, 2) for e in encoded]
                masks = [
                    loss_mask(o[:, 0], o[:, 1], [s for s, r in zip(spans, roles) if r == "assistant" and s[1] > s[0]])
                    for o, (_, spans), roles in zip(offsets, made, part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array([text for text, _ in made], type=pa.string()),
                    pa.array([[{"role": r, "start": a, "stop": b} for r, (a, b) in zip(roles, spans)]
                              for roles, (_, spans) in zip(part.column(1).to_pylist(), made)], type=pa.list_(arrow_place)),
                    pa.array([e.ids for e in encoded], type=pa.list_(pa.int32())),
                    pa.array([o[:, 0] for o in offsets], type=pa.list_(pa.int32())),
                    pa.array([o[:, 1] for o in offsets], type=pa.list_(pa.int32())),
                    pa.array(masks, type=pa.list_(pa.bool_()))], names=schema.names)

    return talks.mapInArrow(run, schema)


def read_back(chats: DataFrame) -> DataFrame:
    """conv_id, roles, texts (read from the formatted string), loss_text (under the mask), formatted_chars."""
    strings = T.ArrayType(T.StringType())
    base = chats.select("conv_id", "formatted", "turns", "starts", "stops", "mask")
    schema = T.StructType([
        base.schema["conv_id"], T.StructField("roles", strings), T.StructField("texts", strings),
        T.StructField("loss_text", T.StringType()), T.StructField("formatted_chars", T.LongType())])

    def run(batches):
        for batch in batches:
            for part in slices(batch, rows=128):
                parsed, loss = [], []
                for text, turns, a, b, mask in zip(*(part.column(i).to_pylist() for i in range(1, 6))):
                    parsed.append(parse(text))
                    spans = [(t["start"], t["stop"]) for t in turns if t["role"] == "assistant"]
                    whole = covered(text, np.array(a, dtype=np.int64), np.array(b, dtype=np.int64), np.array(mask, dtype=bool), spans)
                    loss.append("".join(map(unescape, whole)))
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array([[r for r, _ in p] for p in parsed], type=pa.list_(pa.string())),
                    pa.array([[t for _, t in p] for p in parsed], type=pa.list_(pa.string())), pa.array(loss, type=pa.string()),
                    pa.array([len(t) for t in part.column(1).to_pylist()], type=pa.int64())], names=schema.names)

    return base.mapInArrow(run, schema)
