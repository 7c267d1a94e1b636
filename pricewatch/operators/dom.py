"""Pages as columns: one parse per page, everything else in expressions.

`parse_pages` turns the text of a page into arrays (visible text pieces, elements, scripts, JSON objects) with
the standard library's tokenizer; it knows nothing of prices or shops. Selectors and JSON lookups are column
expressions over those arrays, so each page is read once and no shuffle is needed to look at it.
"""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from ..functions.text import let

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
SILENT = {"script", "style", "template"}
ASSIGNMENT = re.compile(r"([A-Za-z_$][\w$.]*)\s*=\s*(?=[{\[])")
PAGES_PER_BATCH = 64

PARSED = (
    "tokens array<string>,"
    "nodes array<struct<pos:int,parent:int,last:int,tag:string,classes:array<string>,attrs:map<string,string>,"
    "t0:int,t1:int,hidden:boolean>>,"
    "scripts array<struct<type:string,text:string>>,"
    "objects array<struct<doc:int,source:string,ord:int,parent:int,item:boolean,path:array<string>,above:array<int>,"
    "text:map<string,string>,kind:map<string,string>>>"
)


class _Page(HTMLParser):
    """Collects elements in document order with the range of text pieces and of descendants each one covers."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tokens, self.nodes, self.scripts, self.open, self.text = [], [], [], [], []

    def flush(self):
        if self.text:
            raw, self.text = "".join(self.text), []
            tag = self.nodes[self.open[-1]]["tag"] if self.open else ""
            if tag == "script":
                self.scripts[-1]["text"] += raw
            elif tag not in SILENT and raw.strip():
                self.tokens.append(raw.strip())

    def handle_starttag(self, tag, attrs):
        self.flush()
        named = {k: v or "" for k, v in attrs}
        parent = self.open[-1] if self.open else -1
        classes = named.get("class", "").split()
        style = named.get("style", "").lower().replace(" ", "")
        hidden = (
            (parent >= 0 and self.nodes[parent]["hidden"])
            or named.get("aria-hidden") == "true"
            or "aok-hidden" in classes
            or "display:none" in style
            or "visibility:hidden" in style
        )
        pos = len(self.nodes)
        self.nodes.append(
            {"pos": pos, "parent": parent, "last": pos, "tag": tag, "classes": classes, "attrs": list(named.items()),
             "t0": len(self.tokens), "t1": len(self.tokens), "hidden": bool(hidden)}
        )
        if tag == "script":
            self.scripts.append({"type": named.get("type", "").lower(), "text": ""})
        if tag not in VOID:
            self.open.append(pos)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.close_to(len(self.open) - 1)

    def handle_endtag(self, tag):
        self.flush()
        for i in range(len(self.open) - 1, -1, -1):
            if self.nodes[self.open[i]]["tag"] == tag:
                self.close_to(i)
                return

    def close_to(self, depth):
        while len(self.open) > depth:
            node = self.nodes[self.open.pop()]
            node["t1"], node["last"] = len(self.tokens), len(self.nodes) - 1

    def handle_data(self, data):
        self.text.append(data)

    def handle_comment(self, data):
        self.flush()

    def finish(self, html):
        self.feed(html)
        self.close()
        self.flush()
        self.close_to(0)


#: A double-quoted string literal, or what is left if it has no end: one pass over a script in any case.
STRING = re.compile(r'"((?:[^"\\]++|\\.)*+)(?:"|\Z|\\\Z)', re.DOTALL)
OBJECT = re.compile(r'\{\s*["}]')


def _payloads(html, scripts):
    """(source, value) of every JSON document of the page: a bare document, JSON scripts, assigned literals, and
    objects inside escaped strings of scripts."""
    decoder = json.JSONDecoder()

    def read(text):
        try:
            return json.loads(text)
        except ValueError:
            return None

    bare = html.strip()
    if bare[:1] in ("{", "["):
        yield "document", read(bare)
    for s in scripts:
        text = s["text"].strip()
        if "json" in s["type"] or text[:1] in ("{", "["):
            yield ("ld+json" if "ld+json" in s["type"] else "json"), read(text)
            continue
        end = 0
        for m in ASSIGNMENT.finditer(text):
            if m.end() < end:
                continue
            try:
                value, end = decoder.raw_decode(text, m.end())
            except ValueError:
                continue
            yield m.group(1), value
        for value in _spoken(text, decoder):
            yield "escaped", value


def _spoken(text, decoder, depth=2):
    """JSON objects inside string literals of a script: texts whose quotes are escaped, such as pushed page data."""
    if '\\"' not in text:
        return
    for m in STRING.finditer(text):
        raw = m.group(1)
        if '\\"' not in raw or "{" not in raw:
            continue
        try:
            plain = json.loads(f'"{raw}"', strict=False)
        except ValueError:
            continue
        end = 0
        for start in OBJECT.finditer(plain):
            if start.start() >= end:
                try:
                    value, end = decoder.raw_decode(plain, start.start())
                except ValueError:
                    continue
                yield value
        if depth > 1:
            yield from _spoken(plain, decoder, depth - 1)


def _scalar(v):
    if isinstance(v, bool):
        return ("true" if v else "false"), "b"
    if isinstance(v, (int, float)):
        return str(v), "n"
    return (v, "s") if isinstance(v, str) else (None, None)


def _objects(html, scripts):
    """Every JSON object at any depth, in document order, with its scalar fields."""
    out = []
    for doc, (source, value) in enumerate(_payloads(html, scripts)):
        stack = [(value, [], [], False)]
        while stack:
            v, path, above, item = stack.pop()
            if isinstance(v, list):
                stack.extend((x, path, above, True) for x in reversed(v))
            elif isinstance(v, dict):
                text, kind, children = [], [], []
                for k, x in v.items():
                    if isinstance(x, list) and x and not any(isinstance(i, (dict, list)) for i in x):
                        parts = [_scalar(i)[0] for i in x]
                        text.append((k, "\x1f".join(p for p in parts if p is not None)))
                        kind.append((k, "l"))
                    elif isinstance(x, (dict, list)):
                        children.append((x, [*path, k], [*above, len(out)], False))
                    else:
                        t, kd = _scalar(x)
                        if kd:
                            text.append((k, t))
                            kind.append((k, kd))
                out.append({"doc": doc, "source": source, "ord": len(out), "parent": above[-1] if above else -1,
                            "item": item, "path": path, "above": above, "text": text, "kind": kind})
                stack.extend(reversed(children))
    return out


#: A script or style sheet, which holds no references, or an ampersand with the name or number of one that no semicolon ends.
OPEN_REFERENCE = re.compile(r"(<(script|style)\b.*?(?:</\2|\Z))|&(?=#?[A-Za-z0-9]++(?!;))", re.DOTALL | re.IGNORECASE)


def parse_pages(pages: DataFrame, html: str = "html", open_references: bool = True) -> DataFrame:
    """Add tokens, nodes, scripts and objects to every page.

    Browsers read some references without a semicolon, as in `&amp`; with `open_references` false these stay as they are written.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    parsed = StructType.fromDDL(PARSED)
    added = to_arrow_schema(parsed)
    schema = StructType([*pages.schema.fields, *parsed.fields])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, PAGES_PER_BATCH):
                piece = batch.slice(at, PAGES_PER_BATCH)
                cols = {f.name: [] for f in added}
                for text in piece.column(piece.schema.get_field_index(html)).to_pylist():
                    page = _Page()
                    page.finish((text or "") if open_references else OPEN_REFERENCE.sub(lambda m: m[1] or "&amp;", text or ""))
                    cols["tokens"].append(page.tokens)
                    cols["nodes"].append(page.nodes)
                    cols["scripts"].append(page.scripts)
                    cols["objects"].append(_objects(text or "", page.scripts))
                arrays = [pa.array(cols[f.name], type=f.type) for f in added]
                yield pa.RecordBatch.from_arrays([*piece.columns, *arrays], names=[*piece.schema.names, *added.names])

    return pages.mapInArrow(run, schema)


# --- selectors --------------------------------------------------------------
_PIECE = re.compile(r"""(?P<tag>^[A-Za-z0-9]+)|\#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)|
                        \[(?P<attr>[\w:-]+)(?:(?P<op>[*^]?=)['"]?(?P<val>[^'"\]]*)['"]?)?\]""", re.X)


def _test(simple: str):
    """Predicate over a node for one selector without spaces."""

    def test(n: Column) -> Column:
        rule = F.lit(True)
        for m in _PIECE.finditer(simple):
            if m["tag"]:
                rule = rule & (n["tag"] == m["tag"].lower())
            elif m["id"]:
                rule = rule & (n["attrs"]["id"] == m["id"])
            elif m["cls"]:
                rule = rule & F.array_contains(n["classes"], m["cls"])
            else:
                value = n["attrs"][m["attr"]]
                if m["op"] is None:
                    rule = rule & value.isNotNull()
                elif m["op"] == "=":
                    rule = rule & (value == m["val"])
                elif m["op"] == "*=":
                    rule = rule & F.contains(value, F.lit(m["val"]))
                else:
                    rule = rule & value.startswith(m["val"])
        return F.coalesce(rule, F.lit(False))

    return test


def inside(inner: Column, outer: Column) -> Column:
    return (inner["pos"] > outer["pos"]) & (inner["pos"] <= outer["last"])


def select(nodes: Column, selector: str) -> Column:
    """Nodes that match a selector of tags, ids, classes, attribute tests and descendant steps, in document order."""
    *outer, last = selector.split()
    test = _test(last)
    if not outer:
        return F.filter(nodes, lambda n: test(n))
    hits = F.filter(nodes, lambda n: test(n))
    around = select(nodes, " ".join(outer))
    return let(around, lambda found: F.filter(hits, lambda n: F.exists(found, lambda a: inside(n, a))))


def first(nodes: Column, selector: str) -> Column:
    return F.try_element_at(select(nodes, selector), F.lit(1))


def node_text(tokens: Column, node: Column) -> Column:
    return let(node, lambda n: F.array_join(F.slice(tokens, n["t0"] + 1, n["t1"] - n["t0"]), " "))


def page_text(tokens: Column) -> Column:
    return F.array_join(tokens, " ")


def json_objects(parsed: DataFrame) -> DataFrame:
    """One row per JSON object of every page."""
    return parsed.select("page_id", F.explode("objects").alias("o")).select("page_id", "o.*")
