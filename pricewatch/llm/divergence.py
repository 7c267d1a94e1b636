"""Divergence of sources: how far the term frequencies of each source of a language lie from those of every other one, in exact integers.

1. One pass over whole texts counts terms, in memory of bounded size; counts by (lang, source, term) are summed in Spark. A language
   keeps the terms of at least `min_docs` of its documents.
2. A term with `count` of the N kept occurrences of a group has p = 1 + floor(SCALE * (count + 1) / (N + V)), V being the number of
   kept terms of the language. A group diverges from a peer by the sum over all kept terms of f = floor((p - q)^2 / q).
3. Gustavson's row accumulation: the counts lie term-major in blocks; in a block each group takes the postings of its terms row by
   row and scatters them into its row of a dense accumulator, one cell for each peer. No pair of postings leaves a block; what leaves
   it is one row for each pair of groups that share a term.
4. Zero baselines: f isn't zero where a count is zero. Terms of one side only and of none depend on single counts, so they are summed
   from the histogram of counts of each group; a posting pair adds f(p, q) less what these sums gave the term.
5. Groups of a language are dealt into tiles, and each pair of tiles accumulates alone, so that an accumulator has a bounded size.

Rules: null text, language and source are empty strings, and so is a text of no term; groups without any term take part. Terms are
runs of ASCII letters and characters beyond ASCII; only A-Z are lower-cased. A repeated row counts as often as it is there.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricewatch.llm.shared import slices, stored

SCALE = 1_000_000_000
#: Counts that a task holds before it hands them on, groups of a tile, postings of a block (on average, as terms are dealt by hash).
HELD, TILE_GROUPS, BLOCK_POSTINGS = 200_000, 512, 200_000
#: Cells of an accumulator that are computed at once.
CELLS = 1 << 22
#: Bytes of terms to themselves (A-Z lower-cased), all others to a space.
_TERM = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """lang, source, term, count, docs: occurrences and documents of each term in each group. One row with a null term for each group."""
    plain = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])

    def rows(held: dict) -> pa.RecordBatch:
        out = [(g[0], g[1], t, c, d[t]) for g, (n, d) in held.items() for t, c in n.items()] + [(g[0], g[1], None, 0, 0) for g in held]
        kinds = (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64())
        columns = [pa.array([r[k] for r in out], type=t) for k, t in enumerate(kinds)]
        columns[2] = columns[2].cast(pa.string())
        return pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "count", "docs"])

    def run(batches):
        held, n = {}, 0
        for batch in batches:
            for part in slices(batch):
                for lang, source, text in zip(*(part.column(i).to_pylist() for i in range(3))):
                    counts, seen = held.setdefault((lang, source), (Counter(), Counter()))
                    words = text.encode("utf-8", "surrogatepass").translate(_TERM).split()
                    had = len(counts)
                    counts.update(words)
                    seen.update(set(words))
                    n += len(counts) - had
                    if n > HELD:
                        yield rows(held)
                        held, n = {}, 0
        yield rows(held)

    found = plain.mapInArrow(run, "lang string, source string, term string, count long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def _level(count: Column, n: Column, v: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (n + v)), exact beyond 64 bits."""
    return (F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (count.cast("decimal(19,0)") + 1), (n + v).cast("decimal(19,0)")) + 1).cast("long")


def f_of(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / q): both are at most SCALE + 1, so the square fits in 64 bits."""
    d = p - q
    return d * d // q


def _in_tile_pairs(rows: DataFrame) -> DataFrame:
    """Each row once for each pair of tiles (left, right) that its tile is in."""
    other = rows.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    return other.withColumns({"left": F.least("tile", "__other"), "right": F.greatest("tile", "__other")})


def _local(table: pa.Table) -> tuple[list, np.ndarray, np.ndarray]:
    """The groups of a table: names in order, the index of each row, and the first row of each."""
    names, first, index = np.unique(np.array(table["source"].to_pylist(), dtype=object), return_index=True, return_inverse=True)
    return list(names), index, first


def _emit(lang: str, names: list, tile: np.ndarray, left: int, right: int, acc: np.ndarray, cells: np.ndarray) -> pa.Table:
    """The cells of different groups, and of different tiles where two tiles meet."""
    ok = cells & ~np.eye(len(names), dtype=bool)
    if left != right:
        ok &= tile[:, None] != tile[None, :]
    g, h = np.nonzero(ok)
    return pa.table({"lang": pa.array([lang] * len(g), type=pa.string()), "source": pa.array([names[i] for i in g], type=pa.string()),
                     "peer": pa.array([names[i] for i in h], type=pa.string()), "value": pa.array(acc[g, h])})


_PAIR = "lang string, source string, peer string, value long"


def baselines(groups: DataFrame, levels: DataFrame) -> DataFrame:
    """lang, source, peer, value: for each pair of groups the sum over all kept terms as if no term were in both."""
    rows = groups.join(levels.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("times")), ["lang", "source"], "left")
    rows = _in_tile_pairs(rows).select("lang", "left", "right", "source", "tile", "v", "p0", "p", "times")

    def add(table: pa.Table) -> pa.Table:
        names, index, first = _local(table)
        size = len(names)
        v, p0, tile = (table[c].to_numpy()[first] for c in ("v", "p0", "tile"))
        p, times = (table[c].combine_chunks().fill_null(0).to_numpy(zero_copy_only=False) for c in ("p", "times"))
        acc, own = np.zeros((size, size), dtype=np.int64), np.zeros(size, dtype=np.int64)
        np.add.at(own, index, times)
        some = np.flatnonzero(times)
        step = max(1, CELLS // size)
        for at in range(0, len(some), step):
            k = some[at:at + step]
            np.add.at(acc, index[k], times[k][:, None] * f_of(p[k][:, None], p0[None, :]))  # terms of the group alone
            np.add.at(acc.T, index[k], times[k][:, None] * f_of(p0[None, :], p[k][:, None]))  # terms of the peer alone
        if v[0]:
            acc += (v[0] - own[:, None] - own[None, :]) * f_of(p0[:, None], p0[None, :])
        return _emit(table["lang"][0].as_py(), names, tile, table["left"][0].as_py(), table["right"][0].as_py(), acc, np.ones(acc.shape, dtype=bool))

    return rows.groupBy("lang", "left", "right").applyInArrow(add, _PAIR)


def overlaps(levels: DataFrame) -> DataFrame:
    """lang, source, peer, value: what the terms that are in both groups add to the baselines, a row from each block."""
    rows = _in_tile_pairs(levels.withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int")))
    rows = rows.select("lang", "block", "left", "right", "term", "source", "tile", "p0", "p")

    def add(table: pa.Table) -> pa.Table:
        names, index, first = _local(table)
        size = len(names)
        p0, tile, p = table["p0"].to_numpy()[first], table["tile"].to_numpy()[first], table["p"].to_numpy()
        term = table["term"].combine_chunks().dictionary_encode().indices.to_numpy()
        order = np.argsort(term, kind="stable")  # term-major
        start = np.concatenate([[0], np.cumsum(np.bincount(term))])
        peer, level = index[order], p[order]
        acc, met = np.zeros((size, size), dtype=np.int64), np.zeros((size, size), dtype=bool)
        rows_of = np.argsort(index, kind="stable")
        ends = np.concatenate([[0], np.cumsum(np.bincount(index, minlength=size))])
        for g in range(size):
            own = rows_of[ends[g]:ends[g + 1]]
            length = start[term[own] + 1] - start[term[own]]
            cuts = np.searchsorted(np.cumsum(length), np.arange(CELLS, length.sum(), CELLS))
            for part in np.split(np.arange(len(own)), cuts):
                times = length[part]
                at = np.repeat(start[term[own[part]]] - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum()) if len(part) else part
                mine, h, q = np.repeat(p[own[part]], times), peer[at], level[at]
                np.add.at(acc[g], h, f_of(mine, q) - f_of(mine, p0[h]) - f_of(p0[g], q) + f_of(p0[g], p0[h]))
                met[g, h] = True
        return _emit(table["lang"][0].as_py(), names, tile, table["left"][0].as_py(), table["right"][0].as_py(), acc, met)

    return rows.groupBy("lang", "block", "left", "right").applyInArrow(add, _PAIR)


def audit(docs: DataFrame, min_docs: int = 3, top: int = 200, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """lang, source, part, item, value, rank.

    Part `pair`: each other source of the language and the divergence from it, all ranks. Part `term`: the `top` kept terms that the
    group has more often, by p, than its language, and f against the language. Ranks go by value, then by the item's UTF-8 bytes.
    """
    counts = stored(term_counts(docs, lang_col, source_col, text_col), "counts")
    terms = stored(counts.where("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("d"), F.sum("count").alias("all"))
                   .where(F.col("d") >= min_docs).drop("d"), "terms")
    langs = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("all").alias("lang_n"))
    kept = stored(counts.where("term is not null").join(terms, ["lang", "term"]), "kept")
    sizes = kept.groupBy("lang", "source").agg(F.sum("count").alias("n"), F.count(F.lit(1)).alias("postings"))
    groups = (counts.where("term is null").select("lang", "source").join(sizes, ["lang", "source"], "left").join(langs, "lang", "left")
              .fillna(0, ["n", "v", "lang_n", "postings"]))
    number = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / TILE_GROUPS).cast("int").alias("tiles"),
                                        F.ceil(F.sum("postings") / BLOCK_POSTINGS).cast("int").alias("blocks"))
    groups = stored(groups.join(number, "lang").withColumn("tile", F.pmod(F.xxhash64("source"), F.col("tiles")).cast("int"))
                    .withColumn("p0", F.when(F.col("v") > 0, _level(F.lit(0), F.col("n"), F.col("v"))).otherwise(1)), "groups")
    levels = stored(kept.join(groups, ["lang", "source"])
                    .select("lang", "source", "term", "tile", "tiles", "blocks", "p0", _level(F.col("count"), F.col("n"), F.col("v")).alias("p"),
                            _level(F.col("all"), F.col("lang_n"), F.col("v")).alias("q")), "levels")
    pairs = (baselines(groups, levels).union(overlaps(levels)).groupBy("lang", "source", "peer").agg(F.sum("value").alias("value"))
             .select("lang", "source", F.lit("pair").alias("part"), F.col("peer").alias("item"), "value"))
    d = F.col("p") - F.col("q")
    own = levels.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.call_function("div", d * d, F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(order))
    return ranked(pairs).union(ranked(own).where(F.col("rank") <= top))
