"""Links among sets of hashes that meet under keys, with no pair lost under a crowded key.

All sets of a key meet one of them first (stars). Keys whose sets are one component by then are done. The sets of the others are compared
in blocks: those that such keys connect form a cluster, are dealt into tiles by size, and each pair of tiles of fitting sizes is one
group, which counts common elements by a matrix product and returns links only. A tile has a bounded number of sets and elements.

Inputs: `met` has key, id, n (size of the set) and x, the set that all of the key meet; `sets` has id and s, the distinct 64-bit hashes.
Empty sets take no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewatch.llm.components import connected_components
from pricewatch.llm.shared import stored

#: Sets and elements of a tile, beyond which it is divided. One set may have more elements.
TILE_SETS, TILE_SHINGLES = 2048, 1 << 20
#: Elements that one matrix product takes.
COLUMNS = 4096


def met_under_keys(entries: DataFrame) -> DataFrame:
    """`met` of entries (key, id, n): keys of several sets. The set that the others meet is the first in one drawn order, the same for as
    many keys as can be, so that pairs repeat from key to key. Its size is m."""
    first = F.min(F.struct(F.xxhash64("id").alias("o"), F.col("id").alias("x"), F.col("n").alias("m")))
    groups = (entries.groupBy("key").agg(F.count(F.lit(1)).alias("k"), first.alias("f")).where("k > 1")
              .select("key", F.col("f.x").alias("x"), F.col("f.m").alias("m")))
    return stored(entries.join(stored(groups, "groups"), "key"), "met")


def stars(met: DataFrame, percent: int) -> DataFrame:
    """a, b: distinct pairs of fitting sizes of each set with the one that its key meets."""
    fit = 100 * F.least("n", "m") >= percent * F.greatest("n", "m")
    return stored(met.where((F.col("id") != F.col("x")) & fit).select(F.col("x").alias("a"), F.col("id").alias("b")).distinct(), "stars")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """src, dst: the pairs (a, b) whose full sets have this similarity."""
    both = (pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("p")), "a")
            .join(sets.select(F.col("id").alias("b"), F.col("s").alias("q")), "b"))
    common = F.size(F.array_intersect("p", "q")).cast("long")
    return both.where(100 * common >= percent * (F.size("p") + F.size("q") - common)).select(F.col("a").alias("src"), F.col("b").alias("dst"))


def _tiles(members: DataFrame, percent: int) -> DataFrame:
    """cluster, id, root, tile, left, right: each member once for each pair of tiles that its own is in."""
    # sizes that fit differ by one class at most
    step = float(np.log(100 / percent)) * (1 + 1e-9) if percent < 100 else 1.0
    sized = members.withColumn("size", F.floor(F.log(F.col("n").cast("double")) / step + 1e-9).cast("int"))
    parts = (sized.groupBy("cluster", "size").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("t"))
             .withColumn("parts", F.greatest(F.ceil(F.col("c") / TILE_SETS), F.ceil(F.col("t") / TILE_SHINGLES)).cast("int")).drop("c", "t"))
    dealt = (sized.join(parts, ["cluster", "size"])
             .withColumn("tile", F.struct("size", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"))).drop("parts"))
    tiles = parts.select("cluster", "size", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    # a tile meets those of its own size and of the next: both lists come from the parts, not from the members
    own = tiles.join(parts.select("cluster", F.col("size").alias("other"), F.col("parts").alias("k")), "cluster").where("other in (size - 1, size, size + 1)")
    met = own.select("cluster", F.struct("size", "part").alias("tile"),
                     F.explode(F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda i: F.struct(F.col("other").alias("size"), i.alias("part")))).alias("o"))
    return (dealt.join(met, ["cluster", "tile"])
            .select("cluster", "id", "root", "tile", F.least("tile", "o").alias("left"), F.greatest("tile", "o").alias("right")))


def _common(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Number of common elements of each set of a with each of b, exact: products of 0/1 matrices over slices of the common elements."""
    words = np.intersect1d(np.concatenate(a), np.concatenate(b))
    out = np.zeros((len(a), len(b)), dtype=np.int64)

    def matrix(sets: list[np.ndarray], part: np.ndarray) -> np.ndarray:
        x = np.zeros((len(sets), len(part)), dtype=np.float32)
        for i, s in enumerate(sets):
            s = s[np.searchsorted(s, part[0]):np.searchsorted(s, part[-1], side="right")]
            at = np.searchsorted(part, s)
            x[i, at[part[np.minimum(at, len(part) - 1)] == s]] = 1
        return x

    for at in range(0, len(words), COLUMNS):
        part = words[at:at + COLUMNS]
        out += (matrix(a, part) @ matrix(b, part).T).astype(np.int64)
    return out


def _forest(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the links (row, column) of a matrix, a spanning forest: what they connect, with fewer links than rows and columns."""
    rows, columns, new = [], [], [np.ones(n, dtype=bool) for n in linked.shape]
    for start in np.flatnonzero(linked.any(axis=1)).tolist():
        if not new[0][start]:
            continue
        new[0][start], todo = False, [(0, start)]
        while todo:
            side, at = todo.pop()
            found = np.flatnonzero((linked[:, at] if side else linked[at]) & new[1 - side])
            new[1 - side][found] = False
            here = np.full(len(found), at)
            rows.append(found if side else here)
            columns.append(here if side else found)
            todo += [(1 - side, k) for k in found.tolist()]
    return np.concatenate([np.zeros(0, dtype=np.int64), *rows]), np.concatenate([np.zeros(0, dtype=np.int64), *columns])


def _block_links(tiles: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """src, dst: links between members of different components, from each pair of tiles: no more than its members, and enough of them that
    all are connected that are alike."""
    rows = tiles.join(sets, "id").select("cluster", "left", "right", "tile", "id", "root", "s")

    def compare(table: pa.Table) -> pa.Table:
        ids, roots = table["id"].to_numpy(), table["root"].to_numpy()
        sets_ = [np.sort(np.asarray(x.values).view(np.uint64)) for x in table["s"]]
        tile, left, right = table["tile"].to_pylist(), table["left"][0].as_py(), table["right"][0].as_py()
        i = np.array([k for k, t in enumerate(tile) if t == left], dtype=np.int64)
        j = np.array([k for k, t in enumerate(tile) if t == right], dtype=np.int64)
        src, dst = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        if len(i) and len(j) and len(np.unique(roots)) > 1:
            size = np.array([len(s) for s in sets_], dtype=np.int64)
            common = _common([sets_[k] for k in i], [sets_[k] for k in j])
            linked = 100 * common >= percent * (size[i][:, None] + size[j][None, :] - common)
            x, y = _forest(linked & (roots[i][:, None] != roots[j][None, :]))
            src, dst = ids[i[x]], ids[j[y]]
        return pa.table({"src": pa.array(src), "dst": pa.array(dst)})

    return rows.groupBy("cluster", "left", "right").applyInArrow(compare, "src long, dst long")


def open_links(met: DataFrame, links: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """src, dst: `links`, which the stars gave, and those that the keys still need whose sets are in several components."""
    roots = connected_components(links)
    rooted = stored(met.join(roots, met["id"] == roots["node"], "left").select("key", "id", "n", "x", F.coalesce("root", "id").alias("root")), "rooted")
    mixed = stored(rooted.groupBy("key").agg(F.min("root").alias("r"), F.max("root").alias("t")).where("r <> t").select("key"), "mixed")
    still = stored(rooted.join(mixed, "key", "left_semi").select("id", "n", "x", "root").distinct(), "still")
    if still.isEmpty():
        return links
    clusters = connected_components(still.select(F.col("id").alias("src"), F.col("x").alias("dst")))
    # the least of a cluster has no row of its own there
    members = (still.select("id", "n", "root").distinct().join(clusters.select(F.col("node").alias("id"), F.col("root").alias("__c")), "id", "left")
               .withColumn("cluster", F.coalesce("__c", "id")).drop("__c"))
    tiles = _tiles(stored(members, "members"), percent)
    return links.union(stored(_block_links(tiles, sets, percent), "blocks"))
