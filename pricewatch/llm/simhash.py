"""SimHash near-duplicates by multi-index hashing.

1. Fingerprints: one pass over whole texts, an Arrow batch at a time.
2. Equal fingerprints are one class; everything below runs on distinct fingerprints.
3. The 64 bits are two segments of 32. Within `radius` bits, two fingerprints differ in at most radius // 2 bits of the
   first segment or in at most (radius - 1) // 2 bits of the second. So each looks up the keys of a small Hamming ball around
   its segments in the two tables of segments, and the matches are verified over all 64 bits.
4. A table key that more than `BUCKET` fingerprints share would match each with each. Pairs whose two sides both lie
   under such keys meet at whole fingerprints instead: each enumerates what lies within radius // 2 (and the rest within
   radius - radius // 2) bits of it, and fingerprints that meet at one point are linked to the least of them. No pair is
   lost, and such a point has few guests, whatever the group.
5. Connected components give each document the smallest id that links reach.

Rules: null text is empty; a text without words has fingerprint zero, linked like any other. Rows that repeat a doc_id are
kept, each with its fingerprint. A null id never becomes a component id unless all ids of a component are null.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricewatch.llm.bitmap import in_filter, listed, repeated_filter
from pricewatch.llm.blocks import met_under_keys, open_links, stars, verified
from pricewatch.llm.components import connected_components
from pricewatch.llm.shared import map_texts, mix, slices, stored, unbroadcast, words_of

#: Fingerprints under one table key beyond which their pairs are found the other way.
BUCKET = 16
#: Fingerprints that ball_keys() takes: 64 bits, two segments each.
PRINTS = 4
SEED = 42
#: Longs of a sketch: 64 cells each.
SKETCH = 64
#: Sets of a key up to which they are compared in pairs.
PAIRED = 64
#: Keys of dropped documents up to which they are broadcast.
BROADCAST_ROWS = 100_000


def shingle_hashes(text: str, width: int) -> np.ndarray:
    """XXH64 of each run of `width` words, repeats included; of all words if there are fewer; of none if there are none."""
    words = words_of(text)
    n = len(words)
    if n == 0:
        return np.zeros(0, dtype=np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if n <= width:
        return np.array([digest(joined, SEED)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return np.fromiter([digest(joined[a:b], SEED) for a, b in zip(starts[: n - width + 1].tolist(), ends[width - 1:].tolist())],
                       dtype=np.uint64, count=n - width + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is set if it is in over half the hashes. As a signed 64-bit number."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at:at + (1 << 16)].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp long."""

    def make():
        return lambda texts: [pa.array([fingerprint(shingle_hashes(t, width)) for t in texts], type=pa.int64())]

    return map_texts(docs, [id_col], text_col, [("fp", "long")], make).withColumnRenamed(id_col, "doc_id")


def _ball(bits: range, radius: int) -> list[int]:
    """All masks of at most `radius` of the given bits."""
    return [sum(1 << b for b in chosen) for r in range(radius + 1) for chosen in combinations(bits, r)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def _masked(fp: Column, masks: list[int]) -> Column:
    return F.explode(F.transform(F.array(*[F.lit(_signed(m)).cast("long") for m in masks]), lambda m: fp.bitwiseXOR(m)))


def links(fps: DataFrame, radius: int = 2, bucket: int = BUCKET) -> DataFrame:
    """Links (src, dst) among the distinct values of fps.fp that differ in at most `radius` bits, enough of them that the
    components are those of all such pairs; each one verified."""
    low, high = (1 << 32) - 1, _signed(((1 << 32) - 1) << 32)
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    parts = [(0, high, radius // 2, range(32, 64)), (1, low, (radius - 1) // 2, range(0, 32))]
    entries, probes = [], []
    for seg, mask, r, bits in parts:
        if r < 0:
            continue
        key = F.col("fp").bitwiseAND(F.lit(mask).cast("long"))
        entries.append(fps.select(F.lit(seg).alias("seg"), key.alias("key"), F.col("fp").alias("b")))
        probes.append(fps.select(F.lit(seg).alias("seg"), F.col("fp").alias("a"), _masked(key, _ball(bits, r)).alias("key")))
    table = entries[0] if len(entries) == 1 else entries[0].union(entries[1])
    asked = probes[0] if len(probes) == 1 else probes[0].union(probes[1])
    crowded = stored(table.groupBy("seg", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket).select("seg", "key"), "crowded")
    sparse = table.join(crowded, ["seg", "key"], "left_anti")
    # both directions: of two fingerprints, one may lie under a crowded key and the other not
    found = (unbroadcast(asked).join(sparse, ["seg", "key"]).where((F.col("a") != F.col("b")) & near)
             .select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")))
    guests = table.join(crowded, ["seg", "key"], "left_semi").select(F.col("b").alias("fp")).distinct()
    half = radius // 2
    meet = guests.select("fp", _masked(F.col("fp"), _ball(range(64), half)).alias("at"))
    if radius % 2:
        meet = meet.withColumn("far", F.lit(0)).union(
            guests.select("fp", _masked(F.col("fp"), _ball(range(64), half + 1)).alias("at"), F.lit(1)))
        hosts = meet.where("far = 0").groupBy("at").agg(F.min("fp").alias("b"))
    else:
        hosts = meet.groupBy("at").agg(F.min("fp").alias("b"))
    met = (unbroadcast(meet).join(hosts, "at").select(F.col("fp").alias("a"), "b").where((F.col("a") != F.col("b")) & near)
           .select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")))
    return found.union(met).distinct()


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id: one row for each input row."""
    prints = stored(fingerprints(docs, width, id_col, text_col), "prints")
    classes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    roots = connected_components(links(classes.select("fp"), radius))
    rooted = stored(classes.join(roots, classes["fp"] == roots["node"], "left")
                    .select("fp", "least", F.coalesce("root", "fp").alias("root")), "rooted")
    least = stored(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    known = stored(rooted.join(least, "root").select("fp", "component_id"), "known")
    return prints.join(known, "fp").select("doc_id", "fp", "component_id")


def shingle_set(text: str) -> np.ndarray:
    """Distinct hashes of the five-word shingles, in order."""
    return np.unique(shingle_hashes(text, 5))


def ball_keys(prints: np.ndarray) -> np.ndarray:
    """Keys of the balls of radius 1 around each 32-bit segment of the three-word fingerprints, segment number in front."""
    halves = np.ascontiguousarray(prints).view(np.uint32).astype(np.int64)
    masks = np.array(_ball(range(32), 1), dtype=np.int64)
    keys = (halves[:, :, None] ^ masks) | (np.arange(halves.shape[1], dtype=np.int64) << 32)[None, :, None]
    return keys.reshape(len(prints), -1)


def _least_shared(n: int, percent: int) -> int:
    """Elements that a set of n shares at least with each set of this similarity."""
    return -(-percent * n // 100)


def _chosen(rows: pa.RecordBatch, bitmap: np.ndarray | None) -> pa.RecordBatch:
    """The rows of a batch (id, text) whose id, mixed, is in the bit map; all of them without one."""
    if bitmap is None:
        return rows
    return rows.filter(pa.array(in_filter(bitmap, mix(rows.column(0).to_numpy().view(np.uint64), 7))))


def prefixes(texts: DataFrame, percent: int, bitmap=None, chosen=None) -> DataFrame:
    """key, id, n: of the shingle set of each text (id, text), or of those with an id in the bit map `chosen`, the first n - _least_shared() + 1 of its n hashes in an order common to all
    sets: those in the bit map last. Two sets of this similarity have one of these keys in common, whatever the order. With a bit map, the
    first row of a text also has `bits`: the cells of SKETCH longs that its hashes fall into."""
    context = texts.sparkSession.sparkContext
    shared = None if bitmap is None else context.broadcast(bitmap)
    only = None if chosen is None else context.broadcast(chosen)
    names = ["key", "id", "n"] if bitmap is None else ["key", "id", "n", "bits"]

    def run(batches):
        for batch in batches:
            for part in slices(batch, 512):
                part = _chosen(part, None if only is None else only.value)
                keys, ids, sizes, bits = [np.zeros(0, dtype=np.int64)], [], [], []
                for i, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    x = shingle_set(text).view(np.int64)
                    if not len(x):
                        continue
                    if shared is not None:
                        bits += [sketch(x), *[None] * (len(x) - _least_shared(len(x), percent))]
                        x = x[np.argsort(in_filter(shared.value, mix(x.view(np.uint64), 7)), kind="stable")]
                    keys.append(x[:len(x) - _least_shared(len(x), percent) + 1])
                    ids.append(i)
                    sizes.append(len(x))
                times = [len(k) for k in keys[1:]]
                columns = [pa.array(np.concatenate(keys)), pa.array(np.repeat(np.array(ids, dtype=np.int64), times)),
                           pa.array(np.repeat(np.array(sizes, dtype=np.int64), times)), pa.array(bits, type=pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns[:len(names)], names=names)

    return texts.select("id", "text").mapInArrow(run, "key long, id long, n long" + ("" if bitmap is None else ", bits array<long>"))


def sketch(x: np.ndarray) -> np.ndarray:
    """The cells of 64 * SKETCH that hold an element of a set of hashes, as bits."""
    cells = np.zeros(64 * SKETCH, dtype=np.uint8)
    cells[(x.view(np.uint64) >> np.uint64(20)) % np.uint64(64 * SKETCH)] = 1
    return np.packbits(cells, bitorder="little").view("<i8").astype(np.int64)


def _bounded(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that can have this similarity: each cell that only one set fills holds an element that the other hasn't."""
    side = lambda i, n, c: sketches.select(F.col("id").alias(i), F.col("n").alias(n), F.col("bits").alias(c))
    both = pairs.join(side("a", "na", "p"), "a").join(side("b", "nb", "q"), "b")

    def alone(p: str, q: str) -> Column:
        return F.aggregate(F.zip_with(p, q, lambda x, y: F.bit_count(x.bitwiseAND(F.bitwise_not(y)))), F.lit(0), lambda s, c: s + c)

    most = F.least(F.col("na") - alone("p", "q"), F.col("nb") - alone("q", "p"))
    return both.where(100 * most >= percent * (F.col("na") + F.col("nb") - most)).select("a", "b").distinct()


def _sets_of(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """id, s: shingle sets of the texts with these ids, found by a bit map and so without a shuffle of texts, and of few others. One step in
    Python chooses and makes them: two would hold two Python processes and the texts between them in each task."""
    shared = texts.sparkSession.sparkContext.broadcast(repeated_filter(ids, 7))

    def run(batches):
        for batch in batches:
            for part in slices(batch, 512):
                part = _chosen(part, shared.value)
                sets = [shingle_set(t).view(np.int64) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, type=pa.list_(pa.int64()))], names=["id", "s"])

    return stored(texts.select("id", "text").mapInArrow(run, "id long, s array<long>"), "sets")


def _listed(rows: DataFrame, column: str, bitmap: np.ndarray) -> DataFrame:
    """The rows whose value of a column is in the bit map."""
    return listed(rows, F.col(column), bitmap, 7)


def similar_links(texts: DataFrame, percent: int, bucket: int = BUCKET, chosen: np.ndarray | None = None) -> DataFrame:
    """Links (src, dst) among texts (id, text), or those with an id in the bit map `chosen`, enough that the components are those of all pairs whose five-word shingles have a Jaccard
    similarity of percent / 100 or more; each one verified on the full sets.

    Pairs meet under a key of their prefixes. Keys of more than `bucket` sets go to the end of the order, which keeps lines that many
    texts have out of the prefixes. Under each key all are compared with one of them; then all of different components under keys
    of at most PAIRED sets, and those under larger keys in blocks (blocks.py). Pairs that a bound from their sketches rules out
    are not verified. Sets are made again from the texts, and stored for those that are verified only.
    """
    often = prefixes(texts, percent, chosen=chosen).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket).select("key")
    entries = stored(prefixes(texts, percent, repeated_filter(often, 7), chosen), "entries")
    again = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    met = met_under_keys(_listed(entries.select("key", "id", "n"), "key", repeated_filter(again, 7)))
    sketches = entries.where("bits is not null").select("id", "n", "bits")

    def links_of(pairs: DataFrame) -> DataFrame:
        able = stored(_bounded(pairs, sketches, percent), "able")
        return stored(verified(able, _sets_of(texts, able.select(F.explode(F.array("a", "b")).alias("id")).distinct()), percent).distinct(), "links")

    found = links_of(stars(met, percent))
    size = stored(met.groupBy("key").agg(F.count(F.lit(1)).alias("k")).where("k > 2"), "sizes")
    few, many = size.where(F.col("k") <= PAIRED).select("key"), size.where(F.col("k") > PAIRED).select("key")
    roots = connected_components(found)
    side = stored(met.join(few, "key", "left_semi").where("id <> x").join(roots, met["id"] == roots["node"], "left")
                  .select("key", "id", "n", F.coalesce("root", "id").alias("root")), "few")
    other = side.select("key", F.col("id").alias("b"), F.col("n").alias("m"), F.col("root").alias("t"))
    pairs = (side.join(other, "key").where(F.col("id") < F.col("b")).where("root <> t")
             .where(100 * F.least("n", "m") >= percent * F.greatest("n", "m")).select(F.col("id").alias("a"), "b").distinct())
    found = found.union(links_of(stored(pairs, "paired")))
    if many.isEmpty():
        return found
    crowded = stored(met.join(many, "key", "left_semi"), "crowded")
    return open_links(crowded, found, _sets_of(texts, crowded.select("id").distinct()), percent)


def _mixed(keys: DataFrame) -> DataFrame:
    """The keys as _listed() looks them up; repeated_filter(keys, 7) mixes them in its own step."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(mix(batch.column(0).to_numpy().view(np.uint64), 7).view(np.int64))], names=["key"])

    return keys.mapInArrow(run, "key long")


def _first_texts(plain: DataFrame, classes: DataFrame, repeated: bool) -> tuple[DataFrame, np.ndarray]:
    """id, text of the documents, one for each id, and a bit map of the ids of the first of each class, so that texts are not shuffled."""
    named = plain.select(_row_id().alias("id"), F.coalesce(F.col("__text").cast("string"), F.lit("")).alias("text"))
    chosen = repeated_filter(classes.select("id"), 7)
    return stored(_listed(named, "id", chosen).dropDuplicates(["id"]), "texts") if repeated else named, chosen


def _without(docs: DataFrame, key: dict[str, Column], kept: DataFrame, prints: DataFrame, bound: int) -> DataFrame:
    """The documents whose key is in `kept`. They are most of them as a rule, so that the others are left out: up to `bound` keys, which are
    broadcast; beyond, the texts are shuffled. A table of keys takes many times the memory of its file, by which Spark would choose."""
    same = lambda rows, other: [rows[c].eqNullSafe(other[c]) for c in key]
    named = prints.select(*key).distinct()
    dropped = stored(named.join(unbroadcast(kept), same(named, kept), "left_anti"), "dropped")
    keyed = docs.withColumns(key)
    return keyed.join(F.broadcast(dropped) if dropped.count() <= bound else unbroadcast(dropped), same(keyed, dropped), "left_anti")


def _row_id() -> Column:
    """A 64-bit hash of a document's id and text hash, by which its row is known without a join."""
    return F.xxhash64("__id", "__raw")


def dedup(docs: DataFrame, similarity: float | None = 0.8, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of near copies, with all its columns: that of the smallest id (nulls last), then of the least text hash.

    Near copies differ in at most `radius` bits of the 64-bit fingerprint of three-word shingles, as in near_duplicates(), or are
    have a Jaccard similarity of five-word shingles of `similarity` or more (verified on the shingles); None: only the former.
    """
    raw = F.xxhash64(F.coalesce(F.col("__text").cast("string"), F.lit("")))
    plain = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).withColumn("__raw", raw)

    def make():
        def work(texts: list[str]) -> list[pa.Array]:
            own = [xxhash.xxh64_intdigest(shingle_set(t).tobytes()) if similarity is not None else 0 for t in texts]
            return [pa.array([fingerprint(shingle_hashes(t, 3)) for t in texts], type=pa.int64()), pa.array(np.array(own, dtype=np.uint64).view(np.int64))]

        return work

    prints = stored(map_texts(plain, ["__id", "__raw"], "__text", [("fp", "long"), ("h", "long")], make)
                    .withColumn("row", _row_id()), "prints")
    first = F.min(F.struct(F.col("__id").isNull().alias("z"), F.col("__id").alias("d"), F.col("__raw").alias("r")))
    repeated = not prints.groupBy("__id", "__raw").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    # equal texts but for white space and case are one class
    classes = stored(prints.groupBy("fp", "h").agg(first.alias("first"), F.min_by("row", F.struct(F.col("__id").isNull(), "__id", "__raw")).alias("id")).drop("h"), "classes")
    heads = stored(classes.groupBy("fp").agg(F.min("id").alias("head")), "heads")
    near = links(heads.select("fp"), radius)
    near = (near.join(heads.select(F.col("fp").alias("src"), F.col("head").alias("a")), "src")
            .join(heads.select(F.col("fp").alias("dst"), F.col("head").alias("b")), "dst").select(F.col("a").alias("src"), F.col("b").alias("dst")))
    same = classes.select("fp", "id").join(heads, "fp").where("id <> head").select(F.col("id").alias("src"), F.col("head").alias("dst"))
    edges = near.union(same)
    if similarity is not None:
        texts, chosen = _first_texts(plain, classes, repeated)
        edges = edges.union(similar_links(texts, round(100 * similarity), chosen=chosen))
    roots = connected_components(edges)
    rooted = classes.join(roots, classes["id"] == roots["node"], "left").select("first", F.coalesce("root", "id").alias("root"))
    kept = stored(rooted.groupBy("root").agg(F.min("first").alias("f")).select(F.col("f.d").alias("__id"), F.col("f.r").alias("__raw")), "kept")
    key = {"__id": F.col(id_col), "__raw": F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))}
    left = _without(docs, key, kept, prints, BROADCAST_ROWS)
    return (left.dropDuplicates(list(key)) if repeated else left).select(*docs.columns)
