"""MinHash near-duplicates by SetSketch registers: documents whose sets of word shingles have a Jaccard similarity of `percent` / 100 or more.

1. One pass over whole texts sketches each set (setsketch.py). Equal sets are one class; all below runs on classes.
2. Bands: runs of registers are keys. Their length is the greatest with which a pair at the threshold meets in no band with a
   probability of 1e-6 at most.
3. Under each key all classes meet one of them, the same for as many keys as can be. The registers of a pair give the likelihood
   of each similarity; a pair that can't reach the threshold goes no further. The others are verified on their full sets, which
   are made again from the texts of just these classes.
4. Keys whose classes are one component by then are done. The classes of the others are compared in blocks of a bounded number of
   classes and shingles (blocks.py), so that no link under a crowded key is lost.
5. Connected components give each document the smallest id that links reach.

Rules: null text is empty. Words are runs of other characters than white space, A-Z lower-cased. A text of fewer than `width` words
has all of them as its one shingle; one without words has an empty set, which is linked with nothing, not even its like. Rows that
repeat a doc_id are kept, each with its set. A null id never becomes a component id unless all ids of a component are null; then
its rows count as kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewatch.llm import setsketch
from pricewatch.llm.blocks import met_under_keys, open_links, stars, verified
from pricewatch.llm.components import connected_components
from pricewatch.llm.shared import map_texts, stored
from pricewatch.llm.simhash import shingle_hashes

#: Wanted texts up to which their keys are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 500_000


def shingle_set(text: str, width: int) -> np.ndarray:
    """Distinct hashes of the shingles, in order."""
    return np.unique(shingle_hashes(text, width))


def sketches(docs: DataFrame, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """__id, __raw (a hash of the text), digest of the set (null if it is empty), n (its size), regs (its registers)."""
    plain = _texts(docs, id_col, text_col)

    def make():
        def work(texts: list[str]) -> list[pa.Array]:
            sets = [shingle_set(t, width) for t in texts]
            return [pa.array([xxhash.xxh128_digest(s.tobytes()) if len(s) else None for s in sets], type=pa.binary()),
                    pa.array([len(s) for s in sets], type=pa.int64()),
                    pa.array([setsketch.registers(s).tobytes() for s in sets], type=pa.binary())]

        return work

    return map_texts(plain, ["__id", "__raw"], "__text", [("digest", "binary"), ("n", "long"), ("regs", "binary")], make)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    plain = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    return plain.withColumn("__raw", F.xxhash64("__text"))


def band_keys(classes: DataFrame, rows: int) -> DataFrame:
    """key, id, n: one row for each band of each class."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                regs = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype=np.uint8).reshape(-1, setsketch.M)
                keys = setsketch.bands(regs, rows)
                times = keys.shape[1]
                yield pa.RecordBatch.from_arrays([
                    pa.array(keys.ravel()), pa.array(np.repeat(batch.column(0).to_numpy(), times)),
                    pa.array(np.repeat(batch.column(1).to_numpy(), times))], names=["key", "id", "n"])

    return classes.select("id", "n", "regs").mapInArrow(run, "key long, id long, n long")


def _likely(pairs: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose registers don't speak against this similarity."""
    side = lambda c, n, r: classes.select(F.col("id").alias(c), F.col("n").alias(n), F.col("regs").alias(r))
    both = pairs.join(side("a", "m", "p"), "a").join(side("b", "n", "q"), "b").select("a", "b", "m", "n", "p", "q")

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                p, q = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=np.uint8).reshape(-1, setsketch.M) for i in (4, 5))
                ok = setsketch.may_reach(similarity, batch.column(2).to_numpy(), batch.column(3).to_numpy(), (p > q).sum(axis=1), (p < q).sum(axis=1))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok))

    return both.mapInArrow(run, "a long, b long")


def _sets(docs: DataFrame, wanted: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """id and set s of the classes in `wanted` (id, __id, __raw), made from the text of their first document."""
    few = wanted.select("id", F.col("__id").alias("__w"), F.col("__raw").alias("__r"))
    if wanted.count() <= BROADCAST_ROWS:
        few = F.broadcast(few)
    texts = _texts(docs, id_col, text_col)
    found = texts.join(few, (texts["__raw"] == few["__r"]) & texts["__id"].eqNullSafe(few["__w"])).select("id", "__text")

    def make():
        return lambda rows: [pa.array([shingle_set(t, width).view(np.int64) for t in rows], type=pa.list_(pa.int64()))]

    return map_texts(found.dropDuplicates(["id"]), ["id"], "__text", [("s", "array<long>")], make)


def class_links(docs: DataFrame, classes: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """src, dst: links among the classes (id, n, regs, __id, __raw), enough that their components are those of all pairs."""
    similarity = percent / 100
    met = met_under_keys(band_keys(classes, setsketch.band_rows(similarity)))
    likely = stored(_likely(stars(met, percent), classes, similarity), "likely")
    wanted = met.select("id").distinct().join(classes.select("id", "__id", "__raw"), "id")
    sets = stored(_sets(docs, stored(wanted, "wanted"), width, id_col, text_col), "sets")
    return open_links(met, stored(verified(likely, sets, percent), "links"), sets, percent)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles long, component_id, kept: one row for each input row."""
    rows = stored(sketches(docs, width, id_col, text_col), "sketches")
    lead = F.min(F.struct(F.col("__id").isNull().alias("z"), F.col("__id").alias("i"), F.col("__raw").alias("r")))
    classes = stored(rows.where("digest is not null").groupBy("digest").agg(lead.alias("lead"), F.first("n").alias("n"), F.first("regs").alias("regs"))
                     .select("digest", F.monotonically_increasing_id().alias("id"), "n", "regs", F.col("lead.i").alias("__id"), F.col("lead.r").alias("__raw")), "classes")
    roots = connected_components(class_links(docs, classes, width, percent, id_col, text_col))
    rooted = stored(classes.join(roots, classes["id"] == roots["node"], "left").select("digest", "__id", F.coalesce("root", "id").alias("root")), "rooted")
    least = stored(rooted.groupBy("root").agg(F.min("__id").alias("component_id")), "least")
    known = stored(rooted.join(least, "root").select("digest", "component_id"), "known")
    # empty sets have no digest and stay alone
    alone = rows.where("digest is null").select(F.col("__id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("__id").alias("component_id"))
    linked = rows.where("digest is not null").join(known, "digest").select(F.col("__id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))
