"""Cross-entropy difference between a target and a background language model.

Both are byte n-gram models of the same order over one shared vocabulary, the 256 byte values: a token is a byte of the UTF-8 text
(A-Z lowered), predicted from the three bytes before it. Every n-gram of every text is counted: in tasks into arrays of SLOTS
cells (an n-gram's cell is a hash of it, the same in both models), then summed by cell in Spark. The background model counts all
documents, the target model those marked as target. A document is scored as if it had not been counted: its own counts are taken
off first, so that neither model knows a text by heart. Both models are smoothed alike: a 4-gram backs off to the bigram, which is
exact, and that to the unigram. A document's score is the mean over its bytes of loss(background) - loss(target), in nats: higher
means closer to the target.

Sizes: the counts gathered from tasks grow with the input; the finished model has SLOTS cells for 4-grams, SLOTS for their
contexts and 65,536 bigrams, 40 MB whatever the input, which bounds what is broadcast.

Rules: null text is empty; an empty text has no loss and scores 0. Without target rows the difference is 0 everywhere up to
smoothing, as the target model is then uniform over what the background model backs off to.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewatch.llm.shared import LOWER, map_texts, slices, stored

#: Cells of a table of hashed n-grams.
SLOTS = 1 << 21
#: Weight of the lower order, in observations.
MU = 4.0
LONG, CONTEXT, PAIR = 0, 1, 2


def symbols(text: str) -> np.ndarray:
    """Bytes of a text, with three zero bytes before the first."""
    return np.frombuffer(b"\0\0\0" + text.encode("utf-8", "surrogatepass").translate(LOWER), dtype=np.uint8).astype(np.uint32)


def _cell(key: np.ndarray) -> np.ndarray:
    x = key * np.uint32(0x9E3779B1)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x85EBCA77)
    return (x ^ (x >> np.uint32(13))) & np.uint32(SLOTS - 1)


def cells(s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each byte of a text: cell of its 4-gram, cell of the three bytes before, its bigram."""
    before = (s[:-3] << np.uint32(16)) | (s[1:-2] << np.uint32(8)) | s[2:-1]
    return _cell(before << np.uint32(8) | s[3:]), _cell(before ^ np.uint32(0xA5000000)), (s[2:-1] << np.uint32(8)) | s[3:]


def counts(docs: DataFrame, text_col: str = "text", target_col: str = "target") -> DataFrame:
    """table, cell, background, target: counts over all rows, one row for each cell that occurs."""
    rows = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"), F.coalesce(F.col(target_col), F.lit(False)).alias("y"))

    def run(batches):
        total = [np.zeros((2, size), dtype=np.int64) for size in (SLOTS, SLOTS, 65536)]
        for batch in batches:
            for part in slices(batch):
                marks = part.column(1).to_numpy(zero_copy_only=False).astype(bool)
                texts = part.column(0).to_pylist()
                for y in (False, True):
                    chosen = [cells(symbols(t)) for t, m in zip(texts, marks) if m == y]
                    if chosen:
                        for table, size in ((LONG, SLOTS), (CONTEXT, SLOTS), (PAIR, 65536)):
                            total[table][int(y)] += np.bincount(np.concatenate([c[table] for c in chosen]), minlength=size)
        for table, both in enumerate(total):
            used = np.flatnonzero(both.any(axis=0))
            for at in range(0, len(used), 100_000):
                some = used[at:at + 100_000]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(some), table, dtype=np.int32)), pa.array(some.astype(np.int32)),
                    pa.array(both[:, some].sum(axis=0)), pa.array(both[1, some])], names=["table", "cell", "background", "target"])

    made = rows.mapInArrow(run, "table int, cell int, background long, target long")
    return made.groupBy("table", "cell").agg(F.sum("background").alias("background"), F.sum("target").alias("target"))


class Model:
    """Log probabilities of both models, from their counts."""

    def __init__(self, table: np.ndarray, cell: np.ndarray, background: np.ndarray, target: np.ndarray):
        self.long, self.context, self.pair = [], [], []
        for values in (background, target):
            filled = []
            for kind, size in ((LONG, SLOTS), (CONTEXT, SLOTS), (PAIR, 65536)):
                a = np.zeros(size, dtype=np.float64)
                a[cell[table == kind]] = values[table == kind]
                filled.append(a)
            single = filled[PAIR].reshape(256, 256).sum(axis=0)
            single = (single + 1) / (single.sum() + 256)
            first = filled[PAIR].reshape(256, 256)
            pair = (first + MU * single) / (first.sum(axis=1, keepdims=True) + MU)
            self.long.append(filled[LONG].astype(np.float32))
            self.context.append(filled[CONTEXT].astype(np.float32))
            self.pair.append((MU * pair).ravel().astype(np.float32))

    def difference(self, text: str, target: bool) -> float:
        """Mean of loss(background) - loss(target) over the bytes of a text that both models don't count."""
        s = symbols(text)
        if len(s) == 3:
            return 0.0
        long, context, pair = cells(s)
        own_long, own_context = _times(long), _times(context)
        loss = []
        for which, counted in ((0, True), (1, target)):
            n, total = self.long[which][long], self.context[which][context]
            if counted:
                n, total = np.maximum(n - own_long, 0), np.maximum(total - own_context, 0)
            loss.append(np.log(np.maximum(total, n) + np.float32(MU)) - np.log(n + self.pair[which][pair]))
        return float((loss[0] - loss[1]).mean(dtype=np.float64))


def _times(values: np.ndarray) -> np.ndarray:
    """How often each value is among the values."""
    order = np.argsort(values)
    ordered = values[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    out = np.empty(len(values), dtype=np.float32)
    out[order] = np.repeat(np.diff(np.append(first, len(values))), np.diff(np.append(first, len(values))))
    return out


@lru_cache(maxsize=1)
def _model(shared) -> Model:
    return Model(*shared.value)


def score(docs: DataFrame, model: DataFrame, keep: list[str] | None = None, text_col: str = "text", target_col: str = "target") -> DataFrame:
    """The columns in `keep` (doc_id by default) and score double. model: a table as counts() gives it for these documents."""
    found = model.toPandas()  # at most 2 * SLOTS + 65536 rows
    shared = docs.sparkSession.sparkContext.broadcast(tuple(found[c].to_numpy() for c in ("table", "cell", "background", "target")))
    # the mark goes along as the first character of the text
    marked = docs.withColumn("__marked", F.concat(F.when(F.col(target_col), "1").otherwise("0"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))))

    def make():
        m = _model(shared)
        return lambda texts: [pa.array([m.difference(t[1:], t[0] == "1") for t in texts], type=pa.float64())]

    return map_texts(marked, keep or ["doc_id"], "__marked", [("score", "double")], make)


def cross_entropy_difference(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id and score of every row of docs; target rows are those that labels mark with quality 1."""
    good = stored(labels.where("quality = 1").select("doc_id").distinct(), "target")
    # the labels grow with the documents: a merge join at every size
    marked = docs.select("doc_id", "text").join(good.withColumn("target", F.lit(True)).hint("merge"), "doc_id", "left")
    return score(marked, stored(counts(marked), "ngrams"))
