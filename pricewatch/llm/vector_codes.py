"""Vector codes: product quantization of integer vectors with exact arithmetic.

Components become floor(SCALE * x); vectors are cut into equal parts, each with a codebook of its own. Nearest entries are found by
matrix products: integers are broken into limbs so small that a float64 product sums to less than 2^53, so that BLAS is exact; the
limbs' products are put together in int64, and the first least of |c|^2 - 2 x.c is the code. Each round is one pass of the vectors
that leaves a task as one row for each used entry and component, summed in Spark; what comes to the driver are the codebooks, whose
size is that of ENTRIES vectors.

Rules: vectors that are null, or hold a null or a component that is not finite or not below LARGEST in magnitude, take no part. The
dimension is the most frequent one (then the least) among multiples of the number of parts; vectors of others take no part. Equal ids
are ordered by their vectors, null ids come last. Fewer vectors than entries make a smaller codebook; no vector, no rows. Where
2^63 is in reach of the sums, a batch is computed with Python's integers; an error beyond 64 bits is null. The sum of a label with such an error
is null as well; null labels are one label.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewatch.llm.shared import hex_digest, stored

SCALE, LARGEST = 256, 1e27
#: Distinct labels up to which their sums are broadcast; more are joined by a shuffle, in SALTS shares of each label.
BROADCAST_LABELS, SALTS = 100_000, 32
_LONG = 1 << 63


def _limbs(x: np.ndarray, width: int) -> list[np.ndarray]:
    """x as sum of limb[i] * 2^(width * i): limbs of `width` bits, not negative but for the highest, as float64."""
    out = []
    while True:
        if len(x) == 0 or (-(1 << width) <= x.min() and x.max() < (1 << width)):
            return [*out, x.astype(np.float64)]
        out.append((x & ((1 << width) - 1)).astype(np.float64))
        x = x >> width


def dot(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact products x @ c.T of int64 matrices whose products fit in 63 bits."""
    width = (53 - max(1, x.shape[1] - 1).bit_length() - 1) // 2
    out = np.zeros((len(x), len(c)), dtype=np.int64)
    for i, a in enumerate(_limbs(x, width)):
        for j, b in enumerate(_limbs(c, width)):
            out += (a @ b.T).astype(np.int64) << (width * (i + j))
    return out


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest row of c (the first of equals) and squared distance of each row of x; int64, or objects if they need be."""
    most = max((int(np.abs(m).max()) for m in (x, c) if m.size), default=0)
    if x.dtype == object or c.dtype == object or 4 * x.shape[1] * most * most >= _LONG // 2:
        x, c = x.astype(object), c.astype(object)
        d = np.stack([((x - row) ** 2).sum(axis=1) for row in c], axis=1)
        at = np.array([min(range(len(c)), key=row.__getitem__) for row in d], dtype=np.int64)
        return at, d[np.arange(len(x)), at]
    rest = (c * c).sum(axis=1)[None, :] - 2 * dot(x, c)
    at = rest.argmin(axis=1)
    return at, (x * x).sum(axis=1) + rest[np.arange(len(x)), at]


def _whole(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * x): SCALE is a power of two, so nothing is rounded before."""
    x = np.floor(values.astype(np.float64) * SCALE)
    if x.size and np.abs(x).max() >= 2.0 ** 62:
        return np.array([int(v) for v in x.ravel()], dtype=object).reshape(x.shape)
    return x.astype(np.int64)


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    flat = column.flatten()
    return _whole(flat.to_numpy(zero_copy_only=False)).reshape(-1, size)


def kept_vectors(vectors: DataFrame, parts: int, id_col: str, vec_col: str, label_col: str) -> tuple[DataFrame, int]:
    """vec_id, v (array<double>), label of the vectors that take part, and their dimension."""
    v = F.col(vec_col)
    base = vectors.select(F.col(id_col).alias("vec_id"), v.cast("array<double>").alias("v"), F.col(label_col).alias("label"))
    fine = base.where(F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) >= LARGEST)))
    sizes = fine.groupBy(F.size("v").alias("size")).agg(F.count(F.lit(1)).alias("n")).where((F.col("size") > 0) & (F.col("size") % parts == 0))
    first = sizes.orderBy(F.desc("n"), "size").first()
    size = first["size"] if first else 0
    return fine.where(F.size("v") == size) if size else fine.where(F.lit(False)), size


def _assigned(kept: DataFrame, books: list[np.ndarray], size: int) -> DataFrame:
    """vec_id, label, code, error."""
    parts = len(books)
    width = size // parts

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(1), size)
                found = [nearest(x[:, p * width:(p + 1) * width], book) for p, book in enumerate(books)]
                codes = np.stack([at for at, _ in found], axis=1).astype(np.uint8)
                exact = all(d.dtype != object and int(d.max()) < _LONG // parts for _, d in found)
                error = sum(d if exact else d.astype(object) for _, d in found)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0), batch.column(2), pa.array([row.tobytes().hex() for row in codes]),
                    pa.array(error if exact else [e if e < _LONG else None for e in error], type=pa.int64())], names=["vec_id", "label", "code", "error"])

    schema = f"vec_id {kept.schema['vec_id'].dataType.simpleString()}, label {kept.schema['label'].dataType.simpleString()}, code string, error long"
    return kept.select("vec_id", "v", "label").mapInArrow(run, schema)


def _moved(kept: DataFrame, books: list[np.ndarray], size: int) -> list[np.ndarray]:
    """The codebooks with each used entry at the componentwise floor of the mean of its parts."""
    parts = len(books)
    width = size // parts

    def run(batches):
        sums = [np.zeros(b.shape, dtype=object) for b in books]
        counts = [np.zeros(len(b), dtype=np.int64) for b in books]
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0), size)
                for p, book in enumerate(books):
                    own = x[:, p * width:(p + 1) * width]
                    at, _ = nearest(own, book)
                    order = np.argsort(at, kind="stable")
                    starts = np.flatnonzero(np.r_[True, np.diff(at[order]) > 0])
                    small = own.dtype != object and int(np.abs(own).max(initial=0)) * len(own) < _LONG
                    own = own[order] if small else own[order].astype(object)
                    sums[p][at[order][starts]] += np.add.reduceat(own, starts, axis=0).astype(object)
                    counts[p] += np.bincount(at, minlength=len(book))
        rows = [(p, e, i, int(counts[p][e]), str(sums[p][e, i])) for p in range(parts) for e in np.flatnonzero(counts[p]).tolist() for i in range(width)]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=t) for k, t in enumerate(
            (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string()))], names=["part", "entry", "at", "n", "total"])

    rows = kept.select("v").mapInArrow(run, "part int, entry int, at int, n long, total string")
    moved = rows.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    out = [b.astype(object) for b in books]
    for r in moved.collect():  # at most as many rows as the codebooks have components
        out[r["part"]][r["entry"], r["at"]] = int(r["total"]) // r["n"]
    return [_narrow(b) for b in out]


def _narrow(book: np.ndarray) -> np.ndarray:
    return book.astype(np.int64) if all(abs(v) < 1 << 62 for v in book.ravel()) else book


def train(kept: DataFrame, size: int, parts: int, entries: int, rounds: int) -> list[np.ndarray]:
    """One codebook (entries x components, integers) for each part; none if there is no vector."""
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    if not first:
        return []
    start = _whole(np.array([r["v"] for r in first], dtype=np.float64))
    books = [_narrow(start[:, p * (size // parts):(p + 1) * (size // parts)].astype(object)) for p in range(parts)]
    for _ in range(rounds):
        books = _moved(kept, books, size)
    return books


def compress(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, id_col: str = "vec_id", vec_col: str = "embedding",
             label_col: str = "label") -> DataFrame:
    """vec_id, label, code (two hex digits for each part), error (squared distance to the coded vector), label_error (summed over equal
    labels), codebooks_sha256 (of all final components, by part, entry and position, joined by commas). At most 256 entries."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has one byte for each part: 1 to 256 entries")
    kept, size = kept_vectors(vectors, parts, id_col, vec_col, label_col)
    books = train(kept, size, parts, entries, rounds)
    digest = hex_digest(",".join(str(v) for b in books for v in b.ravel()))
    coded = stored(_assigned(kept, books, size), "codes") if books else kept.select(
        "vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    # a sum beyond 64 bits, or of an unknown error, is null
    whole = F.sum(F.col("error").cast("decimal(38,0)"))
    sums = coded.groupBy("label").agg(F.when(F.count("error") == F.count(F.lit(1)), whole).alias("s"))
    sums = stored(sums.select(F.col("label").alias("__label"), F.when(F.col("s") <= F.lit(_LONG - 1), F.col("s").cast("long")).alias("label_error")), "labels")
    if sums.count() <= BROADCAST_LABELS:
        out = coded.join(F.broadcast(sums), coded["label"].eqNullSafe(sums["__label"]))
    else:
        salted = coded.withColumn("__salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
        shares = sums.withColumn("__share", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        out = salted.join(shares, salted["label"].eqNullSafe(shares["__label"]) & (salted["__salt"] == shares["__share"]))
    return out.select("vec_id", "label", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
