"""Shared helpers: tables in the cluster's shared folder, Arrow batches, words."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricewatch.session import ensure_checkpoint_dir

#: The white space of all word rules here: [\x20\x09-\x0D]. It is also what bytes.split() splits at.
SPACE = " \t\n\v\f\r"
#: Lower-cases A-Z in UTF-8 bytes and leaves every other byte alone.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session, or one set for a local session."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    ensure_checkpoint_dir(spark)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage, and a lost executor loses nothing of it."""
    path = f"{shared_folder(df.sparkSession)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unbroadcast(rows: DataFrame) -> DataFrame:
    """A side of a join with rows that explode() made. Spark sizes them by what they were made of, some tens of times too low, and would
    collect them in the driver to broadcast them; so the join is a sort-merge join whatever the size."""
    return rows.hint("merge")


def map_texts(
    df: DataFrame, keep: list[str], text: str, fields: list[tuple[str, str]],
    make: Callable[[], Callable[[list[str]], list[pa.Array]]], rows: int = 512,
) -> DataFrame:
    """Keep some columns and add columns that a task computes from whole texts, an Arrow batch at a time.

    `make` runs once for each task and returns a function from a list of texts (null: empty) to one Arrow array for each
    field. Spark's own settings bound a batch in rows and bytes; it is cut again into slices of at most `rows`.
    """
    base = df.select(*[df[c].alias(f"k{i}") for i, c in enumerate(keep)], F.coalesce(df[text].cast("string"), F.lit("")).alias("t"))
    schema = T.StructType([T.StructField(f"k{i}", df.schema[c].dataType) for i, c in enumerate(keep)]
                          + [T.StructField(n, T._parse_datatype_string(t)) for n, t in fields])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in slices(batch, rows):
                made = work(part.column(len(keep)).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(len(keep))] + made, names=names)

    out = base.mapInArrow(run, schema)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *[n for n, _ in fields])


def text_column(text: Column, kind: str, make: Callable[[], Callable[[list[str]], pa.Array]], rows: int = 512) -> Column:
    """A column that a task computes from whole texts (null: empty), as in map_texts(). Only the text goes to Python and only the new
    column comes back; the other columns of a row stay where they are, so that memory does not hold texts twice."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        work = make()
        for batch in batches:
            per_row = max(1, batch.nbytes // max(1, len(batch)))
            step = int(max(1, min(rows, (4 << 20) // per_row)))
            parts = [work(batch.slice(at, step).to_pylist()) for at in range(0, max(1, len(batch)), step)]
            yield pa.concat_arrays(parts)

    return F.arrow_udf(run, kind)(F.coalesce(text.cast("string"), F.lit("")))


def slices(batch: pa.RecordBatch, rows: int = 512, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch into pieces of bounded rows and, above one row, bounded bytes."""
    at = 0
    per_row = max(1, batch.nbytes // max(1, batch.num_rows))
    step = int(max(1, min(rows, size // per_row)))
    while at < batch.num_rows:
        yield batch.slice(at, step)
        at += step


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(LOWER).split()


def hex_digest(data: str | bytes) -> str:
    return hashlib.sha256(data.encode("utf-8", "surrogatepass") if isinstance(data, str) else data).hexdigest()


def n_words(text: Column) -> Column:
    """Number of words of a text, counted in the JVM: starts of runs of other characters than white space."""
    spaced = F.translate(text, SPACE, " " * len(SPACE))
    return F.coalesce(F.size(F.filter(F.split(spaced, " "), lambda w: w != "")), F.lit(0)).cast("int")


def mix(h: np.ndarray, seed: int) -> np.ndarray:
    """One of a family of permutations of 64-bit hashes."""
    x = h ^ np.uint64((0x9E3779B97F4A7C15 * (2 * seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
