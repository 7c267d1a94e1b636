"""Tables that are replaced in buckets, a batch at a time, each batch once.

A row belongs to the bucket that its key hashes to. A batch writes new versions of the buckets that it touches and then one small
manifest, which names the version of every bucket. Readers go by the newest complete manifest, so a batch shows as a whole or not at
all; a batch that is run again finds its manifest and does nothing, and one that was cut off writes the same files anew. The work
of a batch grows with the buckets that it touches, not with the table.

    folder/data/<table>/version=<batch>/_bucket=<n>/    folder/manifest/batch=<batch>/
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import text_or_empty
from ..functions.urls import canonical_url, row_identity
from ..operators.summary import merge_summary
from ..session import written

BUCKETS = 64
BUCKET = "_bucket"


class BucketedTables:
    """One or more tables, name -> DDL schema, with a common division into buckets and a common manifest."""

    def __init__(self, spark: SparkSession, folder: str, tables: dict[str, str], buckets: int = BUCKETS):
        self.spark, self.folder, self.tables, self.buckets = spark, folder.rstrip("/"), tables, buckets

    def bucket_of(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _files(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _children(self, path: str, prefix: str) -> list[int]:
        fs, p = self._files(path)
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(n[len(prefix):]) for n in names if n.startswith(prefix))

    def batches(self) -> list[int]:
        """Batches whose manifest is complete, oldest first."""
        def complete(batch: int) -> bool:
            fs, p = self._files(f"{self.folder}/manifest/batch={batch}/_SUCCESS")
            return fs.exists(p)

        return [b for b in self._children(f"{self.folder}/manifest", "batch=") if complete(b)]

    def versions(self, batch: int | None = None) -> dict[tuple[str, int], int]:
        """(table, bucket) -> version, at most one entry for each table and bucket."""
        done = self.batches() if batch is None else [batch]
        if not done:
            return {}
        rows = self.spark.read.schema("name string, bucket int, version long").json(f"{self.folder}/manifest/batch={done[-1]}").collect()
        return {(r.name, r.bucket): r.version for r in rows}

    def read(self, name: str, buckets: list[int] | None = None) -> DataFrame:
        """The rows of a table, or of some of its buckets, with the column `_bucket`."""
        found = {b: v for (n, b), v in self.versions().items() if n == name and (buckets is None or b in set(buckets))}
        if not found:
            return self.spark.createDataFrame([], f"{self.tables[name]}, {BUCKET} int")
        base = f"{self.folder}/data/{name}"
        paths = [f"{base}/version={v}/{BUCKET}={b}" for b, v in sorted(found.items())]
        rows = self.spark.read.schema(f"{self.tables[name]}, version long, {BUCKET} int").option("basePath", base).parquet(*paths)
        return rows.drop("version")

    def touched(self, rows: DataFrame) -> list[int]:
        """Distinct buckets of some rows: at most as many numbers as there are buckets."""
        return sorted(r[0] for r in rows.select(BUCKET).distinct().collect())

    def commit(self, batch: int, new: dict[str, DataFrame], touched: list[int]) -> None:
        """Make `new` (with `_bucket`) the rows of the touched buckets; all other buckets stay as they are."""
        versions = {k: v for k, v in self.versions().items() if k[1] not in set(touched)}
        for name, rows in new.items():
            target = f"{self.folder}/data/{name}/version={batch}"
            rows.repartition(max(1, len(touched)), BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(target)
            versions |= {(name, b): batch for b in self._children(target, f"{BUCKET}=")}
        rows = [(n, b, v) for (n, b), v in sorted(versions.items())]
        manifest = self.spark.createDataFrame(rows, "name string, bucket int, version long")
        manifest.coalesce(1).write.mode("overwrite").json(f"{self.folder}/manifest/batch={batch}")

    def expire(self, keep: int = 2) -> None:
        """Delete all but the newest manifests and the data that none of these names."""
        done = self.batches()
        used = {(n, b, v) for batch in done[-keep:] for (n, b), v in self.versions(batch).items()}
        for name in self.tables:
            base = f"{self.folder}/data/{name}"
            for v in self._children(base, "version="):
                for b in self._children(f"{base}/version={v}", f"{BUCKET}="):
                    if done and v <= done[-1] and (name, b, v) not in used:
                        fs, p = self._files(f"{base}/version={v}/{BUCKET}={b}")
                        fs.delete(p, True)
        for batch in done[:-keep]:
            fs, p = self._files(f"{self.folder}/manifest/batch={batch}")
            fs.delete(p, True)


# --- keyed state ------------------------------------------------------------
def merge_keyed(table: BucketedTables, name: str, updates: DataFrame, key: str, batch: int) -> bool:
    """Upsert: the record of an update replaces the one stored under its key. False if the batch was already there.

    `updates` has one row for each key. Only buckets with an update are read and written.
    """
    if batch in table.batches():
        return False
    new = written(updates.withColumn(BUCKET, table.bucket_of(F.col(key))))
    touched = table.touched(new)
    left = table.read(name, touched).join(new.select(key), [key], "left_anti")
    table.commit(batch, {name: left.unionByName(new, allowMissingColumns=True)}, touched)
    return True


# --- summary ----------------------------------------------------------------
def summary_tables(spark: SparkSession, folder: str, row: str, stock: str, buckets: int = BUCKETS) -> BucketedTables:
    """Price rows and stock rows of a published summary, by the canonical link of the product."""
    return BucketedTables(spark, folder, {"rows": row, "stock": stock}, buckets)


def publish_events(table: BucketedTables, events: DataFrame, batch: int) -> bool:
    """Merge events into the published summary as `merge_summary` does. False if the batch was already there.

    An event has `event` and the columns of both tables: `row` is a fresh price row, `stock` a fresh stock row (its link's price
    rows go), `removed` names in `identity` a price row that a failed watch takes back.
    """
    if batch in table.batches():
        return False
    # the events are often the result of other work, and they are read for the buckets and for the merge: made once, with their buckets
    events = written(events.withColumn(BUCKET, table.bucket_of(canonical_url(text_or_empty(F.col("product_url"))))))
    kind = F.col("event")
    names = {n: [c for c in table.read(n).columns if c != BUCKET] for n in table.tables}
    fresh = events.where(kind == "row").select(*names["rows"], BUCKET)
    gaps = events.where(kind == "stock").select(*names["stock"], BUCKET)
    removed = events.where((kind == "removed") & (F.coalesce("identity", F.lit("")) != "")).select("identity").distinct()
    # an identity doesn't tell its bucket: it is looked up among the published identities
    identity = row_identity(F.col("tracking_id"), F.col("product_url"), F.col("is_warehouse"))
    taken = table.read("rows").withColumn("identity", identity).join(removed, ["identity"], "left_semi")
    touched = sorted({*table.touched(fresh), *table.touched(gaps), *table.touched(taken)})
    rows, stock = merge_summary(table.read("rows", touched), fresh, table.read("stock", touched), gaps, removed)
    table.commit(batch, {"rows": rows, "stock": stock}, touched)
    return True


def publisher(table: BucketedTables) -> Callable[[DataFrame, int], None]:
    """Function for `foreachBatch`: a micro-batch that is retried after it was published changes nothing."""
    def on_batch(events: DataFrame, batch_id: int) -> None:
        publish_events(table, events, batch_id)

    return on_batch
