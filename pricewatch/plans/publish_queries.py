"""Registered queries of published tables and of quick-add, with their DuckDB statements."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from ..sources import published, tables
from . import tables as t
from .queries import SQL_MERGE, merge_inputs, query


def new_folder(spark, name: str) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def twice_published(spark, folder):
    """The earlier half as batch 0, the later half with removals as batch 1, and batch 1 again."""
    prev, fresh, prev_stock, fresh_stock, removed = merge_inputs(spark, folder)
    named = lambda df, kind: df.withColumn("event", F.lit(kind))
    first = named(prev, "row").unionByName(named(prev_stock, "stock"), allowMissingColumns=True).withColumn("identity", F.lit(None).cast("string"))
    second = (named(fresh, "row").unionByName(named(fresh_stock, "stock"), allowMissingColumns=True)
              .unionByName(named(removed, "removed"), allowMissingColumns=True))
    ddl = lambda df: ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
    table = published.summary_tables(spark, new_folder(spark, "summary"), ddl(prev), ddl(prev_stock), buckets=16)
    for batch, events in ((0, first), (1, second), (1, second)):
        published.publish_events(table, events, batch)
    return table


@query(f"""WITH {SQL_MERGE} SELECT * FROM p WHERE (l_partkey, l_suppkey, is_warehouse) NOT IN (SELECT (l_partkey, l_suppkey, is_warehouse) FROM fr)
  AND (l_partkey, l_suppkey) NOT IN (SELECT (l_partkey, l_suppkey) FROM fs) AND l_suppkey % 10 <> 0 UNION ALL SELECT * FROM fr""")
def published_rows(spark, folder):
    return twice_published(spark, folder).read("rows").select("l_partkey", "l_suppkey", "is_warehouse", "price")


@query(f"""WITH {SQL_MERGE} SELECT * FROM ps WHERE (l_partkey, l_suppkey) NOT IN (SELECT (l_partkey, l_suppkey) FROM fr)
  AND (l_partkey, l_suppkey) NOT IN (SELECT (l_partkey, l_suppkey) FROM fs) UNION ALL SELECT * FROM fs""")
def published_stock(spark, folder):
    return twice_published(spark, folder).read("stock").select("l_partkey", "l_suppkey")


@query("""SELECT l_partkey AS offer_key, CAST(l_shipdate AS TIMESTAMP) AS last_checked_at, CAST(l_extendedprice AS DECIMAL(18,2)) AS last_price FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_suppkey DESC) = 1""")
def keyed_state(spark, folder):
    """Offer state after three batches of checks, the last one written twice."""
    rows = t.lines(spark, folder).withColumn("batch", F.when(F.year("observed_at") < 1994, 0).when(F.year("observed_at") < 1997, 1).otherwise(2))
    last = F.max_by(F.struct("observed_at", "price"), F.struct("observed_at", "seq")).alias("s")
    table = published.BucketedTables(spark, new_folder(spark, "state"), {"state": "offer_key bigint, last_checked_at timestamp, last_price decimal(18,2)"}, 16)
    for batch in (0, 1, 2, 2):
        new = rows.where(F.col("batch") == batch).groupBy(F.col("l_partkey").alias("offer_key")).agg(last)
        published.merge_keyed(table, "state", new.select(
            "offer_key", F.col("s.observed_at").alias("last_checked_at"), F.col("s.price").alias("last_price")), "offer_key", batch)
    return table.read("state").drop(published.BUCKET)


LATIN = "regexp_matches(html, '^[\\x00-\\xFF]*$')"


@query(f"""SELECT page_id, md5(CASE WHEN page_id % 4 = 2 AND {LATIN} THEN '<meta charset="iso-8859-1">' || html ELSE html END) AS digest FROM pages""")
def decoded_pages(spark, folder):
    """Pages stored as bytes: UTF-8, UTF-16 with a mark, and Latin-1 named by the page or by the header where it can hold the text."""
    html, kind = F.col("html"), F.col("page_id") % 4
    latin = html.rlike(r"^[\x00-\xFF]*$")
    declared = F.concat(F.lit('<meta charset="iso-8859-1">'), html)
    content = (F.when((kind == 1), F.concat(F.unhex(F.lit("FFFE")), F.encode(html, "UTF-16LE"))).when((kind == 2) & latin, F.encode(declared, "ISO-8859-1"))
               .when((kind == 3) & latin, F.encode(html, "ISO-8859-1")).otherwise(F.encode(html, "UTF-8")))
    header = F.when((kind == 3) & latin, "text/html; charset=ISO-8859-1").when(kind == 0, "text/html; charset=utf-8").otherwise("text/html")
    path = new_folder(spark, "pages")
    t.load(spark, folder, "pages").select("page_id", content.alias("html"), header.alias("content_type")).write.parquet(path)
    return tables.read_pages(spark, path, "html", "content_type").select("page_id", F.md5("html").alias("digest"))
