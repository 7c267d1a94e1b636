"""Approximate nearest neighbours by learned partitions.

1. A bounded sample (SAMPLE vectors, by a hash) gives an exact neighbour graph on the driver.
2. The graph is cut into parts of equal size: a start by median splits along main directions, then moves and swaps that
   bring neighbours together while no part exceeds its size by more than SLACK.
3. A small network with one hidden layer learns from the sample which parts a vector's neighbours are in.
4. Every vector is put into its likeliest part. A query goes to its several likeliest parts; how many is set on sample vectors
   that the network has not seen, so that TARGET of their neighbours are found.
5. Inside a part, blocks of vectors meet blocks of queries, and the best of each block are scored exactly in double precision.

Equal vectors are one class that keeps its smallest ids, as many as an answer can name, so a vector that a third of all rows
share costs no more than another. Blocks bound what a task holds whatever the size of a part.

Rules: vectors that are null, zero, hold nulls or non-finite components, or whose length is not the commonest one take no part,
nor do rows without an id; wholly repeated rows count once. Ties go to the smaller id. No vectors: no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricewatch.llm.shared import stored

SAMPLE, NEIGHBOURS, SLACK, TARGET = 8192, 10, 0.05, 0.97
#: Vectors to a part as long as the sample can hold so many parts; vectors and queries in a block.
PART, BLOCK, QUERY_BLOCK = 1024, 2048, 1024


@dataclass
class Router:
    """Network from unit vectors to parts, and the number of parts that a query is sent to."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def parts(self, x: np.ndarray, n: int) -> np.ndarray:
        """The n likeliest parts of each vector, likeliest first."""
        return np.argsort(-self.logits(unit(x)), axis=1, kind="stable")[:, :n]


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest others of each unit vector."""
    k = min(k, len(x) - 1)
    out = np.empty((len(x), k), dtype=np.int64)
    for at in range(0, len(x), 1024):
        s = x[at:at + 1024] @ x.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -np.inf
        out[at:at + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12) -> np.ndarray:
    """Part of each vector; sizes stay within (1 + SLACK) of the mean, and few edges of the graph are cut."""
    label = np.zeros(len(x), dtype=np.int64)

    def split(rows: np.ndarray, low: int, n: int) -> None:
        if n == 1:
            label[rows] = low
            return
        centred = x[rows] - x[rows].mean(axis=0)
        direction = np.linalg.eigh(centred.T @ centred)[1][:, -1]
        order = rows[np.argsort(centred @ direction, kind="stable")]
        cut = len(rows) * (n // 2) // n
        split(order[:cut], low, n // 2)
        split(order[cut:], low + n // 2, n - n // 2)

    split(np.arange(len(x)), 0, parts)
    room = int(np.ceil(len(x) / parts * (1 + SLACK)))
    source, target = np.repeat(np.arange(len(x)), graph.shape[1]), graph.ravel()
    for _ in range(rounds):
        votes = np.zeros((len(x), parts))
        np.add.at(votes, (source, label[target]), 1)
        np.add.at(votes, (target, label[source]), 1)
        best = votes.argmax(axis=1)
        gain = votes[np.arange(len(x)), best] - votes[np.arange(len(x)), label]
        wish = np.flatnonzero(gain > 0)
        wish = wish[np.argsort(-gain[wish], kind="stable")]
        size = np.bincount(label, minlength=parts)
        waiting: dict[tuple[int, int], list[int]] = {}
        moved = 0
        for v in wish.tolist():
            a, b = int(label[v]), int(best[v])
            if size[b] < room:
                label[v] = b
                size[a] -= 1
                size[b] += 1
                moved += 1
            elif waiting.get((b, a)):  # swap with one that wants the other way
                u = waiting[b, a].pop(0)
                label[v], label[u] = b, a
                moved += 2
            else:
                waiting.setdefault((a, b), []).append(v)
        if not moved:
            break
    return label


def learn(x: np.ndarray, parts: int, wanted: int, hidden: int = 128, epochs: int = 25, seed: int = 0) -> Router:
    """Fit the router on sample vectors."""
    x = unit(x)
    rng = np.random.default_rng(seed)
    if len(x) <= 2 * parts or parts < 2:
        return Router(np.zeros((x.shape[1], 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1), 1)
    graph = neighbour_graph(x, NEIGHBOURS)
    label = balanced_parts(x, graph, parts)
    soft = np.full((len(x), parts), 1e-3)
    np.add.at(soft, (np.repeat(np.arange(len(x)), graph.shape[1]), label[graph].ravel()), 1.0)
    soft[np.arange(len(x)), label] += 2.0
    soft /= soft.sum(axis=1, keepdims=True)
    order = rng.permutation(len(x))
    held, used = order[: max(1, min(512, len(x) // 8))], order[max(1, min(512, len(x) // 8)):]
    p = [rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden),
         rng.normal(0, np.sqrt(1 / hidden), (hidden, parts)), np.zeros(parts)]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(epochs):
        rng.shuffle(used)
        for at in range(0, len(used), 256):
            rows = used[at:at + 256]
            h = np.maximum(x[rows] @ p[0] + p[1], 0)
            z = h @ p[2] + p[3]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            d = (z / z.sum(axis=1, keepdims=True) - soft[rows]) / len(rows)
            dh = (d @ p[2].T) * (h > 0)
            t += 1
            for i, g in enumerate((x[rows].T @ dh, dh.sum(axis=0), h.T @ d, d.sum(axis=0))):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p[i] -= 0.003 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    router = Router(*p, probes=1)
    near = graph[held][:, :wanted] if graph.shape[1] > wanted else graph[held]
    exact = np.argsort(-(x[held] @ x.T), axis=1)[:, 1:wanted + 1]
    near = exact if exact.shape[1] else near
    place = router.parts(x, 1)[:, 0]
    rank = np.argsort(router.parts(x[held], parts), axis=1)
    needed = np.sort(rank[np.arange(len(held))[:, None], place[near]].ravel())
    router.probes = int(needed[min(len(needed) - 1, int(np.ceil(TARGET * len(needed))))]) + 1
    return router


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id, v: the rows that take part, wholly repeated ones once."""
    v = F.col("v")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).alias("v")).where(
        F.col("vec_id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda c: c != 0))
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (common["n"] if common else 0))


def _stack(column) -> np.ndarray:
    return np.stack([np.asarray(a, dtype=np.float64) for a in column])


def _placed(rows: DataFrame, router: Router, probes: int) -> DataFrame:
    """Adds parts array<int>: the likeliest `probes` parts of each row's v."""
    shared = rows.sparkSession.sparkContext.broadcast(router)
    names = [*rows.columns, "parts"]
    at = rows.columns.index("v")

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                column = batch.column(at)
                x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(batch), -1)
                found = shared.value.parts(x, probes).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(found), type=pa.list_(pa.int32()))], names=names)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields) + ", parts array<int>"
    return rows.mapInArrow(run, schema)


def search(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding",
           sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: for each row where is_query (a condition on vec_id) holds, its k nearest found."""
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vec_col)
    first = Window.partitionBy("v").orderBy("vec_id")
    top = rows.withColumn("n", F.dense_rank().over(first)).where(F.col("n") <= k + 1)
    classes = stored(top.groupBy("v").agg(F.sort_array(F.collect_set("vec_id")).alias("ids")), "classes")
    total = classes.count()
    share = min(1.0, sample / max(1, total))
    drawn = classes.where(F.pmod(F.xxhash64("v"), F.lit(1 << 20)) < int(share * (1 << 20))).select("v").toPandas()
    if not len(drawn):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    parts = max(1, min(-(-total // PART), len(drawn) // 32))
    router = learn(_stack(drawn["v"]), parts, k)

    base = stored(_placed(classes, router, 1).select("v", "ids", F.col("parts")[0].alias("part")), "index")
    asked = rows.where(is_query).select(F.col("vec_id").alias("query_id"), "v")
    asked_classes = stored(asked.groupBy("v").agg(F.min("query_id").alias("q")), "queries")
    routed = stored(_placed(asked_classes, router, router.probes).select("v", "q", F.explode("parts").alias("part")), "routed")
    # at most `parts` rows each, and parts are bounded by the sample
    blocks = {r["part"]: -(-r["n"] // BLOCK) for r in base.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    lots = {r["part"]: -(-r["n"] // QUERY_BLOCK) for r in routed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    met = sorted(set(blocks) & set(lots))
    if not met:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    def looked(of: dict[int, int]) -> Column:
        return F.create_map(*[F.lit(x) for p in met for x in (p, of[p])])[F.col("part")]

    def dealt(df: DataFrame, own: str, own_of: dict, other: str, other_of: dict) -> DataFrame:
        df = df.where(F.col("part").isin(met))
        df = df.withColumn(own, F.pmod(F.xxhash64("v"), looked(own_of)).cast("int"))
        return df.withColumn(other, F.explode(F.sequence(F.lit(0), (looked(other_of) - 1).cast("int"))))

    left = dealt(base.withColumn("first", F.col("ids")[0]), "block", blocks, "lot", lots)
    right = dealt(routed, "lot", lots, "block", blocks)
    keep = k + 1

    def rerank(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"q": [], "first": [], "score": []})
        a = a.sort_values("first")
        x, y = _stack(a["v"]), _stack(b["v"])
        s = unit(y) @ unit(x).T
        n = min(keep, s.shape[1])
        edge = np.partition(s, s.shape[1] - n, axis=1)[:, s.shape[1] - n]
        i, j = np.nonzero(s >= edge[:, None] - 1e-9)
        exact = np.empty(len(i))
        for at in range(0, len(i), 65536):
            p, r = y[i[at:at + 65536]], x[j[at:at + 65536]]
            exact[at:at + 65536] = (p * r).sum(axis=1) / (np.sqrt((p * p).sum(axis=1)) * np.sqrt((r * r).sum(axis=1)))
        return pd.DataFrame({"q": b["q"].to_numpy()[i], "first": a["first"].to_numpy()[j], "score": exact})

    key = ["part", "block", "lot"]
    found = left.select(*key, "v", "first").groupBy(*key).cogroup(right.select(*key, "v", "q").groupBy(*key)).applyInPandas(
        rerank, "q long, first long, score double")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "first")
    best = found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= keep)
    named = best.join(base.select(F.col("ids")[0].alias("first"), "ids"), "first").select("q", "score", F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    named = named.withColumn("n", F.row_number().over(order)).where(F.col("n") <= keep).drop("n")
    named = named.join(asked_classes, "q").select("v", "score", "vec_id")
    answers = asked.distinct().join(named, "v").where(F.col("query_id") != F.col("vec_id"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (answers.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select(F.col("query_id").cast("long"), F.col("rank").cast("int"), F.col("vec_id").cast("long"), "score"))
