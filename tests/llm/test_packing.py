import itertools

import numpy as np
import pytest

from pricewatch.llm import packing


@pytest.mark.parametrize("buckets", [1, 2, 3, 8])
def test_boundaries_are_optimal(buckets):
    rng = np.random.default_rng(buckets)
    top = np.sort(rng.choice(np.arange(1, 60), 7, replace=False))
    count = rng.integers(1, 9, 7)

    def padding(bounds):
        at = np.searchsorted(bounds, top)
        return int((count * (np.array(bounds)[at] - top)).sum())

    best = min(padding(sorted({*c, top[-1]})) for n in range(0, buckets) for c in itertools.combinations(top[:-1].tolist(), min(n, 6)))
    made = packing.boundaries(top, count, count * top, buckets)
    assert padding(made) == best and len(made) <= buckets


def test_pack(spark, odd, odd_rows):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 97 * (i % 5))) for i in range(6000)], "doc_id long, text string")
    rows = packing.pack(docs, buckets=4, budget=400).collect()
    assert sorted(r.doc_id for r in rows) == list(range(6000))
    batches = {}
    for r in rows:
        assert r.n_tokens == 1 + r.doc_id % 97 * (r.doc_id % 5) <= r.bucket_len
        batches.setdefault((r.bucket, r.batch), []).append(r)
    partial = 0
    for b in batches.values():
        room = max(1, 400 // b[0].bucket_len)
        assert sorted(r.slot for r in b) == list(range(len(b))) and len(b) <= room
        partial += len(b) < room
    assert partial <= 4 and len({r.bucket for r in rows}) == 4
    rows = packing.pack(odd).collect()
    assert sorted(r.n_tokens for r in rows) == sorted(len((r[1] or "").split()) for r in odd_rows)


def test_one_hot_length(spark):
    docs = spark.createDataFrame([(i, "a b" if i % 3 else "c") for i in range(5000)], "doc_id long, text string")
    rows = packing.pack(docs, budget=64).collect()
    assert len({(r.bucket, r.batch, r.slot) for r in rows}) == 5000 and max(r.slot for r in rows) < 64


def test_empty(empty):
    assert packing.pack(empty).count() == 0


def test_cells_keep_order(spark):
    df = spark.range(200_000).select("id", packing.cell(packing.F.col("id")).alias("c")).toPandas().sort_values("id")
    assert (df.c.diff().dropna() >= 0).all() and df.c[:1025].is_unique
    wide = df.groupby("c").id.agg(["min", "max"])
    assert ((wide["max"] - wide["min"] + 1) * 100 <= wide["min"].clip(lower=100) + 100).all()
