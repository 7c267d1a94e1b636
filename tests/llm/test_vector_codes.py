import hashlib
import random

import numpy as np
import pytest

from pricewatch.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<double>, label int, code string, error long, v string"


def plain(rows, parts, entries, rounds):
    """The rule in Python integers: rows are (vec_id, vector, label)."""
    import math

    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) and abs(x) < vc.LARGEST for x in r[1])]
    sizes = [len(r[1]) for r in kept if len(r[1]) and len(r[1]) % parts == 0]
    size = min(set(sizes), key=lambda s: (-sizes.count(s), s)) if sizes else 0
    kept = sorted((r for r in kept if len(r[1]) == size and size), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return []
    w = size // parts
    whole = [[math.floor(x * 256) if abs(x) < 2 ** 40 else int(x) * 256 for x in r[1]] for r in kept]
    cut = [[v[p * w:(p + 1) * w] for p in range(parts)] for v in whole]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def near(x, book):
        d = [sum((a - b) ** 2 for a, b in zip(x, e)) for e in book]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        for p in range(parts):
            at = [near(c[p], books[p])[0] for c in cut]
            books[p] = [[sum(c[p][i] for c, a in zip(cut, at) if a == e) // at.count(e) for i in range(w)] if e in at else old
                        for e, old in enumerate(books[p])]
    found = [[near(c[p], books[p]) for p in range(parts)] for c in cut]
    errors = [sum(d for _, d in f) for f in found]
    digest = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    sums = {}
    for r, e in zip(kept, errors):
        sums[r[2]] = sums.get(r[2], 0) + e
    fit = lambda e: e if e < 2 ** 63 else None
    return [(r[0], "".join(f"{e:02x}" for e, _ in f), fit(e), fit(sums[r[2]]), digest) for r, f, e in zip(kept, found, errors)]


def run(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)
    out = vc.compress(df, **options).select("vec_id", "code", "error", "label_error", "codebooks_sha256")
    return sorted(map(tuple, out.collect()), key=str)


def vectors(rng, n, size, spread=1.0):
    return [(i, [rng.gauss(0, spread) for _ in range(size)], rng.choice([None, 1, 2])) for i in range(n)]


@pytest.mark.parametrize("n, size, parts, entries, rounds", [(200, 16, 4, 8, 2), (50, 32, 16, 64, 2), (3, 8, 2, 64, 1), (120, 6, 3, 5, 4)])
def test_equals_plain_integers(spark, n, size, parts, entries, rounds):
    rows = vectors(random.Random(n), n, size)
    rows += [(n + i, list(rows[i][1]), 1) for i in range(3)]  # equal vectors: ties go to the lower index
    assert run(spark, rows, parts=parts, entries=entries, rounds=rounds) == sorted(plain(rows, parts, entries, rounds), key=str)


def test_odd_rows(spark):
    rng, nan, inf = random.Random(5), float("nan"), float("inf")
    rows = vectors(rng, 40, 8)
    rows += [(100, None, 1), (101, [], 1), (102, [nan] * 8, 1), (103, [1.0] * 7 + [None], 2), (104, [inf] + [0.0] * 7, 2), (105, [1.0] * 7, 1), (106, [0.5] * 16, 1),
             (None, [0.25] * 8, None), (None, [-0.25] * 8, None), rows[3], rows[3], (7, [9.0] * 8, 3), (107, [0.0] * 8, 1), (108, [-0.0] * 8, 1)]
    assert run(spark, rows, parts=4, entries=16) == sorted(plain(rows, 4, 16, 2), key=str)


@pytest.mark.parametrize("scale", [1e5, 1e8, 1e15, 1e25])
def test_large_components(spark, scale):
    rows = vectors(random.Random(3), 30, 8) + [(100 + i, [float(round(scale * (i + 1) * s)) for s in (1, -1, 2, -2, 1, 1, -1, 3)], 1) for i in range(4)]
    assert run(spark, rows, parts=4, entries=6) == sorted(plain(rows, 4, 6, 2), key=str)


def test_none_and_many_labels(spark, monkeypatch):
    assert run(spark, []) == [] and run(spark, [(1, None, 1)]) == []
    monkeypatch.setattr(vc, "BROADCAST_LABELS", 1)
    rows = vectors(random.Random(8), 60, 8)
    assert run(spark, rows, parts=4, entries=6) == sorted(plain(rows, 4, 6, 2), key=str)


def test_limbs():
    rng = np.random.default_rng(1)
    for bits, d in ((3, 4), (20, 4), (28, 16), (29, 7), (30, 1)):
        x, c = (rng.integers(-(1 << bits), 1 << bits, (n, d)) for n in (50, 20))
        want = [[sum(int(a) * int(b) for a, b in zip(r, s)) for s in c] for r in x]
        assert vc.dot(x, c).tolist() == want
        at, dist = vc.nearest(x, c)
        full = [[sum((int(a) - int(b)) ** 2 for a, b in zip(r, s)) for s in c] for r in x]
        assert at.tolist() == [r.index(min(r)) for r in full] and dist.tolist() == [min(r) for r in full]
