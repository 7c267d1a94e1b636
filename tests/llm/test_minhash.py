import random
import re

import numpy as np
import pytest
from conftest import prose

from pricewatch.llm import blocks, minhash, setsketch


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def expected(ids, texts, width, percent):
    """Component of each row by comparing every pair of rows."""
    sets = [shingles(t, width) for t in texts]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, k in enumerate(ids):
        if k is not None and sets[i]:
            least[find(i)] = min(k, least.get(find(i), k))
    return [(k, len(s), least.get(find(i)) if s else k) for i, (k, s) in enumerate(zip(ids, sets))]


def check(rows, ids, texts, width, percent):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows), key=str)
    assert got == sorted(expected(ids, texts, width, percent), key=str)
    assert all(r.kept == (r.component_id is None or r.doc_id == r.component_id) for r in rows)


def edited(rng, text, share):
    words = text.split()
    for i in rng.sample(range(len(words)), int(share * len(words))):
        words[i] = f"new{rng.randint(0, 10 ** 6)}"
    return " ".join(words)


@pytest.mark.parametrize("width, percent", [(3, 85), (5, 80)])
def test_equals_all_pairs(spark, rng, width, percent):
    texts = [prose(rng, rng.randint(1, 200)) for _ in range(60)]
    texts += [edited(rng, texts[rng.randrange(60)], rng.choice([0.005, 0.01, 0.02, 0.03, 0.05])) for _ in range(140)] + texts[:20]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    check(minhash.near_duplicates(docs, width, percent).collect(), ids, texts, width, percent)


@pytest.mark.parametrize("tile", [(512, 1 << 18), (7, 500)])
def test_one_large_group_of_unlike_copies(spark, rng, monkeypatch, tile):
    """Copies of one text, most of them too far from each other to be linked: crowded keys that stay open."""
    monkeypatch.setattr(blocks, "TILE_SETS", tile[0])
    monkeypatch.setattr(blocks, "TILE_SHINGLES", tile[1])
    base = prose(rng, 150)
    texts = [edited(rng, base, rng.uniform(0, 0.12)) for _ in range(150)] + [edited(rng, base, 0.05).rsplit(" ", rng.randint(1, 30))[0] for _ in range(50)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check(minhash.near_duplicates(docs, 3, 85).collect(), list(range(200)), texts, 3, 85)


def test_odd_rows(odd, odd_rows):
    check(minhash.near_duplicates(odd).collect(), [r[0] for r in odd_rows], [r[1] for r in odd_rows], 5, 80)


def test_empty(empty):
    assert minhash.near_duplicates(empty).count() == 0


def test_common_counts(rng, monkeypatch):
    monkeypatch.setattr(blocks, "COLUMNS", 5)
    draw = lambda: np.array(sorted(rng.sample(range(40), rng.randint(1, 20))), dtype=np.uint64)
    a, b = [draw() for _ in range(9)], [draw() for _ in range(7)]
    assert blocks._common(a, b).tolist() == [[len(set(x.tolist()) & set(y.tolist())) for y in b] for x in a]


# --- sketches
def sets_of(rng, shared, left, right):
    x = np.array([rng.getrandbits(64) for _ in range(shared + left + right)], dtype=np.uint64)
    return x[:shared + left], np.concatenate([x[:shared], x[shared + left:]])


def test_sketch_of_a_union_is_the_maximum(rng, monkeypatch):
    for n, m in ((1, 1), (5, 900), (4000, 3000)):
        a, b = sets_of(rng, n // 2, n - n // 2, m)
        both = np.unique(np.concatenate([a, b]))
        assert (setsketch.merge(setsketch.registers(a), setsketch.registers(b)) == setsketch.registers(both)).all()
    monkeypatch.setattr(setsketch, "PART", 100)
    whole = setsketch.registers(both)
    monkeypatch.undo()
    assert (whole == setsketch.registers(both)).all()
    assert not setsketch.registers(np.zeros(0, dtype=np.uint64)).any()


@pytest.mark.parametrize("shared, left, right", [(800, 100, 100), (300, 100, 300), (50, 400, 400), (0, 500, 500), (1000, 0, 0), (17, 2, 1)])
def test_estimate(rng, shared, left, right):
    found, true = [], shared / (shared + left + right)
    for _ in range(40):
        a, b = sets_of(rng, shared, left, right)
        p, q = setsketch.registers(a), setsketch.registers(b)
        n, m = np.array([len(a)]), np.array([len(b)])
        over, under = np.array([(p > q).sum()]), np.array([(p < q).sum()])
        found.append(setsketch.estimate(n, m, over, under)[0])
        assert setsketch.may_reach(true, n, m, over, under)[0]
        if true < 0.5:
            assert not setsketch.may_reach(0.85, n, m, over, under)[0]
    assert abs(np.mean(found) - true) < 0.02 and np.std(found) < 0.06


def test_registers_agree_at_least_as_often_as_the_sets(rng):
    equal = []
    for _ in range(60):
        a, b = sets_of(rng, 85, 7, 8)
        equal.append((setsketch.registers(a) == setsketch.registers(b)).mean())
    assert np.mean(equal) > 0.84


def test_band_rows():
    for s in (0.5, 0.8, 0.85, 0.95, 1.0):
        r = setsketch.band_rows(s)
        assert r == 1 or (1 - s ** r) ** (setsketch.M // r) <= 1e-6
    assert setsketch.band_rows(0.9) > setsketch.band_rows(0.8)
    keys = setsketch.bands(np.zeros((2, setsketch.M), dtype=np.uint8), 7)
    assert len(set(keys[0].tolist())) == setsketch.M // 7 and (keys[0] == keys[1]).all()
