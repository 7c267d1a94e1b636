import random

import numpy as np
import pytest
from conftest import prose
from pyspark.sql import functions as F

from pricewatch.llm import compact_windows, partition_index
from pricewatch.llm.shared import mix


def brute(rows, k=5):
    ids, x = [i for i, _ in rows], np.array([v for _, v in rows], dtype=float)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    out = {}
    for q, i in enumerate(ids):
        order = sorted((-round(s[q, j], 12), ids[j]) for j in range(len(ids)) if ids[j] != i)
        out[i] = [v for _, v in order[:k]]
    return out


def test_recall_and_hot_vector(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 24)).astype(np.float32)
    x[::3] = x[0]
    rows = [(i, v.tolist(), i % 4) for i, v in enumerate(x)]
    got = partition_index.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>, part int"), F.col("vec_id") % 50 == 0).collect()
    want = brute([(r[0], r[1]) for r in rows])
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    queries = [i for i in range(4000) if i % 50 == 0]
    assert sorted(found) == queries and all([n for n, _, _ in sorted(v)] == [1, 2, 3, 4, 5] for v in found.values())
    recall = np.mean([len({v for _, v, _ in found[q]} & set(want[q])) / 5 for q in queries])
    assert recall >= 0.9
    for q in (0, 150, 300):
        assert [v for _, v, _ in sorted(found[q])] == [i for i in range(0, 21, 3) if i != q][:5]


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [1.0, None]),
            (7, [float("inf"), 1.0]), (None, [1.0, 1.0]), (1, [2.0, 0.0]), (8, [1.0, 2.0, 3.0]), (50, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as part", "2 as q")
    got = [tuple(r)[:3] for r in partition_index.search(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 50), (0, 3, 2), (50, 1, 0), (50, 2, 1), (50, 3, 2)]
    assert partition_index.search(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert partition_index.search(df.where("vec_id = 3"), F.col("vec_id") % 50 == 0).count() == 0


def test_parts_are_balanced():
    x = partition_index.unit(np.random.default_rng(0).normal(size=(1000, 8)))
    label = partition_index.balanced_parts(x, partition_index.neighbour_graph(x, 10), 7)
    assert np.bincount(label, minlength=7).max() <= np.ceil(1000 / 7 * 1.05)


@pytest.mark.parametrize("n", [1, 45, 46, 47, 300])
def test_windows_are_the_minima_of_runs(n):
    h = np.random.default_rng(n).integers(0, 40 if n == 47 else 2**63, n).astype(np.uint64)
    g = mix(h, 1)
    made = compact_windows.windows(g, 46)
    for low in range(0, n - 45):
        for high in range(low + 45, n):
            inside = [w for w in made if w[0] <= low <= w[1] <= high <= w[2]]
            assert len(inside) == 1 and g[inside[0][1]] == g[low:high + 1].min()
    want = sorted({int(mix(h, i)[m]) for i in range(compact_windows.HASHES) for _, m, _ in compact_windows.windows(mix(h, i), 46)})
    text, keys = compact_windows.signatures(np.concatenate([h[:3], h, h[:50]]), np.array([0, min(3, n), min(3, n) + n, min(3, n) + n + min(50, n)]), 46)
    assert keys[text == 1].tolist() == want


def test_shingles_do_not_depend_on_neighbours():
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choice("abÉ日Z") for _ in range(rng.randint(1, 7))) + rng.choice(["", "\t", " "]) for _ in range(rng.choice([0, 1, 4, 5, 6, 60]))) for _ in range(200)]
    texts += ["", "  ", "x" * 20_000 + " a b c d", "A b C d E", "a B c D e"]
    flat, ends = compact_windows.shingle_rows(texts, size=300)
    for i, t in enumerate(texts):
        alone, end = compact_windows.shingle_rows([" \n" + t + "\x0b"])
        assert flat[ends[i]:ends[i + 1]].tolist() == alone.tolist()
        assert len(alone) == max(0, len(t.encode().split()) - 4)
    assert flat[ends[-3]:ends[-2]].tolist() == flat[ends[-2]:].tolist()


def passage_pairs(df):
    return [(r.doc_id, r.start, r.stop, r.other_id, r.other_start, r.other_stop) for r in df.collect()]


def test_shared_passages(spark, odd, empty):
    rng = random.Random(9)
    common, line = prose(rng, 60), prose(rng, 14)
    near = common.split()
    near[30] = "changed"
    docs = [(0, f"{prose(rng, 50)} {common} {prose(rng, 90)}"), (1, f"{prose(rng, 70)}\n{common}"), (2, prose(rng, 10) + " " + " ".join(near) + " " + prose(rng, 5)),
            (3, f"{prose(rng, 80)} {line} {prose(rng, 80)}"), (4, f"{line} {prose(rng, 120)}"), (5, prose(rng, 300)), (6, None), (7, common.rsplit(" ", 15)[0])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = passage_pairs(compact_windows.shared_passages(df))
    assert {r[0] for r in got} | {r[3] for r in got} == {0, 1, 2}
    assert (0, 50, 110, 1, 70, 130) in got
    assert any(r[0] in (0, 1) and r[3] == 2 and r[5] - r[4] >= 50 for r in got)
    assert compact_windows.shared_passages(empty).count() == 0
    pairs = passage_pairs(compact_windows.shared_passages(odd))
    assert {(r[0], r[3]) for r in pairs} == {(7, 8), (None, None)}


def test_passage_in_many_documents(spark):
    rng = random.Random(11)
    common, line = prose(rng, 70), prose(rng, 16)
    docs = [(i, f"{prose(rng, 60)} {line} {prose(rng, 40)} " + (common if i % 2 else prose(rng, 70)) + f" {line} {prose(rng, 30)}") for i in range(120)]
    got = passage_pairs(compact_windows.shared_passages(spark.createDataFrame(docs, "doc_id long, text string")))
    assert {r[0] for r in got} | {r[3] for r in got} == set(range(1, 120, 2))
    assert len(got) <= 8 * 120


def test_one_edit_at_every_place(spark):
    rng = random.Random(13)
    docs = []
    for n in (50, 55, 60, 70):
        for at in range(n):
            words = prose(rng, n).split()
            docs.append(f"{prose(rng, 60)} {' '.join(words)} {prose(rng, 60)}")
            words[at] = "changed"
            docs.append(f"{prose(rng, 45)} {' '.join(words)} {prose(rng, 50)}")
    got = compact_windows.shared_passages(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()
    assert {(r.doc_id, r.other_id) for r in got} == {(i, i + 1) for i in range(0, len(docs), 2)}
    flat = [t.split() for t in docs]
    for r in got:
        x, y = ({tuple(w[i:i + 5]) for i in range(a, b - 4)} for w, a, b in ((flat[r.doc_id], r.start, r.stop), (flat[r.other_id], r.other_start, r.other_stop)))
        assert min(r.stop - r.start, r.other_stop - r.other_start) >= 50 and abs(len(x & y) / len(x | y) - r.similarity) < 1e-9 and r.similarity >= 0.8


def test_best_runs_are_those_of_brute_force():
    rng = np.random.default_rng(5)
    for _ in range(40):
        a, b = rng.integers(0, 25, 30), rng.integers(0, 25, 28)
        b[6:20] = a[8:22]
        am, bm, n, k = 12, 10, int(rng.integers(5, 12)), int(rng.integers(5, 12))
        got, s, u = compact_windows.best_runs(a, b, am, bm, n, k)
        want = max(compact_windows.similarity_of(a[p:p + n], b[q:q + k]) for p in range(max(0, am - n + 1), min(am, 30 - n) + 1)
                   for q in range(max(0, bm - k + 1), min(bm, 28 - k) + 1))
        assert abs(got - want) < 1e-12 and abs(compact_windows.similarity_of(a[s:s + n], b[u:u + k]) - got) < 1e-12
        assert s <= am < s + n and u <= bm < u + k


def test_links_beside_the_first_of_a_passage(spark):
    """Two passages that are alike are a pair though the first document of each signature, which holds a piece of them, is like neither."""
    rng = random.Random(17)
    docs, want = [], set()
    for _ in range(6):
        base = prose(rng, 60).split()
        near = list(base)
        near[30] = "near"
        docs += [f"{prose(rng, 60)} {' '.join(words)} {prose(rng, 60)}" for words in (base[:30], base[15:45], base[30:], base, near)]
        want.add((len(docs) - 2, len(docs) - 1))
    got = passage_pairs(compact_windows.shared_passages(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")))
    assert {(r[0], r[3]) for r in got} == want


def test_pairs_in_tiles(spark):
    """All classes of a signature meet once, copies meet the first of their class."""
    rows = [(d, d, 7, 0, 3, 60, 0 if d < 9 else 5) for d in range(14)]
    hits = spark.createDataFrame(rows, "doc_id long, row long, key long, l int, m int, r int, same long")
    for tile in (1, 3, 256):
        got = sorted((r.a, r.b) for r in compact_windows._pairs(hits, tile).collect())
        assert got == sorted([(a, b) for a in range(10) for b in range(a + 1, 10)] + [(9, b) for b in range(10, 14)])


def test_repeated_windows_make_one_pair_of_texts(spark):
    """Windows that a text repeats were joined each with each: 50 of them in 20 texts made 475,000 rows."""
    rows = [(d, d, 7, m, m, m + 50, 0) for d in range(20) for m in range(50)]
    hits = spark.createDataFrame(rows, "doc_id long, row long, key long, l int, m int, r int, same long")
    assert compact_windows._pairs(hits).count() == 190


def test_windows_of_a_repeated_line_are_few():
    """Of a line that a text repeats, windows in equal surroundings are kept once."""
    h = np.tile(np.random.default_rng(3).integers(1, 1 << 62, 12).astype(np.uint64), 60)
    recurs = np.ones(len(h), dtype=bool)
    inside, low, high = compact_windows.contexts(h, recurs, 46, 0.8)
    made = np.array(compact_windows.windows(h, 46), dtype=np.int64)
    got = compact_windows.named(h, made, h, low, high)
    assert inside.all() and len(made) > 50 and got.shape[1] <= 12
    assert 0 in got[2] and set(got[2].tolist()) <= set(made[:, 1].tolist())
