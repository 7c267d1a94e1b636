import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from conftest import prose
from pyspark.sql import functions as F

from pricewatch.llm import blocks, exact_dedup, simhash
from pricewatch.llm.components import connected_components


def plain(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


@pytest.mark.parametrize("support", [exact_dedup.SUPPORT, 0.2])
def test_exact_decisions(spark, odd, odd_rows, support):
    rows = exact_dedup.decisions(odd, support=support).collect()
    assert len(rows) == len(odd_rows)
    groups = {}
    for r in odd_rows:
        groups.setdefault(plain(r[1]), []).append(r)
    best = {k: min(v, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0)) for k, v in groups.items()}
    by_digest = {hashlib.sha256(k.encode()).digest(): k for k in groups}
    for r in rows:
        k = by_digest[bytes(r["__digest"])]
        assert (r.keep_id, r.group_size) == (best[k][0], len(groups[k]))
    assert sum(r.kept for r in rows) == len(groups)
    stay = exact_dedup.dedup(odd, support=support)
    assert stay.columns == odd.columns and sorted(plain(r.text) for r in stay.collect()) == sorted(groups)


def test_exact_hot_group(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "case when id % 3 = 0 then 'same  text' when id % 3 = 1 then concat('t', id) else concat('u', id % 7) end as text")
    rows = exact_dedup.decisions(docs)
    assert rows.where("kept").count() == 1 + 1000 + 7
    hot = rows.where("group_size = 1000").select("keep_id").distinct().collect()
    assert [r.keep_id for r in hot] == [0]


def test_exact_empty(empty):
    assert exact_dedup.decisions(empty).count() == 0 and exact_dedup.dedup(empty).count() == 0


def print_of(text, width=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    runs = [" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(ids, prints, radius):
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    distinct = sorted(set(prints))
    for i, a in enumerate(distinct):
        for b in distinct[i + 1:]:
            if (a ^ b).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    least = {}
    for i, p in zip(ids, prints):
        if i is not None:
            r = find(p)
            least[r] = min(i, least.get(r, i))
    return [least.get(find(p)) for p in prints]


def test_simhash_odd_rows(odd, odd_rows):
    rows = simhash.near_duplicates(odd).collect()
    ids, prints = [r[0] for r in odd_rows], [print_of(r[1]) for r in odd_rows]
    want = sorted(zip([str(i) for i in ids], prints, map(str, classes(ids, prints, 2))))
    assert sorted((str(r.doc_id), r.fp & (1 << 64) - 1, str(r.component_id)) for r in rows) == want
    stay = simhash.dedup(odd, similarity=None)
    assert stay.columns == odd.columns and stay.count() == len({c if c is not None else f"n{p}" for c, p in zip(classes(ids, prints, 2), prints)})


def test_simhash_empty(empty):
    assert simhash.near_duplicates(empty).count() == 0 and simhash.dedup(empty).count() == 0


@pytest.mark.parametrize("radius, bucket", [(0, 16), (1, 2), (2, 16), (2, 1), (3, 2)])
def test_links_find_every_component(spark, radius, bucket):
    rng = random.Random(radius * 10 + bucket)
    centres = [rng.getrandbits(64) for _ in range(12)] + [0]
    prints = set(centres)
    for c in centres:
        for _ in range(25):
            x = c
            for _ in range(rng.randint(1, 5)):
                x ^= 1 << rng.randrange(64)
            prints.add(x)
    hot = rng.getrandbits(32) << 32
    prints |= {hot | rng.getrandbits(32) for _ in range(40)} | {hot | 1 << b for b in range(32)} | {hot}
    prints = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    links = simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long"), radius, bucket)
    pairs = [(r.src, r.dst) for r in links.collect()]
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= radius for a, b in pairs)
    found = {r.node: r.root for r in connected_components(spark.createDataFrame(pairs, "src long, dst long")).collect()} if pairs else {}
    masked = [p & (1 << 64) - 1 for p in prints]
    want = classes(prints, masked, radius)
    sets, expected = {}, {}
    for p, w in zip(prints, want):
        sets.setdefault(found.get(p, p), set()).add(p)
        expected.setdefault(w, set()).add(p)
    assert sorted(map(sorted, sets.values())) == sorted(map(sorted, expected.values()))


def test_links_broadcast_no_exploded_rows(spark):
    """Each fingerprint asks for 34 keys and, under crowded keys, meets at 65 points: Spark sizes these rows like the fingerprints they come from."""
    rows = spark.range(3000).select(F.xxhash64("id").alias("fp"))
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").removesuffix("b")) == 10 << 20
    links = simhash.links(rows)
    plan = links._jdf.queryExecution().executedPlan().toString()

    def built(lines):
        """The lines below each broadcast, cut off where the tree goes on beside it."""
        for i, line in enumerate(lines):
            if "BroadcastExchange" in line:
                depth = line.index("BroadcastExchange")
                below = lines[i + 1:]
                n = next((k for k, x in enumerate(below) if len(x) - len(x.lstrip(" :+-")) <= depth), len(below))
                yield below[:n]

    assert "Generate" in plan and not any("Generate" in x for below in built(plan.splitlines()) for x in below)


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + rng.randint(1, 400)) for _ in range(300)]
    edges += [(rng.randint(2000, 2300), rng.randint(2000, 2300)) for _ in range(150)] + [(5, 5)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    linked = {v for a, b in edges if a != b for v in (a, b)}
    assert got == {v: find(v) for v in linked if find(v) != v}


def shingles(text):
    w = text.split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}


def jaccard(a, b):
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)


def test_similar_copies_go_and_clean_documents_stay(spark, odd, empty):
    rng = random.Random(21)
    docs, group = [], []
    for g in range(60):
        base = prose(rng, rng.randint(60, 300))
        docs.append(base)
        group.append(g)
        for _ in range(rng.randint(0, 2)):
            words = base.split()
            for _ in range(max(1, len(words) // 60)):
                words[rng.randrange(len(words))] = "new" + str(rng.randint(0, 999))
            if jaccard(base, " ".join(words)) >= 0.82:
                docs.append(" ".join(words))
                group.append(g)
    hot = prose(rng, 200).split()
    for i in range(150):
        words = list(hot)
        words[rng.randrange(200)] = f"edit{i}"
        docs.append(" ".join(words))
        group.append(60)
    docs += [" ".join(prose(rng, 100).split()[:80] + docs[0].split()[:20]) for _ in range(10)]
    group += range(61, 71)
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    kept = [r.doc_id for r in simhash.dedup(df).collect()]
    assert sorted(group[i] for i in kept) == sorted(set(group))
    assert simhash.dedup(empty).count() == 0
    assert simhash.dedup(odd).count() <= simhash.dedup(odd, similarity=None).count()


def test_ball_keys():
    import numpy as np

    keys = simhash.ball_keys(np.array([[1, -1], [3, 0]], dtype=np.int64))
    assert keys.shape == (2, 4 * 33) and len(set(keys[0]) & set(keys[1])) >= 33


def test_similar_links_are_those_of_brute_force(spark):
    """Pairs on both sides of 0.8, in a template that fills many keys, have the components of brute force, whatever is crowded."""
    rng = random.Random(33)
    docs, template = [], prose(rng, 60)
    for _ in range(40):
        base = f"{template} {prose(rng, rng.randint(60, 240))}".split()
        docs.append(" ".join(base))
        for edits in (2, 3, 4, 5):
            words = list(base)
            for _ in range(max(1, edits * len(words) // 200)):
                words[rng.randrange(len(words))] = "new" + str(rng.randint(0, 999))
            docs.append(" ".join(words))
    sets = [set(simhash.shingle_set(t).tolist()) for t in docs]
    want = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8:
                a, b = want[i], want[j]
                want = [min(a, b) if w in (a, b) else w for w in want]
    df = spark.createDataFrame(list(enumerate(docs)), "id long, text string")
    for bucket in (2, 16):
        links = [(r.src, r.dst) for r in simhash.similar_links(df, 80, bucket).collect()]
        assert all(len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8 for a, b in links)
        found = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "src long, dst long")).collect()}
        assert [found.get(i, i) for i in range(len(docs))] == want
    kept = simhash.dedup(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want))


def test_keys_of_few_texts_need_no_blocks(spark, monkeypatch):
    """Three texts under one key, the second and third of which are alike, are compared in pairs; what a sketch rules out is not alike."""
    rng = random.Random(5)
    docs = []
    for _ in range(12):
        line = prose(rng, 12)
        base = prose(rng, 90).split()
        near = [*base[:-1], "changed"]
        docs += [f"{prose(rng, 80)} {line}", f"{line} {' '.join(base)}", f"{line} {' '.join(near)}"]
    df = spark.createDataFrame(list(enumerate(docs)), "id long, text string")
    monkeypatch.setattr(simhash, "open_links", lambda *a: pytest.fail("blocks for keys of three texts"))
    links = {tuple(sorted((r.src, r.dst))) for r in simhash.similar_links(df, 80).collect()}
    assert links == {(i + 1, i + 2) for i in range(0, 36, 3)}


def test_listed_rows_stay_out_of_python(spark):
    """Of rows that a bit map chooses, only the key goes to Python."""
    rows = spark.range(1000).select("id", F.repeat(F.lit("x"), 100).alias("text"))
    bitmap = simhash.repeated_filter(simhash._mixed(rows.where("id % 50 = 3").select("id")))
    got = simhash._listed(rows, "id", bitmap)
    assert sorted(r.id for r in got.collect()) == list(range(3, 1000, 50)) and got.columns == ["id", "text"]
    assert "MapInArrow" not in got._jdf.queryExecution().executedPlan().toString()


def test_chosen_texts_take_one_python_step(spark):
    """Texts are chosen by their ids where their sets are made: a task holds one Python process and no texts that wait between two."""
    rng = random.Random(9)
    docs = spark.createDataFrame([(i, prose(rng, 30)) for i in range(200)], "id long, text string")
    few = docs.where("id % 20 = 3").select("id")
    made = simhash.prefixes(docs, 80, simhash.repeated_filter(few, 7), chosen=simhash.repeated_filter(few, 7))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("InArrow") == 1 and "ArrowEvalPython" not in plan
    assert {r.id for r in made.collect()} == set(range(3, 200, 20))
    want = {r.id: sorted(simhash.shingle_set(r.text).view("int64").tolist()) for r in docs.collect() if r.id % 20 == 3}
    assert {r.id: sorted(r.s) for r in simhash._sets_of(docs, few).collect()} == want


@pytest.mark.parametrize("bound", [0, 100])
def test_kept_documents_need_no_broadcast(spark, bound):
    """Documents that stay are those whose keys aren't dropped, ids of null included; the many keys that stay are never broadcast."""
    docs = spark.createDataFrame([(i if i % 7 else None, f"text {i}") for i in range(60)], "doc_id long, text string")
    key = {"__id": F.col("doc_id"), "__raw": F.xxhash64("text")}
    prints = simhash.stored(docs.withColumns(key), "prints")
    kept = simhash.stored(prints.where("cast(substr(text, 6) as int) % 5 > 0").select(*key), "kept")
    got = simhash._without(docs, key, kept, prints, bound)
    assert sorted(r.text for r in got.collect()) == sorted(f"text {i}" for i in range(60) if i % 5)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert ("BroadcastHashJoin" in plan) == (bound > 0) and "kept" not in plan and "LeftAnti" in plan


def test_a_block_returns_a_forest_of_links(spark):
    """Members of a block that are all alike are connected by fewer links than members, not by all their pairs; chains stay whole."""
    rng = np.random.default_rng(4)
    for shape in ((1, 1), (7, 3), (40, 40), (60, 25)):
        linked = rng.random(shape) < 1.2 / max(shape)
        x, y = blocks._forest(linked)
        assert linked[x, y].all() and len(x) < sum(shape)

        def parts(i, j):
            of = list(range(sum(shape)))
            for _ in of:
                for a, b in zip(i, j):
                    of[a] = of[shape[0] + b] = min(of[a], of[shape[0] + b])
            return of

        assert parts(x.tolist(), y.tolist()) == parts(*(k.tolist() for k in np.nonzero(linked)))
    members = spark.range(50).selectExpr("0L as cluster", "id", "3L as n", "id as root")
    sets = spark.range(50).selectExpr("id", "array(1L, 2L, 3L) as s")
    links = [(r.src, r.dst) for r in blocks._block_links(blocks._tiles(members, 80), sets, 80).collect()]
    found = {r.node: r.root for r in connected_components(spark.createDataFrame(links, "src long, dst long")).collect()}
    assert len(links) < 100 and [found.get(i, i) for i in range(50)] == [0] * 50
