import random
import re
from collections import Counter

import pytest

from pricewatch.llm import divergence

SCHEMA = "doc_id long, lang string, source string, text string, term string, count long, value string"


def plain(rows, min_docs=3, top=200):
    """The rule by dense counts over all kept terms, in Python integers: rows are (lang, source, text)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    terms = [[re.sub("[A-Z]", lambda m: m.group().lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", r[2])] for r in rows]
    out = []
    for lang in {r[0] for r in rows}:
        own = [(r[1], t) for r, t in zip(rows, terms) if r[0] == lang]
        docs = Counter(x for _, t in own for x in set(t))
        kept = sorted(x for x, n in docs.items() if n >= min_docs)
        level = lambda c: {x: 1 + 10 ** 9 * (c[x] + 1) // (sum(c[y] for y in kept) + len(kept)) for x in kept}
        counts = {s: Counter(x for z, t in own if z == s for x in t) for s in {s for s, _ in own}}
        p, q = {s: level(c) for s, c in counts.items()}, level(Counter(x for _, t in own for x in t))
        f = lambda a, b: (a - b) ** 2 // b
        for s in counts:
            pairs = [(h, sum(f(p[s][x], p[h][x]) for x in kept)) for h in counts if h != s]
            best = [(x, f(p[s][x], q[x])) for x in kept if counts[s][x] and p[s][x] > q[x]]
            for part, found in (("pair", pairs), ("term", best)):
                found.sort(key=lambda r: (-r[1], r[0].encode()))
                out += [(lang, s, part, x, v, k + 1) for k, (x, v) in enumerate(found) if part == "pair" or k < top]
    return out


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, *r, "x", 1, "y") for i, r in enumerate(rows)], SCHEMA)
    return sorted(map(tuple, divergence.audit(df, **options).collect()))


def corpus(rng, n, sources=5, words=30):
    bag = [f"w{chr(97 + i % 26)}{'xyz'[i % 3]}{'ab' * (i % 4)}" for i in range(words)] + ["é", "日本", "Zz", "zZ"]
    return [(rng.choice(["en", "de"]), f"s{min(rng.randrange(sources), rng.randrange(sources))}",
             " ".join(rng.choice(bag[rng.randrange(len(bag)):]) for _ in range(rng.randint(0, 40)))) for _ in range(n)]


@pytest.mark.parametrize("tiles, postings, held", [(512, 200_000, 200_000), (2, 7, 5), (1, 40, 3)])
def test_equals_dense_counts(spark, monkeypatch, tiles, postings, held):
    monkeypatch.setattr(divergence, "TILE_GROUPS", tiles)
    monkeypatch.setattr(divergence, "BLOCK_POSTINGS", postings)
    monkeypatch.setattr(divergence, "HELD", held)
    monkeypatch.setattr(divergence, "CELLS", 16 if tiles < 512 else divergence.CELLS)
    rows = corpus(random.Random(tiles), 150)
    assert run(spark, rows) == sorted(plain(rows))
    assert run(spark, rows, top=3, min_docs=1) == sorted(plain(rows, 1, 3))


def test_odd_rows(spark):
    rng = random.Random(4)
    long = " ".join(f"t{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}" for _ in range(30_000))
    rows = [(None, None, None), ("", "a", "x x"), (None, "b", "x"), ("en", None, "x y"), ("en", "a", ""), ("en", "b", "123 _-"), ("en", "c", long), ("en", "d", long),
            ("en", "a", "x"), ("en", "a", "x"), ("en", "q", "X"), ("solo", "a", "x"), ("none", "a", "1"), ("none", "b", None), ("en", "c", long), ("", "c", "X[x`x{x\x00x@x")]
    assert run(spark, rows) == sorted(plain(rows))


def test_empty(spark):
    assert run(spark, []) == []


def test_counts_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    n = 4 * 10 ** 18
    got = spark.range(1).select(divergence._level(F.lit(n), F.lit(n + 5), F.lit(7))).first()[0]
    assert got == 1 + 10 ** 9 * (n + 1) // (n + 12)
