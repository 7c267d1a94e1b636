import random
import re

from conftest import prose
from pyspark.sql import functions as F

from pricewatch.llm import lm_score, pii, toxicity

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": kind == "ip" and all(len(x.lstrip("0")) < 4 and int(x.lstrip("0") or 0) <= 255 for x in m.group().split(".")),
                  "card": 12 <= len(digits) <= 19 and pii.luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], pii.BASE.index(s[2])))


def test_base_kinds_equal_patterns():
    anchors, rng = pii.automaton(), random.Random(4)
    for _ in range(30_000):
        t = "".join(rng.choice("a@.1234567890+ -()%٣é") for _ in range(rng.randint(0, 60)))
        assert [s for s in pii.find(t, anchors) if s[2] in pii.BASE] == plain_spans(t)
    t = "4111 1111 1111 1111, 000.1.02.0003 " + "1" * 5000 + ".1.1.1"
    assert [s for s in pii.find(t, anchors) if s[2] in pii.BASE] == plain_spans(t)


def test_added_kinds():
    anchors = pii.automaton()
    t = "See https://a.example.org/x?y=1. IBAN: DE89 3704 0044 0532 0130 00 (DE89370400440532013001), account no. AB-123456, account for 3 years"
    assert [(t[a:b], k) for a, b, k in pii.find(t, anchors)] == [
        ("https://a.example.org/x?y=1", "url"), ("DE89 3704 0044 0532 0130 00", "iban"), ("AB-123456", "account")]


def test_pii_tables(odd, odd_rows, empty):
    rows = pii.spans(odd, ["row"]).collect()
    assert sorted((r.row, len(r.spans)) for r in rows) == sorted((k, 2 if r[1] and "@" in r[1] else 0) for r in odd_rows for k in [r[5]])
    masked = {r.row: r for r in pii.redacted(odd).collect()}
    assert masked[12].text == "<EMAIL> <PHONE>" and masked[12].n_chars == 15 and masked[0].text is None and masked[7].text == odd_rows[7][1]
    assert pii.redacted(odd).columns == odd.columns and pii.redacted(empty).count() == 0


def test_grammar_reads_clauses():
    reader = toxicity.Reader(toxicity.Grammar())
    at = {"you are an idiot.": toxicity.TARGETED, "what an idiot": toxicity.PLAIN, "not an idiot": toxicity.NEGATED,
          "he said idiot": toxicity.REPORTED, "I will kill you": toxicity.THREAT, "i will never kill you": toxicity.NEGATED}
    for text, kind in at.items():
        sums = reader.sums(text)
        assert sums[kind] > 0 and sum(sums) == sums[kind], text
    assert reader.sums("not. idiot")[toxicity.PLAIN] == 1 and not any(reader.sums("all is well, kill time"))


def labelled(rng, n):
    docs, labels = [], []
    for i in range(n):
        words = prose(rng, rng.randint(5, 60)).split()
        bad = i % 6 == 0
        if bad:
            for _ in range(3):
                words.insert(rng.randrange(len(words) + 1), rng.choice(["scum", f"zorbl{rng.choice('abcdefgh')}{rng.choice('xyz')}"]))
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    return docs, labels


def test_toxicity_held_out(spark, rng, odd, odd_rows, empty):
    docs, labels = labelled(rng, 1500)
    d, y = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    grammar = toxicity.train(d, y)
    assert any(s.startswith("zorb") for s in grammar.stems)
    rows = {r.doc_id: r.score for r in toxicity.score(d, grammar).collect()}
    held = [(rows[i] >= 0.5) == bool(t) for i, _, t in labels if toxicity.crc_mod5(i) == 0]
    assert len(held) > 200 and sum(held) / len(held) > 0.97
    assert d.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("h")).where(F.col("h")).count() == len(held)
    scored = toxicity.score(odd, grammar, ["row"]).collect()
    assert len(scored) == len(odd_rows) and all(0 <= r.score < 0.5 for r in scored)
    assert toxicity.score(empty, grammar).count() == 0
    stay = toxicity.clean_only(odd, y)
    assert stay.columns == odd.columns and stay.count() == len(odd_rows)
    assert toxicity.train(empty, y).bias == toxicity.Grammar().bias
    nulls = spark.createDataFrame([(None, 1, 1), (1, None, None)], "doc_id long, quality int, toxic int")
    assert toxicity.train(d, nulls).stems == {}


def test_toxic_filter_sends_only_the_text_to_python(spark, odd):
    """Whole rows went to Python and back, each text twice, which took an executor's memory on large tables."""
    plan = toxicity.clean_only(odd, spark.createDataFrame([], "doc_id long, toxic int"))._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "MapInArrow" not in plan


def test_reader_remembers_a_bounded_number_of_words():
    reader = toxicity.Reader(toxicity.Grammar())
    for i in range(30):
        reader.sums(" ".join(f"w{i * 10_000 + k}" for k in range(10_000)))
    assert len(reader.known) <= toxicity.KNOWN + 10_000
    assert reader.sums("you idiot")[toxicity.TARGETED] > 0


def test_lm_score(spark, rng, odd, odd_rows, empty):
    docs = [(i, prose(rng, 60) if i % 2 else "zq " * 40 + prose(rng, 5)) for i in range(300)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    y = spark.createDataFrame([(i, i % 2, 0) for i in range(150)], "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r.score for r in lm_score.cross_entropy_difference(d, y).collect()}
    assert len(rows) == 300 and min(rows[i] for i in range(1, 300, 2)) > max(rows[i] for i in range(0, 300, 2))
    counts = lm_score.counts(d.withColumn("target", F.col("doc_id") < 10)).groupBy("table").agg(F.sum("background"), F.sum("target")).collect()
    total, target = sum(len(t) for _, t in docs), sum(len(t) for i, t in docs if i < 10)
    assert sorted(map(tuple, counts)) == [(k, total, target) for k in range(3)]
    scores = lm_score.cross_entropy_difference(odd, y).collect()
    assert len(scores) == len(odd_rows) and all(r.score == r.score for r in scores)
    assert lm_score.cross_entropy_difference(empty, y).count() == 0


def test_lm_equals_plain_count(rng):
    """Against dictionaries of n-grams without hashing (no collision among so few)."""
    import numpy as np

    from collections import Counter
    from math import log

    texts = [prose(rng, 30) for _ in range(4)]
    long, context, pair, single = ([Counter(), Counter()] for _ in range(4))
    table = []
    for which in (0, 1):
        for t in texts if which == 0 else texts[:2]:
            s = b"\0\0\0" + t.encode()
            for i in range(3, len(s)):
                long[which][s[i - 3:i + 1]] += 1
                context[which][s[i - 3:i]] += 1
                pair[which][s[i - 1:i + 1]] += 1
                single[which][s[i]] += 1
    arrays = [np.concatenate([lm_score.cells(lm_score.symbols(t))[k] for t in texts]) for k in range(3)]
    targets = [np.concatenate([lm_score.cells(lm_score.symbols(t))[k] for t in texts[:2]]) for k in range(3)]
    for k in range(3):
        for c in np.unique(arrays[k]):
            table.append((k, int(c), int((arrays[k] == c).sum()), int((targets[k] == c).sum())))
    model = lm_score.Model(*map(np.array, zip(*table)))
    for j, t in enumerate(texts):
        s, total = b"\0\0\0" + t.encode(), 0.0
        own_long, own_context = Counter(s[i - 3:i + 1] for i in range(3, len(s))), Counter(s[i - 3:i] for i in range(3, len(s)))
        for i in range(3, len(s)):
            loss = []
            for which in (0, 1):
                own = which == 0 or j < 2
                n = long[which][s[i - 3:i + 1]] - (own_long[s[i - 3:i + 1]] if own else 0)
                c = context[which][s[i - 3:i]] - (own_context[s[i - 3:i]] if own else 0)
                p1 = (single[which][s[i]] + 1) / (sum(single[which].values()) + 256)
                before = sum(v for k, v in pair[which].items() if k[0] == s[i - 1])
                p2 = (pair[which][s[i - 1:i + 1]] + lm_score.MU * p1) / (before + lm_score.MU)
                loss.append(log(c + lm_score.MU) - log(n + lm_score.MU * p2))
            total += loss[0] - loss[1]
        assert abs(model.difference(t, j < 2) - total / (len(s) - 3)) < 2e-3
