import inspect

import corpus_pipeline
from pyspark.sql import functions as F

from pricewatch.llm import exact_dedup, pii, simhash

SF = "/root/testdata/sf0.001"


def test_stages_chain(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before, names = docs, [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "simhash_dedup", "pii", "packing"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        assert list(inspect.signature(stage).parameters) == ["spark", "docs", "sf_dir"]
        after = stage(spark, before, SF).cache()
        if name != "packing":
            assert after.columns == docs.columns
            kept[name] = after
        before = after
    assert kept["toxicity"].count() <= docs.count()
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    assert ids(kept["exact_dedup"]) == ids(exact_dedup.decisions(kept["toxicity"]).where("kept"))
    classes = {r.doc_id: r.component_id for r in simhash.near_duplicates(kept["exact_dedup"]).collect()}
    stay = ids(kept["simhash_dedup"])
    assert len({classes[i] for i in stay}) == len(stay) and set(stay) <= set(ids(kept["exact_dedup"]))
    texts = {r.doc_id: r.text.split() for r in kept["exact_dedup"].collect()}
    sets = {i: {tuple(w[k:k + 5]) for k in range(len(w) - 4)} for i, w in texts.items()}
    alike = lambda a, b: len(sets[a] & sets[b]) / max(1, len(sets[a] | sets[b]))
    assert all(alike(a, b) < 0.9 for a in stay for b in stay if a < b)
    assert all(any(alike(a, b) > 0.5 or classes[a] == classes[b] for b in texts if b != a) for a in texts if a not in stay)
    assert ids(kept["pii"]) == ids(kept["simhash_dedup"])
    left = pii.spans(kept["pii"]).where(F.exists("spans", lambda s: s["kind"] == "email")).count()
    assert left == 0
    run = corpus_pipeline.run(spark, SF)
    assert ids(run) == ids(kept["pii"]) and corpus_pipeline.ORACLE_SQL is None


def test_stages_take_odd_rows(spark, odd, empty):
    for docs in (odd, empty):
        now = docs
        for _, stage in corpus_pipeline.STAGES:
            now = stage(spark, now, SF)
        assert now.count() <= docs.count()
