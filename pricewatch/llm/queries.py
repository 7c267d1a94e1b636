"""The operators of this subpackage bound to the given tables, with DuckDB statements where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewatch.llm import bpe, chat, compact_windows, divergence, exact_dedup, lm_score, minhash, packing, partition_index, pii, simhash, toxicity, vector_codes


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_partition_ann(spark: SparkSession, folder: str) -> DataFrame:
    return partition_index.search(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


def op2_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"))


def op3_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    rows = exact_dedup.decisions(table(spark, folder, "documents"))
    return rows.select("doc_id", "keep_id", F.col("group_size").cast("long"), "kept", F.lower(F.hex("__digest")).alias("text_sha256"))


def op5_simhash(spark: SparkSession, folder: str) -> DataFrame:
    rows = simhash.near_duplicates(table(spark, folder, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ids = bpe.encode(table(spark, folder, "documents"), path, public_tokenizers.PATTERN)
    texts = bpe.decode(ids, path, ["doc_id", "ids"])
    return texts.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    grammar = toxicity.train(docs, table(spark, folder, "labels"))
    scored = toxicity.score(docs, grammar)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_cross_entropy(spark: SparkSession, folder: str) -> DataFrame:
    return lm_score.cross_entropy_difference(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op8_pii(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.spans(table(spark, folder, "documents"))

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")

    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE))
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in pii.BASE]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op9_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    read = chat.read_back(chat.format_chats(turns.unionByName(extra), public_tokenizers.path("byte_bpe_50k.json")))
    line = F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit("\n"), t, F.lit("\n")))
    return read.select("conv_id", F.size("roles").cast("long").alias("n_turns"), F.sha2(F.array_join(line, ""), 256).alias("turns_sha256"),
                       F.char_length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
                       "formatted_chars")


def op10_compact_windows(spark: SparkSession, folder: str) -> DataFrame:
    return compact_windows.shared_passages(table(spark, folder, "documents"))


def op11_setsketch(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, folder, "documents"), width=3, percent=85)


def op12_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audit(table(spark, folder, "documents"))


def op13_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    return vector_codes.compress(table(spark, folder, "embeddings")).drop("label")


QUERIES = {
    "op1_partition_ann": op1_partition_ann,
    "op2_packing": op2_packing,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_simhash": op5_simhash,
    "op6_toxicity": op6_toxicity,
    "op7_cross_entropy": op7_cross_entropy,
    "op8_pii": op8_pii,
    "op9_chat_format": op9_chat_format,
    "op10_compact_windows": op10_compact_windows,
    "op11_setsketch": op11_setsketch,
    "op12_divergence": op12_divergence,
    "op13_vector_codes": op13_vector_codes,
}

#: Parts, entries and rounds of op13, as the operator has them by default.
_PARTS, _ENTRIES, _ROUNDS = 16, 64, 2


def _codes_sql() -> str:
    """Assignments and moved codebooks, one pair of steps for each round."""
    steps = []
    for k in range(_ROUNDS + 1):
        steps.append(f"""
        near{k} as (
          select vec_id, part, arg_min(entry, (d, entry)) as entry, min(d) as d from (
            select vec_id, part, entry, sum((x - c) * (x - c)) as d from cells join book{k} using (part, pos) group by all) group by all)""")
        if k < _ROUNDS:
            steps.append(f"""
        book{k + 1} as (
          select b.part, b.entry, b.pos, coalesce((s - ((s % n) + n) % n) // n, b.c)::bigint as c from book{k} b left join (
            select part, entry, pos, sum(x) as s, count(*) as n from cells join near{k} using (vec_id, part) group by all) m
          on m.part = b.part and m.entry = b.entry and m.pos = b.pos)""")
    last = _ROUNDS
    return f"""
        with kept as (
          select vec_id, embedding, label, len(embedding) // {_PARTS} as w from embeddings
          where len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        cells as (
          select vec_id, (i - 1) // w as part, (i - 1) % w as pos, floor(256 * embedding[i]::double)::bigint as x
          from (select *, unnest(range(1, len(embedding) + 1)) as i from kept)),
        book0 as (
          select part, entry, pos, x as c from cells
          join (select vec_id, row_number() over (order by vec_id) - 1 as entry from kept) using (vec_id) where entry < {_ENTRIES}),
        {",".join(steps)},
        coded as (
          select vec_id, string_agg(lower(lpad(to_hex(entry), 2, '0')), '' order by part) as code, sum(d)::bigint as error
          from near{last} group by 1),
        digest as (select sha256(string_agg(c::varchar, ',' order by part, entry, pos)) as codebooks_sha256 from book{last})
        select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256
        from coded join kept using (vec_id), digest"""


ORACLE = {
    "op3_exact_dedup": r"""
        with keyed as (
          select doc_id, length(coalesce(text, '')) as chars,
                 sha256(translate(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) as text_sha256
          from documents),
        best as (
          select text_sha256, count(*) as group_size, arg_min(doc_id, (-chars, doc_id)) as keep_id from keyed group by 1)
        select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from keyed join best using (text_sha256)""",
    "op12_divergence": r"""
        with d as (
          select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text from documents),
        w as (
          select r, lang, source, translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as term from (
            select r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as t from d)),
        kept as (select lang, term, count(*) as a from w group by all having count(distinct r) >= 3),
        l as (select lang, count(*) as v, sum(a) as n from kept group by all),
        c as (select lang, source, term, count(*) as c from w join kept using (lang, term) group by all),
        g as (select distinct lang, source from d),
        s as (select lang, source, sum(c) as n from c group by all),
        p as (
          select g.lang, g.source, kept.term, coalesce(c.c, 0) as c, (1 + 1000000000 * (coalesce(c.c, 0) + 1)::hugeint // (coalesce(s.n, 0) + l.v))::bigint as p
          from g join kept using (lang) join l using (lang) left join s on s.lang = g.lang and s.source = g.source
          left join c on c.lang = g.lang and c.source = g.source and c.term = kept.term),
        q as (select lang, term, (1 + 1000000000 * (a + 1)::hugeint // (n + v))::bigint as q from kept join l using (lang)),
        f as (
          select x.lang, x.source, y.source as item, sum((x.p - y.p) * (x.p - y.p) // y.p) as value
          from p x join p y using (lang, term) group by all),
        parts as (
          select x.lang, x.source, 'pair' as part, y.source as item, coalesce(f.value, 0)::bigint as value
          from g x join g y on x.lang = y.lang and x.source <> y.source
          left join f on f.lang = x.lang and f.source = x.source and f.item = y.source
          union all
          select lang, source, 'term', term, ((p - q) * (p - q) // q)::bigint from p join q using (lang, term) where c > 0 and p > q)
        select *, (row_number() over (partition by lang, source, part order by value desc, item))::int as rank from parts
        qualify part = 'pair' or rank <= 200""",
    "op13_vector_codes": _codes_sql(),
}
