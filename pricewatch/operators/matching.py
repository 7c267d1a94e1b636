"""Text rules between rows: keywords, exclusions and phrase ownership."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.money import format_money
from ..functions.text import fold_text, fold_word, match_phrase, specificity, text_or_empty


def _finder(wanted: list[str], excluded: list[str]) -> Callable[[], Callable[[str | None], int | None]]:
    """Makes, in a task, the function that gives the number of the first wanted word, in list order, that is a substring of a folded
    text, from 0; None when none is or an excluded word is one. An empty word is a substring of every text.

    All words are one automaton, which reads a text once however many words there are.
    """
    first: dict[str, int] = {}
    for i, word in enumerate(wanted):
        first.setdefault(word, i)
    barred = set(excluded)
    always = first.get("", len(wanted))

    def make():
        import ahocorasick

        machine = ahocorasick.Automaton()
        for word in {*first, *barred} - {""}:
            machine.add_word(word, (first.get(word, len(wanted)), word in barred))
        if len(machine):
            machine.make_automaton()

        def number(text: str | None) -> int | None:
            if text is None or "" in barred:
                return None
            least = always
            for _, (i, out) in machine.iter(text) if len(machine) else ():
                if out:
                    return None
                least = min(i, least)
            return least if least < len(wanted) else None

        return number

    return make


def with_keyword(messages: DataFrame, keywords: list[str], excluded: list[str] | None = None, text: str = "text", keep: str = "all") -> DataFrame:
    """Messages with `keyword`, the first keyword of the list that is a substring of the folded text; null when none is, or when an
    excluded word is one. `keep`: all messages, those with a keyword (`hits`), or those without (`others`). Works on streams.

    The text is folded once in the JVM and read once by an automaton of all words of both lists.
    """
    make = _finder([fold_word(w) for w in keywords], [fold_word(w) for w in excluded or []])
    folded = messages.withColumn("_folded", fold_text(text_or_empty(F.col(text))))
    schema = StructType([*messages.schema.fields, StructField("keyword", StringType())])

    def run(batches):
        number = make()
        for batch in batches:
            found = [number(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            named = pa.array([None if i is None else keywords[i] for i in found], type=pa.string())
            out = pa.RecordBatch.from_arrays([*batch.columns[:-1], named], names=schema.names)
            yield out if keep == "all" else out.filter(pa.array([(i is not None) == (keep == "hits") for i in found], type=pa.bool_()))

    return folded.mapInArrow(run, schema)


def match_keywords(messages: DataFrame, keywords: list[str], text: str = "text") -> DataFrame:
    """Messages that hold a keyword, with the first keyword of the list that matches. Works on streams."""
    return with_keyword(messages, keywords, [], text, "hits")


def drop_excluded(messages: DataFrame, excluded: list[str], text: str = "text") -> DataFrame:
    """Messages that hold none of the excluded words."""
    return with_keyword(messages, excluded, [], text, "others").drop("keyword")


def keyword_hits(messages: DataFrame, keywords: list[str], excluded: list[str], text: str = "text") -> DataFrame:
    """`match_keywords` and `drop_excluded` in one pass."""
    return with_keyword(messages, keywords, excluded, text, "hits")


def exclusion_reason(title: Column, price: Column, minimum: Column, terms: Column) -> Column:
    """Why an offer of a watch is ignored: a price under the minimum, else the first excluded term in its title."""
    low = fold_text(text_or_empty(title))
    hits = F.filter(terms, lambda t: F.contains(low, fold_text(t)))
    by_price = F.concat(
        F.lit("minimum fiyat filtresi: "), format_money(price, True), F.lit(" < "), format_money(minimum, True)
    )
    by_term = F.when(F.size(hits) > 0, F.concat(F.lit("hariç tut filtresi: "), F.try_element_at(hits, F.lit(1))))
    return F.when(price < minimum, by_price).otherwise(by_term)


def exclude_offers(offers: DataFrame, keep_rejected: bool = False) -> DataFrame:
    """Apply minimum_price and excluded_terms of the joined watch; optionally keep rejected rows with `reason`."""
    reason = exclusion_reason(F.col("title"), F.col("price"), F.col("minimum_price"), F.col("excluded_terms"))
    tested = offers.withColumn("reason", reason)
    return tested if keep_rejected else tested.where(F.col("reason").isNull()).drop("reason")


def title_phrases(title: Column, longest: Column) -> Column:
    """Distinct word sequences of a title, up to `longest` words."""
    words = F.split(match_phrase(title), " ")
    starts = F.sequence(F.lit(1), F.size(words))

    def from_start(i):
        lengths = F.sequence(F.lit(1), F.least(longest, F.size(words) - i + 1))
        return F.transform(lengths, lambda n: F.array_join(F.slice(words, i, n), " "))

    return F.array_distinct(F.flatten(F.transform(starts, from_start)))


#: Distinct phrases up to which they are broadcast, so that word sequences are looked up where they are made.
BROADCAST_PHRASES = 200_000


def assign_most_specific(results: DataFrame, watches: DataFrame) -> DataFrame:
    """Pairs of result and watch whose name, as a whole-word phrase, is in the title, for the most specific names.

    `results`: result_id, title. `watches`: watch_key, name. Titles are cut into word sequences and equi-joined
    with the phrases, so no pair is tested that does not match. Phrases are counted first: up to BROADCAST_PHRASES of them go to the
    tasks that cut the titles, and only sequences that are phrases leave these; more phrases are joined by a shuffle, in which
    adaptive execution splits a phrase of many titles. The winners of a result are chosen by one window over its few matches.
    """
    phrases = watches.select("watch_key", match_phrase(F.col("name")).alias("phrase"), specificity(F.col("name")).alias("spec"))
    phrases = phrases.where("phrase != ''")
    best = phrases.groupBy("phrase").agg(F.max("spec").alias("spec"))
    size = best.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size(F.split("phrase", " "))), F.lit(1)).alias("longest")).first()
    few = F.broadcast if size["n"] <= BROADCAST_PHRASES else (lambda df: df)
    grams = results.select("result_id", F.explode(title_phrases(F.col("title"), F.lit(size["longest"]))).alias("phrase"))
    found = grams.join(few(best), ["phrase"])
    top = F.max("spec").over(Window.partitionBy("result_id"))
    winners = found.withColumn("_top", top).where("spec = _top").drop("_top")
    return winners.join(phrases, ["phrase", "spec"]).withColumnRenamed("spec", "specificity")
