"""Toxicity by a weighted finite-state pattern grammar.

Words get a tag: insult, threat verb, will, target, negation, reporting verb or other. Small transducers over tags each follow one
thing: whether a negation is near, whether the clause reports speech, whether a target was named, whether a threat is being
built. Their product, composed once into a table, reads a clause word by word and emits matched clauses: plain, targeted,
negated or reported insults, and threats. An emission is weighted by the word that caused it; a document's score is a logistic
function of the sums by kind of clause.

Insults are the built-in words and what training adds: words and word beginnings that are far likelier in toxic rows. The
weights come from training as well. Training reads a sample of labelled rows (SAMPLE at most on average, by a hash of the id;
a documented bound), in three passes over the stored sample; only counts and a few sums for each row reach the driver.

Rules: null text is empty and gets the score of a text without a match; labels that are null don't train, and a document with
different labels counts as toxic. Without any toxic or clean label the built-in words and weights are used.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricewatch.llm.shared import map_texts, slices, stored, text_column

SAMPLE = 20_000
#: Lengths of word beginnings that are tried; entries of the lexicon at most, the strongest first.
PREFIXES, ENTRIES = range(4, 9), 4096
#: Words whose tags a reader remembers at most.
KNOWN = 100_000
TRIM = ".,;:!?\"'()[]{}«»¡¿…"
CLAUSE_END = ".;:!?"

OTHER, NEGATION, REPORT, TARGET, WILL, VERB, INSULT = range(7)
PLAIN, TARGETED, NEGATED, REPORTED, THREAT = range(5)
KINDS = 5

# The built-in words of the grammar.
WORDS = {
    INSULT: "idiot idiots moron morons scum trash loser losers stupid pathetic worthless disgusting clown clowns dumb fool "
            "imbécile crétin abruti idiota imbécil estúpido basura escoria dummkopf abschaum versager",
    VERB: "kill hurt destroy stab shoot burn beat tuer matar töten",
    WILL: "will gonna shall ll going",
    TARGET: "you your youre he she they them him her tu vous te tú usted ustedes du ihr sie",
    NEGATION: "not never isn't aren't wasn't don't no nicht kein keine ne pas nunca jamais",
    REPORT: "said says wrote writes claimed claims called calls quoted reported dit dijo sagte",
}


def _negation(state: int, tag: int) -> int:
    """Words since a negation, 3: none near."""
    return 0 if tag == NEGATION else min(3, state + 1)


def _report(state: int, tag: int) -> int:
    return 1 if tag == REPORT else state


def _target(state: int, tag: int) -> int:
    """Words since a target, 4: none near."""
    return 0 if tag == TARGET else min(4, state + 1)


def _threat(state: int, tag: int) -> int:
    """0 nothing, 1 after will, 2 will and a verb of violence, 3 and a target: a threat."""
    return {(0, WILL): 1, (1, WILL): 1, (1, VERB): 2, (2, TARGET): 3}.get((state, tag), 0 if state == 3 else 2 if state == 2 else state)


def compose() -> tuple[np.ndarray, np.ndarray, int]:
    """The product of the transducers over tags: next state and emitted kind (-1: none) by state and tag, and the start."""
    states = list(product(range(4), range(2), range(5), range(4)))
    number = {s: i for i, s in enumerate(states)}
    step, emit = np.zeros((len(states), 7), dtype=np.int64), np.full((len(states), 7), -1, dtype=np.int64)
    for s, i in number.items():
        for tag in range(7):
            after = (_negation(s[0], tag), _report(s[1], tag), _target(s[2], tag), _threat(s[3], tag))
            step[i, tag] = number[after]
            if tag == INSULT:
                emit[i, tag] = NEGATED if after[0] < 3 else REPORTED if after[1] else TARGETED if after[2] < 4 else PLAIN
            elif after[3] == 3:
                emit[i, tag] = NEGATED if after[0] < 3 else REPORTED if after[1] else THREAT
    return step, emit, number[(3, 0, 4, 0)]


@dataclass
class Grammar:
    """Weights of insults (whole words, and word beginnings), and the logistic function over sums by kind of clause."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    weights: list[float] = field(default_factory=lambda: [2.0, 2.5, 0.6, 0.6, 3.0])
    bias: float = -3.0


class Reader:
    """Runs the composed machine over texts, with a bounded memory of words."""

    def __init__(self, grammar: Grammar):
        self.grammar = grammar
        step, emit, self.start = compose()
        self.step, self.emit = step.tolist(), emit.tolist()
        self.tags = {w: t for t, text in WORDS.items() for w in text.split() if t != INSULT}
        self.insults = dict.fromkeys(WORDS[INSULT].split(), 1.0) | grammar.words
        self.known: dict[str, tuple[int, float, bool]] = {}

    def tag(self, word: str) -> tuple[int, float, bool]:
        """(tag, weight, whether the clause ends here) of a word in lower case."""
        bare = word.strip(TRIM)
        ends = word[-1] in CLAUSE_END or len(word) > 1 and word[-1] in TRIM and word[-2] in CLAUSE_END
        weight = self.insults.get(bare)
        if weight is None and self.grammar.stems:
            for n in PREFIXES:
                if n > len(bare):
                    break
                if (weight := self.grammar.stems.get(bare[:n])) is not None:
                    break
        return (INSULT, weight, ends) if weight is not None else (self.tags.get(bare, OTHER), 0.0, ends)

    def sums(self, text: str) -> list[float]:
        """Weights of the emissions of each kind, summed over all clauses."""
        known = self.known
        if len(known) > KNOWN:
            known.clear()
        words = text.lower().split()
        total = [0.0] * KINDS
        missing = [w for w in set(words) if w not in known]
        for w in missing:
            known[w] = self.tag(w)
        tagged = [known[w] for w in words]
        if not any(t[0] >= VERB for t in tagged):
            return total
        step, emit, state = self.step, self.emit, self.start
        for tag, weight, ends in tagged:
            kind = emit[state][tag]
            if kind >= 0:
                total[kind] += weight or 1.0
            state = self.start if ends else step[state][tag]
        return total

    def score(self, text: str) -> float:
        return logistic(features(np.array([self.sums(text)])) @ np.array(self.grammar.weights) + self.grammar.bias)[0]


def features(sums: np.ndarray) -> np.ndarray:
    return np.log1p(sums)


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def parts_of(text: str) -> set[str]:
    """What a row has for the lexicon: its words, marked by an end sign, and their beginnings."""
    out = set()
    for w in set(text.lower().split()):
        bare = w.strip(TRIM)
        if len(bare) >= 3:
            out.add(bare + "$")
            out.update(bare[:n] for n in PREFIXES if n <= len(bare))
    return out


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept out of training; one without an id is not, and it has no label either."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _counted(rows: DataFrame, wanted: set[str] | None) -> DataFrame:
    """part, n: in how many of the rows a part (of the wanted ones) is; counted in tasks first."""
    shared = rows.sparkSession.sparkContext.broadcast(wanted) if wanted is not None else None

    def run(batches):
        counts: Counter[str] = Counter()
        for batch in batches:
            for part in slices(batch):
                for text in part.column(0).to_pylist():
                    found = parts_of(text or "")
                    counts.update(found if shared is None else found & shared.value)
        names = list(counts)
        for at in range(0, len(names), 50_000):
            some = names[at:at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([counts[n] for n in some], type=pa.int64())], names=["part", "n"])

    return rows.select("text").mapInArrow(run, "part string, n long").groupBy("part").agg(F.sum("n").alias("n"))


def lexicon(toxic: dict[str, int], clean: dict[str, int], n_toxic: int, n_clean: int) -> tuple[dict[str, float], dict[str, float]]:
    """Words and beginnings whose share of toxic rows speaks for toxicity beyond doubt, weighted by log odds.

    A part stays if the chance that as many of its rows are toxic by luck, times the number of parts, is below 1 in 100 and
    its log odds are 2 or more. A word that a chosen beginning covers is left out, and so is a longer beginning.
    """
    base = n_toxic / (n_toxic + n_clean)
    prior = np.log(base / (1 - base))
    chosen: dict[str, float] = {}
    for part, k in toxic.items():
        c = clean.get(part, 0)
        odds = np.log((k + 0.5) / (c + 0.5)) - prior
        share = k / (k + c)
        surprise = (k + c) * (share * np.log(share / base) + ((1 - share) * np.log((1 - share) / (1 - base)) if c else 0.0))
        if share > base and odds >= 2 and surprise > np.log(100 * len(toxic)):
            chosen[part] = float(odds)
    chosen = dict(sorted(chosen.items(), key=lambda x: (-x[1], x[0]))[:ENTRIES])
    words, stems = {}, {}
    for part in sorted(chosen, key=len):
        bare = part.rstrip("$")
        if any(bare[:n] in stems for n in PREFIXES if n < len(bare) + part.endswith("$")):
            continue
        (words if part.endswith("$") else stems)[bare] = chosen[part] / 2
    return words, stems


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 50) -> tuple[list[float], float]:
    """Logistic regression with a ridge, by Newton's method; weights are kept at 0 or above."""
    a = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = logistic(a @ w)
        g = a.T @ (p - y) + ridge * np.append(w[:-1], 0)
        h = (a * (p * (1 - p))[:, None]).T @ a + np.diag([ridge] * (len(w) - 1) + [1e-6])
        new = w - np.linalg.solve(h, g)
        new[:-1] = np.maximum(new[:-1], 0)
        if np.abs(new - w).max() < 1e-7:
            w = new
            break
        w = new
    return w[:-1].tolist(), float(w[-1])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Grammar:
    """A grammar learned from labelled rows that aren't held out."""
    marks = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    marks = marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = min(1.0, sample / max(1, marks.count()))
    marks = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    rows = stored(docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
                  .join(F.broadcast(marks), "doc_id").repartition(16), "labelled")
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        return Grammar()
    seen = {r["part"]: r["n"] for r in _counted(rows.where("toxic = 1"), None).where("n >= 3").collect()}
    clean = {r["part"]: r["n"] for r in _counted(rows.where("toxic = 0"), set(seen)).collect()}
    words, stems = lexicon(seen, clean, n_toxic, n_clean)
    grammar = Grammar(words, stems)
    summed = _sums(rows, grammar, ["toxic"]).select("toxic", "sums").toPandas()
    x, y = features(np.array(summed["sums"].tolist())), summed["toxic"].to_numpy(dtype=float)
    grammar.weights, grammar.bias = fit(x, y)
    return grammar


def _sums(rows: DataFrame, grammar: Grammar, keep: list[str]) -> DataFrame:
    def make():
        reader = Reader(grammar)
        return lambda texts: [pa.array([reader.sums(t) for t in texts], type=pa.list_(pa.float64()))]

    return map_texts(rows, keep, "text", [("sums", "array<double>")], make)


def score(docs: DataFrame, grammar: Grammar, keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """The columns in `keep` (doc_id by default) and the score."""

    def make():
        reader = Reader(grammar)
        return lambda texts: [pa.array([float(reader.score(t)) for t in texts], type=pa.float64())]

    return map_texts(docs, keep or ["doc_id"], "text", [(name, "double")], make)


def clean_only(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows that aren't toxic, with all their columns."""
    grammar = train(docs, labels)

    def make():
        reader = Reader(grammar)
        return lambda texts: pa.array([float(reader.score(t)) for t in texts], type=pa.float64())

    return docs.where(text_column(docs["text"], "double", make) < threshold)


def crc_mod5(doc_id: int) -> int:
    """held_out() in Python, for tests."""
    return zlib.crc32(str(doc_id).encode()) % 5
