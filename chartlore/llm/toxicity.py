"""Toxicity by a weighted finite-state pattern grammar.

Five letter-to-letter transducers read the words of a clause as symbols and are
composed into one machine: insults, threats, targets, negation and reported
speech. Its output tells plain, aimed, negated and reported insults and threats
apart; clauses are scored, not words on their own.

The insult lexicon is a short seed list plus forms learned from labelled rows:
whole words and word beginnings found in toxic documents far more often than in
clean ones, weighted by a cautious log ratio. Weights of the five clause kinds
come from a logistic regression on the same rows. Both are fitted on at most
`SAMPLE_TOXIC` and `SAMPLE_CLEAN` labelled rows, chosen by hash, and never on
rows held out.

Null and empty texts have no clauses and get the score of a text without
matches. Only labels train; language, source and id never enter a score. Repeated
rows are scored alike. Labels that are null or missing are left out.
"""
from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartlore.llm.common import bounded_rows, ship_package
from chartlore.llm.fitting import fit_logistic, probability
from chartlore.session import staged

SAMPLE_TOXIC = 4_000
SAMPLE_CLEAN = 8_000
MAX_FORMS = 5_000
BEGINNINGS = (4, 5, 6)
CUT = 0.7
KINDS = ("plain", "aimed", "negated", "reported", "threat")
N_COUNTS = len(KINDS) + 2

SEED_INSULTS = "idiot moron stupid loser scum trash worthless pathetic disgusting clown dumb imbecile".split()
THREATS = "kill hurt destroy beat crush smash burn stab shoot hunt".split()
MODALS = "will gonna shall going must werde wird vais voy".split()
TARGETS = "you your yours u he she they them du dich ihr sie tu toi vous tú usted".split()
NEGATIONS = "not never isn't aren't wasn't don't nicht kein keine pas jamais nunca".split()
REPORTS = "said says say called calls reported quoted claims claimed wrote sagte dit dijo".split()
#: Symbols: insult, threat, modal, target, negation, report, anything else; then
#: the machine's own output: aimed, negated, reported insult, carried-out threat.
ALPHABET = "ITWYNR."
OUTPUT_KIND = {"I": "plain", "A": "aimed", "M": "negated", "Q": "reported", "H": "threat"}


@dataclass
class Transducer:
    """A letter-to-letter machine: arcs[state, symbol] = (state, symbol). Symbols
    without an arc pass unchanged; `rest` is the state they lead to."""

    arcs: dict = field(default_factory=dict)
    rest: dict = field(default_factory=dict)
    start: object = 0

    def step(self, state, symbol):
        return self.arcs.get((state, symbol)) or (self.rest.get(state, self.start), symbol)


def window_machine(opens: str, changes: str, into: str, reach: int) -> Transducer:
    """After a symbol of `opens`, a `changes` within `reach` symbols becomes `into`."""
    m = Transducer()
    for left in range(reach + 1):
        for symbol in opens:
            m.arcs[left, symbol] = (reach, symbol)
        m.rest[left] = max(0, left - 1)
        if left:
            m.arcs[left, changes] = (left - 1, into)
    return m


def lasting_machine(opens: str, changes: str, into: str) -> Transducer:
    """After a symbol of `opens`, every later `changes` of the clause becomes `into`."""
    return Transducer({(0, opens): (1, opens), (1, changes): (1, into)}, {0: 0, 1: 1})


def compose(first: Transducer, second: Transducer, symbols: str) -> Transducer:
    """The machine that feeds first's output to second, its reachable states
    spelled out."""
    out, todo = Transducer(start=(first.start, second.start)), [(first.start, second.start)]
    seen = set(todo)
    while todo:
        state = todo.pop()
        for symbol in symbols:
            a, middle = first.step(state[0], symbol)
            b, end = second.step(state[1], middle)
            out.arcs[state, symbol] = ((a, b), end)
            if (a, b) not in seen:
                seen.add((a, b))
                todo.append((a, b))
    return out


def grammar() -> Transducer:
    machine = window_machine("N", "I", "M", 3)
    for other in (lasting_machine("R", "I", "Q"), window_machine("W", "T", "H", 3), window_machine("Y", "I", "A", 4)):
        machine = compose(machine, other, ALPHABET)
    return machine


_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)*")
_CLAUSE_END = ".!?;:\n"


class Scorer:
    """Clause counts of texts for one lexicon: whole words and beginnings."""

    def __init__(self, words: dict[str, float], begins: dict[str, float]):
        self.machine = grammar()
        self.words, self.begins = words, begins
        self.symbol = {w: s for s, group in (("R", REPORTS), ("N", NEGATIONS), ("Y", TARGETS), ("W", MODALS), ("T", THREATS))
                       for w in group}
        self.lengths = sorted({len(b) for b in begins}, reverse=True)
        self.automaton = ahocorasick.Automaton()
        for form in {*words, *begins, *THREATS}:
            self.automaton.add_word(form, len(form))
        self.automaton.make_automaton()

    def insult(self, word: str) -> float:
        weight = self.words.get(word, 0.0)
        for n in self.lengths:
            if len(word) > n:
                weight = max(weight, self.begins.get(word[:n], 0.0))
        return weight

    def counts(self, text: str | None) -> list[float]:
        """Log weight of the matches of each kind, then the strongest match."""
        text = (text or "").lower()
        total, done, top = dict.fromkeys(KINDS, 0.0), 0, 0.0
        for end, size in self.automaton.iter(text):
            start = end - size + 1
            if start < done or start and text[start - 1].isalpha():
                continue
            a = max(text.rfind(c, 0, start) for c in _CLAUSE_END) + 1
            b = min((p for p in (text.find(c, end) for c in _CLAUSE_END) if p >= 0), default=len(text))
            done = b
            top = max(top, self._clause(text[a:b], total))
        return [*(math.log1p(total[k]) for k in KINDS), top, top * top / 8]

    def _clause(self, clause: str, total: dict[str, float]) -> float:
        state, top = self.machine.start, 0.0
        for word in _WORD.findall(clause):
            weight = self.insult(word)
            symbol = "I" if weight else self.symbol.get(word, ".")
            state, out = self.machine.step(state, symbol)
            kind = OUTPUT_KIND.get(out)
            if kind:
                total[kind] += weight or 1.0
                top = max(top, weight or 1.0)
        return top


_SCORERS: dict[int, Scorer] = {}


def _scorer(lexicon: tuple[tuple[str, bool, float], ...]) -> Scorer:
    key = hash(lexicon)
    if key not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[key] = Scorer({f: w for f, whole, w in lexicon if whole}, {f: w for f, whole, w in lexicon if not whole})
    return _SCORERS[key]


def clause_counts(text: Column, lexicon: tuple[tuple[str, bool, float], ...]) -> Column:
    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = _scorer(lexicon)
        for texts in batches:
            yield pd.Series([scorer.counts(t) for t in texts], dtype=object)

    return run(text)


def held_out(key: Column) -> Column:
    """Rows that no label may be learned from."""
    return F.coalesce(F.crc32(key.cast("string")) % 3 == 1, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, key: str, text: str, toxic_bound: int, clean_bound: int) -> DataFrame:
    """Labelled rows outside the held-out part, as (key, text, toxic): all of
    them, or about the bound of each class, chosen by the key's hash."""
    known = labels.select(F.col(key), F.col("toxic").cast("int").alias("toxic")).where(
        F.col(key).isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col(key)))
    known = known.groupBy(key).agg(F.max("toxic").alias("toxic"))
    chosen = bounded_rows(known.where("toxic = 1"), key, toxic_bound, 3).union(
        bounded_rows(known.where("toxic = 0"), key, clean_bound, 3))
    rows = docs.select(key, F.col(text).alias("text")).where(F.col(text).isNotNull()).join(F.broadcast(chosen), key)
    rows = staged(rows, "labelled-texts")
    # Copies of one toxic text would make all its rare words look toxic: of rows
    # that share their least sentence hash, the least key stays.
    rows = rows.withColumn("_copy", least_sentence(F.col("text")))
    first = rows.groupBy("_copy", "toxic").agg(F.min(key).alias(key)).select(key)
    return rows.drop("_copy").join(first, key)


def least_sentence(text: Column) -> Column:
    """The least hash of the sentences of 20 characters or more, or of the text."""
    parts = F.filter(F.split(text, r"[.!?\n]"), lambda s: F.length(s) >= 20)
    return F.coalesce(F.array_min(F.transform(parts, lambda s: F.xxhash64(F.trim(s)))), F.xxhash64(text))


def learn_forms(sample: DataFrame) -> list[tuple[str, bool, float]]:
    """(form, whole word?, weight) of the forms that mark toxic documents.

    A form counts if chance would hardly put so many toxic documents behind it:
    among a million forms, fewer than one in twenty is expected by luck."""
    sizes = sample.groupBy("toxic").count().collect()
    toxic = sum(r["count"] for r in sizes if r.toxic == 1)
    clean = sum(r["count"] for r in sizes if r.toxic == 0)
    if not toxic or not clean:
        return []
    least = max(4, math.ceil(math.log(2e7) / -math.log(toxic / (toxic + clean))))
    # Strings, as their duplicates are found by hash: "=" whole words, "^" beginnings.
    def beginnings(words: Column) -> list[Column]:
        return [F.transform(F.filter(words, lambda w: F.length(w) > n), lambda w: F.concat(F.lit("^"), F.substring(w, 1, n)))
                for n in BEGINNINGS]

    words = F.filter(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+")), lambda w: F.length(w).between(3, 40))
    forms = sample.select("toxic", words.alias("words")).select("toxic", F.explode(F.array_distinct(F.concat(
        F.transform("words", lambda w: F.concat(F.lit("="), w)), *beginnings(F.col("words"))))).alias("f"))
    counted = forms.groupBy("f").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")).select(
        F.startswith("f", F.lit("=")).alias("whole"), F.substr("f", F.lit(2)).alias("form"), "t", "c")
    ratio = (F.log((F.col("t") - 2 * F.sqrt("t") + 0.5) / (toxic + 1)) - F.log((F.col("c") + 0.5) / (clean + 1)))
    rows = counted.where(F.col("t") >= least).withColumn("w", ratio).where("w >= 2").orderBy(
        F.desc("w"), "form", "whole").limit(MAX_FORMS).collect()
    return [(r.form, r.whole, float(r.w)) for r in rows]


@dataclass(frozen=True)
class ToxicityModel:
    lexicon: tuple[tuple[str, bool, float], ...]
    weights: np.ndarray


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
          toxic_bound: int = SAMPLE_TOXIC, clean_bound: int = SAMPLE_CLEAN) -> ToxicityModel:
    ship_package(docs.sparkSession)
    sample = labelled_sample(docs, labels, key, text, toxic_bound, clean_bound).withColumnRenamed(key, "doc_id")
    learned = learn_forms(sample)
    known = {f for f, whole, _ in learned if whole}
    lexicon = tuple(sorted([*learned, *((w, True, 2.0) for w in SEED_INSULTS if w not in known)]))
    rows = sample.select("toxic", clause_counts(F.col("text"), lexicon).alias("x")).collect()
    x = np.array([r.x for r in rows], float).reshape(len(rows), N_COUNTS)
    y = np.array([r.toxic for r in rows], float)
    if len(y) == 0 or y.min() == y.max():  # nothing to learn from: every kind counts
        return ToxicityModel(lexicon, np.array([3.0] * len(KINDS) + [0.0, 0.0, -3.0]))
    return ToxicityModel(lexicon, fit_logistic(x, y, shrink=0.1))


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text", out: str = "score") -> DataFrame:
    """`docs` with the probability of a toxic label; `out` must be a new name."""
    ship_package(docs.sparkSession)
    lexicon, weights = model.lexicon, model.weights

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = _scorer(lexicon)
        for texts in batches:
            x = np.array([scorer.counts(t) for t in texts], float).reshape(len(texts), N_COUNTS)
            yield pd.Series(probability(x, weights))

    return docs.withColumn(out, run(F.col(text)))


def toxicity_report(docs: DataFrame, labels: DataFrame, key: str = "doc_id", cut: float = CUT) -> DataFrame:
    model = train(docs, labels, key)
    scored = score_toxicity(docs.select(key, "text"), model)
    return scored.select(key, held_out(F.col(key)).alias("held_out"), "score",
                         (F.col("score") >= cut).cast("int").alias("predicted"))
