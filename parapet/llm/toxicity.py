"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words become symbols: insult, threat, target, negation, reported speech, comma,
other. Three transducers, composed, read the symbols of a clause:

* negation rewrites an insult or threat that follows a negation closely,
* reported speech rewrites those that a speech verb governs,
* target notes whether the clause is aimed at someone.

What they leave is the pattern of the clause: a plain or aimed insult, an aimed
threat, a negated or a reported one. Documents are scored by their clauses.

Insults are stems with weights, learned from labelled documents: a stem's
occurrences are counted once per pair of neighbouring words, so that copies of one
passage don't make their rare words look like insults. Stems whose share of toxic
contexts could be chance are not used. The weights of the patterns are a small
logistic regression, drawn to fixed prior weights.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, crc_remainder, in_slices, table

#: Labelled rows of each class to learn from: those with the smallest hash of their id.
TOXIC_SAMPLE, CLEAN_SAMPLE = 5_000, 15_000
#: Log-likelihood ratio of a stem's contexts that chance won't give.
SIGNIFICANT = 27.0
#: Least log-odds of an insult stem.
MIN_WEIGHT = 2.0
PREFIXES = (4, 5, 6, 7)

#: Log-odds of a stem whose single use says all; weaker stems count by the square of their share of it.
STRONG = 8.0
#: Insults known beforehand, as strong as that.
SEEDS = ("idiot", "moron", "scum", "worthless", "pathetic", "stupid", "loser", "disgusting", "dumbass", "trottel", "abschaum", "dummkopf", "crétin", "imbécile", "ordure", "estúpido", "imbécil", "escoria")
#: Word classes in English, German, French and Spanish.
THREATS = frozenset("kill killing hurt hurting beat strangle stab shoot burn destroy töten umbringen schlagen verbrennen tuer frapper brûler matar golpear quemar".split())
TARGETS = frozenset("you your yours yourself u ya he she him her they them these those this that everyone people du dich dir dein deine ihr euch sie diese dieser tu te toi vous votre ton ta ils elles ce cette tú ti usted ustedes ellos ellas este esta ese esa".split())
NEGATIONS = frozenset("not no never neither nor isn't aren't wasn't weren't don't doesn't didn't nobody nicht kein keine keinen nie niemals pas jamais aucun non ni ningún ninguna nunca jamás".split())
REPORTING = frozenset("said says say saying told claimed claims wrote called reported quoted alleged sagte sagt behauptete schrieb berichtete zitierte dit disait raconte déclara écrivit dijo dice contó escribió afirmó".split())

PATTERNS = ("insult", "aimed_insult", "threat", "aimed_threat", "negated", "reported")
#: Log-odds that a clause of each pattern adds where nothing was learned, and the bias.
PRIOR = {"insult": 4.0, "aimed_insult": 5.0, "threat": 0.3, "aimed_threat": 3.5, "negated": 1.5, "reported": 1.5}
PRIOR_BIAS = -3.5

_TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|,")
_BREAKS = ".!?;:\n"
_BREAK = re.compile(f"[{_BREAKS}]")


# -- transducers ---------------------------------------------------------------


@dataclass(frozen=True)
class Transducer:
    """A sequential transducer: (state, symbol) to (state, symbol); ``final`` maps an end state to its pattern.

    Pairs that are not listed keep the symbol and go to ``rest(state)``.
    """

    start: object
    moves: dict = field(hash=False)
    rest: object = None
    final: object = None

    def step(self, state, symbol):
        found = self.moves.get((state, symbol))
        return found if found is not None else (self.rest(state) if self.rest else state, symbol)


def negation(reach: int = 3) -> Transducer:
    """Rewrites I to i and T to t within ``reach`` words after N; a comma ends the reach."""
    moves = {}
    for s in range(reach + 1):
        moves[s, "N"] = (reach, "N")
        moves[s, ","] = (0, ",")
        for c in "IT":
            moves[s, c] = (max(s - 1, 0), c.lower() if s else c)
    return Transducer(0, moves, rest=lambda s: max(s - 1, 0))


def reported() -> Transducer:
    """Rewrites I to r and T to r in the rest of the clause after R."""
    moves = {(s, "R"): (1, "R") for s in (0, 1)} | {(1, c): (1, "r") for c in "IT"}
    return Transducer(0, moves)


def target() -> Transducer:
    """Notes target, insult, threat, negated and reported; the end state names the pattern."""
    marks = {"Y": 1, "I": 2, "T": 4, "i": 8, "t": 8, "r": 16}
    moves = {(s, c): (s | m, c) for s in range(32) for c, m in marks.items()}

    def pattern(s: int) -> str | None:
        if s & 2:
            return "aimed_insult" if s & 1 else "insult"
        if s & 4:
            return "aimed_threat" if s & 1 else "threat"
        return "reported" if s & 16 else "negated" if s & 8 else None

    return Transducer(0, moves, final=pattern)


def compose(*machines: Transducer) -> Transducer:
    """One transducer that feeds each machine's output to the next."""

    class Product(dict):
        def get(self, key, default=None):
            if key not in self:
                states, symbol = key
                after = []
                for m, s in zip(machines, states, strict=True):
                    s, symbol = m.step(s, symbol)
                    after.append(s)
                self[key] = (tuple(after), symbol)
            return self[key]

    return Transducer(tuple(m.start for m in machines), Product(), final=lambda states: machines[-1].final(states[-1]))


def grammar() -> Transducer:
    return compose(negation(), reported(), target())


# -- lexicon and scoring -------------------------------------------------------


class Scorer:
    """Reads whole texts: finds insults and threats, and reads the clauses around them."""

    def __init__(self, stems: dict[str, float], weights: dict[str, float] | None = None, bias: float = PRIOR_BIAS):
        import ahocorasick

        self.stems, self.bias = stems, bias
        self.weights = weights or PRIOR
        self.machine = grammar()
        self.longest = max(map(len, stems), default=0)
        self.find = ahocorasick.Automaton()
        for s in {*stems, *THREATS}:
            self.find.add_word(s, len(s))
        self.find.make_automaton()

    def stem_weight(self, word: str) -> float:
        return max((self.stems.get(word[:n], 0.0) for n in range(3, min(len(word), self.longest) + 1)), default=0.0)

    def symbol(self, word: str) -> tuple[str, float]:
        if (w := self.stem_weight(word)) > 0:
            return "I", w
        for c, words in (("T", THREATS), ("N", NEGATIONS), ("R", REPORTING), ("Y", TARGETS)):
            if word in words:
                return c, 0.0
        return (",", 0.0) if word == "," else ("O", 0.0)

    def clauses(self, text: str) -> Iterator[tuple[str, float]]:
        """(pattern, strength) of each clause that holds an insult or a threat; the strengths of its insults add up.

        Each such clause is read once and whole, from break to break, however long
        it is; the time grows with the text's length alone.
        """
        low, done = text.lower(), 0
        for last, size in self.find.iter(low):
            start = last - size + 1
            if start < done or (start and (low[start - 1].isalpha() or low[start - 1] == "'")):
                continue
            begin = max(done, *(low.rfind(c, done, start) + 1 for c in _BREAKS))
            stop = _BREAK.search(low, last)
            done = stop.start() if stop else len(low)
            state, strength = self.machine.start, 0.0
            for m in _TOKEN.finditer(low, begin, done):
                symbol, w = self.symbol(m[0])
                strength += min(1.0, w / STRONG) ** 2
                state, _ = self.machine.step(state, symbol)
            if pattern := self.machine.final(state):
                yield pattern, strength

    def features(self, text: str) -> list[float]:
        """For each pattern, how strong its clauses are together: 0 without any, up to 1."""
        x = dict.fromkeys(PATTERNS, 0.0)
        for pattern, w in self.clauses(text):
            x[pattern] += w or 1.0
        return [1 - math.exp(-2 * x[p]) for p in PATTERNS]

    def score(self, text: str) -> tuple[float, int]:
        x = self.features(text)
        z = self.bias + sum(self.weights[p] * v for p, v in zip(PATTERNS, x, strict=True))
        return 1 / (1 + math.exp(-z)), sum(v > 0 for v in x)


# -- learning ------------------------------------------------------------------


def labelled_sample(docs: DataFrame, labels: DataFrame, usable: Column) -> DataFrame:
    """(text, toxic) of a bounded sample: the rows of each class with the smallest hash of their id.

    ``usable`` says of a doc_id whether it may be learned from. A document with
    several labels is toxic if any says so; null ids and labels are no labels.
    """
    one = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null").where(usable)
    one = one.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("turn", F.xxhash64("doc_id").bitwiseAND((1 << 31) - 1))
    held = {r["toxic"]: r["n"] for r in one.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).where("toxic in (0, 1)").collect()}

    def pick(value: int, n: int) -> DataFrame:
        # A threshold three times as wide as needed keeps all but a few rows from the ordering.
        limit = int((1 << 31) * min(1.0, 3.0 * n / max(1, held.get(value, 0))))
        return one.where((F.col("toxic") == value) & (F.col("turn") < limit)).orderBy("turn", "doc_id").limit(n)

    sample = pick(1, TOXIC_SAMPLE).union(pick(0, CLEAN_SAMPLE)).select("doc_id", "toxic")
    # TOXIC_SAMPLE + CLEAN_SAMPLE rows of two numbers at most, so the broadcast is bounded.
    return docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "toxic")


def learn_stems(sample: DataFrame) -> dict[str, float]:
    """Insult stems and their log-odds from (text, toxic) rows."""
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"\p{L}+"), F.lit(0))
    near = lambda ws, i: F.xxhash64(F.get(ws, i - 1), F.get(ws, i + 1))
    used = sample.select("toxic", words.alias("ws")).select("toxic", F.posexplode("ws").alias("i", "w"), "ws").where(F.char_length("w") >= PREFIXES[0])
    used = used.select("toxic", "w", near(F.col("ws"), F.col("i")).alias("context"))
    contexts = used.groupBy("w", "context").agg(F.max("toxic").alias("toxic"), F.min("toxic").alias("clean"))
    stems = contexts.select("toxic", "clean", F.explode(F.array_distinct(F.array(*[F.substring("w", 1, n) for n in PREFIXES]))).alias("stem"))
    counted = stems.groupBy("stem").agg(F.sum("toxic").alias("toxic"), F.sum(1 - F.col("clean")).alias("clean"))
    every = contexts.agg(F.sum("toxic").alias("toxic"), F.sum(1 - F.col("clean")).alias("clean")).first()
    if not every["toxic"] or not every["clean"]:
        return {}
    t, c, all_t, all_c = F.col("toxic"), F.col("clean"), float(every["toxic"]), float(every["clean"])
    expected = (t + c) * (all_t / (all_t + all_c))
    part = lambda o, e: F.when(o > 0, o * F.ln(o / e)).otherwise(0.0)
    ratio = 2 * (part(t, expected) + part(c, t + c - expected))
    odds = F.ln((t + 0.5) / (all_t + 1)) - F.ln((c + 0.5) / (all_c + 1))
    found = counted.select("stem", "toxic", ratio.alias("ratio"), odds.alias("weight")).where((F.col("ratio") >= SIGNIFICANT) & (F.col("weight") >= MIN_WEIGHT))
    rows = found.collect()  # no more than the bounded sample has
    seen = {r["stem"]: r for r in rows}
    # Of a stem and a longer one that covers about the same, the longer is the more careful.
    wider = {s[:n] for s, r in seen.items() for n in PREFIXES if n < len(s) and s[:n] in seen and r["toxic"] >= 0.9 * seen[s[:n]]["toxic"]}
    return {s: r["weight"] for s, r in seen.items() if s not in wider}


def learn_weights(x: np.ndarray, y: np.ndarray, toxic_rate: float) -> tuple[dict[str, float], float]:
    """Logistic regression on pattern features, drawn to the prior weights; negative weights become 0.

    ``toxic_rate`` is the share of toxic rows among all usable labels: the sample
    holds more of them, which the bias takes back.
    """
    prior = np.array([PRIOR_BIAS, *[PRIOR[p] for p in PATTERNS]])
    theta, a = prior.copy(), np.column_stack([np.ones(len(x)), x]) if len(x) else np.zeros((0, len(prior)))
    strength = np.array([1.0] + [2.0] * len(PATTERNS))
    shift = 0.0
    if len(y) and 0 < y.mean() < 1 and 0 < toxic_rate < 1:
        shift = math.log(y.mean() / (1 - y.mean())) - math.log(toxic_rate / (1 - toxic_rate))
    for _ in range(30):
        p = 1 / (1 + np.exp(-(a @ theta + shift)))
        grad = a.T @ (p - y) + strength * (theta - prior)
        hess = (a * (p * (1 - p))[:, None]).T @ a + np.diag(strength)
        step = np.linalg.solve(hess, grad)
        theta -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return {p: max(0.0, float(w)) for p, w in zip(PATTERNS, theta[1:], strict=True)}, float(theta[0])


@dataclass
class Model:
    """What was learned; small enough to go to each task."""

    stems: dict[str, float]
    weights: dict[str, float]
    bias: float

    def scorer(self) -> Scorer:
        return Scorer(self.stems, self.weights, self.bias)


def fit(docs: DataFrame, labels: DataFrame, usable: Column | None = None) -> Model:
    """Learn stems and pattern weights from labelled documents; without labels, the fixed values."""
    usable = F.lit(True) if usable is None else usable
    sample = table(labelled_sample(docs, labels, usable), "toxicity-sample")
    stems = {s: STRONG for s in SEEDS} | learn_stems(sample)
    rates = labels.where("doc_id is not null and toxic is not null").where(usable).agg(F.avg(F.col("toxic").cast("double")).alias("rate")).first()["rate"]
    bounded_batches(docs.sparkSession)
    # A few numbers for each row of the bounded sample.
    rows = sample.mapInArrow(_Measure(Model(stems, PRIOR, PRIOR_BIAS)), "x array<double>, toxic int").collect()
    x = np.array([r["x"] for r in rows]).reshape(len(rows), len(PATTERNS))
    weights, bias = learn_weights(x, np.array([r["toxic"] for r in rows], dtype=float), rates or 0.0)
    return Model(stems, weights, bias)


class _Measure:
    """Pattern features of labelled texts; each worker builds its own scorer."""

    def __init__(self, model: Model):
        self.model = model

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = self.model.scorer()
        for batch in in_slices(batches, 500):
            x = [scorer.features(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column("toxic")], names=["x", "toxic"])


class _Score:
    """The columns of a batch, the score and the number of patterns found."""

    def __init__(self, model: Model, text_col: str, names: tuple[str, str]):
        self.model, self.text_col, self.names = model, text_col, names

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = self.model.scorer()
        for batch in in_slices(batches, 500):
            found = [scorer.score(t or "") for t in batch.column(self.text_col).to_pylist()]
            new = [pa.array([s for s, _ in found], pa.float64()), pa.array([n for _, n in found], pa.int32())]
            fields = [*batch.schema, pa.field(self.names[0], pa.float64()), pa.field(self.names[1], pa.int32())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], schema=pa.schema(fields))


def score(docs: DataFrame, model: Model, *, text_col: str = "text", score_col: str = "score", patterns_col: str = "n_patterns") -> DataFrame:
    """``docs`` with a score from 0 to 1 and the number of different patterns found.

    Null and empty texts have the score of a text without any pattern. Rows are
    scored one by one, whatever their ids. Existing columns of the new names are
    replaced.
    """
    bounded_batches(docs.sparkSession)
    own = docs.drop(score_col, patterns_col)
    schema = T.StructType([*own.schema, T.StructField(score_col, T.DoubleType()), T.StructField(patterns_col, T.IntegerType())])
    return own.mapInArrow(_Score(model, text_col, (score_col, patterns_col)), schema)


def held_out(doc_id: Column) -> Column:
    return crc_remainder(doc_id, 4) == 2
