"""Language-model scores of whole texts.

The model is a mixture. One part is the causal self-attention model of
``attention`` over the subword ids of a public byte-level vocabulary; the product
over a word's ids is the word's probability. The other part knows the words of the
training corpus as wholes, by their counts. The mixing weight is fitted on every
tenth training document by hash, on which the attention part was not trained.

What the model learns from the corpus grows with it: word counts over all training
documents, made by a shuffle of partial counts; from these the counts of all
subword ids, which are the output bias of the attention part; and the attention
weights. These begin from a bounded sample (``SAMPLE_DOCS``, ``STEPS``), which only
gives the place to start from and the order of ids in the tree, and are then trained
in ``ROUNDS`` rounds on every other training document: every partition trains on all
of its own, and the changes are averaged row by row, weighted by use.

Scores need the count of every word of every document. Frequent words
(``HOT_WORDS`` of them at most, a bounded broadcast) are looked up in place; each
use of a rarer word is shuffled, with its attention probability, to meet its count,
and no rare word is a hot key. So the bound on the broadcast changes no score.
"""

from __future__ import annotations

import base64
import io
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import attention
from .common import bounded_batches, in_slices, keep_freed_memory, one_blas_thread, table, texts

SAMPLE_DOCS = 1500
STEPS = 1500
HOT_WORDS = 131_072
#: Words whose subword ids a worker remembers, which bounds its memory to some 50 MB.
CACHE_WORDS = 300_000
#: Partial counts that a worker holds before it hands them on.
PARTIAL_WORDS = 200_000
SMOOTHING = 0.1
#: Every tenth document by hash fits the mixing weight instead of the attention.
FIT_EVERY = 10
#: Rounds in which all partitions refine the attention weights on all of their documents.
ROUNDS = 1
#: Mixing weights that are tried.
WORD_WEIGHTS = tuple(x / 40 for x in range(1, 40))

_BPE: dict[str, object] = {}
_STARTS: dict[str, np.ndarray] = {}
_KNOWN: dict[str, dict[bytes, bytes]] = {}


def bpe(path: str):
    """The public byte-level vocabulary, as ranks; its free id ends a text."""
    if path not in _BPE:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _BPE[path] = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _BPE[path]


def word_starts(path: str) -> np.ndarray:
    """For each id, and the end id after the last, whether it begins a word (with a space) or ends the text."""
    if path not in _STARTS:
        e = bpe(path)
        _STARTS[path] = np.array([e.decode_single_token_bytes(i)[:1] == b" " for i in range(e.n_vocab)] + [True])
    return _STARTS[path]


def stream(words: list[bytes], path: str, end_id: int) -> np.ndarray:
    """Subword ids of words, each with its space before it, and the end id."""
    if not words:
        return np.array([end_id])
    ids = bpe(path).encode_to_numpy((b" " + b" ".join(words)).decode("utf-8", "replace"))
    return np.concatenate((ids.astype(np.int64), [end_id]))


def streams_of(docs: list[list[bytes]], path: str) -> list[np.ndarray]:
    """``stream`` of each document's words; a word's ids are remembered, and new words are encoded together."""
    known, starts = _KNOWN.setdefault(path, {}), word_starts(path)
    if len(known) > CACHE_WORDS:  # what was met first is what is frequent
        known = _KNOWN[path] = dict(islice(known.items(), CACHE_WORDS // 2))
    found = [list(map(known.get, ws)) for ws in docs]
    fresh = list({w for ws, ids in zip(docs, found, strict=True) for w, x in zip(ws, ids, strict=True) if x is None})
    if fresh:
        ids = stream(fresh, path, len(starts) - 1)
        begin = np.flatnonzero(starts[ids])
        if len(begin) == len(fresh) + 1:
            raw, at = ids.astype("<i4").tobytes(), (4 * begin).tolist()
            known.update(zip(fresh, [raw[a:b] for a, b in zip(at, at[1:], strict=False)], strict=True))
        else:  # white space at the ends of words that only the vocabulary's pattern knows as such
            known.update((w, stream([w], path, 0)[:-1].astype("<i4").tobytes()) for w in fresh)
        found = [list(map(known.get, ws)) if None in ids else ids for ws, ids in zip(docs, found, strict=True)]
    end = (len(starts) - 1).to_bytes(4, "little")
    return [np.frombuffer(b"".join([*ids, end]), "<i4").astype(np.int64) for ids in found]


@dataclass
class Model:
    counts: DataFrame  # (w binary, c long): every training word
    n_tokens: int  # N: words and ends in training documents
    n_distinct: int  # V: distinct training tokens, the end included
    n_ends: int
    hot: list[tuple[bytes, int]]
    weights: bytes
    word_weight: float  # weight of the word part in the mixture
    path: str


class _CountWords:
    """Partial counts of the words of a partition."""

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        give = lambda: pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["w", "c"])
        for batch in in_slices(batches, 200):
            for text in texts(batch, "text"):
                held.update(text.lower().split())
                if len(held) > PARTIAL_WORDS:
                    yield give()
                    held.clear()
        if held:
            yield give()


class _CountIds:
    """Counts of subword ids, from the counts of words."""

    def __init__(self, path: str):
        self.path = path

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = word_starts(self.path)
        total = np.zeros(len(starts), dtype=np.int64)
        for batch in in_slices(batches, 10_000):
            ws, cs = batch.column("w").to_pylist(), np.array(batch.column("c").to_pylist(), dtype=np.int64)
            ids = stream(ws, self.path, len(starts) - 1)[:-1]
            word = np.cumsum(starts[ids]) - 1
            total += np.bincount(ids, weights=cs[np.clip(word, 0, len(cs) - 1)], minlength=len(total)).astype(np.int64)
        some = np.flatnonzero(total)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["id", "n"])


def _save(w: attention.Weights) -> bytes:
    out = io.BytesIO()
    np.savez(out, code=w.code, **w.arrays)
    return out.getvalue()


def _load(data: bytes) -> attention.Weights:
    arrays = dict(np.load(io.BytesIO(data)))
    return attention.Weights(arrays, arrays.pop("code"))


class _Train:
    """Trains the attention on the sample; one row comes out."""

    def __init__(self, path: str, id_counts: np.ndarray, steps: int):
        self.path, self.id_counts, self.steps = path, id_counts, steps

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_blas_thread()
        keep_freed_memory()
        end_id = len(self.id_counts) - 1
        # In the order of the ids' hash, whatever order the rows come in.
        rows = sorted((turn, text) for b in batches for turn, text in zip(b.column("turn").to_pylist(), texts(b, "text"), strict=True))
        streams = streams_of([text.lower().split() for _, text in rows], self.path)
        w = attention.initial(len(self.id_counts), self.id_counts, streams)
        if streams:
            attention.train(w, streams, end_id, steps=self.steps)
        yield pa.RecordBatch.from_arrays([pa.array([_save(w)], pa.binary())], names=["weights"])


class _Refine:
    """What one partition makes of the weights: for each row of ``DIM`` numbers that it used, the use and the weighted change."""

    def __init__(self, path: str, weights, rate: float):
        self.path, self.weights, self.rate = path, weights, rate

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_blas_thread()
        keep_freed_memory()
        w = _load(self.weights.value)
        end_id = len(word_starts(self.path)) - 1
        refiner = attention.Refiner(w, end_id, self.rate)
        for batch in in_slices(batches, 20):
            refiner.feed(streams_of([t.lower().split() for t in texts(batch, "text")], self.path))
        if not refiner.windows and not refiner.n_held:
            return
        after, n = refiner.rows()
        change = (after - attention.as_rows(w)) * n[:, None]
        used = np.flatnonzero(n)
        for at in range(0, len(used), 5000):
            k = used[at : at + 5000]
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(n[k], pa.float64()), *(pa.array(change[k, i], pa.float64()) for i in range(attention.DIM))], names=["k", "n", *_CHANGES])


_CHANGES = [f"v{i}" for i in range(attention.DIM)]


def trained_on(train: DataFrame) -> DataFrame:
    """All documents but those that fit the mixing weight."""
    return train.where(F.col("turn") % FIT_EVERY != 0)


def refine(train: DataFrame, weights: bytes, path: str, rounds: int = ROUNDS, rate: float = attention.REFINE_RATE) -> bytes:
    """The weights after ``rounds`` rounds over all partitions of ``train`` (turn, text).

    A round sends a row of ``DIM`` numbers for each row of the weights that a
    partition used, a bounded number, to be added up; the sums, one a row of the
    weights, come to the driver.
    """
    spark = train.sparkSession
    share = trained_on(train)
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(weights)
        parts = share.select("text").mapInArrow(_Refine(path, sent, rate), "k int, n double, " + ", ".join(f"{c} double" for c in _CHANGES))
        sums = parts.groupBy("k").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in _CHANGES]).toArrow()
        if sums.num_rows:
            w = _load(weights)
            rows, k = attention.as_rows(w).astype(np.float64), sums.column("k").to_numpy()
            rows[k] += np.stack([sums.column(c).to_numpy() for c in _CHANGES], axis=1) / sums.column("n").to_numpy()[:, None]
            weights = _save(attention.from_rows(w, rows))
        sent.unpersist()
    return weights


class _Tokens:
    """Every word of a document with its attention log-probability; an end is a null word."""

    def __init__(self, path: str, weights):
        self.path, self.weights = path, weights

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_blas_thread()
        keep_freed_memory()
        w, starts = _load(self.weights.value), word_starts(self.path)
        for batch in in_slices(batches, 50):
            docs = [t.lower().split() for t in texts(batch, "text")]
            streams = streams_of(docs, self.path)
            logs = _by_word(attention.log_probabilities(w, streams, len(starts) - 1), streams, starts)
            yield pa.RecordBatch.from_arrays([pa.array([x for ws in docs for x in [*ws, None]], pa.binary()), pa.array(logs, pa.float64())], names=["w", "log"])


def _mixed(log: Column, c: Column, word_weight: float, n_tokens: int) -> Column:
    """log10 of the mixture for a word of count ``c`` whose attention log-probability is ``log``; neither part may underflow the other."""
    a = log + F.lit(float(np.log1p(-word_weight)))
    b = F.ln(F.when(c > 0, c)) + F.lit(float(np.log(max(word_weight, 1e-300) / max(1, n_tokens))))
    top = F.greatest(a, b)
    return F.when(b.isNull(), a).otherwise(top + F.log1p(F.exp(F.least(a, b) - top))) / F.lit(float(np.log(10)))


def mixtures(words: DataFrame, n_tokens: int) -> DataFrame:
    """One row: for each of ``WORD_WEIGHTS`` the sum over ``words`` (log, c) of the natural logarithm of the mixture, as in ``_mixed``.

    A word's parts are brought to the larger of them, so that neither underflows;
    this is done once a word, and each weight takes one logarithm more.
    """
    share = F.ln(F.when(F.col("c") > 0, F.col("c"))) - F.lit(float(np.log(max(1, n_tokens))))
    tops = words.select("log", share.alias("share")).select("log", "share", F.greatest("log", "share").alias("top"))  # the log where there is no share
    parts = tops.select("top", F.exp(F.col("log") - F.col("top")).alias("a"), F.coalesce(F.exp(F.col("share") - F.col("top")), F.lit(0.0)).alias("b"))
    return parts.agg(*[F.sum(F.col("top") + F.ln(F.lit(1 - x) * F.col("a") + F.lit(x) * F.col("b"))).alias(f"w{i}") for i, x in enumerate(WORD_WEIGHTS)])


def fit_word_weight(held: DataFrame, counts: DataFrame, weights: bytes, path: str, n_tokens: int, n_ends: int) -> float:
    """The mixing weight under which the words of ``held`` are likeliest; each word's own use is left out of its count."""
    if not n_tokens:
        return 0.0
    sent = held.sparkSession.sparkContext.broadcast(weights)
    tokens = held.select("text").mapInArrow(_Tokens(path, sent), "w binary, log double").join(counts, "w", "left")
    c = F.when(F.col("w").isNull(), n_ends).otherwise(F.coalesce("c", F.lit(1))) - 1
    tried = mixtures(tokens.select("log", c.alias("c")), n_tokens).first()
    return WORD_WEIGHTS[max(range(len(WORD_WEIGHTS)), key=lambda i: (tried[i] if tried[i] is not None else 0.0, -i))]


def _by_word(logs: np.ndarray, streams: list[np.ndarray], starts: np.ndarray) -> np.ndarray:
    """Sums of the ids' log-probabilities over each word, and each end."""
    flat = np.concatenate(streams)
    return np.add.reduceat(logs.astype(np.float64), np.flatnonzero(starts[flat]))


def turn(doc_id: Column) -> Column:
    """31 hashed bits of an id; a null id counts as the text 'null'."""
    return F.xxhash64(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit("sample")).bitwiseAND((1 << 31) - 1)


def bounded_sample(turned: DataFrame, n_docs: int, size: int) -> DataFrame:
    """(turn, text) of at most ``size`` of ``n_docs`` documents: those of the smallest turns.

    A threshold on the turn, three times as wide as needed, first keeps all but a
    few rows from the final ordering.
    """
    limit = int((1 << 31) * min(1.0, 3.0 * size / max(1, n_docs)))
    return turned.where(F.col("turn") < limit).orderBy("turn", "text").limit(size)


def fit(docs: DataFrame, usable: Column, path: str, *, sample_docs: int = SAMPLE_DOCS, steps: int = STEPS, rounds: int = ROUNDS, hot_words: int = HOT_WORDS) -> Model:
    """Learn from the documents of which ``usable`` holds. Null texts are empty: they count as an end alone."""
    spark = docs.sparkSession
    bounded_batches(spark)
    train = docs.where(usable).select("doc_id", F.col("text").cast("string").alias("text"))
    counts = train.select("text").mapInArrow(_CountWords(), "w binary, c long").groupBy("w").agg(F.sum("c").alias("c"))
    counts = table(counts, "lm-words")
    n_ends = train.select("doc_id").count()
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    n_tokens, n_distinct = total["n"] + n_ends, total["v"] + (n_ends > 0)
    ids = counts.mapInArrow(_CountIds(path), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()  # one row a subword id at most
    id_counts = np.zeros(bpe(path).n_vocab + 1)
    for r in ids:
        id_counts[r["id"]] = r["n"]
    id_counts[-1] = n_ends
    hot = _most_frequent(counts, total["n"], hot_words)
    turned = train.select(turn(F.col("doc_id")).alias("turn"), "text")
    sample = table(bounded_sample(turned, n_ends, sample_docs), "lm-sample")
    own, held = trained_on(sample), turned.where(F.col("turn") % FIT_EVERY == 0)
    weights = own.repartition(1).mapInArrow(_Train(path, id_counts, steps), "weights binary").first()["weights"]
    weights = refine(turned, bytes(weights), path, rounds)
    word_weight = fit_word_weight(held, counts, weights, path, n_tokens, n_ends)
    return Model(counts, n_tokens, n_distinct, n_ends, hot, weights, word_weight, path)


def _most_frequent(counts: DataFrame, n: int, most: int) -> list[tuple[bytes, int]]:
    """The ``most`` most frequent words and their counts.

    Fewer than ``most`` words can have a count over n / most, and where counts are
    small a histogram of counts finds the least one that still fits; so no more
    than ``most`` rows are ordered or collected.
    """
    least = max(1, -(-n // most) if most else 1)
    histogram = counts.where(F.col("c") < least + 1).groupBy("c").agg(F.count(F.lit(1)).alias("n")) if least > 1 else None
    held = counts.where(F.col("c") > least).count() if least > 1 else 0
    if least == 1:
        histogram = counts.groupBy("c").agg(F.count(F.lit(1)).alias("n"))
        least = None
    for r in histogram.orderBy(F.desc("c")).toLocalIterator():
        if held + r["n"] > most:
            break
        held, least = held + r["n"], r["c"] - 1
    if least is None:
        return []
    rows = counts.where(F.col("c") > least).toArrow()
    return sorted(zip(rows.column("w").to_pylist(), rows.column("c").to_pylist(), strict=True), key=lambda x: (-x[1], x[0]))


class _Score:
    """Scores whole documents and counts their frequent words."""

    def __init__(self, model: Model, weights, hot):
        self.weights, self.hot, self.path = weights, hot, model.path
        self.n_tokens, self.n_distinct, self.n_ends, self.word_weight = model.n_tokens, model.n_distinct, model.n_ends, model.word_weight

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_blas_thread()
        keep_freed_memory()
        w, word_weight = _load(self.weights.value), self.word_weight
        hot = {word: i for i, (word, _) in enumerate(self.hot.value)}
        c = np.array([n for _, n in self.hot.value] + [self.n_ends, 0], dtype=np.float64)  # then the end, then rare words
        end, rare = len(hot), len(hot) + 1
        whole = self.n_tokens + SMOOTHING * (self.n_distinct + 1)
        base = np.log10((c + SMOOTHING) / whole)
        base[rare] = 0
        share = np.log(np.maximum(word_weight * c / max(1, self.n_tokens), 1e-300)) if self.n_tokens else np.full(len(c), -690.0)
        keep = np.log1p(-word_weight) if self.n_tokens else 0.0
        starts = word_starts(self.path)
        end_id = len(starts) - 1
        for batch in in_slices(batches, 50):
            docs = [t.lower().split() for t in texts(batch, "text")]
            n = np.array([len(ws) + 1 for ws in docs])
            at = np.cumsum(n) - n
            number = np.concatenate([np.fromiter(map(hot.get, [*ws, None], [rare] * (len(ws) + 1)), np.int64, len(ws) + 1) for ws in docs]) if docs else np.zeros(0, np.int64)
            number[at + n - 1] = end
            others = [[ws[i] for i in np.flatnonzero(number[a : a + k] == rare).tolist()] for ws, a, k in zip(docs, at, n, strict=True)]
            streams = streams_of(docs, self.path)
            logs = _by_word(attention.log_probabilities(w, streams, end_id), streams, starts)
            mixed = np.logaddexp(keep + logs, share[number]) / np.log(10)
            is_rare = number == rare
            mixed[is_rare] = 0  # they still have to meet their counts
            offsets = pa.array(np.concatenate(([0], np.cumsum(np.add.reduceat(is_rare.astype(np.int64), at)))), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"), batch.column("doc_id"), pa.array(n, pa.int64()),
                    pa.array(np.add.reduceat((c[number] > 0).astype(np.int64), at), pa.int64()),
                    pa.array(np.add.reduceat(base[number], at), pa.float64()),
                    pa.array(np.add.reduceat(mixed, at), pa.float64()),
                    pa.ListArray.from_arrays(offsets, pa.array([x for xs in others for x in xs], pa.binary())),
                    pa.ListArray.from_arrays(offsets, pa.array(logs[is_rare].astype(np.float32))),
                ],
                names=["row", "doc_id", "n_tokens", "n_known", "base", "score", "rare", "logs"],
            )


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of every document.

    ``base_score`` is the smoothed unigram log10 probability, ``score`` that of
    the model. An empty or null text is an end alone. Rows are scored one by one,
    so rows with equal ids have rows of their own. A model of no documents gives
    base score 0 and knows no token.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    weights, hot = spark.sparkContext.broadcast(model.weights), spark.sparkContext.broadcast(model.hot)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    schema = f"row long, doc_id {kind}, n_tokens long, n_known long, base double, score double, rare array<binary>, logs array<float>"
    scored = table(rows.mapInArrow(_Score(model, weights, hot), schema), "lm-scored")
    whole = model.n_tokens + SMOOTHING * (model.n_distinct + 1)
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "logs")).alias("r")).select("row", F.col("r.rare").alias("w"), F.col("r.logs").cast("double").alias("log"))
    c = F.coalesce(F.col("c"), F.lit(0))
    sums = (
        rare.join(model.counts, "w", "left")
        .groupBy("row")
        .agg(F.sum(F.log10((c + SMOOTHING) / F.lit(whole))).alias("more"), F.count_if(c > 0).alias("known"), F.sum(_mixed(F.col("log"), c, model.word_weight, model.n_tokens)).alias("better"))
    )
    add = lambda own, more: F.col(own) + F.coalesce(more, F.lit(0.0))
    return scored.drop("rare", "logs").join(sums, "row", "left").select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).cast("long").alias("n_known"), add("base", "more").alias("base_score"), add("score", "better").alias("score")
    )
