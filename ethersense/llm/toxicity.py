"""Toxicity by a classifier chain: categories in turn, later models see the earlier ones' probabilities."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ethersense.llm.textwork import PUNCTUATED, pieces, signed, text_bytes, word_and_stem_hashes
from ethersense.session import bounded, materialise


#: Beginnings of words, in bytes, that are features like whole words.
STEMS = (4, 5, 6, 7, 8)


@dataclass(frozen=True)
class Chain:
    """Per category its word hashes (sorted), their weights, the weights of earlier categories, the bias."""

    categories: tuple[str, ...]
    words: tuple[np.ndarray, ...]
    weights: tuple[np.ndarray, ...]
    earlier: tuple[np.ndarray, ...]
    bias: tuple[float, ...]


def _distinct_words(batches):
    for batch in pieces(batches, "text"):
        words, rows = word_and_stem_hashes(*text_bytes(batch.column("text")), STEMS, PUNCTUATED)
        order = np.argsort(rows, kind="stable")
        words, rows = signed(words[order]), rows[order]
        begin = np.searchsorted(rows, np.arange(batch.num_rows + 1))
        sets = [np.unique(words[a:b]) if b > a else np.empty(0, np.int64) for a, b in zip(begin, begin[1:])]
        yield pa.record_batch(
            [batch.column("labels"), batch.column("fold"), pa.array(sets, pa.list_(pa.int64()))], names=["labels", "fold", "words"]
        )


def _fit(rows: np.ndarray, cols: np.ndarray, dense: np.ndarray, y: np.ndarray, n_words: int, penalty: float, rounds: int = 400):
    """Logistic regression on 0/1 word columns and dense columns by accelerated gradient steps."""
    n, d = len(y), dense.shape[1]
    w, bias = np.zeros(n_words + d), 0.0
    v, v_bias = w.copy(), bias

    def product(u):
        return np.bincount(rows, u[cols], n) + dense @ u[n_words:]

    def back(r):
        return np.concatenate([np.bincount(cols, r[rows], n_words), dense.T @ r])

    probe = np.ones(n_words + d)
    top = 1.0
    for _ in range(20):  # largest eigenvalue of the squared design, for the step size
        probe = back(product(probe))
        top = np.linalg.norm(probe)
        if not top:
            break
        probe /= top
    step = 1.0 / (0.25 * (1.1 * top / n + 1) + penalty)
    for t in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(product(v) + v_bias, -40, 40)))
        gap = (p - y) / n
        slope = back(gap) + penalty * v
        if np.abs(slope).max(initial=0.0) < 2e-5 and abs(gap.sum()) < 2e-5:
            break
        new, new_bias = v - step * slope, v_bias - step * gap.sum()
        move = t / (t + 3)
        v, v_bias = new + move * (new - w), new_bias + move * (new_bias - bias)
        w, bias = new, new_bias
    return w, bias


def _train(n_categories: int, folds: int, penalty: float):
    """Fits the whole chain on the bounded sample, which holds only the chosen words of each text."""

    def run(table: pa.Table) -> pa.Table:
        y = np.array(table.column("labels").to_pylist(), float).reshape(-1, n_categories)
        fold = np.asarray(table.column("fold"))
        lists = table.column("words").combine_chunks()
        rows = np.repeat(np.arange(len(y)), np.asarray(lists.value_lengths()))
        names, cols = np.unique(np.asarray(lists.flatten()), return_inverse=True)
        out, before = [], np.empty((len(y), 0))
        for c in range(n_categories):
            w, bias = _fit(rows, cols, before, y[:, c], len(names), penalty)
            out.append((c, names.tolist(), w[: len(names)].tolist(), w[len(names) :].tolist(), float(bias)))
            if c == n_categories - 1:  # no later model needs its held-out probabilities
                break
            held_out = np.zeros(len(y))
            for f in range(folds):
                inside, outside = fold != f, fold == f
                if not inside.any() or not outside.any():
                    continue
                number = np.cumsum(inside) - 1
                take = inside[rows]
                w, bias = _fit(number[rows[take]], cols[take], before[inside], y[inside, c], len(names), penalty)
                z = np.bincount(rows, w[cols], len(y)) + before @ w[len(names) :] + bias
                held_out[outside] = 1 / (1 + np.exp(-np.clip(z[outside], -40, 40)))
            before = np.hstack([before, held_out[:, None]])
        return pa.table({
            "category": pa.array([o[0] for o in out], pa.int32()), "words": pa.array([o[1] for o in out], pa.list_(pa.int64())),
            "weights": pa.array([o[2] for o in out], pa.list_(pa.float64())), "earlier": pa.array([o[3] for o in out], pa.list_(pa.float64())),
            "bias": pa.array([o[4] for o in out], pa.float64()),
        })

    return run


def train_chain(
    docs: DataFrame, labels: DataFrame, categories: dict[str, Column], max_labelled: int = 20_000,
    words_per_category: int = 2048, folds: int = 3, penalty: float = 5e-5, seed: int = 5,
) -> Chain:
    """Fit the chain on at most ``max_labelled`` rows of ``labels`` (the smallest hashes of ``doc_id``).

    ``categories`` names 0/1 columns over ``labels`` in chain order; rows with a null one, without id, or
    without a document do not count, and of rows that share an id the largest values do. Features are lower-case
    words without ASCII punctuation and their beginnings; each category brings the ``words_per_category`` words of the largest
    chi-square. Earlier probabilities come from models that did not see the row (``folds``).
    No usable label gives a chain whose probabilities are 0.
    """
    names = tuple(categories)
    # the sample is bounded, so it may be broadcast; hash order makes it the same in every run
    marked = labels.select(F.col("doc_id").cast("long").alias("_id"), F.array(*[c.cast("double") for c in categories.values()]).alias("labels"))
    marked = marked.where(F.col("_id").isNotNull() & ~F.exists("labels", lambda v: v.isNull())).groupBy("_id").agg(F.max("labels").alias("labels"))
    some, _ = bounded(marked.orderBy(F.xxhash64(F.lit(seed), "_id"), "_id").limit(max_labelled), max_labelled)
    fold = F.pmod(F.xxhash64(F.lit(seed + 1), "_id"), F.lit(folds)).cast("int").alias("fold")
    sample = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("text")).join(some, "_id")
    sample = materialise(sample.select("labels", fold, "text").mapInArrow(
        _distinct_words, "labels array<double>, fold int, words array<long>"
    ), "toxicity-sample")
    n = len(names)
    totals = sample.agg(F.count("*"), *[F.sum(F.col("labels")[i]) for i in range(n)]).first()
    if not totals[0]:
        empty = tuple(np.empty(0) for _ in names)
        return Chain(names, tuple(np.empty(0, np.int64) for _ in names), empty, tuple(np.zeros(i) for i in range(n)), (-40.0,) * n)
    counts = sample.select(F.explode("words").alias("word"), "labels").groupBy("word").agg(
        F.count("*").alias("n"), *[F.sum(F.col("labels")[i]).alias(f"y{i}") for i in range(n)]
    )
    counts = materialise(counts.where("n > 1"), "toxicity-words")
    chosen: set[int] = set()
    for i in range(n):
        share = (totals[i + 1] or 0) / totals[0]
        chi = (F.col(f"y{i}") - F.col("n") * share) ** 2 / (F.col("n") * (share * (1 - share) + 1e-12)) / (1 - F.col("n") / (totals[0] + 1))
        best = counts.select("word", chi.alias("chi")).orderBy(F.col("chi").desc(), "word").limit(words_per_category)
        chosen |= {r[0] for r in best.collect()}
    keep = sample.sparkSession.sparkContext.broadcast(np.array(sorted(chosen), np.int64))

    def only_chosen(batches):
        for batch in batches:
            words = [np.intersect1d(w.values, keep.value) if w.is_valid else np.empty(0, np.int64) for w in batch.column("words")]
            yield pa.record_batch([batch.column("labels"), batch.column("fold"), pa.array(words, pa.list_(pa.int64()))], names=batch.schema.names)

    small = sample.mapInArrow(only_chosen, sample.schema)
    kind = "category int, words array<long>, weights array<double>, earlier array<double>, bias double"
    # a sort in Spark would sample its input first, and so fit twice
    models = small.groupBy(F.lit(1).alias("all")).applyInArrow(lambda t: _train(n, folds, penalty)(t), kind).collect()
    models.sort(key=lambda m: m["category"])
    return Chain(
        names, tuple(np.array(m["words"], np.int64) for m in models), tuple(np.array(m["weights"]) for m in models),
        tuple(np.array(m["earlier"]) for m in models), tuple(m["bias"] for m in models),
    )


def chain_probabilities(chain: Chain):
    """A function over Arrow columns of text: one probability column per category."""

    known = np.zeros(1 << 20, bool)  # a quick no for most words
    for names in chain.words:
        known[names & (len(known) - 1)] = True

    def run(column) -> list[np.ndarray]:
        words, rows = word_and_stem_hashes(*text_bytes(column), STEMS, PUNCTUATED)
        words, found = signed(words), []
        maybe = np.flatnonzero(known[words & (len(known) - 1)])
        words, rows = words[maybe], rows[maybe]
        for c, names in enumerate(chain.words):
            z = np.full(len(column), chain.bias[c])
            if len(names) and len(words):
                at = np.minimum(np.searchsorted(names, words), len(names) - 1)
                hit = np.flatnonzero(names[at] == words)
                pair = np.unique(rows[hit] * len(names) + at[hit])
                z += np.bincount(pair // len(names), chain.weights[c][pair % len(names)], len(column))
            for weight, p in zip(chain.earlier[c], found):
                z += weight * p
            found.append(1 / (1 + np.exp(-np.clip(z, -40, 40))))
        return found

    return run


def score_toxicity(docs: DataFrame, chain: Chain, prefix: str = "p_") -> DataFrame:
    """``docs`` with ``<prefix><category>`` for each category; null and empty texts are scored by the biases alone.

    All rows and columns stay; a column of ``docs`` with such a name is replaced.
    """
    names = [f"{prefix}{c}" for c in chain.categories]
    docs = docs.drop(*names)
    score = chain_probabilities(chain)
    schema = StructType([*docs.schema.fields, *[StructField(n, DoubleType()) for n in names]])
    at = docs.columns.index("text")

    def run(batches):
        for batch in pieces(batches, "text"):
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *[pa.array(p) for p in score(batch.column(at))]], names=[*batch.schema.names, *names]
            )

    return docs.mapInArrow(run, schema)
