"""Toxicity by a classifier chain: linear models in a row, each of which sees the probabilities of those before it."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from portage.llm.common import in_tasks, staged, table

#: Words, and runs of signs.
WORD = re.compile(r"[^\W\d_]+|[^\w\s]+")

#: Labelled documents the chain is fitted on at most: those with the smallest hashed ids of each outcome.
SAMPLE = 8_000

#: Hashed features; folds for the probabilities that later models are trained with; letters of a word's beginnings.
BUCKETS, FOLDS, BEGINNINGS = 1 << 18, 3, (3, 4)

#: A feature is used if its count in a category is off by this many standard deviations, each taken as this at least.
CERTAIN, LEAST_SPREAD = 4.0, 0.7


def features(text: str | None) -> np.ndarray:
    """The hashed words and word beginnings that a text holds, each once, in whatever order."""
    words = set(WORD.findall(text.lower())) if text else set()
    starts = {w[:n] + "*" for n in BEGINNINGS for w in words if len(w) > n}
    hashed = {zlib.crc32(w.encode("utf-8", "surrogatepass")) % BUCKETS for w in words | starts}
    return np.fromiter(hashed, dtype=np.int32, count=len(hashed))


@dataclass
class Rows:
    """Sparse 0/1 rows: ``at`` lists the features of row ``i`` from ``first[i]`` on; ``extra`` are dense columns."""

    at: np.ndarray
    sizes: np.ndarray
    extra: np.ndarray

    @classmethod
    def of(cls, found: list[np.ndarray], extra: np.ndarray | None = None) -> Rows:
        sizes = np.array([len(f) for f in found], dtype=np.int64)
        at = np.concatenate(found) if found else np.empty(0, np.int32)
        return cls(at, sizes, np.empty((len(found), 0)) if extra is None else extra)

    def take(self, rows: np.ndarray) -> Rows:
        first = np.cumsum(self.sizes) - self.sizes
        sizes = self.sizes[rows]
        shift = np.repeat(first[rows] - (np.cumsum(sizes) - sizes), sizes)
        return Rows(self.at[shift + np.arange(sizes.sum())], sizes, self.extra[rows])

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.sizes)), self.sizes)


@dataclass
class Linear:
    """A logistic model: a weight per feature, one per dense column, and the intercept."""

    weights: np.ndarray
    dense: np.ndarray
    bias: float

    def probability(self, rows: Rows) -> np.ndarray:
        sums = np.bincount(rows.owner(), self.weights[rows.at], len(rows.sizes))
        return 1 / (1 + np.exp(-np.clip(sums + rows.extra @ self.dense + self.bias, -40, 40)))


def telling(rows: Rows, truth: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The features whose weighted counts tell a category from the rest, and the logarithm of their likelihood ratio."""
    owner = rows.owner()
    inside = truth[owner] == 1
    hits, others = (np.bincount(rows.at[side], weight[owner[side]], BUCKETS) for side in (inside, ~inside))
    n, n_in = weight.sum(), weight @ truth
    share = np.clip((hits + others) / n, 0, 1)
    spread = np.sqrt(share * (1 - share) * np.square(weight * (truth - n_in / n)).sum())
    certain = np.flatnonzero(np.abs(hits - share * n_in) > CERTAIN * np.maximum(spread, LEAST_SPREAD))
    # Per row of the sample on either side, so that the half a hit added means as much as it does without weights.
    k_in, k_out = truth.sum(), len(truth) - truth.sum()
    hit, other = hits[certain] * (k_in / n_in), others[certain] * (k_out / (n - n_in))
    return certain, np.log((hit + 0.5) / (k_in + 1)) - np.log((other + 0.5) / (k_out + 1))


def fit_linear(
    rows: Rows, truth: np.ndarray, rounds: int = 100, rate: float = 0.15, shrink: float = 1e-4, weight: np.ndarray | None = None
) -> Linear:
    """Logistic regression on the telling features, scaled by their likelihood ratios, by adaptive gradient descent.

    A row of weight 2 counts as two rows; without ``weight`` all count alike.
    """
    model = Linear(np.zeros(BUCKETS), np.zeros(rows.extra.shape[1]), 0.0)
    weight = np.ones(len(truth)) if weight is None else weight / weight.mean() if len(weight) else weight
    share = float(np.average(truth, weights=weight)) if truth.any() and not truth.all() else float(truth.any())
    if share in (0.0, 1.0):
        model.bias = 12.0 if share else -12.0
        return model
    used, scale = telling(rows, truth, weight)
    number = np.full(BUCKETS, -1)
    number[used] = np.arange(len(used))
    held = number[rows.at] >= 0
    owner, at = rows.owner()[held], number[rows.at[held]]
    weights, dense, bias = np.full(len(used), 0.1), model.dense, float(np.log(share / (1 - share)))
    sums, seen = np.full(len(used), 1e-8), np.full(len(dense) + 1, 1e-8)
    for _ in range(rounds):
        score = np.bincount(owner, (weights * scale)[at], len(truth)) + rows.extra @ dense + bias
        error = weight * (1 / (1 + np.exp(-np.clip(score, -40, 40))) - truth) / len(truth)
        step = np.bincount(at, error[owner], len(used)) * scale + shrink * weights
        sums += step * step
        weights = weights - rate * step / np.sqrt(sums)
        rest = np.append(error @ rows.extra, error.sum())
        seen += rest * rest
        change = rate * rest / np.sqrt(seen)
        dense, bias = dense - change[:-1], bias - float(change[-1])
    model.weights[used], model.dense, model.bias = weights * scale, dense, bias
    return model


@dataclass
class Chain:
    """Models by category in their order; each has the probabilities of the earlier ones as dense columns."""

    categories: list[str]
    models: list[Linear]

    def probabilities(self, rows: Rows) -> np.ndarray:
        known = np.empty((len(rows.sizes), 0))
        for model in self.models:
            known = np.column_stack([known, model.probability(Rows(rows.at, rows.sizes, known))])
        return known


def fit_chain(
    rows: Rows, truth: np.ndarray, categories: list[str], folds: int = FOLDS, weight: np.ndarray | None = None
) -> Chain:
    """A chain on rows of features, their 0/1 ``truth`` by category and, if they count unequally, their ``weight``.

    What a later model is trained with are the out-of-fold probabilities of the earlier ones: each row's come from
    models that have not seen the row, so that they are as good as they will be on new texts.
    """
    n = len(rows.sizes)
    fold, known = np.arange(n) % folds, np.empty((n, 0))
    weight = np.ones(n) if weight is None else weight
    models = []
    for i in range(len(categories)):
        now = Rows(rows.at, rows.sizes, known)
        models.append(fit_linear(now, truth[:, i], weight=weight))
        if i + 1 < len(categories):
            apart = np.zeros(n)
            for f in range(folds):
                inside, outside = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
                apart[outside] = fit_linear(now.take(inside), truth[inside, i], weight=weight[inside]).probability(now.take(outside))
            known = np.column_stack([known, apart])
    return Chain(categories, models)


def train(docs: DataFrame, labels: DataFrame, categories: list[str], sample: int = SAMPLE) -> Chain | None:
    """The chain learned from labelled documents; None if there are none.

    Of each combination of labels the rows with the smallest hashed ids are taken, ``sample`` in all at most. A row
    weighs as much as the labelled rows it stands for, so that probabilities follow the labels' own shares whatever the
    size of the table. Labels that are null are 0; where rows of ``labels`` contradict each other for a document the larger label counts.
    """
    asked = [F.max(F.coalesce(F.col(c).cast("int"), F.lit(0))).alias(f"is_{i}") for i, c in enumerate(categories)]
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), *categories).where("doc_id is not null").groupBy("doc_id").agg(*asked)
    names = [f"is_{i}" for i in range(len(categories))]
    each = max(1, sample // 2 ** len(categories))
    # Hashes are spread evenly, so the smallest of a combination lie below a bound that follows from its number of rows:
    # only about twice as many rows as are wanted are ranked in one place. Their number is fixed.
    hashed = known.withColumn("h", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)))
    sizes = hashed.groupBy(*names).agg(
        (F.lit(2.0 * each) / F.count(F.lit(1)) * (1 << 40)).alias("bound"),
        F.greatest(F.count(F.lit(1)) / F.lit(each), F.lit(1.0)).alias("weight"),
    )
    near = hashed.join(F.broadcast(sizes), names).where("h <= bound")
    ranked = near.withColumn("k", F.row_number().over(Window.partitionBy(*names).orderBy("h", "doc_id")))
    chosen = ranked.where(F.col("k") <= each).select("doc_id", "weight", *names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [features(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(held, pa.list_(pa.int32()))], ["h", "weight", *names, "features"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = texts.join(F.broadcast(staged(chosen, "chosen")), "doc_id").select("doc_id", "text", F.xxhash64("text", "doc_id").alias("h"), "weight", *names)
    fields = ", ".join(f"{n} int" for n in names)
    held = in_tasks(rows, run, f"h long, weight double, {fields}, features array<int>").toArrow().combine_chunks()
    if not held.num_rows:
        return None
    # Whatever order the tasks end in, the rows are the same: hashed, so that the folds are alike.
    held = held.take(pa.array(np.argsort(held.column("h").to_numpy(), kind="stable")))
    found = held.column("features").combine_chunks()
    sample = Rows(found.flatten().to_numpy(), found.value_lengths().to_numpy().astype(np.int64), np.empty((held.num_rows, 0)))
    truth = np.stack([np.clip(held.column(n).to_numpy(), 0, 1) for n in names], axis=1).astype(np.float64)
    return fit_chain(sample, truth, categories, weight=held.column("weight").to_numpy())


def scored(docs: DataFrame, chain: Chain | None, categories: list[str], threshold: float) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``p_<category>`` and whether it is over ``threshold``, by category."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = part.column(1).to_pylist()
                rows = Rows.of([features(t) for t in texts])
                found = shared.value.probabilities(rows) if shared.value else np.zeros((len(texts), len(categories)))
                # A text without words says nothing.
                found[rows.sizes == 0] = 0.0
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(p) for p in found.T), *(pa.array(p > threshold) for p in found.T)], names
                )

    names = ["doc_id", *(f"p_{c}" for c in categories), *(f"is_{c}" for c in categories)]
    kinds = ", ".join(["doc_id long", *(f"`p_{c}` double" for c in categories), *(f"`is_{c}` boolean" for c in categories)])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return in_tasks(rows, run, kinds)


def classify(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...], threshold: float = 0.5) -> DataFrame:
    """Every row of ``docs`` with the probability of each category and whether it holds.

    The chain goes through ``categories``, 0/1 columns of ``labels``, in their order. Whole texts are judged. A null or
    wordless text has probability zero throughout, and so has every text if no document is labelled; repeated rows get
    equal results, rows with a null doc_id are judged but not learned from.
    """
    names = list(categories)
    return scored(docs, train(docs, labels, names), names, threshold)


def op9_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    graded = labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), F.col("toxic").alias("toxic"))
    found = classify(docs, graded, ("low_quality", "toxic"))
    return found.select(
        "doc_id", F.col("p_low_quality").alias("low_quality_score"), F.col("p_toxic").alias("toxic_score"), F.col("is_toxic").alias("toxic")
    )
