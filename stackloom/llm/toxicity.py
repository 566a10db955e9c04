"""Toxicity scores by non-negative positive-unlabelled learning (operator 8).

``fit`` learns a linear classifier with numpy from confirmed toxic texts and unlabelled texts.  The
risk is pi * R+(positives) + max(0, R-(unlabelled) - pi * R-(positives)) with the sigmoid loss; where
the second part turns negative, the step goes the other way, as negative risk means overfitting.
The class prior pi is a parameter.  ``score`` is one pass over whole texts, without a shuffle.

Features are hashed lower-case words and word prefixes, counted once a text; only those that are
clearly commoner among positives than in unlabelled text get a weight, never below zero, so that much harmless text
around a toxic passage does not hide it.  The fit uses
``MAX_POSITIVE`` positives and ``MAX_UNLABELLED`` unlabelled texts at most, picked by a hash of the id;
every row is scored.  Spark counts the features of these texts; the driver gets one count for each of the
``2**BITS`` features at most, and of the texts the chosen features alone.

``from_labels`` takes the share of label 1 among the labels outside the held-out fold as prior, kept
between ``LEAST_PRIOR`` and ``MOST_PRIOR``, so that few labels of one kind alone give a model as well.

Null and empty texts have no features and score the bias alone (in 0..1, below 0.5 for a prior below
a half); with no positives every score is 0.  Repeated rows score alike; other columns pass through,
and an existing ``score`` column is replaced; empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stackloom.checkpoints import cut, drop
from stackloom.llm import _sample
from stackloom.llm._words import Words, blocks, byte_spans, freed, tidied

MAX_POSITIVE = 1500
MAX_UNLABELLED = 6000
BITS = 18
MIN_LIFT = 2.0
LEAST_PRIOR, MOST_PRIOR = 1e-3, 0.5
PREFIXES = (4, 5, 6)


def features(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of every word and long enough prefix, with repeats."""
    shift = np.uint64(64 - BITS)
    rows, found = [w.row], [w.hash >> shift]
    for n in PREFIXES:
        long = np.flatnonzero(w.end - w.start > n)
        rows.append(w.row[long])
        found.append(byte_spans(w, w.start[long], w.start[long] + n) * np.uint64(2 * n + 1) >> shift)
    return np.concatenate(rows), np.concatenate(found).astype(np.int64)


def once(rows: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key = np.unique((rows.astype(np.int64) << BITS) | found)
    return key >> BITS, key & ((1 << BITS) - 1)


@dataclass
class Model:
    index: np.ndarray
    weight: np.ndarray
    bias: float

    def scores(self, column: pa.Array) -> np.ndarray:
        table = np.zeros(1 << BITS, np.float32)
        table[self.index] = self.weight
        out = np.full(len(column), self.bias)
        for at, to, w in blocks(column, lower=True, letters=True):
            rows, found = features(w)
            keep = np.flatnonzero(table[found])
            rows, found = once(rows[keep], found[keep])
            out[at:to] += np.bincount(rows, table[found], to - at)
        return 1 / (1 + np.exp(-np.clip(out, -700, 700)))


def chosen(count: np.ndarray, texts: tuple[int, int]) -> np.ndarray:
    """The features, sorted, that are clearly commoner among positives.

    ``count`` has a row for each of positives and unlabelled texts, ``texts`` is how many there are.
    """
    share = [(c + 0.5) / (n + 1) for c, n in zip(count, texts)]
    return np.flatnonzero((count[0] >= max(2, min(5, texts[0] // 20))) & (np.log(share[0] / share[1]) > MIN_LIFT))


def fit_arrays(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, steps: int = 150, rate: float = 0.1) -> Model:
    """Each text is an array of distinct features."""
    count = np.zeros((2, 1 << BITS), np.int64)
    for k, texts in enumerate((positive, unlabelled)):
        for x in texts:
            count[k, x] += 1
    return fit_chosen(chosen(count, (len(positive), len(unlabelled))), positive, unlabelled, prior, steps, rate)


def fit_chosen(index: np.ndarray, positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, steps: int = 150, rate: float = 0.1) -> Model:
    """Weights of the features ``index``; features of the texts that are not in it are passed over."""
    if not positive or not unlabelled:
        return Model(np.empty(0, np.int64), np.empty(0, np.float32), -745.0)
    place = np.full(1 << BITS, -1, np.int32)
    place[index] = np.arange(len(index), dtype=np.int32)

    def sparse(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
        cols = [c[c >= 0] for c in (place[x] for x in texts)]
        return np.repeat(np.arange(len(texts)), [len(c) for c in cols]), np.concatenate(cols), len(texts)

    sides = sparse(positive), sparse(unlabelled)
    weight, bias = np.zeros(len(index)), -1.0
    m, v = np.zeros(len(index) + 1), np.zeros(len(index) + 1)
    for step in range(1, steps + 1):
        z = [bias + np.bincount(r, weight[c], n) for r, c, n in sides]
        s = [1 / (1 + np.exp(-np.clip(x, -500, 500))) for x in z]  # loss as a negative; 1 - s as a positive
        slope = [x * (1 - x) for x in s]
        if s[1].mean() - prior * s[0].mean() >= 0:
            by = -2 * prior * slope[0] / len(slope[0]), slope[1] / len(slope[1])
        else:
            by = prior * slope[0] / len(slope[0]), -slope[1] / len(slope[1])
        g = np.zeros(len(index) + 1)
        for (r, c, _), x in zip(sides, by):
            g[:-1] += np.bincount(c, x[r], len(index))
            g[-1] += x.sum()
        g[:-1] += 1e-6 * weight
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        weight, bias = np.maximum(weight - move[:-1], 0), bias - move[-1]
    return Model(index, weight.astype(np.float32), float(bias))


def _text_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(positive, unlabelled, found) of rows (text, positive, unlabelled): the distinct features of each text."""
    for batch in batches:
        for at, to, w in blocks(batch.column(0), lower=True, letters=True):
            rows, found = once(*features(w))
            cut_at = np.searchsorted(rows, np.arange(to - at + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(cut_at), pa.array(found.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(1).slice(at, to - at), batch.column(2).slice(at, to - at), lists], names=["positive", "unlabelled", "found"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, positives, unlabelled): in how many texts of the partition, by kind."""
    count = np.zeros((2, 1 << BITS), np.int64)
    for batch in batches:
        found = batch.column(2)
        sizes = found.value_lengths().to_numpy(zero_copy_only=False)
        flat = found.flatten().to_numpy()
        for k in (0, 1):
            of_kind = np.repeat(batch.column(k).to_numpy(zero_copy_only=False).astype(bool), sizes)
            count[k] += np.bincount(flat[of_kind], minlength=1 << BITS)
    feature = np.flatnonzero(count.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(feature.astype(np.int32)), *(pa.array(c[feature]) for c in count)], names=["feature", "positives", "unlabelled"])


def fit(docs: DataFrame, positives: DataFrame, prior: float, usable: Column | None = None, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> Model:
    """Learns from the texts of ``docs(doc_id, text)`` named in ``positives(doc_id)`` and from unlabelled ones.

    ``usable`` is a condition on ``doc_id`` for the unlabelled texts.
    """
    good = _sample.spread(positives.select("doc_id").distinct(), max_positive).withColumn("positive", F.lit(True))
    pool = docs.select("doc_id").filter(usable if usable is not None else F.lit(True)).distinct()
    rest = _sample.spread(pool, max_unlabelled).withColumn("positive", F.lit(False))
    # Both samples are limited above, so what is broadcast has a fixed bound.
    ids = good.union(rest).groupBy("doc_id").agg(F.max("positive").alias("positive"), (F.count("*") > F.max("positive").cast("int")).alias("unlabelled"))
    texts = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text", "positive", "unlabelled")
    found = cut(texts.mapInArrow(tidied(_text_features), "positive boolean, unlabelled boolean, found array<int>"))
    kinds = found.agg(*(F.count_if(k) for k in ("positive", "unlabelled"))).first()
    count = np.zeros((2, 1 << BITS), np.int64)
    # One row a feature, 2**BITS at most.
    sums = found.mapInArrow(tidied(_counted), "feature int, positives long, unlabelled long").groupBy("feature").agg(F.sum("positives"), F.sum("unlabelled")).toArrow()
    for k in (0, 1):
        count[k, sums.column(0).to_numpy()] = sums.column(k + 1).to_numpy()
    index = chosen(count, tuple(kinds))

    def narrowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.zeros(1 << BITS, bool)
        wanted[index] = True
        for batch in batches:
            for kind, flag in enumerate(("positive", "unlabelled")):
                lists = batch.filter(batch.column(flag)).column("found")
                flat = lists.flatten().to_numpy()
                ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
                kept = np.concatenate([[0], np.cumsum(wanted[flat])])[np.concatenate([[0], ends]).astype(np.int64)]
                few = pa.ListArray.from_arrays(pa.array(kept.astype(np.int32)), pa.array(flat[wanted[flat]]))
                yield pa.RecordBatch.from_arrays([pa.array([kind] * len(few), pa.int32()), few], names=["kind", "found"])

    kept = found.mapInArrow(tidied(narrowed), "kind int, found array<int>").toArrow()
    positive, unlabelled = ([np.asarray(x, np.int64) for x in kept.filter(pc.equal(kept["kind"], k))["found"].to_pylist()] for k in (0, 1))
    drop(found)
    model = fit_chosen(index, positive, unlabelled, prior)
    del positive, unlabelled, count, sums, kept
    freed()
    return model


def score(df: DataFrame, model: Model, text: str = "text", column: str = "score") -> DataFrame:
    """Adds the probability-like toxicity score of the whole text."""
    names = [c for c in df.columns if c != column]
    schema = T.StructType([df.schema[c] for c in names] + [T.StructField(column, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array(model.scores(batch.column(text)), pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), made], names=[*names, column])

    return df.mapInArrow(tidied(run), schema)


def from_labels(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0) -> Model:
    """A model from ``labels(doc_id, toxic)`` of the rows outside the held-out fold.

    Only labels 1 name examples; all others are unlabelled text.  The prior is the share of label 1.
    """
    usable = _sample.bucket(F.col("doc_id"), folds) != held_out
    known = labels.filter(usable & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    prior = known.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0]
    return fit(docs, known.filter("toxic = 1"), min(max(prior or 0.0, LEAST_PRIOR), MOST_PRIOR), usable)
