"""Quality scores by Bradley-Terry pairwise ranking (operator 9).

A preference pair is a better and a worse text.  ``fit`` learns weights of text features by the
logistic loss on feature differences, P(a beats b) = sigmoid(w . (x_a - x_b)), over all pairs of a good
and another labelled text; the cut between good and poor is a quantile of the scores of all labelled
texts.  ``score`` is one pass over whole texts, without a shuffle.

No text and no pair is left out.  The pairs are not listed: in each round Spark counts the labelled texts and sums their
features by class and by score in steps of ``1 / BINS``, and the loss over all pairs follows from these groups, as if each
text had its group's mean score, which it differs from by less than a step.  The driver gets groups alone, and the cut is the exact
value at its rank.

Null and empty texts have all features zero and get the score that follows from them;
with labels of one class only, every score is 0.5.  Repeated rows score alike; other columns pass
through, and an existing ``score`` column is replaced; empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stackloom.checkpoints import cut, drop
from stackloom.llm import _sample
from stackloom.llm._words import blocks, filled, freed, mix, tidied

#: Groups of scores for each unit of the score; rounds at most, the gain of a round under which they end; weight of the penalty.
BINS = 32
ROUNDS = 25
LEAST_GAIN = 1e-7
PENALTY = 1e-3
#: Parts of a range of scores in the search of the cut.
PARTS = 4096
_SYMBOLS = b"!#$%&*|/\\<>=+_~^@{}[]()\"':;,.?-"
_CLASS = np.full(256, 4, np.uint8)  # other bytes
_CLASS[[9, 11, 12, 13, 32]] = 0
_CLASS[10] = 1
_CLASS[48:58] = 2
_CLASS[65:91] = 3
_CLASS[97:123] = 5
_CLASS[128:] = 6
for _k, _b in enumerate(_SYMBOLS):
    _CLASS[_b] = 7 + _k
_N_CLASSES = 7 + len(_SYMBOLS)
WIDTH = _N_CLASSES + 7


def features(column: pa.Array) -> np.ndarray:
    """Rates of kinds of bytes, word lengths, repetition and size of each text."""
    out = []
    for at, to, w in blocks(filled(column), lower=True):
        n = to - at
        kinds = _CLASS[w.data]
        rows = np.repeat(np.arange(n), w.bytes)
        count = np.bincount(rows * _N_CLASSES + kinds, minlength=n * _N_CLASSES).reshape(n, _N_CLASSES)
        size = np.maximum(w.bytes, 1)[:, None]
        n_words = np.maximum(np.diff(w.first), 1)
        distinct = np.unique(mix(w.hash ^ (w.row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))), return_index=True)[1]
        variety = np.bincount(w.row[distinct], minlength=n) / n_words
        pairs, pair_hash = w.windows(3)
        distinct = np.unique(mix(pair_hash ^ (w.row[pairs].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))), return_index=True)[1]
        triples = np.maximum(np.bincount(w.row[pairs], minlength=n), 1)
        fresh = np.bincount(w.row[pairs[distinct]], minlength=n) / triples
        letters = np.maximum(count[:, 3] + count[:, 5], 1)
        length = np.bincount(w.row, w.end - w.start, n) / n_words
        extra = [count[:, 3] / letters, np.log1p(n_words), length, variety, variety * np.sqrt(n_words), fresh, n_words < 20]
        out.append(np.column_stack([np.log1p(1000 * count / size), *extra]))
    return np.concatenate(out) if out else np.empty((0, WIDTH))


@dataclass
class Model:
    weight: np.ndarray
    center: np.ndarray
    cut: float
    scale: float

    def ranks(self, x: np.ndarray) -> np.ndarray:
        """Scores before cut and scale; summed row by row, so that a text has the same one in any batch."""
        return ((x - self.center) * self.weight).sum(1)

    def scores(self, column: pa.Array) -> np.ndarray:
        z = self.ranks(features(column)) - self.cut
        return 1 / (1 + np.exp(-np.clip(z * self.scale, -700, 700)))


def _text_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            rows = [x.tobytes() for x in features(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["doc_id", "found"])


def _matrix(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Classes and features of rows (good, found)."""
    x = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.float64).reshape(-1, WIDTH)
    return batch.column(0).to_numpy(zero_copy_only=False).astype(bool), x


_SUMS = [f"x{k}" for k in range(WIDTH)]


def _summed(found: DataFrame, groups: Callable[[np.ndarray], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]]) -> dict[bool, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By class: places, counts and sums of ``groups``, which gives those of one class's features in a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, x = _matrix(batch)
            for kind in (True, False):
                place, n, sums = groups(x[good == kind])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(place), kind)), pa.array(place, pa.int64()), pa.array(n, pa.int64()), *map(pa.array, sums.T.copy())], names=["good", "place", "n", *_SUMS])

    schema = "good boolean, place long, n long, " + ", ".join(f"{c} double" for c in _SUMS)
    rows = found.mapInArrow(tidied(run), schema).groupBy("good", "place").agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in _SUMS))
    told = rows.orderBy("good", "place").toArrow()
    good, place, n, *sums = (c.to_numpy() for c in told.columns)
    out = np.column_stack(sums)
    return {kind: (place[good == kind], n[good == kind], out[good == kind]) for kind in (True, False)}


def _moments(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sum of the features at place -1, and of their products with the k-th feature at place k."""
    return np.arange(-1, WIDTH), np.full(WIDTH + 1, len(x)), np.vstack([x.sum(0), x.T @ x])


def _by_score(w: np.ndarray, center: np.ndarray, spread: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = (x - center) / spread
    place = np.floor(x @ w * BINS).astype(np.int64)
    order = np.argsort(place, kind="stable")
    places, first, n = np.unique(place[order], return_index=True, return_counts=True)
    return places, n, np.add.reduceat(x[order], first) if len(x) else np.empty((0, WIDTH))


def _pairs(groups: dict[bool, tuple[np.ndarray, np.ndarray, np.ndarray]], w: np.ndarray, covariance: dict[bool, np.ndarray]) -> tuple[float, np.ndarray, np.ndarray]:
    """Loss over all pairs, its gradient, and its curvature, for which texts scatter alike in all groups of a class."""
    (n_good, good), (n_bad, bad) = ((n / n.sum(), sums / n[:, None]) for _, n, sums in (groups[True], groups[False]))
    loss, grad, bend = PENALTY / 2 * (w @ w), PENALTY * w, PENALTY * np.eye(WIDTH)
    steep = {True: np.zeros(len(n_good)), False: np.zeros(len(n_bad))}
    z_bad = bad @ w
    for at in range(0, len(n_good), 256):
        part = slice(at, at + 256)
        d = np.clip((good[part] @ w)[:, None] - z_bad, -500, 500)
        share = n_good[part, None] * n_bad
        loss += (share * np.logaddexp(0, -d)).sum()
        p = share / (1 + np.exp(d))
        slope = p / (1 + np.exp(-d))
        grad = grad - p.sum(1) @ good[part] + p.sum(0) @ bad
        steep[True][part] = slope.sum(1)
        steep[False] += slope.sum(0)
        cross = good[part].T @ slope @ bad
        bend = bend - cross - cross.T
    for kind, share, mean in ((True, n_good, good), (False, n_bad, bad)):
        inside = covariance[kind] - (mean * share[:, None]).T @ mean + np.outer(share @ mean, share @ mean)
        bend = bend + (mean * steep[kind][:, None]).T @ mean + steep[kind].sum() * inside
    return float(loss), grad, bend


def _at_rank(z: DataFrame, rank: int, low: float, high: float) -> tuple[float, float]:
    """The values of ``z(z)``, all in [low, high], at the place ``rank`` from 0 and at the next one; high behind the last."""
    behind = high
    while low < high:
        part = F.least(F.floor((F.col("z") - low) / ((high - low) / PARTS)), F.lit(PARTS - 1))
        parts = z.filter(F.col("z").between(low, high)).groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.min("z").alias("low"), F.max("z").alias("high"))
        rows = sorted(parts.collect())  # PARTS at most
        k = 0
        while rank >= rows[k]["n"]:
            rank -= rows[k]["n"]
            k += 1
        low, high = rows[k]["low"], rows[k]["high"]
        behind = rows[k + 1]["low"] if k + 1 < len(rows) else behind
        if rank == rows[k]["n"] - 1:
            return high, behind
    return low, low


def fit(docs: DataFrame, ranked: DataFrame) -> Model:
    """Learns from the texts of ``docs(doc_id, text)`` and ``ranked(doc_id, good boolean)``: each good text beats each other."""
    known = ranked.select(F.col("doc_id").cast("long"), "good").filter("doc_id is not null and good is not null").distinct()
    texts = docs.select(F.col("doc_id").cast("long"), "text").filter("doc_id is not null")
    # Features are joined, as they are shorter than texts.
    made = texts.mapInArrow(tidied(_text_features), T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("found", T.BinaryType())]))
    found = cut(made.join(known, "doc_id").select("good", "found"))
    count = {r["good"]: r["count"] for r in found.groupBy("good").count().collect()}
    if len(count) < 2:
        drop(found)
        return Model(np.zeros(WIDTH), np.zeros(WIDTH), 0.0, 1.0)
    model = _fitted(found, count)
    drop(found)
    freed()
    return model


def _fitted(found: DataFrame, count: dict[bool, int]) -> Model:
    moments = {kind: sums for kind, (_, _, sums) in _summed(found, _moments).items()}
    total, both = sum(count.values()), moments[True] + moments[False]
    center = both[0] / total
    spread = np.sqrt(np.maximum(np.diag(both[1:]) / total - center**2, 0)) + 1e-6
    mean = {kind: m[0] / count[kind] for kind, m in moments.items()}
    covariance = {kind: (m[1:] / count[kind] - np.outer(mean[kind], mean[kind])) / np.outer(spread, spread) for kind, m in moments.items()}

    def told(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        return _pairs(_summed(found, lambda x: _by_score(w, center, spread, x)), w, covariance)

    w = np.zeros(WIDTH)
    loss, grad, bend = told(w)
    for _ in range(ROUNDS):
        move = -np.linalg.solve(bend, grad)
        if -(grad @ move) < LEAST_GAIN:
            break
        # Half the way where the whole one goes too far.
        after = told(w + move)
        while after[0] > loss + LEAST_GAIN and np.abs(move).max() > 1e-6:
            move = move / 2
            after = told(w + move)
        w, (loss, grad, bend) = w + move, after
    model = Model(w / spread, center, 0.0, 1.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(model.ranks(_matrix(batch)[1]), pa.float64())], names=["z"])

    z = cut(found.mapInArrow(tidied(run), "z double"))
    low, high, deviation = z.agg(F.min("z"), F.max("z"), F.stddev_pop("z")).first()
    # As many labelled texts are below the cut as are poor.
    below, above = _at_rank(z, count[False] - 1, low, high)
    drop(z)
    return Model(model.weight, center, (below + above) / 2, float(1 / (deviation + 1e-9)))


def score(df: DataFrame, model: Model, text: str = "text", column: str = "score") -> DataFrame:
    """Adds the quality score of the whole text."""
    names = [c for c in df.columns if c != column]
    schema = T.StructType([df.schema[c] for c in names] + [T.StructField(column, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array(model.scores(batch.column(text)), pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), made], names=[*names, column])

    return df.mapInArrow(tidied(run), schema)


def from_labels(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1) -> Model:
    """A model from ``labels(doc_id, quality)`` of all rows outside the held-out fold."""
    usable = (_sample.bucket(F.col("doc_id"), folds) != held_out) & F.col("doc_id").isNotNull()
    known = labels.filter(usable & F.col("quality").isNotNull())
    return fit(docs.filter(usable), known.select("doc_id", (F.col("quality") == 1).alias("good")))
