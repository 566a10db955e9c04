"""Exact top-k search by inner product over a pivot-distance index (operator 13).

A vector's components become whole numbers, floor(``SCALE`` * x).  Each vector is keyed by its nearest
pivot and its distance to it; the pivots are at most ``PIVOTS`` vectors in the order of a hash of their
ids.  A pivot's vectors, sorted by distance, are cut into annuli of ``rows_of(n)`` rows; an annulus of
equal distances that is larger is split by a hash of the ids.

With d(q, p) the distance of query and pivot, an annulus from ``low`` to ``high`` is no nearer to the query
than the gap between d(q, p) and [low, high], by the triangle inequality.  So no vector x in it has a
product above (|q|² + max|x|² - gap²) / 2.  A query opens its annuli in descending order of this
bound, ``GROWTH`` times as many each round, and stops at the first whose bound is below its k-th best score.
Where the bounds exclude little (as with directions spread evenly in many dimensions) all annuli are opened,
so the result is exact in any case.

Of a round, only annuli that some query opens are shuffled, once for each ``SLICE`` queries of the whole
table, and each query once for each annulus it opens.  A task holds one annulus; queries stream past it.
The driver sees counts of ``PIVOTS * RINGS`` cells and the annuli made of them, ``PIVOTS * RINGS + n /
rows_of(n)`` at most.

Vectors that are null, empty, of another length than most, or hold null or non-finite components (also
after scaling) take no part, nor do rows without an id.  The rows of one id count as one vector that
has the best of their scores, and are no candidates for their own id.  Scores are exact; one beyond 64 bits becomes
the nearest 64-bit number.  Other columns are ignored; an empty table or no queries give an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stackloom.checkpoints import cut, drop
from stackloom.llm._words import tidied

SCALE = 64.0
PIVOTS = 256
RINGS = 64
GROWTH = 8
SLICE = 200_000
#: Scores that a task holds at a time, and rows that are keyed at a time.
SCORES = 2_000_000
BLOCK = 1024
#: Sums of products up to here are exact in doubles.
EXACT = 2.0**52
#: Distances and bounds are computed in doubles; bounds are widened by this share.
SLACK = 1e-9
FOUND = "query_id long, vec_id long, score long"


def pivots_of(n: int) -> int:
    return max(1, min(PIVOTS, ceil(sqrt(n) / 32)))


def rows_of(n: int) -> int:
    """Rows of an annulus."""
    return max(1024, min(131_072, ceil(16 * sqrt(n))))


def whole(column: pa.Array, dim: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return np.floor(SCALE * x)


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Euclidean distance of every row to every pivot, without the cancellation of squares; infinite beyond doubles."""
    with np.errstate(over="ignore"):
        return np.sqrt(np.stack([np.square(x - p).sum(axis=1) for p in pivots], axis=1))


def lengths(x: np.ndarray) -> np.ndarray:
    """Squared lengths of the rows."""
    with np.errstate(over="ignore"):
        return np.square(x).sum(axis=1)


@dataclass
class Annuli:
    """Pivot, distances and largest squared length of every annulus."""

    pivots: np.ndarray
    pivot: np.ndarray
    low: np.ndarray
    high: np.ndarray
    length: np.ndarray

    def bounds(self, x: np.ndarray) -> np.ndarray:
        """For each query (row of ``x``) and annulus, a number that no score exceeds."""
        d = distances(x, self.pivots)[:, self.pivot]
        both = lengths(x)[:, None] + self.length
        with np.errstate(over="ignore", invalid="ignore"):
            gap = np.maximum(np.maximum(self.low - d, d - self.high) - SLACK * (d + self.high), 0)
            bound = (both - np.square(gap)) / 2 + SLACK * both + 1
        return np.where(np.isfinite(bound), bound, np.inf)


def annuli_of(cells: list, pivots: np.ndarray, rows: int) -> tuple[Annuli, list[tuple[int, int, int, int]]]:
    """Annuli of about ``rows`` rows from the counted ``cells``, and (pivot, ring, first annulus, parts) of each cell.

    Rings of one pivot are joined in the order of distance; a ring above ``rows`` is split into parts, annuli of
    the same bounds.
    """
    made: list[list[float]] = []
    places: list[tuple[int, int, int, int]] = []
    held = 0
    for cell in sorted(cells, key=lambda c: (c.pivot, c.ring)):
        bounds = [cell.pivot, cell.low, cell.high, cell.length]
        parts = -(-cell.n // rows)
        if parts == 1 and made and made[-1][0] == cell.pivot and held + cell.n <= rows:
            made[-1][2:] = cell.high, max(made[-1][3], cell.length)
            held += cell.n
        else:
            made += [list(bounds) for _ in range(parts)]
            held = cell.n if parts == 1 else rows
        places.append((cell.pivot, cell.ring, len(made) - parts, parts))
    columns = np.array(made, float).reshape(-1, 4).T
    return Annuli(pivots, columns[0].astype(int), *columns[1:]), places


def _keyed(pivots: np.ndarray):
    dim = pivots.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                x = whole(part.column("vector"), dim)
                d = distances(x, pivots)
                near = d.argmin(axis=1)
                made = [pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(d)), near]), pa.array(lengths(x))]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*part.schema.names, "pivot", "distance", "length"])

    return run


def _opened(annuli: Annuli, first: int, end: int, dim: int):
    """(annulus, id, vector, least) of the annuli that each query opens in the places [first, end) of its order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, SCORES // len(annuli.pivot))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                bound = annuli.bounds(whole(part.column("vector"), dim))
                order = np.argsort(-bound, axis=1, kind="stable")[:, first:end]
                least = part.column("least").to_numpy(zero_copy_only=False)
                query, place = np.nonzero(np.take_along_axis(bound, order, 1) >= least[:, None])
                taken = part.take(pa.array(query))
                yield pa.RecordBatch.from_arrays([pa.array(order[query, place].astype(np.int32)), *taken.columns], names=["annulus", *part.schema.names])

    return run


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-numbered rows."""
    if np.sqrt(lengths(q).max()) * np.sqrt(lengths(x).max()) < EXACT:
        return q @ x.T
    exact = lambda m: np.array([[int(v) for v in row] for row in m], dtype=object)
    return np.clip(exact(q) @ exact(x).T, -(1 << 63), (1 << 63) - 1)


def best(query: np.ndarray, q: np.ndarray, least: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of each query's k best rows with scores of ``least`` or more, ties to smaller ids.

    ``ids`` ascend; rows of one id count as one.
    """
    first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    scores = products(q, x)
    if len(first) < len(ids):
        scores, ids = np.maximum.reduceat(scores, first, axis=1), ids[first]
    own = np.minimum(np.searchsorted(ids, query), len(ids) - 1)
    valid = np.ones(scores.shape, bool)
    valid[np.arange(len(query)), own] = ids[own] != query
    if scores.dtype != object:
        scores[~valid] = -np.inf
        if len(ids) > k:
            least = np.maximum(least, np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k])
    row, at = np.nonzero(valid & (scores >= least[:, None]))
    score = scores[row, at]
    order = sorted(range(len(row)), key=lambda i: (row[i], -score[i], at[i])) if score.dtype == object else np.lexsort((at, -score, row))
    row, at, score = row[order], at[order], score[order]
    start = np.searchsorted(row, row)
    kept = np.arange(len(row)) - start < k
    return query[row[kept]], ids[at[kept]], score[kept].astype(np.int64)


def _searched(dim: int, k: int):
    """Rows come sorted by annulus and slice, vectors (side 0, by id) before queries (side 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, xs = None, [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in ("annulus", "slice", "side")], 1)
            edges = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(keys)]):
                part = batch.slice(a, b - a)
                mine, side = tuple(keys[a, :2]), keys[a, 2]
                if mine != key:
                    key, ids, xs = mine, [], []
                if side == 0:
                    ids.append(part.column("id").to_numpy())
                    xs.append(whole(part.column("vector"), dim))
                elif ids:
                    if len(ids) > 1:
                        ids, xs = [np.concatenate(ids)], [np.concatenate(xs)]
                    step = max(1, SCORES // len(ids[0]))
                    for at in range(0, part.num_rows, step):
                        some = part.slice(at, step)
                        out = best(some.column("id").to_numpy(), whole(some.column("vector"), dim), some.column("least").to_numpy(zero_copy_only=False), ids[0], xs[0], k)
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], names=["query_id", "vec_id", "score"])

    return run


def usable(table: DataFrame) -> DataFrame:
    """(id, vector) of the rows that take part, whatever their length."""
    rows = table.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("vector"))
    odd = F.exists("vector", lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double") * SCALE) == float("inf")))
    return rows.filter(F.col("id").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0) & ~F.coalesce(odd, F.lit(True)))


def _ranked(found: DataFrame, k: int) -> DataFrame:
    one = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return one.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(table: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of ``table`` with the highest products with each row of ``queries``.

    Both have ``vec_id`` and ``embedding``.
    """
    spark = table.sparkSession
    rows = usable(table)
    common = rows.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if common is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dim, n = common.dim, common["count"]
    rows = rows.filter(F.size("vector") == dim)
    sample = rows.orderBy(F.xxhash64("id"), "id", "vector").limit(pivots_of(n)).toArrow().combine_chunks()
    pivots = np.unique(whole(sample.column("vector").combine_chunks(), dim), axis=0)
    kind = table.schema["embedding"].dataType.simpleString()
    keyed = cut(rows.mapInArrow(_keyed(pivots), f"id long, vector {kind}, pivot int, distance double, length double"))
    far = keyed.filter(F.col("distance") < float("inf")).agg(F.max("distance")).first()[0] or 1.0
    ring = F.floor(F.least("distance", F.lit(far)) * (RINGS / far)).cast("int")
    cells = keyed.groupBy("pivot", ring.alias("ring")).agg(F.count("*").alias("n"), F.min("distance").alias("low"), F.max("distance").alias("high"), F.max("length").alias("length"))
    # Rows of ``cells``: PIVOTS * (RINGS + 1) at most.
    annuli, places = annuli_of(cells.collect(), pivots, rows_of(n))
    places = F.broadcast(spark.createDataFrame(places, "pivot int, ring int, base int, parts int"))
    placed = keyed.withColumn("ring", ring).join(places, ["pivot", "ring"])
    placed = placed.select((F.col("base") + F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int").alias("annulus"), "id", "vector")
    asked = cut(usable(queries).filter(F.size("vector") == dim))
    slices = max(1, -(-asked.count() // SLICE))
    of_slice = F.pmod(F.xxhash64("id"), F.lit(slices)).cast("int")
    found: DataFrame | None = None
    first, size = 0, 1
    columns = ["annulus", "slice", "side", "id", "vector", "least"]
    keys = ["annulus", "slice", "side", "id"]
    while first < len(annuli.pivot):
        if found is None:
            state = asked.withColumn("least", F.lit(float("-inf")))
        else:
            least = found.groupBy(F.col("query_id").alias("id")).agg(F.when(F.count("*") >= k, F.min("score")).cast("double").alias("least"))
            least = least.withColumn("least", F.col("least") - F.abs("least") * SLACK)  # doubles round large scores
            state = asked.join(least, "id", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
        opened = state.select("id", "vector", "least").mapInArrow(_opened(annuli, first, first + size, dim), f"annulus int, id long, vector {kind}, least double")
        needed = [r.annulus for r in opened.select("annulus").distinct().collect()]
        if not needed:
            break
        table_side = placed if len(needed) == len(annuli.pivot) else placed.join(F.broadcast(spark.createDataFrame([(a,) for a in needed], "annulus int")), "annulus", "left_semi")
        table_side = table_side.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))).withColumns({"side": F.lit(0), "least": F.lit(0.0)})
        met = table_side.select(*columns).union(opened.withColumns({"slice": of_slice, "side": F.lit(1)}).select(*columns))
        met = met.repartition("annulus", "slice").sortWithinPartitions(*keys)
        new = met.mapInArrow(tidied(_searched(dim, k)), FOUND)
        before = found
        found = cut(_ranked(new if before is None else new.union(before.select("query_id", "vec_id", "score")), k))
        if before is not None:
            drop(before)
        first, size = first + size, size * GROWTH
    drop(keyed, asked)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return found.select("query_id", "rank", "vec_id", "score")


#: DuckDB SQL that scores every query against all rows.
SQL = """
WITH pv_rows AS (
  SELECT vec_id, CAST(list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS DOUBLE[64]) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pv_scores AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(array_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM pv_rows q JOIN pv_rows c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), pv_ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM pv_scores
)
SELECT query_id, rank, vec_id, score FROM pv_ranked WHERE rank <= 20
"""
