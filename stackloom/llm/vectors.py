"""Near-duplicate vectors by collision counting on sorted projections (operator 10).

Vectors are linked if their cosine, in double precision, is at least ``COSINE``.  Equal vectors are
one class from the start.  Each of ``TABLES`` tables deals the classes into cells by the sides of a
few random planes; within a cell, the rows are sorted by each of ``PROJECTIONS`` random
one-dimensional projections, the same in all tables.  Around each query vector a window holds what
lies near it in that order, and a pair's collisions are the windows it shares.  Pairs with
``MIN_COLLISIONS`` collisions or more are verified by their exact cosine.

In many dimensions a window holds a large share of all vectors, so the planes make the candidates and
the projections' counts choose among them.  Window and count are calibrated: a pair at cosine ``COSINE`` differs in a projection by a normal
amount, and the count is the largest that such a pair reaches with probability 0.999.  The number of
planes follows the logarithm of the number of classes, so cells stay small, and the number of tables
is what then keeps recall at ``RECALL``.  None of it needs a sample or an index of vectors.

As the count depends on the pair alone, a pair is counted in the first table whose cell it shares, and
nowhere else.  So links are summed, and cells pass on only spanning trees of their links: dense groups
are never expanded into pairs.  Cells with more than ``CELL_ROWS`` rows are split into parts, and
every two parts meet in a task of their own.  A vector is shuffled once a table, as it is stored, with its
cells of the tables before; a cell's parts are told by a join that is a broadcast only where Spark
knows the list of large cells to be small.

Equal vectors are told by two 64-bit hashes.  Vectors that are null, empty, zero, of another length than most, or hold null or non-finite components
link with nothing, and are their own component.  Rows without an id link with nothing and are kept.
Repeated rows of one id and vector count as one vector; extra columns are ignored; an empty table gives
an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, comb, erf, log, log2, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackloom.checkpoints import cut, drop
from stackloom.llm._jobs import components, hot_keys, spread_join
from stackloom.llm._trees import joined

COSINE = 0.95
RECALL = 0.995
PROJECTIONS = 8
WINDOW_SIGMAS = 2.0
CELL = 64
CELL_ROWS = 4000
BLOCK = 512
PAIRS = 1_000_000


def min_collisions(reached: float = 0.999) -> int:
    """The largest count that a pair at the threshold reaches with probability ``reached``."""
    p = erf(WINDOW_SIGMAS / sqrt(2))
    tail = 0.0
    for count in range(PROJECTIONS, -1, -1):
        tail += comb(PROJECTIONS, count) * p**count * (1 - p) ** (PROJECTIONS - count)
        if tail >= reached:
            return count
    return 0


def design(n: int, cosine: float = COSINE) -> tuple[int, int]:
    """(planes, tables) for ``n`` classes."""
    planes = max(0, ceil(log2(max(n, 1) / CELL)))
    stay = (1 - acos(cosine) / pi) ** planes
    return planes, 1 if planes == 0 else ceil(log(1 - RECALL) / log(1 - stay))


def planes_of(dim: int, planes: int, tables: int) -> np.ndarray:
    return np.random.default_rng(1234).standard_normal((dim, planes * tables))


def projections_of(dim: int) -> np.ndarray:
    x = np.random.default_rng(4321).standard_normal((dim, PROJECTIONS))
    return x / np.linalg.norm(x, axis=0)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _cells(dim: int, planes: int, tables: int):
    normals = planes_of(dim, planes, tables)
    weight = 1 << np.arange(planes, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                n = part.num_rows
                sides = unit(_matrix(part.column("vector"), dim)) @ normals > 0
                cells = sides.reshape(n, tables, planes) @ weight
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * tables), pa.array(cells.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], names=[*part.schema.names, "cells"])

    return run


def collisions(p: np.ndarray, window: float) -> np.ndarray:
    """How many of the projections (columns of ``p``) have each two rows in one window, as a flat upper triangle.

    Each projection is sorted; the window centred on a query holds the rows up to ``window`` before and
    behind it, and each pair is met once, from its earlier end.
    """
    n = len(p)
    count = np.zeros(n * n, np.int8)
    for k in range(p.shape[1]):
        order = np.argsort(p[:, k], kind="stable")
        value = p[order, k]
        width = np.searchsorted(value, value + window, side="right") - np.arange(n) - 1
        total = np.cumsum(width)
        at = 0
        while at < n:
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, side="right")))
            rank = np.repeat(np.arange(at, to), width[at:to])
            step = np.arange(len(rank)) - np.repeat(np.cumsum(width[at:to]) - width[at:to], width[at:to])
            u, v = order[rank], order[rank + 1 + step]
            count[np.minimum(u, v) * n + np.maximum(u, v)] += 1
            at = to
    return count


def _link_rows(ids: np.ndarray, weight: np.ndarray, x: np.ndarray, cells: np.ndarray, table: int, part: np.ndarray, pair: tuple[int, int], window: float, count: int, cosine: float, ways: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, links, root): links to other classes first met here, and a spanning forest of them."""
    n = len(ids)
    links, root = np.zeros(n, np.int64), np.arange(n)
    near = np.flatnonzero(collisions(x @ ways, window) >= count)
    for s in range(0, len(near), 20_000):
        u, v = np.divmod(near[s : s + 20_000], n)
        here = (np.minimum(part[u], part[v]) == pair[0]) & (np.maximum(part[u], part[v]) == pair[1])
        if table:
            here &= ~(cells[u] == cells[v]).any(axis=1)
        u, v = u[here], v[here]
        ok = np.einsum("ij,ij->i", x[u], x[v]) >= cosine
        u, v = u[ok], v[ok]
        np.add.at(links, u, weight[v])
        np.add.at(links, v, weight[u])
        root = joined(root, u, v)
    hit = np.flatnonzero(links)
    return ids[hit], links[hit], ids[root[hit]]


def _in_cells(dim: int, window: float, count: int, cosine: float):
    ways = projections_of(dim)
    names = ["table", "cell", "part_a", "part_b", "id", "weight", "part", "before", "vector"]

    def group(rows: pa.Table) -> pa.RecordBatch:
        first = {c: rows.column(c)[0].as_py() for c in names[:4]}
        one = rows.combine_chunks()
        get = lambda c: one.column(c).combine_chunks()
        x = unit(_matrix(get("vector"), dim))
        cells = get("before").flatten().to_numpy(zero_copy_only=False).reshape(len(x), first["table"])
        ids, weight, part = (get(c).to_numpy() for c in ("id", "weight", "part"))
        out = _link_rows(ids, weight, x, cells, first["table"], part, (first["part_a"], first["part_b"]), window, count, cosine, ways)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in out], names=["id", "links", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by cell; a cell's rows may span batches."""
        held: list[pa.RecordBatch] = []
        key = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in names[:4]], 1)
            edges = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(keys)]):
                mine = tuple(keys[a])
                if held and mine != key:
                    yield group(pa.Table.from_batches(held))
                    held = []
                key = mine
                held.append(batch.slice(a, b - a))
        if held:
            yield group(pa.Table.from_batches(held))

    return run


def near_duplicates(table: DataFrame, cosine: float = COSINE) -> DataFrame:
    """One row for each row of ``table(vec_id, embedding)``: vec_id, n_links, component_id, kept."""
    rows = table.select(F.col("vec_id").cast("long"), F.col("embedding").alias("vector"))
    big = F.greatest(F.array_max(F.transform("vector", F.abs)), F.lit(0.0))
    good = F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & ~F.exists("vector", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & (big > 0)
    good = F.coalesce(good, F.lit(False))
    size = rows.filter(good).groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    dim = size.dim if size else 0
    same = ["key_a", "key_b"]
    usable = good & (F.size("vector") == dim)
    rows = rows.select("vec_id", F.when(usable, F.xxhash64("vector")).alias("key_a"), F.when(usable, F.xxhash64(F.lit(dim), "vector")).alias("key_b"), "vector")
    known = rows.filter(F.col("key_a").isNotNull()).groupBy(*same)
    classes = cut(known.agg(F.min("vec_id").alias("id"), F.count_distinct("vec_id").alias("weight"), F.first("vector").alias("vector")))
    n = classes.count()
    planes, tables = design(n, cosine)
    window = WINDOW_SIGMAS * sqrt((2 - 2 * cosine) / max(dim, 1))
    kind = classes.schema["vector"].dataType.simpleString()
    dealt = cut(classes.select("id", "weight", "vector").mapInArrow(_cells(dim, planes, tables), f"id long, weight long, vector {kind}, cells array<long>"))
    large = dealt.select(F.posexplode("cells").alias("table", "cell")).groupBy("table", "cell").count().filter(F.col("count") > CELL_ROWS)
    large = cut(large.select("table", "cell", F.ceil(F.col("count") / CELL_ROWS).cast("int").alias("parts")))
    met = dealt.select("id", "weight", "vector", "cells", F.posexplode("cells").alias("table", "cell"))
    met = met.withColumn("before", F.slice("cells", F.lit(1), F.col("table"))).drop("cells").join(large, ["table", "cell"], "left")
    met = met.withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = met.withColumn("part_a", F.least("part", "other")).withColumn("part_b", F.greatest("part", "other"))
    met = met.select("table", "cell", "part_a", "part_b", "id", "weight", "part", "before", "vector")
    keys = ["table", "cell", "part_a", "part_b"]
    met = met.repartition(*keys).sortWithinPartitions(*keys)
    found = cut(met.mapInArrow(_in_cells(dim, window, min_collisions(), cosine), "id long, links long, root long"))
    drop(dealt, large)
    label = components(found.filter("id != root").select(F.col("root").alias("a"), F.col("id").alias("b")).distinct())
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    named = classes.select("id", "weight", *same).join(links, "id", "left").join(label, "id", "left")
    named = named.select(*same, (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "id").alias("component"))
    out = spread_join(rows.drop("vector"), named, same, hot_keys(classes, *same, times="weight"), "left")
    out = out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


#: DuckDB SQL that compares all pairs.
SQL = """
WITH RECURSIVE ve_rows AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[64]) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0
), ve_links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM ve_rows x JOIN ve_rows y ON x.vec_id <> y.vec_id AND array_cosine_similarity(x.v, y.v) >= 0.95
), ve_reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT ve_reach.a, ve_links.b FROM ve_reach JOIN ve_links ON ve_links.a = ve_reach.b
)
SELECT e.vec_id, (SELECT count(*) FROM ve_links WHERE a = e.vec_id) AS n_links, r.c AS component_id, e.vec_id = r.c AS kept
FROM embeddings e JOIN (SELECT a, min(b) AS c FROM ve_reach GROUP BY a) r ON r.a = e.vec_id
"""
