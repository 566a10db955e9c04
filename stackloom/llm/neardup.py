"""Near-duplicate documents by a multi-index Hamming join of MinHash signatures (operator 2).

A document's set is its distinct shingles of ``size`` words, five unless the caller asks for another
size (words between ASCII white space, A-Z folded; shorter texts are one shingle); two documents are linked if 100 * |intersection| >= 80 * |union|.  Equal sets are one class from the
start.  A class has a signature of ``CHUNKS * WIDTH`` symbols of 16 bits, one MinHash each, split into
chunks.  By pigeonhole, of two signatures that differ in less than 2 * ``CHUNKS`` symbols, some chunk
differs in one symbol at most; so for every chunk each single error is enumerated, by a key over the
chunk without one symbol, and all pairs under that distance share a key.  (A pair at similarity 0.8
misses every chunk with probability 2e-5.)  Candidates that differ in more than ``MAX_DIFFERENT``
symbols cannot be similar enough but with probability 1e-9; the rest is confirmed on the full sets.

Groups of copies are never expanded into all pairs.  In a first round each key picks one of its
members by a hash, and each class is compared with the nearest of those its keys picked, which ties
large groups together.  Then only keys whose members lie in different components so far are looked at
again.  Members of small keys are paired, within neighbouring sizes.  Keys with more than ``LARGE``
members form clusters; clusters are cut into parts of about ``PART`` classes and ``PART_SHINGLES``
shingles at most, and every two parts meet in a task of their own, which counts all intersections of their sets and passes on a spanning forest of
the links.  Any link between candidates is either confirmed, or its ends are already connected.

Texts without words have an empty set and are linked with nothing.  Rows without an id are in no
component and are kept; repeated rows get equal results; other columns are ignored; an empty table
gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stackloom.checkpoints import cut, drop
from stackloom.llm._jobs import components, hot_keys, spread_join
from stackloom.llm._trees import joined
from stackloom.llm._words import Words, blocks, mix, signed, tidied

SHINGLE = 5
PERCENT = 80
CHUNKS, WIDTH = 8, 5
MAX_DIFFERENT = 24
LARGE = 24
PART = 1200
PART_SHINGLES = 2_000_000
_rng = np.random.default_rng(77)
_XOR = _rng.integers(0, 1 << 63, CHUNKS * WIDTH, dtype=np.uint64)
_ODD = _rng.integers(0, 1 << 63, CHUNKS * WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_KEYS = _rng.integers(0, 1 << 63, (CHUNKS * WIDTH, WIDTH), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(w: Words, size: int = SHINGLE) -> list[np.ndarray]:
    """The distinct shingle hashes of every row, sorted."""
    at, found = w.windows(size)
    bound = np.searchsorted(w.row[at], np.arange(w.n_rows + 1))
    n_words = np.diff(w.first)
    out = []
    for row in range(w.n_rows):
        if n_words[row] >= size:
            x = np.sort(found[bound[row] : bound[row + 1]])
            fresh = np.ones(len(x), bool)
            np.not_equal(x[1:], x[:-1], out=fresh[1:])
            out.append(x[fresh])
        elif n_words[row]:
            out.append(w.stretch(w.first[row : row + 1], w.first[row + 1 : row + 2]))
        else:
            out.append(np.empty(0, np.uint64))
    return out


_SETS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("set_a", T.LongType()), T.StructField("set_b", T.LongType()), T.StructField("signature", T.BinaryType())])


def _describe(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, to, w in blocks(batch.column(1), lower=True):
            sets = shingle_sets(w, size)
            count = np.array([len(x) for x in sets])
            full = np.flatnonzero(count)
            a, b = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
            marks = [b""] * len(sets)
            if len(full):
                flat = np.concatenate(sets)
                first = np.concatenate([[0], np.cumsum(count[full])[:-1]])
                a[full] = np.add.reduceat(flat, first)
                b[full] = np.add.reduceat(mix(flat ^ _XOR[0]), first)
                low = np.stack([np.minimum.reduceat((flat ^ x) * m, first) for x, m in zip(_XOR, _ODD)], 1)
                for row, raw in zip(full.tolist(), (mix(low) >> np.uint64(48)).astype(np.uint16)):
                    marks[row] = raw.tobytes()
            ids = batch.column(0).slice(at, to - at)
            yield pa.RecordBatch.from_arrays([ids, pa.array(count, pa.int64()), pa.array(signed(a)), pa.array(signed(b)), pa.array(marks, pa.binary())], names=_SETS.names)


def describe(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """Set size, two set hashes and signature of every whole text."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidied(partial(_describe, size=size)), _SETS)


def _enumerate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        symbols = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint16).reshape(-1, CHUNKS, WIDTH).astype(np.uint64)
        keys = np.empty((len(symbols), CHUNKS * WIDTH), np.uint64)
        for k in range(CHUNKS * WIDTH):
            chunk, gone = divmod(k, WIDTH)
            keep = [j for j in range(WIDTH) if j != gone]
            keys[:, k] = mix((symbols[:, chunk, keep] * _KEYS[k, keep]).sum(1, dtype=np.uint64) + _ODD[k])
        n = keys.shape[1]
        yield pa.RecordBatch.from_arrays([pa.array(signed(keys.ravel())), pa.array(np.repeat(batch.column(0).to_numpy(), n)), pa.array(np.repeat(batch.column(1).to_numpy(), n))], names=["key", "id", "n"])


def chunk_keys(classes: DataFrame) -> DataFrame:
    """Every key (key, id, n) of ``classes(id, n, signature)``: a chunk of the signature without one symbol."""
    return classes.select("id", "n", "signature").mapInArrow(tidied(_enumerate), "key long, id long, n long")


def _distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, far) of rows (a, b, signature, signature) that differ in ``MAX_DIFFERENT`` symbols at most."""
    for batch in batches:
        if batch.num_rows:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for c in (2, 3))
            far = (x != y).sum(1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(far)], names=["a", "b", "far"]).filter(pa.array(far <= MAX_DIFFERENT))


def _often(pairs: DataFrame, k: str) -> list[int]:
    """Hashes of the ids that very many of the ``pairs`` have."""
    return hot_keys(pairs.groupBy(k).agg(F.count("*").alias("times")), k)


def _near(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Those of the written table ``pairs(a, b)`` that sizes and signatures allow, with their distance."""
    side = lambda k: classes.select(F.col("id").alias(k), F.col("n").alias(f"n_{k}"), F.col("signature").alias(f"s_{k}"))
    both = spread_join(spread_join(pairs, side("a"), ["a"], _often(pairs, "a")), side("b"), ["b"], _often(pairs, "b"))
    both = both.filter(100 * F.least("n_a", "n_b") >= PERCENT * F.greatest("n_a", "n_b"))
    return both.select("a", "b", "s_a", "s_b").mapInArrow(tidied(_distances), "a long, b long, far int")


def _compare(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            part = batch.slice(at, 200)
            sets = [[s for _, _, w in blocks(part.column(c), lower=True) for s in shingle_sets(w, size)] for c in (2, 3)]
            keep = []
            for x, y in zip(*sets):
                both = np.concatenate([x, y])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= PERCENT * (len(both) - common) > 0)
            yield part.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def confirm(pairs: DataFrame, docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """Those of the written table ``pairs(a, b)`` whose full shingle sets are similar enough."""
    text = lambda k: docs.select(F.col("doc_id").cast("long").alias(k), F.col("text").alias(f"text_{k}"))
    pairs = pairs.select("a", "b")
    both = spread_join(spread_join(pairs, text("b"), ["b"], _often(pairs, "b")), text("a"), ["a"], _often(pairs, "a")).select("a", "b", "text_a", "text_b")
    return both.mapInArrow(tidied(partial(_compare, size=size)), "a long, b long")


def links_within(sets: list[np.ndarray], part: np.ndarray, pair: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (row, root) of the links between rows of the two parts, from all their intersections."""
    m = len(sets)
    size = np.array([len(x) for x in sets])
    row = np.repeat(np.arange(m), size)
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = np.zeros((m, m), np.float32)
    dense = np.flatnonzero(count >= 32)
    place = np.full(len(count), -1)
    place[dense] = np.arange(len(dense))
    for at in range(0, len(dense), 2048):
        own = (place[column] >= at) & (place[column] < at + 2048)
        hold = np.zeros((m, min(2048, len(dense) - at)), np.float32)
        hold[row[own], place[column[own]] - at] = 1
        common += hold @ hold.T
    few = np.flatnonzero((count[column] > 1) & (count[column] < 32))
    few = few[np.argsort(column[few], kind="stable")]
    for gap in range(1, 32):
        same = np.flatnonzero(column[few[:-gap]] == column[few[gap:]]) if len(few) > gap else np.empty(0, np.int64)
        if not len(same):
            break
        a, b = row[few[same]], row[few[same + gap]]
        cell, times = np.unique(np.minimum(a, b) * m + np.maximum(a, b), return_counts=True)
        common[cell // m, cell % m] += times
        common[cell % m, cell // m] += times
    root = np.arange(m)
    for at in range(0, m, 128):
        some = common[at : at + 128]
        u, v = np.nonzero(100 * some >= PERCENT * (size[at : at + 128, None] + size[None] - some))
        u += at
        ok = (u < v) & (np.minimum(part[u], part[v]) == pair[0]) & (np.maximum(part[u], part[v]) == pair[1])
        root = joined(root, u[ok], v[ok])
    hit = np.flatnonzero(root != np.arange(m))
    return hit, root[hit]


def _cluster(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Rows (cluster, part_a, part_b, part, id, text) come sorted; those of one task may span batches."""
    held: list[tuple[np.ndarray, np.ndarray, list[np.ndarray]]] = []
    key = None

    def compare() -> pa.RecordBatch:
        ids, part = (np.concatenate([x[k] for x in held]) for k in (0, 1))
        hit, root = links_within([s for x in held for s in x[2]], part, key[1:])
        return pa.RecordBatch.from_arrays([pa.array(ids[root]), pa.array(ids[hit])], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(k).to_numpy() for k in range(3)], 1)
        sets = [s for _, _, w in blocks(batch.column(5), lower=True) for s in shingle_sets(w, size)]
        edges = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(keys)]):
            mine = tuple(keys[a].tolist())
            if held and mine != key:
                yield compare()
                held = []
            key = mine
            held.append((batch.column(4).to_numpy()[a:b], batch.column(3).to_numpy()[a:b], sets[a:b]))
    if held:
        yield compare()


def clustered_links(members: DataFrame, docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """Links (a, b), a spanning forest, among the ``members(key, id, n)`` of large keys."""
    first = members.groupBy("key").agg(F.min("id").alias("a"), F.count("*").alias("times"))
    stars = spread_join(members.select("key", "id"), first.drop("times"), ["key"], hot_keys(first, "key"))
    cluster = components(stars.filter("a < id").select("a", F.col("id").alias("b")).distinct())
    sized = cut(cluster.join(members.select("id", "n").distinct(), "id"))
    most = F.greatest(F.count("*") / PART, F.sum("n") / PART_SHINGLES)
    parts = cut(sized.groupBy("component").agg(F.ceil(most).cast("long").alias("parts"), F.count("*").alias("times")))
    met = spread_join(sized, parts.drop("times"), ["component"], hot_keys(parts, "component")).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    met = met.select(F.col("component").alias("cluster"), F.least("part", "other").alias("part_a"), F.greatest("part", "other").alias("part_b"), "part", "id")
    text = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    keys = ["cluster", "part_a", "part_b"]
    rows = met.join(text, "id").select(*keys, "part", "id", "text").repartition(*keys).sortWithinPartitions(*keys)
    out = cut(rows.mapInArrow(tidied(partial(_cluster, size=size)), "a long, b long").distinct())
    drop(cluster, sized, parts)
    return out


def near_duplicates(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """One row for each row of ``docs(doc_id, text)``: doc_id, n_shingles, component_id, kept.

    ``component_id`` is the smallest id in the row's connected component of links.
    """
    sets = cut(describe(docs, size))
    same = ["set_a", "set_b", "n"]
    # Equal sets have equal signatures, so any one of them serves.
    classes = sets.filter("n > 0 and doc_id is not null").groupBy(*same)
    classes = cut(classes.agg(F.min("doc_id").alias("id"), F.min("signature").alias("signature"), F.count("*").alias("times")))
    keys = chunk_keys(classes).withColumn("turn", F.xxhash64("id", "key"))
    held = keys.groupBy("key").agg(F.min("turn").alias("picked"), F.count("*").alias("members")).filter("members > 1")
    held = cut(held)
    hot = hot_keys(held, "key", times="members")
    shared = cut(spread_join(keys, held, ["key"], hot))
    drop(held)

    hubs = shared.filter("turn = picked").select("key", F.col("id").alias("hub"))
    stars = spread_join(shared.select("key", "id"), hubs, ["key"], hot).filter("id != hub").select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()
    stars = cut(stars)
    first = cut(_near(stars, classes))
    drop(stars)
    ends = first.select(F.explode(F.array("a", "b")).alias("id"), "a", "b", "far")
    nearest = cut(ends.groupBy("id").agg(F.min(F.struct("far", "a", "b")).alias("best")).select("best.a", "best.b").distinct())
    links = cut(confirm(nearest, docs, size).distinct())
    drop(first)
    label = components(links)

    split = shared.select("key", "id", "n", "members").join(label, "id", "left").withColumn("component", F.coalesce("component", "id"))
    split = cut(split)
    torn = split.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("key")
    torn = cut(spread_join(split, torn, ["key"], hot))
    drop(shared, split, label)
    large = torn.filter(F.col("members") > LARGE).select("key", "id", "n")
    if large.limit(1).count():
        links = links.union(clustered_links(large, docs, size))
    small = torn.filter(F.col("members") <= LARGE)
    grade = F.floor(F.log("n") / F.log(F.lit(100 / PERCENT)) + 1e-9)
    left = small.select("key", F.col("id").alias("a"), F.col("component").alias("c_a"), grade.alias("grade"))
    right = small.select("key", F.col("id").alias("b"), F.col("component").alias("c_b"), F.explode(F.array(grade - 1, grade, grade + 1)).alias("grade"))
    pairs = cut(left.join(right, ["key", "grade"]).filter("a < b and c_a != c_b").select("a", "b").distinct().join(nearest, ["a", "b"], "left_anti"))
    near = cut(_near(pairs, classes))
    links = links.union(cut(confirm(near, docs, size).distinct()))
    drop(torn, pairs, near, nearest)
    label = components(links)

    named = classes.join(label, "id", "left").select(*same, F.coalesce("component", "id").alias("component"))
    out = spread_join(sets.drop("signature"), named, same, hot_keys(classes, *same), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


#: DuckDB SQL for the rows of ``near_duplicates`` with 4-word shingles over a relation ``documents``.
SQL = r"""
WITH RECURSIVE nd_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM {documents}
), nd_sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END AS s
  FROM nd_words
), nd_items AS (
  SELECT doc_id, unnest(s) AS g FROM nd_sets
), nd_pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n_both FROM nd_items x JOIN nd_items y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2
), nd_links AS (
  SELECT a, b FROM nd_pairs JOIN nd_sets p ON p.doc_id = a JOIN nd_sets q ON q.doc_id = b WHERE 100 * n_both >= 80 * (len(p.s) + len(q.s) - n_both)
), nd_steps AS (
  SELECT a, b FROM nd_links UNION SELECT b, a FROM nd_links
), nd_reach AS (
  SELECT doc_id AS a, doc_id AS b FROM nd_sets UNION SELECT nd_reach.a, nd_steps.b FROM nd_reach JOIN nd_steps ON nd_steps.a = nd_reach.b
)
SELECT doc_id, len(s)::BIGINT AS n_shingles, min(b) AS component_id, doc_id = min(b) AS kept
FROM nd_sets JOIN nd_reach ON a = doc_id GROUP BY doc_id, len(s)
"""
