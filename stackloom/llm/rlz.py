"""Duplicate word spans by relative Lempel-Ziv parsing against an index of the whole corpus (operator 5).

A word is covered if a window of ``WINDOW`` consecutive words around it also starts earlier: in a
document with a smaller id, or earlier in the same one.  Words are taken unchanged.

Every document is cut into blocks at content-defined anchors; a block stands for the windows that
start in it.  The reference is the first occurrence of every distinct block, of all documents, and its
index maps a block's hashes to that place.  Each document is parsed against it greedily from left to
right: a block that the reference holds earlier is copied from there, and the factor goes on for as
long as what follows is copied from what follows there.  Each factor has a window at least, so its words
are duplicates.

The factors' boundaries are checked to the word, as a window of a reference block may still occur
earlier in a different block.  It then shares a minimiser seed (smallest hash of ``SEED`` words in the
window) with that place.  A seed's place is told by the content of the blocks around it, so copies of
one block are one place; windows of reference blocks whose seed has two places are hashed one by one,
and all but the first of equal windows lengthen the factors or are factors of their own.

Blocks and windows are equal if two independent 64-bit hashes are; seeds need one hash, as they only
pick what is looked at.  So the result is exact but for a chance of about 1e-12 at 1e13 windows.

Blocks, seeds and windows are grouped by hash with partial aggregates; where rows are joined with
them, hot keys are dealt over all tasks.  Documents with fewer than ``WINDOW`` words, empty and null
texts have no windows.  Rows without an id lose nothing and are no source; repeated rows of one id
count as one document; extra columns pass through, and an existing ``kept``, ``n_words``,
``n_removed`` or ``factors`` is replaced; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stackloom.checkpoints import cut, drop
from stackloom.llm._jobs import hot_keys, spread_join, unused
from stackloom.llm._words import Words, blocks, mix, signed, tidied

WINDOW = 20
SEED = 8
ANCHOR = 4
BLOCK = 48
_END = np.uint64(0xFFFFFFFFFFFFFFFF)


def sliding(x: np.ndarray, size: int, best) -> np.ndarray:
    """``best`` (np.minimum or np.maximum) of every ``size`` neighbours, by doubling."""
    have, out = 1, x
    while have * 2 <= size:
        out = best(out[: len(out) - have], out[have:])
        have *= 2
    rest = size - have
    return best(out[: len(out) - rest], out[rest:]) if rest else out


def minimisers(w: Words, window: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions whose seed is the smallest of some window of one row, all seeds by position, and the smallest of each window."""
    n = len(w.hash)
    at, found = w.windows(seed)
    value = np.full(n, _END, np.uint64)
    value[at] = found
    span = window - seed + 1
    if n < window:
        return np.empty(0, np.int64), value, np.empty(0, np.uint64)
    low = sliding(value, span, np.minimum)[: n - window + 1]
    low = np.where(w.row[: n - window + 1] == w.row[window - 1 :], low, np.uint64(0))
    around = np.concatenate([np.zeros(span - 1, np.uint64), low, np.zeros(n - len(low), np.uint64)])
    high = sliding(around, span, np.maximum)[:n]
    return np.flatnonzero((value == high) & (value != _END)), value, low


def cut_blocks(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, end of windows, and row of every block."""
    at, found = w.windows(ANCHOR)
    anchor = at[found % np.uint64(BLOCK) == 0]
    n_windows = np.maximum(np.diff(w.first) - WINDOW + 1, 0)
    rows = np.flatnonzero(n_windows)
    last = w.first[:-1] + n_windows
    start = np.unique(np.concatenate([w.first[rows], anchor[anchor < last[w.row[anchor]]]]))
    row = w.row[start]
    end = np.minimum(np.append(start[1:], len(w.hash)), last[row])
    return start, end, row


_SAME = ["key_a", "key_b"]


def _hashed(w: Words, start: np.ndarray, end: np.ndarray) -> list[pa.Array]:
    return [pa.array(signed(w.stretch(start, end))), pa.array(signed(w.other_stretch(start, end)))]


def _block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key_a, key_b, doc_id, start, n): every block, by two hashes of its windows' words."""
    for batch in batches:
        for at, to, w in blocks(batch.column(1)):
            start, end, row = cut_blocks(w)
            ids = batch.column(0).slice(at, to - at).to_numpy(zero_copy_only=False)[row]
            place = [pa.array(ids, pa.int64()), pa.array((start - w.first[row]).astype(np.int32)), pa.array((end - start).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*_hashed(w, start, end + WINDOW - 1), *place], names=[*_SAME, "doc_id", "start", "n"])


def seed_places(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, seed, place) of every minimiser; the place is a hash of all blocks with windows that may hold it, and its offset."""
    start, end, _ = cut_blocks(w)
    at, value, _ = minimisers(w, WINDOW, SEED)
    row = w.row[at]
    lo = np.searchsorted(start, np.maximum(at - (WINDOW - SEED), w.first[row]), side="right") - 1
    hi = np.searchsorted(start, np.minimum(at, w.first[row + 1] - WINDOW), side="right") - 1
    around = w.stretch(start[lo], end[hi] + WINDOW - 1)
    return row, value[at], mix(around + (at - start[lo]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _seed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(seed, place, doc_id) of every minimiser."""
    for batch in batches:
        for at, to, w in blocks(batch.column(1)):
            row, seed, place = seed_places(w)
            ids = batch.column(0).slice(at, to - at).to_numpy(zero_copy_only=False)[row]
            yield pa.RecordBatch.from_arrays([pa.array(signed(seed)), pa.array(signed(place)), pa.array(ids, pa.int64())], names=["seed", "place", "doc_id"])


def listed(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The row of each item of an Arrow list column, and the items; null lists are empty."""
    return np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)), lists.flatten()


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key_a, key_b, doc_id, start) of the windows outside copied blocks whose minimiser is one of the row's listed seeds."""
    for batch in batches:
        for at, to, w in blocks(batch.column(1)):
            start, _ = w.windows(WINDOW)
            if not len(start):
                continue
            of, seeds = listed(batch.column(2).slice(at, to - at))
            wanted = np.unique(mix(seeds.to_numpy(zero_copy_only=False).view(np.uint64)) ^ mix(of.astype(np.uint64)))
            low = minimisers(w, WINDOW, SEED)[2][start]
            of, spans = listed(batch.column(3).slice(at, to - at))
            begin = np.minimum(w.first[of] + spans.field(0).to_numpy(zero_copy_only=False), w.first[of + 1])
            end = np.minimum(begin + spans.field(1).to_numpy(zero_copy_only=False), w.first[of + 1])
            depth = np.bincount(begin, minlength=len(w.hash) + 1) - np.bincount(end, minlength=len(w.hash) + 1)
            copied = np.cumsum(depth)[start] > 0
            start = start[~copied & np.isin(mix(low) ^ mix(w.row[start].astype(np.uint64)), wanted)]
            row = w.row[start]
            ids = batch.column(0).slice(at, to - at).to_numpy(zero_copy_only=False)[row]
            yield pa.RecordBatch.from_arrays([*_hashed(w, start, start + WINDOW), pa.array(ids, pa.int64()), pa.array((start - w.first[row]).astype(np.int32))], names=[*_SAME, "doc_id", "start"])


def _texts(docs: DataFrame) -> DataFrame:
    return docs.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), "text")


def _sources(rows: DataFrame) -> DataFrame:
    """``rows`` whose keys also occur earlier, with their first place (source_id, source_start)."""
    first = rows.groupBy(*_SAME).agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count("*").alias("times")).filter("times > 1")
    first = cut(first.select(*_SAME, "times", F.col("first.doc_id").alias("source_id"), F.col("first.start").alias("source_start")))
    later = (F.col("doc_id") != F.col("source_id")) | (F.col("start") != F.col("source_start"))
    return spread_join(rows, first.drop("times"), _SAME, hot_keys(first, *_SAME)).filter(later)


def copies(docs: DataFrame) -> DataFrame:
    """Duplicate windows as (doc_id, start, n, source_id, source_start).

    Windows that start at words start .. start + n - 1 also start at source_start .. of the earlier source.
    """
    texts = _texts(docs)
    names = ["doc_id", "start", "n", "source_id", "source_start"]
    cells = cut(texts.mapInArrow(tidied(_block_rows), "key_a long, key_b long, doc_id long, start int, n int"))
    copied = cut(_sources(cells).select(*names))
    drop(cells)

    seeds = cut(texts.mapInArrow(tidied(_seed_rows), "seed long, place long, doc_id long"))
    twice = seeds.groupBy("seed").agg(F.min("place").alias("low"), F.max("place").alias("high"), F.count("*").alias("times")).filter("low < high")
    twice = cut(twice.select("seed", "times"))
    # With their places, as rows that are alike in all columns would be dealt to one task.
    holders = spread_join(seeds, twice.select("seed"), ["seed"], hot_keys(twice, "seed"))
    spans = copied.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("copied"))
    unsure = cut(holders.groupBy("doc_id").agg(F.collect_set("seed").alias("seeds")).join(spans, "doc_id", "left"))
    drop(seeds, twice)
    windows = texts.join(unsure, "doc_id").select("doc_id", "text", "seeds", "copied").mapInArrow(tidied(_window_rows), "key_a long, key_b long, doc_id long, start int")
    windows = cut(windows)
    drop(unsure)
    single = cut(_sources(windows).select("doc_id", "start", F.lit(1).alias("n"), "source_id", "source_start"))
    drop(windows)
    return copied.unionByName(single)


def parse(row: np.ndarray, start: np.ndarray, n: np.ndarray, source: np.ndarray, source_start: np.ndarray) -> list[np.ndarray]:
    """Greedy factors (row, start, n_words, source_id, source_start) of each row's copies, from left to right.

    A factor goes on while the next copy starts where the last one ends, in the same source and right behind.
    """
    order = np.lexsort((start, row))
    row, start, n, source, source_start = (x[order].astype(np.int64) for x in (row, start, n, source, source_start))
    new = np.ones(len(row), bool)
    same = (row[1:] == row[:-1]) & (source[1:] == source[:-1]) & (start[1:] - source_start[1:] == start[:-1] - source_start[:-1])
    new[1:] = ~(same & (start[1:] <= start[:-1] + n[:-1]))
    first = np.flatnonzero(new)
    end = np.maximum.reduceat(start + n, first) if len(first) else first
    return [row[first], start[first], end - start[first] + WINDOW - 1, source[first], source_start[first]]


FACTOR = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("n_words", T.IntegerType()), T.StructField("source_id", T.LongType()), T.StructField("source_start", T.IntegerType())])
_FACTOR_KIND = pa.struct([("start", pa.int32()), ("n_words", pa.int32()), ("source_id", pa.int64()), ("source_start", pa.int32())])
_MADE = ["n_words", "n_removed", "kept", "factors"]


def without(w: Words, gone: np.ndarray) -> list[str]:
    """The words of each row that are not gone, joined by one space."""
    kept = np.flatnonzero(~gone)
    size = w.end[kept] - w.start[kept] + 1
    out_at = np.cumsum(size) - size
    total = int(size.sum())
    data = w.data[np.minimum(np.repeat(w.start[kept] - out_at, size) + np.arange(total), max(len(w.data) - 1, 0))] if total else np.empty(0, np.uint8)
    data[out_at + size - 1] = 32
    ends = np.concatenate([[0], np.cumsum(np.bincount(w.row[kept], size, w.n_rows).astype(np.int64))])
    raw = data.tobytes()
    return [raw[a : max(a, b - 1)].decode() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


def _removal(names: list[str], text: str, found: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, w in blocks(batch.column(text)):
                of, items = listed(batch.column(found).slice(at, to - at))
                row, start, size, source, source_start = parse(of, *(items.field(k).to_numpy(zero_copy_only=False) for k in range(4)))
                lo, hi = w.first[row] + start, np.minimum(w.first[row] + start + size, w.first[row + 1])
                ok = lo < hi
                depth = np.bincount(lo[ok], minlength=len(w.hash) + 1) - np.bincount(hi[ok], minlength=len(w.hash) + 1)
                gone = np.cumsum(depth[: len(w.hash)]) > 0
                flat = pa.StructArray.from_arrays([pa.array(start, pa.int32()), pa.array(size, pa.int32()), pa.array(source, pa.int64()), pa.array(source_start, pa.int32())], fields=list(_FACTOR_KIND))
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(w.n_rows + 1)), pa.int32()), flat)
                made = [pa.array(np.diff(w.first), pa.int64()), pa.array(np.bincount(w.row[gone], minlength=w.n_rows), pa.int64()), pa.array(without(w, gone), pa.string()), lists]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(at, to - at) for c in names), *made], names=[*names, *_MADE])

    return run


def remove(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Adds the greedy ``factors`` of each document's ``copies``, ``n_words``, ``n_removed`` and ``kept``.

    ``kept`` has the words outside the factors, joined by one space.
    """
    names = [c for c in docs.columns if c not in _MADE]
    own, items = unused("_factor_id", names, _MADE), unused("_copies", names, _MADE)
    lists = found.groupBy(F.col("doc_id").cast("long").alias(own)).agg(F.collect_list(F.struct("start", "n", "source_id", "source_start")).alias(items))
    both = docs.select(*names).join(lists, docs["doc_id"] == F.col(own), "left").select(*names, items)
    kinds = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType()), T.StructField("factors", T.ArrayType(FACTOR))]
    return both.mapInArrow(tidied(_removal(names, "text", items)), T.StructType([docs.schema[c] for c in names] + kinds))


def factors(docs: DataFrame) -> DataFrame:
    """(doc_id, start, n_words, source_id, source_start): the factors of every document, a row each."""
    parsed = remove(docs.select("doc_id", "text").distinct(), copies(docs))
    return parsed.select("doc_id", F.inline("factors"))


#: DuckDB SQL of the query, without the digest's name for the kept words.
SQL = r"""
WITH ss_words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), ss_windows AS (
  SELECT doc_id, unnest(range(1, len(w) - 18)) AS i, w FROM ss_words
), ss_hashed AS (
  SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS g FROM ss_windows
), ss_ranked AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS r FROM ss_hashed
), ss_gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM ss_ranked WHERE r > 1
), ss_lists AS (
  SELECT doc_id, list(p) AS gone FROM ss_gone GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(array_to_string(list_filter(w, lambda x, k: NOT coalesce(list_contains(gone, k), false)), ' ')) AS kept_sha256
FROM ss_words d LEFT JOIN ss_lists l ON l.doc_id = d.doc_id
"""
