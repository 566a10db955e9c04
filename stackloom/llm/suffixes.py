"""Repeated passages by a sparse suffix array (operator 7).

Words are taken unchanged.  A passage of ``LENGTH`` words or more that occurs at two places, in two
documents or in one, is a repeat.  Only suffixes at minimiser positions are retained: positions whose
seed of ``SEED`` words has the smallest hash of some ``LENGTH``-word window.  Every such window holds one,
and equal windows hold it at the same word, so no repeat is without a retained suffix at both places.

Seeds that occur once cannot start a repeat and are put aside.  Of the others, the retained suffixes
are sorted, over the whole table, by their next ``LENGTH`` words (as word hashes); neighbours are compared
and the match is extended to the right and to the left, as far as a window around the position can
reach.  Longer passages hold many retained suffixes, whose matches add up.  Where neighbours' sorts
cross the edge of a partition, the edge rows meet in a small table of their own: two rows a partition.

The sort sees the right context alone, so a match that needs words at its left can hide behind nearer
neighbours.  Therefore every ``LENGTH``-word window whose minimiser's seed repeats is counted by its
hash, and windows that no match of neighbours covers, but that occur at another place, are repeats too.
So the spans are exact; ``partner_ids`` holds the neighbours and, of such windows, the smallest and the
largest id that hold them, as all pairs would grow with the square of a passage's copies.

Documents with equal words are one class, represented by the smallest id, from the start; if they
have ``LENGTH`` words, each is a repeat as a whole.  Null and empty texts and short documents have no
repeats; rows without an id are left out, as nothing could be said of them; repeated rows of one id are
one document; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackloom.checkpoints import cut, drop
from stackloom.llm._jobs import hot_keys, spread_join
from stackloom.llm._words import blocks, mix, signed, tidied
from stackloom.llm.rlz import listed, minimisers

LENGTH = 50
SEED = 10
REACH = LENGTH - SEED


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, n, words_a, words_b, seeds): word count, hashes of the word sequence, retained seeds."""
    for batch in batches:
        for at, to, w in blocks(batch.column(1)):
            n = np.diff(w.first)
            whole = w.stretch(w.first[:-1], w.first[1:])
            place, value, _ = minimisers(w, LENGTH, SEED)
            cut_at = np.searchsorted(w.row[place], np.arange(to - at + 1))
            lists = pa.ListArray.from_arrays(pa.array(cut_at.astype(np.int32)), pa.array(signed(value[place])))
            ids = batch.column(0).slice(at, to - at)
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(signed(whole)), pa.array(signed(w.other_stretch(w.first[:-1], w.first[1:]))), lists], names=["doc_id", "n", "words_a", "words_b", "seeds"])


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(right, left, doc_id, at): the words from a retained position on, and those before it, backwards."""
    for batch in batches:
        for at, to, w in blocks(batch.column(1)):
            wanted = batch.column(2).slice(at, to - at)
            row = np.repeat(np.arange(to - at), wanted.value_lengths().to_numpy(zero_copy_only=False))
            listed = np.unique(mix(wanted.flatten().to_numpy(zero_copy_only=False).view(np.uint64)) ^ row.astype(np.uint64))
            place, value, _ = minimisers(w, LENGTH, SEED)
            place = place[np.isin(mix(value[place]) ^ w.row[place].astype(np.uint64), listed)]
            if not len(place):
                continue
            row = w.row[place]
            short = (w.hash >> np.uint64(32)).astype(">u4")
            end, begin = np.minimum(place + LENGTH, w.first[row + 1]), np.maximum(place - REACH, w.first[row])
            right = [short[a:b].tobytes() for a, b in zip(place.tolist(), end.tolist())]
            left = [short[a:b][::-1].tobytes() for a, b in zip(begin.tolist(), place.tolist())]
            ids = batch.column(0).slice(at, to - at).to_numpy(zero_copy_only=False)[row]
            yield pa.RecordBatch.from_arrays([pa.array(right, pa.binary()), pa.array(left, pa.binary()), pa.array(ids), pa.array((place - w.first[row]).astype(np.int32))], names=["right", "left", "doc_id", "at"])


def common(a: bytes, b: bytes) -> int:
    """Words that two contexts share from their start."""
    n = min(len(a), len(b)) // 4
    if a[: 4 * n] == b[: 4 * n]:
        return n
    x, y = np.frombuffer(a, "<u4", n), np.frombuffer(b, "<u4", n)
    return int(np.argmax(x != y))


_REPEATS = "doc_id long, start int, n_words int, other_id long, other_start int, right binary, left binary, edge int"


def _compare(rows: list[tuple]) -> list[tuple]:
    """Repeats (both ways) of each row (right, left, doc, at) with the one before it."""
    out = []
    for (r0, l0, d0, p0), (r1, l1, d1, p1) in zip(rows, rows[1:]):
        after = common(r0, r1)
        if after >= SEED:
            before = common(l0, l1)
            if after + before >= LENGTH and (d0, p0) != (d1, p1):
                a, b = p0 - before, p1 - before
                out += [(d0, a, after + before, d1, b), (d1, b, after + before, d0, a)]
    return out


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeats between sort neighbours; the partition's first and last row come out too, as edges."""

    def made(repeats: list[tuple], edges: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*repeats)) if repeats else [()] * 5
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32()]
        left = [pa.array(c, k) for c, k in zip(cols, kinds)]
        more = [pa.array([e[2] for e in edges], pa.int64()), pa.array([e[3] for e in edges], pa.int32()), pa.nulls(len(edges), pa.int32()), pa.nulls(len(edges), pa.int64()), pa.nulls(len(edges), pa.int32())]
        tail = [pa.array([None] * len(repeats) + [e[k] for e in edges], pa.binary()) for k in (0, 1)]
        flag = pa.array([0] * len(repeats) + [1] * len(edges), pa.int32())
        return pa.RecordBatch.from_arrays([*(pa.concat_arrays([a, b]) for a, b in zip(left, more)), *tail, flag], names=["doc_id", "start", "n_words", "other_id", "other_start", "right", "left", "edge"])

    last = None
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            rows = list(zip(*(c.to_pylist() for c in part.columns)))
            edges = [rows[0]] if last is None else []
            repeats = _compare(([last] if last is not None else []) + rows)
            last = rows[-1]
            yield made(repeats, edges)
    if last is not None:
        yield made([], [last])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key_a, key_b, doc_id, start, open) of the windows whose minimiser is wanted; open if no span covers the window."""
    for batch in batches:
        for at, to, w in blocks(batch.column(1)):
            if len(w.hash) < LENGTH:
                continue
            start, found = w.windows(LENGTH)
            low = minimisers(w, LENGTH, SEED)[2][start]
            row = w.row[start]
            of, seeds = listed(batch.column(2).slice(at, to - at))
            wanted = np.unique(mix(seeds.to_numpy(zero_copy_only=False).view(np.uint64)) ^ of.astype(np.uint64))
            ok = np.isin(mix(low) ^ row.astype(np.uint64), wanted)
            start, found, row = start[ok], found[ok], row[ok]
            covered = np.zeros(len(start), bool)
            of, spans = listed(batch.column(3).slice(at, to - at))
            if len(of):
                # Spans are sorted and apart, so the last one that begins at or before a window is the only one that can hold it.
                begin = w.first[of] + spans.field(0).to_numpy(zero_copy_only=False)
                end = begin + spans.field(1).to_numpy(zero_copy_only=False)
                last = np.searchsorted(begin, start, side="right") - 1
                covered = (last >= 0) & (end[last] >= start + LENGTH)
            ids = batch.column(0).slice(at, to - at).to_numpy(zero_copy_only=False)[row]
            keys = [pa.array(signed(found)), pa.array(signed(w.other_stretch(start, start + LENGTH)))]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(ids, pa.int64()), pa.array((start - w.first[row]).astype(np.int32)), pa.array(~covered)], names=["key_a", "key_b", "doc_id", "start", "open"])


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last: list[tuple] = []
    for batch in batches:
        rows = last + list(zip(*(c.to_pylist() for c in batch.columns)))
        last = rows[-1:]
        got = list(zip(*_compare(rows))) or [()] * 5
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(got, kinds)], names=["doc_id", "start", "n_words", "other_id", "other_start"])


def _by_doc(pairs: DataFrame) -> DataFrame:
    """(doc_id, spans, partner_ids): the merged spans and the partners of each document."""
    by_doc = pairs.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("start", "n_words"))).alias("raw"), F.collect_set("other_id").alias("others"))
    merged = F.aggregate(
        "raw",
        F.expr("cast(array() as array<struct<start:int,n_words:int>>)"),
        lambda done, s: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["start"] + F.element_at(done, -1)["n_words"] >= s["start"]),
            F.concat(
                F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))),
                F.array(F.struct(F.element_at(done, -1)["start"].alias("start"), (F.greatest(F.element_at(done, -1)["start"] + F.element_at(done, -1)["n_words"], s["start"] + s["n_words"]) - F.element_at(done, -1)["start"]).alias("n_words"))),
            ),
        ).otherwise(F.concat(done, F.array(s))),
    )
    return by_doc.select("doc_id", merged.alias("spans"), F.sort_array(F.array_except("others", F.array("doc_id"))).alias("partner_ids"))


def repeats(docs: DataFrame) -> DataFrame:
    """One row for each document of ``docs(doc_id, text)`` that holds a repeat.

    doc_id, n_words, n_repeated (words in repeats), spans (start, n_words; merged), and partner_ids: the
    ids of documents met as neighbours, or that hold a window no neighbour shares (its smallest and largest id).
    """
    texts = docs.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), "text")
    told = texts.mapInArrow(tidied(_describe), "doc_id long, n long, words_a long, words_b long, seeds array<long>")
    told = cut(told.filter(F.col("n") >= LENGTH))
    same = ["words_a", "words_b", "n"]
    classes = cut(told.groupBy(*same).agg(F.min(F.struct("doc_id", "seeds")).alias("first"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("times")))
    seeds = classes.select(F.col("low").alias("doc_id"), F.posexplode("first.seeds").alias("place", "seed"))
    twice = cut(seeds.groupBy("seed").agg(F.count("*").alias("times")).filter("times > 1"))
    wanted = cut(spread_join(seeds, twice.select("seed"), ["seed"], hot_keys(twice, "seed")).groupBy("doc_id").agg(F.collect_set("seed").alias("seeds")))
    drop(twice)
    suffixes = texts.join(wanted, "doc_id").select("doc_id", "text", "seeds").mapInArrow(tidied(_suffixes), "right binary, left binary, doc_id long, at int")
    order = ["right", "doc_id", "at"]
    # Written first, as sorting by range reads its input twice; the sample that sets the ranges has a million rows at most.
    suffixes = cut(suffixes)
    found = cut(suffixes.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(tidied(_neighbours), _REPEATS))
    drop(suffixes)
    # Two rows a partition: their number follows the partitions, not the rows.
    edges = found.filter("edge = 1").select("right", "left", "doc_id", F.col("start").alias("at")).coalesce(1).sortWithinPartitions(*order)
    plain = ["doc_id", "start", "n_words", "other_id", "other_start"]
    across = edges.mapInArrow(_edges, "doc_id long, start int, n_words int, other_id long, other_start int")
    pairs = cut(found.filter("edge = 0").select(*plain).union(across))
    drop(found)
    near = cut(_by_doc(pairs))
    marked = texts.join(wanted.join(near.select("doc_id", "spans"), "doc_id", "left"), "doc_id").select("doc_id", "text", "seeds", "spans")
    windows = cut(marked.mapInArrow(tidied(_windows), "key_a long, key_b long, doc_id long, start int, open boolean"))
    drop(near, wanted)
    # One place has one id and one start, also where its row is repeated.
    keys = ["key_a", "key_b"]
    places = windows.groupBy(*keys).agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.min("start").alias("first"), F.max("start").alias("last"), F.count_if("open").alias("times"))
    places = cut(places.filter("times > 0 and (low < high or first < last)").select(*keys, "low", "high", "times"))
    hidden = spread_join(windows.filter("open").select(*keys, "doc_id", "start"), places.drop("times"), keys, hot_keys(places, *keys)).select("doc_id", "start", "low", "high")
    more = hidden.select("doc_id", "start", F.lit(LENGTH).alias("n_words"), F.explode(F.array("low", "high")).alias("other_id"))
    spans = cut(_by_doc(pairs.select("doc_id", "start", "n_words", "other_id").union(more)))
    drop(pairs, windows, places)
    all_of = F.array(F.struct(F.lit(0).alias("start"), F.col("n").cast("int").alias("n_words")))
    class_spans = classes.select(*same, "low", "high", "times").join(spans.withColumnRenamed("doc_id", "low"), "low", "left")
    class_spans = cut(class_spans.filter("low < high or spans is not null"))
    out = spread_join(told.select("doc_id", *same).distinct(), class_spans.drop("times"), same, hot_keys(class_spans, *same))
    copied = F.col("low") < F.col("high")
    chosen = F.when(copied, all_of).otherwise(F.col("spans"))
    partners = F.when(copied, F.sort_array(F.array_distinct(F.concat(F.coalesce("partner_ids", F.array().cast("array<long>")), F.array(F.when(F.col("doc_id") == F.col("low"), F.col("high")).otherwise(F.col("low"))))))).otherwise(F.col("partner_ids"))
    out = out.select("doc_id", F.col("n").alias("n_words"), chosen.alias("spans"), partners.alias("partner_ids"))
    return out.select("doc_id", "n_words", F.aggregate("spans", F.lit(0).cast("long"), lambda t, s: t + s["n_words"]).alias("n_repeated"), "spans", "partner_ids")
