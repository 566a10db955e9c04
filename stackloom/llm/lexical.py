"""Ranked lexical search over a document FP-tree (operator 12).

Terms are runs of ASCII letters, digits and non-ASCII characters, A-Z folded, told by 64-bit hashes.  A document's
score for an item sums, over the item's distinct terms, w * ((10^9 * tf) div (1000 * tf + 8 * m)): w falls with the number
of documents that hold the term, m grows with the document's length (see ``weight`` and ``norms``).

Documents are first restricted to terms of items: a written table of term frequencies, from which counts over
all documents follow.  In a second pass each task sorts a slice of these vectors, terms from frequent to rare, so that documents
with equal beginnings share the paths of a trie.  Its nodes are stretches of the sorted slice, and have the subtree's
smallest m and, by term, its largest tf: no document below a node scores more than these two give.  Each
item goes through the trie depth first, best child first, and leaves out subtrees whose bound is below the
score of its k-th best document so far, over all slices of the task.  All items of a group do so in step, so that
bounds and scores are computed by arrays.  Small neighbouring children make one leaf, whose documents are scored.

Items are a stated query set, taken in blocks of ``BLOCK_TERMS`` terms and one item at most, one pass over the documents for
each block; the driver and each task hold one block at a time.  No text and no vector is shuffled, only k rows of each task and item.
Scores are whole numbers and the result is exact, but for equal hashes of different terms.

Documents that are null or without terms are never found nor counted; those without an id count, but are not
returned.  Every row is a document of its own, repeated ones too.  Benchmark rows of one id are one item with the terms of all; rows
without id or terms find nothing.  Very long texts are read whole; other columns are ignored; empty tables give an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stackloom.checkpoints import cut, drop, running_total
from stackloom.llm._words import Words, blocks, signed, tidied

BLOCK_TERMS = 200_000
#: Documents and terms of a slice.
ROWS, ENTRIES = 8192, 400_000
#: Terms of a path that are told apart, rows of a leaf (about), items in step, nodes that they visit at a time.
DEPTH, LEAF, ITEMS, STEP = 64, 16, 256, 1024
_BITS = 22
_FAR = np.iinfo(np.int64).max


def weight(n_docs: int, df: int) -> int:
    return floor(1000 * log((2 * n_docs + 2) / (2 * df + 1)))


def norms(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """The m of documents with n terms each."""
    if int(n.max(initial=0)) * 90 * n_docs < 1 << 62:
        return 10 + (90 * n_docs * n) // n_terms
    return np.array([10 + 90 * n_docs * x // n_terms for x in n.tolist()], np.int64)


def part_scores(w: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return w * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


@dataclass
class Items:
    """A block of items: ``term[first[i]:first[i + 1]]`` are the places of item i's terms in ``hashes``, which ascend."""

    ids: np.ndarray
    first: np.ndarray
    term: np.ndarray
    hashes: np.ndarray

    @classmethod
    def of(cls, ids: np.ndarray, first: np.ndarray, hashes: np.ndarray) -> Items:
        distinct, term = np.unique(hashes, return_inverse=True)
        return cls(ids, first, term, distinct)


@dataclass
class Search:
    """What a search needs besides the vectors: weights and ranks (from frequent to rare) of terms, and counts."""

    items: Items
    weight: np.ndarray
    rank: np.ndarray
    n_docs: int
    n_terms: int
    k: int


def _restricted(shared: Broadcast):
    """(doc_id, n, terms, tfs): number of terms with repeats, and the items' terms among them with their counts."""

    def of(w: Words, items: Items, bitmap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        maybe = np.flatnonzero(bitmap[w.hash >> np.uint64(64 - _BITS)])
        place = np.minimum(np.searchsorted(items.hashes, w.hash[maybe]), len(items.hashes) - 1)
        ok = items.hashes[place] == w.hash[maybe]
        key, tf = np.unique(w.row[maybe[ok]] * len(items.hashes) + place[ok], return_counts=True)
        row, term = np.divmod(key, len(items.hashes))
        return np.searchsorted(row, np.arange(w.n_rows + 1)).astype(np.int32), term.astype(np.int32), tf.astype(np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value
        bitmap = np.zeros(1 << _BITS, bool)
        bitmap[items.hashes >> np.uint64(64 - _BITS)] = True
        for batch in batches:
            for at, to, w in blocks(batch.column(1), lower=True, letters=True):
                first, term, tf = of(w, items, bitmap)
                lists = (pa.ListArray.from_arrays(pa.array(first), pa.array(x)) for x in (term, tf))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), pa.array(np.diff(w.first)), *lists], names=["doc_id", "n", "terms", "tfs"])

    return run


class Tree:
    """The trie of one slice: rows sorted by their ranks, nodes as stretches of rows, children one after another."""

    def __init__(self, ids: np.ndarray, m: np.ndarray, first: np.ndarray, rank: np.ndarray, tf: np.ndarray):
        """``first`` bounds the terms of each row."""
        row = np.repeat(np.arange(len(ids)), np.diff(first))
        order = np.lexsort((rank, row))
        rank, tf = rank[order], tf[order]
        paths = rank.astype(">u4").tobytes()
        rows = sorted(range(len(ids)), key=lambda i: (paths[4 * first[i] : 4 * first[i + 1]], ids[i]))
        self.ids, self.m = ids[rows], m[rows]
        place = np.empty(len(rows), np.int64)
        place[rows] = np.arange(len(rows))
        # Postings by term, in the order of the sorted rows.
        key = rank.astype(np.int64) * len(rows) + place[row]
        order = np.argsort(key)
        self.key, self.tf = key[order], tf[order].astype(np.int64)
        self.most = _maxima(self.tf)
        self.grow(self.shared(first, rank, rows))

    def shared(self, first: np.ndarray, rank: np.ndarray, rows: list[int]) -> np.ndarray:
        """How many first terms each sorted row shares with the one before, up to DEPTH."""
        size = np.minimum(np.diff(first), DEPTH)
        wide = np.full((len(rows), max(int(size.max(initial=0)), 1)), -1, np.int64)
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        wide[np.repeat(np.arange(len(rows)), size), place] = rank[np.repeat(first[:-1], size) + place]
        wide = wide[rows]
        same = (wide[1:] == wide[:-1]) & (wide[1:] >= 0)
        return np.concatenate([[0], np.minimum.accumulate(same, axis=1).sum(axis=1)])

    def grow(self, shared: np.ndarray) -> None:
        """Cut stretches where the fewest terms are shared, level by level, until they are leaves."""
        starts, ends, children, n_children = [np.array([0])], [np.array([len(shared)])], [], []
        known = 1
        while len(starts[-1]):
            a, b = starts[-1], ends[-1]
            inner = np.flatnonzero(b - a > 2 * LEAF)
            size = (b - a)[inner]
            node = np.repeat(np.arange(len(inner)), size)
            place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            at = a[inner][node] + place
            level = np.where(place == 0, _FAR, shared[at])
            fewest = np.minimum.reduceat(level, np.cumsum(size) - size) if len(inner) else np.empty(0, np.int64)
            # Where all rows are alike any place will do.
            alike = np.minimum.reduceat(np.where(place == 0, True, level == fewest[node]), np.cumsum(size) - size) if len(inner) else np.empty(0, bool)
            edge = (place == 0) | np.where(alike[node], place % LEAF == 0, level == fewest[node])
            begin = np.flatnonzero(edge)
            length = np.diff(np.append(begin, len(edge)))
            # Small neighbours of one parent and one block make one child.
            joined = np.concatenate([[False], (length[1:] <= LEAF) & (length[:-1] <= LEAF) & (at[begin[1:]] // LEAF == at[begin[:-1]] // LEAF) & (place[begin[1:]] > 0)]) if len(begin) else np.empty(0, bool)
            begin = begin[~joined]
            stop = np.append(begin[1:], len(edge)) if len(begin) else begin
            count = np.zeros(len(a), np.int64)
            count[inner] = np.bincount(node[begin], minlength=len(inner))
            children.append(np.where(count > 0, known + np.cumsum(count) - count, -1))
            n_children.append(count)
            starts.append(at[begin])
            ends.append(at[stop - 1] + 1 if len(begin) else begin)
            known += len(begin)
        self.start, self.end = np.concatenate(starts), np.concatenate(ends)
        self.child, self.n_children = np.concatenate(children), np.concatenate(n_children)
        self.least_m, self.least_id = (_least(x, self.start, self.end) for x in (self.m, self.ids))

    def postings(self, rank: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The stretch of postings of each term under each node."""
        base = rank * len(self.ids)
        return np.searchsorted(self.key, base + self.start[node]), np.searchsorted(self.key, base + self.end[node])

    def most_tf(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The largest tf of each stretch, 0 where it is empty."""
        size = np.maximum(hi - lo, 1)
        level = np.frexp(size)[1] - 1
        last = len(self.tf) - 1
        both = np.maximum(self.most[level, np.minimum(lo, last)], self.most[level, np.clip(hi - (1 << level), 0, last)])
        return np.where(hi > lo, both, 0).astype(np.int64)


def _maxima(tf: np.ndarray) -> np.ndarray:
    """Row k: the largest of the 2**k values from each place on."""
    levels = [np.minimum(tf, np.iinfo(np.int32).max).astype(np.int32)]
    while 1 << len(levels) <= len(tf):
        half = 1 << (len(levels) - 1)
        below = levels[-1]
        levels.append(np.concatenate([np.maximum(below[:-half], below[half:]), below[-half:]]))
    return np.stack(levels)


def _least(x: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The smallest value of each stretch."""
    bounds = np.stack([start, end], axis=1).ravel()
    return np.minimum.reduceat(np.append(x, _FAR), bounds)[::2]


class Best:
    """The k best documents of each item so far, scores from high to low, equal ones by id."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score, self.id = np.zeros((n, k), np.int64), np.full((n, k), _FAR)

    def open(self, item: np.ndarray, bound: np.ndarray, least_id: np.ndarray) -> np.ndarray:
        """Whether a document of that bound and id, or a larger one, may still be among an item's best."""
        last = self.score[item, -1]
        return (bound > last) | (bound == last) & (bound > 0) & (least_id <= self.id[item, -1])

    def add(self, item: np.ndarray, id_: np.ndarray, score: np.ndarray) -> None:
        ok = self.open(item, score, id_)
        item, id_, score = item[ok], id_[ok], score[ok]
        if not len(item):
            return
        known = np.unique(item)
        item = np.concatenate([item, np.repeat(known, self.k)])
        id_, score = np.concatenate([id_, self.id[known].ravel()]), np.concatenate([score, self.score[known].ravel()])
        order = np.lexsort((id_, -score, item))
        item, id_, score = item[order], id_[order], score[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        kept = place < self.k
        self.score[item[kept], place[kept]], self.id[item[kept], place[kept]] = score[kept], id_[kept]


def _spread(first: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in ``of``, place in the lists) of every member of the lists ``of`` that ``first`` bounds."""
    size = first[of + 1] - first[of]
    owner = np.repeat(np.arange(len(of)), size)
    return owner, first[of][owner] + np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)


def walk(tree: Tree, search: Search, items: np.ndarray, best: Best) -> int:
    """Take the ``items`` through the tree, depth first; returns how many documents were scored."""
    own = search.items
    item, node, bound = items, np.zeros(len(items), np.int64), np.full(len(items), _FAR)
    scored = 0
    while len(item):
        some = slice(max(len(item) - STEP, 0), None)
        now_item, now_node, now_bound = item[some], node[some], bound[some]
        item, node, bound = (x[: some.start] for x in (item, node, bound))
        ok = best.open(now_item, now_bound, tree.least_id[now_node])
        now_item, now_node = now_item[ok], now_node[ok]
        leaf = tree.n_children[now_node] == 0
        scored += _score(tree, search, now_item[leaf], now_node[leaf], best)
        parent, child = _spread(np.append(0, np.cumsum(tree.n_children[now_node[~leaf]])), np.arange(int((~leaf).sum())))
        next_item = now_item[~leaf][parent]
        offset = child - np.append(0, np.cumsum(tree.n_children[now_node[~leaf]]))[parent]
        next_node = tree.child[now_node[~leaf]][parent] + offset
        owner, at = _spread(own.first, next_item)
        term = own.term[at]
        lo, hi = tree.postings(search.rank[term], next_node[owner])
        part = part_scores(search.weight[term], tree.most_tf(lo, hi), tree.least_m[next_node[owner]])
        total = np.zeros(len(next_item), np.int64)
        np.add.at(total, owner, part)
        ok = best.open(next_item, total, tree.least_id[next_node])
        next_item, next_node, total = next_item[ok], next_node[ok], total[ok]
        # Each item's best child is on top of the stack, then its second best.
        order = np.lexsort((-total, next_item))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order)) - np.searchsorted(next_item[order], next_item[order])
        order = np.argsort(-place, kind="stable")
        item, node, bound = (np.concatenate([x, y[order]]) for x, y in ((item, next_item), (node, next_node), (bound, total)))
    return scored


def _score(tree: Tree, search: Search, item: np.ndarray, leaf: np.ndarray, best: Best) -> int:
    """Score the documents of each item's leaf."""
    size = tree.end[leaf] - tree.start[leaf]
    first = np.append(0, np.cumsum(size))
    owner, at = _spread(search.items.first, item)
    term = search.items.term[at]
    lo, hi = tree.postings(search.rank[term], leaf[owner])
    of = np.repeat(np.arange(len(owner)), hi - lo)
    place = lo[of] + np.arange(len(of)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)
    row = tree.key[place] % len(tree.ids)
    total = np.zeros(first[-1], np.int64)
    np.add.at(total, first[owner[of]] + row - tree.start[leaf[owner[of]]], part_scores(search.weight[term[of]], tree.tf[place], tree.m[row]))
    pair = np.repeat(np.arange(len(leaf)), size)
    row = tree.start[leaf][pair] + np.arange(len(pair)) - first[pair]
    best.add(item[pair], tree.ids[row], total)
    return len(pair)


def _found(shared: Broadcast):
    """(item_id, doc_id, score) of the best documents of all vectors of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search: Search = shared.value
        n_items = len(search.items.ids)
        best = Best(n_items, search.k)

        def done(held: list[pa.RecordBatch]) -> None:
            one = pa.Table.from_batches(held).combine_chunks()
            get = lambda c: one.column(c).combine_chunks()
            terms, tfs = get("terms"), get("tfs")
            first = np.concatenate([[0], np.cumsum(terms.value_lengths().to_numpy())]).astype(np.int64)
            rank = search.rank[terms.flatten().to_numpy()]
            tree = Tree(get("doc_id").to_numpy(), norms(get("n").to_numpy(), search.n_docs, search.n_terms), first, rank, tfs.flatten().to_numpy())
            for at in range(0, n_items, ITEMS):
                walk(tree, search, np.arange(at, min(at + ITEMS, n_items)), best)

        held: list[pa.RecordBatch] = []
        rows = entries = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                held.append(part)
                rows += part.num_rows
                entries += len(part.column("terms").flatten())
                if rows >= ROWS or entries >= ENTRIES:
                    done(held)
                    held, rows, entries = [], 0, 0
        if held and rows:
            done(held)
        item, place = np.nonzero(best.score)
        out = (search.items.ids[item], best.id[item, place], best.score[item, place])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["item_id", "doc_id", "score"])

    return run


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, to, w in blocks(batch.column(1), lower=True, letters=True):
            lists = pa.ListArray.from_arrays(pa.array(w.first.astype(np.int32)), pa.array(signed(w.hash)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), lists], names=["item_id", "terms"])


def _item_blocks(benchmark: DataFrame, limit: int) -> Iterator[Items]:
    """Blocks of items, which begin within ``limit`` terms."""
    rows = benchmark.select(F.col("item_id").cast("long"), "text").filter("item_id is not null and text is not null")
    rows = rows.mapInArrow(tidied(_tokens), "item_id long, terms array<long>")
    rows = rows.groupBy("item_id").agg(F.array_distinct(F.flatten(F.collect_list(F.array_distinct("terms")))).alias("terms")).filter(F.size("terms") > 0)
    placed = running_total(rows, F.size("terms"), ["item_id"], "before")
    placed = cut(placed.select(F.floor(F.col("before") / F.lit(limit)).alias("block"), "item_id", "terms"))
    for (block,) in placed.select("block").distinct().orderBy("block").collect():
        part = placed.filter(F.col("block") == block).orderBy("item_id").toArrow().combine_chunks()
        lists = part.column("terms").combine_chunks()
        first = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]).astype(np.int64)
        yield Items.of(part.column("item_id").to_numpy(), first, lists.flatten().to_numpy().view(np.uint64))
    drop(placed)


def _of_block(docs: DataFrame, items: Items, k: int) -> DataFrame:
    """(item_id, doc_id, score): each task's best documents of each item, written."""
    context = docs.sparkSession.sparkContext
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).filter(F.col("text").isNotNull())
    vectors = cut(rows.mapInArrow(tidied(_restricted(context.broadcast(items))), "doc_id long, n long, terms array<int>, tfs array<int>").filter("n > 0"))
    n_docs, n_terms = vectors.agg(F.count("*"), F.sum("n")).first()
    # A row for each term of the block at most.
    known = vectors.select(F.explode("terms").alias("term")).groupBy("term").count().collect()
    df = np.zeros(len(items.hashes), np.int64)
    for term, count in known:
        df[term] = count
    rank = np.empty(len(df), np.int64)
    rank[np.argsort(-df, kind="stable")] = np.arange(len(df))
    weights = np.array([weight(n_docs, x) for x in df.tolist()], np.int64)
    shared = context.broadcast(Search(items, weights, rank, n_docs, n_terms or 1, k))
    searched = vectors.filter((F.size("terms") > 0) & F.col("doc_id").isNotNull())
    found = cut(searched.mapInArrow(tidied(_found(shared)), "item_id long, doc_id long, score long"))
    drop(vectors)
    return found


def search(docs: DataFrame, benchmark: DataFrame, k: int = 10, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k highest-scoring rows of ``docs(doc_id, text)`` for each item of ``benchmark(item_id, text)``."""
    parts = [_of_block(docs, items, k) for items in _item_blocks(benchmark, block_terms)]
    if not parts:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    ranked = reduce(DataFrame.union, parts).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")


#: DuckDB SQL that scores every document that shares a term.
SQL = r"""
WITH lx_docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents WHERE text IS NOT NULL
), lx_all AS (
  SELECT count(*) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS n_terms FROM lx_docs WHERE len(t) > 0
), lx_items AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark WHERE text IS NOT NULL
), lx_tf AS (
  SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(t) AS n, unnest(t) AS term FROM lx_docs) WHERE term IN (SELECT term FROM lx_items) GROUP BY r, doc_id, n, term
), lx_w AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM lx_tf, lx_all GROUP BY term, n_docs
), lx_scores AS (
  SELECT i.item_id, f.r, f.doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM lx_items i JOIN lx_tf f USING (term) JOIN lx_w USING (term), lx_all GROUP BY i.item_id, f.r, f.doc_id
), lx_ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM lx_scores WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM lx_ranked WHERE rank <= 10
"""
