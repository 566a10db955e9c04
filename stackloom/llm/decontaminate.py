"""Benchmark decontamination by spaced-seed hashing (operator 4).

Tokens are runs of ASCII letters, digits and non-ASCII characters, A-Z folded.  Each of a few fixed
masks ignores some token positions; the hashes of the positions it keeps join benchmark and document
tokens.  Around each hit, benchmark item and document are compared token by token along the hit's
diagonal, and the stretch with the best score (match +1, substitution -2) is kept.  A document holds
an item if some stretch matches ``MIN_MATCH`` tokens, or for shorter items ``SHORT_SHARE`` of them.
Items with up to ``SHORT`` tokens may miss a fifth of them.  Their tokens are split into more parts than
may be missed, and one mask for each choice of that many parts ignores these: as some choice holds all
missed tokens, no short item is lost.  Rows are padded, so that items may overhang a text's ends.
Of longer items, stretches whose matches lie so scattered that no mask fits them stay unseen.

The benchmark is a stated query set: its tokens are hashed and counted by Spark and broadcast in blocks
of ``BLOCK_TOKENS`` tokens and one item at most, one pass over the documents for each block.  With one block no
document is shuffled.  With more, each pass writes the leaks of its texts by two hashes of the text, and a join brings them to the
documents; so the driver and each Python worker hold one block at a time, however many there are.

Null and empty texts hold nothing; null, empty and repeated items are passed over, or reported each
under its own id; items without a token are never found.  Repeated documents are reported alike;
other columns pass through (an existing ``leaks`` column is replaced); empty tables give empty lists.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stackloom.checkpoints import cut, drop, running_total
from stackloom.llm._jobs import hot_keys, spread_join, unused
from stackloom.llm._words import Words, blocks, mix, signed, tidied

# Token positions that count (1) and that are ignored (0).
MASKS = ("1111111", "1101100111", "11100101101", "101100011101", "1011001101", "110001010011")
MIN_MATCH = 13
SHORT_SHARE = 0.8
#: The most tokens of which SHORT_SHARE is less than MIN_MATCH.
SHORT = 15
PAD = 3
BLOCK_TOKENS = 1_000_000
#: Hits that are expanded at a time, and tokens that are compared at a time.
HITS, CELLS = 1_000_000, 1_000_000
_BITS = 22
_COEFFICIENTS = np.random.default_rng(31).integers(1, 1 << 63, (len(MASKS) + 64, 64), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LEAK = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("n_matched", T.IntegerType()), T.StructField("doc_token", T.IntegerType()), T.StructField("item_token", T.IntegerType()), T.StructField("n_tokens", T.IntegerType())])


def needed(n: int) -> int:
    """Matches that an item of n tokens needs."""
    return min(MIN_MATCH, -(-int(100 * SHORT_SHARE) * n // 100))


def seeds(token: np.ndarray, row: np.ndarray, keep: list[int], salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of a mask's windows inside one row, and the hashes of the kept tokens."""
    span = keep[-1] + 1
    n = len(token) - span + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in keep:
        total += token[k : k + n] * _COEFFICIENTS[salt, k]
    ok = np.flatnonzero(row[:n] == row[span - 1 :])
    return ok, mix(total[ok])


def short_masks(n: int) -> tuple[list[int], list[tuple[int, ...]]]:
    """Bounds of the parts of an item of n tokens, and the parts that each mask keeps."""
    missed = n - needed(n)
    parts = n if missed < 2 else 6
    ignored = combinations(range(parts), missed)
    return [n * k // parts for k in range(parts + 1)], [tuple(k for k in range(parts) if k not in x) for x in ignored]


def short_seeds(token: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """For each mask of items of n tokens, the hashes at every start."""
    size = len(token) - n + 1
    if size <= 0:
        return
    bounds, masks = short_masks(n)
    of_part = []
    for a, b in zip(bounds, bounds[1:]):
        total = np.zeros(size, np.uint64)
        for k in range(a, b):
            total += token[k : k + size] * _COEFFICIENTS[len(MASKS) + n, k]
        of_part.append(total)
    for kept in masks:
        total = np.zeros(size, np.uint64)
        for k in kept:
            total += of_part[k]
        yield mix(total)


def padded(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Tokens with PAD empty places between rows and at both ends, and each place's row (-1 where empty)."""
    place = np.arange(len(w.hash)) + PAD * (w.row + 1)
    size = len(w.hash) + PAD * (w.n_rows + 1)
    token, row = np.zeros(size, np.uint64), np.full(size, -1)
    token[place], row[place] = w.hash, w.row
    return token, row


def _lookup(keys: np.ndarray, places: np.ndarray, key: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(index into ``key``, place) of every equal key, in slices of about HITS."""
    lo, hi = np.searchsorted(keys, key), np.searchsorted(keys, key, side="right")
    hit = np.flatnonzero(hi > lo)
    lo, n = lo[hit], (hi - lo)[hit]
    upto = np.concatenate([[0], np.cumsum(n)])
    at = 0
    while at < len(hit):
        to = max(at + 1, int(np.searchsorted(upto, upto[at] + HITS, side="right")) - 1)
        size = n[at:to]
        yield np.repeat(hit[at:to], size), places[np.repeat(lo[at:to] - upto[at:to] + upto[at], size) + np.arange(upto[to] - upto[at])]
        at = to


@dataclass
class Index:
    """Seeds of one block of benchmark items."""

    item: np.ndarray
    token: np.ndarray
    first: np.ndarray
    long: list[tuple[list[int], int, np.ndarray, np.ndarray]]
    short: list[tuple[int, list[tuple[np.ndarray, np.ndarray]]]]
    bitmap: np.ndarray

    @classmethod
    def of(cls, item: np.ndarray, token: np.ndarray, first: np.ndarray) -> Index:
        """Of all items' token hashes one after another; ``first`` bounds the tokens of each."""
        lengths = np.diff(first)
        row = np.repeat(np.arange(len(item)), lengths)
        bitmap = np.zeros(1 << _BITS, bool)

        def ordered(key: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            bitmap[key >> np.uint64(64 - _BITS)] = True
            order = np.argsort(key)
            return key[order], at[order]

        long, short = [], []
        if (lengths > SHORT).any():
            for salt, mask in enumerate(MASKS):
                keep = [k for k, c in enumerate(mask) if c == "1"]
                at, key = seeds(token, row, keep, salt)
                own = lengths[row[at]] > SHORT
                long.append((keep, salt, *ordered(key[own], at[own])))
        for n in sorted({int(n) for n in lengths if 0 < n <= SHORT}):
            at = first[:-1][lengths == n]
            joined = np.concatenate([token[x : x + n] for x in at])
            short.append((n, [ordered(key[::n], at) for key in short_seeds(joined, n)]))
        return cls(item, token, first, long, short, bitmap)

    def hits(self, w: Words) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row, document token less item token, item token) of every equal seed, HITS at a time."""
        for keep, salt, keys, places in self.long:
            at, key = seeds(w.hash, w.row, keep, salt)
            maybe = np.flatnonzero(self.bitmap[key >> np.uint64(64 - _BITS)])
            for of, there in _lookup(keys, places, key[maybe]):
                here = at[maybe[of]]
                yield w.row[here], here - there, there
        if self.short:
            token, row = padded(w)
        for n, masks in self.short:
            # An item overhangs by PAD tokens at most, so its middle lies in its row.
            middle = row[n // 2 : n // 2 + max(len(token) - n + 1, 0)]
            for (keys, places), key in zip(masks, short_seeds(token, n)):
                maybe = np.flatnonzero(self.bitmap[key >> np.uint64(64 - _BITS)] & (middle >= 0))
                for of, there in _lookup(keys, places, key[maybe]):
                    here = maybe[of]
                    yield middle[here], here - PAD * (middle[here] + 1) - there, there

    def leaks(self, w: Words) -> list[list[dict]]:
        """The best stretch of every item that a row holds, of equal ones that of the first diagonal.

        Pairs of item and diagonal are verified once a mask and slice of hits, many at a time: hot seeds, as of an opening that many items
        share, cost a few array operations for each pair and no more.
        """
        out: list[dict[int, tuple]] = [{} for _ in range(w.n_rows)]
        n_items, reach = len(self.item), len(self.token) + 1
        for rows, gaps, there in self.hits(w):
            item = np.searchsorted(self.first, there, side="right") - 1
            key = np.unique((rows * n_items + item) * (len(w.hash) + 2 * reach) + gaps + reach)
            pair, gap = np.divmod(key, len(w.hash) + 2 * reach)
            row, item = np.divmod(pair, n_items)
            for found in self.verified(w, row, item, gap - reach):
                for r, k, matched, doc, own, size in zip(*(x.tolist() for x in found)):
                    if k not in out[r] or (-matched, doc - own) < out[r][k][:2]:
                        out[r][k] = (-matched, doc - own, doc, own, size)
        names = ("item_id", "n_matched", "doc_token", "item_token", "n_tokens")
        made = ([dict(zip(names, (int(self.item[k]), -m, doc, own, size))) for k, (m, _, doc, own, size) in x.items()] for x in out)
        return [sorted(x, key=lambda y: (y["item_id"], y["doc_token"])) for x in made]

    def verified(self, w: Words, row: np.ndarray, item: np.ndarray, gap: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """(row, item, matched, document token, item token, tokens) of the diagonals whose best stretch is long enough."""
        lo = np.maximum(self.first[item], w.first[row] - gap)
        size = np.minimum(self.first[item + 1], w.first[row + 1] - gap) - lo
        need = np.array([needed(n) for n in range(SHORT + 2)])[np.minimum(np.diff(self.first)[item], SHORT + 1)]
        order = np.argsort(size, kind="stable")
        order = order[size[order] >= need[order]]
        at = 0
        while at < len(order):
            # So many that their widest row still makes a table of CELLS.
            to = at + max(1, int(np.searchsorted(np.arange(1, len(order) - at + 1) * size[order[at:]], CELLS, side="right")))
            some, at = order[at:to], to
            place = np.arange(int(size[some[-1]]))
            inside = place < size[some, None]
            own = np.minimum(lo[some, None] + place, len(self.token) - 1)
            same = (self.token[own] == w.hash[np.minimum(own + gap[some, None], len(w.hash) - 1)]) & inside
            able = np.flatnonzero(same.sum(axis=1) >= need[some])
            some, same = some[able], same[able]
            begin, end = best_stretches(same, size[some])
            sums = np.concatenate([np.zeros((len(some), 1), np.int64), np.cumsum(same, axis=1)], axis=1)
            each = np.arange(len(some))
            matched = sums[each, end] - sums[each, begin]
            ok = matched >= need[some]
            some, begin, end, matched = some[ok], begin[ok], end[ok], matched[ok]
            start = lo[some] + begin
            yield row[some], item[some], matched, start + gap[some] - w.first[row[some]], start - self.first[item[some]], end - begin


def best_stretches(same: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of ``same``, as far as its ``size``: the first stretch with the highest score; a match counts 1, another token -2."""
    each = np.arange(len(same))
    sums = np.concatenate([np.zeros((len(same), 1), np.int64), np.cumsum(np.where(same, 1, -2), axis=1)], axis=1)
    gain = sums - np.minimum.accumulate(sums, axis=1)
    gain[np.arange(sums.shape[1]) > size[:, None]] = -1
    end = gain.argmax(axis=1)
    begin = np.where(np.arange(sums.shape[1]) <= end[:, None], sums, sums.max(initial=0) + 1).argmin(axis=1)
    return begin, end


def best_stretch(same: np.ndarray) -> tuple[int, int]:
    """The first stretch with the highest score: a match counts 1, another token -2."""
    sums = np.concatenate([[0], np.cumsum(np.where(same, 1, -2))])
    low = np.minimum.accumulate(sums)
    end = int(np.argmax(sums - low))
    return int(np.argmin(sums[: end + 1])), end


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item_id, tokens): the hashes of each item's tokens."""
    for batch in batches:
        for at, to, w in blocks(batch.column(1), lower=True, letters=True):
            lists = pa.ListArray.from_arrays(pa.array(w.first.astype(np.int32)), pa.array(signed(w.hash)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), lists], names=["item_id", "tokens"])


def _item_blocks(benchmark: DataFrame, limit: int) -> Iterator[Index]:
    """Indexes of blocks of items; a block's items begin within ``limit`` tokens."""
    rows = benchmark.select(F.col("item_id").cast("long"), "text").filter("item_id is not null and text is not null")
    rows = rows.mapInArrow(tidied(_tokens), "item_id long, tokens array<long>").filter(F.size("tokens") > 0)
    placed = running_total(rows, F.size("tokens"), ["item_id", "tokens"], "before")
    placed = cut(placed.select(F.floor(F.col("before") / F.lit(limit)).alias("block"), "item_id", "tokens"))
    for (block,) in placed.select("block").distinct().orderBy("block").collect():
        part = placed.filter(F.col("block") == block).orderBy("item_id", "tokens").toArrow().combine_chunks()
        lists = part.column("tokens").combine_chunks()
        first = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
        yield Index.of(part.column("item_id").to_numpy(), lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), first)


_KIND = pa.list_(pa.struct([("item_id", pa.int64()), ("n_matched", pa.int32()), ("doc_token", pa.int32()), ("item_token", pa.int32()), ("n_tokens", pa.int32())]))


def _with_leaks(docs: DataFrame, block: Index, names: list[str], only: bool = False) -> DataFrame:
    """``docs`` with the leaks of one block's items; ``only`` rows that have some."""
    index = docs.sparkSession.sparkContext.broadcast(block)
    schema = T.StructType([docs.schema[c] for c in names] + [T.StructField("leaks", T.ArrayType(LEAK))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, w in blocks(batch.column("text"), lower=True, letters=True):
                part = batch.slice(at, to - at)
                made = pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(index.value.leaks(w), _KIND)], names=[*names, "leaks"])
                yield made.filter(pc.greater(pc.list_value_length(made.column("leaks")), 0)) if only else made

    return docs.mapInArrow(tidied(run), schema)


def flag(docs: DataFrame, benchmark: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Adds ``leaks``: for each benchmark item that the whole text holds, its best stretch."""
    names = [c for c in docs.columns if c.lower() != "leaks"]
    docs = docs.select(*names)
    made = _item_blocks(benchmark, block_tokens)
    first, second = next(made, None), next(made, None)
    if first is None:
        return docs.withColumn("leaks", F.array().cast(T.ArrayType(LEAK)))
    if second is None:
        return _with_leaks(docs, first, names)
    # Each block's leaks are written before the next block is made: a pass and a Python worker of its own.
    one, two, held = (unused(c, names) for c in ("_text_a", "_text_b", "_leaks"))
    told = docs.select("text", F.xxhash64("text").alias(one), F.xxhash64(F.lit(1), "text").alias(two))
    parts = [cut(_with_leaks(told, block, ["text", one, two], only=True).drop("text").dropDuplicates([one, two])) for block in chain([first, second], made)]
    texts = reduce(DataFrame.union, parts).groupBy(one, two).agg(F.array_sort(F.flatten(F.collect_list("leaks")), _earlier).alias(held))
    texts = cut(texts)
    drop(*parts)
    # Null texts have a key as well, so that a join deals them like other frequent texts.
    keyed = docs.withColumns({one: F.xxhash64("text"), two: F.xxhash64(F.lit(1), "text")})
    hot = hot_keys(keyed.groupBy(one, two).agg(F.count("*").alias("times")), one, two)
    out = spread_join(keyed, texts, [one, two], hot, "left")
    return out.select(*names, F.coalesce(held, F.array().cast(T.ArrayType(LEAK))).alias("leaks"))


def _earlier(x: Column, y: Column) -> Column:
    """Order of leaks by item and place."""
    key = lambda z: F.struct(z["item_id"], z["doc_token"])
    return F.when(key(x) < key(y), -1).when(key(x) > key(y), 1).otherwise(0)


def rows(flagged: DataFrame) -> DataFrame:
    """One row for each document and item it holds."""
    return flagged.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")
