"""BPE encoding and decoding with a pair occurrence index (operator 3).

``encode`` adds token ids to a table, ``decode`` turns ids back into text, ``encode_decode`` does
both in one pass.  The vocabulary is a ``tokenizers`` JSON file whose path is a parameter: BPE with
word ends, NFC and lower case, white space dropped, special tokens found in the raw text.

Merging works on many words at once.  All new distinct words of a batch lie in one symbol array; an
index maps each adjacent pair to all its positions; ranks are applied in ascending order from a
heap, and each merge updates only the lists of the pairs beside it.

Rows are independent: no shuffle, no group, and memory is bounded by a batch and by the caches of words
and pieces, which a worker keeps for its later tasks: the ``CACHE_WORDS`` newest entries of each, and as many before them.
Only words and pieces of up to 64 characters are kept, so an entry has some hundred bytes and the caches a bound in bytes;
longer ones, as in texts without spaces, are encoded anew in each batch.
Null and empty texts give no tokens and an empty decoded text; repeated rows repeat; other columns
pass through; an empty table gives an empty table.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stackloom.llm._recent import Recent
from stackloom.llm._words import tidied

CACHE_WORDS = 250_000
ROWS = 256
_models: dict[str, Model] = {}


class Model:
    """Vocabulary, merge ranks and pre-tokenization of one tokenizer file, with a bounded word cache."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.end = spec["model"].get("end_of_word_suffix") or ""
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.rank, self.pairs = {}, []
        for k, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.pairs.append((vocab[a], vocab[b], vocab[a + b]))
            self.rank.setdefault((vocab[a] << 20) + vocab[b], k)
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pieces = regex.compile(pattern.replace("\\s", "\\p{White_Space}")).findall
        self.gaps = regex.compile(r"\p{White_Space}+")
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        chars = _byte_chars()
        self.inner = [vocab[c] for c in chars]
        self.last = [vocab[c + self.end] for c in chars]
        names = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, k in [*vocab.items(), *self.special.items()]:
            names[k] = token
        self.names = pa.array(names, pa.large_string())
        self.words, self.known = Recent(CACHE_WORDS), Recent(CACHE_WORDS)
        # Symbols before any merge: a byte, or 256 and a word's last byte.
        self.symbols = np.array([*self.inner, *self.last])
        local = {k: at for at, k in enumerate(self.symbols.tolist())}
        self.first_rank = np.full((512, 512), -1, np.int32)
        for pair, k in self.rank.items():
            a, b = local.get(pair >> 20), local.get(pair & 0xFFFFF)
            if a is not None and b is not None:
                self.first_rank[a, b] = k

    def split(self, text: str) -> list[str]:
        """Words between white space; special tokens stand alone."""
        if self.specials is not None and any(s in text for s in self.special):
            out = []
            for k, part in enumerate(self.specials.split(text)):
                out += [part] if k % 2 else self.split_plain(part)
            return out
        return self.split_plain(text)

    def split_plain(self, text: str) -> list[str]:
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # white space for str.split() only
            return [w for w in self.gaps.split(text) if w]
        return text.split()

    def learn(self, words: Iterable[str]) -> None:
        """Add the ids of new words to the cache; pieces that several words share are merged once."""
        split: dict[str, list[str]] = {}
        for word in words:
            if word in self.special:
                self.words.young[word] = np.int32(self.special[word]).tobytes()
            else:
                plain = word if word.isascii() else unicodedata.normalize("NFC", word).replace("Σ", "σ")
                split[word] = self.pieces(plain.lower())
        new = list(self.known.missing({p for pieces in split.values() for p in pieces}))
        known = self.known.young
        if new:
            raw = [p.encode() for p in new]
            ends = np.cumsum([len(x) for x in raw])
            local = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
            local[ends - 1] += 256
            symbols = merge(self.symbols[local], ends, occurrences(self.first_rank, local, ends), self.rank, self.pairs)
            left = symbols >= 0
            ids = symbols[left].astype(np.int32).tobytes()
            bounds = [0, *(4 * np.cumsum(left)[ends - 1]).tolist()]
            known.update(zip(new, map(ids.__getitem__, map(slice, bounds, bounds[1:]))))
        self.words.young.update((word, b"".join([known[p] for p in pieces])) for word, pieces in split.items())

    def encode(self, texts: list[str]) -> pa.ListArray:
        split = [self.split(t) for t in texts]
        if new := self.words.missing(set().union(*split)):
            self.learn(new)
        ids = [b"".join(map(self.words.young.__getitem__, words)) for words in split]
        self.words.trim()
        self.known.trim()
        ends = np.cumsum([0, *(len(x) // 4 for x in ids)], dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), np.int32)))

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """Tokens joined by one space: this kind of file has no decoder of its own."""
        flat = self.names.take(ids.flatten())
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(ids).fill_null(0).to_numpy(zero_copy_only=False))])
        lists = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), flat)
        return pc.binary_join(lists, pa.scalar(" ", pa.large_string()))


def _byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def occurrences(first_rank: np.ndarray, local: np.ndarray, ends: np.ndarray) -> dict[int, list[int]]:
    """The occurrence index before any merge: rank of a pair -> positions of its first symbol, ascending."""
    ranks = first_rank[local[:-1], local[1:]]
    ranks[ends[:-1] - 1] = -1  # the next symbol is another word's
    at = np.flatnonzero(ranks >= 0)
    at = at[np.argsort(ranks[at], kind="stable")]
    edges = [0, *(np.flatnonzero(np.diff(ranks[at])) + 1).tolist(), len(at)]
    return {int(ranks[at[a]]): at[a:b].tolist() for a, b in zip(edges, edges[1:]) if a < b}


def merge(initial: np.ndarray, ends: np.ndarray, index: dict[int, list[int]], rank: dict[int, int], pairs: list[tuple[int, int, int]]) -> np.ndarray:
    """Byte-pair merges of many words at once; ``ends`` are the words' ends in the symbols.

    ``index`` has the occurrences of the first pairs, ``rank`` the rank of a pair (first * 2**20 + second),
    ``pairs`` the symbols of a rank and what they become.  A symbol that a merge took in becomes -1.
    """
    n = len(initial)
    following, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    following[ends - 1] = -1
    before[[0, *ends[:-1]]] = -1
    symbols, following, before = initial.tolist(), following.tolist(), before.tolist()
    places: dict[int, list[int]] = defaultdict(list, index)
    find = rank.get
    active = list(places)
    heapq.heapify(active)
    while active:
        k = heapq.heappop(active)
        a, b, new = pairs[k]
        todo = places.pop(k)
        if a == b:
            todo = sorted(set(todo))  # overlapping pairs merge from the left
        for i, at in enumerate(todo):
            nxt = following[at]
            if nxt < 0 or symbols[at] != a or symbols[nxt] != b:
                continue  # a merge has changed this pair meanwhile
            symbols[at], symbols[nxt] = new, -1
            following[at] = far = following[nxt]
            following[nxt] = -1
            low = k
            if far >= 0:
                before[far] = at
                if (r := find((new << 20) + symbols[far])) is not None:
                    if r not in places:
                        heapq.heappush(active, r)
                    places[r].append(at)
                    if r < low:
                        low = r
            if (left := before[at]) >= 0 and (r := find((symbols[left] << 20) + new)) is not None:
                if r not in places:
                    heapq.heappush(active, r)
                places[r].append(left)
                if r < low:
                    low = r
            if low < k:  # a better pair arose: the rest of this rank waits for it
                if rest := todo[i + 1 :]:
                    if k not in places:
                        heapq.heappush(active, k)
                    places[k] += rest
                break
    return np.array(symbols)


def model(path: str) -> Model:
    if path not in _models:
        _models[path] = Model(path)
    return _models[path]


def _append(df: DataFrame, column: str, new: list[tuple[str, T.DataType]], make) -> DataFrame:
    """``df`` with new columns that ``make(slice of column)`` returns, batch by batch."""
    names = [c for c in df.columns if c not in {n for n, _ in new}]
    schema = T.StructType([df.schema[c] for c in names] + [T.StructField(n, t) for n, t in new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                made = make(part.column(column))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *made], names=[*names, *(n for n, _ in new)])

    return df.mapInArrow(tidied(run), schema)


def _texts(column: pa.Array) -> list[str]:
    return pc.fill_null(column, "").to_pylist()


_IDS = ("ids", T.ArrayType(T.IntegerType()))
_DECODED = ("decoded", T.StringType())


def encode(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Adds ``ids array<int>``, the tokens of the whole text (a column of that name is replaced)."""
    return _append(df, text, [_IDS], lambda column: [model(path).encode(_texts(column))])


def decode(df: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """Adds ``decoded``, the text of ``ids`` (null: empty)."""
    return _append(df, ids, [_DECODED], lambda column: [model(path).decode(column).cast(pa.string())])


def encode_decode(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Adds ``ids`` and ``decoded`` in one pass over the texts."""

    def both(column: pa.Array) -> list[pa.Array]:
        ids = model(path).encode(_texts(column))
        return [ids, model(path).decode(ids).cast(pa.string())]

    return _append(df, text, [_IDS, _DECODED], both)


def digests(df: DataFrame) -> DataFrame:
    """Replaces ``ids`` and ``decoded`` by their count and SHA-256 digests."""
    return df.withColumns(
        {
            "n_tokens": F.size("ids").cast("long"),
            "ids_sha256": F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256),
            "decoded_sha256": F.sha2(F.col("decoded").cast("binary"), 256),
        }
    ).drop("ids", "decoded")
