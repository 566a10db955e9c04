"""Cross-tokenizer alignment by inverted pair bitmaps (operator 11).

Each text is encoded by a byte-level BPE (A, a ``tokenizers`` JSON file) of space + text and by a piece BPE (B, a
``sentencepiece`` model) that adds the space itself; strings of special tokens are plain text.  Offsets where
tokens of both end cut the bytes into groups.  A token of A and one of B are linked where their bytes overlap.
A pair of ids is counted by how many links of all documents hold it.

Documents are dealt into containers, inside one task each, of ``DOCS`` documents and about ``LINKS`` links at most.
For each pair of ids a container has compressed bitmaps of its documents: one of those that hold the pair, and
multiplicity planes, the bits of how many further times they do.  Batches are OR-merged into their container;
a pair's bitmaps of all containers, side by side, are its postings.  Population counts give a pair's number of
documents (of the first bitmap) and of links (of all, by their weights), and these sums are all that is
grouped by pair.  Postings then return the scores: each bitmap adds its pair's count to its documents, container by container.
A bitmap is a list of 16-bit places, or packed bits where that is shorter.

Neither tokenizer joins what a single space between two other characters parts, so such stretches are
encoded and aligned once and kept, in a cache bounded by entries and bytes that a worker keeps over its tasks.

Texts that are null or empty, or whose tokens' bytes differ from space + text, have no tokens: zeros and an empty
digest.  Every row counts by itself, repeated ones and rows without an id too; very long texts are read
whole; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackloom.checkpoints import cut, drop
from stackloom.llm._recent import Recent
from stackloom.llm._words import tidied

DOCS = 1 << 16
LINKS = 6_000_000
CACHE = 150_000
ROWS = 256
#: Bitmaps with a place in this many, or more, are packed bits: shorter than 16 bits a place.
PACKED = 16

# Fixed value: the pattern by which byte-level BPE splits a text before it merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_RUN = re.compile(r"\s\s")
_SINGLE = re.compile(r"(?<=\S) (?=\S)")
_models: dict[tuple[str, str], Model] = {}

COUNTS = ["n_a", "n_b", "n_groups", "n_links"]
_INDEX = "container long, place int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, groups_sha256 string, pair long, plane int, ones int, packed boolean, bitmap binary"
_DOC = ["container", "place", "doc_id", *COUNTS, "groups", "groups_sha256"]
_POSTING = ["container", "pair", "plane", "ones", "packed", "bitmap"]
Entry = tuple[int, int, int, bytes, bytes]


def byte_of_char() -> dict[str, int]:
    """What each character of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def _strings(ids: int, ends: str) -> list[str]:
    return [f"{k}{end}" for k in range(ids) for end in ends]


class Model:
    """Both tokenizers, and a bounded cache of aligned stretches.

    A stretch's entry: tokens of A, of B, groups, linked pairs as an array's bytes, and the groups as text, each
    with a semicolon behind it.  It is None where bytes differ.
    """

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        import tiktoken

        with open(path_a, encoding="utf-8") as f:
            spec = json.load(f)
        special = {x["content"] for x in spec["added_tokens"]}
        chars = byte_of_char()
        vocab = {k: bytes(chars[c] for c in token) for token, k in spec["model"]["vocab"].items() if token not in special}
        made = [spec["model"]["vocab"]["".join(x if isinstance(x, list) else x.split(" "))] for x in spec["model"]["merges"]]
        if made != sorted(made):
            raise ValueError("the ids of merged tokens must ascend with the merges")
        self.encode_a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks={b: k for k, b in vocab.items()}, special_tokens={}).encode_ordinary
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        #: A piece that holds a space after another character would join what a space parts.
        self.parted = not any("▁" in p.lstrip("▁") for p in pieces)
        bytes_a = [vocab.get(k, b"") for k in range(max(vocab) + 1)]
        bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self.bytes_a, self.bytes_b = pa.array(bytes_a, pa.large_binary()), pa.array(bytes_b, pa.large_binary())
        self.sizes_a, self.sizes_b = np.array([*map(len, bytes_a)]), np.array([*map(len, bytes_b)])
        self.pieces = len(pieces)
        self.texts = pa.array(_strings(len(bytes_a), ",|") + _strings(len(pieces), ",;"), pa.large_binary())
        self.known = Recent(CACHE)

    def stretches(self, text: str) -> list[str]:
        if not self.parted:
            return [text]
        if _RUN.search(text) or text[0].isspace() or text[-1].isspace():
            return _SINGLE.split(text)
        return text.split(" ")

    def learn(self, stretches: list[str]) -> None:
        known = self.known.young
        spaced = [" " + s for s in stretches]
        a, b = [*map(self.encode_a, spaced)], self.b.encode(stretches, num_threads=1)
        raw = [s.encode() for s in spaced]
        good = self.equal(raw, a, b)
        known.update((s, None) for s, ok in zip(stretches, good) if not ok)
        keep = np.flatnonzero(good)
        if len(keep):
            one = [[x[k] for k in keep] for x in (stretches, raw, a, b)]
            known.update(zip(one[0], self.aligned(*one[1:])))

    def equal(self, raw: list[bytes], a: list[list[int]], b: list[list[int]]) -> list[bool]:
        """Where both tokenizers' bytes are those of the text."""
        whole, lengths = b"".join(raw), [*map(len, raw)]
        if all(bytes(self.joined(names, ids)) == whole and self.lengths(sizes, ids) == lengths for names, sizes, ids in ((self.bytes_a, self.sizes_a, a), (self.bytes_b, self.sizes_b, b))):
            return [True] * len(raw)
        return [bytes(self.joined(self.bytes_a, [x])) == r == bytes(self.joined(self.bytes_b, [y])) for r, x, y in zip(raw, a, b)]

    @staticmethod
    def lengths(sizes: np.ndarray, ids: list[list[int]]) -> list[int]:
        """Bytes of each list of tokens."""
        upto = np.concatenate([[0], np.cumsum(sizes[np.concatenate([np.array(x, np.int64) for x in ids])])])
        return np.diff(upto[np.cumsum([0, *map(len, ids)])]).tolist()

    @staticmethod
    def joined(names: pa.Array, ids: list[list[int]]) -> memoryview:
        flat = names.take(pa.array(np.concatenate([np.array(x, np.int64) for x in ids])))
        return memoryview(flat.buffers()[2] or b"")

    def aligned(self, raw: list[bytes], a: list[list[int]], b: list[list[int]]) -> Iterator[Entry]:
        """The entries of stretches one after another: all of them are aligned at once."""
        stop = np.cumsum([*map(len, raw)])
        ids_a, ids_b = (np.concatenate([np.array(x, np.int64) for x in ids]) for ids in (a, b))
        end_a, end_b = np.cumsum(self.sizes_a[ids_a]), np.cumsum(self.sizes_b[ids_b])
        common = np.intersect1d(end_a, end_b, assume_unique=True)
        cuts = np.union1d(end_a, end_b)
        pairs = ids_a[np.searchsorted(end_a, cuts)] * self.pieces + ids_b[np.searchsorted(end_b, cuts)]
        group_a, group_b = np.searchsorted(common, end_a), np.searchsorted(common, end_b)
        place_a = np.arange(len(ids_a)) + np.searchsorted(group_b, group_a)
        place_b = np.arange(len(ids_b)) + np.searchsorted(group_a, group_b, side="right")
        code = np.empty(len(ids_a) + len(ids_b), np.int64)
        code[place_a] = 2 * ids_a + (common[group_a] == end_a)
        code[place_b] = 2 * (len(self.sizes_a) + ids_b) + (common[group_b] == end_b)
        text = self.texts.take(pa.array(code))
        offsets = np.frombuffer(text.buffers()[1], np.int64)
        n_a, n_b, n_groups, n_pairs = (np.searchsorted(x, stop, side="right") for x in (end_a, end_b, common, cuts))
        upto = offsets[n_a + n_b]
        data, links = bytes(memoryview(text.buffers()[2])), pairs.tobytes()
        each = [np.diff(x, prepend=0).tolist() for x in (n_a, n_b, n_groups)]
        spans = [zip([0, *x[:-1].tolist()], x.tolist()) for x in (8 * n_pairs, upto)]
        for x, y, g, (p, q), (s, t) in zip(*each, *spans):
            yield x, y, g, links[p:q], data[s:t]

    def entries(self, texts: list[str]) -> Iterator[list[Entry] | None]:
        """For each text its stretches' entries, None where bytes differ; empty texts have none."""
        split = [self.stretches(t) if t else [] for t in texts]
        if new := self.known.missing(set().union(*split)):
            self.learn(list(new))
        known = self.known.young
        for stretches in split:
            found = [known[s] for s in stretches]
            yield None if None in found else found
        self.known.trim()


def model(path_a: str, path_b: str) -> Model:
    key = path_a, path_b
    if key not in _models:
        _models[key] = Model(*key)
    return _models[key]


class Container:
    """Documents of one task, and their links as (pair, place) numbers."""

    def __init__(self, number: int):
        self.number, self.docs, self.links, self.held = number, 0, 0, []

    def add(self, pairs: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Takes in the links of a batch of documents; ``counts`` are each document's.  Returns the documents' places."""
        places = np.arange(self.docs, self.docs + len(counts))
        self.held.append(pairs << 16 | np.repeat(places, counts))
        self.docs += len(counts)
        self.links += len(pairs)
        return places

    def postings(self) -> Iterator[pa.RecordBatch]:
        """The bitmaps of every pair: of its documents (plane 0), and of bit k - 1 of their further links (plane k)."""
        if not self.links:
            return
        keys, times = np.unique(np.concatenate(self.held), return_counts=True)
        self.held = []
        yield from self.bitmaps(0, keys)
        more = times - 1
        plane = 1
        while (more > 0).any():
            yield from self.bitmaps(plane, keys[more & 1 == 1])
            more >>= 1
            plane += 1

    def bitmaps(self, plane: int, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        pair, place = keys >> 16, (keys & 0xFFFF).astype(np.uint16)
        start = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(keys) else np.empty(0, np.int64)
        ones = np.diff(np.append(start, len(keys)))
        packed = ones * PACKED >= self.docs
        listed = ~packed
        if listed.any():
            offsets = np.concatenate([[0], np.cumsum(2 * ones[listed])]).astype(np.int32)
            data = place[np.repeat(listed, ones)].tobytes()
            bitmaps = pa.Array.from_buffers(pa.binary(), int(listed.sum()), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
            yield self.rows(plane, pair[start[listed]], ones[listed], False, bitmaps)
        for at in range(0, int(packed.sum()), 64):
            some = np.flatnonzero(packed)[at : at + 64]
            bits = np.zeros((len(some), self.docs), bool)
            for k, s in enumerate(some):
                bits[k, place[start[s] : start[s] + ones[s]]] = True
            yield self.rows(plane, pair[start[some]], ones[some], True, pa.array([x.tobytes() for x in np.packbits(bits, axis=1)], pa.binary()))

    def rows(self, plane: int, pair: np.ndarray, ones: np.ndarray, packed: bool, bitmaps: pa.Array) -> pa.RecordBatch:
        n = len(pair)
        columns = {"container": pa.array(np.full(n, self.number)), "pair": pa.array(pair), "plane": pa.array(np.full(n, plane, np.int32)), "ones": pa.array(ones.astype(np.int32)), "packed": pa.array(np.full(n, packed)), "bitmap": bitmaps}
        return _filled(columns, n)


def _kind(name: str) -> pa.DataType:
    if name in ("place", "plane", "ones"):
        return pa.int32()
    return {"groups": pa.string(), "groups_sha256": pa.string(), "packed": pa.bool_(), "bitmap": pa.binary()}.get(name, pa.int64())


def _filled(columns: dict[str, pa.Array], n: int) -> pa.RecordBatch:
    """A batch of the index: columns not given are null."""
    names = [c.split()[0] for c in _INDEX.split(", ")]
    return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(n, _kind(c))) for c in names], names=names)


def _described(ids: pa.Array, texts: list[str], m: Model, container: Container, keep: bool) -> pa.RecordBatch:
    """The rows of a batch's documents; their links go to the container."""
    counts, links, groups, digests = [], [], [], []
    for entries in m.entries(texts):
        if not entries:
            counts.append((0, 0, 0, 0))
            groups.append("")
            digests.append("")
            continue
        a, b, g, pairs, text = zip(*entries)
        pairs, text = b"".join(pairs), b"".join(text)[:-1]
        counts.append((sum(a), sum(b), sum(g), len(pairs) // 8))
        links.append(pairs)
        groups.append(text.decode() if keep else None)
        digests.append(sha256(text).hexdigest())
    numbers = np.array(counts, np.int64).reshape(-1, 4)
    places = container.add(np.frombuffer(b"".join(links), np.int64), numbers[:, 3])
    columns = {"container": pa.array(np.full(len(texts), container.number)), "place": pa.array(places.astype(np.int32)), "doc_id": ids}
    columns |= {c: pa.array(numbers[:, k]) for k, c in enumerate(COUNTS)}
    return _filled(columns | {"groups": pa.array(groups, pa.string()), "groups_sha256": pa.array(digests, pa.string())}, len(texts))


def _indexed(path_a: str, path_b: str, keep: bool, links: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path_a, path_b)
        number = TaskContext.get().partitionId() << 32
        container = Container(number)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                if container.docs + part.num_rows > DOCS or container.links >= links:
                    yield from container.postings()
                    number += 1
                    container = Container(number)
                yield _described(part.column(0), pc.fill_null(part.column(1), "").to_pylist(), m, container, keep)
        yield from container.postings()

    return run


def index(docs: DataFrame, path_a: str, path_b: str, keep_groups: bool = False, links: int = LINKS) -> DataFrame:
    """The containers' documents and postings of ``docs(doc_id, text)``, as one written table in the shared folder.

    Rows of documents have no ``pair``; ``groups`` is their text if it is to be kept.  A container is closed once it has ``links``.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return cut(rows.mapInArrow(tidied(_indexed(path_a, path_b, keep_groups, links)), _INDEX))


def pair_counts(indexed: DataFrame, path_b: str) -> DataFrame:
    """(pair, a_id, b_id, links, docs, best): how many links and documents hold each pair, and whether no pair of its B id has more links."""
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
    weight = F.when(F.col("plane") == 0, F.lit(1).cast("long")).otherwise(F.expr("shiftleft(1L, plane - 1)"))
    counted = indexed.filter("pair is not null").groupBy("pair").agg(F.sum(F.col("ones") * weight).alias("links"), F.sum(F.when(F.col("plane") == 0, F.col("ones")).otherwise(0)).alias("docs"))
    counted = counted.withColumns({"a_id": F.expr(f"cast(pair div {pieces} as int)"), "b_id": F.expr(f"cast(pair % {pieces} as int)")})
    # A row for each id of B: 32,000 with the vocabulary of ``path_b``, however many documents there are.
    top = counted.groupBy("b_id").agg(F.max("links").alias("top"))
    return counted.join(F.broadcast(top), "b_id").select("pair", "a_id", "b_id", "links", "docs", (F.col("links") == F.col("top")).alias("best"))


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by container, its documents before its postings; gives the documents with their sums."""
    current, docs, sums = None, [], np.zeros((2, 0), np.int64)

    def done() -> Iterator[pa.RecordBatch]:
        for batch in docs:
            at = batch.column("place").to_numpy()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in _DOC[2:]), *(pa.array(x[at]) for x in sums)], names=[*_DOC[2:], "n_best", "count_sum"])

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("container", "posted")], 1)
        edges = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(keys)]):
            part = batch.slice(a, b - a)
            container, posted = keys[a].tolist()
            if container != current:
                yield from done()
                current, docs, sums = container, [], np.zeros((2, DOCS), np.int64)
            if posted:
                _add(part, sums)
            else:
                docs.append(part)
    yield from done()


def _add(part: pa.RecordBatch, sums: np.ndarray) -> None:
    """Adds each bitmap's link count, and the links if it is the best, at its places, times the plane's weight."""
    plane, score = part.column("plane").to_numpy(), part.column("links").to_numpy()
    weight = np.left_shift(1, np.maximum(plane - 1, 0).astype(np.int64))
    best = part.column("best").to_numpy(zero_copy_only=False) * weight
    total = score * weight
    packed = part.column("packed").to_numpy(zero_copy_only=False)
    bitmap = part.column("bitmap")
    listed = np.flatnonzero(~packed)
    if len(listed):
        some = bitmap.take(pa.array(listed))
        place = np.frombuffer(b"".join(some.to_pylist()), np.uint16)
        row = np.repeat(listed, part.column("ones").to_numpy()[listed])
        np.add.at(sums[0], place, best[row])
        np.add.at(sums[1], place, total[row])
    for k in np.flatnonzero(packed):
        place = np.flatnonzero(np.unpackbits(np.frombuffer(bitmap[int(k)].as_py(), np.uint8)))
        sums[0, place] += best[k]
        sums[1, place] += total[k]


def align(docs: DataFrame, path_a: str, path_b: str, keep_groups: bool = False, links: int = LINKS) -> DataFrame:
    """A row for each row of ``docs(doc_id, text)``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups, groups_sha256."""
    indexed = index(docs, path_a, path_b, keep_groups, links)
    scores = cut(pair_counts(indexed, path_b).select("pair", "links", "best"))
    # Merged at every size: a broadcast of a small table would only hide how shuffles grow.
    postings = indexed.filter("pair is not null").select(*_POSTING).join(scores.hint("merge"), "pair").withColumn("posted", F.lit(1)).drop("pair")
    rows = indexed.filter("pair is null").select(*_DOC).withColumn("posted", F.lit(0))
    met = rows.unionByName(postings, allowMissingColumns=True).repartition("container").sortWithinPartitions("container", "posted")
    out = cut(met.mapInArrow(_summed, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, groups_sha256 string, n_best long, count_sum long"))
    drop(indexed, scores)
    return out.select("doc_id", *COUNTS, "n_best", "count_sum", "groups", "groups_sha256")
