"""Alignment of two tokenizers against the libraries and brute force over pairs of tokens."""

import random
from collections import Counter
from hashlib import sha256
from itertools import accumulate

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from stackloom.llm import align

PATHS = [public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "piece_bpe_32k.model")]


@pytest.fixture(scope="module")
def both():
    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PATHS[1])


def aligned(text, both):
    """(tokens of A, of B, linked pairs, groups) of one text, or None."""
    a, b = both
    chars = align.byte_of_char()
    if not text:
        return None
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    bytes_a = [bytes(chars[c] for c in a.id_to_token(i)) for i in ids_a]
    bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
        return None
    end_a, end_b = ([0, *accumulate(map(len, x))] for x in (bytes_a, bytes_b))
    links = [(x, y) for i, x in enumerate(ids_a) for j, y in enumerate(ids_b) if end_a[i] < end_b[j + 1] and end_b[j] < end_a[i + 1]]
    groups, before = [], 0
    for cut in sorted(set(end_a[1:]) & set(end_b[1:])):
        of = lambda ids, ends: ",".join(str(k) for k, e in zip(ids, ends[1:]) if before < e <= cut)  # noqa: B023, E731
        groups.append(f"{of(ids_a, end_a)}|{of(ids_b, end_b)}")
        before = cut
    return len(ids_a), len(ids_b), links, ";".join(groups)


def brute(docs, both):
    one = {text: aligned(text, both) for _, text in docs}
    count = Counter(p for _, text in docs if one[text] for p in one[text][2])
    top = Counter()
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    out = []
    for k, text in docs:
        if not one[text]:
            out.append((k, 0, 0, 0, 0, 0, 0, "", ""))
            continue
        a, b, links, groups = one[text]
        out.append((k, a, b, groups.count(";") + 1, len(links), sum(count[p] == top[p[1]] for p in links), sum(count[p] for p in links), groups, sha256(groups.encode()).hexdigest()))
    return sorted(out, key=str), count


def corpus():
    rnd = random.Random(5)
    parts = list("ab1 \n\t .'s,é’中日😀\x00\x1c　") + ["  ", " the", " word", " <|endoftext|>", "<s>", " don't", "\r\n", " ﬁn", " Übergröße", " 中文", " naïve"]
    docs = [(k, "".join(rnd.choice(parts) for _ in range(rnd.randint(1, 40)))) for k in range(150)]
    docs += [(200, None), (201, ""), (202, " "), (203, "a▁b"), (204, "▁"), (205, "one two " * 300), (206, "x" * 3000), (None, "no id"), (None, None)]
    return docs + [(k + 300, "a copy of one text") for k in range(40)] + docs[:5]


@pytest.mark.parametrize("links", [align.LINKS, 500])
def test_against_brute_force(spark, both, links):
    """Whole rows, with one container a task and with many; bitmaps of both kinds and several planes."""
    docs = corpus()
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in docs], "doc_id long, text string, pair string, place int").repartition(3)
    want, _ = brute(docs, both)
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(batch, 8 if links < align.LINKS else 10_000)  # a container is closed between batches
    try:
        out = align.align(df, *PATHS, keep_groups=True, links=links)
    finally:
        spark.conf.unset(batch)
    assert out.columns == ["doc_id", *align.COUNTS, "n_best", "count_sum", "groups", "groups_sha256"]
    assert sorted(map(tuple, out.collect()), key=str) == want


def test_counts_of_pairs(spark, both):
    docs = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = align.pair_counts(align.index(df, *PATHS), PATHS[1]).collect()
    _, count = brute(docs, both)
    assert {(r.a_id, r.b_id): r.links for r in got} == count
    held = Counter(p for _, t in docs for p in set((aligned(t, both) or (0, 0, []))[2]))
    assert {(r.a_id, r.b_id): r.docs for r in got} == held
    assert all(r.best == (r.links == max(n for (_, b), n in count.items() if b == r.b_id)) for r in got[:200])


def test_empty_table(spark):
    assert align.align(spark.createDataFrame([], "doc_id long, text string"), *PATHS).collect() == []


def test_bitmaps_of_a_container():
    """Lists and packed bits hold the same places; planes give the multiplicities."""
    rng = np.random.default_rng(7)
    links = [rng.integers(0, 30, int(rng.integers(0, 200))).astype(np.int64) for _ in range(100)]
    c = align.Container(3)
    for x in links:
        c.add(x, np.array([len(x)]))
    got = Counter()
    for batch in c.postings():
        for r in batch.to_pylist():
            bits = np.frombuffer(r["bitmap"], np.uint8)
            places = np.flatnonzero(np.unpackbits(bits)) if r["packed"] else bits.view(np.uint16)
            assert len(places) == r["ones"] and r["container"] == 3
            for p in places.tolist():
                got[r["pair"], p] += 1 << max(r["plane"] - 1, 0)
    assert got == Counter((int(k), d) for d, x in enumerate(links) for k in x)


def test_the_cache_is_bounded():
    m = align.Model(*PATHS)
    m.known.limit = 1000
    for k in range(50):
        list(m.entries([f"w{k}x{j}" + "y" * 10 for j in range(100)] + ["long" * 1000 + str(k)]))
        assert len(m.known.young) <= 1000 and len(m.known.old) <= 1000
        assert all(len(w) <= 64 for w in [*m.known.young, *m.known.old])
    list(m.entries([" ".join(f"v{j}" for j in range(5000))]))
    assert len(m.known.young) <= 1000
