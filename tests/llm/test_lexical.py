"""Ranked lexical search against plain scoring of every document."""

import re
from collections import Counter, defaultdict
from math import floor, log

import numpy as np
import pytest

from stackloom.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=10):
    held = [(i, terms(t)) for i, t in docs]
    n_docs, n_terms = sum(bool(t) for _, t in held), sum(len(t) for _, t in held)
    wanted = defaultdict(set)
    for i, text in items:
        if i is not None:
            wanted[i] |= set(terms(text))
    df = Counter(t for _, ts in held for t in set(ts))
    out = []
    for item, own in wanted.items():
        scores = []
        for i, ts in held:
            if i is None or not ts:
                continue
            tf = Counter(ts)
            m = 10 + 90 * len(ts) * n_docs // n_terms
            score = sum(floor(1000 * log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 8 * m)) for t in own if tf[t])
            if score > 0:
                scores.append((-score, i))
        out += [(item, n, i, -s) for n, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def corpus(seed=3, n=300):
    rng = np.random.default_rng(seed)
    words = [f"w{k}" for k in range(200)] + ["ÄPFEL", "äpfel", "中文", "A1", "a1"]
    p = 1 / np.arange(1, len(words) + 1)
    text = lambda size: " ".join(rng.choice(words, size, p=p / p.sum()))
    docs = [(k, text(int(rng.integers(1, 80)))) for k in range(n)]
    docs += [(n + k, docs[7][1]) for k in range(60)] + docs[:5]  # copies, repeated rows
    docs += [(900, None), (901, ""), (902, " .,;\t\n"), (None, text(30)), (None, None), (903, " ".join(f"x{k}" for k in range(5000)) + " w1 w150")]
    items = [(k, text(int(rng.integers(1, 12)))) for k in range(40)] + [(40, docs[7][1]), (41, None), (42, ""), (43, "nowhere"), (None, "w1"), (44, "w1 w1"), (44, "w150"), (44, "w1 w1")]
    return docs, items


@pytest.mark.parametrize("block_terms", [lexical.BLOCK_TERMS, 60])
def test_against_brute_force(spark, block_terms):
    docs, items = corpus()
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in docs], "doc_id long, text string, score int, terms string").repartition(3)
    benchmark = spark.createDataFrame([(i, t, 9) for i, t in items], "item_id long, text string, rank int")
    out = lexical.search(df, benchmark, block_terms=block_terms)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, out.collect())) == brute(docs, items)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical.search(docs, items).collect() == []
    assert lexical.search(items.select(items.item_id.alias("doc_id"), "text"), docs.select(docs.doc_id.alias("item_id"), "text")).collect() == []


@pytest.mark.parametrize("copies", [0, 700])
def test_slices_of_a_task(copies):
    """Trees of several slices, one after another; bounds leave documents unscored."""
    rng = np.random.default_rng(11)
    vocabulary, n = 400, 3000
    p = 1 / np.arange(1, vocabulary + 1)
    docs = [np.unique(rng.choice(vocabulary, int(rng.integers(1, 60)), p=p / p.sum()), return_counts=True) for _ in range(n)]
    docs[:copies] = [docs[0]] * copies
    sizes = np.array([int(tf.sum()) for _, tf in docs])
    df = np.bincount(np.concatenate([t for t, _ in docs]), minlength=vocabulary)
    wanted = [np.unique(rng.integers(0, vocabulary, 8)) for _ in range(30)] + [docs[0][0], docs[n - 1][0]]
    items = lexical.Items(np.arange(len(wanted)), np.concatenate([[0], np.cumsum([*map(len, wanted)])]), np.concatenate(wanted), np.arange(vocabulary).astype(np.uint64))
    rank = np.empty(vocabulary, np.int64)
    rank[np.argsort(-df, kind="stable")] = np.arange(vocabulary)
    weights = np.array([lexical.weight(n, int(x)) for x in df])
    search = lexical.Search(items, weights, rank, n, int(sizes.sum()), 10)
    best = lexical.Best(len(wanted), 10)
    m = lexical.norms(sizes, n, int(sizes.sum()))
    scored = 0
    for at in range(0, n, 1000):
        part = docs[at : at + 1000]
        first = np.concatenate([[0], np.cumsum([len(t) for t, _ in part])])
        tree = lexical.Tree(np.arange(at, at + len(part)), m[at : at + 1000], first, rank[np.concatenate([t for t, _ in part])], np.concatenate([tf for _, tf in part]))
        leaves = np.flatnonzero(tree.n_children == 0)
        assert sorted(x for k in leaves for x in range(tree.start[k], tree.end[k])) == list(range(len(part)))
        scored += lexical.walk(tree, search, np.arange(len(wanted)), best)
    for k, own in enumerate(wanted):
        scores = []
        for i, (t, tf) in enumerate(docs):
            at = np.isin(t, own)
            scores.append((-int(lexical.part_scores(weights[t[at]], tf[at], np.full(at.sum(), m[i])).sum()), i))
        want = [(s, i) for s, i in sorted(scores)[:10] if s < 0]
        assert [(-s, i) for s, i in zip(best.score[k].tolist(), best.id[k].tolist()) if s > 0] == want
    assert scored < 0.9 * n * len(wanted)


def test_norms_beyond_64_bits():
    n = np.array([10**9, 3])
    assert lexical.norms(n, 10**10, 10**12).tolist() == [10 + 90 * x * 10**10 // 10**12 for x in (10**9, 3)]
