"""Quality: all labelled texts and all pairs of them make the model and its cut."""

import numpy as np
import pyarrow as pa

from stackloom.llm import quality


def _texts(n_good, n_bad):
    rng = np.random.default_rng(3)
    word = lambda size: "".join(map(chr, rng.integers(97, 123, size)))
    rows = []
    for k in range(n_good + n_bad):
        good = k < n_good
        words = [word(rng.integers(3, 9 if good else 7)) for _ in range(rng.integers(8, 30 if good else 24))]
        rows.append((k, " ".join(words) + ("." if rng.random() < (0.7 if good else 0.4) else "!"), good))
    return rows


def test_every_labelled_text_and_pair_counts(spark):
    rows = _texts(3600, 3300)
    frame = spark.createDataFrame(rows, "doc_id long, text string, good boolean").repartition(4)
    model = quality.fit(frame.select("doc_id", "text"), frame.select("doc_id", "good"))
    x = quality.features(pa.array([r[1] for r in rows]))
    good = np.array([r[2] for r in rows])
    spread = x.std(0) + 1e-6
    u = (x - x.mean(0)) / spread
    w = model.weight * spread
    # The slope of the loss over all pairs, listed.
    p = 1 / (1 + np.exp((u[good] @ w)[:, None] - u[~good] @ w)) / (good.sum() * (~good).sum())
    slope = 1e-3 * w - p.sum(1) @ u[good] + p.sum(0) @ u[~good]
    assert np.abs(slope).max() < 2e-4
    scores = model.scores(pa.array([r[1] for r in rows]))
    # Equal scores, which short texts have, may be at the cut.
    assert (scores < 0.5).sum() <= (~good).sum() <= (scores <= 0.5).sum()
    assert scores[good].mean() > scores[~good].mean()


def test_value_at_a_rank(spark):
    values = np.concatenate([np.random.default_rng(1).normal(size=3000), np.full(500, 0.25), [1e9, -1e9, 5e-324]])
    z = spark.createDataFrame([(float(v),) for v in values], "z double")
    ordered = np.sort(values)
    for k in (0, 1, 1500, int(np.searchsorted(ordered, 0.25)) + 499, 3501):
        assert quality._at_rank(z, k, ordered[0], ordered[-1]) == (ordered[k], ordered[k + 1])


def test_a_class_alone_and_texts_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None), (None, "c"), (3, "")], "doc_id long, text string")
    alone = quality.fit(docs, spark.createDataFrame([(1, True), (9, False)], "doc_id long, good boolean"))
    assert set(alone.scores(pa.array(["a", None]))) == {0.5}
    both = quality.fit(docs, spark.createDataFrame([(1, True), (2, False), (3, False), (3, True)], "doc_id long, good boolean"))
    assert both.scores(pa.array(["a b"]))[0] > both.scores(pa.array([""]))[0]
