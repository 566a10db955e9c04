"""Operators on single rows: extraction, tokens, decontamination, toxicity, quality."""

import itertools
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stackloom.llm import bpe, decontaminate, extract, quality, queries, toxicity
from stackloom.llm._words import blocks

DOCS = "doc_id long, text string"
SF = "/root/testdata/sf0.1"


# --- extraction -------------------------------------------------------------------------------------------------


def test_extract_layouts(spark):
    pages = [
        (1, "<html><body><nav><a href='/'>Home</a></nav><article><h1>T&amp;t</h1><p>One  two.<br>Three <b>fo</b>ur.<p>Five.</article><footer>&copy; x</footer></body></html>"),
        (2, None),
        (3, ""),
        (4, "<div class='cookie-notice'><p>We use cookies here, do you agree?</p></div><div class='post'><p>A real text stands in here, long enough.</p><p>It has a second one, too.</p></div><div class='comments'><div class='comment'><p>Nice page, thanks a lot.</p></div></div><script>var t='</p>';</script>"),
        (5, "<article><p>Broken <b>markup <i>here</p><p>goes on & on &lt;3</article"),
        (6, "<nav><a>only</a> <a>menu</a></nav>"),
    ]
    out = {r.page_id: r for r in extract.extract(spark.createDataFrame(pages, "page_id long, html string").withColumn("text", F.lit("old"))).collect()}
    assert out[1].text == "T&t One two. Three four. Five."
    assert out[1].n_chars == len(out[1].text)
    assert out[2].text == out[3].text == out[6].text == "" and out[2].n_chars == 0
    assert out[4].text == "A real text stands in here, long enough. It has a second one, too."
    assert out[5].text.startswith("Broken markup here goes on & on <3")
    assert extract.extract(spark.createDataFrame([], "page_id long, html string")).count() == 0


def test_extract_odd_markup():
    assert extract.leaf_blocks("<p>a<![foo bar]>b</p>")
    deep = "<div>" * 50_000 + "<b>" * 50_000 + "x" + "<script>y</script>" + "<p>z"
    assert [b[0] for b in extract.leaf_blocks(deep)] == ["x", "z"]
    assert extract.leaf_blocks("<p>a <a href=x>b</a> c</p>") == [("a b c", (("p", frozenset()),), 1)]


def test_extract_held_out_pages():
    field = extract.default_field()
    wrong = total = 0
    for page, labels in extract.labelled_pages(150, seed=321):
        got = field.viterbi(field.unary(page))
        wrong += sum(a != b for a, b in zip(got, labels))
        total += len(labels)
    assert wrong / total < 0.02


def test_extract_bounds_paths_and_caches():
    """Varied nesting and ids of their own leave neither long paths nor growing caches; long paths keep their features."""
    varied = "".join(f"<t{k} class='c{k} menu'>x{k} " for k in range(3000)) + "<article class='post'><p>A sentence.</p></article>"
    assert max(len(path) for _, path, _ in extract.leaf_blocks(varied)) <= extract.LONG_PATH
    rng = np.random.default_rng(4)
    tags, said = sorted(extract.KNOWN - extract.INLINE - extract.VOID), sorted(extract.HINTS)
    for _ in range(200):
        entries = [(str(rng.choice(tags)), frozenset(rng.choice(said, int(rng.integers(0, 3))))) for _ in range(60)]
        path = ()
        for entry in entries:
            path = extract.extended(path, entry)
        assert extract.path_features(path) == extract.path_features(tuple(entries))
        assert len(path) <= len(extract.KNOWN) + extract.LONG_PATH + 3
    for k in range(6000):
        extract.leaf_blocks(f"<div id='post-{k}' class='c{k} {'w' * 200}{k}'>x</div>")
    assert extract._known_hints.cache_info().currsize <= 4096
    assert extract.path_features.cache_info().maxsize == 4096


def test_extract_stored_weights_are_those_fitted(spark):
    stored, fitted = extract.default_field(), extract.fitted()
    assert stored.weight.keys() == fitted.weight.keys()
    assert all(abs(stored.weight[k] - w) < 1e-3 for k, w in fitted.weight.items())
    df = spark.createDataFrame([(1, "<p>A sentence stands here.</p>", "old", 1)], "page_id long, html string, Text string, N_Chars int")
    assert extract.extract(df).columns == ["page_id", "html", "text", "n_chars"]


def test_viterbi_is_the_best_path():
    field = extract.default_field()
    rng = np.random.default_rng(1)
    for _ in range(30):
        u = rng.normal(0, 2, 6).tolist()

        def value(path):
            v = field.start[path[0]] + u[0] * path[0]
            for k in range(1, 6):
                v += field.step[path[k - 1]][path[k]] + u[k] * path[k]
            return v

        best = max(([(n >> k) & 1 for k in range(6)] for n in range(64)), key=value)
        assert field.viterbi(u) == best


# --- tokens -----------------------------------------------------------------------------------------------------

ODD = ["I'm can't WE'LL 's's ''s!'s", "a\x1cb \x85c", "ΑΣ ΣΑΣ İstanbul", "<|startoftext|>hi<|endoftext|>x <|ENDOFTEXT|>", "é ́a", "日本語 テスト 123 ²½", "\U0001f600 hi", "a" * 500, "", "  \n", "aaaa bbbb abababab"]


def test_bpe_equals_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    path = queries.tokenizer_path()
    own = tokenizers.Tokenizer.from_file(path)
    own.no_truncation()
    own.no_padding()
    rng = np.random.default_rng(3)
    texts = ODD + ["".join(rng.choice(list("abcABC'!?12 éßñΣ日\n\t<|>"), rng.integers(0, 60))) for _ in range(300)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(-1, None), (0, texts[0])]
    df = spark.createDataFrame(rows, DOCS).withColumn("ids", F.lit("clash"))
    out = bpe.encode_decode(df, path).collect()
    assert len(out) == len(rows)
    for r in out:
        want = own.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == want
        assert r.decoded == own.decode(want, skip_special_tokens=False)
    twice = bpe.decode(bpe.encode(spark.createDataFrame(rows, DOCS), path), path).collect()
    assert {(r.doc_id, r.decoded) for r in twice} == {(r.doc_id, r.decoded) for r in out}
    assert bpe.encode_decode(spark.createDataFrame([], DOCS), path).count() == 0


def test_bpe_query_matches_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    import hashlib

    own = tokenizers.Tokenizer.from_file(queries.tokenizer_path())
    own.no_truncation()
    own.no_padding()
    docs = {r.doc_id: r.text or "" for r in queries.table(spark, "/root/testdata/sf0.001", "documents").collect()}
    for r in queries.op3_bpe(spark, "/root/testdata/sf0.001").collect():
        ids = own.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(own.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_caches_are_bounded():
    model = bpe.Model(queries.tokenizer_path())
    model.words.limit = model.known.limit = 1000
    for k in range(30):
        model.encode([f"{'x' * 2000}{k}", "汉字" * 1000 + str(k), " ".join(f"w{k}y{j}" for j in range(400))])
        for cache in (model.words, model.known):
            assert len(cache.young) <= 1000 and len(cache.old) <= 1000
            assert all(len(w) <= 64 for w in [*cache.young, *cache.old])


# --- decontamination --------------------------------------------------------------------------------------------


def test_decontaminate(spark):
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 5))
    items = [(k, " ".join(word() for _ in range(25))) for k in range(20)] + [(50, "just five words in it"), (51, None), (52, ""), (53, "!!")]
    docs, want = [], {}
    for k in range(60):
        words = [word() for _ in range(80)]
        if k % 3 == 0:
            item = k % 20
            leak = items[item][1].split()
            for p in rng.choice(np.arange(2, 23), k % 4, replace=False):
                leak[p] = word()
            words[30:30] = [w.upper() + "," for w in leak]
            want[k] = item
        docs.append((k, " ".join(words)))
    docs += [(100, None), (101, ""), (102, "So: JUST five, words in it."), (103, " ".join(items[3][1].split()[:9]))]
    df = spark.createDataFrame(docs, DOCS).withColumn("item_id", F.lit("clash"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (1_000_000, 60):
        got = {(r.doc_id, r.item_id) for r in decontaminate.rows(decontaminate.flag(df, bench, block)).collect()}
        assert got == set(want.items()) | {(102, 50)}
    assert decontaminate.rows(decontaminate.flag(df, bench.limit(0))).count() == 0
    assert decontaminate.rows(decontaminate.flag(df.limit(0), bench)).count() == 0
    assert decontaminate.flag(df, bench).count() == len(docs)


def test_decontaminate_short_items(spark):
    """Every choice of ignored tokens that leaves enough, also at the ends of a text, against the rule itself."""
    items = [(n, " ".join(f"i{n}x{k}" for k in range(n))) for n in range(1, 17)]
    docs = []
    for n, text in items[:15]:
        for gone in range(n - decontaminate.needed(n) + 2):
            for places in list(itertools.combinations(range(n), gone))[::7 if gone > 2 else 1]:
                words = ["zz" if k in places else t for k, t in enumerate(text.split())]
                docs += [(n, " ".join(["aa", *words, "bb"])), (n, " ".join(words).strip("z ") or "zz")]
    docs = [(k, n, t) for k, (n, t) in enumerate(docs)]
    want = set()
    for k, n, t in docs:
        item, words = items[n - 1][1].split(), t.split()
        for gap in range(-n, len(words)):
            same = np.array([0 <= p + gap < len(words) and words[p + gap] == x for p, x in enumerate(item)])
            a, b = decontaminate.best_stretch(same)
            if same[a:b].sum() >= decontaminate.needed(n):
                want.add((k, n))
    table = spark.createDataFrame([(k, t) for k, _, t in docs], DOCS)
    for block in (1_000_000, 40):
        got = {(r.doc_id, r.item_id) for r in decontaminate.rows(decontaminate.flag(table, spark.createDataFrame(items, "item_id long, text string"), block)).collect()}
        assert got == want


def _index(texts):
    tokens = [w.hash[a:b] for _, _, w in blocks(pa.array(texts), lower=True, letters=True) for a, b in itertools.pairwise(w.first)]
    return decontaminate.Index.of(np.arange(len(texts)), np.concatenate(tokens), np.concatenate([[0], np.cumsum([*map(len, tokens)])]))


def test_decontaminate_long_items_against_all_diagonals():
    """Items of more than SHORT tokens with replaced ones: nothing is found that the rule denies, and hardly anything is missed."""
    rng = np.random.default_rng(7)
    items, docs, want = [], [], []
    for k in range(1500):
        n, share = int(rng.choice([16, 18, 20, 25, 40])), float(rng.choice([0.1, 0.2, 0.3]))
        item = [f"i{k}x{j}" for j in range(n)]
        doc = [f"z{k}q{j}" if rng.random() < share else x for j, x in enumerate(item)]
        lead = [f"d{k}y{j}" for j in range(int(rng.integers(0, 9)))]
        best = 0
        for gap in range(-n + 1, len(lead) + n):
            same = np.array([0 <= p + gap < len(lead) + n and (lead + doc)[p + gap] == x for p, x in enumerate(item)])
            a, b = decontaminate.best_stretch(same)
            best = max(best, int(same[a:b].sum()))
        items.append(" ".join(item))
        docs.append(" ".join(lead + doc))
        want.append(best if best >= decontaminate.needed(n) else 0)
    got = [x for _, _, w in blocks(pa.array(docs), lower=True, letters=True) for x in _index(items).leaks(w)]
    for k, (leaks, best) in enumerate(zip(got, want)):
        assert not leaks or (best and [x["item_id"] for x in leaks] == [k] and leaks[0]["n_matched"] <= best)
    assert sum(bool(x) for x in got) >= 0.99 * sum(x > 0 for x in want)


def test_decontaminate_best_stretches():
    rng = np.random.default_rng(9)
    same, size = rng.random((500, 30)) < 0.6, rng.integers(0, 31, 500)
    same &= np.arange(30) < size[:, None]
    begin, end = decontaminate.best_stretches(same, size)
    assert [(int(a), int(b)) for a, b in zip(begin, end)] == [decontaminate.best_stretch(x[:n]) for x, n in zip(same, size)]


def test_decontaminate_hot_opening():
    """Many items that begin alike, and a text that repeats this beginning."""
    opening = "which of the following statements about the topic is"
    index = _index([f"{opening} " + " ".join(f"w{k}x{j}" for j in range(12)) for k in range(20_000)])
    for _, _, w in blocks(pa.array([f"{opening} " * 20 + " ".join(f"w7x{j}" for j in range(12)), "x" * 100_000 + " y" * 100_000]), lower=True, letters=True):
        began = time.process_time()
        assert [[x["item_id"] for x in leaks] for leaks in index.leaks(w)] == [[7], []][: w.n_rows]
        assert time.process_time() - began < 5


def test_decontaminate_many_blocks(spark):
    """Blocks have a pass each; nulls, copies and clashing names stay as with one block."""
    items = [(k, " ".join(f"i{k}x{j}" for j in range(20))) for k in range(15)]
    docs = [(k, f"a {items[k % 15][1]} b {items[(k + 4) % 15][1]}" if k % 2 else "plain words") for k in range(30)] + [(50, None), (51, ""), (52, None), (None, items[3][1])] + [(60 + k, items[1][1]) for k in range(20)]
    df = spark.createDataFrame([(k, t, "x", "y") for k, t in docs], "doc_id long, text string, _text_a string, Leaks string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    one, many = (decontaminate.flag(df, bench, n) for n in (1_000_000, 40))
    assert many.columns == one.columns == ["doc_id", "text", "_text_a", "leaks"]
    assert sorted(map(str, many.collect())) == sorted(map(str, one.collect()))
    assert "MapInArrow" not in many._jdf.queryExecution().executedPlan().toString()


def test_decontaminate_blocks_by_true_tokens(spark):
    bench = spark.createDataFrame([(k, "\n".join(f"i{k}x{j}" for j in range(20))) for k in range(10)], "item_id long, text string")
    sizes = [len(x.token) for x in decontaminate._item_blocks(bench, 40)]
    assert sum(sizes) == 200 and max(sizes) <= 60


# --- classifiers ------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("query", "label", "fold", "least"), [("op8_toxicity", "toxic", (5, 0), 0.98), ("op9_quality", "quality", (3, 1), 0.98)])
def test_held_out_accuracy(spark, query, label, fold, least):
    labels = {r.doc_id: r[label] for r in queries.table(spark, SF, "labels").collect()}
    rows = queries.QUERIES[query](spark, SF).collect()
    assert len(rows) == queries.table(spark, SF, "documents").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % fold[0] == fold[1])
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in held) / len(held) >= least


def test_classifiers_on_odd_rows(spark):
    docs = spark.createDataFrame([(1, "good words here"), (2, "bad bad bad"), (3, None), (4, ""), (4, ""), (None, "bad")], DOCS)
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 1, None), (9, None, 1)], "doc_id long, quality int, toxic int")
    for module in (toxicity, quality):
        for some in (labels, labels.limit(0)):
            model = module.from_labels(docs, some, folds=7, held_out=6)
            got = module.score(docs.withColumn("score", F.lit("clash")), model).collect()
            assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
        assert module.score(docs.limit(0), model).count() == 0


def test_unlabelled_risk_does_not_overfit():
    rng = np.random.default_rng(2)
    text = lambda toxic: np.unique(np.concatenate([rng.integers(1000, 9000, 40), rng.integers(0, 10, 5) if toxic else []]).astype(int))
    positive = [text(True) for _ in range(200)]
    unlabelled = [text(k % 10 == 0) for k in range(1000)]
    model = toxicity.fit_arrays(positive, unlabelled, 0.1)
    table = np.zeros(1 << toxicity.BITS)
    table[model.index] = model.weight
    said = [table[x].sum() + model.bias > 0 for x in unlabelled]
    assert sum(s == (k % 10 == 0) for k, s in enumerate(said)) > 980


def test_quality_features_of_empty_column():
    assert quality.features(pa.array([], pa.string())).shape[0] == 0
