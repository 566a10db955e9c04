"""Bucketed stores, the event log, partial top-k, figures and budgeted intake, against the stated rules."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from stackloom import schemas
from stackloom.functions import citations, standard
from stackloom.operators import history, intake, retrieval
from stackloom.sources import files as readers
from stackloom.sources import sinks, store

PAPER = "id string, title string, status string, markdown string"


def files(path):
    """{bucket folder: its data files}."""
    return {d: sorted(f for f in os.listdir(f"{path}/{d}") if f.endswith(".parquet")) for d in os.listdir(path) if d.startswith("_bucket=")}


def test_upsert_leaves_other_buckets(spark, tmp_path):
    path = str(tmp_path / "papers")
    papers = store.Store(spark, path, schemas.PAPERS, "id", buckets=32)
    assert papers.read().count() == 0 and papers.read().columns == schemas.PAPERS.names
    rows = [(f"doc{k}", f"t{k}", "PARSED", "x") for k in range(400)]
    papers.upsert(spark.createDataFrame(rows, PAPER))
    before = files(path)
    touched = papers.upsert(spark.createDataFrame([(f"doc{k}", "new", "EXPORTED", "y") for k in (1, 2, 3)] + [("more", "m", "PARSED", None)], PAPER))
    after = files(path)
    assert len(before) == 32 and len(touched) <= 4
    assert {d for d in after if after[d] != before[d]} == {f"_bucket={n}" for n in touched}
    got = {r.id: r.title for r in papers.read().collect()}
    assert len(got) == 401 and got["doc1"] == "new" and got["doc4"] == "t4" and got["more"] == "m"
    assert sorted(r.id for r in papers.of(spark.createDataFrame([("doc7",), ("doc8",), ("none",)], "id string")).collect()) == ["doc7", "doc8"]
    # The number of buckets is the stored one.
    assert store.Store(spark, path, schemas.PAPERS, "id", buckets=5).buckets == 32


def test_delete_empties_buckets(spark, tmp_path):
    path = str(tmp_path / "papers")
    papers = store.Store(spark, path, schemas.PAPERS, "id", buckets=16, files=2)
    papers.upsert(spark.createDataFrame([(f"doc{k}", "t", "PARSED", "x") for k in range(20)], PAPER))
    papers.delete(spark.createDataFrame([(f"doc{k}",) for k in range(20)], "id string"))
    assert papers.read().count() == 0 and not files(path)
    assert papers.upsert(spark.createDataFrame([], PAPER)) == []
    papers.upsert(spark.createDataFrame([("again", "t", "PARSED", "x")], PAPER))
    assert [r.id for r in papers.read().collect()] == ["again"]


def test_library_writes(spark, tmp_path):
    lib = store.Library(spark, str(tmp_path), buckets=8)
    now = F.lit("2024-01-01 00:00:00")
    docs = spark.createDataFrame([("a", "h1"), ("b", "h1"), ("c", "h1")], "doc_id string, md_hash string")
    chunks = spark.createDataFrame([(1, "a", 0, "x"), (2, "a", 1, "y"), (3, "b", 0, "z")], "chunk_id long, doc_id string, chunk_index int, content string")
    lib.replace_chunks(docs, chunks, now)
    assert {r.doc_id: (r.n_chunks, r.embedded) for r in lib.meta.read().collect()} == {"a": (2, False), "b": (1, False), "c": (0, False)}
    lib.save_embeddings(spark.createDataFrame([("a", 1, [1.0]), ("b", 3, [2.0]), ("c", None, None)], "doc_id string, chunk_id long, vector array<double>"), "m1")
    assert {r.doc_id: r.embedded for r in lib.meta.read().collect()} == {"a": False, "b": True, "c": True}
    # A text that did not change keeps its vectors; one that did loses them, and only its own.
    lib.replace_chunks(spark.createDataFrame([("b", "h2")], "doc_id string, md_hash string"), spark.createDataFrame([(4, "b", 0, "new")], "chunk_id long, doc_id string, chunk_index int, content string"), now)
    got = {r.chunk_id: (r.embedding, r.embedding_model) for r in lib.chunks.read().collect()}
    assert got == {1: ([1.0], "m1"), 2: (None, None), 4: (None, None)}
    assert {r.doc_id: (r.md_hash, r.embedded) for r in lib.meta.read().collect()}["b"] == ("h2", False)
    lib.papers.upsert(spark.createDataFrame([("a", "t", "PARSED", "x"), ("b", "t", "PARSED", "x")], PAPER))
    lib.transition(spark.createDataFrame([("a", "BATCH_FAILED", "quota")], "id string, new_status string, new_error string"))
    assert {r.id: (r.status, r.error_message) for r in lib.papers.read().collect()} == {"a": ("BATCH_FAILED", "quota"), "b": ("PARSED", None)}
    lib.save_details(spark.createDataFrame([("a", "有效", "T")], "doc_id string, legal_status string, title string"))
    lib.save_details(spark.createDataFrame([("a", "", "T2")], "doc_id string, legal_status string, title string"))
    assert [(r.legal_status, r.title) for r in lib.details.read().collect()] == [("有效", "T2")]


# --- retrieval --------------------------------------------------------------------------------------------------


def plain_search(rows, query, k, cap):
    """The rule: chunks in the order of scores, at most ``cap`` of a document, until there are ``k``."""
    good = [(c, d, v) for c, d, v in rows if v is not None and len(v) == len(query) and all(x is not None and x == x for x in v)]
    scored = sorted(((-float(np.dot(v, query)), c, d) for c, d, v in good))
    held, out = {}, []
    for s, c, d in scored:
        if held.get(d, 0) < cap and len(out) < k:
            held[d] = held.get(d, 0) + 1
            out.append((c, d, round(-s, 9)))
    return out


@pytest.mark.parametrize("parts", [1, 7])
def test_partial_best_is_exact(spark, parts):
    rng = np.random.default_rng(3)
    rows = [(k, f"d{int(rng.integers(0, 12)) if k % 3 else 0}", rng.standard_normal(16).round(2).tolist()) for k in range(900)]
    rows += [(1000 + k, f"d{k % 2}", rows[5][2]) for k in range(30)]  # ties
    rows += [(2000, "x", None), (2001, "x", [1.0, None] * 8), (2002, "x", [float("nan")] * 16), (2003, "x", [1.0]), (2004, None, rows[5][2])]
    df = spark.createDataFrame(rows, "chunk_id long, doc_id string, embedding array<double>").repartition(parts)
    for k, cap in ((24, 4), (5, 1), (2000, 3)):
        got = [(r.chunk_id, r.doc_id, round(r.score, 9)) for r in retrieval.search(df, rows[5][2], k, cap).collect()]
        assert got == plain_search(rows, rows[5][2], k, cap)
    merged = retrieval.nearest(df, [rows[5][2], rows[6][2]], 10, 4)
    assert merged.count() <= 2 * 10 * df.rdd.getNumPartitions()


def test_gather_of_several_dimensions(spark):
    df = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "a", [0.0, 1.0]), (3, "b", [1.0])], "chunk_id long, doc_id string, embedding array<double>")
    asked = spark.createDataFrame([(1, "q", [1.0, 0.0]), (1, "r", [2.0]), (2, "s", [0.0, 3.0]), (2, "none", None)], "section int, question string, vector array<double>")
    got = {(r.section, r.chunk_id): r.score for r in retrieval.gather(df, asked, 5, 5).collect()}
    assert got == {(1, 1): 1.0, (1, 2): 0.0, (1, 3): 2.0, (2, 1): 0.0, (2, 2): 3.0}


def plain_figures(rows, files, cap, least):
    """The rule: sections in order, best captions first, what is placed is not placed again, missing files use up the cap."""
    used, out = set(), []
    for section in sorted({r[0] for r in rows}):
        best = {}
        for s, path, caption, score in rows:
            if s == section and score >= least and caption.strip() and path not in used:
                best[path] = max(best.get(path, score), score)
        for path in sorted(best, key=lambda p: (-best[p], p))[:cap]:
            if files is None or path in files:
                used.add(path)
                out.append((section, path))
    return sorted(out)


def test_figures_in_one_plan(spark):
    rng = np.random.default_rng(5)
    rows = [(s, f"img/{int(rng.integers(0, 60))}.jpg", "caption" if rng.random() < 0.9 else " ", round(float(rng.random()), 2)) for s in range(50) for _ in range(40)]
    df = spark.createDataFrame(rows, "section int, img_path string, caption string, score double")
    have = {f"img/{k}.jpg" for k in range(60) if k % 3}
    files = spark.createDataFrame([(p,) for p in have], "path string")
    for known, table in ((None, None), (have, files)):
        out = retrieval.figures(df, table)
        assert sorted((r.section, r.img_path) for r in out.collect()) == plain_figures(rows, known, 2, 0.2)
    few, many = (retrieval.figures(df.filter(f"section < {n}"), files)._jdf.queryExecution().optimizedPlan().toString().count("\n") for n in (2, 50))
    assert few == many
    both = df.withColumn("review", F.lit("a")).union(df.filter("section < 7").withColumn("review", F.lit("b")))
    got = sorted((r.review, r.section, r.img_path) for r in retrieval.figures(both, files, review="review").collect())
    assert got == [("a", *x) for x in plain_figures(rows, have, 2, 0.2)] + [("b", *x) for x in plain_figures([r for r in rows if r[0] < 7], have, 2, 0.2)]


def test_figure_blocks(spark):
    rows = [(1, "img/a.jpg", "Growth", 0.5, "0123456789ab", "figure"), (1, "img/b.jpg", "Rates", 0.9, "ffffffffffff", "table")]
    got = retrieval.figure_blocks(spark.createDataFrame(rows, "section int, img_path string, caption string, score double, doc_id string, asset_type string")).first()
    assert got.markdown == "![表](assets/ffffffff_b.jpg)\n*表：Rates（源自 [@ffffffff]）*\n\n![图](assets/01234567_a.jpg)\n*图：Growth（源自 [@01234567]）*"
    assert [tuple(c) for c in got.copies] == [("img/b.jpg", "assets/ffffffff_b.jpg"), ("img/a.jpg", "assets/01234567_a.jpg")]


# --- intake -----------------------------------------------------------------------------------------------------


def plain_intake(files, budget):
    out = []
    for batch in sorted({f[0] for f in files}):
        used = 0
        for _, name, known, epub, verdict, pages in sorted(f for f in files if f[0] == batch):
            if known or epub or verdict in ("corrupt", "transient"):
                out.append((batch, name, "skipped" if known else "ok" if epub else "quarantined" if verdict == "corrupt" else "failed", 0))
            elif used and pages > budget - used:
                out.append((batch, name, "deferred", 0))
            else:
                used += pages
                out.append((batch, name, "ok", pages))
    return sorted(out)


@pytest.mark.parametrize("parts", [1, 8])
def test_intake_scan(spark, parts):
    rng = np.random.default_rng(parts)
    files = []
    for batch, n in (("one", 700), ("three", 3), ("two", 90), *((f"b{k:03}", int(rng.integers(1, 6))) for k in range(60))):
        for k in range(n):
            files.append((batch, f"f{k:05}", bool(rng.random() < 0.1), bool(rng.random() < 0.1), str(rng.choice(["ok", "corrupt", "transient"], p=[0.8, 0.1, 0.1])), int(rng.choice([0, 1, 3, 20, 45, 120]))))
    files += [("huge", "a", False, False, "ok", 500), ("huge", "b", False, False, "ok", 0), ("huge", "c", False, True, "ok", 7)]
    df = spark.createDataFrame(files, "batch string, name string, known boolean, epub boolean, verdict string, pages long")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted(map(tuple, intake.decide(df.withColumn("part", F.lit("clash")), 100).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == plain_intake(files, 100)
    assert intake.decide(df.limit(0), 100).count() == 0


def test_intake_of_one_large_batch(spark):
    """A million files of one batch: no task holds them all, and decisions carry over the tasks."""
    files = spark.range(1_000_000).select(F.lit("day").alias("batch"), F.format_string("%07d", "id").alias("name"), F.lit(False).alias("known"), F.lit(False).alias("epub"), F.lit("ok").alias("verdict"), (F.col("id") % 7 + F.when(F.col("id") % 11 == 0, 300).otherwise(1)).alias("pages"))
    rows = {r.outcome: (r.n, r.pages) for r in intake.report(intake.decide(files, 2000)).collect()}
    used = n = 0
    for k in range(1_000_000):
        pages = k % 7 + (300 if k % 11 == 0 else 1)
        if not used or pages <= 2000 - used:
            used, n = used + pages, n + 1
    assert rows["ok"] == (n, used) and rows["deferred"][0] == 1_000_000 - n


# --- event log --------------------------------------------------------------------------------------------------


def test_log_lines_come_as_they_were_written(spark, tmp_path):
    """Appends of different sizes, of which Spark packs several into one task, and one of several parts."""
    path, want = str(tmp_path / "log"), []
    for day, n in enumerate((3, 30, 1, 12, 400, 2)):
        rows = [(f"2024-01-0{day + 1} 00:00:00", "batch", f"e{day}-{k}", "failed" if k % 2 else "success") for k in range(n)]
        want += [r[2] for r in rows]
        df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, ts string, mode string, event string, status string")
        sinks.append_events(df.repartitionByRange(4 if n > 100 else 1, "k").sortWithinPartitions("k").drop("k"), path)
    log = readers.events(spark, path)
    assert [r.event for r in log.orderBy("ord").collect()] == want
    assert [r.event for r in readers.numbered(log).orderBy("n").collect()] == want
    assert sorted(r.n for r in readers.numbered(log).collect()) == list(range(1, len(want) + 1))
    failed = [e for e in want if int(e.split("-")[1]) % 2]
    assert [r.event for r in history.recent_failures(log).collect()] == failed[-5:][::-1]
    for name in os.listdir(path):  # copying a log gives its files other times
        os.utime(f"{path}/{name}", (1_700_000_000 + hash(name) % 1000,) * 2)
    assert [r.event for r in readers.events(spark, path).orderBy("ord").collect()] == want


def test_one_log_file_in_many_blocks(spark, tmp_path):
    path = tmp_path / "history.jsonl"
    path.write_text("".join(f'{{"timestamp": "2024-01-01 00:00:00", "mode": "batch", "event": "e{k}", "status": "failed"}}\n' + ("broken\n" if k % 50 == 0 else "") for k in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        log = readers.events(spark, str(path))
        assert log.rdd.getNumPartitions() > 5
        assert [r.event for r in log.orderBy("ord").collect()] == [f"e{k}" for k in range(3000)]
        assert [r.event for r in history.recent_failures(log).collect()] == [f"e{k}" for k in range(2999, 2994, -1)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_extra_keys_win(spark, tmp_path):
    rows = [("2024-01-01 00:00:00", "batch", "batch_submitted", '{"count": 3, "status": "failed", "batch_id": "b1"}'), ("2024-01-02 00:00:00", "book", "book_added", None), ("2024-01-03 00:00:00", "book", None, "[1]")]
    lines = sinks.event_lines(spark.createDataFrame(rows, "ts string, mode string, event string, extra string").coalesce(1))
    sinks.append_events(lines, str(tmp_path / "log"))
    assert '"batch_id":"b1"' in lines.first().value
    got = readers.events(spark, str(tmp_path / "log")).orderBy("ord").collect()
    assert [(r.event, r.status, r["count"], r.title) for r in got] == [("batch_submitted", "failed", 3, ""), ("book_added", "success", None, ""), ("", "success", None, "")]


# --- small rules ------------------------------------------------------------------------------------------------


def test_described_standards_and_unknown_titles(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    say = lambda *x: one(standard.describe(*map(F.lit, x)))
    assert say("GB/T 1677-2008", "2008-11-01", "现行", "2024-05-01") == "GB/T 1677-2008 | 2008-11-01 实施 | 状态 现行（2024-05-01 核实）"
    assert say("", "", "", "") == "编号未识别 | 状态 未核实"
    assert say("A", "", "废止", "") == "A | 状态 废止"
    none = F.lit(None).cast("string")
    assert one(citations.best_title(none, none, none, F.lit(True))) == "未知文献"
    assert one(standard.lines(F.lit("a\x0bb\x0cc\x85d\u2028e\u2029f\r\ng"))) == list("abcdefg")


def test_notes(spark):
    rows = [("0123456789", "A: b/c", "zh", "网页", "http://x", '{"authors": "Li", "abstract": "From the model", "year": 1999}'), ("9876543210", "..", None, "?", None, "{broken"), ("aaaaaaaaaa", None, "", "book", None, None)]
    papers = spark.createDataFrame(rows, "id string, title string, language string, doc_type string, url string, result_json string")
    images = spark.createDataFrame([("0123456789", 2, "o/b.png"), ("0123456789", 1, "o\\\\a.png"), ("0123456789", 3, "o/gone.png")], "id string, pos int, path string")
    there = spark.createDataFrame([("o/b.png",), ("o\\\\a.png",)], "path string")
    got = {r.id: r for r in sinks.notes(papers, F.lit("2024-05-01"), images, there).collect()}
    one = got["0123456789"]
    assert one.file_name == "A bc_01234567.md" and '  - "#web"' in one.content and "**网址**: http://x" in one.content and "**年份**: 1999" in one.content and "From the model" in one.content
    assert one.content.endswith("![图表](attachments/0123456789/a.png)\n![图表](attachments/0123456789/b.png)") and [c.target for c in one.copies] == ["attachments/0123456789/a.png", "attachments/0123456789/b.png"]
    assert got["9876543210"].file_name == "Untitled_Paper_98765432.md" and "**期刊/会议**: 未提取" in got["9876543210"].content and got["9876543210"].content.endswith(sinks.NO_IMAGES)
    assert got["aaaaaaaaaa"].file_name == "Untitled_aaaaaaaa.md" and 'title: "Unknown Title"' in got["aaaaaaaaaa"].content and 'year: "2024"' in got["aaaaaaaaaa"].content
    assert {r.id: len(r.copies) for r in sinks.notes(papers, F.lit("2024-05-01")).collect()} == dict.fromkeys(got, 0)
