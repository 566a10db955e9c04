"""Behaviour of the store, text, intake and streaming pieces on small literal tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stackloom import schemas, vocab
from stackloom.functions import chunking, citations, patent, text
from stackloom.operators import blocks, catalog, history, intake, models, retrieval, state
from stackloom.plans import jobs
from stackloom.sources import files, sinks
from stackloom.streaming import jobs as streams


def one(spark, column, **values):
    ddl = ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'long'}" for k, v in values.items()) or "x string"
    return spark.createDataFrame([tuple(values.values()) or ("",)], ddl).select(column.alias("v")).first()[0]


def test_empty_tables_answer(spark):
    papers, chunks, meta, details = (spark.createDataFrame([], s) for s in (schemas.PAPERS, schemas.CHUNKS, schemas.INDEX_META, schemas.DETAILS))
    assert state.needs_index(papers, meta).count() == 0
    assert retrieval.search(chunks, [1.0, 0.0]).count() == 0
    assert catalog.library_stats(papers, meta, chunks).first()["chunks"] == 0
    assert catalog.type_table(papers, details).count() == len(vocab.DOC_TYPES)
    assert schemas.load(spark, "/tmp/stackloom-no-such-table", schemas.PAPERS).count() == 0


def test_conform_adds_columns(spark):
    old = spark.createDataFrame([("a", "T")], "doc_id string, title string")
    assert "doc_type" in schemas.missing(old, schemas.DETAILS)
    row = schemas.conform(old, schemas.DETAILS).first()
    assert row.doc_type == "paper" and row.n_refs == 0 and row.doi is None


def test_search_cap_and_dimension(spark):
    e = np.eye(4)
    rows = [(k, "a", e[0].tolist()) for k in range(6)] + [(10, "b", e[1].tolist()), (11, "c", [0.9, 0.1, 0.0, 0.0]), (12, "d", [1.0, 0.0])]
    got = retrieval.search(spark.createDataFrame(rows, "chunk_id long, doc_id string, embedding array<double>"), e[0].tolist(), 10, 2).collect()
    assert [r.chunk_id for r in got] == [0, 1, 11, 10]


def test_prune_keeps_small_sets(spark):
    table = lambda n: spark.createDataFrame([(k, [float(k)]) for k in range(1, n + 1)], "doc_id long, vector array<double>")
    assert retrieval.topic_prune(table(10), [1.0]).count() == 10
    assert min(r.score for r in retrieval.topic_prune(table(20), [1.0]).collect()) == 7
    assert retrieval.topic_prune(table(200), [1.0]).count() == 80


def test_index_round(spark):
    papers = spark.createDataFrame([("a", "text one", "EXPORTED"), ("b", "text two", "EXPORTED"), ("c", "x", "PARSED"), ("d", "", "EXPORTED")], "id string, markdown string, status string")
    meta = spark.createDataFrame([], "doc_id string, md_hash string, embedded boolean")
    todo = state.needs_index(papers, meta)
    assert {r.id for r in todo.collect()} == {"a", "b"}
    done = todo.filter("id = 'a'").select(F.col("id").alias("doc_id"), "md_hash", F.lit(True).alias("embedded"))
    assert {r.id for r in state.needs_index(papers, done).collect()} == {"b"}
    changed = papers.withColumn("markdown", F.when(F.col("markdown") != "", F.concat("markdown", F.lit("!"))))
    assert {r.id for r in state.needs_index(changed, done).collect()} == {"a", "b"}


def test_carry_forward_and_status(spark):
    ddl = "doc_id string, title string, legal_status string, status_checked_at string, doc_type string"
    old = spark.createDataFrame([("d1", "t", "", "", "patent")], ddl)
    with_status = state.set_status(old, spark.createDataFrame([("d1",)], "doc_id string"), "驳回", "2026-08-04")
    new = spark.createDataFrame([("d1", "t2", "", "", "paper"), ("d2", "n", "", "", "paper")], ddl)
    rows = {r.doc_id: r for r in state.carry_forward(with_status, new).collect()}
    assert (rows["d1"].legal_status, rows["d1"].status_checked_at, rows["d1"].doc_type, rows["d1"].title) == ("驳回", "2026-08-04", "paper", "t2")
    assert rows["d2"].legal_status == ""
    assert {r.doc_type for r in state.carry_forward(with_status, new.filter("doc_id = 'd1'"), protect_type=True).collect()} == {"paper"}
    with pytest.raises(ValueError):
        state.set_status(old, old, "", "2026-08-04")


def test_chunks():
    md = "lead text that is long enough to stay here.\n# One\n" + "Sentence number one is here. " * 20 + "\n## Two\nshort\n"
    got = chunking.split(md, 100, 20)
    assert got[0] == ("", "lead text that is long enough to stay here.")
    assert all(t in ("", "One") for t, _ in got)
    assert all(c.startswith("One\n") for t, c in got if t == "One")
    assert max(len(c) for _, c in got) <= 100 * 1.3 + 20 + 6
    assert [len(c) for _, c in chunking.split("x" * 250, 100, 0)] == [100, 100, 50]
    assert chunking.split("", 100, 10) == [] and chunking.split("tiny", 100, 10) == []


def test_text_functions(spark):
    md = "![a](b.png)Body " + "y" * 100 + "\n\n\n\nmore\n# References\n[1] x"
    assert one(spark, text.clean_markdown(F.lit(md))) == "Body " + "y" * 100 + "\n\nmore"
    assert one(spark, text.clean_markdown(F.lit("References\n" + "z" * 50))) == "References\n" + "z" * 50
    assert one(spark, text.doi(F.lit("doi:10.1000/ab.c1). Next"))) == "10.1000/ab.c1"
    assert one(spark, text.safe_title(F.lit("A: b/c?"))) == "A bc" and one(spark, text.safe_title(F.lit("??"))) == "Untitled_Paper"
    assert one(spark, text.abstract(F.lit("# T\n摘要：内容。\nmore"))) == "内容。"
    assert one(spark, text.looks_chinese(F.lit(""))) is True
    assert one(spark, text.strip(F.lit("　 a \n"))) == "a"
    assert [tuple(x) for x in one(spark, text.images(F.lit("![x](a.png) <img src='b.png' alt='y'>")))] == [("x", "a.png"), ("y", "b.png")]
    assert one(spark, text.transient_error(F.lit("Timeout"))) and not one(spark, text.transient_error(F.lit("bad file")))
    assert one(spark, files.json_object(F.lit('say {"a": 1} so')).cast("string")) == '{"a":1}'
    assert one(spark, vocab.normalize(F.lit("年报"))) == "report" and one(spark, vocab.normalize(F.lit("?"))) == ""


def test_patent_terms(spark):
    made = lambda no, filed: one(spark, patent.expiry(F.lit(no), F.lit(filed)))
    assert made("CN1S", "2020-02-29") == "2035-02-28" and made("CN1U", "2020-01-02") == "2030-01-02"
    assert made("CN1B", "2021-04-31") == "2041-04-30" and made("CN1B", "") == ""
    assert one(spark, patent.date_text(F.lit("Jun. 3, 2016"))) == "2016-06-03" and one(spark, patent.date_text(F.lit("2019 .13 .03"))) == ""
    assert one(spark, patent.stage(F.lit("US2020000001A1"))) == patent.PENDING


def test_history(spark):
    rows = [("2024-05-01 10:00:00", "batch", "batch_submitted", "success", None), ("2024-05-01 11:00:00", "other", "x", "success", None), ("bad", "batch", "paper_parsed", "success", None)]
    log = spark.createDataFrame(rows, "ts string, mode string, event string, status string, count long").withColumns({"completed": F.lit(None).cast("long"), "failed": F.lit(None).cast("long")})
    got = history.daily(log).collect()
    assert [(r.day, r.submitted_ok) for r in got] == [("2024-05-01", 1)]
    assert history.daily(log, 3, F.lit("2024-06-01").cast("date")).count() == 0


def test_intake(spark):
    ddl = "batch string, name string, known boolean, epub boolean, verdict string, pages long"
    rows = [("d", n, False, False, "ok", p) for n, p in (("a", 6), ("b", 6), ("c", 2))]
    got = {r.name: r.outcome for r in intake.decide(spark.createDataFrame(rows, ddl), 10).collect()}
    assert got == {"a": "ok", "b": "deferred", "c": "ok"}


def test_batch_results(spark):
    lines = [
        ('{"custom_id": "a", "response": {"body": {"choices": [{"message": {"content": "{\\"x\\": 1}"}}]}}}',),
        ('{"id": "b", "response": {"candidates": [{"content": {"parts": [{"text": "no json"}]}}]}}',),
        ("broken",),
        ("",),
    ]
    got = files.batch_results(spark.createDataFrame(lines, "value string"))
    papers = spark.createDataFrame([("a", "BATCH_SUBMITTED", "old", None), ("b", "BATCH_SUBMITTED", None, None)], "id string, status string, error_message string, result_json string")
    after = {r.id: r for r in jobs.fetch(papers, got.filter("id is not null")).collect()}
    assert got.count() == 3 and after["a"].status == "COMPLETED" and after["a"].error_message is None and after["a"].result_json == '{"x": 1}'
    assert after["b"].status == "RESULT_PARSE_FAILED"


def test_models_and_evidence(spark):
    e = models.hashing_embedder(16)
    chunks = spark.createDataFrame([(k, f"d{k % 3}", f"alpha beta gamma {k}") for k in range(9)], "chunk_id long, doc_id string, content string")
    vectors = models.embed(chunks, e).collect()
    assert all(abs(np.linalg.norm(r.vector) - 1) < 1e-6 for r in vectors)
    table = chunks.join(models.embed(chunks, e).withColumnRenamed("vector", "embedding"), "chunk_id")
    asked = spark.createDataFrame([(1, "alpha beta", (e(["alpha beta"])[0]).tolist())], "section int, question string, vector array<double>")
    judge = lambda q, ts: [(7 + len(t) % 2, "fine") for t in ts]
    got = jobs.gather_evidence(table, asked, lambda q, ts: [float(len(t)) for t in ts], judge).collect()
    assert 0 < len(got) <= 10 and all(r.score >= 6 for r in got)

    def fails(q, ts):
        raise RuntimeError

    assert jobs.gather_evidence(table, asked, fails, judge).count() > 0
    assert jobs.gather_evidence(table, asked, None, fails).count() == 0


def test_sources_and_swap(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes(b"x")
    (tmp_path / "in" / "b.EPUB").write_bytes(b"yy")
    row = files.unsupported(spark, str(tmp_path / "in")).first()
    assert (row.n, row.extensions) == (1, [".epub"])
    assert files.pdfs(spark, str(tmp_path / "in")).first().length == 1
    (tmp_path / "log.jsonl").write_text('{"ts": "2024-01-01 00:00:00", "mode": "batch", "event": "x", "status": "failed"}\nbroken\n')
    assert files.events(spark, str(tmp_path / "log.jsonl")).count() == 1
    assert files.events(spark, str(tmp_path / "none.jsonl")).count() == 0
    path = str(tmp_path / "t")
    sinks.swap(spark.range(3), path)
    sinks.swap(spark.read.parquet(path).filter("id > 0"), path)
    assert spark.read.parquet(path).count() == 2
    (tmp_path / "layout").mkdir()
    (tmp_path / "layout" / "d_content_list.json").write_text('[{"type": "text", "text": "T", "text_level": 1}, {"type": "image", "img_path": "i.jpg", "image_caption": ["Fig", "1"]}, {"type": "list", "sub_type": "ref_text", "list_items": ["[1] A"]}]')
    layout = files.layout_blocks(spark, str(tmp_path / "layout"))
    assert blocks.title(layout).first().title == "T"
    assert blocks.assets(layout).first().caption == "Fig 1"
    assert blocks.references(layout).first().raw_text == "[1] A"


def test_outline_and_citations(spark):
    lines = spark.createDataFrame([(k, x) for k, x in enumerate(["# T", "- lost", "## S1", "- q1", "- q2", "## S2", "- q3"])], "pos int, line string")
    assert [(r.section_no, r.section, r.question) for r in files.outline(lines).orderBy("section_no", "question").collect()] == [(1, "S1", "q1"), (1, "S1", "q2"), (2, "S2", "q3")]
    none = spark.createDataFrame([], "doc_id string")
    sections = spark.createDataFrame([(1, "x [@aaaaaaaa] y")], "section_no int, markdown string")
    assert citations.renumber(sections, citations.numbered(citations.marked(sections), none)).first().markdown == "x  y"


def test_streams(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.json").write_text(f'{{"ts": "2024-01-0{k + 1} 00:00:00", "mode": "batch", "event": "e", "doc_id": "d{k % 2}", "status": "EXPORTED"}}\nbroken\n')
    stream = streams.event_stream(spark, str(tmp_path), 1)
    taken = []
    known = lambda: spark.createDataFrame([(t,) for t in taken], "id string")
    query = streams.once(stream.withColumn("id", F.col("doc_id")), known, lambda df: taken.extend(r.id for r in df.collect()), str(tmp_path / "c1"))
    query.awaitTermination()
    assert sorted(taken) == ["d0", "d1"]
    changes = stream.select(F.col("doc_id").alias("id"), F.col("status").alias("new_status"), F.col("ts").alias("ord"))
    query = streams.states(changes).writeStream.format("memory").queryName("states").outputMode("update").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert {r.status for r in spark.table("states").collect()} == {"EXPORTED"}
    query = streams.daily(stream).writeStream.format("memory").queryName("daily").outputMode("complete").option("checkpointLocation", str(tmp_path / "c3")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("daily").count() == 3


def test_entry_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_digest_numbers_over_many_partitions(spark):
    """More rows than the range sampler holds, in many partitions that stay apart."""
    conf = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.execution.rangeExchange.sampleSizePerPartition": "5"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        own = spark.range(0, 30_000, numPartitions=6).select(F.format_string("%06d", (F.col("id") * 7919) % 30_000).alias("id"), F.sha1(F.col("id").cast("string")).alias("title"))
        got = catalog.digest(own, own.filter("id % 3 = 0")).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert len(got) == 10_000
    assert all(r.n == int(r.id) + 1 for r in got)


def test_chunks_follow_the_stated_rules():
    """Expected chunks written out by hand: sentences stripped, packed by line ends, overlap from a sentence's start."""
    sentence = "Sentence number one is here."
    got = chunking.split(f"{sentence} " * 12, 100, 0)
    assert [c for _, c in got] == ["\n ".join([sentence] * 3)] * 4
    assert all(c == c.strip() for _, c in got)
    # Overlap: the last 40 characters of the chunk before, from behind the first sentence end in them.
    tail = "\n Sentence number one is here."
    got = [c for _, c in chunking.split(f"{sentence} " * 6, 100, 40)]
    assert got == ["\n ".join([sentence] * 3), tail + "\n" + "\n ".join([sentence] * 3)]
    # A chunk before that is shorter than the overlap is repeated whole.
    got = chunking.split("# H\n" + "a" * 45 + "\n\n" + "b" * 99, 100, 60)
    assert got == [("H", "H\n" + "a" * 45), ("H", "H\n" + "a" * 45 + "\n" + "b" * 99)]
    # Paragraphs are packed, joined by one line end; a small chunk takes in the next; bare text is cut by length.
    assert chunking.split("p" * 40 + "\n\n" + "q" * 40 + "\n\n" + "r" * 90, 100, 0) == [("", "p" * 40 + "\n" + "q" * 40), ("", "r" * 90)]
    assert chunking.split("s" * 30 + "\n\n" + "t" * 95, 100, 0) == [("", "s" * 30 + "\n" + "t" * 95)]
    assert [len(c) for _, c in chunking.split("u" * 120 + "\n" + "v" * 310, 100, 0)] == [120, 100, 100, 100]
    # No overlap across headings; the heading stands before its text; short ends are dropped.
    got = chunking.split("## A\n" + "x" * 60 + "\n## B\n" + "y" * 60 + "\n## C\nz", 100, 20)
    assert got == [("A", "A\n" + "x" * 60), ("B", "B\n" + "y" * 60)]


def test_json_of_answers(spark):
    cases = {
        'so {"a": "}{", "b": {"c": "\\""}} and {"d": 1}': '{"a":"}{","b":{"c":"\\""}}',
        "[1, 2]": "[1,2]",
        "{open": None,
        "none": None,
        '{"a": "never ends}': None,
        "} {\"e\": 2} tail }": '{"e":2}',
        "{not json} {\"f\": 3}": None,
    }
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", files.json_object(F.col("t")).cast("string").alias("j")).collect()
    assert {r.t: r.j for r in rows} == cases


def test_dates_and_stages(spark):
    dates = {"2019 .06 .03": "2019-06-03", "2021.03.08": "2021-03-08", "Mar. 8, 2021": "2021-03-08", "March 18 , 2021": "2021-03-18", "no 2021.03.08": "", "(2021/3/8)": "2021-03-08", "20210308": "2021-03-08", "1899.01.01": "", "2101.01.01": "", "2020.13.01": "", "": "", "Foo 3, 2020": ""}
    rows = spark.createDataFrame([(k,) for k in dates], "t string").select("t", patent.date_text(F.col("t")).alias("d")).collect()
    assert {r.t: r.d for r in rows} == dates
    stages = {"CN1A": "申请公布（审查中）", "CN1B": "发明专利已授权", "CN1C": "发明专利已授权（更正）", "CN1U": "实用新型已授权", "CN1S": "外观设计已授权", "US1B2": "已授权", "US1A1": "申请公开（审查中）", "US1A": "已授权", "EP1A1": "申请公开（审查中）", "EP1B1": "已授权", "CN1": "未知", "": "未知", "JP1X": "未知"}
    rows = spark.createDataFrame([(k,) for k in stages], "t string").select("t", patent.stage(F.col("t")).alias("s")).collect()
    assert {r.t: r.s for r in rows} == stages


def test_standard_titles(spark):
    from stackloom.functions import standard

    covers = [
        (1, "中华人民共和国国家标准\nGB 1886.64-2015\n食 品 安 全 国 家 标 准\n食品添加剂 焦糖色\nNational food additive caramel colour\n2015-11-13发布\n2016-05-13实施", "食品安全国家标准 食品添加剂 焦糖色", "National food additive caramel colour"),
        (2, "中华人民共和国国家标准\n代替 GB/T 1-1981\n犌犅／犜 1-2008\n犲犲犲犲犲\n中华人民共和国国家标准\n某某名称标准\n2008-05-15发布", "某某名称标准", ""),
    ]
    rows = spark.createDataFrame([c[:2] for c in covers], "k int, head string").select("k", standard.fields(F.col("head")).alias("f")).collect()
    assert [(r.f.title, r.f.title_en) for r in sorted(rows, key=lambda r: r.k)] == [c[2:] for c in covers]


def test_small_pieces(spark, tmp_path):
    path = str(tmp_path / "ids")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    sinks.save_ids(spark, path, ids("b", "a", None))
    sinks.save_ids(spark, path, ids("a", "c"))
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == ["a", "b", "c"]
    assert retrieval.allowed_types("all") is None and retrieval.allowed_types("book") == ["book"]
    with pytest.raises(ValueError):
        retrieval.allowed_types("novel")
    assert models.query_text("q", "do") == "Instruct: do\nQuery: q" and models.query_text("q") == "q"
    assert one(spark, blocks.below(F.lit("/out/b\\i\\x.png"), F.lit("/out/b/"))) == "i/x.png"
    book = one(spark, files.book_meta(F.lit("/d/My.Book.pdf"), F.lit("ISBN：978-7-04-012345-6\n出版 2019 年")))
    assert (book.title, book.isbn, book.year) == ("My.Book", "978-7-04-012345-6", "2019")
    outline = spark.createDataFrame([('{"title": "T", "sections": [{"heading": "S1", "questions": ["q1", "q2"]}, {"heading": "S2", "questions": []}]}',)], "value string")
    assert [tuple(r) for r in files.outline_json(outline).orderBy("section_no", "question").collect()] == [("T", 1, "S1", "q1"), ("T", 1, "S1", "q2"), ("T", 2, "S2", None)]
    lines = spark.createDataFrame([(0, "# Old"), (1, "# New "), (2, "## S")], "pos int, line string")
    assert files.outline_title(lines).first().title == "New"
    assets = spark.createDataFrame([("a/1.png",), ("b/2.png",), ("c/3.png",)], "img_path string")
    found = spark.createDataFrame([("file:/two/a/1.png",), ("/one/a/1.png",), ("/two/b/2.png",)], "path string")
    got = {r.img_path: r.file for r in catalog.asset_files(assets, found, ["/one", "/two/"]).collect()}
    assert got == {"a/1.png": "/one/a/1.png", "b/2.png": "/two/b/2.png", "c/3.png": ""}
    totals = catalog.evidence_totals(spark.range(5), spark.createDataFrame([("x",), ("x",), ("y",)], "doc_id string")).first()
    assert (totals.evidence, totals.documents) == (5, 2)


def test_single_pass(spark):
    scanned = spark.createDataFrame([("a", "p1"), ("a", "p1"), ("b", "p2"), ("c", "p3"), ("k", "p4")], "id string, path string")
    parsed = spark.createDataFrame([("a", "A", "x" * 300), ("b", "B", "short"), ("c", "C", "y" * 300)], "id string, title string, markdown string")
    analyses = spark.createDataFrame([("a", "{}"), ("b", "{}")], "id string, result_json string")
    papers, done = jobs.process_new(scanned, spark.createDataFrame([("k",)], "id string"), parsed, analyses)
    assert {r.id: r.status for r in papers.collect()} == {"a": "EXPORTED", "b": "RESULT_PARSE_FAILED", "c": "PARSED"}
    assert {r.id for r in done.collect()} == {"a", "k"}


def test_questions_meet_chunks_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    chunks = spark.createDataFrame([(k, f"d{k % 9}", rng.normal(size=4).tolist()) for k in range(60)], "chunk_id long, doc_id string, embedding array<double>")
    asked = spark.createDataFrame([(k % 3, k, rng.normal(size=4).tolist()) for k in range(12)], "section long, question long, vector array<double>")
    want = sorted(map(tuple, retrieval.gather(chunks, asked, 6, 8).collect()))
    monkeypatch.setattr(retrieval, "QUESTIONS", 3)
    assert sorted(map(tuple, retrieval.gather(chunks, asked, 6, 8).collect())) == want
    assert retrieval.gather(chunks, asked.limit(0), 6, 8).count() == 0
