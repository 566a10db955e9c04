"""Caches, typed answers, embedding with a deadline, notices, timers and EPUB files."""

import zipfile
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from stackloom.operators import answers, cache
from stackloom.sources import files, store
from stackloom.streaming import nightly, timers, watch


def test_cache_follows_another_writer(spark, tmp_path):
    lib = store.Library(spark, str(tmp_path), buckets=4)
    now = lambda k: F.lit(f"2024-01-0{k} 00:00:00")

    def add(doc, chunk, k):
        lib.replace_chunks(spark.createDataFrame([(doc, "h")], "doc_id string, md_hash string"), spark.createDataFrame([(chunk, doc, 0, "x")], "chunk_id long, doc_id string, chunk_index int, content string"), now(k))
        lib.save_embeddings(spark.createDataFrame([(doc, chunk, [1.0, float(k)])], "doc_id string, chunk_id long, vector array<double>"), "m")

    add("a", 1, 1)
    kept = cache.vectors(store.Library(spark, str(tmp_path)), 2)
    first = kept.get()
    assert first.count() == 1 and kept.get() is first and first.is_cached
    add("b", 2, 2)  # by another process, as far as the cache can tell
    second = kept.get()
    assert second is not first and second.count() == 2 and not first.is_cached
    assert kept.get(force=True) is not second
    kept.close()


def test_typed_answers(spark):
    """Good, broken, repaired, partial, wrongly typed and failing answers in one run."""

    def model(prompts):
        out = []
        for p in prompts:
            if p.startswith("boom"):
                raise RuntimeError("no connection")
            again = answers.AGAIN in p
            out.append({"good": '{"title": "T", "year": 2001}', "wrapped": 'Sure: {"title": "W {x}", "year": 2} ok', "repaired": '{"title": "R", "year": 3}' if again else "{broken", "broken": "nothing", "partial": '{"title": "P"}', "typed": '{"title": "Y", "year": "many"}'}[p.split()[0]])
        return out

    rows = [(p, p + " prompt") for p in ("good", "wrapped", "repaired", "broken", "partial", "typed", "boom")]
    df = spark.createDataFrame(rows, "id string, prompt string").coalesce(1)
    got = {r.id: r for r in answers.ask(df, model, "title string, year int").collect()}
    assert len(got) == 7
    assert [(k, got[k].answer.title, got[k].answer.year, got[k].error, got[k].asked) for k in ("good", "wrapped", "repaired")] == [("good", "T", 2001, None, 1), ("wrapped", "W {x}", 2, None, 1), ("repaired", "R", 3, None, 2)]
    assert got["broken"].error == "no JSON object" and got["partial"].error == got["typed"].error == "missing or of another type: year"
    assert got["boom"].error == "RuntimeError: no connection" and got["boom"].answer is None and got["boom"].asked == 2
    assert {r.id: r.error for r in answers.ask(df.filter("id = 'partial'"), model, "title string, year int", required=["title"]).collect()} == {"partial": None}
    assert answers.ask(df.limit(0), model, "title string").count() == 0


def test_deadlines():
    at = lambda h, m=0: datetime(2024, 5, 1, h, m)
    assert nightly.deadline("08:00", at(23)) == datetime(2024, 5, 2, 8)
    assert nightly.deadline("08:00", at(3)) == at(8)
    assert nightly.deadline("08:00", at(8)) == at(18) and nightly.deadline("08:00", at(12)) == at(22)


def test_stopped_embedding_goes_on(spark, tmp_path):
    queue, out, marks = (str(tmp_path / x) for x in ("queue", "vectors", "marks"))
    chunks = spark.range(40).select(F.concat(F.lit("d"), (F.col("id") % 5).cast("string")).alias("doc_id"), F.col("id").alias("chunk_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("content"))
    nightly.enqueue(chunks, queue, files=8)

    def slow(texts):
        import time

        time.sleep(0.5)
        return np.array([[len(t), 1.0] for t in texts], float)

    start = datetime(2024, 5, 1)
    ticks = iter(range(1000))
    clock = lambda: start + timedelta(hours=next(ticks))
    assert not nightly.embed_until(spark, queue, out, slow, marks, start + timedelta(hours=6), clock=clock, poll=1.0)
    some = spark.read.schema("chunk_id long, vector array<float>").parquet(out).count()
    assert 0 <= some < 40
    nightly.enqueue(chunks.filter("chunk_id < 3").withColumn("chunk_id", F.col("chunk_id") + 100), queue)
    assert nightly.embed_until(spark, queue, out, slow, marks, datetime.max)
    rows = [r.chunk_id for r in spark.read.parquet(out).collect()]
    assert sorted(rows) == [*range(40), 100, 101, 102]
    lib = store.Library(spark, str(tmp_path / "lib"), buckets=4)
    lib.replace_chunks(spark.createDataFrame([("d1", "h"), ("d2", "h")], "doc_id string, md_hash string"), spark.createDataFrame([(1, "d1", 0, "x"), (6, "d1", 1, "y"), (2, "d2", 0, "z"), (99, "d2", 1, "-")], "chunk_id long, doc_id string, chunk_index int, content string"), F.lit("now"))
    nightly.take_in(lib, spark.read.parquet(out), "m")
    assert {r.doc_id: r.embedded for r in lib.meta.read().collect()} == {"d1": True, "d2": False}
    assert {r.chunk_id for r in lib.chunks.read().filter("embedding is not null").collect()} == {1, 2, 6}


def test_notices(spark, tmp_path):
    told = []
    hook = lambda job, counters: told.append((job, counters))
    df = spark.createDataFrame([("ok",), ("skipped",), ("skipped",)], "outcome string")
    counters = {k: F.count_if(F.col("outcome") == k) for k in ("ok", "failed", "skipped")}
    write = lambda d: d.write.format("noop").mode("overwrite").save()
    assert watch.counted(df.filter("outcome = 'skipped'"), "books", counters, write, hook) == {"ok": 0, "failed": 0, "skipped": 2} and told == []
    watch.counted(df, "books", counters, write, hook)
    assert told == [("books", {"ok": 1, "failed": 0, "skipped": 2})]
    with pytest.raises(Exception, match="unreadable"):
        watch.counted(df.withColumn("outcome", F.raise_error(F.lit("unreadable"))), "books", counters, write, hook)
    assert len(told) == 2 and "unreadable" in told[1][1]["error"]
    # A stream of two micro-batches, of which one moves no counter.
    told.clear()
    listener = watch.Notices(hook)
    spark.streams.addListener(listener)
    try:
        for k, part in enumerate((df, df.filter("outcome = 'skipped'"))):
            part.write.mode("append").parquet(str(tmp_path / "in"))
            stream = watch.observed(spark.readStream.schema("outcome string").parquet(str(tmp_path / "in")), "books", counters)
            query = stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
            query.awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    finally:
        spark.streams.removeListener(listener)
    assert told == [("books", {"ok": 1, "failed": 0, "skipped": 2})]


def test_silent_jobs_fail(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", timers.PROVIDER)
    folder = tmp_path / "in"
    folder.mkdir()
    days = [
        [("a", "BATCH_SUBMITTED", "2024-01-01 00:00:00"), ("b", "BATCH_SUBMITTED", "2024-01-01 00:00:00"), ("c", "EXPORTED", "2024-01-01 00:00:00")],
        [("b", "COMPLETED", "2024-01-01 12:00:00"), ("c", "BATCH_FAILED", "2024-01-01 13:00:00")],
        [("z", "PARSED", "2024-01-03 00:00:00")],
        [("z", "PARSED", "2024-01-03 01:00:00"), ("a", "BATCH_SUBMITTED", "2024-01-03 02:00:00")],
    ]
    try:
        got = []
        for k, rows in enumerate(days):
            (folder / f"{k}.json").write_text("".join(f'{{"id": "{i}", "new_status": "{s}", "time": "{t}"}}\n' for i, s, t in rows))
            stream = spark.readStream.schema("id string, new_status string, time timestamp").json(str(folder))
            take = lambda df, _: got.extend(tuple(r) for r in df.collect())
            timers.watched(stream).writeStream.foreachBatch(take).outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    assert ("a", "BATCH_FAILED", 2, "no result within the window") in got and ("a", "BATCH_SUBMITTED", 3, "") in got
    assert not any(i == "b" and s == "BATCH_FAILED" for i, s, _, _ in got)
    assert {s for i, s, _, _ in got if i == "c"} == {"EXPORTED"}


def test_epub_files(spark, tmp_path):
    opf = """<?xml version="1.0"?><package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata>
<dc:title> 测试书 </dc:title><dc:creator>张三</dc:creator><dc:creator>Li &amp; Co</dc:creator><dc:publisher>House</dc:publisher><dc:date>x</dc:date><dc:date>2020-01-01</dc:date>
<dc:identifier>uuid-1</dc:identifier><dc:identifier>urn:isbn:9780000000000</dc:identifier></metadata></package>"""
    container = '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf"/></rootfiles></container>'
    with zipfile.ZipFile(tmp_path / "one.epub", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("META-INF/container.xml", container)
        z.writestr("OEBPS/content.opf", opf)
    with zipfile.ZipFile(tmp_path / "No.Package.EPUB", "w") as z:
        z.writestr("META-INF/container.xml", container)
    (tmp_path / "broken.epub").write_bytes(b"PK no zip")
    (tmp_path / "other.pdf").write_bytes(b"x")
    got = {r.path.rpartition("/")[2]: tuple(r)[1:] for r in files.epubs(spark, str(tmp_path)).collect()}
    assert got == {"one.epub": ("测试书", "张三, Li & Co", "House", "2020", "9780000000000"), "No.Package.EPUB": ("No.Package", "", "", "", ""), "broken.epub": ("broken", "", "", "", "")}


def test_index_rounds(spark, tmp_path):
    """New, changed, unchanged and empty documents; a run without a model; one that fails; each logged."""
    import dataclasses

    from stackloom.config import DEFAULT
    from stackloom.operators import models
    from stackloom.plans import indexing

    lib, log = store.Library(spark, str(tmp_path / "lib"), buckets=4), str(tmp_path / "log")
    config = dataclasses.replace(DEFAULT, embedding_dim=8)
    body = lambda k, word: f"# Title {k}\n\n" + f"{word} sentence number {k} goes on for a while here. " * 60
    schema = "id string, title string, status string, markdown string"
    lib.papers.upsert(spark.createDataFrame([(f"doc{k}", f"t{k}", "EXPORTED", body(k, "first")) for k in range(6)] + [("empty", "e", "EXPORTED", "#"), ("open", "o", "PARSED", body(9, "x"))], schema))
    run = lambda model, day: indexing.index_round(lib, model, "m", F.lit(f"2024-01-0{day} 00:00:00"), log, config=config)
    assert run(None, 1)["deferred"] >= 6
    first = run(models.hashing_embedder(8), 2)
    assert first["total"] == first["indexed"] == 7 and first["chunks"] > 6 and first["failed"] == 0
    held = {r.chunk_id: r.embedding for r in lib.chunks.read().collect()}
    assert run(models.hashing_embedder(8), 3) == {"total": 0, "indexed": 0, "failed": 0, "chunks": 0, "deferred": 0}
    lib.papers.upsert(spark.createDataFrame([("doc1", "t1", "EXPORTED", body(1, "second"))], schema))

    lib.papers.upsert(spark.createDataFrame([("doc2", "t2", "EXPORTED", body(2, "other"))], schema))

    def partly(texts):
        if any("second" in t for t in texts):
            raise RuntimeError("no memory")
        return models.hashing_embedder(8)(texts)

    told = run(partly, 4)  # what fails is left for the next round, the other document is done
    assert (told["total"], told["indexed"], told["failed"]) == (2, 1, 1)
    with pytest.raises(ValueError, match="chunk_size"):
        indexing.index_round(lib, partly, "m", F.lit("2024-01-05 00:00:00"), log, config=_Broken(config))
    assert run(models.hashing_embedder(8), 6)["indexed"] == 1
    now = {r.chunk_id: r.embedding for r in lib.chunks.read().collect()}
    same = {c for c, v in now.items() if held.get(c) == v}
    assert len(now) == len(held) and 0 < len(now) - len(same) <= len(now) / 3 + 1 and all(v is not None for v in now.values())
    assert [r.status for r in indexing.outcomes(files.events(spark, log)).collect()] == ["deferred", "success", "success", "success", "failed", "success"]


class _Broken:
    """Settings that raise where the job reads how to cut a text."""

    def __init__(self, config):
        self._config = config

    def __getattr__(self, name):
        if name == "chunk_size":
            raise ValueError("no chunk_size")
        return getattr(self._config, name)


def test_known_books_and_folders(spark):
    from stackloom.operators import catalog, intake

    papers = spark.createDataFrame([("a", "EXPORTED", "/data/out/p1/images"), ("b", "PARSED", ".\\out\\p2\\images"), ("c", "EXPORTED", "/gone/p3/images/"), ("d", "EXPORTED", None)], "id string, status string, images_dir string")
    books = spark.createDataFrame([("a",), ("b",), ("x",)], "id string")
    assert {r.id: r.known for r in intake.with_known(books, papers).collect()} == {"a": True, "b": False, "x": False}
    assert {r.known for r in intake.with_known(books, papers.limit(0)).collect()} == {False}
    folders = spark.createDataFrame([("file:/data/out/p1",), ("/db/out/p2",), ("/db/p1",)], "path string")
    assert {r.id: r.folder for r in catalog.paper_folders(papers, folders, "/db/").collect()} == {"a": "/data/out/p1", "b": "/db/out/p2", "c": "", "d": ""}
