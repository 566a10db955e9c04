"""The index job over stored tables: only what is new or changed is cut and embedded, and its outcome is logged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackloom.checkpoints import cut, drop
from stackloom.config import DEFAULT, Config
from stackloom.operators import models, state
from stackloom.plans import jobs
from stackloom.sources import sinks
from stackloom.sources.store import Library


def index_round(library: Library, model: models.Embed | None, model_name: str, now: Column, log: str, force: bool = False, config: Config = DEFAULT) -> dict[str, int]:
    """One round; returns and logs how many documents needed it, were indexed, failed or were deferred, and the chunks embedded.

    Documents whose text is as it was indexed keep their chunks, and only those without a vector are embedded; with ``force`` all are cut
    anew.  Without a model documents are cut, and their embedding is deferred to a run that has one.  A chunk that the model fails on leaves its document
    for the next round and costs no other one; any other error is logged before it is raised.
    """
    spark = library.papers.spark
    try:
        found = _round(library, model, model_name, now, force, config)
    except Exception as e:
        _log(spark, log, now, "failed", {}, f"{type(e).__name__}: {e}")
        raise
    _log(spark, log, now, "deferred" if found["deferred"] else "success", found)
    return found


def _round(library: Library, model: models.Embed | None, model_name: str, now: Column, force: bool, config: Config) -> dict[str, int]:
    papers, meta, details = library.papers.read(), library.meta.read(), library.details.read()
    indexed = meta.limit(0) if force else meta
    todo = cut(state.needs_index(papers, indexed))
    before = indexed.select(F.col("doc_id").alias("id"), F.col("md_hash").alias("_hash"))
    changed = cut(todo.join(before, "id", "left").filter("_hash is null or _hash <> md_hash").select(F.col("id").alias("doc_id"), "md_hash"))
    own = papers.join(changed.select(F.col("doc_id").alias("id")), "id", "left_semi")
    library.replace_chunks(changed, jobs.index(own, indexed, details, config), now)
    named = todo.select(F.col("id").alias("doc_id"))
    pending = cut(library.chunks.of(named).filter("embedding is null").select("doc_id", "chunk_id", "content"))
    total, chunks = todo.count(), pending.count()
    if model is not None and total:
        vectors = pending.select("doc_id", "chunk_id").join(models.embed_each(pending, model, config), "chunk_id").select("doc_id", "chunk_id", "vector")
        # Documents without a chunk to embed are done as well.
        rest = named.join(pending.select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id", F.lit(None).cast("long").alias("chunk_id"), F.lit(None).cast("array<float>").alias("vector"))
        library.save_embeddings(vectors.unionByName(rest), model_name)
    done = library.meta.of(named).filter("embedded").count() if total else 0
    drop(todo, changed, pending)
    open_ = total - done
    return {"total": total, "indexed": done, "failed": open_ if model is not None else 0, "chunks": chunks if model is not None else 0, "deferred": open_ if model is None else 0}


def _log(spark, path: str, now: Column, status: str, counts: dict[str, int], error: str = "") -> None:  # noqa: ANN001
    row = spark.range(1).coalesce(1).select(now.cast("string").alias("ts"), F.lit("review").alias("mode"), F.lit("index_build").alias("event"), F.lit(status).alias("status"), F.lit(error).alias("error"), F.to_json(F.create_map(*[F.lit(x) for kv in counts.items() for x in kv])).alias("extra") if counts else F.lit(None).cast("string").alias("extra"))
    sinks.append_events(sinks.event_lines(row), path)


def outcomes(log: DataFrame) -> DataFrame:
    """The rounds of an event log, in the order they ran."""
    return log.filter("event = 'index_build'").orderBy("ord")
