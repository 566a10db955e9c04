"""State of documents and upserts: functions from old tables and new rows to new tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stackloom import vocab
from stackloom.functions.text import content_hash, nonempty

CARRIED = ["legal_status", "status_checked_at", "doc_no", "url", "effective_date"]


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``new`` rows in place of the old ones with their key."""
    return new.unionByName(old.join(new.select(key), key, "left_anti"), allowMissingColumns=True)


def keep_last(rows: DataFrame, key: str, order: Column) -> DataFrame:
    return _one(rows, key, order.desc())


def keep_first(rows: DataFrame, key: str, order: Column) -> DataFrame:
    return _one(rows, key, order.asc())


def _one(rows: DataFrame, key: str, order: Column) -> DataFrame:
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter("_rank = 1").drop("_rank")


def carry_forward(old: DataFrame, new: DataFrame, key: str = "doc_id", carried: list[str] | None = None, protect_type: bool = False) -> DataFrame:
    """Whole-row replacement in which an empty new value of a carried column keeps the old one."""
    names = [c for c in (carried or CARRIED) + (["doc_type"] if protect_type else []) if c in new.columns and c in old.columns]
    before = old.select(key, *[F.col(c).alias(f"_{c}") for c in names])
    joined = new.join(before, key, "left")
    return joined.select(*[F.coalesce(nonempty(F.col(c)), F.col(f"_{c}"), F.lit("")).alias(c) if c in names else F.col(c) for c in new.columns])


def overwrite_nonempty(old: DataFrame, new: DataFrame, key: str = "doc_id") -> DataFrame:
    """Old rows with the non-empty new values; rows that are only new are added."""
    names = [c for c in new.columns if c != key]
    after = new.select(key, *[F.col(c).alias(f"_{c}") for c in names])
    return old.join(after, key, "full").select(*[F.coalesce(nonempty(F.col(f"_{c}")), F.col(c)).alias(c) if c in names else F.col(c) for c in old.columns])


def transition(papers: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Papers after ``outcomes(id, new_status, new_error)``; a state without error clears the old one."""
    joined = papers.join(outcomes, "id", "left")
    changed = F.col("new_status").isNotNull()
    values = {"status": F.coalesce("new_status", "status"), "error_message": F.when(changed, F.col("new_error")).otherwise(F.col("error_message"))}
    return joined.select(*[values.get(c, F.col(c)).alias(c) for c in papers.columns])


def fail_jobs(papers: DataFrame, jobs: DataFrame) -> DataFrame:
    """All submitted papers of failed ``jobs(batch_job_id, error)`` fail with them."""
    hit = papers.filter("status = 'BATCH_SUBMITTED'").join(jobs, "batch_job_id").select("id", F.lit("BATCH_FAILED").alias("new_status"), F.col("error").alias("new_error"))
    return transition(papers, hit)


def reset(papers: DataFrame, doc_id: str | None = None, failed_only: bool = True) -> DataFrame:
    """Failed papers (or one paper by the start of its id) go back to PARSED without error."""
    hit = F.col("status").isin(vocab.FAILED) if failed_only else F.lit(True)
    if doc_id is not None:
        hit = hit & F.col("id").startswith(doc_id)
    hit = F.coalesce(hit, F.lit(False))
    values = {"status": F.when(hit, "PARSED").otherwise(F.col("status")), "error_message": F.when(~hit, F.col("error_message"))}
    return papers.select(*[values.get(c, F.col(c)).alias(c) for c in papers.columns])


def pick_up(papers: DataFrame, queued: DataFrame) -> DataFrame:
    """Papers to submit (again) that are not queued yet; the queue may name one twice."""
    return papers.filter(F.col("status").isin(vocab.RESUBMIT)).join(queued.select("id").distinct(), "id", "left_anti")


def results_outcomes(results: DataFrame) -> DataFrame:
    """Outcomes of parsed ``results(id, content, error)``: completed, failed in the job, or unreadable."""
    status = F.when(nonempty(F.col("error")).isNotNull(), "BATCH_FAILED").when(F.try_parse_json("content").isNotNull(), "COMPLETED").otherwise("RESULT_PARSE_FAILED")
    return results.select("id", status.alias("new_status"), F.col("error").alias("new_error"))


def exported(papers: DataFrame) -> DataFrame:
    return papers.filter((F.col("status") == "EXPORTED") & nonempty(F.col("markdown")).isNotNull())


def needs_index(papers: DataFrame, meta: DataFrame) -> DataFrame:
    """(id, md_hash) of exported papers without an index, with another text than indexed, or not wholly embedded."""
    have = meta.select(F.col("doc_id").alias("id"), F.col("md_hash").alias("_hash"), "embedded")
    now = exported(papers).select("id", content_hash(F.col("markdown")).alias("md_hash"))
    return now.join(have, "id", "left").filter(F.col("_hash").isNull() | (F.col("_hash") != F.col("md_hash")) | ~F.coalesce("embedded", F.lit(False))).select("id", "md_hash")


def needs_enrich(papers: DataFrame, details: DataFrame, head: int = 3000, force: bool = False) -> DataFrame:
    """(id, head) of exported papers without details."""
    have = details.select(F.col("doc_id").alias("id"), "enriched_at")
    rows = papers.filter("status = 'EXPORTED'").join(have, "id", "left")
    return (rows if force else rows.filter("enriched_at is null")).select("id", F.left("markdown", F.lit(head)).alias("head"))


def replace_chunks(chunks: DataFrame, new: DataFrame) -> DataFrame:
    """All chunks of the documents in ``new`` give way to the new ones."""
    return chunks.join(new.select("doc_id").distinct(), "doc_id", "left_anti").select(*new.columns).unionByName(new)


def save_embeddings(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Chunks with the new ``vectors(chunk_id, vector)``."""
    joined = chunks.join(vectors, "chunk_id", "left")
    return joined.select(*[F.coalesce("vector", "embedding").alias(c) if c == "embedding" else F.col(c) for c in chunks.columns])


def embedded(chunks: DataFrame) -> DataFrame:
    """(doc_id, n_chunks, embedded): whether all chunks of a document have vectors."""
    return chunks.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), (F.count_if(F.col("embedding").isNull()) == 0).alias("embedded"))


def set_status(details: DataFrame, idents: DataFrame, status: str, checked_at: str) -> DataFrame:
    """Status and day of verification of the documents in ``idents(doc_id)``."""
    if not status:
        raise ValueError("a status is needed")
    hit = idents.select("doc_id").distinct().withColumn("_hit", F.lit(True))
    values = {"legal_status": F.lit(status), "status_checked_at": F.lit(checked_at)}
    return details.join(hit, "doc_id", "left").select(*[F.when(F.col("_hit"), values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in details.columns])
