"""Named queries over the driver's tables, each with the SQL that gives the same rows.

The document store is mapped onto the tables: papers are documents with a state by id, details are
labelled documents with a type by id, chunks are embeddings with their label as document.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackloom import schemas, vocab
from stackloom.checkpoints import folder
from stackloom.functions import chunking, citations, patent, standard, text
from stackloom.operators import blocks, catalog, history, intake, retrieval, state
from stackloom.plans import jobs
from stackloom.sources import files, sinks, store

TODAY = "2024-06-30"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _key(c: str):
    return F.sha2(F.col(c).cast("string").cast("binary"), 256)


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    pick = lambda items: F.element_at(F.array(*map(F.lit, items)), (F.col("doc_id") % len(items) + 1).cast("int"))
    return d.select(
        _key("doc_id").alias("id"),
        F.concat("source", F.lit("_"), F.col("doc_id").cast("string")).alias("title"),
        F.col("lang").alias("language"),
        F.col("text").alias("markdown"),
        pick(vocab.STATES).alias("status"),
        F.concat(F.lit("p"), (F.col("doc_id") % 2).cast("string")).alias("batch_provider"),
        F.concat(F.lit("job"), (F.col("doc_id") % 15).cast("string")).alias("batch_job_id"),
        F.lit(None).cast("string").alias("result_json"),
        F.when(F.col("doc_id") % 7 == 3, "request timeout").otherwise(F.lit(None)).alias("error_message"),
        F.concat(F.lit("2024-01-"), F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0")).alias("processed_at"),
        "doc_id",
    )


def details(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "labels")
    s, n = F.col("doc_id").cast("string"), F.col("doc_id")
    kinds = ["", *[t for t, *_ in vocab.DOC_TYPES if t != "paper"]]
    return d.select(
        _key("doc_id").alias("doc_id"),
        F.concat(F.lit("Title "), s).alias("title"),
        F.when(n % 5 == 0, F.concat(F.lit("题名"), s)).otherwise("").alias("title_zh"),
        F.when(n % 4 == 0, F.concat(F.lit("Smith A"), s, F.lit("; Jones B"))).otherwise(F.lit(None)).alias("authors"),
        F.when(n % 6 == 0, F.concat(F.lit("10.1000/x"), s)).otherwise(F.lit(None)).alias("doi"),
        F.concat(F.lit("word"), (n % 10).cast("string")).alias("keywords"),
        F.lit("2010").alias("year"),
        F.element_at(F.array(*map(F.lit, kinds)), (n % 8 + 1).cast("int")).alias("doc_type"),
        F.concat(F.lit("CN"), (100000000 + n).cast("string"), F.when(n % 3 == 0, "U").otherwise("B")).alias("patent_no"),
        F.date_add(F.lit("2001-02-03").cast("date"), (n % 9000).cast("int")).cast("string").alias("filing_date"),
        F.when(n % 2 == 0, "已授权").otherwise("").alias("legal_status"),
        F.when(n % 2 == 0, "2024-01-05").otherwise("").alias("status_checked_at"),
        F.concat(F.lit("GB/T "), s, F.lit("-2008")).alias("doc_no"),
        F.when(n % 3 != 0, "2024-02-01").otherwise(F.lit(None)).alias("enriched_at"),
        n.alias("n"),
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").cast("string").alias("doc_id"), "embedding")


def index_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").filter("doc_id % 2 = 0")
    changed = F.when(F.col("doc_id") % 6 == 0, "x").otherwise("")
    return d.select(_key("doc_id").alias("doc_id"), text.content_hash(F.concat("text", changed)).alias("md_hash"), (F.col("doc_id") % 4 != 2).alias("embedded"), F.concat(F.lit("2024-03-"), F.lpad((F.col("doc_id") % 30 + 1).cast("string"), 2, "0")).alias("indexed_at"))


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int = 7) -> list[float]:
    row = table(spark, sf_dir, "embeddings").filter(F.col("vec_id") == vec_id).select("embedding").first()
    return [float(x) for x in row[0]] if row else []


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as a run log."""
    e = table(spark, sf_dir, "events")
    mode = F.when(F.col("event_type") == "view", "realtime").otherwise("batch")
    kind = F.when(F.col("event_type") == "view", "paper_processed").when(F.col("event_type") == "click", "paper_parsed").when(F.col("event_type") == "purchase", "batch_submitted").when(F.col("event_type") == "error", "batch_fetched").otherwise("paper_exported")
    status = F.when(F.col("event_id") % 5 == 0, "failed").otherwise("success")
    return e.select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), mode.alias("mode"), kind.alias("event"), status.alias("status"), F.when(F.col("event_id") % 3 == 0, F.col("event_id") % 7).alias("count"), (F.col("event_id") % 4).alias("completed"), (F.col("event_id") % 2).alias("failed"), F.col("event_id").alias("ord"))


_STATES = ", ".join(f"'{s}'" for s in vocab.STATES)
_KINDS = ", ".join(f"'{t}'" for t in ["", *[t for t, *_ in vocab.DOC_TYPES if t != "paper"]])
#: The same tables in SQL.
TABLES = f"""
WITH papers AS (
  SELECT sha256(doc_id::VARCHAR) AS id, source || '_' || doc_id AS title, lang AS language, text AS markdown, ([{_STATES}])[doc_id % 7 + 1] AS status,
    'p' || (doc_id % 2) AS batch_provider, 'job' || (doc_id % 15) AS batch_job_id, CAST(NULL AS VARCHAR) AS result_json,
    CASE WHEN doc_id % 7 = 3 THEN 'request timeout' END AS error_message, '2024-01-' || lpad((doc_id % 28 + 1)::VARCHAR, 2, '0') AS processed_at, doc_id
  FROM documents
), details AS (
  SELECT sha256(doc_id::VARCHAR) AS doc_id, 'Title ' || doc_id AS title, CASE WHEN doc_id % 5 = 0 THEN '题名' || doc_id ELSE '' END AS title_zh,
    CASE WHEN doc_id % 4 = 0 THEN 'Smith A' || doc_id || '; Jones B' END AS authors, CASE WHEN doc_id % 6 = 0 THEN '10.1000/x' || doc_id END AS doi,
    'word' || (doc_id % 10) AS keywords, '2010' AS year, ([{_KINDS}])[doc_id % 8 + 1] AS doc_type,
    'CN' || (100000000 + doc_id) || CASE WHEN doc_id % 3 = 0 THEN 'U' ELSE 'B' END AS patent_no,
    strftime(DATE '2001-02-03' + (doc_id % 9000)::INTEGER, '%Y-%m-%d') AS filing_date, CASE WHEN doc_id % 2 = 0 THEN '已授权' ELSE '' END AS legal_status,
    CASE WHEN doc_id % 2 = 0 THEN '2024-01-05' ELSE '' END AS status_checked_at, 'GB/T ' || doc_id || '-2008' AS doc_no,
    CASE WHEN doc_id % 3 <> 0 THEN '2024-02-01' END AS enriched_at, doc_id AS n
  FROM labels
), chunks AS (
  SELECT vec_id AS chunk_id, label::VARCHAR AS doc_id, embedding FROM embeddings
), index_meta AS (
  SELECT sha256(doc_id::VARCHAR) AS doc_id, sha256(text || CASE WHEN doc_id % 6 = 0 THEN 'x' ELSE '' END) AS md_hash, doc_id % 4 <> 2 AS embedded,
    '2024-03-' || lpad((doc_id % 30 + 1)::VARCHAR, 2, '0') AS indexed_at
  FROM documents WHERE doc_id % 2 = 0
), log AS (
  SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, CASE WHEN event_type = 'view' THEN 'realtime' ELSE 'batch' END AS mode,
    CASE event_type WHEN 'view' THEN 'paper_processed' WHEN 'click' THEN 'paper_parsed' WHEN 'purchase' THEN 'batch_submitted' WHEN 'error' THEN 'batch_fetched' ELSE 'paper_exported' END AS event,
    CASE WHEN event_id % 5 = 0 THEN 'failed' ELSE 'success' END AS status, CASE WHEN event_id % 3 = 0 THEN event_id % 7 END AS count,
    event_id % 4 AS completed, event_id % 2 AS failed, event_id AS ord
  FROM events
)
"""
_DOT = "list_inner_product(c.embedding::DOUBLE[], q.embedding::DOUBLE[])"
_SCORED = f", q AS (SELECT embedding FROM embeddings WHERE vec_id = 7), hits AS (SELECT c.chunk_id, c.doc_id, {_DOT} AS score FROM chunks c, q)"
_CAP = "SELECT chunk_id, doc_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, chunk_id) AS r FROM {src}) WHERE r <= 4 ORDER BY score DESC, chunk_id LIMIT 24"
_KIND = "coalesce(nullif(doc_type, ''), 'paper')"
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, tables: bool = True):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = (TABLES if tables else "") + sql
        return f

    return add


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6))


@query(_SCORED + _CAP.format(src="hits"))
def vector_topk_capped(spark, sf):
    return _rounded(retrieval.search(chunks(spark, sf), query_vector(spark, sf)).select("chunk_id", "doc_id", "score"))


def _chunk_types(spark, sf):
    return chunks(spark, sf).select("doc_id").distinct().filter("cast(doc_id as int) % 3 > 0").select("doc_id", F.when(F.col("doc_id").cast("int") % 3 == 1, "book").otherwise("patent").alias("doc_type"))


@query(_SCORED + ", typed AS (SELECT * FROM hits WHERE doc_id::INTEGER % 3 <> 2)" + _CAP.format(src="typed"))
def vector_topk_typed(spark, sf):
    allowed = retrieval.typed(chunks(spark, sf), _chunk_types(spark, sf), ["paper", "book"])
    return _rounded(retrieval.search(allowed, query_vector(spark, sf)).select("chunk_id", "doc_id", "score"))


@query(_SCORED + f", best AS ({_CAP.format(src='hits')}) SELECT chunk_id, b.doc_id, coalesce(nullif(t.title_zh, ''), nullif(t.title, ''), d.source || '_' || d.doc_id, '') AS title, score FROM best b LEFT JOIN documents d ON d.doc_id::VARCHAR = b.doc_id LEFT JOIN details t ON t.n::VARCHAR = b.doc_id")
def vector_search_meta(spark, sf):
    own = papers(spark, sf).withColumn("id", F.col("doc_id").cast("string"))
    rows = chunks(spark, sf).withColumns({"section_title": F.lit(""), "content": F.lit("")})
    known = details(spark, sf).withColumn("doc_id", F.col("n").cast("string"))
    return _rounded(jobs.search(rows, own, known, query_vector(spark, sf), 24).select("chunk_id", "doc_id", "title", "score"))


@query(
    """, asked AS (SELECT vec_id % 2 AS section, vec_id AS question, embedding FROM embeddings WHERE vec_id < 6), s AS (
  SELECT section, question, chunk_id, doc_id, list_inner_product(c.embedding::DOUBLE[], a.embedding::DOUBLE[]) AS score FROM chunks c, asked a
), r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY section, question, doc_id ORDER BY score DESC, chunk_id) AS d FROM s) WHERE d <= 4),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY section, question ORDER BY score DESC, chunk_id) AS k FROM r) WHERE k <= 24),
m AS (SELECT section, chunk_id, doc_id, max(score) AS score FROM p GROUP BY ALL)
SELECT section, chunk_id, doc_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY section ORDER BY score DESC, chunk_id) AS k FROM m) WHERE k <= 36"""
)
def multi_question_gather(spark, sf):
    asked = table(spark, sf, "embeddings").filter("vec_id < 6").select((F.col("vec_id") % 2).alias("section"), F.col("vec_id").alias("question"), F.col("embedding").alias("vector"))
    return _rounded(retrieval.gather(chunks(spark, sf), asked, 24, 36))


_MEANS = """, parts AS (SELECT doc_id, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding)::DOUBLE AS x FROM chunks),
means AS (SELECT doc_id, i, avg(x) AS x FROM parts GROUP BY ALL), norms AS (SELECT doc_id, sqrt(sum(x * x)) AS norm FROM means GROUP BY ALL)"""


@query(_MEANS + " SELECT m.doc_id, round(m.x / n.norm, 6) AS first, (SELECT count(*) FROM means k WHERE k.doc_id = m.doc_id)::BIGINT AS dim FROM means m JOIN norms n ON n.doc_id = m.doc_id WHERE m.i = 1")
def doc_mean_vectors(spark, sf):
    return retrieval.document_vectors(chunks(spark, sf)).select("doc_id", F.round(F.col("vector")[0], 6).alias("first"), F.size("vector").cast("long").alias("dim"))


@query(
    """, parts AS (SELECT (chunk_id // 2)::VARCHAR AS doc_id, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding)::DOUBLE AS x FROM chunks),
means AS (SELECT doc_id, i, avg(x) AS x FROM parts GROUP BY ALL), norms AS (SELECT doc_id, sqrt(sum(x * x)) AS norm FROM means GROUP BY ALL),
topic AS (SELECT unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding)::DOUBLE AS y FROM embeddings WHERE vec_id = 7),
s AS (SELECT m.doc_id, sum(m.x / n.norm * t.y) AS score FROM means m JOIN norms n ON n.doc_id = m.doc_id JOIN topic t ON t.i = m.i GROUP BY ALL),
r AS (SELECT *, row_number() OVER (ORDER BY score, doc_id) AS k, count(*) OVER () AS n FROM s)
SELECT doc_id, round(score, 6) AS score FROM r WHERE n <= 10 OR k > n * 3 // 10 ORDER BY score DESC LIMIT 80"""
)
def topic_prune(spark, sf):
    # Documents of two chunks each: hundreds of them, so that both the floor and the cap cut.
    pairs = chunks(spark, sf).withColumn("doc_id", F.expr("cast(chunk_id div 2 as string)"))
    return _rounded(retrieval.topic_prune(retrieval.document_vectors(pairs), query_vector(spark, sf)))


@query(
    """ SELECT section, chunk_id, score FROM (SELECT *, row_number() OVER (PARTITION BY section ORDER BY score DESC, retrieval DESC, chunk_id) AS k FROM (
  SELECT vec_id % 3 AS section, vec_id AS chunk_id, greatest(1, least(10, vec_id % 13))::INTEGER AS score, round(embedding[1]::DOUBLE, 6) AS retrieval, vec_id % 5 <> 0 AS ok FROM embeddings
) WHERE score >= 6 AND ok) WHERE k <= 10""",
    tables=False,
)
def evidence_topn(spark, sf):
    v = F.col("vec_id")
    rows = table(spark, sf, "embeddings").select((v % 3).alias("section"), v.alias("chunk_id"), F.round(F.col("embedding")[0].cast("double"), 6).alias("retrieval"), (v % 13).alias("score"), F.when(v % 5 == 0, " ").otherwise("text").alias("summary"))
    return retrieval.evidence(rows).select("section", "chunk_id", "score")


@query(" SELECT status, count(*) AS n FROM papers GROUP BY status")
def status_counts(spark, sf):
    return catalog.status_counts(papers(spark, sf))


@query(f" SELECT {_KIND} AS doc_type, count(*) AS n FROM papers p LEFT JOIN details d ON d.doc_id = p.id WHERE status = 'EXPORTED' GROUP BY 1")
def type_counts(spark, sf):
    return catalog.type_counts(papers(spark, sf), details(spark, sf))


@query(f", t AS (SELECT {_KIND} AS doc_type, count(*) AS n FROM papers p LEFT JOIN details d ON d.doc_id = p.id WHERE status = 'EXPORTED' GROUP BY 1), k(doc_type, code) AS (VALUES {', '.join(f"('{t}', '{c}')" for t, c, *_ in vocab.DOC_TYPES)}) SELECT doc_type, code, coalesce(n, 0) AS n FROM k FULL JOIN t USING (doc_type)")
def type_table(spark, sf):
    return catalog.type_table(papers(spark, sf), details(spark, sf))


@query(" SELECT (SELECT count(*) FROM papers WHERE status = 'EXPORTED') AS exported, (SELECT count(*) FROM index_meta WHERE embedded) AS indexed, (SELECT count(*) FROM papers WHERE status = 'EXPORTED') - (SELECT count(*) FROM index_meta WHERE embedded) AS pending, (SELECT count(*) FROM chunks) AS chunks, (SELECT count(embedding) FROM chunks) AS embedded_chunks")
def library_stats(spark, sf):
    return catalog.library_stats(papers(spark, sf), index_meta(spark, sf), chunks(spark, sf))


@query(" SELECT (SELECT count(*) FROM details) AS details, (SELECT max(processed_at) FROM papers) AS last_processed")
def library_status(spark, sf):
    return catalog.library_status(papers(spark, sf), details(spark, sf))


@query(" SELECT count(*) AS n, coalesce(max(indexed_at), '') AS latest FROM index_meta WHERE embedded")
def index_fingerprint(spark, sf):
    return catalog.fingerprint(index_meta(spark, sf))


@query(" SELECT DISTINCT batch_job_id, batch_provider FROM papers WHERE status = 'BATCH_SUBMITTED'")
def distinct_jobs(spark, sf):
    return catalog.open_jobs(papers(spark, sf))


@query(" SELECT p.id, sha256(p.markdown) AS md_hash FROM papers p LEFT JOIN index_meta m ON m.doc_id = p.id WHERE p.status = 'EXPORTED' AND p.markdown <> '' AND (m.md_hash IS NULL OR m.md_hash <> sha256(p.markdown) OR NOT m.embedded)")
def docs_needing_index(spark, sf):
    return state.needs_index(papers(spark, sf), index_meta(spark, sf))


@query(" SELECT p.id, left(p.markdown, 3000) AS head FROM papers p LEFT JOIN details d ON d.doc_id = p.id WHERE p.status = 'EXPORTED' AND d.enriched_at IS NULL")
def docs_needing_enrich(spark, sf):
    return state.needs_enrich(papers(spark, sf), details(spark, sf))


@query(" SELECT id, status FROM papers WHERE status IN ('PARSED', 'SUBMIT_FAILED', 'BATCH_FAILED', 'RESULT_PARSE_FAILED') AND doc_id % 10 <> 1")
def resubmittable_pickup(spark, sf):
    own = papers(spark, sf)
    return state.pick_up(own, own.filter("doc_id % 10 = 1")).select("id", "status")


@query(" SELECT id, CASE WHEN doc_id % 4 = 0 THEN 'COMPLETED' WHEN doc_id % 4 = 1 THEN 'BATCH_FAILED' ELSE status END AS status, CASE WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 4 = 1 THEN 'quota' ELSE error_message END AS error_message FROM papers")
def state_transition(spark, sf):
    own = papers(spark, sf)
    outcomes = own.filter("doc_id % 4 < 2").select("id", F.when(F.col("doc_id") % 4 == 0, "COMPLETED").otherwise("BATCH_FAILED").alias("new_status"), F.when(F.col("doc_id") % 4 == 1, "quota").alias("new_error"))
    return state.transition(own, outcomes).select("id", "status", "error_message")


@query(" SELECT id, CASE WHEN status = 'BATCH_SUBMITTED' AND batch_job_id IN ('job2', 'job9') THEN 'BATCH_FAILED' ELSE status END AS status FROM papers")
def job_failure(spark, sf):
    failed = spark.createDataFrame([("job2", "expired"), ("job9", "expired")], "batch_job_id string, error string")
    return state.fail_jobs(papers(spark, sf), failed).select("id", "status")


@query(" SELECT id, CASE WHEN status IN ('SUBMIT_FAILED', 'BATCH_FAILED', 'RESULT_PARSE_FAILED') THEN 'PARSED' ELSE status END AS status, CASE WHEN status NOT IN ('SUBMIT_FAILED', 'BATCH_FAILED', 'RESULT_PARSE_FAILED') THEN error_message END AS error_message FROM papers")
def reset_failed(spark, sf):
    return state.reset(papers(spark, sf)).select("id", "status", "error_message")


@query(" SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1", tables=False)
def upsert_keep_last(spark, sf):
    rows = table(spark, sf, "orders")
    return state.keep_last(rows, "o_custkey", F.struct("o_orderdate", "o_orderkey")).select("o_custkey", "o_orderkey", "o_totalprice")


@query(" SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders) WHERE r = 1", tables=False)
def dedupe_first(spark, sf):
    rows = table(spark, sf, "orders")
    return state.keep_first(rows, "o_custkey", F.struct("o_orderdate", "o_orderkey")).select("o_custkey", "o_orderkey", "o_totalprice")


@query(" SELECT id, CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE title END AS title FROM papers")
def upsert_rows(spark, sf):
    own = papers(spark, sf).select("id", "title", "doc_id")
    new = own.filter("doc_id % 3 = 0").withColumn("title", F.lit("new"))
    return state.upsert(own, new, "id").select("id", "title")


@query(" SELECT doc_id, CASE WHEN n % 3 = 0 THEN '失效' ELSE legal_status END AS legal_status, 'again' AS title FROM details")
def carry_forward(spark, sf):
    old = details(spark, sf)
    new = old.select("doc_id", F.lit("again").alias("title"), F.when(F.col("n") % 3 == 0, "失效").otherwise("").alias("legal_status"))
    return state.carry_forward(old, new).select("doc_id", "legal_status", "title")


@query(" SELECT doc_id, CASE WHEN n % 4 = 0 THEN 'book' ELSE doc_type END AS doc_type, title FROM details")
def nonempty_overwrite(spark, sf):
    old = details(spark, sf)
    new = old.filter("n % 2 = 0").select("doc_id", F.when(F.col("n") % 4 == 0, "book").otherwise("").alias("doc_type"))
    return state.overwrite_nonempty(old, new).select("doc_id", "doc_type", "title")


@query(f", j AS (SELECT d.*, coalesce(nullif(title_zh, ''), nullif(d.title, ''), nullif(p.title, ''), '') AS shown FROM details d LEFT JOIN papers p ON p.id = d.doc_id) SELECT doc_id, {_KIND} AS doc_type, shown AS title FROM j WHERE doc_id LIKE 'title 1%' OR upper(patent_no) = 'TITLE1' OR upper(replace(replace(doc_no, ' ', ''), '　', '')) = 'TITLE1' OR contains({_LOWER.format('shown')}, 'title 1')")
def resolve_title(spark, sf):
    return catalog.resolve(details(spark, sf), papers(spark, sf), "Title 1")


@query(f", j AS (SELECT d.*, coalesce(nullif(title_zh, ''), nullif(d.title, ''), nullif(p.title, ''), '') AS shown FROM details d LEFT JOIN papers p ON p.id = d.doc_id) SELECT doc_id, {_KIND} AS doc_type, shown AS title FROM j WHERE n = (SELECT min(doc_id) FROM labels WHERE doc_id % 8 = 3)")
def resolve_number(spark, sf):
    own = details(spark, sf)
    n = own.filter(catalog.kind() == "standard").agg(F.min("n")).first()[0]
    return catalog.resolve(own, papers(spark, sf), f"gb/t{n}-2008", "standard")


_HIT = " OR ".join(f"coalesce(contains({_LOWER.format(c)}, 'src1'), false)" for c in ("p.title", "d.title", "d.authors", "d.doi", "d.keywords"))


@query(f" SELECT p.id, p.title AS file_title, d.title, d.authors FROM papers p LEFT JOIN details d ON d.doc_id = p.id WHERE status = 'EXPORTED' AND ({_HIT}) ORDER BY p.id LIMIT 20")
def keyword_search(spark, sf):
    return catalog.keyword_search(papers(spark, sf), details(spark, sf), "SRC1", 20)


@query(
    f""", j AS (SELECT d.*, coalesce(nullif(title_zh, ''), nullif(d.title, ''), nullif(p.title, ''), '') AS shown, CASE WHEN n % 3 = 0 THEN 10 ELSE 20 END AS years FROM details d LEFT JOIN papers p ON p.id = d.doc_id WHERE {_KIND} = 'patent')
SELECT doc_id, patent_no AS number, shown AS title, filing_date AS dated, legal_status, status_checked_at, CASE WHEN n % 3 = 0 THEN '实用新型已授权' ELSE '发明专利已授权' END AS stage,
  strftime(filing_date::DATE + to_years(years), '%Y-%m-%d') AS expiry, strftime(filing_date::DATE + to_years(years), '%Y-%m-%d') < '{TODAY}' AS expired FROM j"""
)
def ledger_list(spark, sf):
    return catalog.ledger(details(spark, sf), papers(spark, sf), "patent", F.lit(TODAY).cast("date"))


def _total(event: str, status: str, amount: str) -> str:
    return f"coalesce(sum(CASE WHEN event = '{event}' AND status = '{status}' THEN {amount} END), 0)::BIGINT"


@query(
    f""" SELECT left(ts, 10) AS day, {_total('paper_parsed', 'success', '1')} AS parsed_ok, {_total('paper_parsed', 'failed', '1')} AS parsed_fail, {_total('batch_submitted', 'success', 'coalesce(count, 1)')} AS submitted_ok,
  {_total('batch_submitted', 'failed', 'coalesce(count, 1)')} AS submitted_fail, {_total('batch_fetched', 'success', 'completed')} AS completed, {_total('batch_fetched', 'success', 'failed')} AS failed,
  {_total('paper_exported', 'success', '1')} AS exported, {_total('paper_processed', 'success', '1')} AS realtime_ok, {_total('paper_processed', 'failed', '1')} AS realtime_fail FROM log GROUP BY 1"""
)
def history_daily(spark, sf):
    return history.daily(events(spark, sf))


@query(" SELECT ts, event, ord FROM log WHERE status IN ('failed', 'quarantined') ORDER BY ord DESC LIMIT 5")
def recent_failures(spark, sf):
    return history.recent_failures(events(spark, sf)).select("ts", "event", "ord")


@query(" SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL", tables=False)
def tumbling_daily_events(spark, sf):
    rows = table(spark, sf, "events").groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"))
    return rows.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query(r" SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '\n{3,}', E'\n\n', 'g'), '^[\s]+', ''), '[\s]+$', '') AS cleaned FROM documents", tables=False)
def clean_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.clean_markdown(F.col("text")).alias("cleaned"))


@query(r" SELECT page_id, length(regexp_replace(regexp_replace(html, '(?i)</?(?:span|div|figure|figcaption)\b[^>]*>', '', 'g'), '\n{3,}', E'\n\n', 'g'))::INTEGER AS n FROM pages", tables=False)
def html_strip(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.length(text.strip_wrappers(F.col("html"))).alias("n"))


@query(" SELECT doc_id, CASE WHEN length(text) <= 900 THEN text ELSE left(text, 600) || E'\\n\\n[... 中间内容已省略 ...]\\n\\n' || right(text, 300) END AS body FROM documents", tables=False)
def key_sections_fallback(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.key_sections(F.col("text"), 900).alias("body"))


@query(" SELECT doc_id, sha256(text) AS hash FROM documents", tables=False)
def content_hash(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.content_hash(F.col("text")).alias("hash"))


@query(" SELECT doc_id, coalesce(length(regexp_replace(text, '[^一-鿿]', '', 'g')) / nullif(length(text), 0) > 0.2, true) AS chinese FROM documents", tables=False)
def looks_chinese(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.looks_chinese(F.col("text")).alias("chinese"))


@query(r" SELECT doc_id FROM documents WHERE length(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g')) < 200", tables=False)
def empty_gate(spark, sf):
    return table(spark, sf, "documents").filter(text.too_short(F.col("text"))).select("doc_id")


@query(" SELECT doc_id, len(regexp_extract_all(text, '[^。！？；.!?]*[。！？；.!?]|[^。！？；.!?]+$'))::BIGINT AS n FROM documents", tables=False)
def sentence_split(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(text.sentences(F.col("text"))).cast("long").alias("n"))


def _chunked(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", text.clean_markdown(F.col("text")).alias("markdown"), F.when(F.col("doc_id") % 8 == 1, "book").otherwise("paper").alias("doc_type"))
    return chunking.chunks(rows)


@query()
def chunk_documents(spark, sf):
    return _chunked(spark, sf)


@query()
def chunk_stats(spark, sf):
    return _chunked(spark, sf).groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.max("char_len").alias("longest"), F.sum("char_len").alias("chars"))


def _layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layout blocks of all documents: their text, and planted titles, pictures, tables, charts, references and DOIs, as the tables hold none."""
    n, s = F.col("doc_id"), F.col("doc_id").cast("string")
    none = F.lit(None).cast("string")
    lists = lambda *x: F.array(*x).cast("array<string>")
    held = lambda *kv: F.create_map(*kv).cast("map<string,array<string>>")

    def block(pos, kind, when=None, sub=none, text_=none, path=none, page=0, captions=None, items=None):
        fields = {"pos": F.lit(pos), "type": F.lit(kind), "sub_type": sub, "text": text_, "text_level": F.lit(1 if pos == 0 else None).cast("int"), "img_path": path, "page_idx": F.lit(page), "captions": held() if captions is None else captions, "items": F.lit(None).cast("array<string>") if items is None else items}
        made = F.struct(*[c.alias(k) for k, c in fields.items()])
        return made if when is None else F.when(when, made)

    blocks_ = F.array(
        block(0, "text", text_=F.concat(F.lit("Title "), s)),
        block(1, "text", text_=F.concat(F.coalesce("text", F.lit("")), F.when(n % 6 == 0, F.concat(F.lit(" see doi 10.1000/abc."), s, F.lit("). More"))).otherwise(""))),
        block(2, "image", n % 3 == 0, path=F.concat(F.lit("images\\f"), s, F.lit(".jpg")), page=1, captions=held(F.lit("image_caption"), lists(F.concat(F.lit("Fig. "), s), F.lit("Growth")))),
        block(3, "table", n % 4 == 1, path=F.concat(F.lit("images/t"), s, F.lit(".jpg")), page=2, captions=held(F.lit("table_caption"), lists(F.concat(F.lit("Table "), s)), F.lit("other"), lists(F.lit("x")))),
        block(4, "list", n % 5 == 2, sub=F.lit("ref_text"), page=3, items=lists(F.concat(F.lit("[1] First "), s, F.lit(".")), F.lit(" "), F.lit("[2] Second."))),
        block(5, "chart", n % 7 == 0, path=F.lit("images/c.jpg")),
        block(6, "list", n % 10 == 2, sub=F.lit("ref_text"), page=4, items=lists(F.lit("[3] Third."))),
        block(7, "image", n % 11 == 0, page=4),
    )
    return table(spark, sf_dir, "documents").select(s.alias("doc_id"), F.explode(F.array_compact(blocks_)).alias("b")).select("doc_id", "b.*")


_ASSETS = """ WITH assets AS (SELECT doc_id::VARCHAR AS doc_id, 'figure' AS asset_type, 'images/f' || doc_id || '.jpg' AS img_path, 'Fig. ' || doc_id || ' Growth' AS caption, 1 AS page_idx FROM documents WHERE doc_id % 3 = 0
  UNION ALL SELECT doc_id::VARCHAR, 'table', 'images/t' || doc_id || '.jpg', 'Table ' || doc_id, 2 FROM documents WHERE doc_id % 4 = 1
  UNION ALL SELECT doc_id::VARCHAR, 'figure', 'images/c.jpg', '', 0 FROM documents WHERE doc_id % 7 = 0),
refs AS (SELECT doc_id::VARCHAR AS doc_id, 1 AS ref_index, '[1] First ' || doc_id || '.' AS raw_text FROM documents WHERE doc_id % 5 = 2
  UNION ALL SELECT doc_id::VARCHAR, 2, '[2] Second.' FROM documents WHERE doc_id % 5 = 2 UNION ALL SELECT doc_id::VARCHAR, 3, '[3] Third.' FROM documents WHERE doc_id % 10 = 2)"""


@query(_ASSETS + " SELECT * FROM assets", tables=False)
def blocks_assets(spark, sf):
    return blocks.assets(_layout(spark, sf))


@query(_ASSETS + " SELECT * FROM refs", tables=False)
def blocks_refs(spark, sf):
    return blocks.references(_layout(spark, sf))


@query(
    _ASSETS
    + """ SELECT doc_id, coalesce(n_figures, 0)::BIGINT AS n_figures, coalesce(n_tables, 0)::BIGINT AS n_tables, coalesce(n_refs, 0)::BIGINT AS n_refs
  FROM (SELECT doc_id, count(*) FILTER (asset_type = 'figure') AS n_figures, count(*) FILTER (asset_type = 'table') AS n_tables FROM assets GROUP BY 1) FULL JOIN (SELECT doc_id, count(*) AS n_refs FROM refs GROUP BY 1) USING (doc_id)""",
    tables=False,
)
def blocks_counts(spark, sf):
    own = _layout(spark, sf)
    return blocks.counts(blocks.assets(own), blocks.references(own))


@query(
    r""" SELECT doc_id, doi FROM (SELECT doc_id::VARCHAR AS doc_id, rtrim(regexp_extract(coalesce(text, '') || CASE WHEN doc_id % 6 = 0 THEN ' see doi 10.1000/abc.' || doc_id || '). More' ELSE '' END, '10\.\d{4,9}/[^\s"<>\]]+'), '.,;:)）。，；') AS doi FROM documents) WHERE doi <> ''""",
    tables=False,
)
def doi_extract(spark, sf):
    return blocks.dois(_layout(spark, sf))


def _number(c):
    return F.col(c).cast("string")


def _paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page, head): documents behind title pages of Chinese grants (two of ten), of American patents, or none."""
    n = F.col("doc_id")
    day = F.date_format(F.date_add(F.lit("2001-02-03").cast("date"), (n % 3000).cast("int")), "yyyy .MM .dd")
    grant = F.concat(F.lit("(10)授权公告号 CN "), (n + 100000000).cast("string"), F.when(n % 10 == 3, " B").otherwise(" U"), F.lit("\n(21)申请号 201910472 305.X\n(22)申请日 "), day, F.lit("\n(73)专利权人 东方大学 地址 650599 某省\n(72)发明人 张三 李四\n(54)发明名称\n一种装置\n(57)摘要 A01B 3/02\n"))
    american = F.concat(F.lit("United States Patent\nPatent No.: US "), F.format_number(n + 10000000, 0), F.lit(" B2\n(22) Filed: Jun. 3, 2016\n(54) Device\n"))
    head = F.when(n % 10 == 3, grant).when(n % 10 == 4, grant).when(n % 10 == 6, american).when(n % 10 == 8, "A paper that cites a United States Patent once.\n").otherwise("")
    return table(spark, sf_dir, "documents").select(n.alias("page"), F.concat(head, F.coalesce("text", F.lit(""))).alias("head"))


@query(
    """ SELECT doc_id AS page, CASE WHEN doc_id % 10 = 6 THEN 'US' || (10000000 + doc_id) || 'B2' ELSE 'CN' || (100000000 + doc_id) || CASE WHEN doc_id % 10 = 3 THEN 'B' ELSE 'U' END END AS patent_no,
  CASE WHEN doc_id % 10 = 6 THEN '2016-06-03' ELSE strftime(DATE '2001-02-03' + (doc_id % 3000)::INTEGER, '%Y-%m-%d') END AS filing_date, CASE WHEN doc_id % 10 = 6 THEN '' ELSE '一种装置' END AS title,
  CASE WHEN doc_id % 10 = 6 THEN '' ELSE '张三 李四' END AS inventors, CASE WHEN doc_id % 10 = 6 THEN '' ELSE '东方大学' END AS assignee,
  CASE doc_id % 10 WHEN 6 THEN '已授权' WHEN 3 THEN '发明专利已授权' ELSE '实用新型已授权' END AS stage,
  strftime(CASE WHEN doc_id % 10 = 6 THEN DATE '2016-06-03' ELSE DATE '2001-02-03' + (doc_id % 3000)::INTEGER END + to_years(CASE WHEN doc_id % 10 = 4 THEN 10 ELSE 20 END), '%Y-%m-%d') AS expiry,
  CASE WHEN doc_id % 10 = 6 THEN 2 ELSE 7 END AS marks FROM documents WHERE doc_id % 10 IN (3, 4, 6)""",
    tables=False,
)
def patent_detect(spark, sf):
    rows = _paged(spark, sf).select("page", patent.fields(F.col("head")).alias("f")).filter("f is not null")
    return rows.select("page", "f.patent_no", "f.filing_date", "f.title", "f.inventors", "f.assignee", "f.stage", "f.expiry", "f.marks")


@query(" SELECT doc_id, patent_no, strftime(filing_date::DATE + to_years(CASE WHEN n % 3 = 0 THEN 10 ELSE 20 END), '%Y-%m-%d') AS expiry FROM details")
def patent_stage_expiry(spark, sf):
    return details(spark, sf).select("doc_id", "patent_no", patent.expiry(F.col("patent_no"), F.col("filing_date")).alias("expiry"))


def _standards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page, head): documents behind covers of national and international standards, or none."""
    n = F.col("doc_id")
    no = (n % 9000 + 1000).cast("string")
    national = F.concat(F.lit("中 华 人 民 共 和 国 国 家 标 准\n犌犅<sup>/</sup>T "), no, F.lit("—2008\n代替 GB/T "), no, F.lit("—1981\n增塑剂环氧值的测定\nDetermination of epoxy value\n2008-05-15 发布 2008-11-01 实施\n国家质量监督检验检疫总局\n"))
    international = F.concat(F.lit("INTERNATIONAL STANDARD\nICS 67.200\nISO "), no, F.lit(":2000\nFats and oils preparation of esters\n"))
    head = F.when(n % 10 == 7, national).when(n % 10 == 2, international).when(n % 10 == 5, "A paper with GB/T 1.1—2009.\n").otherwise("")
    return table(spark, sf_dir, "documents").select(n.alias("page"), F.concat(head, F.coalesce("text", F.lit(""))).alias("head"))


@query(
    """ SELECT doc_id AS page, CASE WHEN doc_id % 10 = 7 THEN 'GB/T ' || (doc_id % 9000 + 1000) || '-2008' ELSE 'ISO ' || (doc_id % 9000 + 1000) || ':2000' END AS doc_no, CASE WHEN doc_id % 10 = 7 THEN '增塑剂环氧值的测定' ELSE '' END AS title,
  CASE WHEN doc_id % 10 = 7 THEN '2008-05-15' ELSE '' END AS issued, CASE WHEN doc_id % 10 = 7 THEN '2008-11-01' ELSE '' END AS effective, CASE WHEN doc_id % 10 = 7 THEN '2008' ELSE '2000' END AS year,
  CASE WHEN doc_id % 10 = 7 THEN '国家质量监督检验检疫总局' ELSE '' END AS issuer FROM documents WHERE doc_id % 10 IN (2, 7)""",
    tables=False,
)
def standard_detect(spark, sf):
    rows = _standards(spark, sf).select("page", standard.fields(F.col("head"), ["doc_no", "title", "issued", "effective", "year", "issuer"]).alias("f")).filter("f is not null")
    return rows.select("page", "f.*")


@query(
    """ SELECT doc_id, coalesce(nullif(doc_no, ''), '编号未识别') || CASE WHEN n % 3 = 0 THEN ' | 2008-11-01 实施' ELSE '' END || ' | 状态 ' || CASE WHEN legal_status = '' THEN '未核实' ELSE legal_status || '（' || status_checked_at || ' 核实）' END AS line
  FROM (SELECT * REPLACE (CASE WHEN n % 7 = 0 THEN '' ELSE doc_no END AS doc_no) FROM details)"""
)
def standard_lines(spark, sf):
    n = F.col("n")
    line = standard.describe(F.when(n % 7 == 0, "").otherwise(F.col("doc_no")), F.when(n % 3 == 0, "2008-11-01"), F.col("legal_status"), F.col("status_checked_at"))
    return details(spark, sf).select("doc_id", line.alias("line"))


#: Covers put before some documents' texts, as the tables hold no patents and standards.
PATENT_COVER = "(10)授权公告号 CN 112856361 B\n(21)申请号 201910472305.X\n(22)申请日 2019.06.03\n(54)发明名称\n一种装置\n"
STANDARD_COVER = "中华人民共和国国家标准\nGB/T 1677-2008\n增塑剂环氧值的测定\n2008-05-15 发布 2008-11-01 实施\n"


def covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers of which a tenth begin with a patent's title page and a tenth with a standard's cover."""
    cover = F.when(F.col("doc_id") % 10 == 3, PATENT_COVER).when(F.col("doc_id") % 10 == 7, STANDARD_COVER).otherwise("")
    return papers(spark, sf_dir).withColumn("markdown", F.concat(cover, "markdown"))


_TOLD = "CASE doc_id % 10 WHEN 3 THEN 'patent' WHEN 7 THEN 'standard' ELSE '' END"
_RESCAN = f", r AS (SELECT p.id AS doc_id, {_KIND} AS old_type, {_TOLD.replace('doc_id', 'p.doc_id')} AS new_type FROM papers p LEFT JOIN details d ON d.doc_id = p.id WHERE status = 'EXPORTED' AND (p.doc_id % 10 IN (3, 7) OR markdown <> ''))"


@query(_RESCAN + " SELECT doc_id, old_type, new_type, new_type <> '' AND new_type <> old_type AS changed FROM r")
def rescan_types(spark, sf):
    return jobs.rescan_types(covered(spark, sf), details(spark, sf))


@query(_RESCAN + " SELECT count(*) AS scanned, count(*) FILTER (new_type <> '') AS found, count(*) FILTER (new_type <> '' AND new_type <> old_type) AS newly FROM r")
def rescan_summary(spark, sf):
    return jobs.rescan_summary(jobs.rescan_types(covered(spark, sf), details(spark, sf)))


@query(
    """ SELECT id, title, language, CASE doc_id % 10 WHEN 3 THEN 'patent' WHEN 7 THEN 'standard' ELSE 'paper' END AS doc_type, CASE WHEN doc_id % 10 = 3 THEN 'CN112856361B' ELSE '' END AS patent_no,
  CASE WHEN doc_id % 10 = 7 THEN 'GB/T 1677-2008' ELSE '' END AS doc_no, CASE WHEN doc_id % 10 = 3 THEN '2019-06-03' ELSE '' END AS filing_date, CASE WHEN doc_id % 10 = 7 THEN '2008-11-01' ELSE '' END AS effective_date,
  CASE doc_id % 10 WHEN 3 THEN '2019' WHEN 7 THEN '2008' ELSE '' END AS year FROM papers"""
)
def note_metadata(spark, sf):
    return jobs.note_metadata(covered(spark, sf)).select("id", "title", "language", "doc_type", "patent_no", "doc_no", "filing_date", "effective_date", "year")


def _analysed(rows: DataFrame) -> DataFrame:
    """Papers with an analysis: whole for most, broken for some, none for others."""
    whole = F.to_json(F.struct(F.concat(F.lit("Auth "), F.col("doc_id").cast("string")).alias("authors"), F.lit("J").alias("journal"), F.lit(1999).alias("year"), F.lit("short").alias("tldr")))
    return rows.withColumn("result_json", F.when(F.col("doc_id") % 3 == 0, whole).when(F.col("doc_id") % 3 == 1, "{broken"))


_META = """, meta AS (SELECT p.id AS doc_id, p.title, coalesce(nullif(p.language, ''), 'zh') AS language,
  coalesce(nullif(d.authors, ''), CASE WHEN p.doc_id % 3 = 0 THEN 'Auth ' || p.doc_id END, '') AS authors, CASE WHEN p.doc_id % 3 = 0 THEN 'J' ELSE '' END AS journal,
  coalesce(d.year, CASE WHEN p.doc_id % 3 = 0 THEN '1999' END, '') AS year, CASE WHEN p.doc_id % 3 = 0 THEN 'short' ELSE '' END AS tldr, coalesce(d.title_zh, '') AS title_zh,
  coalesce(d.doi, '') AS doi, coalesce(d.patent_no, '') AS patent_no, coalesce(nullif(d.doc_type, ''), 'paper') AS doc_type, p.status, p.doc_id AS n FROM papers p LEFT JOIN details d ON d.doc_id = p.id)"""
_META_COLUMNS = ["doc_id", "title", "language", "authors", "journal", "year", "tldr", "title_zh", "doi", "patent_no", "doc_type"]


@query(_META + f" SELECT {', '.join(_META_COLUMNS)} FROM meta WHERE status = 'EXPORTED'")
def paper_meta(spark, sf):
    return catalog.meta(_analysed(papers(spark, sf)), details(spark, sf)).select(*_META_COLUMNS)


@query(_META + f" SELECT {', '.join(_META_COLUMNS)} FROM meta WHERE n % 5 = 0")
def paper_meta_of_ids(spark, sf):
    own = _analysed(papers(spark, sf))
    return catalog.meta(own, details(spark, sf), own.filter("doc_id % 5 = 0").select("id")).select(*_META_COLUMNS)


@query(
    _META
    + """, m AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS k FROM meta WHERE status = 'EXPORTED')
SELECT k AS n, doc_id, left('[' || k || '] 《' || title || '》(' || coalesce(nullif(year, ''), '年份不详') || ') ' || tldr, 300) AS line FROM m WHERE n % 2 = 0"""
)
def outline_lines(spark, sf):
    own = _analysed(papers(spark, sf))
    return retrieval.digest_lines(catalog.meta(own, details(spark, sf)), own.filter("doc_id % 2 = 0").select(F.col("id").alias("doc_id")))


#: Reference lines of all labelled documents: eight types, both languages, with and without each part.
_PARTS = {
    "language": ("CASE WHEN n % 2 = 0 THEN 'zh' ELSE 'en' END", lambda n: F.when(n % 2 == 0, "zh").otherwise("en")),
    "file_title": ("'File ' || n || CASE WHEN n % 3 = 0 THEN '_张三丰' ELSE '' END", lambda n: F.concat(F.lit("File "), n.cast("string"), F.when(n % 3 == 0, "_张三丰").otherwise(""))),
    "title_en": ("CASE WHEN n % 7 < 3 THEN 'Title ' || n ELSE '' END", lambda n: F.when(n % 7 < 3, F.concat(F.lit("Title "), n.cast("string"))).otherwise("")),
    "names": ("CASE n % 4 WHEN 0 THEN '' WHEN 1 THEN 'Li A' WHEN 2 THEN 'Li A，Wu B; Xu C' ELSE 'Li A, Wu B, Xu C；Yu D' END", lambda n: F.when(n % 4 == 0, "").when(n % 4 == 1, "Li A").when(n % 4 == 2, "Li A，Wu B; Xu C").otherwise("Li A, Wu B, Xu C；Yu D")),
    "publisher": ("CASE WHEN n % 5 < 3 THEN 'House' ELSE '' END", lambda n: F.when(n % 5 < 3, "House").otherwise("")),
    "pub_place": ("CASE WHEN n % 11 < 6 THEN 'Town' ELSE '' END", lambda n: F.when(n % 11 < 6, "Town").otherwise("")),
    "journal": ("CASE WHEN n % 13 < 8 THEN 'Journal' ELSE '' END", lambda n: F.when(n % 13 < 8, "Journal").otherwise("")),
    "edition": ("CASE WHEN n % 17 < 9 THEN '2nd ed' ELSE '' END", lambda n: F.when(n % 17 < 9, "2nd ed").otherwise("")),
    "url": ("CASE WHEN n % 19 < 9 THEN 'http://x/' || n ELSE '' END", lambda n: F.when(n % 19 < 9, F.concat(F.lit("http://x/"), n.cast("string"))).otherwise("")),
}
_CODES = " ".join(f"WHEN '{t}' THEN '{c}'" for t, c, *_ in vocab.DOC_TYPES)


@query(
    f""", d AS (SELECT * EXCLUDE (doc_type, doi), {_KIND} AS doc_type, coalesce(doi, '') AS doi, {', '.join(f'{x} AS {c}' for c, (x, _) in _PARTS.items())} FROM details),
e AS (SELECT *, CASE WHEN language = 'zh' AND title_zh <> '' THEN title_zh WHEN language = 'en' AND title_en <> '' THEN title_en ELSE replace(file_title, '_张三丰', '') END AS best,
  CASE doc_type {_CODES} END AS code, CASE n % 4 WHEN 1 THEN 'Li A' WHEN 2 THEN 'Li A, Wu B, Xu C' WHEN 3 THEN 'Li A, Wu B, Xu C, ' || if(language = 'zh', '等', 'et al')
    ELSE CASE WHEN doc_type IN ('standard', 'web') THEN '' WHEN n % 3 = 0 THEN '张三丰, 等' WHEN language = 'zh' THEN '作者不详' ELSE 'Unknown' END END AS who,
  CASE WHEN publisher <> '' AND pub_place <> '' THEN ' Town: House, 2010.' WHEN publisher <> '' THEN ' House, 2010.' WHEN pub_place <> '' THEN ' Town, 2010.' ELSE ' 2010.' END AS printed FROM d),
f AS (SELECT *, '[' || n || '] ' || CASE WHEN who = '' THEN '' ELSE who || '. ' END || best AS lead FROM e)
SELECT doc_id, lead || CASE code WHEN 'M' THEN '[M].' || CASE WHEN edition <> '' THEN ' 2nd ed.' ELSE '' END || printed WHEN 'P' THEN ': ' || patent_no || '[P]. ' || filing_date || '.'
    WHEN 'S' THEN ': ' || doc_no || '[S].' || printed WHEN 'EB/OL' THEN '[EB/OL]. 2010.' || CASE WHEN url <> '' THEN ' ' || url || '.' ELSE '' END WHEN 'J' THEN '[J].' || CASE WHEN journal <> '' THEN ' Journal, 2010.' ELSE ' 2010.' END || CASE WHEN doi <> '' THEN ' DOI: ' || doi || '.' ELSE '' END
    ELSE '[' || code || '].' || printed END || CASE WHEN code IN ('M', 'EB/OL') THEN '' ELSE ' [[' || file_title || '_' || left(doc_id, 8) || ']]' END AS line FROM f"""
)
def reference_lines(spark, sf):
    rows = details(spark, sf).withColumns({c: f(F.col("n")) for c, (_, f) in _PARTS.items()})
    rows = rows.withColumns({"authors": F.col("names"), "title": F.col("file_title"), "doc_type": catalog.kind()})
    return rows.select("doc_id", citations.reference(F.col("n"), F.col("doc_id"), F.col).alias("line"))


def _review(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A section a document, which cites itself, another document, and two that there are not; and the cited documents."""
    own = papers(spark, sf_dir)
    mark = lambda c: F.concat(F.lit("[@"), F.left(_key(c), F.lit(8)), F.lit("]"))
    told = own.withColumn("other", F.col("doc_id") * 7 % 101)
    text_ = F.concat(F.lit("One "), mark("doc_id"), F.lit(" and "), mark("other"), F.lit(". Bad [@00000000], "), F.lit("[@zz] and "), mark("doc_id"), F.lit("."))
    sections = told.select((1000000 - F.col("doc_id")).alias("section_no"), text_.alias("markdown"))
    n = F.col("doc_id")
    kinds = {"doc_type": F.when(n % 3 == 0, "paper").when(n % 3 == 1, "book").otherwise("patent"), "title": F.concat(F.lit("File"), _number("doc_id")), "title_zh": F.lit(""), "title_en": F.when(n % 2 == 0, F.concat(F.lit("Title "), _number("doc_id"))).otherwise(""), "authors": F.when(n % 5 < 3, "Li A, Wu B, Xu C, Yu D").otherwise(""), "journal": F.lit("Journal"), "year": F.lit("2001"), "doi": F.when(n % 4 == 0, "10.1/x").otherwise("")}
    rest = {c: F.lit("") for c in ("pub_place", "publisher", "edition", "patent_no", "filing_date", "doc_no", "url")}
    docs = own.select(F.col("id").alias("doc_id"), *[c.alias(k) for k, c in (kinds | rest | {"language": F.lit("en")}).items()])
    return sections, docs


_NUMBERS = """, s AS (SELECT 1000000 - doc_id AS section_no, doc_id AS own, doc_id * 7 % 101 AS other FROM papers),
m AS (SELECT section_no, 0 AS pos, left(sha256(own::VARCHAR), 8) AS prefix FROM s UNION ALL SELECT section_no, 1, left(sha256(other::VARCHAR), 8) FROM s),
k AS (SELECT left(id, 8) AS prefix, max(id) AS id FROM papers GROUP BY 1), f AS (SELECT k.id, k.prefix, min(section_no * 10 + pos) AS spot FROM m JOIN k USING (prefix) GROUP BY ALL),
numbers AS (SELECT id, prefix, row_number() OVER (ORDER BY spot) AS n FROM f)"""


@query(_NUMBERS + " SELECT id AS doc_id, n FROM numbers")
def citation_numbering(spark, sf):
    sections, docs = _review(spark, sf)
    return citations.numbered(citations.marked(sections), docs).select("doc_id", "n")


@query(
    _NUMBERS
    + """ SELECT section_no, 'One ' || coalesce('[' || a.n || ']', '') || ' and ' || coalesce('[' || b.n || ']', '') || '. Bad , [@zz] and ' || coalesce('[' || a.n || ']', '') || '.' AS markdown
  FROM s LEFT JOIN numbers a ON a.prefix = left(sha256(own::VARCHAR), 8) LEFT JOIN numbers b ON b.prefix = left(sha256(other::VARCHAR), 8)"""
)
def citation_filter(spark, sf):
    return jobs.assemble(*_review(spark, sf))[0]


@query(
    _NUMBERS
    + """, c AS (SELECT u.n, p.id, p.doc_id AS d FROM numbers u JOIN papers p ON p.id = u.id),
l AS (SELECT n, id, d, '[' || n || '] ' || CASE WHEN d % 5 < 3 THEN 'Li A, Wu B, Xu C, et al' ELSE 'Unknown' END || '. ' || CASE WHEN d % 2 = 0 THEN 'Title ' || d ELSE 'File' || d END AS lead, ' [[File' || d || '_' || left(id, 8) || ']]' AS link FROM c)
SELECT lead || CASE d % 3 WHEN 0 THEN '[J]. Journal, 2001.' || CASE WHEN d % 4 = 0 THEN ' DOI: 10.1/x.' ELSE '' END || link WHEN 1 THEN '[M]. 2001.' ELSE '[P]. 2001.' || link END AS line FROM l"""
)
def format_reference(spark, sf):
    return jobs.assemble(*_review(spark, sf))[1].select("line")


def _books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as book files of five folders."""
    n = F.col("doc_id")
    verdict = F.when(n % 13 == 5, "corrupt").when(n % 17 == 3, "transient").otherwise("ok")
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("day"), (n % 5).cast("string")).alias("batch"), F.lpad(n.cast("string"), 9, "0").alias("name"), (n % 10 == 1).alias("known"), (n % 10 == 2).alias("epub"), verdict.alias("verdict"), (n * 37 % 90).alias("pages"))


@query(
    """ WITH RECURSIVE books AS (SELECT 'day' || doc_id % 5 AS batch, lpad(doc_id::VARCHAR, 9, '0') AS name, doc_id % 10 = 1 AS known, doc_id % 10 = 2 AS epub, doc_id * 37 % 90 AS pages,
  CASE WHEN doc_id % 13 = 5 THEN 'corrupt' WHEN doc_id % 17 = 3 THEN 'transient' ELSE 'ok' END AS verdict FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY name) AS k, CASE WHEN known THEN 'skipped' WHEN epub THEN 'ok' WHEN verdict = 'corrupt' THEN 'quarantined' WHEN verdict = 'transient' THEN 'failed' END AS settled FROM books),
steps AS (SELECT batch, ''::VARCHAR AS name, 0::BIGINT AS k, ''::VARCHAR AS outcome, 0::BIGINT AS pages, 0::BIGINT AS used FROM (SELECT DISTINCT batch FROM placed)
  UNION ALL SELECT p.batch, p.name, p.k, coalesce(p.settled, CASE WHEN s.used > 0 AND p.pages > 1000 - s.used THEN 'deferred' ELSE 'ok' END),
    CASE WHEN p.settled IS NULL AND NOT (s.used > 0 AND p.pages > 1000 - s.used) THEN p.pages ELSE 0 END, s.used + CASE WHEN p.settled IS NULL AND NOT (s.used > 0 AND p.pages > 1000 - s.used) THEN p.pages ELSE 0 END
  FROM steps s JOIN placed p ON p.batch = s.batch AND p.k = s.k + 1)
SELECT batch, name, outcome, pages FROM steps WHERE k > 0""",
    tables=False,
)
def intake_budget(spark, sf):
    return intake.decide(_books(spark, sf), 1000)


_NOTE_SQL = sinks.NOTE.replace("'", "''")
for _name, _value in {
    "doc_type": "doc_type", "language": "coalesce(nullif(language, ''), 'en')", "date": f"'{TODAY}'", "title": "title", "label": "CASE doc_type WHEN 'patent' THEN '专利' WHEN 'standard' THEN '标准' ELSE '期刊论文' END",
    "authors": "CASE WHEN d % 3 = 0 THEN 'Auth ' || d ELSE '未提取' END", "year": f"CASE WHEN d % 3 = 0 THEN '1999' ELSE '{TODAY[:4]}' END", "journal": "CASE WHEN d % 3 = 0 THEN 'J' ELSE '未提取' END",
    "source": "CASE doc_type WHEN 'patent' THEN 'CN112856361B' WHEN 'standard' THEN 'GB/T 1677-2008' ELSE CASE WHEN d % 3 = 0 THEN 'J' ELSE '未提取' END END", "source_label": "CASE doc_type WHEN 'patent' THEN '专利号' WHEN 'standard' THEN '标准号' ELSE '期刊/会议' END",
    "tldr": "CASE WHEN d % 3 = 0 THEN 'short' ELSE '' END", "abstract": "''", "background": "''", "methods": "''", "results": "''", "conclusion": "''",
    "images": "CASE d % 4 WHEN 1 THEN '![图表](attachments/' || id || '/a' || d || '.png)' || chr(10) || '![图表](attachments/' || id || '/b.png)' WHEN 2 THEN '![图表](attachments/' || id || '/b.png)' ELSE '*暂无提取的图表*' END",
}.items():
    _NOTE_SQL = _NOTE_SQL.replace(f"{{{_name}}}", f"' || {_value} || '")


@query(f" SELECT id, title || '_' || left(id, 8) || '.md' AS file_name, '{_NOTE_SQL}' AS content FROM (SELECT *, doc_id AS d, CASE doc_id % 10 WHEN 3 THEN 'patent' WHEN 7 THEN 'standard' ELSE 'paper' END AS doc_type FROM papers)")
def note_files(spark, sf):
    """Notes of all papers with what their covers and analyses say, and with planted images, some of which have no file."""
    own = _analysed(covered(spark, sf))
    whole = jobs.note_metadata(own, ["patent_no", "doc_no"], ["result_json"])
    n = F.col("doc_id")
    names = F.array(F.struct(F.lit(1).alias("pos"), F.concat(F.lit("out\\a"), _number("doc_id"), F.lit(".png")).alias("path")), F.struct(F.lit(2).alias("pos"), F.lit("out/b.png").alias("path")))
    images = own.filter(n % 4 > 0).filter(n % 4 < 3).select("id", n, F.explode(names).alias("i")).select("id", "doc_id", "i.*")
    there = images.filter("pos = 2 or doc_id % 4 = 1").select("path")
    return sinks.notes(whole, F.lit(TODAY), images.drop("doc_id"), there).select("id", "file_name", "content")


#: Buckets of the stores that queries write.
BUCKETS = 16


def _stored(spark: SparkSession, sf_dir: str) -> tuple[store.Store, list[int]]:
    """A store of all papers after an upsert of a few, some of them new; and the buckets it wrote anew."""
    own = papers(spark, sf_dir)
    made = store.Store(spark, f"{folder(spark)}/{uuid.uuid4().hex}", schemas.PAPERS, "id", BUCKETS)
    made.upsert(schemas.conform(own.filter("doc_id % 300 <> 7"), schemas.PAPERS))
    few = own.filter("doc_id % 150 = 7").withColumns({"status": F.lit("EXPORTED"), "title": F.lit("again")})
    return made, made.upsert(schemas.conform(few, schemas.PAPERS))


@query(" SELECT id, CASE WHEN doc_id % 150 = 7 THEN 'again' ELSE title END AS title, CASE WHEN doc_id % 150 = 7 THEN 'EXPORTED' ELSE status END AS status, markdown FROM papers WHERE doc_id % 300 <> 7 OR doc_id % 150 = 7")
def store_upsert(spark, sf):
    return _stored(spark, sf)[0].read().select("id", "title", "status", "markdown")


@query(f" SELECT b AS bucket, count(*) AS n, bool_or(again) AS rewritten FROM (SELECT (('0x' || left(md5(id), 8))::BIGINT % {BUCKETS})::INTEGER AS b, doc_id % 150 = 7 AS again FROM papers) GROUP BY 1")
def store_buckets(spark, sf):
    made, touched = _stored(spark, sf)
    rows = made.read().groupBy(store.bucket(F.col("id"), BUCKETS).alias("bucket")).agg(F.count("*").alias("n"))
    return rows.withColumn("rewritten", F.col("bucket").isin(touched))


@query(" SELECT event, status, event_id, n FROM (SELECT *, row_number() OVER (ORDER BY (event_id * 5 + 3) % 4, event_id) AS n FROM (SELECT event_id, event_type AS event, CASE WHEN event_id % 5 = 0 THEN 'failed' ELSE 'success' END AS status FROM events)) WHERE status = 'failed'", tables=False)
def log_failures(spark, sf):
    """Events appended in four writes, each of several files and in another order than of ids, and numbered as the log has them."""
    e = table(spark, sf, "events")
    rows = e.select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), F.lit("batch").alias("mode"), F.col("event_type").alias("event"), F.when(F.col("event_id") % 5 == 0, "failed").otherwise("success").alias("status"), F.to_json(F.struct(F.col("event_id").alias("count"))).alias("extra"))
    path = f"{folder(spark)}/{uuid.uuid4().hex}"
    for k in range(4):
        own = rows.filter((F.col("event_id") * 5 + 3) % 4 == k)
        sinks.append_events(sinks.event_lines(own.repartitionByRange(3, "event_id").sortWithinPartitions("event_id")), path)
    return files.numbered(files.events(spark, path)).filter("status = 'failed'").select("event", "status", F.col("count").alias("event_id"), "n")


@query(
    """ WITH RECURSIVE c AS (SELECT doc_id % 50 AS section, 'img/' || (doc_id * 13 % 200) AS img_path, (doc_id * 37 % 1000) / 1000.0::DOUBLE AS score, CASE WHEN doc_id % 9 = 0 THEN ' ' ELSE 'caption' END AS caption FROM documents),
g AS (SELECT section, img_path, max(score) AS score FROM c WHERE score >= 0.2 AND trim(caption) <> '' GROUP BY ALL),
l AS (SELECT section, row_number() OVER (ORDER BY section) AS k, list(img_path ORDER BY score DESC, img_path) AS paths FROM g GROUP BY section),
r AS (SELECT 0::BIGINT AS k, 0::BIGINT AS section, []::VARCHAR[] AS used, []::VARCHAR[] AS placed
  UNION ALL SELECT l.k, l.section, list_concat(r.used, list_filter(list_filter(l.paths, lambda p: NOT list_contains(r.used, p))[1:2], lambda p: substr(p, 5)::INTEGER % 3 <> 0)),
    list_filter(list_filter(l.paths, lambda p: NOT list_contains(r.used, p))[1:2], lambda p: substr(p, 5)::INTEGER % 3 <> 0) FROM r JOIN l ON l.k = r.k + 1),
o AS (SELECT section, unnest(placed) AS img_path FROM r WHERE k > 0)
SELECT o.section, o.img_path, g.score FROM o JOIN g ON g.section = o.section AND g.img_path = o.img_path""",
    tables=False,
)
def figures_choice(spark, sf):
    """Figures of fifty sections; a third of the files is missing."""
    n = F.col("doc_id")
    rows = table(spark, sf, "documents").select((n % 50).alias("section"), F.concat(F.lit("img/"), (n * 13 % 200).cast("string")).alias("img_path"), F.when(n % 9 == 0, " ").otherwise("caption").alias("caption"), ((n * 37 % 1000) / F.lit(1000.0)).alias("score"))
    have = rows.filter("cast(substr(img_path, 5) as int) % 3 <> 0").select(F.col("img_path").alias("path")).distinct()
    return retrieval.figures(rows, have).select("section", "img_path", "score")


@query(" SELECT p_partkey AS doc_id, k + 1 AS part, k * 10 AS first_page, least(k * 10 + 10, p_size) - 1 AS last_page FROM (SELECT p_partkey, p_size, unnest(range(0, (p_size + 9) // 10))::INTEGER AS k FROM part)", tables=False)
def page_ranges(spark, sf):
    books = table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_size").cast("int").alias("n_pages"))
    return blocks.page_ranges(books, 10)


@query(" SELECT id FROM papers WHERE status IN ('PARSED', 'SUBMIT_FAILED', 'BATCH_FAILED', 'RESULT_PARSE_FAILED') AND length(trim(markdown, E' \\n\\t')) >= 200 ORDER BY id LIMIT 30")
def batch_round(spark, sf):
    own = papers(spark, sf)
    return jobs.batch_round(own, own.limit(0)).select("id")


@query(" SELECT n, id, title FROM (SELECT row_number() OVER (ORDER BY id) AS n, id, title, doc_id FROM papers) WHERE doc_id % 3 = 0")
def digest_numbers(spark, sf):
    own = papers(spark, sf)
    return catalog.digest(own, own.filter("doc_id % 3 = 0"))


@query(" SELECT id, title FROM papers WHERE status = 'EXPORTED' AND doc_id % 4 <> 0")
def missing_folders(spark, sf):
    own = papers(spark, sf).withColumn("images_dir", F.concat(F.lit("/data/"), F.col("doc_id").cast("string")))
    return catalog.missing_folders(own, own.filter("doc_id % 4 = 0").select(F.col("doc_id").cast("string").alias("name")))


@query(
    """ SELECT o_orderkey, n_lines, last_ship FROM (SELECT l_orderkey AS o_orderkey, count(*) AS n_lines, strftime(max(l_shipdate), '%Y-%m-%d') AS last_ship FROM lineitem GROUP BY 1)""",
    tables=False,
)
def lines_per_order(spark, sf):
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n_lines"), F.max("l_shipdate").alias("last"))
    return rows.select("o_orderkey", "n_lines", F.date_format("last", "yyyy-MM-dd").alias("last_ship"))


@query(" SELECT c_custkey, count(o_orderkey) AS n, coalesce(round(sum(o_totalprice), 2), 0) AS total FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey", tables=False)
def orders_per_customer(spark, sf):
    per = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("o_orderkey").alias("n"), F.sum("o_totalprice").alias("total"))
    rows = table(spark, sf, "customer").join(per, F.col("c_custkey") == F.col("o_custkey"), "left")
    return rows.select("c_custkey", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce(F.round("total", 2), F.lit(0.0)).alias("total"))
