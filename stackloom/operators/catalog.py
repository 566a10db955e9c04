"""Counts, look-ups and ledgers over papers, details and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackloom import vocab
from stackloom.checkpoints import running_total
from stackloom.functions import patent
from stackloom.functions.text import first_nonempty, nonempty


def kind() -> Column:
    return F.coalesce(nonempty(F.col("doc_type")), F.lit(vocab.DEFAULT_TYPE))


def status_counts(papers: DataFrame) -> DataFrame:
    return papers.groupBy("status").agg(F.count("*").alias("n"))


def type_counts(papers: DataFrame, details: DataFrame) -> DataFrame:
    """Exported papers by type, most first."""
    rows = papers.filter("status = 'EXPORTED'").join(details.select(F.col("doc_id").alias("id"), "doc_type"), "id", "left")
    return rows.groupBy(kind().alias("doc_type")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "doc_type")


def type_table(papers: DataFrame, details: DataFrame) -> DataFrame:
    """Every known type, also those without papers, and the unknown ones that occur."""
    counts = type_counts(papers, details)
    known = vocab.doc_types(papers.sparkSession).select("doc_type", "code")
    return known.join(counts, "doc_type", "full").select("doc_type", "code", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def library_stats(papers: DataFrame, meta: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: exported, indexed, pending, chunks, embedded_chunks."""
    a = papers.agg(F.count_if(F.col("status") == "EXPORTED").alias("exported"))
    b = meta.agg(F.count_if(F.coalesce("embedded", F.lit(False))).alias("indexed"))
    c = chunks.agg(F.count("*").alias("chunks"), F.count_if(F.col("embedding").isNotNull()).alias("embedded_chunks"))
    # Three one-row tables.
    return a.join(b, F.lit(True)).join(c, F.lit(True)).select("exported", "indexed", (F.col("exported") - F.col("indexed")).alias("pending"), "chunks", "embedded_chunks")


def library_status(papers: DataFrame, details: DataFrame) -> DataFrame:
    a = details.agg(F.count("*").alias("details"))
    return a.join(papers.agg(F.max("processed_at").alias("last_processed")), F.lit(True))


def fingerprint(meta: DataFrame) -> DataFrame:
    """One row that changes when the embedded index does."""
    return meta.filter("embedded").agg(F.count("*").alias("n"), F.coalesce(F.max("indexed_at"), F.lit("")).alias("latest"))


def open_jobs(papers: DataFrame) -> DataFrame:
    return papers.filter("status = 'BATCH_SUBMITTED'").select("batch_job_id", "batch_provider").distinct()


def with_papers(details: DataFrame, papers: DataFrame) -> DataFrame:
    """Details with the file title of their paper, also without one."""
    return details.join(papers.select(F.col("id").alias("doc_id"), F.col("title").alias("file_title")), "doc_id", "left")


def display_title() -> Column:
    return first_nonempty(F.col("title_zh"), F.col("title"), F.col("file_title"))


def digest(papers: DataFrame, kept: DataFrame) -> DataFrame:
    """(n, id, title) of the kept papers; the numbers count all papers in the order of ids, so they have gaps.

    Ids are counted by range partition: each partition's rows are numbered from where the one before ends.
    """
    numbered = running_total(papers.select("id", "title").repartitionByRange("id"), F.lit(1), ["id"], "_before")
    return numbered.join(kept.select("id").distinct(), "id", "left_semi").select((F.col("_before") + 1).alias("n"), "id", "title")


def missing_folders(papers: DataFrame, folders: DataFrame) -> DataFrame:
    """Exported papers whose folder of parsed files is not among ``folders(name)``."""
    return papers.filter("status = 'EXPORTED'").select("id", "title", F.substring_index("images_dir", "/", -1).alias("name")).join(folders.select("name").distinct(), "name", "left_anti").select("id", "title")


def _ascii_lower(x: Column) -> Column:
    return F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def keyword_search(papers: DataFrame, details: DataFrame, word: str, limit: int) -> DataFrame:
    """Exported papers with the word in any of six columns, ASCII case folded; in the order of ids."""
    rows = papers.filter("status = 'EXPORTED'").select("id", F.col("title").alias("file_title"), "result_json").join(details.select(F.col("doc_id").alias("id"), "title", "authors", "doi", "keywords"), "id", "left")
    low = word.translate({c: c + 32 for c in range(65, 91)})
    hit = [F.coalesce(_ascii_lower(F.col(c)).contains(low), F.lit(False)) for c in ("file_title", "title", "authors", "doi", "keywords", "result_json")]
    found = hit[0]
    for h in hit[1:]:
        found = found | h
    return rows.filter(found).orderBy("id").limit(limit).select("id", "file_title", "title", "authors")


def resolve(details: DataFrame, papers: DataFrame, ident: str, doc_type: str | None = None) -> DataFrame:
    """Documents meant by an identifier: start of the id, patent number, squeezed document number, or part of a title."""
    tight = ident.replace(" ", "").upper()
    rows = with_papers(details, papers)
    squeezed = F.upper(F.replace(F.replace(F.coalesce("doc_no", F.lit("")), F.lit(" "), F.lit("")), F.lit("　"), F.lit("")))
    title = _ascii_lower(display_title()).contains(ident.translate({c: c + 32 for c in range(65, 91)}))
    hit = F.col("doc_id").startswith(ident) | F.coalesce(F.upper("patent_no") == tight, F.lit(False)) | (squeezed == tight) | title
    hit = hit if doc_type is None else hit & (kind() == doc_type)
    return rows.filter(hit).select("doc_id", kind().alias("doc_type"), display_title().alias("title"))


def ledger(details: DataFrame, papers: DataFrame, doc_type: str, today: Column, keyword: str | None = None) -> DataFrame:
    """Documents of one type with status, newest first; of patents also stage and term, computed as they are read."""
    if doc_type not in vocab.STATUSES:
        raise ValueError(f"no status for {doc_type}")
    when = first_nonempty(F.col("filing_date"), F.col("year"))
    number = F.col("patent_no" if doc_type == "patent" else "doc_no")
    rows = with_papers(details, papers).filter(kind() == doc_type)
    out = rows.select("doc_id", number.alias("number"), display_title().alias("title"), when.alias("dated"), F.coalesce("legal_status", F.lit("")).alias("legal_status"), F.coalesce("status_checked_at", F.lit("")).alias("status_checked_at"))
    if doc_type == "patent":
        out = out.withColumns({"stage": patent.stage(F.col("number")), "expiry": patent.expiry(F.col("number"), F.col("dated")), "expired": patent.expired(F.col("number"), F.col("dated"), today)})
    if keyword:
        out = out.filter(F.lower(F.coalesce("number", F.lit(""))).contains(keyword.lower()) | F.lower("title").contains(keyword.lower()))
    return out.orderBy(F.desc("dated"), "doc_id")


#: What a document's metadata holds beside its analysis, all as text.
_DETAILS = ["title_zh", "title_en", "doi", "keywords", "publisher", "pub_place", "edition", "patent_no", "filing_date", "legal_status", "status_checked_at", "doc_no", "url", "effective_date"]


def meta(papers: DataFrame, details: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """One row a paper: title, language, what its analysis says, and over that what its details say.

    Of the papers in ``ids(id)`` in any state; without ids, or with an empty table of them, of all exported ones.
    """
    some = ids is not None and ids.limit(1).count() > 0
    rows = papers.join(ids.select("id").distinct(), "id", "left_semi") if some else papers.filter("status = 'EXPORTED'")
    own = details.select(F.col("doc_id").alias("id"), *[F.col(c).alias(f"d_{c}") for c in details.columns if c != "doc_id"])
    have = set(details.columns)
    detail = lambda c: F.col(f"d_{c}").cast("string") if c in have else F.lit(None).cast("string")
    analysis = F.try_parse_json("result_json")
    told = lambda c: F.try_variant_get(analysis, f"$.{c}", "string")
    both = rows.join(own, "id", "left")
    return both.select(
        F.col("id").alias("doc_id"),
        F.coalesce("title", F.lit("")).alias("title"),
        first_nonempty(F.col("language"), F.lit("zh")).alias("language"),
        *[first_nonempty(detail(c), told(c)).alias(c) for c in ("authors", "journal", "year")],
        first_nonempty(told("tldr")).alias("tldr"),
        *[first_nonempty(detail(c)).alias(c) for c in _DETAILS],
        first_nonempty(detail("doc_type"), F.lit(vocab.DEFAULT_TYPE)).alias("doc_type"),
    )


def evidence_totals(evidence: DataFrame, markers: DataFrame) -> DataFrame:
    """One row: pieces of evidence, and cited documents (``markers(doc_id)``)."""
    return evidence.agg(F.count("*").alias("evidence")).join(markers.agg(F.count_distinct("doc_id").alias("documents")), F.lit(True))


def asset_files(assets: DataFrame, files: DataFrame, roots: list[str]) -> DataFrame:
    """``assets(img_path, ...)`` with ``file``: its path under the first of the ``roots`` that has it in ``files(path)``; '' if none."""
    bare = F.regexp_replace("path", "^file:/*", "/")
    under = [F.when(bare.startswith(r.rstrip("/") + "/"), F.struct(F.lit(k).alias("rank"), F.substr(bare, F.lit(len(r.rstrip("/")) + 2)).alias("img_path"))) for k, r in enumerate(roots)]
    held = files.select(bare.alias("file"), F.explode(F.array_compact(F.array(*under))).alias("u")).select("u.rank", "u.img_path", "file")
    best = held.groupBy("img_path").agg(F.min_by("file", "rank").alias("file"))
    return assets.join(best, "img_path", "left").withColumn("file", F.coalesce("file", F.lit("")))


def paper_folders(papers: DataFrame, folders: DataFrame, root: str) -> DataFrame:
    """(id, folder) of each paper: the parent of its images' folder if it is in ``folders(path)``, else that path below ``root``, else ''."""
    bare = lambda c: F.regexp_replace(F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("/")), "^file:/*", "/"), "/+$", "")
    parent = F.regexp_replace(bare(F.col("images_dir")), "/[^/]*$", "")
    there = folders.select(bare(F.col("path")).alias("folder")).distinct()
    tried = F.array(F.struct(F.lit(0).alias("rank"), parent.alias("folder")), F.struct(F.lit(1).alias("rank"), F.concat(F.lit(root.rstrip("/") + "/"), F.regexp_replace(parent, "^[./]+", "")).alias("folder")))
    named = papers.select("id", F.explode(tried).alias("t")).select("id", "t.rank", "t.folder").join(there, "folder")
    best = named.groupBy("id").agg(F.min_by("folder", "rank").alias("folder"))
    return papers.select("id").join(best, "id", "left").withColumn("folder", F.coalesce("folder", F.lit("")))
