"""Whole jobs: search, indexing, enrichment, type rescans, batch rounds and reviews."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackloom import vocab
from stackloom.config import DEFAULT, Config
from stackloom.functions import chunking, citations, patent, standard, text
from stackloom.operators import blocks, catalog, models, retrieval, state


def search(chunks: DataFrame, papers: DataFrame, details: DataFrame, query: list[float], k: int = 10, corpus: list[str] | None = None, config: Config = DEFAULT) -> DataFrame:
    """The best chunks with their paper's title: (chunk_id, doc_id, title, section_title, score, preview)."""
    found = retrieval.search(retrieval.typed(chunks, details, corpus) if corpus else chunks, query, k, config.max_per_doc)
    best = chunks.join(F.broadcast(found.select("chunk_id", "score")), "chunk_id")  # k rows
    titled = best.join(papers.select(F.col("id").alias("doc_id"), F.col("title").alias("file_title")), "doc_id", "left").join(details.select("doc_id", "title_zh", F.col("title").alias("own_title")), "doc_id", "left")
    title = text.first_nonempty(F.col("title_zh"), F.col("own_title"), F.col("file_title"))
    return titled.select("chunk_id", "doc_id", title.alias("title"), "section_title", "score", F.left("content", F.lit(120)).alias("preview")).orderBy(F.desc("score"), "chunk_id")


def index(papers: DataFrame, meta: DataFrame, details: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Chunks of all papers that need an index, with ids from their document and place."""
    todo = state.needs_index(papers, meta)
    kinds = details.select(F.col("doc_id").alias("id"), "doc_type")
    docs = papers.join(todo.select("id"), "id", "left_semi").join(kinds, "id", "left")
    made = chunking.chunks(docs.select(F.col("id").alias("doc_id"), text.clean_markdown(F.col("markdown")).alias("markdown"), catalog.kind().alias("doc_type")), config)
    return made.withColumn("chunk_id", F.xxhash64("doc_id", "chunk_index"))


# The detected fields, and which fields of a title page and of a cover tell each.
DETECTED = {
    "title": (["title"], ["title"]),
    "patent_no": (["patent_no"], []),
    "doc_no": ([], ["doc_no"]),
    "filing_date": (["filing_date"], []),
    "effective_date": ([], ["effective"]),
    "authors": (["inventors"], []),
    "publisher": (["assignee"], ["publisher", "issuer"]),
    "year": (["filing_date"], ["year"]),
}


def detect(head: Column, names: Sequence[str] = tuple(DETECTED)) -> Column:
    """Type and named fields of a document from its first page: patent before standard; '' if neither."""
    return text.let(detected_type(head), lambda kind: _detected(head, kind, names))


def detected_type(head: Column) -> Column:
    """The type alone, which is much cheaper to tell than the fields."""
    return text.let(head.rlike(text.COVER_WORDS), lambda words: F.when(patent.cover(head, words), "patent").when(standard.cover(head, words), "standard").otherwise(""))


def _detected(head: Column, kind: Column, names: Sequence[str]) -> Column:
    needed = [list(dict.fromkeys(f for c in names for f in DETECTED[c][k])) for k in (0, 1)]
    # Only the fields of its own type are worked out.
    own = [F.when(kind == k, reader.read(head, fields)) if fields else None for k, reader, fields in zip(("patent", "standard"), (patent, standard), needed, strict=True)]

    def told(c: str, found: Column | None, k: int) -> Column:
        values = [found[f] for f in DETECTED[c][k]]
        return F.left(values[0], F.lit(4)) if (c, k) == ("year", 0) else text.first_nonempty(*values)

    def made(p: Column | None, s: Column | None) -> Column:
        fields = {c: F.when(kind == "patent", told(c, p, 0)).when(kind == "standard", told(c, s, 1)) for c in names}
        return F.struct(kind.alias("doc_type"), *[F.coalesce(f, F.lit("")).alias(c) for c, f in fields.items()])

    given = lambda value, use: use(None) if value is None else text.let(value, use)
    return given(own[0], lambda p: given(own[1], lambda s: made(p, s)))


def rescan_types(papers: DataFrame, details: DataFrame, head_chars: int = DEFAULT.head_chars) -> DataFrame:
    """(doc_id, old_type, new_type, changed): a dry run of the detectors over all exported papers."""
    now = state.exported(papers).select(F.col("id").alias("doc_id"), detected_type(F.left("markdown", F.lit(head_chars))).alias("new_type"))
    old = details.select("doc_id", "doc_type")
    rows = now.join(old, "doc_id", "left").select("doc_id", catalog.kind().alias("old_type"), "new_type")
    return rows.withColumn("changed", (F.col("new_type") != "") & (F.col("new_type") != F.col("old_type")))


def rescan_summary(rescanned: DataFrame) -> DataFrame:
    """One row of ``rescan_types``: scanned, found (of a type that a detector told), newly (of another type than before)."""
    found = F.col("new_type") != ""
    return rescanned.agg(F.count("*").alias("scanned"), F.count_if(found).alias("found"), F.count_if(found & F.col("changed")).alias("newly"))


def note_metadata(papers: DataFrame, names: Sequence[str] = tuple(c for c in DETECTED if c != "title"), keep: Sequence[str] = ()) -> DataFrame:
    """(id, title, language, doc_type, the named fields and the papers' columns ``keep``): detectors over the whole text; a paper where they find nothing."""
    own = ["id", "title", "language", *keep]
    told = papers.select(*own, detect(F.coalesce("markdown", F.lit("")), names).alias("d"))
    return told.select(*own, *[f"d.{c}" for c in names], text.first_nonempty(F.col("d.doc_type"), F.lit(vocab.DEFAULT_TYPE)).alias("doc_type"))


def process_new(files: DataFrame, known: DataFrame, parsed: DataFrame, analyses: DataFrame, config: Config = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """The single pass over a folder: (new papers, ids processed after it).

    ``files(id, path)`` that are not ``known(id)``, with their ``parsed(id, title, markdown)`` text and
    ``analyses(id, result_json)``; a text that is too short fails, one without analysis stays parsed.
    """
    fresh = files.dropDuplicates(["id"]).join(known.select("id"), "id", "left_anti")
    rows = fresh.join(parsed, "id", "left").join(analyses.dropDuplicates(["id"]), "id", "left")
    short = text.too_short(F.col("markdown"), config.min_text_chars)
    status = F.when(short, "RESULT_PARSE_FAILED").when(F.col("result_json").isNotNull(), "EXPORTED").otherwise("PARSED")
    papers = rows.select("id", "path", "title", "markdown", F.when(~short, F.col("result_json")).alias("result_json"), status.alias("status"), F.when(short, "too little text").alias("error_message"))
    done = papers.filter("status = 'EXPORTED'").select("id")
    return papers, known.select("id").union(done).distinct()


def outline_digest(papers: DataFrame, details: DataFrame, chunks: DataFrame, topic: list[float]) -> DataFrame:
    """The lines that an outline is asked from: of exported papers close to the topic; without vectors, of all."""
    meta = catalog.meta(papers, details)
    vectors = retrieval.document_vectors(chunks.join(meta.select("doc_id"), "doc_id", "left_semi"))
    near = retrieval.topic_prune(vectors, topic)
    return retrieval.digest_lines(meta, near if near.limit(1).count() else meta)


def enrich(papers: DataFrame, details: DataFrame, layout: DataFrame, today: Column, force: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New details, assets and references of the papers that need them."""
    todo = state.needs_enrich(papers, details, force=force).select(F.col("id").alias("doc_id"), "head")
    own = layout.join(todo.select("doc_id"), "doc_id", "left_semi")
    assets, references = blocks.assets(own), blocks.references(own)
    told = todo.select("doc_id", detect(F.col("head")).alias("d")).select("doc_id", "d.*")
    new = told.join(blocks.title(own).withColumnRenamed("title", "block_title"), "doc_id", "left").join(blocks.dois(own), "doc_id", "left").join(blocks.counts(assets, references), "doc_id", "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("n_figures", "n_tables", "n_refs")}
    new = new.withColumns(zero | {"title": text.first_nonempty(F.col("title"), F.col("block_title")), "doc_type": catalog.kind(), "enriched_at": today.cast("string"), "doi": F.coalesce("doi", F.lit(""))}).drop("block_title")
    return state.carry_forward(details, new), assets, references


def batch_round(papers: DataFrame, queued: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """The papers of the next batch: not queued, long enough, in the order of ids, cut to the batch limit (a feature)."""
    ready = state.pick_up(papers, queued).filter(~text.too_short(F.col("markdown"), config.min_text_chars))
    return ready.orderBy("id").limit(config.batch_limit)


def fetch(papers: DataFrame, results: DataFrame) -> DataFrame:
    """Papers after a batch's results, with the analyses stored."""
    first = state.keep_first(results.withColumn("_at", F.monotonically_increasing_id()), "id", F.col("_at")).drop("_at")
    after = state.transition(papers, state.results_outcomes(first))
    answers = first.select("id", F.col("content").alias("_content"))
    return after.join(answers, "id", "left").select(*[F.coalesce("_content", c).alias(c) if c == "result_json" else F.col(c) for c in papers.columns])


def gather_evidence(chunks: DataFrame, questions: DataFrame, reranker: models.Rerank | None, judge: models.Judge, config: Config = DEFAULT) -> DataFrame:
    """The evidence of each section: retrieval, optional reranking, judging, threshold and cut."""
    recall = config.rerank_candidates if reranker else config.top_k
    keep = config.rerank_candidates * 100 if reranker else int(config.top_k * 1.5)
    pool = retrieval.gather(chunks, questions, recall, keep, config.max_per_doc).join(chunks.select("chunk_id", "content"), "chunk_id")
    if reranker:
        scores = models.rerank(pool, questions, reranker, config)
        pool = retrieval.per_section(pool.drop("score").join(scores, ["section", "chunk_id"]), config.top_k)
    return retrieval.evidence(models.judge(pool, questions, judge, config), config.min_score, config.evidence_n)


def assemble(sections: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sections with numbered citations, and their reference lines (n, doc_id, line)."""
    numbers = citations.numbered(citations.marked(sections), docs)
    lines = numbers.join(docs, "doc_id").select("n", "doc_id", citations.reference(F.col("n"), F.col("doc_id"), F.col).alias("line"))
    return citations.renumber(sections, numbers), lines


def set_type(details: DataFrame, papers: DataFrame, ident: str, new_type: str, everything: bool = False) -> DataFrame:
    """Details with another type for what ``ident`` means; refuses several matches unless asked for."""
    if new_type not in {t for t, *_ in vocab.DOC_TYPES}:
        raise ValueError(f"unknown type {new_type}")
    hits = catalog.resolve(details, papers, ident)
    if hits.limit(2).count() > 1 and not everything:
        raise ValueError(f"{ident} means several documents")
    return state.overwrite_nonempty(details, hits.select("doc_id", F.lit(new_type).alias("doc_type")))
