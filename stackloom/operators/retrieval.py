"""Vector retrieval over chunk tables (chunk_id, doc_id, embedding, ...)."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from stackloom import vocab
from stackloom.checkpoints import running_total
from stackloom.config import DEFAULT, Config
from stackloom.functions.text import clamp_score


#: Questions that meet the chunks in one pass.
QUESTIONS = 512


def allowed_types(corpus: str) -> list[str] | None:
    """The document types that a corpus name stands for: none for all of them, or the type itself."""
    known = [t for t, *_ in vocab.DOC_TYPES]
    if corpus not in ("all", *known):
        raise ValueError(f"corpus must be all or one of {', '.join(known)}, not {corpus}")
    return None if corpus == "all" else [corpus]


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def scored(chunks: DataFrame, query: list[float]) -> DataFrame:
    """Chunks of the query's dimension with their score; others are passed over."""
    usable = chunks.filter(F.size("embedding") == len(query))
    return usable.withColumn("score", dot(F.col("embedding"), F.array(*map(F.lit, query))))


class _Best:
    """The best hits of one question so far: at most ``k``, and at most ``cap`` of one document; ties by chunk."""

    def __init__(self, query: np.ndarray, k: int, cap: int):
        self.query, self.k, self.cap = query, k, cap
        self.score, self.chunk, self.doc = np.empty(0), np.empty(0, np.int64), np.empty(0, object)
        self.length = float(np.linalg.norm(query))

    def least(self) -> float:
        return self.score[-1] if len(self.score) == self.k else -np.inf

    def add(self, rough: np.ndarray, x: np.ndarray, lengths: np.ndarray, chunk: np.ndarray, doc: np.ndarray) -> None:
        """Rows ``x`` with ``rough`` scores of a matrix product, which rounds by place; those that may count are scored anew, each in the same order of sums."""
        near = np.flatnonzero(rough >= self.least() - ROUNDING * lengths * self.length)
        if not len(near):
            return
        score = np.concatenate([self.score, (x[near] * self.query).sum(axis=1)])
        chunk, doc = np.concatenate([self.chunk, chunk[near]]), np.concatenate([self.doc, doc[near]])
        order = np.lexsort((chunk, -score))
        held: Counter = Counter()
        kept = []
        for at in order.tolist():
            if held[doc[at]] < self.cap:
                held[doc[at]] += 1
                kept.append(at)
                if len(kept) == self.k:
                    break
        self.score, self.chunk, self.doc = score[kept], chunk[kept], doc[kept]


#: Error of a matrix product, relative to the vectors' lengths; rows that are scored at a time.
ROUNDING, ROWS = 1e-9, 512


def nearest(chunks: DataFrame, questions: list[list[float]], k: int, cap: int) -> DataFrame:
    """(question, chunk_id, doc_id, score): for each question, by its place, hits that hold its ``k`` best with at most ``cap`` of a document.

    A task scores its chunks by a matrix product and keeps each question's best: ``k`` rows a task and question are
    merged, however many chunks there are.  That is exact: what outranks a chunk in its task under the cap also
    does so over all tasks, or is replaced by better chunks of its document.  Vectors of another dimension, and those with null or NaN
    components, are passed over.
    """
    kind = chunks.schema["doc_id"].dataType.simpleString()
    schema = f"question int, chunk_id long, doc_id {kind}, score double"
    table = np.array(questions, np.float64)
    if not table.size:
        return chunks.sparkSession.createDataFrame([], schema)
    dim = table.shape[1]
    clean = (F.size("embedding") == dim) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x))
    rows = chunks.filter(clean & F.col("chunk_id").isNotNull()).select(F.col("chunk_id").cast("long"), "doc_id", "embedding")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [_Best(q, k, cap) for q in table]
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                x = part.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
                rough, lengths = x @ table.T, np.sqrt(np.einsum("ij,ij->i", x, x))
                chunk, doc = part.column("chunk_id").to_numpy(), part.column("doc_id").to_numpy(zero_copy_only=False)
                for n, b in enumerate(best):
                    b.add(rough[:, n], x, lengths, chunk, doc)
        for n, b in enumerate(best):
            made = [np.full(len(b.chunk), n, np.int32), b.chunk, b.doc.tolist(), b.score]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(made, arrow)], schema=arrow)

    arrow = to_arrow_schema(T.StructType.fromDDL(schema))
    return rows.mapInArrow(run, schema)


def typed(hits: DataFrame, details: DataFrame, allowed: list[str]) -> DataFrame:
    """Hits of the allowed document types; without a details row a document is a paper."""
    kinds = details.select("doc_id", "doc_type").dropDuplicates(["doc_id"])
    kind = F.coalesce(F.nullif("doc_type", F.lit("")), F.lit(vocab.DEFAULT_TYPE))
    return hits.join(kinds, "doc_id", "left").withColumn("doc_type", kind).filter(F.col("doc_type").isin(allowed))


def capped(hits: DataFrame, k: int, cap: int, score: str = "score") -> DataFrame:
    """The ``k`` best hits with at most ``cap`` of one document; ties by chunk."""
    order = Window.partitionBy("doc_id").orderBy(F.desc(score), "chunk_id")
    return hits.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= cap).drop("_rank").orderBy(F.desc(score), "chunk_id").limit(k)


def search(chunks: DataFrame, query: list[float], k: int = DEFAULT.top_k, cap: int = DEFAULT.max_per_doc) -> DataFrame:
    """The ``k`` best chunks (chunk_id, doc_id, score) with at most ``cap`` of one document."""
    return capped(nearest(chunks, [query], k, cap).drop("question"), k, cap)


def gather(chunks: DataFrame, questions: DataFrame, recall: int, keep: int, cap: int = DEFAULT.max_per_doc) -> DataFrame:
    """(section, chunk_id, doc_id, score): hits of all ``questions(section, question, vector)``, best score of each chunk.

    The questions are a stated query set, taken ``QUESTIONS`` at a time, one dimension at a time; hits are cut to ``recall`` a question before
    the merge.
    """
    asked = questions.filter("vector is not null").select("section", "question", "vector").orderBy("section", "question").collect()
    kind = questions.schema["section"].dataType.simpleString()
    parts = []
    for dim in sorted({len(q.vector) for q in asked}):
        own = [q for q in asked if len(q.vector) == dim]
        for at in range(0, len(own), QUESTIONS):
            some = own[at : at + QUESTIONS]
            named = chunks.sparkSession.createDataFrame([(n, q.section) for n, q in enumerate(some)], f"question int, section {kind}")
            hits = nearest(chunks, [q.vector for q in some], recall, cap)
            per_doc = Window.partitionBy("question", "doc_id").orderBy(F.desc("score"), "chunk_id")
            per_question = Window.partitionBy("question").orderBy(F.desc("score"), "chunk_id")
            cut_ = hits.withColumn("_d", F.row_number().over(per_doc)).filter(F.col("_d") <= cap).withColumn("_q", F.row_number().over(per_question)).filter(F.col("_q") <= recall)
            parts.append(cut_.join(F.broadcast(named), "question").select("section", "chunk_id", "doc_id", "score"))
    if not parts:
        parts = [nearest(chunks, [], recall, cap).select(F.lit(None).cast(kind).alias("section"), "chunk_id", "doc_id", "score")]
    merged = reduce(DataFrame.union, parts).groupBy("section", "chunk_id", "doc_id").agg(F.max("score").alias("score"))
    return per_section(merged, keep)


def per_section(hits: DataFrame, keep: int, score: str = "score") -> DataFrame:
    order = Window.partitionBy("section").orderBy(F.desc(score), "chunk_id")
    return hits.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= keep).drop("_rank")


def evidence(judged: DataFrame, least: int = DEFAULT.min_score, keep: int = DEFAULT.evidence_n) -> DataFrame:
    """The ``keep`` best of ``judged(section, chunk_id, retrieval, score, summary)`` with a score and a summary."""
    good = judged.withColumn("score", clamp_score(F.col("score"))).filter((F.col("score") >= least) & (F.trim(F.coalesce("summary", F.lit(""))) != ""))
    order = Window.partitionBy("section").orderBy(F.desc("score"), F.desc("retrieval"), "chunk_id")
    return good.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= keep).drop("_rank")


def document_vectors(chunks: DataFrame) -> DataFrame:
    """(doc_id, vector): the mean of a document's vectors, of length one unless it is zero.

    Of vectors of several dimensions in one document, the dimension that most have counts.
    """
    usable = chunks.filter((F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull()))
    sized = usable.select("doc_id", F.size("embedding").alias("dim"), array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    means = sized.groupBy("doc_id", "dim").agg(Summarizer.mean(F.col("v")).alias("v"), F.count("*").alias("n"))
    rows = means.groupBy("doc_id").agg(F.max_by(vector_to_array("v"), F.struct("n", "dim")).alias("mean"))
    norm = F.sqrt(dot(F.col("mean"), F.col("mean")))
    return rows.select("doc_id", norm.alias("norm"), "mean").select("doc_id", F.when(F.col("norm") > 0, F.transform("mean", lambda x: x / F.col("norm"))).otherwise(F.col("mean")).alias("vector"))


def topic_prune(vectors: DataFrame, topic: list[float], most: int = 80, small: int = 10) -> DataFrame:
    """Documents close to a topic: those above the lowest three tenths, ``most`` at most; all of a small set.

    The floor is the score at its rank over all documents, which range partitions count.
    """
    told = vectors.select("doc_id", dot(F.col("vector"), F.array(*map(F.lit, topic))).alias("score"))
    order = ["score", "doc_id"]
    ranked = running_total(told.repartitionByRange(*order), F.lit(1), order, "_rank")
    n = ranked.count()
    if n <= small:
        return ranked.select("doc_id", "score")
    floor = ranked.filter(F.col("_rank") == n * 3 // 10).select(F.col("score").alias("floor"))
    return ranked.join(F.broadcast(floor), F.col("score") >= F.col("floor")).orderBy(F.desc("score"), "doc_id").limit(most).select("doc_id", "score")


def digest_lines(meta: DataFrame, kept: DataFrame, longest: int = 300) -> DataFrame:
    """(n, doc_id, line): what an outline is asked from, a line a kept document; numbers count all documents, so they have gaps."""
    rows = running_total(meta.select("doc_id", "title", "year", "tldr").repartitionByRange("doc_id"), F.lit(1), ["doc_id"], "_before").withColumn("n", F.col("_before") + 1)
    line = F.concat(F.lit("["), F.col("n").cast("string"), F.lit("] 《"), "title", F.lit("》("), F.coalesce(F.nullif("year", F.lit("")), F.lit("年份不详")), F.lit(") "), "tldr")
    return rows.join(kept.select("doc_id").distinct(), "doc_id", "left_semi").select("n", "doc_id", F.left(line, F.lit(longest)).alias("line"))


def figures(captions: DataFrame, files: DataFrame | None = None, config: Config = DEFAULT, review: str | None = None) -> DataFrame:
    """(section, img_path, caption, score): the best figures above the threshold, each path in its first section only.

    Sections choose in order.  Each takes its best figures among those no section before has placed, as many as the
    settings say; then those without a file in ``files(path)`` are left out, not replaced, and may still be
    placed by a later section.  ``captions(section, img_path, caption, score, ...)`` may hold many reviews, told by the column ``review``;
    its other columns pass through.

    Before section n at most n - 1 times the cap are placed, so no rank beyond n times the cap can be chosen: that bounds
    what a review's one fold over its ranked figures has to see by its sections, however many figures there are.
    """
    cap = config.figures_per_section
    by = [review] if review else []
    good = captions.filter((F.col("score") >= config.figure_min_score) & (F.trim("caption") != ""))
    once = Window.partitionBy(*by, "section", "img_path").orderBy(F.desc("score"), "caption")
    good = good.withColumn("_rank", F.row_number().over(once)).filter("_rank = 1")
    good = good.withColumn("_rank", F.row_number().over(Window.partitionBy(*by, "section").orderBy(F.desc("score"), "img_path")))
    # A row a section.
    order = good.select(*by, "section").distinct().withColumn("_n", F.row_number().over(Window.partitionBy(*by or [F.lit(0)]).orderBy("section")))
    near = good.join(order, [*by, "section"]).filter(F.col("_rank") <= cap * F.col("_n"))
    held = near.withColumn("_file", F.lit(True)) if files is None else near.join(files.select(F.col("path").alias("img_path"), F.lit(True).alias("_file")).distinct(), "img_path", "left")
    listed = held.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("_n", "_rank", "img_path", F.coalesce("_file", F.lit(False)).alias("file")))).alias("all"))
    state = F.expr("named_struct('n', 0, 'taken', 0, 'used', cast(array() as array<string>), 'out', cast(array() as array<struct<_n:int,img_path:string>>))")

    def step(s: Column, f: Column) -> Column:
        taken = F.when(f["_n"] == s["n"], s["taken"]).otherwise(0)
        free = ~F.array_contains(s["used"], f["img_path"]) & (taken < cap)
        placed = free & f["file"]
        used = F.when(placed, F.concat(s["used"], F.array(f["img_path"]))).otherwise(s["used"])
        out = F.when(placed, F.concat(s["out"], F.array(F.struct(f["_n"].alias("_n"), f["img_path"].alias("img_path"))))).otherwise(s["out"])
        return F.struct(f["_n"].alias("n"), F.when(free, taken + 1).otherwise(taken).alias("taken"), used.alias("used"), out.alias("out"))

    chosen = listed.select(*by, F.explode(F.aggregate("all", state, step, lambda s: s["out"])).alias("c")).select(*by, "c._n", "c.img_path")
    return near.join(chosen, [*by, "_n", "img_path"]).select(*captions.columns)


def figure_blocks(chosen: DataFrame) -> DataFrame:
    """(section, markdown, copies): the lines behind a section's text for its ``figures`` (with doc_id, asset_type), best first, and what to copy where.

    ``copies`` has (source, target) of each file; a target's name begins with the document's, so equal names of several do not meet.
    """
    name = F.concat(F.left("doc_id", F.lit(8)), F.lit("_"), F.substring_index("img_path", "/", -1))
    label = F.when(F.col("asset_type") == "table", "表").otherwise("图")
    block = F.concat(F.lit("!["), label, F.lit("](assets/"), name, F.lit(")\n*"), label, F.lit("："), "caption", F.lit("（源自 [@"), F.left("doc_id", F.lit(8)), F.lit("]）*"))
    rows = chosen.select("section", F.struct((-F.col("score")).alias("order"), "img_path", block.alias("block"), F.concat(F.lit("assets/"), name).alias("target")).alias("f"))
    # A section has as many figures as the settings say.
    told = rows.groupBy("section").agg(F.sort_array(F.collect_list("f")).alias("all"))
    copies = F.transform("all", lambda f: F.struct(f["img_path"].alias("source"), f["target"].alias("target")))
    return told.select("section", F.array_join(F.transform("all", lambda f: f["block"]), "\n\n").alias("markdown"), copies.alias("copies"))
