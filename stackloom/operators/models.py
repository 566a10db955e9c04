"""Models as batch functions that the caller passes in; no network code of its own.

An embedder maps texts to vectors, a reranker a query and texts to scores, a judge a question and
texts to (score, summary).  They run on Arrow batches inside tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackloom.config import DEFAULT, Config

Embed = Callable[[list[str]], np.ndarray]
Rerank = Callable[[str, list[str]], list[float]]
Judge = Callable[[str, list[str]], list[tuple[int, str]]]


def hashing_embedder(dim: int = 64) -> Embed:
    """A stand-in that needs no model: words hashed to signed places."""

    def embed(texts: list[str]) -> np.ndarray:
        import zlib

        out = np.zeros((len(texts), dim))
        for k, text in enumerate(texts):
            for word in text.lower().split():
                h = zlib.crc32(word.encode())
                out[k, h % dim] += 1 if h >> 31 else -1
        return out

    return embed


def query_text(question: str, instruction: str = "") -> str:
    """What is embedded for a question: with an instruction before it, as documents never have."""
    return f"Instruct: {instruction}\nQuery: {question}" if instruction else question


def _vectors(model: Embed, texts: list[str], dim: int) -> np.ndarray:
    """Vectors of length one, cut to ``dim`` numbers."""
    x = np.asarray(model(texts), float)[:, :dim]
    if len(x) != len(texts):
        raise ValueError("the embedder returned another number of vectors than texts")
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return (x / np.where(norm > 0, norm, 1)).astype(np.float32)


def embed(chunks: DataFrame, model: Embed, config: Config = DEFAULT) -> DataFrame:
    """(chunk_id, vector): vectors of length one, cut to ``embedding_dim`` where the model gives more."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), config.embedding_batch):
                part = batch.iloc[at : at + config.embedding_batch]
                x = _vectors(model, [t[: config.embed_chars] for t in part["content"].fillna("")], config.embedding_dim)
                yield pd.DataFrame({"chunk_id": part["chunk_id"].values, "vector": list(x)})

    return chunks.select(F.col("chunk_id").cast("long"), "content").mapInPandas(run, "chunk_id long, vector array<float>")


def embed_each(chunks: DataFrame, model: Embed, config: Config = DEFAULT) -> DataFrame:
    """(chunk_id, vector, error): as ``embed``, but a failing batch is embedded text by text, and a text that fails has no vector and says why."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), config.embedding_batch):
                part = batch.iloc[at : at + config.embedding_batch]
                texts = [t[: config.embed_chars] for t in part["content"].fillna("")]
                try:
                    made = [(v, None) for v in _vectors(model, texts, config.embedding_dim)]
                except Exception:  # noqa: BLE001 (a failing batch must not end the run)
                    made = [_one_vector(model, t, config.embedding_dim) for t in texts]
                yield pd.DataFrame({"chunk_id": part["chunk_id"].values, "vector": [v for v, _ in made], "error": [e for _, e in made]})

    return chunks.select(F.col("chunk_id").cast("long"), "content").mapInPandas(run, "chunk_id long, vector array<float>, error string")


def _one_vector(model: Embed, text: str, dim: int) -> tuple[np.ndarray | None, str | None]:
    try:
        return _vectors(model, [text], dim)[0], None
    except Exception as e:  # noqa: BLE001
        return None, f"{type(e).__name__}: {e}"


def rerank(pool: DataFrame, questions: DataFrame, model: Rerank, config: Config = DEFAULT) -> DataFrame:
    """(section, chunk_id, score): the best score of each pooled chunk over its section's questions.

    Where the model fails, the section's chunks keep their order with score 0.
    """
    asked = questions.groupBy("section").agg(F.sort_array(F.collect_set("question")).alias("questions"))
    rows = pool.join(asked, "section").select("section", "chunk_id", "content", "questions")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for section, part in batch.groupby("section"):
                texts = [t[: config.rerank_chars] for t in part["content"].fillna("")]
                try:
                    scores = np.max([model(q, texts) for q in part["questions"].iloc[0]], axis=0)
                except Exception:  # noqa: BLE001 (a failing model must not end the run)
                    scores = np.zeros(len(part))
                yield pd.DataFrame({"section": section, "chunk_id": part["chunk_id"].values, "score": np.asarray(scores, float)})

    kind = pool.schema["section"].dataType.simpleString()
    return rows.mapInPandas(run, f"section {kind}, chunk_id long, score double")


def judge(pool: DataFrame, questions: DataFrame, model: Judge, config: Config = DEFAULT) -> DataFrame:
    """(section, chunk_id, retrieval, score, summary) by a model; a failed chunk has score 0 and no summary."""
    asked = questions.groupBy("section").agg(F.array_join(F.sort_array(F.collect_set("question")), "\n").alias("ask"))
    rows = pool.join(asked, "section").select("section", "chunk_id", F.col("score").alias("retrieval"), "content", "ask")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for ask, text in zip(batch["ask"], batch["content"].fillna("")):
                try:
                    out.append(model(ask, [text[: config.rerank_chars]])[0])
                except Exception:  # noqa: BLE001 (one failure must not end the run)
                    out.append((0, ""))
            yield batch[["section", "chunk_id", "retrieval"]].assign(score=[int(s) for s, _ in out], summary=[t for _, t in out])

    kind = pool.schema["section"].dataType.simpleString()
    return rows.mapInPandas(run, f"section {kind}, chunk_id long, retrieval double, score int, summary string")


def fill_empty(details: DataFrame, answers: DataFrame, always: tuple[str, ...] = ("title_zh", "title_en", "keywords"), key: str = "doc_id") -> DataFrame:
    """Details with a model's ``answers`` in empty fields, and in some fields always."""
    names = [c for c in answers.columns if c != key]
    joined = details.join(answers.select(key, *[F.col(c).alias(f"_{c}") for c in names]), key, "left")
    have = lambda c: F.nullif(F.col(c), F.lit(""))
    pick = lambda c: F.coalesce(have(f"_{c}"), F.col(c)) if c in always else F.coalesce(have(c), F.col(f"_{c}"))
    return joined.select(*[pick(c).alias(c) if c in names else F.col(c) for c in details.columns])
