"""The numbered queries: thin callables that apply one operator each to its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stackloom.llm import _sample, align, bpe, decontaminate, extract, lexical, neardup, pivots, privacy, quality, rlz, suffixes, toxicity, vectors

BPE_FILE = "word_bpe_49k.json"
#: The tokenizers A and B of ``op11_align``.
ALIGNED = ("byte_bpe_50k.json", "piece_bpe_32k.model")
#: Words of a shingle in ``op2_minhash``.
OP2_SHINGLE = 4
#: The key of the surrogates; a real run passes a secret one of its own.
PRIVACY_KEY = "stackloom"


def tokenizer_path(name: str = BPE_FILE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), OP2_SHINGLE)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digests(bpe.encode_decode(docs, tokenizer_path())).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.rows(decontaminate.flag(docs, table(spark, sf_dir, "benchmark")))


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = rlz.remove(docs, rlz.copies(docs))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op6_privacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return privacy.replace(table(spark, sf_dir, "documents").select("doc_id", "text"), PRIVACY_KEY)


def op7_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _classified(scored: DataFrame, folds: int, held_out: int) -> DataFrame:
    """The columns that both classifiers' queries return."""
    fold: Column = _sample.bucket(F.col("doc_id"), folds)
    return scored.select("doc_id", (fold == held_out).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return _classified(toxicity.score(docs, toxicity.from_labels(docs, table(spark, sf_dir, "labels"))), 5, 0)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return _classified(quality.score(docs, quality.from_labels(docs, table(spark, sf_dir, "labels"))), 3, 1)


def op10_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op11_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return align.align(docs, *map(tokenizer_path, ALIGNED)).drop("groups")


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op13_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors_ = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return pivots.top_k(vectors_, vectors_.filter("vec_id % 20 = 0"))


QUERIES = {
    "op1_extract": op1_extract,
    "op2_minhash": op2_minhash,
    "op3_bpe": op3_bpe,
    "op4_decontaminate": op4_decontaminate,
    "op5_substrings": op5_substrings,
    "op6_privacy": op6_privacy,
    "op7_suffixes": op7_suffixes,
    "op8_toxicity": op8_toxicity,
    "op9_quality": op9_quality,
    "op10_vectors": op10_vectors,
    "op11_align": op11_align,
    "op12_search": op12_search,
    "op13_pivots": op13_pivots,
}

ORACLE_SQL: dict[str, str] = {
    "op5_substrings": rlz.SQL,
    "op10_vectors": vectors.SQL,
    "op12_search": lexical.SQL,
    "op13_pivots": pivots.SQL,
    "op2_minhash": neardup.SQL.format(documents="documents"),
}
