"""The corpus pipeline: toxicity, near-duplicates, benchmark leaks, personal data, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows of ``docs``, what the stage before it kept.
All but the last return the columns of ``docs``, whatever their names; none loses a clean document.  Rows without an id
pass the stages that need one.  Null and empty texts are never rejected, repeated rows share their fate, and an empty table gives
an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stackloom.checkpoints import cut, drop, temporary
from stackloom.llm import bpe, decontaminate, neardup, privacy, toxicity
from stackloom.llm._jobs import unused
from stackloom.llm.queries import PRIVACY_KEY, table, tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose toxicity score is a half or more."""
    model = toxicity.from_labels(docs, table(spark, sf_dir, "labels"))
    column = unused("_toxicity", docs.columns)
    return toxicity.score(docs, model, column=column).filter(F.col(column) < 0.5).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near-duplicates."""
    copies = neardup.near_duplicates(docs).filter("not kept").select("doc_id").distinct()
    return docs.join(copies, "doc_id", "left_anti").select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    plain, own = _kept_aside(docs, "leaks")
    flagged = decontaminate.flag(plain, table(spark, sf_dir, "benchmark"))
    return flagged.filter(F.size("leaks") == 0).select(*own)


def _kept_aside(docs: DataFrame, name: str) -> tuple[DataFrame, list[Column]]:
    """``docs`` with a column that an operator would replace under another name, and the columns that give ``docs`` back."""
    aside = {c: unused(f"_{c}", docs.columns) for c in docs.columns if c.lower() == name}
    return docs.withColumnsRenamed(aside), [F.col(aside.get(c, c)).alias(c) for c in docs.columns]


def hide_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by surrogates and counts the characters anew."""
    plain, own = _kept_aside(docs, "n_entities")
    out = privacy.replace(plain, PRIVACY_KEY)
    return out.withColumn("n_chars", F.char_length("text").cast("long")).select(*own)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text."""
    out = bpe.encode_decode(docs.select("doc_id", "lang", "source", "text"), tokenizer_path())
    return bpe.digests(out).select("doc_id", "lang", "source", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("privacy", hide_private),
    ("tokens", tokenize),
]

#: The classifier and the keyed surrogates are beyond SQL; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; of the tables written on the way, only the one it reads stays."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        with temporary():
            out = stage(spark, docs, sf_dir)
            docs = cut(out, keep=True)
        if before is not None:
            drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
