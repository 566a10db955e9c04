"""Table schemas, and how older or empty tables are brought to them."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _schema(ddl: str) -> T.StructType:
    kinds = {"string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "boolean": T.BooleanType(), "vector": T.ArrayType(T.FloatType()), "double": T.DoubleType()}
    fields = []
    for part in ddl.split(","):
        name, _, kind = part.strip().partition(" ")
        fields.append(T.StructField(name, kinds[kind or "string"]))
    return T.StructType(fields)


PAPERS = _schema("id, title, pdf_path, language, markdown, images_dir, status, batch_provider, batch_job_id, result_json, error_message, processed_at")
CHUNKS = _schema("chunk_id long, doc_id, chunk_index int, section_title, content, char_len int, embedding vector, embedding_model")
INDEX_META = _schema("doc_id, md_hash, n_chunks int, embedded boolean, indexed_at")
DETAILS = _schema(
    "doc_id, title, title_zh, title_en, doi, authors, journal, year, keywords, n_figures int, n_tables int, n_refs int, enriched_at, source,"
    "doc_type, publisher, pub_place, edition, isbn, patent_no, filing_date, legal_status, status_checked_at, doc_no, url, effective_date"
)
ASSETS = _schema("doc_id, asset_type, img_path, caption, page_idx int")
REFERENCES = _schema("doc_id, ref_index int, raw_text")
EVENTS = _schema("ts, mode, event, title, doc_id, status, error, count long, completed long, failed long")
IDS = _schema("id")
DEFAULTS = {"doc_type": "paper", "n_figures": 0, "n_tables": 0, "n_refs": 0, "section_title": ""}


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with missing columns added (default or null), others cast, and columns in order."""
    have = {c.lower(): c for c in df.columns}
    return df.select(*[(F.col(have[f.name.lower()]) if f.name.lower() in have else F.lit(DEFAULTS.get(f.name))).cast(f.dataType).alias(f.name) for f in schema])


def missing(df: DataFrame, schema: T.StructType) -> list[str]:
    """Columns that ``conform`` would add."""
    have = {c.lower() for c in df.columns}
    return [f.name for f in schema if f.name.lower() not in have]


def load(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A stored table; an empty one where there is none yet."""
    try:
        return conform(spark.read.parquet(path), schema)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], schema)
