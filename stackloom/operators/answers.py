"""Typed answers of a language model: checked against a schema, with one corrective pass and an error column."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stackloom.checkpoints import cut
from stackloom.sources.files import json_object

Chat = Callable[[list[str]], list[str]]
#: Rows that the model sees at a time.
BATCH = 16
# Fixed value: what is asked where an answer could not be read.
AGAIN = "\n\n你上次输出的 JSON 无法解析，请严格只输出合法 JSON，不要输出任何其它文字。"


def _said(rows: DataFrame, model: Chat, key: str) -> DataFrame:
    """(key, prompt, said, failure): the model's texts, batch by batch; a batch that fails is asked row by row, so that one bad row costs its own answer only."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), BATCH):
                part = batch.iloc[at : at + BATCH]
                prompts = part["prompt"].fillna("").tolist()
                try:
                    answers = [(x, None) for x in model(prompts)]
                    if len(answers) != len(prompts):
                        raise ValueError("the model returned another number of answers than prompts")
                except Exception:  # noqa: BLE001 (a failing batch must not end the run)
                    answers = [_one(model, p) for p in prompts]
                yield pd.DataFrame({key: part[key].values, "prompt": part["prompt"].values, "said": [a for a, _ in answers], "failure": [f for _, f in answers]})

    return rows.select(key, "prompt").mapInPandas(run, f"`{key}` {kind}, prompt string, said string, failure string")


def _one(model: Chat, prompt: str) -> tuple[str | None, str | None]:
    try:
        return model([prompt])[0], None
    except Exception as e:  # noqa: BLE001
        return None, f"{type(e).__name__}: {e}"


def _checked(rows: DataFrame, schema: T.StructType, required: list[str]) -> DataFrame:
    """Adds ``answer``, null where it does not hold, and ``error``."""
    found = json_object(F.col("said"))
    read = F.from_json(F.to_json(F.struct(found.alias("x"))), T.StructType([T.StructField("x", schema)]))["x"]
    lacking = F.filter(F.array(*[F.when(F.col(f"_read.{c}").isNull(), F.lit(c)) for c in required]), lambda c: c.isNotNull()) if required else F.array().cast("array<string>")
    error = F.when(F.col("failure").isNotNull(), F.col("failure")).when(F.col("_object").isNull(), "no JSON object")
    error = error.when(F.size("_lacking") > 0, F.concat(F.lit("missing or of another type: "), F.array_join("_lacking", ", ")))
    told = rows.withColumns({"_object": F.try_variant_get(found, "$", "string"), "_read": read}).withColumn("_lacking", lacking).withColumn("error", error)
    return told.withColumn("answer", F.when(F.col("error").isNull(), F.col("_read"))).drop("_object", "_read", "_lacking")


def ask(rows: DataFrame, model: Chat, schema: str | T.StructType, key: str = "id", required: list[str] | None = None, again: str = AGAIN) -> DataFrame:
    """(key, answer, error, asked) of ``rows(key, prompt)``: ``answer`` is a struct of ``schema``, or null with a reason.

    A text may hold its JSON object between other words.  Fields of another type count as missing; ``required`` names those that must
    be there, all of them if it is not given.  Rows whose first answer does not hold are asked once more, with ``again`` behind
    their prompt; the others are not.  First answers are written, so that no model is asked twice for one row.
    """
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    must = schema.names if required is None else required
    first = cut(_checked(_said(rows, model, key), schema, must))
    bad = first.filter(F.col("error").isNotNull())
    second = cut(_checked(_said(bad.select(key, F.concat(F.coalesce("prompt", F.lit("")), F.lit(again)).alias("prompt")), model, key), schema, must))
    columns: list[Column | str] = [key, "answer", "error"]
    return first.filter(F.col("error").isNull()).select(*columns, F.lit(1).alias("asked")).union(second.select(*columns, F.lit(2).alias("asked")))
