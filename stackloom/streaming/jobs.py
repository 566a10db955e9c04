"""Streaming forms: intake by content hash, state changes, windowed history."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from stackloom import schemas, vocab


def file_stream(spark: SparkSession, folder: str, per_batch: int = 30) -> DataFrame:
    """New PDFs of a folder with their content hash as id."""
    files = spark.readStream.format("binaryFile").option("pathGlobFilter", "*.pdf").option("maxFilesPerTrigger", per_batch).load(folder)
    return files.select("path", F.sha2("content", 256).alias("id"), "length")


def event_stream(spark: SparkSession, folder: str, per_batch: int = 30) -> DataFrame:
    rows = spark.readStream.schema(schemas.EVENTS).option("mode", "DROPMALFORMED").option("maxFilesPerTrigger", per_batch).json(folder)
    return rows.withColumn("time", F.try_to_timestamp("ts"))


def once(stream: DataFrame, known: Callable[[], DataFrame], take: Callable[[DataFrame], None], checkpoint: str, period: str | None = None) -> StreamingQuery:
    """Hands each new id to ``take`` once; ``known`` reads the ids that are stored by then.

    With a period the query goes on; without one it ends when all files there are have been read.
    """

    def batch(rows: DataFrame, _: int) -> None:
        take(rows.dropDuplicates(["id"]).join(known().select("id"), "id", "left_anti"))

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=period) if period else writer.trigger(availableNow=True)).start()


def daily(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Events by day, mode and status, with a watermark for late ones."""
    return stream.withWatermark("time", late).groupBy(F.window("time", "1 day"), "mode", "status").agg(F.count("*").alias("n")).select(F.to_date("window.start").alias("day"), "mode", "status", "n")


def states(stream: DataFrame) -> DataFrame:
    """(id, status, changes): the state of each document after ``stream(id, new_status, ord)``; done documents stay done."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001 (GroupState)
        status, n = state.get if state.exists else ("PARSED", 0)
        rows = pd.concat(list(batches)).sort_values("ord")
        for new in rows["new_status"]:
            if status != "EXPORTED" and new in vocab.STATES and new != status:
                status, n = new, n + 1
        state.update((status, n))
        yield pd.DataFrame({"id": [key[0]], "status": [status], "changes": [n]})

    return stream.groupBy("id").applyInPandasWithState(step, "id string, status string, changes long", "status string, changes long", "update", "NoTimeout")


def embed_missing(read: Callable[[], DataFrame], write: Callable[[DataFrame], None], model: Callable[[DataFrame], DataFrame], per_round: int, rounds: int) -> int:
    """Resumable embedding: rounds of chunks without vectors until none is left or the rounds are used; returns the rounds."""
    from stackloom.operators.state import save_embeddings

    for k in range(rounds):
        chunks = read()
        todo = chunks.filter("embedding is null").orderBy("doc_id", "chunk_index").limit(per_round)
        if not todo.limit(1).count():
            return k
        write(save_embeddings(chunks, model(todo)))
    return rounds
