"""Embedding with a deadline: a stream over a queue of chunks that stops in time and goes on from its checkpoint."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackloom.config import DEFAULT, Config
from stackloom.operators import models
from stackloom.sources.store import Library

QUEUE = "doc_id string, chunk_id long, content string"
#: Hours after which a run ends in any case, as one begun by hand in the daytime.
MOST_HOURS = 10


def deadline(hhmm: str, now: datetime, most_hours: float = MOST_HOURS) -> datetime:
    """The next time of day ``hhmm``, but no later than ``most_hours`` from now."""
    hour, minute = map(int, hhmm.split(":"))
    at = now.replace(hour=hour, minute=minute, second=0, microsecond=0)
    return min(at if at > now else at + timedelta(days=1), now + timedelta(hours=most_hours))


def enqueue(chunks: DataFrame, queue: str, files: int = 1) -> None:
    """Appends chunks to the queue, in ``files`` files: a micro-batch reads so many of them, and is what a stop may cost."""
    chunks.select("doc_id", F.col("chunk_id").cast("long"), "content").repartition(files, "chunk_id").write.mode("append").parquet(queue)


def embed_until(spark: SparkSession, queue: str, vectors: str, model: models.Embed, checkpoint: str, until: datetime, per_batch: int = 1, clock: Callable[[], datetime] = datetime.now, poll: float = 1.0, config: Config = DEFAULT) -> bool:
    """Embeds what the queue holds into ``vectors(chunk_id, vector)``; whether all of it is done.

    Ends when the queue is empty or ``until`` is reached.  What a micro-batch has written is committed with its checkpoint, so a later call goes on
    behind it, and each chunk gets its vector once; only the batch that is broken off is made again.
    """
    stream = spark.readStream.schema(QUEUE).option("maxFilesPerTrigger", per_batch).parquet(queue)
    query = models.embed(stream, model, config).writeStream.format("parquet").option("path", vectors).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    while not query.awaitTermination(poll):
        if clock() >= until:
            query.stop()
            return False
    return True


def take_in(library: Library, vectors: DataFrame, model: str) -> list[int]:
    """Saves streamed ``vectors(chunk_id, vector)`` of chunks that are still there and have none; returns the buckets written."""
    open_ = library.chunks.read().filter("embedding is null").select("doc_id", "chunk_id")
    return library.save_embeddings(open_.join(vectors.dropDuplicates(["chunk_id"]), "chunk_id").select("doc_id", "chunk_id", "vector"), model)
