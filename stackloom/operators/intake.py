"""Budgeted intake of books: what is taken, put off or put aside, in the order of names."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stackloom.checkpoints import cut

def _settled() -> Column:
    """The outcome of a file that the budget does not decide; null if it does."""
    out = F.when(F.coalesce("known", F.lit(False)), "skipped").when(F.coalesce("epub", F.lit(False)), "ok")
    return out.when(F.col("verdict") == "corrupt", "quarantined").when(F.col("verdict") == "transient", "failed")


def taken(pages: np.ndarray, used: int, budget: int) -> np.ndarray:
    """Which files of these sizes, in order, fit what is left of the budget; while nothing is used, any does."""
    out = np.zeros(len(pages), bool)
    at = 0
    while at < len(pages):
        # The next file that fits: those before it do not change what is left.
        fits = np.flatnonzero(pages[at:] <= budget - used) if used else np.array([0])
        if not len(fits):
            break
        at += int(fits[0])
        out[at] = True
        used += int(pages[at])
        at += 1
    return out


def _carry(table: np.ndarray, pages: np.ndarray, budget: int) -> None:
    """``table[u]``, pages used before a stretch by pages used at its start, goes on over files of these sizes.

    Pages used lie between 0 and the budget; budget + 1 stands for anything above, as where the first file alone is larger.
    """
    for p in pages.tolist():
        fits = (table == 0) | (p <= budget - table)
        table[fits] = np.minimum(table[fits] + p, budget + 1)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, str], pa.RecordBatch]]:
    """Rows that come sorted by part and batch, by these two; rows of one key come in one piece or several."""
    for rows in batches:
        part, batch = rows.column("part").to_numpy(), rows.column("batch").to_numpy(zero_copy_only=False)
        edges = (np.flatnonzero((part[1:] != part[:-1]) | (batch[1:] != batch[:-1])) + 1).tolist()
        for a, b in zip([0, *edges], [*edges, rows.num_rows] if rows.num_rows else []):
            yield (int(part[a]), batch[a]), rows.slice(a, b - a)


def _undecided(rows: pa.RecordBatch) -> np.ndarray:
    return pc.is_null(rows.column("settled")).to_numpy(zero_copy_only=False)


def _carried(budget: int):
    """(part, batch, carry): pages used after a part's rows of a batch, by the pages used before them.

    Only of a part's first and last batch: those between begin and end inside, with nothing used.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, is_first = None, [], True

        def told() -> pa.RecordBatch:
            table = np.arange(budget + 2)
            for pages in held:
                _carry(table, pages, budget)
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]]), pa.array([table.tolist()], pa.list_(pa.int64()))], names=["part", "batch", "carry"])

        for mine, rows in _runs(batches):
            if mine != key:
                if key is not None and (is_first or mine[0] != key[0]):
                    yield told()
                is_first = key is None or mine[0] != key[0]
                key, held = mine, []
            held.append(rows.column("pages").to_numpy()[_undecided(rows)])
        if key is not None:
            yield told()

    return run


def _decided(budget: int):
    """Rows come sorted by part, batch and name, each with the pages used ``before`` its batch's rows of this part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, used = None, 0
        for key, rows in _runs(batches):
            if key != current:
                current, used = key, rows.column("before")[0].as_py()
            open_, pages = _undecided(rows), rows.column("pages").to_numpy()
            fits = np.zeros(len(pages), bool)
            fits[open_] = taken(pages[open_], used, budget)
            used = min(used + int(pages[fits].sum()), budget + 1)
            outcome = pc.fill_null(rows.column("settled"), pa.array(np.where(fits, "ok", "deferred"), pa.string()))
            yield pa.RecordBatch.from_arrays([rows.column("batch"), rows.column("name"), outcome, pa.array(np.where(fits, pages, 0))], names=["batch", "name", "outcome", "pages"])

    return run


def decide(files: DataFrame, budget: int) -> DataFrame:
    """(batch, name, outcome, pages) of ``files(batch, name, known, epub, verdict, pages)``.

    A known file is skipped, an EPUB costs nothing, a corrupt file is quarantined, a passing error
    fails, and a file beyond the rest of the budget is deferred while later, smaller ones may still fit.
    While nothing is used, any size is taken.

    Each decision depends on those before, so this is a scan over rows sorted by range: every task first tells, for
    each number of pages that may be used before its rows, how many are after them; these tables, of
    ``budget + 2`` numbers and two a task at most, are joined in order, and then every task decides with what is used before it.
    Rows of one batch and name are one file, the largest counts; null batches and names count as empty.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    one = files.groupBy(text("batch"), text("name")).agg(F.max(F.struct(F.coalesce("pages", F.lit(0)).cast("long").alias("pages"), _settled().alias("settled"))).alias("f"))
    order = ["batch", "name"]
    ranged = one.select(*order, "f.settled", "f.pages").repartitionByRange(*order)
    rows = cut(ranged.withColumn("part", F.spark_partition_id()))
    by_part = lambda df: df.repartition("part").sortWithinPartitions("part", *order)
    carries = by_part(rows).mapInArrow(_carried(budget), "part int, batch string, carry array<long>")
    listed = carries.groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("part", "carry"))).alias("all"))
    start = F.expr("named_struct('used', 0L, 'out', cast(array() as array<struct<part:int,before:bigint>>))")
    step = lambda s, c: F.struct(F.element_at(c["carry"], (s["used"] + 1).cast("int")).alias("used"), F.concat(s["out"], F.array(F.struct(c["part"].alias("part"), s["used"].alias("before")))).alias("out"))
    before = listed.select("batch", F.explode(F.aggregate("all", start, step, lambda s: s["out"])).alias("b")).select("batch", "b.part", "b.before")
    told = rows.join(before, ["batch", "part"], "left").withColumn("before", F.coalesce("before", F.lit(0)).cast("long"))
    return by_part(told.select(*order, "settled", "pages", "part", "before")).mapInArrow(_decided(budget), "batch string, name string, outcome string, pages long")


def with_known(files: DataFrame, papers: DataFrame) -> DataFrame:
    """``files(id, ...)`` with ``known``: whether a paper of that content is there and exported; of an empty table none is."""
    done = papers.filter("status = 'EXPORTED'").select("id").distinct().withColumn("known", F.lit(True))
    return files.drop("known").join(done, "id", "left").withColumn("known", F.coalesce("known", F.lit(False)))


def report(decisions: DataFrame) -> DataFrame:
    """(batch, outcome, n, pages)."""
    return decisions.groupBy("batch", "outcome").agg(F.count("*").alias("n"), F.sum("pages").alias("pages"))
