"""Small Spark helpers: joins that split hot keys, connected components, and free column names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackloom.checkpoints import cut, drop

#: A key is hot if it has more than one in ``HOT`` of all rows and more than ``LEAST``; so there are fewer hot keys than ``HOT``.
HOT = 100
LEAST = 500


def unused(name: str, *taken: list[str]) -> str:
    """``name``, or a longer form of it that none of the ``taken`` columns has."""
    names = {c.lower() for columns in taken for c in columns}
    while name.lower() in names:
        name = "_" + name
    return name


def hot_keys(sizes: DataFrame, *keys: str, times: str = "times") -> list[int]:
    """Hashes of the hot keys of ``sizes(*keys, times)``, which has a row a key: less than ``HOT``, however many rows there are."""
    total = sizes.agg(F.sum(times)).first()[0] or 0
    return [r[0] for r in sizes.filter(F.col(times) > max(total / HOT, LEAST)).select(F.xxhash64(*keys)).collect()]


def spread_join(rows: DataFrame, table: DataFrame, keys: list[str], hot: list[int], how: str = "inner") -> DataFrame:
    """``rows`` joined with ``table``, which has a row a key; rows of the ``hot`` keys are dealt over many tasks.

    A hot key's row of ``table`` is copied for each of these, ``HOT`` times at most.  Rows are dealt by a hash of all their
    columns, so ``rows`` should hold one that tells rows of a key apart; rows that are wholly alike go to one task.
    """
    n = max(min(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), HOT), 1)
    # Without hot keys a hash that hardly any key has stands in, so that the plan is the same at every size.
    is_hot = F.xxhash64(*keys).isin(hot or [0])
    dealt = rows.withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64(*rows.columns), F.lit(n))).otherwise(0))
    salts = F.when(is_hot, F.sequence(F.lit(0), F.lit(n - 1))).otherwise(F.array(F.lit(0))).cast("array<long>")
    return dealt.join(table.withColumn("_salt", F.explode(salts)), [*keys, "_salt"], how).drop("_salt")


def components(links: DataFrame) -> DataFrame:
    """Connected components of ``links(a long, b long)``: one row ``(id, component)`` per linked vertex.

    Minimum labels travel over the links and are shortened by pointer jumping, so the number of
    rounds follows the logarithm of a component's diameter.  Each round is joins and partial
    aggregates on tables the size of ``links``; its result is written, and that of the round before
    deleted.  Vertices with very many links, and roots of very large components, are dealt over all tasks.
    """
    both = cut(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    degree = both.groupBy(F.col("b").alias("id")).agg(F.count("*").alias("times"))
    hubs = hot_keys(degree, "id")
    label = cut(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    while True:
        met = spread_join(both.select("a", F.col("b").alias("id")), label, ["id"], hubs)
        seen = met.groupBy(F.col("a").alias("id")).agg(F.min("component").alias("seen"))
        near = cut(label.join(seen, "id").select("id", F.least("component", "seen").alias("near"), F.col("component").alias("old")))
        roots = hot_keys(near.groupBy("near").agg(F.count("*").alias("times")), "near")
        top = near.select(F.col("id").alias("near"), F.col("near").alias("far"))
        step = cut(spread_join(near, top, ["near"], roots, "left").select("id", F.least("near", F.coalesce("far", "near")).alias("component"), "old"))
        drop(near, label)
        moved = step.filter(F.col("component") != F.col("old")).limit(1).count()
        label = step.select("id", "component")
        label._written = step._written
        if not moved:
            drop(both)
            return label
