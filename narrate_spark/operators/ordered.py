"""Ordered scans over groups of any size.

A plain ``sum() over (partition by book order by chapter)`` sends a whole book
to one task.  Where one book may hold a third of all rows that never finishes,
so a scan goes by ranges:

1. rows are placed by range of (group, order), so a group larger than a partition
   goes on in the next ones, and are written with the number of their partition;
2. every partition is summed up to one edge row per group in it;
3. a group that spans partitions carries its edges on, in order of partitions.  A
   partition shares its first and its last group with others at most, so there are
   no more than two such rows per partition: they are broadcast;
4. one window inside each (partition, group) completes the scan.

Rows are few columns wide: the keys, the order and the value.  They are exchanged
twice, by range and by (partition, group), whatever their number and order values.
The written table fixes the ranges: a range placement is drawn from a sample, and
a second one of the same rows may cut elsewhere.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from narrate_spark.storage import stored


def _scan(
    rows: DataFrame,
    keys: list[str],
    order: list[str],
    parts: int | None,
    summary: Callable[[Sequence[str]], Column],
    exclusive: Callable[[Column, WindowSpec], Column],
    combine: Callable[[Column, Column], Column],
) -> DataFrame:
    """Add ``__out``, the exclusive scan of ``__value``, to narrow rows."""
    count = [] if parts is None else [parts]
    ranged = rows.repartitionByRange(*count, *keys, *order)
    placed = stored(ranged.withColumn("__part", F.spark_partition_id()))

    def before(window: WindowSpec) -> WindowSpec:
        return window.rowsBetween(Window.unboundedPreceding, -1)

    group = Window.partitionBy(*keys)
    edges = placed.groupBy("__part", *keys).agg(summary(order).alias("__value"))
    spanning = edges.withColumn("__parts", F.count(F.lit(1)).over(group)).where(F.col("__parts") > 1)
    carried = spanning.select(
        F.col("__part").alias("__p"),
        *[F.col(k).alias(f"__c{i}") for i, k in enumerate(keys)],
        exclusive(F.col("__value"), before(group.orderBy("__part"))).alias("__carry"),
    )
    local = before(Window.partitionBy("__part", *keys).orderBy(*order))
    inside = placed.withColumn("__inside", exclusive(F.col("__value"), local))
    same = F.col("__part") == F.col("__p")
    for i, key in enumerate(keys):
        same = same & F.col(key).eqNullSafe(F.col(f"__c{i}"))
    return inside.join(F.broadcast(carried), same, "left").select(
        *rows.columns, combine(F.col("__carry"), F.col("__inside")).alias("__out")
    )


def _run(
    df: DataFrame,
    keys: Sequence[str],
    order: str | Sequence[str],
    value: Column,
    out: str,
    cheap: bool,
    parts: int | None,
    **rules: Callable,
) -> DataFrame:
    cols = [order] if isinstance(order, str) else list(order)
    names = {f"__k{i}": k for i, k in enumerate(keys)} | {f"__o{i}": c for i, c in enumerate(cols)}
    rows = df.select(*[F.col(c).alias(n) for n, c in names.items()], value.alias("__value"))
    # drawing the sample reads the rows once more
    rows = rows if cheap else stored(rows)
    places = list(names)
    scanned = _scan(rows, places[: len(keys)], places[len(keys) :], parts, **rules)
    kept = {c: n for n, c in reversed(names.items())}
    return scanned.select(
        *[F.col(kept[c]).alias(c) for c in dict.fromkeys([*keys, *cols])],
        F.col("__value").alias("value"),
        F.col("__out").alias(out),
    )


def sum_before(
    df: DataFrame,
    keys: Sequence[str],
    order: str | Sequence[str],
    value: Column,
    out: str,
    cheap: bool = False,
    parts: int | None = None,
) -> DataFrame:
    """Sum of ``value`` over all earlier rows of the group (0 for the first).

    The result has the keys, the order columns, ``value`` and ``out``.  Nulls in
    keys and order are values like others; without keys all rows are one group.
    ``cheap``: rows cost little to compute, so they need not be written before
    they are placed.  ``parts`` fixes the number of ranges.
    """
    zero = F.lit(0).cast("bigint")
    return _run(
        df,
        keys,
        order,
        value.cast("bigint"),
        out,
        cheap,
        parts,
        summary=lambda _: F.sum("__value"),
        exclusive=lambda v, w: F.coalesce(F.sum(v).over(w), zero),
        combine=lambda carry, inside: F.coalesce(carry, zero) + inside,
    )


def last_before(
    df: DataFrame,
    keys: Sequence[str],
    order: str | Sequence[str],
    value: Column,
    out: str,
    cheap: bool = False,
    parts: int | None = None,
) -> DataFrame:
    """Last non-null ``value`` among all earlier rows of the group.

    With a value that is never null this is ``lag``.  Columns, ``cheap`` and
    ``parts`` are those of ``sum_before``.
    """

    def newest(by: Sequence[str]) -> Column:
        known = F.when(F.col("__value").isNotNull(), F.struct(*by))
        return F.max_by("__value", known)

    return _run(
        df,
        keys,
        order,
        value,
        out,
        cheap,
        parts,
        summary=newest,
        exclusive=lambda v, w: F.last(v, ignorenulls=True).over(w),
        combine=lambda carry, inside: F.coalesce(inside, carry),
    )
