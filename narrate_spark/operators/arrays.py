"""Arrays to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_rows(
    df: DataFrame, keep: list[str], array: Column | str, pos: str, item: str
) -> DataFrame:
    """One row per array element with its position (bigint).

    The plain generator makes the optimizer infer a size filter, which is then
    pushed below and computes the whole array a second time.  The outer form
    infers nothing; its rows for empty arrays are dropped on the position.
    """
    rows = df.select(*keep, F.posexplode_outer(array).alias(pos, item))
    rows = rows.where(F.col(pos).isNotNull())
    return rows.withColumn(pos, F.col(pos).cast("bigint"))
