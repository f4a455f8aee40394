"""Size checks that pick between a small and a large way of doing a thing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A side up to this planned size is broadcast.
BROADCAST_BYTES = 8 << 20
# Input bytes of one partition of a spread scan: of a large input, and of a small one as
# long as it has no more than ``SPREAD_TASKS`` partitions per core.
SPREAD_BYTES = 4 << 20
SPREAD_LEAST_BYTES = 256 << 10
SPREAD_TASKS = 3
# From so many input bytes per core on a scan is left as it lies: an exchange among that many
# partitions costs more than uneven tasks, which are many for each core by then.
SPREAD_BYTES_PER_CORE = 64 << 30


def planned_bytes(df: DataFrame) -> int:
    """The planner's size of a result; grows with joins, so rather too high."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def input_bytes(df: DataFrame) -> int:
    """Bytes of everything a result is read from."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))


def small(df: DataFrame) -> DataFrame:
    """Broadcast a side whose planned size is small; leave others to the planner."""
    return F.broadcast(df) if planned_bytes(df) <= BROADCAST_BYTES else df


def spread_parts(size: int, cores: int, part_bytes: int = SPREAD_BYTES) -> int:
    """Partitions of a spread scan of so many bytes."""
    return max(size // part_bytes, min(cores * SPREAD_TASKS, size // SPREAD_LEAST_BYTES)) + 1


def spread(df: DataFrame, *keys: str, like: DataFrame | None = None, part_bytes: int = SPREAD_BYTES) -> DataFrame:
    """Spread an input by its keys over partitions of a bounded size.

    A scan gives tasks of whole row groups, several files at a time, which are fine to read
    and slow to analyse: text work takes a hundred times as long as the exchange.  The number
    of partitions follows the size of the input, so a larger one has more tasks, not longer
    ones.  A stream is sized by the table it replays (``like``).
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = input_bytes(like or df)
    if size >= cores * SPREAD_BYTES_PER_CORE:
        return df
    return df.repartition(spread_parts(size, cores, part_bytes), *keys)
