"""Connected components of a graph given as edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narrate_spark.llm import common

# Edges that a task contracts at a time.
SHARE = 250_000

_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each vertex of the edges but the smallest of its component, and that smallest one."""
    ids, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(ids))
    while len(x):
        least = np.minimum(root[x], root[y])
        np.minimum.at(root, root[x], least)
        np.minimum.at(root, root[y], least)
        while not np.array_equal(root, root[root]):
            root = root[root]
        apart = root[x] != root[y]
        x, y = x[apart], y[apart]
    rest = np.flatnonzero(root < np.arange(len(ids)))
    return ids[rest], ids[root[rest]]


def contract(edges: DataFrame, shares: int) -> DataFrame:
    """The edges with those of each share of at most ``SHARE`` replaced by the stars of their components."""

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def star() -> pa.RecordBatch:
            a, b = stars(*(np.concatenate([h.column(c).to_numpy() for h in held]) for c in ("a", "b")))
            return common.batch({"a": a, "b": b}, _EDGES)

        for whole in batches:
            for at in range(0, whole.num_rows, SHARE):
                b = whole.slice(at, SHARE)
                if held and sum(h.num_rows for h in held) + b.num_rows > SHARE:
                    yield star()
                    held = []
                held.append(b)
        if held:
            yield star()

    return edges.coalesce(shares).mapInArrow(shrink, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """(a, b) with b the smallest id of a's component, for every a but the smallest itself.

    Edges are contracted in shares of at most ``SHARE``.  Where they fill one
    share, that is the result.  Otherwise two steps alternate until nothing
    changes: each vertex links its larger neighbours to its smallest one, then its
    smaller ones.  Both are a grouping, which sums up in each task first, and a
    join, so a vertex with very many neighbours is no task of its own.  Every round
    is written, and only its row count and a checksum come to the driver.
    """
    edges = common.stored(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    )
    state, before = _state(edges), None
    while state[0] and state != before:
        shares = -(-state[0] // SHARE)
        edges = contract(edges, shares)
        if shares == 1:
            return common.stored(edges)
        edges = common.stored(edges)
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        least = both.groupBy("u").agg(F.least(F.min("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = common.stored(small.union(least.select("a", "m")).distinct())
        before, state = state, _state(edges)
    return edges
