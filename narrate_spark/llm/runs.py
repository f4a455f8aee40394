"""Periodic stretches of words: found as runs of Lyndon roots, and collapsed to one period.

A run is a stretch of consecutive words of smallest period q, as long as
``min_exponent`` periods and ``min_length`` words at least, that no neighbouring
word extends.  Each run holds a Lyndon root of one of two orders of the words, an
order and its reverse, and such a root is the longest Lyndon word at its place.
The Lyndon array, the length of that word at each place, falls out of the grouping
phase of a suffix sorter, before any suffix is sorted: groups of places with equal
words are taken from the last one down, and each group lengthens the words of the
places it is hung on (``lyndon_array``).  A root is extended to both sides by
longest common extensions into its run.

A run of exponent m holds each of its words m times.  So stretches are cut first
at words that occur fewer times in them, until nothing changes; no run is lost,
and the slow grouping only sees what may repeat.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrate_spark.llm import common

MIN_LENGTH = 6
MIN_EXPONENT = 4
# Documents are searched in groups of about so many bytes of text (or one document).
GROUP_BYTES = 1 << 20

_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_FOUND = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(_RUN)), ("collapsed", pa.binary())]
)


def lyndon_array(letters: np.ndarray) -> np.ndarray:
    """Length of the longest Lyndon word at each place, with the end of a stretch below all letters.

    Negative letters end stretches; the first letter is one.
    """
    n = len(letters)
    places = np.flatnonzero(letters >= 0)
    places = places[np.argsort(letters[places], kind="stable")]
    kinds = letters[places]
    first = np.flatnonzero(np.r_[True, kinds[1:] != kinds[:-1]]) if len(kinds) else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[first, len(places)])
    heads = np.full(n, -1)
    heads[places] = np.repeat(first, sizes)
    slots = np.zeros(n, np.int64)
    slots[places] = np.arange(len(places))
    members = np.zeros(len(places), np.int64)
    members[first] = sizes

    # a group is the slots from its head on; groups lie in order of their Lyndon words so far
    at, slot, head, size = places.tolist(), slots.tolist(), heads.tolist(), members.tolist()
    before, length = [0] * n, [1] * n
    end = len(at)
    while end:
        start = head[at[end - 1]]
        group = at[start:end]
        group.sort()
        hung: dict[int, int] = {}
        for i in group:
            p = i - 1
            while head[p] >= start:  # what lies between is part of longer or equal words
                p = before[p]
            before[i] = p
            if head[p] >= 0:
                hung[p] = hung.get(p, 0) + 1
        own = length[group[0]]
        most = max(hung.values(), default=0)
        # words that take the group's word more often are greater: they leave their group first, to its end
        for times in range(most, 0, -1):
            moved = [p for p, t in hung.items() if t == times] if most > 1 else list(hung)
            for p in moved:
                h = head[p]
                size[h] -= 1
                t, s = h + size[h], slot[p]
                q = at[t]
                at[s], slot[q] = q, s
                at[t], slot[p] = p, t
                length[p] += times * own
            kept: dict[int, int] = {}
            for p in moved:
                head[p] += size[head[p]]
                kept[head[p]] = kept.get(head[p], 0) + 1
            for h, k in kept.items():
                size[h] = k
        end = start
    return np.array(length)


def _common_right(x: np.ndarray, i: int, j: int) -> int:
    """Longest common extension of places i < j to the right."""
    k, step = 0, 16
    while True:
        a, b = x[i + k : i + k + step], x[j + k : j + k + step]
        differ = np.flatnonzero(a[: len(b)] != b)
        if len(differ):
            return k + int(differ[0])
        k += len(b)
        if len(b) < step:
            return k
        step *= 2


def _common_left(x: np.ndarray, i: int, j: int) -> int:
    """Longest common extension of what ends before places i < j to the left."""
    k, step = 0, 16
    while True:
        step_ = min(step, i - k)
        a, b = x[i - k - step_ : i - k], x[j - k - step_ : j - k]
        differ = np.flatnonzero(a != b)
        if len(differ):
            return k + step_ - 1 - int(differ[-1])
        k += step_
        if step_ < step:
            return k
        step *= 2


def extend_roots(x: np.ndarray, lengths: np.ndarray, min_length: int, min_exponent: int) -> set[tuple[int, int, int]]:
    """Runs (start, end, period) of the Lyndon roots of one order; places below 0 in ``x`` all differ."""
    n = len(x)
    i = np.flatnonzero(x >= 0)
    q = lengths[i]
    # a run holds one root fewer than its exponent, one after another
    for k in range(1, min_exponent - 1):
        j = i + k * q
        good = j < n
        i, q, j = i[good], q[good], j[good]
        good = (lengths[j] == q) & (x[j] == x[i])
        i, q = i[good], q[good]
    if min_exponent > 2:
        good = i + 2 * q - 1 < n
        i, q = i[good], q[good]
        good = x[i + q - 1] == x[i + 2 * q - 1]
        i, q = i[good], q[good]
    found: set[tuple[int, int, int]] = set()
    done: dict[int, int] = {}  # end of the last run of each period
    for a, p in zip(i.tolist(), q.tolist(), strict=True):
        if a + p <= done.get(p, 0):
            continue
        end = a + p + _common_right(x, a, a + p)
        start = a - _common_left(x, a, a + p)
        done[p] = end
        if end - start >= max(min_length, min_exponent * p):
            found.add((start, end, p))
    return found


def _repeating(ids: np.ndarray, stretch: np.ndarray, min_length: int, min_exponent: int) -> np.ndarray:
    """Places that are left when stretches are cut at words with too few places in them."""
    at = np.arange(len(ids))
    kinds = int(ids.max(initial=0)) + 1
    while len(at):
        key = stretch * kinds + ids[at]
        _, of, times = np.unique(key, return_inverse=True, return_counts=True)
        left = times[of] >= min_exponent
        kept, stretch = at[left], stretch[left]
        apart = np.r_[True, (np.diff(kept) > 1) | (np.diff(stretch) != 0)] if len(kept) else np.zeros(0, bool)
        number = np.cumsum(apart) - 1
        long = np.bincount(number, minlength=1)[number] >= min_length if len(kept) else np.zeros(0, bool)
        kept, number = kept[long], number[long]
        if len(kept) == len(at):
            return kept
        at, stretch = kept, number
    return at


def find_runs(
    docs: list[list[bytes]], min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT
) -> list[list[tuple[int, int, int]]]:
    """Runs (start, length, period) of each list of words, by start, then period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in docs]
    number = dict(zip(dict.fromkeys(chain.from_iterable(docs)), count()))  # noqa: B905
    sizes = np.array([len(w) for w in docs], np.int64)
    ids = np.fromiter(map(number.__getitem__, chain.from_iterable(docs)), np.int64, int(sizes.sum()))
    firsts = np.cumsum(sizes) - sizes
    at = _repeating(ids, np.repeat(np.arange(len(docs)), sizes), min_length, min_exponent)
    if not len(at):
        return out
    doc = np.searchsorted(firsts + sizes, at, "right")
    # one string of all stretches, each behind an end mark of its own
    opens = np.flatnonzero(np.r_[True, (np.diff(at) > 1) | (np.diff(doc) != 0)])
    kinds = np.unique(ids[at], return_inverse=True)[1]
    x = np.insert(kinds, opens, -1 - np.arange(len(opens)))
    x = np.append(x, -1 - len(opens))
    back = np.append(np.insert(at, opens, -1), -1)
    top = int(kinds.max())
    found = extend_roots(x, lyndon_array(x), min_length, min_exponent)
    found |= extend_roots(x, lyndon_array(np.where(x < 0, x, top - x)), min_length, min_exponent)
    for start, end, period in sorted(found, key=lambda r: (r[0], r[2])):
        place = int(back[start])
        d = int(np.searchsorted(firsts + sizes, place, "right"))
        out[d].append((place - int(firsts[d]), end - start, period))
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that a run repeats, joined by blanks."""
    if not runs:
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return b" ".join(compress(words, keep.tolist()))


def collapse_runs(docs: DataFrame, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """Runs of each document and its text with every run cut to one period.

    Returns one row per row of ``docs``: doc_id, n_words, runs (start, length and
    period in words, by start, then period) and collapsed (the words left, joined
    by one blank).  Words are ``[^\\x20\\x09-\\x0D]+`` and are compared byte by byte.
    A null, empty or blank text has no words, no runs and an empty collapsed text.
    Repeated rows and rows without doc_id are rows like others; an empty table gives
    no row.  Other columns are not read.  ``min_exponent`` is a whole number, 2 at
    least.  A row's work stays in its task, and nothing is shuffled.
    """
    if min_exponent < 2:
        raise ValueError("min_exponent is 2 at least")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(ids: list, texts: list[bytes]) -> pa.RecordBatch:
            words = [t.split() for t in texts]
            runs = find_runs(words, min_length, min_exponent)
            rows = [[{"start": s, "length": n, "period": p} for s, n, p in r] for r in runs]
            left = [collapsed(w, r) for w, r in zip(words, runs, strict=True)]
            return common.batch({"doc_id": ids, "n_words": [len(w) for w in words], "runs": rows, "collapsed": left}, _FOUND)

        for b in batches:
            ids: list[int | None] = []
            texts: list[bytes] = []
            size = 0
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                ids.append(doc)
                texts.append(text.as_py() or b"")
                size += len(texts[-1])
                if size >= GROUP_BYTES:
                    yield done(ids, texts)
                    ids, texts, size = [], [], 0
            if ids:
                yield done(ids, texts)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    found = rows.mapInArrow(
        search,
        "doc_id bigint, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed binary",
    )
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))


def _looped(doc_id: Column, text: Column) -> Column:
    """The words of a text; those of every tenth document repeat from some word on."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    h = F.crc32(doc_id.cast("string").cast("binary"))

    def loop(w: Column) -> Column:
        g, n = F.floor(h / 10), F.size(w)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        places = F.sequence(F.lit(0), n - 1)
        return F.array_join(F.transform(places, lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p))), " ")

    looped = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, loop(w)).otherwise(F.lit("")))
    return F.when(h % 10 == 0, F.get(looped, F.lit(0))).otherwise(text)


def op12_runs(spark, sf_dir: str) -> DataFrame:
    """Runs of all ``documents``, those of every tenth one written so that it repeats."""
    docs = common.table(spark, sf_dir, "documents")
    docs = docs.select("doc_id", _looped(F.col("doc_id"), F.col("text")).alias("text"))
    found = collapse_runs(docs)
    line = F.array_join(
        F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), ""
    )
    ranked = F.transform(
        "runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))
    )
    best = F.array_max(ranked)
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), line.alias("line"), "collapsed").select(
        "doc_id",
        "n_runs",
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.col("line").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
