"""Benchmark decontamination by size-partitioned minhash containment search.

An item is the set of its five-word shingles; a document contains it when it has
at least 80 % of them.  The minwise shingle of an item under a hash function is a
random one of its shingles, so a document that contains a share c of the item
holds it with probability c, however long the document is.  Items are
partitioned by size: small ones are probed with all their shingles, larger ones
with ``PROBES`` minwise shingles, and a document that is too small for a class
is not compared with it.  Documents with enough of the probes are candidates, and
exact counting of the words' shingles decides.

Items are a stated set of queries.  They are taken in blocks of bounded size, and
documents are read where they lie, once a block, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narrate_spark.llm import common, tokens

SIZE = 5
THRESHOLD = 80  # percent
# Probes of a large item and hits that make a candidate: an item contained by 80 %
# has fewer hits with a probability of 3 in 10 million.
PROBES, HITS = 16, 4
# Bytes of item texts that are compared at a time; their index is sent to all tasks.
BLOCK_BYTES = 4 << 20

_FOUND = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("item_id", pa.int64()),
        ("shared", pa.int64()),
        ("item_shingles", pa.int64()),
        ("containment", pa.float64()),
    ]
)
_WORDS = bytes(b"\x20"[0] if common.NOT_ALNUM[i] else ord(chr(i).lower()) if i < 128 else i for i in range(256))
_SEEDS = common.mix(np.arange(100, 100 + PROBES, dtype=np.uint64)) | np.uint64(1)


def exact_shingles(text: str | None, size: int = SIZE) -> set[tuple[bytes, ...]]:
    """Distinct shingles of a text: A-Z lower-cased, words of letters, digits and non-ASCII characters."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_WORDS).split()
    return set(zip(*(words[i:] for i in range(size)), strict=False))


class ItemIndex:
    """Probes of a block of items, by size class."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        self.ids = [i for i, _ in items]
        # an item of fewer than five words is one shingle of its own length, looked for as such
        self.short: dict[int, dict[tuple[bytes, ...], list[int]]] = {}
        self.exact = []
        for k, (_, text) in enumerate(items):
            words = (text or "").encode("utf-8", "surrogatepass").translate(_WORDS).split()
            self.exact.append(exact_shingles(text, max(1, min(SIZE, len(words)))))
            if 0 < len(words) < SIZE:
                self.short.setdefault(len(words), {}).setdefault(tuple(words), []).append(k)
        self.sizes = np.array([len(s) for s in self.exact])
        probes: list[tuple[int, int]] = []
        self.hits = np.full(len(items), HITS)
        for k, (_, text) in enumerate(items):
            all_ = self.hashed(text)
            if len(all_) <= PROBES:  # a small item: all shingles, of which 80 % must be there
                self.hits[k] = -(-len(all_) * THRESHOLD // 100)
                chosen = all_
            else:
                with np.errstate(over="ignore"):
                    chosen = all_[(all_[:, None] * _SEEDS).argmin(axis=0)]
            probes += [(int(h), k) for h in chosen]
        probes.sort()
        self.probe = np.array([h for h, _ in probes], np.uint64)
        self.owner = np.array([k for _, k in probes], np.int64)
        # a bit for the first bits of each probe rejects nearly all shingles of a document
        self.first = np.zeros(1 << 20, bool)
        self.first[self.probe >> np.uint64(44)] = True

    @staticmethod
    def hashed(text: str | None) -> np.ndarray:
        """Hashes of the five-word shingles of a whole text; a shorter one has none."""
        words = common.word_hashes(text, common.NOT_ALNUM)
        return common.shingles(words, SIZE) if len(words) >= SIZE else words[:0]

    def find(self, text: str | None) -> list[tuple[int, int]]:
        """(item, shared shingles) of each item that the whole text contains."""
        return self._find_short(text) + self._find_long(text)

    def _find_short(self, text: str | None) -> list[tuple[int, int]]:
        found = []
        for size, items in self.short.items():
            for words in items.keys() & exact_shingles(text, size):
                found += [(k, 1) for k in items[words]]
        return found

    def _find_long(self, text: str | None) -> list[tuple[int, int]]:
        all_ = self.hashed(text)
        some = all_[self.first[all_ >> np.uint64(44)]]
        if not len(some):
            return []
        low, high = np.searchsorted(self.probe, some, "left"), np.searchsorted(self.probe, some, "right")
        hit = np.flatnonzero(high > low)
        if not len(hit):
            return []
        owners = np.concatenate([self.owner[low[i] : high[i]] for i in hit])
        items, counts = np.unique(owners, return_counts=True)
        fits = (counts >= self.hits[items]) & (100 * len(all_) >= THRESHOLD * self.sizes[items])
        if not fits.any():
            return []
        own = exact_shingles(text)
        shared = ((int(k), len(own & self.exact[k])) for k in items[fits])
        return [(k, n) for k, n in shared if 100 * n >= THRESHOLD * len(self.exact[k])]


def item_blocks(items: DataFrame, block_bytes: int) -> Iterator[ItemIndex]:
    """Indexes of the items, block by block."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-int(total) // block_bytes)
    for k in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()
        yield ItemIndex([(r["item_id"], r["text"]) for r in rows])


def find_contaminated(docs: DataFrame, items: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each document and item that it contains by 80 % or more.

    An item of fewer than five words is one shingle of its own length, and found wherever
    its words stand one after another; longer ones have shingles of five words.  Without
    words, and for a null text, there is nothing to find.  Repeated documents and items
    give repeated rows; null ids are kept.  Without documents or items there is no row.
    """
    spark = docs.sparkSession
    out = spark.createDataFrame([], "doc_id bigint, item_id bigint, shared bigint, item_shingles bigint, containment double")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    for index in item_blocks(items, block_bytes):
        sent = spark.sparkContext.broadcast(index)

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = sent.value
            for b in batches:
                rows: dict[str, list] = {f.name: [] for f in _FOUND}
                for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                    for k, shared in index.find(text):
                        values = (doc, index.ids[k], shared, int(index.sizes[k]), shared / int(index.sizes[k]))
                        for column, value in zip(rows.values(), values, strict=True):
                            column.append(value)
                yield common.batch(rows, _FOUND)

        out = out.union(docs.mapInArrow(search, out.schema))
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that contain no item; rows and columns are else those of ``docs``."""
    spark = docs.sparkSession
    for index in item_blocks(items, block_bytes):
        sent = spark.sparkContext.broadcast(index)

        def clean(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            tokens.forget()
            for b in batches:
                keep = [not sent.value.find(text) for text in b.column("text").to_pylist()]
                yield b.filter(pa.array(keep, pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs


def op3_decontamination(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` against all items of ``benchmark``."""
    return find_contaminated(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


_SHINGLES = r"""
  SELECT {id}, k, unnest(list_distinct(
    CASE WHEN len(w) >= k THEN [array_to_string(w[i:i + k - 1], ' ') for i in range(1, len(w) - k + 2)] ELSE [] END)) AS s
  FROM {words}
"""
_CUT = r"""
  SELECT {id}, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM {table}
"""
ORACLE_SQL = f"""
WITH dw AS ({_CUT.format(id="doc_id", table="documents")}),
iw AS (SELECT item_id, w, least(len(w), 5) AS k FROM ({_CUT.format(id="item_id", table="benchmark")}) WHERE len(w) > 0),
d AS ({_SHINGLES.format(id="doc_id", words="dw, (SELECT DISTINCT k FROM iw)")}),
i AS ({_SHINGLES.format(id="item_id", words="iw")}),
n AS (SELECT item_id, count(*) AS item_shingles FROM i GROUP BY item_id),
c AS (SELECT doc_id, item_id, count(*) AS shared FROM d JOIN i USING (k, s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, shared, item_shingles, CAST(shared AS DOUBLE) / item_shingles AS containment
FROM c JOIN n USING (item_id) WHERE 100 * shared >= 80 * item_shingles
"""
