"""Near-duplicates by a chosen-path similarity join.

A document is the set of its word shingles.  Its signature holds one minwise
hash of two bytes for each of ``COORDINATES`` hash functions, so documents that are not
alike share hardly a token, however many there are.  In a tree, a node's documents
branch by the tokens (coordinate, minwise hash) that a random function of the
node selects, about 1 / threshold per document, so a pair of the wanted
similarity shares one child on average, and a dissimilar pair none.  Nodes are
compared exhaustively, by a sketch of the signature.  Large ones are branched
before, unless nearly all of their documents are linked already.
Each level loses pairs, so the number of independent trees follows from the
deepest level in use: documents whose nodes are branched again get further trees,
until a pair at the threshold is missed with a probability below one in ten thousand.

What the trees find are candidates.  Links are confirmed on the full sets: first
every document's most similar candidate of another component in the nodes of the first
trees alone, in rounds.  Nodes of all trees in which one component is left need no
comparison.
Candidates of different components that are left tie their documents to clusters,
in each of which a document stands once, however many nodes it shares with the
others.  A cluster gets the full sets, and each candidate that is not connected
yet is checked there.
Documents with one and the same set are one vertex, whatever their number.

Nodes that stay large are dealt into blocks, and so are large clusters: the
members of the largest component once, all others to every block, so each pair
across components still meets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narrate_spark.llm import common, tokens
from narrate_spark.llm.components import components, stars

THRESHOLD = 80  # percent
COORDINATES = 256
# Trees by the deepest level in use.  Shared tokens are binomial; a pair at the threshold is
# lost in all of them with a probability of 4.4e-5 at most, and in the 16 of all documents
# before its nodes are branched again with as much, so with less than 1e-4 together.
TREES = {2: 16, 3: 22, 4: 28, 5: 34, 6: 40}
# Levels that are branched in one go, and the depth at which branching ends.
FIRST_LEVELS = 2
DEPTH = 6
# Nodes of at most so many documents are compared exhaustively.  A pair takes about 0.17
# microseconds, while a document whose node is branched again takes rows in up to 24 trees more, so
# branching is the dearer way for smaller nodes, and it makes many times more rows.
NODE = 4000
# Ties of a task are contracted when there are so many.
TIES = 1 << 20
# Clusters of more documents are dealt into blocks of about so many.
CLUSTER = 250
# Coordinates of the sketch (two bits each) that must agree; at the threshold
# this is five standard deviations below the mean.
AGREE = 189
# Trees whose candidates are confirmed before the others are grown, in rounds; a round that
# adds no more than one in so many links is the last.  Later steps find what is left.
FIRST_TREES = 2
MORE = 10

_WORDS = COORDINATES // 32
_SETS = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n", pa.int64()),
        ("f1", pa.int64()),
        ("f2", pa.int64()),
        ("signature", pa.binary()),
        ("sketch", pa.binary()),
    ]
)
_NODES = pa.schema([("node", pa.int64()), ("doc", pa.int64())])
_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("score", pa.int32())])

_SEEDS = common.mix(np.arange(1, COORDINATES + 1, dtype=np.uint64)) | np.uint64(1)


def signature(items: np.ndarray) -> np.ndarray:
    """Two bytes of the minwise hash of a set for each coordinate."""
    out = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(items), 512):
            np.minimum(out, (items[at : at + 512, None] * _SEEDS).min(axis=0), out=out)
        return (common.mix(out) >> np.uint64(48)).astype("<u2")


def sketch(signature: np.ndarray) -> np.ndarray:
    """Two bits of each coordinate, packed."""
    two = (signature & 3).astype(np.uint64).reshape(_WORDS, 32)
    return (two << (2 * np.arange(32, dtype=np.uint64))).sum(axis=1, dtype=np.uint64)


def document_sets(docs: DataFrame, size: int) -> DataFrame:
    """Set size, a 128-bit fingerprint of the set, and the signature of each document."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.forget()
        for b in batches:
            n, f1, f2, signatures, sketches = [], [], [], [], []
            for text in b.column("text").to_pylist():
                items = common.shingles(common.word_hashes(text, common.SPACES), size)
                n.append(len(items))
                f1.append(int(items.sum(dtype=np.uint64).astype(np.int64)))
                f2.append(int(common.mix(items + np.uint64(1)).sum(dtype=np.uint64).astype(np.int64)))
                own = signature(items)
                signatures.append(own.tobytes() if len(items) else None)
                sketches.append(sketch(own).tobytes() if len(items) else None)
            yield common.batch(
                {"doc_id": b.column("doc_id"), "n": n, "f1": f1, "f2": f2, "signature": signatures, "sketch": sketches}, _SETS
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        sets, "doc_id bigint, n bigint, f1 bigint, f2 bigint, signature binary, sketch binary"
    )


def branch(rows: DataFrame, levels: int, threshold: int, trees: range = range(0)) -> DataFrame:
    """Children (node, doc) of (node, doc, signature) rows; without ``node``, of the roots of ``trees``."""
    rooted = "node" in rows.columns
    limit = np.uint64(int(2**64 * 100 / threshold / COORDINATES))
    coordinates = np.arange(COORDINATES, dtype=np.uint64) << np.uint64(16)
    rows = rows.select(*(["node"] if rooted else []), "doc", "signature")

    def children(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.forget()
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                b = whole.slice(at, 2048)
                with np.errstate(over="ignore"):
                    signatures = np.frombuffer(b"".join(b.column("signature").to_pylist()), "<u2")
                    hashed = common.mix(signatures.reshape(-1, COORDINATES) + coordinates)
                    doc, all_ = b.column("doc").to_numpy(), np.arange(b.num_rows)
                    if rooted:
                        roots = [b.column("node").to_numpy().astype(np.uint64)]
                    else:
                        seeds = common.mix(np.array(trees, np.uint64) + np.uint64(7919))
                        roots = [np.full(b.num_rows, s) for s in seeds]
                    for node in roots:
                        row = all_
                        for _ in range(levels):
                            # a node's random function of a token decides whether it is branched by
                            chance = common.mix(hashed[row] ^ common.mix(node)[:, None])
                            i, j = np.nonzero(chance < limit)
                            node, row = common.mix(chance[i, j] + node[i]), row[i]
                        yield common.batch({"node": node.astype(np.int64), "doc": doc[row]}, _NODES)

    return rows.mapInArrow(children, "node bigint, doc bigint")


def shared_nodes(nodes: DataFrame) -> DataFrame:
    """(node, doc, count) of the nodes that hold more than one document."""
    nodes = common.stored(nodes)
    several = nodes.groupBy("node").count().filter("count > 1")
    shared = common.stored(nodes.join(several, "node").select("node", "doc", "count"))
    common.drop(nodes)
    return shared


def unsettled(several: DataFrame) -> DataFrame:
    """Nodes of over ``NODE`` documents whose rows would grow beyond twice their number in ``deal_large``."""
    parts = several.filter(F.col("count") > NODE).groupBy("node", "comp").agg(F.count(F.lit(1)).alias("members"))
    nodes = parts.groupBy("node").agg(F.sum("members").alias("count"), F.max("members").alias("main"))
    blocks = (F.col("count") / NODE + 1).cast("int")
    return common.stored(nodes.filter((F.col("count") - F.col("main")) * blocks > F.col("count")).select("node"))


def grow_trees(groups: DataFrame, members: DataFrame, labels: DataFrame, threshold: int) -> DataFrame:
    """(node, doc, count, comp) of the nodes with several components, branched until they are small or settled.

    ``members`` are the shared nodes of the first levels of the first trees.
    """
    grown, deepest, crowded, done = TREES[FIRST_LEVELS], FIRST_LEVELS, None, None
    while True:
        depth = FIRST_LEVELS
        while True:
            several = several_components(members, labels)
            large = unsettled(several)
            last = depth == DEPTH or large.isEmpty()
            small = several if last else several.join(large, "node", "left_anti")
            done = small if done is None else done.union(small)
            if last:
                break
            inner = several.join(large, "node", "left_semi").select("node", "doc").join(groups.select("doc", "signature"), "doc")
            if crowded is None:  # all later large nodes hold some of these documents only
                crowded = common.stored(groups.join(inner.select("doc"), "doc", "left_semi"))
            members, depth = shared_nodes(branch(inner, 1, threshold)), depth + 1
        deepest = max(deepest, depth)
        if grown == TREES[deepest]:
            return common.stored(done)
        more = range(grown, TREES[deepest])
        members, grown = shared_nodes(branch(crowded, FIRST_LEVELS, threshold, more)), TREES[deepest]


def nodes_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables that hold whole nodes, of batches in order of their nodes."""
    tokens.forget()
    held: pa.Table | None = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = t if held is None else pa.concat_tables([held, t]).combine_chunks()
        if not t.num_rows:
            continue
        node = t.column("node").to_numpy()
        cut = int(np.searchsorted(node, node[-1]))  # the last node may go on
        if cut:
            yield t.slice(0, cut)
        held = t.slice(cut)
    if held is not None and held.num_rows:
        yield held


def alike(t: pa.Table, threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows i, rows j of the same nodes and other components, and agreeing coordinates, where the sketches are alike.

    Row by row distance, so within one result neither i nor j repeats.
    """
    node, n, comp, copied = (t.column(c).to_numpy() for c in ("node", "n", "comp", "copied"))
    sketches = np.frombuffer(b"".join(t.column("sketch").to_pylist()), "<u8").reshape(-1, _WORDS)
    i = np.arange(len(node))
    for step in range(1, len(node)):
        i = i[: np.searchsorted(i, len(node) - step)]
        i = i[node[i] == node[i + step]]
        if not len(i):
            return
        k = i[(comp[i] != comp[i + step]) & ~(copied[i] & copied[i + step])]
        least, most = np.minimum(n[k], n[k + step]), np.maximum(n[k], n[k + step])
        k = k[100 * least >= threshold * most]
        x = sketches[k] ^ sketches[k + step]
        x = (x | (x >> np.uint64(1))) & np.uint64(0x5555555555555555)
        agree = (COORDINATES - np.bitwise_count(x).sum(axis=1)).astype(np.int32)
        good = agree >= AGREE
        if good.any():
            yield k[good], k[good] + step, agree[good]


def by_node(rows: DataFrame) -> DataFrame:
    """Rows of a node together."""
    return rows.repartition("node").sortWithinPartitions("node", "doc")


def best_candidates(rows: DataFrame, threshold: int) -> DataFrame:
    """Each document with the most similar one of another component, as distinct pairs (a, b), a < b."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in nodes_in(batches):
            doc = t.column("doc").to_numpy()
            best, other = np.zeros(len(doc), np.int32), np.zeros(len(doc), np.int64)
            for i, j, agree in alike(t, threshold):
                for a, b in ((i, j), (j, i)):
                    better = agree > best[a]
                    best[a[better]], other[a[better]] = agree[better], doc[b[better]]
            at = np.flatnonzero(best)
            yield common.batch({"a": doc[at], "b": other[at], "score": best[at]}, _PAIRS)

    found = by_node(rows).mapInArrow(compare, "a bigint, b bigint, score int")
    found = found.groupBy("a").agg(F.max_by("b", F.struct("score", -F.col("b"))).alias("b"))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def candidate_ties(rows: DataFrame, threshold: int) -> DataFrame:
    """Ties (a, b) of each document with candidates of another component to the first of those its node connects it to."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in nodes_in(batches):
            held, ties = [], 0
            for i, j, _ in alike(t, threshold):
                held.append((i, j))
                ties += len(i)
                if ties > TIES:  # to less than one for each row
                    held = [stars(*map(np.concatenate, zip(*held, strict=True)))]
                    ties = len(held[0][0])
            if held:
                doc = t.column("doc").to_numpy()
                at, first = stars(*map(np.concatenate, zip(*held, strict=True)))
                yield common.batch({"a": doc[at], "b": doc[first], "score": np.zeros(len(at), np.int32)}, _PAIRS)

    return by_node(rows).mapInArrow(compare, "a bigint, b bigint, score int").select("a", "b").distinct()


def clusters(ties: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, doc, count, comp) with one row per tied document; the node is its cluster."""
    docs = ties.select(F.col("a").alias("doc")).union(ties.select("b")).distinct()
    of = components(ties).select(F.col("a").alias("doc"), F.col("b").alias("cluster"))
    labels = labels.select(F.col("a").alias("doc"), F.col("b").alias("label"))
    rows = docs.join(of, "doc", "left").join(labels, "doc", "left")
    rows = common.stored(rows.select(F.coalesce("cluster", "doc").alias("node"), "doc", F.coalesce("label", "doc").alias("comp")))
    return rows.join(rows.groupBy("node").count(), "node").select("node", "doc", "count", "comp")


def settle(rows: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Links (a, b) that join the components within each cluster, each confirmed on the full sets.

    Candidates are tried from the most similar one on; those that links of the
    cluster connect already are left out, so it gives fewer links than documents.
    """

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in nodes_in(batches):
            doc, node, comp = (t.column(c).to_numpy() for c in ("doc", "node", "comp"))
            found = list(alike(t, threshold))
            if not found:
                continue
            i, j, agree = (np.concatenate(x) for x in zip(*found, strict=True))
            items, parent, links = t.column("items"), {}, []
            own: dict[int, np.ndarray] = {}

            def top(x: tuple, parent=parent) -> tuple:
                while (up := parent.get(x, x)) != x:
                    parent[x] = parent.get(up, up)
                    x = up
                return x

            def full(k: int, own=own, items=items) -> np.ndarray:
                if k not in own:
                    own[k] = np.frombuffer(items[k].as_py(), "<u8")
                return own[k]

            order = np.lexsort((j, i, -agree, node[i]))
            at = None
            for x, y in zip(i[order].tolist(), j[order].tolist(), strict=True):
                if at != node[x]:
                    at = node[x]
                    own.clear()
                u, v = top((at, comp[x])), top((at, comp[y]))
                if u != v and similar(full(x), full(y), threshold):
                    parent[u] = v
                    links.append((x, y))
            x, y = (np.array(c, np.int64) for c in (zip(*links, strict=True) if links else ((), ())))
            yield common.batch({"a": doc[x], "b": doc[y], "score": np.zeros(len(x), np.int32)}, _PAIRS)

    full_rows = rows.join(sets.select(F.col("doc_id").alias("doc"), "items"), "doc")
    return common.stored(by_node(full_rows).mapInArrow(check, "a bigint, b bigint, score int").select("a", "b").distinct())


def similar(x: np.ndarray, y: np.ndarray, threshold: int) -> bool:
    """Whether two full sets, as sorted distinct hashes, reach the threshold."""
    if len(x) > len(y):
        x, y = y, x
    if 100 * len(x) < threshold * len(y):
        return False
    at = np.searchsorted(y, x)
    both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
    return 100 * both >= threshold * (len(x) + len(y) - both)


def full_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(doc_id, items) of the wanted documents: all shingle hashes of the whole text, packed."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.forget()
        for b in batches:
            items = (common.shingles(common.word_hashes(t, common.SPACES), size) for t in b.column("text").to_pylist())
            packed = [i.astype("<u8").tobytes() for i in items]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(packed, pa.binary())], ["doc_id", "items"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return common.stored(docs.join(wanted, "doc_id", "left_semi").mapInArrow(sets, "doc_id bigint, items binary"))


def confirm(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True)
            keep = [similar(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), threshold) for x, y in both]
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    first = sets.select(F.col("doc_id").alias("a"), F.col("items").alias("x"))
    second = sets.select(F.col("doc_id").alias("b"), F.col("items").alias("y"))
    found = pairs.select("a", "b").join(first, "a").join(second, "b").select("a", "b", "x", "y")
    return common.stored(found.mapInArrow(check, "a bigint, b bigint").distinct())


def several_components(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, doc, count, comp) of the nodes that hold several components."""
    labels = labels.select(F.col("a").alias("doc"), F.col("b").alias("label"))
    rows = members.join(labels, "doc", "left").select("node", "doc", "count", F.coalesce("label", "doc").alias("comp"))
    rows = common.stored(rows)
    several = rows.groupBy("node").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2")).filter("c1 < c2")
    return common.stored(rows.join(several.select("node"), "node", "left_semi"))


def deal_large(rows: DataFrame, size: int, every: bool) -> DataFrame:
    """Deal the rows of nodes of over ``size`` documents into blocks of about that size.

    With ``every``, documents outside of the node's largest component go to every
    block, which then hold each pair across components.  Their rows in all blocks
    but the first are ``copied``; two such rows need no comparison.
    """
    first = F.lit(False).alias("copied")
    large = rows.filter(F.col("count") > size)
    if large.isEmpty():
        return rows.select("node", "doc", "comp", first)
    blocks = (F.col("count") / size + 1).cast("int")
    own = F.array(F.pmod(F.xxhash64("doc", "node"), blocks).cast("int"))
    copied = F.lit(False)
    if every:
        parts = large.groupBy("node", "comp").agg(F.count(F.lit(1)).alias("members"))
        main = parts.groupBy("node").agg(F.max_by("comp", F.struct("members", "comp")).alias("main"))
        large = large.join(main, "node")
        own = F.when(F.col("comp") == F.col("main"), own).otherwise(F.sequence(F.lit(0), blocks - 1))
        copied = (F.col("comp") != F.col("main")) & (F.col("block") > 0)
    dealt = large.withColumn("block", F.explode(own))
    dealt = dealt.select(F.xxhash64("node", "block").alias("node"), "doc", "comp", copied.alias("copied"))
    return rows.filter(F.col("count") <= size).select("node", "doc", "comp", first).union(dealt)


def link_documents(docs: DataFrame, size: int, threshold: int = THRESHOLD) -> DataFrame:
    """Near-duplicate components of ``docs`` (doc_id, text; other columns are not read).

    Returns one row per row of ``docs``: doc_id, n_shingles, component_id (the
    smallest doc_id reachable over links) and kept (doc_id is that one).  Documents
    without words, and null texts, have an empty set and no link.  Rows that repeat a
    doc_id with other texts count as one vertex.  A null doc_id is never linked, has
    a null component and is kept.  An empty table gives no row.
    """
    with common.scratch(docs.sparkSession):
        return common.stored(_linked(docs, size, threshold), keep=True)


def _linked(docs: DataFrame, size: int, threshold: int) -> DataFrame:
    sets = common.stored(document_sets(docs, size))
    known = sets.filter("doc_id IS NOT NULL AND n > 0")
    groups = common.stored(
        known.groupBy("f1", "f2", "n")
        .agg(F.min(F.struct("doc_id", "signature", "sketch")).alias("rep"))
        .select("f1", "f2", "n", F.col("rep.doc_id").alias("doc"), F.col("rep.signature").alias("signature"), F.col("rep.sketch").alias("sketch"))
    )
    sketches = groups.select("doc", "n", "sketch")

    first = shared_nodes(branch(groups, FIRST_LEVELS, threshold, range(FIRST_TREES)))
    links = docs.sparkSession.createDataFrame([], "a bigint, b bigint")
    labels, known = links, 0
    while True:  # each round links components to their best candidates, so few rounds leave few of them
        several = several_components(first, labels)
        found = common.stored(best_candidates(deal_large(several, NODE, False).join(sketches, "doc"), threshold))
        wanted = found.select(F.col("a").alias("doc_id")).union(found.select("b")).distinct()
        some = full_sets(docs, wanted, size)
        new = confirm(found, some, threshold)
        common.drop(several, found, some)
        more = new.count()
        if more:
            links = links.union(new)
            labels = components(links)
        known += more
        if more * MORE <= known:
            break
    others = shared_nodes(branch(groups, FIRST_LEVELS, threshold, range(FIRST_TREES, TREES[FIRST_LEVELS])))
    grown = grow_trees(groups, first.union(others), labels, threshold)
    common.drop(first, others)
    ties = common.stored(candidate_ties(deal_large(grown, NODE, True).join(sketches, "doc"), threshold))
    if not ties.isEmpty():
        tied = common.stored(deal_large(clusters(ties, labels), CLUSTER, True).join(sketches, "doc"))
        wanted = tied.select(F.col("doc").alias("doc_id")).distinct()
        some = full_sets(docs, wanted, size)
        labels = components(links.union(settle(tied, some, threshold)))

    out = sets.select("doc_id", "n", "f1", "f2").join(groups.select("f1", "f2", "n", "doc"), ["f1", "f2", "n"], "left")
    out = out.join(labels.select(F.col("a").alias("doc"), F.col("b").alias("least")), "doc", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc", "doc_id"))
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
    )


def keep_one(docs: DataFrame, size: int = 5, threshold: int = THRESHOLD) -> DataFrame:
    """The documents of ``docs`` without near-duplicates: the smallest doc_id of each component stays.

    Rows of one doc_id are one document, of which one row stays; rows without
    doc_id all stay.  The columns are those of ``docs``.
    """
    kept = link_documents(docs, size, threshold).filter("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("kept_id")).distinct()
    some = docs.filter("doc_id IS NOT NULL")
    some = some.join(kept, F.col("doc_id").cast("long") == F.col("kept_id"), "left_semi").dropDuplicates(["doc_id"])
    return some.unionByName(docs.filter("doc_id IS NULL"))


def op6_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all ``documents`` over two-word shingles."""
    return link_documents(common.table(spark, sf_dir, "documents"), 2)
