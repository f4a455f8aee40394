"""Whitening, runs and mixing against plain versions, and their defined cases."""

from __future__ import annotations

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from narrate_spark.llm import mixing, runs, whitening

SF = "/root/testdata/sf0.001"


# --- whitening -------------------------------------------------------------


def _vectors(count=300, width=12, seed=3):
    rng = np.random.default_rng(seed)
    rows = rng.normal(size=(count, width)) @ rng.normal(size=(width, width)) * 0.3 + rng.normal(size=width)
    return [(i, [float(x) for x in r], "clash", 5) for i, r in enumerate(rows)]


SCHEMA = "vec_id long, vector array<double>, component string, n int"


def _plain_whitening(vectors):
    x = np.floor(1024 * np.array(vectors)) + 100000
    centred = x - x.mean(0)
    values, columns = np.linalg.eigh(centred.T @ centred / len(x))
    return x, values[::-1], (centred @ columns[:, ::-1]), values.sum()


def test_factor_and_rotations_equal_the_eigenvalues():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 9, 40):
        a = rng.normal(size=(n, n)) * np.exp(2 * rng.normal(size=n))
        a = a @ a.T
        low = whitening.pivoted_cholesky(a)
        assert np.allclose(low @ low.T, a, rtol=0, atol=1e-12 * np.abs(a).max())
        values, columns = whitening.one_sided_jacobi(low)
        assert np.allclose(values, np.linalg.eigvalsh(a)[::-1][: len(values)], rtol=1e-7, atol=1e-12 * values[0])
        assert np.allclose(columns.T @ columns, np.eye(len(values)), atol=1e-12)
        assert np.allclose(a @ columns, columns * values, atol=1e-10 * values[0])
    assert whitening.pivoted_cholesky(np.zeros((3, 3))).shape == (3, 0)
    assert whitening.pivoted_cholesky(np.ones((3, 3))).shape == (3, 1)


def test_small_eigenvalues_keep_their_precision():
    scales = 10.0 ** -np.arange(0, 14, 2)
    low = np.tril(np.random.default_rng(2).normal(size=(7, 7)) * 0.1 + np.eye(7)) * scales
    values, _ = whitening.one_sided_jacobi(low)
    assert np.allclose(np.prod(values), np.prod(np.diag(low) ** 2), rtol=1e-12)


def test_whitening_equals_the_plain_one(spark):
    rows = _vectors()
    bad = [
        (1000, None, "x", 1),
        (1001, [None, *rows[0][1][1:]], "x", 1),
        (1002, [math.nan, *rows[0][1][1:]], "x", 1),
        (1003, [math.inf] * 12, "x", 1),
    ]
    repeated = [rows[0], (None, rows[1][1], None, None)]
    good = rows + repeated
    df = spark.createDataFrame(good + bad, SCHEMA).repartition(5)
    got = whitening.whiten_embeddings(df).collect()
    x, values, projected, trace = _plain_whitening([r[1] for r in good])
    assert len(got) == 8 * len(good) and {r["n"] for r in got} == {len(good)}
    sums = [int(s) for s in x.sum(0)]
    by_id = {}
    for r in got:
        by_id.setdefault(r["vec_id"], []).append(r)
    sign = [0] * 8
    for row, place in zip(good, range(len(good)), strict=True):
        found = sorted(by_id[row[0]], key=lambda r: r["component"])
        deviation = sum((len(good) * int(v) - s) ** 2 for v, s in zip(x[place], sums, strict=True))
        for r in found:
            k = r["component"] - 1
            plain = projected[place, k] / math.sqrt(values[k])
            sign[k] = sign[k] or (1 if plain * r["whitened"] > 0 else -1)
            assert r["whitened"] == pytest.approx(sign[k] * plain, abs=1e-9)
            assert r["deviation"] == deviation
            assert r["explained"] == pytest.approx(values[k] / trace, rel=1e-9)
            assert r["identity_error"] < 1e-9


@pytest.mark.parametrize("vectors", [[], [None], [[1.0, 2.0]], [[1.0, 2.0]] * 5, [[], []]])
def test_nothing_to_whiten(spark, vectors):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in enumerate(vectors)], SCHEMA)
    assert whitening.whiten_embeddings(df).collect() == []


def test_short_vectors_and_huge_entries(spark):
    vectors = [[1.0, 2.0, 0.5], [1.5], [1e300, -1e300], [0.25, 7.0, 1.0], []]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in enumerate(vectors)], SCHEMA)
    got = whitening.whiten_embeddings(df)
    assert {r["vec_id"] for r in got.collect()} == set(range(5))
    assert {r["deviation"] for r in got.where("vec_id = 2").collect()} == {None}
    # the components of a rank below eight
    assert got.agg(F.max("component")).first()[0] <= 3


# --- runs ------------------------------------------------------------------


def _plain_runs(w, least, power):
    n, out = len(w), []
    for q in range(1, n // power + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            size = j + q - i
            part = w[i : i + size]
            if size >= max(least, power * q) and not any(part[r:] == part[: size - r] for r in range(1, q)):
                out.append((i, size, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_lyndon_array_equals_the_next_smaller_suffix():
    rnd = random.Random(1)
    for _ in range(800):
        x = [rnd.randrange(rnd.randint(1, 4)) for _ in range(rnd.randint(1, 24))]
        plain = [next(j - i for j in range(i + 1, len(x) + 1) if x[j:] < x[i:]) for i in range(len(x))]
        assert runs.lyndon_array(np.array([-1, *x]))[1:].tolist() == plain


def _repetitive(rnd):
    kinds, w = rnd.randint(1, 4), []
    for _ in range(rnd.randint(0, 12)):
        unit = [rnd.randrange(kinds) for _ in range(rnd.randint(1, 4))]
        w += (unit * rnd.randint(1, 7))[: rnd.randint(1, 30)]
    return [str(x).encode() for x in w]


@pytest.mark.parametrize("least,power", [(6, 4), (2, 2), (3, 3), (1, 5)])
def test_runs_equal_the_plain_ones(least, power):
    rnd = random.Random(power)
    for _ in range(400):
        docs = [_repetitive(rnd) for _ in range(rnd.randint(1, 4))]
        assert runs.find_runs(docs, least, power) == [_plain_runs(d, least, power) for d in docs]


def _looped(doc, words):
    h, n = zlib.crc32(str(doc).encode()), len(words)
    if doc is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def test_op12_on_a_table(spark, tmp_path):
    rnd = random.Random(9)
    rows = [(i, b" ".join(_repetitive(rnd)).decode()) for i in range(120)]
    rows += [(i, " ".join(f"w{rnd.randrange(300)}" for _ in range(rnd.randint(1, 200)))) for i in range(200, 320)]
    rows += [(400, None), (401, ""), (402, " \n\t "), (None, "a " * 9), (403, "x y\x1c " * 7 + "Ünï 中"), (403, "again")]
    rows += [(404, "long " * 30_000), (405, "ab " * 5 + "z" * 200_000 + " ab" * 6), (403, "again")]
    df = spark.createDataFrame([(d, t, 1, "clash") for d, t in rows], "doc_id long, text string, runs int, best string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = runs.op12_runs(spark, str(tmp_path)).collect()
    wanted = []
    for doc, text in rows:
        words = _looped(doc, (text or "").encode().split())
        found = _plain_runs(words, 6, 4) if len(words) < 5000 else [(0, len(words), 1)]
        drop = {k for s, n, q in found for k in range(s + q, s + n)}
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
        left = b" ".join(w for k, w in enumerate(words) if k not in drop)
        wanted.append(
            (doc, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2])
            + (hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(left).hexdigest())
        )
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, wanted))
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert list(got[0].asDict()) == names


def test_collapsed_text_and_empty_table(spark):
    df = spark.createDataFrame([(1, "so it goes " * 4 + "on"), (2, "so it")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in runs.collapse_runs(df).collect()}
    assert got[1]["collapsed"] == "so it goes on" and got[1]["runs"][0].asDict() == {"start": 0, "length": 12, "period": 3}
    assert got[2]["collapsed"] == "so it" and got[2]["runs"] == [] and got[2]["n_words"] == 2
    assert runs.collapse_runs(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        runs.collapse_runs(df, min_exponent=1)


# --- mixing ----------------------------------------------------------------


def _plain_targets(sizes, weights, most=3):
    held, total = {}, sum(sizes.values())
    while True:
        free = [s for s in sizes if s not in held]
        share = (total - sum(held.values())) / (sum(weights[s] for s in free) or 1)
        over = [s for s in free if share * weights[s] > most * sizes[s]]
        if not over:
            return held | {s: share * weights[s] for s in free}
        held |= {s: most * sizes[s] for s in over}


def _mixed(spark):
    rnd = random.Random(4)
    rows = [(i, "w " * rnd.randint(0, 40), "hot", 1, 2) for i in range(300)]
    rows += [(1000 + i, " ".join("wörd" for _ in range(rnd.randint(1, 90))), rnd.choice(["a", "Z", "é", "ab", None, ""]), 1, 2) for i in range(200)]
    rows += [(2000, "tiny", "b", 1, 2), (2001, None, "none", 1, 2), (2001, "", "none", 1, 2), (2002, "x " * 50_000, "one", 1, 2)]
    rows += [(None, "the same row", "a", 1, 2)] * 40 + [(2003, None, None, 1, 2)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string, size int, before int")


def test_mixing(spark):
    rows, df = _mixed(spark)
    got = mixing.place_documents(df.repartition(7))
    got = got.withColumn("copies", mixing.copies(got)).collect()
    assert len(got) == len(rows)
    size = {}
    for _, t, s, *_ in rows:
        size[s] = size.get(s, 0) + len((t or "").encode().split())
    order = sorted(size, key=lambda s: (s is None, s or ""))
    targets = _plain_targets(size, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)})
    assert sum(targets.values()) == pytest.approx(sum(size.values()))
    taken, times = {}, []
    for r in got:
        assert r["source_size"] == size[r["source"]] and r["target"] == pytest.approx(targets[r["source"]])
        words = sum(c["words"] for c in r["copies"])
        assert words <= 3 * r["size"] and all(0 <= c["time"] <= 1 for c in r["copies"])
        taken[r["source"]] = taken.get(r["source"], 0) + words
        times += [(r["source"], c["epoch"], r["before"], c["time"]) for c in r["copies"]]
    for s, words in taken.items():
        assert abs(words - targets[s]) <= 0.5
    # within a source, copies are due in the order in which they stand
    times.sort(key=lambda t: (t[0] is None, t[0] or "", t[1], t[2]))
    for x, y in zip(times, times[1:], strict=False):
        assert x[0] != y[0] or x[3] <= y[3]


def test_mixing_reruns_agree_and_are_sorted(spark):
    _, df = _mixed(spark)
    first = mixing.training_order(df.repartition(3)).collect()
    again = mixing.training_order(df.repartition(8)).collect()
    assert [r["time"] for r in first] == sorted(r["time"] for r in first)
    assert sorted(map(str, first)) == sorted(map(str, again))


def test_mixing_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.training_order(empty).collect() == [] and mixing.place_documents(empty).collect() == []
    blank = spark.createDataFrame([(1, None, None), (2, " ", "a")], "doc_id long, text string, source string")
    assert {(r["doc_id"], r["size"], r["target"]) for r in mixing.place_documents(blank).collect()} == {(1, 0, 0.0), (2, 0, 0.0)}


@pytest.mark.parametrize("schedule", [*mixing.SCHEDULES, ((0.0, 0.0), (0.5, 4.0), (1.0, 0.0)), ((0.0, 3.0), (0.25, 0.0), (0.5, 0.0), (1.0, 1.0))])
def test_time_inverts_the_integral(spark, schedule):
    sums = mixing.integral(schedule)
    shares = spark.range(101).select((F.col("id") / 100).alias("s"))
    for r in shares.select("s", mixing.time_of(F.col("s"), schedule).alias("t")).collect():
        part, t = 0.0, r["t"]
        for (a, w), (b, v) in zip(schedule, schedule[1:], strict=False):
            x = min(max(t - a, 0.0), b - a)
            part += w * x + (v - w) / (b - a) * x * x / 2
        assert part == pytest.approx(r["s"] * sums[-1], abs=1e-9)


def test_op11_to_op13_on_the_given_tables(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet").count()
    docs = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert whitening.op11_whitening(spark, SF).count() == 8 * vectors
    mixed = mixing.op13_mixing(spark, SF)
    assert mixed.count() == docs
    assert {"doc_id", "size", "source_size", "target", "taken"} <= set(mixed.columns)
