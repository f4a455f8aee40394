"""The operators against brute force on small fixtures, and their defined cases."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from narrate_spark.llm import (
    chat,
    common,
    components,
    decontaminate,
    licenses,
    near_dedup,
    packing,
    quality,
    queries,
    search,
    token_files,
    tokens,
    url_filter,
    warc,
)

SF = "/root/testdata/sf0.001"
WORDS = [f"w{i}" for i in range(60)]


def _documents(seed: int = 1):
    """Documents with near copies, exact copies, nulls, empty and repeated rows, and a very long text."""
    rnd = random.Random(seed)
    rows = [(0, None), (1, ""), (2, " \n\t"), (3, "One"), (4, "one"), (None, "a b c"), (None, None)]
    for i in range(10, 40):
        base = [rnd.choice(WORDS) for _ in range(rnd.randint(2, 80))]
        rows.append((i, " ".join(base)))
        for j in range(rnd.randint(0, 3)):
            near = list(base)
            for _ in range(rnd.randint(0, 2 + len(near) // 12)):
                near[rnd.randrange(len(near))] = rnd.choice(WORDS)
            rows.append((100 * i + j, " ".join(near).upper() if j else " ".join(near)))
    rows += [rows[8], (9000, "long " * 40_000), (9001, "x" * 300_000), (9002, "Ünï 中文 😀 don't  stop\n\n\tnow ")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(d, t, d, "extra", 7) for d, t in _documents()]
    return spark.createDataFrame(rows, "doc_id long, text string, node long, sketch string, n int")


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def _set(text, size):
    w = (text or "").encode().lower().split()
    return {tuple(w)} if 0 < len(w) < size else set(zip(*(w[i:] for i in range(size)), strict=False))


@pytest.mark.parametrize("node", [1000, 2])
def test_near_dedup(spark, docs, monkeypatch, node):
    monkeypatch.setattr(near_dedup, "NODE", node)  # 2: every node is branched and dealt
    got = near_dedup.link_documents(docs, 2).collect()
    rows = _documents()
    assert len(got) == len(rows)
    sets = {d: _set(t, 2) for d, t in rows if d is not None}
    up = {d: d for d in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                up[y] = x
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), top(r["doc_id"]))
            assert r["kept"] == (r["component_id"] == r["doc_id"])


def test_near_dedup_of_pairs_at_the_threshold(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "NODE", 1)  # every shared node is branched to the last level
    rows = []
    for i in range(1000):
        both = [f"s{i}_{k}" for k in range(89)]
        rows += [(2 * i + side, " ".join(both + [f"d{i}_{side}_{k}" for k in range(11)])) for side in (0, 1)]
    got = near_dedup.link_documents(spark.createDataFrame(rows, "doc_id long, text string"), 1).collect()
    missed = [r["doc_id"] for r in got if r["component_id"] != r["doc_id"] // 2 * 2]
    assert missed == []


def test_near_dedup_of_a_group_below_the_threshold_is_not_branched(spark, monkeypatch):
    branch = near_dedup.branch

    def first_levels_only(rows, levels, threshold, trees=range(0)):
        assert "node" not in rows.columns  # nodes of this size are compared
        return branch(rows, levels, threshold, trees)

    monkeypatch.setattr(near_dedup, "branch", first_levels_only)
    both = " ".join(f"s{k}" for k in range(82))  # any two share 82 of 118 words
    rows = [(i, f"{both} " + " ".join(f"d{i}_{k}" for k in range(18))) for i in range(2000)]
    rows += [(2000 + i, f"{text} more") for i, text in rows[:2]]
    got = near_dedup.link_documents(spark.createDataFrame(rows, "doc_id long, text string"), 1).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: i % 2000 for i in range(2002)}


def test_ties_are_contracted_when_there_are_many(spark, monkeypatch):
    sketch = bytes(64)
    rows = [(node, doc, doc, False, 10, sketch) for node in (1, 2) for doc in range(40 * node, 40 * node + 30)]
    df = spark.createDataFrame(rows, "node long, doc long, comp long, copied boolean, n long, sketch binary")
    want = {(doc, 40 * node) for node, doc, *_ in rows if doc != 40 * node}
    for most in (1 << 20, 5):
        monkeypatch.setattr(near_dedup, "TIES", most)
        assert {(r["a"], r["b"]) for r in near_dedup.candidate_ties(df, 80).collect()} == want


def test_stages_without_tokens_free_the_encoders():
    before = tokens._ENCODERS.copy()
    try:
        tokens._ENCODERS["a"] = object()
        assert list(near_dedup.nodes_in(iter([]))) == [] and not tokens._ENCODERS
    finally:
        tokens._ENCODERS.update(before)


def test_near_dedup_without_first_candidates(spark, monkeypatch):
    found = near_dedup.best_candidates
    monkeypatch.setattr(near_dedup, "best_candidates", lambda rows, threshold: found(rows, threshold).filter("a < 0"))
    rows = [(i, " ".join(f"w{k}" for k in range(100) if k != i)) for i in range(3)]
    got = near_dedup.link_documents(spark.createDataFrame(rows, "doc_id long, text string"), 1).collect()
    assert {r["component_id"] for r in got} == {0}


def test_keep_one_keeps_columns(spark, docs):
    got = near_dedup.keep_one(docs, 2)
    assert got.columns == docs.columns
    ids = [r["doc_id"] for r in got.collect()]
    assert len([i for i in ids if i is not None]) == len({i for i in ids if i is not None})
    assert ids.count(None) == 2 and 4 not in ids and {0, 1, 2, 3} <= set(ids)


def test_components_over_several_shares(spark, monkeypatch):
    monkeypatch.setattr(components, "SHARE", 7)
    edges = [(i, i + 3) for i in range(0, 60, 3)] + [(1, k) for k in range(100, 130)] + [(5, 5), (129, 4), (4, 129)]
    rows = spark.createDataFrame(edges, "a long, b long").repartition(6)
    got = {r["a"]: r["b"] for r in components.components(rows).collect()}
    assert got == {i: 0 for i in range(3, 63, 3)} | {k: 1 for k in [4, *range(100, 130)]}
    assert components.components(rows.filter("a < 0")).isEmpty()


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, i) for i in range(1001, 1200)] + [(5, 5)]
    got = {r["a"]: r["b"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(1, 61), 0), **dict.fromkeys(range(1001, 1200), 1000)}


@pytest.mark.parametrize("name,spaced", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_encoder_equals_the_tokenizer(name, spaced):
    rnd = random.Random(5)
    parts = ["a", "B", " ", "  ", "\n", "\n\n", "'s", "é", "1", "\t", "\x85", "\x1c", "\x01", "\x00", "<|endoftext|>", "Σ", "中", "\u0301", "\u3000", "😀"]
    e = tokens.Encoder(tokens.public_path(name), spaced, 200)
    texts = [None, "", *("".join(rnd.choice(parts) for _ in range(rnd.randint(1, 12))) for _ in range(1500))]
    for at in range(0, len(texts), 50):
        for t, raw in zip(texts[at : at + 50], e.encode(texts[at : at + 50]), strict=True):
            assert raw == (e.plain(t).tobytes() if t else b""), repr(t)


def test_words_and_marks_go_to_the_merges_at_once():
    rnd = random.Random(6)
    e = tokens.Encoder(tokens.public_path("byte_bpe_50k.json"), True, 3000)
    letters = "etaoinshrETAX" + "ªµºÀÖØöøßéſǅʯ"
    marks = ["", "", ".", ",", "###", "$$$", "...", "?!", "_", "-", "\\", "`~", '"', "[]"]
    learnt, learn = [], e.learn
    e.learn = lambda pieces: (learnt.extend(pieces), learn(pieces))

    def word():
        return "".join(rnd.choices(letters, k=rnd.randint(1, 9))) + rnd.choice(marks)

    texts = [rnd.choice(["", " "]) + "".join(word() + rnd.choice([" ", " ", "\n"]) for _ in range(40)) + word() for _ in range(500)]
    for at in range(0, len(texts), 25):
        for t, raw in zip(texts[at : at + 25], e.encode(texts[at : at + 25]), strict=True):
            assert raw == e.plain(t).tobytes(), repr(t)
    assert all(p.strip("\x00").isspace() for p in learnt)
    mixed = ["it's l'été, 12 an-ti", "über中 a1 x's", "ab\u0301 ×÷ ʰa b²"]
    assert e.encode(mixed) == [e.plain(t).tobytes() for t in mixed]
    assert "12" in learnt and "it's" not in e.later


def test_elias_fano_selects():
    for values in ([], [0], [0, 0, 0], [5, 5, 900_000], sorted(random.Random(2).choices(range(10**7), k=3000))):
        own = token_files.EliasFano.of(np.array(values, np.int64))
        back, _ = token_files.EliasFano.read(own.to_bytes(), 0)
        assert back.values().tolist() == values and [back.select(i) for i in range(len(values))] == values


@pytest.mark.parametrize("file_ids", [token_files.FILE_IDS, 50])
def test_token_files(spark, docs, file_ids):
    got = token_files.read_token_files(token_files.write_token_files(docs, file_ids=file_ids)).orderBy("start").collect()
    e, start = tokens.encoder(tokens.public_path("byte_bpe_50k.json"), True), 0
    rows = sorted(_documents(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    assert len(got) == len(rows)
    for (doc, text), r in zip(rows, got, strict=True):
        ids = np.append(e.plain(text or ""), 2).astype("<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (doc, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_packing(spark, docs):
    got = packing.pack_documents(docs, window=128).collect()
    e = tokens.encoder(tokens.public_path("word_bpe_49k.json"), False)
    want = sorted((str(d), zlib.crc32(np.append(e.plain(t or ""), 2).astype("<u4")[at : at + 128].tobytes()))
                  for d, t in _documents() for at in range(0, len(e.plain(t or "")) + 1, 128))
    assert sorted((str(r["doc_id"]), r["ids_crc32"]) for r in got) == want
    rows: dict = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == rows.get(r["sequence_id"], 0)
        rows[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(rows.values()) <= 128


def test_best_fit_takes_the_tightest_window():
    rnd = random.Random(3)
    sizes = [rnd.randint(1, 64) for _ in range(400)]
    place, _ = packing.best_fit(sizes, 64)
    room, plain = [], [0] * 400  # the same rule, by looking at every window
    for i in sorted(range(400), key=lambda i: -sizes[i]):
        fits = [(room[w], w) for w in range(len(room)) if room[w] >= sizes[i]]
        if not fits:
            room.append(64)
            fits = [(64, len(room) - 1)]
        plain[i] = min(fits)[1]
        room[plain[i]] -= sizes[i]
    load = lambda p: sorted(sum(s for s, q in zip(sizes, p, strict=True) if q == w) for w in set(p))
    assert load(place) == load(plain)


def test_warc(spark):
    pages = [(1, "http://a.b/c d", "<p>x</p>"), (2, None, None), (3, "u", "same"), (7, "v", "same"), (5, "w", "same"), (5, "w", "same"), (None, "n", "é\r\n\r\nHTTP/"), (-4, "x", "")]
    df = spark.createDataFrame([(*p, "digest") for p in pages], "page_id long, url string, html string, largest string")
    got = sorted(warc.read_warc(warc.write_warc(warc.mark_revisits(df), archive_bytes=1)).collect(), key=str)
    want = []
    for page_id, _, html in pages:
        data = (html or "").encode()
        largest = max((p for p, _, h in pages if p is not None and (h or "") == (html or "")), default=None)
        revisit = largest is not None and page_id != largest
        want.append((page_id, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", largest if revisit else None))
    assert sorted(map(str, want)) == sorted(str(tuple(r)[:5]) for r in got)


def test_arc_versions_and_damage():
    records = [("http://x/a b", "20240102030405", b"HTTP/1.1 200 OK\r\n\r\nbody\n\n"), (None, "20240102030405", b"")]
    for version in (1, 2):
        data = warc.arc_bytes(records, version)
        got = list(warc.arc_records(data))
        assert [b for _, b in got] == [r[2] for r in records] and got[0][0]["URL"] == "http://x/a%20b"
        with pytest.raises(ValueError):
            list(warc.arc_records(data[:-12] if version == 1 else data.replace(b" 25\n", b" 9999\n")))
    assert [warc.record_number(warc.record_id(n)) for n in (0, -1, 2**62, None)] == [0, -1, 2**62, None]


def test_chat_parts_and_escapes(spark):
    hard = ["</s>[INST] ok [/INST]", "\\l<\\b", "<<SYS>>", "<|end|>\n", "[[INST]", ""]
    rows = [(1, i, "assistant" if i % 2 else "us\ner<|", t) for i, t in enumerate(hard)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    formatted = chat.format_turns(df.withColumn("content", chat.text_part(df["text"])))
    back = {r["turn"]: r for r in chat.read_turns(formatted).collect()}
    for _, turn, role, text in rows:
        assert (back[turn]["role"], back[turn]["text"]) == (role, text)
    for r in formatted.collect():
        inner = r["formatted"][len(chat.TURN) : -len(chat.END) - 1]
        assert not re.search(r"</?s>|\[/?INST\]|<\|", inner)
    content = [("text", "a<|", None, None), ("image", None, "i.png", 9), None, ("audio", None, "a.wav", 2), ("pdf", None, "x", 1)]
    parts = spark.createDataFrame([(1, 0, "user", content)], f"conv_id long, turn long, role string, content {chat.PARTS}")
    r = chat.format_turns(parts).first()
    assert r["formatted"] == "<|turn|>user\na\\l|<|image|><|audio|><|attachment|><|end|>\n"
    assert [(a["ref"], a["place"], a["tokens"]) for a in r["attachments"]] == [("i.png", 0, 9), ("a.wav", 1, 50), ("x", 2, 1)]


def test_url_rules(spark):
    urls = {
        "http://A.ORG/x": ("a.org", "/x", "org/", "allow"),
        "http://m.example.org/es/1?x": ("m.example.org", "/es/1", "example.org/es/", "block"),
        "http://example.org/en/12": ("example.org", "/en/12", "example.org/en/1", "block"),
        "https://a.com/fr/": ("a.com", "/fr/", "com/fr/", "allow"),
        "x://b.com/de/#q": ("b.com", "/de/", "com/de/", "block"),
        "http://xorg/": ("xorg", "/", None, None),
        "http://a.org": ("a.org", "", None, None),
        "nothing": ("", "", None, None),
        "a://b://c/d": ("b:", "//c/d", None, None),
    }
    rows = [(i, u, "<b>free</b> casino words") for i, u in enumerate(urls)] + [(99, None, None), (None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in url_filter.filter_urls(df).collect()}
    assert len(got) == len(rows) - 0
    for i, (host, path, rule, verdict) in enumerate(urls.values()):
        r = got[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == verdict or verdict is None and r["verdict"] in ("allow", "block")
    assert url_filter.viterbi("freecasino", [(0, 4, 5), (4, 6, 5)], 100) == ["free", "casino"]
    assert url_filter.filter_urls(df.limit(0)).count() == 0


@pytest.mark.parametrize("hot", [1000, 5])
def test_url_scores_without_a_rule(spark, monkeypatch, hot):
    monkeypatch.setattr(url_filter, "HOT", hot, raising=False)
    rnd = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda: "".join(rnd.choices(letters, k=8))
    shared = [word() for _ in range(40)] + ["casino", "poker"]
    urls = [f"http://host.net/{'/'.join([rnd.choice(shared) for _ in range(3)] + [word() for _ in range(20)])}" for _ in range(300)]
    rows = [(i % 290, u, "host net") for i, u in enumerate(urls)] + [(None, None, None)]
    got = url_filter.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    pages = [[*r["words"], *("/" + t for t in re.findall("[a-z]+", r["path"]))] for r in got]
    bad = [any(t.lstrip("/") in url_filter.SEEDS for t in p) for p in pages]
    n = {c: Counter(t for p, b in zip(pages, bad, strict=True) if b == c for t in p) for c in (False, True)}
    size = len(n[False] | n[True])
    assert len(got) == len(rows) and size > 5000
    odds = {t: math.log((n[True][t] + 1) / (n[True].total() + size)) - math.log((n[False][t] + 1) / (n[False].total() + size)) for t in n[False] | n[True]}
    for r, p in zip(got, pages, strict=True):
        x = math.log((sum(bad) + 1) / (len(bad) - sum(bad) + 1)) + sum(odds[t] for t in p)
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-x)), abs=1e-9)
        assert r["rule"] is None and r["verdict"] == ("block" if x >= 0 else "allow")


def test_warc_of_many_pages_without_html(spark, monkeypatch):
    monkeypatch.setattr(warc, "CONVERT_BYTES", 50_000)
    pages = spark.range(20_000).selectExpr("id AS page_id", "CAST(NULL AS STRING) AS url", "CAST(NULL AS STRING) AS html")
    files = warc.write_warc(warc.mark_revisits(pages).coalesce(1), archive_bytes=50_000)
    got = [r["records"] for r in files.collect()]
    assert sum(got) == 20_000 and max(got) < 1000
    assert warc.read_warc(files).agg({"page_id": "max"}).first()[0] == 19_999


def test_licenses(spark):
    texts = [
        "Licensed under the Apache License, Version 2.0",
        "GNU GNU General Public License! gnu general public\nLicense",
        "mit licenses cc-by CC BY-NC 4.0",
        None,
        "",
        "the licence of nothing " * 3000 + "MIT License",
    ]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, words string")
    got = {r["doc_id"]: r for r in licenses.scan_licenses(df).collect()}
    pattern = licenses.WORD.replace("\\x", "\\x")
    for i, t in enumerate(texts):
        w = re.findall(pattern, (t or "").lower())
        at = [(j, label) for p, label in licenses.PHRASES for j in range(len(w)) if w[j : j + len(p.split())] == p.split()]
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (
            len(w), len(at), min((j for j, _ in at), default=None), max((j for j, _ in at), default=None), ",".join(sorted({x for _, x in at})),
        )
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert got[0]["labels"] == "apache,apache-notice" and got[0]["score"] == 1.0
    assert licenses.scan_licenses(df.limit(0)).count() == 0


def test_licenses_equal_the_plain_scores(spark):
    rnd = random.Random(8)
    pool = [w for _, t, _ in licenses.TEMPLATES for w in t.split()]
    texts = []
    for _ in range(150):
        parts = []
        for _ in range(rnd.randint(1, 4)):
            words = rnd.choice(licenses.TEMPLATES)[1].split()
            parts += [rnd.choice(pool) if rnd.random() < 0.1 else w for w in words] + [rnd.choice(["x", "y", "the"])] * rnd.randint(0, 2)
        texts.append(" ".join(parts[rnd.randint(0, 3) :]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    weights = licenses.word_weights(common.stored(licenses.word_index(df)))
    got = {r["doc_id"]: r for r in licenses.scan_licenses(df).collect()}
    for i, t in enumerate(texts):
        w = re.findall(licenses.WORD, t.lower())
        scores = {}
        for label, text, key in licenses.TEMPLATES:
            words, keys = text.split(), key.split()
            key_at = next(k for k in range(len(words)) if words[k : k + len(keys)] == keys)
            starts = [k - key_at for k in range(len(w)) if w[k : k + len(keys)] == keys]
            met = [sum(weights[x] for j, x in enumerate(words) if 0 <= s + j < len(w) and w[s + j] == x) for s in starts]
            scores[label] = max(met, default=0.0) / sum(weights[x] for x in words)
        assert got[i]["score"] == pytest.approx(max(scores.values()), abs=1e-8)
        base = {label for p, label in licenses.PHRASES if f" {p} " in f" {' '.join(w)} "}
        sure = {x for x, v in scores.items() if v >= licenses.MIN_SCORE + 1e-9}
        maybe = {x for x, v in scores.items() if v >= licenses.MIN_SCORE - 1e-9}
        assert base | sure <= set(filter(None, got[i]["labels"].split(","))) <= base | maybe


def test_licenses_of_a_text_with_very_many_places(spark):
    def seconds(times):
        df = spark.createDataFrame([(1, "mit license " * times)], "doc_id long, text string")
        start = time.perf_counter()
        row = licenses.scan_licenses(df).first()
        assert row["n_base"] == times and row["last_word"] == 2 * times - 2
        return time.perf_counter() - start

    seconds(10)
    assert seconds(32_000) < 20


def test_licenses_of_a_file_with_three(spark):
    apache = "Licensed under the Apache License, Version 2.0"
    whole = {label: text for label, text, _ in licenses.TEMPLATES}
    three = f"{whole['mit-text']}. And: {whole['bsd-text']}; {apache}"
    rows = [(0, three), (1, " / ".join(whole.values())), *((i, apache) for i in range(10, 40))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in licenses.scan_licenses(df).collect()}
    assert got[0] == "apache,apache-notice,bsd-text,mit-text"
    assert set(whole) <= set(got[1].split(","))
    assert got[10] == "apache,apache-notice"


def test_decontamination(spark, docs):
    item = [f"i{i}" for i in range(60)]
    near = item[:30] + ["zz"] + item[31:]  # five of 56 shingles differ
    far = [w if i % 4 else "zz" for i, w in enumerate(item)]
    rows = [(1, " ".join(["w"] * 5000 + item)), (2, ", ".join(near).upper()), (3, " ".join(far)), (4, None), (5, "only four short words"), (6, "and only four short words")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, item_id long")
    items = spark.createDataFrame([(10, " ".join(item)), (11, None), (12, ""), (13, "Only four, short words")], "item_id long, text string")
    for size in (decontaminate.BLOCK_BYTES, 50):
        got = sorted((r["doc_id"], r["item_id"], r["shared"]) for r in decontaminate.find_contaminated(df, items, size).collect())
        # a short item is also found inside a longer document
        assert got == [(1, 10, 56), (2, 10, 51), (5, 13, 1), (6, 13, 1)]
    clean = decontaminate.drop_contaminated(df, items)
    assert clean.columns == df.columns and sorted(r["doc_id"] for r in clean.collect()) == [3, 4]
    assert decontaminate.find_contaminated(df, items.limit(0)).count() == 0


def test_short_items_inside_long_documents(spark):
    con = duckdb.connect()
    rnd = random.Random(6)
    docs = [(i, " ".join(rnd.choice("a b c d e f".split()) for _ in range(rnd.randint(0, 30)))) for i in range(80)] + [(80, None), (81, "a, B")]
    items = [(i, " ".join(rnd.choice("a b c d e f".split()) for _ in range(i % 7))) for i in range(40)] + [(40, None), (41, "A b"), (41, "A b")]
    for name, rows, key in (("documents", docs, "doc_id"), ("benchmark", items, "item_id")):
        con.execute(f"CREATE TABLE {name} ({key} BIGINT, text VARCHAR)")
        con.executemany(f"INSERT INTO {name} VALUES (?, ?)", rows)
    found = decontaminate.find_contaminated(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    )
    got = {tuple(r) for r in found.select("doc_id", "item_id").collect()}
    plain = set()
    for d, t in docs:
        w = re.findall(r"[a-z]+", (t or "").lower())
        for k, u in items:
            v = re.findall(r"[a-z]+", (u or "").lower())
            size = min(5, len(v))
            own = {tuple(v[i : i + size]) for i in range(len(v) - size + 1)} if v else set()
            both = own & {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}
            if own and 100 * len(both) >= 80 * len(own):
                plain.add((d, k))
    assert got == plain and len(plain) > 100
    unique = [i for i in items if i[0] != 41]
    con.execute("DELETE FROM benchmark WHERE item_id = 41")
    again = decontaminate.find_contaminated(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(unique, "item_id long, text string")
    )
    sql = con.execute(decontaminate.ORACLE_SQL).fetchall()
    assert sorted((r["doc_id"], r["item_id"], r["shared"]) for r in again.collect()) == sorted(r[:3] for r in sql)


def test_search_and_ties(spark, docs, monkeypatch):
    monkeypatch.setattr(search, "SHARD_DOCS", 16)
    monkeypatch.setattr(search, "BLOCK_DOCS", 4)
    asked = docs.filter("doc_id IN (10, 11, 1000, 0, 1)").select(docs["doc_id"].alias("query_id"), "text")
    got = search.search(docs, asked, 5).collect()
    rows = _documents()
    words = [[w for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())] for _, t in rows]
    average = sum(map(len, words)) / len(rows)
    for q in {r["query_id"] for r in got}:
        asked_words = {w for (d, _), own in zip(rows, words, strict=True) if d == q for w in own}
        best = []
        for (d, _), own in zip(rows, words, strict=True):
            units = 0
            for w in asked_words & set(own):
                df, tf = sum(w in set(o) for o in words), own.count(w)
                idf = np.log(1 + (len(rows) - df + 0.5) / (df + 0.5))
                units += int(np.floor(idf * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(own) / average))) * search.UNIT + 0.5))
            if units:
                best.append((-units, d is not None, d or 0))
        want = [-u / search.UNIT for u, _, _ in sorted(best)[:5]]
        mine = [r["score"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q]
        assert np.allclose(mine, want, atol=3 / search.UNIT)
    assert {r["query_id"] for r in got} == {10, 11, 1000} & {d for d, _ in rows}


def test_search_shard_against_all_postings():
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{w}" for w in rng.zipf(1.4, rng.integers(0, 60)) % 300) for _ in range(200)]
    texts += texts[:40] + [None, ""]
    counts = [search.term_counts(t) for t in texts]
    average = sum(n.sum() for _, n in counts) / len(texts)
    shard = search.Shard.from_bytes(search.Shard.build([*range(len(texts) - 1), None], counts).to_bytes())
    shard.weigh(average, 8)
    asked = list(range(0, 240, 7))
    terms = np.concatenate([counts[q][0] for q in asked])
    number = np.repeat(np.arange(len(asked)), [len(counts[q][0]) for q in asked])
    df = {t: sum(t in set(own.tolist()) for own, _ in counts) for t in set(terms.tolist())}
    idf = np.array([np.log(1 + (len(texts) - df[t] + 0.5) / (df[t] + 0.5)) for t in terms.tolist()])
    for floor in (0, 4 * search.UNIT):
        least = np.full(len(asked), float(floor))
        query, place, units = shard.search(number, terms, idf, 5, least)
        for i, _ in enumerate(asked):
            weight = dict(zip(terms[number == i].tolist(), idf[number == i].tolist(), strict=True))
            want = []
            for own, n in counts:
                part = n * (search.K1 + 1) / (n + search.K1 * (1 - search.B + search.B * (n.sum() / average)))
                want.append(sum(int(np.floor(weight[t] * p * search.UNIT + 0.5)) for t, p in zip(own.tolist(), part.tolist(), strict=True) if t in weight))
            kth = max(sorted(want)[-5], floor, 1)
            assert {d: u for d, u in enumerate(want) if u >= kth} == dict(zip(place[query == i].tolist(), units[query == i].tolist(), strict=True))


@pytest.mark.parametrize("frequent", [0, 0.004, 2])
def test_search_with_frequent_terms_as_a_matrix(monkeypatch, frequent):
    monkeypatch.setattr(search, "FREQUENT", frequent)
    monkeypatch.setattr(search, "STEP_PAIRS", 2000)
    monkeypatch.setattr(search, "STEP_POSTINGS", 50)
    monkeypatch.setattr(search, "STEP_EXACT", 7)
    rng = np.random.default_rng(8)
    counts = [search.term_counts(" ".join(f"w{w}" for w in rng.zipf(1.3, rng.integers(0, 80)) % 400)) for _ in range(301)]
    shard = search.Shard.build([*range(len(counts))], counts)
    average = float(np.mean(shard.length))
    shard.weigh(average, 16)
    picked = [*range(0, 300, 11)]
    number = np.repeat(np.arange(len(picked)), [len(counts[i][0]) for i in picked])
    terms = np.concatenate([counts[i][0] for i in picked])
    df = np.diff(shard.first)[np.searchsorted(shard.terms, terms)]
    idf = np.log(1 + (len(counts) - df + 0.5) / (df + 0.5))
    asked = search.Asked(number, terms, idf, len(picked))
    least = np.zeros(len(picked))
    query, place, units = shard.search_all(asked, 10, least)
    for i in range(len(picked)):
        weight = dict(zip(terms[number == i].tolist(), idf[number == i].tolist(), strict=True))
        every = []
        for own, n in counts:
            part = n * (search.K1 + 1) / (n + search.K1 * (1 - search.B + search.B * (n.sum() / average)))
            every.append(sum(int(np.floor(weight[t] * p * search.UNIT + 0.5)) for t, p in zip(own.tolist(), part.tolist(), strict=True) if t in weight))
        kth = max(sorted(every)[-10], 1)
        assert {d: u for d, u in enumerate(every) if u >= kth} == dict(zip(place[query == i].tolist(), units[query == i].tolist(), strict=True))
        assert least[i] == (kth if sum(u > 0 for u in every) >= 10 else 0)
    # what a query has found before is not found again below it
    query, place, units = shard.search_all(asked, 10, least)
    assert (units >= least[query]).all()


def test_search_weighs_a_shard_once_for_many_queries(spark):
    asked = spark.range(300).selectExpr("id AS query_id", "transform(sequence(1, 200), i -> struct(id * 200 + i AS term, 1D AS idf)) AS terms")
    assert search.query_files(asked, 1).count() == 1


def test_search_does_not_broadcast_the_vocabulary(spark):
    asked = spark.createDataFrame([(1, "a b")], "query_id long, text string")
    index = search.build_index(spark.createDataFrame([(1, "a b c")], "doc_id long, text string"))
    plan = search.query_terms(asked, search.document_frequencies(index), 1)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_search_repeated_and_null_ids(spark, monkeypatch):
    monkeypatch.setattr(search, "SHARD_DOCS", 3)
    monkeypatch.setattr(search, "QUERY_BLOCK", 2)
    monkeypatch.setattr(search, "QUERY_TERMS", 3)
    rows = [(d, f"alpha beta{i % 4} gamma{i % 3}", "x") for i, d in enumerate([None, 1, 1, 2, None, 5, 6, 7, 8, 9, 10])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string").repartition(3)
    asked = spark.createDataFrame([(1, "alpha"), (1, "beta1"), (2, "gamma0 beta0"), (3, ""), (None, "alpha"), (4, "alpha")], "query_id long, text string")
    got = search.search(docs, asked, 4).collect()
    assert {r["query_id"] for r in got} == {1, 2, 4}
    assert all([r["rank"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == [1, 2, 3, 4] for q in (1, 2, 4))
    every = [r["doc_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == 4]
    assert every == [None, None, 1, 1]  # all tie: null ids first, then smaller ones


def test_quality_on_held_out_rows(spark):
    rows = queries.QUERIES["op2_quality"](spark, "/root/testdata/sf0.01").collect()
    labels = {r["doc_id"]: r["quality"] for r in common.table(spark, "/root/testdata/sf0.01", "labels").collect()}
    held = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert len(rows) == 1000 and np.mean([a == b for a, b in held]) > 0.95
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in rows)


def test_quality_defined_cases(spark, docs):
    labels = spark.createDataFrame([(10, 1), (10, 1), (11, 0), (None, 1), (12, None), (13, 5)], "doc_id long, quality int")
    weights = quality.train(docs, labels)
    assert quality.score(docs, weights).count() == len(_documents())
    assert quality.keep_good(docs, weights).columns == docs.columns
    assert not quality.train(docs, labels.limit(0)).any()


def test_empty_tables(spark, nothing):
    assert near_dedup.link_documents(nothing, 2).count() == 0
    assert token_files.read_token_files(token_files.write_token_files(nothing)).count() == 0
    assert packing.pack_documents(nothing).count() == 0
    assert search.search(nothing, nothing.withColumnRenamed("doc_id", "query_id")).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_warc(warc.write_warc(warc.mark_revisits(pages))).count() == 0


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query_matches_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    mine, theirs = queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.ORACLES[name]).df()
    order = sorted(mine.columns)
    assert order == sorted(theirs.columns)
    text = lambda df: sorted(df[order].map(str).itertuples(index=False, name=None))
    assert text(mine) == text(theirs)


def test_pipeline(spark):
    import corpus_pipeline

    docs = common.table(spark, SF, "documents")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.stored(stage(spark, docs, SF))
        assert docs.columns == columns and 0 < docs.count() <= before, name
        before = docs.count()
    placed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert placed.select("doc_id").distinct().count() == before


def test_warc_archive_is_read_once(monkeypatch):
    fields = {"URL": "http://a.org/", "IP-address": "0.0.0.0", "Archive-date": "20240101000000", "Content-type": "text/html"}
    rng = random.Random(5)
    blocks = [b"HTTP/1.1 200 OK\r\n\r\n" + rng.randbytes(n % 900) for n in range(3000)] + [b"x" * 100000 + rng.randbytes(50000)]
    data = b"".join(warc.member(warc.warc_record(fields, b, i, None, False)) for i, b in enumerate(blocks))
    handed = []

    class Counting:
        def __init__(self, *args):
            self.z = real(*args)

        def decompress(self, piece):
            handed.append(len(piece))
            return self.z.decompress(piece)

        def __getattr__(self, name):
            return getattr(self.z, name)

    real = warc.zlib.decompressobj
    monkeypatch.setattr(warc.zlib, "decompressobj", Counting)
    read = [(warc.record_number(f["WARC-Record-ID"]), b) for f, b in warc.warc_records(data)]
    assert read == list(enumerate(blocks))
    assert sum(handed) <= len(data) + (len(blocks) << 13)
    for cut in (1, 40, len(data) // 2, len(data) - 1):
        with pytest.raises(ValueError):
            list(warc.warc_records(data[:cut]))
