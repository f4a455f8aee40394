import random

import pytest
from pyspark.sql import functions as F

from narrate_spark import constants as K
from narrate_spark.operators import analyze as A
from narrate_spark.operators import plan as P
from narrate_spark.operators import segments as G
from narrate_spark.operators import timeline as T
from narrate_spark.operators.synthesize import Audio, apply_synthesizer, job_failures
from narrate_spark.operators.jobs import transitions
from tests import plain

SCHEMA = "book_id string, chapter_idx bigint, title string, segs array<string>"


def chapters(spark, *segments, title="T"):
    return spark.createDataFrame([("b", 0, title, list(segments))], SCHEMA)


def events(spark, *segments, title="T", **kw):
    rows = P.synthesis_plan(chapters(spark, *segments, title=title), **kw).collect()
    return [(r.seg_pos, r.kind, r.text, r.pause_ms, r.seg_pause_ms) for r in sorted(rows, key=lambda r: (r.seg_pos, r.event_idx))]


def test_scene_segment_between_texts(spark):
    assert events(spark, "Antes.", "***", "Después.") == [
        (0, "text", "Antes.", 0, 700), (1, "pause", "", 1500, 0), (2, "text", "Después.", 0, 2500),
    ]


def test_second_pause_segment_is_dropped(spark):
    assert [e[0] for e in events(spark, "Antes.", "***", "---", "Después.")] == [0, 1, 3]


def test_last_segment_pause(spark):
    assert events(spark, "Uno.", "***")[-1] == (1, "pause", "", 1500, 2500)
    # the chapter pause is lost with the last segment
    assert events(spark, "Uno.", "***", "---")[-1] == (1, "pause", "", 1500, 0)
    assert events(spark, "Uno.", "Page 3") == [(0, "text", "Uno.", 0, 700)]


def test_neighbouring_pauses_take_the_longest(spark):
    assert events(spark, "A.\n***\nChapter 2\n---\nB.") == [
        (0, "text", "A.", 0, 2500), (0, "pause", "", 1500, 2500), (0, "text", "B.", 0, 2500),
    ]
    longer = P.Prosody(title_ms=3000)
    assert events(spark, "A.\n***\nChapter 2\n---\nB.", prosody=longer)[1][3] == 3000


def test_title_anchor(spark):
    assert events(spark, "Chapter 1\nOnce.", title="Chapter 1") == [
        (0, "pause", "", 1200, 2500), (0, "text", "Once.", 0, 2500),
    ]
    assert events(spark, "DIE STRASSE\nEs war.", title="Die Straße")[1][1] == "pause"
    assert [e[1] for e in events(spark, "Once.\nMore.", title="Other")] == ["text"]


def test_rules_hold_for_random_plans(spark):
    """What the plan of any chapter keeps to, stated as rules on its events."""
    rng = random.Random(3)
    lines = ["Foo bar. Baz!", "***", "Page 2", "Chapter 4", "Etc. no end", "---", "¿ Qué ? Sí.", "xvi", "A. B. C."]
    books = [
        [("\n".join(rng.choice(lines) for _ in range(rng.randint(1, 4)))) for _ in range(rng.randint(1, 7))]
        for _ in range(400)
    ]
    df = spark.createDataFrame([("b", i, "zzz", b) for i, b in enumerate(books)], SCHEMA).repartition(4)
    got = {}
    for r in P.synthesis_plan(df, max_chars=12).collect():
        got.setdefault((r.chapter_idx, r.seg_pos), []).append(r)
    norms = {r.chapter_idx: r.norms for r in A.with_normalized(df).collect()}
    pause_of = {K.SCENE_BREAK_MARKER: 1500, K.CHAPTER_TITLE_MARKER: 1200}
    for i, segments in norms.items():
        cut = [plain.chunks(n, 12) for n in segments]
        spoken = {at for at, c in enumerate(cut) if any(x not in pause_of for x in c)}
        silent = {at for at, c in enumerate(cut) if c} - spoken
        kept = {at for c, at in got if c == i}
        # every segment with text is there; of segments in a row that only pause, the first one is
        assert spoken <= kept <= spoken | silent
        for at in silent:
            earlier = [k for k in range(at) if k in spoken or k in silent]
            assert (at in kept) == (not earlier or earlier[-1] in spoken)
        for at in kept:
            rows = sorted(got[i, at], key=lambda r: r.event_idx)
            assert [r.event_idx for r in rows] == list(range(len(rows)))
            assert [r.text for r in rows if r.kind == "text"] == [x for x in cut[at] if x not in pause_of]
            assert all(a.kind == "text" or b.kind == "text" for a, b in zip(rows, rows[1:], strict=False))
            # a pause is as long as the longest marker between its neighbours
            groups = "".join("T" if x not in pause_of else "S" if pause_of[x] == 1500 else "C" for x in cut[at])
            longest = [1500 if "S" in g else 1200 for g in groups.split("T") if g]
            assert [r.pause_ms for r in rows if r.kind == "pause"] == longest
            last = at == len(segments) - 1
            assert {r.seg_pause_ms for r in rows} == {2500 if last else 0 if at in silent else 700}


def test_segment_numbers_run_through_the_book(spark):
    df = spark.createDataFrame(
        [("a", 0, "x", ["p", "q"]), ("a", 5, "y", ["r"]), ("a", 9, "z", ["s"]), ("b", 2, "x", ["t"])], SCHEMA
    )
    rows = G.explode_segments(G.with_segment_offset(df)).collect()
    assert {r.seg_text: r.seg_idx for r in rows} == {"p": 0, "q": 1, "r": 2, "s": 3, "t": 0}


def test_pending_and_progress(spark):
    plan = P.synthesis_plan(G.with_segment_offset(chapters(spark, "Uno.", "***", "Dos.")))
    done = spark.createDataFrame([("b", "ch0000_seg000000_chunk0.wav")], "book_id string, artifact string")
    assert {r.artifact for r in P.pending_work(plan, done).collect()} == {
        "ch0000_seg000001_chunk0.wav", "ch0000_seg000002_chunk0.wav",
    }
    assert P.plan_progress(plan, done).first()[1:] == (2, 1)


def test_synthesizer_errors_become_rows(spark):
    def factory():
        def speak(text, language, voice, speed):
            if "bad" in text:
                raise RuntimeError("model failed")
            return Audio(24000, 1, 2, 100, b"\x01\x02" * 100)

        return speak

    rows = [("b", "1", "ok", 1.0), ("b", "2", "bad", 1.0), ("b", "3", " ", 1.0), ("b", "4", "ok", 2.5)]
    df = spark.createDataFrame(rows, "book_id string, artifact string, text string, speed double")
    df = df.withColumns({"language": F.lit("en"), "voice": F.lit("v")})
    got = {r.artifact: r for r in apply_synthesizer(df, factory, 3).collect()}
    assert got["1"].frames == 100 + 1920 and len(got["1"].pcm) == 2 * 2020
    assert got["2"].error == "RuntimeError: model failed"
    assert got["3"].error == "ValueError: Cannot synthesize empty text"
    assert got["4"].error == "ValueError: Speed must be between 0.5 and 2.0, got 2.5"


def test_failures_only_move_legal_states(spark):
    jobs = spark.createDataFrame([("a", "ready"), ("b", "cancelled"), ("c", "ready")], "job_id string, state string")
    errors = spark.createDataFrame([("a", 2, "E: late"), ("a", 1, "E: first"), ("b", 1, "E: x")], "job_id string, pos int, error string")
    got = {r.job_id: (r.state, r.error_message) for r in job_failures(jobs, errors, transitions(spark)).collect()}
    assert got == {"a": ("failed", "E: first"), "b": ("cancelled", "E: x"), "c": ("ready", None)}


def test_markers_and_metadata(spark):
    durations = spark.createDataFrame(
        [("b", 0, 5000), ("b", 3, 0), ("b", 10, 3000)], "book_id string, chapter_idx bigint, duration_ms bigint"
    )
    titles = spark.createDataFrame([("b", 0, "One")], "book_id string, chapter_idx bigint, title string")
    rows = sorted(T.chapter_markers(durations, titles).collect(), key=lambda r: r.chapter_idx)
    assert [(r.title, r.start_ms, r.end_ms) for r in rows] == [("One", 0, 5000), ("Chapter 11", 5000, 8000)]
    books = spark.createDataFrame([("b", "T=1", "A", "", "v - k")], "book_id string, title string, author string, language string, narrator string")
    blocks = T.ffmetadata(books, T.chapter_markers(durations, titles)).orderBy("chapter_idx").collect()
    assert "\n".join(r.block for r in blocks) == (
        ";FFMETADATA1\ntitle=T=1\nartist=v - k\ncomposer=A\nalbum_artist=A\nalbum=T=1\ngenre=Audiobook\n"
        "\n[CHAPTER]\nTIMEBASE=1/1000\nSTART=0\nEND=5000\ntitle=One\n"
        "\n[CHAPTER]\nTIMEBASE=1/1000\nSTART=5000\nEND=8000\ntitle=Chapter 11"
    )
    assert T.metadata_header(books, escape=True).first().block.split("\n")[1] == "title=T\\=1"


def test_warnings(spark):
    df = spark.createDataFrame(
        [("b", 0, "Section 1", ["Page 1"]), ("b", 1, "Fine", ["One.", "Two."])], SCHEMA
    )
    rows = A.chapter_warnings(A.analyze_chapters(df)).orderBy("rule_no").collect()
    assert [(r.chapter_idx, r.rule_no) for r in rows] == [(0, 1), (0, 2), (0, 3)]
    assert rows[0].warning == "Chapter 0: no heading detected (auto-titled 'Section 1')"


def test_fingerprint_sees_order_and_is_repeatable(spark):
    def prints(*segs):
        return A.fingerprints(A.chunks(chapters(spark, *segs))).first().fingerprint

    assert prints("Uno.", "Dos.") == prints("Uno.", "Dos.") != prints("Dos.", "Uno.")
    assert K.DEFAULT_MAX_CHARS == 500


@pytest.mark.parametrize("limit", [8, 60])
def test_no_word_is_lost(spark, limit):
    df = chapters(spark, "Uno dos. Tres! ***\n***\n¿ Cuatro ? cinco", "Page 1\nSeis.")
    assert A.word_differences(df, limit).count() == 0
    assert A.chunk_lengths_ok(A.chunks(df, limit), limit).count() == 0


def test_title_anchor_skips_blank_lines(spark):
    df = chapters(spark, "x").select(
        P.title_anchor(F.lit("\xa0\n  Title \nText."), F.lit("TITLE"), F.lit(True)).alias("t")
    )
    assert df.first().t == f"\xa0\n  Title \n{K.CHAPTER_TITLE_MARKER}\nText."
