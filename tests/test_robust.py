"""Odd inputs must neither end a job nor be lost."""

import io
import zipfile

from pyspark.sql import functions as F

from narrate_spark.functions import normalize, units
from narrate_spark.operators import segments, timeline
from narrate_spark.sources import epub, wav


def _one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column).first()[0]


def test_long_repetitions_in_patterns(spark):
    df = spark.createDataFrame([("a " + ". " * 500_000 + "b",)], ["t"])
    out = df.select(normalize.normalize("t").alias("t")).first()[0]
    assert out == "a ... b"
    spec = ",".join("7" for _ in range(50_000))
    assert _one(spark, units.chapter_spec_error(F.col("s")), s=spec) is None


def test_chapter_spec_beyond_int(spark):
    assert _one(spark, units.parse_chapter_spec(F.col("s")), s="3000000000") == [3_000_000_000]
    assert _one(spark, units.chapter_spec_error(F.col("s")), s="1-99999999999999999999") is not None
    hit = units.in_chapter_spec(F.lit(1_999_999_999), F.col("s"))
    assert _one(spark, hit, s="0-2000000000") is True
    assert _one(spark, units.in_chapter_spec(F.lit(3), F.col("s")), s="5-1,2") is False


def test_damaged_archive_is_an_error_row(spark):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a.txt", "some text " * 200)
    good = buffer.getvalue()
    rows = [("good", bytearray(good))]
    for at in range(20, len(good), 7):
        rows.append((f"bad{at}", bytearray(good[:at] + bytes([good[at] ^ 0xFF]) + good[at + 1 :])))
    df = spark.createDataFrame(rows, "book_id string, content binary")
    got = {r["book_id"]: r["error"] for r in epub.read_archives(df).select("book_id", "error").collect()}
    assert len(got) == len(rows) and got["good"] is None


def test_merge_joins_bytes_with_gap(spark):
    rows = [("b", 0, i, bytearray([255 - i, 0, 200, i]), 1000, 1, 2) for i in range(50)]
    df = spark.createDataFrame(
        rows, "book_id string, chapter_idx long, part_idx int, pcm binary, rate int, channels int, width int"
    )
    out = bytes(wav.merge_pcm(df, 1).first()["wav"])[44:]
    assert out == b"\0\0".join(bytes(r[3]) for r in rows)


def test_abbreviation_with_any_number_of_marks(spark):
    from narrate_spark.functions import sentences

    counts = (1, 64, 65, 70, 5000, 100_000)
    rows = [("He said no" + "\u2014" * n + ". Yes he did. End",) for n in counts]
    found = spark.createDataFrame(rows, "t string").select(sentences.split_sentences(F.col("t")).alias("s")).collect()
    assert [r.s for r in found] == [[t.removesuffix(" End"), "End"] for (t,) in rows]


def test_selections_stay_ranges(spark):
    chapters = spark.createDataFrame([("a", i) for i in (0, 1, 2, 5, 5)] + [(None, 3)], "book_id string, chapter_idx long")
    specs = [
        (1, "a", "0-2000000000"), (2, "a", "5-1"), (3, "a", "x"), (4, "a", "2,0-1,5,5"), (5, "a", None), (6, "a", "0-9223372036854775807"),
        (7, "b", "1"), (8, "a", "0-1,2"), (9, None, "3"), (10, "a", "4-6,1-2,9-8"),
    ]
    requests = spark.createDataFrame(specs, "request_id long, book_id string, spec string")
    got = {r["request_id"]: r for r in segments.check_selections(chapters, requests).collect()}
    assert len(got) == len(specs)
    assert (got[1]["ranges"], int(got[1]["named"]), got[1]["available"]) == ("0-2000000000", 2_000_000_001, 4)
    assert got[1]["error"] == "Chapter indices out of range: 1999999997. Available indices: 0-5"
    assert got[2]["error"] == "Chapter selection is empty. Available indices: 0-5"
    assert got[3]["error"] == got[5]["error"] == "Invalid chapter specification."
    assert (got[4]["ranges"], got[4]["available"], got[4]["error"]) == ("0-2,5", 4, None)
    assert int(got[6]["named"]) == 1 << 63 and got[6]["available"] == 4
    assert got[7]["error"] == "Chapter indices out of range: 1. Available indices: (none)"
    assert (got[8]["ranges"], got[8]["error"]) == ("0-2", None)
    assert (got[10]["ranges"], got[10]["available"]) == ("1-2,4-6", 3)
    assert segments.check_selections(chapters.limit(0), requests.limit(0)).count() == 0


def test_manifest_order(spark):
    names = ["w/ch_10/seg_2.wav", "w/ch_2/seg_10.wav", "w/ch_2/seg_9.wav", "w/ch_x/seg_1.wav", "w/ch_2/seg_9.wav", "w/ch_0/seg_0.wav", "w/ch_2/cover.jpg", "seg_1.wav", ""]
    files = spark.createDataFrame([("a", n) for n in names] + [(None, "c/seg_.wav"), ("b", None)], "book_id string, path string")
    got = {(r["book_id"], r["position"]): r["path"] for r in timeline.assembly_manifest(files).collect()}
    want = ["w/ch_0/seg_0.wav", "w/ch_x/seg_1.wav", "w/ch_2/seg_9.wav", "w/ch_2/seg_10.wav", "w/ch_10/seg_2.wav"]
    assert got == {("a", i): n for i, n in enumerate(want)} | {(None, 0): "c/seg_.wav"}
