import html
import html.entities
import io
import json
import random
import re
import time
import wave
import zipfile

import pytest
from pyspark.sql import functions as F

from narrate_spark import sinks
from narrate_spark.functions import markup as M
from narrate_spark.functions import units as U
from narrate_spark.functions.unicode import unescape_marks
from narrate_spark.operators import jobs as J
from narrate_spark.operators import segments as G
from narrate_spark.sources import covers, epub, files, job_records, parsers, unpacked, wav
from narrate_spark.sources import markup as S
from narrate_spark.sources.package_xml import ncx_entries

OPF = """<?xml version="1.0"?><package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/">
<metadata>{meta}</metadata><manifest>{items}</manifest><spine>{spine}</spine></package>"""


def make_epub(pages, meta="<dc:title> A Book </dc:title><dc:creator>Someone</dc:creator><dc:language>es</dc:language>", extra=""):
    items = '<item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>' + extra
    spine = '<itemref idref="nav"/>'
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for i, page in enumerate(pages):
            items += f'<item id="c{i}" href="text/c{i}.xhtml" media-type="application/xhtml+xml"/>'
            spine += f'<itemref idref="c{i}"/>'
            if page is not None:
                z.writestr(f"OEBPS/text/c{i}.xhtml", page)
        z.writestr("META-INF/container.xml", '<container><rootfile full-path="OEBPS/content.opf"/></container>')
        z.writestr("OEBPS/content.opf", OPF.format(meta=meta, items=items, spine=spine))
        z.writestr("OEBPS/nav.xhtml", "<p>nav</p>")
        z.writestr("OEBPS/img/front.jpg", b"\xff\xd8jpeg")
        z.writestr("OEBPS/cover.xhtml", '<html><img src="img/front.jpg"/></html>')
    return buffer.getvalue()


def make_wav(rate=24000, channels=1, width=2, frames=240):
    buffer = io.BytesIO()
    with wave.open(buffer, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(width)
        w.setframerate(rate)
        w.writeframes(b"\x01\x02" * (frames * channels * width // 2))
    return buffer.getvalue()


@pytest.fixture(scope="module")
def books(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("books")
    (root / "One.EPUB").write_bytes(
        make_epub(["<h1>First &amp; best</h1><p>Uno.</p><p>Dos<br/>Tres</p>", None, "<p> </p>", "<p>Cuatro.</p>"])
    )
    (root / "bad.epub").write_bytes(b"not a zip")
    (root / "broken.epub").write_bytes(b"PK\x03\x04 broken")
    (root / "a.txt").write_bytes("Para 1\n\n\n\nPara 2\nmás".encode())
    (root / "latin.txt").write_bytes(b"Caf\xe9 in Paris.")
    (root / "x.pdf").write_bytes(b"pdf")
    return files.scan_books(files.scan_files(spark, str(root)))


def test_scan_and_validate(books):
    good, bad = files.validate_books(books)
    assert sorted(r.stem for r in good.collect()) == ["One", "a", "broken", "latin"]
    assert sorted((r.path.rsplit("/", 1)[1], r.error.split(":")[0]) for r in bad.collect()) == [
        ("bad.epub", "Corrupt or invalid ZIP"), ("x.pdf", "Unsupported format"),
    ]


def test_no_book_disappears(spark, books, tmp_path):
    (tmp_path / "old.mobi").write_bytes(b"binary")
    (tmp_path / "empty.epub").write_bytes(make_epub([None]))
    more = files.scan_books(files.scan_files(spark, str(tmp_path)))
    good, _ = files.validate_books(books.unionByName(more))
    chapters = parsers.parse_books(good)
    errors = parsers.parsing_errors(good, chapters)
    got = sorted((r.path.rsplit("/", 1)[1], r.error.split(":")[0]) for r in errors.collect())
    assert got == [
        ("broken.epub", "Corrupt or invalid ZIP"), ("empty.epub", "No readable chapter"), ("old.mobi", "No parser for format kindle"),
    ]
    named = {r.book_id for r in chapters.select("book_id").union(errors.select("book_id")).distinct().collect()}
    assert named == {r.book_id for r in good.select("book_id").collect()}


def test_parse_books(books):
    good, _ = files.validate_books(books)
    rows = G.explode_segments(G.with_segment_offset(parsers.parse_books(good))).collect()
    got = sorted((r.book_id.rsplit("/", 1)[1], r.chapter_idx, r.title, r.seg_idx, r.seg_text) for r in rows)
    assert got == [
        ("One.EPUB", 0, "First & best", 0, "Uno."),
        ("One.EPUB", 0, "First & best", 1, "Dos"),
        ("One.EPUB", 0, "First & best", 2, "Tres"),
        ("One.EPUB", 3, "Section 4", 3, "Cuatro."),
        ("a.txt", 0, "Chapter 1", 0, "Para 1"),
        ("a.txt", 0, "Chapter 1", 1, "Para 2\nmás"),
        ("latin.txt", 0, "Chapter 1", 0, "Café in Paris."),
    ]
    assert sorted(r.title for r in files.txt_metadata(good.where("format = 'txt'")).collect()) == ["a", "latin"]


def test_archives_report_errors_and_metadata(books):
    good, _ = files.validate_books(books)
    archives = epub.read_archives(good.where("format = 'epub'"))
    errors = epub.archive_errors(archives).collect()
    assert len(errors) == 1 and errors[0].error.startswith("Corrupt or invalid ZIP")
    meta = sorted(tuple(r)[1:] for r in epub.metadata(archives).collect())
    assert meta == [("", "", "en"), ("A Book", "Someone", "es")]
    # without pages asked for, none is read
    only = epub.read_archives(good.where("format = 'epub'"), ("book",))
    assert {r.part for r in only.collect()} == {"book"}


def test_metadata_defaults(spark):
    df = spark.createDataFrame([("b", "Stem", make_epub(["<p>x</p>"], meta=""))], "book_id string, stem string, content binary")
    rows = epub.read_archives(df)
    assert epub.metadata(rows).first()[1:] == ("", "", "en")
    assert epub.metadata(rows, use_stem=True).first().title == "Stem"


def test_archives_as_a_data_source(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "One.EPUB").write_bytes(make_epub(["<h1>T</h1><p>Uno.</p>", None, "<p>Dos.</p>"]))
    (tmp_path / "bad.epub").write_bytes(b"not a zip")
    (tmp_path / "note.txt").write_text("no archive")
    epub.register(spark)
    rows = spark.read.format("epub").load(str(tmp_path))
    assert sorted(((r.stem, r.part, r.pos, r.error is None) for r in rows.collect()), key=str) == sorted(
        [("One", "book", None, True), ("One", "page", 0, True), ("One", "page", 2, True), ("bad", "book", None, False)], key=str
    )
    chapters = S.page_chapters(epub.spine_pages(rows))
    assert sorted((r.chapter_idx, r.title, list(r.segs)) for r in chapters.collect()) == [(0, "T", ["Uno."]), (2, "Section 3", ["Dos."])]
    books = spark.read.format("epub").option("parts", "book").load(str(tmp_path))
    assert {r.part for r in books.collect()} == {"book"}


def test_strange_archives_end_no_job(spark):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfile full-path="p.opf"/></container>')
        z.writestr("p.opf", "<package><broken")
    rows = [("a", None), ("b", b""), ("c", buffer.getvalue()), ("d", make_epub(["x"], extra="<item/><item id='q'/>"))]
    df = spark.createDataFrame(rows, "book_id string, content binary")
    got = sorted((r.book_id, r.part, r.error is None) for r in epub.read_archives(df).collect())
    assert got == [("a", "book", False), ("b", "book", False), ("c", "book", True), ("d", "book", True), ("d", "page", True)]
    assert covers.pick_cover(df).collect() == []
    assert epub.read_archives(df.limit(0)).collect() == []


def test_cover_from_archive(spark, tmp_path):
    extra = (
        '<item id="w" href="cover.xhtml" media-type="application/xhtml+xml"/>'
        '<item id="pic" href="img/front.jpg" media-type="image/jpeg"/>'
    )
    df = spark.createDataFrame([("b", make_epub(["<p>x</p>"], extra=extra))], "book_id string, content binary")
    row = covers.pick_cover(df).first()
    assert (row["rank"], row["name"], row["suffix"]) == (4, "img/front.jpg", ".jpg")
    plan = covers.pick_cover(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    content = covers.pick_cover(df, with_content=True).select(F.lit("Stem").alias("stem"), "suffix", "content")
    sinks.write_covers(content, str(tmp_path))
    assert (tmp_path / "Stem_cover.jpg").read_bytes() == b"\xff\xd8jpeg"


NCX = '<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/"><navMap>{}</navMap></ncx>'


def nav(label, src, inner=""):
    text = f"<navLabel><text>{label}</text></navLabel>" if label is not None else ""
    return f"<navPoint>{text}<content src='{src}'/>{inner}</navPoint>"


def test_contents_and_sections(spark):
    ncx = NCX.format(
        nav(" Intro ", "x#filepos100", nav(None, "x#filepos500")) + nav("Gone", "x#filepos9999") + nav("No", "x#top") + nav("End", "x#filepos1000")
    )
    page = (
        b"<p>lost</p><a id=\"filepos100\" /><p>One</p><div><a id='filepos500'/></div><p>Two</p>"
        b"<a id=\"filepos1000\" /><p>Three \xff</p>"
    )
    rows = [("b", page, ncx), ("m", b"<h1>A &amp; B</h1>x<h2> </h2>y", "broken <"), ("s", b"only text", None), ("n", page, NCX.format(nav("q", "#filepos7")))]
    df = spark.createDataFrame(rows, "book_id string, content binary, ncx string")
    got = sorted((r.book_id, r.chapter_idx, r.title, list(r.segs)) for r in parsers.parse_unpacked(df).collect())
    assert got == [
        ("b", 0, "Intro", ["One"]),
        # the next entry has no anchor and is not mentioned: this one runs to the end
        ("b", 1, "Section 2", ["Two", "Three �"]),
        ("b", 3, "End", ["Three �"]),
        ("m", 0, "A &amp; B", ["x"]),
        ("m", 1, "Section 2", ["y"]),
        ("s", 0, "Chapter 1", ["only text"]),
    ]


def test_unpacked_directories(spark, tmp_path):
    opf = OPF.format(
        meta='<dc:title>T</dc:title><meta content="pic" name="cover"/><meta name="cover" content="none"/>',
        items="<item media-type='a>b' href='front.jpeg' id='pic'/><!-- <item id='pic' href='x'/> -->", spine="",
    )
    for name, given in {
        "one": {"book.html": '<a id="filepos5" /><p>x</p>', "content.opf": opf, "toc.ncx": NCX.format(nav("A", "#filepos5")), "front.jpeg": "j"},
        "two": {"z.html": "<h1>Z</h1>z", "a.htm": "<p>a</p>", "content.opf": opf},
        "none": {"content.opf": opf, "front.jpeg": "j"},
        "bare": {"b.xhtml": "<title> </title>b"},
    }.items():
        (tmp_path / name).mkdir()
        for file, text in given.items():
            (tmp_path / name / file).write_text(text)
    books = unpacked.unpacked_books(files.scan_files(spark, str(tmp_path)))
    got = {r.stem: (r.format, bytes(r.content)[:4], r.opf is None, r.ncx is None, len(r["names"])) for r in books.collect()}
    assert got == {
        "one": ("unpacked", b"<a i", False, False, 4), "two": ("unpacked", b"<p>a", False, True, 3), "bare": ("unpacked", b"<tit", True, True, 1),
    }
    chapters = {(r.book_id.rsplit("/", 1)[1], r.title, *r.segs) for r in parsers.parse_books(books).collect()}
    assert chapters == {("one", "A", "x"), ("two", "Chapter 1", "a"), ("bare", "Chapter 1", "b")}
    assert sorted(tuple(r)[1:] for r in unpacked.metadata(books).collect()) == [("T", "", "en"), ("T", "", "en"), ("bare", "", "en")]
    found = [(r.book_id.rsplit("/", 1)[1], r["name"], r.suffix) for r in unpacked.opf_cover(books).collect()]
    assert found == [("one", "front.jpeg", ".jpeg")]
    plan = unpacked.chapters(books)._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan and "MapIn" not in plan


def test_broken_contents_count_as_none(spark):
    good = NCX.format(nav("A", "#filepos1"))
    cases = [None, "", "broken <", good[:-6], good.replace("</navMap>", ""), good.replace("A<", "&nosuch;<"), good, '<!DOCTYPE ncx PUBLIC "a" "http://x/y.dtd">' + good]
    cases.append(NCX.format(nav("A", "#filepos99999999999999999999") + "<!--" + nav("B", "#filepos2") + "-->"))
    df = spark.createDataFrame(list(enumerate(cases)), "i int, x string")
    got = {r.i: [tuple(e) for e in r.e] for r in df.select("i", ncx_entries(F.col("x")).alias("e")).collect()}
    assert got == {i: [("A", 1)] if i in (6, 7) else [] for i in range(len(cases))}


def test_unpacked_metadata(spark):
    opf = OPF.format(meta="<dc:title>T</dc:title><dc:language> de </dc:language>", items="", spine="")
    rows = [("a", "stem", opf, "H"), ("b", "stem", "<broken", "H"), ("c", "stem", None, "")]
    df = spark.createDataFrame(rows, "book_id string, stem string, opf string, html_title string")
    df = df.select("book_id", "stem", "opf", F.concat(F.lit("<title>"), "html_title", F.lit("</title>")).cast("binary").alias("content"))
    got = sorted(tuple(r) for r in unpacked.metadata(df).collect())
    assert got == [("a", "T", "", "de"), ("b", "H", "", "en"), ("c", "stem", "", "en")]


def test_markup(spark):
    html = "<h2>Late</h2><h1> </h1><p class=x>A &lt;b&gt; &eacute;&amp;amp; &#233;</p>B<BR>C<script>s()</script>"
    row = spark.range(1).select(
        M.heading(F.lit(html)).alias("h"), M.xhtml_to_text(F.lit(html)).alias("t"), M.html_title(F.lit("<TITLE>a <b>c</b>&nbsp;</TITLE>")).alias("x")
    ).first()
    assert row.h == "Late" and row.x == "a c"
    assert row.t == "A <b> é&amp; é\nB\nCs()"
    df = spark.createDataFrame([("b", 3, "<p>x</p>")], "book_id string, chapter_idx bigint, markup string")
    assert S.page_chapters(df).first().title == "Section 4"


def test_unescape_equals_the_standard_library(spark):
    rnd = random.Random(2)
    names = list(html.entities.html5)
    texts = ["&" + n for n in names] + ["&" + n + "x;" for n in names] + [f"&#{n};" for n in range(200)]
    texts += ["&#x110000;", "&#xD800;", "&#xFDD0;", "&#x1FFFE", "&#99999999999999999999;", "&#xFFFFFFFFFFFFFFFFFFFFFF;", "&#;", "&#x;", "&", "&&amp;", "&amp;lt;", ""]
    parts = ["&", "#", "x", "X", ";", "amp", "lt", "not", "notin", "in", "1", "41", "é", " ", "AMP", "copy", "\n", "&nbsp;", "\ue000", "<"]
    texts += ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 9))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", M.unescape(F.col("t")).alias("u"))
    assert "EvalPython" not in df._jdf.queryExecution().executedPlan().toString()
    wrong = [(r.t, r.u, html.unescape(r.t)) for r in df.collect() if r.u != html.unescape(r.t)]
    assert wrong == []


def test_headings_equal_the_plain_pattern_and_take_linear_time(spark):
    rnd = random.Random(3)
    parts = ["<h1>", "</h1>", "<h2 a='b'>", "</H2>", "<H3>", "</h3>", "t", "<p>", ">", "<h1", "\ufdd0", "\ufdd6", "<", "</h1"]
    pages = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14))) for _ in range(3000)]
    cut = F.transform(M.heading_sections(F.col("m")), lambda s: unescape_marks(F.replace(s, F.lit(M.SPLIT), F.lit("|"))))
    df = spark.createDataFrame([(p,) for p in pages], "m string").select("m", cut.alias("s"), M.heading(F.col("m")).alias("h"))
    for r in df.collect():
        found = list(re.finditer(r"(?is)<(h[1-3])[^>]*>(.*?)</\1>", r.m))
        ends = [f.start() for f in found[1:]] + [len(r.m)] * bool(found)
        assert r.s == [f"{f[2]}|{r.m[f.end() : e]}" for f, e in zip(found, ends, strict=True)], r.m
        levels = [re.search(rf"(?is)<h{n}[^>]*>(.*?)</h{n}>", r.m) for n in range(1, 7)]
        texts = [re.sub("<[^>]+>", "", f[1]).strip() for f in levels if f]
        assert r.h == next((t for t in texts if t), "")
    start = time.perf_counter()
    for page in ("<h1>open " * 20_000, "<h2>open " * 20_000 + "</h1>", "<h1>a</h1>" * 20_000):
        one = spark.createDataFrame([(page,)], "m string")
        one.select(F.size(M.heading_sections(F.col("m"))), M.heading(F.col("m"))).collect()
    assert time.perf_counter() - start < 6


def test_single_file_books_are_read_once(spark, tmp_path):
    spark.createDataFrame([("b", b"<h1>A</h1>x", None)], "book_id string, content binary, ncx string").write.parquet(str(tmp_path / "p"))
    plan = unpacked.chapters(spark.read.parquet(str(tmp_path / "p")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "EvalPython" not in plan and "MapIn" not in plan


def test_wav_scan(spark):
    odd = bytearray(make_wav(22050, 2, 2, 10))
    odd[12:12] = b"LIST\x04\x00\x00\x00abcd"
    rows = [("a", make_wav(24000, 1, 2, 240)), ("b", make_wav(48000, 2, 1, 7)), ("c", bytes(odd)), ("d", b"nonsense")]
    df = spark.createDataFrame(rows, "path string, content binary")
    got = {r.path: (r.rate, r.channels, r.width, r.frames) for r in wav.scan_wav(df).collect()}
    assert got == {"a": (24000, 1, 2, 240), "b": (48000, 2, 1, 7), "c": (22050, 2, 2, 10), "d": (None,) * 4}


def test_merge_and_write_wavs(spark, tmp_path):
    pcm = b"\x01\x02" * 240
    rows = [("b", 0, 1, pcm, 24000), ("b", 0, 0, b"\x03\x04" * 240, 24000), ("b", 1, 0, pcm, 24000), ("b", 1, 1, pcm, 22050)]
    parts = spark.createDataFrame(rows, "book_id string, chapter_idx bigint, part_idx bigint, pcm binary, rate bigint")
    parts = parts.withColumns({"channels": F.lit(1).cast("bigint"), "width": F.lit(2).cast("bigint")})
    merged = wav.merge_pcm(parts, 100)
    errors = {r.chapter_idx: r.error for r in merged.collect()}
    assert errors == {0: None, 1: "WAV format mismatch"}
    sinks.write_wavs(merged, str(tmp_path))
    with wave.open(str(tmp_path / "b" / "ch_0000.wav")) as w:
        assert (w.getframerate(), w.getnframes()) == (24000, 2880)
        assert w.readframes(2880) == b"\x03\x04" * 240 + b"\x00" * 4800 + pcm
    assert [p.name for p in (tmp_path / "b").iterdir()] == ["ch_0000.wav"]


def test_silence(spark):
    def frames(ms, rate):
        size = wav.silence_bytes(F.lit(ms), F.lit(rate), F.lit(1), F.lit(2))
        return spark.range(1).select(F.octet_length(size).alias("n")).first().n // 2

    assert frames(500, 24000) == 12000 and frames(0, 24000) == 0
    with pytest.raises(Exception, match="negative"):
        frames(-1, 24000)
    tail = wav.append_silence(F.unhex(F.lit("0102")), F.lit(0), F.lit(24000), F.lit(1), F.lit(2))
    assert bytes(spark.range(1).select(tail.alias("x")).first().x) == b"\x01\x02"


def test_units(spark):
    df = spark.createDataFrame([(3661000,), (0,), (359999999,)], "ms bigint")
    assert [r[0] for r in df.select(U.ms_to_timestamp(F.col("ms"))).collect()] == ["01:01:01.000", "00:00:00.000", "99:59:59.999"]
    speeds = [2.0, 0.5, 1.0, 1.28, 3.0]
    df = spark.createDataFrame([(s,) for s in speeds], "s double")
    got = [r[0] for r in df.select(U.speed_to_duration_delta(F.col("s"))).collect()]
    assert got == [round(1 / s - 1, 4) for s in speeds[:4]] + [None]
    specs = ["0,2,5", "1-3", "5-3", "3,1-2,3", "x", "", "1-", "-1"]
    df = spark.createDataFrame([(s,) for s in specs], "s string")
    got = [r[0] for r in df.select(U.parse_chapter_spec(F.col("s"))).collect()]
    assert got == [[0, 2, 5], [1, 2, 3], [], [1, 2, 3], None, None, None, None]


def test_job_records(spark, tmp_path):
    record = {"id": "a1", "state": "ready", "created_at": "2026-01-02T03:04:05+00:00", "updated_at": "2026-01-02T03:04:06+00:00"}
    for name, text in {
        "a": json.dumps(record, indent=2),
        "b": "{broken",
        "c": json.dumps({**record, "id": "c1", "state": "strange"}),
        "d": json.dumps({**record, "id": "d1", "max_chars": 80, "chapter_indices": [1, 2], "total_segments": 4, "completed_segments": 1}),
    }.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "job.json").write_text(text)
    jobs = job_records.scan_jobs(spark, str(tmp_path))
    got = {r.id: r for r in jobs.collect()}
    assert sorted(got) == ["a1", "d1"]
    assert (got["a1"].max_chars, got["a1"].speed, got["a1"].book_title) == (500, 1.0, "")
    assert (got["d1"].max_chars, got["d1"].chapter_indices) == (80, [1, 2])
    listing = J.job_listing(
        jobs.select(F.col("id").alias("job_id"), F.col("book_title").alias("title"), "state",
                    F.col("completed_segments").alias("done"), F.col("total_segments").alias("total"), "created_at")
    )
    rows = {r.job_id: (r.title, r.progress, r.created) for r in listing.collect()}
    assert rows["d1"] == ("—", "1/4 (25.0%)", "2026-01-02 03:04:05")
    assert rows["a1"][1] == "0/0 (0.0%)"
    job_records.write_jobs(jobs, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2


def test_tables_and_side_files(spark, tmp_path):
    rows = spark.createDataFrame([("b", 1, "two"), ("b", 0, "one"), ("c", 0, "x")], "book_id string, chapter_idx bigint, text string")
    sinks.write_table(rows.withColumn("format", F.lit("txt")), str(tmp_path / "t"), "format")
    sinks.write_table(rows.where("book_id = 'b'").withColumn("format", F.lit("epub")), str(tmp_path / "t"), "format")
    assert spark.read.parquet(str(tmp_path / "t")).count() == 5
    sinks.write_side_files(rows, str(tmp_path / "s"), "text", ["chapter_idx"])
    parts = sorted((tmp_path / "s" / "book_id=b").glob("part-*"))
    assert "".join(p.read_text() for p in parts) == "one\ntwo\n"


def test_progress_is_rounded_from_its_exact_value(spark):
    df = spark.createDataFrame([(1, 16), (3, 16), (3, 2000), (16, 16), (30, 16), (0, 0)], "done bigint, total bigint")
    got = [r.p for r in df.select(J.progress_text(F.col("done"), F.col("total")).alias("p")).collect()]
    assert got == ["1/16 (6.2%)", "3/16 (18.8%)", "3/2000 (0.1%)", "16/16 (100.0%)", "30/16 (187.5%)", "0/0 (0.0%)"]
