"""Markup, archive, cover and WAV queries over ``pages`` and ``documents``."""

from __future__ import annotations

import html
import html.entities
import io
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrate_spark.functions import markup as M
from narrate_spark.operators import segments as G
from narrate_spark.operators.arrays import explode_rows
from narrate_spark.operators.sizes import spread
from narrate_spark.plans import sql
from narrate_spark.plans.corpus import document_chapters, table
from narrate_spark.sources import covers, epub, unpacked, wav
from narrate_spark.sources import markup as S
from narrate_spark.sources.package_xml import ncx_entries

KEY = ["book_id", "chapter_idx"]
# Input bytes of one partition of pages; archives are made of them and read in Python.
PAGE_BYTES = 1 << 20


def pages(spark, sf_dir) -> DataFrame:
    """Pages, spread over partitions of a bounded size."""
    return spread(table(spark, sf_dir, "pages"), "page_id", part_bytes=PAGE_BYTES)


def _varied(page: Column, html: Column) -> Column:
    """Headings of other levels, written into the page by a fixed rule."""

    def swap(text: Column, old: str, new: str) -> Column:
        return F.replace(text, F.lit(old), F.lit(new))

    rule = page % 5
    return (
        F.when(rule == 1, swap(swap(html, "<h1>", "<h2>"), "</h1>", "</h2>"))
        .when(rule == 2, swap(html, "<article>", "<article><h2>Early &amp; late</h2>One.<br/>Two."))
        .when(rule == 3, swap(html, "<article>", "<article><h1> &nbsp; </h1>A &lt; B<H3 class='x'>Third</H3>C"))
        .when(rule == 4, swap(swap(html, "<h1>", "<div>"), "</h1>", "</div>"))
        .otherwise(html)
    )


def varied_pages(spark, sf_dir) -> DataFrame:
    """Pages as spine items: each host is a book, each page a position."""
    return pages(spark, sf_dir).select(
        F.regexp_extract("url", "//([^/]+)", 1).alias("book_id"),
        F.col("page_id").alias("chapter_idx"),
        _varied(F.col("page_id"), F.col("html")).alias("markup"),
    )


def q_titles(spark, sf_dir):
    return pages(spark, sf_dir).select("page_id", M.html_title(F.col("html")).alias("title"))


def q_headings(spark, sf_dir):
    return varied_pages(spark, sf_dir).select(
        F.col("chapter_idx").alias("page_id"), M.heading(F.col("markup")).alias("heading")
    )


def q_text(spark, sf_dir):
    return varied_pages(spark, sf_dir).select(
        F.col("chapter_idx").alias("page_id"), M.xhtml_to_text(F.col("markup")).alias("text")
    )


def q_segments(spark, sf_dir):
    chapters = S.page_chapters(varied_pages(spark, sf_dir))
    rows = G.explode_segments(G.with_segment_offset(chapters))
    return rows.select(*KEY, "title", "seg_pos", "seg_idx", F.col("seg_text").alias("text"))


def _single_file_books(spark, sf_dir) -> DataFrame:
    no_toc = F.array().cast("array<struct<title:string,filepos:bigint>>")
    return pages(spark, sf_dir).select(
        F.col("page_id").cast("string").alias("book_id"),
        _varied(F.col("page_id"), F.col("html")).alias("markup"),
        no_toc.alias("toc"),
    )


def q_heading_chapters(spark, sf_dir):
    rows = G.explode_segments(S.html_chapters(_single_file_books(spark, sf_dir)))
    return rows.select(*KEY, "title", "seg_pos", F.col("seg_text").alias("text"))


def _anchored_books(spark, sf_dir) -> DataFrame:
    """An anchor before every paragraph, and a contents entry for each.

    Every third anchor uses single quotes; where the paragraph number is 4 the
    anchor is left out, so its entry is skipped and the section before it runs
    to the next mention, here to the end.
    """
    parts = F.split("html", "<p>", -1)

    def anchor(text: Column, i: Column) -> Column:
        number = i.cast("string")
        tag = F.when(
            i % 3 == 0, F.concat(F.lit("<a id='filepos"), number, F.lit("' /><p>"))
        ).otherwise(F.concat(F.lit('<a id="filepos'), number, F.lit('" /><p>')))
        return F.when(i == 0, text).when(i == 4, F.concat(F.lit("<p>"), text)).otherwise(
            F.concat(tag, text)
        )

    def entry(i: Column) -> Column:
        title = F.when(i % 2 == 0, F.concat(F.lit("Part "), i.cast("string"))).otherwise("")
        return F.struct(title.alias("title"), i.cast("bigint").alias("filepos"))

    count = F.size(parts) - 1
    toc = F.when(
        count > 0, F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), entry)
    ).otherwise(F.array().cast("array<struct<title:string,filepos:bigint>>"))
    return pages(spark, sf_dir).select(
        F.col("page_id").cast("string").alias("book_id"),
        F.array_join(F.transform(parts, anchor), "").alias("markup"),
        toc.alias("toc"),
    )


def q_toc_chapters(spark, sf_dir):
    books = _anchored_books(spark, sf_dir)
    rows = G.explode_segments(S.html_chapters(books))
    return rows.select(*KEY, "title", "seg_pos", F.col("seg_text").alias("text"))


_OPF = """<?xml version="1.0"?><package xmlns="http://www.idpf.org/2007/opf"
 xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata>{0}</metadata><manifest>
 <item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>
 <item id="page" href="text/page%20one.xhtml" media-type="application/xhtml+xml"/>{1}</manifest>
 <spine><itemref idref="nav"/><itemref idref="ghost"/><itemref idref="page"/></spine></package>"""
_BOX = '<container><rootfiles><rootfile full-path="OPS/book.opf"/></rootfiles></container>'


def _told(page_id: int) -> str:
    """Metadata of an archive; which fields it has varies."""
    return (
        (f"<dc:title id='t'> Page {page_id} &amp; more </dc:title><dc:title>Other</dc:title>" if page_id % 3 else "")
        + (f"<dc:creator>Writer {page_id % 10}</dc:creator>" if page_id % 4 else "<dc:creator> </dc:creator>")
        + ("<dc:language>es</dc:language>" if page_id % 5 == 0 else "")
        + ('<meta name="cover" content="i2"/>' if page_id % 7 == 2 else "")
        + ('<meta name="cover" content="absent"/>' if page_id % 7 == 5 else "")
    )


def _pictures(r: int) -> tuple[str, dict[str, str]]:
    """Manifest items and entries of an archive whose cover hides in another place for each ``r``."""
    wrap = "MyCover.xhtml" if r == 4 else "w.xhtml"
    items = (
        '<item id="i1" href="img/first.jpg" media-type="image/jpeg"/><item id="i2" href="img/meta.gif" media-type="image/gif"/>'
        f'<item id="{"cover" if r == 3 else "i3"}" href="img/exact.webp" media-type=""/>'
        f'<item id="w" href="{wrap}" media-type="application/xhtml+xml"/>'
        f'<item id="i5" href="img/front.png" media-type="image/png"{" properties='cover-image'" if r == 1 else ""}/>'
    )
    entries = {
        "img/first.jpg": "" if r == 6 else "a",
        "img/meta.gif": "b",
        "img/exact.webp": "c",
        wrap: '<html><body><IMG alt="" src="../img/Front.PNG"/></body></html>',
        "img/front.png": "d",
    }
    return items, entries


# Archives that are made and sent on together.
_ARCHIVES = 256


def _archives(batches):
    for whole in batches:
        for at in range(0, whole.num_rows, _ARCHIVES):
            batch = whole.slice(at, _ARCHIVES)
            made = []
            for page_id, html in zip(batch.column("page_id"), batch.column("html"), strict=True):
                page = page_id.as_py()
                buffer = io.BytesIO()
                items, entries = _pictures(page % 7)
                with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
                    archive.writestr("META-INF/container.xml", _BOX)
                    archive.writestr("OPS/book.opf", _OPF.format(_told(page), items))
                    archive.writestr("OPS/nav.xhtml", "<p>Contents</p>")
                    archive.writestr("OPS/text/page one.xhtml", html.as_py())
                    for name, text in entries.items():
                        archive.writestr(f"OPS/{name}", text)
                made.append((str(page), f"book-{page}", buffer.getvalue()))
            columns = [pa.array(c, t) for c, t in zip(zip(*made, strict=True), (pa.string(), pa.string(), pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays(columns, ["book_id", "stem", "content"])


def epub_books(spark, sf_dir) -> DataFrame:
    """Each page as a small EPUB archive."""
    rows = pages(spark, sf_dir).select("page_id", "html")
    return rows.mapInArrow(_archives, "book_id string, stem string, content binary")


def _damaged_books(spark, sf_dir) -> DataFrame:
    """The archives, some of them cut off, without content or with a page that is no longer what it was."""
    content, page = F.col("content"), F.col("book_id").cast("bigint")
    # the page is stored under its name twice: before its data, and in the list at the end
    at = F.expr("instr(hex(content), hex('OPS/text/page one.xhtml')) div 2") + len("OPS/text/page one.xhtml") + 1
    broken = F.concat(
        F.substring(content, F.lit(1), at), F.unhex(F.lit("FFFFFF")), F.substring(content, at + 4, F.octet_length(content))
    )
    damaged = (
        F.when(page % 10 == 1, F.substring(content, 1, 60))
        .when(page % 10 == 2, F.lit("no archive").cast("binary"))
        .when(page % 10 == 3, broken)
        .when(page % 10 == 4, F.lit(None).cast("binary"))
        .otherwise(content)
    )
    return epub_books(spark, sf_dir).withColumn("content", damaged)


def q_epub(spark, sf_dir):
    chapters = S.page_chapters(epub.spine_pages(epub.read_archives(epub_books(spark, sf_dir), ("page",))))
    rows = G.explode_segments(chapters)
    return rows.select(*KEY, "title", "source_file", "seg_pos", F.col("seg_text").alias("text"))


def q_epub_metadata(spark, sf_dir):
    return epub.metadata(epub.read_archives(epub_books(spark, sf_dir), ("book",)), use_stem=True)


def q_archive_errors(spark, sf_dir):
    errors = epub.archive_errors(epub.read_archives(_damaged_books(spark, sf_dir)))
    return errors.select("book_id", F.coalesce("name", F.lit("")).alias("name"), F.substring_index("error", ":", 1).alias("error"))


def q_covers(spark, sf_dir):
    found = covers.pick_cover(epub_books(spark, sf_dir), with_content=True)
    return found.withColumn("content", F.col("content").cast("string"))


def unpacked_files(spark, sf_dir) -> DataFrame:
    """The files (path, content) of one unpacked directory per page; some have no package, contents or cover."""
    page = F.col("page_id")
    root = F.concat(F.lit("/books/"), page.cast("string"), F.lit("/"))
    parts = F.split("html", "<p>", -1)

    def anchored(text: Column, i: Column) -> Column:
        mark = F.concat(F.lit('<a id="filepos'), i.cast("string"), F.lit('" /><p>'))
        return F.when(i == 0, text).otherwise(F.concat(mark, text))

    def point(i: Column) -> Column:
        number = i.cast("string")
        label = F.when(i % 2 == 0, F.concat(F.lit("<navLabel><text> Part "), number, F.lit(" &amp; on</text></navLabel>"))).otherwise("")
        return F.concat(F.lit("<n:navPoint playOrder='"), number, F.lit("'>"), label, F.lit("<content src='book.html#filepos"), number, F.lit("'/></n:navPoint>"))

    count = F.size(parts) - 1
    points = F.when(count > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), point), "")).otherwise("")
    ncx = F.concat(F.lit('<?xml version="1.0"?><ncx xmlns:n="u"><navMap>'), points, F.when(page % 6 == 5, "</navMap>").otherwise("</navMap></ncx>"))
    title = F.when(page % 3 > 0, F.concat(F.lit("<dc:title> Kindle "), page.cast("string"), F.lit(" </dc:title>"))).otherwise("")
    opf = F.concat(
        F.lit('<package xmlns:dc="d"><metadata>'), title,
        F.lit("<dc:language>fr</dc:language><meta content='pic' name='cover'/></metadata><manifest><item href='"),
        F.when(page % 4 == 1, "absent.jpg").otherwise("front.gif"), F.lit("' id=\"pic\"/></manifest></package>"),
    )

    def file(name: str, content: Column) -> Column:
        return F.struct(F.concat(root, F.lit(name)).alias("path"), content.cast("binary").alias("content"))

    files = F.array(
        file("book.html", F.array_join(F.transform(parts, anchored), "")),
        file("front.gif", F.lit("GIF")),
        F.when(page % 6 != 4, file("toc.ncx", ncx)),
        F.when(page % 5 != 4, file("content.opf", opf)),
    )
    return pages(spark, sf_dir).select(F.inline(F.array_compact(files)))


def unpacked_books(spark, sf_dir) -> DataFrame:
    """The unpacked directories as books."""
    return unpacked.unpacked_books(unpacked_files(spark, sf_dir)).withColumn("book_id", F.col("stem"))


def q_unpacked_chapters(spark, sf_dir):
    rows = G.explode_segments(unpacked.chapters(unpacked_books(spark, sf_dir)))
    return rows.select(*KEY, "title", "seg_pos", F.col("seg_text").alias("text"))


def q_unpacked_metadata(spark, sf_dir):
    return unpacked.metadata(unpacked_books(spark, sf_dir))


def q_ncx(spark, sf_dir):
    rows = unpacked_books(spark, sf_dir).select("book_id", F.posexplode_outer(ncx_entries(F.col("ncx"))).alias("pos", "e"))
    return rows.where("pos IS NOT NULL").select("book_id", F.col("pos").cast("bigint").alias("pos"), "e.title", "e.filepos")


def q_opf_cover(spark, sf_dir):
    return unpacked.opf_cover(unpacked_books(spark, sf_dir))


def _parts(spark, sf_dir) -> DataFrame:
    """A few PCM bytes per line of each document."""
    chapters = document_chapters(spark, sf_dir)
    lines = explode_rows(chapters, KEY, F.split("text", "\n", -1), "part_idx", "line")
    pcm = F.unhex(F.repeat(F.lpad(F.hex(F.col("part_idx") % 256), 4, "0"), F.length("line") % 9 * 2))
    return lines.select(
        *KEY, "part_idx", pcm.alias("pcm"),
        F.when((F.col("chapter_idx") % 11 == 0) & (F.col("part_idx") == 3), 22050).otherwise(24000).cast("bigint").alias("rate"),
        F.lit(1).cast("bigint").alias("channels"), F.lit(2).cast("bigint").alias("width"),
    )


def q_merge_wav(spark, sf_dir):
    merged = wav.merge_pcm(_parts(spark, sf_dir), silence_between_ms=1)
    return merged.select(
        *KEY, F.coalesce(F.lower(F.sha2(F.lower(F.hex("wav")), 256)), F.lit("")).alias("digest"),
        F.coalesce("error", F.lit("")).alias("error"),
    )


def q_scan_wav(spark, sf_dir):
    files = _parts(spark, sf_dir).select(
        *KEY, "part_idx", wav.wav_bytes(F.col("pcm"), F.col("rate"), F.col("channels"), F.col("width")).alias("content")
    )
    return wav.scan_wav(files).drop("content")


QUERIES = {
    "page_titles": q_titles,
    "page_headings": q_headings,
    "page_text": q_text,
    "page_segments": q_segments,
    "page_heading_chapters": q_heading_chapters,
    "page_toc_chapters": q_toc_chapters,
    "epub_chapters": q_epub,
    "epub_metadata": q_epub_metadata,
    "archive_errors": q_archive_errors,
    "cover_selection": q_covers,
    "ncx_entries": q_ncx,
    "unpacked_chapters": q_unpacked_chapters,
    "kindle_metadata": q_unpacked_metadata,
    "opf_cover": q_opf_cover,
    "merge_wav": q_merge_wav,
    "scan_wav": q_scan_wav,
}


def _unescape(x: str) -> str:
    for entity, char in (
        ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&nbsp;", "\xa0"),
    ):
        x = f"replace({x}, '{entity}', '{char}')"
    return f"replace(replace(replace({x}, '&amp;', chr(1)), '&amp', chr(1)), chr(1), '&')"


def _clean(x: str) -> str:
    return sql.strip(_unescape(sql.sub(x, "<[^>]+>", "''")))


def _page_text(x: str) -> str:
    one = sql.sub(x, "(?is)<h[1-6][^>]*>.*?</h[1-6]>", "''")
    one = sql.sub(one, r"(?i)<br\s*/?>", "chr(10)")
    one = sql.sub(sql.sub(one, "(?i)<p[^>]*>", "chr(10)"), "(?i)</p>", "chr(10)")
    return _clean(one)


def _page_lines(x: str) -> str:
    return (
        f"list_filter(list_transform({sql.lines(x)}, lambda l: {sql.strip('l')}), lambda l: l <> '')"
    )


# What references stand for: HTML5's names, and numbers below 160, some of which stand for others.
_REFERENCES = "refs(name, char) AS (VALUES " + ", ".join(
    f"('{name}', '{char.replace("'", "''")}')"
    for name, char in [*html.entities.html5.items(), *((f"#{n}", html.unescape(f"&#{n};")) for n in range(160))]
) + ")"
_OLD_NAMES = "|".join(sorted((n for n in html.entities.html5 if not n.endswith(";")), key=len, reverse=True))


def _readable(name: str, source: str, key: str) -> str:
    """CTEs ending in ``name``: the key and ``t`` of a source's rows, ``t`` without tags, unescaped as in HTML5, stripped.

    A reference is a number, else a whole name, else the longest old name (those
    without a semicolon) that stands there.
    """
    return (
        f"{name}_cut AS (SELECT {key}, unnest(ps) AS part, generate_subscripts(ps, 1) AS i FROM "
        f"(SELECT {key}, coalesce(string_split({sql.sub('t', '<[^>]+>', "''")}, '&'), [NULL]) AS ps FROM {source})), "
        f"{name}_found AS (SELECT *, regexp_extract(part, '^#(?:[0-9]+|[xX][0-9a-fA-F]+);?') AS digits, "
        r"regexp_extract(part, '^[^\t\n\f <&#;]{1,32};?') AS whole, "
        f"regexp_extract(part, '^(?:{_OLD_NAMES})') AS old FROM {name}_cut), "
        f"{name}_number AS (SELECT *, CASE WHEN digits <> '' THEN "
        f"coalesce(try_cast(regexp_replace(rtrim(digits[2:], ';'), '^[xX]0*', '0x0') AS UBIGINT), 1114112) END AS n FROM {name}_found), "
        f"{name} AS (SELECT {key}, {sql.strip("string_agg(CASE WHEN i = 1 THEN part "
        "WHEN n < 160 THEN by_number.char || substr(part, length(digits) + 1) "
        "WHEN n > 1114111 OR n BETWEEN 55296 AND 57343 THEN chr(65533) || substr(part, length(digits) + 1) "
        "WHEN n BETWEEN 64976 AND 65007 OR n % 65536 >= 65534 THEN substr(part, length(digits) + 1) "
        "WHEN n IS NOT NULL THEN chr(n::INTEGER) || substr(part, length(digits) + 1) "
        "WHEN by_name.char IS NOT NULL THEN by_name.char || substr(part, length(whole) + 1) "
        "WHEN by_old.char IS NOT NULL THEN by_old.char || substr(part, length(old) + 1) "
        "ELSE '&' || part END, '' ORDER BY i)")} AS t FROM {name}_number "
        "LEFT JOIN refs AS by_number ON by_number.name = '#' || n LEFT JOIN refs AS by_name ON by_name.name = whole "
        f"LEFT JOIN refs AS by_old ON by_old.name = old GROUP BY {key})"
    )


def _numbered(columns: str, source: str) -> str:
    """CTE ``rows``: some columns of a source, and a number ``r`` of each row."""
    return f"rows AS MATERIALIZED (SELECT row_number() OVER () AS r, {columns} FROM {source})"


_HEADS = (
    "levels AS (SELECT r, unnest([1, 2, 3, 4, 5, 6]) AS level, unnest(["
    + ", ".join(f"regexp_extract(markup, '(?is)<h{n}[^>]*>(.*?)</h{n}>', 1)" for n in range(1, 7))
    + f"]) AS t FROM rows), {_readable('level_texts', 'levels', 'r, level')}, "
    "heads AS (SELECT r, coalesce(arg_min(t, level) FILTER (t <> ''), '') AS head FROM level_texts GROUP BY r)"
)


def _blocks(x: str) -> str:
    """Markup with paragraphs on lines of their own and without headings."""
    one = sql.sub(x, "(?is)<h[1-6][^>]*>.*?</h[1-6]>", "''")
    return sql.sub(sql.sub(one, rf"(?i)<br{sql.B}*/?>", "chr(10)"), "(?i)<p[^>]*>|</p>", "chr(10)")


_TEXTS = f"blocks AS (SELECT r, {_blocks('markup')} AS t FROM rows), {_readable('texts', 'blocks', 'r')}"
_TITLES = (
    "titles AS (SELECT r, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS t FROM rows), "
    + _readable("clean", "titles", "r")
)

_VARIED = (
    "varied AS (SELECT page_id, regexp_extract(url, '//([^/]+)', 1) AS host, CASE page_id % 5 "
    "WHEN 1 THEN replace(replace(html, '<h1>', '<h2>'), '</h1>', '</h2>') "
    "WHEN 2 THEN replace(html, '<article>', '<article><h2>Early &amp; late</h2>One.<br/>Two.') "
    "WHEN 3 THEN replace(html, '<article>', '<article><h1> &nbsp; </h1>A &lt; B<H3 class=''x''>Third</H3>C') "
    "WHEN 4 THEN replace(replace(html, '<h1>', '<div>'), '</h1>', '</div>') ELSE html END AS markup FROM pages)"
)
_EXPLODED = (
    "ex AS (SELECT * EXCLUDE (ls), unnest(ls) AS text, (generate_subscripts(ls, 1) - 1)::BIGINT AS seg_pos FROM ch)"
)
_SECTIONS = (
    "string_split(regexp_replace(markup, '(?is)(?:<h1[^>]*>(.*?)</h1>|<h2[^>]*>(.*?)</h2>|<h3[^>]*>(.*?)</h3>)', "
    r"chr(1) || '\1\2\3' || chr(2), 'g'), chr(1))"
)
_SEC_TITLE = sql.strip(sql.sub("string_split(part, chr(2))[1]", "<[^>]+>", "''"))
_SECTION = "(?is)<h1[^>]*>.*?</h1>|<h2[^>]*>.*?</h2>|<h3[^>]*>.*?</h3>"
_SECTION_TITLE = sql.strip(sql.sub("regexp_extract(element, '(?is)^<h[1-3][^>]*>(.*)</h[1-3]>$', 1)", "<[^>]+>", "''"))
_PARTS = "string_split(html, '<p>')"

ORACLES = {
    "page_titles": f"WITH {_REFERENCES}, {_numbered('page_id, html', 'pages')}, {_TITLES} "
    "SELECT page_id, t AS title FROM rows JOIN clean USING (r)",
    "page_headings": f"WITH {_REFERENCES}, {_VARIED}, {_numbered('page_id, markup', 'varied')}, {_HEADS} "
    "SELECT page_id, head AS heading FROM rows JOIN heads USING (r)",
    "page_text": f"WITH {_REFERENCES}, {_VARIED}, {_numbered('page_id, markup', 'varied')}, {_TEXTS} "
    "SELECT page_id, t AS text FROM rows JOIN texts USING (r)",
    "page_segments": f"WITH {_REFERENCES}, {_VARIED}, {_numbered('host, page_id, markup', 'varied')}, {_HEADS}, {_TEXTS}, "
    f"h AS (SELECT host AS book_id, page_id AS chapter_idx, head, {_page_lines('t')} AS ls "
    "FROM rows JOIN heads USING (r) JOIN texts USING (r)), ch AS (SELECT book_id, chapter_idx, "
    f"CASE WHEN head = '' THEN 'Section ' || (chapter_idx + 1) ELSE head END AS title, ls FROM h), {_EXPLODED} "
    "SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY chapter_idx, seg_pos) - 1 AS seg_idx FROM ex",
    "page_heading_chapters": f"WITH {_REFERENCES}, {_VARIED}, "
    f"sp AS (SELECT page_id, markup, regexp_extract_all(markup, '{_SECTION}') AS hs, regexp_split_to_array(markup, '{_SECTION}') AS bs FROM varied), "
    "pt AS (SELECT page_id, unnest(hs) AS element, unnest(bs[2:]) AS body, generate_subscripts(hs, 1) - 1 AS chapter_idx FROM sp WHERE len(hs) > 0), "
    f"al AS (SELECT page_id, chapter_idx, {_SECTION_TITLE} AS head, body AS markup FROM pt "
    "UNION ALL SELECT page_id, 0, 'Chapter 1', markup FROM sp WHERE len(hs) = 0), "
    f"{_numbered('*', 'al')}, {_TEXTS}, "
    "ch AS (SELECT page_id::VARCHAR AS book_id, chapter_idx, CASE WHEN head = '' THEN 'Section ' || (chapter_idx + 1) ELSE head END AS title, "
    f"{_page_lines('t')} AS ls FROM rows JOIN texts USING (r)), {_EXPLODED} SELECT book_id, chapter_idx::BIGINT AS chapter_idx, title, seg_pos, text FROM ex",
    "page_toc_chapters": f"WITH sp AS (SELECT page_id, {_PARTS} AS ps FROM pages), "
    "pt AS (SELECT page_id, unnest(ps[2:]) AS part, generate_subscripts(ps[2:], 1) AS n, len(ps) - 1 AS total FROM sp WHERE len(ps) > 1), "
    # the entry of part 4 is skipped; part 3 has no following anchor and runs to the end of the page
    # (or to the name of anchor 40, which mentions it)
    "t3 AS (SELECT page_id, string_agg(CASE WHEN n = 3 THEN part ELSE '<p>' || part END, '' ORDER BY n) || "
    "CASE WHEN any_value(total) >= 40 THEN '<a id=\"' ELSE '' END AS body FROM pt WHERE n BETWEEN 3 AND 39 GROUP BY page_id), "
    "bd AS (SELECT page_id, n, CASE WHEN n = 3 AND total > 3 THEN t3.body ELSE part END AS body FROM pt LEFT JOIN t3 USING (page_id) WHERE n <> 4), "
    "ch AS (SELECT page_id::VARCHAR AS book_id, (n - 1)::BIGINT AS chapter_idx, CASE WHEN n % 2 = 0 THEN 'Part ' || n ELSE 'Section ' || n END AS title, "
    f"{_page_lines(_page_text("'<p>' || body"))} AS ls FROM bd), {_EXPLODED} SELECT * FROM ex",
    "epub_chapters": f"WITH {_REFERENCES}, {_numbered('page_id, html AS markup', 'pages')}, {_HEADS}, {_TEXTS}, "
    f"h AS (SELECT page_id::VARCHAR AS book_id, 1::BIGINT AS chapter_idx, head, {_page_lines('t')} AS ls "
    "FROM rows JOIN heads USING (r) JOIN texts USING (r)), ch AS (SELECT book_id, chapter_idx, "
    f"CASE WHEN head = '' THEN 'Section 2' ELSE head END AS title, 'text/page%20one.xhtml' AS source_file, ls FROM h), {_EXPLODED} SELECT * FROM ex",
    "epub_metadata": "SELECT page_id::VARCHAR AS book_id, CASE WHEN page_id % 3 = 0 THEN 'book-' || page_id ELSE 'Page ' || page_id || ' & more' END AS title, "
    "CASE WHEN page_id % 4 = 0 THEN '' ELSE 'Writer ' || page_id % 10 END AS author, CASE page_id % 5 WHEN 0 THEN 'es' ELSE 'en' END AS language FROM pages",
    "archive_errors": "SELECT page_id::VARCHAR AS book_id, CASE page_id % 10 WHEN 3 THEN 'text/page%20one.xhtml' ELSE '' END AS name, "
    "CASE page_id % 10 WHEN 3 THEN 'Unreadable page' ELSE 'Corrupt or invalid ZIP' END AS error FROM pages WHERE page_id % 10 BETWEEN 1 AND 4",
    "cover_selection": "SELECT page_id::VARCHAR AS book_id, CASE page_id % 7 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 WHEN 4 THEN 4 ELSE 5 END::BIGINT AS rank, "
    "CASE page_id % 7 WHEN 1 THEN 'img/front.png' WHEN 2 THEN 'img/meta.gif' WHEN 3 THEN 'img/exact.webp' WHEN 4 THEN 'img/front.png' "
    "WHEN 6 THEN 'img/meta.gif' ELSE 'img/first.jpg' END AS name, CASE page_id % 7 WHEN 1 THEN '.png' WHEN 2 THEN '.gif' WHEN 3 THEN '.webp' "
    "WHEN 4 THEN '.png' WHEN 6 THEN '.gif' ELSE '.jpg' END AS suffix, CASE page_id % 7 WHEN 1 THEN 'd' WHEN 2 THEN 'b' WHEN 3 THEN 'c' "
    "WHEN 4 THEN 'd' WHEN 6 THEN 'b' ELSE 'a' END AS content FROM pages",
    "ncx_entries": f"SELECT page_id::VARCHAR AS book_id, (n - 1)::BIGINT AS pos, CASE WHEN n % 2 = 0 THEN 'Part ' || n || ' & on' ELSE '' END AS title, "
    f"n::BIGINT AS filepos FROM (SELECT page_id, unnest(range(1, len({_PARTS}))) AS n FROM pages WHERE page_id % 6 < 4)",
    "unpacked_chapters": f"WITH sp AS (SELECT page_id, html, {_PARTS} AS ps FROM pages), "
    "pt AS (SELECT page_id, unnest(ps[2:]) AS part, generate_subscripts(ps[2:], 1) AS n FROM sp WHERE page_id % 6 < 4 AND len(ps) > 1), "
    "toc AS (SELECT page_id, n - 1 AS chapter_idx, CASE WHEN n % 2 = 0 THEN 'Part ' || n || ' & on' ELSE '' END AS head, '<p>' || part AS body FROM pt), "
    f"sec AS (SELECT page_id, {_SECTIONS.replace('markup', 'html')} AS hs, html FROM sp WHERE NOT (page_id % 6 < 4 AND len(ps) > 1)), "
    "hd AS (SELECT page_id, unnest(hs[2:]) AS part, generate_subscripts(hs[2:], 1) - 1 AS chapter_idx FROM sec WHERE len(hs) > 1), "
    f"al AS (SELECT * FROM toc UNION ALL SELECT page_id, chapter_idx, {_SEC_TITLE} AS head, string_split(part, chr(2))[2] AS body FROM hd "
    "UNION ALL SELECT page_id, 0, 'Chapter 1', html FROM sec WHERE len(hs) = 1), "
    "ch AS (SELECT page_id::VARCHAR AS book_id, chapter_idx::BIGINT AS chapter_idx, CASE WHEN head = '' THEN 'Section ' || (chapter_idx + 1) ELSE head END AS title, "
    f"{_page_lines(_page_text('body'))} AS ls FROM al), {_EXPLODED} SELECT book_id, chapter_idx, title, seg_pos, text FROM ex",
    "kindle_metadata": f"WITH {_REFERENCES}, {_numbered('page_id, html', 'pages')}, {_TITLES} SELECT page_id::VARCHAR AS book_id, CASE WHEN page_id % 5 <> 4 AND page_id % 3 > 0 THEN 'Kindle ' || page_id "
    "ELSE coalesce(nullif(t, ''), page_id::VARCHAR) END AS title, "
    "'' AS author, CASE page_id % 5 WHEN 4 THEN 'en' ELSE 'fr' END AS language FROM rows JOIN clean USING (r)",
    "opf_cover": "SELECT page_id::VARCHAR AS book_id, 'front.gif' AS name, '.gif' AS suffix FROM pages WHERE page_id % 5 <> 4 AND page_id % 4 <> 1",
}

_PCM = (
    "ls AS (SELECT source AS book_id, doc_id AS chapter_idx, string_split(text, chr(10)) AS ls FROM documents), "
    "pt AS (SELECT book_id, chapter_idx, unnest(ls) AS line, (generate_subscripts(ls, 1) - 1)::BIGINT AS part_idx FROM ls), "
    "pc AS (SELECT *, repeat(printf('%04x', part_idx % 256), (length(line) % 9 * 2)::INT) AS h, "
    "CASE WHEN chapter_idx % 11 = 0 AND part_idx = 3 THEN 22050 ELSE 24000 END::BIGINT AS rate FROM pt)"
)


def _le(x: str, size: int) -> str:
    digits = f"printf('%0{size * 2}x', {x})"
    return " || ".join(f"substr({digits}, {2 * i + 1}, 2)" for i in reversed(range(size)))


ORACLES["scan_wav"] = (
    f"WITH {_PCM} SELECT book_id, chapter_idx, part_idx, rate, 1::BIGINT AS channels, 2::BIGINT AS width, "
    "(length(h) // 4)::BIGINT AS frames FROM pc"
)
ORACLES["merge_wav"] = (
    f"WITH {_PCM}, mg AS (SELECT book_id, chapter_idx, string_agg(h, repeat('0000', 24) ORDER BY part_idx) AS h, "
    "count(DISTINCT rate) > 1 AS mixed FROM pc GROUP BY book_id, chapter_idx) SELECT book_id, chapter_idx, "
    "CASE WHEN mixed THEN '' ELSE sha256('52494646' || "
    f"{_le('length(h) // 2 + 36', 4)} || '57415645666d74201000000001000100c05d000080bb000002001000' || '64617461' || "
    f"{_le('length(h) // 2', 4)} || h) END AS digest, CASE WHEN mixed THEN 'WAV format mismatch' ELSE '' END AS error FROM mg"
)
