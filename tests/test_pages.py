"""Page queries and their SQL on references, blanks and marks that the given pages do not hold."""

import html

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from narrate_spark.plans import page_queries
from tools.check import frame

NAMES = ["page_titles", "page_text", "page_segments", "page_headings", "epub_chapters", "page_heading_chapters", "kindle_metadata"]
ODD = [
    "cut &quot", "cut &lt", "cut &gt", "cut &amp", "cut &am", "cut &", "a &lt b &ampc &quotd", "&notit; &notin; &noti",
    "&eacute;&eacute &hellip; &hellip &mdash;", "&NotEqualTilde;&fjlig;&apos;&NewLine;x&Tab;y", "&amp;lt; &amp;amp; &ampamp; &#38;lt;",
    "&#8217;&#8217 &#x2019;&#X2019x &#x1F600;", "&#0;&#13;&#128;&#x9f;&#1;&#127;&#159;&#160;", "&#xD800;&#xFDD0;&#x1FFFE;&#1114111;&#1114112;",
    "&#99999999999999999999999;&#x99999999999999999999;&#x00000000000000000000026;&#000000000000000000000038;", "&#; &#x; &#xg &#a &;; &&amp;&",
    "A&nbsp;", "<i>&copy</i>&reg", "'\"", "a\x01b\x02c", "é&É&Eacute;&Eacute", "&AMP;&AMP&LT&GT;",
]
PAGE = (
    "<html><head><title> {0} </title></head><body><article><h1>{0}</h1><p>One {0}<br\xa0/>two<br 　/>three</p>"
    "<h2 id='x'>{0} b</H2>\x0bfour\x1cfive<p class='a'>six &copy 2020<h3>{0}"
    "</article></body></html>"
)


@pytest.fixture(scope="module")
def odd_pages(tmp_path_factory):
    folder = tmp_path_factory.mktemp("odd")
    # every text meets every rule on page numbers
    texts = [ODD[i // 15] for i in range(15 * len(ODD))]
    rows = {
        "page_id": pa.array(range(len(texts)), pa.int64()),
        "url": [f"https://host{i % 7}.example/{i}" for i in range(len(texts))],
        "html": [PAGE.format(t) for t in texts],
    }
    pq.write_table(pa.table(rows), folder / "pages.parquet")
    return str(folder)


@pytest.mark.parametrize("name", NAMES)
def test_odd_pages_match_the_sql(spark, odd_pages, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{odd_pages}/pages.parquet'")
    mine = frame(page_queries.QUERIES[name](spark, odd_pages).toPandas())
    theirs = frame(con.execute(page_queries.ORACLES[name]).df())
    assert list(mine.columns) == list(theirs.columns)
    assert mine.map(str).equals(theirs.map(str))


def test_titles_in_sql_are_unescaped_as_in_html5(odd_pages):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{odd_pages}/pages.parquet'")
    got = dict(con.execute(page_queries.ORACLES["page_titles"]).fetchall())
    plain = [t.replace("<i>", "").replace("</i>", "") for t in ODD]
    assert [got[15 * i] for i in range(len(ODD))] == [html.unescape(t).strip() for t in plain]
