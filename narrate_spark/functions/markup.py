"""HTML/XHTML to narration text, as Column expressions."""

from __future__ import annotations

import html
import html.entities

from pyspark.sql import Column
from pyspark.sql import functions as F

from narrate_spark.functions.unicode import BLANK, ESCAPE, MARK_CHARS, chain, escape_marks, ustrip

# Noncharacters; those that a page itself holds are escaped in its sections.
SPLIT, MARK = MARK_CHARS
# Stands in no escaped text: an escape is followed by another code there.
OPEN = ESCAPE + "\ufdd6"

# Entities handled inside the JVM; the ampersand comes last so that an escaped
# entity is only unescaped once.
_COMMON = {
    "&lt;": "<",
    "&gt;": ">",
    "&quot;": '"',
    "&#39;": "'",
    "&apos;": "'",
    "&nbsp;": "\xa0",
    "&copy;": "©",
    "&reg;": "®",
    "&middot;": "·",
    "&mdash;": "—",
    "&ndash;": "–",
    "&hellip;": "…",
    "&laquo;": "«",
    "&raquo;": "»",
    "&amp;": "&",
}
_OTHER_ENTITY = "&(?!(?:" + "|".join(e[1:-1] for e in _COMMON) + ");)[#A-Za-z]"
# The standard names, and the texts of the references below 160, some of which stand for others.
_BETWEEN = "\ue000"
_NAMES = sorted(html.entities.html5)
_OLD_NAMES = sorted((n for n in _NAMES if not n.endswith(";")), key=len, reverse=True)
_LOW = [html.unescape(f"&#{n};") for n in range(160)]


def _constant(values: list[str]) -> Column:
    """A constant array; made of one literal, which the optimizer splits once."""
    return F.split(F.lit(_BETWEEN.join(values)), _BETWEEN, -1)


def _numbered(number: Column) -> Column:
    """Text of a numeric reference; the number is null where it is too large."""
    one = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    nothing = number.between(0xFDD0, 0xFDEF) | (number.bitwiseAND(0xFFFE) == 0xFFFE)
    return (
        F.when(number.isNull() | (number > 0x10FFFF) | number.between(0xD800, 0xDFFF), "\ufffd")
        .when(number < len(_LOW), F.get(_constant(_LOW), number.cast("int")))
        .when(nothing, "")
        .otherwise(one)
    )


def _reference(part: Column) -> Column:
    """Text behind an ampersand, with the reference that it begins with replaced."""

    def found(pattern: str) -> Column:
        return F.regexp_extract(part, rf"\A{pattern}", 1)

    def after(pattern: str) -> Column:
        return F.regexp_replace(part, rf"\A{pattern}", "")

    decimal, hexadecimal = "#([0-9]+);?", "#[xX]([0-9a-fA-F]+);?"
    digits, digits16 = found(decimal), found("#[xX]0*([0-9a-fA-F]+);?")
    number16 = F.when(F.length(digits16) <= 8, F.conv(F.substring(digits16, 1, 8), 16, 10).try_cast("bigint"))
    # the whole name, then the longest old one that it begins with
    names = F.array(found(r"([^\t\n\f <&#;]{1,32};?)"), found("(" + "|".join(_OLD_NAMES) + ")"))
    places = F.transform(
        names, lambda n: F.struct(n.alias("name"), F.array_position(_constant(_NAMES), n).cast("int").alias("at"))
    )
    values = _constant([html.entities.html5[n] for n in _NAMES])
    replaced = F.transform(
        F.filter(places, lambda p: (p["name"] != "") & (p["at"] > 0)),
        lambda p: F.concat(F.get(values, p["at"] - 1), F.substr(part, F.length(p["name"]) + 1)),
    )
    return (
        F.when(digits != "", F.concat(_numbered(digits.try_cast("bigint")), after(decimal)))
        .when(digits16 != "", F.concat(_numbered(number16), after(hexadecimal)))
        .otherwise(F.coalesce(F.get(replaced, F.lit(0)), F.concat(F.lit("&"), part)))
    )


def unescape(text: Column) -> Column:
    """HTML5 unescape, all of it in the JVM.

    Texts holding only common entities take a few replacements.  Others are cut at
    ampersands, and each part is looked up: a whole name, else the longest old name
    that it begins with, else a number.
    """

    def common(t: Column) -> Column:
        for entity, char in _COMMON.items():
            t = F.replace(t, F.lit(entity), F.lit(char))
        return t

    def every(t: Column) -> Column:
        parts = F.transform(F.split(t, "&", -1), lambda p, i: F.when(i == 0, p).otherwise(_reference(p)))
        return F.array_join(parts, "")

    return chain(text, lambda t: F.when(t.rlike(_OTHER_ENTITY), every(t)).otherwise(common(t)))


def strip_tags(text: Column) -> Column:
    """Remove every tag."""
    return F.regexp_replace(text, "<[^>]+>", "")


def html_title(markup: Column) -> Column:
    """Text of the first title element, or an empty string."""
    inner = F.regexp_extract(markup, r"(?is)<title[^>]*>(.*?)</title>", 1)
    return ustrip(unescape(strip_tags(inner)))


def heading(markup: Column) -> Column:
    """First heading by level (not by position) whose text is not empty."""
    # only the first start is tried: where it is not closed, none behind it is
    levels = F.array(
        *(F.regexp_extract(markup, rf"(?is)\A(?>.*?<h{n})(?>[^>]*>)(.*?)</h{n}>", 1) for n in range(1, 7))
    )
    texts = F.transform(levels, lambda inner: ustrip(unescape(strip_tags(inner))))
    return F.coalesce(F.get(F.filter(texts, lambda t: t != ""), F.lit(0)), F.lit(""))


def block_text(markup: Column) -> Column:
    """Markup to text before unescaping: headings out, paragraphs on own lines."""
    one = F.regexp_replace(markup, r"(?is)<h[1-6][^>]*>.*?</h[1-6]>", "")
    one = F.regexp_replace(one, rf"(?i)<br{BLANK}*/?>", "\n")
    one = F.regexp_replace(one, r"(?i)<p[^>]*>|</p>", "\n")
    return strip_tags(one)


def xhtml_to_text(markup: Column) -> Column:
    """Readable text of a page; scripts and styles are kept as they are."""
    return ustrip(unescape(block_text(markup)))


def _closed(markup: Column, levels: str, mark: str) -> Column:
    """The markup with ``mark`` written into the starts of headings that are not closed.

    A start is closed when a closing tag of its level stands behind its own end.
    What lies behind the last such place is cut off once per level, so that no
    search for a closing tag is in vain and all searches together pass a page once.
    """
    for level in levels:
        close = f"</h{level}>"
        head = F.regexp_extract(markup, rf"(?is)\A(.*>)[^>]*{close}", 1)
        tail = F.substr(markup, F.length(head) + 1)
        marked = F.concat(head, F.regexp_replace(tail, f"(?i)<(?=h{level})", f"<{mark}"))
        markup = F.when(markup.rlike(f"(?i)<h{level}"), marked).otherwise(markup)
    return markup


def heading_sections(markup: Column) -> Column:
    """Array of ``heading SPLIT body`` strings with escaped marks, one per h1-h3 element.

    Whatever stands before the first heading is not part of any section.  The time
    taken grows with the page, also where headings are not closed.
    """
    steps = [
        escape_marks,
        lambda m: _closed(m, "1", OPEN),
        lambda m: _closed(m, "2", OPEN),
        lambda m: _closed(m, "3", OPEN),
        lambda m: F.regexp_replace(m, r"(?is)<(h[1-3])[^>]*>(.*?)</\1>", f"{MARK}$2{SPLIT}"),
        lambda m: F.replace(m, F.lit("<" + OPEN), F.lit("<")),
    ]
    parts = F.split(chain(markup, *steps), MARK, -1)
    return F.slice(parts, F.lit(2), F.size(parts))
