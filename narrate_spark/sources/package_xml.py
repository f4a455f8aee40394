"""Package and contents documents of unpacked books, read in the JVM.

A document is checked for being well-formed first; what is not counts as missing.
Its elements are then cut out by name, whatever their namespace prefix, so an entry
keeps its place also where its label is missing.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from narrate_spark.functions.markup import unescape
from narrate_spark.functions.unicode import chain, ustrip

_GUARD = "_corrupt string, _none string"
_NAME = r"(?:[\w.-]+:)?"
_VALUE = r"""(?:"([^"]*)"|'([^']*)')"""


def well_formed(xml: Column) -> Column:
    """The document without comments, or null when it is none."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "ignoreNamespace": "true"}
    good = F.from_xml(xml, _GUARD, options)["_corrupt"].isNull()
    return F.when(xml.isNotNull() & good, F.regexp_replace(xml, "(?s)<!--.*?-->", ""))


def elements(xml: Column, name: str) -> Column:
    """What follows the name of each element of a kind, up to the next of them, in document order."""
    parts = F.split(xml, rf"<{_NAME}{name}(?=[\s/>])", -1)
    return F.slice(parts, F.lit(2), F.size(parts))


def attribute(element: Column, name: str) -> Column:
    """Value of an attribute, null without one; ``element`` begins behind its name."""
    others = rf"\A(?:\s++(?!{name}\s*=)[^\s=>/]++\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'))*+\s++{name}\s*+=\s*+"
    pattern = others + _VALUE
    value = F.concat(F.regexp_extract(element, pattern, 1), F.regexp_extract(element, pattern, 2))
    return F.when(element.rlike(pattern), unescape(value))


def text_of(xml: Column, name: str) -> Column:
    """Stripped text of the first element of a kind, null when it has none."""
    inner = F.regexp_extract(xml, rf"<{_NAME}{name}(?:\s[^>]*)?/?>([^<]*)", 1)
    return F.nullif(ustrip(unescape(inner)), F.lit(""))


def opf_package(xml: Column) -> Column:
    """Title, author, language, manifest items (id, href) and cover id of a package document."""

    def read(good: Column) -> Column:
        items = F.transform(
            elements(good, "item"), lambda e: F.struct(attribute(e, "id").alias("id"), attribute(e, "href").alias("href"))
        )
        covers = F.filter(elements(good, "meta"), lambda e: attribute(e, "name") == "cover")
        return F.struct(
            text_of(good, "title").alias("title"),
            text_of(good, "creator").alias("author"),
            text_of(good, "language").alias("language"),
            F.coalesce(items, F.array().cast("array<struct<id:string,href:string>>")).alias("items"),
            attribute(F.get(covers, F.lit(0)), "content").alias("cover_id"),
        )

    return chain(xml, well_formed, read)


def ncx_entries(xml: Column) -> Column:
    """Contents (title, filepos) in document order; entries without a file position are left out.

    The label and the target of an entry stand before the entries inside it.
    """

    def entry(point: Column) -> Column:
        target = attribute(F.get(elements(point, "content"), F.lit(0)), "src")
        place = F.regexp_extract(target, r"filepos(\d+)", 1).try_cast("bigint")
        return F.struct(F.coalesce(text_of(point, "text"), F.lit("")).alias("title"), place.alias("filepos"))

    found = F.transform(elements(chain(xml, well_formed), "navPoint"), entry)
    kept = F.filter(found, lambda e: e["filepos"].isNotNull())
    return F.coalesce(kept, F.array().cast("array<struct<title:string,filepos:bigint>>"))
