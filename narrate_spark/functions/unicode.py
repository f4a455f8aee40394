"""Unicode-aware whitespace helpers as Column expressions.

Java's ``\\s`` and Spark's ``trim`` are ASCII-centred.  Text from books uses
no-break spaces, ideographic spaces and information separators, so every
operator goes through the explicit classes below (they also avoid the slow
``(?U)`` regex mode).  Wide blanks sit behind a range intersection, which lets
the matcher dismiss Latin text after one comparison.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_WIDE = r"[\u1680-\u3000&&[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]"
_WIDE_INLINE = r"[\u1680-\u3000&&[\u1680\u2000-\u200a\u202f\u205f\u3000]]"
# All blanks that separate words, as the inside of a character class.
BLANK_SET = rf"\t-\r\x1c-\x20\x85\xa0{_WIDE}"
# Blanks that do not end a line.
INLINE_SET = rf"\t\x1f\x20\xa0{_WIDE_INLINE}"
BLANK = f"[{BLANK_SET}]"
INLINE = f"[{INLINE_SET}]"
DIGIT = r"\p{Nd}"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85[\u2000-\u2fff&&[\u2028\u2029]]]"
_OTHER_LINE_END = r"[\r\x0b\x0c\x1c-\x1e\x85[\u2000-\u2fff&&[\u2028\u2029]]]"

# The same blanks as plain characters.
BLANK_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

Step = Callable[[Column], Column]


def each(texts: Column, *steps: Step) -> Column:
    """Apply the steps to every text of an array.

    Each step is its own lambda, so a step may mention its input many times
    without the steps before it being evaluated again.
    """
    for step in steps:
        texts = F.transform(texts, step)
    return texts


def chain(text: Column, *steps: Step) -> Column:
    """Apply the steps to one text."""
    return F.get(each(F.array(text), *steps), F.lit(0))


def guarded(guard: str, pattern: str, replacement: str) -> Step:
    """A replacement that only runs on texts the cheaper ``guard`` finds."""
    return lambda t: F.when(
        t.rlike(guard), F.regexp_replace(t, pattern, replacement)
    ).otherwise(t)


def where_contains(literals: str | tuple[str, ...], step: Step) -> Step:
    """A step that only runs on texts holding one of some literals.

    Finding a literal is a byte comparison, far cheaper than any pattern.
    """
    wanted = (literals,) if isinstance(literals, str) else literals

    def run(text: Column) -> Column:
        found = F.contains(text, F.lit(wanted[0]))
        for literal in wanted[1:]:
            found = found | F.contains(text, F.lit(literal))
        return F.when(found, step(text)).otherwise(text)

    return run


def replaced(pattern: str, replacement: str) -> Step:
    """A pattern replacement as a step."""
    return lambda t: F.regexp_replace(t, pattern, replacement)


def ustrip(text: Column) -> Column:
    """Remove blanks of every kind from both ends."""
    return F.btrim(text, F.lit(BLANK_CHARS))


# Noncharacters that mark places inside a text; its own ones are escaped meanwhile.
MARK_CHARS = "\ufdd0\ufdd1"
ESCAPE = "\ufdd2"
ESCAPED = MARK_CHARS + ESCAPE
ESCAPE_CODES = "\ufdd3\ufdd4\ufdd5"


def _escape(text: Column) -> Column:
    for char, code in list(zip(ESCAPED, ESCAPE_CODES, strict=True))[::-1]:
        text = F.replace(text, F.lit(char), F.lit(ESCAPE + code))
    return text


def _unescape(text: Column) -> Column:
    for char, code in zip(ESCAPED, ESCAPE_CODES, strict=True):
        text = F.replace(text, F.lit(ESCAPE + code), F.lit(char))
    return text


escape_marks = where_contains(tuple(ESCAPED), _escape)
unescape_marks = where_contains(ESCAPE, _unescape)


def keeping_marks(*steps: Step) -> Step:
    """Steps that neither drop nor move characters but blanks, as one step that leaves own marks escaped.

    Meanwhile one character stands for each of them, so that lengths do not change.
    """
    stand_in = where_contains(tuple(ESCAPED), lambda t: F.translate(t, ESCAPED, ESCAPE * len(ESCAPED)))

    def run(text: Column) -> Column:
        def put_back(marked: Column) -> Column:
            own = F.transform(F.regexp_extract_all(text, F.lit(f"([{ESCAPED}])"), F.lit(1)), _escape)
            parts = F.split(marked, ESCAPE, -1)
            return F.array_join(F.zip_with(F.concat(F.array(F.lit("")), own), parts, lambda o, p: F.concat(o, p)), "")

        return chain(text, stand_in, *steps, where_contains(ESCAPE, put_back))

    return run


unify_separators = guarded(_OTHER_LINE_END, LINE_END, "\n")


def drop_final_newline(text: Column) -> Column:
    """Without one newline at the very end."""
    return F.when(
        F.endswith(text, F.lit("\n")), F.substr(text, F.lit(1), F.length(text) - 1)
    ).otherwise(text)


def unify_line_ends(text: Column) -> Column:
    """Turn every line separator into a newline and drop a final one."""
    return chain(text, unify_separators, drop_final_newline)


def split_lines(text: Column) -> Column:
    """Lines of a text as an array; an empty text has no lines."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(
        F.split(unify_line_ends(text), "\n", -1)
    )


COUNT_STEPS: tuple[Step, ...] = (
    ustrip,
    lambda t: F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, f"{BLANK}++", -1))),
)


def count_words(text: Column) -> Column:
    """Number of blank-separated words."""
    return chain(text, *COUNT_STEPS).cast("bigint")


def fold_case(text: Column) -> Column:
    """Caseless comparison key (sharp s expands, as in full case folding)."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))
