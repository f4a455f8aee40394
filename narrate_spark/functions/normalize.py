"""Text normalization as whole-text regular expressions.

No Python on the data path: every step is a replacement on the segment text.
Patterns start with a rare literal (a newline, a dash, a dot), which keeps the
search close to one comparison per character, and rewrites whose pattern must
start with a blank only run behind a guard that does not.  Lines are addressed
by the newline in front of them, so one is prepended while lines are classified.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from narrate_spark import constants as K
from narrate_spark.functions.unicode import (
    BLANK,
    DIGIT,
    INLINE,
    INLINE_SET,
    chain,
    drop_final_newline,
    guarded,
    replaced,
    unify_separators,
    ustrip,
    where_contains,
)


def _line_pattern(pattern: str) -> str:
    inside_class = pattern.replace("[{BLANK}", f"[{INLINE_SET}")
    return inside_class.replace("{BLANK}", INLINE).replace("{DIGIT}", DIGIT)


_END = r"(?=\n|\z)"
_SCENE = rf"\n(?=[*•\-–—])(?:{_line_pattern(K.SCENE_LINE)}){_END}"
_TITLE = rf"\n(?:{_line_pattern(K.TITLE_LINE)}){_END}"
_NOISE = rf"\n(?:{'|'.join(_line_pattern(p) for p in K.NOISE_LINES)}){_END}"
_MARKER_LINE = rf"\n(?:{K.SCENE_BREAK_MARKER}|{K.CHAPTER_TITLE_MARKER}){_END}"


def _replace(old: str, new: str):
    return lambda t: F.replace(t, F.lit(old), F.lit(new))


def _lead(text: Column) -> Column:
    return F.concat(F.lit("\n"), text)


def _unlead(text: Column) -> Column:
    return F.substring(text, 2, 2147483647)


WHITESPACE_STEPS = (
    _replace("\t", " "),
    where_contains("  ", replaced(" {2,}", " ")),
    where_contains("\n\n", replaced("\n{2,}", "\n")),
    ustrip,
)

# Strip every line of a newline-separated text; the line count stays.
INLINE_STEPS = (
    replaced(rf"\n{INLINE}++", "\n"),
    guarded(rf"\n(?<={INLINE}\n)", rf"{INLINE}++\n", "\n"),
)

LINE_STEPS = (
    unify_separators,
    drop_final_newline,
    lambda t: F.concat(F.lit("\n"), t, F.lit("\n")),
    *INLINE_STEPS,
    drop_final_newline,
    replaced(_SCENE, "\n" + K.SCENE_BREAK_MARKER),
    replaced(_TITLE, "\n" + K.CHAPTER_TITLE_MARKER),
    replaced(_NOISE, ""),
    _unlead,
)

_LONE_DASH = rf"[-–](?<={BLANK}[-–])"

DIALOGUE_STEPS = (
    _replace("«", '"'),
    _replace("»", '"'),
    _replace("“", '"'),
    _replace("”", '"'),
    _replace("‘", "'"),
    _replace("’", "'"),
    where_contains(("-", "–"), replaced(rf"(?md)^[-–]{BLANK}*+", "— ")),
    where_contains(
        ("-", "–"), guarded(rf"{_LONE_DASH}{BLANK}", rf"{BLANK}+[-–]{BLANK}+", " — ")
    ),
    where_contains(
        ("-", "–"), guarded(rf"{_LONE_DASH}[.!?]", rf"{BLANK}+[-–]([.!?])", " —$1")
    ),
    where_contains(("¿", "¡"), replaced(rf"([¿¡]){BLANK}++", "$1")),
    where_contains("....", replaced(r"\.{4,}", "...")),
    replaced(rf"\.(?:{BLANK}++\.){{2,}}+", "..."),
)

NORMALIZE_STEPS = (
    *WHITESPACE_STEPS,
    *LINE_STEPS,
    *DIALOGUE_STEPS,
    *INLINE_STEPS,
    ustrip,
)


def normalize_whitespace(text: Column) -> Column:
    """Tabs become spaces, runs of spaces or newlines collapse, ends are stripped."""
    return chain(text, *WHITESPACE_STEPS)


def classify_lines(text: Column) -> Column:
    """Drop boilerplate lines; scene breaks and chapter lines become markers."""
    return chain(text, *LINE_STEPS)


def normalize_dialogue(text: Column) -> Column:
    """Plain quotes, em-dash dialogue, tight inverted marks, three-dot ellipsis."""
    return chain(text, *DIALOGUE_STEPS)


def normalize(text: Column) -> Column:
    """The full chain; the result may contain marker lines."""
    return chain(text, *NORMALIZE_STEPS)


def line_kind(line: Column) -> Column:
    """Kind of one line: blank, scene_break, chapter_title, noise or text."""
    return chain(
        line,
        ustrip,
        _lead,
        lambda t: F.when(t == "\n", "blank")
        .when(t.rlike(rf"\A{_SCENE}"), K.KIND_SCENE)
        .when(t.rlike(rf"\A{_TITLE}"), K.KIND_TITLE)
        .when(t.rlike(rf"\A{_NOISE}"), "noise")
        .otherwise(K.KIND_TEXT),
    )


def is_marker(text: Column) -> Column:
    """Whether a line or chunk is a prosody marker."""
    return ustrip(text).isin(K.SCENE_BREAK_MARKER, K.CHAPTER_TITLE_MARKER)


def chunk_kind(text: Column) -> Column:
    """Kind column of a chunk."""
    return (
        F.when(ustrip(text) == K.SCENE_BREAK_MARKER, K.KIND_SCENE)
        .when(ustrip(text) == K.CHAPTER_TITLE_MARKER, K.KIND_TITLE)
        .otherwise(K.KIND_TEXT)
    )


def drop_markers(normalized: Column) -> Column:
    """Normalized text without its marker lines."""
    return F.when(
        F.contains(normalized, F.lit("\x00")),
        _unlead(F.regexp_replace(_lead(normalized), _MARKER_LINE, "")),
    ).otherwise(normalized)
