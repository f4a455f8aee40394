"""Sentence splitting and greedy chunk packing without folds.

Both sequential rules of chunking are regular languages, so neither needs an
array fold:

* a stop is acceptable by what stands around it: a mark behind an abbreviation
  and its closing marks, however many, keeps their stops from a blank, a
  look-ahead rules out continuations.  Acceptable stops
  get a boundary character.  A stop exactly at the start of a sentence does not
  end it; such boundaries are taken out again, every other one in a row of them;
* a packed chunk is "as many characters up to the limit as still end on a
  sentence boundary, else one whole sentence".

Two Unicode noncharacters mark the places; those that a text itself holds are
escaped until it is cut.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from narrate_spark import constants as K
from narrate_spark.functions.unicode import (
    BLANK,
    BLANK_CHARS,
    BLANK_SET,
    ESCAPE,
    INLINE,
    LINE_END,
    MARK_CHARS,
    chain,
    guarded,
    keeping_marks,
    replaced,
    unescape_marks,
    where_contains,
)

SOFT = MARK_CHARS[0]  # between two sentences
HARD = MARK_CHARS[1]  # between chunks that must not merge

_CLOSERS = K.SENTENCE_CLOSERS.replace("-", r"\-")
_TRAILERS = K.WORD_TRAILERS.replace("-", r"\-")
_MARKS = f"[{SOFT}{HARD}]"


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" for c in word)


_ABBREVIATION = "|".join(_either_case(w) for w in K.ABBREVIATIONS)
ABBREVIATED = rf"[{_TRAILERS}](?<=(?:{BLANK}|{HARD}|\A)(?:{_ABBREVIATION})[{_TRAILERS}])[{_TRAILERS}]*+"
NO_STOP = SOFT + SOFT  # behind an abbreviation; never beside another mark
STOP = (
    r"[.!?](?<![.!?]{2})"
    rf"[.!?]*+[{_CLOSERS}]*+"
    rf"(?:{BLANK}++(?!(?:[—–\-]{BLANK}*+)?[{K.CONTINUATION_LETTERS}])|(?={HARD}|\z))"
)
_RUN = rf"[.!?]++[{_CLOSERS}]*+{BLANK}*+"
LEADING_STOP = rf"(?=[.!?])(?<={_MARKS}|\A)({_RUN}){SOFT}({_RUN}{SOFT})?"


def _trim_marks(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANK_CHARS + SOFT + HARD))


MARK_STEPS = (
    replaced(ABBREVIATED, f"$0{NO_STOP}"),
    replaced(STOP, f"$0{SOFT}"),
    lambda t: F.replace(t, F.lit(NO_STOP), F.lit("")),
    guarded(rf"[.!?](?<=(?:{_MARKS}|\A)[.!?])", LEADING_STOP, "$1$2"),
    _trim_marks,
    # blanks between a sentence and its boundary, nearly always just one
    lambda t: F.replace(t, F.lit(f" {SOFT}"), F.lit(SOFT)),
    lambda t: F.replace(t, F.lit(f"\n{SOFT}"), F.lit(SOFT)),
    guarded(rf"{SOFT}(?<={BLANK}{SOFT})", rf"{BLANK}+(?={SOFT})", ""),
)


def _cut(marked: Column, mark: str) -> Column:
    parts = F.split(marked, mark, -1)
    return (
        F.when(marked == "", F.array().cast("array<string>"))
        .when(F.contains(marked, F.lit(ESCAPE)), F.transform(parts, unescape_marks))
        .otherwise(parts)
    )


SENTENCE_STEPS = (keeping_marks(*MARK_STEPS), lambda t: _cut(t, SOFT))


def split_sentences(text: Column) -> Column:
    """Sentences of a text as an array (blank text gives an empty array)."""
    return chain(text, *SENTENCE_STEPS)


_MARKER = f"{K.SCENE_BREAK_MARKER}|{K.CHAPTER_TITLE_MARKER}"
# Hard boundaries around marker lines; only texts with markers pay for it.
_ISLAND_STEPS = (
    where_contains("\x00", replaced(LINE_END, "\n")),
    where_contains(
        "\x00",
        replaced(rf"(?<=\n|\A){INLINE}*+({_MARKER}){INLINE}*+(?=\n|\z)", f"{HARD}$1{HARD}"),
    ),
    lambda t: F.replace(t, F.lit(f"\n{HARD}"), F.lit(HARD)),
    lambda t: F.replace(t, F.lit(f"{HARD}\n"), F.lit(HARD)),
)
_EDGE = f"[{BLANK_SET}{SOFT}{HARD}]"


def pack_steps(max_chars: int | Column = K.DEFAULT_MAX_CHARS):
    """Steps from normalized text to hard-bounded chunks, own marks escaped."""
    if isinstance(max_chars, int):
        if max_chars < 1:
            raise ValueError("max_chars must be at least 1")
        limit: Column = F.lit(str(max_chars))
    else:
        limit = max_chars.cast("string")
    pattern = F.concat(
        F.lit(f"([^{HARD}]{{1,"),
        limit,
        F.lit(rf"}}(?={_MARKS}|\z)|[^{SOFT}{HARD}]+){_MARKS}?"),
    )
    return (
        keeping_marks(
            *_ISLAND_STEPS,
            *MARK_STEPS,
            where_contains(HARD, replaced(rf"{_EDGE}*{HARD}{_EDGE}*+", HARD)),
            lambda t: F.regexp_replace(t, pattern, F.lit(f"$1{HARD}")),
            lambda t: F.rtrim(t, F.lit(HARD)),
            lambda t: F.replace(t, F.lit(SOFT), F.lit(" ")),
        ),
    )


def pack_marked(text: Column, max_chars: int | Column = K.DEFAULT_MAX_CHARS) -> Column:
    """Text with a hard boundary between chunks; blank text gives ``''``."""
    return chain(text, *pack_steps(max_chars))


def cut_chunks(packed: Column) -> Column:
    """Chunks of a packed text."""
    return _cut(packed, HARD)


def chunk_array(text: Column, max_chars: int | Column = K.DEFAULT_MAX_CHARS) -> Column:
    """Chunks of a (normalized) text as an array; markers stand alone."""
    return chain(text, *pack_steps(max_chars), cut_chunks)
