"""SQL surface: ``chunk_text`` as a table function.

    SELECT c.* FROM docs, LATERAL chunk_text(docs.text, 500) c

DataFrame users take ``chunk_array``, which never leaves the JVM.  The table
function applies the same patterns in Python, one text at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from narrate_spark import constants as K
from narrate_spark.functions import sentences as S
from narrate_spark.functions.unicode import BLANK_CHARS, ESCAPE, ESCAPED

_MARKERS = (K.SCENE_BREAK_MARKER, K.CHAPTER_TITLE_MARKER)
_KINDS = dict(zip(_MARKERS, (K.KIND_SCENE, K.KIND_TITLE), strict=True))


def _pattern(java: str):
    import regex

    return regex.compile(java.replace(r"\z", r"\Z"), regex.V1)


def _islands(text: str) -> Iterator[str]:
    """Marker lines, and the text between them."""
    held: list[str] = []
    for line in text.splitlines():
        if line.strip() in _MARKERS:
            yield "\n".join(held)
            yield line.strip()
            held = []
        else:
            held.append(line)
    yield "\n".join(held)


class ChunkText:
    """Table function handler; patterns compile once per task."""

    def __init__(self) -> None:
        self.abbreviated = _pattern(S.ABBREVIATED)
        self.stop = _pattern(S.STOP)
        self.leading = _pattern(S.LEADING_STOP)

    def sentences(self, text: str) -> list[str]:
        """Sentences of one island."""
        own = iter([c for c in text if c in ESCAPED])
        text = text.translate(dict.fromkeys(map(ord, ESCAPED), ESCAPE))
        marked = self.abbreviated.sub(lambda m: m[0] + S.NO_STOP, text)
        marked = self.stop.sub(lambda m: m[0] + S.SOFT, marked).replace(S.NO_STOP, "")
        marked = self.leading.sub(lambda m: m[1] + (m[2] or ""), marked)
        parts = (p.strip(BLANK_CHARS) for p in marked.split(S.SOFT))
        return ["".join(next(own) if c == ESCAPE else c for c in p) if ESCAPE in p else p for p in parts if p]

    def eval(self, text: str, max_chars: int) -> Iterator[tuple[int, str, str]]:
        """Chunks as (chunk_idx, kind, text)."""
        number = 0
        islands = _islands(text) if text and "\x00" in text else [text or ""]
        for island in islands:
            if island in _KINDS:
                yield number, _KINDS[island], ""
                number += 1
                continue
            held = ""
            for sentence in [*self.sentences(island), None]:
                if sentence is not None and held and len(held) + 1 + len(sentence) <= max_chars:
                    held = f"{held} {sentence}"
                    continue
                if held:
                    yield number, K.KIND_TEXT, held
                    number += 1
                held = sentence or ""


def register(spark: SparkSession) -> None:
    """Make ``chunk_text`` known to SQL."""
    handler = udtf(ChunkText, returnType="chunk_idx int, kind string, text string")
    spark.udtf.register("chunk_text", handler)
