"""SQL building blocks of the DuckDB cross-checks.

They follow the meaning of the operators with per-line lists and ordered
reductions, on purpose a different way than the Spark expressions take.
"""

from __future__ import annotations

from narrate_spark import constants as K
from narrate_spark.functions.unicode import BLANK_CHARS

NL = "chr(10)"
_WIDE = r"\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
B = rf"[\x09-\x0d\x1c-\x20\x85\xa0{_WIDE}]"
SEPARATORS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"
SCENE = "(chr(2)||'S'||chr(2))"
TITLE = "(chr(2)||'T'||chr(2))"
CUT = "chr(3)"


def strip(x: str) -> str:
    return f"trim({x}, '{BLANK_CHARS}')"


def sub(x: str, pattern: str, new: str) -> str:
    return f"regexp_replace({x}, '{pattern}', {new}, 'g')"


def lines(x: str) -> str:
    return f"string_split({sub(x, SEPARATORS, NL)}, {NL})"


def whitespace(x: str) -> str:
    one = sub(f"replace({x}, chr(9), ' ')", " {2,}", "' '")
    return strip(sub(one, r"\n{2,}", NL))


def kind(line: str) -> str:
    """Kind of a stripped line."""
    scene = rf"[\x09\x1f\x20\xa0{_WIDE}*•\-–—]{{3,}}"
    title = rf"(?i)(Chapter|Capítulo|Cap\.?){B}+\d+"
    noise = "|".join(
        (
            rf"[-—–]?{B}*[Pp]age{B}+\d+{B}*[-—–]?",
            rf"[-—–]?{B}*p\.{B}*\d+{B}*[-—–]?",
            rf"[-—–]{B}*\d+{B}*[-—–]",
            "[ivxlcdmIVXLCDM]+",
            "(?i:Contents|Table of Contents|Índice|Índice de contenidos)",
            rf"(?i:Copyright){B}+©.*",
            r"(?i:All rights reserved)\.?",
        )
    )
    return (
        f"CASE WHEN {line} = '' THEN 'blank' "
        f"WHEN regexp_full_match({line}, '{scene}') THEN '{K.KIND_SCENE}' "
        f"WHEN regexp_full_match({line}, '{title}') THEN '{K.KIND_TITLE}' "
        f"WHEN regexp_full_match({line}, '{noise}') THEN 'noise' ELSE 'text' END"
    )


def dialogue(x: str) -> str:
    quotes = "repeat(chr(34), 4) || repeat(chr(39), 2)"
    one = f"translate({x}, '«»“”‘’', {quotes})"
    one = sub(one, rf"(?m)^[-–]{B}*", "'— '")
    one = sub(one, rf"{B}+[-–]{B}+", "' — '")
    one = sub(one, rf"{B}+[-–]([.!?])", r"' —\1'")
    one = sub(one, rf"¿{B}+", "'¿'")
    one = sub(one, rf"¡{B}+", "'¡'")
    one = sub(one, r"\.{3,}", "'...'")
    return sub(one, rf"(?:\.{B}+){{2,}}\.", "'...'")


def normalized(x: str) -> str:
    """Normalized text with short marker lines."""
    stripped = f"list_transform({lines(whitespace(x))}, lambda l: {strip('l')})"
    kinds = f"list_transform({stripped}, lambda l: struct_pack(t := l, k := {kind('l')}))"
    kept = f"list_filter({kinds}, lambda s: s.k <> 'noise')"
    marked = (
        f"list_transform({kept}, lambda s: CASE s.k WHEN '{K.KIND_SCENE}' THEN {SCENE} "
        f"WHEN '{K.KIND_TITLE}' THEN {TITLE} ELSE s.t END)"
    )
    spoken = dialogue(f"array_to_string({marked}, {NL})")
    tidy = f"list_transform(string_split({spoken}, {NL}), lambda l: {strip('l')})"
    return strip(f"array_to_string({tidy}, {NL})")


def plain(norm: str) -> str:
    """Normalized text without marker lines."""
    kept = f"list_filter(string_split({norm}, {NL}), lambda l: l NOT IN ({SCENE}, {TITLE}))"
    return f"array_to_string({kept}, {NL})"


def words(x: str) -> str:
    return (
        f"len(list_filter(regexp_split_to_array({x}, '{B}+'), lambda w: w <> ''))::BIGINT"
    )


_WORDS = "|".join(K.ABBREVIATIONS)
_TRAIL = r'.!?"»”’—-'
_RUN = r'[.!?]+[”’"»—-]*'


def sentences(x: str) -> tuple[str, str]:
    """Fragments of a text, and its sentences by folding the fragments ``fr``."""
    cut = f"'\\1' || {CUT}"
    parts = f"string_split({sub(x, f'({_RUN}(?:{B}+|$))', cut)}, {CUT})"
    flagged = (
        "list_transform(fr, lambda f, i: CASE "
        "WHEN i = len(fr) THEN 'R' "
        f"WHEN regexp_matches(f, '(?:^|{B})(?i:{_WORDS})[{_TRAIL}]*{B}*$') THEN 'R' "
        f"WHEN regexp_matches(fr[i + 1], '^{B}*(?:[—–-]{B}*)?[{K.CONTINUATION_LETTERS}]') THEN 'R' "
        f"WHEN regexp_full_match(f, '{_RUN}{B}*') THEN 'B' ELSE 'A' END || f)"
    )
    body = "substr(e, 2)"
    fold = (
        f"list_reduce({flagged}, lambda acc, e: CASE "
        f"WHEN e[1] = 'R' OR (e[1] = 'B' AND (acc = '' OR acc[-1] = {CUT})) THEN acc || {body} "
        f"ELSE acc || {body} || {CUT} END, '')"
    )
    return parts, (
        f"list_filter(list_transform(string_split({fold}, {CUT}), "
        f"lambda s: {strip('s')}), lambda s: s <> '')"
    )


def packed(sent: str, max_chars: int) -> str:
    """Chunk list of a sentence list."""
    return (
        f"string_split(list_reduce({sent}, lambda acc, s: CASE "
        f"WHEN length(string_split(acc, {CUT})[-1]) + 1 + length(s) <= {max_chars} "
        f"THEN acc || ' ' || s ELSE acc || {CUT} || s END), {CUT})"
    )


_WRITTEN = """CASE (doc_id * 31 + (i - 1) * 7) % 23
 WHEN 0 THEN '***'
 WHEN 1 THEN 'Page ' || ((i - 1) % 40)
 WHEN 2 THEN 'Chapter ' || ((i - 1) % 40)
 WHEN 3 THEN '- ' || l
 WHEN 4 THEN '«' || l || '»'
 WHEN 5 THEN 'xvii'
 WHEN 6 THEN '  ---  '
 WHEN 7 THEN '¿ ' || l || ' ?  . . . y – bien'
 WHEN 8 THEN 'Copyright © 2020'
 WHEN 9 THEN chr(9) || '“' || replace(l, ' ', '  ') || '” ....'
 ELSE l END"""

_TEXT = (
    f"array_to_string(list_transform(string_split(text, {NL}), lambda l, i: {_WRITTEN} || "
    f"CASE WHEN (doc_id + i - 1) % 3 = 0 THEN {NL} || {NL} ELSE {NL} END), '')"
)

_FIRST = strip(f"string_split(text, {NL})[1]")
_CHAPTER_TITLE = (
    "CASE WHEN doc_id % 7 = 0 THEN 'Section ' || (doc_id + 1) "
    f"WHEN doc_id % 3 = 0 THEN lower({_FIRST}) ELSE 'Text ' || doc_id END"
)

NARRATION = (
    f"narration AS (SELECT source AS book_id, doc_id AS chapter_idx, {_CHAPTER_TITLE} AS title, "
    f"{_TEXT} AS text FROM documents)"
)


def segments(source: str = "narration") -> str:
    """CTE ``seg``: one row per paragraph segment."""
    kept = (
        f"list_filter(list_transform(string_split(text, {NL}||{NL}), "
        f"lambda p: {strip('p')}), lambda p: p <> '')"
    )
    return (
        f"segs AS (SELECT book_id, chapter_idx, title, {kept} AS segs FROM {source}), "
        "seg AS (SELECT book_id, chapter_idx, title, len(segs) AS n_seg, unnest(segs) AS raw, "
        "generate_subscripts(segs, 1) - 1 AS seg_pos FROM segs)"
    )


def norms(raw: str = "raw", source: str = "seg") -> str:
    """CTE ``norm``: normalized text per segment."""
    return f"norm AS (SELECT * EXCLUDE (raw), {normalized(raw)} AS norm FROM {source})"


def chunk_rows(max_chars: int = K.DEFAULT_MAX_CHARS) -> str:
    """CTEs ending in ``chunk``: ordered chunks (markers included) of ``norm``."""
    parts, sent = sentences("t")
    key = "book_id, chapter_idx, seg_pos"
    return (
        f"line_rows AS (SELECT {key}, unnest(ls) AS line, generate_subscripts(ls, 1) AS li "
        f"FROM (SELECT {key}, string_split(norm, {NL}) AS ls FROM norm WHERE norm <> '')), "
        f"marks AS (SELECT *, line IN ({SCENE}, {TITLE}) AS is_mark FROM line_rows), "
        f"isl AS (SELECT *, 2 * sum(is_mark::INT) OVER (PARTITION BY {key} ORDER BY li) "
        "+ (NOT is_mark)::INT AS isl FROM marks), "
        f"island AS (SELECT {key}, isl, bool_or(is_mark) AS is_mark, "
        f"string_agg(line, {NL} ORDER BY li) AS t FROM isl GROUP BY {key}, isl), "
        f"frag AS (SELECT *, {parts} AS fr FROM island), "
        f"sent AS (SELECT {key}, isl, is_mark, t, CASE WHEN is_mark THEN [t] ELSE {sent} END AS s FROM frag), "
        f"packed AS (SELECT {key}, isl, is_mark, s, {packed('s', max_chars)} AS c FROM sent WHERE len(s) > 0), "
        f"raw_chunk AS (SELECT {key}, isl, is_mark, unnest(c) AS text, generate_subscripts(c, 1) AS ci FROM packed), "
        f"chunk AS (SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY isl, ci) - 1 AS chunk_idx, "
        f"CASE WHEN NOT is_mark THEN 'text' WHEN text = {SCENE} THEN '{K.KIND_SCENE}' "
        f"ELSE '{K.KIND_TITLE}' END AS kind, CASE WHEN is_mark THEN '' ELSE text END AS text FROM raw_chunk)"
    )


BASE = f"{NARRATION}, {segments()}, {norms()}"
CHUNKS = f"{BASE}, {chunk_rows()}"


def shown(x: str) -> str:
    """Marker text as shown in results."""
    return f"replace(replace({x}, {SCENE}, '[{K.KIND_SCENE}]'), {TITLE}, '[{K.KIND_TITLE}]')"
