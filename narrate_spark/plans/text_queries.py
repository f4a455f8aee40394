"""Text, chunk and analysis queries over ``documents`` and ``conversations``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from narrate_spark import constants as K
from narrate_spark.functions import normalize as N
from narrate_spark.functions.unicode import each, split_lines
from narrate_spark.functions.units import format_range
from narrate_spark.operators import analyze as A
from narrate_spark.operators import segments as G
from narrate_spark.operators.arrays import explode_rows
from narrate_spark.operators.sizes import spread
from narrate_spark.plans import sql
from narrate_spark.plans.corpus import document_chapters, narration_chapters, table

KEY = ["book_id", "chapter_idx"]


def shown(text: Column) -> Column:
    """Markers as readable words."""
    one = F.replace(text, F.lit(K.SCENE_BREAK_MARKER), F.lit(f"[{K.KIND_SCENE}]"))
    return F.replace(one, F.lit(K.CHAPTER_TITLE_MARKER), F.lit(f"[{K.KIND_TITLE}]"))


def segmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Narration chapters with their paragraph segments."""
    return G.with_segments(narration_chapters(spark, sf_dir), G.paragraph_segments)


def analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapter statistics of the narration chapters."""
    return A.analyze_chapters(segmented(spark, sf_dir))


def q_txt_segments(spark, sf_dir):
    return G.explode_segments(segmented(spark, sf_dir)).select(
        *KEY, "seg_pos", F.col("seg_text").alias("text")
    )


def q_segment_index(spark, sf_dir):
    rows = G.explode_segments(G.with_segment_offset(segmented(spark, sf_dir)))
    return rows.select(*KEY, "seg_pos", "seg_idx", F.length("seg_text").cast("bigint").alias("n_chars"))


def q_whitespace(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    text = N.normalize_whitespace(F.concat(F.col("text"), F.lit("\t \n\n"), F.col("role")))
    return turns.select("conv_id", "turn", text.alias("text"))


def q_classify(spark, sf_dir):
    chapters = narration_chapters(spark, sf_dir)
    lines = explode_rows(chapters, KEY, split_lines(F.col("text")), "line_no", "line")
    return lines.select(*KEY, "line_no", N.line_kind(F.col("line")).alias("kind"))


def q_dialogue(spark, sf_dir):
    return narration_chapters(spark, sf_dir).select(
        *KEY, N.normalize_dialogue(F.col("text")).alias("text")
    )


def q_normalize(spark, sf_dir):
    norms = each(F.col("segs"), *N.NORMALIZE_STEPS)
    rows = explode_rows(segmented(spark, sf_dir), KEY, norms, "seg_pos", "norm")
    return rows.select(*KEY, "seg_pos", shown(F.col("norm")).alias("norm"))


def q_sentences(spark, sf_dir):
    return A.sentences(segmented(spark, sf_dir)).select(*KEY, "seg_pos", "sentence_idx", "text")


def q_chunks(spark, sf_dir):
    return A.chunks(segmented(spark, sf_dir)).select(
        *KEY, "seg_pos", "chunk_idx", "kind", "text", "n_chars"
    )


def q_small_chunks(spark, sf_dir):
    return A.chunks(segmented(spark, sf_dir), max_chars=120).select(
        *KEY, "seg_pos", "chunk_idx", "kind", "n_chars"
    )


def q_analyze(spark, sf_dir):
    return analysis(spark, sf_dir)


def q_totals(spark, sf_dir):
    return A.book_totals(analysis(spark, sf_dir))


def q_warnings(spark, sf_dir):
    return A.chapter_warnings(analysis(spark, sf_dir))


def q_preview(spark, sf_dir):
    rows = A.preview(segmented(spark, sf_dir))
    return rows.select(*KEY, "label", "text")


def q_plan_size(spark, sf_dir):
    return A.plan_size(analysis(spark, sf_dir))


def _requests(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    asked = docs.join(labels, "doc_id", "left_semi")
    return asked.select(F.col("source").alias("book_id"), F.col("doc_id").alias("chapter_idx"))


def q_selected(spark, sf_dir):
    chosen = G.select_chapters(segmented(spark, sf_dir), _requests(spark, sf_dir))
    return A.analyze_chapters(chosen).select(*KEY, "segments", "chars", "words", "chunks")


def q_missing(spark, sf_dir):
    asked = _requests(spark, sf_dir)
    asked = asked.union(asked.select("book_id", F.col("chapter_idx") + 20))
    chapters = document_chapters(spark, sf_dir).select(*KEY)
    rows = G.missing_chapters(chapters, asked)
    return rows.select(*KEY, format_range(F.col("first"), F.col("last")).alias("available"))


def q_selection_errors(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    doc = F.col("doc_id").cast("string")
    rule = F.col("doc_id") % 8
    spec = (
        F.when(rule == 0, F.lit("0-2000000000")).when(rule == 1, F.lit("1-4000000000")).when(rule == 2, F.lit("5-1"))
        .when(rule == 3, F.lit("1,x")).when(rule == 4, F.concat(doc, F.lit(","), doc)).when(rule == 5, F.concat(F.lit(" 3 - 9 ,"), doc, F.lit(",4-12")))
        .when(rule == 6, F.concat(doc, F.lit("-"), (F.col("doc_id") + 20).cast("string"))).otherwise(doc)
    )
    requests = docs.select(F.col("doc_id").alias("request_id"), F.col("source").alias("book_id"), spec.alias("spec"))
    chapters = docs.select(F.col("source").alias("book_id"), F.col("doc_id").alias("chapter_idx"))
    rows = G.check_selections(chapters, requests)
    return rows.select("request_id", "book_id", "ranges", F.col("named").cast("bigint").alias("named"), "available", F.coalesce("error", F.lit("")).alias("error"))


def q_words_kept(spark, sf_dir):
    return A.word_check(segmented(spark, sf_dir)).groupBy("book_id").agg(
        F.count(F.lit(1)).alias("chapters"),
        F.sum("words_before").alias("words"),
        F.count(F.when(~F.col("same"), 1)).alias("n_different"),
    )


def q_fingerprint(spark, sf_dir):
    return A.fingerprints(A.chunks(segmented(spark, sf_dir)))


def q_short_texts(spark, sf_dir):
    items = spread(table(spark, sf_dir, "benchmark"), "item_id")
    chapters = items.select(
        F.lit("benchmark").alias("book_id"),
        F.col("item_id").alias("chapter_idx"),
        F.lit("").alias("title"),
        F.array("text").alias("segs"),
    )
    rows = A.chunks(chapters, max_chars=80)
    return rows.select(F.col("chapter_idx").alias("item_id"), "chunk_idx", "kind", "text", "n_chars")


QUERIES = {
    "txt_segments": q_txt_segments,
    "segment_index": q_segment_index,
    "whitespace_conversations": q_whitespace,
    "classify_lines": q_classify,
    "dialogue_documents": q_dialogue,
    "normalize_documents": q_normalize,
    "split_sentences": q_sentences,
    "chunk_documents": q_chunks,
    "chunk_documents_120": q_small_chunks,
    "chunk_short_texts": q_short_texts,
    "analyze_chapters": q_analyze,
    "book_totals": q_totals,
    "chapter_warnings": q_warnings,
    "chapter_preview": q_preview,
    "plan_size": q_plan_size,
    "chapter_selection": q_selected,
    "selection_missing": q_missing,
    "selection_errors": q_selection_errors,
    "word_preservation": q_words_kept,
    "chunk_fingerprint": q_fingerprint,
}

_COUNTS = (
    f"{sql.CHUNKS}, n_chunk AS (SELECT book_id, chapter_idx, count(*) FILTER (kind = 'text') AS chunks "
    "FROM chunk GROUP BY ALL), "
    f"n_text AS (SELECT book_id, chapter_idx, any_value(title) AS title, count(*) AS segments, "
    f"sum(length({sql.plain('norm')}))::BIGINT AS chars, sum({sql.words(sql.plain('norm'))})::BIGINT AS words "
    "FROM norm GROUP BY book_id, chapter_idx), "
    "analysis AS (SELECT t.*, coalesce(c.chunks, 0)::BIGINT AS chunks FROM n_text t "
    "LEFT JOIN n_chunk c USING (book_id, chapter_idx))"
)
_SENT_PARTS, _SENT_LIST = sql.sentences("t")
_ASKED = (
    "asked AS (SELECT source AS book_id, doc_id AS chapter_idx FROM documents "
    "WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1))"
)
_BENCH = (
    "seg AS (SELECT 'benchmark' AS book_id, item_id AS chapter_idx, 0 AS seg_pos, text AS raw FROM benchmark)"
)

ORACLES = {
    "txt_segments": f"WITH {sql.NARRATION}, {sql.segments()} SELECT book_id, chapter_idx, "
    "seg_pos::BIGINT AS seg_pos, raw AS text FROM seg",
    "segment_index": f"WITH {sql.NARRATION}, {sql.segments()} SELECT book_id, chapter_idx, "
    "seg_pos::BIGINT AS seg_pos, row_number() OVER (PARTITION BY book_id ORDER BY chapter_idx, seg_pos) - 1 "
    "AS seg_idx, length(raw)::BIGINT AS n_chars FROM seg",
    "whitespace_conversations": "SELECT conv_id, turn, "
    f"{sql.whitespace('text || chr(9) || chr(32) || chr(10) || chr(10) || role')} AS text FROM conversations",
    "classify_lines": f"WITH {sql.NARRATION}, ls AS (SELECT book_id, chapter_idx, "
    f"{sql.lines(sql.sub('text', '\\n$', chr(39) * 2))} AS ls FROM narration), "
    "l AS (SELECT book_id, chapter_idx, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS line_no FROM ls) "
    f"SELECT book_id, chapter_idx, line_no::BIGINT AS line_no, {sql.kind(sql.strip('line'))} AS kind FROM l",
    "dialogue_documents": f"WITH {sql.NARRATION} SELECT book_id, chapter_idx, {sql.dialogue('text')} AS text "
    "FROM narration",
    "normalize_documents": f"WITH {sql.BASE} SELECT book_id, chapter_idx, seg_pos::BIGINT AS seg_pos, "
    f"{sql.shown('norm')} AS norm FROM norm",
    "split_sentences": f"WITH {sql.BASE}, p AS (SELECT book_id, chapter_idx, seg_pos, {sql.plain('norm')} AS t FROM norm), "
    f"f AS (SELECT *, {_SENT_PARTS} AS fr FROM p), s AS (SELECT *, {_SENT_LIST} AS s FROM f) "
    "SELECT book_id, chapter_idx, seg_pos::BIGINT AS seg_pos, generate_subscripts(s, 1) - 1 AS sentence_idx, "
    "unnest(s) AS text FROM s",
    "chunk_documents": f"WITH {sql.CHUNKS} SELECT book_id, chapter_idx, seg_pos::BIGINT AS seg_pos, chunk_idx, kind, "
    "text, length(text)::BIGINT AS n_chars FROM chunk",
    "chunk_documents_120": f"WITH {sql.BASE}, {sql.chunk_rows(120)} SELECT book_id, chapter_idx, "
    "seg_pos::BIGINT AS seg_pos, chunk_idx, kind, length(text)::BIGINT AS n_chars FROM chunk",
    "chunk_short_texts": f"WITH {_BENCH}, {sql.norms()}, {sql.chunk_rows(80)} SELECT chapter_idx AS item_id, "
    "chunk_idx, kind, text, length(text)::BIGINT AS n_chars FROM chunk",
    "analyze_chapters": f"WITH {_COUNTS} SELECT * FROM analysis",
    "book_totals": f"WITH {_COUNTS} SELECT book_id, count(*) AS chapters, sum(segments)::BIGINT AS segments, "
    "sum(chars)::BIGINT AS chars, sum(words)::BIGINT AS words, sum(chunks)::BIGINT AS chunks FROM analysis GROUP BY book_id",
    "chapter_warnings": f"WITH {_COUNTS} "
    "SELECT book_id, chapter_idx, 1::BIGINT AS rule_no, 'Chapter ' || chapter_idx || ': no heading detected (auto-titled ''' || title || ''')' AS warning "
    "FROM analysis WHERE title = '' OR title LIKE 'Section %' "
    "UNION ALL SELECT book_id, chapter_idx, 2, 'Chapter ' || chapter_idx || ': only ' || segments || ' segment(s) — may be a parsing artifact' "
    "FROM analysis WHERE segments <= 1 "
    "UNION ALL SELECT book_id, chapter_idx, 3, 'Chapter ' || chapter_idx || ': 0 characters after normalization (noise-only content)' "
    "FROM analysis WHERE chars = 0",
    "chapter_preview": f"WITH {sql.CHUNKS} SELECT book_id, chapter_idx, "
    "row_number() OVER (PARTITION BY book_id, chapter_idx ORDER BY seg_pos, chunk_idx) || '/' || "
    "count(*) OVER (PARTITION BY book_id, chapter_idx) AS label, text FROM chunk WHERE kind = 'text'",
    "plan_size": f"WITH {_COUNTS} SELECT book_id, sum(chunks)::BIGINT AS total_segments FROM analysis GROUP BY book_id",
    "chapter_selection": f"WITH {_COUNTS}, {_ASKED} SELECT book_id, chapter_idx, segments, chars, words, chunks "
    "FROM analysis SEMI JOIN asked USING (book_id, chapter_idx)",
    "selection_missing": f"WITH {_ASKED}, a AS (SELECT * FROM asked UNION SELECT book_id, chapter_idx + 20 FROM asked), "
    "r AS (SELECT source AS book_id, min(doc_id) || '-' || max(doc_id) AS available FROM documents GROUP BY source) "
    "SELECT a.*, r.available FROM a JOIN r USING (book_id) WHERE (book_id, chapter_idx) NOT IN "
    "(SELECT (source, doc_id) FROM documents)",
    "selection_errors": "WITH d AS (SELECT doc_id::BIGINT AS i, source AS book_id FROM documents), "
    "r AS (SELECT i, book_id, unnest(CASE i % 8 WHEN 0 THEN [[0, 2000000000]] WHEN 1 THEN [[1, 4000000000]] WHEN 2 THEN [] WHEN 3 THEN [] "
    "WHEN 5 THEN CASE WHEN i BETWEEN 3 AND 13 THEN [[3, greatest(i, 12)]] WHEN i = 2 THEN [[2, 12]] WHEN i < 2 THEN [[i, i], [3, 12]] "
    "ELSE [[3, 12], [i, i]] END WHEN 6 THEN [[i, i + 20]] ELSE [[i, i]] END) AS p FROM d), "
    "c AS (SELECT r.i, p, (SELECT count(DISTINCT d.i) FROM d WHERE d.book_id = r.book_id AND d.i BETWEEN p[1] AND p[2]) AS n FROM r), "
    "s AS (SELECT i, string_agg(CASE WHEN p[1] = p[2] THEN p[1]::VARCHAR ELSE p[1] || '-' || p[2] END, ',' ORDER BY p[1]) AS ranges, "
    "sum(p[2] - p[1] + 1)::BIGINT AS named, sum(n)::BIGINT AS available FROM c GROUP BY i), "
    "b AS (SELECT book_id, min(i) || '-' || max(i) AS span FROM d GROUP BY book_id), "
    "j AS (SELECT d.i, d.book_id, span, coalesce(ranges, '') AS ranges, coalesce(named, 0) AS named, coalesce(available, 0) AS available "
    "FROM d JOIN b USING (book_id) LEFT JOIN s USING (i)) "
    "SELECT i AS request_id, book_id, ranges, named, available, CASE WHEN i % 8 = 3 THEN 'Invalid chapter specification.' "
    "WHEN named = 0 THEN 'Chapter selection is empty. Available indices: ' || span WHEN available < named THEN "
    "'Chapter indices out of range: ' || (named - available) || '. Available indices: ' || span ELSE '' END AS error FROM j",
    "word_preservation": f"WITH {_COUNTS}, w AS (SELECT book_id, sum({sql.words('text')})::BIGINT AS words FROM chunk GROUP BY book_id) "
    "SELECT book_id, a.chapters, w.words, 0::BIGINT AS n_different FROM w JOIN "
    "(SELECT book_id, count(*) AS chapters FROM analysis GROUP BY book_id) a USING (book_id)",
    "chunk_fingerprint": f"WITH {sql.CHUNKS} SELECT book_id, count(*) AS n_chunks, sum(('0x' || substr(sha256(chapter_idx || '|' || "
    "seg_pos || '|' || chunk_idx || '|' || kind || '|' || text), 1, 15))::BIGINT)::VARCHAR AS fingerprint FROM chunk GROUP BY book_id",
}
