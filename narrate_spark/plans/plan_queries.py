"""Synthesis plan, resume, audio manifest and timeline queries.

There is no audio among the given tables.  Lengths follow an assumed speaking
rate of ``FRAMES_PER_CHAR`` frames per character; it is a stand-in for a model.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrate_spark import constants as K
from narrate_spark.functions.units import (
    artifact_name,
    index_from_name,
    ms_to_frames,
    ms_to_timestamp,
    narrator_tag,
    with_acoustic_tail,
)
from narrate_spark.operators import plan as P
from narrate_spark.operators import segments as G
from narrate_spark.operators import timeline as T
from narrate_spark.operators.synthesize import Audio, apply_synthesizer
from narrate_spark.plans import sql
from narrate_spark.plans.corpus import document_chapters, table
from narrate_spark.plans.text_queries import segmented

FRAMES_PER_CHAR = 1600
KEY = ["book_id", "chapter_idx"]


def full_plan(spark, sf_dir) -> DataFrame:
    """Plan with book-wide segment numbers and artifact names."""
    return P.synthesis_plan(G.with_segment_offset(segmented(spark, sf_dir)))


def _format(events: DataFrame) -> DataFrame:
    """Rule-based PCM formats of the texts; pauses have none yet."""

    def known(value: Column) -> Column:
        return F.when(F.col("kind") == "text", value.cast("bigint"))

    rate = F.when(F.col("chapter_idx") % 3 == 0, 22050).when(F.col("chapter_idx") % 3 == 1, 48000)
    return events.select(
        *KEY,
        "seg_pos",
        "event_idx",
        known(rate.otherwise(24000)).alias("rate"),
        known(F.col("seg_pos") % 2 + 1).alias("channels"),
        known(F.lit(2)).alias("width"),
    )


def audio_events(plan: DataFrame) -> DataFrame:
    """Assumed audio of every event at the default rate."""
    rate = F.lit(K.DEFAULT_RATE).cast("bigint")
    spoken = with_acoustic_tail(F.length("text").cast("bigint") * FRAMES_PER_CHAR, rate)
    frames = F.when(F.col("kind") == "text", spoken).otherwise(
        ms_to_frames(F.col("pause_ms"), rate)
    )
    return plan.select(
        *KEY, "seg_idx", "event_idx", "seg_pause_ms", rate.alias("rate"), frames.alias("frames")
    )


def chapter_audio(spark, sf_dir) -> DataFrame:
    """Audio events whose segments are numbered inside their chapter.

    Sums over a chapter need no book-wide numbers, so the text is read once.
    """
    plan = P.synthesis_plan(segmented(spark, sf_dir))
    return audio_events(plan.withColumnRenamed("seg_pos", "seg_idx"))


def markers(spark, sf_dir) -> DataFrame:
    """Chapter markers of the assumed audio."""
    segments = T.segment_audio(chapter_audio(spark, sf_dir))
    # every fifth chapter has no stored title, to use the default
    titles = document_chapters(spark, sf_dir).where(F.col("chapter_idx") % 5 != 0)
    return T.chapter_markers(T.chapter_durations(segments), titles.select(*KEY, "title"))


def _plan_and_done(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The plan, and artifacts that exist already: three per segment of the labelled documents.

    The segments of a chapter are counted once for both, and the artifacts need no text.
    """
    chapters = segmented(spark, sf_dir)
    offsets = G.segment_offsets(chapters)
    plan = P.synthesis_plan(G.with_segment_offset(chapters, offsets))
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("chapter_idx"))
    numbers = F.sequence("seg_offset", F.col("seg_offset") + F.col("segments") - 1)
    rows = offsets.join(labels, "chapter_idx", "left_semi").select(*KEY, F.explode(numbers).alias("seg_idx"))
    made = rows.select(*KEY, "seg_idx", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("event"))
    name = artifact_name(F.col("chapter_idx"), F.col("seg_idx"), F.col("event"))
    return plan, made.select("book_id", name.alias("artifact"))


def q_events(spark, sf_dir):
    return full_plan(spark, sf_dir).select(
        *KEY, "seg_pos", "seg_idx", "event_idx", "kind", "text", "pause_ms", "seg_pause_ms", "artifact"
    )


def q_pauses(spark, sf_dir):
    plan = P.synthesis_plan(segmented(spark, sf_dir), P.Prosody(600, 2000, 900, 1300), 200)
    return plan.groupBy("book_id", "kind", "pause_ms", "seg_pause_ms").agg(
        F.count(F.lit(1)).alias("events"), F.sum(F.length("text")).alias("chars")
    )


def q_anchor(spark, sf_dir):
    chapters = segmented(spark, sf_dir)
    first = F.get("segs", F.lit(0))
    anchored = P.title_anchor(first, F.col("title"), F.lit(True))
    return chapters.select(
        *KEY,
        (anchored != first).alias("narrated"),
        F.replace(anchored, F.lit(K.CHAPTER_TITLE_MARKER), F.lit("[chapter_title]")).alias("text"),
    )


def q_pending(spark, sf_dir):
    return P.pending_work(*_plan_and_done(spark, sf_dir)).select("book_id", "artifact", "kind")


def q_progress(spark, sf_dir):
    return P.plan_progress(*_plan_and_done(spark, sf_dir))


def q_pause_formats(spark, sf_dir):
    return P.pause_formats(_format(P.synthesis_plan(segmented(spark, sf_dir))))


def _stand_in():
    """Speech stand-in: silence of the assumed length."""

    def speak(text, language, voice, speed):
        return Audio(K.DEFAULT_RATE, 1, 2, int(len(text) * FRAMES_PER_CHAR / speed))

    return speak


def q_synthesize(spark, sf_dir):
    plan = full_plan(spark, sf_dir).where(F.col("kind") == "text")
    speeds = F.element_at(F.array(*[F.lit(s) for s in (1.0, 0.5, 2.0, 2.5)]), (F.col("seg_idx") % 4 + 1).cast("int"))
    pending = plan.select(
        "book_id", "artifact", "text", F.lit("en-us").alias("language"),
        F.lit("af_sarah").alias("voice"), speeds.alias("speed"),
    )
    made = apply_synthesizer(pending, _stand_in)
    return made.select(
        "book_id",
        "artifact",
        F.coalesce("rate", F.lit(0)).alias("rate"),
        F.coalesce("frames", F.lit(0)).alias("frames"),
        F.coalesce("error", F.lit("")).alias("error"),
    )


def q_segment_audio(spark, sf_dir):
    return T.segment_audio(audio_events(full_plan(spark, sf_dir)))


def q_timeline(spark, sf_dir):
    rows = markers(spark, sf_dir)
    return rows.select(
        *KEY, "title", "start_ms", "end_ms", ms_to_timestamp(F.col("start_ms")).alias("start_at")
    )


def q_ffmetadata(spark, sf_dir):
    books = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("book_id")).agg(
        F.min_by("lang", "doc_id").alias("language")
    )
    books = books.select(
        "book_id",
        F.concat(F.lit("Book "), F.col("book_id")).alias("title"),
        F.lit("Some Author").alias("author"),
        F.when(F.col("language") != "de", F.col("language")).otherwise("").alias("language"),
        narrator_tag(F.lit("af_sarah"), F.lit("kokoro")).alias("narrator"),
    )
    return T.ffmetadata(books, markers(spark, sf_dir))


def q_concat_list(spark, sf_dir):
    segments = T.segment_audio(audio_events(full_plan(spark, sf_dir)))
    return T.concat_list(segments, "/work")


def q_mismatch(spark, sf_dir):
    events = _format(P.synthesis_plan(segmented(spark, sf_dir)))
    parts = P.pause_formats(events).withColumnRenamed("seg_pos", "seg_idx")
    return T.format_mismatches(parts).select(*KEY, "seg_idx", "event_idx", "kind", "rate", "channels", "width")


def q_merged(spark, sf_dir):
    return T.merged_frames(chapter_audio(spark, sf_dir), 100)


def q_order(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    number = F.col("doc_id").cast("string")
    name = (
        F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("ch_"), F.lpad(number, 8, "0")))
        .when(F.col("doc_id") % 4 == 1, F.concat(F.lit("seg_"), number))
        .when(F.col("doc_id") % 4 == 2, F.concat(F.lit("ch"), number))
        .otherwise(F.concat(F.lit("ch_x"), number))
    )
    return docs.select("doc_id", name.alias("name"), index_from_name(name).alias("number"))


def q_manifest(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("book_id"), F.col("doc_id").cast("bigint").alias("doc"))
    number = F.col("doc").cast("string")
    chapter = F.when(F.col("doc") % 7 == 3, F.lit("cover")).otherwise(F.concat(F.lit("ch_"), (F.col("doc") % 11).cast("string")))
    name = F.when(F.col("doc") % 5 == 4, F.concat(F.lit("note_"), number)).otherwise(F.concat(F.lit("seg_"), number))
    files = docs.select("book_id", F.concat(F.lit("out/"), chapter, F.lit("/"), name, F.lit(".wav")).alias("path"))
    return T.assembly_manifest(files)


QUERIES = {
    "title_anchor": q_anchor,
    "plan_events": q_events,
    "plan_pauses": q_pauses,
    "plan_pending": q_pending,
    "plan_progress": q_progress,
    "pause_formats": q_pause_formats,
    "synthesize": q_synthesize,
    "segment_audio": q_segment_audio,
    "chapter_timeline": q_timeline,
    "ffmetadata": q_ffmetadata,
    "concat_list": q_concat_list,
    "format_mismatch": q_mismatch,
    "merged_frames": q_merged,
    "assembly_order": q_order,
    "assembly_manifest": q_manifest,
}

_FIRST = sql.strip("string_split(raw, chr(10))[1]")
_FOLD = "replace(lower({}), 'ß', 'ss')"
_NARRATED = f"seg_pos = 0 AND {_FOLD.format(_FIRST)} = {_FOLD.format(sql.strip('title'))}"
_ANCHORED = (
    f"CASE WHEN {_NARRATED} THEN string_split(raw, chr(10))[1] || chr(10) || {sql.TITLE} || "
    "substr(raw, length(string_split(raw, chr(10))[1]) + 1) ELSE raw END"
)


def _events(max_chars: int, scene: int, title: int, paragraph: int, chapter: int) -> str:
    seg = "book_id, chapter_idx, seg_pos"
    return (
        f"{sql.NARRATION}, {sql.segments()}, "
        f"anchored AS (SELECT * EXCLUDE (raw), {_ANCHORED} AS raw FROM seg), "
        f"{sql.norms(source='anchored')}, {sql.chunk_rows(max_chars)}, "
        "numbered AS (SELECT book_id, chapter_idx, seg_pos, n_seg, row_number() OVER "
        "(PARTITION BY book_id ORDER BY chapter_idx, seg_pos) - 1 AS seg_idx FROM seg), "
        f"e0 AS (SELECT *, CASE kind WHEN '{K.KIND_SCENE}' THEN {scene} WHEN '{K.KIND_TITLE}' THEN {title} ELSE 0 END AS ms, "
        f"lag(kind, 1, 'text') OVER (PARTITION BY {seg} ORDER BY chunk_idx) AS before FROM chunk), "
        f"e1 AS (SELECT *, sum((kind = 'text' OR before = 'text')::INT) OVER (PARTITION BY {seg} ORDER BY chunk_idx) AS g FROM e0), "
        f"e2 AS (SELECT {seg}, g, CASE WHEN any_value(kind) = 'text' THEN 'text' ELSE 'pause' END AS kind, any_value(text) AS text, "
        f"max(ms)::BIGINT AS pause_ms FROM e1 GROUP BY {seg}, g), "
        f"e3 AS (SELECT *, row_number() OVER (PARTITION BY {seg} ORDER BY g) - 1 AS event_idx FROM e2), "
        f"s0 AS (SELECT {seg}, bool_and(kind = 'pause') AS silent FROM e3 GROUP BY {seg}), "
        "s1 AS (SELECT *, lag(silent, 1, false) OVER (PARTITION BY book_id, chapter_idx ORDER BY seg_pos) AS was FROM s0), "
        f"s2 AS (SELECT {seg}, seg_idx, CASE WHEN seg_pos = n_seg - 1 THEN {chapter} WHEN silent THEN 0 ELSE {paragraph} END::BIGINT AS seg_pause_ms "
        f"FROM s1 JOIN numbered USING ({seg}) WHERE NOT (silent AND was)), "
        f"ev AS (SELECT e3.*, seg_idx, seg_pause_ms, printf('ch%04d_seg%06d_chunk%d.wav', chapter_idx, seg_idx, event_idx) AS artifact "
        f"FROM e3 JOIN s2 USING ({seg}))"
    )


_PLAN = _events(500, 1500, 1200, 700, 2500)
_DONE = "done AS (SELECT book_id, artifact FROM ev WHERE chapter_idx IN (SELECT doc_id FROM labels) AND event_idx < 3)"
_AUDIO = (
    f"{_PLAN}, au AS (SELECT *, CASE WHEN kind = 'text' THEN length(text) * {FRAMES_PER_CHAR} + 1920 "
    "ELSE trunc(24000 * (pause_ms / 1000.0::DOUBLE))::BIGINT END AS frames FROM ev), "
    "sa AS (SELECT book_id, chapter_idx, seg_idx, 24000::BIGINT AS rate, (sum(frames) + "
    "trunc(24000 * (max(seg_pause_ms) / 1000.0::DOUBLE)))::BIGINT AS frames FROM au GROUP BY book_id, chapter_idx, seg_idx)"
)
_MARKERS = (
    f"{_AUDIO}, du AS (SELECT book_id, chapter_idx, sum(trunc((frames::DOUBLE / 24000) * 1000))::BIGINT AS ms FROM sa "
    "GROUP BY book_id, chapter_idx), mk AS (SELECT book_id, chapter_idx, coalesce(t.title, 'Chapter ' || (chapter_idx + 1)) AS title, "
    "(sum(ms) OVER (PARTITION BY book_id ORDER BY chapter_idx) - ms)::BIGINT AS start_ms, "
    "(sum(ms) OVER (PARTITION BY book_id ORDER BY chapter_idx))::BIGINT AS end_ms FROM du LEFT JOIN "
    "(SELECT * FROM narration WHERE chapter_idx % 5 <> 0) t USING (book_id, chapter_idx) WHERE ms > 0)"
)
_FORMATS = (
    f"{_PLAN}, fm AS (SELECT book_id, chapter_idx, seg_pos, event_idx, kind, "
    "CASE WHEN kind = 'text' THEN CASE chapter_idx % 3 WHEN 0 THEN 22050 WHEN 1 THEN 48000 ELSE 24000 END END AS r, "
    "CASE WHEN kind = 'text' THEN seg_pos % 2 + 1 END AS c FROM ev), "
    "pf AS (SELECT book_id, chapter_idx, seg_pos::BIGINT AS seg_pos, event_idx, kind, "
    "coalesce(last_value(r IGNORE NULLS) OVER w, 24000)::BIGINT AS rate, "
    "coalesce(last_value(c IGNORE NULLS) OVER w, 1)::BIGINT AS channels, 2::BIGINT AS width FROM fm "
    "WINDOW w AS (PARTITION BY book_id ORDER BY chapter_idx, seg_pos, event_idx))"
)

ORACLES = {
    "title_anchor": f"WITH {sql.NARRATION}, {sql.segments()} SELECT book_id, chapter_idx, {_NARRATED} AS narrated, "
    f"replace({_ANCHORED}, {sql.TITLE}, '[chapter_title]') AS text FROM seg WHERE seg_pos = 0",
    "plan_events": f"WITH {_PLAN} SELECT book_id, chapter_idx, seg_pos::BIGINT AS seg_pos, seg_idx, event_idx, kind, "
    "CASE WHEN kind = 'text' THEN text ELSE '' END AS text, pause_ms, seg_pause_ms, artifact FROM ev",
    "plan_pauses": f"WITH {_events(200, 900, 1300, 600, 2000)} SELECT book_id, kind, pause_ms, seg_pause_ms, count(*) AS events, "
    "sum(length(text))::BIGINT AS chars FROM ev GROUP BY ALL",
    "plan_pending": f"WITH {_PLAN}, {_DONE} SELECT book_id, artifact, kind FROM ev ANTI JOIN done USING (book_id, artifact)",
    "plan_progress": f"WITH {_PLAN} SELECT book_id, count(*) AS total_segments, count(*) FILTER (chapter_idx IN "
    "(SELECT doc_id FROM labels) AND event_idx < 3) AS completed_segments FROM ev WHERE kind = 'text' GROUP BY book_id",
    "pause_formats": f"WITH {_FORMATS} SELECT * FROM pf",
    "synthesize": f"WITH {_PLAN}, t AS (SELECT *, [1.0, 0.5, 2.0, 2.5][seg_idx % 4 + 1] AS speed FROM ev WHERE kind = 'text') "
    "SELECT book_id, artifact, CASE WHEN speed <= 2 THEN 24000 ELSE 0 END::BIGINT AS rate, "
    f"CASE WHEN speed <= 2 THEN (trunc(length(text) * {FRAMES_PER_CHAR} / speed) + 1920)::BIGINT ELSE 0 END AS frames, "
    "CASE WHEN speed > 2 THEN 'ValueError: Speed must be between 0.5 and 2.0, got 2.5' ELSE '' END AS error FROM t",
    "segment_audio": f"WITH {_AUDIO} SELECT * FROM sa",
    "chapter_timeline": f"WITH {_MARKERS} SELECT book_id, chapter_idx, title, start_ms, end_ms, "
    "printf('%02d:%02d:%02d.%03d', start_ms // 3600000, start_ms // 60000 % 60, start_ms // 1000 % 60, start_ms % 1000) AS start_at FROM mk",
    "ffmetadata": f"WITH {_MARKERS}, bk AS (SELECT source AS book_id, arg_min(lang, doc_id) AS lang FROM documents GROUP BY source) "
    "SELECT book_id, -1::BIGINT AS chapter_idx, array_to_string([';FFMETADATA1', 'title=Book ' || book_id, 'artist=af_sarah - kokoro', "
    "'composer=Some Author', 'album_artist=Some Author', 'album=Book ' || book_id, 'genre=Audiobook'], chr(10)) || "
    "CASE WHEN lang <> 'de' THEN chr(10) || 'language=' || lang ELSE '' END AS block FROM bk UNION ALL "
    "SELECT book_id, chapter_idx, chr(10) || '[CHAPTER]' || chr(10) || 'TIMEBASE=1/1000' || chr(10) || 'START=' || start_ms || "
    "chr(10) || 'END=' || end_ms || chr(10) || 'title=' || title FROM mk",
    "concat_list": f"WITH {_AUDIO} SELECT book_id, chapter_idx, seg_idx, 'file ''/work/' || book_id || printf('/ch_%04d/seg_%06d.wav', "
    "chapter_idx, seg_idx) || '''' AS line FROM sa",
    "format_mismatch": f"WITH {_FORMATS}, fi AS (SELECT book_id, chapter_idx, arg_min([rate, channels, width], seg_pos * 100000 + event_idx) AS f "
    "FROM pf GROUP BY book_id, chapter_idx) SELECT book_id, chapter_idx, seg_pos AS seg_idx, event_idx, kind, rate, channels, width "
    "FROM pf JOIN fi USING (book_id, chapter_idx) WHERE f <> [rate, channels, width]",
    "merged_frames": f"WITH {_AUDIO} SELECT book_id, chapter_idx, count(*) AS parts, 24000::BIGINT AS rate, "
    "(sum(frames) + (count(*) - 1) * 2400)::BIGINT AS frames FROM au GROUP BY book_id, chapter_idx",
    "assembly_order": "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'ch_' || lpad(doc_id::VARCHAR, 8, '0') WHEN 1 THEN 'seg_' || doc_id "
    "WHEN 2 THEN 'ch' || doc_id ELSE 'ch_x' || doc_id END AS name, CASE WHEN doc_id % 4 < 2 THEN doc_id ELSE 0 END AS number FROM documents",
    "assembly_manifest": "WITH d AS (SELECT source AS book_id, doc_id AS n, CASE WHEN doc_id % 7 = 3 THEN 'cover' ELSE 'ch_' || doc_id % 11 END AS chapter, "
    "CASE WHEN doc_id % 7 = 3 THEN 0 ELSE doc_id % 11 END AS c FROM documents WHERE doc_id % 5 <> 4) "
    "SELECT book_id, 'out/' || chapter || '/seg_' || n || '.wav' AS path, "
    "row_number() OVER (PARTITION BY book_id ORDER BY c, chapter, n) - 1 AS position FROM d",
}
