"""Voice, language and request queries; every request comes from a table row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrate_spark import constants as K
from narrate_spark.functions import languages as L
from narrate_spark.functions import units as U
from narrate_spark.operators import jobs as J
from narrate_spark.operators import voices as V
from narrate_spark.plans import sql
from narrate_spark.plans.corpus import table

_IDS = [*K.PREFIX_VOICES, "af_unknown", "_x", "nova", "qq_top", ""]
_LANGS = ["en-us", "en-gb", "es", "fr", "de", "ja"]
_ALIASES = [" Phonon ", "KOKORO", "phonom-40m", "other", "", "phonom"]


def _pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


def _tag(doc: Column, lang: Column) -> Column:
    rule = doc % 7
    return (
        F.when(rule == 0, F.concat(F.lit("  "), F.upper(lang), F.lit("_XX ")))
        .when(rule == 1, F.concat(lang, F.lit("-Latn-YY")))
        .when(rule == 2, F.lit("it"))
        .when(rule == 3, F.lit(""))
        .otherwise(lang)
    )


def _requests(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        "doc_id", _pick(_IDS, F.col("doc_id")).alias("voice"), _pick(_LANGS, F.col("doc_id")).alias("language")
    )


def _source_voices(spark, sf_dir) -> DataFrame:
    """Every (language, source) of the documents as a voice."""
    docs = table(spark, sf_dir, "documents")
    prefix = F.when(F.col("lang") == "en", "a").when(F.col("lang") == "es", "e").when(F.col("lang") == "fr", "f").otherwise("x")
    voice = F.concat(prefix, F.lit("f_"), F.col("source"))
    return docs.groupBy(voice.alias("voice")).agg(F.min("doc_id").alias("pos"))


def q_voice_language(spark, sf_dir):
    rows = _requests(spark, sf_dir)
    return rows.select("doc_id", "voice", F.coalesce(L.voice_language(F.col("voice")), F.lit("")).alias("language"))


def q_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    tag = _tag(F.col("doc_id"), F.col("lang"))
    return docs.select(
        "doc_id", F.coalesce(L.checkpoint_language(tag), F.lit("")).alias("language"),
        F.coalesce(L.language_error(tag), F.lit("")).alias("error"),
    )


def q_resolve_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    explicit = F.when(F.col("doc_id") % 3 == 0, _tag(F.col("doc_id"), F.col("lang")))
    inferred = F.when(F.col("doc_id") % 10 == 1, "xx").otherwise(F.col("lang"))
    language, error = V.resolve_language(explicit, inferred)
    return docs.select(
        "doc_id", F.coalesce(language, F.lit("")).alias("language"), F.coalesce(error, F.lit("")).alias("error")
    )


def q_resolve(spark, sf_dir):
    return V.resolve_voices(_requests(spark, sf_dir), V.prefix_catalog(spark))


def q_validate(spark, sf_dir):
    return V.validate_prefix(_requests(spark, sf_dir), V.prefix_catalog(spark))


def _speakers(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents")
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")

    def side(rows: DataFrame) -> DataFrame:
        grouped = rows.groupBy(F.col("lang").alias("language"), F.col("source").alias("voice"))
        return grouped.agg(F.min("doc_id").alias("pos"))

    model = side(docs.join(good, "doc_id", "left_semi").where("lang <> 'de'"))
    return model, side(docs.where("lang NOT IN ('de', 'fr')")), docs.select(F.col("lang").alias("language"))


def q_merge(spark, sf_dir):
    return V.merge_catalogs(*_speakers(spark, sf_dir))


def q_validate_checkpoint(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model, _, _ = _speakers(spark, sf_dir)
    voice = F.when(F.col("doc_id") % 5 == 0, "default").when(F.col("doc_id") % 5 == 1, "").otherwise(F.col("source"))
    asked = docs.select("doc_id", voice.alias("voice"), _tag(F.col("doc_id"), F.col("lang")).alias("language"))
    return V.validate_checkpoint(asked, model).select("doc_id", "error")


def q_capabilities(spark, sf_dir):
    return V.capabilities(V.catalog_from_ids(_source_voices(spark, sf_dir)))


def q_list(spark, sf_dir):
    return V.list_voices(V.catalog_from_ids(_source_voices(spark, sf_dir)))


def q_alias(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    alias = _pick(_ALIASES, F.col("event_id"))
    return events.groupBy(alias.alias("alias"), F.coalesce(L.backend_name(alias), F.lit("")).alias("backend")).agg(
        F.count(F.lit(1)).alias("requests")
    )


def _spec(event: Column, user: Column) -> Column:
    a, b = (event % 10).cast("string"), (user % 17).cast("string")
    rule = event % 6
    return (
        F.when(rule == 0, F.concat(a, F.lit(", "), b, F.lit(","), a))
        .when(rule == 1, F.concat(a, F.lit("-"), b))
        .when(rule == 2, F.concat(F.lit(" 3 - 5 ,"), b, F.lit(",4-9")))
        .when(rule == 3, F.concat(a, F.lit(",x")))
        .when(rule == 4, F.lit(""))
        .otherwise(b)
    )


def q_spec(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    spec = _spec(F.col("event_id"), F.col("user_id"))
    parsed = F.coalesce(F.array_join(U.parse_chapter_spec(spec).cast("array<string>"), ","), F.lit(""))
    return events.select(
        "event_id", spec.alias("spec"), parsed.alias("indices"),
        F.coalesce(U.chapter_spec_error(spec), F.lit("")).alias("error"),
    )


def q_speed(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    speed = (F.col("event_id") % 300).cast("double") / F.lit(100.0)
    return events.select(
        "event_id", F.coalesce(U.speed_to_duration_delta(speed), F.lit(-9.0)).alias("delta"),
        F.coalesce(U.speed_error(speed), F.lit("")).alias("error"),
    )


def q_request(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    output = F.concat(F.col("source"), _pick([".m4b", ".WAV", ".mp3", "", "/.wav", ".tar.m4b"], F.col("doc_id")))
    return docs.select(
        "doc_id", output.alias("output"), J.request_error(output, F.col("doc_id") % 4 - 1).alias("error")
    )


QUERIES = {
    "voice_language": q_voice_language,
    "language_normalize": q_language,
    "language_resolve": q_resolve_language,
    "voice_resolve": q_resolve,
    "voice_validate": q_validate,
    "voice_validate_checkpoint": q_validate_checkpoint,
    "catalog_merge": q_merge,
    "capabilities": q_capabilities,
    "list_voices": q_list,
    "backend_alias": q_alias,
    "chapter_spec": q_spec,
    "speed_delta": q_speed,
    "request_validation": q_request,
}


def _list(values) -> str:
    return "[" + ", ".join("'" + v + "'" for v in values) + "]"


_PREFIXES = "CASE {} " + " ".join(f"WHEN '{p}' THEN '{lang}'" for p, lang in K.VOICE_PREFIX_LANGUAGE.items()) + " END"
_NAMES = "CASE language " + " ".join(f"WHEN '{c}' THEN '{n}'" for c, n in K.PREFIX_LANGUAGE_NAMES.items()) + " ELSE language END"


def _own(voice: str) -> str:
    return f"CASE WHEN contains({voice}, '_') THEN " + _PREFIXES.format(f"string_split({voice}, '_')[1][1]") + " END"


_REQ = (
    f"req AS (SELECT doc_id, {_list(_IDS)}[doc_id % {len(_IDS)} + 1] AS voice, "
    f"{_list(_LANGS)}[doc_id % {len(_LANGS)} + 1] AS language FROM documents)"
)
_CAT = (
    f"cat AS (SELECT unnest({_list(K.PREFIX_VOICES)}) AS voice, generate_subscripts({_list(K.PREFIX_VOICES)}, 1) AS pos), "
    f"catalog AS (SELECT pos, voice, {_own('voice')} AS language FROM cat)"
)
_TAG = (
    "CASE doc_id % 7 WHEN 0 THEN '  ' || upper(lang) || '_XX ' WHEN 1 THEN lang || '-Latn-YY' WHEN 2 THEN 'it' "
    "WHEN 3 THEN '' ELSE lang END"
)
_SUPPORTED = "de, en, es, fr, pt"


def _primary(tag: str) -> str:
    return f"string_split(replace(lower({sql.strip(tag)}), '_', '-'), '-')[1]"


def _norm(tag: str) -> str:
    return f"CASE WHEN {_primary(tag)} IN ('de', 'en', 'es', 'fr', 'pt') THEN {_primary(tag)} ELSE '' END"


def _error(tag: str) -> str:
    return (
        f"CASE WHEN {_primary(tag)} IN ('de', 'en', 'es', 'fr', 'pt') THEN '' ELSE 'Language ''' || {tag} || "
        f"''' is not supported. Supported languages: {_SUPPORTED}' END"
    )


_SPEAKERS = (
    "model AS (SELECT lang AS language, source AS voice, min(doc_id) AS pos FROM documents WHERE lang <> 'de' AND doc_id IN "
    "(SELECT doc_id FROM labels WHERE quality = 1) GROUP BY ALL), "
    "other AS (SELECT lang AS language, source AS voice, min(doc_id) AS pos FROM documents WHERE lang NOT IN ('de', 'fr') GROUP BY ALL)"
)
_SRC = (
    "src AS (SELECT CASE lang WHEN 'en' THEN 'a' WHEN 'es' THEN 'e' WHEN 'fr' THEN 'f' ELSE 'x' END || 'f_' || source AS voice "
    f"FROM documents), sv AS (SELECT DISTINCT voice, {_own('voice')} AS language FROM src), "
    "known AS (SELECT * FROM sv WHERE language IS NOT NULL)"
)
_SPEC = (
    "CASE event_id % 6 WHEN 0 THEN a || ', ' || b || ',' || a WHEN 1 THEN a || '-' || b WHEN 2 THEN ' 3 - 5 ,' || b || ',4-9' "
    "WHEN 3 THEN a || ',x' WHEN 4 THEN '' ELSE b END"
)
_RANGE = "range(trim(string_split(p, '-')[1])::INT, trim(string_split(p, '-')[-1])::INT + 1)"

ORACLES = {
    "voice_language": f"WITH {_REQ} SELECT doc_id, voice, coalesce({_own('voice')}, '') AS language FROM req",
    "language_normalize": f"WITH t AS (SELECT doc_id, {_TAG} AS tag FROM documents) SELECT doc_id, {_norm('tag')} AS language, "
    f"{_error('tag')} AS error FROM t",
    "language_resolve": f"WITH t AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN {_TAG} ELSE '' END AS tag, "
    "CASE WHEN doc_id % 10 = 1 THEN 'xx' ELSE lang END AS inf FROM documents) SELECT doc_id, "
    f"CASE WHEN tag <> '' THEN {_norm('tag')} ELSE {_norm('inf')} END AS language, "
    f"CASE WHEN tag <> '' THEN {_error('tag')} WHEN {_norm('inf')} = '' THEN 'A language is needed' ELSE '' END AS error FROM t",
    "voice_resolve": f"WITH {_REQ}, {_CAT}, o AS (SELECT doc_id, voice, coalesce({_own('voice')}, language) AS language FROM req), "
    "f AS (SELECT language, arg_min(voice, pos) AS first FROM catalog GROUP BY language) "
    "SELECT doc_id, o.language, CASE WHEN c.voice IS NOT NULL THEN o.voice ELSE coalesce(first, '') END AS voice, "
    "CASE WHEN c.voice IS NOT NULL THEN 'exact' WHEN first IS NOT NULL THEN 'replaced' ELSE 'error' END AS status, "
    "CASE WHEN c.voice IS NULL AND first IS NULL THEN 'No voices for language ''' || o.language || '''' ELSE '' END AS error "
    "FROM o LEFT JOIN catalog c ON c.voice = o.voice AND c.language = o.language LEFT JOIN f ON f.language = o.language",
    "voice_validate": f"WITH {_REQ}, {_CAT} SELECT doc_id, voice, language, CASE WHEN {_own('voice')} IS NULL THEN 'Unknown voice format: ' || voice "
    "WHEN voice NOT IN (SELECT voice FROM catalog) THEN 'Voice ''' || voice || ''' is not available' "
    "WHEN language NOT IN (SELECT language FROM catalog) THEN 'Language ''' || language || ''' is not supported' ELSE '' END AS error FROM req",
    "voice_validate_checkpoint": f"WITH {_SPEAKERS}, t AS (SELECT doc_id, {_TAG} AS tag, CASE doc_id % 5 WHEN 0 THEN 'default' WHEN 1 THEN '' "
    f"ELSE source END AS voice FROM documents) SELECT doc_id, CASE WHEN {_norm('tag')} = '' THEN {_error('tag')} "
    f"WHEN voice NOT IN ('', 'default') AND ({_norm('tag')}, voice) NOT IN (SELECT (language, voice) FROM model) THEN "
    f"'Voice ''' || voice || ''' is not available for language ''' || {_norm('tag')} || '''' ELSE '' END AS error FROM t",
    "catalog_merge": f"WITH {_SPEAKERS}, u AS (SELECT language, voice, 0 AS src, pos FROM model UNION ALL SELECT language, voice, 1, pos FROM other), "
    "d AS (SELECT language, voice, src, pos FROM u QUALIFY row_number() OVER (PARTITION BY language, voice ORDER BY src, pos) = 1) "
    "SELECT l.language, coalesce(voice, 'default') AS voice, coalesce(src, 0)::BIGINT AS src, coalesce(pos, 0)::BIGINT AS pos "
    "FROM (SELECT DISTINCT lang AS language FROM documents) l LEFT JOIN d USING (language)",
    "capabilities": f"WITH {_SRC} SELECT language, count(*) AS n_voices, {_NAMES} AS name FROM known GROUP BY language",
    "list_voices": f"WITH {_SRC} SELECT voice, language, {_NAMES} AS language_name FROM known",
    "backend_alias": f"SELECT {_list(_ALIASES)}[event_id % 6 + 1] AS alias, ['phonon', 'kokoro', 'phonon', '', '', 'phonon'][event_id % 6 + 1] AS backend, "
    "count(*) AS requests FROM events GROUP BY ALL",
    "chapter_spec": "WITH e AS (SELECT event_id, (event_id % 10)::VARCHAR AS a, (user_id % 17)::VARCHAR AS b FROM events), "
    f"s AS (SELECT event_id, {_SPEC} AS spec FROM e), g AS (SELECT *, event_id % 6 IN (3, 4) AS bad FROM s) "
    "SELECT event_id, spec, CASE WHEN bad THEN '' ELSE array_to_string(list_sort(list_distinct(flatten(list_transform("
    f"string_split(spec, ','), lambda p: CASE WHEN bad THEN [] ELSE {_RANGE} END)))), ',') END AS indices, "
    "CASE WHEN bad THEN 'Invalid chapter specification.' ELSE '' END AS error FROM g",
    "speed_delta": "WITH s AS (SELECT event_id, (event_id % 300)::DOUBLE / 100 AS v FROM events) SELECT event_id, "
    "CASE WHEN v BETWEEN 0.5 AND 2.0 THEN round_even((1.0::DOUBLE / v - 1) * 10000, 0) / 10000 + 0.0::DOUBLE ELSE -9.0::DOUBLE END AS delta, "
    "CASE WHEN v BETWEEN 0.5 AND 2.0 THEN '' ELSE 'Speed must be between 0.5 and 2.0, got ' || v END AS error FROM s",
    "request_validation": "WITH r AS (SELECT doc_id, source || ['.m4b', '.WAV', '.mp3', '', '/.wav', '.tar.m4b'][doc_id % 6 + 1] AS output FROM documents) "
    "SELECT doc_id, output, CASE doc_id % 6 WHEN 2 THEN 'Unsupported output extension ''.mp3''. Use .m4b or .wav.' "
    "WHEN 3 THEN 'Unsupported output extension ''(none)''. Use .m4b or .wav.' WHEN 4 THEN 'Unsupported output extension ''(none)''. Use .m4b or .wav.' "
    "ELSE CASE WHEN doc_id % 4 <= 1 THEN 'max_chars must be a positive integer.' ELSE '' END END AS error FROM r",
}
