"""Voice catalogs: listing, resolving, validating, merging.

Catalogs are fixed lists of at most a few hundred rows, so they are broadcast;
``small`` checks that before it does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from narrate_spark import constants as K
from narrate_spark.functions.languages import (
    checkpoint_language,
    language_error,
    prefix_language_name,
    voice_language,
)
from narrate_spark.operators.sizes import small


def prefix_catalog(spark: SparkSession) -> DataFrame:
    """The published prefix-coded voices: pos, voice, language."""
    rows = ",".join(f"({i}L, '{v}')" for i, v in enumerate(K.PREFIX_VOICES))
    ids = spark.sql(f"SELECT * FROM VALUES {rows} AS t(pos, voice)")
    return ids.withColumn("language", voice_language(F.col("voice")))


def catalog_from_ids(ids: DataFrame) -> DataFrame:
    """Catalog of voice ids (pos, voice); ids without a known prefix are left out."""
    known = ids.withColumn("language", voice_language(F.col("voice")))
    return known.where(F.col("language").isNotNull())


def capabilities(voices: DataFrame) -> DataFrame:
    """Languages of a catalog with their names and voice counts."""
    counts = voices.groupBy("language").agg(F.count(F.lit(1)).alias("n_voices"))
    return counts.withColumn("name", prefix_language_name(F.col("language")))


def list_voices(voices: DataFrame, language: str | None = None) -> DataFrame:
    """Voices with the name of their language, all or of one exact code."""
    rows = voices if language is None else voices.where(F.col("language") == language)
    return rows.select(
        "voice", "language", prefix_language_name(F.col("language")).alias("language_name")
    )


def resolve_voices(requests: DataFrame, catalog: DataFrame) -> DataFrame:
    """Voice and language each request (voice, language) really gets.

    The voice's own language overrides the request.  A voice the catalog does
    not have for that language is replaced by the first one it has; a language
    without voices is an error.
    """
    own = voice_language(F.col("voice"))
    asked = requests.withColumn("_lang", F.coalesce(own, F.col("language")))
    exact = catalog.select(
        F.col("voice"), F.col("language").alias("_lang"), F.lit(True).alias("_exact")
    ).distinct()
    first = catalog.groupBy(F.col("language").alias("_lang")).agg(
        F.min_by("voice", "pos").alias("_first")
    )
    joined = asked.join(small(exact), ["voice", "_lang"], "left")
    joined = joined.join(small(first), "_lang", "left")
    found = F.coalesce("_exact", F.lit(False))
    return joined.select(
        *[c for c in requests.columns if c not in ("voice", "language")],
        F.col("_lang").alias("language"),
        F.when(found, F.col("voice")).otherwise(F.coalesce("_first", F.lit(""))).alias("voice"),
        F.when(found, "exact")
        .when(F.col("_first").isNotNull(), "replaced")
        .otherwise("error")
        .alias("status"),
        F.when(
            ~found & F.col("_first").isNull(),
            F.concat(F.lit("No voices for language '"), F.col("_lang"), F.lit("'")),
        )
        .otherwise("")
        .alias("error"),
    )


def validate_prefix(requests: DataFrame, catalog: DataFrame) -> DataFrame:
    """Error of each (voice, language) for the prefix-coded backend, else ''."""
    voices = catalog.select("voice", F.lit(True).alias("_voice")).distinct()
    languages = catalog.select("language", F.lit(True).alias("_language")).distinct()
    joined = requests.join(small(voices), "voice", "left")
    joined = joined.join(small(languages), "language", "left")
    error = (
        F.when(
            voice_language(F.col("voice")).isNull(),
            F.concat(F.lit("Unknown voice format: "), F.col("voice")),
        )
        .when(
            F.col("_voice").isNull(),
            F.concat(F.lit("Voice '"), F.col("voice"), F.lit("' is not available")),
        )
        .when(
            F.col("_language").isNull(),
            F.concat(F.lit("Language '"), F.col("language"), F.lit("' is not supported")),
        )
        .otherwise("")
    )
    return joined.select(*requests.columns, error.alias("error"))


def validate_checkpoint(requests: DataFrame, catalog: DataFrame) -> DataFrame:
    """The same for the per-language backend; ``default`` is always accepted."""
    lang = checkpoint_language(F.col("language"))
    voices = catalog.select("voice", F.col("language").alias("_lang"), F.lit(True).alias("_known"))
    joined = requests.withColumn("_lang", lang).join(
        small(voices.distinct()), ["voice", "_lang"], "left"
    )
    free = F.coalesce("voice", F.lit("")).isin("", "default")
    missing = F.concat(
        F.lit("Voice '"), F.col("voice"), F.lit("' is not available for language '"),
        F.col("_lang"), F.lit("'"),
    )
    error = F.coalesce(
        language_error(F.col("language")),
        F.when(~free & F.col("_known").isNull(), missing),
        F.lit(""),
    )
    return joined.select(*requests.columns, error.alias("error"))


def merge_catalogs(model: DataFrame, catalog: DataFrame, languages: DataFrame) -> DataFrame:
    """Ordered union of model voices and catalog voices, without repeats.

    Each side holds language, pos and voice.  A language with no voice at all
    has the voice ``default``.  The rank is dense per language; catalogs are
    fixed lists, so the window over them is small by nature.
    """
    both = model.select("language", F.lit(0).alias("src"), "pos", "voice").unionByName(
        catalog.select("language", F.lit(1).alias("src"), "pos", "voice")
    )
    first = both.groupBy("language", "voice").agg(F.min(F.struct("src", "pos")).alias("at"))
    joined = languages.select("language").distinct().join(first, "language", "left")
    return joined.select(
        "language",
        F.coalesce("voice", F.lit("default")).alias("voice"),
        F.coalesce("at.src", F.lit(0)).cast("bigint").alias("src"),
        F.coalesce("at.pos", F.lit(0)).cast("bigint").alias("pos"),
    )


def resolve_language(explicit: Column, inferred: Column) -> tuple[Column, Column]:
    """Language of a request and its error.

    An explicit tag must be supported; without one, the language of the book
    is taken where it is supported.
    """
    given = F.coalesce(explicit, F.lit("")) != ""
    language = F.when(given, checkpoint_language(explicit)).otherwise(checkpoint_language(inferred))
    error = F.when(given, language_error(explicit)).otherwise(
        F.when(checkpoint_language(inferred).isNull(), F.lit("A language is needed"))
    )
    return language, error
