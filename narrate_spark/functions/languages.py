"""Language, voice and backend names as Column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from narrate_spark import constants as K
from narrate_spark.functions.unicode import ustrip


def _lookup(table: dict[str, str], key: Column) -> Column:
    literal = F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])
    return F.try_element_at(literal, key)


def voice_language(voice: Column) -> Column:
    """Language of a prefix-coded voice id, null when it has no known prefix."""
    prefix = F.substring(F.substring_index(voice, "_", 1), 1, 1)
    return F.when(F.contains(voice, F.lit("_")), _lookup(K.VOICE_PREFIX_LANGUAGE, prefix))


def prefix_language_name(code: Column) -> Column:
    """Name of a voice-prefix language; an unknown code names itself."""
    return F.coalesce(_lookup(K.PREFIX_LANGUAGE_NAMES, code), code)


def primary_subtag(tag: Column) -> Column:
    """Lower-case primary subtag of a language tag."""
    return F.substring_index(F.translate(F.lower(ustrip(tag)), "_", "-"), "-", 1)


def checkpoint_language(tag: Column) -> Column:
    """Supported primary language, null when the tag is not supported."""
    primary = primary_subtag(F.coalesce(tag, F.lit("")))
    return F.when(primary.isin(*K.CHECKPOINT_LANGUAGES), primary)


def language_error(tag: Column) -> Column:
    """Message for an unsupported language, else null."""
    supported = ", ".join(sorted(K.CHECKPOINT_LANGUAGES))
    return F.when(
        checkpoint_language(tag).isNull(),
        F.concat(
            F.lit("Language '"),
            F.coalesce(tag, F.lit("")),
            F.lit(f"' is not supported. Supported languages: {supported}"),
        ),
    )


def backend_name(alias: Column) -> Column:
    """Canonical backend of an accepted spelling, else null."""
    return _lookup(K.BACKEND_ALIASES, F.lower(ustrip(F.coalesce(alias, F.lit("")))))
