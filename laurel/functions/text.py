"""Names, tags, labels and search text."""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from laurel.functions import fixed
from laurel.functions.values import _col

_ASCII = r"^[\x00-\x7F]*\z"


def literal_map(values: Mapping) -> Column:
    return F.create_map(*[F.lit(item) for pair in values.items() for item in pair])


def looked_up(values: Mapping, key) -> Column:
    return F.try_element_at(literal_map(values), _col(key))


@F.pandas_udf(StringType())
def _fold_accents(names: pd.Series) -> pd.Series:
    def fold(name):
        if name is None:
            return None
        decomposed = unicodedata.normalize("NFKD", name).casefold()
        return "".join(c for c in decomposed if not unicodedata.combining(c))

    return names.map(fold)


def folded_name(name) -> Column:
    """Case- and accent-folded sort key. Only names beyond ASCII reach Python."""
    name = _col(name)
    plain = name.rlike(_ASCII)
    return F.coalesce(F.when(plain, F.lower(name)), _fold_accents(F.when(~plain, name)))


def collapsed(text) -> Column:
    return F.trim(F.regexp_replace(_col(text), r"\s+", " "))


def split_native_name(name) -> Column:
    """``Romanized (Native)`` as two names; the second is null when there is none."""
    text = F.trim(F.coalesce(_col(name), F.lit("")))
    pattern = r"^(.+?)\s*\(([^()]*)\)\s*$"
    romanized = F.trim(F.regexp_extract(text, pattern, 1))
    native = F.trim(F.regexp_extract(text, pattern, 2))
    both = (romanized != "") & (native != "")
    return F.struct(
        F.when(both, romanized).otherwise(text).alias("romanized_name"),
        F.when(both, native).alias("native_name"),
    )


def record_tag(value) -> Column:
    tag = F.upper(F.trim(F.coalesce(_col(value), F.lit(""))))
    return F.when(tag.isin(*fixed.CONTINENTAL_TAGS), "CR").otherwise(tag)


def plain_continent(value) -> Column:
    """Continent name from an id such as ``_Europe``; blank when it is none of the six."""
    text = F.trim(F.regexp_replace(F.coalesce(_col(value), F.lit("")), "^_", ""))
    return F.when(text.isin(*fixed.CONTINENTS), text).otherwise("")


def level_label(level, continent) -> Column:
    level = _col(level)
    label = looked_up(fixed.CONTINENT_LABELS, continent)
    return F.when(level == "CR", F.coalesce(label, F.lit("CR"))).otherwise(level)


def alert_icon(level, continent) -> Column:
    label = level_label(level, continent)
    return F.when(label == "CR", "/icons/icon-192.png").otherwise(
        F.concat(F.lit("/notification_icons/notification_icon_"), label, F.lit(".png"))
    )


def alert_type(level) -> Column:
    return looked_up(fixed.ALERT_TYPES, level)


def is_relative_target(url) -> Column:
    """A same-origin path: one leading slash, no scheme, no host."""
    return F.coalesce(_col(url).startswith("/") & ~_col(url).startswith("//"), F.lit(False))


def source_label(method) -> Column:
    return F.when(_col(method) == fixed.SOCKET, fixed.SECOND_SOURCE_LABEL).otherwise(
        fixed.FIRST_SOURCE_LABEL
    )


def event_search_terms(event_id) -> Column:
    terms = F.create_map(
        *[
            item
            for event, words in fixed.EVENT_SEARCH_TERMS.items()
            for item in (F.lit(event), F.array(*[F.lit(w) for w in words]))
        ]
    )
    return F.coalesce(F.try_element_at(terms, _col(event_id)), F.array().cast("array<string>"))


def events_matching(term: str) -> list[str]:
    wanted = term.strip().casefold()
    return [e for e, words in fixed.EVENT_SEARCH_TERMS.items() if wanted and any(wanted in w for w in words)]
