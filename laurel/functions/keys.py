"""Identity keys, fingerprints and hashes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from laurel.functions.values import _col

# Fields whose change makes a stored fact change; observation time, raw links and the provider
# payload stay out.
MATERIAL_FIELDS = (
    "source",
    "method",
    "source_identity",
    "source_competition_id",
    "source_competitor_id",
    "competition_id",
    "competition_name",
    "competition_country",
    "competition_start",
    "competition_end",
    "round_id",
    "round_number",
    "round_name",
    "event_id",
    "event_name",
    "person_name",
    "person_id",
    "country_code",
    "kind",
    "value",
    "entered_at",
    "source_url",
    "competition_timezone",
    "local_date",
)


def blank_to_null(value) -> Column:
    return F.nullif(_col(value), F.lit(""))


def natural_key(competition_id, person_id, event_id, round_number, kind) -> Column:
    """Source-independent key of one result; null while any part is missing."""
    competition, person = blank_to_null(competition_id), blank_to_null(person_id)
    number = _col(round_number).cast("string")
    return F.when(
        competition.isNotNull() & person.isNotNull() & number.isNotNull(),
        F.concat_ws(
            "|",
            F.lit("wca"),
            F.upper(competition),
            F.upper(person),
            _col(event_id),
            number,
            _col(kind),
        ),
    )


def source_key(source, source_competition_id, source_identity, event_id, kind) -> Column:
    return F.concat_ws(
        "|",
        F.lit("source"),
        _col(source),
        F.coalesce(_col(source_competition_id), F.lit("")),
        _col(source_identity),
        _col(event_id),
        _col(kind),
        F.lit("final"),
    )


def observation_key(source, method, source_identity, kind) -> Column:
    return F.concat_ws(
        "|", _col(source), _col(method), _col(source_identity), _col(kind), F.lit("final")
    )


def comparison_key(
    competition_id, person_id, event_id, round_number, kind, level, source, source_result_id, stable_identity
) -> Column:
    """Key under which detections of the same record by different methods meet."""
    natural = natural_key(competition_id, person_id, event_id, round_number, kind)
    ident = F.coalesce(blank_to_null(source_result_id), _col(stable_identity))
    own = F.concat(_col(source), F.lit(":"), ident, F.lit("|"), _col(kind))
    return F.concat(F.coalesce(natural, own), F.lit("|"), _col(level))


def canonical_json(fields: Sequence[str]) -> Column:
    """Compact JSON with sorted field names and explicit nulls."""
    return F.to_json(F.struct(*sorted(fields)), {"ignoreNullFields": "false"})


def content_hash(fields: Sequence[str]) -> Column:
    return F.sha2(canonical_json(fields), 256)


def material_fingerprint(fields: Sequence[str] = MATERIAL_FIELDS) -> Column:
    return F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256)


def valid_person_id(person_id) -> Column:
    text = F.upper(F.trim(_col(person_id)))
    return F.coalesce(text.rlike(r"^\d{4}[A-Z]{4}\d{2}\z"), F.lit(False))


def competition_source_key(official_id, source, source_id) -> Column:
    official = blank_to_null(official_id)
    return F.when(official.isNotNull(), F.concat(F.lit("wca:"), official)).otherwise(
        F.concat(_col(source), F.lit(":"), _col(source_id))
    )
