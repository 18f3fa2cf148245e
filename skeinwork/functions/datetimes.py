"""Date-times as text: strict, lenient and schema-level validity, and instants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two grammars.
STRICT = r"[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]+)?(?:Z|(?!-00:00)[+-](?:[01][0-9]|2[0-3]):[0-5][0-9])"
SCHEMA = r"[0-9]{4}-(?:0[1-9]|1[012])-(?:[0-2][0-9]|3[01])T(?:[0-1][0-9]|2[0-3]):[0-5][0-9]:(?:[0-5][0-9]|60)(?:\.[0-9]+)?(?:Z|[+-](?:[0-1][0-9]|2[0-3]):[0-5][0-9])"


def instant(text: Column) -> Column:
    """The instant to microseconds; null where the text is no date-time."""
    return F.try_to_timestamp(text)


def _year_fits(text: Column) -> Column:
    """Whether the year in UTC has four digits: only offsets at the ends of the range can push it out."""
    year = F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), instant(text).cast("timestamp_ntz")), "yyyyy")
    return F.coalesce(year.rlike(r"\A0[0-9]{4}\z"), F.lit(False))


def datetime_valid(text: Column) -> Column:
    """The grammar, a real calendar date, at most 64 bytes and a year of four digits."""
    shape = text.rlike(rf"\A{STRICT}\z") & (F.octet_length(text) <= 64)
    return F.coalesce(F.when(shape, instant(text).isNotNull() & _year_fits(text)), F.lit(False))


def datetime_repaired(text: Column) -> Column:
    """``-00:00``, ``-0000`` and ``+0000`` as ``+00:00``; ``Z`` where no zone is found."""
    fixed = F.regexp_replace(F.regexp_replace(text, r"-00:00\z", "+00:00"), r"[+-]0000\z", "+00:00")
    return F.when(fixed.rlike(r"(?s)(?:Z|[+-].{5})\z"), fixed).otherwise(F.concat(fixed, F.lit("Z")))


def datetime_lenient(text: Column) -> Column:
    """The text itself or its repaired form, whichever is valid; else null."""
    return F.when(datetime_valid(text), text).when(datetime_valid(datetime_repaired(text)), datetime_repaired(text))


def datetime_schema_valid(text: Column) -> Column:
    """What record schemas ask for: the grammar, with second 60 and any day up to 31; no year before 0."""
    shape = text.rlike(rf"\A{SCHEMA}\z") & (F.octet_length(text) <= 64) & ~text.endswith("-00:00")
    return F.coalesce(F.when(shape, instant(text).isNull() | _year_fits(text)), F.lit(False))
