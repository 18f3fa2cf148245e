"""Retry delays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the longest wait that a server may ask for, in seconds.
LONGEST_WAIT = 330.0


def delay(attempt: Column, base: float = 1.0, most: float = 30.0, jitter: Column | None = None) -> Column:
    """Seconds before a retry: base doubled for each attempt, capped, times ``jitter`` where given."""
    plain = F.least(F.lit(most), F.lit(base) * F.pow(F.lit(2.0), F.least(attempt, F.lit(60)).cast("double")))
    return plain if jitter is None else plain * jitter


def rate_limit_delay(reset_in: Column, attempt: Column, base: float = 1.0, most: float = 30.0) -> Column:
    """What the server asks for, within the longest wait; else the usual delay."""
    return F.when(reset_in > 0, F.least(reset_in.cast("double"), F.lit(LONGEST_WAIT))).otherwise(delay(attempt, base, most))
