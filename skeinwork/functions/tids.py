"""Timestamp ids: 53 bits of microseconds and 10 of a clock id in thirteen sortable base-32 digits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skeinwork.functions.identifiers import TID, matches

# The digits in order, and the digits of ``conv``.
DIGITS = "234567abcdefghijklmnopqrstuvwxyz"
PLAIN = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
MAX_MICROS = (1 << 53) - 1


def tid_valid(text: Column) -> Column:
    return matches(text, TID, 13)


def tid_from_integer(value: Column) -> Column:
    """The id of a non-negative 63-bit integer."""
    return F.translate(F.lpad(F.conv(value.cast("string"), 10, 32), 13, "0"), PLAIN, DIGITS)


def tid(micros: Column, clock: Column) -> Column:
    """The id of a time and a clock id; null out of range."""
    fits = micros.between(0, MAX_MICROS) & clock.between(0, 1023)
    return F.when(fits, tid_from_integer(F.shiftleft(micros.cast("long"), 10) + clock))


def tid_integer(text: Column) -> Column:
    """The integer; 0 where the length is wrong."""
    return F.when(F.octet_length(text) == 13, F.conv(F.translate(text, DIGITS, PLAIN), 32, 10).cast("long")).otherwise(0)


def tid_micros(text: Column) -> Column:
    return F.shiftright(tid_integer(text), 10)


def tid_clock(text: Column) -> Column:
    return tid_integer(text).bitwiseAND(1023)


def tid_time(text: Column) -> Column:
    return F.timestamp_micros(tid_micros(text))
