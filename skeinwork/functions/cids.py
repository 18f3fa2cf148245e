"""Content ids: CIDv1 with SHA-256, codec dag-cbor or raw, as base-32 text; tree heights of keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skeinwork.functions.tids import PLAIN

# Base-32 digits, and the leading bytes (version, codec, hash kind, hash length) in hexadecimal.
BASE32 = "abcdefghijklmnopqrstuvwxyz234567"
DAG_CBOR, RAW = "01711220", "01551220"
CID_PATTERN = r"b[a-z2-7]{58}"


def cid_of_digest(digest: Column, codec: str = DAG_CBOR) -> Column:
    """The id of a SHA-256 digest in hexadecimal: 75 digits are five groups of twelve base-32 digits, 58 of which count."""
    digits = F.rpad(F.concat(F.lit(codec), digest), 75, "0")
    groups = [F.lpad(F.conv(F.substring(digits, 1 + 15 * k, 15), 16, 32), 12, "0") for k in range(5)]
    return F.concat(F.lit("b"), F.translate(F.substring(F.concat(*groups), 1, 58), PLAIN, BASE32))


def cid_of(data: Column, codec: str = DAG_CBOR) -> Column:
    """The id of some bytes or text."""
    return cid_of_digest(F.sha2(data.cast("binary"), 256), codec)


def cid_valid(text: Column) -> Column:
    """The shape of a CIDv1 text with one of the two codecs; the last digit has two spare bits that must be zero."""
    return F.coalesce(text.rlike(r"\A(bafyrei|bafkrei)[a-z2-7]{51}[aeimquy4]\z"), F.lit(False))


def cid_codec(text: Column) -> Column:
    """``dag-cbor``, ``raw`` or null."""
    return F.when(text.startswith("bafyrei"), "dag-cbor").when(text.startswith("bafkrei"), "raw")


def cid_digest(text: Column) -> Column:
    """The SHA-256 digest in hexadecimal."""
    digits = F.rpad(F.translate(F.substring(text, 2, 58), BASE32, PLAIN), 60, "0")
    groups = [F.lpad(F.conv(F.substring(digits, 1 + 12 * k, 12), 32, 16), 15, "0") for k in range(5)]
    return F.lower(F.substring(F.concat(*groups), 9, 64))


def key_height(key: Column) -> Column:
    """The tree layer of a key: leading zero two-bit pairs of its SHA-256."""
    digest = F.sha2(key.cast("binary"), 256)
    zeros = F.length(F.regexp_extract(digest, "^0*", 0))
    return zeros * 2 + F.when(F.substr(digest, zeros + 1, F.lit(1)).isin("1", "2", "3"), 1).otherwise(0)


def common_prefix(a: Column, b: Column) -> Column:
    """The number of leading bytes that two texts share."""
    ha, hb = F.hex(a.cast("binary")), F.hex(b.cast("binary"))
    size = F.least(F.octet_length(a), F.octet_length(b))
    same = F.transform(F.sequence(F.lit(0), size), lambda n: F.substr(ha, n * 2 + 1, F.lit(2)) == F.substr(hb, n * 2 + 1, F.lit(2)))
    first = F.nullif(F.array_position(same, False), F.lit(0))  # 0 where no byte differs
    return F.coalesce(F.least(size, first.cast("int") - 1), size)
