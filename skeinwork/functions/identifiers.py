"""Identifier syntax as Columns: validity predicates, parts and normal forms.

Predicates are false, never null, for null input. Lengths are bytes. Patterns are anchored with ``\\A`` and ``\\z``,
as ``$`` would let a trailing newline pass.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The grammars, and the top-level domains that no account may use.
LABEL = r"[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?"
TOP = r"[a-zA-Z](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?"
DID = r"did:[a-z]+:[a-zA-Z0-9._:%-]*[a-zA-Z0-9._-]"
HANDLE = rf"(?:{LABEL}\.)+{TOP}"
NSID = rf"{TOP}(?:\.{LABEL})+\.[a-zA-Z][a-zA-Z0-9]{{0,62}}"
RECORD_KEY = r"[a-zA-Z0-9_~.:-]{1,512}"
TID = r"[2-7a-j][2-7a-z]{12}"
URI = r"[a-zA-Z][a-zA-Z0-9+.-]{0,80}:[^\x00-\x20\x7F]+"


def _language() -> str:
    """A language tag by the grammar of RFC 5646, section 2.1, part by part."""
    alpha, digit, alnum = "[A-Za-z]", "[0-9]", "[A-Za-z0-9]"
    extended = f"{alpha}{{3}}(?:-{alpha}{{3}}){{0,2}}"
    primary = f"(?:{alpha}{{2,3}}(?:-{extended})?|{alpha}{{4,8}})"
    script, region = f"{alpha}{{4}}", f"(?:{alpha}{{2}}|{digit}{{3}})"
    variant = f"(?:{alnum}{{5,8}}|{digit}{alnum}{{3}})"
    extension = f"[0-9A-WY-Za-wy-z](?:-{alnum}{{2,8}})+"
    private = f"x(?:-{alnum}{{1,8}})+"
    tag = f"{primary}(?:-{script})?(?:-{region})?(?:-{variant})*(?:-{extension})*(?:-{private})?"
    # The tags of the registry that the grammar doesn't give, or gives another meaning.
    irregular = "en-GB-oed i-ami i-bnn i-default i-enochian i-hak i-klingon i-lux i-mingo i-navajo i-pwn i-tao i-tay i-tsu sgn-BE-FR sgn-BE-NL sgn-CH-DE"
    regular = "art-lojban cel-gaulish no-bok no-nyn zh-guoyu zh-hakka zh-min zh-min-nan zh-xiang"
    return f"(?:{'|'.join(f'{irregular} {regular}'.split())}|{tag}|{private})"


LANGUAGE = _language()
MST_KEY = r"[a-zA-Z0-9_~.:-]+/[a-zA-Z0-9_~.:-]+"
BLOCKED_TOPS = ["alt", "arpa", "example", "internal", "invalid", "local", "localhost", "onion"]
INVALID_HANDLE = "handle.invalid"


def matches(text: Column, pattern: str, most: int) -> Column:
    """Whether the whole text has the pattern and at most ``most`` bytes."""
    return F.coalesce(text.rlike(rf"\A{pattern}\z") & (F.octet_length(text) <= most), F.lit(False))


def did_valid(text: Column) -> Column:
    return matches(text, DID, 2048)


def did_method(did: Column) -> Column:
    """The method; empty where there is none."""
    return F.regexp_extract(did, r"(?s)\Adid:([^:]*):", 1)


def did_identifier(did: Column) -> Column:
    """What follows the method; empty where there is none."""
    return F.regexp_extract(did, r"(?s)\Adid:[^:]*:(.*)\z", 1)


def handle_valid(text: Column) -> Column:
    return matches(text, HANDLE, 253)


def handle_top(handle: Column) -> Column:
    """The last label, lower-cased; empty without a dot."""
    return F.when(F.instr(handle, ".") > 0, F.lower(F.substring_index(handle, ".", -1))).otherwise("")


def handle_allowed(handle: Column) -> Column:
    return ~handle_top(handle).isin(BLOCKED_TOPS)


def handle_is_invalid(handle: Column) -> Column:
    """Whether it is the sentinel that stands for a failed resolution."""
    return F.lower(handle) == INVALID_HANDLE


def nsid_valid(text: Column) -> Column:
    return matches(text, NSID, 317)


def nsid_name(nsid: Column) -> Column:
    return F.substring_index(nsid, ".", -1)


def _before_last(text: Column) -> Column:
    return F.regexp_extract(text, r"(?s)\A(.*)\.[^.]*\z", 1)


def nsid_authority(nsid: Column) -> Column:
    """The domain labels in reverse, lower-cased; empty without a dot."""
    return F.lower(F.array_join(F.reverse(F.split(_before_last(nsid), r"\.")), "."))


def nsid_normal(nsid: Column) -> Column:
    """Domain labels lower-cased, the name as it is."""
    return F.when(F.instr(nsid, ".") > 0, F.concat(F.lower(_before_last(nsid)), F.lit("."), nsid_name(nsid))).otherwise(nsid)


def record_key_valid(text: Column) -> Column:
    return matches(text, RECORD_KEY, 512) & ~F.coalesce(text.isin(".", ".."), F.lit(True))


def identifier_valid(text: Column) -> Column:
    """A DID where it starts like one, else a handle."""
    return F.when(text.startswith("did:"), did_valid(text)).otherwise(handle_valid(text))


def identifier_normal(text: Column) -> Column:
    return F.when(text.startswith("did:"), text).otherwise(F.lower(text))


def uri_authority(uri: Column) -> Column:
    return F.regexp_extract(uri, r"(?s)\Aat://([^/]*)", 1)


def uri_path(uri: Column) -> Column:
    return F.regexp_extract(uri, r"(?s)\Aat://[^/]*/(.*)\z", 1)


def uri_collection(uri: Column) -> Column:
    return F.regexp_extract(uri, r"(?s)\Aat://[^/]*/([^/]*)", 1)


def uri_record_key(uri: Column) -> Column:
    return F.regexp_extract(uri, r"(?s)\Aat://[^/]*/[^/]*/(.*)\z", 1)


def at_uri_valid(text: Column) -> Column:
    """``at://authority[/collection[/record key]]`` with valid parts, no query and no fragment."""
    shape = text.rlike(r"\Aat://[^/?#]+(?:/[^/?#]+(?:/[^/?#]+)?)?\z") & (F.octet_length(text) <= 8192)
    parts = identifier_valid(uri_authority(text)) & ((uri_collection(text) == "") | nsid_valid(uri_collection(text))) & ((uri_record_key(text) == "") | record_key_valid(uri_record_key(text)))
    return F.coalesce(shape & parts, F.lit(False))


def at_uri_parts(text: Column) -> Column:
    return F.struct(uri_authority(text).alias("authority"), uri_collection(text).alias("collection"), uri_record_key(text).alias("rkey"))


def at_uri_normal(uri: Column) -> Column:
    """Authority and collection in normal form, the record key as it is."""
    collection, rkey = uri_collection(uri), uri_record_key(uri)
    with_collection = F.when(collection == "", "").otherwise(F.concat(F.lit("/"), nsid_normal(collection)))
    return F.concat(F.lit("at://"), identifier_normal(uri_authority(uri)), with_collection, F.when(rkey == "", "").otherwise(F.concat(F.lit("/"), rkey)))


def language_valid(text: Column) -> Column:
    return matches(text, LANGUAGE, 1 << 20)


def uri_valid(text: Column) -> Column:
    return matches(text, URI, 8192)


def split_key(path: Column) -> Column:
    """(collection, rkey) cut at the first slash; without one, all is the collection."""
    at = F.instr(path, "/")
    return F.struct(F.when(at == 0, path).otherwise(F.substring_index(path, "/", 1)).alias("collection"), F.when(at == 0, "").otherwise(F.substr(path, at + 1)).alias("rkey"))


def repo_path_valid(path: Column) -> Column:
    """``collection/record key``, both valid."""
    parts = split_key(path)
    return F.coalesce((F.instr(path, "/") > 0) & nsid_valid(parts["collection"]) & record_key_valid(parts["rkey"]), F.lit(False))


def tree_key_valid(key: Column) -> Column:
    """One slash, both sides non-empty, at most 1024 bytes."""
    return matches(key, MST_KEY, 1024)


def http_origin(url: Column) -> Column:
    """The http(s) origin of a ws(s) url; null for other schemes or without a host."""
    scheme, host = F.regexp_extract(url, r"\A(wss?|https?)://", 1), F.regexp_extract(url, r"\A(?:wss?|https?)://([^/?#]+)", 1)
    return F.when((scheme != "") & (host != ""), F.concat(F.when(scheme.isin("wss", "https"), "https").otherwise("http"), F.lit("://"), host))


def endpoint_valid(url: Column) -> Column:
    """An http(s) url with a host."""
    return F.coalesce(url.rlike(r"\A(?i:https?)://[^/?#\s]+"), F.lit(False))


def mime_accepted(accept: Column, mime: Column) -> Column:
    """Whether an array of patterns (``*/*``, ``type/*`` or exact) takes the type."""
    return F.exists(accept, lambda p: (p == "*/*") | (p == mime) | (p.endswith("/*") & F.startswith(mime, F.regexp_replace(p, r"\*\z", ""))))


def op_fields_error(repo: Column, collection: Column, rkey: Column, rev: Column) -> Column:
    """The first field of an operation with wrong syntax; null where all are right."""
    return F.when(~did_valid(repo), "repo").when(~nsid_valid(collection), "collection").when(~record_key_valid(rkey), "rkey").when(~matches(rev, TID, 13), "rev")
