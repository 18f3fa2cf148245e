"""Queries over record schemas: wrong shapes of every scalar kind, references across documents, folders of schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinwork.operators import lexicon
from skeinwork.plans.records import SCHEMAS
from skeinwork.plans.registry import query
from skeinwork.plans.views import both
from skeinwork.session import stored, work_dir

_LINK = "bafyreibml4midgt7ojq7dnabnku5ikzro4erfvdux6mmiqeat7pci2gy4u"
SCALARS = {
    "lexicon": 1,
    "id": "com.example.scalars",
    "defs": {
        "main": {
            "type": "record",
            "key": "any",
            "record": {
                "type": "object",
                "properties": {
                    "flag": {"type": "boolean", "const": True},
                    "raw": {"type": "bytes", "minLength": 2, "maxLength": 4},
                    "link": {"type": "cid-link"},
                    "file": {"type": "blob", "accept": ["image/*", "text/plain"], "maxSize": 100},
                    "head": {"type": "ref", "ref": "com.example.post#reply"},
                    "gone": {"type": "ref", "ref": "com.example.nowhere"},
                    "site": {"type": "ref", "ref": "com.example.link"},
                },
            },
        }
    },
}
KNOWN = [*SCHEMAS, SCALARS]


def _wrong(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    found = lexicon.validate(both(spark, sf_dir, sql), lexicon.catalogue(KNOWN), ["event_id"])
    said = F.array_sort(F.transform("violations", lambda v: F.concat_ws(" ", v["path"], v["message"])))
    return found.select("event_id", F.array_join(said, "; ").alias("wrong"))


def _records(cases: dict[str, list[tuple[str, str]]]) -> tuple[str, str]:
    """SQL of the records, and of what is wrong with them: the k-th field goes through its cases at its own pace."""
    parts, wrong, step = [], [], 1
    for field, values in cases.items():
        place = f"(event_id // {step}) % {len(values)}"
        parts.append(f"CASE {place} " + " ".join(f"WHEN {k} THEN ',\"{field}\":{v}'" for k, (v, _) in enumerate(values)) + " END")
        wrong.append(f"CASE {place} " + " ".join(f"WHEN {k} THEN {repr(field + w) if w else 'NULL'}" for k, (_, w) in enumerate(values)) + " END")
        step *= len(values)
    head = """'{"$type":"com.example.scalars"'"""
    return f"SELECT event_id, 'com.example.scalars' AS collection, {head} || {' || '.join(parts)} || '}}' AS record FROM events", f"SELECT event_id, concat_ws('; ', {', '.join(w for _, w in sorted(zip(cases, wrong, strict=True)))}) AS wrong FROM events"


_SCALARS, _SCALARS_WRONG = _records(
    {
        "flag": [("true", ""), ("false", " is not the constant"), ('"true"', " is not a boolean"), ("1", " is not a boolean")],
        "link": [(f'{{"$link":"{_LINK}"}}', ""), ('{"$link":"bad"}', " is not a link"), ('{"$link":1}', " is not a link"), ("{}", " is not a link"), (f'"{_LINK}"', " is not a link"), (f'{{"$link":"{_LINK[:-1]}v"}}', " is not a link"), ("[]", " is not a link")],
        "raw": [('{"$bytes":"AAEC"}', ""), ('{"$bytes":"!!!"}', " is not bytes"), ('{"$bytes":"AA"}', " has a wrong size"), ('{"$bytes":"AAECAwQF"}', " has a wrong size"), ('{"$bytes":"AAE="}', ""), ('"AAEC"', " is not bytes"), ('{"$bytes":[]}', " is not bytes"), ('{"$bytes":"AAEC="}', " is not bytes")],
    }
)


@query(_SCALARS_WRONG)
def h10_scalar_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Booleans, bytes and links, right and in wrong shapes of every kind."""
    return _wrong(spark, sf_dir, _SCALARS.replace(" // ", " div "))


def _blob(ref: str = '{"$link":"x"}', mime: str = '"image/png"', size: str = "1", kind: str = '"blob"') -> str:
    return f'{{"$type":{kind},"ref":{ref},"mimeType":{mime},"size":{size}}}'


_NO = " is not a blob"
_BLOBS, _BLOBS_WRONG = _records(
    {
        "file": [
            (_blob(), ""), (_blob(ref='"x"'), _NO), (_blob(ref="null"), _NO), (_blob(ref="7"), _NO), (_blob(ref="[]"), _NO), (_blob(ref='{"$link":7}'), _NO), (_blob(ref="{}"), _NO),
            (_blob(mime="7"), _NO), (_blob(mime="null"), _NO), (_blob(mime='"text/plain"'), ""), (_blob(mime='"text/html"'), " has a type that is not accepted"), (_blob(size='"1"'), _NO), (_blob(size="true"), _NO), (_blob(size="101"), " is too large"), (_blob(size="100.0"), ""),
            (_blob(kind='"image"'), _NO), (_blob(kind="null"), _NO), ("{}", _NO), ("[]", _NO), ('"blob"', _NO),
        ],
    }
)


@query(_BLOBS_WRONG)
def h11_blob_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blobs with every part missing or of a wrong kind, of other types, and too large."""
    return _wrong(spark, sf_dir, _BLOBS.replace(" // ", " div "))


_REFS, _REFS_WRONG = _records(
    {
        "gone": [("1", " refers to nothing"), ("{}", " refers to nothing")],
        "head": [('{"parent":"at://a.test/com.example.post/1"}', ""), ("{}", "/parent is required"), ('{"parent":1}', "/parent is not text"), ('"x"', " is not an object"), ('{"parent":"x"}', "/parent is no at-uri")],
        "site": [('{"uri":"https://a.test"}', ""), ('{"uri":"none"}', "/uri is no uri"), ("{}", "/uri is required")],
    }
)


@query(_REFS_WRONG)
def h13_document_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References to definitions of other documents, and to none."""
    return _wrong(spark, sf_dir, _REFS.replace(" // ", " div "))


# --- a folder of schemas, one for each part; some refer to nothing, some in circles, some come twice ------------

_PARTS = "(SELECT p_partkey AS n, max(p_partkey) OVER () AS m FROM part)"
_NEXT = "CASE WHEN n % 10 = 9 THEN n + m ELSE n % 10 + n // 10 * 10 + CASE WHEN n % 10 < 6 THEN 1 WHEN n % 10 = 6 THEN -3 ELSE 0 END END"
_FOLDER = f"""SELECT n, '{{"lexicon":1,"id":"com.example.s' || n || '","defs":{{"main":{{"type":"object","properties":{{"a":{{"type":"ref","ref":"#other"}},"b":{{"type":"array","items":{{"type":"ref","ref":"com.example.s' || ({_NEXT}) || '"}}}}}}}},"other":{{"type":"string"}}}}}}' AS value FROM {_PARTS} x"""
_EDGES = f"edges AS (SELECT 'com.example.s' || n || '#main' AS name, 'com.example.s' || ({_NEXT}) || '#main' AS ref FROM {_PARTS} x UNION ALL SELECT 'com.example.s' || n || '#main', 'com.example.s' || n || '#other' FROM {_PARTS} x)"


def _folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The definitions of a folder that holds a document for each part, a line each, every thirteenth twice, and one that
    is none."""
    made = both(spark, sf_dir, _FOLDER.replace(" // ", " div "))
    path = work_dir(spark, "schemas")
    twice = made.where("n % 13 = 0")
    broken = made.where("n = 1").select("n", F.lit("[1]").alias("value"))
    made.unionAll(twice).unionAll(broken).select("value").write.text(path)
    return stored(lexicon.definitions(spark.read.text(path)), "definitions")


@query(f"SELECT 'com.example.s' || n AS id, CAST(2 AS BIGINT) AS n FROM {_PARTS} x WHERE n % 13 = 0")
def h01_duplicate_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that a folder holds twice."""
    return lexicon.duplicates(_folder(spark, sf_dir))


@query(f"WITH {_EDGES} SELECT name, ref FROM edges WHERE ref NOT IN (SELECT name FROM edges) AND ref NOT LIKE '%#other'")
def h02_unresolved_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of a folder's schemas that nothing answers."""
    return lexicon.loose(_folder(spark, sf_dir))


@query(f"WITH RECURSIVE {_EDGES}, c AS (SELECT name, ref FROM edges UNION SELECT c.name, e.ref FROM c JOIN edges e ON c.ref = e.name) SELECT name, count(*) AS n, bool_or(ref = name) AS circular FROM c GROUP BY name")
def a24_schema_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many definitions each one needs, and which stand in a circle."""
    found = lexicon.closure(lexicon.references(_folder(spark, sf_dir)))
    return found.groupBy("name").agg(F.count("*").alias("n"), F.bool_or(F.col("ref") == F.col("name")).alias("circular"))
