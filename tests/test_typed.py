"""Reading binary values without building them, typed records, and a validator that no JSON makes fail."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skeinwork.functions import cbor
from skeinwork.operators import lexicon, typed
from skeinwork.plans.schemas import KNOWN
from skeinwork.plans.typed import CHAIN
from skeinwork.sources import frames

LINK = cbor.Link(b"\x01\x71\x12\x20" + bytes(32))
PLAIN = st.recursive(st.none() | st.booleans() | st.integers(-(2**63), 2**63 - 1) | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=8) | st.binary(max_size=300) | st.just(LINK), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=5), x, max_size=4), max_leaves=20)
JSON = st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False) | st.text(max_size=6), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.sampled_from(["$type", "$link", "$bytes", "ref", "mimeType", "size", "parent", "uri", "file"]) | st.text(max_size=3), x, max_size=5), max_leaves=20)


@settings(max_examples=200, deadline=None)
@given(PLAIN)
def test_a_skip_ends_where_a_decoding_ends(value):
    data = cbor.encode(value)
    assert cbor.skipped(data, 0) == len(data)
    for cut in range(len(data)):
        with pytest.raises(ValueError):
            cbor.skipped(data[:cut], 0)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.text(max_size=5), PLAIN, max_size=5), st.binary(max_size=6))
def test_fields_are_found_where_they_are(value, rest):
    data = cbor.encode(value)
    assert {k: cbor.decode_at(data, at)[0] for k, at in cbor.fields_at(data)} == value
    text = value.get("a") if isinstance(value.get("a"), str) else None
    if value.get("a") is None or text is not None:
        assert cbor.peek_text(data, "a") == text or value.get("a") is None


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=40))
def test_no_bytes_raise_anything_else(data):
    for read in (lambda: cbor.peek_text(data), lambda: cbor.skipped(data, 0), lambda: typed.decoded(data, typed.chained(CHAIN, "app.bsky.feed.post"))):
        try:
            read()
        except ValueError:
            pass
    frames.decode_label_frame(data)


@settings(max_examples=400, deadline=None)
@given(st.dictionaries(st.sampled_from(["flag", "raw", "link", "file", "head", "gone", "site", "$type"]), JSON, max_size=8))
def test_no_json_makes_the_validator_fail(record):
    known = lexicon.catalogue(KNOWN)
    for nsid in ("com.example.scalars", "com.example.post"):
        for path, message in lexicon.violations(known, nsid, json.loads(json.dumps(record))):
            assert isinstance(path, str) and isinstance(message, str)


def test_records_that_are_too_deep_are_wrong(spark):
    deep = '{"file":' * 100_000 + "1" + "}" * 100_000
    rows = spark.createDataFrame([(1, "com.example.scalars", deep), (2, "com.example.scalars", "{"), (3, "com.example.scalars", None)], "id int, collection string, record string")
    found = lexicon.validate(rows, lexicon.catalogue(KNOWN), ["id"]).orderBy("id").collect()
    assert [r.violations[0].message for r in found] == ["is too deep", "not JSON", "not JSON"]


def test_the_first_catalogue_that_has_a_collection_decides():
    assert typed.chained(CHAIN, "app.bsky.actor.profile").simpleString() == "struct<name:string>"
    assert typed.chained(CHAIN[::-1], "app.bsky.actor.profile").simpleString() == "struct<name:bigint>"
    assert typed.chained(CHAIN, "none") is None


def test_typed_rows_of_wrong_and_missing_records(spark):
    post = cbor.encode({"text": "a", "level": 3})
    rows = [(1, "app.bsky.feed.post", post), (2, "app.bsky.feed.post", None), (3, "none", post), (4, "app.bsky.feed.like", b""), (5, "app.bsky.feed.post", b""), (6, None, post), (7, "app.bsky.feed.post", cbor.encode({"langs": "x"}))]
    found = typed.typed(spark.createDataFrame(rows, "id int, collection string, data binary"), CHAIN, {"post": "app.bsky.feed.post"}, ["id"]).orderBy("id").collect()
    assert [r.error for r in found] == [None, None, "unknown collection", None, "unexpected end", "unknown collection", "not an array"]
    assert found[0].post.level == 3 and found[0].post.langs is None and found[1].post is None
    with pytest.raises(ValueError):
        typed.typed(spark.createDataFrame(rows, "id int, collection string, data binary"), CHAIN, {"x": "none"}, ["id"])


def test_schema_folders(spark, tmp_path):
    docs = {"a": {"lexicon": 1, "id": "x.a", "defs": {"main": {"type": "ref", "ref": "x.b"}, "other": {"type": "ref", "ref": "#main"}}}, "b": {"lexicon": 1, "id": "x.b", "defs": {"main": {"type": "ref", "ref": "x.a#other"}}}, "c": {"lexicon": 1, "id": "x.b", "defs": {"main": {"type": "union", "refs": ["#none"]}}}, "d": {"lexicon": 2}}
    for name, d in docs.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(d, indent=1))
    (tmp_path / "e.json").write_text("{")
    found = lexicon.read_definitions(spark, str(tmp_path)).cache()
    assert found.where("error IS NOT NULL").count() == 2
    assert [tuple(r) for r in lexicon.duplicates(found).collect()] == [("x.b", 2)]
    assert [tuple(r) for r in lexicon.loose(found).collect()] == [("x.b#main", "x.b#none")]
    circles = {r.name for r in lexicon.closure(lexicon.references(found)).where("name = ref").collect()}
    assert circles == {"x.a#main", "x.a#other", "x.b#main"}
    assert lexicon.closure(lexicon.references(found).limit(0)).count() == 0
    (tmp_path / "e.json").unlink()
    (tmp_path / "d.json").unlink()
    with pytest.raises(ValueError, match="x.b is given twice"):
        lexicon.read_catalogue(spark, str(tmp_path))
    (tmp_path / "c.json").unlink()
    assert set(lexicon.read_catalogue(spark, str(tmp_path))) == {"x.a#main", "x.a#other", "x.b#main"}
