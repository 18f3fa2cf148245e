"""Secret scans with one combined automaton.

Every rule has a core regex, a class of bytes that carries the match on greedily, and least lengths. The cores of
all rules are compiled into one minimal automaton that runs over a text once; where a core ends, the rule's
reversed automaton finds where the match began (leftmost, not before the end of the rule's last match) and the
class finds where it ends. A match that is too short is dropped but still consumed, as a regex engine would.

Null and empty texts have no spans; rows that repeat are scanned alike; other columns may be null; an empty table
gives an empty result. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.llm.arrays import pieces
from skeinwork.llm.automaton import ALL, Automaton, backwards, compile_rules, parse


@dataclass(frozen=True)
class Rule:
    """``core`` must match; ``tail`` is a class that follows it; ``least`` counts bytes of the match, or of the last
    byte of the core and the tail where ``value_only``."""

    kind: str
    core: str
    tail: str = ""
    least: int = 0
    value_only: bool = False
    fold: bool = False


#: The base rules, then the method's own.
BASE = [
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=\-]""", r"[A-Za-z0-9+/_.=\-]", 6, True, True),
    Rule("access", r"AKIA[A-Z0-9]", r"[A-Z0-9]", 20),
    Rule("hex", r"[0-9a-f]{24}", r"[0-9a-f]", 24),
]
MORE = [
    Rule("github", r"gh[pousr]_[A-Za-z0-9]", r"[A-Za-z0-9]", 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9]", r"[A-Za-z0-9\-]", 20),
    Rule("stripe", r"[sr]k_live_[A-Za-z0-9]", r"[A-Za-z0-9]", 24),
    Rule("google", r"AIza[A-Za-z0-9_\-]", r"[A-Za-z0-9_\-]", 39),
    Rule("jwt", r"eyJ[A-Za-z0-9_\-]+\.eyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]", r"[A-Za-z0-9_\-]", 40),
    Rule("pem", r"-----BEGIN ([A-Z]+ )*PRIVATE KEY-----"),
]
RULES = BASE + MORE


@dataclass
class Scanner:
    """The combined automaton, each rule's reversed one, and the bytes that end each rule's tail."""

    rules: tuple[Rule, ...]
    forward: Automaton
    reverse: list[Automaton]
    tails: list[frozenset[int]]


@cache
def scanner(rules: tuple[Rule, ...] = tuple(RULES)) -> Scanner:
    """Compiled once in each worker."""
    # within a value, each rule's bytes must keep their own case
    cores = [parse(r.core, r.fold) for r in rules]
    # the class of an assigned value has both cases already, so folding the whole core changes only the keyword
    tails = [parse(r.tail)[1][1] if r.tail else frozenset() for r in rules]
    return Scanner(rules, compile_rules(cores, True), [compile_rules([backwards(c)], False) for c in cores], [t & ALL for t in tails])


def scan(data: bytes, how: Scanner) -> list[tuple[int, int, int]]:
    """Spans (start, rule, end) in bytes, ordered by start and rule."""
    table, accept, state = how.forward.table, how.forward.accept, how.forward.start
    hits = []
    for at, byte in enumerate(data, 1):
        state = table[state + byte]
        if state >= accept:
            hits.append((at, state))
    if not hits:
        return []
    used = [0] * len(how.rules)
    found = []
    for at, state in hits:
        for k in how.forward.marks[state // 256]:
            if at <= used[k]:
                continue
            start = _start(data, at, used[k], how.reverse[k])
            if start is None:
                continue
            end, tail, rule = at, how.tails[k], how.rules[k]
            while end < len(data) and data[end] in tail:
                end += 1
            used[k] = end
            if (end - at + 1 if rule.value_only else end - start) >= rule.least:
                found.append((start, k, end))
    return sorted(found)


def _start(data: bytes, end: int, floor: int, reverse: Automaton) -> int | None:
    """The leftmost start, not before ``floor``, of a match of the core that ends at ``end``."""
    state, start, at = reverse.start, None, end
    while at > floor:
        at -= 1
        state = reverse.table[state + data[at]]
        if state >= reverse.accept:
            start = at
        elif state == reverse.dead:
            break
    return start


def code_points(data: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The spans with code-point offsets."""
    marks = sorted({p for s, _, e in spans for p in (s, e)})
    place, last, count = {}, 0, 0
    for p in marks:
        count += len(data[last:p].decode("utf-8", "replace"))
        place[p], last = count, p
    return [(place[s], k, place[e]) for s, k, e in spans]


def find(docs: DataFrame, text: str = "text", key: str = "doc_id", rules: list[Rule] = RULES) -> DataFrame:
    """A row for each document: ``key`` and ``found``, an array of (kind, start, end) by start and rule."""
    kind = docs.schema[key].dataType.simpleString()
    chosen = tuple(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        how = scanner(chosen)
        shape = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in pieces(batches, "_text"):
            out = []
            for data in batch.column(1).cast(pa.binary()).to_pylist():
                spans = code_points(data, scan(data, how)) if data else []
                out.append([{"kind": how.rules[k].kind, "start": s, "end": e} for s, k, e in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, shape)], ["key", "found"])

    picked = docs.select(F.col(key).alias("key"), F.col(text).alias("_text"))
    return picked.mapInArrow(run, f"key {kind}, found array<struct<kind:string,start:bigint,end:bigint>>").withColumnRenamed("key", key)


def listed(found: str = "found") -> F.Column:
    """The spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(scanned: DataFrame) -> DataFrame:
    """``doc_id``, the base kinds' counts, the digest of their list, all spans listed, and their number."""
    names = [r.kind for r in BASE]
    base = F.filter("found", lambda s: s["kind"].isin(names))
    counted = scanned.withColumn("_base", base)
    of = lambda kind: F.size(F.filter("_base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return counted.select("doc_id", *map(of, names), F.sha2(listed("_base").cast("binary"), 256).alias("base_sha256"), listed().alias("spans"), F.size("found").cast("long").alias("n_spans"))


def redact(docs: DataFrame, text: str = "text", rules: list[Rule] = RULES) -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets; overlapping spans count as one.

    Only ``text`` changes, and ``n_chars`` where the table has it.
    """
    chosen, names = tuple(rules), docs.columns
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        how = scanner(chosen)
        for batch in pieces(batches, text):
            clean = [None if d is None else _redacted(d, how) for d in batch.column(at).cast(pa.binary()).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array(clean, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, names)

    clean = docs.mapInArrow(run, docs.schema)
    if "n_chars" in names:
        clean = clean.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length(text).cast(docs.schema["n_chars"].dataType)))
    return clean.select(*names)


def _redacted(data: bytes, how: Scanner) -> str:
    out, last = [], 0
    for start, k, end in scan(data, how):
        if start >= last:
            out += [data[last:start], f"<{how.rules[k].kind}>".encode()]
        last = max(last, end)
    return b"".join([*out, data[last:]]).decode("utf-8", "replace")


def sha256_of(spans: str) -> str:
    """What ``digest`` gives for a list of spans; for tests."""
    return hashlib.sha256(spans.encode()).hexdigest()
