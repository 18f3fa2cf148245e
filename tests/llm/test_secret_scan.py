"""The automaton against Python's regexes."""

import random
import re

from skeinwork.llm import secret_scan as sc

BASE = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 24),
}


def brute(text: str) -> list[tuple[str, int, int]]:
    out = [(m.start(), k, name, m.end()) for k, (name, (rx, group, least)) in enumerate(BASE.items()) for m in rx.finditer(text) if len(m[group]) >= least]
    return [(name, a, b) for a, _, name, b in sorted(out)]


def texts() -> list[str]:
    draw = random.Random(9)
    parts = ["password", "PassWd", "secret", "Token", "api_key", "APIKEY", "api key", ": ", "=", " = ", '"', "'", ":", "  ", "AKIA", "AKIA" + "A1" * 9, "0123456789abcdef" * 2, "deadbeef", "é", "ſ", "\n", "x.y/z+w==", "abc", "ghp_" + "a" * 36, "🙂", "eyJa.eyJb.c" + "d" * 40, "-----BEGIN RSA PRIVATE KEY-----"]
    return ["".join(draw.choice(parts) for _ in range(draw.randint(1, 25))) for _ in range(400)]


def test_equals_regexes(spark):
    rows = list(enumerate([*texts(), "", None, "token=abcdef token: 'abcdef' tokens=abcdef", "a" * 300_000 + " secret=hunter22"]))
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS found", "'x' AS key").repartition(4)
    got = {r["doc_id"]: r for r in sc.find(docs).collect()}
    digests = {r["doc_id"]: r for r in sc.digest(sc.find(docs)).collect()}
    names = list(BASE)
    for i, text in rows:
        want = brute(text or "")
        assert [(s["kind"], s["start"], s["end"]) for s in got[i]["found"] if s["kind"] in names] == want, text
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert digests[i]["base_sha256"] == sc.sha256_of(joined)
        assert [digests[i][f"n_{k}"] for k in names] == [sum(w[0] == k for w in want) for k in names]
        assert digests[i]["spans"] == ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in got[i]["found"])


def test_more_kinds_and_redaction(spark):
    text = "é ghp_" + "a" * 36 + " and token = 'abcdefg' end"
    docs = spark.createDataFrame([(1, text, "n", 5), (1, None, "n", None), (2, "plain", None, 1)], "doc_id long, text string, kind string, n_chars long")
    clean = sc.redact(docs)
    assert clean.columns == docs.columns
    got = sorted(clean.collect(), key=repr)
    assert {(r["text"], r["n_chars"]) for r in got} == {("é <github> and <assign>' end", 28), (None, None), ("plain", 5)}
    assert sc.find(docs.limit(0)).count() == 0


def test_minimal_automaton_is_deterministic():
    how = sc.scanner()
    assert len(how.forward.table) % 256 == 0 and max(how.forward.table) < len(how.forward.table)
    assert len(how.forward.table) // 256 < 1024
