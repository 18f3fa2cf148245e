"""Rules and parts of urls against plain Python, trees on labelled urls held out."""

import random
import re

from pyspark.sql import functions as F

from skeinwork.llm import url_filter as uf


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    return "".join(c.lower() if c.isascii() else c for c in host), path


def rule(url):
    host, path = parts(url)
    best = (None, None)
    for text, says in uf.RULES:
        name, _, rest = text.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest) and len(text) > len(best[0] or ""):
            best = text, says
    return best


URLS = [None, "", "no scheme", "http://", "http://Example.COM/en/7#x", "https://a.example.com/en/71?q=1", "http://b.com/en/9", "http://com/en/", "http://xcom/en/", "https://example.net/de/81", "https://q.net/de/3",
        "http://É.Org/es/?", "a://b://c.org/es/1", "http://x.org?y=/es/", "http://x.net\n/de/1", "http://x.org/es", "http://casino-bets.test/1?a=1&b=2"]


def test_rules_equal_plain_python(spark):
    draw = random.Random(1)
    urls = URLS + ["".join(draw.choice(["http", "://", "example", ".", "com", "net", "org", "/en/", "/de/", "/es/", "7", "8", "?", "#", "A"]) for _ in range(draw.randint(1, 9))) for _ in range(300)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "'x' AS host", "1.0 AS length", "'y' AS suffix1").repartition(3)
    got = {r["page_id"]: r for r in uf.judge(pages, uf.fit(uf.seed_labelled(pages))).collect()}
    for i, url in enumerate(urls):
        text, says = rule(url)
        assert (got[i]["host"], got[i]["path"]) == parts(url)
        assert got[i]["rule"] == text
        assert got[i]["verdict"] == (says or ("block" if got[i]["url_block"] else "allow"))
    assert not any(got[i]["url_block"] for i in (0, 1))


def test_trees_learn_from_labelled_urls(spark):
    draw = random.Random(6)
    word = lambda n: "".join(draw.choice("abcdeiou") for _ in range(n))

    def url(bad):
        host = f"{word(4)}-{draw.randrange(1000)}.{draw.choice(['top', 'click', 'com'])}" if bad else f"www.{word(6)}.{draw.choice(['org', 'com'])}"
        query = "?" + "&".join(f"{word(2)}={draw.randrange(10**6)}" for _ in range(draw.randint(2, 6))) if bad and draw.random() < 0.8 else ""
        return f"http://{host}/{word(5)}/{draw.randrange(10**6) if bad else word(7)}{query}"

    rows = [(url(i % 2), float(i % 2)) for i in range(1200)]
    model = uf.fit(spark.createDataFrame(rows[:800], "url string, label double"))
    held = model.score(spark.createDataFrame(rows[800:], "url string, label double"))
    right = held.agg(F.avg((F.col("url_block") == (F.col("label") == 1)).cast("int"))).first()[0]
    assert right > 0.95
    again = uf.fit(spark.createDataFrame(rows[:800], "url string, label double").repartition(7)).score(spark.createDataFrame(rows[800:], "url string, label double"))
    assert sorted(map(repr, held.select("url", "url_block").collect())) == sorted(map(repr, again.select("url", "url_block").collect()))


def test_one_label_or_no_rows(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    model = uf.fit(uf.seed_labelled(none))
    assert model.trees is None and uf.judge(none, model).count() == 0


def test_suffix_rates_are_of_all_labelled_urls(spark):
    rows = [(f"http://h{i % 50}.site{i % 5}.org/{i}", float(i % 5 == 0)) for i in range(1000)]
    model = uf.fit(spark.createDataFrame(rows, "url string, label double"), rows_per_label=20)
    rates = {r["suffix2"]: r["suffix2_rate"] for r in model.suffixes["suffix2"].collect()}
    assert model.base_rate == 0.2 and rates == {f"site{k}.org": ((200.0 if k == 0 else 0.0) + 1.0) / 205 for k in range(5)}


def test_long_and_repeated_urls(spark):
    long = "http://casino.example.test/" + "a/1?" * 100_000
    pages = spark.createDataFrame([(1, long), (1, long), (2, "http://plain.example.test/"), (3, "http://plain.example.test/")], "page_id long, url string")
    got = sorted((r["page_id"], r["host"], len(r["path"]), r["verdict"]) for r in uf.judge(pages, uf.fit(uf.seed_labelled(pages))).collect())
    assert got[0] == got[1] and got[0][1:3] == ("casino.example.test", 4) and [r[0] for r in got] == [1, 1, 2, 3]
