"""Quality rules with adaptive thresholds per language and source. JVM only.

Base rules count words, symbols, repeated lines and words in repeated 3-word windows. The adaptive rules
turn five of these counts into rates and compare each with a fence drawn from quantile sketches of its
language and source: the ninth decile plus ``REACH`` times its distance from the median, which counts as one
bucket's width at least, so a fence moves with its own group and nothing else. A rate counts what goes beyond a
few events (``ALLOWED``), as one repeated line in a text of three says nothing. The sketches are histograms over
integer buckets whose width grows with the value (32 to an octave, so at most 3 per cent wide); sketches of parts add
up to the sketch of the whole, in any order. A group of fewer than ``MIN_GROUP`` documents borrows its language's
sketch, the sum of the sources' sketches.

Null texts count as empty and fail the base rules; null languages and sources form groups of their own; rows that
repeat are judged alike; a long text is one row whose arrays of words lie in memory once; ids may be of any type and
null; other columns may have any name; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skeinwork.llm.common import SPACES, staged, words_of

#: Each rate, out of 1000, with the events that it leaves out of account.
ALLOWED = {"symbols": 2, "upper": 2, "exclaims": 2, "repeats": 20, "dup_lines": 2}
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MIN_GROUP = 40
REACH = 8


def _drop(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def text_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """A row for each document with its counts: doc_id, lang, source, n_words, word_chars, n_symbols, ..."""
    content = F.coalesce(F.col(text), F.lit(""))
    split = docs.select("doc_id", "lang", "source", content.alias("_text"), words_of(content).alias("_words"))
    most = F.greatest(F.size("_words") - 2, F.lit(0))
    zipped = F.arrays_zip(*(F.slice("_words", k, most).alias(f"w{k}") for k in (1, 2, 3)))
    hashes = F.transform(zipped, lambda w: F.xxhash64(w))
    lines = F.filter(F.split("_text", "\n"), lambda line: F.length(_drop(line, SPACES)) > 0)
    hashed = split.select("*", hashes.alias("_hashes"), lines.alias("_lines"))
    # most texts repeat no window; only those that do are sorted
    some = F.when(F.size("_hashes") > F.size(F.array_distinct("_hashes")), F.col("_hashes")).otherwise(F.array().cast("array<bigint>"))
    ordered = hashed.select("*", F.sort_array(F.transform(some, lambda h, i: F.struct(h.alias("h"), i.alias("i")))).alias("_windows"))
    again = F.transform("_windows", lambda w, i: F.when((F.get("_windows", i - 1)["h"] == w["h"]) | (F.get("_windows", i + 1)["h"] == w["h"]), w["i"]))
    found = ordered.select("*", F.sort_array(F.filter(again, lambda i: i.isNotNull())).alias("_again"))
    reach = F.transform("_again", lambda at, i: F.least(F.lit(3), F.coalesce(F.get("_again", i + 1) - at, F.lit(3))))
    count = lambda chars: (F.length("_text") - F.length(_drop(F.col("_text"), chars))).cast("long")
    return found.select(
        "doc_id",
        "lang",
        "source",
        F.size("_words").cast("long").alias("n_words"),
        F.length(_drop(F.col("_text"), SPACES)).cast("long").alias("word_chars"),
        count(SYMBOLS).alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.aggregate(reach, F.lit(0), lambda a, x: a + x).cast("long").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        count("ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("n_upper"),
        count("!").alias("n_exclaims"),
    )


def rates(counts: DataFrame) -> DataFrame:
    """``counts`` with ``base_failed`` and the rates out of 1000 added, as long."""
    of = {"symbols": ("n_symbols", "n_words"), "upper": ("n_upper", "word_chars"), "exclaims": ("n_exclaims", "n_words"), "repeats": ("n_repeat_words", "n_words"), "dup_lines": ("n_dup_lines", "n_lines")}
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return counts.select("*", failed.alias("base_failed"), *(F.expr(f"1000 * greatest({a} - {ALLOWED[name]}, 0) div greatest({b}, 1)").alias(name) for name, (a, b) in of.items()))


def bucket(value: Column) -> Column:
    """The bucket of a count: itself below 64, else its six leading bits and their place."""
    place = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    return (place * 64 + F.call_function("shiftright", value, place)).cast("long")


def bucket_floor(at: Column) -> Column:
    """The least value of a bucket; buckets of place p > 0 hold leading bits 32 to 63, so ids of places don't overlap."""
    place = F.greatest(F.expr("0"), F.floor((at - 32) / 64)).cast("int")
    return F.call_function("shiftleft", (at - place * 64).cast("long"), place)


def sketches(rated: DataFrame) -> DataFrame:
    """Mergeable sketches: (lang, source, rate, bucket, n)."""
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("rate"), bucket(F.col(name)).alias("bucket")) for name in ALLOWED)))
    return rated.select("lang", "source", each.alias("m")).groupBy("lang", "source", "m.rate", "m.bucket").agg(F.count("*").alias("n"))


def bucket_width(floor: Column) -> Column:
    """The width of the bucket that begins at ``floor``."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(F.length(F.bin(floor)) - 6, F.lit(0)))


def quantile(tenths: int) -> Column:
    """Over a sketch's buckets: the least bucket's floor with at least so many tenths of the rows at or below it."""
    return F.min(F.when(10 * F.col("_upto") >= tenths * F.col("_all"), bucket_floor(F.col("bucket"))))


def _fences(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., n, a fence for each rate) of sketches summed by ``keys``."""
    summed = sketch.groupBy(*keys, "rate", "bucket").agg(F.sum("n").alias("n"))
    each = W.partitionBy(*keys, "rate")
    upto = summed.select("*", F.sum("n").over(each.orderBy("bucket")).alias("_upto"), F.sum("n").over(each).alias("_all"))
    per = upto.groupBy(*keys, "rate").agg(F.max("_all").alias("n"), quantile(5).alias("mid"), quantile(9).alias("high"))
    fenced = per.withColumn("fence", F.col("high") + REACH * F.greatest(F.col("high") - F.col("mid"), bucket_width(F.col("high"))))
    return fenced.groupBy(*keys).agg(F.max("n").alias("n"), *(F.max(F.when(F.col("rate") == r, F.col("fence"))).alias(f"{r}_fence") for r in ALLOWED))


def fences(sketch: DataFrame) -> DataFrame:
    """(lang, source, a fence for each rate), small groups borrowing their language's."""
    own, whole = _fences(sketch, ["lang", "source"]), _fences(sketch, ["lang"])
    whole = whole.select(F.col("lang").alias("_lang"), *(F.col(f"{r}_fence").alias(f"{r}_whole") for r in ALLOWED))
    both = own.join(whole, F.col("lang").eqNullSafe(F.col("_lang")))
    return both.select("lang", "source", *(F.when(F.col("n") < MIN_GROUP, F.col(f"{r}_whole")).otherwise(F.col(f"{r}_fence")).alias(f"{r}_fence") for r in ALLOWED))


def judge(docs: DataFrame, text: str = "text") -> DataFrame:
    """A row for each document with its counts, base_failed, the rates, their fences and kept."""
    rated = staged(rates(text_counts(docs, text)), "quality-counts")
    drawn = fences(sketches(rated)).withColumnsRenamed({"lang": "_lang", "source": "_source"})
    joined = rated.join(drawn, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left").drop("_lang", "_source")
    beyond = F.lit(False)
    for r in ALLOWED:
        beyond = beyond | (F.col(r) > F.col(f"{r}_fence"))
    return joined.withColumn("kept", ~(F.col("base_failed") | beyond))


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, lang, source, coalesce(text, '') AS t FROM documents)
, w AS (SELECT k, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d)
, win AS (SELECT k, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM w, unnest(range(1, len(w) - 1)) AS u(i))
, rep AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS c FROM win) WHERE c > 1)
, cov AS (SELECT k, count(DISTINCT i + j) AS n FROM rep, (VALUES (0), (1), (2)) AS o(j) GROUP BY k)
, ln AS (SELECT k, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d)
, c AS (SELECT d.doc_id, d.lang, d.source, CAST(len(w.w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(l) AS BIGINT) AS n_lines,
    CAST(length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS BIGINT) AS n_upper, CAST(length(t) - length(replace(t, '!', '')) AS BIGINT) AS n_exclaims
    FROM d JOIN w USING (k) JOIN ln USING (k) LEFT JOIN cov USING (k))
, r AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    [1000 * greatest(n_symbols - 2, 0) // greatest(n_words, 1), 1000 * greatest(n_upper - 2, 0) // greatest(word_chars, 1), 1000 * greatest(n_exclaims - 2, 0) // greatest(n_words, 1),
     1000 * greatest(n_repeat_words - 20, 0) // greatest(n_words, 1), 1000 * greatest(n_dup_lines - 2, 0) // greatest(n_lines, 1)] AS v FROM c)
, e AS (SELECT lang, source, i, v[i] AS x, greatest(length(bin(v[i])) - 6, 0) AS p FROM r, unnest(range(1, 6)) AS u(i))
, b AS (SELECT lang, source, i, (x >> p) << p AS x FROM e)
, u AS (SELECT *, sum(n) OVER (PARTITION BY lang, source, i ORDER BY x) AS upto, sum(n) OVER (PARTITION BY lang, source, i) AS al FROM (SELECT lang, source, i, x, count(*) AS n FROM b GROUP BY ALL))
, uw AS (SELECT *, sum(n) OVER (PARTITION BY lang, i ORDER BY x) AS upto, sum(n) OVER (PARTITION BY lang, i) AS al FROM (SELECT lang, i, x, count(*) AS n FROM b GROUP BY ALL))
, q AS (SELECT lang, source, i, max(al) AS n, min(x) FILTER (10 * upto >= 5 * al) AS mid, min(x) FILTER (10 * upto >= 9 * al) AS high FROM u GROUP BY ALL)
, qw AS (SELECT lang, i, min(x) FILTER (10 * upto >= 5 * al) AS mid, min(x) FILTER (10 * upto >= 9 * al) AS high FROM uw GROUP BY ALL)
, f AS (SELECT q.lang, q.source, q.i, CASE WHEN q.n < 40 THEN qw.high + 8 * greatest(qw.high - qw.mid, 1 << greatest(length(bin(qw.high)) - 6, 0))
        ELSE q.high + 8 * greatest(q.high - q.mid, 1 << greatest(length(bin(q.high)) - 6, 0)) END AS fence
    FROM q JOIN qw ON q.lang IS NOT DISTINCT FROM qw.lang AND q.i = qw.i)
, fs AS (SELECT lang, source, list(fence ORDER BY i) AS f FROM f GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT (base_failed OR v[1] > f[1] OR v[2] > f[2] OR v[3] > f[3] OR v[4] > f[4] OR v[5] > f[5]) AS kept
FROM r JOIN fs ON r.lang IS NOT DISTINCT FROM fs.lang AND r.source IS NOT DISTINCT FROM fs.source
"""
