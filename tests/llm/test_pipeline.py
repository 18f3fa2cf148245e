"""The stages one after the other, each against what its operator says of its own input."""

from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline as cp
from skeinwork.llm import decontaminate, minhash, ngram_quality, secret_scan
from skeinwork.llm.common import staged, table

SF = "/root/testdata/sf0.001"


def test_stages_follow_their_operators(spark):
    docs, labels, items = (table(spark, SF, name) for name in ("documents", "labels", "benchmark"))
    columns = docs.columns
    # the longest good document that holds no test item, with a secret at its end and the least id of all
    good = docs.join(labels.where("quality = 1"), "doc_id", "left_semi").join(decontaminate.leaks(docs, items), "doc_id", "left_anti")
    long = good.orderBy(F.desc("n_chars"), "doc_id").limit(1).select(F.lit(-1).cast("long").alias("doc_id"), F.concat("text", F.lit(" password = hunter2345678")).alias("text"), *columns[2:])
    docs = staged(docs.unionByName(long), "test")
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    step = {}
    for name, stage in cp.STAGES:
        before, docs = docs, staged(stage(spark, docs, SF), "test")
        step[name] = before, docs
        assert docs.columns[: len(columns)] == columns
    before, after = step["quality classifier"]
    assert ids(after) == ids(ngram_quality.judge(before, labels).where("kept")) and 0 < after.count() < before.count()
    before, after = step["MinHash near-dedup"]
    assert ids(after) == ids(minhash.classify(before).where("is_kept")) and after.count() < before.count()
    before, after = step["benchmark decontamination"]
    held = set(ids(decontaminate.leaks(before, items)))
    assert held and ids(after) == [i for i in ids(before) if i not in held]
    before, after = step["secret scans"]
    assert ids(after) == ids(before) and -1 in ids(secret_scan.find(before).where("size(found) > 0"))
    assert secret_scan.find(after).where("size(found) > 0").isEmpty()
    before, after = step["mixing sources to target weights"]
    assert after.columns == [*columns, "copy"] and set(ids(after)) <= set(ids(before))


def test_run_gives_the_last_stage(spark):
    found = cp.run(spark, SF)
    assert found.columns == [*table(spark, SF, "documents").columns, "copy"] and found.count() > 0


def test_it_is_registered():
    assert __spark_entry__.queries()["pipeline"] is cp.run
