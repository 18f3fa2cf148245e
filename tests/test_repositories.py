"""Archives that are walked where their bytes lie, against the walk over rows of blocks."""

from pyspark.sql import functions as F

from skeinwork.plans import commits
from skeinwork.sources import archives, repositories

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_walks_agree(spark):
    made = commits._commits(spark, SF)
    files = made.select("seq", F.when(F.col("seq") % 50 == 0, None).otherwise(F.col("blocks")).alias("blocks"))
    opened, blocks = repositories.opened(files, "blocks", "seq")
    found = repositories.walked(opened, blocks)
    loaded, below = repositories.read(files, "blocks", "seq")
    same = ["path", "did", "rev", "version", "root", "content", "signature", F.col("error").isNull()]
    assert rows_of(loaded.select(same)) == rows_of(opened.select(same)) == rows_of(repositories.loaded(files, "blocks", "seq").select(same))
    at = ["path", "kind", "depth", "key", "cid"]
    assert rows_of(below.select(at)) == rows_of(found.select(at))
    nodes = [*at, "error"]
    assert rows_of(below.where("kind = 'node'").select(nodes)) == rows_of(found.where("kind = 'node'").select(nodes))
    records = ["path", "key", "cid", "data", "error"]
    assert rows_of(below.where("kind = 'record'").select(records)) == rows_of(repositories.records(found, blocks))
    assert rows_of(repositories.missing(below)) == rows_of(repositories.completeness(found, blocks))


def test_archives_are_written_anew_in_order(spark):
    made = commits._commits(spark, SF)
    _, below = repositories.read(made, "blocks", "seq")
    again = repositories.exported(made, "blocks", "seq")
    lacking = repositories.missing(below).drop("n_records")
    assert rows_of(again.drop("archive")) == rows_of(lacking)
    whole = {r["path"]: bytes(r["archive"]) for r in again.where("archive IS NOT NULL").collect()}
    assert whole and set(whole) == {r["path"] for r in lacking.where("missing_nodes + missing_records = 0").collect()}
    heads = {r["seq"]: r["commit"] for r in made.collect()}
    walked = {path: [] for path in whole}
    for r in below.collect():
        if r["path"] in whole:
            walked[r["path"]].append(((1, "%06d" % r["depth"]) if r["kind"] == "node" else (2, r["key"]), r["cid"]))
    for path, data in whole.items():
        roots, at = archives.read_header(data)
        order = [heads[path], *(c for _, c in sorted(walked[path]))]
        assert roots == order[:1] and [c for c, _ in archives.read_blocks(data, at)] == list(dict.fromkeys(order))


def test_blocks_do_not_cross_the_network(spark):
    """Neither query sends or stores an archive's blocks to walk its tree."""
    assert "Exchange" not in commits.a09_export_complete(spark, SF)._jdf.queryExecution().executedPlan().toString()
    read = commits.a20_verified_records(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "data#" not in "".join(line for line in read.splitlines() if "Join" in line)
    assert "kind#" in read


def test_signatures_of_a_key_lie_together(spark):
    """A worker makes a key's comb once, however many keys there are."""
    plan = commits.a20_verified_records(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Sort [repo#" in plan and "RepartitionByExpression [repo#" in plan
