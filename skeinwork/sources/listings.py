"""Pages of a directory of repositories, as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinwork.functions.identifiers import did_valid

PAGE = "cursor string, repos array<struct<did:string,rev:string,head:string,active:boolean>>"


def entries(pages: DataFrame, key: str, body: str = "body") -> DataFrame:
    """(key, did, active, error): a row for each entry; a wrong did is null and an error."""
    each = pages.select(key, F.explode(F.from_json(body, PAGE)["repos"]).alias("r"))
    good = did_valid(F.col("r.did"))
    return each.select(key, F.when(good, F.col("r.did")).alias("did"), F.coalesce("r.active", F.lit(True)).alias("active"), F.when(~good, "bad did").alias("error"))
