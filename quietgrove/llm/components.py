"""Connected components of a table of links, by alternating star operations.

Every round hangs neighbours under the smallest id they can see: first all larger neighbours of
a node, then the node with its smaller ones. The table never gets longer than the links, and no
node's neighbours are gathered anywhere. Rounds are stored tables, so lost executors cost little.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietgrove.scratch import Scratch


def _hang(links: DataFrame, larger: bool) -> DataFrame:
    """Links from neighbours to the smallest id around ``u``; all links of ``u`` are rows."""
    least = links.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    joined = links.join(least, "u")
    if larger:
        return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.select("u", F.col("m").alias("v"))
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(own)


def connected_components(links: DataFrame) -> DataFrame:
    """``(id, component)`` for every id in ``links(u long, v long)``; component is the smallest id."""
    scratch = Scratch(links.sparkSession)
    now = scratch.save(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                       .where("u > v").distinct())
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _hang(both, larger=True).where("u <> v").distinct()
        small = _hang(large, larger=False).where("u <> v").distinct()
        after = scratch.save(small)
        state = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        scratch.release(now)
        now = after
        if state == seen:
            break
        seen = state
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
