"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_counted

#: Links of a partition, so that small link tables don't become many small files.
PARTITION_ROWS = 50_000


def _least(links: DataFrame, hubs: bool) -> DataFrame:
    """(u, v, m): ``m`` is the smallest of u and its neighbours. It is aggregated
    before the shuffle; with ``hubs`` the links of a node that has very many stay
    where they are and the hubs' rows are broadcast."""
    least = links.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    joined = join_counted(links, cut(least), "u") if hubs else links.join(least, "u")
    return joined.select("u", "v", F.least("u", "m").alias("m"))


def _large_star(links: DataFrame, hubs: bool) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _least(both, hubs).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(links: DataFrame, hubs: bool) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    near = _least(down, hubs)
    return (near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(near.select("u", F.col("m").alias("v"))))


def _unfinished(links: DataFrame) -> bool:
    """Whether a node has two links down, or one down and one up: then the links
    aren't stars around the smallest ids yet."""
    ends = (links.select(F.col("u").alias("x"), F.lit(1).alias("down"), F.lit(0).alias("up"))
            .unionByName(links.select(F.col("v").alias("x"), F.lit(0).alias("down"), F.lit(1).alias("up"))))
    marks = ends.groupBy("x").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return marks.where("down > 1 or (down = 1 and up = 1)").limit(1).count() > 0


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every node that has a link; ``links`` is (u, v).
    ``component`` is the smallest id that can be reached. Each pass is written to
    the shared folder; the number of passes grows with the logarithm of a chain."""
    now = cut(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while _unfinished(now):
        few = 1 + now.count() // PARTITION_ROWS
        hubs = few > 1  # links that fit into one partition need no care
        now = now.coalesce(few)
        large = _large_star(now, hubs).coalesce(few)
        now = cut(_small_star(cut(large) if hubs else large, hubs).distinct().coalesce(few))
    return (now.select(F.col("u").alias("id"), F.col("v").alias("component"))
            .unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component"))).distinct())
