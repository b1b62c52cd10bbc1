"""Connected components of a table of links, on Spark."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored


def components(links: DataFrame, most_rounds: int | None = None, under: str | None = None) -> DataFrame:
    """(v, comp): comp is the smallest vertex that v reaches; links has columns a, b.

    Alternating large-star and small-star steps: each is one aggregation and one join over the links, their number
    grows with the logarithm of the vertices, and no vertex's links are gathered in one place. The rounds go on until one
    changes nothing; the links left then are (vertex, component) pairs. Where most_rounds is given and not enough, an
    error is raised. under: the folder of the rounds' tables.
    """
    pairs = stored(links.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("c")).distinct(), "links", under)
    last = None
    for done in count():
        if done == most_rounds:
            raise RuntimeError(f"the components have not settled in {most_rounds} rounds")
        both = pairs.unionByName(pairs.select(F.col("c").alias("v"), F.col("v").alias("c")))
        least = both.groupBy("v").agg(F.min("c").alias("m")).withColumn("m", F.least("m", "v"))
        large = both.where("c > v").join(least, "v").select(F.col("c").alias("v"), F.col("m").alias("c"))
        large = large.where("v <> c").distinct()
        low = large.groupBy("v").agg(F.min("c").alias("m"))
        small = large.join(low, "v").select(F.col("c").alias("v"), F.col("m").alias("c")).where("v <> c").unionByName(low.select("v", F.col("m").alias("c")))
        pairs = stored(small.distinct(), "links", under)
        now = pairs.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("v", "c") % 1000000007), F.lit(0)).alias("h")).first()
        if last == now:
            break
        last = now
    own = pairs.select(F.col("c").alias("v")).distinct()
    return pairs.select("v", F.col("c").alias("comp")).unionByName(own.select("v", F.col("v").alias("comp"))).groupBy("v").agg(F.min("comp").alias("comp"))
