"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nocturne.llm.common import discard, materialize


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node that has a link in (a, b): root is the least node of its component.

    Each round writes its links to the shared folder; the number of rounds grows with the
    logarithm of the longest path.  A hub's links are reduced before they are shuffled, and
    the least neighbours are written, so that they join between two shuffles, of which a hub's can be split.
    """
    links = materialize(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"
    )
    mark = None
    while True:
        now = tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == mark or not now[0]:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = now
        both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large, "links")
        down = materialize(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(down, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = materialize(small.unionByName(down.select("a", F.col("m").alias("b"))).distinct(), "links")
        for done in (links, least, large, down):
            discard(done)
        links = after
