"""Connected components of links, by hooking every node to the smallest neighbour seen.

Each round writes its links to the shared folder. Nodes and links stay distributed; the
driver only sees whether anything changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placebook.llm.common import stored

# Links up to which a round is one task's work: a distributed round is seven shuffles, and
# each costs as many tasks as there are shuffle partitions, however few the links.
FEW = 50_000


def components(links: DataFrame) -> DataFrame:
    """``id, component`` for every node of ``links (a, b)``: the smallest id it reaches.

    Alternates two steps until stable: every node links its larger neighbours to the
    smallest one around (large star), then its smaller neighbours and itself to the
    smallest (small star). Both keep what is connected; a long chain shortens by about
    half a round.
    """
    links = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    together = (lambda df: df.coalesce(1)) if links.limit(FEW + 1).count() <= FEW else (lambda df: df)
    before = None
    while True:
        both = together(links.union(links.select("b", "a")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = together(stored(large, "large-star"))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a")
        small = together(joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))))
        small = stored(small.where("a <> b").distinct(), "small-star")
        links = small
        after = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if before == after:
            break
        before = after
    stars = links.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return stars.union(stars.select(F.col("component").alias("id"), "component").distinct())
