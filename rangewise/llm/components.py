"""Connected components of a table of links, by alternating large and small stars.

Each step is an aggregation (smallest neighbour) and a join back on the same key;
steps are written to the shared folder, and nothing but a count goes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rangewise.llm.common import dropped, written


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links: (a, b) with a > b. Large star: every neighbour above a vertex is linked to
    the smallest one around it; small star: so is every one below it, and itself."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = both.join(least, "a")
    if large:
        out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.filter("a != b").distinct()


def components(links: DataFrame, most_steps: int = 60) -> DataFrame:
    """(vertex, root) for every vertex of links (a, b), other than roots; a root is the
    smallest vertex that can be reached. Loops and repeated links do no harm."""
    links = written(links.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    for _ in range(most_steps):
        stars = written(_star(_star(links, True), False))
        dropped(links)
        links = stars
        # at the fixed point every link goes to a root: no vertex is at both ends
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return links.select(F.col("a").alias("vertex"), F.col("b").alias("root"))
        state = now
    raise RuntimeError("components did not settle")
