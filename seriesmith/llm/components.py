"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesmith.llm.common import stored


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select("b", "a")).toDF("a", "b")
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    to_least = down.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return to_least.union(least.select("a", "m")).toDF("a", "b")


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (a, b): the smallest node reachable.

    Each round's links are written to the shared folder. Groups are only aggregated (a minimum per node) and joined, so
    a node with very many links is pre-aggregated and its rows can be split by the skew join; the driver sees one count
    and one checksum per round. Self links and null ends are ignored.
    """
    links = links.toDF("a", "b").filter("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links, state = stored(links, "links"), None
    while True:
        count, total = links.agg(F.count("*"), F.sum(F.hash("a", "b").cast("decimal(38,0)"))).first()
        if state == (count, total) or not count:
            break
        state = (count, total)
        links = stored(_small_star(_large_star(links).distinct()).distinct(), "links")
    roots = links.select("b").distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        roots.select(F.col("b").alias("node"), F.col("b").alias("component")))
