"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threatweave.llm.common import settle


def _minima(links: DataFrame, least) -> DataFrame:
    """Each ``u`` and the least of its side; written, as Spark can split a join with a plain table at a hot ``u``."""
    return settle(links.groupBy("u").agg(least.alias("m")), "star-centres")


def _is_stars(links: DataFrame) -> bool:
    """Whether every node is either one centre ``v`` or a leaf ``u`` of one centre (true of no links)."""
    ends = links.select(F.col("u").alias("x"), F.lit(1).alias("leaf")).unionByName(
        links.select(F.col("v").alias("x"), F.lit(0).alias("leaf")))
    return ends.groupBy("x").agg(F.sum("leaf").alias("leaves"), F.count("*").alias("n")).where(
        "leaves > 1 OR (leaves = 1 AND n > 1)").isEmpty()


def connected_components(links: DataFrame) -> DataFrame:
    """``node, comp`` for every end of ``links`` (``u, v``, of one orderable type); ``comp`` is the smallest node reachable.

    Large star: every node hands the smallest of itself and its neighbours to its
    larger neighbours. Small star: to its smaller ones and itself. Both keep the
    components; repeated, the links become one star per component, which ends the
    rounds. Every round is written to the shared folder; minima combine before they are
    shuffled; only a yes or no per round reaches the driver. Empty links give an empty table.
    """
    ordered = links.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    ordered = settle(ordered, "links")
    while not _is_stars(ordered):
        both = ordered.unionByName(ordered.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # (v, m) for the larger neighbours v of each u
        large = both.where("v > u").join(_minima(both, F.least(F.col("u"), F.min("v"))), "u").select(
            F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = settle(large, "large-star")
        # (v, m) for the smaller neighbours v of each u, and (u, m)
        small = large.join(_minima(large, F.min("v")), "u").select(
            F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        ordered = settle(small, "small-star")
    return ordered.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(
        ordered.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
