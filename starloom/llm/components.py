"""Connected components of a table of links, as alternating star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.session import materialize


def _large_star(links: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the least node around it."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # Written down, so that both sides of the join are plain shuffles and a hot node can be split.
    least = materialize(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("root").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the least of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("root"))
    moved = down.join(least, "a").where("b <> root").select(F.col("b").alias("a"), F.col("root").alias("b"))
    return moved.unionByName(least.select("a", F.col("root").alias("b")))


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """For each linked node ``a`` the least node of its component, ``b``; least nodes themselves are left out.

    ``links`` has two integer columns ``a`` and ``b``. The number of rounds grows
    with the logarithm of the longest path; each is written to the shared folder,
    and only a count and a checksum reach the driver. A node with very many links
    is a hot key of a join with one row per node, which adaptive execution splits.
    """
    links = materialize(links.where("a <> b").distinct())
    state = _state(links)
    while True:
        links = materialize(_small_star(_large_star(links).where("a <> b").distinct()).where("a <> b").distinct())
        new = _state(links)
        if new == state:
            return links
        state = new
