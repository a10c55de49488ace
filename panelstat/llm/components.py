"""Connected components of a table of links, by alternating large and small stars.

Every round turns the links of each node to its smallest neighbour; the links end as stars around the
smallest node of each component, in a number of rounds that is logarithmic in practice. Neighbour
minima are aggregated within tasks and written before they are joined back, so that a node with a
third of all links is split by the adaptive join and never gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelstat.session import checkpoint


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def _large_star(links: DataFrame) -> DataFrame:
    """Larger neighbours of a node go to the smallest of its neighbours and itself."""
    both = links.union(links.select("b", "a")).toDF("u", "v")
    least = checkpoint(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    turned = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return checkpoint(turned.distinct())


def _small_star(links: DataFrame) -> DataFrame:
    """Smaller neighbours of a node, and the node, go to the smallest of them. Links point downwards."""
    least = checkpoint(links.groupBy("a").agg(F.min("b").alias("m")))
    others = links.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return checkpoint(others.union(least.select("a", F.col("m").alias("b"))).distinct())


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node in a link (a, b) other than the roots, which are the smallest nodes.

    Runs jobs. Links of a node to itself are ignored; no links give no rows.
    """
    links = checkpoint(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    state = _state(links)
    while state[0]:
        links = _small_star(_large_star(links))
        before, state = state, _state(links)
        if state == before:
            break
    return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
