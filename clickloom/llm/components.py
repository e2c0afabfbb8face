"""Connected components by alternating stars, in DataFrame operations only.

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014): a large star hangs every larger
neighbour of a node on the smallest node around it, a small star does so with the node and its smaller
neighbours. The number of links never grows, and the links end as one star per component. Both joins
read written tables, so a node with very many links is split by Spark's skew handling.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.session import discard, staged


def components(links: DataFrame) -> DataFrame:
    """(root, node) for every node of ``links`` (columns ``a``, ``b``) that isn't its component's smallest.

    ``root`` is the smallest node that can be reached. Links with a null end and links of a node with
    itself are left out; repeated links count once. No links give no rows. The result is a written table.
    """
    links = staged(
        links.where("a <> b").select(F.least("a", "b").alias("root"), F.greatest("a", "b").alias("node")).distinct(), "links"
    )
    state = _state(links)
    while state[0]:
        large = _star(links, links.unionAll(links.select(F.col("node").alias("root"), F.col("root").alias("node"))), True)
        small = _star(large, large, False)
        discard(links, large)
        links, before, state = small, state, _state(small)
        if state == before:
            break
    return links


def _star(links: DataFrame, around: DataFrame, large: bool) -> DataFrame:
    """``around``: a row for each node ("node") and neighbour ("root") that takes part."""
    low = around.groupBy("node").agg(F.min("root").alias("low"))
    low = staged(low.select("node", F.least("node", "low").alias("low")) if large else low, "low")
    met = around.join(low, "node")
    if large:
        hung = met.where("root > node").select(F.col("low").alias("root"), F.col("root").alias("node"))
    else:
        hung = met.select(F.col("low").alias("root"), F.col("root").alias("node")).unionAll(
            low.select(F.col("low").alias("root"), "node")
        )
    out = staged(hung.where("root <> node").select("root", "node").distinct(), "links")
    discard(low)
    return out


def _state(links: DataFrame):
    return links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("root", "node").cast("decimal(38,0)"))).first()
