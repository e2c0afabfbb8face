"""Connected components of links that tasks contract before, and between, alternating stars.

A task joins the links it reads to trees in bounded chunks and hands on one link to the smallest node for each
other node, without an exchange. That is most of the work for links of many small groups, so that the star rounds,
which exchange all links by their ends, have little left to do; they end when the links are stars.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.llm.components import _star
from clickloom.llm.vptree import Forest
from clickloom.session import discard, staged

# Links that a task joins at once.
CHUNK = 1 << 20


def components(links: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(root, node) for every node of ``links`` (whole numbers ``a``, ``b``) that isn't its component's smallest.

    ``root`` is the smallest node that can be reached. Links with a null end and links of a node with itself are
    left out; repeated links count once. No links give no rows. The result is a written table.
    """
    own = staged(links.where("a <> b").select(F.least("a", "b").alias("root"), F.greatest("a", "b").alias("node")), "links")
    links = _shrunk(own, chunk)
    while not _are_stars(links):
        large = _star(links, links.unionAll(links.select(F.col("node").alias("root"), F.col("root").alias("node"))), True)
        small = _star(large, large, False)
        discard(links, large)
        links = _shrunk(small, chunk)
    return links


def _shrunk(links: DataFrame, chunk: int) -> DataFrame:
    """The written ``links`` contracted twice: the second time tasks read what several have left."""
    for _ in range(2):
        after = staged(contracted(links, chunk), "links")
        discard(links)
        links = after
    return links


def contracted(links: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Links (root, node) with the same components, to the smallest node of each tree that a task has joined."""

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])
            size += batch.num_rows
            if size >= chunk:
                held = [_hung(held)]
                size = len(held[0][0])
                if 2 * size > chunk:
                    yield _rows(*held[0])
                    held, size = [], 0
        if held:
            yield _rows(*_hung(held))

    return links.select("root", "node").mapInArrow(run, "root long, node long")


def _hung(held) -> list[np.ndarray]:
    ends = np.concatenate([part[0] for part in held] + [part[1] for part in held])
    nodes, at = np.unique(ends, return_inverse=True)
    forest = Forest(len(nodes))
    forest.join(at[: len(at) // 2], at[len(at) // 2 :])
    root = forest.find(np.arange(len(nodes)))
    below = np.flatnonzero(root != np.arange(len(nodes)))
    return [nodes[root[below]], nodes[below]]


def _rows(root: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(root), pa.array(node)], ["root", "node"])


def _are_stars(links: DataFrame) -> bool:
    """Whether every node hangs on one root, once, and no root hangs on another."""
    ends = F.array(
        F.struct(F.col("node").alias("end"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")),
        F.struct(F.col("root").alias("end"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")),
    )
    told = links.select(F.explode(ends).alias("e")).select("e.*").groupBy("end").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
    return told.where((F.col("hangs") > 1) | ((F.col("hangs") == 1) & (F.col("holds") == 1))).isEmpty()
