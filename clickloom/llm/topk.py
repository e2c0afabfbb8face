"""Exact top-k inner products with a pivot-distance index.

Vectors get one more coordinate that brings all to the same norm, so that the largest inner product is the
smallest distance. Each is keyed by its nearest pivot and the distance to it, and distances are cut into
annuli. A query searches its own annulus first, then the others in the order of the best score that the
triangle inequality leaves possible there, and stops where that can't beat its k-th score. Annuli are cut
into blocks of bounded size, a common vector over several. Neighbouring blocks form zones and queries of
neighbouring blocks form parts, both of bounded size; a query goes once to each zone with blocks to search, and
a zone's vectors go to the parts that ask it. One task holds one part and one zone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickloom.llm.text import sample_below
from clickloom.session import discard, shuffle_partitions, staged

# Numbers that pivots are fitted on (vectors times dimensions), and pivots; all vectors are indexed.
SAMPLE_VALUES, PIVOTS, ROUNDS = 1 << 18, 64, 5
RINGS = 64
LEAST_BLOCK, MOST_BLOCK = 256, 65_536
# Vectors to a zone (up to a block more) and queries to a part (up to the queries of a block more).
MOST_ZONE, MOST_QUERIES = 65_536, 65_536
# Scores or bounds that are held at once.
MOST_SCORES = 1 << 21
# Blocks that a query searches between its own and all others that may still help.
NEXT = 4
# Rounding of distances and of bounds, relative to the vectors' norm.
SLACK = 1e-6


@dataclass
class Index:
    """Pivots in the lifted space, the common squared norm, and blocks: pivot, nearest and farthest distance,
    zone, and the part of their queries."""

    pivots: np.ndarray
    norm: float
    pivot: np.ndarray
    near: np.ndarray
    far: np.ndarray
    zone: np.ndarray
    part: np.ndarray

    def place(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest pivot and the distance to it."""
        d = self.distances(vectors, np.sqrt(np.maximum(self.norm - (vectors**2).sum(1), 0)))
        nearest = d.argmin(1)
        return nearest, d[np.arange(len(d)), nearest]

    def distances(self, vectors: np.ndarray, last: np.ndarray) -> np.ndarray:
        lifted = np.column_stack((vectors, last))
        square = (lifted**2).sum(1)[:, None] + (self.pivots**2).sum(1) - 2 * lifted @ self.pivots.T
        return np.sqrt(np.maximum(square, 0))

    def best_scores(self, queries: np.ndarray) -> np.ndarray:
        """For each query and block a score that no vector of the block exceeds."""
        d = self.distances(queries, np.zeros(len(queries)))[:, self.pivot]
        slack = SLACK * (1 + np.abs(d).max(initial=0) + np.sqrt(self.norm))
        least = np.maximum(np.maximum(d - self.far, self.near - d) - slack, 0)
        square = (queries**2).sum(1)[:, None]
        return (square + self.norm - least**2) / 2 + SLACK * (square + self.norm) + 0.5


def whole_numbers(embedding: str) -> Column:
    """Each component x as floor(256 x), as a double that holds it exactly; beyond 64 bits it saturates."""
    return F.transform(F.col(embedding), lambda x: F.floor(x.cast("double") * 256).cast("double"))


def usable(embedding: str) -> Column:
    finite = F.forall(F.col(embedding), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.col(embedding).isNotNull() & F.coalesce(finite, F.lit(False))


def _matrix(column, dims: int) -> np.ndarray:
    """A column of lists as rows; a shorter one is filled with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False)
    if (lengths == dims).all():
        return values.reshape(len(lengths), dims).astype(float)
    out = np.zeros((len(lengths), dims))
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    pivots: int = PIVOTS,
    counted: bool = False,
) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the ``k`` best rows for each query, ties to the smaller id.

    The score is the inner product of the whole-numbered vectors, where a shorter vector is filled up with
    zeros; beyond 64 bits it saturates. A query's candidates are all rows with another id. Rows with a null
    id, a null vector or a component that is null or not finite take no part. Of rows that repeat an id each
    is a candidate; as a query the id counts once, with the smallest of its vectors. Fewer candidates give
    fewer rows, an empty table none. Other columns aren't read. With ``counted`` a column n_searched tells how
    many vectors of searched blocks the query met, itself among them.
    """
    spark = vectors.sparkSession
    named = ["query_id", "rank", "vec_id", "score", *(["n_searched"] if counted else [])]
    rows = vectors.where(usable(embedding) & F.col(vec_id).isNotNull())
    rows = staged(rows.select(F.col(vec_id).cast("long").alias("vec_id"), whole_numbers(embedding).alias("v")), "vectors")
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    total, dims, norm = rows.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(square)).first()
    if not total:
        zero = F.lit(0).cast("long")
        none = rows.select(F.lit(None).cast("long").alias("query_id"), F.lit(1).alias("rank"), "vec_id", zero.alias("score"), zero.alias("n_searched"))
        return none.select(named).limit(0)
    dims = max(dims, 1)
    sample = rows.where(sample_below(F.col("vec_id"), total, max(1, SAMPLE_VALUES // dims))).select("v").toArrow()
    index = _fit(_matrix(sample["v"], dims), float(norm), pivots)

    @F.arrow_udf("struct<pivot: int, distance: double>")
    def place(column: pa.Array) -> pa.Array:
        pivot, distance = index.place(_matrix(column, dims))
        return pa.StructArray.from_arrays([pa.array(pivot, pa.int32()), pa.array(distance)], names=["pivot", "distance"])

    keyed = staged(rows.select("vec_id", "v", place.asNondeterministic()("v").alias("at")).select("vec_id", "v", "at.*"), "placed")
    width = (keyed.agg(F.max("distance")).first()[0] or 0.0) / RINGS or 1.0
    ring = F.least(F.floor(F.col("distance") / width), F.lit(RINGS - 1)).cast("int")
    placed = keyed.withColumn("ring", ring)
    sizes = placed.groupBy("pivot", "ring").count().orderBy("pivot", "ring").collect()  # at most pivots x rings rows
    even = total // (4 * shuffle_partitions(spark))
    block = min(max(even, LEAST_BLOCK), MOST_BLOCK)
    zone = min(max(4 * even, block), MOST_ZONE)
    annuli = _blocks(index, [tuple(r) for r in sizes], width, block, zone)
    cut = F.broadcast(spark.createDataFrame(annuli, "pivot int, ring int, first int, pieces int, start long, each long"))  # as many rows as sizes
    piece = F.pmod(F.xxhash64("vec_id", "v"), F.col("pieces")).cast("int")
    at = F.floor((F.col("start") + F.col("piece") * F.col("each")) / zone).cast("int")
    cut_up = placed.join(cut, ["pivot", "ring"]).withColumn("piece", piece)
    blocks = staged(cut_up.select("vec_id", "v", (F.col("first") + F.col("piece")).alias("block"), at.alias("zone")), "blocks")
    own = blocks.where(is_query).groupBy("vec_id").agg(F.min(F.struct("v", "block")).alias("q"))
    queries = staged(own.select(F.col("vec_id").alias("query_id"), "q.v", "q.block"), "queries")
    asking = np.zeros(len(index.pivot), dtype=np.int64)
    for r in queries.groupBy("block").count().collect():  # at most as many rows as the index has blocks
        asking[r["block"]] = r["count"]
    index.part = (np.cumsum(asking) - asking) // MOST_QUERIES

    def search(asked: pa.Table, held: pa.Table) -> pa.Table:
        if not len(asked) or not len(held):
            return _hits(*(np.zeros(0, np.int64) for _ in range(4)))
        held = held.sort_by([("block", "ascending"), ("vec_id", "ascending")])
        return _search(asked, held, dims, k)

    def searched(visits: DataFrame) -> DataFrame:
        cells = visits.select(F.col("part").alias("part"), F.col("zone").alias("zone")).distinct()
        copies = blocks.join(cells, "zone")  # a zone's vectors, once for each part that asks it
        found = visits.groupBy("part", "zone").cogroup(copies.groupBy("part", "zone")).applyInArrow(search, HITS)
        return staged(found, "found")

    def visit(asked: DataFrame, chosen: slice | None) -> DataFrame:
        """The own block, or of the others in the order of what they may hold those chosen that can still beat the k-th score."""

        @F.arrow_udf("struct<part: int, zones: array<struct<zone: int, blocks: array<int>>>>")
        def choose(v: pa.Array, block: pa.Array, least: pa.Array) -> pa.Array:
            mine = block.to_numpy()
            out = [[b] for b in mine] if chosen is None else _chosen(index, _matrix(v, dims), mine, least, chosen)
            zones = [_by_zone(index.zone, np.asarray(found)) for found in out]
            kind = pa.list_(pa.struct([("zone", pa.int32()), ("blocks", pa.list_(pa.int32()))]))
            return pa.StructArray.from_arrays([pa.array(index.part[mine], pa.int32()), pa.array(zones, kind)], names=["part", "zones"])

        told = asked.select("query_id", "v", choose.asNondeterministic()("v", "block", "least").alias("to"))
        return told.select("query_id", "v", "to.part", F.explode("to.zones").alias("to")).select("query_id", "v", "part", "to.*")

    def still(found: DataFrame) -> DataFrame:
        kth = staged(_ranked(found, k).where(F.col("rank") == k).select("query_id", F.col("score").cast("double").alias("least")), "kth")
        return queries.join(kth, "query_id", "left")

    # Each search leaves less for the next one to look at.
    found = searched(visit(queries.withColumn("least", F.lit(None).cast("double")), None))
    found = found.unionByName(searched(visit(still(found), slice(0, NEXT))))
    found = found.unionByName(searched(visit(still(found), slice(NEXT, None))))
    discard(rows, keyed)
    ranked = _ranked(found, k)
    if counted:
        ranked = ranked.join(found.groupBy("query_id").agg(F.sum("searched").alias("n_searched")), "query_id")
    return ranked.select(named)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _fit(sample: np.ndarray, norm: float, pivots: int) -> Index:
    """Pivots by a few rounds of k-means over the lifted sample."""
    lifted = np.column_stack((sample, np.sqrt(np.maximum(norm - (sample**2).sum(1), 0))))
    rng = np.random.default_rng(11)
    centres = lifted[rng.permutation(len(lifted))[: max(1, min(pivots, len(lifted) // 8))]]
    if not len(centres):
        centres = np.zeros((1, lifted.shape[1]))
    index = Index(centres, norm, *(np.zeros(0) for _ in range(5)))
    for _ in range(ROUNDS if len(lifted) else 0):
        nearest = index.place(sample)[0]
        for i in range(len(centres)):
            if (nearest == i).any():
                centres[i] = lifted[nearest == i].mean(0)
    return index


def _blocks(index: Index, sizes: list[tuple[int, int, int]], width: float, block: int, zone: int) -> list[tuple[int, ...]]:
    """(pivot, ring, first block, blocks, vectors before, vectors to a block) for each ring that holds vectors.

    Small neighbours share a block. A block belongs to the zone in which its first vector falls.
    """
    out, bounds, held, last, before = [], [], 0, None, 0
    for pivot, ring, n in sizes:
        if last == pivot and held + n <= block:
            bounds[-1][2] = (ring + 1) * width
            out.append((pivot, ring, len(bounds) - 1, 1, bounds[-1][3], 0))
            held += n
        else:
            pieces = -(-n // block)
            out.append((pivot, ring, len(bounds), pieces, before, n // pieces))
            bounds += [[pivot, ring * width, (ring + 1) * width, before + i * (n // pieces)] for i in range(pieces)]
            last, held = (pivot, n) if pieces == 1 else (None, 0)
        before += n
    index.pivot = np.array([b[0] for b in bounds], dtype=np.int64)
    index.near, index.far = (np.array([b[i] for b in bounds], dtype=float) for i in (1, 2))
    index.zone = np.array([b[3] // zone for b in bounds], dtype=np.int64)
    return out


def _chosen(index: Index, queries: np.ndarray, mine: np.ndarray, least: pa.Array, chosen: slice) -> list[np.ndarray]:
    """For each query the chosen blocks, without its own, whose bound reaches its k-th score."""
    floor = np.nan_to_num(least.to_numpy(zero_copy_only=False).astype(float), nan=-np.inf)
    out, step = [], max(1, MOST_SCORES // len(index.pivot))
    for at in range(0, len(queries), step):
        for row, own, low in zip(index.best_scores(queries[at : at + step]), mine[at : at + step], floor[at : at + step], strict=True):
            order = np.argsort(-row, kind="stable")
            order = order[order != own][chosen]
            out.append(order[row[order] >= low])
    return out


def _by_zone(zone: np.ndarray, blocks: np.ndarray) -> list[dict]:
    blocks = np.sort(blocks)  # zones ascend with blocks
    starts = np.flatnonzero(np.diff(zone[blocks], prepend=-1))
    return [{"zone": int(zone[b[0]]), "blocks": b.tolist()} for b in np.split(blocks, starts[1:]) if len(b)]


def _search(asked: pa.Table, held: pa.Table, dims: int, k: int) -> pa.Table:
    """The k best hits of each query of a part in the blocks of a zone that it asks; ``held`` is in the order of block and id."""
    ids, matrix, of = held["vec_id"].to_numpy(), _matrix(held["v"], dims), held["block"].to_numpy()
    names, queries = asked["query_id"].to_numpy(), _matrix(asked["v"], dims)
    lists = asked["blocks"].combine_chunks()
    query = np.repeat(np.arange(len(names)), pc.list_value_length(lists).to_numpy())
    block = lists.flatten().to_numpy()
    order = np.argsort(block, kind="stable")
    query, block = query[order], block[order]
    best, searched = [], np.zeros(len(names), dtype=np.int64)
    for b in np.unique(block):
        lo, hi = np.searchsorted(of, b), np.searchsorted(of, b, "right")
        mine = query[np.searchsorted(block, b) : np.searchsorted(block, b, "right")]
        searched[mine] += hi - lo
        if lo < hi:
            at, found, scores = _best(names[mine], queries[mine], ids[lo:hi], matrix[lo:hi], k)
            best.append((mine[at], found, scores))
    at, found, scores = _top(*(np.concatenate([b[i] for b in best] or [np.zeros(0, np.int64)]) for i in range(3)), k)
    first = np.diff(at, prepend=-1) > 0  # one row of a query carries how many vectors it met
    return _hits(names[at], found, scores, np.where(first, searched[at], 0))


def _best(names: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The place of a query, id and score for the k best vectors of each query, without its own id."""
    exact = float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * queries.shape[1] < 2.0**53
    out, step, edge = [], max(1, MOST_SCORES // len(ids)), len(ids) - min(k, len(ids))
    for at in range(0, len(names), step):
        part = queries[at : at + step]
        scores = part @ vectors.T if exact else _saturated(part, vectors)
        own = names[at : at + step, None] == ids
        scores[own] = -np.inf if exact else np.iinfo(np.int64).min
        row, column = np.nonzero((scores >= np.partition(scores, edge, axis=1)[:, edge, None]) & ~own)
        out.append(_top(row + at, ids[column], scores[row, column].astype(np.int64), k))
    return tuple(np.concatenate([o[i] for o in out]) for i in range(3))


def _top(at: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k rows of largest score for each value of ``at``, ties to the smaller id, in this order."""
    order = np.lexsort((ids, -scores, at))
    at, ids, scores = at[order], ids[order], scores[order]
    keep = np.arange(len(at)) - np.searchsorted(at, at) < k
    return at[keep], ids[keep], scores[keep]


def _saturated(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products in whole numbers of any size, brought into 64 bits."""
    left, right = ([[int(x) for x in v] for v in m] for m in (queries, vectors))
    most = (1 << 63) - 1
    return np.array([[max(-most, min(most, sum(a * b for a, b in zip(q, v, strict=True)))) for v in right] for q in left], dtype=np.int64)


HITS = "query_id long, vec_id long, score long, searched long"


def _hits(names, ids, scores, searched) -> pa.Table:
    columns = {"query_id": names, "vec_id": ids, "score": scores, "searched": searched}
    return pa.table({name: pa.array(values, pa.int64()) for name, values in columns.items()})
