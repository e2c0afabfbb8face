"""SimHash near-duplicates with a sharded vantage-point tree.

Equal fingerprints are one code. A tree grown on a bounded sample of codes cuts the Hamming space into
shards; a code goes to its own shard and to those within reach beyond a boundary. Shards are cut into
blocks of bounded size, so a dense group of near copies is compared by many tasks, and a task returns one
link per code at most, never the pairs of a group. Components of the links are found by Spark joins.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickloom.llm.contraction import components
from clickloom.llm.text import SPACED, pieces_of_words, sample_below, utf8
from clickloom.llm.vptree import Forest, VantageTree, join_near
from clickloom.session import discard, shuffle_partitions, staged

SHINGLE, REACH, SEED = 4, 4, 42
# Codes that the tree is grown on; all codes are indexed and compared.
SAMPLE = 32_768
LEAST_BLOCK, MOST_BLOCK = 2_048, 32_768
HASHES = 1 << 15


def fingerprint(data: bytes, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a text as an unsigned number; 0 without words.

    A bit is set if more than half of the shingles have it set; repeated shingles count as often as they
    occur, and a text of fewer words is one shingle.
    """
    ones, total, tail = np.zeros(64, dtype=np.int64), 0, []
    pattern = b" ".join([b"%b"] * shingle)
    for words in pieces_of_words(data, SPACED):
        words = tail + words
        for at in range(0, len(words) - shingle + 1, HASHES):
            part = words[at : at + HASHES + shingle - 1]
            hashes = [xxhash.xxh64_intdigest(pattern % w, SEED) for w in zip(*(part[i:] for i in range(shingle)), strict=False)]
            ones += _ones(hashes)
            total += len(hashes)
        tail = words[-(shingle - 1) :] if shingle > 1 else []
    if not total:
        if not tail:
            return 0
        ones, total = _ones([xxhash.xxh64_intdigest(b" ".join(tail), SEED)]), 1
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big")


def _ones(hashes: list[int]) -> np.ndarray:
    """How many of the hashes have each bit set, the highest bit first."""
    bits = np.unpackbits(np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return bits.sum(0, dtype=np.int64)


@F.arrow_udf(T.LongType())
def _signed(texts: pa.Array) -> pa.Array:
    codes = np.array([fingerprint(t) for t in utf8(texts)], dtype=np.uint64)
    return pa.array(codes.view(np.int64))


def simhash(text: str | Column) -> Column:
    """The fingerprint as a signed 64-bit number with the same bits."""
    return _signed.asNondeterministic()(text)  # so that a filter on it doesn't compute it again


def near_links(codes: DataFrame, reach: int = REACH, sample: int = SAMPLE) -> DataFrame:
    """Links (a, b) that connect exactly the codes within ``reach`` bits of each other, directly or by others.

    ``codes`` is a written table with the distinct 64-bit numbers ``code``.
    """
    total = codes.count()
    picked = codes.where(sample_below(F.col("code"), total, sample)).select("code").toPandas()  # about `sample` rows
    tree = VantageTree.build(np.sort(picked["code"].to_numpy(np.int64)).view(np.uint64), total, reach)

    def count(batches):
        homes, visitors = np.zeros(tree.shards, np.int64), np.zeros(tree.shards, np.int64)
        for batch in batches:
            _, shard, own = tree.place(_codes(batch))
            homes += np.bincount(shard[own], minlength=tree.shards)
            visitors += np.bincount(shard[~own], minlength=tree.shards)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(tree.shards)), pa.array(homes), pa.array(visitors)], ["shard", "h", "v"])

    sizes = codes.select("code").mapInArrow(count, "shard long, h long, v long").groupBy("shard").agg(F.sum("h").alias("h"), F.sum("v").alias("v"))
    sizes = sizes.toPandas().sort_values("shard")  # a row for each shard, at most sample / 64
    homes, visitors = sizes["h"].to_numpy(), sizes["v"].to_numpy()
    even = int((homes.sum() + visitors.sum()) / (8 * shuffle_partitions(codes.sparkSession)))
    block = min(max(even, LEAST_BLOCK), MOST_BLOCK)
    home_blocks, visit_blocks = -(-homes // block), -(-visitors // block)
    first = np.concatenate(([0], np.cumsum(home_blocks * (home_blocks + visit_blocks))))

    def deal(batches):
        for batch in batches:
            codes = _codes(batch)
            rows, shard, own = tree.place(codes)
            value = codes[rows]
            spread = (value * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
            n, m = home_blocks[shard], visit_blocks[shard]
            part = spread % np.where(own, n, np.maximum(m, 1))
            cells, sides, sent = [], [], []
            for k in range(int((n + m).max(initial=0))):
                # Block `part` at home against block k (at home from n on), or as a visitor against home block k.
                base = first[shard] + part * (n + m)
                meets = own & (k >= part) & (k < n + m) & ((k != part) | (n > 1) | (m == 0))
                cells.append(base[meets] + k)
                sides.append(np.where(k == part[meets], 2, np.where((n == 1) & (m > 0) & (k == n), 2, 0)[meets]))
                sent.append(value[meets])
                for away, at in ((own & (k < part), k * (n + m) + part), (~own & (k < n), k * (n + m) + n + part)):
                    cells.append((first[shard] + at)[away])
                    sides.append(np.ones(int(away.sum()), dtype=np.int64))
                    sent.append(value[away])
            if cells:
                out = [np.concatenate(x) for x in (cells, sides, sent)]
                yield pa.RecordBatch.from_arrays([pa.array(out[0]), pa.array(out[1].astype(np.int8)), pa.array(out[2].view(np.int64))], ["cell", "side", "code"])

    def link(cell: pd.DataFrame) -> pd.DataFrame:
        values, side = cell["code"].to_numpy(np.int64).view(np.uint64), cell["side"].to_numpy()
        mine, others = np.flatnonzero(side != 1), np.flatnonzero(side == 1)
        forest = Forest(len(values))
        join_near(forest, values, mine, others, reach)
        if (side == 2).any():
            join_near(forest, values, mine, mine, reach)
        root = forest.find(np.arange(len(values)))
        linked = np.flatnonzero(root != np.arange(len(values)))
        signed = values.view(np.int64)
        return pd.DataFrame({"a": signed[linked], "b": signed[root[linked]]})

    dealt = codes.select("code").mapInArrow(deal, "cell long, side byte, code long")
    return dealt.groupBy("cell").applyInPandas(link, "a long, b long")


def _codes(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def classes(signed: DataFrame, reach: int = REACH) -> DataFrame:
    """(code, root, head) for each distinct ``code`` of a written table.

    ``root`` is the smallest code of its component and ``head`` the smallest ``doc_id`` there.
    """
    codes = staged(signed.groupBy("code").agg(F.min("doc_id").alias("own")), "codes")
    labels = components(near_links(codes, reach))
    named = labels.unionByName(labels.select("root", F.col("root").alias("node")).distinct())
    members = staged(named.join(codes, named["node"] == codes["code"]).select("code", "root", "own"), "members")
    # Written, so that the join is dealt on its own and a large component's rows can be split.
    heads = staged(members.groupBy("root").agg(F.min("own").alias("head")), "heads")
    linked = members.join(heads, "root").select("code", "root", "head")
    out = codes.join(linked, "code", "left")
    out = staged(out.select("code", F.coalesce("root", "code").alias("root"), F.coalesce("head", "own").alias("head")), "classes")
    discard(codes, labels, members, heads)
    return out


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", reach: int = REACH) -> DataFrame:
    """A row per document: doc_id, fingerprint (16 hex digits) and component_id, the smallest id of its component.

    Texts that are null or have no words have fingerprint zero and are linked like any other. Repeated rows
    give repeated rows. A null id is nobody's component_id unless the whole component has no id. Other
    columns of ``docs`` are not read. An empty table gives an empty result.
    """
    signed = staged(docs.select(F.col(doc_id).alias("doc_id"), simhash(F.col(text)).alias("code")), "signed")
    joined = signed.join(classes(signed, reach), "code")
    return joined.select("doc_id", hex16("code").alias("fingerprint"), F.col("head").alias("component_id"))


def hex16(code: str) -> Column:
    return F.lower(F.lpad(F.hex(code), 16, "0"))


def one_per_group(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", reach: int = REACH) -> DataFrame:
    """The rows of ``docs`` with one document left of each component: the smallest id, nulls last.

    Of rows that repeat that id one stays. All columns come back as they were, whatever their names.
    """
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    rows = staged(rows.select(F.monotonically_increasing_id().alias("at"), simhash(F.col(f"row.`{text}`")).alias("code"), "row"), "rows")
    ids = rows.select("at", "code", F.col(f"row.`{doc_id}`").alias("doc_id"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "at"))
    groups = ids.join(classes(ids, reach), "code").groupBy("root")
    kept = staged(groups.agg(first.alias("first")).select(F.col("first.at").alias("at")), "kept")
    # Merged at every size: a broadcast of the kept ids would grow with the documents.
    return rows.join(kept.hint("merge"), "at", "left_semi").select("row.*")
