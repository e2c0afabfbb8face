"""Blocks of documents that ask shards of distinct keys.

A block holds what bounded many documents need to be finished later, and asks each shard about the distinct
keys that hash there, in one packed row. A shard sees each key of the corpus together with all blocks that
ask for it, and answers every block with one value per key. Rows sent are per block and distinct key, not
per token, which is what keeps such jobs small on disk.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext

# Bytes of text to a block and to a shard. A task holds one block or one shard at a time.
BLOCK_BYTES, SHARD_BYTES = 8 << 20, 16 << 20
LEAST_SHARDS = 8


def pack(*values) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(values, protocol=5))


def unpack(data: bytes):
    return pickle.loads(zstandard.ZstdDecompressor().decompress(data))


def shards_for(size: int, shard_bytes: int = SHARD_BYTES) -> int:
    return max(LEAST_SHARDS, -(-size // shard_bytes))


def numbered(first: int) -> int:
    """A number for a block that no other task gives."""
    return (TaskContext.get().partitionId() << 32) + first


def split_by(shard: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts by shard, and where each shard begins in it."""
    order = np.argsort(shard, kind="stable")
    return order, np.searchsorted(shard[order], np.arange(shards + 1))


def rows(columns: dict[str, tuple[list, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns.values()], list(columns))


ASKS = pa.list_(pa.struct([("shard", pa.int32()), ("data", pa.binary())]))
ASKS_SQL = "array<struct<shard: int, data: binary>>"
