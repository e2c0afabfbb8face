"""Scoring texts with an interpolated bigram model held in sharded Elias-Fano tries.

Blocks of documents keep their words as numbers and send each shard the distinct (context, successor) pairs
that hash there, with how often training documents hold them. A shard merges the counts of all blocks, lays
them out as an n-gram trie and answers each block by context-relative successor search. So every task holds
one block or one shard, the model grows with the corpus, and nothing of it passes through the driver but the
few contexts that are too frequent for one shard: their successors are dealt over several.

With c(u) and d(u) the count of a context and the number of its different successors, the model is

    p(w | u) = c(u, w) / (c(u) + d(u)) + (1 - sum over v of c(u, v) / (c(u) + d(u))) * (c(w) + 1) / (N + V + 1)

(Witten and Bell's interpolation). A context that was dealt over k shards uses k times the number of different
successors in each shard for d(u) there; the weight left to the second term is summed over the shards, so
the probabilities of all successors still add up to one, but for the quantisation of the first term.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.llm import blocks
from clickloom.llm.elias_fano import SUCCESSOR_BITS, NgramTrie, restored
from clickloom.llm.text import SPACED, pieces_of_words, text_bytes, utf8
from clickloom.session import staged

BLOCK_BYTES, SHARD_BYTES = 6 << 20, 6 << 20
SEED = 7
# Stand-ins for the hashes of a document's begin (a context only) and end (a successor only).
BEGIN, END = np.uint64(0x42656769_6E), np.uint64(0x456E64)
RESULT = "held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


@dataclass
class Frequent:
    """Contexts that are dealt over several shards, sorted by hash: counts and numbers of shards."""

    hashes: np.ndarray
    counts: np.ndarray
    pieces: np.ndarray

    def of(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each hash in the list, -1 for others."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)


class _Gatherer:
    def __init__(self):
        self.ids, self.held, self.lengths, self.numbers, self.bytes = [], [], [], [], 0
        self.vocabulary: dict[bytes, int] = {}

    def add(self, doc_id, held: bool, data: bytes) -> None:
        known, length = self.vocabulary, 0
        for words in pieces_of_words(data, SPACED):
            self.numbers.append(np.array([known.setdefault(w, len(known)) for w in words], dtype=np.uint32))
            length += len(words)
        self.ids.append(doc_id)
        self.held.append(bool(held))
        self.lengths.append(length)
        self.bytes += len(data)

    def row(self, number: int, id_type: pa.DataType) -> pa.RecordBatch:
        hashes = np.array([xxhash.xxh64_intdigest(w, SEED) for w in self.vocabulary], dtype=np.uint64)
        numbers = np.concatenate(self.numbers) if self.numbers else np.zeros(0, np.uint32)
        lengths, held = np.array(self.lengths, dtype=np.int64), np.array(self.held)
        trained = numbers[np.repeat(~held, lengths)]
        return blocks.rows(
            {
                "block": ([number], pa.int64()),
                "ids": ([self.ids], pa.list_(id_type)),
                "train_docs": ([int((~held).sum())], pa.int64()),
                "train_words": ([len(trained)], pa.int64()),
                "words": ([blocks.pack(hashes, np.bincount(trained, minlength=len(hashes)).astype(np.uint32))], pa.binary()),
                "body": ([blocks.pack(numbers, lengths.astype(np.uint32), held)], pa.binary()),
            }
        )


class _Pairs:
    """The distinct (context, successor) pairs of a block in the order in which shards are asked."""

    def __init__(self, words: bytes, body: bytes, shards: int, frequent: Frequent):
        hashes, _ = blocks.unpack(words)
        numbers, lengths, self.held = blocks.unpack(body)
        n = self.kinds = len(hashes)
        order = np.argsort(hashes, kind="stable")
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.arange(n)
        self.hashes = np.append(hashes[order], BEGIN)
        ends = np.cumsum(lengths.astype(np.int64) + 1)
        successor = np.full(int(ends[-1]) if len(ends) else 0, n, dtype=np.int64)
        inside = np.ones(len(successor), dtype=bool)
        inside[ends - 1] = False
        successor[inside] = rank[numbers]
        context = np.empty_like(successor)
        context[1:] = successor[:-1]  # a document begins where the one before it ended
        context[:1] = n
        self.lengths = lengths.astype(np.int64) + 1
        pairs, self.inverse = np.unique(context * (n + 1) + successor, return_inverse=True)
        self.token = successor
        train = np.repeat(~self.held, self.lengths)
        self.counts = np.bincount(self.inverse, weights=train, minlength=len(pairs)).astype(np.uint32)
        self.context, self.successor = pairs // (n + 1), pairs % (n + 1)
        place = frequent.of(self.hashes[self.context])
        marks = np.append(self.hashes[:-1], END)[self.successor]
        pieces = np.where(place >= 0, frequent.pieces[place] if len(frequent.pieces) else 1, 1).astype(np.uint64)
        self.marks = marks >> np.uint64(64 - SUCCESSOR_BITS)
        shard = ((self.hashes[self.context] >> np.uint64(20)) + (marks >> np.uint64(8)) % pieces) % np.uint64(shards)
        self.order, self.first = blocks.split_by(shard.astype(np.int64), shards)

    def groups(self, s: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs that ask shard ``s``, the contexts among them and how many successors each has there."""
        mine = self.order[self.first[s] : self.first[s + 1]]
        starts = np.flatnonzero(np.diff(self.context[mine], prepend=-1))
        return mine, self.context[mine][starts], np.diff(np.append(starts, len(mine)))


class _Shard:
    """Counts of one shard, merged over all blocks, as a trie."""

    def __init__(self, asked: list[tuple], frequent: Frequent):
        contexts = _join([a[0] for a in asked], np.uint64)
        sizes = _join([a[1] for a in asked], np.int64)
        marks = _join([_marks(a) for a in asked], np.uint64)
        counts = _join([a[4] for a in asked], np.int64)
        known, rank = np.unique(contexts, return_inverse=True)
        bits = np.uint64(SUCCESSOR_BITS)
        keys, inverse = np.unique((np.repeat(rank, sizes).astype(np.uint64) << bits) | marks, return_inverse=True)
        total = np.bincount(inverse, weights=counts, minlength=len(keys)).astype(np.int64)
        keys, total = keys[total > 0], total[total > 0]
        owner = (keys >> bits).astype(np.int64)
        present, owner = np.unique(owner, return_inverse=True)
        hashes = known[present]
        count = np.bincount(owner, weights=total, minlength=len(present)).astype(np.int64)
        kinds = np.bincount(owner, minlength=len(present))
        place = frequent.of(hashes)
        dealt = place >= 0
        whole, pieces = count.copy(), np.ones(len(present), dtype=np.int64)
        if len(frequent.hashes):
            whole[dealt], pieces[dealt] = frequent.counts[place[dealt]], frequent.pieces[place[dealt]]
        self.trie = NgramTrie(
            hashes, count, np.concatenate(([0], np.cumsum(kinds))), keys & np.uint64((1 << SUCCESSOR_BITS) - 1), total / (whole + kinds * pieces)[owner]
        )
        self.words = int((~dealt & (hashes != BEGIN)).sum())
        at, of_frequent = self.trie.context(frequent.hashes)
        self.frequent = of_frequent, self._kinds(at)

    def _kinds(self, at: np.ndarray) -> np.ndarray:
        if not self.trie.contexts.size:
            return np.zeros(len(at), dtype=np.int64)
        first, last = self.trie.ranges(at)
        return np.where(at >= 0, last - first, 0)

    def answer(self, asked: tuple) -> bytes:
        contexts, sizes = asked[0], asked[1].astype(np.int64)
        at, count = self.trie.context(contexts)
        codes = np.zeros(int(sizes.sum()), dtype=np.uint8)
        if self.trie.contexts.size and len(at):
            first, last = self.trie.ranges(at)
            codes = self.trie.successor(*(np.repeat(x, sizes) for x in (at, first, last)), _marks(asked))
        return blocks.pack(count, self._kinds(at), codes, *self.frequent)


def _marks(asked: tuple) -> np.ndarray:
    return asked[2].astype(np.uint64) | (asked[3].astype(np.uint64) << np.uint64(32))


def _join(parts: list[np.ndarray], kind) -> np.ndarray:
    return np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)


def _frequent(held: DataFrame, shards: int, train_words: int, train_docs: int) -> Frequent:
    """Contexts with more than half a shard's share of the training tokens, with exact counts."""
    total = train_words + train_docs

    def counts(choose: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> dict[int, int]:
        def tell(batches):
            for batch in batches:
                for words in batch.column(0).to_pylist():
                    hashes, n = blocks.unpack(words)
                    mine = choose(hashes, n)
                    yield blocks.rows({"hash": (hashes[mine].view(np.int64), pa.int64()), "n": (n[mine].astype(np.int64), pa.int64())})

        told = held.select("words").mapInArrow(tell, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))
        return {r["hash"]: r["n"] for r in told.where(F.col("n") * 4 * shards > total).collect()}  # fewer than 4 x shards

    # A word with a share of 1/(2 x shards) of all blocks has half of that in blocks that tell it at least.
    likely = np.array(sorted(counts(lambda hashes, n: n * 4.0 * shards > n.sum())), dtype=np.int64).view(np.uint64)
    exact = counts(lambda hashes, n: np.isin(hashes, likely)) if len(likely) else {}
    exact[int(np.array([BEGIN]).view(np.int64)[0])] = train_docs
    rows = sorted((np.int64(h).view(np.uint64), n, min(shards, -(-2 * shards * n // max(total, 1)))) for h, n in exact.items())
    rows = [r for r in rows if r[2] > 1]
    return Frequent(*(np.array([r[i] for r in rows], dtype=kind) for i, kind in enumerate((np.uint64, np.int64, np.int64))))


def score_texts(
    docs: DataFrame, held_out: Column, doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES
) -> DataFrame:
    """A row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score.

    Documents for which ``held_out`` is not true are learned from; all are scored. Tokens are the lower-cased
    words and one end. ``base_score`` is the log10 probability under add-one counts, ``score`` under the
    model above. A null or empty text is its end alone. With nothing to learn from both scores are 0.
    Repeated rows count as often as they occur and give repeated rows; a null id stays null; other columns
    aren't read.
    """
    kind = dict(docs.dtypes)[doc_id]
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held"), F.col(text).alias("text"))
    shards = blocks.shards_for(text_bytes(docs), shard_bytes)

    def gather(batches):
        block, made = _Gatherer(), 0
        for batch in batches:
            id_type = batch.schema.field(0).type
            for key, held, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2)), strict=True):
                block.add(key, held, data)
                if block.bytes >= block_bytes:
                    yield block.row(blocks.numbered(made), id_type)
                    block, made = _Gatherer(), made + 1
        if block.ids:
            yield block.row(blocks.numbered(made), id_type)

    schema = f"block long, ids array<{kind}>, train_docs long, train_words long, words binary, body binary"
    held = staged(docs.mapInArrow(gather, schema), "lm_blocks")
    train_words, train_docs = (n or 0 for n in held.agg(F.sum("train_words"), F.sum("train_docs")).first())
    frequent = _frequent(held, shards, train_words, train_docs)

    def ask(batches):
        for batch in batches:
            for number, words, body in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                pairs = _Pairs(words, body, shards, frequent)
                for s in range(shards):
                    mine, contexts, sizes = pairs.groups(s)
                    marks = pairs.marks[mine]
                    data = blocks.pack(
                        pairs.hashes[contexts],
                        sizes.astype(np.uint32),
                        marks.astype(np.uint32),
                        (marks >> np.uint64(32)).astype(np.uint8),
                        pairs.counts[mine],
                    )
                    yield blocks.rows({"shard": ([s], pa.int32()), "block": ([number], pa.int64()), "data": ([data], pa.binary())})

    asks = held.select("block", "words", "body").mapInArrow(ask, "shard int, block long, data binary")

    def answer(table: pa.Table) -> pa.Table:
        asked = [blocks.unpack(data.as_py()) for data in table["data"]]
        shard = _Shard(asked, frequent)
        data = pa.array([shard.answer(a) for a in asked], pa.binary())
        return pa.table({"shard": table["shard"], "block": table["block"], "words": pa.array([shard.words] * len(asked), pa.int64()), "data": data})

    answers = staged(asks.groupBy("shard").applyInArrow(answer, "shard int, block long, words long, data binary"), "lm_answers")
    words = answers.groupBy("shard").agg(F.max("words").alias("words")).agg(F.sum("words")).first()[0] or 0
    known = words + int((frequent.hashes != BEGIN).sum()) + (train_docs > 0)
    tokens = train_words + train_docs

    def finish(answer: pa.Table, block: pa.Table) -> pa.Table:
        pairs = _Pairs(block["words"][0].as_py(), block["body"][0].as_py(), shards, frequent)
        count, kinds = np.zeros(pairs.kinds + 1, dtype=np.int64), np.zeros(pairs.kinds + 1, dtype=np.int64)
        codes = np.zeros(len(pairs.context), dtype=np.uint8)
        left = np.zeros(len(frequent.hashes))
        for s, data in zip(answer["shard"].to_pylist(), answer["data"].to_pylist(), strict=True):
            mine, contexts, _ = pairs.groups(s)
            count[contexts], kinds[contexts], codes[mine], part, part_kinds = blocks.unpack(data)
            left += part / np.maximum(frequent.counts + part_kinds * frequent.pieces, 1)
        learned = np.where(count > 0, count / np.maximum(count + kinds, 1), 0.0)
        place = frequent.of(pairs.hashes)
        learned[place >= 0] = left[place[place >= 0]]
        count[place >= 0] = frequent.counts[place[place >= 0]]
        seen = np.append(count[:-1], train_docs)
        base = (seen + 1.0) / (tokens + known + 1.0)
        pair = restored(codes) + np.maximum(1.0 - learned[pairs.context], 1e-9) * base[pairs.successor]
        starts = np.cumsum(pairs.lengths) - pairs.lengths
        sums = [np.add.reduceat(x, starts) for x in (np.log10(pair)[pairs.inverse], np.log10(base)[pairs.token], (seen > 0)[pairs.token].astype(np.int64))]
        return pa.table(
            {
                "doc_id": block["ids"].combine_chunks().flatten(),
                "held_out": pairs.held,
                "n_tokens": pairs.lengths,
                "n_known": sums[2],
                "train_tokens": np.full(len(starts), tokens, dtype=np.int64),
                "base_score": sums[1],
                "score": sums[0],
            }
        )

    documents = held.select("block", "ids", "words", "body")
    return answers.select("shard", "block", "data").groupBy("block").cogroup(documents.groupBy("block")).applyInArrow(finish, f"doc_id {kind}, {RESULT}")
