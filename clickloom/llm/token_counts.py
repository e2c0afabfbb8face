"""Token counts of a byte-level BPE without making token ids.

Blocks of documents keep how often each document holds each pre-token and ask for the number of pieces of
every distinct one. Shards of distinct pre-tokens count the pieces once for the whole corpus; the answers are
joined to the frequencies of each document and summed.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from clickloom.llm import blocks
from clickloom.llm.text import text_bytes, utf8
from clickloom.session import staged

# The split of byte-level BPE, and the same for texts of characters that all libraries class alike.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
PLAIN_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
NOT_PLAIN = re.compile("[^\x00-\x1b\x20-\x7f\xc0-ɏ]")
# No pre-token goes over a single space between two characters that aren't white space.
CUT = re.compile(r"(?<=\S) (?=\S)")
PIECE = 1 << 20
# Beyond this code point the library itself splits.
LAST = 0x32000


def byte_characters() -> dict[int, str]:
    """The printable character that byte-level BPE writes for each byte: itself, or the next above 255."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class PieceCounter:
    """Splits texts into pre-tokens and counts the pieces of one pre-token."""

    def __init__(self, source: str):
        """``source``: a tokenizer file's text with a byte-level split, no normalizer and no added prefix space."""
        spec = json.loads(source)
        split = spec.get("pre_tokenizer") or {}
        if split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True) or spec.get("normalizer"):
            raise ValueError("only byte-level tokenizers without a normalizer are supported")
        self.library = Tokenizer.from_str(source)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        self.special = [t["content"] for t in spec.get("added_tokens") or []]
        self.characters = byte_characters()

    @functools.cached_property
    def unsettled(self) -> re.Pattern:
        """Characters that the library classes otherwise than ``regex``: the two follow different Unicode versions."""
        found = []
        for low in range(0x80, LAST, 0x2000):
            chars = [chr(c) for c in range(low, low + 0x2000) if not 0xD800 <= c < 0xE000]
            for lead, kind in (("a", r"\p{L}"), ("1", r"\p{N}")):
                spans = self.library.pre_tokenizer.pre_tokenize_str("".join(f"{lead}{c}\n" for c in chars))
                joined = {start // 3 for _, (start, end) in spans if start % 3 == 0 and end - start == 2}
                same = regex.compile(kind).match
                found += [c for i, c in enumerate(chars) if (i in joined) != bool(same(c))]
        return re.compile("[" + "".join(map(re.escape, sorted(set(found)))) + f"{chr(LAST)}-{chr(0x10FFFF)}]")

    def split(self, text: str) -> Callable[[str], list[str]]:
        """A function that splits pieces of ``text`` as the library does."""
        if not NOT_PLAIN.search(text):
            return PLAIN_SPLIT.findall
        if not self.unsettled.search(text):
            return SPLIT.findall
        return lambda piece: [piece[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(piece)]

    def pre_tokens(self, text: str) -> Iterator[list[str]]:
        """The pre-tokens of a text in order, a list for each piece of it."""
        split, start = self.split(text), 0
        while start < len(text):
            cut = CUT.search(text, start + PIECE) if len(text) - start > PIECE else None
            stop = cut.start() if cut else len(text)
            yield split(text[start:stop] if start or cut else text)
            start = stop

    def whole(self, text: str) -> int:
        return len(self.library.encode(text, add_special_tokens=False).ids)

    def pieces(self, token: str) -> int:
        return len(self.model.tokenize(token.encode().decode("latin-1").translate(self.characters)))


class _Block:
    def __init__(self):
        self.ids, self.sizes, self.direct, self.places, self.counts, self.ends = [], [], [], [], [], []
        self.vocabulary: dict[str, int] = {}
        self.bytes = 0

    def add(self, doc_id, data: bytes, counter: PieceCounter) -> None:
        text, direct = data.decode(), 0
        if any(s in text for s in counter.special):
            direct = counter.whole(text)
        else:
            found: Counter[str] = Counter()
            for part in counter.pre_tokens(text):
                found.update(part)
            known = self.vocabulary
            self.places.append(np.array([known.setdefault(t, len(known)) for t in found], dtype=np.int32))
            self.counts.append(np.array(list(found.values()), dtype=np.int32))
        self.ends.append(sum(map(len, self.places[-1:])) if not direct else 0)
        self.ids.append(doc_id)
        self.sizes.append(len(data))
        self.direct.append(direct)
        self.bytes += len(data)

    def row(self, number: int, shards: int, id_type: pa.DataType) -> pa.RecordBatch:
        tokens = list(self.vocabulary)
        shard = np.array([zlib.crc32(t.encode()) % shards for t in tokens], dtype=np.int64)
        order, first = blocks.split_by(shard, shards)
        asks, place = [], np.empty(len(tokens), dtype=np.int32)
        for s in range(shards):
            mine = sorted(order[first[s] : first[s + 1]].tolist(), key=tokens.__getitem__)  # neighbours compress well
            place[mine] = np.arange(first[s], first[s + 1])
            if mine:
                asks.append({"shard": s, "data": blocks.pack([tokens[i] for i in mine])})
        ends = np.array(self.ends, dtype=np.int32)
        places = place[np.concatenate(self.places)] if self.places else np.zeros(0, np.int32)
        counts = np.concatenate(self.counts) if self.counts else np.zeros(0, np.int32)
        # Places in order within each document, as steps from one to the next: small numbers take little room.
        owner = np.repeat(np.arange(len(ends)), ends)
        by_place = np.lexsort((places, owner))
        steps = np.diff(places[by_place], prepend=0)
        heads = (np.cumsum(ends) - ends)[ends > 0]
        steps[heads] = places[by_place][heads]
        steps = steps.astype(np.uint32)
        body = blocks.pack((steps & 0xFF).astype(np.uint8), (steps >> 8 & 0xFF).astype(np.uint8), (steps >> 16).astype(np.uint16), counts[by_place], ends)
        return blocks.rows(
            {
                "block": ([number], pa.int64()),
                "ids": ([self.ids], pa.list_(id_type)),
                "sizes": ([self.sizes], pa.list_(pa.int64())),
                "direct": ([self.direct], pa.list_(pa.int64())),
                "body": ([body], pa.binary()),
                "asks": ([asks], blocks.ASKS),
            }
        )


def count_tokens(
    docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", block_bytes: int = blocks.BLOCK_BYTES
) -> DataFrame:
    """A row per document: doc_id, n_bytes (UTF-8) and n_tokens.

    ``tokenizer`` is the path of the tokenizer's file on the driver. Counts are those of its library without
    added begin or end tokens; a special string inside a text is one token, as the library has it, and such a
    text is given to the library whole. A null or empty text has no bytes and no tokens. Repeated rows and
    ids give repeated rows, a null id stays null, and other columns aren't read.
    """
    with open(tokenizer, encoding="utf-8") as file:
        source = docs.sparkSession.sparkContext.broadcast(file.read())
    kind = dict(docs.dtypes)[doc_id]
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    shards = blocks.shards_for(text_bytes(docs))

    def gather(batches):
        counter, block, made = PieceCounter(source.value), _Block(), 0
        for batch in batches:
            for key, data in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                block.add(key, data, counter)
                if block.bytes >= block_bytes:
                    yield block.row(blocks.numbered(made), shards, batch.schema.field(0).type)
                    block, made = _Block(), made + 1
            id_type = batch.schema.field(0).type
        if block.ids:
            yield block.row(blocks.numbered(made), shards, id_type)

    schema = f"block long, ids array<{kind}>, sizes array<long>, direct array<long>, body binary, asks {blocks.ASKS_SQL}"
    held = staged(docs.mapInArrow(gather, schema), "token_blocks")

    def count(table: pa.Table) -> pa.Table:
        counter, known = PieceCounter(source.value), {}
        answers = []
        for data in table["data"]:
            (tokens,) = blocks.unpack(data.as_py())
            for token in tokens:
                if token not in known:
                    known[token] = counter.pieces(token)
            answers.append(blocks.pack(np.array([known[t] for t in tokens], dtype=np.int32)))
        return pa.table({"block": table["block"], "shard": table["shard"], "data": pa.array(answers, pa.binary())})

    asks = held.select("block", F.explode("asks").alias("ask")).select("block", "ask.shard", "ask.data")
    answers = asks.groupBy("shard").applyInArrow(count, "block long, shard int, data binary")

    def finish(answer: pa.Table, block: pa.Table) -> pa.Table:
        parts = sorted(zip(answer["shard"].to_pylist(), answer["data"].to_pylist(), strict=True))
        pieces = np.concatenate([blocks.unpack(d)[0] for _, d in parts] or [np.zeros(0, np.int32)])
        low, middle, high, counts, ends = blocks.unpack(block["body"][0].as_py())
        steps = low.astype(np.int64) + (middle.astype(np.int64) << 8) + (high.astype(np.int64) << 16)
        edges = np.concatenate(([0], np.cumsum(ends, dtype=np.int64)))
        along = np.cumsum(steps)
        before = np.concatenate(([0], along))[edges[:-1]]
        places = along - np.repeat(before, ends)
        total = np.concatenate(([0], np.cumsum(pieces[places].astype(np.int64) * counts)))
        n = np.diff(total[edges]) + block["direct"][0].values.to_numpy()
        ids = block["ids"].combine_chunks().flatten()
        return pa.table({"doc_id": ids, "n_bytes": block["sizes"][0].values, "n_tokens": pa.array(n, pa.int64())})

    documents = held.select("block", "ids", "sizes", "direct", "body")
    return answers.groupBy("block").cogroup(documents.groupBy("block")).applyInArrow(finish, f"doc_id {kind}, n_bytes long, n_tokens long")
