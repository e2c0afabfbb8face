"""Benchmark decontamination with suffix arrays over the training texts.

Texts are cut into shards of bounded size. A shard numbers its words by the benchmark's vocabulary, keeps
the runs of known words that are long enough to hold a match, and sorts their suffixes. Every suffix of the
benchmark is then looked up by binary search, one more word at a time: the range that is left after a
window's words holds all occurrences of that window, and searching on gives the longest verbatim match at
each place. Words outside the vocabulary end a match, so nothing that could match is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickloom.llm.suffixes import Shard, expand
from clickloom.llm.text import ALNUM, pieces_of_words, text_bytes, utf8
from clickloom.session import discard, staged

WINDOW = 13
# A document is contaminated if at least one word in this many is hit.
SHARE = 20
# Words of a shard, and bytes of benchmark text that are searched for at a time.
SHARD_WORDS = 1 << 20
BENCH_BYTES = 16 << 20
SPAN = pa.list_(pa.int32())
MATCHES = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("spans", T.ArrayType(T.ArrayType(T.IntegerType()))),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("longest", T.IntegerType()),
    ]
)


@dataclass
class Benchmark:
    """Benchmark texts by word numbers: ``suffixes`` are (start, words that a match needs, text)."""

    vocabulary: dict[bytes, int]
    words: np.ndarray
    starts: np.ndarray
    needs: np.ndarray
    texts: np.ndarray
    items: list[list[str]]

    @classmethod
    def build(cls, ids: list, texts: list[bytes], window: int = WINDOW) -> Benchmark:
        """Equal word sequences are one text with several ids; texts without words are left out."""
        vocabulary: dict[bytes, int] = {}
        known: dict[tuple, int] = {}
        flat, starts, needs, owner, items = [], [], [], [], []
        for item, text in zip(ids, texts, strict=True):
            numbers = [vocabulary.setdefault(w, len(vocabulary) + 1) for part in pieces_of_words(text, ALNUM) for w in part]
            if not numbers:
                continue
            at = known.setdefault(tuple(numbers), len(items))
            if at < len(items):
                items[at].append(item)
                continue
            need = min(window, len(numbers))
            places = range(len(flat), len(flat) + len(numbers) - need + 1)
            starts += places
            needs += [need] * len(places)
            owner += [len(items)] * len(places)
            items.append([item])
            flat += [*numbers, 0]
        return cls(vocabulary, *(np.array(x, dtype=np.int64) for x in (flat, starts, needs, owner)), items)

    def matches(self, texts: list[bytes], shard_words: int = SHARD_WORDS) -> Iterator[tuple[int, list, list, int]]:
        """For each text its words, spans of hit words, ids of the items that occur and the longest match."""
        held, size = [], 0
        for text in texts:
            parts = [np.fromiter(map(self.vocabulary.get, w, repeat(0)), np.int32, len(w)) for w in pieces_of_words(text, ALNUM)]
            held.append(np.concatenate(parts) if parts else np.zeros(0, np.int32))
            size += len(held[-1])
            if size >= shard_words:
                yield from self._search(held)
                held, size = [], 0
        yield from self._search(held)

    def _search(self, texts: list[np.ndarray]) -> Iterator[tuple[int, list, list, int]]:
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        flat = np.concatenate([x for t in texts for x in (t, [0])]) if texts else np.zeros(0, np.int64)
        first = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1]
        place, words = _long_runs(flat, int(self.needs.min(initial=1 << 30)))
        depth, pairs = self._occurrences(Shard(words))
        where, which = pairs
        ends = np.zeros(len(flat) + 1, dtype=np.int32)
        if len(where):
            reach = self.needs[which]
            np.add.at(ends, place[where], 1)
            np.add.at(ends, place[where] + reach, -1)
        hit = np.cumsum(ends[:-1]) > 0
        edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
        row = np.searchsorted(first, place[where], "right") - 1
        found: dict[int, set[int]] = {}
        if len(row):
            texts_hit = np.unique(np.stack((row, self.texts[which])), axis=1)
            for r, t in zip(*texts_hit.tolist(), strict=True):
                found.setdefault(r, set()).add(t)
        longest = np.zeros(len(texts), dtype=np.int64)
        at = np.flatnonzero(depth)
        np.maximum.at(longest, np.searchsorted(first, place[at], "right") - 1, depth[at])
        begin, end = edges[0::2], edges[1::2]
        owner = np.searchsorted(first, begin, "right") - 1
        bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
        for i, size in enumerate(sizes.tolist()):
            mine = slice(bounds[i], bounds[i + 1])
            spans = np.stack((begin[mine], end[mine]), axis=1) - first[i]
            items = sorted({item for t in found.get(i, ()) for item in self.items[t]})
            yield size, spans.tolist(), items, int(longest[i])

    def _occurrences(self, shard: Shard):
        """How far a match goes at each place of the shard, and (place, suffix) of all windows that occur.

        A suffix is narrowed for the words of its window alone. Matches of more words are windows that follow each
        other in both texts, so each one's length is what is left of its row of windows.
        """
        alive = np.arange(len(self.starts))
        lo, hi = np.zeros(len(alive), np.int64), np.full(len(alive), len(shard.words))
        places, suffixes, step = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        while len(alive):
            lo, hi = shard.narrow(lo, hi, step, self.words[self.starts[alive] + step])
            step += 1
            full = self.needs[alive] == step
            row, at = expand(lo[full], hi[full])
            places.append(shard.order[at])
            suffixes.append(alive[full][row])
            on = (lo < hi) & ~full
            alive, lo, hi = alive[on], lo[on], hi[on]
        where, which = np.concatenate(places), np.concatenate(suffixes)
        depth = np.zeros(len(shard.words), dtype=np.int64)
        if len(where):
            apart = where - self.starts[which]
            order = np.lexsort((where, apart))
            sorted_, row = where[order], apart[order]
            last = np.flatnonzero(np.append((row[1:] != row[:-1]) | (sorted_[1:] != sorted_[:-1] + 1), True))
            end = sorted_[last[np.searchsorted(last, np.arange(len(order)))]]
            np.maximum.at(depth, sorted_, self.needs[which[order]] + end - sorted_)
        return depth, (where, which)


def _long_runs(flat: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and words of the runs of at least ``least`` known words, with the separator after each run."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], (flat > 0).view(np.int8), [0]))))
    begin, end = edges[0::2], edges[1::2]
    long = end - begin >= least
    place = expand(begin[long], end[long] + 1)[1]
    return place, np.append(flat, 0)[place]


def _blocks(benchmark: DataFrame, item_id: str, text: str, block_bytes: int) -> list[DataFrame]:
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item_id"), F.col(text).alias("text"))
    blocks = max(1, -(-text_bytes(items) // block_bytes))
    if blocks == 1:
        return [items]
    dealt = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    return [items.where(dealt == i) for i in range(blocks)]


def _matcher(items: DataFrame):
    rows = items.collect()  # at most about BENCH_BYTES of text
    built = Benchmark.build([r["item_id"] for r in rows], [(r["text"] or "").encode() for r in rows])
    shared = items.sparkSession.sparkContext.broadcast(built)

    @F.arrow_udf(MATCHES)
    def match(texts: pa.Array) -> pa.Array:
        names, kinds = MATCHES.fieldNames(), [pa.int64(), pa.list_(SPAN), pa.list_(pa.string()), pa.int32()]
        found = list(zip(*shared.value.matches(utf8(texts)), strict=True)) or [[]] * len(kinds)
        return pa.StructArray.from_arrays([pa.array(x, kind) for x, kind in zip(found, kinds, strict=True)], names=names)

    return match.asNondeterministic()


def with_matches(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    into: str = "matches",
    item_id: str = "item_id",
    item_text: str = "text",
    block_bytes: int = BENCH_BYTES,
) -> DataFrame:
    """``docs`` with a struct ``into``: n_words, spans, items and longest.

    ``spans`` are the maximal runs [start, end) of words that lie in an occurrence of a benchmark window,
    ``items`` the ids (as text, a null as an empty one) of the items with occurring windows in code point
    order, and ``longest`` the words of the longest verbatim match. Null or empty texts have no words and no
    matches; an empty benchmark matches nothing; repeated rows and items count once each in every row.
    A benchmark beyond ``block_bytes`` is searched for in blocks, whose results are merged for each row.
    """
    blocks = _blocks(benchmark, item_id, item_text, block_bytes)
    if len(blocks) == 1:
        return docs.withColumn(into, _matcher(blocks[0])(F.col(text)))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.monotonically_increasing_id().alias("at"))
    rows = staged(rows, "rows")
    parts = [staged(rows.select("at", _matcher(b)(F.col(f"row.`{text}`")).alias("m")), "matches") for b in blocks]
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    merged = merged.groupBy("at").agg(
        F.max("m.n_words").alias("n_words"),
        F.flatten(F.collect_list("m.spans")).alias("spans"),  # a list per block
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("m.items")))).alias("items"),
        F.max("m.longest").alias("longest"),
    )
    merged = staged(merged.select("at", F.struct("n_words", _merge_spans(F.col("spans")).alias("spans"), "items", "longest").alias("m")), "merged")
    discard(*parts)
    return rows.join(merged, "at").select("row.*", F.col("m").alias(into))


@F.arrow_udf(T.ArrayType(T.ArrayType(T.IntegerType())))
def _merge_spans(spans: pa.Array) -> pa.Array:
    out = []
    for row in spans.to_pylist():
        merged: list[list[int]] = []
        for start, end in sorted(row):
            if merged and start <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], end)
            else:
                merged.append([start, end])
        out.append(merged)
    return pa.array(out, pa.list_(SPAN))


def n_hit(into: str = "matches") -> Column:
    return F.aggregate(F.col(f"{into}.spans"), F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])


def contaminated(into: str = "matches", share: int = SHARE) -> Column:
    hit = n_hit(into)
    return (hit > 0) & (share * hit >= F.col(f"{into}.n_words"))
