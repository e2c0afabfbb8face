"""Spelling variants by a bit-sliced position index.

A cell of words has a bitset for each position and letter: which of its words hold that letter there. A word is
compared with all words of the cell at once, letter by letter, by word-parallel recurrences over bitsets: words
that agree so far, words with one letter replaced, and, with positions shifted by one, words with one letter less
or one more. What is left at its end, at the right length, differs by exactly one letter.

Two words that differ by one letter share their first or their last half: the error lies in one of them at most.
Words go to cells by these halves, for pairs with themselves and the next longer ones, so that every pair meets
once; a half that very many words have is cut into pieces, and pairs of pieces are cells of their own.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.llm.text import UPPER, utf8
from clickloom.operators.lookup import measured_lookup
from clickloom.session import discard, staged

LEAST_LETTERS, LEAST_COUNT, RATIO, DELETED = 7, 2, 10, 31
# Fixed value: the letters of a run.
LETTERS = "A-Za-zÀ-ÿ"
ALPHABET = 26 + 64
_LOWER = bytes.maketrans(UPPER, UPPER.lower())
# Words to a cell, and 64-bit pieces of a bitset times words that ask at once.
CELL, BATCH = 4_096, 1 << 14
# Counts that a task keeps before it hands them on, and bytes of a text that are read at once.
KEPT, PIECE = 200_000, 1 << 20
_FOUND = "word string, n_near long, near_n long, near string"


def counted(text: bytes, doc_id: str, runs: re.Pattern, least: int, counts: Counter) -> None:
    """Add the words of a text, with the letter that the rule takes out of some of them."""
    lower, base, own, start = text.translate(_LOWER), zlib.crc32(f"{doc_id}:".encode()), Counter(), 0
    while start < len(lower):
        stop = lower.find(b" ", start + PIECE)
        stop = len(lower) if stop < 0 else stop
        own.update(runs.findall(lower[start:stop].decode()))
        start = stop
    for run, n in own.items():
        h = zlib.crc32(run.encode(), base)
        if h % DELETED == 0:
            run = run[: (at := h % len(run))] + run[at + 1 :]
            if len(run) < least:
                continue
        counts[run] += n


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST_LETTERS, often: int = LEAST_COUNT) -> DataFrame:
    """(word, n): the words of all texts with at least ``least`` letters and ``often`` occurrences.

    Null and empty texts have none; a null id counts as an empty one.
    """
    runs = re.compile(f"[{LETTERS}]{{{least},}}")  # maximal, as a run of fewer letters has no such part

    def count(batches):
        counts: Counter = Counter()
        for batch in batches:
            for own, data in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                counted(data, own or "", runs, least, counts)
                if len(counts) > KEPT:
                    yield _counts(counts)
                    counts = Counter()
        yield _counts(counts)

    rows = docs.select(F.col(f"`{doc_id}`").cast("string"), F.col(f"`{text}`")).mapInArrow(count, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= often)


def _counts(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])


class PositionIndex:
    """Bitsets over words sorted by length: which of them hold a letter at a position."""

    def __init__(self, words: list[str]):
        self.lengths, flat, at = _letters(words)
        place, holder = at * ALPHABET + flat, np.repeat(np.arange(len(words)), self.lengths)
        self.slots, row = np.unique(place, return_inverse=True)
        width = -(-len(words) // 64)
        self.bits = np.zeros((len(self.slots) + 1, width), dtype=np.uint64)  # the last row stays empty
        np.bitwise_or.at(self.bits, (row, holder >> 6), np.uint64(1) << (holder & 63).astype(np.uint64))

    def rows(self, at: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """The row of each position and letter; the empty one where no word holds it."""
        place = at * ALPHABET + letters
        row = np.minimum(np.searchsorted(self.slots, place), max(len(self.slots) - 1, 0))
        return np.where((at >= 0) & (self.slots[row] == place), row, len(self.slots))

    def near(self, letters: np.ndarray):
        """(row, word) of asked words of one length, a row of letters each, and the words with exactly one error."""
        n = letters.shape[1]
        first, last = np.searchsorted(self.lengths, (n - 1, n + 2))
        if first == last:
            return
        left, right = first >> 6, -(-last // 64)
        same, less, more = (self._of_length(n + d, left, right) for d in (0, -1, 1))
        at = np.arange(n)
        places = [self.rows(at[None] + d, letters) for d in (-1, 0, 1)]
        step = max(1, BATCH // (right - left))
        for start in range(0, len(letters), step):
            before, here, after = (p[start : start + step] for p in places)
            agree = np.full((len(here), right - left), ~np.uint64(0))
            replaced, dropped, added = (np.zeros_like(agree) for _ in range(3))
            for i in range(n):
                hold = self.bits[here[:, i], left:right]
                replaced = (replaced & hold) | (agree & ~hold)
                dropped = (dropped & self.bits[before[:, i], left:right]) | agree
                added = (added | agree) & self.bits[after[:, i], left:right]
                agree &= hold
                if i % 8 == 7 and not (agree.any() or replaced.any() or dropped.any() or added.any()):
                    break
            found = (replaced & same) | (dropped & less) | ((added | agree) & more)
            row, piece = np.nonzero(found)
            if len(row):
                bits = np.unpackbits(found[row, piece].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                k, bit = np.nonzero(bits)
                yield start + row[k], (left + piece[k]) * 64 + bit

    def _of_length(self, length: int, left: int, right: int) -> np.ndarray:
        own = np.zeros((right - left) * 64, dtype=np.uint8)
        at = self.lengths[left * 64 : right * 64] == length
        own[: len(at)] = at
        return np.packbits(own, bitorder="little").view(np.uint64)


def _letters(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths, and letter numbers and positions of all words in a row."""
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    points = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    flat = np.where(points < 128, points - ord("a"), points - 0xC0 + 26)
    return lengths, flat, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def _compared(cell: pa.Table) -> pa.Table:
    """For each asking word of a cell its number of near words and the one of largest n, ties to the smallest."""
    words = cell["word"].to_pylist()
    order = sorted(range(len(words)), key=lambda i: len(words[i]))
    words = [words[i] for i in order]
    group, side, n, role = (cell[c].to_numpy()[order] for c in ("pairs", "side", "n", "role"))
    halves, starts = {}, {}  # exact numbers of what words share
    own = [(g, s, w[: g // 2] if s == 0 else w[-(g // 2) :]) for g, s, w in zip(group.tolist(), side.tolist(), words, strict=True)]
    half = np.array([halves.setdefault(x, len(halves)) for x in own], dtype=np.int64)
    start = np.array([starts.setdefault(w[: g // 2], len(starts)) for g, w in zip(group.tolist(), words, strict=True)], dtype=np.int64)
    held, asks = np.flatnonzero(role & 1), np.flatnonzero(role & 2)
    index = PositionIndex([words[i] for i in held])
    lengths, flat, _ = _letters([words[i] for i in asks])
    begins = np.cumsum(lengths) - lengths
    whole = np.array([len(w) for w in words], dtype=np.int64)
    pairs = []
    for length in np.unique(lengths):
        mine = np.flatnonzero(lengths == length)
        for row, word in index.near(flat[begins[mine][:, None] + np.arange(length)]):
            a, b = asks[mine[row]], held[word]
            meets = (half[a] == half[b]) & (np.minimum(whole[a], whole[b]) == group[a]) & ((side[a] == 0) | (start[a] != start[b]))
            pairs.append((a[meets], b[meets]))
    a, b = (np.concatenate([p[i] for p in pairs]) if pairs else np.zeros(0, np.int64) for i in (0, 1))
    rank = np.empty(len(words), dtype=np.int64)
    rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    best = np.lexsort((rank[b], -n[b], a))
    a, b = a[best], b[best]
    asked, first, total = np.unique(a, return_index=True, return_counts=True)
    return pa.table(
        {
            "word": pa.array([words[i] for i in asked], pa.string()),
            "n_near": pa.array(total.astype(np.int64)),
            "near_n": pa.array(n[b[first]].astype(np.int64)),
            "near": pa.array([words[i] for i in b[first]], pa.string()),
        }
    )


def near_words(words: DataFrame, least: int = LEAST_LETTERS, cell: int = CELL) -> DataFrame:
    """(word, n_near, near_n, near) for each word that has near words, ``near`` being the one of largest n.

    ``words`` is a written table of distinct words with their counts n.
    """
    length = F.char_length("word")

    def halves(pairs: Column) -> list[Column]:
        half = F.floor(pairs / 2).cast("int")
        ends = (F.substring(F.col("word"), F.lit(1), half), F.right(F.col("word"), half))
        return [F.struct(pairs.alias("pairs"), F.lit(i).alias("side"), F.xxhash64(pairs, F.lit(i), end).alias("key")) for i, end in enumerate(ends)]

    meets = F.concat(F.array(*halves(length)), F.when(length > least, F.array(*halves(length - 1))).otherwise(F.array().cast("array<struct<pairs:int,side:int,key:bigint>>")))
    entries = words.select("word", "n", F.explode(meets).alias("e")).select("word", "n", "e.*")
    shared = entries.groupBy("key").agg(F.count(F.lit(1)).alias("held"))
    total = shared.agg(F.sum("held")).first()[0] or 0
    cells = max(1, -(-total // cell))
    large = shared.where(F.col("held") > cell).select("key", F.ceil(F.col("held") / cell).cast("int").alias("pieces"))
    entries = measured_lookup(entries, large, ["key"], ["word"])
    # A word of a large half is held by its piece's cells and asks in those of all pieces.
    own, pieces = F.pmod(F.xxhash64(F.lit(1), "word"), F.col("pieces")).cast("int"), F.sequence(F.lit(0), F.col("pieces") - 1)
    role = lambda other, value: F.when(other == own, 3).otherwise(value)
    held = F.transform(pieces, lambda j: F.struct(own.alias("piece"), j.alias("asked"), role(j, 1).alias("role")))
    asks = F.transform(F.filter(pieces, lambda j: j != own), lambda j: F.struct(j.alias("piece"), own.alias("asked"), F.lit(2).alias("role")))
    alone = F.array(F.struct(F.lit(-1).alias("piece"), F.lit(-1).alias("asked"), F.lit(3).alias("role")))
    place = F.when(F.col("pieces").isNull(), F.pmod(F.col("key"), F.lit(cells))).otherwise(F.col("key"))
    dealt = entries.select("word", "n", "pairs", "side", place.alias("cell"), F.explode(F.when(F.col("pieces").isNull(), alone).otherwise(F.concat(held, asks))).alias("p"))
    found = dealt.select("word", "n", "pairs", "side", "cell", "p.*").groupBy("cell", "piece", "asked").applyInArrow(_compared, _FOUND)
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    found = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    return found.select("word", "n_near", (-F.col("best.less")).alias("near_n"), F.col("best.near").alias("near"))


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST_LETTERS, ratio: int = RATIO, cell: int = CELL) -> DataFrame:
    """A row per word: word, form, root, n, n_near and form_n.

    A word's form is its near word of largest n (ties: smallest in code-point order) if that n is at least ``ratio``
    times its own; root follows forms to the last. Texts that are null or hold no word of ``least`` letters add
    nothing, a null id counts as an empty one, repeated rows count each, other columns aren't read, and a table
    without words gives no rows. A run has no upper length. With a ratio of 1 or less forms could go in circles.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more")
    words = staged(vocabulary(docs, doc_id, text, least), "words")
    near = near_words(words, least, cell)
    formed = F.col("near_n") >= ratio * F.col("n")
    told = words.join(near.hint("merge"), "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(formed, F.col("near")).alias("form"),
        F.when(formed, F.col("near_n")).alias("form_n"),
    )
    told = staged(told, "forms")
    steps = staged(told.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    most = words.agg(F.max("n")).first()[0] or 0
    # Each form has at least `ratio` times the count, so chains are short; each round doubles the steps made.
    longest = int(math.log(max(most, 1), ratio)) + 1
    for _ in range(math.ceil(math.log2(longest))):
        further = steps.select(F.col("word").alias("root"), F.col("root").alias("last"))
        after = staged(steps.join(further.hint("merge"), "root", "left").select("word", F.coalesce("last", "root").alias("root")), "roots")
        discard(steps)
        steps = after
    discard(words)
    return told.join(steps.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
