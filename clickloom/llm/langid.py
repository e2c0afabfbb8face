"""Language identification by prediction by partial matching over bytes.

Each language has context trees of orders 0 to ORDER, learned from a bounded sample of labelled texts and
frozen. A byte is coded in its longest known context; where it never followed that context, an escape is
paid and the next shorter context is asked, down to uniform bytes. With escape method C, a context seen n
times with d different successors gives the escape d / (n + d) and a successor seen c times c / (n + d).
As the counts are frozen, the cost of a byte depends on the last ORDER bytes alone, so the cost of every
known context and successor is worked out once for all languages and looked up in compact tables.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickloom.llm.hashing import KeyTable
from clickloom.llm.text import AT_ONCE, UPPER, sample_below, utf8
from clickloom.session import discard, staged

ORDER = 4
# Texts that the trees are learned from, shared evenly among the languages. All texts are scored.
LEARN_ROWS = 4_000
UNKNOWN = "und"
POSITIONS = 1 << 18
LOWER = bytes.maketrans(UPPER, UPPER.lower())
RESULT = T.StructType(
    [
        T.StructField("lang_pred", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("bits", T.DoubleType()),
        T.StructField("n_bytes", T.LongType()),
    ]
)


def _mask(order: int) -> int:
    return (1 << 8 * order) - 1


def _grams(data: bytes, order: int) -> np.ndarray:
    """Each byte with the ``order`` bytes before it as one number; zero bytes stand before the text."""
    flat = np.frombuffer(bytes(order) + data, dtype=np.uint8).astype(np.int64)
    grams = flat[order:].copy()
    for i in range(1, order + 1):
        grams |= flat[order - i : len(flat) - i] << (8 * i)
    return grams


@dataclass
class ContextTrees:
    """Code lengths in bits for every language: dense for order 1, keyed tables above."""

    langs: list[str]
    order: int
    dense: np.ndarray
    costs: list[tuple[KeyTable, np.ndarray]]
    escapes: list[tuple[KeyTable, np.ndarray]]

    @classmethod
    def learn(cls, langs: list[str], counts: list[tuple[np.ndarray, np.ndarray]], order: int = ORDER) -> ContextTrees:
        """``counts``: for each language the distinct grams of order + 1 bytes and how often each occurs."""
        levels = []
        for k in range(order + 1):
            seen = []
            for grams, n in counts:
                keys, inverse = np.unique(grams & _mask(k + 1), return_inverse=True)
                seen.append((keys, np.bincount(inverse, weights=n, minlength=len(keys))))
            levels.append(seen)
        trees = cls(langs, order, np.zeros((0, 0), np.float32), [], [])
        symbols = np.arange(256)
        lower = np.full((256, len(langs)), 8.0)
        lower = _level(levels[0], symbols, lower, 0)[0]
        pairs = np.arange(65536)
        trees.dense = _level(levels[1], pairs, lower[pairs & 255], 1)[0].astype(np.float32)
        below_table, below = None, trees.dense.astype(np.float64)
        for k in range(2, order + 1):
            keys = np.unique(np.concatenate([s[0] for s in levels[k]] or [np.zeros(0, np.int64)]))
            shorter = keys & _mask(k)
            lower = below[shorter] if below_table is None else below[below_table.find(shorter)]
            cost, contexts, escape = _level(levels[k], keys, lower, k)
            below_table, below = KeyTable(keys), cost
            trees.costs.append((below_table, cost.astype(np.float32)))
            trees.escapes.append((KeyTable(contexts), escape.astype(np.float32)))
        return trees

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Code length of each whole text in each language."""
        total = np.zeros((len(texts), len(self.langs)))
        held, size = [], 0
        for i, text in enumerate(texts):
            for at in range(0, len(text), POSITIONS):
                held.append((i, text[max(0, at - self.order) : at + POSITIONS], min(at, self.order)))
                size += min(POSITIONS, len(text) - at)
                if size >= POSITIONS:
                    self._add(total, held)
                    held, size = [], 0
        self._add(total, held)
        return total

    def _add(self, total: np.ndarray, held: list[tuple[int, bytes, int]]) -> None:
        grams, rows, starts, n = [], [], [], 0
        for i, text, skip in held:
            part = _grams(text.translate(LOWER), self.order)[skip:]
            if len(part):
                grams.append(part)
                rows.append(i)
                starts.append(n)
                n += len(part)
        if n:
            cost = self._costs(np.concatenate(grams))
            np.add.at(total, np.array(rows), np.add.reduceat(cost, np.array(starts), axis=0, dtype=np.float64))

    def _costs(self, grams: np.ndarray) -> np.ndarray:
        out = np.zeros((len(grams), len(self.langs)), dtype=np.float32)
        left = np.arange(len(grams))
        for k in range(self.order, 1, -1):
            table, cost = self.costs[k - 2]
            mine = grams[left]
            found = table.find(mine & _mask(k + 1))
            hit = found >= 0
            out[left[hit]] += cost[found[hit]]
            left, mine = left[~hit], mine[~hit]
            contexts, escape = self.escapes[k - 2]
            known = contexts.find((mine >> 8) & _mask(k))
            at = known >= 0
            out[left[at]] += escape[known[at]]
        out[left] += self.dense[grams[left] & _mask(2)]
        return out


def _level(seen, keys: np.ndarray, lower: np.ndarray, k: int):
    """Costs of ``keys`` at order k over the costs of the next shorter context; contexts and their escapes."""
    contexts = np.unique(np.concatenate([np.unique(s[0] >> 8) for s in seen] or [np.zeros(0, np.int64)]))
    escape = np.zeros((len(contexts), len(seen)))
    cost = lower.copy()
    for j, (grams, n) in enumerate(seen):
        if not len(grams):
            continue
        own, inverse = np.unique(grams >> 8, return_inverse=True)
        total, kinds = np.bincount(inverse, weights=n), np.bincount(inverse)
        escape[np.searchsorted(contexts, own), j] = np.log2((total + kinds) / kinds)
        at = np.minimum(np.searchsorted(own, keys >> 8), len(own) - 1)
        known = own[at] == keys >> 8
        cost[known, j] += np.log2((total + kinds) / kinds)[at[known]]
        cost[np.searchsorted(keys, grams), j] = np.log2((total + kinds)[inverse] / n)
    return cost, contexts, escape


def learn(
    docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", rows: int = LEARN_ROWS, order: int = ORDER
) -> ContextTrees:
    """Context trees of every language from about ``rows`` texts, or from all if there are fewer.

    A language with fewer texts than its even share gives all of them. Rows without a language are left out.
    """
    named = docs.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.col(key).alias("key"))
    sizes = {r["lang"]: r["count"] for r in named.groupBy("lang").count().collect()}  # one row per language
    share = math.ceil(rows / max(len(sizes), 1))
    picked = F.lit(False)
    for name, n in sizes.items():
        picked = picked | ((F.col("lang") == name) & sample_below(F.col("key"), n, share))

    def count(batches):
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), utf8(batch.column(1))
            for name in set(names):
                parts = [_grams(t.translate(LOWER), order) for x, t in zip(names, texts, strict=True) if x == name]
                grams, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(grams), pa.string()), pa.array(grams), pa.array(n)], ["lang", "gram", "n"])

    grams = named.where(picked).select("lang", "text").mapInArrow(count, "lang string, gram long, n long")
    grams = staged(grams.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    langs = sorted(sizes)
    counts = []
    for name in langs:  # as many rows as the sampled texts have bytes, at most
        mine = grams.where(F.col("lang") == name).select("gram", "n").toArrow()
        counts.append((mine["gram"].to_numpy().astype(np.int64), mine["n"].to_numpy().astype(np.float64)))
    discard(grams)
    return ContextTrees.learn(langs, counts, order)


def predictor(spark, trees: ContextTrees):
    """A function of a text column that gives (lang_pred, score, bits, n_bytes)."""
    shared = spark.sparkContext.broadcast(trees)  # as large as the bounded sample allows

    @F.arrow_udf(RESULT)
    def predict(texts: pa.Array) -> pa.Array:
        model = shared.value
        langs, scores, best, sizes = [], [], [], []
        for at in range(0, len(texts), AT_ONCE):
            data = utf8(texts.slice(at, AT_ONCE))
            sizes += [len(t) for t in data]
            for text, row in zip(data, model.bits(data), strict=True):
                if not model.langs or not any(c.isalpha() for c in text.decode()):
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    best.append(8.0 * len(text))
                    continue
                j = int(np.argmin(row))
                langs.append(model.langs[j])
                scores.append(float(1 / np.exp2(np.minimum(row[j] - row, 0)).sum()))
                best.append(float(row[j]))
        columns = [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(best, pa.float64()), pa.array(sizes, pa.int64())]
        return pa.StructArray.from_arrays(columns, names=RESULT.fieldNames())

    return predict.asNondeterministic()


def with_language(docs: DataFrame, trees: ContextTrees, text: str = "text", into: str = "language") -> DataFrame:
    """``docs`` with a struct ``into``: lang_pred, score, bits and n_bytes of each whole text.

    ``lang_pred`` is the language with the shortest code, the first by name of equal ones, and ``score`` its
    share of the probability that all languages give the text. A null text, a text without a letter, or any
    text if nothing was learned, is ``und`` with score 0 and eight bits a byte.
    """
    return docs.withColumn(into, predictor(docs.sparkSession, trees)(F.col(text)))


def is_language(into: str = "language") -> Column:
    """False for texts without a letter and for those no learned language codes in less than eight bits a byte."""
    r = F.col(into)
    return (r["lang_pred"] != UNKNOWN) & (r["bits"] < 8.0 * r["n_bytes"])
