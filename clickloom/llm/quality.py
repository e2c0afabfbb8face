"""Quality rules whose thresholds follow the documents: quantile sketches per language and source.

A document that passes the base rules is measured in whole numbers (shares in thousandths). A sketch of such a
measure is its count per value, values above 255 cut to their leading eight bits: its quantiles are off by less
than 1 in 128, its size is bounded, and sketches merge by adding counts, so Spark sums them on the map side and a
group of any size never meets in one task. Sketches of a language and source merge to those of the language and
of the whole corpus, which stand in for groups that are too small. A threshold lies beyond the group's outer
quantile by a multiple of its distance from the median; documents are joined with their group's thresholds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickloom.llm.text import SPACE, utf8
from clickloom.operators.lookup import measured_lookup
from clickloom.session import staged

# The symbols and the base rules.
SYMBOLS = b"#*$%&|<>"
WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
# A group of fewer documents takes the thresholds of its language, or of the corpus.
LEAST_GROUP = 100
# Thresholds lie SPREAD times the distance from the median to a quartile beyond that quartile, plus a slack.
QUARTILES, SPREAD = (25, 50, 75), 6
# Measures with their slack, in thousandths; a word may also be too short.
MEASURES = {"symbols": 20, "dup_lines": 400, "repeats": 250, "word_length": 500}
LOW = ("word_length",)
FIELDS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
_COUNTS = T.StructType([T.StructField(f, T.LongType()) for f in FIELDS])
_SPACES = bytes.maketrans(SPACE, b" " * len(SPACE))
_MIX = np.uint64(0x9E3779B97F4A7C15)
CONTINUED = bytes(range(0x80, 0xC0))


def repeated(words: list[bytes], window: int = WINDOW) -> int:
    """How many words lie in windows that occur twice or more in the text."""
    if len(words) <= window:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), dtype=np.uint64, count=len(words))
    n = len(ids) - window + 1
    code = np.zeros(n, dtype=np.uint64)
    for i in range(window):  # equal windows have equal codes
        code = (code ^ ids[i : i + n]) * _MIX
        code ^= code >> np.uint64(29)
    order = np.argsort(code, kind="stable")
    same = code[order[1:]] == code[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n, dtype=bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    at = np.flatnonzero(twice)
    windows = ids[at[:, None] + np.arange(window)]  # exact, in case codes collide
    _, first, total = np.unique(windows, axis=0, return_inverse=True, return_counts=True)
    edges = np.zeros(len(ids) + 1, dtype=np.int64)
    at = at[total[first.ravel()] > 1]
    np.add.at(edges, at, 1)
    np.add.at(edges, at + window, -1)
    return int((np.cumsum(edges)[:-1] > 0).sum())


def counts(data: bytes) -> tuple[int, ...]:
    """The numbers of FIELDS for a text."""
    plain = data.translate(_SPACES)
    words = plain.split()
    inner = sum(map(len, words))
    # A code point has one byte that doesn't continue another; white space is one byte.
    chars = inner - len(data) + len(data.translate(None, CONTINUED))
    lines = [x for x in data.split(b"\n") if x.strip(SPACE)]
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    return len(words), chars, symbols, len(lines), len(lines) - len(set(lines)), repeated(words)


@F.arrow_udf(_COUNTS)
def _counted(texts: pa.Array) -> pa.Array:
    rows = [counts(t) for t in utf8(texts)]
    return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(len(FIELDS))], list(FIELDS))


def counted(text: str | Column) -> Column:
    """A struct of FIELDS; all zero for a null text."""
    return _counted.asNondeterministic()(text)


def base_failed(least: int = LEAST_WORDS, most: int = MOST_REPEATED) -> Column:
    return (F.col("n_words") < least) | (100 * F.col("n_repeat_words") > most * F.col("n_words"))


def measured() -> dict[str, Column]:
    """Each of MEASURES in thousandths; null where there is nothing to measure it on."""
    parts = {"symbols": ("n_symbols", "word_chars"), "dup_lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words"), "word_length": ("word_chars", "n_words")}
    return {name: F.when(F.col(whole) > 0, F.expr(f"1000 * {part} div {whole}")).alias(name) for name, (part, whole) in parts.items()}


def sketch(rows: DataFrame) -> DataFrame:
    """(lang, source, measure, value, n): the sketches of all groups; ``rows`` has the columns lang, source and MEASURES.

    Sketches merge by adding n over equal values.
    """
    pairs = F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).alias("value")) for m in MEASURES))).alias("p")
    told = rows.select("lang", "source", pairs).select("lang", "source", "p.*").where("value IS NOT NULL")
    over = F.greatest(F.length(F.bin("value")) - 8, F.lit(0))
    cut = F.expr("shiftleft(shiftright(value, over), over)")
    told = told.withColumn("over", over).withColumn("value", cut)
    return told.groupBy("lang", "source", "measure", "value").agg(F.count(F.lit(1)).alias("n"))


def quartiles(sketches: DataFrame) -> DataFrame:
    """(level, lang, source, measure, docs, q25, q50, q75) of each group (level 0), language (1) and the corpus (2).

    The coarser levels come from merged sketches; their absent names are empty. A window holds one sketch.
    """
    nothing = F.lit("")
    levels = [(0, F.col("lang"), F.col("source")), (1, F.col("lang"), nothing), (2, nothing, nothing)]
    keys = F.explode(F.array(*(F.struct(F.lit(i).alias("level"), a.alias("lang"), b.alias("source")) for i, a, b in levels))).alias("k")
    merged = sketches.select(keys, "measure", "value", "n").select("k.*", "measure", "value", "n")
    group = ["level", "lang", "source", "measure"]
    merged = merged.groupBy(*group, "value").agg(F.sum("n").alias("n"))
    here = Window.partitionBy(*group)
    below = F.sum("n").over(here.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)).alias("below")
    ranked = merged.select(*group, "value", below, F.sum("n").over(here).alias("docs"))
    reached = [F.min(F.when(100 * F.col("below") >= q * F.col("docs"), F.col("value"))).alias(f"q{q}") for q in QUARTILES]
    return ranked.groupBy(*group).agg(F.max("docs").alias("docs"), *reached)


def thresholds(sketches: DataFrame, least_group: int = LEAST_GROUP, spread: int = SPREAD) -> DataFrame:
    """A row per (lang, source) with columns low_<measure> and high_<measure>; no low threshold is a null."""
    told = staged(quartiles(sketches), "quartiles")
    own, language, corpus = (told.where(F.col("level") == i) for i in range(3))

    def named(df: DataFrame, name: str) -> DataFrame:
        return df.select(*(["lang"] if name == "language" else []), "measure", F.struct("docs", "q25", "q50", "q75").alias(name))

    joined = own.select("lang", "source", "measure", F.struct("docs", "q25", "q50", "q75").alias("own"))
    joined = joined.join(named(language, "language"), ["lang", "measure"]).join(named(corpus, "corpus"), "measure")
    fit = F.when(F.col("own.docs") >= least_group, F.col("own")).when(F.col("language.docs") >= least_group, F.col("language"))
    joined = joined.select("lang", "source", "measure", fit.otherwise(F.col("corpus")).alias("q"))
    columns = []
    for measure, slack in MEASURES.items():
        low = F.col("q.q25") - spread * (F.col("q.q50") - F.col("q.q25")) - slack
        high = F.col("q.q75") + spread * (F.col("q.q75") - F.col("q.q50")) + slack
        mine = F.col("measure") == measure
        columns.append(F.max(F.when(mine, low if measure in LOW else F.lit(None).cast("long"))).alias(f"low_{measure}"))
        columns.append(F.max(F.when(mine, high)).alias(f"high_{measure}"))
    return joined.groupBy("lang", "source").agg(*columns)


def _group(name: str) -> Column:
    """A name as a text that isn't null: absent ones are a group of their own."""
    return F.coalesce(F.concat(F.lit("="), F.col(name).cast("string")), F.lit("?"))


def _judged(rows: DataFrame, least_group: int) -> DataFrame:
    """The written ``rows`` (lang, source, at, FIELDS, ...) with base_failed, kept and beyond (names of measures)."""
    rows = rows.withColumns(measured()).withColumn("base_failed", base_failed())
    limits = thresholds(sketch(rows.where(~F.col("base_failed"))), least_group)
    met = measured_lookup(rows, limits, ["lang", "source"], ["at"])
    outside = [F.when((F.col(m) > F.col(f"high_{m}")) | F.coalesce(F.col(m) < F.col(f"low_{m}"), F.lit(False)), F.lit(m)) for m in MEASURES]
    beyond = F.when(F.col("base_failed"), F.lit("")).otherwise(F.concat_ws(",", *outside))
    met = met.withColumn("beyond", beyond)
    return met.withColumn("kept", ~F.col("base_failed") & (F.col("beyond") == ""))


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", least_group: int = LEAST_GROUP) -> DataFrame:
    """A row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, beyond.

    Null and empty texts have no words and fail the base rules. Null languages and sources are groups of their own.
    Repeated rows give repeated rows and count as often. Documents that fail the base rules don't shape thresholds.
    ``beyond`` names the measures past their thresholds. Other columns aren't read; an empty table gives no rows.
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc"), F.col(f"`{lang}`").alias("lang"), F.col(f"`{source}`").alias("source"), counted(F.col(f"`{text}`")).alias("c"))
    rows = rows.select("doc", _group("lang").alias("lang"), _group("source").alias("source"), F.monotonically_increasing_id().alias("at"), "c.*")
    out = _judged(staged(rows, "measured"), least_group)
    told = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "beyond")
    return out.select(F.col("doc").alias(doc_id), *told)


def filtered(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_group: int = LEAST_GROUP) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns, whatever the names."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    rows = rows.select("row", counted(F.col(f"row.`{text}`")).alias("c"), F.col(f"row.`{lang}`").alias("lang"), F.col(f"row.`{source}`").alias("source"))
    rows = rows.select("row", _group("lang").alias("lang"), _group("source").alias("source"), F.monotonically_increasing_id().alias("at"), "c.*")
    return _judged(staged(rows, "measured"), least_group).where("kept").select("row.*")
