"""Vocabularies of any size as one dictionary table (feature, token, id).

Ids are positions in each feature's sorted list of tokens, as with a literal list, but neither the list nor the
lookup passes through the driver: tokens are numbered by a global order over value ranges, and all features of a
row meet the dictionary in one lookup, broadcast if it was counted to be small, else with hot tokens salted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.operators.lookup import BROADCAST_ROWS, measured_lookup
from clickloom.operators.order import with_row_index
from clickloom.session import discard, staged

# Bytes of a token that its place in the order is found by; tokens that share them are ordered in full.
_BYTES = 5


def _numbered(tokens: Column, number: int) -> Column:
    pairs = F.transform(tokens, lambda t: F.struct(F.lit(number).alias("number"), t.alias("token")))
    return F.coalesce(pairs, F.array().cast("array<struct<number:int,token:string>>"))


def build(df: DataFrame, tokens: dict[str, Column], least_count: int = 1) -> DataFrame:
    """(feature, token, id, n): every token of each feature's array that occurs ``least_count`` times or more.

    Null and empty tokens have no id. Ids run from 0 in code-point order. The result is a written table.
    """
    features = list(tokens)
    pairs = F.concat(*(_numbered(tokens[f], k) for k, f in enumerate(features)))
    counted = df.select(F.explode(pairs).alias("p")).select("p.*").where("token IS NOT NULL AND token <> ''")
    counted = counted.groupBy("number", "token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)
    first = F.rpad(F.hex(F.substring(F.col("token").cast("binary"), 1, _BYTES)), 2 * _BYTES, "0")
    key = F.col("number") * F.lit(1 << 8 * _BYTES) + F.conv(first, 16, 10).cast("bigint")
    counted = staged(counted.withColumn("key", key), "tokens")
    indexed = staged(with_row_index(counted, "key", "place", ties=("token",)), "tokens")
    starts = indexed.groupBy("number").agg(F.min("place").alias("start"))  # a row for each feature
    names = F.element_at(F.array(*(F.lit(f) for f in features)), F.col("number") + 1)
    out = indexed.join(F.broadcast(starts), "number").select(names.alias("feature"), "token", (F.col("place") - F.col("start")).alias("id"), "n")
    out = staged(out, "vocabulary")
    discard(counted, indexed)
    return out


def with_vocabulary_ids(
    rows: DataFrame, row_id: str, tokens: dict[str, Column], dictionary: DataFrame, max_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """(row id, one array of ids per feature): the ids of the known tokens in the order of the array.

    Tokens that aren't in the dictionary are dropped, as are null ones. Every row comes back; without known tokens
    its arrays are empty. ``rows`` is read once, and its pairs are exchanged once by row (and once more by token
    if the dictionary is too large to broadcast).
    """
    features = list(tokens)

    def placed(feature: str) -> Column:
        return F.transform(tokens[feature], lambda t, at: F.struct(F.lit(feature).alias("_feature"), t.alias("_token"), at.alias("_at")))

    none = F.array().cast("array<struct<_feature:string,_token:string,_at:int>>")
    pairs = rows.select(row_id, F.concat(*(F.coalesce(placed(f), none) for f in features)).alias("_pairs"))
    pairs = pairs.select(row_id, F.inline_outer("_pairs"))
    table = dictionary.select(F.col("feature").alias("_feature"), F.col("token").alias("_token"), F.col("id").alias("_known"))
    found = measured_lookup(pairs, table, ["_feature", "_token"], [row_id], max_rows)

    def ids(feature: str) -> Column:
        own = (F.col("_feature") == feature) & F.col("_known").isNotNull()
        listed = F.array_sort(F.collect_list(F.when(own, F.struct("_at", "_known"))))
        return F.transform(listed, lambda p: p["_known"]).alias(feature)

    return found.groupBy(row_id).agg(*(ids(f) for f in features))
