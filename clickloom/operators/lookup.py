"""Skew-proof lookups of a keyed table (rates, weights, embeddings) from a large row set.

Three ways, from cheapest to most general:

* ``broadcast_lookup`` when a caller proves that the table is small;
* ``measured_lookup``, which counts a materialised table first and picks one of the other two;
* ``salted_lookup``, a shuffle join in which the few keys that could overload a task are split.

With P shuffle partitions at most 2P keys can hold more than 1/(2P) of all rows each. Those 2P keys
are found by a map-side-combined count and a top-k, so the list that is broadcast has a fixed bound.
Each hot key gets salts in proportion to its share, at most 3P in total; its table row is repeated
once per salt. All other keys keep one partition slot. No row is dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickloom.session import shuffle_partitions, staged

# A broadcast relation of this many narrow rows is some 100-200 MB per executor.
BROADCAST_ROWS = 2_000_000
# And so much text in the keys of all tables that one plan broadcasts.
BROADCAST_BYTES = 64_000_000

SALT = "_salt"
SALTS = "_salts"


def hot_keys(rows: DataFrame, keys: list[str], count: Column | None = None) -> DataFrame:
    """The keys that may need splitting, with their number of salts (at most 2P rows).

    ``count`` is given when ``rows`` is already aggregated and carries the number of rows per key.
    """
    parts = shuffle_partitions(rows.sparkSession)
    weight = F.count(F.lit(1)) if count is None else F.sum(count)
    top = (
        rows.where(_all_present(keys))
        .groupBy(*keys)
        .agg(weight.cast("double").alias("_n"))
        .orderBy(F.desc("_n"), *keys)
        .limit(2 * parts)
    )
    # The window runs over the 2P rows of the top list only.
    share = F.col("_n") / F.sum("_n").over(Window.partitionBy(F.lit(0)))
    return top.select(*keys, F.ceil(share * parts).cast("int").alias(SALTS))


def salted_lookup(
    rows: DataFrame,
    table: DataFrame,
    keys: list[str],
    spread: list[str],
    hot: DataFrame | None = None,
    how: str = "left",
    tasks: int | None = None,
) -> DataFrame:
    """Join ``rows`` with ``table`` (unique on ``keys``); ``spread`` are columns that tell rows apart.

    Both are dealt to ``tasks`` tasks if that is given, else to as many as the session asks for.
    """
    parts = shuffle_partitions(rows.sparkSession)
    hot = hot_keys(rows, keys) if hot is None else hot
    hot = F.broadcast(hot)  # at most 2P rows
    slot = F.xxhash64(*spread)
    salts = F.when(_all_present(keys), F.coalesce(F.col(SALTS), F.lit(1))).otherwise(F.lit(parts))
    salted_rows = rows.join(hot, keys, "left").withColumn(SALT, F.pmod(slot, salts).cast("int")).drop(SALTS)
    salted_table = (
        table.join(hot, keys, "left")
        .withColumn(SALT, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(SALTS), F.lit(1)) - 1)))
        .drop(SALTS)
    )
    if tasks is not None:
        salted_rows, salted_table = (df.repartition(tasks, *keys, SALT) for df in (salted_rows, salted_table))
    return salted_rows.join(salted_table, [*keys, SALT], how).drop(SALT)


def broadcast_lookup(rows: DataFrame, table: DataFrame, keys: list[str], max_rows: int, how: str = "left") -> DataFrame:
    """Map-side join for a table that the caller knows to have at most ``max_rows`` rows."""
    if max_rows > BROADCAST_ROWS:
        raise ValueError(f"{max_rows} rows is above the broadcast bound of {BROADCAST_ROWS}")
    return rows.join(F.broadcast(table), keys, how)


def bounded_lookup(
    rows: DataFrame,
    table: DataFrame,
    keys: list[str],
    spread: list[str],
    max_rows: int | None,
    hot: DataFrame | None = None,
    how: str = "left",
    tasks: int | None = None,
) -> DataFrame:
    """Broadcast when ``max_rows`` (for example a spec's dimension) proves it safe, else salt."""
    if max_rows is not None and max_rows <= BROADCAST_ROWS:
        return broadcast_lookup(rows, table, keys, max_rows, how)
    return salted_lookup(rows, table, keys, spread, hot, how, tasks)


def measured_lookup(
    rows: DataFrame,
    table: DataFrame,
    keys: list[str],
    spread: list[str],
    max_rows: int = BROADCAST_ROWS,
    count: Column | None = None,
    how: str = "left",
) -> DataFrame:
    """Materialise ``table``, count it, and broadcast it only if it has at most ``max_rows`` rows."""
    stored = staged(table, "lookup")
    if stored.count() <= max_rows:
        return rows.join(F.broadcast(stored), keys, how)
    hot = hot_keys(stored, keys, count) if count is not None else None
    return salted_lookup(rows, stored, keys, spread, hot, how)


def _all_present(keys: list[str]) -> Column:
    present = F.col(keys[0]).isNotNull()
    for key in keys[1:]:
        present = present & F.col(key).isNotNull()
    return present
