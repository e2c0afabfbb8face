"""Sparse wide input, weight lookup, embedding lookup and dense deep input."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.functions import categorical as cat
from clickloom.functions.arrays import let
from clickloom.functions.clean import split_multivalue
from clickloom.functions.numeric import scale
from clickloom.operators.lookup import bounded_lookup
from clickloom.spec import Continuous, Cross, HashBucket, Identity, ModelSpec, Vocab


def _value(name: str) -> str:
    return f"_value_{name}"


def _first_id(name: str) -> str:
    return f"_first_id_{name}"


def with_values(df: DataFrame, spec: ModelSpec, columns: list) -> DataFrame:
    """Add per feature what ids derive from: the tokens of a text, or the id of a number.

    Several ids use each of these columns, so Spark keeps them in a projection of their own and
    splits a text once per row. The same holds for the vocabulary position of a first token.
    """
    names = sorted({m for c in columns for m in (c.members if isinstance(c, Cross) else (c.name,))})

    def value(name: str) -> Column:
        used = spec.feature(name)
        if isinstance(used, Identity):
            return cat.identity_id(F.col(name), used.size)
        if isinstance(used, Continuous):
            return cat.bucketize(F.col(name), list(used.boundaries))
        return _text_tokens(spec, name)

    valued = df.withColumns({_value(name): value(name) for name in names})
    first = {
        _first_id(c.name): cat.vocab_id(F.get(_value(c.name), 0), list(c.values)) for c in columns if isinstance(c, Vocab)
    }
    return valued.withColumns(first) if first else valued


def _is_text(spec: ModelSpec, name: str) -> bool:
    return isinstance(spec.feature(name), (HashBucket, Vocab))


def _block(
    spec: ModelSpec, column, method: str, one: Callable[[Column], Column], many: Callable[[Column], Column]
) -> Column:
    """Array built from the ids of one column.

    ``one`` builds it from a single id and ``many`` from an array of ids. Nearly all fields hold one
    token, for which plain generated code does and no array function has to be interpreted.
    """
    if isinstance(column, Cross):
        return _cross_block(spec, column, method, one, many)
    value = F.col(_value(column.name))
    if isinstance(column, HashBucket):
        single = one(cat.hash_bucket(F.get(value, 0), column.size, method))
        return F.when(F.size(value) == 1, single).otherwise(many(cat.hash_bucket_tokens(value, column.size, method)))
    if isinstance(column, Vocab):
        known = F.col(_first_id(column.name))
        single = F.when(known >= 0, one(known)).otherwise(F.slice(one(known), 1, 0))
        return F.when(F.size(value) == 1, single).otherwise(many(cat.vocab_id_tokens(value, list(column.values))))
    return one(value)


def _cross_block(spec: ModelSpec, cross: Cross, method: str, one, many) -> Column:
    texts = [m for m in cross.members if _is_text(spec, m)]

    def single(name: str) -> Column:
        value = F.col(_value(name))
        return F.get(value, 0) if name in texts else value.cast("string")

    def tokens(name: str) -> Column:
        value = F.col(_value(name))
        return value if name in texts else F.array(value.cast("string"))

    block = one(cat.cross_hash([single(m) for m in cross.members], cross.size, method))
    if not texts:
        return block
    plain = reduce(lambda a, b: a & b, [F.size(_value(name)) == 1 for name in texts])
    product = cat.cross_hash_tokens([tokens(m) for m in cross.members], cross.size, method)
    return F.when(plain, block).otherwise(many(product))


def with_column_ids(df: DataFrame, spec: ModelSpec, columns: dict, method: str = "xxhash64") -> DataFrame:
    """Add, per output name, the array of ids of one column within its own range."""
    valued = with_values(df, spec, list(columns.values()))
    blocks = {out: _block(spec, column, method, F.array, lambda ids: ids) for out, column in columns.items()}
    return valued.select(*df.columns, *[block.alias(out) for out, block in blocks.items()])


def _wide_columns(spec: ModelSpec) -> list[tuple]:
    offsets = {slot.name: slot.offset for slot in spec.wide_slots()}
    return [(c, F.lit(offsets[c.name]).cast("bigint")) for c in [*spec.features, *spec.crosses] if c.size]


def with_wide_ids(df: DataFrame, spec: ModelSpec, method: str = "xxhash64", out: str = "ids") -> DataFrame:
    """Add all wide ids of a row in the shared id space."""

    def shifted(column, offset: Column) -> Column:
        return _block(
            spec, column, method, lambda i: F.array(i + offset), lambda ids: F.transform(ids, lambda i: i + offset)
        )

    columns = _wide_columns(spec)
    valued = with_values(df, spec, [c for c, _ in columns])
    return valued.select(*df.columns, F.concat(*[shifted(c, offset) for c, offset in columns]).alias(out))


def wide_input(df: DataFrame, spec: ModelSpec, keep: list[str], method: str = "xxhash64") -> DataFrame:
    """Long sparse input: one row per id and row, with the number of times the id occurs.

    Columns own disjoint id ranges, so repeats are counted within each column's few ids and no
    shuffle is needed.
    """

    def pair(i: Column, value: Column) -> Column:
        return F.struct(i.alias("idx"), value.alias("value"))

    def counted(column, offset: Column) -> Column:
        def count(ids: Column, i: Column) -> Column:
            return F.size(F.filter(ids, lambda other: other == i)).cast("double")

        def several(ids: Column) -> Column:
            return F.transform(F.array_distinct(ids), lambda i: pair(i + offset, count(ids, i)))

        return _block(
            spec, column, method, lambda i: F.array(pair(i + offset, F.lit(1.0))), lambda ids: let(ids, several)
        )

    columns = _wide_columns(spec)
    valued = with_values(df, spec, [c for c, _ in columns])
    pairs = valued.select(*keep, F.concat(*[counted(c, offset) for c, offset in columns]).alias("_pairs"))
    # The array is a column of its own so that it is built by generated code; an outer inline adds no
    # filter that would build it again.
    return pairs.select(*keep, F.inline_outer("_pairs")).where(F.col("idx").isNotNull())


def wide_logit(
    rows: DataFrame, weights: DataFrame, row_id: str, ids: str, max_ids: int | None, bias: float = 0.0, out: str = "logit"
) -> DataFrame:
    """Sum of the weights of each row's ids plus the bias; ids without a weight count 0.

    ``max_ids`` is the number of ids the spec allows, which bounds the weight table.
    """
    pairs = rows.select(row_id, F.explode_outer(ids).alias("idx"))
    found = bounded_lookup(pairs, weights.select("idx", "w"), ["idx"], [row_id], max_ids)
    return found.groupBy(row_id).agg((F.coalesce(F.sum("w"), F.lit(0.0)) + F.lit(bias)).alias(out))


def embedding_mean(
    rows: DataFrame, table: DataFrame, row_id: str, ids: str, width: int, max_ids: int | None, out: str = "embedded"
) -> DataFrame:
    """Mean of the vectors of each row's ids; a row without ids gets zeros.

    ``table`` has columns ``idx`` and ``vector``.
    """
    pairs = rows.select(row_id, F.explode_outer(ids).alias("idx"))
    bound = None if max_ids is None else narrow_rows(max_ids, width)
    found = bounded_lookup(pairs, table.select("idx", "vector"), ["idx"], [row_id], bound)
    mean = [F.coalesce(F.avg(F.get("vector", i).cast("double")), F.lit(0.0)) for i in range(width)]
    return found.groupBy(row_id).agg(F.array(*mean).alias(out))


def deep_input(
    rows: DataFrame,
    spec: ModelSpec,
    row_id: str,
    tables: dict[str, DataFrame],
    method: str = "xxhash64",
    out: str = "deep",
) -> DataFrame:
    """Dense input per row: scaled numbers, hot vectors and mean embeddings in spec order.

    ``tables`` maps each embedded column to its (idx, vector) table. All embedded columns share one
    lookup, keyed by column number and id, however many there are. Hot columns travel as ids and become
    vectors after the last exchange; looked-up vectors are dealt by row once for all that follows.
    """
    columns = {c.name: c for c in [*spec.features, *spec.crosses]}
    slots = spec.deep_slots()
    embedded = [s for s in slots if s.how == "embedding"]
    number = {slot.name: i for i, slot in enumerate(embedded)}
    dense = {slot.name: f"_dense_{i}" for i, slot in enumerate(slots) if slot.how != "embedding"}
    hot = {dense[s.name]: columns[s.name] for s in slots if s.how == "hot"}

    def carried(slot) -> Column:
        column = columns[slot.name]
        return scale(F.col(slot.name), column.scale, column.params) if slot.how == "number" else F.col(dense[slot.name])

    def block(slot) -> Column:
        if slot.how == "number":
            return F.array(F.col(dense[slot.name]))
        if slot.how == "hot":
            return cat.multi_hot(F.col(dense[slot.name]), columns[slot.name].size)
        mean_of_slot = F.slice(F.try_element_at("_means", F.lit(number[slot.name])), 1, slot.width)
        return F.coalesce(mean_of_slot, F.array_repeat(F.lit(0.0), slot.width))

    base = with_column_ids(rows, spec, hot, method).select(
        row_id, *[carried(s).alias(dense[s.name]) for s in slots if s.name in dense]
    )
    if not embedded:
        return base.select(row_id, F.concat(*[block(s) for s in slots]).alias(out))

    tagged_ids = with_column_ids(rows, spec, {f"_ids_{i}": columns[s.name] for i, s in enumerate(embedded)}, method)

    def tagged(i: int) -> Column:
        return F.transform(f"_ids_{i}", lambda idx: F.struct(F.lit(i).alias("slot"), idx.alias("idx")))

    pairs = tagged_ids.select(row_id, F.concat(*[tagged(i) for i in range(len(embedded))]).alias("_pairs"))
    pairs = pairs.select(row_id, F.inline_outer("_pairs")).where(F.col("idx").isNotNull())
    table = reduce(
        DataFrame.unionByName,
        [tables[s.name].select(F.lit(number[s.name]).alias("slot"), "idx", "vector") for s in embedded],
    )
    widest = max(s.width for s in embedded)
    bound = sum(narrow_rows(columns[s.name].size, s.width) for s in embedded)
    found = bounded_lookup(pairs, table, ["slot", "idx"], [row_id], bound).repartition(row_id)
    mean = [F.coalesce(F.avg(F.get("vector", i).cast("double")), F.lit(0.0)) for i in range(widest)]
    means = found.groupBy(row_id, "slot").agg(F.array(*mean).alias("mean"))
    packed = means.groupBy(row_id).agg(F.map_from_entries(F.collect_list(F.struct("slot", "mean"))).alias("_means"))

    return base.join(packed, row_id, "left").select(row_id, F.concat(*[block(s) for s in slots]).alias(out))


def dimension_report(spark, spec: ModelSpec) -> DataFrame:
    """Width of every column in the wide and deep input, one row per feature or cross."""
    wide = {s.name: s.size for s in spec.wide_slots()}
    deep = {s.name: s.width for s in spec.deep_slots()}
    rows = [(c.name, wide.get(c.name, 0), deep.get(c.name, 0)) for c in [*spec.features, *spec.crosses]]
    return spark.createDataFrame(rows, "column string, wide_width bigint, deep_width bigint")


def narrow_rows(ids: int, width: int) -> int:
    """Size of an embedding table, counted in rows of two numbers."""
    return ids * max(1, width // 2)


def _text_tokens(spec: ModelSpec, name: str) -> Column:
    if spec.multivalue:
        return split_multivalue(F.col(name))
    return F.filter(F.array(F.col(name)), lambda t: t.isNotNull() & (t != ""))
