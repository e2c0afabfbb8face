"""Category ids: hash buckets, vocabularies, identities, buckets of numbers, crosses, hot vectors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from clickloom.functions.arrays import let

SEPARATOR = "\u0001"


def hash_text(text: Column, method: str = "xxhash64") -> Column:
    """A non-negative integer hash; ``md5`` gives the same number in other engines."""
    if method == "md5":
        return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")
    if method == "xxhash64":
        return F.pmod(F.xxhash64(text), F.lit(2**62))
    raise ValueError(f"unknown hash {method!r}")


def hash_bucket(text: Column, size: int | Column, method: str = "xxhash64") -> Column:
    """Bucket of a single value; an empty value has no id (null)."""
    size = size if isinstance(size, Column) else F.lit(size)
    return F.when(text != "", F.pmod(hash_text(text, method), size).cast("bigint"))


def hash_bucket_tokens(tokens: Column, size: int, method: str = "xxhash64") -> Column:
    return F.transform(tokens, lambda t: F.pmod(hash_text(t, method), F.lit(size)).cast("bigint"))


def vocab_id(text: Column, values: list[str]) -> Column:
    """Position in the list, or -1 when the value is not in it."""
    # One text literal that is split while planning: far cheaper to build than a literal per value.
    listed = F.split(F.lit(SEPARATOR.join(values)), SEPARATOR)
    return F.coalesce(F.array_position(listed, text) - 1, F.lit(-1)).cast("bigint")


def vocab_id_tokens(tokens: Column, values: list[str]) -> Column:
    """Ids of the known tokens; unknown ones are dropped."""
    return F.filter(F.transform(tokens, lambda t: vocab_id(t, values)), lambda i: i >= 0)


def identity_id(number: Column, size: int) -> Column:
    return F.when(number.between(0, size - 1), number).otherwise(F.lit(0)).cast("bigint")


def bucketize(number: Column, boundaries: list[float]) -> Column:
    """How many boundaries are at or below the number: 0 to len(boundaries)."""
    steps = [(number >= F.lit(float(b))).cast("int") for b in boundaries]
    return F.coalesce(reduce(lambda a, b: a + b, steps), F.lit(0)).cast("bigint")


def cross_hash(values: list[Column], size: int, method: str = "xxhash64") -> Column:
    """Bucket of the combination of single values; no id if a member is missing or empty."""
    present = reduce(lambda a, b: a & b, [v.isNotNull() & (v != "") for v in values])
    return F.when(present, F.pmod(hash_text(F.concat_ws(SEPARATOR, *values), method), F.lit(size)).cast("bigint"))


def cross_hash_tokens(members: list[Column], size: int, method: str = "xxhash64") -> Column:
    """One bucket per combination of the members' tokens (arrays of strings)."""

    def extend(combined: Column, tokens: Column) -> Column:
        def joined(values: Column, left: Column) -> Column:
            return F.transform(values, lambda right: F.concat(left, F.lit(SEPARATOR), right))

        return let(tokens, lambda values: F.flatten(F.transform(combined, lambda left: joined(values, left))))

    return hash_bucket_tokens(reduce(extend, members), size, method)


def one_hot(id_: Column, size: int) -> Column:
    """Indicator vector of a single id; negative ids give all zeros."""
    return F.array(*[(id_ == F.lit(i)).cast("double") for i in range(size)])


def multi_hot(ids: Column, size: int) -> Column:
    """Counts per id; ids outside [0, size) are ignored."""
    positions = F.sequence(F.lit(0), F.lit(size - 1))

    def count(found: Column, i: Column) -> Column:
        return F.size(F.filter(found, lambda x: x == i)).cast("double")

    return let(ids, lambda found: F.transform(positions, lambda i: count(found, i)))
