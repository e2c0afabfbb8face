"""Cleaning: missing tokens, typed decoding, multi-value fields, labels and row weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.spec import ModelSpec

MISSING_TOKEN = "-"
DEFAULTS = {"int": 0, "float": 0.0, "double": 0.0, "string": ""}


def is_missing(c: Column) -> Column:
    return c.isNull() | c.isin("", MISSING_TOKEN)


def fill_missing(c: Column, default) -> Column:
    """``default`` where the field is null, empty or the missing token."""
    return F.when(is_missing(c), F.lit(default)).otherwise(c)


def typed(c: Column, kind: str) -> Column:
    """Decode a text field as ``kind``; missing or malformed fields take the type's default."""
    default = F.lit(DEFAULTS[kind]).cast(kind)
    if kind == "string":
        return fill_missing(c, "")
    return F.when(is_missing(c), default).otherwise(F.coalesce(c.try_cast(kind), default))


def typed_decode(raw: DataFrame, spec: ModelSpec, with_label: bool = True) -> DataFrame:
    """All fields of a raw text table in their spec types (the label is left out for prediction)."""
    names = list(spec.fields) if with_label else spec.names("all")
    return raw.select(*[typed(F.col(n), spec.field_type(n)).alias(n) for n in names])


def split_multivalue(c: Column, delimiter: str = ",") -> Column:
    """Tokens of a joined field; empty tokens are dropped, so an empty field has none."""
    several = F.array_remove(F.split(c, f"\\Q{delimiter}\\E"), "")
    none = F.array().cast("array<string>")
    return F.when(F.contains(c, F.lit(delimiter)), several).when(c != "", F.array(c)).otherwise(none)


def scalar_to_array(c: Column) -> Column:
    return F.array(c)


def is_positive(label: Column) -> Column:
    return F.coalesce(label == 1, F.lit(False))


def class_weight(label: Column, positive: float | None = None, negative: float | None = None) -> Column:
    """Row weight by class; an unset weight is 1."""
    pos, neg = (1.0 if w is None else float(w) for w in (positive, negative))
    return F.when(is_positive(label), F.lit(pos)).otherwise(F.lit(neg))


def prune_columns(df: DataFrame, spec: ModelSpec, with_label: bool = True) -> DataFrame:
    """Used features only, so that the scan reads no other column."""
    return df.select(*([spec.label] if with_label else []), *spec.names("used"))


def select_by_kind(df: DataFrame, spec: ModelSpec, which: str, keep: tuple[str, ...] = ()) -> DataFrame:
    return df.select(*keep, *spec.names(which))


def request_struct(spec: ModelSpec) -> Column:
    """One scoring request per row: text features as strings, all others as floats."""
    return F.struct(
        *[
            (F.col(n).cast("string") if spec.field_type(n) == "string" else F.col(n).cast("float")).alias(n)
            for n in spec.names("used")
        ]
    )
