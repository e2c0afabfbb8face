"""Dictionaries from data, and lookups of any size."""

import pytest
from pyspark.sql import functions as F

from clickloom.operators import vocabulary

ROWS = [(1, ["b", "a", "b", "zz", ""], ["x"]), (2, None, ["y", None, "x"]), (3, [], None), (4, ["ü", "a", "abcdefgh2", "abcdefgh1", "hot"], ["q"])]
ROWS += [(i, ["hot", "b"], []) for i in range(10, 60)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "id long, name array<string>, kind array<string>")


def listed(i):
    return sorted({t for r in ROWS for t in r[i] or [] if t}, key=lambda t: t.encode())


def test_ids_are_places_in_the_sorted_list(spark, rows):
    built = vocabulary.build(rows, {"name": F.col("name"), "kind": F.col("kind")}).collect()
    for i, feature in ((1, "name"), (2, "kind")):
        assert {r["token"]: r["id"] for r in built if r["feature"] == feature} == {t: k for k, t in enumerate(listed(i))}
    assert next(r["n"] for r in built if r["token"] == "hot") == 51
    often = vocabulary.build(rows, {"name": F.col("name")}, least_count=2).collect()
    assert {r["token"]: r["id"] for r in often} == {"a": 0, "b": 1, "hot": 2}


@pytest.mark.parametrize("bound", [1000, 0])
def test_lookup_keeps_order_and_every_row(spark, rows, no_broadcast, bound):
    known = {"name": {t: i for i, t in enumerate(["hot", "b", "ü"])}, "kind": {"x": 7}}
    dictionary = spark.createDataFrame([(f, t, i) for f, ids in known.items() for t, i in ids.items()], "feature string, token string, id long")
    tokens = {"name": F.col("name"), "kind": F.col("kind")}
    got = {r["id"]: (r["name"], r["kind"]) for r in vocabulary.with_vocabulary_ids(rows, "id", tokens, dictionary, bound).collect()}
    want = {r[0]: tuple([known[f][t] for t in r[i] or [] if t in known[f]] for i, f in ((1, "name"), (2, "kind"))) for r in ROWS}
    assert got == want


def test_no_tokens(spark, rows):
    assert vocabulary.build(rows.where("false"), {"name": F.col("name")}).collect() == []
