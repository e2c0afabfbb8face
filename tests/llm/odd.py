"""Rows that every operator must cope with, and small helpers."""

from __future__ import annotations

# doc_id, text, lang, source; the first two columns after them clash with names that operators use inside.
LONG = "word " * 300_000
ODD = [
    (None, None, None, None),
    (1, None, "en", "a"),
    (2, "", "en", "a"),
    (3, "  \t\n ", None, "a"),
    (4, "The same text in two rows of one id", "en", "b"),
    (4, "The same text in two rows of one id", "en", "b"),
    (5, "The same text in two rows of one id", "en", None),
    (None, "No id but a text of its own here", "en", "b"),
    (6, LONG, "en", "c"),
    (7, "Ünïcödé ſtraße 漢字 🙂 \u2028 x", "de", "c"),
]
CLASH = ["row", "at", "code", "score", "matches", "spans", "language", "size", "mix_shard", "n_words"]


def odd_docs(spark, rows=ODD):
    schema = "doc_id long, text string, lang string, source string, " + ", ".join(f"`{c}` string" for c in CLASH)
    return spark.createDataFrame([(*r, *CLASH) for r in rows], schema)


def plain_docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def rows_of(df):
    return [tuple(r) for r in df.collect()]
