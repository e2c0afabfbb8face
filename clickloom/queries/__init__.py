"""Registered queries over the given tables, each with the SQL that must give the same rows."""

from clickloom.queries import ads, aggregates, cleaning, features, images, joins, model_files, models, scans, sinks  # noqa: F401
from clickloom.queries.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
