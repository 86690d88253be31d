"""Queries over the given tables, each with the SQL that must agree with it."""

from catalog.registry import CATALOG
from catalog import answers, cohort, datasets, evaluation, ingest, runs, selecting  # noqa: F401

__all__ = ["CATALOG"]
