"""Ragged-record profiling and unification as Spark jobs."""

from fieldloom.session import configure, cut_lineage

__all__ = ["configure", "cut_lineage"]
