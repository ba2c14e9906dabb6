"""Exact data-quality checks for tables of any size, as Spark jobs."""

from gaugeline.settings import Settings

__all__ = ["Settings"]
