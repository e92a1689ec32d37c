"""Flagship job: log lines per OCSF class with coverage.

lines -> mask (21 regex replaces, one projection) -> first matching rule on the masked
line (one projection) -> per-class partial/final aggregate. One shuffle (the tiny
aggregate); the scan reads only the columns the rendering needs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from logweave.functions.masks import mask_only
from logweave.operators.normalize import normalize
from logweave.operators.reports import class_coverage
from logweave.sources.rules import DEFAULT_RULES


def labelled_lines(lines: DataFrame, rules=DEFAULT_RULES, on: str = "processed") -> DataFrame:
    """Masked lines with their rule label. ``on`` = 'processed' (masked text) or 'line'."""
    m = mask_only(lines)
    return normalize(m, on, rules)


def class_coverage_job(lines: DataFrame, rules=DEFAULT_RULES) -> DataFrame:
    return class_coverage(labelled_lines(lines, rules))
