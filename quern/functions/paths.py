"""Path expressions shared by several operators (JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_path(path: Column) -> Column:
    """A relative path with ``/`` separators and without redundant ``.`` parts, doubled or leading slashes."""
    slashed = F.regexp_replace(F.trim(path), r"[\\/]+", "/")
    return F.regexp_replace(F.regexp_replace(slashed, r"(^|/)(\./)+", "$1"), r"^/+", "")


def package_of(path: Column) -> Column:
    """The first two parts of a cleaned relative path; null where the path has fewer than three parts."""
    head = F.regexp_extract(clean_path(path), r"^([^/]+/[^/]+)/", 1)
    return F.when(head != "", head)
