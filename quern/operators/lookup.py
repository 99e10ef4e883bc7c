"""Point lookups and listings over files, symbols and relations.

Every listing has a total order (ties by id). Exact duplicate rows are the caller's to remove.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def like(column: Column, pattern: str) -> Column:
    """Pattern match where ``%`` and ``_`` are wildcards, only ASCII letters fold, and there is no escape."""
    if not re.search(r"[%_]", pattern) and pattern.isascii():
        return F.lower(column) == pattern.lower()
    body = "".join(".*" if c == "%" else "." if c == "_" else re.escape(c) if c.isascii() else c for c in pattern)
    return column.rlike(f"(?is)\\A{body}\\z")


def by_id(rows: DataFrame, id: int) -> DataFrame:
    return rows.where(F.col("id") == id)


def symbols_by_name(symbols: DataFrame, pattern: str, limit: int = 100) -> DataFrame:
    """The first ``limit`` symbols by name whose name fits the pattern."""
    return symbols.where(like(F.col("name"), pattern)).orderBy("name", "id").limit(limit)


def symbols_by_name_or_part(symbols: DataFrame, pattern: str, limit: int = 100) -> DataFrame:
    """As symbols_by_name; where nothing fits, names that contain the pattern.

    One plan: the best class of match is found by a window-free aggregate and joined back.
    """
    exact, part = like(F.col("name"), pattern), like(F.col("name"), f"%{pattern}%")
    rated = symbols.withColumn("_class", F.when(exact, 0).when(part, 1)).where("_class IS NOT NULL")
    best = rated.agg(F.min("_class").alias("_best"))
    return rated.join(F.broadcast(best), F.col("_class") == F.col("_best")).drop("_class", "_best").orderBy("name", "id").limit(limit)


def symbols_of_file(symbols: DataFrame, file_id: int) -> DataFrame:
    return symbols.where(F.col("file_id") == file_id).orderBy("start_line", "id")


def symbols_of_path(symbols: DataFrame, files: DataFrame, path: str) -> DataFrame:
    """Symbols of the file with exactly this relative path; none if it is unknown."""
    there = files.where(F.col("relative_path") == path).select(F.col("id").alias("file_id")).distinct()
    return symbols.join(there, "file_id", "left_semi").orderBy("start_line", "id")


def symbols_of_path_end(symbols: DataFrame, files: DataFrame, end: str) -> DataFrame:
    """Symbols of the first file, by relative path, whose path ends in ``end``."""
    first = files.where(F.col("relative_path").endswith(end)).orderBy("relative_path", "id").limit(1).select(F.col("id").alias("file_id"))
    return symbols.join(F.broadcast(first), "file_id", "left_semi").orderBy("start_line", "id")


def symbols_by_kind(symbols: DataFrame, kind: str) -> DataFrame:
    return symbols.where(F.col("kind") == kind).orderBy("qualified_name", "id")


def outgoing(relations: DataFrame, symbol_id: int) -> DataFrame:
    return relations.where(F.col("source_symbol_id") == symbol_id)


def incoming(relations: DataFrame, symbol_id: int) -> DataFrame:
    return relations.where(F.col("target_symbol_id") == symbol_id)


def relations_by_kind(relations: DataFrame, kind: str) -> DataFrame:
    return relations.where(F.col("kind") == kind)


def list_files(files: DataFrame) -> DataFrame:
    return files.orderBy("relative_path", "id")


def file_by_path(files: DataFrame, path: str) -> DataFrame:
    return files.where(F.col("path") == path)


def path_of_file(files: DataFrame, id: int) -> DataFrame:
    return files.where(F.col("id") == id).select("relative_path")
