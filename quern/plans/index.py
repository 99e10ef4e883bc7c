"""The index life cycle: changed files are parsed, replace their old rows, names are resolved, vectors added.

All tables of an index version are written before the version pointer is swapped, so a run that fails
leaves the previous index in force.  Ids: files and symbols are numbered densely by relative path and
position; a changed file keeps its id, its symbols get new ones.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern import schema
from quern.functions.embedder import Embedder, embed_rows
from quern.operators.incremental import VersionPointer, changed_records
from quern.operators.numbering import number
from quern.operators.relational import resolve_relations, unembedded
from quern.operators.vector import embed_text
from quern.session import cut
from quern.sources.parse import parse_files

TABLES = {"files": schema.FILES, "symbols": schema.SYMBOLS, "relations": schema.RELATIONS, "embeddings": schema.EMBEDDINGS}


def upsert_files(files: DataFrame, changed: DataFrame, now: int) -> DataFrame:
    """Insert new paths; of known ones only hash, size and time change (id, relative path and language stay)."""
    fresh = changed.select("path", F.col("relative_path").alias("_rel"), F.col("language").alias("_lang"), F.col("content_hash").alias("_hash"), F.col("size_bytes").alias("_size"))
    top = files.agg(F.max("id")).first()[0] or 0
    new = fresh.join(files.select("path"), "path", "left_anti")
    new = number(new, ["_rel", "path"], "id", top + 1).select(
        "id", "path", F.col("_rel").alias("relative_path"), F.col("_lang").alias("language"), F.col("_hash").alias("content_hash"), F.col("_size").alias("size_bytes"), F.lit(now).cast("long").alias("last_indexed")
    )
    kept = files.join(fresh, "path", "left").select(
        "id", "path", "relative_path", "language", F.coalesce("_hash", "content_hash").alias("content_hash"), F.coalesce("_size", "size_bytes").alias("size_bytes"),
        F.when(F.col("_hash").isNotNull(), F.lit(now).cast("long")).otherwise(F.col("last_indexed")).alias("last_indexed"),
    )
    return kept.unionByName(new)


def delete_files(tables: dict[str, DataFrame], gone: DataFrame, drop_files: bool = True) -> dict[str, DataFrame]:
    """Remove the files of ``gone(file_id)`` with symbols, relations and vectors; edges into them lose their target."""
    old = tables["symbols"].join(gone, "file_id", "left_semi").select(F.col("id").alias("_old"))
    r = tables["relations"].join(gone.select(F.col("file_id").alias("_g")), F.col("file_id") == F.col("_g"), "left_anti")
    r = r.join(old, F.col("source_symbol_id") == F.col("_old"), "left_anti")
    r = r.join(old, F.col("target_symbol_id") == F.col("_old"), "left").withColumn("target_symbol_id", F.when(F.col("_old").isNull(), F.col("target_symbol_id"))).drop("_old")
    files = tables["files"].join(gone.select(F.col("file_id").alias("_g")), F.col("id") == F.col("_g"), "left_anti") if drop_files else tables["files"]
    return {
        "files": files,
        "symbols": tables["symbols"].join(gone, "file_id", "left_anti"),
        "relations": r,
        "embeddings": tables["embeddings"].join(old, F.col("symbol_id") == F.col("_old"), "left_anti"),
    }


def store_embeddings(embeddings: DataFrame, new: DataFrame) -> DataFrame:
    """Insert or replace vectors by symbol."""
    return embeddings.join(new.select("symbol_id"), "symbol_id", "left_anti").unionByName(new.select("symbol_id", "vector"))


class Index:
    """Versioned tables under ``root``."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.pointer = VersionPointer(spark, self.root)

    def tables(self) -> dict[str, DataFrame]:
        version = self.pointer.current()
        if version is None:
            return {n: self.spark.createDataFrame([], s) for n, s in TABLES.items()}
        return {n: self.spark.read.schema(s).parquet(f"{self.root}/{version}/{n}") for n, s in TABLES.items()}

    def run(self, scanned: DataFrame, embedder: Embedder | None = None, prune: bool = False, now: int | None = None) -> dict[str, int]:
        """Index what ``sources.scan`` found (or any part of it). Returns counts; nothing is written if nothing changed."""
        before = self.tables()
        now = int(time.time()) if now is None else now
        changed = cut(changed_records(scanned, before["files"].select("path", "content_hash"), "path"))
        gone = before["files"].join(scanned.select("path"), "path", "left_anti").select(F.col("id").alias("file_id")) if prune else None
        n_changed = changed.count()
        if not n_changed and (gone is None or gone.isEmpty()) and embedder is None:
            return {"changed": 0, "symbols": 0, "relations": 0, "attempted": 0, "resolved": 0, "embedded": 0}
        tables = delete_files(before, gone) if gone is not None else before
        files = cut(upsert_files(tables["files"], changed, now))
        ids = files.select(F.col("id").alias("file_id"), "path")
        todo = changed.join(ids, "path").select("file_id", "relative_path", "language", "text")
        tables = delete_files({**tables, "files": files}, todo.select("file_id"), drop_files=False)
        parsed = cut(parse_files(todo))
        rel_paths = todo.select(F.col("file_id").alias("_f"), "relative_path")

        top = before["symbols"].agg(F.max("id")).first()[0] or 0
        flat = parsed.select("file_id", F.inline("symbols")).join(rel_paths, F.col("file_id") == F.col("_f")).drop("_f")
        new_symbols = cut(number(flat, ["relative_path", "file_id", "ordinal"], "id", top + 1))
        symbols = new_symbols.select(*[F.col(c) if c != "parent_symbol_id" else F.lit(None).cast("long").alias(c) for c in schema.SYMBOLS.names])
        top_r = before["relations"].agg(F.max("id")).first()[0] or 0
        flat_r = parsed.select("file_id", F.posexplode("relations").alias("_at", "_r")).select("file_id", "_at", "_r.*")
        owners = new_symbols.select(F.col("file_id").alias("_f"), F.col("ordinal").alias("_o"), F.col("id").alias("source_symbol_id"), "relative_path")
        joined = flat_r.join(owners, (F.col("file_id") == F.col("_f")) & (F.col("source_ordinal") == F.col("_o")))
        relations = number(joined, ["relative_path", "file_id", "_at"], "id", top_r + 1).select(
            "id", "source_symbol_id", F.col("target_name").alias("target_symbol_name"), F.lit(None).cast("long").alias("target_symbol_id"), "kind", "file_id", "line"
        )
        all_symbols = tables["symbols"].unionByName(symbols)
        loose = cut(tables["relations"].unionByName(relations))
        resolved = cut(resolve_relations(loose, all_symbols))
        embeddings = tables["embeddings"]
        n_embedded = 0
        if embedder is not None:
            wanted = unembedded(all_symbols, embeddings, skip_kinds=True).select(F.col("id").alias("symbol_id"), embed_text().alias("text"))
            new = cut(embed_rows(wanted, embedder))
            n_embedded = new.count()
            embeddings = store_embeddings(embeddings, new)
        version = f"v-{uuid.uuid4().hex}"
        for name, rows in (("files", files if gone is None else tables["files"]), ("symbols", all_symbols), ("relations", resolved), ("embeddings", embeddings)):
            rows.write.parquet(f"{self.root}/{version}/{name}")
        self.pointer.swap(version)
        return {
            "changed": n_changed, "symbols": symbols.count(), "relations": relations.count(),
            "attempted": loose.where("target_symbol_id IS NULL").count(), "resolved": resolved.where("target_symbol_id IS NOT NULL").count() - loose.where("target_symbol_id IS NOT NULL").count(),
            "embedded": n_embedded,
        }
