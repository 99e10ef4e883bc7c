"""Joins and rollups over files, symbols, relations and vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.skew import balanced_join, plan_loads
from quern.schema import DEPENDENCY_KINDS, REPORTED_KINDS, UNEMBEDDED_KINDS


def parent_dir(path: Column, root: str = "") -> Column:
    """Directory of a relative path; ``root`` for files at the top."""
    d = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return F.when(d == "", F.lit(root)).otherwise(d)


def resolve_relations(relations: DataFrame, symbols: DataFrame) -> DataFrame:
    """Fill null targets with the least id of the symbols of exactly that name.

    The lookup side is one row per name. Rows that have a target stay where they are; the others are spread by the
    load of their name, as a handful of names has most of them. ``relations`` is read three times: give a table.
    """
    names = symbols.where("name IS NOT NULL").groupBy(F.col("name").alias("target_symbol_name")).agg(F.min("id").alias("__q_id"))
    loose = relations.where("target_symbol_id IS NULL")
    joined = balanced_join(loose, names, plan_loads(loose, ["target_symbol_name"]), F.col("id"))
    found = joined.withColumn("target_symbol_id", F.col("__q_id")).select(*relations.columns)
    return relations.where("target_symbol_id IS NOT NULL").unionByName(found)


def resolution_counts(relations: DataFrame, symbols: DataFrame) -> DataFrame:
    """(attempted, resolved): rows without a target before, and those that got one."""
    names = symbols.select(F.col("name").alias("_name")).distinct()
    loose = relations.where("target_symbol_id IS NULL").groupBy("target_symbol_name").agg(F.count(F.lit(1)).alias("_n"))
    joined = loose.join(names, F.col("target_symbol_name") == F.col("_name"), "left")
    return joined.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("attempted"), F.coalesce(F.sum(F.when(F.col("_name").isNotNull(), F.col("_n"))), F.lit(0)).alias("resolved")
    )


def file_dependencies(relations: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(source_path, target_path, kind), distinct, between different files.

    Edges are reduced to distinct (source file, target file, kind) before paths are looked up.
    """
    place = symbols.select(F.col("id").alias("_s"), F.col("file_id").alias("_f"))
    kept = relations.where(F.col("kind").isin(*DEPENDENCY_KINDS) & F.col("target_symbol_id").isNotNull()).select("source_symbol_id", "target_symbol_id", "kind").distinct()
    src = kept.join(place, F.col("source_symbol_id") == F.col("_s")).select(F.col("_f").alias("_sf"), "target_symbol_id", "kind").distinct()
    both = src.join(place, F.col("target_symbol_id") == F.col("_s")).select("_sf", F.col("_f").alias("_tf"), "kind").where("_sf <> _tf").distinct()
    names = files.select(F.col("id").alias("_id"), F.col("relative_path").alias("_path"))
    out = both.join(names, F.col("_sf") == F.col("_id")).select(F.col("_path").alias("source_path"), "_tf", "kind")
    return out.join(names, F.col("_tf") == F.col("_id")).select("source_path", F.col("_path").alias("target_path"), "kind").distinct()


def dependency_links(dependencies: DataFrame) -> DataFrame:
    """(source, target, weight, kinds): weight counts distinct kinds, not call sites."""
    return dependencies.groupBy(F.col("source_path").alias("source"), F.col("target_path").alias("target")).agg(
        F.count(F.lit(1)).alias("weight"), F.array_sort(F.collect_set("kind")).alias("kinds")
    )


def dependency_nodes(dependencies: DataFrame) -> DataFrame:
    ends = dependencies.select(F.col("source_path").alias("id")).union(dependencies.select(F.col("target_path").alias("id"))).distinct()
    return ends.withColumn("dir", parent_dir(F.col("id")))


def unembedded(symbols: DataFrame, embeddings: DataFrame, skip_kinds: bool = False) -> DataFrame:
    """Symbols without a vector, by id; with ``skip_kinds`` without those that never get one."""
    out = symbols.join(embeddings.select(F.col("symbol_id").alias("_e")).distinct(), F.col("id") == F.col("_e"), "left_anti")
    return (out.where(~F.col("kind").isin(*UNEMBEDDED_KINDS)) if skip_kinds else out).orderBy("id")


def with_paths(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Symbols with ``file_path``, empty where the file is unknown."""
    names = files.select(F.col("id").alias("_id"), F.col("relative_path").alias("_path")).distinct()
    return symbols.join(names, F.col("file_id") == F.col("_id"), "left").withColumn("file_path", F.coalesce("_path", F.lit(""))).drop("_id", "_path")


def references(relations: DataFrame, symbols: DataFrame, files: DataFrame, name_filter: Column) -> DataFrame:
    """Every relation whose resolved target is a matching symbol, with its source and place."""
    targets = symbols.where(name_filter).select(F.col("id").alias("target_symbol_id"), F.col("id").alias("target_id"), F.col("qualified_name").alias("target"))
    aimed = relations.where("target_symbol_id IS NOT NULL").select("id", "source_symbol_id", "target_symbol_id", "kind", "file_id", "line")
    hits = balanced_join(aimed, targets, plan_loads(aimed, ["target_symbol_id"]), F.col("id"), "inner")
    sources = symbols.select(F.col("id").alias("_s"), F.col("name").alias("source"), F.col("kind").alias("source_kind"))
    names = files.select(F.col("id").alias("_id"), F.col("relative_path").alias("_path")).distinct()
    found = hits.join(sources, F.col("source_symbol_id") == F.col("_s")).join(names, F.col("file_id") == F.col("_id"), "left")
    return found.select("target_id", "target", "source", "source_kind", F.col("kind").alias("relation_kind"), F.coalesce("_path", F.lit("")).alias("file_path"), F.col("line"), F.col("id").alias("relation_id"))


def implementations(relations: DataFrame, symbols: DataFrame, name: str) -> DataFrame:
    """Sources of ``implements`` relations that write exactly this name, one row per relation."""
    hits = relations.where((F.col("kind") == "implements") & (F.col("target_symbol_name") == name)).select(F.col("id").alias("relation_id"), "source_symbol_id")
    cols = [F.col("id").alias("symbol_id"), "name", "qualified_name", F.col("kind").alias("symbol_kind"), "file_id", "start_line"]
    return hits.join(symbols.select(*cols), F.col("source_symbol_id") == F.col("symbol_id")).drop("source_symbol_id")


def index_stats(files: DataFrame, symbols: DataFrame, relations: DataFrame, embeddings: DataFrame) -> DataFrame:
    """One row: four counts and the sorted languages."""
    f = files.agg(F.count(F.lit(1)).alias("total_files"), F.array_sort(F.collect_set("language")).alias("languages"))
    out = f
    for rows, name in ((symbols, "total_symbols"), (relations, "total_relations"), (embeddings, "total_embeddings")):
        out = out.crossJoin(rows.agg(F.count(F.lit(1)).alias(name)))  # one row beside one row
    return out


def symbol_counts(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """(file, kind, count): counted per file id first, so only counts meet the paths."""
    per = symbols.groupBy("file_id", "kind").agg(F.count(F.lit(1)).alias("count"))
    names = files.select(F.col("id").alias("_id"), F.col("relative_path").alias("file"))
    return per.join(names, F.col("file_id") == F.col("_id")).groupBy("file", "kind").agg(F.sum("count").alias("count"))


def file_counts(counts: DataFrame) -> DataFrame:
    """(file, dir, total, kinds): symbol_counts with one row per file."""
    return counts.groupBy("file").agg(
        F.sum("count").alias("total"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "count")))).alias("kinds")
    ).withColumn("dir", parent_dir(F.col("file")))


def files_per_directory(files: DataFrame) -> DataFrame:
    return files.groupBy(parent_dir(F.col("relative_path"), ".").alias("dir")).agg(F.array_sort(F.collect_list("relative_path")).alias("files"))


def kind_counts(symbols: DataFrame) -> DataFrame:
    return symbols.where(F.col("kind").isin(*REPORTED_KINDS)).groupBy("kind").agg(F.count(F.lit(1)).alias("count"))


def language_counts(files: DataFrame) -> DataFrame:
    return files.groupBy("language").agg(F.count(F.lit(1)).alias("count"))


def project_structure(files: DataFrame, symbols: DataFrame, relations: DataFrame, embeddings: DataFrame) -> DataFrame:
    """The structure report as rows (section, name, count), sorted as it is printed."""
    stats = index_stats(files, symbols, relations, embeddings)
    totals = stats.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("name"), F.col(c).alias("count")) for n, c in (("files", "total_files"), ("symbols", "total_symbols"), ("relations", "total_relations"), ("embeddings", "total_embeddings"))
    ])).alias("x")).select(F.lit("totals").alias("section"), "x.name", "x.count")
    dirs = files.groupBy(parent_dir(F.col("relative_path"), ".").alias("name")).agg(F.count(F.lit(1)).alias("count"))
    parts = [
        totals,
        language_counts(files).select(F.lit("languages").alias("section"), F.col("language").alias("name"), "count"),
        kind_counts(symbols).select(F.lit("kinds").alias("section"), F.col("kind").alias("name"), "count"),
        dirs.select(F.lit("directories").alias("section"), "name", "count"),
    ]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    by_name = F.col("section") == "directories"
    return out.orderBy("section", F.when(by_name, 0).otherwise(-F.col("count")), "name")


def structure_tree(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(dir, file, symbols): per file its symbols as structs by line, sorted by directory."""
    per = symbols.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct(F.col("start_line").alias("line"), "id", "name", "kind"))).alias("symbols"))
    joined = files.join(per, F.col("id") == F.col("file_id"))
    return joined.select(parent_dir(F.col("relative_path")).alias("dir"), F.col("relative_path").alias("file"), per["symbols"]).orderBy("dir", "file")
