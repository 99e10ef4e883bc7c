"""References to records that do not exist: direct orphans and those that inherit it.

A reference is at fault directly if the record it names is missing or deleted.  Records below a dead
record are indirectly orphaned: a fixpoint of semi-joins carries death down the foreign keys, and
references from or to such records are reported as inherited.  Each round of the fixpoint also joins the
links with themselves, so that it reaches twice as far as the one before.

Every lookup of references goes through ``skew.balanced_join``: references to one hot record, or without
any, are spread over as many tasks as their number asks for.

Defined results: exact duplicate rows are one record; the latest event per record counts (ties: the
greatest event id); a null source is no live record; a null target id is judged by name; a relation whose
file is unknown has no package, so no name can be found in it; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.paths import package_of
from quern.operators.incremental import latest_by
from quern.operators.skew import balanced_join, plan_loads
from quern.session import cut

SYMBOL_COLUMNS = ["id", "file_id", "name", "parent_symbol_id"]


def live_symbols(symbols: DataFrame, late: DataFrame, events: DataFrame) -> DataFrame:
    """(id, file_id, name, parent_symbol_id) of symbols and late symbols whose latest event is no deletion."""
    every = symbols.select(*SYMBOL_COLUMNS).unionByName(late.select(*SYMBOL_COLUMNS)).where("id IS NOT NULL").distinct()
    last = latest_by(events.select("symbol_id", "logged_at", "event_id", "action"), "symbol_id", "logged_at", "event_id")
    dead = last.where(F.lower(F.trim("action")) == "deleted").select(F.col("symbol_id").alias("_dead"))
    return every.join(dead, F.col("id") == F.col("_dead"), "left_anti")


def current_files(files: DataFrame) -> DataFrame:
    """(file_id, package, last_indexed) of the current row of each file."""
    now = latest_by(files.select("id", "last_indexed", "relative_path"), "id", "last_indexed")
    return now.select(F.col("id").alias("file_id"), package_of(F.col("relative_path")).alias("package"), "last_indexed")


def distinct_references(relations: DataFrame) -> DataFrame:
    """The columns of a reference, one row per record, written once."""
    return cut(relations.select(F.col("id").alias("relation_id"), "source_symbol_id", "target_symbol_id", "target_symbol_name", "file_id").distinct())


def with_package(rows: DataFrame, files: DataFrame, spread: str) -> DataFrame:
    """``rows`` (a written table) with the package of their file, null where there is none."""
    return balanced_join(rows, files.select("file_id", "package"), plan_loads(rows, ["file_id"]), F.col(spread))


def direct_orphans(references: DataFrame, live: DataFrame, files: DataFrame) -> DataFrame:
    """(relation_id, ref_field, file_id) of every reference that is at fault itself.

    ``references`` is the result of distinct_references, ``live`` of live_symbols, ``files`` of current_files.
    """

    def fault(rows: DataFrame, field) -> DataFrame:
        return rows.select("relation_id", field.alias("ref_field"), "file_id")

    by_source = references.select("relation_id", "source_symbol_id", "file_id")
    ids = live.select(F.col("id").alias("source_symbol_id")).distinct()
    bad_source = balanced_join(by_source, ids, plan_loads(by_source, ["source_symbol_id"]), F.col("relation_id"), "left_anti")

    with_id = references.where("target_symbol_id IS NOT NULL").select("relation_id", "target_symbol_id", "target_symbol_name", "file_id")
    names = live.groupBy(F.col("id").alias("target_symbol_id")).agg(F.collect_set("name").alias("_names"))
    by_target = balanced_join(with_id, names, plan_loads(with_id, ["target_symbol_id"]), F.col("relation_id"))
    kind = F.when(F.col("_names").isNull(), "target_symbol_id").when(
        ~F.coalesce(F.array_contains("_names", F.col("target_symbol_name")), F.lit(False)), "target_symbol_name"
    )
    bad_target = fault(by_target, kind).where("ref_field IS NOT NULL")

    # Names without an id: first the distinct (file, name), then one lookup per (package, name).
    loose = references.where("target_symbol_id IS NULL").select("relation_id", "file_id", "target_symbol_name")
    asked = with_package(cut(loose.select("file_id", "target_symbol_name").distinct()), files, "target_symbol_name")
    have = with_package(cut(live.select("file_id", "name").distinct()), files, "name").select(F.col("package").alias("_pkg"), F.col("name").alias("_nm")).distinct()
    found = asked.join(have, (F.col("package") == F.col("_pkg")) & (F.col("target_symbol_name") == F.col("_nm")), "left_semi").drop("package")
    bad_name = balanced_join(loose, found, plan_loads(loose, ["file_id", "target_symbol_name"]), F.col("relation_id"), "left_anti")
    return fault(bad_source, F.lit("source_symbol_id")).unionByName(bad_target).unionByName(fault(bad_name, F.lit("target_symbol_name")))


def cascade(live: DataFrame) -> DataFrame:
    """Ids of live symbols below a symbol that is dead or missing, to a fixpoint.

    Round k semi-joins the links that lead 2^k levels up with what is orphaned so far. As whoever is orphaned
    from afar has an ancestor orphaned at every smaller distance, a round that finds nobody is the last.
    """
    kids = cut(live.where("parent_symbol_id IS NOT NULL").select("id", F.col("parent_symbol_id").alias("up")).distinct())
    ids = live.select(F.col("id").alias("up")).distinct()
    sound = balanced_join(kids, ids.withColumn("_live", F.lit(True)), plan_loads(kids, ["up"]), F.col("id"))
    sound = cut(sound)
    found = cut(sound.where("_live IS NULL").select("id").distinct())
    links = sound.where("_live").select("id", "up")
    while True:
        plan = plan_loads(links, ["up"])
        if not plan.total:
            return found
        hit = balanced_join(links, found.select(F.col("id").alias("up")), plan, F.col("id"), "left_semi").select("id").distinct()
        fresh = cut(hit.join(found, "id", "left_anti"))
        if fresh.isEmpty():
            return found
        found = cut(found.unionByName(fresh))
        above = links.select(F.col("id").alias("up"), F.col("up").alias("_next"))
        links = cut(balanced_join(links, above, plan, F.col("id"), "inner").select("id", F.col("_next").alias("up")).distinct())


def orphan_report(relations: DataFrame, symbols: DataFrame, late: DataFrame, events: DataFrame, files: DataFrame) -> DataFrame:
    """(ref_field, month, direct, inherited): faulty references per field and month of the file's last_indexed.

    inherited counts references that are sound themselves but lead from or to an indirectly orphaned symbol.
    """
    live = cut(live_symbols(symbols, late, events))
    now = cut(current_files(files))
    references = distinct_references(relations)
    direct = cut(direct_orphans(references, live, now))
    below = cascade(live)
    tagged = direct.withColumn("_kind", F.lit("direct"))
    for field in ("source_symbol_id", "target_symbol_id"):
        part = references.where(F.col(field).isNotNull()).select("relation_id", field, "file_id")
        hit = balanced_join(part, below.select(F.col("id").alias(field)), plan_loads(part, [field]), F.col("relation_id"), "left_semi")
        hit = hit.select("relation_id", F.lit(field).alias("ref_field"), "file_id")
        known = direct.where(F.col("ref_field") == field).select("relation_id")
        tagged = tagged.unionByName(hit.join(known, "relation_id", "left_anti").withColumn("_kind", F.lit("inherited")))
    per_file = tagged.groupBy("file_id", "ref_field").agg(
        F.count_if(F.col("_kind") == "direct").alias("direct"), F.count_if(F.col("_kind") == "inherited").alias("inherited")
    )
    stamped = per_file.join(now.select("file_id", "last_indexed"), "file_id", "left")
    month = F.date_format(F.timestamp_seconds("last_indexed"), "yyyy-MM")
    return stamped.groupBy("ref_field", month.alias("month")).agg(F.sum("direct").alias("direct"), F.sum("inherited").alias("inherited"))
