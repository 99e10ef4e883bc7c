"""Queries of the general training-data problems (2, 3, 5, 7) over the stated tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import hierarchy as H
from quern.operators import incremental as I
from quern.operators import orphans as O
from quern.operators import skew as S
from quern.session import cut, scratch, table

#: p3_found: share of the distinct relations that makes a name hot.
HOT_SHARE = 0.02


def _store(spark: SparkSession) -> I.StateStore:
    """An empty state store in the shared folder, removed when the driver ends."""
    return I.StateStore(spark, scratch(spark), "path")


def _committed(spark: SparkSession, sf: str) -> DataFrame:
    """(path, content_hash, run_id): what the committed runs wrote, one row per run and path."""
    runs = table(spark, sf, "index_runs").where(F.lower(F.trim("status")) == "committed").select("run_id").distinct()
    rows = table(spark, sf, "index_ledger").select("path", "run_id", "content_hash").join(runs, "run_id")
    return rows.groupBy("path", "run_id").agg(F.max("content_hash").alias("content_hash"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    store = _store(spark)
    store.adopt(_committed(spark, sf), "run_id")
    files = table(spark, sf, "files").select("path", "last_indexed", "id", "content_hash")
    return store.pending(I.latest_by(files, "path", "last_indexed")).rows.select(F.col("id").alias("file_id"))


def p2_runs(spark: SparkSession, sf: str) -> DataFrame:
    """The committed runs played again through the store: (run_id, path) of every record that was new or changed in its run."""
    store = _store(spark)
    rows = cut(_committed(spark, sf))
    found = None
    for r in sorted(r.run_id for r in rows.select("run_id").distinct().collect()):
        run = store.pending(rows.where(F.col("run_id") == r))
        store.commit(run)
        found = run.rows.select("run_id", "path") if found is None else found.unionByName(run.rows.select("run_id", "path"))
    return found if found is not None else rows.select("run_id", "path")


def p3_targets(spark: SparkSession, sf: str) -> DataFrame:
    """Calls and distinct callers per (target_symbol_name, target_symbol_id), with the target's kind and file."""
    rel = table(spark, sf, "relations").where("kind = 'calls'").select("id", "target_symbol_name", "target_symbol_id", "source_symbol_id")
    plan = S.plan_loads(rel, ["target_symbol_name", "target_symbol_id"])
    counts = cut(S.per_key_counts(rel, plan, "source_symbol_id", row="id"))
    symbols = table(spark, sf, "symbols").select("id", F.lower("kind").alias("target_kind"), F.col("file_id").alias("target_file_id"))
    symbols = symbols.groupBy(F.col("id").alias("target_symbol_id")).agg(
        F.min("target_kind").alias("target_kind"), F.min("target_file_id").alias("target_file_id")
    )
    by_id = S.plan_loads(counts, ["target_symbol_id"])
    return S.balanced_join(counts, symbols, by_id, F.col("target_symbol_name"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    rel = table(spark, sf, "relations").select("id", "target_symbol_name")
    plan = S.plan_loads(rel, ["target_symbol_name"])
    counts = S.per_key_counts(rel, plan, "id", row="id")
    total = rel.agg(F.count_distinct("id")).first()[0]
    return counts.where((F.col("distinct_id") >= HOT_SHARE * total) & F.col("target_symbol_name").isNotNull()).select("target_symbol_name")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    links = H.clean_links(table(spark, sf, "symbols"), "id", "parent_symbol_id")
    return H.cycles(links).select("cycle_id", F.col("id").alias("symbol_id"))


def p5_hierarchy(spark: SparkSession, sf: str) -> DataFrame:
    """Path, depth, root, preorder range, number of descendants and cycle of every symbol."""
    tree = H.hierarchy(H.clean_links(table(spark, sf, "symbols"), "id", "parent_symbol_id", "name"))
    return tree.select(
        F.col("id").alias("symbol_id"), F.col("root").alias("root_id"), "depth", "path", "lo", "hi", (F.col("size") - 1).alias("descendants"), "cycle_id"
    )


def p5_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Root, depth, path and number of descendants of every symbol that a root reaches."""
    tree = H.hierarchy(H.clean_links(table(spark, sf, "symbols"), "id", "parent_symbol_id", "name")).where("root IS NOT NULL")
    return tree.select(F.col("id").alias("symbol_id"), F.col("root").alias("root_id"), "depth", "path", (F.col("size") - 1).alias("descendants"))


def p5_descendants(spark: SparkSession, sf: str) -> DataFrame:
    """Every (ancestor, descendant) pair of symbols, from the nested ranges."""
    links = H.clean_links(table(spark, sf, "symbols"), "id", "parent_symbol_id")
    return H.descendants(cut(H.hierarchy(links))).select(F.col("ancestor").alias("ancestor_id"), F.col("id").alias("symbol_id"))


def _p7_tables(spark: SparkSession, sf: str) -> list[DataFrame]:
    return [table(spark, sf, t) for t in ("relations", "symbols", "symbols_late", "symbol_events", "files")]


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    relations, symbols, late, events, files = _p7_tables(spark, sf)
    live = cut(O.live_symbols(symbols, late, events))
    return O.direct_orphans(O.distinct_references(relations), live, cut(O.current_files(files))).select("relation_id", "ref_field")


def p7_report(spark: SparkSession, sf: str) -> DataFrame:
    return O.orphan_report(*_p7_tables(spark, sf))


QUERIES = {f.__name__: f for f in (p2_found, p2_runs, p3_found, p3_targets, p5_found, p5_hierarchy, p5_paths, p5_descendants, p7_found, p7_report)}

_CLEAN = r"regexp_replace(regexp_replace(regexp_replace(trim(relative_path), '[\\/]+', '/', 'g'), '(^|/)(\./)+', '\1', 'g'), '^/+', '')"

_P7 = f"""
WITH ev AS (SELECT symbol_id, action FROM symbol_events QUALIFY row_number() OVER (PARTITION BY symbol_id ORDER BY logged_at DESC, event_id DESC) = 1),
live AS (SELECT DISTINCT id, file_id, name FROM (SELECT id, file_id, name FROM symbols UNION ALL SELECT id, file_id, name FROM symbols_late)
  WHERE id NOT IN (SELECT symbol_id FROM ev WHERE lower(trim(action)) = 'deleted')),
f AS (SELECT id, nullif(regexp_extract({_CLEAN}, '^([^/]+/[^/]+)/', 1), '') AS pkg, last_indexed FROM files
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY last_indexed DESC, relative_path DESC) = 1),
ln AS (SELECT DISTINCT f.pkg, live.name FROM live JOIN f ON live.file_id = f.id),
r AS (SELECT DISTINCT id, source_symbol_id, target_symbol_id, target_symbol_name, file_id FROM relations),
found AS (SELECT r.id AS relation_id, 'source_symbol_id' AS ref_field FROM r LEFT JOIN (SELECT DISTINCT id FROM live) l ON r.source_symbol_id = l.id WHERE l.id IS NULL
UNION ALL
SELECT r.id, 'target_symbol_id' FROM r LEFT JOIN (SELECT DISTINCT id FROM live) l ON r.target_symbol_id = l.id WHERE l.id IS NULL AND r.target_symbol_id IS NOT NULL
UNION ALL
SELECT r.id, 'target_symbol_name' FROM r JOIN (SELECT id, list(name) AS names FROM live GROUP BY id) l ON r.target_symbol_id = l.id WHERE NOT list_contains(l.names, r.target_symbol_name)
UNION ALL
SELECT r.id, 'target_symbol_name' FROM r LEFT JOIN f ON r.file_id = f.id LEFT JOIN ln ON ln.pkg = f.pkg AND ln.name = r.target_symbol_name
WHERE r.target_symbol_id IS NULL AND ln.name IS NULL)
"""

SQL = {
    "p2_found": """
WITH cur AS (SELECT path, id, lower(trim(content_hash)) AS h FROM (SELECT DISTINCT * FROM files)
  QUALIFY row_number() OVER (PARTITION BY path ORDER BY last_indexed DESC NULLS LAST, id DESC, content_hash DESC) = 1),
st AS (SELECT path, lower(trim(content_hash)) AS h FROM index_ledger
  WHERE run_id IN (SELECT run_id FROM index_runs WHERE lower(trim(status)) = 'committed')
  QUALIFY row_number() OVER (PARTITION BY path ORDER BY run_id DESC, content_hash DESC) = 1)
SELECT cur.id AS file_id FROM cur LEFT JOIN st ON cur.path IS NOT DISTINCT FROM st.path
WHERE st.path IS NULL OR st.h IS DISTINCT FROM cur.h""",
    "p2_runs": """
WITH w AS (SELECT path, run_id, max(content_hash) AS content_hash FROM index_ledger WHERE run_id IN (SELECT run_id FROM index_runs WHERE lower(trim(status)) = 'committed') GROUP BY 1, 2),
h AS (SELECT path, run_id, lower(trim(content_hash)) AS h, row_number() OVER o AS n, lag(lower(trim(content_hash))) OVER o AS old FROM w WINDOW o AS (PARTITION BY path ORDER BY run_id))
SELECT run_id, path FROM h WHERE n = 1 OR h IS DISTINCT FROM old""",
    "p3_found": """
WITH r AS (SELECT DISTINCT id, target_symbol_name FROM relations)
SELECT target_symbol_name FROM r WHERE target_symbol_name IS NOT NULL GROUP BY 1
HAVING count(DISTINCT id) >= 0.02 * (SELECT count(DISTINCT id) FROM r)""",
    "p3_targets": """
WITH r AS (SELECT DISTINCT id, target_symbol_name, target_symbol_id, source_symbol_id, kind FROM relations WHERE kind = 'calls'),
c AS (SELECT target_symbol_name, target_symbol_id, count(*) AS calls, count(DISTINCT source_symbol_id) AS distinct_source_symbol_id FROM r GROUP BY 1, 2),
s AS (SELECT id, min(lower(kind)) AS target_kind, min(file_id) AS target_file_id FROM symbols GROUP BY 1)
SELECT c.*, s.target_kind, s.target_file_id FROM c LEFT JOIN s ON c.target_symbol_id = s.id""",
    "p5_found": """
WITH RECURSIVE s AS (SELECT id, min(parent_symbol_id) AS parent FROM symbols GROUP BY id),
walk(first_id, here, low, n) AS (
  SELECT id, parent, least(id, parent), 1 FROM s WHERE parent IN (SELECT id FROM s)
  UNION ALL
  SELECT w.first_id, s.parent, least(w.low, coalesce(s.parent, w.low)), n + 1 FROM walk w JOIN s ON s.id = w.here
  WHERE w.here <> w.first_id AND s.parent IS NOT NULL AND n < 200)
SELECT low AS cycle_id, first_id AS symbol_id FROM walk WHERE here = first_id""",
    "p5_paths": """
WITH RECURSIVE s AS (SELECT id, min(parent_symbol_id) AS parent, min(name) AS name FROM symbols GROUP BY id),
t(id, root_id, depth, path, above) AS (
  SELECT id, id, 1::BIGINT, name, []::BIGINT[] FROM s WHERE parent IS NULL OR parent NOT IN (SELECT id FROM s)
  UNION ALL SELECT s.id, t.root_id, t.depth + 1, t.path || '/' || s.name, list_append(t.above, t.id) FROM t JOIN s ON s.parent = t.id),
d AS (SELECT a, count(*) AS n FROM (SELECT unnest(above) AS a FROM t) GROUP BY a)
SELECT id AS symbol_id, root_id, depth, path, coalesce(d.n, 0) AS descendants FROM t LEFT JOIN d ON d.a = t.id""",
    "p5_hierarchy": """
WITH RECURSIVE s AS (SELECT id, min(parent_symbol_id) AS p, min(name) AS name FROM symbols GROUP BY id),
k AS (SELECT s.id, s.name, CASE WHEN s.p IN (SELECT id FROM s) THEN s.p END AS parent FROM s),
up(id, anc, hops) AS (SELECT id, id, 0 FROM k UNION SELECT up.id, k.parent, hops + 1 FROM up JOIN k ON k.id = up.anc WHERE k.parent IS NOT NULL AND hops < 200),
low AS (SELECT id, min(anc) AS m FROM up WHERE hops > 0 GROUP BY id),
ring AS (SELECT low.id, low.m AS cycle_id FROM low WHERE EXISTS (SELECT 1 FROM up WHERE up.id = low.id AND up.anc = low.id AND up.hops > 0)),
t(id, root_id, depth, path) AS (
  SELECT id, id, 1::BIGINT, name FROM k WHERE parent IS NULL
  UNION ALL SELECT k.id, t.root_id, t.depth + 1, t.path || '/' || k.name FROM t JOIN k ON k.parent = t.id),
pairs AS (SELECT DISTINCT id, anc FROM up),
size AS (SELECT anc AS id, count(*) AS n FROM pairs GROUP BY anc),
w AS (SELECT k.id, k.parent, 1 + coalesce(sum(size.n) OVER (PARTITION BY k.parent ORDER BY k.id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS step
  FROM k JOIN size USING (id) JOIN t USING (id) WHERE k.parent IS NOT NULL),
p AS (SELECT pairs.id, sum(w.step) AS lo FROM pairs JOIN w ON w.id = pairs.anc GROUP BY pairs.id)
SELECT k.id AS symbol_id, t.root_id, t.depth, t.path, (CASE WHEN t.id IS NOT NULL THEN coalesce(p.lo, 0) END)::BIGINT AS lo,
  (CASE WHEN t.id IS NOT NULL THEN coalesce(p.lo, 0) + size.n END)::BIGINT AS hi, size.n - 1 AS descendants, ring.cycle_id
FROM k JOIN size USING (id) LEFT JOIN t USING (id) LEFT JOIN p USING (id) LEFT JOIN ring USING (id)""",
    "p5_descendants": """
WITH RECURSIVE s AS (SELECT id, min(parent_symbol_id) AS parent FROM symbols GROUP BY id),
t(id, above) AS (SELECT id, []::BIGINT[] FROM s WHERE parent IS NULL OR parent NOT IN (SELECT id FROM s)
  UNION ALL SELECT s.id, list_append(t.above, t.id) FROM t JOIN s ON s.parent = t.id)
SELECT unnest(above) AS ancestor_id, id AS symbol_id FROM t""",
    "p7_found": _P7 + "SELECT * FROM found",
    "p7_report": _P7.replace("WITH ev", "WITH RECURSIVE ev") + """,
par AS (SELECT DISTINCT id, parent_symbol_id AS parent FROM (SELECT id, parent_symbol_id FROM symbols UNION ALL SELECT id, parent_symbol_id FROM symbols_late) WHERE id IN (SELECT id FROM live) AND parent_symbol_id IS NOT NULL),
below(id) AS (SELECT id FROM par WHERE parent NOT IN (SELECT id FROM live) UNION SELECT par.id FROM below JOIN par ON par.parent = below.id),
inh AS (SELECT id AS relation_id, 'source_symbol_id' AS ref_field, file_id FROM r WHERE source_symbol_id IN (SELECT id FROM below)
  UNION ALL SELECT id, 'target_symbol_id', file_id FROM r WHERE target_symbol_id IN (SELECT id FROM below)),
every AS (SELECT found.*, r.file_id, 1 AS direct, 0 AS inherited FROM found JOIN r ON r.id = found.relation_id
  UNION ALL SELECT relation_id, ref_field, file_id, 0, 1 FROM inh WHERE NOT EXISTS (SELECT 1 FROM found WHERE found.relation_id = inh.relation_id AND found.ref_field = inh.ref_field))
SELECT ref_field, strftime(make_timestamp(f.last_indexed * 1000000), '%Y-%m') AS month, sum(direct)::BIGINT AS direct, sum(inherited)::BIGINT AS inherited FROM every LEFT JOIN f ON every.file_id = f.id GROUP BY 1, 2""",
}
