"""Queries of the code-intelligence operators over the given tables, with the equivalent SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import embedder
from quern.functions.paths import clean_path
from quern.operators import fts, graph, incremental, lookup, relational, vector
from quern.plans import index
from quern.schema import DEPENDENCY_KINDS, REPORTED_KINDS
from quern.session import cut, table
from quern.sources.parse import parse_files

DIM = 64
ROOT, CALLER_ROOT, DEPTH = "%_mesh", "get_setting", 3
TEXT_QUERY = "lock OR (semaphore AND cache) OR \"cold cache\" NOT zzz"


SHORT = ["id", "name", "qualified_name", "kind", "file_id", "start_line"]


class Tables:
    """The tables as the operators want them: one current row per file, distinct rows, kinds in lower case."""

    def __init__(self, spark: SparkSession, sf: str) -> None:
        self.spark, self.sf = spark, sf

    def files(self, *cols: str) -> DataFrame:
        """The current row of each file, with cleaned paths; only the named columns are read."""
        rows = table(self.spark, self.sf, "files")
        now = incremental.latest_by(rows.select(*dict.fromkeys(("id", "last_indexed", "path", "relative_path", *(cols or rows.columns)))), "id", "last_indexed")
        return now.withColumn("relative_path", clean_path(F.col("relative_path")))

    def symbols(self, *more: str) -> DataFrame:
        """Distinct symbols. Columns are picked before rows are told apart, so the shuffle carries no text unless asked for."""
        return table(self.spark, self.sf, "symbols").select(*SHORT, *more).withColumn("kind", F.lower("kind")).distinct()

    def texts(self) -> DataFrame:
        return self.symbols("signature", "doc_comment", "body_snippet")

    def relations(self) -> DataFrame:
        return table(self.spark, self.sf, "relations").distinct()

    def vectors(self) -> DataFrame:
        """Least sound vector per symbol."""
        v = table(self.spark, self.sf, "symbol_vectors")
        ok = v.where((F.size("vector") == DIM) & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x)))
        return ok.groupBy("symbol_id").agg(F.min("vector").alias("vector"))

    def documents(self) -> DataFrame:
        return table(self.spark, self.sf, "documents")


EDGE = ["id", "source_symbol_id", "target_symbol_name", "target_symbol_id", "kind", "file_id", "line"]

_F = r"""f AS (SELECT * REPLACE (regexp_replace(regexp_replace(regexp_replace(trim(relative_path), '[\\/]+', '/', 'g'), '(^|/)(\./)+', '\1', 'g'), '^/+', '') AS relative_path)
  FROM files QUALIFY row_number() OVER (PARTITION BY id ORDER BY last_indexed DESC, path DESC, relative_path DESC, language DESC, content_hash DESC) = 1)"""
_S = "s AS (SELECT DISTINCT * REPLACE (lower(kind) AS kind) FROM symbols)"
_R = "r AS (SELECT DISTINCT * FROM relations)"
_V = "v AS (SELECT symbol_id, min(vector) AS vector FROM symbol_vectors WHERE len(vector) = 64 AND NOT list_bool_or(list_transform(vector, lambda x: x IS NULL OR isnan(x))) GROUP BY 1)"
_SHORT = "id, name, qualified_name, kind, file_id, start_line"
_EDGE = ", ".join(EDGE)


def _with(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"


QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = lambda spark, sf, f=f: f(Tables(spark, sf))
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


# Lookups and listings


@query(_with(_S) + f"SELECT {_SHORT} FROM s WHERE id = 1")
def q1_symbol_by_id(t):
    return lookup.by_id(t.symbols(), 1).select(*SHORT)


@query(_with(_S) + f"SELECT {_SHORT} FROM s WHERE name ILIKE 'get_sett%' ORDER BY name, id LIMIT 100")
def q2_name_pattern(t):
    return lookup.symbols_by_name(t.symbols(), "get_sett%").select(*SHORT)


@query(_with(_S) + f"SELECT {_SHORT} FROM s WHERE name ILIKE '%tokenize_%' ORDER BY name, id LIMIT 100")
def q3_name_or_part(t):
    return lookup.symbols_by_name_or_part(t.symbols(), "tokenize_").select(*SHORT)


@query(_with(_S) + f"SELECT {_SHORT} FROM s WHERE file_id = 1000")
def q4_file_symbols(t):
    return lookup.symbols_of_file(t.symbols(), 1000).select(*SHORT)


@query(_with(_S, _F) + f"SELECT {_SHORT} FROM s WHERE file_id IN (SELECT id FROM f WHERE relative_path = 'core/runtime_base/src/settings.py')")
def q5_path_symbols(t):
    return lookup.symbols_of_path(t.symbols(), t.files("id"), "core/runtime_base/src/settings.py").select(*SHORT)


@query(_with(_S, _F) + f"SELECT {_SHORT} FROM s WHERE file_id = (SELECT id FROM f WHERE ends_with(relative_path, '.rs') ORDER BY relative_path, id LIMIT 1)")
def q6_path_end_symbols(t):
    return lookup.symbols_of_path_end(t.symbols(), t.files("id"), ".rs").select(*SHORT)


@query(_with(_S) + f"SELECT {_SHORT} FROM s WHERE kind = 'interface'")
def q7_symbols_by_kind(t):
    return lookup.symbols_by_kind(t.symbols(), "interface").select(*SHORT)


@query(_with(_R) + f"SELECT {_EDGE} FROM r WHERE source_symbol_id = (SELECT min(source_symbol_id) FROM r WHERE kind = 'calls' AND target_symbol_id IS NOT NULL)")
def q8_outgoing(t):
    first = t.relations().where("kind = 'calls' AND target_symbol_id IS NOT NULL").agg(F.min("source_symbol_id")).first()[0]
    return lookup.outgoing(t.relations(), first).select(*EDGE)


@query(_with(_R) + f"SELECT {_EDGE} FROM r WHERE target_symbol_id = 1")
def q9_incoming(t):
    return lookup.incoming(t.relations(), 1).select(*EDGE)


@query(_with(_R) + f"SELECT {_EDGE} FROM r WHERE kind = 'implements'")
def q10_relations_by_kind(t):
    return lookup.relations_by_kind(t.relations(), "implements").select(*EDGE)


@query(_with(_F) + "SELECT * FROM f")
def q11_files(t):
    return lookup.list_files(t.files())


@query(_with(_F) + "SELECT id, relative_path FROM f WHERE path = '/srv/checkout/quillon/core/runtime_base/src/settings.py'")
def q12_file_by_path(t):
    return lookup.file_by_path(t.files(), "/srv/checkout/quillon/core/runtime_base/src/settings.py").select("id", "relative_path")


# Joins and rollups

_RESOLVED = "n AS (SELECT name, min(id) AS id FROM s GROUP BY name), rr AS (SELECT r.* REPLACE (coalesce(r.target_symbol_id, n.id) AS target_symbol_id) FROM r LEFT JOIN n ON r.target_symbol_name = n.name)"


@query(_with(_R, _S, _RESOLVED) + f"SELECT {_EDGE} FROM rr")
def j1_resolve(t):
    return relational.resolve_relations(cut(t.relations()), t.symbols()).select(*EDGE)


@query(_with(_R, _S) + "SELECT count(*) AS attempted, count(*) FILTER (WHERE target_symbol_name IN (SELECT name FROM s)) AS resolved FROM r WHERE target_symbol_id IS NULL")
def j1_counts(t):
    return relational.resolution_counts(t.relations(), t.symbols())


_D = f"""d AS (SELECT DISTINCT sf.relative_path AS source_path, tf.relative_path AS target_path, r.kind FROM r JOIN s a ON r.source_symbol_id = a.id JOIN f sf ON a.file_id = sf.id
  JOIN s b ON r.target_symbol_id = b.id JOIN f tf ON b.file_id = tf.id WHERE sf.id <> tf.id AND r.kind IN {DEPENDENCY_KINDS})"""


def _dependencies(t):
    return relational.file_dependencies(t.relations(), t.symbols(), t.files("id"))


@query(_with(_R, _S, _F, _D) + "SELECT * FROM d")
def j2_file_dependencies(t):
    return _dependencies(t)


@query(_with(_S) + f"SELECT {_SHORT} FROM s WHERE id NOT IN (SELECT symbol_id FROM symbol_vectors WHERE symbol_id IS NOT NULL)")
def j3_unembedded(t):
    return relational.unembedded(t.symbols(), table(t.spark, t.sf, "symbol_vectors")).select(*SHORT)


@query(_with(_S) + f"SELECT {_SHORT} FROM s WHERE id NOT IN (SELECT symbol_id FROM symbol_vectors WHERE symbol_id IS NOT NULL) AND kind NOT IN ('import', 'variable', 'assignment', 'constant')")
def v8_to_embed(t):
    return relational.unembedded(t.symbols(), table(t.spark, t.sf, "symbol_vectors"), skip_kinds=True).select(*SHORT)


_A2 = "a2 AS (SELECT f.relative_path AS file, s.kind, count(*) AS count FROM s JOIN f ON s.file_id = f.id GROUP BY 1, 2)"


@query(_with(_S, _F, _A2) + "SELECT * FROM a2")
def j4_symbol_counts(t):
    return relational.symbol_counts(t.symbols(), t.files("id"))


@query(_with(_S, _F) + "SELECT s.id, s.name, coalesce(f.relative_path, '') AS file_path FROM s LEFT JOIN f ON s.file_id = f.id")
def j7_with_paths(t):
    return relational.with_paths(t.symbols(), t.files("id")).select("id", "name", "file_path")


@query(_with(_R, _S, _F) + """SELECT g.id AS target_id, g.qualified_name AS target, a.name AS source, a.kind AS source_kind, r.kind AS relation_kind, coalesce(f.relative_path, '') AS file_path, r.line, r.id AS relation_id
FROM r JOIN s g ON r.target_symbol_id = g.id JOIN s a ON r.source_symbol_id = a.id LEFT JOIN f ON r.file_id = f.id WHERE g.name ILIKE 'get_setting'""")
def j8_references(t):
    return relational.references(cut(t.relations()), t.symbols(), t.files("id"), lookup.like(F.col("name"), "get_setting"))


@query(_with(_R, _S) + """SELECT r.id AS relation_id, s.id AS symbol_id, s.name, s.qualified_name, s.kind AS symbol_kind, s.file_id, s.start_line FROM r JOIN s ON r.source_symbol_id = s.id
WHERE r.kind = 'implements' AND r.target_symbol_name = (SELECT min(target_symbol_name) FROM r WHERE kind = 'implements' AND target_symbol_name > 'A')""")
def j9_implementations(t):
    r = t.relations()
    name = r.where("kind = 'implements' AND target_symbol_name > 'A'").agg(F.min("target_symbol_name")).first()[0] or ""
    return relational.implementations(r, t.symbols(), name)


@query(_with(_F, _S, _R) + "SELECT (SELECT count(*) FROM f) AS total_files, (SELECT list_sort(list(DISTINCT language)) FROM f) AS languages, (SELECT count(*) FROM s) AS total_symbols, (SELECT count(*) FROM r) AS total_relations, (SELECT count(*) FROM symbol_vectors) AS total_embeddings")
def a1_stats(t):
    return relational.index_stats(t.files("language"), t.symbols(), t.relations(), table(t.spark, t.sf, "symbol_vectors"))


@query(_with(_S, _F, _A2) + """SELECT file, sum(count)::BIGINT AS total, map_from_entries(list_sort(list(struct_pack(k := kind, v := count)))) AS kinds, regexp_extract(file, '^(.*)/[^/]*$', 1) AS dir FROM a2 GROUP BY file""")
def a3_file_counts(t):
    return relational.file_counts(relational.symbol_counts(t.symbols(), t.files("id")))


@query(_with(_R, _S, _F, _D) + "SELECT source_path AS source, target_path AS target, count(*) AS weight, list_sort(list(DISTINCT kind)) AS kinds FROM d GROUP BY 1, 2")
def a4_dependency_links(t):
    return relational.dependency_links(_dependencies(t))


@query(_with(_R, _S, _F, _D) + "SELECT DISTINCT id, regexp_extract(id, '^(.*)/[^/]*$', 1) AS dir FROM (SELECT source_path AS id FROM d UNION ALL SELECT target_path FROM d)")
def a5_dependency_nodes(t):
    return relational.dependency_nodes(_dependencies(t))


_DIR = "CASE WHEN regexp_extract(relative_path, '^(.*)/[^/]*$', 1) = '' THEN '.' ELSE regexp_extract(relative_path, '^(.*)/[^/]*$', 1) END"


@query(_with(_F) + f"SELECT {_DIR} AS dir, list_sort(list(relative_path)) AS files FROM f GROUP BY 1")
def a6_files_per_directory(t):
    return relational.files_per_directory(t.files("id"))


@query(_with(_S) + f"SELECT kind, count(*) AS count FROM s WHERE kind IN {REPORTED_KINDS} GROUP BY 1")
def a7_kind_counts(t):
    return relational.kind_counts(t.symbols())


@query(_with(_F) + "SELECT language, count(*) AS count FROM f GROUP BY 1")
def a8_language_counts(t):
    return relational.language_counts(t.files("language"))


@query(_with(_F, _S, _R) + f"""SELECT 'totals' AS section, 'files' AS name, (SELECT count(*) FROM f) AS count UNION ALL SELECT 'totals', 'symbols', (SELECT count(*) FROM s) UNION ALL SELECT 'totals', 'relations', (SELECT count(*) FROM r)
UNION ALL SELECT 'totals', 'embeddings', (SELECT count(*) FROM symbol_vectors) UNION ALL SELECT 'languages', language, count(*) FROM f GROUP BY language
UNION ALL SELECT 'kinds', kind, count(*) FROM s WHERE kind IN {REPORTED_KINDS} GROUP BY kind UNION ALL SELECT 'directories', {_DIR}, count(*) FROM f GROUP BY 2""")
def a9_project_structure(t):
    return relational.project_structure(t.files("language"), t.symbols(), t.relations(), table(t.spark, t.sf, "symbol_vectors"))


@query(_with(_F, _S) + """SELECT regexp_extract(relative_path, '^(.*)/[^/]*$', 1) AS dir, relative_path AS file, count(*) AS n, min(s.start_line)::BIGINT AS first_line FROM f JOIN s ON s.file_id = f.id GROUP BY 1, 2""")
def a10_structure_tree(t):
    tree = relational.structure_tree(t.files(), t.symbols())
    return tree.select("dir", "file", F.size("symbols").cast("long").alias("n"), F.col("symbols")[0]["line"].cast("long").alias("first_line"))


@query("SELECT count(*) AS count FROM symbol_vectors")
def a11_embedding_count(t):
    return table(t.spark, t.sf, "symbol_vectors").agg(F.count(F.lit(1)).alias("count"))


# Graphs

_ROOT = f"root AS (SELECT id, name FROM s WHERE name ILIKE '{ROOT}' ORDER BY name, id LIMIT 1)"
_CALLER_ROOT = f"root AS (SELECT id, name FROM s WHERE name ILIKE '{CALLER_ROOT}' ORDER BY name, id LIMIT 1)"


def _bfs(a: str, b: str) -> str:
    return f"""c AS (SELECT * FROM r WHERE kind = 'calls' AND target_symbol_id IS NOT NULL),
w(id, lvl) AS (SELECT id, 0 FROM root UNION SELECT c.{b}, w.lvl + 1 FROM w JOIN c ON c.{a} = w.id JOIN s ON s.id = c.{b} WHERE w.lvl < {DEPTH}),
lv AS (SELECT id, min(lvl) AS lvl FROM w GROUP BY id)"""


def _edges(a: str, kind: str) -> str:
    return f"SELECT c.id AS relation_id, source_symbol_id AS source, target_symbol_id AS target, '{kind}' AS kind, file_id, line FROM c JOIN lv ON c.{a} = lv.id WHERE lvl < {DEPTH}"


_NODES = "SELECT s.id, s.name, s.qualified_name, s.kind, s.file_id, s.start_line, lv.lvl FROM lv JOIN s ON s.id = lv.id"


def _graph(t, callers=False):
    return graph.call_graph(t.symbols(), t.relations(), CALLER_ROOT if callers else ROOT, DEPTH, callers)


@query(_with(_R, _S, _ROOT, _bfs("source_symbol_id", "target_symbol_id")) + _NODES)
def g1_callee_nodes(t):
    return _graph(t)[0]


@query(_with(_R, _S, _ROOT, _bfs("source_symbol_id", "target_symbol_id")) + _edges("source_symbol_id", "calls"))
def g1_callee_edges(t):
    return _graph(t)[1]


@query(_with(_R, _S, _CALLER_ROOT, _bfs("target_symbol_id", "source_symbol_id")) + _NODES)
def g2_caller_nodes(t):
    return _graph(t, True)[0]


@query(_with(_R, _S, _CALLER_ROOT, _bfs("target_symbol_id", "source_symbol_id")) + _edges("target_symbol_id", "called_by"))
def g2_caller_edges(t):
    return _graph(t, True)[1]


@query(_with(_R, _S) + """, q AS (SELECT min(target_symbol_name) AS n FROM r WHERE kind IN ('inherits', 'implements') AND target_symbol_name > 'A' AND target_symbol_id IS NOT NULL AND target_symbol_name IN (SELECT name FROM s)),
root AS (SELECT id FROM s WHERE name ILIKE (SELECT n FROM q) ORDER BY name, id LIMIT 1)
SELECT r.id AS relation_id, source_symbol_id AS source, target_symbol_id AS target, target_symbol_name, kind, CASE WHEN source_symbol_id = root.id THEN 'parent' ELSE 'child' END AS role
FROM r, root WHERE kind IN ('inherits', 'implements') AND (source_symbol_id = root.id OR target_symbol_name = (SELECT n FROM q) OR target_symbol_id = root.id)""")
def g3_inheritance(t):
    r, s = t.relations(), t.symbols()
    named = r.where("kind IN ('inherits', 'implements') AND target_symbol_name > 'A' AND target_symbol_id IS NOT NULL")
    name = named.join(s.select(F.col("name").alias("_n")).distinct(), F.col("target_symbol_name") == F.col("_n"), "left_semi").agg(F.min("target_symbol_name")).first()[0]
    return graph.inheritance(s, r, name or "")


SQL["g3_inheritance"] = SQL["g3_inheritance"].replace("\n, q AS", ", q AS")


@query(_with(_R, _S, _ROOT, _bfs("source_symbol_id", "target_symbol_id")) + f"""SELECT e.relation_id, a.qualified_name AS source_name, b.qualified_name AS target_name, e.kind FROM ({_edges("source_symbol_id", "calls")}) e
JOIN ({_NODES}) a ON e.source = a.id JOIN ({_NODES}) b ON e.target = b.id""")
def g5_named_edges(t):
    nodes, edges = _graph(t)
    return graph.named_edges(edges, nodes)


@query(_with(_S) + "SELECT CASE WHEN kind IN ('class', 'struct') THEN 1 WHEN kind = 'function' THEN 2 WHEN kind = 'method' THEN 3 WHEN kind IN ('trait', 'interface') THEN 4 ELSE 5 END::BIGINT AS grp, count(*) AS count FROM s GROUP BY 1")
def g6_kind_groups(t):
    return t.symbols().groupBy(graph.kind_group(F.col("kind")).cast("long").alias("grp")).agg(F.count(F.lit(1)).alias("count"))


# Full text. The SQL counts the tokens of each row and scores them by the same formula.

_TOK = "regexp_extract_all(lower(strip_accents(coalesce({c}, ''))), '[\\p{{L}}\\p{{N}}]+')"
_ALL = " || ".join(_TOK.format(c=c) for c in fts.COLUMNS)


def _bm25(terms: list[str], hit: str, tail: str) -> str:
    counts = ", ".join(f"len(list_filter(t, lambda x: x = '{w}')) AS f{k}" for k, w in enumerate(terms))
    stats = ", ".join(f"count(*) FILTER (WHERE f{k} > 0) AS d{k}" for k in range(len(terms)))
    idf = [f"(CASE WHEN ln((n - d{k} + 0.5) / (d{k} + 0.5)) > 0 THEN ln((n - d{k} + 0.5) / (d{k} + 0.5)) ELSE 1e-6 END)" for k in range(len(terms))]
    score = " + ".join(f"{idf[k]} * f{k} * 2.2 / (f{k} + 1.2 * (0.25 + 0.75 * l / m))" for k in range(len(terms)))
    return _with(_S, f"tok AS (SELECT id, {_ALL} AS t FROM s)", f"c AS (SELECT id, len(t) AS l, {counts} FROM tok)", f"z AS (SELECT count(*) AS n, avg(l) AS m, {stats} FROM c)", f"k AS (SELECT id, -({score}) AS rank FROM c, z WHERE {hit})") + tail


def _rounded(df, *cols):
    return df.select("id", *[F.round(c, 6).alias(c) for c in cols])


@query(_bm25(["lock", "cache"], "f0 > 0 OR f1 > 0", "SELECT id, round(rank, 6) AS rank FROM k"))
def f1_rank_all(t):
    return _rounded(fts.rank_rows(t.texts(), "lock OR cache"), "rank")


@query(_bm25(["semaphore", "lock", "cache"], "f0 > 0 AND f1 > 0 AND NOT f2 > 0", "SELECT id, round(rank, 6) AS rank FROM k ORDER BY k.rank, id LIMIT 50"))
def f1_search(t):
    return _rounded(fts.search(t.texts(), "semaphore lock NOT cache", 50), "rank")


@query(_bm25(["callers", "tokenize"], "f0 > 0 AND f1 > 0", "SELECT id, round(rank, 6) AS rank, round(1 / (1 + abs(rank)), 6) AS score FROM k ORDER BY k.rank, id LIMIT 20"))
def f3_text_search(t):
    return _rounded(fts.text_search(t.texts(), "callers AND tokenize", 20), "rank", "score")


@query(_with(_S, "cols AS (" + " UNION ALL ".join(f"SELECT id, ' ' || array_to_string({_TOK.format(c=c)}, ' ') || ' ' AS x FROM s" for c in fts.COLUMNS) + ")") + "SELECT DISTINCT id FROM cols WHERE contains(x, ' concurrent use since ') ")
def f1_phrase(t):
    return fts.rank_rows(t.texts(), '"concurrent use, since"').select("id")


@query(_with(_S, "cols AS (" + " UNION ALL ".join(f"SELECT id, ' ' || array_to_string({_TOK.format(c=c)}, ' ') || ' ' AS x FROM s" for c in fts.COLUMNS) + ")") + "SELECT DISTINCT id FROM cols WHERE contains(x, ' tokeniz') ORDER BY id LIMIT 20")
def f2_prefix_search(t):
    return fts.prefix_search(t.texts(), "tokeniz")


@query(_with(_S, f"p AS (SELECT unnest({_ALL}) AS term FROM s)") + "SELECT term, count(*) AS n FROM p GROUP BY 1")
def s14_posting_counts(t):
    return fts.postings(t.texts()).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


# Vectors

_DBL = "list_transform(vector, lambda x: x::DOUBLE)"


@query(_with(_V, f"q AS (SELECT symbol_id AS qi, {_DBL} AS q FROM v ORDER BY symbol_id LIMIT 1)") + f"SELECT symbol_id, round(coalesce(list_cosine_similarity({_DBL}, q), 0), 6) AS similarity FROM v, q WHERE list_max(list_transform(vector, lambda x: abs(x))) > 0 ORDER BY list_cosine_similarity({_DBL}, q) DESC, symbol_id LIMIT 20")
def v4_nearest(t):
    v = t.vectors()
    q = v.orderBy("symbol_id").first().vector
    return vector.nearest(v, q, 20).select("symbol_id", F.round("similarity", 6).alias("similarity"))


@query(_with(_V, f"n AS (SELECT symbol_id, {_DBL} AS x FROM v WHERE list_max(list_transform(vector, lambda x: abs(x))) > 0)", "k AS (SELECT a.symbol_id AS query_id, b.symbol_id, list_cosine_similarity(a.x, b.x) AS c FROM n a JOIN n b ON a.symbol_id <> b.symbol_id WHERE a.symbol_id % 100 = 0 QUALIFY row_number() OVER (PARTITION BY a.symbol_id ORDER BY round(c, 12) DESC, b.symbol_id) <= 10)") + "SELECT query_id, symbol_id, round(c, 6) AS similarity FROM k")
def v4_nearest_for_queries(t):
    v = t.vectors()
    near = vector.nearest_for_queries(v, v.where(F.col("symbol_id") % 100 == 0), 10, DIM)
    return near.select("query_id", "symbol_id", F.round("similarity", 6).alias("similarity"))


@query(_with(_V, f"n AS (SELECT symbol_id, {_DBL} AS x FROM v)") + "SELECT symbol_id, round(sqrt(list_sum(list_transform(list_transform(x, lambda y: y / CASE WHEN list_inner_product(x, x) = 0 THEN 1 ELSE sqrt(list_inner_product(x, x)) END), lambda z: z * z))), 6) AS norm FROM n")
def v2_normalized(t):
    unit = t.vectors().select("symbol_id", vector.normalized(F.col("vector")).alias("u"))
    return unit.select("symbol_id", F.round(F.sqrt(F.aggregate("u", F.lit(0.0), lambda s, x: s + x * x)), 6).alias("norm"))


@query(_with(_S) + "SELECT id, concat_ws(' | ', kind || ' ' || name, signature, doc_comment, body_snippet) AS text FROM s WHERE kind NOT IN ('import', 'variable', 'assignment', 'constant')")
def v7_embed_text(t):
    return vector.embeddable(t.texts()).select("id", vector.embed_text().alias("text"))


_H = """x AS (SELECT id, 1 / (1 + abs(rank)) AS t FROM k ORDER BY rank, id LIMIT 40),
y AS (SELECT symbol_id AS id, CASE WHEN list_max(list_transform(vector, lambda x: abs(x))) > 0 THEN list_cosine_similarity(list_transform(vector, lambda x: x::DOUBLE), q) ELSE 0 END AS c FROM v, q ORDER BY 2 DESC, 1 LIMIT 40),
b AS (SELECT coalesce(x.id, y.id) AS id, CASE WHEN t IS NOT NULL AND c IS NOT NULL THEN (t + c) / 2 + 0.1 ELSE coalesce(t, c) END AS score, CASE WHEN c IS NULL THEN 'text' WHEN t IS NULL THEN 'semantic' ELSE 'both' END AS source FROM x FULL JOIN y ON x.id = y.id)
SELECT b.id, s.name, s.qualified_name, s.kind, coalesce(f.relative_path, '') AS file_path, round(score, 6) AS score, source, coalesce(signature, body_snippet, s.kind || ' ' || s.name) AS snippet FROM b JOIN s ON s.id = b.id LEFT JOIN f ON s.file_id = f.id ORDER BY b.score DESC, b.id LIMIT 20"""


@query(_bm25(["semaphore", "lock"], "f0 > 0 AND f1 > 0", "").rstrip() + ",\n" + ",\n".join((_F, _V, f"q AS (SELECT {_DBL} AS q FROM v ORDER BY symbol_id LIMIT 1)", _H)))
def h1_hybrid(t):
    v = t.vectors()
    q = v.orderBy("symbol_id").first().vector
    found = vector.hybrid_search(t.texts(), t.files("id"), v, "semaphore lock", q, 20)
    return found.withColumn("score", F.round("score", 6))


# Sources and incremental index


@query("SELECT doc_id, sha256(text) AS content_hash, strlen(text) AS size_bytes FROM documents WHERE text IS NOT NULL")
def s5_fingerprint(t):
    d = t.documents().where("text IS NOT NULL")
    return d.select("doc_id", F.sha2(F.col("text"), 256).alias("content_hash"), F.octet_length("text").cast("long").alias("size_bytes"))


@query(_with(_F) + "SELECT id, coalesce(CASE regexp_extract(path, '\\.([^./]+)$', 1) WHEN 'py' THEN 'python' WHEN 'pyi' THEN 'python' WHEN 'js' THEN 'javascript' WHEN 'jsx' THEN 'javascript' WHEN 'mjs' THEN 'javascript' WHEN 'cjs' THEN 'javascript' WHEN 'ts' THEN 'typescript' WHEN 'tsx' THEN 'typescript' WHEN 'rs' THEN 'rust' WHEN 'go' THEN 'go' WHEN 'java' THEN 'java' WHEN 'c' THEN 'c' WHEN 'h' THEN 'c' WHEN 'cpp' THEN 'cpp' WHEN 'cc' THEN 'cpp' WHEN 'cxx' THEN 'cpp' WHEN 'hpp' THEN 'cpp' WHEN 'hxx' THEN 'cpp' WHEN 'hh' THEN 'cpp' END, 'unknown') AS language FROM f")
def s3_language(t):
    from quern.schema import language_of

    return t.files().select("id", language_of(F.col("path")).alias("language"))


@query("WITH st AS (SELECT path, lower(trim(content_hash)) AS h FROM index_ledger WHERE run_id IN (SELECT run_id FROM index_runs WHERE status = 'committed') QUALIFY row_number() OVER (PARTITION BY path ORDER BY run_id DESC) = 1), " + _F + " SELECT f.id FROM f LEFT JOIN st USING (path) WHERE st.h IS DISTINCT FROM lower(f.content_hash)")
def s6_changed_files(t):
    state = incremental.state_from_ledger(table(t.spark, t.sf, "index_ledger"), table(t.spark, t.sf, "index_runs"))
    return incremental.changed_records(t.files(), state, "path").select("id")


_ST = "st AS (SELECT path, lower(trim(content_hash)) AS h FROM index_ledger WHERE run_id IN (SELECT run_id FROM index_runs WHERE lower(trim(status)) = 'committed') QUALIFY row_number() OVER (PARTITION BY path ORDER BY run_id DESC, content_hash DESC) = 1)"


@query(_with(_F, _ST) + """SELECT f.id, f.path, f.relative_path, f.language, coalesce(st.h, f.content_hash) AS content_hash, CASE WHEN st.h IS NULL THEN f.size_bytes ELSE 0 END AS size_bytes, CASE WHEN st.h IS NULL THEN f.last_indexed ELSE 7 END AS last_indexed FROM f LEFT JOIN st USING (path)
UNION ALL SELECT (SELECT max(id) FROM f) + row_number() OVER (ORDER BY path), path, path, 'unknown', h, 0, 7 FROM st WHERE path NOT IN (SELECT path FROM f)""")
def s7_upsert_files(t):
    """Current files, brought to the state of the ledger: known paths keep id, relative path and language."""
    state = incremental.state_from_ledger(table(t.spark, t.sf, "index_ledger"), table(t.spark, t.sf, "index_runs"))
    seen = state.select("path", F.col("path").alias("relative_path"), F.lit("unknown").alias("language"), incremental.normal_hash(F.col("content_hash")).alias("content_hash"), F.lit(0).cast("long").alias("size_bytes"))
    return index.upsert_files(t.files(), seen, 7)


@query(_with(_F, _S, _R, "g AS (SELECT id FROM f WHERE language = 'go')", "o AS (SELECT id FROM s WHERE file_id IN (SELECT id FROM g))") + """SELECT id, source_symbol_id, CASE WHEN target_symbol_id NOT IN (SELECT id FROM o) THEN target_symbol_id END AS target_symbol_id
FROM r WHERE file_id NOT IN (SELECT id FROM g) AND source_symbol_id NOT IN (SELECT id FROM o)""")
def s10_delete_files(t):
    """Relations left after the files of one language are deleted: own ones go, edges into them lose their target."""
    rows = {"files": t.files(), "symbols": t.symbols(), "relations": t.relations(), "embeddings": t.vectors()}
    gone = rows["files"].where("language = 'go'").select(F.col("id").alias("file_id"))
    return index.delete_files(rows, gone)["relations"].select("id", "source_symbol_id", "target_symbol_id")


@query(_with(_S) + "SELECT id AS symbol_id, 1.0::DOUBLE AS norm FROM s WHERE kind NOT IN ('import', 'variable', 'assignment', 'constant')")
def v6_embed(t):
    """Hashed vectors of all symbols that get one: their lengths."""
    return _embedded(t).select("symbol_id", F.round(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x)), 4).alias("norm"))


@query()
def v6_vectors(t):
    """The same vectors in full; tests compare them with vectors made one by one."""
    return _embedded(t)


def _embedded(t):
    rows = vector.embeddable(t.texts()).select(F.col("id").alias("symbol_id"), vector.embed_text().alias("text"))
    return embedder.embed_rows(rows, embedder.HashingEmbedder())


@query()
def parse_documents(t):
    """Symbols and calls per language and kind that the parsers find in the listings among the documents."""
    text = F.col("text")
    language = (
        F.when(text.rlike(r"(?m)^\s*(async )?def \w+\("), "python").when(text.rlike(r"(?m)^\s*(pub )?fn \w+"), "rust").when(text.rlike(r"(?m)^\s*func "), "go")
        .when(text.rlike(r"(?m)^\s*(export )?(async )?function "), "typescript").when(text.rlike(r"(?m)^\s*public "), "java").when(text.rlike(r"(?m)^[\w:]+[ *]+\w+\(.*\) *\{"), "cpp").otherwise("unknown")
    )
    files = t.documents().select(F.col("doc_id").alias("file_id"), F.coalesce("rel_path", F.lit("")).alias("relative_path"), language.alias("language"), "text")
    found = parse_files(files.where("language <> 'unknown'")).join(files.select("file_id", "language"), "file_id")
    symbols = found.select("language", F.explode("symbols.kind").alias("kind"))
    return symbols.unionByName(found.select("language", F.explode("relations.kind").alias("kind"))).groupBy("language", "kind").agg(F.count(F.lit(1)).alias("n"))


@query(_with(_S, _R, "rr AS (SELECT DISTINCT * FROM r)", "n AS (SELECT name, min(id) AS id FROM s GROUP BY name)", "c AS (SELECT r.id, source_symbol_id, coalesce(r.target_symbol_id, n.id) AS target FROM r LEFT JOIN n ON r.target_symbol_name = n.name WHERE r.kind = 'calls')", _ROOT, "w(id, lvl) AS (SELECT id, 0 FROM root UNION SELECT c.target, w.lvl + 1 FROM w JOIN c ON c.source_symbol_id = w.id JOIN s ON s.id = c.target WHERE w.lvl < 2)") + "SELECT s.id, s.name, s.qualified_name, s.kind, s.file_id, s.start_line, min(lvl) AS lvl FROM w JOIN s ON s.id = w.id GROUP BY ALL")
def flagship_callees(t):
    """Resolve relations by name, then the callees of one symbol to depth 2."""
    s = t.symbols()
    return graph.call_graph(s, relational.resolve_relations(cut(t.relations()), s), ROOT, 2)[0]


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return QUERIES["flagship_callees"](spark, sf)
