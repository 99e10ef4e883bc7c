"""Queries of the problems tagged llm, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import bpe, clustering, leakage, matching, pairs, quality
from quern.session import table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return pairs.pair_functions(table(spark, sf, "symbols")).select("symbol_id").distinct()


def p1_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """The kept symbols with their cleaned documentation and code."""
    symbols = table(spark, sf, "symbols")
    kept = pairs.pair_functions(symbols).select("symbol_id", "documentation")
    code = symbols.select(F.col("id").alias("symbol_id"), "signature", "body_snippet").distinct()
    return kept.join(code, "symbol_id")


def p1_extracted(spark: SparkSession, sf: str) -> DataFrame:
    """Documented functions found in the listings among the documents, broken ones included."""
    return pairs.extract_pairs(table(spark, sf, "documents").select("doc_id", "text").distinct(), path="doc_id").withColumnRenamed("path", "doc_id")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return clustering.clusters(table(spark, sf, "symbol_vectors")).select("cluster_id", "symbol_id")


def p4_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Size and most typical members of every cluster."""
    return clustering.describe(clustering.clusters(table(spark, sf, "symbol_vectors")))


def p6_matches(spark: SparkSession, sf: str) -> DataFrame:
    """Matched relations with their confidence."""
    return matching.match_names(*[table(spark, sf, t) for t in ("relations", "symbols", "files")])


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return p6_matches(spark, sf).select("relation_id", "symbol_id")


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.encode_corpus(table(spark, sf, "documents"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.find_leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return quality.find_non_prose(table(spark, sf, "documents"), table(spark, sf, "common_words"))


def p10_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return quality.document_statistics(table(spark, sf, "documents"), table(spark, sf, "common_words"))


QUERIES = {f.__name__: f for f in (p1_found, p1_pairs, p1_extracted, p4_found, p4_clusters, p6_found, p6_matches, p8_ids, p9_found, p10_found, p10_statistics)}
#: A component is a cluster if all its members have the same neighbours (themselves included) and no others.
_CLUSTERS = """
WITH v AS (SELECT symbol_id, min(vector) AS vector FROM symbol_vectors WHERE len(vector) = 64
    AND NOT list_bool_or(list_transform(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) AND list_max(list_transform(vector, lambda x: abs(x))) > 0 GROUP BY 1),
u AS (SELECT symbol_id, list_transform(vector, lambda x: x::DOUBLE) AS x FROM v),
n AS (SELECT a.symbol_id, list_sort(list(b.symbol_id)) AS near FROM u a JOIN u b ON list_cosine_similarity(a.x, b.x) >= 0.8 - 1e-9 GROUP BY 1),
g AS (SELECT near FROM n GROUP BY near HAVING count(*) = len(near) AND len(near) >= 3),
m AS (SELECT near[1] AS cluster_id, unnest(near) AS symbol_id FROM g)"""

SQL: dict[str, str] = {
    "p4_found": _CLUSTERS + " SELECT cluster_id, symbol_id FROM m",
    "p4_clusters": _CLUSTERS + """,
w AS (SELECT m.cluster_id, m.symbol_id, list_transform(u.x, lambda x: x / sqrt(list_inner_product(u.x, u.x))) AS x FROM m JOIN u USING (symbol_id)),
c AS (SELECT cluster_id, list(s ORDER BY k) AS s FROM (SELECT cluster_id, k, sum(x[k]) AS s FROM w, range(1, 65) r(k) GROUP BY 1, 2) GROUP BY 1),
d AS (SELECT w.cluster_id, w.symbol_id, round(list_cosine_similarity(w.x, c.s), 4) AS near FROM w JOIN c USING (cluster_id))
SELECT cluster_id, count(*) AS size, list_slice(list(symbol_id ORDER BY near DESC, symbol_id), 1, 3) AS typical FROM d GROUP BY 1""",
}
