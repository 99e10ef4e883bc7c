"""Exact vector search and hybrid ranking.

Similarities are computed in double. Null vectors and vectors of another length than the query's match nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators import fts
from quern.schema import UNEMBEDDED_KINDS
from quern.session import cut

#: Queries compared in one pass over the rows: the block that travels with the tasks.
QUERY_BLOCK = 4096


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double; 0 where either norm is 0."""
    a, b = a.cast("array<double>"), b.cast("array<double>")
    norms = F.sqrt(_sum(F.transform(a, lambda x: x * x))) * F.sqrt(_sum(F.transform(b, lambda x: x * x)))
    return F.coalesce(F.try_divide(_sum(F.zip_with(a, b, lambda x, y: x * y)), F.when(norms != 0, norms)), F.lit(0.0))


def normalized(v: Column) -> Column:
    """The unit vector; a zero vector stays as it is."""
    v = v.cast("array<double>")
    norm = F.sqrt(_sum(F.transform(v, lambda x: x * x)))
    return F.when(norm == 0, v).otherwise(F.transform(v, lambda x: F.try_divide(x, norm)))


def nearest(rows: DataFrame, query: list[float], limit: int, id: str = "symbol_id", vector: str = "vector") -> DataFrame:
    """(id, similarity) of the ``limit`` rows most similar to one vector, ties by id."""
    q = F.array(*[F.lit(float(x)) for x in query])
    v = F.col(f"`{vector}`")
    fit = rows.where((F.size(v) == len(query)) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x)))
    return fit.select(F.col(f"`{id}`").alias(id), cosine(v, q).alias("similarity")).orderBy(F.desc("similarity"), id).limit(limit)


def nearest_for_queries(rows: DataFrame, queries: DataFrame, k: int, dim: int, id: str = "symbol_id", vector: str = "vector") -> DataFrame:
    """(query_id, id, similarity): the ``k`` nearest rows of each query (itself excluded), ties by id.

    Queries are taken ``QUERY_BLOCK`` at a time (a bounded block travels with the tasks); each task keeps k
    rows per query of what it has read, so only these few are shuffled.
    """

    def sound(df: DataFrame) -> DataFrame:
        v = F.col(f"`{vector}`").cast("array<double>")
        ok = df.where((F.size(v) == dim) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0))
        return ok.groupBy(F.col(f"`{id}`").cast("long").alias("id")).agg(F.min(v).alias("v"))

    base, asked = sound(rows), sound(queries)
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    slot = F.pmod(F.xxhash64("id"), F.lit(blocks))
    parts = []
    for b in range(blocks):
        got = asked.where(slot == b).orderBy("id").collect()
        ids = np.array([r.id for r in got], dtype=np.int64)
        q = np.array([r.v for r in got], dtype=np.float64).reshape(-1, dim)
        q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
        shared = rows.sparkSession.sparkContext.broadcast((ids, q))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, q = shared.value
            best_s = np.full((len(ids), 0), 0.0)
            best_i = np.zeros((len(ids), 0), dtype=np.int64)
            for batch in batches:
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                n = batch.column(0).to_numpy()
                for lo in range(0, len(n), 4096):
                    s = q @ x[lo : lo + 4096].T
                    part = n[lo : lo + 4096]
                    s[ids[:, None] == part[None, :]] = -np.inf
                    s = np.hstack([best_s, s])
                    i = np.hstack([best_i, np.broadcast_to(part, (len(ids), len(part)))])
                    # rounding makes equal vectors tie exactly, so that ids decide
                    order = np.lexsort((i, -np.round(s, 12)), axis=1)[:, :k]
                    best_s, best_i = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
            flat = np.isfinite(best_s)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(ids, best_s.shape[1])[flat.ravel()]), pa.array(best_i[flat]), pa.array(best_s[flat])], names=["query_id", id, "similarity"]
            )

        parts.append(base.mapInArrow(run, f"query_id long, `{id}` long, similarity double"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("similarity", 12)), id)
    return out.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r")


def embed_text() -> Column:
    """What is embedded of a symbol: kind and name, then signature, documentation and body where present."""
    return F.concat_ws(" | ", F.concat_ws(" ", "kind", "name"), "signature", "doc_comment", "body_snippet")


def embeddable(symbols: DataFrame) -> DataFrame:
    return symbols.where(~F.col("kind").isin(*UNEMBEDDED_KINDS))


def hybrid(text_hits: DataFrame, semantic_hits: DataFrame, symbols: DataFrame, files: DataFrame, limit: int) -> DataFrame:
    """Merge (id, rank) and (id, similarity) hits: both -> mean + 0.1, else the one score; best ``limit`` with snippet."""
    t = text_hits.select("id", (1 / (1 + F.abs("rank"))).alias("_t"))
    both = t.join(semantic_hits.select("id", F.col("similarity").alias("_s")), "id", "full_outer")
    score = F.when(F.col("_t").isNotNull() & F.col("_s").isNotNull(), (F.col("_t") + F.col("_s")) / 2 + 0.1).otherwise(F.coalesce("_t", "_s"))
    source = F.when(F.col("_s").isNull(), "text").when(F.col("_t").isNull(), "semantic").otherwise("both")
    top = both.select("id", score.alias("score"), source.alias("source"))
    # At most 4 x limit hits: only their symbols are told apart, so no text of others is shuffled.
    top = cut(top)
    known = symbols.select("id", "name", "qualified_name", "kind", "file_id", "signature", "body_snippet").join(F.broadcast(top), "id").distinct()
    best = known.orderBy(F.desc("score"), "id").limit(limit)
    names = files.select(F.col("id").alias("_f"), F.col("relative_path").alias("_path")).distinct()
    out = best.join(names, F.col("file_id") == F.col("_f"), "left")
    snippet = F.coalesce("signature", "body_snippet", F.concat_ws(" ", "kind", "name"))
    return out.select("id", "name", "qualified_name", "kind", F.coalesce("_path", F.lit("")).alias("file_path"), "score", "source", snippet.alias("snippet"))


def hybrid_search(symbols: DataFrame, files: DataFrame, vectors: DataFrame | None, query: str, query_vector: list[float] | None, limit: int = 10, score_mode: str = "reference") -> DataFrame:
    """Hybrid search. ``reference`` keeps the published behaviour, where 1 / (1 + |rank|) favours weaker text hits
    among the 2 x limit fetched; ``corrected`` uses |rank| / (1 + |rank|) instead."""
    hits = fts.search(symbols, query, 2 * limit)
    if score_mode == "corrected":
        # the rank whose displayed score is |rank| / (1 + |rank|)
        hits = hits.withColumn("rank", -1 / F.greatest(F.abs("rank"), F.lit(1e-12)))
    elif score_mode != "reference":
        raise ValueError(score_mode)
    if vectors is None or query_vector is None:
        near = hits.select("id", F.lit(0.0).alias("similarity")).limit(0)
    else:
        near = nearest(vectors, query_vector, 2 * limit).withColumnRenamed("symbol_id", "id")
    return hybrid(hits, near, symbols, files, limit)
