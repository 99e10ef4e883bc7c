"""Call graphs and inheritance.

Breadth-first search is level-synchronous: each level joins the frontier with the edges and drops what was
seen, and is materialised, so plans stay small and a lost executor costs one level at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.lookup import symbols_by_name
from quern.session import cut


class SymbolNotFound(LookupError):
    """No symbol fits the name."""


def root_of(symbols: DataFrame, name: str) -> DataFrame:
    """One row: the first symbol, by name and id, that fits the pattern."""
    return symbols_by_name(symbols, name, 1)


def levels(edges: DataFrame, roots: DataFrame, depth: int, known: DataFrame | None = None) -> DataFrame:
    """(id, lvl): least distance of every node within ``depth`` of ``roots(id)``. Edges: (a, b), a written table.

    A level reads two columns, keeps the edges of the frontier and tells their ends apart; nothing else is shuffled.
    """
    front = cut(roots.select("id").distinct().withColumn("lvl", F.lit(0)))
    seen = front
    links = edges.select(F.col("a").alias("_a"), F.col("b").alias("_b"))
    for lvl in range(1, depth + 1):
        reached = links.join(front.select(F.col("id").alias("_f")), F.col("_a") == F.col("_f")).select(F.col("_b").alias("id")).distinct()
        reached = reached.join(seen, "id", "left_anti")
        front = cut((reached if known is None else reached.join(known, "id", "left_semi")).withColumn("lvl", F.lit(lvl)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def call_graph(symbols: DataFrame, relations: DataFrame, name: str, depth: int, callers: bool = False) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of callees, or callers, of the first symbol that fits ``name``.

    Nodes carry their least level. An edge is listed for every call (multigraph, self-loops, cycles and
    edges to seen nodes included) whose expanded end lies below ``depth``.
    """
    root = cut(root_of(symbols, name).select("id"))
    if root.isEmpty():
        raise SymbolNotFound(name)
    calls = relations.where((F.col("kind") == "calls") & F.col("target_symbol_id").isNotNull())
    a, b = ("target_symbol_id", "source_symbol_id") if callers else ("source_symbol_id", "target_symbol_id")
    # The edges are written once, with what the answer needs of them; ends that are no symbols are dropped from what is reached.
    calls = cut(calls.select("id", "source_symbol_id", "target_symbol_id", "file_id", "line"))
    lv = levels(calls.select(F.col(a).alias("a"), F.col(b).alias("b")), root, depth, symbols.select("id"))
    nodes = symbols.join(lv, "id").select("id", "name", "qualified_name", "kind", "file_id", "start_line", "lvl")
    expanded = lv.where(F.col("lvl") < depth).select(F.col("id").alias("_x"))
    edges = calls.join(expanded, F.col(a) == F.col("_x")).select(
        F.col("id").alias("relation_id"), F.col("source_symbol_id").alias("source"), F.col("target_symbol_id").alias("target"),
        F.lit("called_by" if callers else "calls").alias("kind"), "file_id", "line",
    )
    return nodes, edges


def inheritance(symbols: DataFrame, relations: DataFrame, name: str) -> DataFrame:
    """Edges one hop up and down, inherits and implements, with role parent or child.

    Up: the root's own edges. Down: edges that write exactly ``name`` or point at the root.
    """
    root = root_of(symbols, name).select(F.col("id").alias("_root"))
    both = relations.where(F.col("kind").isin("inherits", "implements"))
    tagged = both.crossJoin(F.broadcast(root))  # the root is one row
    up = F.col("source_symbol_id") == F.col("_root")
    down = (F.col("target_symbol_name") == name) | (F.col("target_symbol_id") == F.col("_root"))
    return tagged.where(up | F.coalesce(down, F.lit(False))).select(
        F.col("id").alias("relation_id"), F.col("source_symbol_id").alias("source"), F.col("target_symbol_id").alias("target"), "target_symbol_name", "kind",
        F.when(up, "parent").otherwise("child").alias("role"),
    )


def named_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with qualified names instead of ids; edges with an end outside ``nodes`` are dropped."""
    n = nodes.select(F.col("id").alias("_i"), F.col("qualified_name").alias("_q"))
    out = edges.join(n, F.col("source") == F.col("_i")).select("relation_id", F.col("_q").alias("source_name"), "target", "kind")
    return out.join(n, F.col("target") == F.col("_i")).select("relation_id", "source_name", F.col("_q").alias("target_name"), "kind")


def kind_group(kind: Column) -> Column:
    return F.when(kind.isin("class", "struct"), 1).when(kind == "function", 2).when(kind == "method", 3).when(kind.isin("trait", "interface"), 4).otherwise(5)


def as_tree(nodes: list[dict], edges: list[dict], name: str) -> list[dict]:
    """Nested callee trees of a graph that was already limited by depth; a node met again on its own path ends it."""
    kids: dict = {}
    for e in edges:
        kids.setdefault(e["source"], []).append(e["target"])
    by = {n["qualified_name"]: n for n in nodes}
    tops = [n for n in nodes if name in n["qualified_name"] or n["name"] == name][:1]
    if not tops:
        pointed = {e["target"] for e in edges}
        tops = [n for n in nodes if n["qualified_name"] not in pointed] or nodes

    def grow(q: str, path: frozenset) -> dict:
        inner = [] if q in path else [grow(t, path | {q}) for t in kids.get(q, ()) if t in by]
        return {**by[q], "children": inner}

    return [grow(n["qualified_name"], frozenset()) for n in tops]
