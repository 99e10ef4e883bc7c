"""The user-facing operations: tools, command line, JSON-RPC over stdio and HTTP routes over one index.

Results that leave the engine are small by definition (limits, one symbol's neighbourhood, rollups per
file); only here are rows collected.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import unquote_plus, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.embedder import Embedder, HashingEmbedder
from quern.operators import fts, graph, lookup, relational, vector
from quern.plans.index import Index
from quern.sources.source_tree import git_rules, scan

DATA_DIRECTORY = ".quern"


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def _short(text: str | None, n: int) -> str:
    return (text or "")[:n].replace("\n    ", "\n")


class Engine:
    """All operations over the tables of an index (or any tables of the same schemas)."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], embedder: Embedder | None = None) -> None:
        self.spark, self.t, self.embedder = spark, tables, embedder

    # Search

    def search(self, query: str, limit: int = 10, score_mode: str = "reference") -> list[dict]:
        vectors = self.t["embeddings"] if self.embedder is not None and not self.t["embeddings"].isEmpty() else None
        q = self.embedder.embed([query])[0].tolist() if vectors is not None else None
        hits = vector.hybrid_search(self.t["symbols"], self.t["files"], vectors, query, q, limit, score_mode)
        return _rows(hits.orderBy(F.desc("score"), "id"))

    def prefix_search(self, text: str, limit: int = 20) -> list[dict]:
        ids = fts.prefix_search(self.t["symbols"], text, limit)
        found = relational.with_paths(self.t["symbols"].join(F.broadcast(ids), "id", "left_semi"), self.t["files"])  # at most ``limit`` ids
        return _rows(found.orderBy("id").select("id", "name", "qualified_name", "kind", "file_path", "start_line"))

    # Symbols and files

    def symbol(self, name: str) -> list[dict]:
        found = lookup.symbols_by_name_or_part(self.t["symbols"], name)
        return _rows(relational.with_paths(found, self.t["files"]).orderBy("name", "id"))

    def file_symbols(self, path: str) -> list[dict]:
        return _rows(lookup.symbols_of_path(self.t["symbols"], self.t["files"], path))

    def file_symbols_by_end(self, path: str) -> list[dict]:
        return _rows(lookup.symbols_of_path_end(self.t["symbols"], self.t["files"], path))

    # Graphs

    def calls(self, name: str, depth: int = 3, callers: bool = False) -> dict:
        nodes, edges = graph.call_graph(self.t["symbols"], self.t["relations"], name, depth, callers)
        named = graph.named_edges(edges, nodes)
        placed = relational.with_paths(nodes, self.t["files"]).withColumn("group", graph.kind_group(F.col("kind")))
        return {
            "root": name,
            "nodes": _rows(placed.orderBy("lvl", "id").select("id", "name", F.col("qualified_name").alias("qualifiedName"), "kind", F.col("file_path").alias("filePath"), F.col("start_line").alias("startLine"), "group")),
            "edges": _rows(named.orderBy("relation_id").select(F.col("source_name").alias("source"), F.col("target_name").alias("target"), F.when(F.col("kind") == "calls", "Calls").otherwise("CalledBy").alias("kind"))),
        }

    def call_tree(self, name: str, depth: int = 3, callers: bool = False) -> list[dict]:
        g = self.calls(name, depth, callers)
        nodes = [{**n, "qualified_name": n["qualifiedName"]} for n in g["nodes"]]
        edges = [{"source": e["target"], "target": e["source"]} if callers else e for e in g["edges"]]
        return graph.as_tree(nodes, edges, name)

    def inheritance(self, name: str) -> dict:
        rows = _rows(graph.inheritance(self.t["symbols"], self.t["relations"], name).orderBy("relation_id"))
        return {"parents": [r for r in rows if r["role"] == "parent"], "children": [r for r in rows if r["role"] == "child"]}

    def implementations(self, name: str) -> list[dict]:
        return _rows(relational.implementations(self.t["relations"], self.t["symbols"], name).orderBy("relation_id"))

    def references(self, name: str) -> dict:
        """Exact matches only; names that merely contain it are listed as suggestions."""
        found = relational.references(self.t["relations"], self.t["symbols"], self.t["files"], lookup.like(F.col("name"), name)).orderBy("target_id", "relation_id")
        rows = _rows(found)
        like = [] if rows else [r["qualified_name"] for r in _rows(lookup.symbols_by_name(self.t["symbols"], f"%{name}%", 20))]
        return {"total": len(rows), "references": rows, "suggestions": like}

    # Rollups

    def stats(self) -> dict:
        return _rows(relational.index_stats(*[self.t[n] for n in ("files", "symbols", "relations", "embeddings")]))[0]

    def structure(self) -> list[dict]:
        return _rows(relational.project_structure(*[self.t[n] for n in ("files", "symbols", "relations", "embeddings")]))

    def structure_tree(self) -> list[dict]:
        return _rows(relational.structure_tree(self.t["files"], self.t["symbols"]))

    def dependencies(self) -> dict:
        d = relational.file_dependencies(self.t["relations"], self.t["symbols"], self.t["files"])
        return {"nodes": _rows(relational.dependency_nodes(d).orderBy("id")), "links": _rows(relational.dependency_links(d).orderBy("source", "target"))}

    def file_counts(self) -> list[dict]:
        return _rows(relational.file_counts(relational.symbol_counts(self.t["symbols"], self.t["files"])).orderBy("file"))


# Tools over JSON-RPC

_NAME = {"name": {"type": "string", "description": "Name of a symbol; % and _ are wildcards"}}
_DEPTH = {"depth": {"type": "integer", "description": "Levels to follow (default 2)"}}
TOOLS = {
    "search": ("Hybrid text and vector search over symbols", {"query": {"type": "string"}, "limit": {"type": "integer"}}, ["query"], lambda e, a: e.search(a["query"], int(a.get("limit", 10)))),
    "get_symbol": ("Symbols by name, or containing it", _NAME, ["name"], lambda e, a: e.symbol(a["name"])),
    "get_callers": ("Who calls a symbol", _NAME | _DEPTH, ["name"], lambda e, a: e.calls(a["name"], int(a.get("depth", 2)), True)),
    "get_callees": ("What a symbol calls", _NAME | _DEPTH, ["name"], lambda e, a: e.calls(a["name"], int(a.get("depth", 2)))),
    "get_inheritance": ("Parents and children of a type", _NAME, ["name"], lambda e, a: e.inheritance(a["name"])),
    "find_implementations": ("Types that implement a name", _NAME, ["name"], lambda e, a: e.implementations(a["name"])),
    "get_file_symbols": ("Symbols of a file, by the end of its path", {"path": {"type": "string"}}, ["path"], lambda e, a: e.file_symbols_by_end(a["path"])),
    "get_project_structure": ("Totals, languages, kinds and directories", {}, [], lambda e, a: e.structure()),
    "get_references": ("Every reference to a symbol", _NAME, ["name"], lambda e, a: e.references(a["name"])),
}


def render(tool: str, result) -> str:
    """The text a tool answers with."""
    if tool == "get_symbol":
        shown = [f"{r['kind']} {r['qualified_name']} ({r['file_path']}:{r['start_line']})\n  {_short(r['signature'], 200)}\n  {_short(r['doc_comment'], 300)}" for r in result[:20]]
        return "\n".join(shown + ([f"and {len(result) - 20} more"] if len(result) > 20 else [])) or "No symbols found."
    if tool == "get_references" and not result["total"]:
        return "No references found."
    return json.dumps(result, default=str)


def answer(engine: Engine, line: str) -> dict | None:
    """One JSON-RPC request to one response."""
    try:
        request = json.loads(line)
    except json.JSONDecodeError as e:
        return {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": f"Parse error: {e}"}}
    head = {"jsonrpc": "2.0", "id": request.get("id")}
    method, params = request.get("method"), request.get("params") or {}
    if method == "initialize":
        return head | {"result": {"protocolVersion": "2024-11-05", "capabilities": {"tools": {}}, "serverInfo": {"name": "quern", "version": "0.1.0"}}}
    if method in ("notifications/initialized", "ping"):
        return head | {"result": {}}
    if method == "tools/list":
        tools = [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": p, "required": r}} for n, (d, p, r, _) in TOOLS.items()]
        return head | {"result": {"tools": tools}}
    if method == "tools/call":
        name, arguments = params.get("name"), params.get("arguments") or {}
        try:
            if name not in TOOLS:
                raise LookupError(f"Unknown tool: {name}")
            missing = [r for r in TOOLS[name][2] if r not in arguments]
            if missing:
                raise LookupError(f"Missing argument: {missing[0]}")
            text = render(name, TOOLS[name][3](engine, arguments))
            return head | {"result": {"content": [{"type": "text", "text": text}]}}
        except Exception as e:
            return head | {"result": {"content": [{"type": "text", "text": f"Error: {e}"}], "isError": True}}
    return head | {"error": {"code": -32601, "message": f"Method not found: {method}"}}


def serve_stdio(engine: Engine) -> None:
    for line in sys.stdin:
        if line.strip():
            print(json.dumps(answer(engine, line), default=str), flush=True)


# HTTP


def route(engine: Engine, target: str) -> tuple[int, object]:
    """(status, JSON value) of a GET request."""
    parts = urlsplit(target)
    path = parts.path
    args = dict(p.partition("=")[::2] for p in parts.query.split("&") if p)
    fixed = {"/api/stats": engine.stats, "/api/structure": engine.structure_tree, "/api/dependencies": engine.dependencies, "/api/file-counts": engine.file_counts}
    try:
        if path == "/":
            return 200, {"name": "quern", "routes": [*fixed, "/api/callgraph/{name}", "/api/search?q=", "/api/file-symbols/{path}"]}
        if path in fixed:
            return 200, fixed[path]()
        if path.startswith("/api/callgraph/"):
            return 200, engine.calls(unquote_plus(path[len("/api/callgraph/") :]), 4)
        if path == "/api/search":
            return 200, engine.prefix_search(unquote_plus(args.get("q", "")), 20)
        if path.startswith("/api/file-symbols/"):
            return 200, engine.file_symbols(unquote_plus(path[len("/api/file-symbols/") :]))
        return 404, {"error": "not found"}
    except Exception as e:
        return 500, {"error": str(e)}


def serve_http(engine: Engine, port: int = 7777) -> HTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self) -> None:
            status, value = route(engine, self.path)
            body = json.dumps(value, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_) -> None:
            return

    return HTTPServer(("127.0.0.1", port), Handler)


# Command line


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    cli = argparse.ArgumentParser(prog="quern", description="Index source trees and query them")
    cli.add_argument("--project", "-p", default=".")
    commands = cli.add_subparsers(dest="command", required=True)
    index = commands.add_parser("index")
    index.add_argument("path", nargs="?")
    index.add_argument("--no-embed", action="store_true")
    index.add_argument("--prune", action="store_true")
    search = commands.add_parser("search")
    search.add_argument("query")
    search.add_argument("-n", "--limit", type=int, default=10)
    calls = commands.add_parser("calls")
    calls.add_argument("name")
    calls.add_argument("-d", "--depth", type=int, default=3)
    calls.add_argument("--callers", action="store_true")
    symbols = commands.add_parser("symbols")
    symbols.add_argument("file")
    for c in (search, calls, symbols):
        c.add_argument("--json", action="store_true")
    commands.add_parser("stats")
    serve = commands.add_parser("serve")
    serve.add_argument("-P", "--port", type=int, default=7777)
    commands.add_parser("mcp")
    a = cli.parse_args(argv)
    root = os.path.abspath(getattr(a, "path", None) or a.project)
    spark = spark or SparkSession.builder.appName("quern").getOrCreate()
    store, embedder = Index(spark, os.path.join(root, DATA_DIRECTORY)), HashingEmbedder()
    if a.command == "index":
        counts = store.run(scan(spark, root, git_rules(root)), None if a.no_embed else embedder, prune=a.prune)
        print(json.dumps(counts))
        return 0
    engine = Engine(spark, store.tables(), embedder)
    if a.command == "serve":
        serve_http(engine, a.port).serve_forever()
    elif a.command == "mcp":
        serve_stdio(engine)
    elif a.command == "stats":
        print("\n".join(f"{k}: {v}" for k, v in engine.stats().items()))
    else:
        try:
            found = engine.search(a.query, a.limit) if a.command == "search" else engine.calls(a.name, a.depth, a.callers) if a.command == "calls" else engine.file_symbols(a.file)
        except (LookupError, ValueError) as e:
            print(f"Error: {e}", file=sys.stderr)
            return 1
        if a.json:
            print(json.dumps(found, default=str))
        elif a.command == "search":
            print("\n".join(f"{r['score']:.3f} {r['kind']} {r['qualified_name']} {r['file_path']}\n    {_short(r['snippet'], 200)}" for r in found))
        elif a.command == "calls":
            print("\n".join(f"{e['source']} -> {e['target']}" for e in found["edges"]) + f"\n{len(found['nodes'])} nodes, {len(found['edges'])} edges")
        else:
            print("\n".join(f"{r['start_line']}-{r['end_line']} {r['kind']} {r['name']}" for r in found))
    return 0


if __name__ == "__main__":
    sys.exit(main())
