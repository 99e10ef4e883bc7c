"""Lookups, rollups, graphs, full text and vectors against sqlite and small fixtures."""

import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern import schema
from quern.functions import embedder as E
from quern.functions.paths import package_of
from quern.operators import fts, graph, lookup, numbering, relational, vector

ROWS = [
    (1, "handle_request", "a::handle_request", "def handle_request(req)", "Handles a café request quickly", "return send(req)"),
    (2, "send", "a::send", None, None, "socket.write(request)"),
    (3, "Server", "b::Server", "class Server", "request request server", None),
    (4, "handler", "b::handler", "fn handler()", "a quick handler of requests", "handle(x)"),
    (5, "loop", "c::loop", None, "", "for request in queue: handle_request(request)"),
    (6, "rest", "c::rest", "fn rest()", "nothing of interest", None),
    (7, "queue", "c::queue", "fn queue()", "the queue holds requests; see handle_request", "x"),
]
TEXT_SCHEMA = "id long, name string, qualified_name string, signature string, doc_comment string, body_snippet string"


@pytest.fixture(scope="module")
def corpus(spark):
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(name, qualified_name, signature, doc_comment, body_snippet)")
    db.executemany("INSERT INTO t(rowid, name, qualified_name, signature, doc_comment, body_snippet) VALUES (?,?,?,?,?,?)", ROWS)
    return spark.createDataFrame(ROWS, TEXT_SCHEMA).cache(), db


@pytest.mark.parametrize(
    "query",
    ["request", "handle request", "queue OR server", "request NOT server", "handle_request", '"quick handler"', "hand*", "name:queue", "{name doc_comment}:request", "-name:queue",
     "^fn", "NEAR(queue holds, 2)", "NEAR(queue requests, 0)", "cafe", "(loop OR rest) AND fn", '"a" + quick', "for AND request AND queue", "REQUEST", "handle NOT (server OR loop)", "doc_comment : requ*"],
)
def test_full_text_matches_sqlite(corpus, query):
    rows, db = corpus
    want = {i: round(r, 6) for i, r in db.execute("SELECT rowid, rank FROM t WHERE t MATCH ? ORDER BY rank", (query,))}
    got = {r.id: round(r["rank"], 6) for r in fts.rank_rows(rows, query).collect()}
    assert got == pytest.approx(want, abs=2e-6)


@pytest.mark.parametrize("query", ["", "a.b", "a,b", "it's", "foo(", '"', "AND", "*", "handle-request", "NOT x", "x NOT", "nocol:x"])
def test_invalid_queries(corpus, query):
    rows, db = corpus
    with pytest.raises(fts.QueryError):
        fts.rank_rows(rows, query)
    with pytest.raises(sqlite3.OperationalError):
        db.execute("SELECT rowid FROM t WHERE t MATCH ?", (query,)).fetchall()


def test_prefix_search_and_scores(corpus):
    rows, _ = corpus
    assert [r.id for r in fts.prefix_search(rows, 'hand"').collect()] == [1, 4, 5, 7]
    scored = fts.text_search(rows, "request", 2).collect()
    assert all(r.score == pytest.approx(1 / (1 + abs(r["rank"]))) for r in scored)
    assert fts.rank_rows(rows.limit(0), "request").count() == 0
    assert {r.term for r in fts.postings(rows.where("id = 2")).where("col = 'name'").collect()} == {"send"}


def test_hybrid_modes(corpus, spark):
    rows, _ = corpus
    symbols = rows.withColumn("kind", F.lit("function")).withColumn("file_id", F.lit(1).cast("long"))
    files = spark.createDataFrame([(1, "a.py")], "id long, relative_path string")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (6, [0.6, 0.8]), (2, [0.0, 0.0])], "symbol_id long, vector array<float>")
    got = {r.id: r for r in vector.hybrid_search(symbols, files, vectors, "request", [1.0, 0.0], 10).collect()}
    ranks = {r.id: r["rank"] for r in fts.search(symbols, "request", 20).collect()}
    assert got[1].score == pytest.approx((1 / (1 + abs(ranks[1])) + 1) / 2 + 0.1) and got[1].source == "both"
    assert got[6].score == pytest.approx(0.6, abs=1e-6) and got[6].source == "semantic" and got[6].snippet == "fn rest()"
    assert got[3].score == pytest.approx(1 / (1 + abs(ranks[3])))
    # the published scores drop the best hits of a text-only search; the corrected mode keeps them
    few = [r.id for r in vector.hybrid_search(symbols, files, None, "request", None, 2).collect()]
    best = [r.id for r in vector.hybrid_search(symbols, files, None, "request", None, 2, "corrected").collect()]
    by_rank = sorted(ranks, key=lambda i: (ranks[i], i))
    assert sorted(few) == sorted(by_rank[2:4]) and sorted(best) == sorted(by_rank[:2])


def test_like_matches_sqlite(spark):
    names = ["handle_request", "handleXrequest", "HANDLE_REQUEST", "É", "é", "a\\b", "a%b", "axb", "", "a.b"]
    db = sqlite3.connect(":memory:")
    df = spark.createDataFrame([(n,) for n in names], "name string")
    for pattern in ["handle_request", "%request", "é", "a\\b", "a%b", "a.b", "%", "", "_"]:
        want = [n for n in names if db.execute("SELECT ? LIKE ?", (n, pattern)).fetchone()[0]]
        assert [r.name for r in df.where(lookup.like(F.col("name"), pattern)).collect()] == want, pattern


SYM = "id long, file_id long, name string, qualified_name string, kind string, start_line int"
REL = "id long, source_symbol_id long, target_symbol_name string, target_symbol_id long, kind string, file_id long, line int"


@pytest.fixture(scope="module")
def code(spark):
    s = spark.createDataFrame([(1, 1, "a", "m::a", "function", 1), (2, 1, "b", "m::b", "function", 2), (3, 2, "c", "n::c", "class", 3), (4, 2, "b", "n::b", "method", 4), (5, 2, "d", "n::d", "class", 9)], SYM)
    r = spark.createDataFrame(
        [(1, 1, "b", 2, "calls", 1, 1), (2, 1, "b", 2, "calls", 1, 2), (3, 2, "c", 3, "calls", 1, 3), (4, 3, "a", 1, "calls", 2, 4), (5, 2, "b", 2, "calls", 1, 5), (6, 1, "b", None, "calls", 1, 6),
         (7, 5, "c", 3, "inherits", 2, 7), (8, 5, "I", None, "implements", 2, 8), (9, 1, "zz", None, "calls", 1, 9)],
        REL,
    )
    f = spark.createDataFrame([(1, "m.py", "python"), (2, "p/n.py", "python")], "id long, relative_path string, language string")
    return s, r, f


def test_call_graph(code):
    s, r, _ = code
    for depth, nodes, edges in [(0, {1}, set()), (1, {1, 2}, {1, 2}), (2, {1, 2, 3}, {1, 2, 3, 5}), (9, {1, 2, 3}, {1, 2, 3, 4, 5})]:
        n, e = graph.call_graph(s, r, "a", depth)
        assert {x.id for x in n.collect()} == nodes and {x.relation_id for x in e.collect()} == edges
    n, e = graph.call_graph(s, r, "a", 1, callers=True)
    assert {x.id for x in n.collect()} == {1, 3} and [x.kind for x in e.collect()] == ["called_by"]
    with pytest.raises(graph.SymbolNotFound):
        graph.call_graph(s, r, "nothing", 1)


def test_inheritance_references_resolution(code):
    s, r, f = code
    assert {(x.relation_id, x.role) for x in graph.inheritance(s, r, "c").collect()} == {(7, "child")}
    assert {(x.relation_id, x.role) for x in graph.inheritance(s, r, "d").collect()} == {(7, "parent"), (8, "parent")}
    assert [x.symbol_id for x in relational.implementations(r, s, "I").collect()] == [5]
    resolved = {x.id: x.target_symbol_id for x in relational.resolve_relations(r, s).collect()}
    assert resolved[6] == 2 and resolved[9] is None and len(resolved) == 9
    assert tuple(relational.resolution_counts(r, s).first()) == (3, 1)
    refs = relational.references(r, s, f, lookup.like(F.col("name"), "b")).collect()
    assert {x.relation_id for x in refs} == {1, 2, 5}


def test_rollups(code):
    s, r, f = code
    d = relational.file_dependencies(r, s, f)
    assert {(x.source_path, x.target_path, x.kind) for x in d.collect()} == {("m.py", "p/n.py", "calls"), ("p/n.py", "m.py", "calls")}
    assert {x.dir for x in relational.dependency_nodes(d).collect()} == {"", "p"}
    assert {x.dir for x in relational.files_per_directory(f).collect()} == {".", "p"}
    counts = {x.file: (x.total, x.kinds) for x in relational.file_counts(relational.symbol_counts(s, f)).collect()}
    assert counts["p/n.py"] == (3, {"class": 2, "method": 1})


def test_tree_has_a_cycle_guard():
    nodes = [{"name": n, "qualified_name": n} for n in "abc"]
    edges = [{"source": "a", "target": "b"}, {"source": "b", "target": "a"}, {"source": "a", "target": "c"}]
    tree = graph.as_tree(nodes, edges, "a")
    assert [c["name"] for c in tree[0]["children"]] == ["b", "c"] and tree[0]["children"][0]["children"][0]["children"] == []


def test_vectors(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((300, 8)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [1.0]), (902, [0.0] * 8), (903, [float("nan")] * 8)]
    df = spark.createDataFrame(rows, "symbol_id long, vector array<float>").repartition(5)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = {}
    for r in vector.nearest_for_queries(df, df.where("symbol_id % 100 = 0"), 5, 8).collect():
        got.setdefault(r.query_id, []).append((-r.similarity, r.symbol_id))
    for q in (0, 100, 200):
        sim = u @ u[q]
        want = [i for i in np.lexsort((np.arange(300), -sim)) if i != q][:5]
        assert [i for _, i in sorted(got[q])] == want
    top = vector.nearest(df, x[7].tolist(), 3).collect()
    assert top[0].symbol_id == 7 and top[0].similarity == pytest.approx(1)
    pair = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0])], "a array<double>, b array<double>")
    assert pair.select(vector.cosine(F.col("a"), F.col("b"))).first()[0] == 0.0


def test_embedder(spark):
    h = E.HashingEmbedder(32)
    assert np.allclose(np.linalg.norm(h.embed(["a b", "c"]), axis=1), 1) and not h.embed([""]).any()
    assert E.blob_to_vector(E.vector_to_blob([1.5, -2.0]) + b"x") == [1.5, -2.0]
    states, mask = np.ones((2, 3, 4)), np.array([[1, 1, 0], [0, 0, 0]])
    assert np.allclose(E.mean_pool(states, mask)[0], 1) and not E.mean_pool(states, mask)[1].any()

    class Fails(E.HashingEmbedder):
        def embed(self, texts):
            if len(texts) > 1 or "bad" in texts:
                raise RuntimeError
            return super().embed(texts)

    df = spark.createDataFrame([(1, "x"), (2, "bad"), (3, None)], "symbol_id long, text string")
    assert sorted(r.symbol_id for r in E.embed_rows(df, Fails(8)).collect()) == [1, 3]


def test_numbering_and_paths(spark):
    df = spark.createDataFrame([(c,) for c in "hgfedcba"], "k string").repartition(3)
    assert [(r.k, r.n) for r in numbering.number(df, ["k"], "n", 5).orderBy("n").collect()] == [(c, 5 + i) for i, c in enumerate("abcdefgh")]
    paths = [("./a/b/c.py", "a/b"), ("a\\b\\c.py", "a/b"), ("a/./b//c.py", "a/b"), ("/a/b/c", "a/b"), ("a/b", None), (None, None)]
    got = spark.createDataFrame(paths, "p string, w string").select(package_of(F.col("p")).alias("g"), "w").collect()
    assert all(r.g == r.w for r in got)
    langs = spark.createDataFrame([("x/a.py",), ("b.h",), ("c.PY",), ("d",)], "p string").select(schema.language_of(F.col("p"))).collect()
    assert [r[0] for r in langs] == ["python", "c", "unknown", "unknown"]


def test_hashing_embedder_reads_whole_texts():
    from quern.functions.embedder import HashingEmbedder

    long = " ".join(f"w{k}" for k in range(200))
    one, two = HashingEmbedder().embed([long, long + " tail"])
    assert (one != two).any()
