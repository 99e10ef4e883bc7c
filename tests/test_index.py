"""Parsers, source trees, the index life cycle, streaming and the user-facing operations."""

import json

import pytest

from quern import api
from quern.functions.embedder import HashingEmbedder
from quern.plans.index import Index
from quern.sources.parse import parse
from quern.sources.source_tree import IgnoreRules, git_rules, scan
from quern.streaming.reindex import reindex, saved_files

# language: source, symbols (kind, name, signature, doc, parent), relations (source, target, kind)
FIXTURES = {
    "python": (
        'import os\nclass A(Base, m.Mix):\n    """Doc A."""\n    def run(self, x: int) -> str:\n        """Runs."""\n        def inner():\n            return foo(x)\n        return self.go(x)\ndef top(): return bar()\ntop()\n',
        [("import", "import os", None, None, None), ("class", "A", None, "Doc A.", None), ("method", "run", "def run(self, x: int)  -> str", "Runs.", 1), ("method", "inner", "def inner()", None, 2), ("function", "top", "def top()", None, None)],
        {(1, "Base", "inherits"), (1, "m.Mix", "inherits"), (2, "go", "calls"), (3, "foo", "calls"), (4, "bar", "calls")},
    ),
    "javascript": (
        "import x from './x.js';\n/** Adds. */\nexport async function add(a, b) {\n  return plus(a, b);\n}\nclass Foo extends Bar {\n  // go on\n  static go(x) { this.stop(x); }\n}\nconst f = (a) => {\n  run(a);\n};\nadd(1);\n",
        [("import", "import x from './x.js';", None, None, None), ("function", "add", "function add(a, b)", "* Adds.", None), ("class", "Foo", None, None, None), ("method", "go", None, "go on", 2), ("function", "f", None, None, None)],
        {(1, "plus", "calls"), (2, "Bar", "inherits"), (3, "stop", "calls"), (4, "run", "calls")},
    ),
    "typescript": (
        "interface I { a: number; }\ntype T = string | number;\nexport class K implements I, J { m(x: T): void { call(x); } }\nconst g = async (q: T): Promise<void> => {\n  await call(q);\n};\n",
        [("interface", "I", None, None, None), ("type", "T", None, None, None), ("class", "K", None, None, None), ("method", "m", None, None, 2), ("function", "g", None, None, None)],
        {(2, "I", "inherits"), (2, "J", "inherits"), (3, "call", "calls"), (4, "call", "calls")},
    ),
    "rust": (
        "use std::io;\n/// A point.\n/// Two.\npub struct P { x: i32 }\nimpl Show for P {\n    fn show(&self) -> String {\n        format(self.x)\n    }\n}\npub fn main() { let p = P::new(1); p.show::<T>(); }\n",
        [("import", "use std::io;", None, None, None), ("struct", "P", None, "A point.\nTwo.", None), ("module", "impl P", None, None, None), ("method", "show", "fn show(&self) -> String", None, 2), ("function", "main", "pub fn main()", None, None)],
        {(2, "Show", "implements"), (3, "format", "calls"), (4, "show", "calls")},
    ),
    "go": (
        'package main\nimport (\n  "fmt"\n)\n// Server serves.\ntype Server struct { a int }\nfunc (s *Server) Run(x int) error {\n  return s.go(x)\n}\nfunc main() { fmt.Println(Run(1)) }\n',
        [("import", 'import (\n  "fmt"\n)', None, None, None), ("struct", "Server", None, "Server serves.", None), ("method", "Run", "func (s *Server) Run(x int) error", None, None), ("function", "main", "func main()", None, None)],
        {(2, "go", "calls"), (3, "Println", "calls"), (3, "Run", "calls")},
    ),
    "java": (
        "import a.b.C;\n/** K. */\npublic class K extends Base implements I, J<T> {\n  public K(int x) { init(x); }\n  public List<String> run(Map<String, Integer> m) throws E {\n    return this.go(m);\n  }\n}\ninterface Q { void z(); }\n",
        [("import", "import a.b.C;", None, None, None), ("class", "K", None, "* K.", None), ("constructor", "K", "public K(int x)", None, 1), ("method", "run", "public List<String> run(Map<String, Integer> m) throws E", None, 1), ("interface", "Q", None, None, None), ("method", "z", "void z();", None, 4)],
        {(1, "Base", "inherits"), (1, "I", "implements"), (1, "J", "implements"), (2, "init", "calls"), (3, "go", "calls")},
    ),
    "c": (
        "#include <stdio.h>\n#define MAX 3\n#define ADD(a) (a+1)\nstruct node { int a; };\ntypedef int (*cb)(int);\nenum color { RED };\nint proto(int a);\n/* adds */\nstatic int add(int n, int b) {\n  return plus(n, b);\n}\n",
        [("import", "#include <stdio.h>", None, None, None), ("constant", "MAX", None, None, None), ("function", "ADD", None, None, None), ("struct", "node", None, None, None), ("type", "cb", None, None, None), ("enum", "color", None, None, None), ("function", "proto", "int proto(int a)", None, None), ("function", "add", "static int add(int n, int b)", "adds", None)],
        {(7, "plus", "calls")},
    ),
    "cpp": (
        "namespace ns {\nclass A : public B, private C {\n public:\n  A(int x) : a(x) { init(); }\n  int run() const { return go(); }\n};\ntemplate <typename T> T id(T x) { return x; }\n}\n",
        [("module", "ns", None, None, None), ("class", "A", None, None, 0), ("method", "A", "A(int x) : a(x)", None, 1), ("method", "run", "int run() const", None, 1), ("method", "id", "T id(T x)", None, 0)],
        {(1, "B", "inherits"), (1, "C", "inherits"), (2, "init", "calls"), (3, "go", "calls")},
    ),
}


@pytest.mark.parametrize("language", FIXTURES)
def test_parsers(language):
    source, symbols, relations = FIXTURES[language]
    p = parse(source, language, "p")
    assert [(s.kind, s.name, s.signature, s.doc_comment, s.parent) for s in p.symbols] == symbols
    assert {(s, t, k) for s, t, k, _ in p.relations} == relations
    # cut anywhere, a parser neither fails nor hangs
    for n in range(0, len(source), 7):
        parse(source[:n], language, "p")


def test_parser_details():
    p = parse(FIXTURES["python"][0], "python", "p")
    assert [s.qualified_name for s in p.symbols][1:4] == ["p::A", "p::A::run", "p::run::inner"]
    assert p.symbols[2].body_snippet.splitlines()[0] == '        """Runs."""' and p.symbols[4].body_snippet is None
    assert (p.symbols[0].start_col, p.symbols[0].end_col, p.symbols[2].start_line, p.symbols[2].end_line) == (0, 0, 4, 8)
    broken = parse("def ok():\n    f(1)\nclass Bad(:\n    pass\ndef ok2(a):\n    return g(a)\n", "python", "p")
    assert [s.name for s in broken.symbols] == ["ok", "ok2"]
    assert parse("anything", "unknown", "p").symbols == []


BROKEN = '''import os
def one(a):
    return two(a)
class C(Base):
    def two(self):
        return (1,
    def three(self):
        x =
        return one(3)
    @property
    def four(self) -> int:
        """Doc of four, "é"."""
        try:
            a = 1 +
        except ValueError:
            pass
        return one(4)
def broken(x, y -> :
    def inner(z):
        return one(z)
def five():
    return one(5)
'''


def test_broken_python_loses_only_what_is_broken():
    got = parse(BROKEN, "python", "a.py")
    assert [s.name for s in got.symbols if s.kind != "import"] == ["one", "C", "two", "three", "four", "inner", "five"]
    assert sum("one" in r for r in got.relations) == 4 and sum("two" in r for r in got.relations) == 1
    assert next(s for s in got.symbols if s.name == "four").doc_comment == 'Doc of four, "é".'
    big = "class A:\n" + "".join(f"    def m{k}(self):\n        return {k}{' +' if k % 50 == 0 else ''}\n" for k in range(2000))
    assert len(parse(big, "python", "b.py").symbols) == 2001


def test_ignore_rules():
    rules = IgnoreRules([("", "*.log\n!keep.log\n/out\nbuild/\ndocs/**/x.md\n"), ("sub", "local*\n")])
    hidden = {"a.log": True, "d/b.log": True, "keep.log": False, "out": True, "d/out": False, "build/x": True, "docs/a/b/x.md": True, "docs/x.md": True, "sub/local1": True, "local1": False}
    assert {p: rules.matches(p) for p in hidden} == hidden


@pytest.fixture(scope="module")
def tree(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("tree")
    for path, text in {
        "src/a.py": "def alpha(x):\n    return beta(x)\n", "src/b.py": "def beta(x):\n    return 1\nclass Base:\n    pass\n", "src/c.py": "class Kid(Base):\n    def go(self):\n        return alpha(1)\n",
        "node_modules/z.js": "function q(){}", "notes.txt": "x", ".hidden.py": "def h(): pass", "skip.go": "func Z() {}\n", ".gitignore": "skip.*\n",
    }.items():
        (d / path).parent.mkdir(parents=True, exist_ok=True)
        (d / path).write_text(text)
    (d / "bad.py").write_bytes(b"\xff\xfe")
    return d


def test_index_life_cycle(spark, tree):
    root, ix = str(tree), Index(spark, str(tree / ".quern"))
    look = lambda: scan(spark, root, git_rules(root))
    assert sorted(r.relative_path for r in look().collect()) == ["src/a.py", "src/b.py", "src/c.py"]
    first = ix.run(look(), HashingEmbedder(16), now=1)
    assert (first["changed"], first["attempted"], first["resolved"], first["embedded"]) == (3, 3, 3, 5)
    names = {r.id: r.name for r in ix.tables()["symbols"].collect()}
    assert names == {1: "alpha", 2: "beta", 3: "Base", 4: "Kid", 5: "go"}
    assert ix.run(look(), now=2)["changed"] == 0  # unchanged input is a no-op

    (tree / "src/b.py").write_text("def gamma(x):\n    return 2\n")
    again = ix.run(look(), HashingEmbedder(16), now=3)
    t = ix.tables()
    assert again["changed"] == 1 and {r.id: r.last_indexed for r in t["files"].collect()} == {1: 1, 2: 3, 3: 1}
    assert {r.target_symbol_name: r.target_symbol_id for r in t["relations"].collect()} == {"beta": None, "Base": None, "alpha": 1}
    assert {r.symbol_id for r in t["embeddings"].collect()} == {r.id for r in t["symbols"].collect()}

    (tree / "src/c.py").unlink()
    ix.run(look(), now=4)
    assert ix.tables()["files"].count() == 3  # vanished files stay unless pruned
    ix.run(look(), prune=True, now=5)
    assert ix.tables()["files"].count() == 2 and ix.tables()["relations"].count() == 1

    engine = api.Engine(spark, ix.tables(), HashingEmbedder(16))
    assert engine.stats()["total_files"] == 2
    assert engine.search("alpha", 5)[0]["name"] == "alpha"
    ask = lambda m, **p: api.answer(engine, json.dumps({"jsonrpc": "2.0", "id": 1, "method": m, "params": p}))
    assert len(ask("tools/list")["result"]["tools"]) == 9 and ask("ping")["result"] == {} and ask("nope")["error"]["code"] == -32601
    assert api.answer(engine, "{")["error"]["code"] == -32700
    assert "alpha" in ask("tools/call", name="get_symbol", arguments={"name": "alph"})["result"]["content"][0]["text"]
    assert ask("tools/call", name="get_callees", arguments={"name": "zzz"})["result"]["isError"]
    for tool, arguments in {"get_project_structure": {}, "get_file_symbols": {"path": "b.py"}, "get_references": {"name": "alpha"}, "get_inheritance": {"name": "alpha"}, "find_implementations": {"name": "I"}}.items():
        assert "isError" not in ask("tools/call", name=tool, arguments=arguments)["result"]
    assert api.route(engine, "/api/file-symbols/src%2Fa.py")[1][0]["name"] == "alpha"
    assert api.route(engine, "/api/search?q=")[0] == 500 and api.route(engine, "/x")[0] == 404
    for path in ("/", "/api/stats", "/api/structure", "/api/dependencies", "/api/file-counts", "/api/callgraph/alpha", "/api/search?q=alp"):
        assert api.route(engine, path)[0] == 200
    assert api.main(["-p", root, "calls", "alpha", "--json"], spark) == 0 and api.main(["-p", root, "calls", "zz"], spark) == 1


def test_streaming_reindex(spark, tmp_path):
    inbox, ix = tmp_path / "inbox", Index(spark, str(tmp_path / "ix"))
    inbox.mkdir()
    save = lambda n, text, at: (inbox / f"{n}.json").write_text(json.dumps({"path": "/a.py", "relative_path": "a.py", "language": "python", "text": text, "saved_at": at}))
    save(1, "def one(): pass\n", "2024-01-01T00:00:00Z")
    save(2, "def two(): pass\n", "2024-01-02T00:00:00Z")
    reindex(saved_files(spark, str(inbox)), ix, str(tmp_path / "cp"), once=True).awaitTermination()
    assert [r.name for r in ix.tables()["symbols"].collect()] == ["two"]
    save(3, "def three(): pass\n", "2024-01-03T00:00:00Z")
    reindex(saved_files(spark, str(inbox)), ix, str(tmp_path / "cp"), once=True).awaitTermination()
    assert [r.name for r in ix.tables()["symbols"].collect()] == ["three"]
    save(4, "def old(): pass\n", "2024-01-02T12:00:00Z")  # an older save that comes late
    reindex(saved_files(spark, str(inbox)), ix, str(tmp_path / "cp"), once=True).awaitTermination()
    assert [r.name for r in ix.tables()["symbols"].collect()] == ["three"]
