"""Text operators: encoding, leakage, quality, pairing. Brute force, round trips and awkward rows."""

import base64
import random

import numpy as np

import pytest

from quern.llm import bpe, gll, leakage, pairs, quality, words

TEXTS = [
    None, "", " ", "\n\n\t ", "hello world", "<|endoftext|> and <|startoftext|>", "it's we'll THEY'RE", "日本語のテキスト、それは", "été Ünïcödé ½ ² Ⅷ", "a" * 5000, "ab" * 700, "=" * 999 + "x",
    "x\x1cy \x85 z w", "👩‍💻 ok﻿", "0123456789 12,345.67", "    indented\n\tcode()  \n", "\r\n\r\n",
]


def test_encoding_equals_public_library(spark):
    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    public = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert bpe.PATTERN == P.PATTERN
    rng = random.Random(5)
    texts = TEXTS + ["".join(rng.choice(["a", "e", "th", " ", "\n", "é", "中", "1", "'s", "_", "Z"]) for _ in range(rng.randrange(60))) for _ in range(200)]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] + [(4, texts[4], "clash")], "doc_id long, text string, ids string").repartition(3)
    got = {}
    for r in bpe.encode_corpus(df).collect():
        got.setdefault(r.doc_id, []).append(r.ids)
    assert len(got) == len(texts) and len(got[4]) == 2  # repeated rows give repeated results
    for i, t in enumerate(texts):
        assert got[i][0] == public.encode_ordinary(t or ""), repr(t)
        assert public.decode(got[i][0]) == (t or "")
    assert bpe.encode_corpus(df.limit(0)).count() == 0


def brute_leaks(docs, items, n=12):
    out = set()
    for i, t in items:
        w = words.normal_words(t) if t else []
        m = min(n, len(w))
        runs = {tuple(w[s : s + m]) for s in range(len(w) - m + 1)} if w else set()
        for d, x in docs:
            v = words.normal_words(x) if x else []
            if any(tuple(v[s : s + m]) in runs for s in range(len(v) - m + 1) if m):
                out.add((d, i))
    return out


def test_retrieval_matches_brute_force_scores():
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(60)] + ["the", "of"] * 12
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([5, 14, 40, 90])))) for i in range(150)]
    index = leakage.ItemIndex(items)
    code = np.array([rng.randrange(-1, len(index.vocabulary)) for _ in range(600)])
    start = np.arange(0, 560, 29)
    stop = start + leakage.PASSAGE
    n, dense = len(index.ids), np.zeros((len(index.vocabulary), len(index.ids)))
    dense[index.key // n, index.key % n] = index.weight
    want = set()
    for p, (a, b) in enumerate(zip(start, stop)):
        score = dense[sorted({c for c in code[a:b].tolist() if c >= 0})].sum(axis=0)
        want |= {(p, i) for i in np.nonzero(score >= index.least)[0].tolist()}
    got = set(zip(*(x.tolist() for x in index._retrieve(code, start, stop))))
    assert got == want and len(want) > 20


def test_only_retrieved_passages_are_verified(monkeypatch):
    text = "one two three four five six seven eight nine ten eleven twelve thirteen"
    index = leakage.ItemIndex([(1, text), (2, "alpha beta gamma"), (3, "")])
    assert index.leaks([text + " more", None, "x alpha beta gamma"]) == [(0, 1), (2, 2)]
    monkeypatch.setattr(index, "_retrieve", lambda *_: (np.zeros(0, np.int64), np.zeros(0, np.int64)))
    assert index.leaks([text]) == []


def test_leaks_match_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    vocabulary = [f"w{k}" for k in range(40)] + ["the", "of", "and"] * 8
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(say(rng.choice([3, 8, 12, 30, 70])))) for i in range(40)] + [(90, None), (91, ""), (92, "..."), (1, "the of and w1 w2")]
    docs = []
    for d in range(150):
        body = say(rng.randrange(0, 300))
        if rng.random() < 0.6:
            src = rng.choice(items[:40])[1].split()
            k = rng.choice([10, 11, 12, 13, len(src)])
            at = rng.randrange(0, max(1, len(src) - k + 1))
            where = rng.randrange(0, len(body) + 1)
            body[where:where] = src[at : at + k]
        docs.append((d, "_".join(body).upper() if d % 7 == 0 else " , ".join(body)))
    docs += [(900, None), (901, ""), (902, "x " * 20_000)]
    df = spark.createDataFrame([(d, t, 1) for d, t in docs] + [(3, docs[3][1], 1)], "doc_id long, text string, item_id int").repartition(4)
    it = spark.createDataFrame([(i, t, 5) for i, t in items] + [(2, items[2][1], 5)], "item_id long, text string, doc_id int")
    want = brute_leaks(docs, items)
    assert len(want) > 30
    assert {(r.doc_id, r.item_id) for r in leakage.find_leaks(df, it).collect()} == want
    monkeypatch.setattr(leakage, "INDEX_BYTES", 20_000)  # several indexes, one after the other
    rows = [(r.doc_id, r.item_id) for r in leakage.find_leaks(df, it).collect()]
    assert set(rows) == want and len(rows) == len(want)
    assert leakage.find_leaks(df, it.limit(0)).count() == 0 and leakage.find_leaks(df.limit(0), it).count() == 0


def test_words():
    assert words.normal_words("Ｆｕｌｌ wi­dth, été a_b&nbsp;c&#101;d​!") == ["full", "width", "été", "a", "b", "ced"]


PROSE = "The graph shows that merge_gateway calls the parser, which keeps every tensor before release. Nobody expects a record to be stale, yet the editor reads it twice."
CASES = {
    "prose": (PROSE, True), "wrapped": ("Title: Notes\n\nThe graph shows that mergeGateway calls\nthe parser, which keeps every tensor before\nrelease. Nobody expects a record to be\nstale, yet the editor reads it twice.", True),
    "upper": (PROSE.upper(), True), "wide": ("".join(chr(ord(c) + 0xFEE0) if 33 <= ord(c) < 127 else c for c in PROSE), True),
    "german": ("Der Puffer wurde geladen, bevor der Treiber die fehlende Liste erreicht hat. Bitte prüfe, ob der Kanal auch dann gelöscht wird.", True),
    "chinese": ("如果队列为空，就不能校验这个快照，需要先更新服务。我们在字段里排序了缓存，因为旧的文件没有被删除。", True),
    "open lines": ("To keep the factory small, we assemble cursors quietly and evict only what it asked for\nBecause the mutex has no owner, its callers lock it themselves and forget the rest", True),
    "few function words": ("Reviewers found 2827 ambiguous mutexes, nobody recovered prefetch_lexer. Slow checkpoints block ProxyMesh, whose frozen lexer normalizes threads.", True),
    "list": ("# Changelog\n- fix: poll the queue\n- as in the heap for citation\n- with or by operand", False), "plain list": ("All of it\nHow to resolve a directory\nNot in the operand\nFor all the clusters", False),
    "table": ("| kind | size |\n| --- | --- |\n| all of it | 3 |", False), "code": ("def f(x):\n    if x is None:\n    raise ValueError(x)\n    return g(x)", False),
    "log": ("2024-03-04T05:45:49Z DEBUG [a-19] throttle the queue of the worker\n" * 4, False), "salad": ("of voucher by was pending then palette all if are be were dense its which on of were", False),
    "repeated": ("You are not logged in here yet.\n" * 30, False), "rule": ("=" * 400 + "sentence", False), "hex": ("00000000  33 a4 e5 c3 a0 43 f3 c7", False),
    "glossary": ("Open points\nwidget (cursor and the passenger),\npassenger (the canvas of the schema),\nfirmware (not in the cursor),\nconfig (when it is nested),", False),
    "base64": ("W8/6gepbR7BwmuKe7Ovos8Crqas4fck8xlTYTuss0vdTosyIxYRGYoAhEbSn6MWmlga7jStIJhwy\nPzTFsm6bsTk3VTYVAXJ92WF3gwXcHHl4nrP5Rh5mlVi7GXEzAx9/cYsCSiD0061ComduLo11Iqjb\n" * 3, False),
    "lower case": ("wir haben den treiber in mertova neu gebaut,\nweil der langsame dienst nicht mehr gezählt\nwurde. der index wurde übersprungen, bevor der\naufruf die gesperrte liste erreicht hat.", True),
    "stray fence": ("The graph shows that the parser keeps every tensor.\n    char * f(const char *s) {\n    return g(s);\n}\n```\nNobody expects a record to be stale, yet the editor reads it twice, and all of it is kept.\nThe fix is to read it once before the release of the next version.", True),
    "quoted": ("| Without the heap a reader cannot tell whether it was\n| upgraded or only secondary. Given a worker,\n| explain how it is read by all of them from the editor.", True),
    "dashes": ("Given The Coroutines And A Widget - Explain How The Iterator Rotates Each Of Them On A Cache - " * 2 + "Does It Really Traverse The Timer - Or Is The Anomaly Only Probed In The Second Pass", True),
    "fragments": ("are atomic because the config\nunder heavy load this is how\nnobody annotates it the old code\nonly in batches that template", False),
}


@pytest.mark.parametrize("name", CASES)
def test_prose_or_not(name):
    judge = quality.Judge({"the", "of", "and", "is", "that", "der", "die", "wenn", "因为", "如果", "我们"})
    text, prose = CASES[name]
    assert (judge.prose_share(text) >= 0.5) is prose


def test_quality_frames(spark):
    rows = [(1, CASES["prose"][0], 9), (2, CASES["list"][0], 9), (3, None, 9), (4, " \n", 9), (5, "", 9), (2, CASES["list"][0], 9), (6, "word " * 50_000, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, word_count int")
    common = spark.createDataFrame([("en", "The", 1), ("en", "of", 2), ("en", None, 3)], "lang string, word string, freq_rank int")
    assert sorted(r.doc_id for r in quality.find_non_prose(df, common).collect()) == [2, 6]
    got = {r.doc_id: r for r in quality.document_statistics(df, common).collect()}
    assert got[1].word_count == len(PROSE.split()) and got[1].prose_share > 0.95 and got[1].mean_word_length == pytest.approx(sum(map(len, PROSE.split())) / len(PROSE.split()))
    assert got[1].common_word_share == pytest.approx(3 / len(PROSE.split()))
    assert got[3].word_count == 0 and got[3].prose_share is None and got[4].prose_share is None
    assert got[6].top_trigram_share > 0.9
    assert quality.document_statistics(df.limit(0), common.limit(0)).count() == 0


DOCS = [  # documentation, name, kept
    ("Turns each tensor into a barrier that other tools can read.", "register_document", True), ("/**\n * Slow on dirty firewalls, prefer evict_itinerary.\n */", "scan_barrier", True),
    ("我们在日志里更新了队列，因为旧的符号没有被发布。", "merge", True), ("noqa: E501\nHolds the lock only while the queue is being drained.", "f", True), ("@param worker the primary gateway of this node\n@return a dependency", "f", True),
    ("The recover pending channel function.", "recoverPendingChannel", False), ("This method normalizes the heartbeat schema.", "normalizeHeartbeatSchema", False), ("tags observers", "tag_observer", False),
    ("TODO: add a proper description of this function here before the next release", "f", False), ("@param a\n@param b\n@throws IOException\n@return", "f", False), ("Args:\n    document\n    profile\nReturns:\n    None", "f", False),
    ("/*\n * This file is part of x.\n * Redistribution is permitted under the terms of the licence\n * that was shipped with this package.\n */", "f", False), ("Copyright (c) 2024 The Authors. All rights reserved.", "f", False),
    ("// a_b(c, d);\n// e_f(g, h);\n// i_j(k, l);", "f", False), ("See {@link Foo#bar_baz_qux_quux}.", "f", False), ("eslint-disable-next-line no-unused-vars", "f", False), ("#[allow(dead_code, unused_variables, clippy::all)]", "f", False),
    ("-----------", "f", False), ("{@inheritDoc}", "f", False), ("let animation = self.camera.lock().unwrap();\nanimation.delete_heap(camera);", "f", False), ("", "f", False), (None, "f", False), ("Indices of the matrix", "matrix_index", False),
]


@pytest.mark.parametrize("doc,name,kept", DOCS)
def test_telling_documentation(doc, name, kept):
    n, chars, _ = pairs.telling(doc, name)
    assert (n >= pairs.LEAST_WORDS or chars >= pairs.LEAST_CHARS) is kept


SYMBOLS = "id long, name string, qualified_name string, kind string, signature string, doc_comment string, body_snippet string, words string, symbol_id int"


def test_pair_frame(spark):
    good = "Turns each tensor into a barrier that other tools can read."
    rows = [
        (1, "f", "a.py::f", "FUNCTION", "def f()", good, None), (1, "f", "a.py::f", "FUNCTION", "def f()", good, None), (2, "f", "a.py::f", "class", "x", good, "y"), (3, "f", "a.py::f", "method", " ", good, "\n"),
        (4, "f", "a.pyi::f", "Constructor", None, " ", '    """Reads the stale index and splits it until'), (5, "f", "a.go::f", "function", None, None, '    "Reads the stale index and splits it"'), (6, None, None, "function", "s", None, None),
        (None, "f", "a.py::f", "function", "s", good, None), (7, "f", "b.py::f", "method", "s", "x " * 20_000, None), (8, "f", "b.py::f", None, "s", good, None),
    ]
    df = spark.createDataFrame([(*r, "?", 0) for r in rows], SYMBOLS)
    got = {r.symbol_id: r.documentation for r in pairs.pair_functions(df).collect()}
    assert sorted(got) == [1, 4, 7] and got[4].startswith("Reads the stale")
    many = spark.createDataFrame([(i, f"g{i}", "a.go::g", "function", "s", "Stands in for what the generator will write here later.", None, "", 0) for i in range(60)] + [(*rows[0], "", 0)], SYMBOLS)
    assert [r.symbol_id for r in pairs.pair_functions(many).collect()] == [1]  # a template that the corpus repeats describes nothing
    assert pairs.pair_functions(df.limit(0)).count() == 0


BROKEN = '''/** Computes the sum of two numbers without any overflow at all. */
int add(int a, int b) {
  return a + b;
}
def broken(x, y  -> :
# Loads the thing from disk and caches it for later use.
async def load(path: str, n: int = 3) -> dict[str, int]:
    return foo(path)
func (s *Server) Handle(w http.ResponseWriter, r *Request) (int, error) {
pub fn go_on<T: Clone>(x: &T) -> Result<Vec<T>> {
public static List<String> names(Map<String, Integer> m) throws IOException {
if (x) { foo(); }
std::string Foo::bar(const char *p) const {
'''


def test_functions_come_out_of_broken_files(spark):
    names = [f["name"] for f in gll.functions(BROKEN)]
    assert names == ["add", "load", "Handle", "go_on", "names", "bar"]
    assert [f["name"] for f in gll.functions(BROKEN[: BROKEN.index("pub fn")])] == names[:3]
    assert gll.docstring_of('   """Cut off in the mid') == "Cut off in the mid" and gll.docstring_of("x = 1") is None and gll.docstring_of("") is None
    df = spark.createDataFrame([("a", BROKEN), ("b", None), ("c", "")], "path string, text string")
    assert [r.name for r in pairs.extract_pairs(df).orderBy("line").collect()] == ["add", "load"]


def test_left_recursion_and_ambiguity_end():
    tokens = gll.lex("a a a a")
    p = gll.Parse(tokens, "S", 0, {"S": [["S", "S"], ["a"], []]})
    assert p.ends["S", 0] == {0, 1, 2, 3, 4}


FORMS = {
    "class A {\n  public A(int x) {\n  }\n}": ["A"], "A::A(int x) : m(x) {\n}\nA::~A() {\n}": ["A", "A"], "class B {\n  constructor(x) {\n  }\n  load(a: string): Promise<void> {\n  }\n}": ["constructor", "load"],
    "int add(int a, int b)\n{\n  return a;\n}": ["add"], "fn first<'a, 'b>(x: &'a str, y: &'b str) -> &'a str {\n}\nfn next(x: u8) {\n}": ["first", "next"], "def wide(" + ", ".join(f"a{k}" for k in range(300)) + "):\n    pass": ["wide"],
    "/* never closed\nint add(int a) {\n}": ["add"], 'def f(x):\n    """never closed\n\ndef g(y):\n    pass': ["f", "g"], "foreach (x) {\n}\nrun(x);\nif (a) {\n}": [], "def f(a, b\n\ndef g(x):\n    pass": ["g"],
}


@pytest.mark.parametrize("source", FORMS)
def test_forms_of_functions(source):
    assert [f["name"] for f in gll.functions(source)] == FORMS[source]


RUNNING = {
    "ja": "この関数は設定ファイルを読み込み、必要な値を検証してから結果を返します。エラーが起きた場合には、呼び出し元に例外を送ります。",
    "ko": "이 함수는 설정 파일을 읽고 필요한 값을 확인한 다음 결과를 돌려줍니다. 오류가 발생하면 호출한 쪽에 예외를 전달합니다.",
    "ar": "تقرأ هذه الدالة ملف الإعدادات وتتحقق من القيم المطلوبة ثم تعيد النتيجة إلى المستدعي. وإذا حدث خطأ فإنها ترسل استثناء واضحا إلى البرنامج.",
    "hi": "यह फ़ंक्शन सेटिंग फ़ाइल को पढ़ता है और ज़रूरी मानों की जाँच करके परिणाम लौटाता है। यदि कोई त्रुटि होती है तो यह कॉल करने वाले को अपवाद भेजता है।",
    "th": "ฟังก์ชันนี้อ่านไฟล์การตั้งค่าและตรวจสอบค่าที่จำเป็นก่อนส่งผลลัพธ์กลับไปยังผู้เรียก",
    "ru": "Эта функция читает файл настроек и проверяет нужные значения, а затем возвращает результат. Если возникает ошибка, она передаёт исключение вызывающему коду.",
    "pt": "Esta função lê o ficheiro de configuração e verifica os valores necessários antes de devolver o resultado. Se ocorrer um erro, ela envia uma exceção a quem a chamou.",
    "long": "When the worker starts, it reads the file that was written by the scheduler on the night before, looks up every shard that is still marked as open, asks the registry who holds its lease, and, "
    "if nobody answers within the time that an operator has set for this kind of request, takes the lease itself, writes a line to the journal so that a later reader can tell what happened and why, "
    "copies the newest pages into memory while older ones stay on disk, tells all of its neighbours which part of the table they may drop, and waits until each has confirmed; only then does it begin with "
    "the work for which we built it, namely to merge small pieces into larger ones, to throw away records that were deleted long ago, to rebuild the index from what remains, to compare its digest with that of "
    "the copy in the other region, and to report the difference, should there be any, to the people on duty, who can then decide whether the copy or the original ought to be trusted during the next day.",
}
DEBRIS = {
    "salad": "Table running parser Monday blue deployment seventeen window gateway purple cursor lantern bridge.",
    "cycle": "The parser reads the file first. Then the cache is filled again. After that the worker sleeps. Nobody waits for the lock here. The result goes to the queue. " * 9,
    "dominant": "the quick fox " * 60,
    "twice a line": "\n".join(["We read the file and return what it holds."] * 5),
}


@pytest.mark.parametrize("name", [*RUNNING, *DEBRIS])
def test_prose_in_any_script_and_debris(name):
    judge = quality.Judge({"the", "of", "and", "is", "的"})
    share = judge.prose_share(RUNNING.get(name) or DEBRIS[name])
    assert share >= 0.8 if name in RUNNING else share < 0.5


ARROWS = """
// Adds two numbers and returns their sum to the caller.
export const add = (a, b) => a + b;
/** Doubles whatever it is given, twice over. */
const dbl = async (x: number): Promise<number> => {
  return x;
}
let one = x => x + 1;
const y = foo(1);
class A {
  /** Reads the file again from the start. */
  read(a) { return 1; }
}
"""


def test_arrow_functions_and_cut_off_symbols():
    found = {f["name"]: f["doc"] for f in gll.functions(ARROWS)}
    assert list(found) == ["add", "dbl", "one", "read"] and found["one"] is None and "Doubles" in found["dbl"] and "Reads" in found["read"]
    assert gll.function_of("def merge(queue)  -> bytes", '    """Joins both\n    queues', True)["doc"].startswith("Joins both")
    for signature, name in (("void f(const char *a)", "f"), ("func (r *T) Go(a int) error", "Go"), ("public List<String> get(String a)", "get"), ("pub fn run(&self) -> u8", "run"), ("const h = (a)", "h"), ("Ctor(int a)", "Ctor")):
        assert gll.function_of(signature, "    x = 1", False)["name"] == name
    assert gll.function_of(None, "x", False) is None and gll.function_of("  ", "x", True) is None and gll.function_of("@@ nothing", None, False) is None


@pytest.mark.parametrize("others", [0, 3000])
def test_templates_drop_at_any_size_of_the_corpus(spark, others):
    said = lambda n: f"Helper that takes whatever {n} may hold and passes it on to the next layer unchanged."
    rows = [(i, f"take_v{i:03d}x", said(f"take_v{i:03d}x")) for i in range(120)] + [(1000 + i, "copied", "Turns each line of the file into a record with its own number.") for i in range(300)]
    rows += [(5000 + i, f"other{i}", f"Counts the words of chapter {chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)} in the second book again.") for i in range(others)]
    df = spark.createDataFrame([(i, n, f"m.py::{n}", "function", f"def {n}()", d, None) for i, n, d in rows], "id long, name string, qualified_name string, kind string, signature string, doc_comment string, body_snippet string")
    kept = {r.symbol_id for r in pairs.pair_functions(df).select("symbol_id").collect()}
    # the template goes; one function that was copied is no template
    assert kept == {i for i, _, _ in rows if i >= 1000}
