"""JavaScript, TypeScript, Rust, Go, Java, C and C++: a tolerant scan over tokens with matched brackets.

The scan knows strings, comments and brackets, so declarations are found in files that do not parse as a
whole.  Macros are not expanded and preprocessor branches are all read.
"""

from __future__ import annotations

import bisect
import re

from quern.sources.parse.model import Parsed, Symbol, snippet

_TOKEN = re.compile(
    r"(?P<comment>//[^\n]*|/\*(?:.|\n)*?(?:\*/|\Z))|(?P<string>\"(?:\\.|[^\"\\\n])*\"?|`(?:\\.|[^`\\])*`?|'(?:\\.|[^'\\\n])'|'(?:\\.|[^'\\\n])*')"
    r"|(?P<pre>^[ \t]*\#[ \t]*(?:include|define|if|ifdef|ifndef|elif|else|endif|undef|pragma|error)\b(?:[^\n\\]|\\.|\\\n)*)|(?P<word>[^\W\d][\w$]*|\$[\w$]*)|(?P<number>\d[\w.]*)"
    r"|(?P<op>=>|->|::|\?\.|:=|&&|\|\||[^\s\w])",
    re.M,
)
#: Words that look like calls or types but are neither.
_NOT_CALLS = set("if for while switch catch return else do match loop sizeof typeof instanceof new delete throw await yield function fn func class super in of case assert synchronized defined alignof decltype static_assert async".split())
_CONTROL = set("if for while switch catch else do try return new throw delete case goto sizeof typedef using namespace template operator friend struct enum class union extern".split())
_MODIFIERS = {
    "rust": {"pub", "async", "const", "unsafe", "extern", "default"},
    "java": {"public", "private", "protected", "static", "final", "abstract", "native", "synchronized", "default", "strictfp", "sealed"},
}


class _Scan:
    def __init__(self, source: str, language: str, path: str) -> None:
        self.s, self.lang, self.out = source, language, Parsed(path)
        self.starts = [0]
        for k, c in enumerate(source):
            if c == "\n":
                self.starts.append(k + 1)
        self.all = [(m.lastgroup, m.group(), m.start(), m.end()) for m in _TOKEN.finditer(source)]
        if language not in ("c", "cpp"):
            self.all = [t for t in self.all if t[0] != "pre"]
        self.t = [t for t in self.all if t[0] != "comment"]
        self.all_starts = [t[2] for t in self.all]
        self.match = self._brackets()
        self.inside = self._innermost()
        self.stack: list[tuple[int, int]] = []  # (symbol, token index of its end)
        self.class_bodies: set[int] = set()

    def _brackets(self) -> dict[int, int]:
        pairs, open_at = {}, []
        close = {")": "(", "]": "[", "}": "{"}
        for k, (kind, text, _, _) in enumerate(self.t):
            if kind != "op":
                continue
            if text in "([{":
                open_at.append(k)
            elif text in close:
                # a missing closer is skipped over, a stray one ignored
                for d in range(len(open_at) - 1, -1, -1):
                    if self.t[open_at[d]][1] == close[text]:
                        pairs[open_at[d]] = k
                        del open_at[d:]
                        break
        for k in open_at:
            pairs[k] = len(self.t) - 1
        return pairs

    def _innermost(self) -> list[int]:
        """For each token the innermost bracket around it, -1 at the top."""
        out, open_at = [], []
        for k in range(len(self.t)):
            while open_at and self.match[open_at[-1]] < k:
                open_at.pop()
            out.append(open_at[-1] if open_at else -1)
            if k in self.match:
                open_at.append(k)
        return out

    def text(self, k: int) -> str:
        return self.t[k][1] if 0 <= k < len(self.t) else ""

    def kind(self, k: int) -> str:
        return self.t[k][0] if 0 <= k < len(self.t) else ""

    def line(self, at: int) -> int:
        return bisect.bisect_right(self.starts, at)

    def col(self, at: int) -> int:
        return len(self.s[self.starts[self.line(at) - 1] : at].encode("utf-8", "replace"))

    def span(self, a: int, b: int) -> str:
        """Source text of tokens a to b."""
        return self.s[self.t[a][2] : self.t[min(b, len(self.t) - 1)][3]]

    def parent(self) -> int | None:
        return self.stack[-1][0] if self.stack else None

    def comment_before(self, k: int) -> str | None:
        """The comment right before token k, if nothing but blanks of one line stands between."""
        begin = self.t[k][2]
        at = bisect.bisect_left(self.all_starts, begin)
        before = self.all[at - 1] if at else None
        if before is None or before[0] != "comment" or self.line(before[3] - 1) + 1 < self.line(begin):
            return None
        text = before[1]
        while text.startswith("//"):
            text = text[2:]
        while text.startswith("/*"):
            text = text[2:]
        while text.endswith("*/"):
            text = text[:-2]
        return text.lstrip("#").strip()

    def doc_lines(self, k: int) -> str | None:
        """Contiguous /// or //! lines before token k."""
        run: list[str] = []
        at = bisect.bisect_left(self.all_starts, self.t[k][2]) - 1
        while at >= 0 and self.all[at][0] == "comment" and self.all[at][1].startswith(("///", "//!")):
            run.insert(0, self.all[at][1])
            at -= 1
        return "\n".join(re.sub(r"^(?:///|//!)+", "", c).strip() for c in run) if run else None

    def add(self, name: str, kind: str, a: int, b: int, *, under: bool, signature: str | None = None, body: str | None = None, doc: str | None = None, scope: bool = True) -> int:
        """A symbol over tokens a to b; with ``scope`` it encloses what follows up to b."""
        start, end = self.t[a][2], self.t[min(b, len(self.t) - 1)][3]
        parent = self.parent()
        k = self.out.add(
            Symbol(name, self.out.qualified(name, parent if under else None), kind, self.line(start), self.line(max(start, end - 1)), self.col(start), self.col(end), signature, doc, body, parent)
        )
        if scope:
            self.stack.append((k, b))
        return k

    def statement_start(self, k: int) -> bool:
        return k == 0 or self.text(k - 1) in ("{", "}", ";", ")", ":", "export", "default", "async", "declare", "abstract") or self.kind(k - 1) in ("string", "pre") or self.line(self.t[k - 1][3] - 1) < self.line(self.t[k][2]) and self.text(k - 1) not in ("=", ",", "(", "[", "return", "=>", "?", "&&", "||", "+", ".", "new")

    def end_of_statement(self, k: int, lines: bool = True) -> int:
        """Last token of a statement from k: its semicolon, or the line's end where lines end statements."""
        while k < len(self.t):
            if self.text(k) == ";":
                return k
            if k in self.match:
                k = self.match[k]
            if lines and (k + 1 >= len(self.t) or self.line(self.t[k + 1][2]) > self.line(self.t[k][3] - 1) and self.text(k) not in (",", "=", "from", "|", "&", "=>") and self.text(k + 1) not in ("from", ".", "=", "|", "&", "?")):
                return k
            k += 1
        return len(self.t) - 1

    def back_over(self, k: int, words: set[str]) -> int:
        while k > 0 and (self.text(k - 1) in words or (self.text(k - 1) == ")" and self.text(k - 3) == "(" and self.text(k - 4) in words)):
            k -= 4 if self.text(k - 1) == ")" else 1
        return k

    def find(self, k: int, stops: str) -> int:
        """First token from k that is one of ``stops``, passing over bracket pairs that are not stops."""
        while k < len(self.t):
            x = self.text(k)
            if x in stops and self.kind(k) == "op":
                return k
            k = self.match[k] + 1 if k in self.match else k + 1
        return len(self.t)

    def run(self) -> Parsed:
        step = {"javascript": self.js, "typescript": self.js, "rust": self.rust, "go": self.go, "java": self.java}.get(self.lang, self.c)
        k = 0
        while k < len(self.t):
            while self.stack and k > self.stack[-1][1]:
                self.stack.pop()
            nxt = step(k)
            if nxt is None:
                self.call(k)
                nxt = k + 1
            k = nxt
        return self.out

    def call(self, k: int) -> None:
        """word ( ... ): a call of the nearest enclosing symbol."""
        if self.text(k) != "(" or self.parent() is None:
            return
        p = k - 1
        if self.text(p) == ">" and self.lang in ("rust", "typescript", "java", "cpp"):  # type arguments
            depth = 0
            while p >= 0:
                depth += {">": 1, "<": -1}.get(self.text(p), 0)
                p -= 1
                if not depth:
                    break
            if self.text(p) == "::":
                p -= 1
        if self.kind(p) != "word" or self.text(p) in _NOT_CALLS:
            return
        before = self.text(p - 1)
        if before in ("new", "fn", "func", "function", "def", "class") or (self.lang == "rust" and self.text(p + 1) == "!"):
            return
        self.out.relate(self.parent(), self.text(p), "calls", self.line(self.t[p][2]))

    # Languages. Each looks at token k and returns where to go on, or None if nothing is declared there.

    def js(self, k: int) -> int | None:
        x, out = self.text(k), self.out
        if x == "import" and self.statement_start(k) and self.text(k + 1) not in ("(", "."):
            e = self.end_of_statement(k)
            out.add_import(self.span(k, e), self.line(self.t[k][2]), self.line(self.t[e][3] - 1))
            return e + 1
        if x == "function" and self.statement_start(k):
            n = k + 1 + (self.text(k + 1) == "*")
            if self.kind(n) != "word":
                return None
            p = self.find(n, "(")
            b = self.find(self.match.get(p, p) + 1, "{;")
            if p >= len(self.t) or self.text(b) != "{":
                return None
            a = self.back_over(k, {"async"})
            e = self.match[b]
            self.add(self.text(n), "function", a, e, under=True, signature=f"function {self.text(n)}{self.span(p, self.match[p])}", body=snippet(self.span(a, e)), doc=self.comment_before(self.back_over(a, {"export", "default"})))
            return p + 1
        if x in ("class", "interface") and self.statement_start(k) and self.kind(k + 1) == "word" and (x == "class" or self.lang == "typescript"):
            b = self.find(k + 1, "{")
            if b >= len(self.t):
                return None
            s = self.add(self.text(k + 1), x, k, self.match[b], under=False, doc=self.comment_before(self.back_over(k, {"export", "default", "abstract", "declare"})))
            if x == "class":
                for base in re.split(r",|\bimplements\b", re.sub(r"^.*?\bextends\b|^.*?(?=\bimplements\b)", "", self.span(k + 2, b - 1), flags=re.S) if re.search(r"\b(extends|implements)\b", self.span(k + 2, b - 1)) else ""):
                    self.out.relate(s, re.sub(r"<.*", "", base, flags=re.S).strip(), "inherits", self.line(self.t[k][2]))
                self.class_bodies.add(b)
            return b + 1
        if x == "type" and self.lang == "typescript" and self.statement_start(k) and self.kind(k + 1) == "word" and self.text(self.find(k + 1, "=;{(")) == "=":
            self.add(self.text(k + 1), "type", k, self.end_of_statement(k), under=False, doc=self.comment_before(self.back_over(k, {"export", "declare"})), scope=False)
            return k + 2
        if self.kind(k) == "word" and self.text(k + 1) in ("=", ":") and self.text(k - 1) in ("const", "let", "var", ","):
            v = self.find(k + 1, "=;") + 1
            a = v
            v += self.text(v) == "async"
            if self.text(v) == "(":
                arrow = self.find(self.match[v] + 1, "=;,{") if self.text(self.match[v] + 1) != "=>" else self.match[v] + 1
                arrow = next((q for q in range(self.match[v] + 1, min(len(self.t), self.match[v] + 40)) if self.text(q) in ("=>", ";", "{")), arrow)
            else:
                arrow = v + 1 if self.kind(v) == "word" else v
            if self.text(arrow) != "=>":
                return None
            e = self.match[arrow + 1] if arrow + 1 in self.match and self.text(arrow + 1) == "{" else self.end_of_statement(arrow + 1)
            self.add(self.text(k), "function", k, e, under=True, body=snippet(self.span(a, e)))
            return a
        if x == "(" and self.kind(k - 1) in ("word", "string") and self._in_class_body(k):
            p = self.match.get(k, k)
            b = self.find(p + 1, "{;=")
            name = self.text(k - 1).strip("\"'")
            if self.text(b) == "{" and name not in _CONTROL:
                a = self.back_over(k - 1, {"async", "static", "get", "set", "*", "#", "public", "private", "protected", "readonly", "override"})
                self.add(name, "method", a, self.match[b], under=True, body=snippet(self.span(a, self.match[b])), doc=self.comment_before(a))
                return k + 1
        return None

    def _in_class_body(self, k: int) -> bool:
        return self.inside[k] in self.class_bodies

    def rust(self, k: int) -> int | None:
        x = self.text(k)
        first = self.back_over(k, _MODIFIERS["rust"])
        if x == "use" and self.text(k + 1) != "(":
            e = self.end_of_statement(k, lines=False)
            self.out.add_import(self.span(first, e), self.line(self.t[first][2]), self.line(self.t[e][3] - 1))
            return e + 1
        if x == "fn" and self.kind(k + 1) == "word":
            p = self.find(k + 2, "(")
            b = self.find(self.match.get(p, p) + 1, "{;")
            if self.text(b) != "{":
                return None
            e = self.match[b]
            kind = "function" if self.parent() is None else "method"
            self.add(self.text(k + 1), kind, first, e, under=True, signature=self.span(first, e).split("{")[0].strip(), body=snippet(self.span(first, e)), doc=self.doc_lines(first))
            return b
        if x in ("struct", "enum", "trait") and self.kind(k + 1) == "word":
            b = self.find(k + 2, "{;")
            e = self.match[b] if self.text(b) == "{" else b
            self.add(self.text(k + 1), x, first, e, under=False, doc=self.doc_lines(first))
            return k + 2
        if x == "impl" and (k == 0 or self.text(k - 1) in ("}", ";", "{", "]", "unsafe", "default")):
            b = self.find(k + 1, "{;")
            if self.text(b) != "{":
                return None
            head = re.sub(r"\bwhere\b.*$", "", self.span(k + 1, b - 1), flags=re.S).strip()
            if head.startswith("<"):
                depth = 0
                for i, c in enumerate(head):
                    depth += {"<": 1, ">": -1}.get(c, 0)
                    if not depth:
                        head = head[i + 1 :].strip()
                        break
            trait, _, kind = head.rpartition(" for ")
            s = self.add(f"impl {kind.strip()}", "module", first, self.match[b], under=False)
            self.out.symbols[s].qualified_name = self.out.qualified(kind.strip())
            if trait:
                self.out.relate(s, trait.strip(), "implements", self.line(self.t[first][2]))
            return b + 1
        return None

    def go(self, k: int) -> int | None:
        x = self.text(k)
        if x == "import" and self.statement_start(k):
            e = self.match[k + 1] if self.text(k + 1) == "(" else self.end_of_statement(k)
            self.out.add_import(self.span(k, e), self.line(self.t[k][2]), self.line(self.t[e][3] - 1))
            return e + 1
        if x == "func" and self.statement_start(k):
            receiver = self.text(k + 1) == "("
            n = self.match[k + 1] + 1 if receiver else k + 1
            if self.kind(n) != "word":
                return None
            p = self.find(n + 1, "(")
            b = self.match.get(p, p) + 1
            b = self.find(b, "{") if self.text(b) != "{" else b
            e = self.match.get(b, self.end_of_statement(k))
            self.add(self.text(n), "method" if receiver else "function", k, e, under=False, signature=self.span(k, e).split("{")[0].strip(), body=snippet(self.span(k, e)), doc=self.comment_before(k))
            return p + 1
        if x == "type" and self.statement_start(k):
            n = k + 2 if self.text(k + 1) == "(" else k + 1
            if self.kind(n) != "word":
                return None
            v = self.text(n + 1)
            kind = {"struct": "struct", "interface": "interface"}.get(v, "type")
            e = self.match[k + 1] if n == k + 2 else self.end_of_statement(k)
            self.add(self.text(n), kind, k, e, under=False, doc=self.comment_before(k), scope=False)
            return n + 1
        return None

    def java(self, k: int) -> int | None:
        x = self.text(k)
        if x == "import" and self.statement_start(k):
            e = self.end_of_statement(k, lines=False)
            self.out.add_import(self.span(k, e), self.line(self.t[k][2]), self.line(self.t[e][3] - 1))
            return e + 1
        if x in ("class", "interface") and self.kind(k + 1) == "word" and self.text(k - 1) not in (".", "@"):
            b = self.find(k + 1, "{;")
            if self.text(b) != "{":
                return None
            a = self.back_over(k, _MODIFIERS["java"])
            s = self.add(self.text(k + 1), x, a, self.match[b], under=False, doc=self.comment_before(self._before_annotations(a)))
            head = self.span(k + 2, b - 1) if b > k + 2 else ""
            if x == "class":
                line = self.line(self.t[k][2])
                up = re.search(r"\bextends\s+([\w.]+)", head)
                if up:
                    self.out.relate(s, up.group(1), "inherits", line)
                faces = re.search(r"\bimplements\s+(.*)$", head, re.S)
                for f in re.split(r",(?![^<]*>)", faces.group(1)) if faces else ():
                    self.out.relate(s, re.sub(r"<.*", "", f, flags=re.S).strip(), "implements", line)
            self.class_bodies.add(b)
            return b + 1
        if x == "(" and self.kind(k - 1) == "word" and self._in_class_body(k) and self.text(k - 1) not in _NOT_CALLS and self.text(k - 2) not in ("new", ".", "=", "@"):
            b = self.find(self.match.get(k, k) + 1, "{;=")
            owner = self.out.symbols[self.parent()].name if self.parent() is not None else ""
            name = self.text(k - 1)
            if self.text(b) not in ("{", ";"):
                return None
            a = k - 1
            while a > 0 and (self.kind(a - 1) == "word" or self.text(a - 1) in (">", "]", "[", "<", ",", ".", "?", "@")) and self.text(a - 1) not in ("return", "throw"):
                a -= 1
            e = self.match[b] if self.text(b) == "{" else b
            signature = self.span(a, e).split("{")[0].strip()
            self.add(name, "constructor" if name == owner else "method", a, e, under=True, signature=signature, body=snippet(self.span(a, e)), doc=self.comment_before(self._before_annotations(a)))
            return k + 1
        return None

    def _before_annotations(self, k: int) -> int:
        while k > 1 and self.text(k - 2) == "@":
            k -= 2
        return k

    def c(self, k: int) -> int | None:
        kind, x = self.t[k][0], self.text(k)
        cpp = self.lang == "cpp"
        if kind == "pre":
            text = x.strip()
            at = self.line(self.t[k][2] + len(x) - len(x.lstrip()))
            if re.match(r"#\s*include\b", text):
                self.out.add_import(text, at, self.line(self.t[k][3] - 1))
            m = re.match(r"#\s*define\s+(\w+)(\(?)", text)
            if m:
                self.add(m.group(1), "function" if m.group(2) else "constant", k, k, under=False, doc=self.comment_before(k), scope=False)
            return k + 1
        if x == "namespace" and cpp and self.text(k - 1) != "using":
            b = self.find(k + 1, "{;=")
            if self.text(b) != "{":
                return None
            name = self.span(k + 1, b - 1) if b > k + 1 else "anonymous"
            self.add(name, "module", k, self.match[b], under=False)
            return b + 1
        if x == "typedef":
            e = self.end_of_statement(k, lines=False)
            words = [q for q in range(k, e) if self.kind(q) == "word"]
            depth_free = [q for q in words if not any(o < q < c for o, c in self.match.items() if k < o < e)]
            inner = k + 1
            if self.text(inner) in ("struct", "enum") and self.kind(inner + 1) == "word":
                self.c(inner)
            if depth_free or words:
                name = self.text((depth_free or words)[-1])
                pointer = next((q for q in range(k, e) if self.text(q) == "(" and self.text(q + 1) == "*"), None)
                name = self.text(pointer + 2) if pointer is not None else name
                self.add(name, "type", k, e, under=False, doc=self.comment_before(k), scope=False)
            return e + 1
        if x in ("struct", "enum") or (x == "class" and cpp):
            n = k + 1
            while self.text(n) in ("class", "struct") or (self.text(n) in ("final", "alignas")):
                n += 1
            if self.kind(n) != "word" or (x == "enum" and self.text(k - 1) == "friend"):
                return None
            b = self.find(n + 1, "{;" if self.text(n + 1) == ":" else "{;(=,)*&>")
            body = self.text(b) == "{"
            if x == "class" and not body and self.text(b) != ";":
                return None
            s = self.add(self.text(n), x, k, self.match[b] if body else n, under=False, doc=self.comment_before(k), scope=body)
            if body and cpp and x != "enum" and self.text(n + 1) == ":":
                for base in re.split(r",(?![^<]*>)", self.span(n + 2, b - 1)):
                    base = re.sub(r"\b(?:public|private|protected|virtual)\b", "", base)
                    if x == "class":
                        self.out.relate(s, re.sub(r"<.*", "", base, flags=re.S).strip(), "inherits", self.line(self.t[k][2]))
            return (b if body else n) + 1
        if x == "(" and self.kind(k - 1) == "word" and self.text(k - 1) not in _CONTROL and self.text(k - 1) not in _NOT_CALLS and k in self.match and not self._in_function():
            a = k - 1
            while a > 0 and (self.kind(a - 1) == "word" or self.text(a - 1) in ("*", "&", "::", ">", "<", ",", "~")) and self.text(a - 1) not in ("return", "else", "public", "private", "protected"):
                a -= 1
            if self.text(a) == "template":  # the declaration inside counts, not its parameters
                depth, a = 0, a + 1
                while a < k:
                    depth += {"<": 1, ">": -1}.get(self.text(a), 0)
                    a += 1
                    if not depth:
                        break
            if a == k - 1 and not (cpp and self.parent() is not None):
                return None
            b = self.find(self.match[k] + 1, "{;=,)")
            name = self.text(k - 1)
            if self.text(k - 2) == "::" or self.text(k - 2) == "~":
                name = self.span(max(a, k - 3), k - 1) if self.text(k - 2) == "::" else "~" + name
            if self.text(b) == "{":
                e = self.match[b]
                kind = "method" if cpp and self.parent() is not None else "function"
                self.add(name, kind, a, e, under=cpp, signature=self.span(a, e).split("{")[0].strip(), body=snippet(self.span(a, e)), doc=self.comment_before(a))
                return b if cpp else k + 1  # initialisers of members are no calls
            if self.text(b) == ";" and not cpp:
                self.add(name, "function", a, b, under=False, signature=self.span(a, b).strip().rstrip(";"), doc=self.comment_before(a), scope=False)
                return self.match[k] + 1
        return None

    def _in_function(self) -> bool:
        return bool(self.stack) and self.out.symbols[self.stack[-1][0]].kind in ("function", "method")


def parse_braces(source: str, language: str, path: str) -> Parsed:
    return _Scan(source, language, path).run()
