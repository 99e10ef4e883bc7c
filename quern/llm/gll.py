"""A small generalised LL parser (descriptors over a graph-structured stack) and a function grammar.

The grammar is deliberately ambiguous and left-recursive where that is natural; the graph-structured stack
shares the work of all alternatives.  Recovery: where no function starts at a token, the scan moves on by one
token, so functions are found in broken, cut-off and mixed files; nothing after an error is lost.
"""

from __future__ import annotations

import re
from collections import defaultdict

#: Words that are no names of functions.
KEYWORDS = set("if for while switch catch return else do try with match loop in is not and or new delete throw await yield sizeof case".split())
#: Words that may stand before a function's type or name.
MODIFIERS = set("pub async static public private protected final abstract export default inline virtual extern unsafe const constexpr override synchronized native explicit friend open internal".split())

_LEX = re.compile(
    r"(?P<doc>\"\"\"(?:.|\n)*?(?:\"\"\"|\Z)|'''(?:.|\n)*?(?:'''|\Z))"
    r"|(?P<comment>/\*(?:.|\n)*?(?:\*/|\Z)|//[^\n]*|#(?!\[|include|define|if|endif|else|undef|pragma)[^\n]*)"
    r"|(?P<life>(?<=[&<])'[^\W\d]\w*(?!['\w])|(?<=, )'\w+(?=(?:, ?'\w+)*\s*>)|(?<=\+ )'(?:static|[a-z])\b(?=\s*[>,){]))"
    r"|(?P<string>[rbuf]?\"(?:\\.|[^\"\\\n])*\"?|[rbuf]?'(?:\\.|[^'\\\n])*'?)"
    r"|(?P<word>[^\W\d]\w*)|(?P<number>\d[\w.]*)|(?P<line>\n)|(?P<arrow>->|=>|::)|(?P<other>[^\s\w])"
)
#: The same for whole files: a comment or string that is never closed ends with its line.
_RESUMING = re.compile(_LEX.pattern.replace(r"(?:\"\"\"|\Z)", r"\"\"\"|\"\"\"[^\n]*").replace(r"(?:'''|\Z)", r"'''|'''[^\n]*").replace(r"(?:\*/|\Z)", r"\*/|/\*[^\n]*"))
#: Words before a parenthesis and a brace that open a block, not a method.
BLOCKS = set("foreach using lock elseif elif unless until guard select fixed when repeat".split())


class Token:
    __slots__ = ("kind", "text", "at", "line")

    def __init__(self, kind: str, text: str, at: int, line: int) -> None:
        self.kind, self.text, self.at, self.line = kind, text, at, line


def lex(source: str, pattern: re.Pattern = _LEX) -> list[Token]:
    """Tokens with their offset and 1-based line; blanks vanish, line ends stay."""
    out, line = [], 1
    for m in pattern.finditer(source):
        out.append(Token(m.lastgroup, m.group(), m.start(), line))
        line += m.group().count("\n")
    return out


def function_of(signature: str | None, body: str | None, python: bool) -> dict | None:
    """The function whose signature and (cut off) body these are, parsed as a broken file; None if no function starts there."""
    if not signature or not signature.strip():
        return None
    head = signature.rstrip()
    if python:
        head = head if head.endswith(":") else head + ":"
    elif not head.endswith(("{", ";", "=>")):
        head += " =>" if "=" in head and _BINDERS & set(head.split()) else " {"
    found = functions(f"{head}\n{body or ''}", 1)
    return found[0] if found else None


#: Nonterminal -> alternatives. Lower-case names in angle brackets are token tests, other symbols literal text.
GRAMMAR: dict[str, list[list[str]]] = {
    "Function": [["Mods", "def", "Name", "Generic", "Params", "Result"], ["Mods", "function", "Star", "Name", "Generic", "Params", "Result"],
                 ["Mods", "fn", "Name", "Generic", "Params", "Result"], ["Mods", "func", "Receiver", "Name", "Generic", "Params", "Result"],
                 ["Mods", "Type", "Name", "Params", "Tail"], ["Mods", "Type", "Owner", "Name", "Params", "Tail"], ["Method"], ["Arrow"]],
    # Functions bound to a name.
    "Arrow": [["Mods", "Let", "Name", "Annot", "=", "Mods", "Params", "Result", "=>"], ["Mods", "Let", "Name", "Annot", "=", "Mods", "Generic", "Params", "Result", "=>"], ["Mods", "Let", "Name", "=", "Mods", "<name>", "=>"]],
    "Let": [[], ["let"], ["var"]],
    "Annot": [[], [":", "Out"]],
    # Constructors, destructors and methods without a type.
    "Method": [["Mods", "Name", "Generic", "Params", "Tail"], ["Mods", "Owner", "Name", "Params", "Tail"], ["Mods", "Owner", "~", "Name", "Params", "Tail"], ["Mods", "~", "Name", "Params", "Tail"]],
    "Mods": [[], ["Mods", "<modifier>"]],
    "Star": [[], ["*"]],
    "Name": [["<name>"]],
    "Owner": [["<name>", "::"], ["Owner", "<name>", "::"]],
    "Receiver": [[], ["Params"]],
    "Generic": [[], ["<", "Inner", ">"]],
    "Type": [["<name>"], ["Type", "::", "<name>"], ["Type", "<", "Inner", ">"], ["Type", "*"], ["Type", "&"], ["Type", "[", "]"], ["Type", "<name>"]],
    "Params": [["(", "Inner", ")"]],
    "Inner": [[], ["Inner", "Item"]],
    "Item": [["<plain>"], ["(", "Inner", ")"], ["[", "Inner", "]"], ["{", "Inner", "}"]],
    "Result": [[], ["->", "Out"], [":", "Out"], ["Out"]],
    "Out": [["<outword>"], ["Out", "<outword>"], ["Out", "(", "Inner", ")"], ["(", "Inner", ")"]],
    "Tail": [[], ["throws", "Type"], ["const"], ["noexcept"]],
    # A documentation string that opens a body, possibly cut off.
    "DocString": [["Lines", "<doc>"], ["Lines", "<string>"]],
    "Lines": [[], ["Lines", "<line>"]],
}

_TESTS = {
    "<name>": lambda t: t.kind == "word" and t.text not in KEYWORDS and t.text not in MODIFIERS,
    "<modifier>": lambda t: t.kind == "word" and t.text in MODIFIERS,
    "<plain>": lambda t: t.kind in ("word", "number", "string", "line", "arrow", "comment", "doc") or t.text not in "()[]{}",
    "<outword>": lambda t: t.kind in ("word", "arrow", "life") or t.text in ("<", ">", "[", "]", "&", "*", ",", "'", ".", "|"),
    "<doc>": lambda t: t.kind == "doc",
    "<string>": lambda t: t.kind == "string",
    "<line>": lambda t: t.kind == "line",
}


class Parse:
    """All completions (nonterminal, start) -> ends reachable from one start symbol and position."""

    def __init__(self, tokens: list[Token], symbol: str, at: int, grammar: dict[str, list[list[str]]] = GRAMMAR) -> None:
        self.tokens, self.grammar = tokens, grammar
        self.ends: dict[tuple[str, int], set[int]] = defaultdict(set)
        edges: dict[tuple[str, int], set] = defaultdict(set)
        seen, work = set(), []

        def push(slot, node, pos) -> None:
            d = (slot, node, pos)
            if d not in seen:
                seen.add(d)
                work.append(d)

        def call(name: str, pos: int, back) -> None:
            node = (name, pos)
            fresh = node not in edges
            if back not in edges[node]:
                edges[node].add(back)
                if back is not None:  # ends found before serve the new caller too
                    for e in tuple(self.ends[node]):
                        push(back[0], back[1], e)
            if fresh:
                for alt in range(len(grammar[name])):
                    push((name, alt, 0), node, pos)

        call(symbol, at, None)
        while work:
            (name, alt, dot), node, pos = work.pop()
            body = grammar[name][alt]
            while dot < len(body):
                s = body[dot]
                dot += 1
                if s in grammar:
                    call(s, pos, ((name, alt, dot), node))
                    break
                if pos < len(tokens) and (_TESTS[s](tokens[pos]) if s in _TESTS else tokens[pos].text == s):
                    pos += 1
                else:
                    break
            else:
                if pos not in self.ends[node]:
                    self.ends[node].add(pos)
                    for back in tuple(edges[node]):
                        if back is not None:
                            push(back[0], back[1], pos)

    def spans(self, name: str, start: int, end: int, want: str) -> tuple[int, int] | None:
        """The span of ``want`` in some derivation of (name, start, end)."""
        for body in self.grammar[name]:
            got = self._walk(tuple(body), start, end, want)
            if got is not None:
                return got
        return None

    def _walk(self, body, pos, end, want, found=None):
        if not body:
            return found if pos == end else None
        s, rest = body[0], body[1:]
        if s in self.grammar:
            for e in sorted(self.ends.get((s, pos), ()), reverse=True):
                if e <= end:
                    got = self._walk(rest, e, end, want, (pos, e) if s == want else found)
                    if got is not None:
                        return got
            return None
        if pos < end and (_TESTS[s](self.tokens[pos]) if s in _TESTS else self.tokens[pos].text == s):
            return self._walk(rest, pos + 1, end, want, found)
        return None


_OPENERS = {"def", "function", "fn", "func"}
#: Words that bind a name to a value.
_BINDERS = {"const", "let", "var"}


def docstring_of(body: str) -> str | None:
    """The documentation string that opens a body (maybe cut off), without its quotes."""
    tokens = lex(body)
    ends = Parse(tokens, "DocString", 0).ends.get(("DocString", 0))
    if not ends:
        return None
    t = tokens[min(ends) - 1].text
    return t.lstrip("rbufRBUF").strip("\"'") if t else None


def functions(source: str, last_line: int | None = None) -> list[dict]:
    """Functions of a source text of any supported language, broken or whole; with ``last_line`` those that begin by then.

    Each has name, signature, doc (comments right before it, or a string that opens its body), line and body_snippet.
    """
    tokens = lex(source, _RESUMING)
    lines = source.split("\n")
    closes, opened = {}, []
    for n, x in enumerate(tokens):
        if x.text == "(":
            opened.append(n)
        elif x.text == ")" and opened:
            closes[opened.pop()] = n
    out, k, pending = [], 0, []
    while k < len(tokens):
        t = tokens[k]
        if last_line and t.line > last_line:
            break
        if t.kind in ("comment", "doc"):
            pending.append(t)
            k += 1
            continue
        if t.kind == "line":
            if k and tokens[k - 1].kind == "line":
                pending = []
            k += 1
            continue
        starts_line = k == 0 or tokens[k - 1].kind in ("line", "comment") or tokens[k - 1].text in "{};"
        # a function needs a parenthesis on the same line; tokens are parsed only up to the end of its header
        stop, ahead, arrow = k, None, False
        while starts_line and stop < len(tokens):
            x = tokens[stop].text
            if x == "=" and not ahead and any(o.text in _BINDERS for o in tokens[k:stop]):
                arrow = True
            elif x == "=>" and arrow:
                ahead, stop = True, stop + 1
                break
            elif x == "(":
                ahead = True
                if stop not in closes:
                    break
                stop = closes[stop]
            elif x in "{};=" and x or tokens[stop].kind == "line" or (x == ":" and ahead and not arrow):
                break
            stop += 1
        if ahead and starts_line and (t.kind == "word" and t.text not in KEYWORDS or t.text == "~"):
            part = tokens[k:stop]
            parse = Parse(part, "Function", 0)
            ends = parse.ends.get(("Function", 0))
            end = max(ends) if ends else 0
            # the brace may stand on a later line, or after a result or a list of initial values
            brace, result = stop, stop < len(tokens) and tokens[stop].text == ":"
            while brace < len(tokens) and (tokens[brace].kind in ("line", "comment") or result and tokens[brace].text not in ("{", "}", ";")):
                brace += 1
            braced = brace < len(tokens) and tokens[brace].text == "{"
            declared = any(x.text in _OPENERS for x in part[:8]) or braced
            method = parse.ends.get(("Method", 0), ())
            if arrow:
                declared = end == len(part) and part[-1].text == "=>"
            elif end in method and not any(x.text in _OPENERS for x in part[:8]):
                declared = braced and end == len(part) and not any(x.text in BLOCKS for x in part[:1])
            if end and declared:
                span = parse.spans("Function", 0, end, "Name") or parse.spans("Method", 0, end, "Name") or parse.spans("Arrow", 0, end, "Name")
                if span:
                    last = part[end - 1]
                    signature = source[t.at : last.at + (0 if arrow else len(last.text))]
                    first = tokens[stop].line if stop < len(tokens) else last.line
                    if braced and not any(x.text in _OPENERS for x in part[:8]):
                        first = tokens[brace].line
                    rest = source[last.at + len(last.text) :].lstrip(" \t:{=>")
                    if rest.lstrip()[:3] in ('"""', "'''") and rest.lstrip().find(rest.lstrip()[:3], 3) < 0:
                        rest = rest.split("\n\n")[0]  # a string that is never closed
                    doc = "\n".join(x.text for x in pending) or (docstring_of(rest) if t.text == "def" or part[0].text in ("async", "def") else None)
                    body = "\n".join(lines[first : first + 5])
                    out.append({"name": part[span[0]].text, "signature": " ".join(signature.split()), "doc": doc, "line": t.line, "body_snippet": body or None})
                    pending, k = [], k + end
                    continue
        pending = []
        k += 1
    return out


def function_of(signature: str | None, body: str | None, python: bool) -> dict | None:
    """The function whose signature and (cut off) body these are, parsed as a broken file; None if no function starts there."""
    if not signature or not signature.strip():
        return None
    head = signature.rstrip()
    if python:
        head = head if head.endswith(":") else head + ":"
    elif not head.endswith(("{", ";", "=>")):
        head += " =>" if "=" in head and _BINDERS & set(head.split()) else " {"
    found = functions(f"{head}\n{body or ''}", 1)
    return found[0] if found else None
