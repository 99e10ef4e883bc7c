"""Python sources, by the standard library's syntax tree; broken files are parsed statement by statement."""

from __future__ import annotations

import ast
import re

from quern.sources.parse.model import Parsed, Symbol, snippet

_QUOTES = ('"""', "'''")


class _Walk(ast.NodeVisitor):
    def __init__(self, out: Parsed, source: str, first_line: int = 0) -> None:
        self.out, self.lines, self.shift = out, source.split("\n"), first_line
        # Byte offsets of lines; sources with other line ends are left to the library, which is slower.
        self.raw, self.starts = source.encode(errors="replace"), None
        if not re.search(r"\r(?!\n)|\f", source):
            self.starts = [0]
            for line in self.raw.split(b"\n"):
                self.starts.append(self.starts[-1] + len(line) + 1)
        self.source = source
        self.parent: int | None = None

    def _text(self, node: ast.AST) -> str:
        if self.starts is None:
            return ast.get_source_segment(self.source, node) or ""
        return self.raw[self.starts[node.lineno - 1] + node.col_offset : self.starts[node.end_lineno - 1] + node.end_col_offset].decode(errors="replace")

    def _doc(self, node) -> str | None:
        first = node.body[0] if node.body else None
        if isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant) and isinstance(first.value.value, str):
            text = self._text(first.value)
            for q in _QUOTES:
                while text.startswith(q):
                    text = text[3:]
            for q in _QUOTES:
                while text.endswith(q):
                    text = text[:-3]
            return text.strip()
        return None

    def _inside(self, symbol: int, nodes) -> None:
        before, self.parent = self.parent, symbol
        for n in nodes:
            self.visit(n)
        self.parent = before

    def _add(self, node, kind: str, parent_in_name: bool, signature: str | None, body: str | None) -> int:
        out = self.out
        return out.add(
            Symbol(
                node.name, out.qualified(node.name, self.parent if parent_in_name else None), kind, node.lineno + self.shift, node.end_lineno + self.shift,
                node.col_offset, node.end_col_offset, signature, self._doc(node), body, self.parent,
            )
        )

    def visit_FunctionDef(self, node) -> None:
        for d in node.decorator_list:  # decorators belong to what surrounds the function
            self.visit(d)
        text = self._text(node)
        params = _parenthesis(text)
        signature = f"def {node.name}{params}" + (f"  -> {self._text(node.returns)}" if node.returns else "")
        k = self._add(node, "function" if self.parent is None else "method", True, signature, snippet(text))
        rest = [n for n in ast.iter_child_nodes(node) if n not in node.decorator_list]
        self._inside(k, rest)

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_ClassDef(self, node) -> None:
        for d in node.decorator_list:
            self.visit(d)
        k = self._add(node, "class", False, None, None)
        for base in node.bases:
            if isinstance(base, (ast.Name, ast.Attribute)):
                self.out.relate(k, self._text(base), "inherits", base.lineno + self.shift)
        self._inside(k, [n for n in ast.iter_child_nodes(node) if n not in node.decorator_list])

    def visit_Import(self, node) -> None:
        self.out.add_import(self._text(node), node.lineno + self.shift, node.end_lineno + self.shift)

    visit_ImportFrom = visit_Import

    def visit_Call(self, node) -> None:
        f = node.func
        name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else self._text(f)
        self.out.relate(self.parent, name, "calls", node.lineno + self.shift)
        self.generic_visit(node)


def _parenthesis(text: str) -> str:
    """The parameter list of a function's text."""
    start = text.find("(")
    depth, quote = 0, ""
    for k in range(max(start, 0), len(text)):
        c = text[k]
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
            if not depth:
                return text[start : k + 1]
    return "()"


_CONTINUES = re.compile(r"(?:else|elif|except|finally)\b|[)\]}]")
_COMPOUND = re.compile(r"(?:async\s+)?(?:def|class|if|for|while|with|try|match)\b")


def _parses(lines: list[str]) -> bool:
    try:
        ast.parse("\n".join(lines))
        return True
    except (SyntaxError, ValueError, RecursionError):
        return False


def _repair(lines: list[str]) -> list[str]:
    """As many lines, in which statements that do not parse are ``pass``.

    Statements are told apart by their indentation; of one that fails, the block below it is repaired alone, so a
    broken method costs itself and no line is parsed more often than it is nested.
    """
    full = [k for k, l in enumerate(lines) if l.strip() and not l.lstrip().startswith("#")]
    if not full or _parses(lines):
        return lines
    deep = min(len(lines[k]) - len(lines[k].lstrip()) for k in full)
    groups: list[list[int]] = []
    quoted = decorated = False
    for k in full:
        line = lines[k][deep:]
        if groups and (quoted or decorated or line[:1].isspace() or _CONTINUES.match(line)):
            groups[-1].append(k)
        else:
            groups.append([k])
        if not quoted:
            decorated = line.startswith("@") or (decorated and line[:1].isspace())
        quoted ^= (line.count('"""') + line.count("'''")) % 2 == 1
    out = [""] * len(lines)
    for g in groups:
        a, b = g[0], g[-1] + 1
        part = [l[deep:] for l in lines[a:b]]
        if not _parses(part):
            part = _repair_statement(part)
        out[a:b] = [" " * deep + l if l else "" for l in part]
    return out


def _repair_statement(part: list[str]) -> list[str]:
    nothing = ["pass"] + [""] * (len(part) - 1)
    at = next((k for k, l in enumerate(part) if not l.startswith("@")), 0)
    rest = ["    pass", "finally:", "    pass"] if part[at].startswith("try") else ["    pass"]
    inner = next((k for k in range(at + 1, len(part)) if part[k][:1].isspace() and part[k].strip() and part[k - 1].rstrip().endswith(":") and _parses([*part[:k], *rest])), None)
    if not _COMPOUND.match(part[at]):
        return nothing
    if inner is None:
        # the header is broken: what is defined below it may still be read
        below = [l if l[:1].isspace() else "" for l in part[1:]]
        return ["if True:", *_body(below)] if any(l.strip() for l in below) else nothing
    # clauses after the first (else, except) are repaired with the block they follow
    stop = next((k for k in range(inner, len(part)) if part[k].strip() and not part[k][:1].isspace()), len(part))
    whole = [*part[:inner], *_body(part[inner:stop]), *[""] * (len(part) - stop)]
    if _parses(whole):
        return whole
    # a header that wants another clause (try)
    whole = ["if True:", *[""] * (inner - 1), *whole[inner:]]
    return whole if _parses(whole) else nothing


def _body(lines: list[str]) -> list[str]:
    done = _repair(lines)
    if any(l.strip() and not l.lstrip().startswith("#") for l in done):
        return done
    return ["    pass", *done[1:]] if done else ["    pass"]


def parse_python(source: str, path: str) -> Parsed:
    """Symbols and relations of a module; statements that do not parse are left out, whatever surrounds them."""
    out = Parsed(path)
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        source = "\n".join(_repair(source.replace("\0", " ").expandtabs(8).split("\n")))
        try:
            tree = ast.parse(source)
        except (SyntaxError, ValueError, RecursionError):
            return out
    _Walk(out, source).visit(tree)
    return out
