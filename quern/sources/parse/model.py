"""What a parser collects, and the rules all languages share."""

from __future__ import annotations

from dataclasses import dataclass, field

SNIPPET_LINES = 5


@dataclass
class Symbol:
    name: str
    qualified_name: str
    kind: str
    start_line: int
    end_line: int
    start_col: int
    end_col: int
    signature: str | None = None
    doc_comment: str | None = None
    body_snippet: str | None = None
    parent: int | None = None


@dataclass
class Parsed:
    path: str
    symbols: list[Symbol] = field(default_factory=list)
    relations: list[tuple[int, str, str, int]] = field(default_factory=list)

    def qualified(self, name: str, parent: int | None = None) -> str:
        """path::name, or path::parent::name with one parent level."""
        return f"{self.path}::{name}" if parent is None else f"{self.path}::{self.symbols[parent].name}::{name}"

    def add(self, symbol: Symbol) -> int:
        self.symbols.append(symbol)
        return len(self.symbols) - 1

    def add_import(self, text: str, start_line: int, end_line: int) -> int:
        text = text.strip()
        return self.add(Symbol(text, text, "import", start_line, end_line, 0, 0))

    def relate(self, source: int | None, target: str, kind: str, line: int) -> None:
        """Relations without an enclosing symbol are dropped."""
        if source is not None and target:
            self.relations.append((source, target, kind, line))

    def symbol_rows(self):
        for k, s in enumerate(self.symbols):
            yield (k, s.name, s.qualified_name, s.kind, s.start_line, s.end_line, s.start_col, s.end_col, s.signature, s.doc_comment, s.body_snippet, s.parent)

    def relation_rows(self):
        return iter(r for r in self.relations if 0 <= r[0] < len(self.symbols))


def snippet(text: str) -> str | None:
    """The lines after the first, five at most; none where there are none or they are blank."""
    body = "\n".join(text.splitlines()[1 : 1 + SNIPPET_LINES])
    return body if body.strip() else None


def columns(source: str) -> list[int]:
    """Byte offset of the start of each line."""
    at, out = 0, [0]
    for line in source.split("\n"):
        at += len(line.encode("utf-8", "replace")) + 1
        out.append(at)
    return out
