"""Ranked full-text search over the text columns of symbols, with a query grammar.

Tokens are runs of letters and digits, lower-cased and without diacritics (``_`` separates).  Scores are
BM25 over the concatenation of the indexed columns (k1 = 1.2, b = 0.75), negative, best first; a phrase
counts as one term.  Everything is evaluated JVM-side on token arrays: one pass gathers the corpus
statistics of the query's phrases, a second one scores, and ``orderBy().limit()`` keeps the top rows.

Grammar: bare words (AND), AND/OR/NOT, parentheses, "phrases", a + b, prefix*, column:term, {c1 c2}:term,
^term (first token of a column), NEAR(a b, n).  NOT is binary. Invalid queries raise QueryError.
"""

from __future__ import annotations

import math
import re
import unicodedata
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.session import cut

COLUMNS = ("name", "qualified_name", "signature", "doc_comment", "body_snippet")
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


class QueryError(ValueError):
    """The query does not follow the grammar."""


def _fold_table() -> tuple[str, str]:
    """Letters with diacritics and their plain forms, by Unicode decomposition."""
    pairs = []
    for cp in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        base = unicodedata.normalize("NFD", chr(cp))[0]
        if base != chr(cp) and base.isascii():
            pairs.append((chr(cp), base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_FROM, _TO = _fold_table()


def fold_text(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if unicodedata.category(c) != "Mn")


def tokens(column: Column) -> Column:
    """Token array of a text column; null text has no tokens."""
    plain = F.lower(F.translate(F.coalesce(column, F.lit("")), _FROM, _TO))
    return F.regexp_extract_all(F.regexp_replace(plain, r"\p{Mn}+", ""), F.lit(r"[\p{L}\p{N}\p{Co}]+"), F.lit(0))


@dataclass
class Phrase:
    """Consecutive tokens, possibly anchored to a column's start, ending in a prefix, limited to columns."""

    words: list[str]
    prefix: bool = False
    first: bool = False
    columns: tuple[str, ...] | None = None
    near: Node | None = None

    def _fits(self, toks: Column, at: Column) -> Column:
        """Whether the phrase starts at 0-based position ``at``."""
        tests = []
        for k, w in enumerate(self.words):
            t = F.get(toks, at + k)
            tests.append(t.startswith(w) if self.prefix and k == len(self.words) - 1 else t == w)
        return reduce(lambda a, b: a & b, tests)

    def positions(self, toks: Column) -> Column:
        """0-based start positions in one column."""
        last = F.size(toks) - len(self.words)
        if self.first:
            last = F.least(last, F.lit(0))
        steps = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        return F.filter(steps, lambda i: F.coalesce(self._fits(toks, i), F.lit(False)))

    def _close(self, toks: Column):
        """Test of a position in one column: every other phrase of the NEAR lies within its gap."""
        others = [(len(p.words), p.positions(toks)) for p in self.near.phrases if p is not self]

        def test(i: Column) -> Column:
            near = [F.exists(spots, self._within(i, size)) for size, spots in others]
            return reduce(lambda a, b: a & b, near, F.lit(True))

        return test

    def _within(self, i: Column, size: int):
        return lambda j: (j - i - len(self.words) <= self.near.gap) & (i - j - size <= self.near.gap)

    def frequency(self, cols: dict[str, Column]) -> Column:
        """Occurrences that count for the score: inside NEAR only those close to all others."""
        if self.near is None:
            return self.count(cols)
        parts = []
        for n, c in cols.items():
            if self.columns is None or n in self.columns:
                parts.append(F.size(F.filter(self.positions(c), self._close(c))))
        return reduce(lambda a, b: a + b, parts, F.lit(0))

    def count(self, cols: dict[str, Column]) -> Column:
        used = [c for n, c in cols.items() if self.columns is None or n in self.columns]
        if not used or not self.words:
            return F.lit(0)
        if len(self.words) == 1 and not self.first:
            w = self.words[0]
            test = (lambda x: x.startswith(w)) if self.prefix else (lambda x: x == w)
            return reduce(lambda a, b: a + b, [F.size(F.filter(c, test)) for c in used])
        return reduce(lambda a, b: a + b, [F.size(self.positions(c)) for c in used])


@dataclass
class Node:
    kind: str  # phrase, and, or, not, near
    phrases: list[Phrase] = field(default_factory=list)
    kids: list[Node] = field(default_factory=list)
    gap: int = 10

    def all_phrases(self) -> list[Phrase]:
        return self.phrases + [p for k in self.kids for p in k.all_phrases()]

    def test(self, cols: dict[str, Column]) -> Column:
        if self.kind == "phrase":
            return self.phrases[0].count(cols) > 0
        if self.kind == "near":
            return self._near(cols)
        tests = [k.test(cols) for k in self.kids]
        if self.kind == "not":
            return tests[0] & ~tests[1]
        return reduce((lambda a, b: a & b) if self.kind == "and" else (lambda a, b: a | b), tests)

    def _near(self, cols: dict[str, Column]) -> Column:
        """All phrases in one column with at most ``gap`` tokens between the first one's and the others' ends."""
        hits = []
        for n, c in cols.items():
            if any(p.columns is not None and n not in p.columns for p in self.phrases):
                continue
            spots = [p.positions(c) for p in self.phrases]
            size = [len(p.words) for p in self.phrases]

            def within(i, k, spots=spots, size=size):
                return F.exists(spots[k], lambda j: (j - i - size[0] <= self.gap) & (i - j - size[k] <= self.gap))

            hits.append(F.exists(spots[0], lambda i: reduce(lambda a, b: a & b, [within(i, k) for k in range(1, len(spots))], F.lit(True))))
        return reduce(lambda a, b: a | b, hits, F.lit(False))


_LEX = re.compile(r"\s*(?:(?P<string>\"(?:[^\"]|\"\")*\")|(?P<word>[A-Za-z0-9_\x1a\x80-\U0010ffff]+)|(?P<sym>[():{}+*^,]|-(?=\s*(?:\{|\w+\s*:))))")


class Parser:
    """Recursive descent: OR, then NOT, then AND (written or implied), then one unit."""

    def __init__(self, query: str, columns: tuple[str, ...] = COLUMNS) -> None:
        self.columns, self.items, at = columns, [], 0
        query = query.rstrip()
        while at < len(query):
            m = _LEX.match(query, at)
            if not m or m.end() == at:
                raise QueryError(f"syntax error near {query[at : at + 10]!r}")
            self.items.append((m.lastgroup, m.group(m.lastgroup)))
            at = m.end()
        self.at = 0

    def _peek(self, k: int = 0) -> tuple[str | None, str]:
        return self.items[self.at + k] if self.at + k < len(self.items) else (None, "")

    def _take(self, text: str) -> bool:
        if self._peek()[1] == text and self._peek()[0] in ("sym", "word"):
            self.at += 1
            return True
        return False

    def parse(self) -> Node:
        if not self.items:
            raise QueryError("the query is empty")
        tree = self._or()
        if self.at < len(self.items):
            raise QueryError(f"syntax error near {self._peek()[1]!r}")
        return tree

    def _or(self) -> Node:
        kids = [self._and()]
        while self._take("OR"):
            kids.append(self._and())
        return kids[0] if len(kids) == 1 else Node("or", kids=kids)

    def _and(self) -> Node:
        kids = [self._not()]
        while self._take("AND"):
            kids.append(self._not())
        return kids[0] if len(kids) == 1 else Node("and", kids=kids)

    def _not(self) -> Node:
        left = self._implied()
        while self._take("NOT"):
            left = Node("not", kids=[left, self._implied()])
        return left

    def _implied(self) -> Node:
        kids = [self._unit(None)]
        while self._peek()[0] is not None and self._peek()[1] not in (")", "OR", "AND", "NOT"):
            kids.append(self._unit(None))
        return kids[0] if len(kids) == 1 else Node("and", kids=kids)

    def _unit(self, columns: tuple[str, ...] | None) -> Node:
        kind, text = self._peek()
        if kind is None or text in ("OR", "AND", "NOT") and kind == "word":
            raise QueryError(f"a term is missing near {text!r}")
        if self._take("-"):
            return self._filtered(negative=True)
        if text == "{" or (kind == "word" and self._peek(1) == ("sym", ":")):
            return self._filtered(negative=False)
        if self._take("("):
            inner = self._or()
            if not self._take(")"):
                raise QueryError("a parenthesis is not closed")
            self._limit(inner, columns)
            return inner
        if kind == "word" and text == "NEAR" and self._peek(1) == ("sym", "("):
            return self._near(columns)
        return Node("phrase", phrases=[self._phrase(columns)])

    @staticmethod
    def _limit(node: Node, columns: tuple[str, ...] | None) -> None:
        for p in node.all_phrases() if columns is not None else ():
            p.columns = columns if p.columns is None else tuple(c for c in p.columns if c in columns)

    def _filtered(self, negative: bool) -> Node:
        names = []
        if self._take("{"):
            while not self._take("}"):
                kind, text = self._peek()
                if kind not in ("word", "string"):
                    raise QueryError("a column list is not closed")
                names.append(text.strip('"'))
                self.at += 1
        else:
            names.append(self._peek()[1].strip('"'))
            self.at += 1
        if not self._take(":"):
            raise QueryError("a colon is missing after the columns")
        low = {c.lower(): c for c in self.columns}
        for n in names:
            if n.lower() not in low:
                raise QueryError(f"no such column: {n}")
        picked = tuple(low[n.lower()] for n in names)
        if negative:
            picked = tuple(c for c in self.columns if c not in picked)
        node = self._unit(picked)
        self._limit(node, picked)
        return node

    def _phrase(self, columns: tuple[str, ...] | None) -> Phrase:
        first = self._take("^")
        words: list[str] = []
        while True:
            kind, text = self._peek()
            if kind not in ("word", "string"):
                raise QueryError(f"a term is missing near {text!r}")
            self.at += 1
            raw = text[1:-1].replace('""', '"') if kind == "string" else text
            words += re.findall(r"[^\W_]+", fold_text(raw))
            if not self._take("+"):
                break
        return Phrase(words, self._take("*"), first, columns)

    def _near(self, columns: tuple[str, ...] | None) -> Node:
        self.at += 2
        phrases, gap = [], 10
        while not self._take(")"):
            if self._take(","):
                gap = int(self._peek()[1]) if self._peek()[1].isdigit() else -1
                self.at += 1
                if gap < 0 or not self._take(")"):
                    raise QueryError("NEAR wants a number and a closing parenthesis")
                break
            phrases.append(self._phrase(columns))
        if not phrases:
            raise QueryError("NEAR is empty")
        if len(phrases) == 1:
            return Node("phrase", phrases=phrases)
        node = Node("near", phrases=phrases, gap=gap)
        for p in phrases:
            p.near = node
        return node


def rank_rows(rows: DataFrame, query: str, id: str = "id", columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """(id, rank) of every matching row; rank is negative, the least is the best match."""
    tree = Parser(query, columns).parse()
    phrases = [p for p in tree.all_phrases() if p.words]
    if not phrases:
        return rows.select(id, F.lit(0.0).alias("rank")).limit(0)
    toks = rows.select(F.col(f"`{id}`").alias("_id"), *[tokens(F.col(f"`{c}`")).alias(f"_t{k}") for k, c in enumerate(columns)])
    cols = {c: F.col(f"_t{k}") for k, c in enumerate(columns)}
    counted = toks.select(
        "_id",
        reduce(lambda a, b: a + b, [F.size(c) for c in cols.values()]).alias("_len"),
        tree.test(cols).alias("_hit"),
        *[p.frequency(cols).alias(f"_f{k}") for k, p in enumerate(phrases)],
        *[(p.count(cols) > 0).alias(f"_d{k}") for k, p in enumerate(phrases)],
    )
    counted = cut(counted)  # a few numbers per row; the texts are read and cut into tokens once
    s = counted.agg(F.count(F.lit(1)).alias("n"), F.sum("_len").alias("len"), *[F.count_if(F.col(f"_d{k}")).alias(f"d{k}") for k in range(len(phrases))]).first()
    n, mean = s["n"], (s["len"] or 0) / s["n"] if s["n"] else 0.0
    score = F.lit(0.0)
    for k in range(len(phrases)):
        df = s[f"d{k}"]
        idf = math.log((n - df + 0.5) / (df + 0.5)) if n else 0.0
        idf = idf if idf > 0 else LEAST_IDF
        f = F.col(f"_f{k}").cast("double")
        score = score + F.lit(idf) * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("_len") / F.lit(mean or 1.0)))
    return counted.where("_hit").select(F.col("_id").alias(id), (-score).alias("rank"))


def search(rows: DataFrame, query: str, limit: int, id: str = "id", columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """The ``limit`` best matches (ties by id)."""
    return rank_rows(rows, query, id, columns).orderBy("rank", id).limit(limit)


def text_search(rows: DataFrame, query: str, limit: int, id: str = "id", columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """search with the displayed score 1 / (1 + |rank|)."""
    return search(rows, query, limit, id, columns).withColumn("score", 1 / (1 + F.abs("rank")))


def prefix_search(rows: DataFrame, text: str, limit: int = 20, id: str = "id", columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """Ids of rows that fit ``text`` without quotes and with ``*`` appended, by id."""
    tree = Parser(text.replace('"', "") + "*", columns).parse()
    toks = rows.select(F.col(f"`{id}`").alias(id), *[tokens(F.col(f"`{c}`")).alias(f"_t{k}") for k, c in enumerate(columns)])
    return toks.where(tree.test({c: F.col(f"_t{k}") for k, c in enumerate(columns)})).select(id).orderBy(id).limit(limit)


def postings(rows: DataFrame, id: str = "id", columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """The derived index (id, col, pos, term) of the given rows; for changed files only, pass only their rows."""
    parts = [rows.select(F.col(f"`{id}`").alias(id), F.lit(c).alias("col"), F.posexplode(tokens(F.col(f"`{c}`"))).alias("pos", "term")) for c in columns]
    return reduce(DataFrame.unionByName, parts)
