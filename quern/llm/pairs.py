"""Functions paired with their documentation.

Source files are parsed with an error-recovering generalised LL grammar (``gll``), so functions come out
of broken files too; signature and snippet of a symbol are such a file, cut off.  Documentation is cleaned of
everything that says nothing, corpus-repeated descriptions are found by counting hashes in which the name is left
open, and a pair is kept if enough words remain that do not merely repeat the function's name.

Defined results: kinds count in any letter case; a symbol without signature and snippet is no pair; null or
blank documentation is replaced by a Python docstring that opens the snippet; exact duplicate rows are one
symbol; null ids are dropped; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.gll import docstring_of, function_of
from quern.llm.gll import functions as parse_functions
from quern.operators.skew import balanced_join, plan_loads
from quern.session import cut

#: Words beyond the name; characters of scripts without spaces; differently named functions that make a description a template.
LEAST_WORDS, LEAST_CHARS, TEMPLATE_COUNT = 5, 10, 40

_NAME_WORD = re.compile(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|\d+")
_WORD = re.compile(r"[^\W\d_][\w]*(?:['’-][^\W\d_]\w*)*|\d+[^\W\d_]\w*")
_SPACELESS = re.compile(r"[぀-ヿ㐀-䶿一-鿿豈-﫿฀-໿ក-៿]")
_MARKS = re.compile(r"^\s*(?:/\*+!?<?|\*+/|///+[!<]?|//+[!<]?|\*+(?!\w*\*)|#+!?(?!\[)|--+|;+|%+|<!--|\"{3}|'{3}|\"\"|''|>+)\s*|\s*(?:\*+/|-->|\"{3}|'{3})\s*$")
_INLINE = re.compile(r"</?[a-zA-Z][^<>]{0,80}>|[`*]{1,3}(?=\S)|(?<=\S)[`*]{1,3}|!\[|\]\([^()]*\)")
_STUB = re.compile(
    r"^\W*(?:(?:todo|fixme|xxx+|hack|tbd|tba|wip)\b.*|n/?a|none|null|placeholder|stub|dummy|lorem ipsum.*|\(?(?:no|missing|add|insert|write|enter|put)\s+(?:a\s+|some\s+|the\s+|your\s+|proper\s+|real\s+)*"
    r"(?:description|documentation|docs?|docstring|comment|summary|me|here)\b.*|(?:description|documentation|docs?|docstring|summary|comment)\s+(?:is\s+)?(?:missing|goes here|here|pending|to (?:do|come|follow)|tbd|needed).*"
    r"|(?:auto-?\s?generated|automatically generated|generated by|generated stub|code generated)\b.*|undocumented\W*|to be (?:documented|done|written)\b.*|coming soon\W*|write me\W*|document me\W*|"
    r"(?:à|zu|da|por|te)\s+(?:documenter|dokumentieren|documentare|documentar|documenteren)\W*|beschreibung (?:fehlt|folgt).*|待补充.*|暂无.*|未完成.*|待办.*)$",
    re.I,
)
_DIRECTIVE = re.compile(
    r"^\W*(?:noqa\b|type:\s*ignore|pragma\b|pylint\s*:|eslint|tslint\s*:|jshint|jslint|prettier-ignore|istanbul\b|c8 ignore|v8 ignore|@?ts-(?:ignore|expect-error|nocheck|check)|nolint|golangci|nosec|nosonar|sonar|clang-(?:format|tidy)|fmt:\s|isort\s*:|"
    r"yapf|black:|ruff\s*:|mypy\s*:|pyright\s*:|flake8|coverage\s*:|cspell|spell-?checker|rubocop|shellcheck|rustfmt|allow\(|deny\(|warn\(|cfg|derive\(|inline\b\W*$|must_use|suppress|@?SuppressWarnings|noinspection|checkstyle|stylelint|webpack|"
    r"go:|\+build\b|region\b|endregion\b|vim\s*:|-\*-|coding[:=]|encoding[:=]|usr/bin|NOLINT\w*|lint:|biome-ignore|deno-|@?flow\b\W*$|@jsx\b|@format\b|@generated\b|doctest\s*:|pytest\s*:|@?Override\b|@?Deprecated\b\W*$|@?Nullable\b|@?NonNull\b|use strict)",
    re.I,
)
_LICENCE = re.compile(r"\b(?:copyright|\(c\)\s*\d{4}|©|licen[cs]e[ds]?|spdx|all rights reserved|redistribut\w+|warrant(?:y|ies)|permission is hereby|this file is part of|gnu general|apache software|mit-0)\b|©", re.I)
_CODE = re.compile(
    r"^(?:[\w.>&*!:$-]+\s*\([^()]*(?:\([^()]*\)[^()]*)*\)\s*[;:{]?|(?:if|for|while|switch|elif|else if|catch)\s*\(.*|(?:if|for|while|elif|with)\b.*:\s*|for\b.*\{|(?:let|var|const|val|int|auto|bool|char|double|float|long|size_t|String|final)\s+(?:mut\s+)?[\w*&<>\[\]:]+\s*=.*|"
    r"[\w.\[\]>-]+\s*(?:[-+*/|&]?=|:=|<<=?)\s*\S.*|return\b(?:\s+[\w.()\[\], !&*+-]*)?;?|(?:def|func|fn|function|class|import|from|#include|package|using|raise|throw|assert|del|yield|await|print)\b\s*[\w.(\"<'].*[;:)\]\w>\"']|.*[;{}]|[})\]]+[;,]?|break;?|continue;?|pass|else:?|try:?|end)$"
)
_TAG = re.compile(r"^[@\\](\w+)\s*(?:\[[^\]]*\])?\s*(.*)$|^:(\w+)(?:\s+[^:]*)?:\s*(.*)$")
#: Tags whose first word is a name or type, not a description; tags that only point elsewhere.
NAMING_TAGS = {"param", "params", "arg", "argument", "tparam", "throws", "throw", "exception", "raises", "raise", "type", "property", "prop", "member", "var", "ivar", "cvar", "field", "template", "typeparam", "key", "keyword"}
POINTING_TAGS = {"see", "seealso", "copydoc", "copybrief", "inheritdoc", "link", "ref", "sa", "author", "authors", "since", "version", "date", "file", "package", "module", "namespace", "class", "memberof", "ingroup", "addtogroup", "group", "rtype", "returntype", "override", "overrides", "internal", "private", "public", "protected", "api", "access", "todo", "hidden", "ignore", "async", "static", "readonly", "const", "final", "virtual", "abstract", "function", "method", "func", "name", "meth", "mod", "attr", "obj", "data", "doc", "term", "exc", "category", "license", "licence", "copyright"}
_SECTION = re.compile(r"^(?:args|arguments|parameters|params|returns?|yields?|raises|throws|exceptions?|attributes|keyword args|other parameters|notes?|see also|examples?|since|deprecated|warning|warnings|todo|references)\s*:?$", re.I)
_POINTER = re.compile(
    r"^\W*(?:(?:see|cf\.?|refer to|same as|as (?:in|for|with|per|described in)|like|ditto|idem|ibid|equivalent (?:of|to)|alias (?:of|for|to)|shorthand for|wrapper (?:for|around|of)|delegates? to|forwards? to|overrides?|inherited|inherits|implements|documented (?:in|at|under)|siehe|vgl\.?|voir|véase|ver|zie|vedi|wie|comme|come|como)\b|\{@inheritdoc\}|参见|参考|同上|见)",
    re.I,
)
_LINK = re.compile(r"\{@\w+\s+[^{}]*\}|:\w+:`[^`]*`|https?://\S+|\[\[?[\w.#:]+\]?\]")


@lru_cache(maxsize=100_000)
def stem(w: str) -> str:
    """A rough stem under which the inflections of a word meet."""
    w = w.lower().replace("’", "'")
    if w.endswith("'s"):
        w = w[:-2]
    for ending, instead in (("ices", "ex"), ("ies", "y"), ("ied", "y"), ("yses", "ysis")):
        if w.endswith(ending) and len(w) > len(ending) + 2:
            return stem(w[: -len(ending)] + instead) if ending != "yses" else w[:-4] + "ysis"
    for ending in ("izations", "ization", "ations", "ation", "ingly", "ings", "ing", "edly", "ers", "ors", "ions", "er", "or", "ion", "ed", "es", "s", "ly"):
        if w.endswith(ending) and len(w) - len(ending) >= 3 and not (ending == "s" and w.endswith("ss")):
            w = w[: -len(ending)]
            break
    if len(w) > 3 and w[-1] == w[-2] and w[-1] not in "aeiou":
        w = w[:-1]
    w = w.rstrip("e") if len(w) > 3 else w
    if w.endswith(("at", "iz", "is")) and len(w) > 5:
        w = w[:-2]
    return w[:-2] + "ex" if w.endswith("ix") else w


def _is_licence_follow(line: str) -> bool:
    return line[:1].islower()


def clean(doc: str) -> list[str]:
    """The lines of a documentation comment that say something, without marks and markup."""
    out: list[str] = []
    licence = False
    for raw in html.unescape(doc).replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        line, before = raw.strip(), None
        if _DIRECTIVE.match(line) or re.match(r"#!?\[.*\]$", line):
            licence = False
            continue
        while line != before:
            before = line
            line = _MARKS.sub("", line).strip()
        if not line:
            licence = False
            continue
        if _LICENCE.search(line):
            licence = True
            continue
        if licence and _is_licence_follow(line):
            continue
        licence = False
        if _DIRECTIVE.match(line) or _STUB.match(line) or _SECTION.match(line):
            continue
        bare = _INLINE.sub("", line).strip()
        if _STUB.match(bare):
            continue
        if not _SPACELESS.search(bare) and _CODE.match(bare):
            continue
        m = _TAG.match(line)
        if m:
            tag, rest = (m.group(1) or m.group(3)).lower(), (m.group(2) or m.group(4) or "").strip()
            if tag in POINTING_TAGS:
                continue
            rest = re.sub(r"^\{[^{}]*\}\s*", "", rest)
            if tag in NAMING_TAGS and m.group(1):
                rest = re.sub(r"^[\w.\[\]<>*&$-]+\s*[-:]?\s*", "", rest)
            if tag in ("type", "rtype", "raises", "throws") or len(rest.split()) < 2:
                continue
            bare = _INLINE.sub("", rest)
        elif len(bare.split()) == 1 and not _SPACELESS.search(bare):
            bare = "" if re.fullmatch(r"[\w.]+:?", bare) else bare
        if bare:
            out.append(bare)
    return out


def telling(doc: str | None, name: str) -> tuple[int, int, str]:
    """(words beyond the name, characters of scripts without spaces, the cleaned text)."""
    if not doc:
        return 0, 0, ""
    text = " ".join(clean(doc))
    kept = []
    for s in re.split(r"(?<=[.!?。；])\s+|(?<=[。！？])", text):
        linkless = _LINK.sub(" ", s)
        # A mere pointer: it opens like one, or nothing but the link is left.
        if _POINTER.match(s) and len(_WORD.findall(linkless)) <= 9 or (linkless != s and len(_WORD.findall(linkless)) <= 2):
            continue
        kept.append(linkless if linkless.strip() else "")
    text = " ".join(x for x in kept if x).strip()
    own = {stem(w) for w in _NAME_WORD.findall(name or "")}
    chars = len(_SPACELESS.findall(text))
    count = 0
    for w in _WORD.findall(_SPACELESS.sub(" ", text)):
        parts = _NAME_WORD.findall(w) if w.isascii() else [w]
        if not parts or all(stem(p) in own for p in parts):
            continue
        count += 1
    return count, chars, text


PAIRS = "symbol_id long, name string, documentation string, words long, characters long, template long, parsed boolean"


def pair_functions(symbols: DataFrame) -> DataFrame:
    """(symbol_id, name, signature, body_snippet, documentation) of functions with telling documentation."""
    rows = symbols.where(F.lower(F.trim("kind")).isin("function", "method", "constructor") & F.col("id").isNotNull()).select(
        F.col("id").alias("symbol_id"), "name", "qualified_name", "signature", "doc_comment", "body_snippet"
    )
    some_code = (F.trim(F.coalesce("signature", F.lit(""))) != "") | (F.regexp_replace(F.coalesce("body_snippet", F.lit("")), r"\s+", "") != "")
    rows = rows.where(some_code).distinct()
    python = F.regexp_like(F.split_part(F.coalesce("qualified_name", F.lit("")), F.lit("::"), F.lit(1)), F.lit(r"\.pyi?$"))
    blank = F.regexp_replace(F.coalesce("doc_comment", F.lit("")), r"\s+", "") == ""
    opens = F.regexp_like(F.coalesce("body_snippet", F.lit("")), F.lit(r"^\s*[rRbBuU]{0,2}[\"']"))
    # Rows without any documentation leave before Python sees them.
    rows = rows.where(~blank | (python & opens)).withColumn("_blank", blank)

    rows = rows.withColumn("_python", python)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, name, doc, signature, body, empty, py in zip(*(batch.column(k).to_pylist() for k in range(7))):
                # Every row is parsed as the start of a broken file; where no function starts, its columns speak.
                parsed = function_of(signature, body, py)
                if empty:
                    doc = parsed["doc"] if parsed and parsed["doc"] else docstring_of(body)
                called = f"{name or ''} {parsed['name']}" if parsed and parsed["name"] != name else name or ""
                words, chars, text = telling(doc, called)
                if words >= LEAST_WORDS or chars >= LEAST_CHARS:
                    out.append((i, name, text, words, chars, template_of(text, called), parsed is not None))
            columns = list(zip(*out)) if out else [[]] * 7
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["symbol_id", "name", "documentation", "words", "characters", "template", "parsed"])

    picked = rows.select("symbol_id", "name", "doc_comment", "signature", "body_snippet", "_blank", "_python")
    return without_templates(cut(picked.mapInArrow(run, PAIRS)))


def template_of(text: str, name: str) -> int:
    """A hash of a description in which the words of the function's name and numbers are left open."""
    own = {stem(w) for w in _NAME_WORD.findall(name) + re.findall(r"[^\W_]+", name)}
    return hash_text(" ".join("_" if stem(w) in own or w.isdigit() else w.lower() for w in re.findall(r"[^\W_]+", text)))


def without_templates(told: DataFrame) -> DataFrame:
    """Rows but those whose description, names left open, stands at more than ``TEMPLATE_COUNT`` differently named functions.

    The bound is a number, not a share, so the same description is kept or dropped whatever else the corpus holds.
    ``told`` is a written table.
    """
    counts = told.groupBy("template", "name").agg(F.lit(1).alias("_1")).groupBy("template").agg(F.count(F.lit(1)).alias("_n"))
    worn = cut(counts.where(F.col("_n") > TEMPLATE_COUNT).select("template"))
    if worn.isEmpty():
        return told
    return balanced_join(told, worn, plan_loads(told, ["template"]), F.col("documentation"), "left_anti")


def hash_text(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text) - (1 << 63)


def extract_pairs(files: DataFrame, text: str = "text", path: str = "path") -> DataFrame:
    """(path, line, name, signature, documentation, body_snippet) from source texts, broken ones included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "line", "name", "signature", "documentation", "body_snippet", "template"]
        for batch in batches:
            out = []
            for where, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for f in parse_functions(source or ""):
                    words, chars, told = telling(f["doc"], f["name"])
                    if words >= LEAST_WORDS or chars >= LEAST_CHARS:
                        out.append((where, f["line"], f["name"], f["signature"], told, f["body_snippet"], template_of(told, f["name"])))
            columns = list(zip(*out)) if out else [[]] * 7
            kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    found = files.select(F.col(f"`{path}`").cast("string"), f"`{text}`").mapInArrow(
        run, "path string, line long, name string, signature string, documentation string, body_snippet string, template long"
    )
    return without_templates(cut(found)).drop("template")
