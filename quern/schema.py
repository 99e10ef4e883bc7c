"""Fixed schemas and enumerations of the code-intelligence tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, IntegerType, LongType, StringType, StructField, StructType


def _struct(**kinds) -> StructType:
    return StructType([StructField(n, k, nullable) for n, (k, nullable) in kinds.items()])


L, S, I = LongType(), StringType(), IntegerType()

FILES = _struct(
    id=(L, False), path=(S, False), relative_path=(S, False), language=(S, False), content_hash=(S, False), size_bytes=(L, False), last_indexed=(L, False)
)
SYMBOLS = _struct(
    id=(L, False), file_id=(L, False), name=(S, False), qualified_name=(S, False), kind=(S, False), start_line=(I, False), end_line=(I, False),
    start_col=(I, False), end_col=(I, False), signature=(S, True), doc_comment=(S, True), body_snippet=(S, True), parent_symbol_id=(L, True),
)
RELATIONS = _struct(
    id=(L, False), source_symbol_id=(L, False), target_symbol_name=(S, False), target_symbol_id=(L, True), kind=(S, False), file_id=(L, False), line=(I, False)
)
EMBEDDINGS = _struct(symbol_id=(L, False), vector=(ArrayType(FloatType()), False))

# The enumerations and the extensions of each language.
LANGUAGES = ("python", "javascript", "typescript", "rust", "go", "java", "c", "cpp", "unknown")
SYMBOL_KINDS = ("function", "method", "class", "struct", "interface", "trait", "enum", "variable", "constant", "module", "import", "type", "field", "constructor")
RELATION_KINDS = ("calls", "called_by", "inherits", "implements", "imports", "references", "contains")
EXTENSIONS = {
    "py": "python", "pyi": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "typescript",
    "rs": "rust", "go": "go", "java": "java", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hxx": "cpp", "hh": "cpp",
}
#: Kinds counted in the structure report; kinds that get no vector; kinds of edges that make files depend on each other.
REPORTED_KINDS = ("function", "method", "class", "struct", "interface", "trait", "enum")
UNEMBEDDED_KINDS = ("import", "variable", "assignment", "constant")
DEPENDENCY_KINDS = ("calls", "imports", "inherits", "implements", "references")


def symbol_kind(text: Column) -> Column:
    """A symbol kind as stored; unknown ones read as ``function``."""
    return F.when(text.isin(*SYMBOL_KINDS), text).otherwise("function")


def relation_kind(text: Column) -> Column:
    """A relation kind as stored; unknown ones read as ``references``."""
    return F.when(text.isin(*RELATION_KINDS), text).otherwise("references")


def language_of(path: Column) -> Column:
    """Language by extension (case-sensitive), ``unknown`` for others."""
    ext = F.regexp_extract(path, r"\.([^./\\]+)$", 1)
    table = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, ext), F.lit("unknown"))
