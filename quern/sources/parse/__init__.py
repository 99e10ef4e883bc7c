"""Source texts to symbols and relations: one parser for Python, one for the languages with braces."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from quern.sources.parse.braces import parse_braces
from quern.sources.parse.model import Parsed
from quern.sources.parse.python import parse_python

SYMBOL_COLUMNS = "ordinal int, name string, qualified_name string, kind string, start_line int, end_line int, start_col int, end_col int, signature string, doc_comment string, body_snippet string, parent_ordinal int"
RELATION_COLUMNS = "source_ordinal int, target_name string, kind string, line int"


def parse(source: str, language: str, path: str) -> Parsed:
    """Symbols and relations of one source text; an unknown language gives none."""
    if language == "python":
        return parse_python(source, path)
    if language == "unknown":
        return Parsed(path)
    return parse_braces(source, language, path)


def parse_files(files: DataFrame) -> DataFrame:
    """(file_id, relative_path, language, text) -> one row per file with arrays of symbol and relation structs.

    Texts are parsed where they lie, once; both tables are read off the result.
    """
    schema = f"file_id long, symbols array<struct<{SYMBOL_COLUMNS.replace(' ', ':').replace(',:', ',')}>>, relations array<struct<{RELATION_COLUMNS.replace(' ', ':').replace(',:', ',')}>>"
    names_s, names_r = ([c.split()[0] for c in t.split(", ")] for t in (SYMBOL_COLUMNS, RELATION_COLUMNS))
    kind = {"int": pa.int32(), "string": pa.string()}
    type_s, type_r = (pa.list_(pa.struct([(c.split()[0], kind[c.split()[1]]) for c in t.split(", ")])) for t in (SYMBOL_COLUMNS, RELATION_COLUMNS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            symbols, relations = [], []
            for path, language, text in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
                p = parse(text or "", language, path)
                symbols.append([dict(zip(names_s, s)) for s in p.symbol_rows()])
                relations.append([dict(zip(names_r, r)) for r in p.relation_rows()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(symbols, type_s), pa.array(relations, type_r)], names=["file_id", "symbols", "relations"])

    return files.select("file_id", "relative_path", "language", "text").mapInArrow(run, schema)
