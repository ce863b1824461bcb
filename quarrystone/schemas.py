"""Explicit schemas of every table. Nothing is inferred at run time."""

from __future__ import annotations

from pyspark.sql import types as T

BLOCKS_VERSION = "1.0"
CHUNKS_VERSION = "1.0"
CORPUS_VERSION = "v1"
PDF_CORPUS_VERSION = "v4-pdf-header-columns"
INDEX_VERSION = "v2"


_ATOMS = {
    "STRING": T.StringType(), "BIGINT": T.LongType(), "INT": T.IntegerType(), "DOUBLE": T.DoubleType(), "FLOAT": T.FloatType(),
    "BOOLEAN": T.BooleanType(),
}


def _split(text: str) -> list[str]:
    """At commas outside angle brackets."""
    parts, depth, at = [], 0, 0
    for i, c in enumerate(text):
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            parts.append(text[at:i])
            at = i + 1
    return [p.strip() for p in [*parts, text[at:]] if p.strip()]


def _type(text: str) -> T.DataType:
    text = text.strip()
    if text.startswith("ARRAY<"):
        return T.ArrayType(_type(text[6:-1]))
    if text.startswith("STRUCT<"):
        return T.StructType([T.StructField(n.strip(), _type(t)) for n, _, t in (f.partition(":") for f in _split(text[7:-1]))])
    return _ATOMS[text]


def ddl(text: str) -> T.StructType:
    """A schema from its DDL, without a session."""
    return T.StructType([T.StructField(n, _type(t)) for n, _, t in (f.partition(" ") for f in _split(text))])


_BLOCK = """type STRING, text STRING, source_name STRING, source_url STRING, page INT, heading_path ARRAY<STRING>,
    table_id STRING, caption STRING, headers ARRAY<STRING>, rows ARRAY<ARRAY<STRING>>, bbox ARRAY<DOUBLE>"""
BLOCK = ddl(_BLOCK)
BLOCKS = ddl(f"doc_id BIGINT, pos BIGINT, {_BLOCK}")
_META = """source_name STRING, source_url STRING, page INT, heading_path ARRAY<STRING>, block_type STRING, table_id STRING,
    row_start INT, row_end INT, column_group ARRAY<STRING>"""
CHUNKS = ddl(
    f"id BIGINT, doc_id BIGINT, text STRING, source_text STRING, {_META}, table_prefix STRING, table_row_texts ARRAY<STRING>"
)
SUBCHUNKS = ddl(f"id BIGINT, parent_id BIGINT, part INT, text STRING, source_text STRING, {_META}")
VECTORS = ddl("id BIGINT, vec ARRAY<FLOAT>")
EDGES = ddl("src BIGINT, dst BIGINT, channel STRING, rank INT")
EXTRACTION = ddl(
    """chunk_id BIGINT, entities ARRAY<STRUCT<name: STRING, description: STRING>>,
    relations ARRAY<STRUCT<source: STRING, target: STRING, relation: STRING, description: STRING>>"""
)
ENTITIES = ddl("entity_id BIGINT, key STRING, name STRING, descriptions ARRAY<STRING>, chunk_ids ARRAY<BIGINT>")
RELATIONS = ddl("relation_id BIGINT, source STRING, target STRING, relation STRING, description STRING, chunk_id BIGINT")
KEYWORDS = ddl("keyword_id BIGINT, keyword STRING, vec ARRAY<FLOAT>")
KEYWORD_EDGES = ddl("keyword_id BIGINT, subchunk_id BIGINT")
PDF_WORDS = ddl(
    "file STRING, page INT, word_no INT, text STRING, x0 DOUBLE, top DOUBLE, x1 DOUBLE, bottom DOUBLE, upright BOOLEAN"
)
PDF_TABLES = ddl("file STRING, page INT, table_no INT, bbox ARRAY<DOUBLE>, cells ARRAY<ARRAY<ARRAY<DOUBLE>>>")
PAGES = ddl("page_id BIGINT, url STRING, html STRING")
FETCHED = ddl("pos INT, requested_url STRING, final_url STRING, html STRING")
SOURCES = ddl(
    """source INT, kind STRING, requested_url STRING, final_url STRING, title STRING, characters INT, filename STRING,
    bytes BIGINT, pages INT, stored_file STRING"""
)
