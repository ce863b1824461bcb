"""How blocks, rows, relations and retrieved chunks read as text (column expressions)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.functions.text import clean_text


def filled(x: Column) -> Column:
    """The value, or null where it's blank."""
    return F.when(F.trim(x) != "", x)


def path_text(heading_path: Column) -> Column:
    return F.array_join(F.coalesce(heading_path, F.array().cast("array<string>")), " > ")


def table_row_text(headers: Column, row: Column) -> Column:
    """``header = value; header = value.``; blank cells and cells beyond the headers are left out; '' if none is left."""
    cells = F.zip_with(
        F.slice(row, F.lit(1), F.least(F.size(row), F.size(headers))),
        F.slice(headers, F.lit(1), F.least(F.size(row), F.size(headers))),
        lambda v, h: F.when(clean_text(v) != "", F.concat(h, F.lit(" = "), clean_text(v))),
    )
    said = F.array_join(F.array_compact(cells), "; ")
    return F.when(said != "", F.concat(said, F.lit("."))).otherwise(F.lit(""))


def rows_text(headers: Column, rows: Column) -> Column:
    """The texts of all rows that aren't blank."""
    return F.filter(F.transform(rows, lambda r: table_row_text(headers, r)), lambda t: t != "")


def lines(*parts: Column) -> Column:
    """The parts that aren't blank, one line each."""
    return F.concat_ws("\n", *[filled(p) for p in parts])


def block_text(rows: Column | None = None) -> Column:
    """A block (columns of ``schemas.BLOCK``) as text: its heading path, then its text, or caption and rows."""
    body = F.col("rows") if rows is None else rows
    table = lines(path_text(F.col("heading_path")), F.col("caption"), F.array_join(rows_text(F.col("headers"), body), "\n"))
    return F.when(F.col("type") == "table", table).otherwise(lines(path_text(F.col("heading_path")), F.col("text")))


def relation_text() -> Column:
    """``S --[relation]--> T. description`` from source, target, relation, description."""
    said = F.coalesce(filled(F.trim("relation")), F.lit("related to"))
    fact = F.concat(F.coalesce("source", F.lit("")), F.lit(" --["), said, F.lit("]--> "), F.coalesce("target", F.lit("")))
    return F.when(filled(F.col("description")).isNotNull(), F.concat(fact, F.lit(". "), F.trim("description"))).otherwise(fact)


def entity_text() -> Column:
    """``name: descriptions`` with distinct descriptions in the order first seen."""
    return F.concat("name", F.lit(": "), F.array_join(F.array_distinct("descriptions"), " "))


def source_suffix() -> Column:
    """``, source X, page N, table T, rows a-b`` for what a chunk has of these."""
    parts = [
        F.concat(F.lit("source "), filled(F.col("source_name"))),
        F.concat(F.lit("page "), F.col("page").cast("string")),
        F.concat(F.lit("table "), filled(F.col("table_id"))),
        F.concat(F.lit("rows "), F.col("row_start").cast("string"), F.lit("-"), F.col("row_end").cast("string")),
    ]
    said = F.concat_ws(", ", *parts)
    return F.when(said != "", F.concat(F.lit(", "), said)).otherwise(F.lit(""))


def chunk_entry(subchunk: bool = False) -> Column:
    """A chunk or subchunk under its label; its source text where there is one."""
    name = [F.lit("[chunk "), F.col("parent_id" if subchunk else "id").cast("string")]
    if subchunk:
        name += [F.lit(", subchunk "), F.col("id").cast("string")]
    return F.concat(*name, source_suffix(), F.lit("]\n"), F.coalesce(filled(F.col("source_text")), F.col("text")))


def context(ranked: DataFrame, subchunk: bool = False, rank: str = "rank") -> DataFrame:
    """One row ``context``: the entries of a ranked selection (a top k) in order, a blank line between them."""
    entries = ranked.select(F.col(rank).alias("_rank"), chunk_entry(subchunk).alias("_entry"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("_rank", "_entry"))), lambda e: e["_entry"])
    return entries.agg(F.array_join(ordered, "\n\n").alias("context"))


def source_label() -> Column:
    """How an answer names a chunk's source."""
    return F.concat_ws(
        ", ",
        F.coalesce(filled(F.col("source_name")), filled(F.col("source_url")), F.lit("unknown source")),
        F.concat(F.lit("p. "), F.col("page").cast("string")),
        F.concat(F.lit("table "), filled(F.col("table_id"))),
        F.concat(F.lit("rows "), F.col("row_start").cast("string"), F.lit("-"), F.col("row_end").cast("string")),
    )
