"""Stored blocks written out in the forms the source readers take, for round trips over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.functions.text import SPACE

WORD_WIDTH, COLUMN_WIDTH, LINE_HEIGHT = 6.0, 120.0, 12.0


def _escaped(x):
    return F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def html_pages(blocks: DataFrame) -> DataFrame:
    """(page_id, url, html): one page for each document of web blocks."""
    tagged = lambda tag, x: F.concat(F.lit(f"<{tag}>"), x, F.lit(f"</{tag}>"))
    cells = lambda tag, row: tagged("tr", F.array_join(F.transform(row, lambda c: tagged(tag, _escaped(F.coalesce(c, F.lit(""))))), ""))
    table = tagged("table", F.concat(cells("th", F.col("headers")), F.array_join(F.transform("rows", lambda r: cells("td", r)), "")))
    text = _escaped(F.coalesce("text", F.lit("")))
    part = F.when(F.col("type") == "table", table).when(F.col("type") == "heading", tagged("h1", text)).otherwise(tagged("p", text))
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", part.alias("h")))), lambda x: x["h"]), "\n")
    page = blocks.groupBy("doc_id").agg(F.min("source_url").alias("url"), ordered.alias("body"))
    return page.select(F.col("doc_id").alias("page_id"), "url", F.concat(F.lit("<html><body><main>"), "body", F.lit("</main></body></html>")).alias("html"))


def pdf_words(blocks: DataFrame) -> DataFrame:
    """Words of text blocks, one line a block, placed on a page for each document and page number."""
    file = F.concat(F.col("doc_id").cast("string"), F.lit(".pdf"))
    line = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("pos"))
    flat = F.trim(F.regexp_replace("text", SPACE, " "))
    numbered = blocks.where(F.length(flat) > 0).withColumn("line", line)  # before the words are told apart
    each = numbered.select(file.alias("file"), "page", "line", F.posexplode(F.split(flat, " ")).alias("i", "text"))
    x = F.col("i") * WORD_WIDTH
    return each.select(
        "file", "page", (F.col("line") * 100_000 + F.col("i")).cast("int").alias("word_no"), "text", x.cast("double").alias("x0"),
        (F.col("line") * LINE_HEIGHT).alias("top"), (x + WORD_WIDTH - 1).alias("x1"), (F.col("line") * LINE_HEIGHT + 8.0).alias("bottom"), F.lit(True).alias("upright"),
    )


def pdf_tables(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Words and ruled cells of table blocks: headers and rows, a cell each, a page for each table."""
    file = F.concat_ws("-", F.col("doc_id").cast("string"), F.col("pos").cast("string"), F.lit("table.pdf"))
    base = blocks.select(file.alias("file"), "page", F.concat(F.array("headers"), "rows").alias("grid"), F.size("headers").alias("w"))
    rows = base.select("file", "page", F.posexplode("grid").alias("y", "row"))
    cells = rows.select("file", "page", "y", F.posexplode("row").alias("x", "cell"))
    parts = F.split(F.trim(F.regexp_replace(F.coalesce("cell", F.lit("")), SPACE, " ")), " ")
    cells = cells.withColumn("parts", parts).withColumn("step", F.least(F.lit(WORD_WIDTH), F.lit(COLUMN_WIDTH - 10) / F.size("parts")))
    each = cells.select("file", "page", "y", "x", "step", F.posexplode("parts").alias("i", "text")).where("text <> ''")
    left = F.col("x") * COLUMN_WIDTH + 2 + F.col("i") * F.col("step")
    top = F.col("y") * LINE_HEIGHT + 202.0
    words = each.select(
        "file", "page", (F.col("y") * 1_000_000 + F.col("x") * 1000 + F.col("i")).cast("int").alias("word_no"), "text", left.cast("double").alias("x0"),
        top.alias("top"), (left + F.col("step") * 0.8).cast("double").alias("x1"), (top + 8.0).alias("bottom"), F.lit(True).alias("upright"),
    )
    box = lambda x, y: F.array(x * COLUMN_WIDTH, y * LINE_HEIGHT + 200.0, (x + 1) * COLUMN_WIDTH, (y + 1) * LINE_HEIGHT + 200.0)
    grid = F.transform(F.sequence(F.lit(0), F.size("grid") - 1), lambda y: F.transform(F.sequence(F.lit(0), F.col("w") - 1), lambda x: box(x, y)))
    whole = F.array(F.lit(0.0), F.lit(200.0), F.col("w") * COLUMN_WIDTH, F.size("grid") * LINE_HEIGHT + 200.0)
    return words, base.select("file", "page", F.lit(1).alias("table_no"), whole.alias("bbox"), grid.alias("cells"))
