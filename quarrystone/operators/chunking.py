"""Chunking: word windows, text runs, table row packing, column groups, tau subchunks, global numbering.

Windows and packing are array expressions within a row; only the grouping of consecutive blocks and the global
numbering shuffle, each by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.functions.render import block_text, filled, lines, path_text, table_row_text
from quarrystone.functions.text import gaps, strip, words
from quarrystone.runtime import prefix_offsets, stored

SIZE, OVERLAP = 450, 60
META = ["source_name", "source_url", "page", "heading_path"]


def check_window(size: int, overlap: int) -> None:
    if size <= 0:
        raise ValueError("chunk size must be positive")
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and smaller than the chunk size")


def window_starts(n: Column, size: int, overlap: int) -> Column:
    """Where the windows over ``n`` words begin; the last is the first to reach the end."""
    step = size - overlap
    count = F.when(n <= size, F.lit(1)).otherwise(F.ceil((n - size) / F.lit(step)).cast("int") + 1)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: i * step)).otherwise(F.array().cast("array<int>"))


def word_chunks(df: DataFrame, keep: list[str], text: str = "text", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """``keep``, ``chunk_no`` (from 0), ``text`` (the window's words) and ``source_text`` (the original between them)."""
    check_window(size, overlap)
    t = F.col("_t")
    base = df.select(*keep, F.col(text).alias("_t"))
    base = base.withColumn("_w", words(t)).withColumn("_g", gaps(t)).drop("_t")
    # texts without words have no windows; a filter for them would be pushed down and look for words twice
    each = base.select(*keep, "_w", "_g", F.posexplode(window_starts(F.size("_w"), size, overlap)).alias("chunk_no", "_s"))
    own = F.slice("_w", F.col("_s") + 1, F.lit(size))
    said = F.zip_with(own, F.slice("_g", F.col("_s") + 2, F.size(own)), lambda w, g: F.concat(w, g))
    return each.select(*keep, "chunk_no", F.array_join(own, " ").alias("text"), strip(F.array_join(said, "")).alias("source_text"))


def number_globally(df: DataFrame, order: list[str], out: str = "id", width: int = 1000) -> DataFrame:
    """Adds ``out``: 0, 1, … in the order of ``order``, whose first column is a number.

    Rows are counted by ranges of ``width`` values of that number, the counts are added up, and only the rows of
    one range are put in order in a task.
    """
    staged = df.withColumn("_all", F.lit(0)).withColumn("_one", F.lit(1).cast("long"))
    staged = staged.withColumn("_range", F.floor(F.col(order[0]) / F.lit(width)))
    numbered = prefix_offsets(staged, "_all", order, "_one", "_range", out)
    return numbered.withColumn(out, F.col(out) - 1).drop("_all", "_one", "_range")


def text_runs(blocks: DataFrame) -> DataFrame:
    """(doc_id, run_pos, source_text, metadata): consecutive text blocks of one section and page, joined by blank lines.

    A run ends where source, page or heading path change, and at a table that has rows or not.
    """
    table = F.col("type") == "table"
    by_pos = Window.partitionBy("doc_id").orderBy("pos")
    section = F.struct(F.coalesce("source_name", F.lit("")), F.coalesce("source_url", F.lit("")), F.col("page"), F.coalesce("heading_path", F.array().cast("array<string>")))
    marked = blocks.withColumn("_table", table).withColumn("_key", section)
    before = F.lag(F.struct("_table", "_key")).over(by_pos)
    opens = before.isNull() | F.col("_table") | before["_table"] | (before["_key"] != F.col("_key"))
    runs = marked.withColumn("_run", F.sum(opens.cast("int")).over(by_pos)).where(~F.col("_table"))
    entry = F.struct(F.col("pos"), block_text().alias("text"))
    head = F.min(F.struct("pos", *META))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["text"]), "\n\n")
    grouped = runs.groupBy("doc_id", "_run").agg(joined.alias("source_text"), head.alias("_head"))
    return grouped.select("doc_id", F.col("_head.pos").alias("run_pos"), "source_text", *[F.col(f"_head.{m}").alias(m) for m in META])


def _cost(headers: Column, row: Column) -> Column:
    return F.size(words(table_row_text(headers, row)))


def pack_rows(costs: Column, base: Column, size: int) -> Column:
    """For each row the number of the pack it goes to: a pack that has rows is closed when one more would exceed ``size``."""
    start = F.struct(base.cast("int").alias("acc"), F.lit(0).alias("n"), F.lit(0).alias("pack"), F.array().cast("array<int>").alias("packs"))

    def put(s: Column, c: Column) -> Column:
        full = (s["n"] > 0) & (s["acc"] + c > size)
        pack = s["pack"] + full.cast("int")
        return F.struct(
            F.when(full, base.cast("int") + c).otherwise(s["acc"] + c).alias("acc"),
            F.when(full, 1).otherwise(s["n"] + 1).alias("n"),
            pack.alias("pack"),
            F.array_append(s["packs"], pack).alias("packs"),
        )

    return F.aggregate(costs, start, put, lambda s: s["packs"])


def cell_costs(headers: Column, rows: Column) -> Column:
    """What every cell of a table costs in words, row by row."""

    def cost(r: Column, c: Column) -> Column:
        said = F.concat(F.get(headers, c), F.lit(" = "), F.get(r, c))
        return F.when(F.trim(F.get(r, c)) != "", F.size(words(said))).otherwise(0)

    columns = F.sequence(F.lit(0), F.size(headers) - 1)
    return F.transform(rows, lambda r: F.transform(columns, lambda c: cost(r, c)))


def column_groups(grid: Column, width: Column, base: Column, size: int) -> Column:
    """The columns of each group of a table too wide for ``size``: the first column leads every group.

    ``grid`` are the cell costs; it must be a column of its own, as it is looked into at every step. Greedy from left
    to right: a group that has columns is closed when one more would make its costliest row exceed ``size``. Null
    for tables that stay whole.
    """
    base = base.cast("int")
    too_wide = (width > 1) & (F.array_max(F.transform(grid, lambda g: F.aggregate(g, base, lambda a, x: a + x))) > size)
    empty = F.array().cast("array<int>")
    start = F.struct(empty.alias("now"), F.array().cast("array<array<int>>").alias("done"))

    def put(s: Column, c: Column) -> Column:
        largest = F.array_max(
            F.transform(grid, lambda g: base + F.get(g, F.lit(0)) + F.get(g, c) + F.aggregate(s["now"], F.lit(0), lambda a, i: a + F.get(g, i)))
        )
        full = (F.size(s["now"]) > 0) & (largest > size)
        return F.struct(
            F.when(full, F.array(c)).otherwise(F.array_append(s["now"], c)).alias("now"),
            F.when(full, F.array_append(s["done"], s["now"])).otherwise(s["done"]).alias("done"),
        )

    groups = F.aggregate(F.sequence(F.lit(1), width - 1), start, put, lambda s: F.when(F.size(s["now"]) > 0, F.array_append(s["done"], s["now"])).otherwise(s["done"]))
    led = F.transform(groups, lambda g: F.concat(F.array(F.lit(0)), g))
    return F.when(too_wide, led)


def table_chunks(blocks: DataFrame, size: int = SIZE) -> DataFrame:
    """Chunks of table blocks: whole rows packed up to ``size`` words, wide tables by column groups."""
    tables = blocks.where((F.col("type") == "table") & (F.size("rows") > 0))
    prefix = lines(path_text(F.col("heading_path")), F.col("caption"))
    tables = tables.withColumn("table_prefix", prefix).withColumn("_base", F.size(words(F.col("table_prefix"))))
    tables = tables.withColumn("_grid", cell_costs(F.col("headers"), F.col("rows")))
    groups = column_groups(F.col("_grid"), F.size("headers"), F.col("_base"), size)
    whole = F.array(F.sequence(F.lit(0), F.size("headers") - 1))
    split = tables.withColumn("_split", groups)
    split = split.select("*", F.posexplode(F.coalesce("_split", whole)).alias("_g", "_cols"))
    pick = lambda r: F.transform("_cols", lambda c: F.get(r, c))
    named = F.when(F.col("_split").isNotNull(), F.concat(F.coalesce("table_id", F.lit("table")), F.lit("-columns-"), (F.col("_g") + 1).cast("string")))
    split = split.withColumns({"table_id": F.coalesce(named, "table_id"), "headers": pick(F.col("headers")), "rows": F.transform("rows", pick)})
    packed = split.withColumn("_packs", pack_rows(F.transform("rows", lambda r: _cost(F.col("headers"), r)), F.col("_base"), size))
    each = packed.select("*", F.explode(F.array_distinct("_packs")).alias("_pack"))
    first = F.array_position("_packs", F.col("_pack")).cast("int")
    count = F.size(F.filter("_packs", lambda p: p == F.col("_pack")))
    each = each.withColumns({"row_start": first, "row_end": first + count - 1})
    own = F.slice("rows", F.col("row_start"), F.col("row_end") - F.col("row_start") + 1)
    each = each.withColumn("rows", own)
    said = block_text()
    return each.select(
        "doc_id", F.col("pos").alias("run_pos"), "_g", F.col("_pack").alias("chunk_no"), F.array_join(words(said), " ").alias("text"), said.alias("source_text"), *META,
        F.lit("table").alias("block_type"), "table_id", "row_start", "row_end", F.col("headers").alias("column_group"), "table_prefix",
        F.transform("rows", lambda r: table_row_text(F.col("headers"), r)).alias("table_row_texts"),
    )


def structured_chunks(blocks: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Chunks of blocks (``schemas.CHUNKS``), numbered in the order of document and position. Absent metadata is null."""
    check_window(size, overlap)
    runs = word_chunks(text_runs(blocks), ["doc_id", "run_pos", *META], "source_text", size, overlap)
    texts = runs.withColumns(
        {
            "_g": F.lit(0), "block_type": F.lit("text"), "table_id": F.lit(None).cast("string"), "row_start": F.lit(None).cast("int"),
            "row_end": F.lit(None).cast("int"), "column_group": F.lit(None).cast("array<string>"), "table_prefix": F.lit(None).cast("string"),
            "table_row_texts": F.lit(None).cast("array<string>"),
        }
    )
    every = texts.unionByName(table_chunks(blocks, size))
    bare = {
        "source_name": filled(F.col("source_name")), "source_url": filled(F.col("source_url")), "table_prefix": F.col("table_prefix"),
        "heading_path": F.when(F.size("heading_path") > 0, F.col("heading_path")),
    }
    # numbering reads its rows twice, so the work on texts is kept
    numbered = number_globally(stored(every.withColumns(bare), "chunks"), ["doc_id", "run_pos", "_g", "chunk_no"])
    return numbered.select(
        "id", "doc_id", "text", "source_text", *META, "block_type", "table_id", "row_start", "row_end", "column_group", "table_prefix", "table_row_texts"
    )


def build_chunks(blocks: DataFrame, strategy: str = "words", size: int = SIZE, overlap: int = OVERLAP, output: str | None = None) -> DataFrame:
    """Chunks of blocks; only the strategy ``words`` is known. Optionally written as Parquet. No chunks is an error."""
    if strategy != "words":
        raise ValueError(f"unsupported chunking strategy: {strategy}")
    chunks = structured_chunks(blocks, size, overlap)
    if output:
        chunks.write.mode("overwrite").parquet(output)
        chunks = blocks.sparkSession.read.schema(chunks.schema).parquet(output)
    if chunks.isEmpty():
        raise ValueError("no chunks could be built from the blocks")
    return chunks


def tau_subchunks(chunks: DataFrame, tau: int = 1, numbered: bool = True) -> DataFrame:
    """Each chunk in 2^tau pieces (``schemas.SUBCHUNKS``); bounds round half to even, empty pieces are dropped.

    Table chunks are cut between complete rows, with their prefix repeated and their row range counted anew. Chunks
    with null text give no pieces.
    """
    if tau < 0:
        raise ValueError("tau must not be negative")
    pieces = 2**tau
    rows = F.col("table_row_texts")
    by_rows = rows.isNotNull() & (F.size(rows) > 0)
    units = F.when(by_rows, rows).otherwise(words(F.col("text")))
    source = F.coalesce(filled(F.col("source_text")), F.col("text"))
    staged = chunks.withColumns({"_rows": by_rows, "_u": units, "_src": source})
    # the spans of the source text belong to the words only where these are the same words
    staged = staged.withColumn("_sw", words(F.col("_src"))).withColumn("_sg", gaps(F.col("_src")))
    staged = staged.select("*", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))).alias("part"))
    bound = lambda p: F.bround(p.cast("double") * F.size("_u") / F.lit(float(pieces)), 0).cast("int")
    staged = staged.withColumns({"_from": bound(F.col("part")), "_to": bound(F.col("part") + 1)}).where("_to > _from")
    own = F.slice("_u", F.col("_from") + 1, F.col("_to") - F.col("_from"))
    table_text = lines(F.coalesce("table_prefix", F.lit("")), F.array_join(F.filter(own, lambda r: r != ""), "\n"))
    spans = F.zip_with(own, F.slice("_sg", F.col("_from") + 2, F.size(own)), lambda w, g: F.concat(w, g))
    same = F.size("_sw") == F.size("_u")
    plain_source = F.when(same, strip(F.array_join(spans, ""))).otherwise(F.array_join(own, " "))
    staged = staged.withColumns(
        {
            "source_text": F.when(F.col("_rows"), table_text).otherwise(plain_source),
            "text": F.when(F.col("_rows"), F.array_join(words(table_text), " ")).otherwise(F.array_join(own, " ")),
            "row_end": F.when(F.col("_rows"), F.col("row_start") + F.col("_to") - 1).otherwise(F.col("row_end")),
            "row_start": F.when(F.col("_rows"), F.col("row_start") + F.col("_from")).otherwise(F.col("row_start")),
            "parent_id": F.col("id"),
        }
    )
    out = staged.select(
        "parent_id", "part", "text", "source_text", *META, "block_type", "table_id", "row_start", "row_end", "column_group"
    )
    return number_globally(stored(out, "subchunks"), ["parent_id", "part"]).select("id", *out.columns) if numbered else out
