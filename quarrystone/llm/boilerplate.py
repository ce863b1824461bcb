"""Main body of web pages: site templates found by counting element hashes per host.

A page's elements are its lines (the lines of a block are a subtree of the page). Each element has up to two
shapes, hashed: its text with numbers and the site's own name masked, and, for ``label: rest``, its label. Shapes are
counted by host and over all hosts, in distinct pages. A shape that recurs across many pages of its host, or across
a good part of the pages of all hosts that use it, belongs to a template, and elements of such shapes are deleted.
Elements without a shape of their own, such as links to other pages, are deleted by their structure: what stands before
the title, and lines on their own that are no sentence, heading, table row or part of a list.

Text lines leave their page only as hashes: what is shuffled is (host, hash) counts, and for each line its number and
a few flags. A host may own any share of all pages, as counts are combined before they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.runtime import small_side, stored

#: A shape of a host's template stands on at least this many and this share of the host's pages.
HOST_PAGES = 4
HOST_SHARE = 0.3
#: A shape of templates in general stands on at least this many pages, and this share of the pages of hosts that use it.
ALL_PAGES = 8
ALL_SHARE = 0.07
#: The share for elements marked as headings, whose few words a page's own headings may have.
HEADING_SHARE = 0.1
#: The same for labels, which no text body has in common.
LABEL_PAGES = 4
LABEL_SHARE = 0.02
#: Longer elements are text, unless they recur as a whole.
LONGEST = 300
#: Words of a line that is content by itself: with a sentence mark at its end, and without.
SENTENCE_WORDS = 2
CONTENT_WORDS = 12

_WORD = "[\\p{L}\\p{N}]++"


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))


def site_name(of_host: Column) -> Column:
    """The first run of letters of a host without www: what a site calls itself in its template."""
    return F.regexp_extract(of_host, "^(?:www\\.)?(\\p{L}+)", 1)


def _shape(line: Column, site: Column) -> Column:
    masked = F.regexp_replace(F.lower(line), "[0-9]++(?:[.,][0-9]++)*+", "#")
    named = F.when(F.length(site) > 2, F.replace(masked, site, F.lit("@"))).otherwise(masked)
    return F.trim(named)


def _elements(lines: DataFrame) -> DataFrame:
    """Adds shape and label hashes and what kind of line it is. lines: host, line and others; line is trimmed."""
    line = F.col("line")
    # plain searches come before patterns, which most lines are spared
    row = line.contains(" = ") & line.rlike("(?:^|; )[^=;]{1,60} = [^;]")  # a table row written out
    short = F.length(line) <= LONGEST
    label = F.when(line.contains(": "), F.regexp_extract(line, "^([^:]{2,40}?)\\s?: \\S", 1)).otherwise(F.lit(""))
    menu = (F.regexp_count(line, F.lit(" [·|»>/] ")) >= 3) | (line.contains("  ") & (F.regexp_count(line, F.lit("\\S {2,}+")) >= 3))
    # the cut-off beginning of another page, or a link with its section
    teaser = line.rlike("\\s…$") | (line.contains(" · ") & line.rlike("^[^·.!?]{1,30} · [^·.!?]{1,40}$"))
    closed = line.rlike("[.!?…．。！？؟।]['\"”’»“)\\]」]*+$")
    worded = F.when(closed, line.rlike(f"(?:{_WORD}[^\\p{{L}}\\p{{N}}]*+){{{SENTENCE_WORDS}}}")).otherwise(
        F.regexp_count(line, F.lit(_WORD)) >= CONTENT_WORDS
    )
    return lines.withColumn("_site", site_name(F.col("host"))).select(
        *lines.columns,
        row.alias("is_row"),
        (~teaser & ~menu & (worded | ~short)).alias("is_text"),
        line.startswith("- ").alias("is_item"),
        teaser.alias("is_teaser"),
        F.when(~row & (line != ""), F.xxhash64(_shape(line, F.col("_site")))).alias("shape"),
        F.when(~row & short & ~closed & (label != ""), F.xxhash64(F.lit("label"), F.lower(label))).alias("label"),
    )


def template_shapes(elements: DataFrame) -> DataFrame:
    """(host, h, own, common, strong): template shapes, of a host's own or common to all. elements: doc_id, host, shape, label."""
    pages = elements.groupBy("host").agg(F.count_distinct("doc_id").alias("pages"))
    kinds = F.array(F.struct(F.col("shape").alias("h"), F.lit(False).alias("is_label")), F.struct(F.col("label").alias("h"), F.lit(True).alias("is_label")))
    each = elements.select("doc_id", "host", F.explode(kinds).alias("k")).select("doc_id", "host", "k.h", "k.is_label").where("h is not null")
    # distinct pages: a shape repeated on one page counts once
    by_host = each.groupBy("host", "h", "is_label", "doc_id").agg(F.lit(1).alias("one")).groupBy("host", "h", "is_label").agg(F.count(F.lit(1)).alias("n"))
    by_host = stored(by_host.join(small_side(pages), "host"), "shapes")
    over_all = by_host.groupBy("h").agg(F.sum("n").alias("all_n"), F.sum("pages").alias("all_pages"))
    judged = by_host.join(over_all, "h")
    own = (F.col("n") >= HOST_PAGES) & (F.col("n") >= HOST_SHARE * F.col("pages")) & (F.col("pages") > HOST_PAGES)
    common = (F.col("all_n") >= ALL_PAGES) & (F.col("all_n") >= ALL_SHARE * F.col("all_pages"))
    labels = F.col("is_label") & (F.col("all_n") >= LABEL_PAGES) & (F.col("all_n") >= LABEL_SHARE * F.col("all_pages"))
    return judged.where(own | common | labels).select("host", "h", own.alias("own"), (common | labels).alias("common"),
        (F.col("all_n") >= HEADING_SHARE * F.col("all_pages")).alias("strong"))


def mark_lines(elements: DataFrame, shapes: DataFrame) -> DataFrame:
    """Adds ``is_template`` to elements, which have a ``kind`` (the type of the block they stand in, or null)."""
    own = small_side(shapes.where("own").select("host", F.col("h").alias("_h1")).distinct())
    common = small_side(shapes.where("common").groupBy(F.col("h").alias("_h2")).agg(F.bool_or("strong").alias("_strong")))
    common_label = common.select(F.col("_h2").alias("_h3"))
    marked = (
        elements.join(own.withColumnRenamed("host", "_host"), (F.col("host") == F.col("_host")) & (F.col("shape") == F.col("_h1")), "left")
        .join(common, F.col("shape") == F.col("_h2"), "left")
        .join(common_label, F.col("label") == F.col("_h3"), "left")
    )
    # the few words of a heading may recur on the pages of a small site by chance
    heading = F.coalesce(F.col("kind") == "heading", F.lit(False))
    known = F.when(heading, F.coalesce("_strong", F.lit(False))).otherwise(
        F.col("_h1").isNotNull() | F.col("_h2").isNotNull() | F.col("_h3").isNotNull()
    )
    return marked.withColumn("is_template", known).drop("_host", "_h1", "_h2", "_h3", "_strong", "shape", "label")


def place_rules(items: DataFrame) -> DataFrame:
    """Adds ``is_boilerplate`` by an item's template, kind and place on its page. items: place, doc_id, item_no, kind, is_title,
    is_template, is_text, is_row, is_item, is_teaser."""
    page = Window.partitionBy("place", "doc_id")
    by_no = page.orderBy("item_no")
    upto = by_no.rowsBetween(Window.unboundedPreceding, 0)
    body = (F.col("is_text") | F.col("is_row")) & ~F.col("is_template")
    marked = items.withColumn("_title_at", F.min(F.when(F.col("is_title"), F.col("item_no"))).over(page))
    marked = marked.withColumn("_last", F.coalesce(F.max(F.when(body, F.col("item_no"))).over(page), "_title_at", F.lit(-1)))
    marked = marked.withColumn("_after", F.col("item_no") > F.col("_last"))
    marked = marked.withColumn("_tail", F.max((F.col("_after") & F.col("is_template")).cast("int")).over(upto) == 1)
    leads = F.coalesce(F.lead(body | (F.col("is_item") & ~F.col("is_template"))).over(by_no), F.lit(False))
    before = F.coalesce(F.col("item_no") < F.col("_title_at"), F.lit(False))
    loose = F.col("kind").isin("list", "paragraph")  # a single line; lists of several are of kind lists
    alone = F.when(loose, ~F.col("is_text")).when(F.col("kind").isNotNull(), F.lit(False))
    # pages without blocks: links follow the template elements after the last content; headings lead to content
    alone = alone.otherwise(~F.col("is_text") & (F.col("_tail") | ~(F.col("is_item") | leads)))
    junk = before | (~F.col("is_row") & (F.col("is_template") | F.col("is_teaser") | alone))
    return marked.withColumn("is_boilerplate", junk & ~F.col("is_title")).drop("_title_at", "_last", "_after", "_tail")


def _bare_title(title: Column) -> Column:
    return F.trim(F.regexp_replace(title, " [|] [^|]*$", ""))


def label_pages(web_pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """(place, doc_id, item_no, is_boilerplate): every line of every page (place ``line``) and every block of a web page
    (place ``block``).

    A page or block stored twice counts once (of a page's rows the one loaded last). Pages with null text have no
    lines; blocks with null text, such as tables, are content. Blank lines are boilerplate only where their
    place makes them so. Pages without a title keep what stands before the body unless its shape is a template's.
    """
    pages = web_pages.select("doc_id", F.coalesce("final_url", "requested_url").alias("url"), "title", "text", "loaded_at")
    newest = F.max_by(F.struct("url", "title", "text"), F.struct(F.col("loaded_at").isNotNull(), "loaded_at")).alias("p")
    pages = pages.where("doc_id is not null").groupBy("doc_id").agg(newest).select("doc_id", "p.*").withColumn("host", host(F.col("url")))
    lines = pages.select("doc_id", "host", _bare_title(F.col("title")).alias("_title"), F.posexplode(F.split("text", "\n", -1)).alias("item_no", "line"))
    lines = lines.withColumn("line", F.trim(F.col("line"))).withColumn("is_title", F.coalesce(F.col("line") == F.col("_title"), F.lit(False)))
    lines = lines.withColumn("_same", F.xxhash64("line"))
    elements = stored(_elements(lines).drop("line", "_title"), "elements")
    shapes = stored(template_shapes(elements), "templates")

    mine = blocks.where("source_url is not null and doc_id is not null and pos is not null")
    mine = mine.select("doc_id", "pos", host(F.col("source_url")).alias("host"), "type", "text").dropDuplicates(["doc_id", "pos"])
    parts = mine.select(
        "doc_id", "pos", "host", F.when((F.col("type") == "list") & F.col("text").contains("\n"), "lists").otherwise(F.col("type")).alias("kind"),
        F.posexplode_outer(F.split("text", "\n", -1)).alias("_i", "line"),
    )
    parts = parts.withColumn("line", F.trim(F.col("line"))).withColumn("_same", F.xxhash64("line"))
    parts = stored(_elements(parts).withColumn("is_table", F.col("line").isNull()).drop("line"), "block-elements")

    # the block a line stands in: the same line's n-th occurrence on the page
    nth = lambda *order: F.row_number().over(Window.partitionBy("doc_id", "_same").orderBy(*order))
    kinds = parts.where("not is_table").select("doc_id", "_same", "kind", nth("pos", "_i").alias("_n"))
    of_lines = elements.withColumn("_n", nth("item_no")).join(kinds, ["doc_id", "_same", "_n"], "left")
    flags = ["is_title", "is_template", "is_text", "is_row", "is_item", "is_teaser"]
    of_lines = mark_lines(of_lines, shapes).select(
        F.lit("line").alias("place"), "doc_id", F.col("item_no").cast("long").alias("item_no"), "kind", *flags
    )
    titles = pages.where("title is not null").select("doc_id", F.xxhash64(_bare_title(F.col("title"))).alias("_title"))
    judged = mark_lines(parts.join(titles, "doc_id", "left"), shapes)
    whole = judged.groupBy("doc_id", "pos").agg(
        F.first("kind").alias("kind"),
        F.bool_or(F.coalesce(F.col("_same") == F.col("_title"), F.lit(False))).alias("is_title"),
        (F.avg(F.col("is_template").cast("int")) >= 0.5).alias("is_template"),
        F.bool_or("is_text").alias("is_text"),
        F.bool_or(F.col("is_row") | F.col("is_table")).alias("is_row"),
        F.bool_and("is_item").alias("is_item"),
        F.bool_and("is_teaser").alias("is_teaser"),
    )
    of_blocks = whole.select(F.lit("block").alias("place"), "doc_id", F.col("pos").alias("item_no"), "kind", *flags)
    items = of_lines.unionByName(of_blocks).na.fill(False, flags)
    return place_rules(items).select("place", "doc_id", "item_no", "is_boilerplate")


def main_text(web_pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc_id, text): the main body of every page, its kept lines joined by line feeds."""
    kept = label_pages(web_pages, blocks).where("place = 'line' and not is_boilerplate")
    numbers = kept.groupBy("doc_id").agg(F.array_sort(F.collect_list("item_no")).alias("_keep"))
    newest = F.max_by("text", F.struct(F.col("loaded_at").isNotNull(), "loaded_at")).alias("text")
    pages = web_pages.where("doc_id is not null").groupBy("doc_id").agg(newest)
    lines = F.split("text", "\n", -1)
    body = F.array_join(F.transform("_keep", lambda i: F.get(lines, i.cast("int"))), "\n")
    return pages.join(numbers, "doc_id", "left").select("doc_id", F.when(F.col("text").isNotNull(), F.coalesce(body, F.lit(""))).alias("text"))
