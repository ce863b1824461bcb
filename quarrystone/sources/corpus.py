"""Structured corpora: blocks of pages or files written with their text, sources and a manifest, under a content key."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.functions.render import block_text
from quarrystone.operators.blocks import text_block, validated
from quarrystone.schemas import BLOCK, CORPUS_VERSION, PDF_CORPUS_VERSION
from quarrystone.sources import html, urls

#: Bits of a position for a block's number in its page or file, and for a page's number in its file.
ITEM_BITS = 32
PAGE_BITS = 20


@dataclass(frozen=True)
class SavedCorpus:
    """Where a corpus lies and what it holds."""

    path: str
    request_key: str
    content_key: str
    corpus_id: str
    source_count: int

    @property
    def blocks_path(self) -> str:
        return f"{self.path}/blocks"

    @property
    def text_path(self) -> str:
        return f"{self.path}/text"

    @property
    def sources_path(self) -> str:
        return f"{self.path}/sources"


def short_hash(*parts: str) -> str:
    return hashlib.sha256("|".join(parts).encode()).hexdigest()[:16]


def content_key(blocks: DataFrame) -> str:
    """A key of ordered blocks. Each block is hashed where it lies; what comes together is one hash for every thousand
    blocks, in order, so no task sees the corpus."""
    one = F.sha2(F.to_json(F.struct(*BLOCK.fieldNames())), 256)
    part = F.floor(F.col("pos") / 1000)
    of_part = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "h"))), lambda x: x["h"]), ""), 256)
    parts = blocks.select("pos", one.alias("h"), part.alias("p")).groupBy("p").agg(of_part.alias("h"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "h"))), lambda x: x["h"]), "")
    return parts.agg(F.substring(F.sha2(whole, 256), 1, 16)).first()[0]


def save_corpus(blocks: DataFrame, sources: DataFrame, root: str, request_key: str, version: str = CORPUS_VERSION) -> SavedCorpus:
    """Writes blocks (``pos`` and block columns), their text and sources; the manifest comes last and makes them count.

    Blocks that render to nothing are dropped, the rest is checked; no block is an error.
    """
    spark = blocks.sparkSession
    kept = validated(blocks).where(F.trim(block_text()) != "").select("pos", *BLOCK.fieldNames())
    if kept.isEmpty():
        raise ValueError("the sources have no readable text")
    key = content_key(kept)
    corpus_id = short_hash(version, request_key, key)
    path = f"{root.rstrip('/')}/corpus_id={corpus_id}"
    saved = SavedCorpus(path, request_key, key, corpus_id, sources.count())
    kept.write.mode("overwrite").parquet(saved.blocks_path)
    stored = spark.read.parquet(saved.blocks_path)
    stored.select("pos", block_text().alias("text")).write.mode("overwrite").parquet(saved.text_path)
    sources.write.mode("overwrite").parquet(saved.sources_path)
    manifest = spark.createDataFrame([(json.dumps(asdict(saved)),)], "value string")
    manifest.coalesce(1).write.mode("overwrite").text(f"{path}/_manifest_json")
    return saved


def load_manifest(spark: SparkSession, root: str, corpus_id: str) -> SavedCorpus | None:
    """The saved corpus of an id, or None where it is missing, broken, or its id isn't 16 hex digits."""
    if not re.fullmatch(r"[0-9a-f]{16}", corpus_id or ""):
        return None
    try:
        path = f"{root.rstrip('/')}/corpus_id={corpus_id}"
        saved = SavedCorpus(**json.loads(spark.read.text(f"{path}/_manifest_json").first()[0]))
        for part in (saved.blocks_path, saved.text_path, saved.sources_path):
            spark.read.parquet(part).schema  # noqa: B018
        return saved
    except Exception:
        return None


def pointer_path(root: str, request_key: str, version: str = PDF_CORPUS_VERSION) -> str:
    return f"{root.rstrip('/')}/_requests/{short_hash(version, request_key)}"


def save_pointer(spark: SparkSession, root: str, saved: SavedCorpus, version: str = PDF_CORPUS_VERSION) -> None:
    """Remembers which corpus answered a request."""
    row = spark.createDataFrame([(saved.corpus_id,)], "corpus_id string")
    row.coalesce(1).write.mode("overwrite").json(pointer_path(root, saved.request_key, version))


def load_pointer(spark: SparkSession, root: str, request_key: str, version: str = PDF_CORPUS_VERSION) -> SavedCorpus | None:
    """The corpus of an earlier request with the same files, if all of it is there."""
    try:
        row = spark.read.schema("corpus_id string").json(pointer_path(root, request_key, version)).first()
    except Exception:
        return None
    return load_manifest(spark, root, row.corpus_id) if row else None


def web_corpus(pages: DataFrame, root: str) -> SavedCorpus:
    """Saves fetched pages (pos, requested_url, final_url, html) in order; a page without blocks gets one from its text."""
    numbered = pages.select(F.col("pos").cast("long").alias("page_id"), F.col("final_url").alias("url"), "html")
    blocks = html.page_blocks(numbered)
    bare = numbered.join(blocks.select("page_id").distinct(), "page_id", "left_anti")
    made = bare.select("page_id", F.lit(0).cast("long").alias("pos"), text_block(F.coalesce("url", F.lit("")), F.coalesce("url", F.lit("")), F.col("url")).alias("b"))
    every = blocks.unionByName(made.select("page_id", "pos", "b.*"))
    ordered = every.withColumn("pos", F.shiftleft(F.col("page_id"), ITEM_BITS) + F.col("pos")).drop("page_id")
    titles = blocks.where("pos = 0").select("page_id", F.col("source_name").alias("title"))
    described = (
        pages.withColumn("page_id", F.col("pos").cast("long")).join(titles, "page_id", "left")
        .select(
            (F.col("pos") + 1).cast("int").alias("source"), F.lit("web").alias("kind"), "requested_url", "final_url", "title",
            F.length("html").alias("characters"), F.lit(None).cast("string").alias("filename"), F.lit(None).cast("long").alias("bytes"),
            F.lit(None).cast("int").alias("pages"), F.lit(None).cast("string").alias("stored_file"),
        )
    )
    key = urls.request_key(pages.select("pos", F.col("requested_url").alias("url"))).first()[0]
    return save_corpus(ordered, described, root, key)


def pdf_corpus(spark: SparkSession, paths: list[str], root: str, extract, most: int = 10, most_bytes: int = 50_000_000) -> SavedCorpus:
    """Saves the blocks of PDF files. ``extract(path)`` gives a file's blocks (file, page, pos, block columns).

    A set of files seen before, whatever their names, isn't read again.
    """
    from quarrystone.sources import pdf

    # contents are hashed where they are read
    found = pdf.pdf_files(spark, paths, most, most_bytes).select("path", "length", F.sha2("content", 256).alias("digest"))
    names = [p.strip().rsplit("/", 1)[-1] for p in paths if p and p.strip()]
    files = sorted(found.collect(), key=lambda f: names.index(f.path.rsplit("/", 1)[-1]))  # at most ``most`` files
    key = pdf.pdf_request_key([(f.length, f.digest) for f in files])
    known = load_pointer(spark, root, key)
    if known:
        return known
    every = None
    for n, f in enumerate(files):
        name = f.path.rsplit("/", 1)[-1]
        found = pdf.require_blocks(extract(f.path), name).withColumn("pos", F.shiftleft(F.lit(n << PAGE_BITS).cast("long") + F.col("page"), ITEM_BITS) + F.col("pos"))
        every = found if every is None else every.unionByName(found)
    rows = [(n + 1, "pdf", None, None, None, None, f.path.rsplit("/", 1)[-1], f.length, None, f"{n + 1:02d}_{f.path.rsplit('/', 1)[-1]}") for n, f in enumerate(files)]
    from quarrystone.schemas import SOURCES

    saved = save_corpus(every, spark.createDataFrame(rows, SOURCES), root, key, PDF_CORPUS_VERSION)
    save_pointer(spark, root, saved)
    return saved


def extract_corpus(spark: SparkSession, sources: list[str], root: str, kind: str = "auto", fetcher=None, extract=None, settings=None) -> SavedCorpus:
    """Addresses or PDF files to a saved corpus."""
    from quarrystone.config import Settings

    s = settings or Settings()
    if urls.source_kind(sources, kind) == "web":
        listed = urls.parse_url_list(spark.createDataFrame([("\n".join(sources),)], "value string"), most=s.max_url_pages)
        pages = urls.fetch_pages(listed, fetcher or urls.http_fetcher(s.url_timeout, s.max_url_page_bytes))
        return web_corpus(pages, root)
    if extract is None:
        raise ValueError("reading PDF files needs a reader")
    return pdf_corpus(spark, sources, root, extract, s.max_pdf_files, s.max_pdf_file_bytes)
