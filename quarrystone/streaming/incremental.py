"""Incremental indexing of documents that arrive over time, with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from quarrystone.operators.chunking import OVERLAP, SIZE, word_chunks
from quarrystone.providers import Embedder
from quarrystone.runtime import stored

#: Bits of a chunk's id for its number in its document: 16 million chunks, over six billion words.
CHUNK_BITS = 24


def index_batch(documents: DataFrame, root: str, embedder: Embedder, size: int = SIZE, overlap: int = OVERLAP) -> None:
    """Adds the chunks and vectors of documents (doc_id, text) that aren't indexed yet. Running it again adds nothing, and
    after a failure only what is missing: chunks are written first, then the vectors of chunks that have none.

    A chunk's id is its document's and its number in it, so batches need no common counter.
    """
    once = stored(documents.dropDuplicates(["doc_id"]), "batch")
    new = once.join(_written(once, f"{root}/chunks", "doc_id"), "doc_id", "left_anti")
    chunks = word_chunks(new, ["doc_id"], "text", size, overlap)
    chunks = chunks.withColumn("id", F.shiftleft(F.col("doc_id").cast("long"), CHUNK_BITS) + F.col("chunk_no"))
    chunks.select("id", "doc_id", "chunk_no", "text", "source_text").write.mode("append").parquet(f"{root}/chunks")
    mine = once.sparkSession.read.parquet(f"{root}/chunks").join(once.select("doc_id"), "doc_id", "left_semi")
    bare = mine.join(_written(once, f"{root}/chunk_vectors", "id"), "id", "left_anti")
    embedder.embed(stored(bare.select("id", "text"), "bare")).write.mode("append").parquet(f"{root}/chunk_vectors")


def _written(like: DataFrame, path: str, key: str) -> DataFrame:
    """The keys of a stored table; none where it doesn't exist yet."""
    spark = like.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], f"{key} long")
    return spark.read.parquet(path).select(key).distinct()


def index_stream(spark: SparkSession, folder: str, schema: T.StructType, root: str, embedder: Embedder, checkpoint: str) -> StreamingQuery:
    """Indexes Parquet files of documents as they appear in a folder; ends when all there now are done."""
    incoming = spark.readStream.schema(schema).parquet(folder).select("doc_id", "text")
    return (
        incoming.writeStream.foreachBatch(lambda batch, _: index_batch(batch, root, embedder))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def term_counts_stream(documents: DataFrame, at: str = "collected_at", late: str = "2 days", width: str = "1 day") -> DataFrame:
    """(window, source, documents, characters) of a stream of documents, by day of collection; late rows within ``late``."""
    timed = documents.where(F.col(at).isNotNull()).withWatermark(at, late)
    return timed.groupBy(F.window(at, width), "source").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.length("text")).alias("characters"))
