"""Text and JSON files, and vectors as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrystone.operators.blocks import validated
from quarrystone.schemas import BLOCK, VECTORS


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): whole files as UTF-8; a byte order mark is removed, bytes that aren't UTF-8 are replaced."""
    files = spark.read.format("binaryFile").load(path)
    text = F.make_valid_utf8(F.col("content").cast("string"))
    return files.select("path", F.regexp_replace(text, "^\\uFEFF", "").alias("text"))


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object a line; the files appear when the whole job has ended."""
    df.write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of a JSON list (or one object a line), in order, each checked; a faulty one raises an error when read."""
    raw = spark.read.schema(BLOCK).option("multiLine", True).json(path)
    # a file is one list read by one task, in order
    listed = raw.withColumn("pos", F.monotonically_increasing_id())
    return validated(listed)


def write_vectors(vectors: DataFrame, path: str) -> None:
    vectors.select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<float>").alias("vec")).write.mode("overwrite").parquet(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(VECTORS).parquet(path)
