"""The registered queries of the training-data operators, and their SQL equivalents where SQL can express them.

Each runs over its whole tables with production parameters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.llm import boilerplate, lookalike, mixing, names, neighbours, pieces, readability, sentences, terms, tokens
from quarrystone.runtime import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.lookalike_blocks(table(spark, d, "blocks"))


def p1_consistent(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.consistent(table(spark, d, "blocks"), ["doc_id", "pos"])


def p2_terms(spark: SparkSession, d: str) -> DataFrame:
    return terms.term_frequencies(table(spark, d, "subchunks"), "id", "text")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_terms(spark, d).where(F.col("mark").isNotNull()).select("term", "mark")


def p3_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.similar(table(spark, d, "relation_vectors"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.similar_pairs(p3_neighbours(spark, d))


def p4_main_text(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.main_text(table(spark, d, "web_pages"), table(spark, d, "blocks"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    marked = boilerplate.label_pages(table(spark, d, "web_pages"), table(spark, d, "blocks"))
    return marked.where("is_boilerplate").select("place", "doc_id", "item_no")


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    entities, relations = table(spark, d, "entities"), table(spark, d, "relations")
    return names.link_names([entities.select("name"), relations.select("source"), relations.select("target")])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return names.name_pairs(p5_groups(spark, d))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentences(table(spark, d, "corpus"))


def p7_pieces(spark: SparkSession, d: str) -> DataFrame:
    blocks = table(spark, d, "blocks").select(F.lit("blocks").alias("place"), "doc_id", F.col("pos").alias("item_no"), "text")
    chunks = table(spark, d, "chunks").select(
        F.lit("chunks").alias("place"), "doc_id", F.col("id").alias("item_no"), F.col("source_text").alias("text")
    )
    found = pieces.split_long(blocks.unionByName(chunks), ["place", "doc_id", "item_no"])
    # an item stored twice counts once; only the few long ones are compared
    return found.dropDuplicates(["place", "doc_id", "item_no", "piece_no"])


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_pieces(spark, d).where("piece_no = 1").select("place", "doc_id", "item_no")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(table(spark, d, "documents"), ["doc_id"]).select("doc_id", "ids")


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(p9_mix(spark, d), table(spark, d, "mix_targets"))


def p10_levels(spark: SparkSession, d: str) -> DataFrame:
    return readability.reading_levels(table(spark, d, "documents"), table(spark, d, "reading_samples"), ["doc_id"])


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_levels(spark, d).where(F.col("reading_level").isNotNull()).select("doc_id", "reading_level")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = [
        p1_found, p1_consistent, p2_found, p2_terms, p3_found, p3_neighbours, p4_found, p4_main_text, p5_found, p5_groups,
        p6_found, p7_found, p7_pieces, p8_ids, p9_mix, p9_shares, p10_found, p10_levels,
    ]
    return {f.__name__: f for f in every}


_WORDS = "regexp_extract_all({}, '[\\p{{L}}\\p{{N}}]+(?:[''’][\\p{{L}}\\p{{N}}]+)*')"

_TERMS = f"""
WITH r AS (SELECT DISTINCT id, text FROM subchunks WHERE text IS NOT NULL),
t AS (SELECT id, unnest({_WORDS.format("replace(lower(text), 'ß', 'ss')")}) AS term FROM r),
n AS (SELECT count(*) AS n FROM r),
f AS (SELECT term, count(*) AS n_total, count(DISTINCT id) AS n_records FROM t GROUP BY term)
SELECT term, n_total, n_records,
       CASE WHEN n_records <= 1 THEN 'rare' WHEN n_records > 0.1 * n THEN 'common' END AS mark
FROM f, n
"""


def oracle_sql() -> dict[str, str]:
    long_items = f"""
    SELECT DISTINCT 'blocks' AS place, doc_id, pos AS item_no FROM blocks WHERE len({_WORDS.format("text")}) > 450
    UNION ALL
    SELECT DISTINCT 'chunks' AS place, doc_id, id AS item_no FROM chunks WHERE len({_WORDS.format("source_text")}) > 450
    """
    return {
        "p2_terms": _TERMS,
        "p2_found": f"SELECT term, mark FROM ({_TERMS}) WHERE mark IS NOT NULL",
        "p7_found": long_items,
    }
