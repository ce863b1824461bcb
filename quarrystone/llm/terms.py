"""Frequency of every distinct term over a collection, with marks for terms too rare or too common to be useful.

Each record emits its own term counts, counts of equal terms are combined by hash before anything is shuffled,
and only one partial row per term and task crosses the network. A term may stand in any share of all records:
its partial rows are as many as there are tasks, never as many as there are records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.functions.text import casefold, words

#: A term in at most so many records is rare.
RARE_RECORDS = 1
#: A term in more than this share of the records with text is common.
COMMON_SHARE = 0.1


def records(df: DataFrame, key: str, text: str) -> DataFrame:
    """(record, text): each key once. Rows without a key are records of their own, told apart by their text."""
    k, t = df[f"`{key}`"], df[f"`{text}`"]
    return df.select(k.alias("_key"), F.when(k.isNull(), t).alias("_own"), t.alias("_text")).dropDuplicates(
        ["_key", "_own"]
    )


def term_frequencies(
    df: DataFrame,
    key: str,
    text: str,
    rare_records: int = RARE_RECORDS,
    common_share: float = COMMON_SHARE,
    terms: Column | None = None,
) -> DataFrame:
    """(term, n_total, n_records, mark): how often each term occurs in all and in how many records.

    ``mark`` is ``rare`` for terms in at most ``rare_records`` records, ``common`` for terms in more than
    ``common_share`` of the records whose text isn't null, else null; a term that is both counts as rare.
    Terms are the words of the text, lower-cased with ß as ss, or the array ``terms`` over a column ``_text``.
    A repeated key counts once; null and empty texts have no terms; an empty table gives no rows.
    """
    each = records(df, key, text).where(F.col("_text").isNotNull())
    n_texts = each.agg(F.count(F.lit(1)).alias("n"))
    split = words(casefold(F.col("_text"))) if terms is None else terms
    # dropDuplicates left each record in one task: the counts within a record need no further shuffle
    per_record = (
        each.select("_key", "_own", F.explode(split).alias("term")).groupBy("_key", "_own", "term").agg(F.count(F.lit(1)).alias("n"))
    )
    total = per_record.groupBy("term").agg(F.sum("n").alias("n_total"), F.count(F.lit(1)).alias("n_records"))
    bound = n_texts.select(F.col("n") * F.lit(common_share)).scalar()
    mark = F.when(F.col("n_records") <= rare_records, "rare").when(F.col("n_records") > bound, "common")
    return total.select("term", "n_total", "n_records", mark.alias("mark"))
