import re

import pytest
from pyspark.sql import functions as F

from quarrystone.functions import render, text

WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr.alias("y")).first()[0]


def test_words(spark):
    assert one(spark, text.words(F.col("x")), "Hello, World! Isn't this Dr. Watson?") == ["Hello", "World", "Isn't", "this", "Dr", "Watson"]
    assert one(spark, text.words(F.col("x")), None) is None


@pytest.mark.parametrize("s", ["", " a  b ", "it’s 3.5_x", "naïve Straße ok", "多語 字", "''a''b'c"])
def test_words_and_gaps_rebuild_the_text(spark, s):
    row = spark.createDataFrame([(s,)], "x string").select(text.words(F.col("x")).alias("w"), text.gaps(F.col("x")).alias("g")).first()
    assert row.w == WORD.findall(s)
    assert len(row.g) == len(row.w) + 1
    assert "".join(a + b for a, b in zip(row.g, [*row.w, ""])) == s


def test_clean_text(spark):
    assert one(spark, text.clean_text(F.col("x")), "\t a   b\n") == "a b"
    assert one(spark, text.clean_text(F.col("x")), None) == ""


def test_text_span(spark):
    assert one(spark, text.text_span(F.col("x"), F.lit(0), F.lit(2)), "Hello, World!") == "Hello, World!"
    assert one(spark, text.text_span(F.col("x"), F.lit(1), F.lit(1)), "(Hello), World! x") == "World!"


def test_keyword_and_lexical_tokens_differ(spark):
    s = "The Straße isn't a_b ok x"
    assert one(spark, text.keyword_tokens(F.col("x")), s) == ["strasse", "isn't", "b", "ok", "x"]
    assert one(spark, text.lexical_terms(F.col("x")), s) == ["straße", "isn", "a_b", "ok"]


def test_sentences(spark):
    s = "Dr. Watson arrived. Mr. Holmes waited! No. This fragment remains long enough."
    got = one(spark, text.split_sentences(F.col("x")), s)
    assert len(got) == 3 and got[2].startswith("No. This")
    assert one(spark, text.split_sentences(F.col("x")), "J. K. Rowling wrote this. It was version 2. of many... and more came.") == [
        "J. K. Rowling wrote this.", "It was version 2. of many... and more came.",
    ]


def test_group_numbers(spark):
    g = text.group_numbers(F.col("x"))
    assert one(spark, g, "a 41 256 010 b 1234 567 c 1 000") == "a 41256010 b 1234 567 c 1000"
    assert one(spark, g, "no numbers") == "no numbers"


def test_small_parsers(spark):
    assert one(spark, text.progress_counts(F.col("x")), "Parsed 1/9, then 3/7 done").asDict() == {"done": 3, "total": 7}
    assert one(spark, text.progress_counts(F.col("x")), "nothing") is None
    assert one(spark, text.retry_delay(F.col("x")), "quota: please retry in 12.5s") == 12.5
    assert one(spark, text.retry_delay(F.col("x")), "no") is None
    assert one(spark, text.strip_code_fence(F.col("x")), "```json\n{}\n```") == "{}"


def test_rendering(spark):
    df = spark.sql("select array('Code', 'Price') headers, array(array('A1', ' 5  0 ', 'extra'), array('', ''), array('B2', '')) rows, 'table' type, array('P', 'Q') heading_path, '' caption, cast(null as string) text")
    assert df.select(render.block_text().alias("t")).first().t == "P > Q\nCode = A1; Price = 5 0.\nCode = B2."
    rel = spark.createDataFrame([("Holmes", "Watson", "friend", None), ("A", "B", " ", "d")], "source string, target string, relation string, description string")
    assert [r[0] for r in rel.select(render.relation_text()).collect()] == ["Holmes --[friend]--> Watson", "A --[related to]--> B. d"]


def test_labels(spark):
    schema = "id long, parent_id long, text string, source_text string, source_name string, page int, table_id string, row_start int, row_end int, rank int"
    df = spark.createDataFrame([(1, 7, "second", None, None, None, None, None, None, 1), (2, 7, "t", "source", "s.pdf", 4, "limits", 2, 2, 2)], schema)
    assert render.context(df, subchunk=True).first()[0] == "[chunk 7, subchunk 1]\nsecond\n\n[chunk 7, subchunk 2, source s.pdf, page 4, table limits, rows 2-2]\nsource"
    assert render.context(df.limit(0)).first()[0] == ""


def test_stored_tables_can_be_released(spark):
    from quarrystone import runtime

    kept = runtime.stored(spark.range(5).toDF("id"), "five")
    path = runtime._WRITTEN[-1]
    assert kept.count() == 5 and runtime.local_path_exists(path)
    runtime.release(spark)
    assert not runtime.local_path_exists(path)


def test_small_sides_are_checked(spark):
    from quarrystone.runtime import small_side

    big = spark.range(10**7).selectExpr("id", "cast(id as string) x").distinct()
    assert "broadcast" in small_side(spark.range(5))._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in small_side(big, 1000)._jdf.queryExecution().logical().toString().lower()


def test_running_totals_over_buckets(spark):
    from quarrystone.runtime import prefix_offsets

    df = spark.createDataFrame([("a", i // 3, i, i) for i in range(10)] + [("b", 0, 0, 5)], "g string, b int, o int, n long")
    got = {(r.g, r.o): r.t for r in prefix_offsets(df, "g", ["o"], "n", "b", "t").collect()}
    assert all(got["a", i] == sum(range(i + 1)) for i in range(10)) and got["b", 0] == 5
