import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarrystone.operators import blocks as B
from quarrystone.operators import chunking as C
from quarrystone.schemas import BLOCKS, CHUNKS


def block(doc, pos, type="paragraph", text=None, path=(), **more):
    row = {"doc_id": doc, "pos": pos, "type": type, "text": text, "source_name": "s", "heading_path": list(path)} | more
    return tuple(row.get(f) for f in BLOCKS.fieldNames())


def table(doc, pos, headers, rows, **more):
    return block(doc, pos, "table", None, **{"table_id": "t", "headers": headers, "rows": rows, **more})


def test_table_block(spark):
    df = spark.sql("select array('', 'A', 'a') h, array(array('x'), array(' ', ''), array('1', '2', '3', '4')) r")
    b = df.select(B.table_block(F.col("h"), F.col("r"), F.lit("s"), F.lit("t")).alias("b")).select("b.*").first()
    assert b.headers == ["Column 1", "A", "a (2)", "Column 4"]
    assert b.rows == [["x", "", "", ""], ["1", "2", "3", "4"]]


def test_text_block_drops_blank_headings(spark):
    b = spark.sql("select ' a  b ' t, array('H', ' ', null) p").select(B.text_block(F.col("t"), F.lit(" s "), path=F.col("p")).alias("b")).select("b.*").first()
    assert (b.text, b.source_name, b.heading_path) == ("a b", "s", ["H"])


@pytest.mark.parametrize(
    "row, error",
    [
        (block(0, 3, text="ok"), None),
        (block(0, 3, type=" ", text="x"), "block 3: type is blank"),
        (block(0, 3, text=None), "text is missing"),
        (block(0, 3, text="x", page=0), "page is below 1"),
        (block(0, 3, text="x", bbox=[0.0, 1.0, 2.0]), "four finite numbers"),
        (block(0, 3, text="x", bbox=[3.0, 1.0, 2.0, 4.0]), "ends before it begins"),
        (table(0, 3, ["a", "b"], [["1", "2"], ["1"]]), "row 2 does not have 2 cells"),
        (table(0, 3, ["a", ""], [["1", "2"]]), "missing or blank"),
        (table(0, 3, ["a"], [["1"]], table_id=" "), "table_id is blank"),
    ],
)
def test_validation(spark, row, error):
    df = spark.createDataFrame([row], BLOCKS)
    got = B.with_errors(df).first().error
    assert got is None if error is None else error in got
    if error:
        with pytest.raises(Exception, match="block 3"):
            B.validated(df).collect()


def test_word_windows(spark):
    text = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    rows = C.word_chunks(df, ["doc_id"], size=10, overlap=2).orderBy("chunk_no").collect()
    assert len(rows) == 4 and {r.doc_id for r in rows} == {1}
    assert rows[1].text.split()[:2] == rows[0].text.split()[-2:]
    one = C.word_chunks(spark.createDataFrame([(1, "Hello, World!")], "doc_id long, text string"), ["doc_id"], size=2, overlap=0).first()
    assert (one.text, one.source_text) == ("Hello World", "Hello, World!")
    with pytest.raises(ValueError):
        C.word_chunks(df, ["doc_id"], size=5, overlap=5)


@given(n=st.integers(0, 3000), size=st.integers(1, 500), overlap=st.integers(0, 499))
@settings(max_examples=200, deadline=None)
def test_window_count_formula(n, size, overlap):
    if overlap >= size:
        return
    starts, at = [], 0
    while at < n:
        starts.append(at)
        if at + size >= n:
            break
        at += size - overlap
    assert len(starts) == (0 if n == 0 else 1 if n <= size else math.ceil((n - size) / (size - overlap)) + 1)


def test_runs_break_at_sections_and_tables(spark):
    rows = [
        block(1, 0, text="a"), block(1, 1, text="b"), block(1, 2, text="c", path=["H"]), table(1, 3, ["k"], [["v"]]), block(1, 4, text="d", path=["H"]),
        table(1, 5, ["k"], []), block(1, 6, text="e", path=["H"]),
    ]
    got = C.text_runs(spark.createDataFrame(rows, BLOCKS)).orderBy("run_pos").collect()
    assert [(r.run_pos, r.source_text) for r in got] == [(0, "a\n\nb"), (2, "H\nc"), (4, "H\nd"), (6, "H\ne")]


def test_tables_are_packed_by_rows(spark):
    rows = [["r1", "a b c"], ["r2", "d e f"], ["r3", "x " * 40]]
    df = spark.createDataFrame([table(1, 0, ["K", "V"], rows, caption="cap")], BLOCKS)
    got = C.structured_chunks(df, 20, 0).orderBy("id").collect()
    assert [(c.row_start, c.row_end) for c in got][0] == (1, 2)
    # the wide third row makes column groups, each led by the first column
    assert all(c.column_group[0] == "K" and c.table_id.startswith("t-columns-") for c in got)
    assert {c.table_prefix for c in got} == {"cap"}
    whole = C.structured_chunks(spark.createDataFrame([table(1, 0, ["K", "V"], rows[:2] * 5)], BLOCKS), 20, 0).orderBy("id").collect()
    assert [(c.row_start, c.row_end) for c in whole] == [(1, 3), (4, 6), (7, 9), (10, 10)]
    assert whole[0].table_id == "t" and whole[0].heading_path is None


@given(costs=st.lists(st.integers(0, 30), max_size=40), base=st.integers(0, 10), size=st.integers(1, 60))
@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_packing_equals_a_loop(spark, costs, base, size):
    packs, acc, n, pack = [], base, 0, 0
    for c in costs:
        if n and acc + c > size:
            pack, acc, n = pack + 1, base, 0
        acc, n = acc + c, n + 1
        packs.append(pack)
    got = spark.createDataFrame([(costs,)], "c array<int>").select(C.pack_rows(F.col("c"), F.lit(base), size).alias("p")).first().p
    assert got == packs


def test_tau(spark):
    text = " ".join(f"w{i}" for i in range(10))
    row = {"id": 5, "doc_id": 1, "text": text, "source_text": text, "block_type": "text"}
    limits = {"id": 6, "doc_id": 1, "text": "x", "source_text": "x", "block_type": "table", "row_start": 1, "row_end": 2, "table_prefix": "P", "table_row_texts": ["a = 1.", "b = 2."]}
    df = spark.createDataFrame([tuple(r.get(f) for f in CHUNKS.fieldNames()) for r in (row, limits)], CHUNKS)
    got = C.tau_subchunks(df, 2).where("parent_id = 5").orderBy("id").collect()
    assert [len(r.text.split()) for r in got] == [2, 3, 3, 2]  # half-even bounds 0 2 5 8 10
    assert " ".join(r.text for r in got) == text
    cut = C.tau_subchunks(df, 1).where("parent_id = 6").orderBy("id").collect()
    assert [(r.row_start, r.row_end, r.source_text) for r in cut] == [(1, 1, "P\na = 1."), (2, 2, "P\nb = 2.")]
    with pytest.raises(ValueError):
        C.tau_subchunks(df, -1)


def test_numbering_is_global_and_dense(spark):
    df = spark.createDataFrame([(d, n) for d in (5, 2500, 7) for n in range(3)], "doc_id long, n int")
    got = C.number_globally(df, ["doc_id", "n"]).orderBy("id").collect()
    assert [(r.doc_id, r.n, r.id) for r in got] == [(d, n, i * 3 + n) for i, d in enumerate((5, 7, 2500)) for n in range(3)]


def test_build_chunks_errors(spark):
    empty = spark.createDataFrame([], BLOCKS)
    with pytest.raises(ValueError, match="unsupported"):
        C.build_chunks(empty, strategy="tokens")
    with pytest.raises(ValueError, match="no chunks"):
        C.build_chunks(empty)
