import numpy as np
import pandas as pd
import pytest

from quarrystone.config import Settings
from quarrystone.plans.pipeline import Comparison, text_blocks
from quarrystone.plans.store import skeleton_name, source_key
from quarrystone.providers import GraphExtractionError, HashingEmbedder, RemoteEmbedder, RuleExtractor, parse_extractions
from quarrystone.schemas import BLOCKS, PDF_TABLES, PDF_WORDS
from quarrystone.sources import corpus, html, pdf, urls
from quarrystone.streaming import incremental


def test_url_lists(spark):
    assert urls.urls_from_text(spark, "https://a.example/x\n\n http://b.example \nhttps://a.example/x") == ["https://a.example/x", "http://b.example"]
    for bad in ("file:///etc/passwd", "https://u:p@a.example/", "https:///x"):
        with pytest.raises(Exception):
            urls.urls_from_text(spark, bad)
    with pytest.raises(Exception, match="at most 1"):
        urls.urls_from_text(spark, "http://a.example\nhttp://b.example", most=1)
    with pytest.raises(ValueError, match="Provide at least one"):
        urls.urls_from_text(spark, " \n ")


def test_source_kinds():
    assert urls.source_kind(["http://a.example/x.pdf"]) == "web" and urls.source_kind(["a.PDF", "b.pdf"]) == "pdf"
    for bad in ([], [" "], ["a.pdf", "http://b.example"], ["a.txt"]):
        with pytest.raises(ValueError):
            urls.source_kind(bad)
    with pytest.raises(ValueError):
        urls.source_kind(["a.pdf"], "ftp")


def test_responses():
    assert urls.read_response("http://a.example", "text/html; charset=latin-1", "é".encode("latin-1"), 10) == "é"
    assert urls.read_response("http://a.example", "text/html; charset=none", b"x\xff", 10) == "x�"
    for args in (("ftp://a", "text/html", b"", 9), ("http://a", "image/png", b"", 9), ("http://a", "text/html", b"12", 1)):
        with pytest.raises(ValueError):
            urls.read_response(*args)


PAGE = """<html><head><title>Example   article</title><style>x</style></head><body><nav>menu</nav><main><h1>Top</h1><p>One <b>two</b>.</p>
<ul><li>a<ul><li>b</li></ul></li><li></li><li>c</li></ul><ol><li></li><li>d</li></ol><div><p>inner</p></div><section>leaf</section><script>no</script>
<table><caption>Cap</caption><thead><tr><th rowspan="2">Parameter</th><th colspan="2">Limits</th></tr><tr><th>Minimum</th><th>Maximum</th></tr></thead>
<tr><td>T</td><td>1</td><td>2</td></tr><tr><td>U</td><td>3</td><td>4</td></tr></table><h2>Sub</h2><p>end</p></main></body></html>"""


def test_html_blocks():
    title, blocks = html.html_blocks(PAGE, "fallback", "http://a.example")
    assert title == "Example article"
    assert [(b["type"], b["text"]) for b in blocks if b["type"] != "table"] == [
        ("heading", "Example article"), ("heading", "Top"), ("paragraph", "One two ."), ("list", "- a b - c"), ("list", "2. d"), ("paragraph", "inner"),
        ("paragraph", "leaf"), ("heading", "Sub"), ("paragraph", "end"),
    ]
    t = next(b for b in blocks if b["type"] == "table")
    assert t["headers"] == ["Parameter", "Limits > Minimum", "Limits > Maximum"] and t["rows"] == [["T", "1", "2"], ["U", "3", "4"]]
    assert t["caption"] == "Cap" and t["heading_path"] == ["Top"] and blocks[-1]["heading_path"] == ["Top", "Sub"]
    assert html.html_blocks("just text", "n", "u")[1][0]["text"] == "just text"
    assert html.html_blocks("", "n", "u") == ("", [])


def words(rows):
    return pdf.Words.of(pd.DataFrame(rows, columns=["text", "x0", "top", "x1", "bottom", "upright"]))


def w(text, x0, top, width=20, up=True):
    return (text, float(x0), float(top), float(x0 + width), float(top + 8), up)


def test_lines_and_rotated_text():
    page = words([w("b", 40, 11), w("a", 0, 10), w("c", 0, 30), w("up", 100, 50, up=False), w("going", 101, 20, up=False)])
    assert page.say(np.arange(5)) == "a b c up going"
    assert pdf.merged_edges([5.0, 0.0, 0.6, 5.4]) == [0.3, 5.2]


def test_price_lines_split_a_row():
    cells = [w("Model", 0, 10), w("4NC", 60, 10), w("–", 120, 10), w("o", 120, 30), w("721", 180, 10), w("360", 200, 10), w("1", 180, 30), w("000", 200, 30), w("760", 220, 30)]
    page = words(cells)
    columns = [np.array([0]), np.array([1]), np.array([2, 3]), np.array([4, 5, 6, 7, 8])]
    assert pdf.split_row(page, columns) == [["Model", "4NC", "–", "721360"], ["Model", "4NC", "o", "1000760"]]


def test_table_with_an_unruled_first_column_and_headers_above():
    page = words([
        w("Name", 10, 80), w("Power", 110, 80), w("Price", 210, 80), w("A8", 10, 102), w("250", 110, 102), w("41", 210, 102, 10), w("256", 222, 102, 15), w("010", 240, 102, 15),
        w("Hybrid", 130, 122), w("B9", 10, 142), w("300", 110, 142), w("5", 210, 142),
    ])
    row = lambda y: [[100.0, y, 200.0, y + 20], [200.0, y, 300.0, y + 20]]
    grid = [row(100.0), [[100.0, 120.0, 300.0, 140.0]], row(140.0)]
    t = pdf.read_table(page, [100.0, 100.0, 300.0, 160.0], grid, [[100.0, 100.0, 300.0, 160.0]])
    assert t.headers == ["Name", "Power", "Price"]
    assert t.rows == [["A8", "250", "41256010"], ["B9", "300", "5"]] and t.sections == [(120.0, "Hybrid")]
    peer = pdf.read_table(page, [100.0, 100.0, 300.0, 160.0], grid, [[0.0, 90.0, 90.0, 170.0], [100.0, 100.0, 300.0, 160.0]])
    assert len(peer.headers) == 2


def test_pdf_pages(spark):
    rows = [("f.pdf", 1, i, *x) for i, x in enumerate([w("Intro", 0, 10), w("text", 30, 10), w("H1", 0, 302), w("H2", 60, 302), w("a", 0, 322), w("b", 60, 322)])]
    ruled = [("f.pdf", 1, 1, [0.0, 300.0, 100.0, 340.0], [[[0.0, 300.0, 50.0, 320.0], [50.0, 300.0, 100.0, 320.0]], [[0.0, 320.0, 50.0, 340.0], [50.0, 320.0, 100.0, 340.0]]])]
    got = pdf.page_blocks(spark.createDataFrame(rows, PDF_WORDS), spark.createDataFrame(ruled, PDF_TABLES)).orderBy("pos").collect()
    assert [(b.type, b.text) for b in got] == [("paragraph", "Intro text"), ("table", None)]
    assert got[1].headers == ["H1", "H2"] and got[1].rows == [["a", "b"]] and got[1].caption == "Intro text" and got[1].table_id == "f.pdf-page-1-table-1"
    assert pdf.raw_table([["", None], ["a"], ["b", "c"]]) == (["a", ""], [["b", "c"]])
    assert pdf.raw_table([["a", "b"]]) == (["Column 1", "Column 2"], [["a", "b"]])


def test_pdf_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "b.pdf").write_bytes(b"nothing")
    assert pdf.pdf_files(spark, [str(tmp_path / "a.pdf")] * 2).count() == 1
    for bad in ([str(tmp_path / "b.pdf")], ["x.txt"], []):
        with pytest.raises(Exception):
            pdf.pdf_files(spark, bad).collect()
    assert pdf.pdf_request_key([(1, "a"), (1, "b")]) != pdf.pdf_request_key([(1, "b"), (1, "a")]) == pdf.pdf_request_key([(1, "b"), (1, "a")])


def test_extraction_answers(spark):
    answer = '```json\n{"chunk_id": 5, "entities": [{"name": "x"}], "relations": []}\n{"chunk_id": 2, "entities": [], "relations": []} {"chunk_id": true} [1]\n{"chunk_id": 5, "entities": [{"name": "y", "description": "d"}]}```'
    answers = spark.createDataFrame([(answer,)], "answer string")
    expected = spark.createDataFrame([(2,), (5,)], "chunk_id long")
    got = parse_extractions(answers, expected).orderBy("chunk_id").collect()
    assert [g.chunk_id for g in got] == [2, 5] and got[1].entities[0].name == "y"
    with pytest.raises(GraphExtractionError):
        parse_extractions(answers, spark.createDataFrame([(9,)], "chunk_id long"))


def test_remote_embedder_resumes(spark):
    texts = spark.createDataFrame([(i, f"t{i}") for i in range(5)], "id long, text string")
    calls = RemoteEmbedder(lambda ts, task: [[float(len(t)), 0.0] for t in ts], 2, batch=2, delay=0)
    done = spark.createDataFrame([(0, [0.0, 1.0])], "id long, vec array<double>")
    got = {r.id: r.vec for r in calls.embed(texts, done=done).collect()}
    assert len(got) == 5 and got[0] == [0.0, 1.0] and got[1] == [1.0, 0.0]


def test_corpus_is_saved_and_found_again(spark, tmp_path):
    pages = spark.createDataFrame([(0, "http://a.example", "http://a.example/", PAGE), (1, "http://b.example", "http://b.example/", "")], "pos int, requested_url string, final_url string, html string")
    saved = corpus.web_corpus(pages, str(tmp_path))
    again = corpus.web_corpus(pages, str(tmp_path))
    assert saved == again and saved.source_count == 2
    assert corpus.load_manifest(spark, str(tmp_path), saved.corpus_id) == saved
    assert corpus.load_manifest(spark, str(tmp_path), "no") is None and corpus.load_manifest(spark, str(tmp_path), "0" * 16) is None
    corpus.save_pointer(spark, str(tmp_path), saved)
    assert corpus.load_pointer(spark, str(tmp_path), saved.request_key) == saved
    text = spark.read.parquet(saved.text_path).orderBy("pos").collect()
    assert text[0].text == "Example article"
    with pytest.raises(ValueError):
        corpus.save_corpus(spark.createDataFrame([], BLOCKS), pages, str(tmp_path), "k")


def test_index_keys():
    s = Settings(embedding_dimensions=8)
    assert source_key("a", s) != source_key("b", s) and len(source_key("a", s)) == 16
    assert skeleton_name(6, 0.2, 1, "m").startswith("skeleton_k6_b0.2_t1_x")


def test_build_resume_and_compare(spark, tmp_path):
    texts = spark.createDataFrame([(i, f"Sherlock Holmes met Doctor Watson in case {i}. Evidence about Baker Street was found there.") for i in range(4)], "doc_id long, text string")
    seen = []
    job = Comparison(spark, str(tmp_path), Settings(embedding_dimensions=16), progress=seen.append)
    with pytest.raises(ValueError, match="build the indexes"):
        job.compare("who?")
    job.build(blocks=text_blocks(texts), k=2, beta=0.5)
    first = len(seen)
    job.build(blocks=text_blocks(texts), k=2, beta=0.5)
    assert first > 5 and len(seen) == first
    rows = job.compare("Who met Watson?", top_k=2).collect()
    assert [r.strategy for r in rows] == ["text", "graph", "two_channel"] and all(r.answer for r in rows)
    with pytest.raises(ValueError, match="ask"):
        job.compare(" ")


def test_incremental_index(spark, tmp_path):
    docs = spark.createDataFrame([(1, "one two three"), (1, "one two three"), (2, None)], "doc_id long, text string")
    for _ in range(2):
        incremental.index_batch(docs, str(tmp_path), HashingEmbedder(8))
    assert spark.read.parquet(f"{tmp_path}/chunks").count() == spark.read.parquet(f"{tmp_path}/chunk_vectors").count() == 1


def test_rules_find_names():
    entities, relations = RuleExtractor().rules("Sherlock Holmes saw Doctor Watson. nobody else")
    assert [e["name"] for e in entities] == ["Sherlock Holmes", "Doctor Watson"] and relations[0]["source"] == "Sherlock Holmes"


def test_text_and_block_files(spark, tmp_path):
    from quarrystone.sources import files

    (tmp_path / "a.txt").write_bytes(b"\xef\xbb\xbfab\xff c")
    assert files.read_text(spark, str(tmp_path / "a.txt")).first().text == "ab� c"
    (tmp_path / "b.json").write_text('[{"type": "paragraph", "text": "x", "source_name": "s", "heading_path": []}, {"type": "table", "table_id": "t", "source_name": "s", "headers": ["a", "b"], "rows": [["1"]]}]')
    with pytest.raises(Exception, match="does not have 2 cells"):
        files.read_blocks(spark, str(tmp_path / "b.json")).collect()
    vectors = spark.createDataFrame([(1, [1.0, 2.0])], "id int, vec array<double>")
    files.write_vectors(vectors, str(tmp_path / "v"))
    assert files.read_vectors(spark, str(tmp_path / "v")).first().vec == [1.0, 2.0]
    files.write_json(vectors, str(tmp_path / "j"))
    assert files.read_json(spark, str(tmp_path / "j"), vectors.schema).first().id == 1


def test_table_spans_and_header_levels():
    from quarrystone.sources.html import parse, read_table

    table = """<table><thead><tr><th rowspan=2>Parameter</th><th colspan=2>Limits</th></tr><tr><th>Minimum</th><th>Maximum</th></tr></thead>
    <tr><td rowspan="2">Force</td><td>1</td><td>2</td></tr><tr></tr><tr><td colspan=2>same</td></tr></table>"""
    headers, rows = read_table(parse(table).first("table"))
    assert headers == ["Parameter", "Limits > Minimum", "Limits > Maximum"]
    assert rows == [["Force", "1", "2"], ["Force", "same", "same"]]
    plain = "<table><tr><td>a</td><td rowspan=3>b</td></tr><tr><td>c</td></tr></table>"
    assert read_table(parse(plain).first("table")) == (["Column 1", "Column 2"], [["a", "b"], ["c", "b"], ["", "b"]])
    assert read_table(parse("<table></table>").first("table")) == ([], [])


def test_a_batch_that_failed_is_run_again(spark, tmp_path):
    from quarrystone.providers import HashingEmbedder
    from quarrystone.streaming.incremental import index_batch

    class Failing(HashingEmbedder):
        def embed(self, *a, **k):
            raise RuntimeError("quota")

    docs = spark.createDataFrame([(1, "one two"), (2, "three four"), (2, "three four")], "doc_id long, text string")
    root = str(tmp_path / "index")
    with pytest.raises(RuntimeError):
        index_batch(docs, root, Failing(8))
    for _ in range(2):
        index_batch(docs, root, HashingEmbedder(8))
    assert spark.read.parquet(f"{root}/chunks").count() == 2
    assert sorted(r.id for r in spark.read.parquet(f"{root}/chunk_vectors").collect()) == [1 << 24, 2 << 24]
