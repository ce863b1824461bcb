import unicodedata

import pytest
from pyspark.sql import functions as F

from quarrystone.llm import boilerplate as B
from quarrystone.llm import lookalike as L

BLOCKS = "doc_id long, pos long, type string, text string, source_url string, heading_path array<string>, canonical string, field string"


def blocks(spark, rows):
    return spark.createDataFrame([(d, p, "paragraph", t, "https://x.example/1", h, None, None) for d, p, t, h in rows], BLOCKS)


SAME = ["Café file ΟΚ", "Café file OK", "Ｃａｆé ﬁle OK", "Caf​é file　OK", "Cаfé file ОК"]
OTHER = ["cafe file OK", "Cafe file OK", "Café  file OK", "Café file OK²", "Café file OK2", "Café, file OK", "Café file OK…"]


def test_equal_looking_texts_come_out_equal(spark):
    rows = [(i, 0, t, [t, "x"]) for i, t in enumerate(SAME + OTHER)] + [(90, 0, None, None), (91, 0, "", []), (92, 0, "​", [""]), (93, 0, "Å", None), (94, 0, "Å", None)]
    got = {r.doc_id: r for r in L.consistent(blocks(spark, rows), ["doc_id", "pos"]).collect()}
    assert len({got[i].text for i in range(5)}) == 1 and len({tuple(got[i].heading_path) for i in range(5)}) == 1
    others = [got[i].text for i in range(5, 12)]
    assert len(set(others) | {got[0].text}) == 8
    assert got[90].text is None and got[90].heading_path is None and got[91].heading_path == [] and got[92].heading_path == [""]
    assert got[91].text == got[92].text and got[93].text == got[94].text
    assert unicodedata.is_normalized("NFC", got[0].text)


def test_pairs(spark):
    rows = [(1, 0, "Café", ["H"]), (1, 1, "Café", ["Н"]), (1, 1, "Café", ["Н"]), (2, 0, "Café", ["Н"]), (2, 5, "Cafe", None), (3, 0, None, ["H", "x"]), (None, 1, "Café", ["H"])]
    got = {tuple(r) for r in L.lookalike_blocks(blocks(spark, rows)).collect()}
    assert got == {("text", 1, 0, 1, 1), ("text", 1, 1, 2, 0), ("heading_path", 1, 0, 1, 1)}
    assert L.lookalike_blocks(blocks(spark, []).limit(0)).count() == 0


def test_a_spelling_of_many_rows_meets_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(L, "BLOCK_ROWS", 7)
    rows = [(i, 0, "Same text", []) for i in range(40)] + [(100 + i, 0, "Ѕame text", []) for i in range(10)]
    got = L.lookalike_blocks(blocks(spark, rows)).collect()
    assert len(got) == 400 and len({tuple(r) for r in got}) == 400


def test_every_mapped_character_maps_to_a_fixed_point():
    table = L.character_map()
    assert all(table.get(v, v) == v for v in table.values() if v)


NAV = ["Home", "Models", "Contact us now"]


def pages(spark, n=12):
    web, own = [], []
    for i in range(n):
        a, b, c = (chr(97 + i) * n for n in (4, 5, 6))  # words no other page has
        body = [f"Engine {a}", f"The {b} starts in the cold and {c} runs all day.", f"- bolt {a}, A1", f"- nut {b}, B2", "Code = 1; Price = 2.", f"It ends with {c} remarks."]
        lines = [*NAV, "© 2020 Acme", *body, f"{i} people are looking", f"Related: Wheel {chr(65 + i)}", f"Seat {chr(75 + i)}", "Imprint | Privacy | Terms | Sitemap"]
        web.append((i, f"https://www.acme.example/{i}", None, f"Engine {a} | Acme", "\n".join(lines), "2024-01-01"))
        kinds = ["paragraph"] * 4 + ["heading", "paragraph"]
        own += [(i, p, k, t, "https://www.acme.example/1", [], None, None) for p, (k, t) in enumerate(zip(kinds, lines[:6]))]
        own += [(i, 6, "list", "\n".join(body[2:4]), "https://www.acme.example/1", [], None, None), (i, 7, "table", None, "https://www.acme.example/1", [], None, None)]
        own += [(i, 8 + j, "paragraph", t, "https://www.acme.example/1", [], None, None) for j, t in enumerate(lines[9:])]
    web += [(0, None, None, None, "old", "2020-01-01"), (500, "https://one.example/", None, None, None, None), (None, "u", None, None, "x", None)]
    return (
        spark.createDataFrame(web, "doc_id long, requested_url string, final_url string, title string, text string, loaded_at string").selectExpr("*", "'x' host"),
        spark.createDataFrame(own, BLOCKS),
    )


def test_templates_go_and_bodies_stay(spark):
    web, own = pages(spark)
    got = {(r.place, r.doc_id, r.item_no): r.is_boilerplate for r in B.label_pages(web, own).collect()}
    for i in range(12):
        assert [n for n in range(14) if not got["line", i, n]] == [4, 5, 6, 7, 8, 9], i
        assert [n for n in range(13) if not got["block", i, n]] == [4, 5, 6, 7, 8], i
    text = {r.doc_id: r.text for r in B.main_text(web, own).collect()}
    assert text[3].split("\n")[0] == "Engine dddd" and text[3].endswith("dddddd remarks.") and text[500] is None


def test_a_long_notice_on_every_page_goes(spark):
    web, own = pages(spark)
    notice = "We and our partners store cookies on your device and read them to measure how our pages are used. " * 5
    # in the body, where only the count can tell it, and a long line of one page
    web = web.withColumn("text", F.replace("text", F.lit("\n- bolt"), F.concat(F.lit("\n" + notice + "\n"), F.repeat(F.concat("doc_id", F.lit(" Only here it says so. ")), F.lit(20)), F.lit("\n- bolt"))))
    web = web.withColumn("text", F.translate("text", "0123456789", "zyxwvutsrq"))
    got = {(r.doc_id, r.item_no): r.is_boilerplate for r in B.label_pages(web, own.limit(0)).where("place = 'line'").collect()}
    assert all(got[i, 6] for i in range(12)) and not any(got[i, n] for i in range(12) for n in (4, 5, 7, 8, 9))


def test_empty_tables(spark):
    web, own = pages(spark, 1)
    assert B.label_pages(web.limit(0), own.limit(0)).count() == 0


@pytest.mark.parametrize("url, want", [("https://User@WWW.a.example:80/x?y", "www.a.example"), ("no url", ""), (None, None)])
def test_hosts(spark, url, want):
    assert spark.createDataFrame([(url,)], "u string").select(B.host(F.col("u"))).first()[0] == want




def test_classes_differ_in_marks_beyond_the_composed_ones(spark):
    pairs = [(chr(0x1ED) + "x 1", unicodedata.normalize("NFD", chr(0x1ED)) + "x 1"), ("a≠b", "a≠b"), ("\U0001d400bc 2", "Abc 2"), ("ᏢᎪᏟ 3", "PAC 3"), ("한 4", "한 4")]
    apart = ["ǫx 1", "a=b", "Abc  2", "pac 3", "m² 5", "m2 5"]
    rows = [(i, 0, t, None) for i, t in enumerate([t for p in pairs for t in p] + apart)]
    found = L.lookalike_blocks(spark.createDataFrame(rows, "doc_id long, pos long, text string, heading_path array<string>")).collect()
    assert sorted((r.doc_id_a, r.doc_id_b) for r in found) == [(0, 1), (2, 3), (4, 5), (6, 7), (8, 9)]
