import base64
import random
import re
from collections import Counter

import pytest

from quarrystone.llm import pieces, terms, tokens

tiktoken = pytest.importorskip("tiktoken")
WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")


@pytest.fixture(scope="module")
def whole():
    try:
        with open(tokens.VOCABULARY, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    except FileNotFoundError:
        pytest.skip("no vocabulary here")
    return tiktoken.Encoding("whole", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_fragments_encode_like_whole_texts(spark, whole):
    rnd = random.Random(3)
    letters = "ab e's''ll \n\t 　​中文字ไทยहिन्दी123.,!?-_é🙂🇩🇪\0<|endoftext|>"
    texts = ["", None, "x" * 30_000, " " * 999, "don't I'LL  we've!'s"] + ["".join(rnd.choice(letters) for _ in range(rnd.randrange(60))) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in tokens.encode(df, ["doc_id"]).collect()}
    for i, t in enumerate(texts):
        assert got[i].ids == whole.encode_ordinary(t or ""), repr(t)
        assert got[i].n_tokens == len(got[i].ids)
        assert whole.decode(got[i].ids) == (t or "")


def test_encoding_keeps_rows_and_columns(spark, whole):
    df = spark.createDataFrame([(None, "a", 7), (1, "a", 7), (1, "a", 7)], "doc_id long, text string, ids int")
    rows = tokens.encode(df, ["doc_id"]).collect()
    assert len(rows) == 3 and all(r.ids == rows[0].ids for r in rows)
    assert tokens.encode(df.limit(0), ["doc_id"]).count() == 0
    assert tokens.encode(df, ["doc_id"], ids=False).columns == ["doc_id", "n_tokens"]


def test_term_frequencies(spark):
    rows = [(1, "Straße STRASSE don’t a_b"), (1, "Straße STRASSE don’t a_b"), (2, None), (3, ""), (4, "strasse x"), (None, "x"), (None, "x"), (None, "y")]
    df = spark.createDataFrame(rows, "id long, text string").selectExpr("*", "1 term", "2 n")
    got = {r.term: (r.n_total, r.n_records, r.mark) for r in terms.term_frequencies(df, "id", "text", common_share=0.3).collect()}
    # records with text: 1, 3, 4, and two without a key
    assert got == {
        "strasse": (3, 2, "common"), "don’t": (1, 1, "rare"), "a": (1, 1, "rare"), "b": (1, 1, "rare"), "x": (2, 2, "common"), "y": (1, 1, "rare"),
    }
    assert terms.term_frequencies(df.limit(0), "id", "text").count() == 0


def test_a_term_in_every_record(spark):
    df = spark.range(500).selectExpr("id", "concat('the w', id) text")
    got = {r.term: r.mark for r in terms.term_frequencies(df, "id", "text").collect()}
    assert Counter(got.values()) == {"rare": 500, "common": 1} and got["the"] == "common"


def fresh_words(parts, overlap):
    words = [WORD.findall(p) for p in parts]
    out = list(words[0])
    for a, b in zip(words, words[1:]):
        assert a[-overlap:] == b[: len(a[-overlap:])] if overlap else True
        out += b[overlap:]
    return out


@pytest.mark.parametrize("limit, overlap", [(450, 60), (20, 5), (20, 0)])
def test_pieces_cover_their_text(spark, limit, overlap):
    rnd = random.Random(5)
    texts = ["", None, "short text.", "... --- ...", "w " * limit, "w " * (limit + 1), "x" * 9000 + " y"]
    for _ in range(12):
        ends = rnd.choice([[" "], [" ", ". ", ", "], [" ", ".\n\n", "! "], ["。", "，", " "]])
        texts.append("".join(f"{rnd.choice(['word', 'it’s', 'Größe', 'a'])}{n}{rnd.choice(ends)}" for n in range(rnd.randrange(limit, 6 * limit))))
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").selectExpr("*", "'x' piece", "0 piece_no")
    rows = pieces.split_long(df, ["id"], "text", limit, overlap).orderBy("id", "piece_no").collect()
    for i, t in enumerate(texts):
        mine = [r for r in rows if r.id == i]
        n = len(WORD.findall(t or ""))
        assert bool(mine) == (n > limit), (i, n)
        if mine:
            assert fresh_words([r.piece for r in mine], overlap) == WORD.findall(t)
            assert all(r.n_words == len(WORD.findall(r.piece)) <= limit and r.n_pieces == len(mine) for r in mine)


def test_pieces_end_at_the_strongest_boundary(spark):
    sentence = "one two three four five six seven eight nine. "
    df = spark.createDataFrame([(1, sentence * 5), (2, "one two three four five six seven eight,\n\nnine " * 5)], "id long, text string")
    rows = pieces.split_long(df, ["id"], "text", 20, 4).orderBy("id", "piece_no").collect()
    assert all(r.piece.endswith(".") for r in rows if r.id == 1)
    assert all(r.piece.endswith("eight,") for r in rows if r.id == 2 and r.piece_no + 1 < r.n_pieces)
    with pytest.raises(ValueError):
        pieces.split_long(df, ["id"], "text", 10, 8)
