import time

import numpy as np
import pytest

from quarrystone.llm import names as M
from quarrystone.llm import neighbours as N


def brute(ids, x, k=5):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(x @ x.T, 6)
    np.fill_diagonal(s, -9)
    order = np.argsort(-s, axis=1, kind="stable")[:, :k]
    return {int(i): [int(ids[j]) for j in row] for i, row in zip(ids, order)}


def table(spark, ids, x):
    return spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in zip(ids, x)], "id long, vec array<float>")


def test_recall_and_order(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16))
    x = (centres[rng.integers(40, size=1500)] + 0.5 * rng.normal(size=(1500, 16))).astype(np.float32)
    ids = np.arange(1500) * 3
    got = {}
    for r in N.similar(table(spark, ids, x), probes=20).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append(r.neighbour)
    want = brute(ids, x.astype(float))
    hits = sum(len(set(got[i]) & set(want[i])) for i in want)
    assert hits / (5 * len(want)) >= 0.9 and all(len(v) == 5 for v in got.values())


def test_copies_ties_and_rows_that_take_no_part(spark):
    rows = [(i, [1.0, 0.0]) for i in (9, 3, 5, 7, 1, 2, 8)] + [(3, [1.0, 0.0]), (20, [0.0, 1.0]), (21, [0.0, 2.0]), (30, None), (31, [0.0, 0.0]), (32, []), (33, [float("nan"), 1.0]), (34, [None, 1.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "id long, vec array<float>").selectExpr("*", "1 v", "2 n")
    got = {}
    for r in N.similar(df).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append(r.neighbour)
    assert got[9] == [1, 2, 3, 5, 7] and got[1] == [2, 3, 5, 7, 8]
    assert got[20] == [21, 1, 2, 3, 5] and set(got) == {1, 2, 3, 5, 7, 8, 9, 20, 21}
    pairs = {tuple(r) for r in N.similar_pairs(N.similar(df)).collect()}
    assert all(a < b for a, b in pairs) and (20, 21) in pairs
    assert N.similar(df.where("id = 20")).count() == 0 and N.similar(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="lengths"):
        N.similar(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "id long, vec array<float>")).count()


def test_crowded_shards_are_split(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK_ROWS", 50)
    rng = np.random.default_rng(4)
    x = np.concatenate([np.ones((150, 8)) + 1e-2 * rng.normal(size=(150, 8)), rng.normal(size=(150, 8))]).astype(np.float32)
    got = {}
    for r in N.similar(table(spark, range(300), x)).collect():
        got.setdefault(r.id, set()).add(r.neighbour)
    want = brute(np.arange(300), x.astype(float))
    assert sum(len(got[i] & set(want[i])) for i in want) / 1500 >= 0.95


def test_a_crowd_of_scaled_and_nearly_equal_copies(spark):
    rng = np.random.default_rng(5)
    crowd = rng.normal(size=16) * rng.uniform(0.1, 9, size=(3000, 1)) * (1 + 1e-6 * rng.normal(size=(3000, 16)))
    x = np.concatenate([crowd, rng.normal(size=(3000, 16))]).astype(np.float32)
    ids = rng.permutation(6000)
    got = {}
    for r in N.similar(table(spark, ids, x)).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append(r.neighbour)
    first = sorted(ids[:3000].tolist())[:6]
    assert all(got[i] == [j for j in first if j != i][:5] for i in ids[:3000].tolist())


PERSON = ["José Vagemuleau", "Dr. José Vagemuleau", "VAGEMULEAU, José", "Vagemuleau José", "Pepe Vagemuleau", "Jose B. Vagemuleau", "J. Vagemuleau", "José Vagemluleau"]
RELATIVE = ["Margaret Vagemuleau", "Peggy Vagemuleau"]
FIRM = ["Kudinumeau Energy Systems Ltd.", "Kudinumeau Energy Systems, Limited", "Kudinumeau-Energy Sys. Ltd", "KUDINUMEAU ENERGY SYSTEMS LTD.", "Kudinumeau ES Ltd.", "Energy Systems Kudinumeau Ltd.", "Kudinumeauenergy systems Ltd.", "K. Energy Systems (Kudinumeau)", "The Kudinumeau Energy Systems Company"]
SISTER = ["Kudinumeau Motors Ltd.", "Kudinumeau Mtrs"]
MODEL = ["Kasutonquist 3", "Kasutonquist-3", "KASUTONQUIST 3"]
NEXT = ["Kasutonquist 4"]


def test_variants_are_linked_and_others_are_not(spark):
    groups = [PERSON, RELATIVE, FIRM, SISTER, MODEL, NEXT, [""], ["Ω"]]
    every = [n for g in groups for n in g]
    a = spark.createDataFrame([(n,) for n in every[::2] * 3 + [None]], "x string")
    b = spark.createDataFrame([(n,) for n in every[1::2]], "y string")
    linked = M.link_names([a, b])
    assert linked.count() == len(every)
    got = {tuple(r) for r in M.name_pairs(linked).collect()}
    want = {(min(p, q), max(p, q)) for g in groups for p in g for q in g if p != q}
    assert got == want
    assert M.name_pairs(M.link_names([a.limit(0), b.limit(0)])).count() == 0


def test_variants_in_different_blocks_are_linked(spark):
    groups = [
        ["Acme Robotics GmbH", "Acme Robotics", "Acme Robotcs GmbH"], ["Acme GmbH", "Acme"], ["Zarko Petrulevic", "Xarko Petrulevic", "Xarko Petruleivc", "Petrulevic Zarko"],
        ["Kudinumeau 3 GmbH", "Kudinumeau 3"], ["Kudinumeau 4"], ["Kudinumeau"], ["Mirko Petrulevic"], ["X. Petrulevich"],
    ]
    linked = M.link_names([spark.createDataFrame([(n,) for g in groups for n in g], "x string")])
    got = {tuple(r) for r in M.name_pairs(linked).collect()}
    assert got == {(min(p, q), max(p, q)) for g in groups for p in g for q in g if p != q}


def test_a_group_of_many_spellings_meets_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 3)
    rows = [(f"n{i}", 1, "x", 5) for i in range(11)] + [("alone", 1, "x", 6)]
    got = {tuple(r) for r in M.name_pairs(spark.createDataFrame(rows, "name string, n int, kind string, group long")).collect()}
    assert len(got) == 55 and all(a < b for a, b in got)


def test_no_link_is_lost_by_the_prefix_join(spark):
    rng = np.random.default_rng(0)
    syllables = ["ka", "lo", "mi", "ru", "te", "zo"]
    cores = sorted({"".join(rng.choice(syllables, 5)) for _ in range(150)})
    cores += ["".join((c[:4], c[5], c[4], c[6:])) for c in cores[:40]]
    cores = sorted(set(cores))
    rows = [(i, "product", c, "1", sorted({f"^{c}$"[j : j + n] for n in (2, 3) for j in range(len(c) + 3 - n)})) for i, c in enumerate(cores)]
    keys = spark.createDataFrame(rows, "key long, kind string, core string, second string, grams array<string>")
    got = {(r.a, r.b) for r in M.similar_keys(keys).collect()}
    n = len(rows)
    import math
    from collections import Counter

    df = Counter(g for r in rows for g in r[4])
    v = [{g: math.log(1.5 + n / df[g]) for g in r[4]} for r in rows]
    norm = [math.sqrt(sum(x * x for x in y.values())) for y in v]
    cos = lambda i, j: sum(x * v[j].get(g, 0) for g, x in v[i].items()) / norm[i] / norm[j]
    want = {(i, j) for i in range(n) for j in range(i + 1, n) if M.core_similarity(cores[i], cores[j]) > 0 and cos(i, j) >= M.COSINE}
    # forms find some more: pairs within one edit whose cosine is lower
    assert want <= got and all(M.core_similarity(cores[i], cores[j]) > 0 for i, j in got)


def test_short_forms_outside_the_lexicon_and_short_surnames(spark):
    groups = [
        ["Sam Bronowitch", "Samuel Bronowitch"], ["Andy Millerson", "Andrew Millerson"], ["Danny Weissmann", "Daniel Weissmann"], ["Acme Pharmaceuticals", "Acme Pharma"],
        ["Thomas Berger", "Tom Berger"], ["Tom Bergen"], ["Maria Lindqvist"], ["Petra Lindqvist"], ["Rob Bavuganren", "Robert Bavuganren"],
    ]
    names = spark.createDataFrame([(n,) for g in groups for n in g], "x string")
    found = lambda **k: {tuple(r) for r in M.name_pairs(M.link_names([names], **k)).collect()}
    want = {(min(p, q), max(p, q)) for g in groups for p in g for q in g if p != q}
    assert found() == want
    # without a lexicon only what rules and n-grams give
    bare = found(lexicon=M.Lexicon({}, {}, set()))
    assert {("Sam Bronowitch", "Samuel Bronowitch"), ("Andrew Millerson", "Andy Millerson")} <= bare <= want | bare and ("Tom Bergen", "Tom Berger") not in bare


@pytest.mark.parametrize("a, b, d", [("abc", "abc", 0), ("abc", "acb", 1), ("abc", "ab", 1), ("abcd", "wxyz", 3), ("", "a", 1)])
def test_distance(a, b, d):
    assert M.distance(a, b, 2) == d


def shuffle_bytes(spark):
    """Bytes of the session's shuffle files."""
    every = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    files = [every.apply(i) for i in range(every.size())]
    return sum(f.length() for f in files if f.getName().startswith("shuffle_"))


def test_shuffles_of_the_comparison_do_not_pile_up(spark):
    rng = np.random.default_rng(3)
    syllables = ["ka", "lo", "mi", "ru", "te", "zo", "ba", "ne"]
    names = [(f"{first} {''.join(rng.choice(syllables, 5)).title()}",) for first in ("Thomas", "Tom", "T.", "Zarko") for _ in range(300)]
    spark._jvm.System.gc()
    time.sleep(1)
    before = shuffle_bytes(spark)
    linked = M.link_names([spark.createDataFrame(names, "x string")])
    for _ in range(50):
        # all of them are deleted with the step that made them, in the background
        if shuffle_bytes(spark) <= before:
            break
        time.sleep(0.2)
    assert shuffle_bytes(spark) <= before
    assert linked.count() == len(set(names))


def test_rounds_of_forms_find_every_pair(spark, monkeypatch):
    rng = np.random.default_rng(7)
    letters = list("abcdefgh")

    def edited(s, n):
        for _ in range(n):
            i, kind = int(rng.integers(len(s) - 1)), int(rng.integers(4))
            s = (s[:i] + "x" + s[i + 1 :], s[:i] + s[i + 1 :], s[:i] + "y" + s[i:], s[:i] + s[i + 1] + s[i] + s[i + 2 :])[kind]
        return s

    cores = {"".join(rng.choice(letters, n)) for n in [*range(5, 32), 40, 60, 90]}
    cores |= {edited(c, n) for c in sorted(cores) for n in (1, 1, 2, 2)} | {"phillippowitschkky", "filipovitschci", "", "a"}
    readings = [("product", c, "1") for c in sorted(cores)]
    want = {(i, j) for i, x in enumerate(readings) for j, y in enumerate(readings[:i]) if M.core_similarity(x[1], y[1]) > 0 and abs(len(x[1]) - len(y[1])) <= M.LENGTHS}
    rows, h = M.block_forms(readings, [M.by_ear(r[1]) for r in readings], [["product|1"]] * len(readings))
    forms = [set(h[rows == i].tolist()) for i in range(len(readings))]
    assert len(want) > 60 and all(forms[i] & forms[j] for i, j in want)
    keys = spark.createDataFrame([(i, *r) for i, r in enumerate(readings)], "key long, kind string, core string, second string")
    found = lambda tables: {(r.a, r.b) for t in tables for r in t.collect()}
    whole = M.met_keys(keys)
    monkeypatch.setattr(M, "FEW", 1)
    monkeypatch.setattr(M, "AT_ONCE", 30)
    parts = M.met_keys(keys)
    assert len(whole) == 1 and len(parts) >= 3
    assert found(parts) == found(whole) >= {(j, i) for i, j in want}
