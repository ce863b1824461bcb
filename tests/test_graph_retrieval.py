import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrystone.operators import graph as G
from quarrystone.operators import retrieval as R
from quarrystone.operators import vectors as V
from quarrystone.schemas import ENTITIES, EXTRACTION, RELATIONS


def vecs(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "id long, vec array<double>")


def test_normalise_and_means(spark):
    df = vecs(spark, [(0, [3, 4]), (1, [0, 0]), (2, [1, 0])])
    assert [r[0] for r in df.orderBy("id").select(V.normalise(F.col("vec"))).collect()] == [[0.6, 0.8], [0, 0], [1, 0]]
    members = spark.createDataFrame([(1, 0), (1, 2), (2, 9)], "g long, m long")
    got = V.mean_vectors(members, df, "g", "m", 2).collect()
    assert len(got) == 1 and np.allclose(np.linalg.norm(got[0].vec), 1)


def test_top_k_breaks_ties_by_id(spark):
    df = spark.createDataFrame([(3, 0.5), (1, 0.5000001), (2, 0.9), (4, None)], "id long, score double")
    assert [r.id for r in V.top_k(df, 3).orderBy("rank").collect()] == [2, 1, 3]
    assert V.top_k(df, 0).count() == 0


def test_block_neighbours_equal_brute_force(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = vecs(spark, list(enumerate(x.tolist())))
    got = G.block_top(df, df, "vec", G._dot, 4, block_rows=17).orderBy("src", "rank").collect()
    s = np.round(x @ x.T, 6)
    np.fill_diagonal(s, -9)
    want = np.argsort(-s, axis=1, kind="stable")[:, :4]
    assert [[r.dst for r in got if r.src == i] for i in range(60)] == want.tolist()


def test_common_terms_equal_sets():
    rng = np.random.default_rng(1)
    rows = [[f"t{j}" for j in range(80) if rng.random() < (0.9 if j < 5 else 0.15)] for _ in range(70)] + [[]]
    got = G._common_terms(rows, rows[:40])
    assert np.array_equal(got, [[len(set(a) & set(b)) for b in rows[:40]] for a in rows])


def test_cooccurrence_counts_terms_on_many_texts(spark, monkeypatch):
    monkeypatch.setattr(G, "PAIR_ROWS", 64, raising=False)
    rng = np.random.default_rng(3)
    # "gearbox" is on 230 texts, others on a few; the last ten texts hold only rare terms
    held = [{f"rare{j}" for j in rng.integers(60, size=3)} | ({"gearbox"} if i < 230 else set()) for i in range(240)]
    texts = spark.createDataFrame([(i, " ".join(sorted(t))) for i, t in enumerate(held)] + [(240, None), (241, "")], "id long, text string")
    got = {(r.a, r.b): r.common for r in G.cooccurrence(texts).collect()}
    want = {(i, j): len(held[i] & held[j]) for i in range(240) for j in range(i + 1, 240) if held[i] & held[j]}
    assert got == want and G.cooccurrence(texts).count() == len(want)


def test_hybrid_graph(spark):
    texts = spark.createDataFrame([(0, "alpha beta"), (1, "beta gamma"), (2, "delta"), (3, "")], "id long, text string")
    v = vecs(spark, [(i, np.eye(4)[i]) for i in range(4)])
    edges = G.hybrid_knn(texts, v, 2).collect()
    assert sorted((e.src) for e in edges) == [0, 0, 1, 1, 2, 2, 3, 3]
    assert all(e.src != e.dst for e in edges) and len({(e.src, e.dst) for e in edges}) == 8
    assert {e.dst for e in edges if e.src == 0 and e.channel == "lexical"} == {1}
    assert {e.dst for e in edges if e.src == 2 and e.channel == "lexical"} == {0}  # nothing shared: the smallest id
    assert G.hybrid_knn(texts.limit(1), v, 2).count() == 0


def test_pagerank(spark):
    nodes = spark.createDataFrame([(i,) for i in range(5)], "id long")
    edges = spark.createDataFrame([(0, 1), (0, 1), (1, 2), (2, 0), (3, 0)], "src long, dst long")
    got = {r.id: r.pagerank for r in G.pagerank(nodes, edges).collect()}
    r = np.full(5, 0.2)
    for _ in range(200):
        new = np.full(5, 0.15 / 5 + 0.85 * r[4] / 5)
        for a, b in ((0, 1), (1, 2), (2, 0), (3, 0)):
            new[b] += 0.85 * r[a]
        r = new
    assert abs(sum(got.values()) - 1) < 1e-9
    assert all(abs(got[i] - r[i]) < 1e-4 for i in range(5))
    core = G.core_chunks(spark.createDataFrame([(i, 0.2) for i in range(5)], "id long, pagerank double"), 0.4).orderBy("core_no").collect()
    assert [c.id for c in core] == [0, 1]


def test_core_over_quantiles(spark, monkeypatch):
    monkeypatch.setattr(G, "CORE_ROWS", 7)
    rows = [(i, (i * 37 % 50) / 50) for i in range(60)]
    got = G.core_chunks(spark.createDataFrame(rows, "id long, pagerank double"), 0.5).orderBy("core_no").collect()
    want = [i for i, _ in sorted(rows, key=lambda r: (-round(r[1], 12), r[0]))[:30]]
    assert [c.id for c in got] == want and [c.core_no for c in got] == list(range(30))


def test_skeleton_merge(spark):
    rows = [
        (5, [("holmes ", "later"), ("", "x")], []),
        (2, [("Holmes", "first"), ("Watson", " ")], [("Holmes", "Watson", "friend", None)]),
    ]
    df = spark.createDataFrame(rows, EXTRACTION)
    core = spark.createDataFrame([(2, 0.5, 0), (5, 0.5, 1)], "id long, pagerank double, core_no int")
    got = {e.key: e for e in G.skeleton_entities(df, core).collect()}
    assert got["holmes"].name == "Holmes" and got["holmes"].chunk_ids == [2, 5] and got["holmes"].descriptions == ["first", "later"]
    assert got["watson"].descriptions == [] and {e.entity_id for e in got.values()} == {0, 1}
    rel = G.skeleton_relations(df, core).collect()
    assert [(r.relation_id, r.chunk_id, r.relation) for r in rel] == [(0, 2, "friend")]


def test_keywords(spark):
    texts = spark.createDataFrame([(0, "common Holmes the"), (1, "Common evidence holmes"), (2, "evidence Watson"), (3, "watson singular the")], "id long, text string")
    vocab = G.keyword_vocabulary(texts)
    assert [r.keyword for r in vocab.orderBy("keyword_id").collect()] == ["common", "evidence", "holmes", "watson"]
    edges = G.keyword_edges(texts, vocab).join(vocab, "keyword_id").where("keyword = 'holmes'").collect()
    assert sorted(e.subchunk_id for e in edges) == [0, 1]
    kv = {r.keyword: r.vec for r in G.keyword_vectors(vocab, texts.where("id < 2"), vecs(spark, [(0, [1, 0]), (1, [0, 1])]), 2).collect()}
    assert np.isclose(np.linalg.norm(kv["holmes"]), 1) and kv["watson"] == [0.0, 0.0]
    with pytest.raises(ValueError):
        G.checked_vocabulary(vocab.limit(0))


def store(spark):
    n = 11
    names = [f"E{i}" for i in range(n)]
    entities = spark.createDataFrame([(i, x.lower(), x, [], [0 if i < 10 else 1]) for i, x in enumerate(names)], ENTITIES)
    relations = spark.createDataFrame([(0, "E0", "e1", "r", None, 1), (1, "E2", "other", "r", None, 1), (2, "no", "no", "r", None, 0)], RELATIONS)
    subchunks = spark.createDataFrame([(i, i // 2, f"s{i}", None, "src", None, None, None, None, None) for i in range(6)], "id long, parent_id long, text string, source_text string, source_name string, source_url string, page int, table_id string, row_start int, row_end int")
    return {
        "entities": entities, "entity_vectors": vecs(spark, [(i, [1 - i * 0.05, i * 0.05]) for i in range(n)]), "relations": relations,
        "relation_vectors": vecs(spark, [(0, [1, 0]), (1, [0, 1]), (2, [1, 0])]), "subchunks": subchunks,
        "subchunk_vectors": vecs(spark, [(i, [i, 6 - i]) for i in range(6)]),
        "keywords": spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "keyword_id long, vec array<double>"),
        "keyword_edges": spark.createDataFrame([(0, 4), (0, 5), (1, 0), (1, 3)], "keyword_id long, subchunk_id long"),
        "chunk_vectors": vecs(spark, [(0, [1, 0]), (1, [0.9, 0.1]), (2, [0, 1])]), "edges": spark.createDataFrame([(0, 2), (1, 0)], "src long, dst long"),
    }


def test_relation_scores(spark):
    s = store(spark)
    seeds = R.entity_seeds(s["entity_vectors"], [1.0, 0.0])
    assert seeds.count() == 10
    got = R.relation_ranking(s["relations"], s["relation_vectors"], s["entities"], seeds, [1.0, 0.0], 6).orderBy("rank").collect()
    assert [(r.relation_id, r.matched) for r in got] == [(0, 2), (1, 1)]
    with pytest.raises(Exception, match="no vector"):
        R.relation_ranking(s["relations"], s["relation_vectors"].where("id > 0"), s["entities"], seeds, [1.0, 0.0], 6).collect()


def test_two_channels(spark):
    s = store(spark)
    ranked, skeleton = R.two_channel(s, [1.0, 0.0], 4, 0.5)
    rows = ranked.orderBy("rank").collect()
    # chunk 0 has ten seeds, so its subchunks lead although others are nearer
    assert [(r.id, r.channel) for r in rows] == [(1, "skeleton"), (0, "skeleton"), (5, "keyword"), (4, "keyword")]
    said = R.two_channel_context(ranked, skeleton, s["subchunks"]).first()[0]
    assert said.startswith("Graph facts:\n- E0 --[r]--> e1") and "[chunk 0, subchunk 1, source src]" in said
    d = R.diagnostics(ranked, skeleton, s["subchunks"]).first()
    assert d.skeleton_ids == [1, 0] and len(d.seeds) == 10 and len(d.facts) == 2
    only, _ = R.two_channel(s, [1.0, 0.0], 2, 1.0)
    assert {r.channel for r in only.collect()} == {"skeleton"}


@pytest.mark.parametrize("k, theta, want", [(5, 0.5, (2, 3)), (3, 0.5, (2, 1)), (6, 0.4, (2, 4)), (4, 2.0, (4, 0))])
def test_budgets(k, theta, want):
    assert R.budgets(k, theta) == want


def test_text_and_graph_retrieval(spark):
    s = store(spark)
    assert [r.id for r in R.text_retrieve(s["chunk_vectors"], [1.0, 0.0], 2).orderBy("rank").collect()] == [0, 1]
    got = [r.id for r in R.knn_retrieve(s["chunk_vectors"], s["edges"], [1.0, 0.0], 2).orderBy("rank").collect()]
    assert got == [0, 2]  # one seed and its hop
    assert {r.strategy for r in R.compare(s, [1.0, 0.0], 2).collect()} == {"text", "graph", "two_channel"}
