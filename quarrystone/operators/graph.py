"""Graph operators: hybrid neighbour graph, PageRank and core selection, skeleton merge, keyword graph.

All-pairs work is done in blocks: rows are split into blocks by hash, each pair of blocks is one task that holds two
blocks and keeps only the best k of each row, and the tasks' results are merged by row. Nothing is collected to the
driver and no task grows with the table.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.functions.text import casefold, keyword_tokens, lexical_terms
from quarrystone.operators.chunking import number_globally
from quarrystone.operators.vectors import mean_vectors, or_zero
from quarrystone.runtime import cut, prefix_offsets, stored

#: Rows of a block in all-pairs work.
BLOCK_ROWS = 4096
#: Rows that are put in order in one task when the core is chosen.
CORE_ROWS = 20_000
#: Terms on at most so many rows of a block are counted pair by pair, others as columns of a matrix.
SPARSE_ROWS = 24
#: Texts that share a term found on more texts than this are counted in pairs of blocks.
HEAVY_TEXTS = 200
#: Ranges over which words are put in order, and words sampled to find these.
RANGES = 64
RANGE_SAMPLE = 4096
#: Rows of a block where a task gives out all pairs of two blocks.
PAIR_ROWS = 1024


def block_top(left: DataFrame, right: DataFrame, payload: str, score: Callable, k: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(src, dst, score, rank): for each row of ``left`` the k best other rows of ``right`` by ``score``.

    ``score(a, b)`` gives the matrix of scores of two lists of payloads. Scores are rounded to six decimals; of equal
    ones the smaller id comes first. Both tables are (id, ``payload``).
    """
    n_left = max(1, math.ceil(left.count() / block_rows))
    n_right = max(1, math.ceil(right.count() / block_rows))
    of = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = left.select("id", payload, of(n_left).alias("i"), each(n_right).alias("j"))
    b = right.select(F.col("id").alias("id_b"), F.col(payload).alias("payload_b"), each(n_left).alias("i_b"), of(n_right).alias("j_b"))

    def best(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({"src": [], "near": [], "scores": []})
        y = y.sort_values("id_b", kind="stable")
        ids, own = y["id_b"].to_numpy(), x["id"].to_numpy()
        s = np.round(np.asarray(score(list(x[payload]), list(y["payload_b"])), dtype=np.float64), 6)
        s[own[:, None] == ids[None, :]] = -np.inf
        rows = []
        for r in range(len(own)):
            # a stable sort of the few rows that can be among the best keeps the smaller id first
            kept = min(k, len(ids))
            bar = np.partition(s[r], len(ids) - kept)[len(ids) - kept] if kept else np.inf
            may = np.flatnonzero((s[r] >= bar) & np.isfinite(s[r]))
            may = may[np.argsort(-s[r][may], kind="stable")][:kept]
            rows.append((own[r], ids[may], s[r][may]))
        return pd.DataFrame(rows, columns=["src", "near", "scores"])

    met = a.groupBy("i", "j").cogroup(b.groupBy("i_b", "j_b")).applyInPandas(best, "src long, near array<long>, scores array<double>")
    pairs = met.select("src", F.explode(F.arrays_zip("near", "scores")).alias("p")).select("src", F.col("p.near").alias("dst"), F.col("p.scores").alias("score"))
    order = Window.partitionBy("src").orderBy(F.desc("score"), "dst")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _common_terms(a: list, b: list) -> np.ndarray:
    """How many terms each pair of rows shares."""
    names: dict[str, int] = {}
    code = lambda rows: (np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.array([names.setdefault(t, len(names)) for r in rows for t in r], dtype=np.int64))
    ra, ta = code(a)
    rb, tb = code(b)
    out = np.zeros((len(a), len(b)), dtype=np.float32)
    if not len(ta) or not len(tb):
        return out
    na, nb = np.bincount(ta, minlength=len(names)), np.bincount(tb, minlength=len(names))
    heavy = (np.minimum(na, nb) > 0) & ((na > SPARSE_ROWS) | (nb > SPARSE_ROWS))
    light = (na > 0) & (nb > 0) & ~heavy
    columns = np.flatnonzero(heavy)
    for at in range(0, len(columns), 2048):
        place = np.full(len(names), -1)
        place[columns[at : at + 2048]] = np.arange(len(columns[at : at + 2048]))
        ma = np.zeros((len(a), len(columns[at : at + 2048])), dtype=np.float32)
        mb = np.zeros((len(b), ma.shape[1]), dtype=np.float32)
        ma[ra[place[ta] >= 0], place[ta[place[ta] >= 0]]] = 1
        mb[rb[place[tb] >= 0], place[tb[place[tb] >= 0]]] = 1
        out += ma @ mb.T
    pick_a, pick_b = light[ta], light[tb]
    left = pd.DataFrame({"t": ta[pick_a], "a": ra[pick_a]})
    met = left.merge(pd.DataFrame({"t": tb[pick_b], "b": rb[pick_b]}), on="t")
    flat = np.bincount(met["a"].to_numpy() * len(b) + met["b"].to_numpy(), minlength=out.size)
    return out + flat.reshape(out.shape)


def _dot(a: list, b: list) -> np.ndarray:
    return np.stack(a).astype(np.float64) @ np.stack(b).astype(np.float64).T


def lexical_neighbours(texts: DataFrame, k: int) -> DataFrame:
    """(src, dst, score, rank): the k other texts that share most distinct terms; texts that share none fill up by id."""
    terms = texts.select("id", F.coalesce(lexical_terms(F.col("text")), F.array().cast("array<string>")).alias("terms"))
    return block_top(terms, terms, "terms", _common_terms, k)


def semantic_neighbours(vectors: DataFrame, k: int, queries: DataFrame | None = None) -> DataFrame:
    """(src, dst, score, rank): the k other vectors of highest dot product; vectors should be normalised."""
    vectors = vectors.where("vec is not null")
    return block_top(vectors if queries is None else queries, vectors, "vec", _dot, k)


def cooccurrence(texts: DataFrame, at_most: int | None = None) -> DataFrame:
    """(a, b, common), a < b: all pairs of texts that share a term, with the number of terms they share.

    Pairs of which one text has only terms found on at most ``HEAVY_TEXTS`` texts are counted by the inverted-index
    join. Its size for terms on more texts would grow with the square of their number, so texts that hold such a term
    meet in pairs of blocks, where all their terms are counted at once; each pair of texts is counted in one of the two
    ways. The result itself may hold every pair of texts. ``at_most`` leaves out terms on more texts than that.
    """
    each = texts.select("id", F.explode(lexical_terms(F.col("text"))).alias("term"))
    counts = each.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    if at_most is not None:
        counts = counts.where(F.col("df") <= at_most)
    kept = stored(each.join(counts, "term"), "terms")
    rows = stored(kept.groupBy("id").agg(F.collect_list("term").alias("terms"), (F.max("df") > HEAVY_TEXTS).alias("heavy")), "rows")
    light = kept.where(F.col("df") <= HEAVY_TEXTS).select("id", "term").join(rows.select("id", "heavy"), "id")
    a, b = light.select("term", "id", "heavy").toDF("term", "a", "heavy_a"), light.select("term", "id", "heavy").toDF("term", "b", "heavy_b")
    met = a.join(b, "term").where("a < b and not (heavy_a and heavy_b)").groupBy("a", "b").agg(F.count(F.lit(1)).alias("common"))
    crowd = rows.where("heavy").select("id", "terms")
    n = math.ceil(crowd.count() / PAIR_ROWS)
    if n == 0:
        return met
    own = F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    left = crowd.select("id", "terms", own.alias("i")).withColumn("j", F.explode(F.sequence("i", F.lit(n - 1))))
    right = crowd.select(F.col("id").alias("id_b"), F.col("terms").alias("terms_b"), own.alias("j_b"))
    right = right.withColumn("i_b", F.explode(F.sequence(F.lit(0), "j_b")))

    def count(key: tuple, x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({"a": [], "b": [], "common": []})
        c = _common_terms(list(x["terms"]), list(y["terms_b"]))
        u, v = x["id"].to_numpy(), y["id_b"].to_numpy()
        if key[0] == key[1]:
            c[u[:, None] >= v[None, :]] = 0
        at, to = np.nonzero(c)
        return pd.DataFrame({"a": np.minimum(u[at], v[to]), "b": np.maximum(u[at], v[to]), "common": c[at, to].astype(np.int64)})

    dense = left.groupBy("i", "j").cogroup(right.groupBy("i_b", "j_b")).applyInPandas(count, "a long, b long, common long")
    return met.unionByName(dense)


def hybrid_knn(texts: DataFrame, vectors: DataFrame, k: int = 6) -> DataFrame:
    """(src, dst, channel, rank): for each text floor(k/2) lexical neighbours, then semantic ones that aren't among them.

    k is brought into 2 … n-1 (2 at least); fewer than two texts have no edges. No edge is doubled or leads to its own text.
    """
    n = texts.count()
    if n < 2:
        return texts.sparkSession.createDataFrame([], "src long, dst long, channel string, rank int")
    k = max(2, min(k, n - 1))
    lexical = stored(lexical_neighbours(texts, k // 2).select("src", "dst", "rank"), "lexical")
    # at most k // 2 of these are taken already
    semantic = semantic_neighbours(vectors, k).select("src", "dst", "score")
    fresh = semantic.join(lexical.select("src", "dst"), ["src", "dst"], "left_anti")
    order = Window.partitionBy("src").orderBy(F.desc("score"), "dst")
    fresh = fresh.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k - k // 2)
    edges = lexical.select("src", "dst", F.lit("lexical").alias("channel"), "rank")
    return edges.unionByName(fresh.select("src", "dst", F.lit("semantic").alias("channel"), (F.col("rank") + k // 2).alias("rank")))


def pagerank(nodes: DataFrame, edges: DataFrame, alpha: float = 0.85, tolerance: float = 1e-6, most: int = 100, rounds: int | None = None) -> DataFrame:
    """(id, pagerank) of a directed graph with isolated nodes; repeated edges count once, dangling weight is spread evenly.

    Stops when the change, summed over all nodes, is below ``tolerance`` times their number, or after ``rounds`` rounds
    exactly. Ranks are written in each round, so that a plan holds one round; what is lost at dangling nodes and the
    change are sums over the ranks written, taken together.
    """
    nodes = stored(nodes.select("id").distinct(), "nodes")
    n = nodes.count()
    if n == 0:
        return nodes.withColumn("pagerank", F.lit(0.0))
    links = edges.select(F.col("src").alias("id"), "dst").distinct().where("id is not null and dst is not null")
    links = links.join(nodes, "id", "left_semi").join(nodes.toDF("dst"), "dst", "left_semi")
    degree = links.groupBy("id").agg(F.count(F.lit(1)).cast("double").alias("degree"))
    links = stored(links.join(degree, "id").select("id", "dst", (1 / F.col("degree")).alias("share")), "links")
    # a node sends to others or is dangling
    start = nodes.join(degree, "id", "left").select("id", F.col("degree").isNull().alias("dangles"))
    ranks = cut(start.withColumns({"pagerank": F.lit(1.0 / n), "change": F.lit(0.0)}))
    lost = ranks.where("dangles").count() / n
    for _ in range(rounds or most):
        sent = links.join(ranks.select("id", "pagerank"), "id").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("pagerank") * F.col("share")).alias("got"))
        now = F.coalesce("got", F.lit(0.0)) * alpha + F.lit((alpha * lost + 1 - alpha) / n)
        fresh = ranks.join(sent, "id", "left").select("id", "dangles", now.alias("pagerank"), F.abs(now - F.col("pagerank")).alias("change"))
        ranks = cut(fresh)
        lost, change = ranks.agg(F.coalesce(F.sum(F.when(F.col("dangles"), F.col("pagerank"))), F.lit(0.0)), F.sum("change")).first()
        if rounds is None and change < tolerance * n:
            break
    return ranks.select("id", "pagerank")


def core_chunks(ranks: DataFrame, beta: float = 0.2) -> DataFrame:
    """(id, pagerank, core_no): the first ceil(beta · n), one at least, by rank; ties by id.

    The core grows with the graph, so it isn't taken by a limit, which would bring it together in one place: ranks are
    split at quantiles, and places are counted up over these.
    """
    ranks = ranks.select("id", "pagerank", F.round("pagerank", 12).alias("_r"))
    n = ranks.count()
    m = max(1, math.ceil(round(beta * n, 9)))
    parts = min(1000, n // CORE_ROWS)
    bounds = ranks.agg(F.percentile_approx("_r", [i / (parts + 1) for i in range(1, parts + 1)], 10_000)).first()[0] if parts else []
    above = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b > F.col("_r"))) if bounds else F.lit(0)
    staged = ranks.withColumns({"_all": F.lit(0), "_one": F.lit(1).cast("long"), "_part": above, "_desc": -F.col("_r")})
    placed = prefix_offsets(staged, "_all", ["_desc", "id"], "_one", "_part", "_place")
    return placed.where(F.col("_place") <= m).select("id", "pagerank", (F.col("_place") - 1).cast("int").alias("core_no"))


def mentions(extractions: DataFrame, core: DataFrame) -> DataFrame:
    """(seq, chunk_id, name, description): entity mentions in core order; seq = (core_no, place in the record)."""
    e = extractions.join(core.select(F.col("id").alias("chunk_id"), "core_no"), "chunk_id")
    each = e.select("chunk_id", "core_no", F.posexplode("entities").alias("at", "e"))
    return each.select(F.struct("core_no", "at").alias("seq"), "chunk_id", F.trim("e.name").alias("name"), F.trim("e.description").alias("description"))


def skeleton_entities(extractions: DataFrame, core: DataFrame) -> DataFrame:
    """``schemas.ENTITIES``: mentions merged by name without regard to case, in the order first seen.

    The first spelling names the entity; descriptions that aren't blank and the chunk of every mention are kept in
    order, repeats included. Blank names are skipped.
    """
    m = mentions(extractions, core).where(F.coalesce("name", F.lit("")) != "").withColumn("key", casefold(F.col("name")))
    said = F.array_sort(F.collect_list(F.struct("seq", "chunk_id", "description")))
    merged = m.groupBy("key").agg(F.min("seq").alias("first"), F.min_by("name", "seq").alias("name"), said.alias("all"))
    described = F.filter(F.transform("all", lambda x: x["description"]), lambda d: F.coalesce(d, F.lit("")) != "")
    merged = merged.select("key", "name", "first", described.alias("descriptions"), F.transform("all", lambda x: x["chunk_id"].cast("long")).alias("chunk_ids"))
    numbered = number_globally(merged.withColumn("_c", F.col("first.core_no")).withColumn("_a", F.col("first.at")), ["_c", "_a"], "entity_id")
    return numbered.select("entity_id", "key", "name", "descriptions", "chunk_ids")


def skeleton_relations(extractions: DataFrame, core: DataFrame) -> DataFrame:
    """``schemas.RELATIONS``: every relation of every core chunk, in core order; nothing is merged or checked."""
    e = extractions.join(core.select(F.col("id").alias("chunk_id"), "core_no"), "chunk_id")
    each = e.select("chunk_id", "core_no", F.posexplode("relations").alias("at", "r"))
    return number_globally(each, ["core_no", "at"], "relation_id").select("relation_id", "r.source", "r.target", "r.relation", "r.description", F.col("chunk_id").cast("long").alias("chunk_id"))


def keyword_vocabulary(texts: DataFrame, least: int = 2) -> DataFrame:
    """(keyword_id, keyword, df): keyword tokens of at least ``least`` texts, numbered by code points."""
    each = texts.select("id", F.explode(F.array_distinct(keyword_tokens(F.col("text")))).alias("keyword"))
    kept = each.groupBy("keyword").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= least)
    # places are counted over ranges with about as many words each, whatever letters they begin with
    kept = stored(kept, "keywords")
    some = kept.sample(min(1.0, RANGE_SAMPLE / max(1, kept.count())), 7).select("keyword").orderBy("keyword").limit(2 * RANGE_SAMPLE).collect()  # bounded sample
    bounds = [r[0] for r in some[:: max(1, len(some) // RANGES)]][1:]
    part = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]).cast("array<string>"), lambda b: b <= F.col("keyword"))) if bounds else F.lit(0)
    return number_globally(kept.withColumn("_first", part), ["_first", "keyword"], "keyword_id", 1).select("keyword_id", "keyword", "df")


def keyword_edges(texts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(keyword_id, subchunk_id): which texts hold which keyword. The vocabulary must not be empty."""
    each = texts.select(F.col("id").alias("subchunk_id"), F.explode(F.array_distinct(keyword_tokens(F.col("text")))).alias("keyword"))
    return each.join(vocabulary.select("keyword_id", "keyword"), "keyword").select("keyword_id", "subchunk_id")


def keyword_vectors(vocabulary: DataFrame, sentences: DataFrame, vectors: DataFrame, dims: int) -> DataFrame:
    """(keyword_id, keyword, vec): the normalised mean vector of the sentences that hold a keyword, or zeros."""
    members = keyword_edges(sentences, vocabulary).select("keyword_id", F.col("subchunk_id").alias("sentence_id"))
    means = mean_vectors(members, vectors, "keyword_id", "sentence_id", dims)
    return vocabulary.join(means, "keyword_id", "left").select("keyword_id", "keyword", or_zero(F.col("vec"), dims).alias("vec"))


def checked_vocabulary(vocabulary: DataFrame) -> DataFrame:
    if vocabulary.isEmpty():
        raise ValueError("no keyword is found in at least two subchunks")
    return vocabulary


