"""The three retrieval strategies: global vector top k, graph expansion, and skeleton plus keyword channels."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.functions.render import context, relation_text
from quarrystone.functions.text import casefold
from quarrystone.operators.vectors import ranked_by_query, rounded, scored, top_k
from quarrystone.runtime import stored

ENTITY_SEEDS = 10


def _scored(vectors: DataFrame, query: list[float], key: str = "id") -> DataFrame:
    named = vectors if key == "id" else vectors.withColumnRenamed(key, "id")
    return scored(named, query).withColumn("score", rounded(F.col("score")))


def text_retrieve(chunk_vectors: DataFrame, query: list[float], k: int = 6) -> DataFrame:
    """(id, score, rank): the k chunks nearest to the question."""
    return ranked_by_query(chunk_vectors, query, k)


def knn_retrieve(chunk_vectors: DataFrame, edges: DataFrame, query: list[float], k: int = 6, direction: str = "out") -> DataFrame:
    """(id, score, rank): half of k as seeds, one hop along the edges (out, in, both or mutual), ranked anew."""
    seeds = max(1, min(k, math.ceil(k / 2)))
    start = ranked_by_query(chunk_vectors, query, seeds).select("id")
    out = edges.select("src", "dst")
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    hops = {"out": out, "in": back, "both": out.union(back), "mutual": out.join(back, ["src", "dst"], "left_semi")}[direction]
    # the few seeds are the broadcast side
    near = hops.join(F.broadcast(start.withColumnRenamed("id", "src")), "src").select(F.col("dst").alias("id"))
    candidates = start.union(near).distinct()
    found = chunk_vectors.join(candidates, "id", "left_semi")
    return top_k(_scored(found, query), k)


def budgets(k: int, theta: float) -> tuple[int, int]:
    """Skeleton and keyword budget; halves round to even, what the skeleton leaves isn't handed over."""
    skeleton = min(k, max(0, round(theta * k)))
    return skeleton, k - skeleton


@dataclass
class Skeleton:
    """What the skeleton channel found: subchunks (id, adjacency, score, rank), seeds, and facts with their scores."""

    subchunks: DataFrame
    seeds: DataFrame
    facts: DataFrame


def entity_seeds(entity_vectors: DataFrame, query: list[float], n: int = ENTITY_SEEDS) -> DataFrame:
    return ranked_by_query(entity_vectors, query, n)


def seed_adjacency(entities: DataFrame, seeds: DataFrame) -> DataFrame:
    """(chunk_id, n): +1 for each seed and distinct chunk it is mentioned in."""
    own = entities.join(F.broadcast(seeds.select(F.col("id").alias("entity_id"))), "entity_id")
    return own.select(F.explode(F.array_distinct("chunk_ids")).alias("chunk_id")).groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n"))


def relation_ranking(relations: DataFrame, relation_vectors: DataFrame, entities: DataFrame, seeds: DataFrame, query: list[float], limit: int) -> DataFrame:
    """(relation_id, …, matched, score, rank): relations with a seed at one end (1) or both (2), then by similarity.

    A relation without a vector is an error.
    """
    keys = entities.join(F.broadcast(seeds.select(F.col("id").alias("entity_id"))), "entity_id").select("key").distinct()
    a, b = F.broadcast(keys.toDF("_a")), F.broadcast(keys.toDF("_b"))
    met = relations.join(a, casefold(F.col("source")) == F.col("_a"), "left").join(b, casefold(F.col("target")) == F.col("_b"), "left")
    matched = F.col("_a").isNotNull().cast("int") + F.col("_b").isNotNull().cast("int")
    met = met.withColumn("matched", matched).where("matched > 0").drop("_a", "_b")
    scores = _scored(relation_vectors, query).toDF("relation_id", "score")
    met = met.join(scores, "relation_id", "left")
    sure = F.when(F.col("score").isNull(), F.raise_error(F.lit("a relation has no vector")).cast("double")).otherwise(F.col("score"))
    order = (F.desc("matched"), F.desc("score"), "relation_id")
    best = met.withColumn("score", sure).orderBy(*order).limit(limit)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def skeleton_channel(entities: DataFrame, entity_vectors: DataFrame, relations: DataFrame, relation_vectors: DataFrame, subchunks: DataFrame, subchunk_vectors: DataFrame, query: list[float], budget: int) -> Skeleton:
    """Subchunks of chunks that seeds and their best relations point to, by adjacency and similarity."""
    seeds = stored(entity_seeds(entity_vectors, query), "seeds")
    facts = stored(relation_ranking(relations, relation_vectors, entities, seeds, query, max(1, 3 * budget)), "facts")
    more = facts.select("chunk_id").where("chunk_id is not null").groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n"))
    parents = seed_adjacency(entities, seeds).unionByName(more).groupBy("chunk_id").agg(F.sum("n").alias("adjacency"))
    own = subchunks.select("id", "parent_id").join(parents, F.col("parent_id") == F.col("chunk_id"))
    met = own.join(_scored(subchunk_vectors, query), "id")
    order = (F.desc("adjacency"), F.desc("score"), "id")
    best = met.orderBy(*order).limit(budget).select("id", "adjacency", "score")
    return Skeleton(best.withColumn("rank", F.row_number().over(Window.orderBy(*order))), seeds, facts)


def keyword_channel(keyword_vectors: DataFrame, edges: DataFrame, subchunk_vectors: DataFrame, skeleton: DataFrame, query: list[float], budget: int) -> DataFrame:
    """(id, score, rank): subchunks of the best keywords, without the skeleton's.

    Keywords are taken in order of similarity from a pool of max(20, 4 · budget) until their subchunks number twice the
    budget; the keyword that gets there counts whole. The skeleton's subchunks are taken out after that.
    """
    if budget <= 0:
        return subchunk_vectors.sparkSession.createDataFrame([], "id long, score double, rank int")
    pool = ranked_by_query(keyword_vectors.select(F.col("keyword_id").alias("id"), "vec"), query, max(20, 4 * budget))
    met = edges.join(F.broadcast(pool.select(F.col("id").alias("keyword_id"), "rank")), "keyword_id")
    first = met.groupBy("subchunk_id").agg(F.min("rank").alias("rank"))
    new = first.groupBy("rank").agg(F.count(F.lit(1)).alias("n"))  # one row for each keyword of the pool at most
    before = F.coalesce(F.sum("n").over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_ = new.withColumn("before", before).where(F.col("before") < 2 * budget).select("rank")
    candidates = first.join(F.broadcast(open_), "rank", "left_semi").select(F.col("subchunk_id").alias("id"))
    rest = candidates.join(F.broadcast(skeleton.select("id")), "id", "left_anti")
    return top_k(_scored(subchunk_vectors.join(rest, "id", "left_semi"), query), budget)


def two_channel(store: dict[str, DataFrame], query: list[float], k: int = 6, theta: float = 0.4) -> tuple[DataFrame, Skeleton]:
    """(id, channel, rank, score): the skeleton's subchunks, then the keywords'. ``store``: tables by name."""
    for_skeleton, for_keywords = budgets(k, theta)
    skeleton = skeleton_channel(
        store["entities"], store["entity_vectors"], store["relations"], store["relation_vectors"], store["subchunks"], store["subchunk_vectors"], query, for_skeleton
    )
    chosen = stored(skeleton.subchunks, "skeleton")
    words = keyword_channel(store["keywords"], store["keyword_edges"], store["subchunk_vectors"], chosen, query, for_keywords)
    n = F.lit(for_skeleton)
    both = chosen.select("id", F.lit("skeleton").alias("channel"), "rank", "score").unionByName(
        words.select("id", F.lit("keyword").alias("channel"), (F.col("rank") + n).alias("rank"), "score")
    )
    return both, skeleton


def graph_facts(skeleton: Skeleton) -> DataFrame:
    """One row ``facts``: the relations' texts under a heading, or '' where there are none."""
    said = F.array_sort(F.collect_list(F.struct("rank", relation_text().alias("t"))))
    joined = F.array_join(F.transform(said, lambda x: F.concat(F.lit("- "), x["t"])), "\n")
    return skeleton.facts.agg(F.when(F.count(F.lit(1)) > 0, F.concat(F.lit("Graph facts:\n"), joined)).otherwise(F.lit("")).alias("facts"))


def two_channel_context(ranked: DataFrame, skeleton: Skeleton, subchunks: DataFrame) -> DataFrame:
    """One row ``context``: facts, then the subchunks in order."""
    # of each at most k rows
    own = context(subchunks.join(F.broadcast(ranked.select("id", "rank")), "id"), subchunk=True)
    both = graph_facts(skeleton).crossJoin(own)  # one row each
    return both.select(F.concat_ws("\n\n", F.when(F.col("facts") != "", F.col("facts")), F.when(F.col("context") != "", F.col("context"))).alias("context"))


def diagnostics(ranked: DataFrame, skeleton: Skeleton, subchunks: DataFrame) -> DataFrame:
    """One row: chosen ids by channel, their sources, the entity seeds, and facts with their scores."""
    met = subchunks.join(F.broadcast(ranked.select("id", "channel", "rank", "score")), "id")
    of = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col("channel") == c, F.struct("rank", "id")))), lambda x: x["id"])
    source = F.struct("id", "source_name", "source_url", "page")
    chosen = met.agg(
        of("skeleton").alias("skeleton_ids"), of("keyword").alias("keyword_ids"),
        F.array_sort(F.collect_list(F.when(F.coalesce("source_name", "source_url").isNotNull(), source))).alias("sources"),
    )
    seeds = skeleton.seeds.agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("seeds"))
    fact = F.struct("rank", relation_text().alias("fact"), "matched", "score")
    facts = skeleton.facts.agg(F.array_sort(F.collect_list(fact)).alias("facts"))
    return chosen.crossJoin(seeds).crossJoin(facts)  # one row each


def compare(tables: dict[str, DataFrame], query: list[float], k: int = 6, theta: float = 0.4) -> DataFrame:
    """(strategy, rank, id, score) of all three strategies."""
    texts = text_retrieve(tables["chunk_vectors"], query, k)
    graph = knn_retrieve(tables["chunk_vectors"], tables["edges"], query, k)
    both, _ = two_channel(tables, query, k, theta)
    named = lambda df, s: df.select(F.lit(s).alias("strategy"), F.col("rank").cast("int").alias("rank"), "id", "score")
    return named(texts, "text").unionByName(named(graph, "graph")).unionByName(named(both, "two_channel"))
