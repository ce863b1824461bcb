"""Mixing of sources to target shares by weighted fair queueing.

Each document copy gets a virtual finish time: the tokens its source has served up to and including it, divided by
the source's weight. In order of finish time the sources come in proportion to their weights at every point, and
where the time reaches the total budget the selection ends. Running totals within a source are taken over hash
buckets, so a source may hold any share of all documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.llm.tokens import VOCABULARY, encode
from quarrystone.runtime import prefix_offsets, small_side, stored

#: Documents of one source that a task puts in order.
BUCKET_ROWS = 20_000


def plan_quota(rows: list[dict], budget: float | None = None) -> dict[str, float]:
    """Tokens for each source. rows: source, weight, max_repeats and tokens, one for each wanted source.

    Without ``budget`` the total is the largest at which every source that has documents reaches its share. With
    one, a source that its repeats don't carry so far gives all it has, and the others fill up by weight.
    """
    have = {r["source"]: r for r in rows if r["tokens"] > 0 and r["weight"] > 0 and r["max_repeats"] > 0}
    cap = {s: r["tokens"] * r["max_repeats"] for s, r in have.items()}
    weight = {s: r["weight"] for s, r in have.items()}
    if not have:
        return {}
    if budget is None:
        budget = min(cap[s] / weight[s] for s in have) * sum(weight.values())
    quota, left, open_ = {}, float(budget), set(have)
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if cap[s] < weight[s] * unit * (1 - 1e-12)}
        if not full:
            quota |= {s: weight[s] * unit for s in open_}
            break
        quota |= {s: float(cap[s]) for s in full}
        left -= sum(cap[s] for s in full)
        open_ -= full
    return quota


def mix(
    documents: DataFrame,
    targets: DataFrame,
    budget: float | None = None,
    vocabulary: str = VOCABULARY,
    seed: int = 42,
    key: str = "doc_id",
) -> DataFrame:
    """The selection in order of its virtual finish times: ``finish_at``, ``source``, ``doc_id``, ``repeat_no`` (from
    0), ``n_tokens``, and the source's ``target_share`` and ``reached_share`` of all selected tokens.

    Documents of null or unlisted sources and those without tokens are never selected. Target rows with a null
    source, weight or max_repeats are ignored; of a source listed twice the larger weight counts. A source is
    gone through again, in the same shuffled order, until its share or ``max_repeats`` is reached. Empty inputs
    give no rows.
    """
    spark = documents.sparkSession
    wanted = (
        targets.where("source is not null and weight > 0 and max_repeats > 0")
        .groupBy("source")
        .agg(F.max("weight").alias("weight"), F.max_by("max_repeats", "weight").alias("max_repeats"))
    )
    mine = documents.select(key, "source", "text").join(small_side(wanted.select("source")), "source", "left_semi")
    sized = stored(encode(mine, [key, "source"], "text", vocabulary, ids=False).where("n_tokens > 0"), "mix-sizes")
    per_source = sized.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))
    # one row for each listed source: as many as mix targets, whatever the number of documents
    rows = [r.asDict() for r in wanted.join(per_source, "source", "left").na.fill(0, ["tokens", "docs"]).collect()]
    quota = plan_quota(rows, budget)
    weights = sum(r["weight"] for r in rows) or 1.0
    facts = spark.createDataFrame(
        [
            (r["source"], float(r["weight"] / weights), int(r["max_repeats"]), int(r["tokens"]), float(quota.get(r["source"], 0)))
            for r in rows
        ],
        "_s string, target_share double, _most int, _all long, _quota double",
    )
    buckets = max(1, -(-max((r["docs"] for r in rows), default=0) // BUCKET_ROWS))
    shuffled = sized.withColumn("_hash", F.xxhash64(F.lit(seed), "source", key)).withColumn(
        "_bucket", F.floor((F.shiftrightunsigned("_hash", 1) / F.lit(float(2**63))) * buckets).cast("int")
    )
    served = prefix_offsets(shuffled, "source", ["_hash", key], "n_tokens", "_bucket", "_served")
    served = served.join(F.broadcast(facts), F.col("source") == F.col("_s"))  # one row per listed source
    copies = F.when(
        F.col("_quota") >= F.col("_served"),
        F.least(F.col("_most").cast("long"), F.floor((F.col("_quota") - F.col("_served")) / F.col("_all")) + 1),
    ).otherwise(F.lit(0).cast("long"))
    taken = served.withColumn("_copies", copies).where("_copies > 0")
    copied = taken.select(
        "source", key, "n_tokens", "target_share", "_all", "_served", F.explode(F.sequence(F.lit(0), (F.col("_copies") - 1).cast("int"))).alias("repeat_no")
    )
    finish = (F.col("repeat_no") * F.col("_all") + F.col("_served")) / F.col("target_share")
    selection = stored(copied.withColumn("finish_at", finish).drop("_all", "_served"), "mix-selection")
    reached = selection.groupBy(F.col("source").alias("_s")).agg(F.sum("n_tokens").alias("_n"))
    total = reached.agg(F.sum("_n")).scalar()
    reached = small_side(reached.select("_s", (F.col("_n") / total).alias("reached_share")))
    return (
        selection.join(reached, F.col("source") == F.col("_s"))
        .select("finish_at", "source", key, "repeat_no", "n_tokens", "target_share", "reached_share")
        .orderBy("finish_at", "source", key, "repeat_no")
    )


def shares(selection: DataFrame, targets: DataFrame) -> DataFrame:
    """For each listed source: target and reached share, selected tokens, documents and copies."""
    got = selection.groupBy("source").agg(
        F.max("reached_share").alias("reached_share"),
        F.sum("n_tokens").alias("n_tokens"),
        F.count(F.lit(1)).alias("n_copies"),
        F.sum(F.when(F.col("repeat_no") == 0, 1).otherwise(0)).alias("n_documents"),
    )
    wanted = targets.where("source is not null and weight > 0").groupBy("source").agg(F.max("weight").alias("target_share"))
    return wanted.join(got, "source", "left").na.fill(0)
