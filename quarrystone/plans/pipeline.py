"""Build and compare: the engine's entry points, and its command line."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.config import Settings
from quarrystone.functions.render import context, source_label
from quarrystone.operators import retrieval
from quarrystone.operators.blocks import text_block
from quarrystone.plans.store import IndexStore, source_key
from quarrystone.providers import Embedder, ExtractiveGenerator, Extractor, Generator, HashingEmbedder, RuleExtractor
from quarrystone.runtime import stored
from quarrystone.sources import corpus, files


def text_blocks(texts: DataFrame) -> DataFrame:
    """Plain texts (doc_id, text) as one paragraph block each."""
    made = text_block(F.col("text"), F.concat(F.lit("document "), F.col("doc_id").cast("string")))
    return texts.where("text is not null").select("doc_id", F.lit(0).cast("long").alias("pos"), made.alias("b")).select("doc_id", "pos", "b.*")


class Comparison:
    """Three retrieval strategies over one corpus. Build first, then compare with the same parameters."""

    def __init__(self, spark: SparkSession, root: str, settings: Settings | None = None, embedder: Embedder | None = None, extractor: Extractor | None = None, generator: Generator | None = None, progress=lambda m: None):
        self.settings = settings or Settings()
        self.embedder = embedder or HashingEmbedder(self.settings.embedding_dimensions)
        self.generator = generator or ExtractiveGenerator()
        self.store = IndexStore(spark, root, self.settings, self.embedder, extractor or RuleExtractor(), progress)
        self.loaded: tuple | None = None
        self.tables: dict[str, DataFrame] = {}

    def build(self, blocks: DataFrame | None = None, sources: list[str] | None = None, content: str | None = None, k: int = 6, beta: float = 0.2, tau: int = 1, **extract) -> float:
        """Builds what is missing of the indexes of a corpus; returns the seconds it took."""
        started = time.monotonic()
        spark = self.store.spark
        if (blocks is None) == (sources is None):
            raise ValueError("give either blocks or sources")
        if sources is not None:
            saved = corpus.extract_corpus(spark, sources, self.store.path("corpora"), settings=self.settings, **extract)
            blocks = spark.read.parquet(saved.blocks_path).withColumn("doc_id", F.shiftright("pos", corpus.ITEM_BITS))
            content = saved.content_key
        key = source_key(content or corpus.content_key(blocks.withColumn("pos", F.shiftleft(F.col("doc_id"), corpus.ITEM_BITS) + F.col("pos"))), self.settings)
        self.tables = self.store.ensure_skeleton(blocks, key, k, beta, tau)
        self.loaded = (key, k, beta, tau)
        return time.monotonic() - started

    def compare(self, question: str, top_k: int = 6, theta: float = 0.4, temperature: float = 0.2) -> DataFrame:
        """(strategy, context, answer, ids) of the three strategies."""
        if not question.strip():
            raise ValueError("ask a question")
        if self.loaded is None:
            raise ValueError("build the indexes first")
        t, q = self.tables, self.embedder.embed_query(question)
        chunks = t["chunks"]
        rows = []
        for name, found in (("text", retrieval.text_retrieve(t["chunk_vectors"], q, top_k)), ("graph", retrieval.knn_retrieve(t["chunk_vectors"], t["edges"], q, top_k))):
            best = stored(found, name)
            said = context(chunks.join(F.broadcast(best.select("id", "rank")), "id")).first()[0]  # top_k rows
            rows.append((name, said, self.generator.answer(question, said, temperature), [r.id for r in best.orderBy("rank").collect()]))
        found, skeleton = retrieval.two_channel(t, q, top_k, theta)
        best = stored(found, "both")
        said = retrieval.two_channel_context(best, skeleton, t["subchunks"]).first()[0]
        named = t["subchunks"].join(F.broadcast(best.select("id", "rank")), "id").select("rank", source_label().alias("s")).orderBy("rank").collect()
        answer = self.generator.answer(question, said, temperature)
        rows.append(("two_channel", said, f"{answer}\nSources: {'; '.join(dict.fromkeys(r.s for r in named))}", [r.id for r in best.orderBy("rank").collect()]))
        return self.store.spark.createDataFrame(rows, "strategy string, context string, answer string, ids array<long>")


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description="Build the indexes of a text file or of addresses.")
    p.add_argument("sources", nargs="+")
    p.add_argument("--root", required=True)
    p.add_argument("--knn-k", type=int, default=6)
    p.add_argument("--beta", type=float, default=0.2)
    p.add_argument("--tau", type=int, default=1)
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    job = Comparison(spark, a.root, progress=print)
    if len(a.sources) == 1 and not a.sources[0].lower().startswith("http"):
        texts = files.read_text(spark, a.sources[0]).select(F.lit(0).cast("long").alias("doc_id"), "text")
        seconds = job.build(blocks=text_blocks(texts), k=a.knn_k, beta=a.beta, tau=a.tau)
    else:
        seconds = job.build(sources=a.sources, k=a.knn_k, beta=a.beta, tau=a.tau)
    print(f"built in {seconds:.1f} s")


if __name__ == "__main__":
    main()
