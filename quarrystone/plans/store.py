"""Materialised indexes under content keys: built once, reused, resumed and upgraded in place.

An artifact is a Parquet folder that counts once its job has committed (``_SUCCESS``); parts of a build that are there
are read, the rest is built. Nothing is kept in memory between builds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.config import Settings
from quarrystone.functions.render import entity_text, filled, relation_text
from quarrystone.functions.text import split_sentences
from quarrystone.operators import chunking, graph
from quarrystone.providers import Embedder, Extractor
from quarrystone.schemas import INDEX_VERSION


def source_key(content: str, s: Settings, version: str = INDEX_VERSION) -> str:
    """The key of an index: content, chunking, model and format."""
    joined = "|".join(map(str, (content, s.chunk_words, s.chunk_overlap, s.embedding_model, s.embedding_dimensions, version)))
    return hashlib.sha256(joined.encode()).hexdigest()[:16]


def skeleton_name(k: int, beta: float, tau: int, model: str, version: str = INDEX_VERSION) -> str:
    tag = hashlib.sha256(f"{model}|{version}".encode()).hexdigest()[:8]
    return f"skeleton_k{k}_b{round(beta, 4):g}_t{tau}_x{tag}"


def knn_name(k: int) -> str:
    return f"knn_k{k}"


@dataclass
class IndexStore:
    spark: SparkSession
    root: str
    settings: Settings
    embedder: Embedder
    extractor: Extractor
    progress: Callable[[str], None] = lambda message: None

    def path(self, *parts: str) -> str:
        return "/".join([self.root.rstrip("/"), *parts])

    def has(self, *parts: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path(*parts)}/_SUCCESS")
        return bool(path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path))

    def ensure(self, make: Callable[[], DataFrame], *parts: str) -> DataFrame:
        """The stored artifact, made and written first where it is missing."""
        if not self.has(*parts):
            self.progress(f"building {'/'.join(parts)}")
            make().write.mode("overwrite").parquet(self.path(*parts))
        return self.spark.read.parquet(self.path(*parts))

    def ensure_base(self, blocks: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
        """Chunks and their vectors; no chunks is an error."""
        s = self.settings
        chunks = self.ensure(lambda: chunking.structured_chunks(blocks, s.chunk_words, s.chunk_overlap), key, "chunks")
        if chunks.isEmpty():
            raise ValueError("no chunks could be built")
        said = chunks.select("id", F.coalesce(filled(F.col("source_text")), "text").alias("text"))
        return chunks, self.ensure(lambda: self.embedder.embed(said), key, "chunk_vectors")

    def ensure_knn(self, blocks: DataFrame, key: str, k: int) -> DataFrame:
        chunks, vectors = self.ensure_base(blocks, key)
        return self.ensure(lambda: graph.hybrid_knn(chunks.select("id", "text"), vectors, k), key, knn_name(k))

    def ensure_extractions(self, core: DataFrame, chunks: DataFrame, *at: str) -> DataFrame:
        """Extraction records of all core chunks; chunks with stored records aren't asked for again."""
        wanted = core.select(F.col("id").alias("chunk_id"))
        done = self.spark.read.parquet(self.path(*at)) if self.has(*at) else None
        missing = wanted if done is None else wanted.join(done, "chunk_id", "left_anti")
        if done is None or not missing.isEmpty():
            todo = chunks.join(missing.select(F.col("chunk_id").alias("id")), "id", "left_semi")
            self.extractor.extract(todo).write.mode("overwrite" if done is None else "append").parquet(self.path(*at))
        return self.spark.read.parquet(self.path(*at)).join(wanted, "chunk_id", "left_semi")

    def ensure_vectors(self, texts: Callable[[], DataFrame], *at: str) -> DataFrame:
        """Vectors of (id, text); where some ids have none yet, for these only (an index made before they existed)."""
        if self.has(*at):
            rows = texts()
            missing = rows.join(self.spark.read.parquet(self.path(*at)).select("id"), "id", "left_anti")
            if not missing.isEmpty():
                self.embedder.embed(missing).write.mode("append").parquet(self.path(*at))
        return self.ensure(lambda: self.embedder.embed(texts()), *at)

    def ensure_skeleton(self, blocks: DataFrame, key: str, k: int = 6, beta: float = 0.2, tau: int = 1) -> dict[str, DataFrame]:
        """All tables of the two-channel index."""
        chunks, chunk_vectors = self.ensure_base(blocks, key)
        edges = self.ensure_knn(blocks, key, k)
        name = skeleton_name(k, beta, tau, self.settings.extraction_model)
        e = self.ensure
        core = e(lambda: graph.core_chunks(graph.pagerank(chunks.select("id"), edges), beta), key, name, "core")
        records = self.ensure_extractions(core, chunks, key, name, "extractions")
        entities = e(lambda: graph.skeleton_entities(records, core), key, name, "entities")
        relations = e(lambda: graph.skeleton_relations(records, core), key, name, "relations")
        entity_vectors = self.ensure_vectors(lambda: entities.select(F.col("entity_id").alias("id"), entity_text().alias("text")), key, name, "entity_vectors")
        relation_vectors = self.ensure_vectors(lambda: relations.select(F.col("relation_id").alias("id"), relation_text().alias("text")), key, name, "relation_vectors")
        subchunks = e(lambda: chunking.tau_subchunks(chunks, tau), key, name, "subchunks")
        if tau == 0:  # every chunk is its own subchunk, in the same order
            parents = subchunks.select("id", "parent_id")
            subchunk_vectors = parents.join(chunk_vectors.withColumnRenamed("id", "parent_id"), "parent_id").select("id", "vec")
        else:
            subchunk_vectors = self.ensure_vectors(lambda: subchunks.select("id", F.coalesce(filled(F.col("source_text")), "text").alias("text")), key, name, "subchunk_vectors")

        def made_sentences() -> DataFrame:
            split = subchunks.select(F.col("id").alias("_s"), F.posexplode(split_sentences(F.coalesce("source_text", "text"))).alias("n", "text"))
            return chunking.number_globally(split, ["_s", "n"]).select("id", "text")

        sentences = e(made_sentences, key, name, "sentences")
        sentence_vectors = self.ensure_vectors(lambda: sentences, key, name, "sentence_vectors")
        vocabulary = e(lambda: graph.checked_vocabulary(graph.keyword_vocabulary(subchunks)), key, name, "vocabulary")
        keywords = e(lambda: graph.keyword_vectors(vocabulary, sentences, sentence_vectors, self.embedder.dims), key, name, "keywords")
        keyword_edges = e(lambda: graph.keyword_edges(subchunks, vocabulary), key, name, "keyword_edges")
        return {
            "chunks": chunks, "chunk_vectors": chunk_vectors, "edges": edges, "core": core, "entities": entities, "entity_vectors": entity_vectors,
            "relations": relations, "relation_vectors": relation_vectors, "subchunks": subchunks, "subchunk_vectors": subchunk_vectors,
            "keywords": keywords, "keyword_edges": keyword_edges,
        }
