"""The registered queries of the engine's own operators, each over its whole tables, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.functions import render
from quarrystone.functions.text import clean_text, keyword_tokens, lexical_terms, split_sentences, words
from quarrystone.operators import blocks as block_ops
from quarrystone.operators import chunking, graph, retrieval, vectors
from quarrystone.plans import fixtures
from quarrystone.providers import HashingEmbedder, RuleExtractor
from quarrystone.runtime import latest, stored, table
from quarrystone.sources import html, pdf, urls

QUESTION = "Which homologation documentation covers the electrohydraulic suspension of the car?"
DIMS = 64

def _blocks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "blocks").dropDuplicates(["doc_id", "pos"])


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def _subchunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "subchunks").dropDuplicates(["id"])


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").dropDuplicates(["id"])


def _embeddings(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("id"), vectors.normalise(F.col("embedding")).alias("vec"))


def _relations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "relations").dropDuplicates(["relation_id"])


def _entities(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "entities").dropDuplicates(["entity_id"])


# -- text functions


def clean_documents(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).select("doc_id", clean_text(F.col("text")).alias("text"))


def tokenize_stats(spark: SparkSession, d: str) -> DataFrame:
    w = words(F.col("text"))
    return _documents(spark, d).select("doc_id", F.size(w).cast("long").alias("n_words"), F.size(F.array_distinct(w)).cast("long").alias("n_distinct")).where("n_words >= 0")


def keyword_token_counts(spark: SparkSession, d: str) -> DataFrame:
    return _subchunks(spark, d).where("text is not null").select("id", F.size(keyword_tokens(F.col("text"))).cast("long").alias("n_tokens"))


def lexical_term_counts(spark: SparkSession, d: str) -> DataFrame:
    return _subchunks(spark, d).where("text is not null").select("id", F.size(lexical_terms(F.col("text"))).cast("long").alias("n_terms"))


def sentence_stats(spark: SparkSession, d: str) -> DataFrame:
    s = _documents(spark, d).where("text is not null").select("doc_id", split_sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.array_join("s", "|").alias("sentences"))


def render_blocks(spark: SparkSession, d: str) -> DataFrame:
    return _blocks(spark, d).select("doc_id", "pos", render.block_text().alias("rendered"))


def relation_texts(spark: SparkSession, d: str) -> DataFrame:
    return _relations(spark, d).select("relation_id", render.relation_text().alias("fact"))


def entity_texts(spark: SparkSession, d: str) -> DataFrame:
    return _entities(spark, d).select("entity_id", render.entity_text().alias("entity_text"))


def subchunk_labels(spark: SparkSession, d: str) -> DataFrame:
    return _subchunks(spark, d).select("id", render.chunk_entry(subchunk=True).alias("entry"))


# -- blocks and chunks


def block_errors(spark: SparkSession, d: str) -> DataFrame:
    return block_ops.with_errors(_blocks(spark, d)).select("doc_id", "pos", "error")


def rebuilt_tables(spark: SparkSession, d: str) -> DataFrame:
    t = _blocks(spark, d).where("type = 'table'")
    made = block_ops.table_block(F.col("headers"), F.col("rows"), F.col("source_name"), F.col("table_id"), F.col("caption"))
    return t.select("doc_id", "pos", made.alias("b")).select("doc_id", "pos", "b.headers", F.size("b.rows").cast("long").alias("n_rows"))


def text_runs(spark: SparkSession, d: str) -> DataFrame:
    return chunking.text_runs(_blocks(spark, d)).select("doc_id", "run_pos", "source_text")


def word_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.word_chunks(_documents(spark, d), ["doc_id"]).select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), "text", "source_text")


def structured_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.structured_chunks(_blocks(spark, d))


def table_chunks(spark: SparkSession, d: str) -> DataFrame:
    c = chunking.table_chunks(_blocks(spark, d), size=60)
    return c.select("doc_id", F.col("run_pos").alias("pos"), "table_id", "row_start", "row_end", "source_text")


def tau_subchunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.tau_subchunks(_chunks(spark, d), 1)


def tau_text_subchunks(spark: SparkSession, d: str) -> DataFrame:
    c = _chunks(spark, d).where("table_row_texts is null")
    return chunking.tau_subchunks(c, 2, numbered=False).select("parent_id", F.col("part").cast("long").alias("part"), "text")


def numbered_chunks(spark: SparkSession, d: str) -> DataFrame:
    c = chunking.word_chunks(_documents(spark, d), ["doc_id"]).select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"))
    return chunking.number_globally(c, ["doc_id", "chunk_no"])


# -- vectors and graphs


def normalised_vectors(spark: SparkSession, d: str) -> DataFrame:
    e = _embeddings(spark, d)
    return e.select("id", F.round(vectors.norm(F.col("vec")), 6).alias("norm"), F.round(F.get("vec", F.lit(0)), 6).alias("first"))


def mean_vectors(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    members = e.select(F.col("label").cast("long").alias("label"), F.col("vec_id").alias("member"))
    m = vectors.mean_vectors(members, _embeddings(spark, d), "label", "member", DIMS)
    return m.select("label", F.round(F.get("vec", F.lit(0)), 6).alias("first"), F.round(F.get("vec", F.lit(63)), 6).alias("last"))


def semantic_knn(spark: SparkSession, d: str) -> DataFrame:
    return _long(graph.semantic_neighbours(_embeddings(spark, d), 5)).select("src", "dst", "rank", "score")


def _long(df: DataFrame) -> DataFrame:
    return df.withColumn("rank", F.col("rank").cast("long"))


def lexical_cooccurrence_topk(spark: SparkSession, d: str) -> DataFrame:
    texts = _entities(spark, d).select(F.col("entity_id").alias("id"), F.array_join("descriptions", " ").alias("text"))
    found = graph.lexical_neighbours(texts, 3)
    return _long(found).select("src", "dst", F.col("score").cast("long").alias("common"), "rank")


def lexical_cooccurrence(spark: SparkSession, d: str) -> DataFrame:
    texts = _entities(spark, d).select(F.col("entity_id").alias("id"), F.array_join("descriptions", " ").alias("text"))
    return graph.cooccurrence(texts)


def hybrid_knn(spark: SparkSession, d: str) -> DataFrame:
    """All documents, embedded by hashed words."""
    texts = _documents(spark, d).select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    return _long(graph.hybrid_knn(texts, stored(HashingEmbedder(DIMS).embed(texts), "vectors"), 6))


def _ranks(spark: SparkSession, d: str) -> DataFrame:
    e = _embeddings(spark, d)
    return graph.pagerank(e.select("id"), stored(graph.semantic_neighbours(e, 3).select("src", "dst"), "edges"))


def pagerank_core(spark: SparkSession, d: str) -> DataFrame:
    core = graph.core_chunks(_ranks(spark, d), 0.2)
    return core.select("id", F.round("pagerank", 10).alias("pagerank"), F.col("core_no").cast("long").alias("core_no"))


def pagerank_converged(spark: SparkSession, d: str) -> DataFrame:
    return _ranks(spark, d).select("id", F.round("pagerank", 10).alias("pagerank"))


def keyword_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return graph.keyword_vocabulary(_subchunks(spark, d))


def keyword_edges(spark: SparkSession, d: str) -> DataFrame:
    s = _subchunks(spark, d)
    return graph.keyword_edges(s, stored(graph.keyword_vocabulary(s), "vocabulary"))


def keyword_vectors(spark: SparkSession, d: str) -> DataFrame:
    s = _subchunks(spark, d)
    sentences = s.where("source_text is not null").select("id", F.posexplode(split_sentences(F.col("source_text"))).alias("n", "text"))
    sentences = stored(chunking.number_globally(sentences.withColumnRenamed("id", "_s"), ["_s", "n"]), "sentences")
    return graph.keyword_vectors(stored(graph.keyword_vocabulary(s), "vocabulary"), sentences, HashingEmbedder(DIMS).embed(sentences), DIMS)


def _extracted(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    chunks = _chunks(spark, d)
    core = chunks.select("id", F.lit(0.0).alias("pagerank"), F.col("id").alias("core_no"))
    return stored(RuleExtractor().extract(chunks), "extracted"), core


def skeleton_entities(spark: SparkSession, d: str) -> DataFrame:
    return graph.skeleton_entities(*_extracted(spark, d))


def skeleton_relations(spark: SparkSession, d: str) -> DataFrame:
    return graph.skeleton_relations(*_extracted(spark, d))


# -- retrieval


def hashed_vectors(spark: SparkSession, d: str) -> DataFrame:
    v = HashingEmbedder(DIMS).embed(_documents(spark, d), "doc_id")
    return v.select("id", F.round(F.get("vec", F.lit(0)), 6).alias("first"), F.round(F.get("vec", F.lit(63)), 6).alias("last"))


def text_retrieve(spark: SparkSession, d: str) -> DataFrame:
    e = HashingEmbedder(DIMS)
    found = retrieval.text_retrieve(e.embed(_documents(spark, d), "doc_id"), e.embed_query(QUESTION), 6)
    return _long(found)


def _first_vector(spark: SparkSession, d: str) -> list[float]:
    return [float(x) for x in _embeddings(spark, d).where("id = 0").first()["vec"]]


def knn_retrieve(spark: SparkSession, d: str) -> DataFrame:
    e = _embeddings(spark, d)
    edges = stored(graph.semantic_neighbours(e, 4).select("src", "dst"), "edges")
    return _long(retrieval.knn_retrieve(e, edges, _first_vector(spark, d), 8))


def seed_adjacency(spark: SparkSession, d: str) -> DataFrame:
    e = _entities(spark, d)
    seeds = e.where("cardinality(array_distinct(chunk_ids)) >= 3").select(F.col("entity_id").alias("id"))
    return retrieval.seed_adjacency(e, seeds)


def _store(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    e = HashingEmbedder(DIMS)
    subchunks, entities, relations = _subchunks(spark, d), _entities(spark, d), _relations(spark, d)
    vocabulary = stored(graph.keyword_vocabulary(subchunks), "vocabulary")
    facts = relations.select(F.col("relation_id").alias("id"), render.relation_text().alias("text"))
    names = entities.select(F.col("entity_id").alias("id"), render.entity_text().alias("text"))
    return {
        "subchunks": stored(subchunks, "subchunks"), "subchunk_vectors": stored(e.embed(subchunks), "vectors"), "entities": entities,
        "entity_vectors": e.embed(names), "relations": relations, "relation_vectors": e.embed(facts),
        "keywords": e.embed(vocabulary, "keyword_id", "keyword").withColumnRenamed("id", "keyword_id"),
        "keyword_edges": graph.keyword_edges(subchunks, vocabulary),
    }


def relation_rank(spark: SparkSession, d: str) -> DataFrame:
    s, q = _store(spark, d), HashingEmbedder(DIMS).embed_query(QUESTION)
    seeds = stored(retrieval.entity_seeds(s["entity_vectors"], q), "seeds")
    ranked = retrieval.relation_ranking(s["relations"], s["relation_vectors"], s["entities"], seeds, q, 20)
    return _long(ranked).withColumn("matched", F.col("matched").cast("long"))


def two_channel_retrieve(spark: SparkSession, d: str) -> DataFrame:
    found, _ = retrieval.two_channel(_store(spark, d), HashingEmbedder(DIMS).embed_query(QUESTION), 10, 0.4)
    return _long(found)


def two_channel_context(spark: SparkSession, d: str) -> DataFrame:
    s = _store(spark, d)
    found, skeleton = retrieval.two_channel(s, HashingEmbedder(DIMS).embed_query(QUESTION), 10, 0.4)
    return retrieval.two_channel_context(stored(found, "found"), skeleton, s["subchunks"])


def two_channel_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    s = _store(spark, d)
    found, skeleton = retrieval.two_channel(s, HashingEmbedder(DIMS).embed_query(QUESTION), 10, 0.4)
    told = retrieval.diagnostics(stored(found, "found"), skeleton, s["subchunks"])
    listed = lambda c, f, sep=",": F.array_join(F.transform(c, f), sep)
    return told.select(
        listed("skeleton_ids", lambda i: i.cast("string")).alias("skeleton_ids"), listed("keyword_ids", lambda i: i.cast("string")).alias("keyword_ids"),
        listed("sources", lambda x: F.concat(x["id"].cast("string"), F.lit(":"), F.coalesce(x["source_name"], x["source_url"]))).alias("sources"),
        listed("seeds", lambda x: x["id"].cast("string")).alias("seeds"), listed("facts", lambda x: F.concat(F.lit("- "), x["fact"]), "\n").alias("facts"),
    )


def three_way_comparison(spark: SparkSession, d: str) -> DataFrame:
    """What each of the three strategies chooses for the question."""
    e = HashingEmbedder(DIMS)
    vectors = stored(e.embed(_chunks(spark, d).where("text is not null")), "vectors")
    edges = stored(graph.semantic_neighbours(vectors, 4).select("src", "dst"), "edges")
    return _long(retrieval.compare(_store(spark, d) | {"chunk_vectors": vectors, "edges": edges}, e.embed_query(QUESTION), 10))


def context_render(spark: SparkSession, d: str) -> DataFrame:
    e = HashingEmbedder(DIMS)
    chunks = _chunks(spark, d).where("text is not null")
    found = retrieval.text_retrieve(e.embed(chunks), e.embed_query(QUESTION), 6)
    return render.context(chunks.join(F.broadcast(found.select("id", "rank")), "id"))  # six rows


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Documents cut into word windows, embedded, ranked for the question, rendered as a context."""
    e = HashingEmbedder(DIMS)
    chunks = chunking.number_globally(chunking.word_chunks(_documents(spark, d), ["doc_id"]), ["doc_id", "chunk_no"])
    chunks = stored(chunks, "chunks")
    found = retrieval.text_retrieve(e.embed(chunks), e.embed_query(QUESTION), 6)
    absent = {c: F.lit(None).cast(t) for c, t in (("source_name", "string"), ("page", "int"), ("table_id", "string"), ("row_start", "int"), ("row_end", "int"))}
    return render.context(chunks.join(F.broadcast(found.select("id", "rank")), "id").withColumns(absent))


# -- sources


def corpus_key(spark: SparkSession, d: str) -> DataFrame:
    pages = latest(table(spark, d, "web_pages").select("doc_id", "requested_url", "loaded_at"), ["doc_id"], ["loaded_at"])
    return urls.request_key(pages.select(F.col("doc_id").alias("pos"), F.col("requested_url").alias("url")))


def html_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Web blocks written out as HTML pages and read back."""
    return html.page_blocks(fixtures.html_pages(_blocks(spark, d).where("source_url is not null")))


def html_text(spark: SparkSession, d: str) -> DataFrame:
    return html.page_text(html_blocks(spark, d))


def pdf_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """The text blocks of PDF pages laid out as words with positions, and read back as paragraphs."""
    placed = fixtures.pdf_words(_blocks(spark, d).where("page is not null and type <> 'table' and text is not null"))
    found = pdf.page_blocks(placed, spark.createDataFrame([], "file string, page int, table_no int, bbox array<double>, cells array<array<array<double>>>"))
    return found.select("file", "page", F.col("pos").cast("long").alias("pos"), "text")


def pdf_tables(spark: SparkSession, d: str) -> DataFrame:
    """The tables of PDF pages laid out as words and ruled cells, and read back as table blocks."""
    tables = _blocks(spark, d).where("page is not null and type = 'table' and size(rows) > 0")
    placed, ruled = fixtures.pdf_tables(tables)
    return pdf.page_blocks(placed, ruled).where("type = 'table'").select("file", "page", "table_id", "headers", "rows")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = [
        clean_documents, tokenize_stats, keyword_token_counts, lexical_term_counts, sentence_stats, render_blocks, relation_texts, entity_texts,
        subchunk_labels, block_errors, rebuilt_tables, text_runs, word_chunks, structured_chunks, table_chunks, tau_subchunks, tau_text_subchunks,
        numbered_chunks, normalised_vectors, mean_vectors, semantic_knn, lexical_cooccurrence, lexical_cooccurrence_topk,
        hybrid_knn, pagerank_core, pagerank_converged, keyword_vocabulary, keyword_edges, keyword_vectors, skeleton_entities, skeleton_relations, hashed_vectors, text_retrieve,
        knn_retrieve, seed_adjacency, relation_rank, two_channel_retrieve, two_channel_context, two_channel_diagnostics, three_way_comparison, context_render, corpus_key,
        html_blocks, html_text, pdf_paragraphs, pdf_tables,
    ]
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    from quarrystone.plans.oracle import oracle_sql as sql

    return sql()
