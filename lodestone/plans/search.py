"""The hybrid search: chunks, kNN on their vectors, BM25, rank fusion, reranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import fulltext, retrieval, vector
from lodestone.operators.models import Embedder, HashingEmbedder, Reranker, embedded, rerank_scores

from . import tables as t


def search_and_merge(chunks: DataFrame, vectors: DataFrame, index: fulltext.Index, query: str, query_vector: list[float], k: int, hybrid: bool = True, within: DataFrame | None = None) -> DataFrame:
    """(chunk_id, score, order): the k best by fused ranks, or by distance alone. Both lists have k entries; ``within`` scopes the text list only."""
    near = vector.knn(vectors, query_vector, k, id_column="chunk_id").withColumn("distance", F.round("distance", 9))
    ranked = retrieval.ranked(near, "distance")
    if hybrid:
        columns = None if within is None else ("content",)
        hits = retrieval.ranked(fulltext.search(index, query, limit=k, columns=columns, within=within).withColumn("rank", F.round("rank", 9)).withColumnRenamed("rank", "bm25"), "bm25")
        fused = retrieval.reciprocal_rank_fusion(ranked, hits, k, known=chunks)
    else:
        fused = ranked.join(chunks.select("chunk_id"), "chunk_id", "left_semi").select("chunk_id", (-F.col("distance")).alias("score"))
    return retrieval.ranked(fused, "score", ascending=False).withColumnRenamed("rank", "order")


def with_rows(hits: DataFrame, chunks: DataFrame, files: DataFrame) -> DataFrame:
    """Hits with their chunk and path. Hits are at most k rows, so the joins broadcast them."""
    return chunks.join(F.broadcast(hits), "chunk_id").join(files.select("file_id", "path"), "file_id")


def reranked(rows: DataFrame, query: str, reranker: Reranker | None, top_k: int) -> DataFrame:
    if reranker is None:
        return rows.orderBy("order").limit(top_k)
    return retrieval.rerank(rows, rerank_scores(query, F.col("content"), reranker), top_k, "order")


def hybrid(spark: SparkSession, sf_dir: str, embedder: Embedder | None = None) -> DataFrame:
    """The flagship: the whole first benchmark text searched in the chunks of documents; the text list holds chunks with all its terms only."""
    embedder = embedder or HashingEmbedder(64)
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").limit(1).collect()[0]
    query = item.text
    chunks = t.chunks(spark, sf_dir)
    vectors = chunks.select("chunk_id", embedded(F.col("content"), embedder).alias("embedding"))
    index = fulltext.build_index(chunks, columns=("content",), stemming=False)
    hits = search_and_merge(chunks, vectors, index, query, embedder.embed([query])[0], 50)
    rows = with_rows(hits, chunks, t.files(spark, sf_dir))
    top = retrieval.rerank(rows, retrieval.lexical_score(query, F.col("content")), 10, "order")
    return top.select("chunk_id", "path", "start_line", "end_line", F.round("score", 9).alias("score"), F.round("rerank_score", 6).alias("rerank_score"))
