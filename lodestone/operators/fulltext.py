"""Full-text search: a positional inverted index as a table, and BM25.

``postings(term, chunk_id, col, tf, positions)`` is one row per term, chunk and
indexed column; ``doc_stats(chunk_id, len)`` has the number of tokens over all
columns. Stored sorted by term, a query reads the row groups of its terms only.
A query is split at white space; each part is a phrase (a part such as foo_bar
has two tokens that must be adjacent), and all phrases must match.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.stemming import prefix_of, stem, stemmed
from lodestone.functions.text import tokens

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
COLUMNS = ("content", "file_path", "symbol")


@dataclass(frozen=True)
class Index:
    postings: DataFrame
    doc_stats: DataFrame
    stemming: bool
    terms: DataFrame | None = None  # (chunk_id, col, pos, term), not stemmed, of an index that is not stored


def build_index(chunks: DataFrame, columns: tuple[str, ...] = COLUMNS, stemming: bool = True) -> Index:
    """The index of chunks(chunk_id, ...columns)."""
    listed = [F.struct(F.lit(c).alias("col"), tokens(F.col(c)).alias("t")) for c in columns]
    rows = chunks.select("chunk_id", F.explode(F.array(*listed)).alias("x")).select("chunk_id", "x.col", "x.t")
    doc_stats = rows.groupBy("chunk_id").agg(F.sum(F.size("t")).alias("len"))
    terms = rows.select("chunk_id", "col", F.posexplode("t").alias("pos", "term"))
    if not stemming:
        return Index(_postings(terms), doc_stats, stemming, terms)
    stems = terms.select("term").distinct().withColumn("stem", stemmed(F.col("term")))  # the stemmer sees distinct terms only
    return Index(_postings(terms.join(stems, "term").select("chunk_id", "col", "pos", F.col("stem").alias("term"))), doc_stats, stemming, terms)


def _postings(terms: DataFrame) -> DataFrame:
    return terms.groupBy("term", "chunk_id", "col").agg(F.count(F.lit(1)).cast("int").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))


def _postings_of(index: Index, wanted: list[str]) -> DataFrame:
    """Postings with those of the wanted terms, all others or not. Of an index that is not stored, only words that may have a wanted stem are stemmed."""
    if index.terms is None or not index.stemming:
        return index.postings
    near = F.lit(False)
    for p in sorted({prefix_of(w) for w in wanted}):
        near = near | F.col("term").startswith(p)
    return _postings(index.terms.where(near).withColumn("term", stemmed(F.col("term"))).where(F.col("term").isin(wanted)))


def save_index(index: Index, path: str) -> None:
    index.postings.sort("term", "chunk_id").write.mode("overwrite").parquet(f"{path}/postings")
    index.doc_stats.write.mode("overwrite").parquet(f"{path}/doc_stats")


def load_index(spark, path: str, stemming: bool = True) -> Index:
    return Index(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/doc_stats"), stemming)


def parse_query(spark, query: str, stemming: bool) -> list[list[str]]:
    """The phrases of a query, as lists of terms; parts without letters or digits are dropped."""
    import re
    import unicodedata

    from lodestone.functions.text import ACCENTED, PLAIN

    table = str.maketrans(ACCENTED, PLAIN)
    parts = [re.findall(r"[^\W_]+", "".join(c for c in p.lower().translate(table) if not unicodedata.combining(c))) for p in query.split()]
    return [[stem(t) if stemming else t for t in p] for p in parts if p]


def _phrase_hits(postings: DataFrame, phrases: list[list[str]]) -> DataFrame:
    """(phrase, chunk_id, tf): occurrences of each phrase over the columns."""
    spark = postings.sparkSession
    wanted = spark.createDataFrame([(p, k, t) for p, terms in enumerate(phrases) for k, t in enumerate(terms)], "phrase int, at int, term string")
    needed = sorted({t for p in phrases for t in p})
    found = postings.where(F.col("term").isin(needed)).join(F.broadcast(wanted), "term")
    if all(len(p) == 1 for p in phrases):
        return found.groupBy("phrase", "chunk_id").agg(F.sum("tf").alias("tf"))
    # a start is a position every term of the phrase has, shifted by its place
    shifted = found.select("phrase", "chunk_id", "col", "at", F.transform("positions", lambda p: p - F.col("at")).alias("starts"))
    lengths = F.create_map(*[F.lit(x) for p, terms in enumerate(phrases) for x in (p, len(terms))])
    grouped = shifted.groupBy("phrase", "chunk_id", "col").agg(F.collect_list("starts").alias("s"))
    grouped = grouped.where(F.size("s") == lengths[F.col("phrase")])
    common = F.aggregate("s", F.element_at("s", 1), lambda a, b: F.array_intersect(a, b))
    return grouped.withColumn("n", F.size(common)).where("n > 0").groupBy("phrase", "chunk_id").agg(F.sum("n").alias("tf"))


def bm25(tf: Column, length: Column, mean: Column, idf: Column) -> Column:
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def idf_of(n_docs: Column, df: Column) -> Column:
    return F.greatest(F.log((n_docs - df + 0.5) / (df + 0.5)), F.lit(LEAST_IDF))


def search(index: Index, query: str, limit: int | None = 10, offset: int = 0, columns: tuple[str, ...] | None = None, within: DataFrame | None = None) -> DataFrame:
    """(chunk_id, rank), best first, rank being minus the BM25 score.

    ``columns`` restricts what is matched, ``within`` (chunk_id) which chunks are
    returned; the statistics are those of the whole table in any case.
    """
    spark = index.postings.sparkSession
    phrases = parse_query(spark, query, index.stemming)
    if not phrases:
        return index.doc_stats.select("chunk_id", F.lit(0.0).alias("rank")).limit(0)
    postings = _postings_of(index, sorted({t for p in phrases for t in p}))
    if columns is not None:
        postings = postings.where(F.col("col").isin(*columns))
    # hits and doc_stats are used twice each; with the same columns and filters in both places, Spark computes them once
    hits = _phrase_hits(postings, phrases)
    df = hits.groupBy("phrase").agg(F.count("tf").alias("df"))
    totals = index.doc_stats.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("mean"))
    sizes = index.doc_stats.select(F.col("chunk_id").alias("_id"), "len")
    rows = hits.join(F.broadcast(df), "phrase").join(sizes, F.col("chunk_id").eqNullSafe(F.col("_id"))).join(F.broadcast(totals))
    score = bm25(F.col("tf"), F.col("len"), F.col("mean"), idf_of(F.col("n"), F.col("df")))
    out = rows.groupBy("chunk_id").agg(F.sum(score).alias("_s"), F.count(F.lit(1)).alias("_p")).where(F.col("_p") == len(phrases))
    if within is not None:
        out = out.join(within.select("chunk_id").distinct(), "chunk_id", "left_semi")
    out = out.select("chunk_id", (-F.col("_s")).alias("rank")).orderBy(F.round("rank", 9), "chunk_id")
    if offset:
        out = out.offset(offset)
    return out if limit is None else out.limit(limit)
