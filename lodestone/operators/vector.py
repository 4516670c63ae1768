"""Vector search: exact cosine k-nearest neighbours, one query or many, and a hashed variant.

Vectors are array<float> columns; arithmetic is in double. Rows whose vector is
null, of another length than the query's or zero are no neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The most bytes of queries that are sent to every task; larger sets go block by block.
BROADCAST_BYTES = 64 << 20
#: Queries, and rows, of one matrix of distances in a task: 8 MB.
TILE = 1024


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def checked(vectors: DataFrame, dimension: int, column: str = "embedding") -> DataFrame:
    """vectors, raising on the first one of another dimension."""
    wrong = F.concat(F.lit(f"dimension {dimension} expected, found "), F.size(column).cast("string"))
    return vectors.withColumn(column, F.when(F.size(column) == dimension, F.col(column)).otherwise(F.raise_error(wrong).cast("array<float>")))


def knn(vectors: DataFrame, query: Sequence[float], k: int, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(id, distance) of the k nearest: a scan with a top-k per task, no shuffle of vectors."""
    q = F.lit([float(x) for x in query])
    rows = vectors.where((F.size(column) == len(query)) & (dot(F.col(column), F.col(column)) > 0))
    rows = rows.select(id_column, cosine_distance(F.col(column), q).alias("distance"))
    return rows.orderBy(F.round("distance", 9), id_column).limit(k)


def knn_batch(vectors: DataFrame, queries: DataFrame, k: int, id_column: str = "vec_id", column: str = "embedding", exclude_self: bool = False) -> DataFrame:
    """(query_id, id, distance, rank): the k nearest rows of every query (query_id, embedding).

    Queries go to every task, in blocks of at most BROADCAST_BYTES with their
    results; a task keeps its k best per query from products of TILE queries and
    TILE rows at most, and only those are shuffled and merged. There are at most
    four tasks for each core, so that what they send follows the queries.
    """
    got = queries.select(F.col("query_id").cast("long"), F.col(column).alias("q")).where("q IS NOT NULL").toArrow()
    vectors = vectors.coalesce(4 * vectors.sparkSession.sparkContext.defaultParallelism)
    widths = pc.list_value_length(got["q"]).to_numpy()
    parts = []
    for width in np.unique(widths) if len(widths) else [1]:
        some = got.filter(pa.array(widths == width))
        ids, q = some["query_id"].to_numpy(), some["q"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(some.num_rows, width)
        step = max(1, BROADCAST_BYTES // (8 * int(width) + 16 * k))
        parts += [_knn_block(vectors, ids[a : a + step], q[a : a + step], k, id_column, column, exclude_self) for a in range(0, max(1, len(ids)), step)]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    order = Window.partitionBy("query_id").orderBy(F.round("distance", 9), id_column)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _nearer(best_d: np.ndarray, best_id: np.ndarray, d: np.ndarray, own: np.ndarray) -> None:
    """Puts the nearest of the rows ``own`` at distances d into the k best of each query, in place; ties to smaller ids."""
    k = best_d.shape[1]
    last = np.round(best_d[:, -1], 9)
    bound = last
    if d.shape[1] > k and not np.isfinite(last).all():
        bound = np.fmin(last, np.partition(d, k - 1, axis=1)[:, k - 1])
    r, c = np.nonzero(d <= (bound + 1e-9)[:, None])  # distances are compared to nine places
    new, own = d[r, c], own[c]
    near = np.round(new, 9)
    fits = (near < last[r]) | (near == last[r]) & (own < best_id[r, -1])
    r, new, own = r[fits], new[fits], own[fits]
    if not len(r):
        return
    rows = np.unique(r)
    at = np.concatenate([np.repeat(rows, k), r])
    new, own = np.concatenate([best_d[rows].ravel(), new]), np.concatenate([best_id[rows].ravel(), own])
    order = np.lexsort((own, np.round(new, 9), at))
    starts = np.searchsorted(at[order], rows)
    keep = order[starts[:, None] + np.arange(k)]
    best_d[rows], best_id[rows] = new[keep], own[keep]


def _knn_block(vectors: DataFrame, ids: np.ndarray, queries: np.ndarray, k: int, id_column: str, column: str, exclude_self: bool) -> DataFrame:
    names, tile = ["query_id", id_column, "distance"], TILE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best_d, best_id = np.full((len(ids), k), np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)
        for whole in batches:
            for b in (whole.slice(a, tile) for a in range(0, whole.num_rows, tile)):
                lists = b.column(1)
                fits = np.flatnonzero(np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False).astype(float), nan=-1) == queries.shape[1])
                m = lists.take(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(fits), queries.shape[1])
                norm = np.linalg.norm(m, axis=1)
                m, own = m[norm > 0] / norm[norm > 0][:, None], b.column(0).to_numpy()[fits][norm > 0]
                if not len(own):
                    continue
                for a in range(0, len(ids), tile):
                    part = slice(a, a + tile)
                    q = queries[part].astype(np.float64)
                    d = 1 - q / np.maximum(np.linalg.norm(q, axis=1), 1e-300)[:, None] @ m.T
                    if exclude_self:
                        same = np.flatnonzero(np.isin(own, ids[part]))
                        r, c = np.nonzero(ids[part][:, None] == own[same][None, :])
                        d[r, same[c]] = np.inf
                    _nearer(best_d[part], best_id[part], d, own)
        for a in range(0, len(ids), tile):
            r, c = np.nonzero(np.isfinite(best_d[a : a + tile]))
            yield pa.record_batch([pa.array(ids[a + r]), pa.array(best_id[a + r, c]), pa.array(best_d[a + r, c])], names)

    rows = vectors.select(F.col(id_column).cast("long").alias(id_column), column).where(F.col(id_column).isNotNull())
    return rows.mapInArrow(run, f"query_id long, {id_column} long, distance double")


def knn_hashed(vectors: DataFrame, query: Sequence[float], k: int, id_column: str = "vec_id", column: str = "embedding", tables: int = 8, width: float = 0.5, seed: int = 42) -> DataFrame:
    """(id, distance) of about the k nearest, by random projections of unit vectors.

    Rows whose projection falls into the query's bucket, or one beside it, in any
    table are compared exactly; the hashes are plain expressions over the column.
    """
    g = np.random.default_rng(seed)
    q = np.asarray(query, float)
    q = q / np.linalg.norm(q)
    near = F.lit(False)
    norm = F.sqrt(dot(F.col(column), F.col(column)))
    for _ in range(tables):
        w = g.normal(size=len(q))
        at = float(w @ q) / width
        near = near | (F.abs(dot(F.col(column), F.lit(w.tolist())) / norm / width - at) <= 1.0)
    return knn(vectors.where((F.size(column) == len(q)) & near), query, k, id_column, column)
