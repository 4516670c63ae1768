"""Approximate nearest neighbours by vantage-point trees, one per shard.

Vectors are scaled to unit length, where the chord distance is a metric that
orders by cosine. Rows are dealt to shards of about SHARD_ROWS by a hash; a
shard's tree splits its rows at the median distance from a vantage point down
to leaves of LEAF rows. A block of queries walks the tree together: at a node,
each query first enters the side it lies on and then the other one unless the
triangle inequality, with the gap to the boundary multiplied by ``relax``,
shows that it holds nothing nearer. relax = 1 is exact search; larger factors
prune more. Ties at the boundary are always entered.

A shard's tree is built once, in one task, and stored with its vectors. Queries
go past the stored trees in groups of at most GROUP_BYTES, broadcast one group
after the other, so no vector is copied per query; a task keeps the k best of each
query over all the trees it reads, prunes each tree by what those before have given,
and only these k are shuffled and merged by a window per query. Scores are
recomputed from the original vectors in double precision, pair by pair, so equal
vectors score equally and ties go to the smaller id.

Vectors that are null, zero, of another length than most, or hold a null or
non-finite component take no part. Repeated rows are one. Other rows that share an
id are candidates each, but never for a query of that id; those of equal score to
a query are one neighbour and take one of its k places. Other columns are ignored.
Empty tables give no rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Steps, prepare

SHARD_ROWS, LEAF, QUERY_BLOCK = 8192, 128, 4096
#: Of queries that travel at once.
GROUP_BYTES = 32 << 20
RELAX = 5.0
TIE = 1e-12


@dataclass
class Node:
    rows: np.ndarray | None = None  # of a leaf
    vantage: int = -1
    bound: float = 0.0  # inside: distance <= bound
    inside: Node | None = None
    outside: Node | None = None


def build(unit: np.ndarray, rows: np.ndarray, g: np.random.Generator, leaf: int = LEAF) -> Node:
    if len(rows) <= leaf:
        return Node(rows=rows)
    vantage = int(g.choice(rows))
    d = chord(unit[rows] @ unit[vantage])
    half = len(rows) // 2
    order = np.argpartition(d, half)
    bound = float(d[order[:half]].max())
    return Node(vantage=vantage, bound=bound, inside=build(unit, rows[order[:half]], g, leaf), outside=build(unit, rows[order[half:]], g, leaf))


def chord(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * cosine, 0))


class Search:
    """The k nearest rows for each of a block of queries; one pass over one tree."""

    def __init__(self, unit: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int, relax: float, floor: np.ndarray | None = None):
        """floor: cosines that each query's k best of other shards reach already."""
        self.floor = np.full(len(queries), -np.inf) if floor is None else floor
        self.unit, self.ids, self.queries, self.query_ids, self.k, self.relax = unit, ids, queries, query_ids, k, relax
        self.best = np.full((len(queries), k), -np.inf)  # cosines, best first
        self.rows = np.full((len(queries), k), -1, np.int64)
        self.scanned = 0
        self.repeats = len(np.unique(ids)) < len(ids)

    def distinct(self, cs: np.ndarray, rs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of rows of one id with equal cosines the first, behind k empty places."""
        cs, rs = cs[rs >= 0], rs[rs >= 0]
        order = np.lexsort((-cs, self.ids[rs]))
        cs, rs = cs[order], rs[order]
        again = (np.diff(self.ids[rs]) == 0) & (np.abs(np.diff(cs)) <= TIE)
        first = np.concatenate([[True], ~again])[: len(rs)]
        return np.concatenate([np.full(self.k, -np.inf), cs[first]]), np.concatenate([np.full(self.k, -1), rs[first]])

    def leaf(self, rows: np.ndarray, q: np.ndarray) -> None:
        c = self.queries[q] @ self.unit[rows].T
        self.scanned += c.size
        c[self.ids[rows][None, :] == self.query_ids[q][:, None]] = -np.inf
        some = (c.max(axis=1) >= np.maximum(self.best[q, -1], self.floor[q]) - TIE).nonzero()[0]
        for i in some:
            cs = np.concatenate([self.best[q[i]], c[i]])
            rs = np.concatenate([self.rows[q[i]], np.where(c[i] > -np.inf, rows, -1)])  # no row of the query's own id
            if self.repeats:
                cs, rs = self.distinct(cs, rs)
            # cosines within TIE are equal here; of equal ones the smaller id is nearer
            near = np.flatnonzero(cs >= np.partition(cs, -self.k)[-self.k] - TIE)
            ids = np.where(rs[near] >= 0, self.ids[rs[near]], np.iinfo(np.int64).max)
            top = near[np.lexsort((ids, -np.round(cs[near], 11)))[: self.k]]
            self.best[q[i]], self.rows[q[i]] = cs[top], rs[top]

    def walk(self, node: Node, q: np.ndarray) -> None:
        if not len(q):
            return
        if node.rows is not None:
            return self.leaf(node.rows, q)
        d = chord(self.queries[q] @ self.unit[node.vantage])
        gap = d - node.bound  # to the boundary; negative inside
        within = gap <= 0
        self.walk(node.inside, q[within])
        self.walk(node.outside, q[~within])
        # the other side holds nothing nearer than the gap
        reach = chord(np.maximum(np.maximum(self.best[q, -1], self.floor[q]) - TIE, -1)) + 1e-9
        other = np.abs(gap) * self.relax <= reach
        self.walk(node.outside, q[within & other])
        self.walk(node.inside, q[~within & other])


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of pairs of rows, each computed on its own."""
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.sqrt((m * m).sum(axis=1))[:, None]


@dataclass
class Shard:
    ids: np.ndarray  # ascending
    vectors: np.ndarray
    tree: Node

    @staticmethod
    def of(ids: np.ndarray, vectors: np.ndarray, seed: int = 8) -> Shard:
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], vectors[order]
        return Shard(ids, vectors, build(_unit(vectors), np.arange(len(ids)), np.random.default_rng(seed)))

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, relax: float, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(query index, row, cosine, distances computed) of the k best per query."""
        s = Search(_unit(self.vectors), self.ids, _unit(queries), query_ids, k, relax, floor)
        s.walk(self.tree, np.arange(len(queries)))
        q, at = np.nonzero(s.rows >= 0)
        rows = s.rows[q, at]
        return q, rows, _exact(queries[q], self.vectors[rows]), s.scanned


class Best:
    """The k best of each query over any number of shards."""

    def __init__(self, query_ids: np.ndarray, queries: np.ndarray, k: int, relax: float):
        self.query_ids, self.queries, self.k, self.relax = query_ids, queries, k, relax
        self.found = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)  # query, id, score
        self.floor = np.full(len(queries), -np.inf)
        self.scanned = 0

    def add(self, shard: Shard) -> None:
        q, rows, score, scanned = shard.search(self.query_ids, self.queries, self.k, self.relax, self.floor)
        self.scanned += scanned
        q, ids, score = (np.concatenate(x) for x in zip(self.found, (q, shard.ids[rows], score)))
        order = np.lexsort((ids, -score, q))
        q, ids, score = q[order], ids[order], score[order]
        new = np.concatenate([[True], (np.diff(q) != 0) | (np.diff(ids) != 0) | (np.diff(score) != 0)])[: len(q)]
        q, ids, score = q[new], ids[new], score[new]
        starts = np.searchsorted(q, q)
        place = np.arange(len(q)) - starts
        keep = place < self.k
        last = place == self.k - 1
        self.floor[q[last]] = score[last]
        self.found = q[keep], ids[keep], score[keep]


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """id and v, the rows that take part."""
    v = F.col(vector_column).cast("array<double>")
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), v.alias("v")).where("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.where(fine)


def nearest(vectors: DataFrame, k: int = 5, every: int = 50, relax: float = RELAX, id_column: str = "vec_id", vector_column: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for every row whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    prepare(spark)
    steps = Steps(spark)
    rows = steps.put(usable(vectors, id_column, vector_column).dropDuplicates(["id", "v"]), "vectors")
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("id") % every == 0).alias("q")).orderBy(F.desc("n"), "d").limit(1).collect()
    width, n, asked = (sizes[0].d, sizes[0].n, sizes[0].q) if sizes else (1, 0, 0)
    shards, groups = max(1, -(-n // shard_rows)), max(1, -(-8 * width * asked // GROUP_BYTES))
    rows = rows.where(F.size("v") == width)

    def stored(left: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"shard": [pickle.dumps(Shard.of(left["id"].to_numpy(), np.stack(left["v"].to_numpy())))]})

    trees = steps.put(rows.groupBy(F.pmod(F.xxhash64("id", "v"), F.lit(shards))).applyInPandas(stored, "shard binary"), "trees")
    queries = rows.where(F.col("id") % every == 0).withColumn("group", F.pmod(F.xxhash64("id"), F.lit(groups)))
    found = []
    for group in range(groups):
        got = queries.where(F.col("group") == group).select("id", "v").toArrow().sort_by("id")
        ids = got["id"].to_numpy()
        sent = spark.sparkContext.broadcast((ids, got["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), width)))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, v = sent.value
            best = [Best(ids[a : a + QUERY_BLOCK], v[a : a + QUERY_BLOCK], k, relax) for a in range(0, len(ids), QUERY_BLOCK)]
            for batch in batches:
                for blob in batch.column(0):
                    shard = pickle.loads(blob.as_py())
                    for b in best:
                        b.add(shard)
            for b in best:
                q, near, score = b.found
                yield pa.record_batch([pa.array(b.query_ids[q]), pa.array(near), pa.array(score)], ["query_id", "vec_id", "score"])

        found.append(steps.put(trees.mapInArrow(run, "query_id long, vec_id long, score double"), "found"))
        sent.destroy()
    steps.keep(*found)
    every_group = found[0]
    for f in found[1:]:
        every_group = every_group.union(f)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return every_group.dropDuplicates().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
