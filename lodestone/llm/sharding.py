"""Sharding by proportional stratified interleaving (DataFrame functions only).

Rows are shuffled within their source by a seeded hash and ranked; row r of n
gets the fraction (r - 1/2) / n. Sorting all rows by that fraction deals the
sources evenly through the order, so cutting the order into equal runs gives
every shard the mixture of the whole, with row counts at most one apart.

No rank is taken in one task. A rank is a bucket's offset plus the row number
in the bucket: within a source, buckets are the leading bits of the hash (a
source with a third of all rows is spread over all of them); over all rows,
they are equal slices of the fraction. Only the offsets, one row per bucket,
are summed by a window. Rows travel as key, hash, size and checksum; texts
are never shuffled.

Nulls: a null source is a source of its own, a null text has no bytes, a null
key is hashed like any other value. Repeated rows are dealt one by one, ties
of the hash are ordered by key, checksum and size. An empty table gives no rows.
Extra columns are ignored. Equal texts are not kept together by this method.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import staged, text_of, top_bits

SOURCE_BITS = 10
SLICES = 4096


def interleaved(rows: DataFrame, source: str, hashed: str, ties: list[Column]) -> DataFrame:
    """rows with ``_g``, the place of each row in the interleaved order from 0, and ``_n``, the number of rows."""
    rows = rows.withColumns({"_null": F.col(source).isNull(), "_src": F.coalesce(F.col(source), F.lit("")), "_b": top_bits(F.col(hashed), SOURCE_BITS)})
    stratum = ["_null", "_src"]
    before = Window.partitionBy(*stratum).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy(*stratum, "_b").agg(F.count(F.lit(1)).alias("_c")).select(*stratum, "_b", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"), F.sum("_c").over(Window.partitionBy(*stratum)).alias("_of"))
    inside = Window.partitionBy(*stratum, "_b").orderBy(hashed, *ties)
    ranked = rows.join(offsets, [*stratum, "_b"]).withColumn("_f", (F.col("_before") + F.row_number().over(inside) - 0.5) / F.col("_of"))
    ranked = staged(ranked.withColumn("_slice", F.least(F.floor(F.col("_f") * SLICES), F.lit(SLICES - 1)).cast("int")).drop("_b", "_before", "_of"), "ranked")
    # at most SLICES rows, so one window over all of them and a broadcast are bounded
    starts = ranked.groupBy("_slice").agg(F.count(F.lit(1)).alias("_c"))
    starts = starts.select("_slice", F.coalesce(F.sum("_c").over(Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"), F.sum("_c").over(Window.partitionBy()).alias("_n"))
    inside = Window.partitionBy("_slice").orderBy("_f", "_null", "_src", hashed, *ties)
    return ranked.join(F.broadcast(starts), "_slice").withColumn("_g", F.col("_start") + F.row_number().over(inside) - 1).drop("_slice", "_start", "_f", "_null", "_src")


def shard_documents(docs: DataFrame, shards: int = 16, seed: int = 20) -> DataFrame:
    """doc_id, source, size, text_crc32, shard and slot of every row of docs."""
    text = text_of()
    rows = docs.select("doc_id", "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    rows = rows.withColumn("_h", F.xxhash64(F.lit(seed), "doc_id", "text_crc32"))
    placed = interleaved(rows, "source", "_h", [F.col("doc_id"), F.col("text_crc32"), F.col("size")])
    shard = F.expr(f"_g * {shards} div _n")
    return placed.withColumn("_s", shard).select("doc_id", "source", "size", "text_crc32", F.col("_s").cast("int").alias("shard"), (F.col("_g") - F.expr(f"(_s * _n + {shards - 1}) div {shards}")).cast("long").alias("slot"))
