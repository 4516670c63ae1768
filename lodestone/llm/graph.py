"""Connected components of an edge table by label propagation and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Steps


def components(edges: DataFrame) -> DataFrame:
    """(v, label) for every vertex of edges(a, b): the smallest vertex its component holds.

    In a round, each vertex takes the smallest label of its neighbours, the vertex
    that was its label takes that one too, and both then take the label of their
    label. Hooking the old label keeps long chains of any order short: a round for
    each doubling of their length or two. Labels only fall, and rounds go on until
    none does. Every round's labels are written to the shared folder, and the
    round before is deleted. Vertices with very many edges only meet in joins whose
    large side Spark can split and in minima that are taken before the shuffle.
    """
    steps = Steps(edges.sparkSession)
    both = steps.put(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct().toDF("v", "u"), "edges")
    labels = steps.put(both.groupBy("v").agg(F.least(F.min("u"), F.first("v")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("v").alias("u"), F.col("label").alias("l")), "u").groupBy("v").agg(F.min("l").alias("l"))
        seen = labels.select("v", "label").join(near, "v").select("v", "label", F.least("label", "l").alias("l"))
        own = F.struct("v", "l", F.col("label").alias("old"))
        hook = F.struct(F.col("label").alias("v"), "l", F.lit(None).cast(labels.schema["label"].dataType).alias("old"))
        moved = seen.select(F.explode(F.when(F.col("l") < F.col("label"), F.array(own, hook)).otherwise(F.array(own))).alias("m")).select("m.*")
        nearer = moved.groupBy("v").agg(F.min("l").alias("label"), F.max("old").alias("old"))
        jump = labels.select(F.col("v").alias("label"), F.col("label").alias("far"))
        new = nearer.join(jump, "label", "left").select("v", F.least("label", F.coalesce("far", "label")).alias("label"), "old")
        new = steps.put(new, "labels")
        steps.drop(labels)
        labels = new
        if new.where("label <> old").isEmpty():
            steps.drop(both)
            return new.select("v", "label")


def roots(parents: DataFrame) -> DataFrame:
    """(v, label) for every vertex of parents(v, label), where each has one parent smaller than itself: the end of its path.

    Pointer jumping: the number of rounds is the logarithm of the longest path.
    """
    steps = Steps(parents.sparkSession)
    labels = steps.put(parents, "parents")
    while True:
        far = labels.select(F.col("v").alias("label"), F.col("label").alias("far"))
        new = labels.select("v", "label").join(far, "label", "left").select("v", F.coalesce("far", "label").alias("label"), F.col("far").isNotNull().alias("moved"))
        new = steps.put(new, "roots")
        steps.drop(labels)
        labels = new
        if new.where("moved").isEmpty():
            return new.select("v", "label")
