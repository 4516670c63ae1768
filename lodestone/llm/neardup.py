"""MinHash near-duplicates by SetSketch registers.

A text's set is its distinct k-word shingles. Its sketch has registers of
exponentially spaced truncated minima: for register i, the least value of an
exponential hash over the set, on a logarithmic scale of base BASE, truncated to
a byte. Sketches of parts merge by maximum; two registers agree with a chance a
little over the similarity. Some registers make a band; documents that share a
band, a bucket, are candidates. Similarity is estimated jointly from the counts
of registers that are greater, less and equal, with both set sizes known, by
maximum likelihood; candidates far under the threshold (SIGMAS standard errors)
are dropped by it, all others are verified on their full sets.

Texts with equal sets are one class, represented by its smallest doc_id. In a
bucket every member is compared with one pivot; what verifies is linked, and
most buckets then lie in one component and are settled. In those that do not,
each member outside the bucket's largest component, a straggler, is compared
with all members of other components. Members are packed into blocks of bounded
size for that, sketches side by side, so a task compares blocks in numpy and
only pairs that may reach the threshold become rows, each in the first band it
shares; the best of each straggler and component go first, and what they link
need not be compared again. So a group of any size takes a linear number of rows
as long as it holds together, and no link is given up: a pair that shares a band
is compared, or its documents are connected already. The chance that a pair at
the threshold t shares none of n bands of r registers is (1 - t^r)^n; r is the
largest that keeps it under MISS. Components are found by joins, later ones over
the components so far and not the documents; neither links nor fingerprints ever
reach the driver. A step's tables are deleted once nothing reads them.

Nulls and texts without words have no set and are linked with nothing. Rows that
share a doc_id are one document: its set is that of the text of least hash, and
all of them get its component, each with its own n_shingles. A null doc_id takes
the component of its text's class, if it has one. Repeated rows are repeated in
the result; keep_one leaves one of them. Empty tables give no rows; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Steps, compacted, prepare
from .graph import components, roots
from .hashing import in_blocks, mix, shingles, word_hashes

#: Registers of a sketch: all make bands, and all serve the estimate.
REGISTERS = 640
#: The most that a pair at the threshold may be missed with, by bands and again by the estimate.
MISS = 1e-6
#: With these, registers of sets of up to a billion shingles fit in a byte.
BASE, RATE, TOP = 1.1, 20.0, 255
SIGMAS = 4.75  # the normal tail beyond it is MISS
#: Bits of a bucket's key below the number of its band.
KEY_BITS = 53
#: Mean numbers of members and of stragglers in a block.
BLOCK, STRAGGLERS = 256, 64
_SEEDS = np.random.Generator(np.random.PCG64(7)).integers(1, 2**32, (2, REGISTERS), np.uint32)
_SEEDS[0] |= np.uint32(1)


def sketch(items: np.ndarray) -> np.ndarray:
    """The registers of a set of 64-bit hashes."""
    low = (items >> np.uint64(32)).astype(np.uint32)
    least = np.full(REGISTERS, np.uint32(0xFFFFFFFF))
    for a in range(0, len(low), 128):
        block = np.multiply(low[a : a + 128, None], _SEEDS[0][None, :])
        block += _SEEDS[1]
        np.minimum(least, block.min(axis=0), out=least)
    # the minimum of exponential hashes of rate RATE, truncated on a scale of base BASE
    h = -np.log1p(-(least + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(h) / np.log(BASE)), 0, TOP).astype(np.uint8)


def band_rows(threshold: float) -> int:
    """The most registers a band can have if pairs at the threshold are to share one but for a chance of MISS."""
    return max(r for r in range(1, 33) if r == 1 or (1 - threshold**r) ** (REGISTERS // r) <= MISS)


def likelihood_estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, steps: int = 40) -> np.ndarray:
    """Joint maximum-likelihood similarity of pairs of sketches (rows of a and b) of sets of na and nb items."""
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - more - less
    u, v = na / (na + nb), nb / (na + nb)
    p = lambda x: -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def score(j: np.ndarray) -> np.ndarray:
        up, down = p(u - v * j), p(v - u * j)
        return more * np.log(up) + less * np.log(down) + same * np.log(np.maximum(1 - up - down, 1e-12))

    lo, hi = np.zeros(len(u)), np.minimum(u / v, v / u)
    ratio = (np.sqrt(5) - 1) / 2
    for _ in range(steps):  # the log-likelihood is unimodal: golden section
        x, y = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        left = score(x) > score(y)
        hi, lo = np.where(left, y, hi), np.where(left, lo, x)
    return (lo + hi) / 2


def _sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    for first, _, block in in_blocks(column.to_pylist()):
        words, counts = word_hashes(block)
        ends = np.cumsum(counts)
        for z, n in zip(ends, counts):
            yield shingles(words[z - n : z], k)


def sketched(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, a hash of the text, n_shingles, the digest of the set and the sketch."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digests, kept = [], [], []
            for s in _sets(batch.column(2), k):
                n.append(len(s))
                digests.append(np.array([mix(s, 11).sum(), mix(s, 12).sum()], np.uint64).tobytes() if len(s) else None)
                kept.append(sketch(s).tobytes() if len(s) else None)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(kept, pa.binary())], ["doc_id", "hash", "n_shingles", "digest", "sketch"])

    rows = compacted(docs.select("doc_id", F.xxhash64("text").alias("hash"), "text"))
    return rows.mapInArrow(run, f"doc_id {id_type}, hash long, n_shingles long, digest binary, sketch binary")


def _cut(percent: int) -> float:
    """Estimates from here on may be of pairs that reach the threshold."""
    t = percent / 100
    return t - SIGMAS * float(np.sqrt(t * (1 - t) / REGISTERS))


def _estimated(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """pairs(a, b) that may reach the threshold, with their estimate."""
    id_type = pairs.schema["a"].dataType.simpleString()
    r = reps.select("doc_id", "n_shingles", "sketch")
    both = pairs.join(r.toDF("a", "na", "ra"), "a").join(r.toDF("b", "nb", "rb"), "b").select("a", "b", "na", "nb", "ra", "rb")
    least = _cut(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = (batch.column(c).to_numpy().astype(float) for c in (2, 3))
            if not len(na):
                continue
            ra, rb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(len(na), REGISTERS) for c in (4, 5))
            j = likelihood_estimate(ra, rb, na, nb)
            # sizes alone bound the similarity exactly
            keep = (j >= least) & (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(j)], ["a", "b", "j"]).filter(pa.array(keep))

    return both.mapInArrow(run, f"a {id_type}, b {id_type}, j double")


def _straggling(rest: DataFrame, reps: DataFrame, rows: int, percent: int, best_only: bool) -> DataFrame:
    """Pairs that may reach the threshold among rest(key, v, label): of each bucket's stragglers with members of other components.

    a, b, their labels la and lb, the estimate j. ``best_only``: of each straggler
    and block, only the most similar member of every component; more says that
    there were others.
    """
    id_type = rest.schema["v"].dataType.simpleString()
    per_label = rest.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c"))
    per_key = per_label.groupBy("key").agg(F.sum("c").alias("n"), F.max_by("label", "c").alias("main"), F.max("c").alias("most")).where("most < n")
    full = rest.join(per_key, "key").join(reps.select(F.col("doc_id").alias("v"), F.col("n_shingles").alias("size"), "sketch"), "v")

    def blocks(side: DataFrame, mean: int, count: str, names: list[str]) -> DataFrame:
        slot = F.pmod(F.xxhash64("v"), F.ceil(F.col(count) / mean))
        member = F.collect_list(F.struct("v", "label", "size", "sketch"))
        return side.groupBy("key", slot.alias("_slot")).agg(member.alias("x")).select("key", *[F.col(f"x.{c}").alias(n) for c, n in zip(("v", "label", "size", "sketch"), names)])

    few = blocks(full.where("label <> main").withColumn("s", F.col("n") - F.col("most")), STRAGGLERS, "s", ["sv", "sl", "sn", "sr"])
    all_ = blocks(full, BLOCK, "n", ["mv", "ml", "mn", "mr"])
    both = few.join(all_, "key").select(F.shiftright("key", KEY_BITS).cast("int").alias("at"), "sv", "sl", "sn", "sr", "mv", "ml", "mn", "mr")
    least = _cut(percent)
    numbers = lambda c, i: c[i].values.to_numpy(zero_copy_only=False)
    names = ["a", "b", "la", "lb", "j", "more"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(0).to_pylist()
            cols = [batch.column(c) for c in range(1, 9)]
            for i in range(batch.num_rows):
                sv, sl, sn, mv, ml, mn = (numbers(cols[c], i) for c in (0, 1, 2, 4, 5, 6))
                sr, mr = (np.frombuffer(b"".join(cols[c][i].as_py()), np.uint8).reshape(-1, REGISTERS) for c in (3, 7))
                bands = mr[:, : REGISTERS // rows * rows].reshape(len(mr), -1, rows)
                for v, label, n, r in zip(sv, sl, sn, sr):
                    apart = np.flatnonzero((ml != label) & (100 * np.minimum(mn, n) >= percent * np.maximum(mn, n)))
                    if not len(apart):
                        continue
                    # registers agree at least as often as the sets' similarity
                    apart = apart[(mr[apart] == r).sum(axis=1) >= least * REGISTERS]
                    shared = (bands[apart] == r[: bands.shape[1] * rows].reshape(-1, rows)).all(axis=2)
                    apart = apart[shared.argmax(axis=1) == at[i]]
                    if not len(apart):
                        continue
                    j = likelihood_estimate(np.broadcast_to(r, (len(apart), REGISTERS)), mr[apart], np.full(len(apart), float(n)), mn[apart].astype(float))
                    apart, j = apart[j >= least], j[j >= least]
                    more = np.zeros(len(apart), bool)
                    if best_only and len(apart):
                        order = np.argsort(-j, kind="stable")
                        _, first, times = np.unique(ml[apart][order], return_index=True, return_counts=True)
                        apart, j, more = apart[order[first]], j[order[first]], times > 1
                    swap, other, theirs = mv[apart] < v, mv[apart], ml[apart]
                    columns = [np.where(swap, other, v), np.where(swap, v, other), np.where(swap, theirs, label), np.where(swap, label, theirs), j, more]
                    yield pa.record_batch([pa.array(c) for c in columns], names)

    return both.mapInArrow(run, f"a {id_type}, b {id_type}, la {id_type}, lb {id_type}, j double, more boolean")


def _verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """pairs(a, b, la, lb) whose full sets reach the threshold: 100 * intersection >= percent * union."""
    id_type = pairs.schema["a"].dataType.simpleString()
    both = pairs.select("a", "b", "la", "lb").join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b").select("a", "b", "la", "lb", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(_sets(batch.column(4), k), _sets(batch.column(5), k)):
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield batch.select(["a", "b", "la", "lb"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, f"a {id_type}, b {id_type}, la {id_type}, lb {id_type}")


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    found = _grouped(docs, shingle_words, percent)
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
    return found.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def _grouped(docs: DataFrame, shingle_words: int, percent: int) -> DataFrame:
    """doc_id, hash, n_shingles, component_id and stands (whether its text is the one that stands for its id) of every row."""
    spark = docs.sparkSession
    prepare(spark)
    rows, steps = band_rows(percent / 100), Steps(spark)
    all_rows = steps.put(sketched(docs, shingle_words), "sketches")
    # of rows that share an id, the one of least hash stands for it; of classes of equal sets, the least id
    ids = all_rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.struct("hash", "digest")).alias("own"))
    ids = steps.put(ids.select("doc_id", "own.hash", "own.digest"), "ids")
    classes = steps.put(ids.where("digest IS NOT NULL").groupBy("digest").agg(F.min(F.struct("doc_id", "hash")).alias("rep")).select("digest", "rep.doc_id", "rep.hash"), "classes")
    reps = all_rows.where("digest IS NOT NULL").join(classes.select("doc_id", "hash"), ["doc_id", "hash"], "left_semi").dropDuplicates(["doc_id"])
    reps = steps.put(reps.select("doc_id", "hash", "n_shingles", "sketch"), "representatives")
    bands = reps.select(F.col("doc_id").alias("v"), "sketch", F.explode(F.sequence(F.lit(0), F.lit(REGISTERS // rows - 1))).alias("at"))
    hashed = F.shiftrightunsigned(F.xxhash64(F.expr(f"substring(sketch, at * {rows} + 1, {rows})")), 64 - KEY_BITS)
    members = bands.select((F.shiftleft(F.col("at").cast("long"), KEY_BITS) + hashed).alias("key"), "v")
    heads = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("pivot")).where("n > 1").drop("n")
    buckets = steps.put(members.join(heads, "key"), "buckets")
    wanted = reps.select("doc_id", "hash").join(buckets.select(F.col("v").alias("doc_id")).distinct(), "doc_id", "left_semi")
    texts = docs.where("doc_id IS NOT NULL").select("doc_id", F.xxhash64("text").alias("hash"), "text").join(wanted, ["doc_id", "hash"], "left_semi").dropDuplicates(["doc_id"])
    texts = steps.put(texts.select("doc_id", "text"), "texts")
    labels: DataFrame | None = None  # v, label of all that are linked with a smaller one

    def labelled(pairs: DataFrame) -> DataFrame:
        """pairs(a, b) with their components la and lb, if these are two."""
        if labels is None:
            return pairs.withColumns({"la": F.col("a"), "lb": F.col("b")})
        out = pairs.join(labels.toDF("a", "la"), "a", "left").join(labels.toDF("b", "lb"), "b", "left")
        return out.withColumns({"la": F.coalesce("la", "a"), "lb": F.coalesce("lb", "b")}).where("la <> lb")

    def link(pairs: DataFrame, name: str) -> bool:
        """Verifies pairs of different components and joins the components of those that hold."""
        nonlocal labels
        found = steps.put(_verified(pairs, texts, shingle_words, percent), name)
        if found.isEmpty():
            return False
        moved = components(found.select(F.col("la").alias("a"), F.col("lb").alias("b"))).toDF("label", "to")
        before, labels = labels, moved.where("label <> to")
        if before is not None:
            labels = labels.union(before.join(moved, "label", "left").select("v", F.coalesce("to", "label")))
        labels = steps.put(labels.toDF("v", "label"), "labels")
        if before is not None:
            steps.drop(before)
        steps.drop(found)
        return True

    def rest() -> DataFrame:
        """The buckets' members but their pivots, which have met all others."""
        out = buckets.where("v <> pivot").select("key", "v")
        return out.withColumn("label", F.col("v")) if labels is None else out.join(labels, "v", "left").select("key", "v", F.coalesce("label", "v").alias("label"))

    pairs = buckets.where("v <> pivot").select(F.col("pivot").alias("a"), F.col("v").alias("b")).distinct()
    likely = steps.put(_estimated(pairs, reps, percent), "likely")
    # first the most similar partner of each document: one smaller id each, so paths end at their components' least
    best = likely.groupBy("b").agg(F.max_by("a", "j").alias("a")).select("a", "b", F.col("a").alias("la"), F.col("b").alias("lb"))
    parents = steps.put(_verified(best, texts, shingle_words, percent).select(F.col("b").alias("v"), F.col("a").alias("label")), "parents")
    if not parents.isEmpty():
        labels = steps.put(roots(parents), "labels")
    # then whatever is still apart
    link(labelled(likely.select("a", "b")).dropDuplicates(["a", "b"]), "links")
    # stragglers: the best member of each component
    nearest = steps.put(_straggling(rest(), reps, rows, percent, best_only=True), "nearest")
    link(nearest.dropDuplicates(["a", "b"]), "near")
    # and, where there are more pairs between components that are still apart, all of these
    left = steps.put(labelled(nearest.where("more").select("a", "b").distinct()).select(F.explode(F.array("la", "lb")).alias("label")).distinct(), "left")
    if not left.isEmpty():
        link(_straggling(rest().join(left, "label", "left_semi"), reps, rows, percent, best_only=False).dropDuplicates(["a", "b"]), "last")
    # an id's class, and for rows without an id that of their digest
    keys = ids.join(classes.select("digest", F.col("doc_id").alias("rep")), "digest", "left").select("doc_id", F.lit(None).cast("binary").alias("_digest"), F.col("hash").alias("_own"), "rep")
    keys = keys.union(classes.select(F.lit(None).cast(ids.schema["doc_id"].dataType), "digest", F.lit(None).cast("long"), "doc_id"))
    if labels is not None:
        keys = keys.join(labels.toDF("rep", "_label"), "rep", "left").withColumn("rep", F.coalesce("_label", "rep")).drop("_label")
    digest = F.when(F.col("doc_id").isNull(), F.col("digest"))
    out = all_rows.select("doc_id", "hash", "n_shingles", digest.alias("_d")).alias("r").join(keys.alias("k"), F.col("r.doc_id").eqNullSafe(F.col("k.doc_id")) & F.col("_d").eqNullSafe(F.col("_digest")), "left")
    out = out.select("r.doc_id", "hash", "n_shingles", F.coalesce("rep", "r.doc_id").alias("component_id"), F.coalesce(F.col("hash") == F.col("_own"), F.lit(True)).alias("stands"))
    out = steps.put(out, "components")
    steps.keep(out)
    return out


def keep_one(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each component: that of the doc_id which names it. Rows without an id all stay."""
    found = _grouped(docs, shingle_words, percent)
    kept = found.where("doc_id = component_id AND stands").select(F.col("doc_id").alias("_kept_id"), F.col("hash").alias("_kept_hash")).distinct()
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    same = (F.col("row.doc_id") == F.col("_kept_id")) & (F.xxhash64("row.text") == F.col("_kept_hash"))
    out = rows.join(kept, same, "left_semi").select("row.*").dropDuplicates(["doc_id"])
    return out.unionByName(docs.where("doc_id IS NULL"))
