"""Mixing sources to target weights by blocks (DataFrame functions only).

Each source's words, its documents in a seeded order, form one stream that is
packed into blocks of one fixed length. A source's target says how many of its
blocks the mix draws. For every output shard, the number of blocks it takes of
each source is drawn: multinomial over the shards, given the source's total. The
counts decide the slots: a shard owns so many consecutive slot numbers of the
source, and a slot number becomes a block number by a pseudorandom permutation
(a Feistel network on a grid just larger than the number of blocks, walked until
it lands inside; a new key for each pass through the source). Slots and the
pieces of documents in each block are then joined by block number. The last slot
takes a block's leading words, so that targets are met to the word but for a
short last block.

Targets: weights repeat over the sources in code-point order, null last, and
share ``share`` of all words; a target stops at ``cap`` times its source and
the excess goes to the others by weight (closed form: sources sorted by size
over weight, the capped ones first). A block is drawn at most ``cap`` times.

Source totals, counts and slots are DataFrames; only one row per source goes
through a single window. Positions in a stream are offsets of hash buckets
plus a sum in the bucket, so a source with a third of the words is spread out.
Nulls: null texts have no words; null sources are one source; rows without
words are kept with nothing taken. Repeated rows are separate rows. Texts of any
length are cut at block ends, never shortened. An empty table gives no rows; extra
columns, whatever their names, are ignored or, with texts, kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, Steps, text_of, top_bits, word_count

BLOCK_WORDS = 1024
SOURCE_BITS = 10
OUTPUT_SHARDS = 64
SLOT_RUN = 1 << 12
#: What a row is known by: two hashes of its id and text, and its number among rows alike.
ROW = ["_h", "_g", "_again"]


def permuted(index: Column, size: Column, key: Column) -> Column:
    """A pseudorandom permutation of 0 .. size - 1, keyed, computed for one index.

    Rounds add hashes of one coordinate to the other on a grid of wide x high
    cells. Cells from size on, fewer than a row of them, are walked out of: a walk
    meets each of them once at most, so it always ends.
    """
    wide = F.ceil(F.sqrt(size)).cast("long")
    high = F.ceil(size / wide).cast("long")

    def once(x: Column) -> Column:
        a, b = F.pmod(x, wide), F.floor(x / wide).cast("long")
        for r in (0, 2):
            a = F.pmod(a + F.pmod(F.xxhash64(b, key, F.lit(r)), wide), wide)
            b = F.pmod(b + F.pmod(F.xxhash64(a, key, F.lit(r + 1)), high), high)
        return b * wide + a

    def walked(first: Column) -> Column:
        outside = F.when(first >= size, F.sequence(F.lit(1).cast("long"), wide * high - size)).otherwise(F.array().cast("array<bigint>"))
        return F.aggregate(outside, first, lambda x, _: F.when(x < size, x).otherwise(once(x)))

    return F.transform(F.array(once(index)), walked)[0]


def source_targets(rows: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """One row per source: source_size, target, the block length and count, and the slots to draw."""
    every = Window.partitionBy()
    s = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    s = s.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).cast("double"))
    s = s.withColumns({"_all": F.sum("source_size").over(every) * share, "_most": F.col("source_size") * cap})
    order = Window.orderBy(F.col("_most") / F.col("_w"), F.col("source").isNull(), "source")
    capped = F.coalesce(F.sum("_most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_w = F.sum("_w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    s = s.withColumn("_rate", (F.col("_all") - capped) / open_w)
    # the first source whose cap is not reached at its rate ends the capped ones
    fits = F.when(F.col("_most") / F.col("_w") >= F.col("_rate"), F.struct((F.col("_most") / F.col("_w")).alias("m"), F.col("_rate").alias("r")))
    s = s.withColumn("_rate", F.min(fits).over(every)["r"])
    s = s.withColumn("target", F.coalesce(F.least(F.col("_most"), F.col("_rate") * F.col("_w")), F.col("_most")))
    return s.select("source", "source_size", "target")


def with_blocks(sources: DataFrame, block_words: int) -> DataFrame:
    s = sources.where("source_size > 0").withColumn("_len", F.expr(f"CAST(ceil(source_size / ceil(source_size / {block_words}D)) AS BIGINT)"))
    s = s.withColumns({"_blocks": F.expr("(source_size + _len - 1) div _len"), "_take": F.round("target").cast("long")})
    s = s.withColumns({"_passes": F.expr("_take div source_size"), "_rest": F.expr("_take % source_size")})
    return s.withColumns({"_part": F.expr("_rest % _len"), "_slots": F.expr("_passes * _blocks + (_rest + _len - 1) div _len")})


def _runs(rows: DataFrame, count: str) -> DataFrame:
    """rows for every run of SLOT_RUN of 0 .. count - 1, and the numbers of each run as ``_i``: few bytes, but many numbers."""
    runs = rows.where(f"{count} > 0").withColumn("_run", F.explode(F.expr(f"sequence(0L, ({count} - 1) div {SLOT_RUN})")))
    # with the number given, Spark does not put them all into one task
    runs = runs.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "source", "_run")
    return runs.withColumn("_i", F.explode(F.expr(f"sequence(_run * {SLOT_RUN}, least({count}, (_run + 1) * {SLOT_RUN}) - 1)")))


def draw_counts(blocks: DataFrame, seed: int, shards: int = OUTPUT_SHARDS) -> DataFrame:
    """One row per source and output shard with blocks: their number ``_n``, multinomial over the shards, and how many are in shards before."""
    drawn = F.pmod(F.xxhash64(F.lit(seed + 1), "source", "_i"), F.lit(shards)).cast("int")
    counts = _runs(blocks, "_slots").groupBy("source", drawn.alias("output_shard")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("source").orderBy("output_shard").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0)))


def draw_slots(blocks: DataFrame, seed: int, shards: int = OUTPUT_SHARDS) -> DataFrame:
    """One row per slot: source, slot, turn (pass through the source), output shard, block, and words taken from the block's start."""
    known = blocks.select(F.struct(F.col("source").isNull(), F.coalesce("source", F.lit(""))).alias("_k"), "_slots", "_blocks", "_len", "_part")
    counts = draw_counts(blocks, seed, shards).withColumn("_k", F.struct(F.col("source").isNull(), F.coalesce("source", F.lit(""))))
    slots = _runs(counts.join(known, "_k"), "_n").withColumn("slot", F.col("_first") + F.col("_i"))
    slots = slots.withColumn("turn", F.expr("slot div _blocks"))
    block = permuted(F.expr("slot % _blocks"), F.col("_blocks"), F.xxhash64(F.lit(seed), "source", "turn"))
    last = (F.col("slot") == F.col("_slots") - 1) & (F.col("_part") > 0)
    return slots.select("source", "slot", "turn", "output_shard", block.alias("block"), F.when(last, F.col("_part")).otherwise(F.col("_len")).alias("words"))


def _hashes(seed: int) -> dict[str, Column]:
    text = text_of()
    return {"_h": F.xxhash64(F.lit(seed), "doc_id", text), "_g": F.xxhash64(F.lit(seed + 1), text, "doc_id")}


def _again() -> Column:
    return F.row_number().over(Window.partitionBy("_h", "_g").orderBy(F.col("source").isNull(), "source"))


def placed(docs: DataFrame, seed: int, steps: Steps) -> DataFrame:
    """Each row's identity, source, words and first position in its source's stream."""
    rows = docs.select("doc_id", "source", word_count(text_of()).alias("size"), *[c.alias(n) for n, c in _hashes(seed).items()])
    rows = rows.withColumn("_again", _again())
    rows = rows.withColumns({"_b": top_bits(F.col("_h"), SOURCE_BITS), "_null": F.col("source").isNull(), "_src": F.coalesce("source", F.lit(""))})
    rows = steps.put(rows, "sized")
    stratum = ["_null", "_src"]
    before = Window.partitionBy(*stratum).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy(*stratum, "_b").agg(F.sum("size").alias("_c")).select(*stratum, "_b", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*stratum, "_b").orderBy("_h", "_g", "_again").rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(offsets, [*stratum, "_b"]).withColumn("_start", F.col("_before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    out = steps.put(out.select("doc_id", *ROW, "source", "size", "_start"), "placed")
    steps.drop(rows)
    return out


def pieces(docs: DataFrame, weights: tuple[int, ...], share: float, cap: float, block_words: int, seed: int, shards: int = OUTPUT_SHARDS) -> tuple[DataFrame, DataFrame]:
    """(rows with source_size and target; what the slots take of rows: output_shard, turn, and words a .. z - 1 of the row)."""
    steps = Steps(docs.sparkSession)
    rows = placed(docs, seed, steps)
    sources = steps.put(source_targets(rows, weights, share, cap), "sources")
    rows = rows.withColumn("_k", F.struct(F.col("source").isNull(), F.coalesce("source", F.lit(""))))
    keyed = sources.withColumn("_k", F.struct(F.col("source").isNull(), F.coalesce("source", F.lit("")))).drop("source")
    rows = rows.join(keyed, "_k").drop("_k")
    same = ["_null", "_src", "block"]
    null_safe = {"_null": F.col("source").isNull(), "_src": F.coalesce("source", F.lit(""))}
    slots = draw_slots(with_blocks(sources, block_words), seed, shards).withColumns(null_safe).select(*same, "output_shard", "turn", "words")
    length = F.expr(f"CAST(ceil(source_size / ceil(source_size / {block_words}D)) AS BIGINT)")
    inside = rows.where("size > 0").withColumn("_len", length).withColumn("block", F.explode(F.expr("sequence(_start div _len, (_start + size - 1) div _len)")))
    inside = inside.withColumns({"_lo": F.expr("greatest(_start, block * _len)"), "_hi": F.expr("least(_start + size, (block + 1) * _len)"), **null_safe})
    # slots come from one row per source, by which Spark would take them for small enough to broadcast
    drawn = inside.join(slots.hint("merge"), same).withColumn("_end", F.expr("least(_hi, block * _len + words)")).where("_end > _lo")
    return rows, drawn.select(*ROW, "size", "output_shard", "turn", (F.col("_lo") - F.col("_start")).alias("a"), (F.col("_end") - F.col("_start")).alias("z"))


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, block_words: int = BLOCK_WORDS, seed: int = 6, shards: int = OUTPUT_SHARDS) -> DataFrame:
    """Of every row how many of its words the mix takes, and into which output shards.

    doc_id, source, size, source_size, target, taken, and output_shards: structs of
    output_shard and the words that go there, by shard.
    """
    rows, drawn = pieces(docs, weights, share, cap, block_words, seed, shards)
    by_shard = drawn.groupBy(*ROW, "output_shard").agg(F.sum(F.col("z") - F.col("a")).alias("words"))
    words = by_shard.groupBy(*ROW).agg(F.sum("words").alias("taken"), F.sort_array(F.collect_list(F.struct("output_shard", "words"))).alias("output_shards"))
    out = rows.join(words, ROW, "left")
    none = F.array().cast("array<struct<output_shard:int,words:bigint>>")
    return out.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("output_shards", none).alias("output_shards"))


def mixed_texts(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, block_words: int = BLOCK_WORDS, seed: int = 6, shards: int = OUTPUT_SHARDS, shard_column: str = "output_shard") -> DataFrame:
    """The mix itself: the columns of docs and the output shard, a row per document, output shard and pass.

    A column of docs named like shard_column is replaced, all others are kept.
    A row that takes the whole document keeps its text as it is; of others, the
    words taken are joined by blanks in their order. n_chars, if there, follows.
    Texts are shuffled once.
    """
    _, drawn = pieces(docs, weights, share, cap, block_words, seed, shards)
    spans = drawn.groupBy(*ROW, "size", "output_shard", "turn").agg(F.sort_array(F.collect_list(F.struct("a", "z"))).alias("spans"), F.sum(F.col("z") - F.col("a")).alias("words"))
    plan = spans.groupBy("_h", "_g").agg(F.collect_list(F.struct("_again", "output_shard", "turn", "spans", (F.col("words") == F.col("size")).alias("whole"))).alias("_all"))
    full = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), "source", *[c.alias(n) for n, c in _hashes(seed).items()])
    # rows alike are numbered after the join, by its own keys: no shuffle more
    out = full.join(plan.hint("merge"), ["_h", "_g"]).withColumn("_again", _again())
    text = text_of("row.text")

    def made(words: Column) -> Column:
        return F.transform("_mine", lambda p: F.when(p["whole"], text).otherwise(F.array_join(F.flatten(F.transform(p["spans"], lambda s: F.slice(words, (s["a"] + 1).cast("int"), (s["z"] - s["a"]).cast("int")))), " ")))

    out = out.withColumn("_mine", F.sort_array(F.filter("_all", lambda p: p["_again"] == F.col("_again"))))
    # the words of a text are found once, and only if something less than the whole is taken
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    some = F.transform(F.array(words), made)[0]
    texts = F.when(F.forall("_mine", lambda p: p["whole"]), F.transform("_mine", lambda p: text)).otherwise(some)
    out = out.select("row", F.explode(F.arrays_zip(texts.alias("text"), F.col("_mine.output_shard").alias("shard"))).alias("new"))
    new = {"text": F.col("new.text"), shard_column: F.col("new.shard")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("new.text").cast(docs.schema["n_chars"].dataType)
    columns = docs.columns + [shard_column] * (shard_column not in docs.columns)
    return out.select(*[(new[c] if c in new else F.col("row").getField(c)).alias(c) for c in columns])
