"""URL filters by a Bloom filter cascade.

Every url yields candidate keys: each suffix of its host at a label boundary,
followed by each prefix of its path that has the length of some rule's path.
Rules and the block list are listed keys of that form, so a url is decided by
membership of its candidates. The key universe, all distinct candidates of the
table, is known in advance; level 0 of a cascade holds the listed keys, level 1
the unlisted ones that pass level 0, level 2 the listed ones that pass level 1,
and so on until no key passes wrongly. Membership is then exact for every key
of the universe, and looking it up needs no join: the filters travel with the task.

Their size follows the list, which the caller holds in memory, and not the table:
the rate of level 0 is the share of listed keys, halved, so level 1 is expected to
hold half as many keys as are listed, and each later level fewer; level 0 has
1.45 log2(2 unlisted / listed) bits a key, under 100 for any table. The keys'
hashes are seeded until no listed key shares its hash with an unlisted one.

Bits are set in parts: each partition sets its own keys' bits, the parts are
merged by word with bit_or. Urls that are null or without ``://`` have an empty
host and path, no candidates, and are allowed. Urls of any length are judged whole.
Repeated rows are judged one by one; empty tables give no rows; other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Steps, ascii_lower, prepare

# The rules, as (verdict, host and path).
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Hosts that are blocked, subdomains included, where no rule speaks.
BLOCKED_SITES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
BLOCKED_HOSTS = tuple(f"{site}.example.{top}" for site in BLOCKED_SITES for top in ("com", "net", "org"))
NONE, ALLOW, BLOCK = 0, 1, 2


def host_and_path(url: Column) -> tuple[Column, Column]:
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    u = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(u, parts, 1)), F.regexp_extract(u, parts, 2)


def candidates(host: Column, path: Column, lengths: list[int]) -> Column:
    """Keys of a url: host suffixes times path prefixes of the given lengths."""
    labels = F.split(host, r"\.", -1)
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."))
    paths = F.array_compact(F.array(*[F.when(F.length(path) >= n, F.left(path, F.lit(n))) for n in lengths]))
    keys = F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.concat(h, p))))
    return F.when(F.length(host) > 0, keys).otherwise(F.array().cast("array<string>"))


def _mixed(h: np.ndarray, salt: int) -> np.ndarray:
    """A hash of keys with a salt (splitmix finaliser)."""
    with np.errstate(over="ignore"):
        z = h.view(np.uint64) + np.uint64((salt + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


@dataclass
class Level:
    bits: int
    hashes: int
    words: np.ndarray  # uint64

    def positions(self, h: np.ndarray, level: int) -> np.ndarray:
        # each hash is mixed on its own: in a filter of a few hundred bits, sums of two would meet too often
        return np.stack([_mixed(h, 64 * level + i) for i in range(self.hashes)], axis=1) % np.uint64(self.bits)

    def has(self, h: np.ndarray, level: int) -> np.ndarray:
        p = self.positions(h, level)
        return ((self.words[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1)).all(axis=1)


class Cascade:
    """Exact membership for the keys of the universe it was built over."""

    def __init__(self) -> None:
        self.levels: list[Level] = []

    def passes(self, h: np.ndarray) -> np.ndarray:
        ok = np.ones(len(h), bool)
        for k, level in enumerate(self.levels):
            ok[ok] = level.has(h[ok], k)
        return ok

    def listed(self, h: np.ndarray) -> np.ndarray:
        out, open_ = np.zeros(len(h), bool), np.arange(len(h))
        for k, level in enumerate(self.levels):
            hit = level.has(h[open_], k)
            out[open_[~hit]] = k % 2 == 1
            open_ = open_[hit]
        out[open_] = len(self.levels) % 2 == 1
        return out


def build_cascade(keys: DataFrame, later_fp: float = 0.1) -> Cascade:
    """The cascade over keys(_h long, listed boolean), the distinct universe, where no hash is both listed and not."""
    cascade = Cascade()
    counts = {r.listed: r["count"] for r in keys.groupBy("listed").count().collect()}
    first_fp = min(0.5, max(2.0**-64, 0.5 * counts.get(True, 0) / max(1, counts.get(False, 0))))

    def members(k: int) -> DataFrame:
        def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array(cascade.passes(b.column(0).to_numpy(zero_copy_only=False))))

        mine = keys.where("listed" if k % 2 == 0 else "NOT listed").select("_h")
        return mine.mapInArrow(kept, "_h long") if k else mine

    for k in count():
        mine = members(k)
        n = mine.count()
        if not n:
            break
        fp = first_fp if k == 0 else later_fp
        level = Level(max(64, int(np.ceil(n * 1.4427 * np.log2(1 / fp)))), min(64, max(1, round(np.log2(1 / fp)))), np.zeros(0, np.uint64))

        def parts(batches: Iterator[pa.RecordBatch], level: Level = level, k: int = k) -> Iterator[pa.RecordBatch]:
            for b in batches:
                p = level.positions(b.column(0).to_numpy(zero_copy_only=False), k).ravel()
                w, at = np.unique(p >> np.uint64(6), return_inverse=True)
                bits = np.zeros(len(w), np.uint64)
                np.bitwise_or.at(bits, at, np.uint64(1) << (p & np.uint64(63)))
                yield pa.record_batch([pa.array(w.astype(np.int64)), pa.array(bits.view(np.int64))], ["w", "bits"])

        merged = mine.mapInArrow(parts, "w long, bits long").groupBy("w").agg(F.bit_or("bits").alias("bits")).toArrow()
        level.words = np.zeros(level.bits // 64 + 1, np.uint64)
        level.words[merged["w"].to_numpy()] = merged["bits"].to_numpy().view(np.uint64)
        cascade.levels.append(level)
    return cascade


def hashed(key: Column | str, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), key)


def apart(keys: DataFrame, seed: int) -> bool:
    """Whether no listed key of keys(key, listed) has the hash of an unlisted one."""
    mine = keys.where("listed").select(hashed("key", seed).alias("_h"))
    return keys.where("NOT listed").select(hashed("key", seed).alias("_h")).join(mine, "_h", "left_semi").isEmpty()


def filter_urls(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, blocked_hosts: tuple[str, ...] = BLOCKED_HOSTS) -> DataFrame:
    """page_id, host, path, rule and verdict of every url. Of the rules that fit, the longest decides; of equally long ones, that of the longer host."""
    spark = pages.sparkSession
    prepare(spark)
    lengths = sorted({len(r) - r.index("/") for _, r in rules} | ({0} if blocked_hosts else set()))
    host, path = host_and_path(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("_keys", candidates(F.col("host"), F.col("path"), lengths))
    steps = Steps(spark)
    universe = steps.put(urls.select(F.explode("_keys").alias("key")).distinct(), "universe")
    lists = {ALLOW: [r for v, r in rules if v == "allow"], BLOCK: [r for v, r in rules if v == "block"] + list(blocked_hosts)}
    tagged = {}
    for side, keys in lists.items():
        listed = spark.createDataFrame([(k,) for k in keys], "key string")
        both = universe.select("key", F.lit(False).alias("l")).union(listed.select("key", F.lit(True))).groupBy("key").agg(F.max("l").alias("listed"))
        tagged[side] = steps.put(both, f"keys{side}")
    seed = next(n for n in count() if all(apart(t, n) for t in tagged.values()))
    cascades = {side: build_cascade(t.select(hashed("key", seed).alias("_h"), "listed")) for side, t in tagged.items()}
    steps.keep()

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(b.schema.get_field_index("_hashes"))
            h = column.flatten().to_numpy(zero_copy_only=False)
            code = np.zeros(len(h), np.int8)
            for side, cascade in cascades.items():
                code[cascade.listed(h)] = side
            codes = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())]).astype(np.int32)), pa.array(code))
            yield pa.record_batch([*(b.column(c) for c in ("page_id", "host", "path", "_keys")), codes], ["page_id", "host", "path", "_keys", "_codes"])

    id_type = pages.schema["page_id"].dataType.simpleString()
    found = urls.withColumn("_hashes", F.transform("_keys", lambda k: hashed(k, seed))).mapInArrow(look_up, f"page_id {id_type}, host string, path string, _keys array<string>, _codes array<tinyint>")
    return _judged(found)


def _judged(found: DataFrame) -> DataFrame:
    hits = F.filter(F.arrays_zip(F.col("_keys").alias("key"), F.col("_codes").alias("code")), lambda x: x["code"] > 0)
    ruled = F.filter(hits, lambda x: F.contains(x["key"], F.lit("/")))
    best = F.array_max(F.transform(ruled, lambda x: F.struct(F.length(x["key"]), F.instr(x["key"], "/"), x["key"].alias("key"), x["code"].alias("code"))))
    rows = found.select("page_id", "host", "path", best.alias("_best"), F.exists(hits, lambda x: (x["code"] == BLOCK) & ~F.contains(x["key"], F.lit("/"))).alias("_listed"))
    blocked = F.when(F.col("_best").isNotNull(), F.col("_best.code") == BLOCK).otherwise(F.col("_listed"))
    return rows.select("page_id", "host", "path", F.col("_best.key").alias("rule"), F.when(blocked, "block").otherwise("allow").alias("verdict"))
