"""Small documents with the awkward cases: nulls, blanks, ties, repeats, long texts, clashing column names."""

import random
import re
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(["the", "of", "And", "river", "stone", "Élan", "x1", "town,", "mill", "wheel"]) + rng.choice(["", "s", "ing", "ed"]) for _ in range(n))


def rows(n: int = 60, seed: int = 3) -> list[tuple]:
    rng, out = random.Random(seed), []
    for i in range(n):
        text = prose(rng, rng.randint(5, 300))
        out.append((i, text, "en", f"s{i % 4}" if i % 11 else None, len(text)))
    base = prose(rng, 200)
    for k in range(12):  # copies and near copies, a third of the table
        out += [(100 + k, base, "en", "s0", len(base)), (200 + k, base.replace("river", "river%d" % k, 1), "en", "s0", None)]
    long = prose(rng, 20_000)
    return out + [(300, None, None, "s1", None), (301, "", "en", "s1", 0), (302, " \n\t ", "en", None, 4), (303, "word", "en", "s2", 4), (304, long, "en", "s2", len(long)), (305, "two Words", "en", "s9", 9), (100, base, "en", "s0", len(base)), (None, base, "en", "s0", 1), (306, "\U0001f600 ünï \u2003 end", "en", "s3", 5)]


def documents(spark: SparkSession, data: list[tuple] | None = None, clash: bool = False) -> DataFrame:
    d = spark.createDataFrame(rows() if data is None else data, SCHEMA).repartition(3, "doc_id")
    if clash:
        for c in ("size", "shard", "slot", "rank", "score", "quality", "label", "media", "digest", "band", "kept", "block", "held_out", "source_size", "v", "n"):
            d = d.withColumn(c, F.lit("clash"))
    return d


def fold(i, n: int) -> int:
    return zlib.crc32(str(i).encode()) % n
