"""The corpus pipeline: quality classifier, near duplicates, secrets, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that run() writes
as Parquet and reads again as the next stage's docs. All stages but the last
return the columns of documents:

1. quality: documents that the classifier rejects go.
2. near_duplicates: of each group of near duplicates (five-word shingles,
   similarity 0.8 or more) one document stays.
3. secrets: spans that hold secrets are replaced in the texts.
4. mixing: the sources' words are drawn to their target weights; a document
   becomes a row per copy, with the words that copy holds.
5. packing: token pieces of all rows, with their places in the sequences.

Each stage is a function of all its rows, and their awkward cases are those of its
operator. Null texts have no words: the classifier scores them as empty, they are
nobody's near duplicate, hold no secret, and the mix takes nothing of them. Rows
without an id stay until the mix. Of repeated rows, and of rows that share an id, one
is left by near_duplicates. Without labels of both classes, quality keeps all.
Ties are broken by ids and seeded hashes, so a run can be repeated. An empty table
stays empty. Extra columns, whatever their names, go along to the packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import mixing, neardup, packing, quality, secrets
from lodestone.llm.common import Steps


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_texts(docs).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack),
]
#: Not expressible in SQL: a trained network, sketches and byte-level BPE. Tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, steps, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), Steps(spark), None
    for name, stage in STAGES[:-1]:
        docs = steps.put(stage(spark, docs, sf_dir), name)
        if last is not None:
            steps.drop(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
