"""The test tables seen as index tables, for Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.chunking import chunk_by_lines


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A table with fewer bytes than this for each core may lie in fewer row groups than there are cores.
SPREAD_BYTES = 32 << 20


def spread(rows: DataFrame, key: str) -> DataFrame:
    """rows on all cores by a key, if their table is too small to be so already; else as they are, without a shuffle.

    A small Parquet file is often one row group, and so one task. The size is
    Spark's own estimate, so nothing is read for it.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(cores, key) if size < SPREAD_BYTES * cores else rows


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents for work on their texts."""
    return spread(read(spark, sf_dir, "documents"), "doc_id")


def files(spark: SparkSession, sf_dir: str, content: bool = False) -> DataFrame:
    """documents as files: a project per source."""
    d = documents(spark, sf_dir) if content else read(spark, sf_dir, "documents")
    path = F.concat("lang", F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    columns = [F.col("doc_id").alias("file_id"), F.substring("source", 4, 9).cast("long").alias("project_id"), path.alias("path"), F.col("lang").alias("language"), F.octet_length("text").cast("long").alias("size_bytes")]
    return d.select(*columns, *([F.col("text").alias("content")] if content else []))


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.substring("source", 4, 9).cast("long").alias("project_id"), F.col("source").alias("name"), F.concat(F.lit("/work/"), "source").alias("path")).distinct()


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line chunks of documents with chunk_id = file_id * 1000 + ord."""
    c = chunk_by_lines(files(spark, sf_dir, content=True))
    return c.withColumn("chunk_id", F.col("file_id") * 1000 + F.col("ord"))


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as chunks with symbols: one per part, in a file per brand."""
    p = read(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("chunk_id"), F.col("p_size").cast("long").alias("file_id"), F.regexp_replace("p_name", " ", "_").alias("symbol"), F.substring_index("p_type", " ", 1).alias("symbol_kind"), F.col("p_size").alias("start_line"), (F.col("p_size") + 5).alias("end_line"))


def symbol_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.col("p_size").cast("long").alias("file_id"), F.lit(1).cast("long").alias("project_id"), F.concat(F.lit("src/mod_"), F.col("p_size").cast("string"), F.lit(".rs")).alias("path")).distinct()


def definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as definitions: a name per customer, a file per ten customers."""
    o = read(spark, sf_dir, "orders").where("o_orderkey % 8 = 0")
    return o.select(F.col("o_orderkey").alias("definition_id"), F.expr("o_custkey div 10").alias("file_id"), F.concat(F.lit("fn_"), (F.col("o_custkey") % 200).cast("string")).alias("name"), F.lower("o_orderstatus").alias("kind"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderpriority")).alias("scope"), (F.col("o_orderkey") % 500).cast("int").alias("start_line"), (F.col("o_orderkey") % 500 + 9).cast("int").alias("end_line"))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as calls."""
    o = read(spark, sf_dir, "orders").where("o_orderkey % 8 <> 0")
    return o.select(F.col("o_orderkey").alias("call_id"), F.expr("o_custkey div 10").alias("file_id"), F.concat(F.lit("fn_"), (F.col("o_custkey") % 200).cast("string")).alias("caller_name"), F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderpriority")).alias("caller_scope"), F.concat(F.lit("fn_"), (F.col("o_orderkey") % 211).cast("string")).alias("callee_name"), (F.col("o_orderkey") % 500).cast("int").alias("line_number"))


def call_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer")
    return c.select(F.expr("c_custkey div 10").alias("file_id")).distinct().select("file_id", (F.col("file_id") % 3).alias("project_id"), F.concat(F.lit("lib/f"), F.col("file_id").cast("string"), F.lit(".go")).alias("path"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("turn_id"), "role", F.col("text").alias("content"))


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as file changes."""
    return read(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 50).alias("project_id"), F.concat(F.lit("f"), (F.col("user_id") % 400).cast("string"), F.lit(".py")).alias("file_path"), F.when(F.col("event_id") % 7 == 0, "delete").otherwise("modify").alias("event_type"), F.col("ts").alias("queued_at"))


# the same as SQL

FILES = "SELECT doc_id AS file_id, CAST(substr(source, 4) AS BIGINT) AS project_id, lang || '/' || source || '/' || doc_id || '.txt' AS path, lang AS language, CAST(strlen(text) AS BIGINT) AS size_bytes, text AS content FROM documents"
PROJECTS = "SELECT DISTINCT CAST(substr(source, 4) AS BIGINT) AS project_id, source AS name, '/work/' || source AS path FROM documents"


def lines_sql(column: str) -> str:
    """A list of lines, as lodestone.functions.text.lines has them."""
    parts = f"string_split(coalesce({column}, ''), chr(10))"
    return f"list_transform(CASE WHEN {parts}[-1] = '' THEN {parts}[1:len({parts}) - 1] ELSE {parts} END, lambda x: regexp_replace(x, '\\r$', ''))"


CHUNKS = f"""SELECT file_id * 1000 + CAST(s // 55 AS BIGINT) AS chunk_id, file_id, project_id, path, language, CAST(s + 1 AS INTEGER) AS start_line, CAST(least(s + 60, n) AS INTEGER) AS end_line, array_to_string(l[s + 1:s + 60], chr(10)) AS content
FROM (SELECT *, unnest(range(0, greatest(n - 6, 0) + 1, 55)) AS s FROM (SELECT *, len(l) AS n FROM (SELECT file_id, project_id, path, language, {lines_sql('content')} AS l FROM files_) WHERE len(l) > 0))
WHERE regexp_matches(array_to_string(l[s + 1:s + 60], chr(10)), '\\S')"""
SYMBOLS = "SELECT p_partkey AS chunk_id, CAST(p_size AS BIGINT) AS file_id, replace(p_name, ' ', '_') AS symbol, split_part(p_type, ' ', 1) AS symbol_kind, p_size AS start_line, p_size + 5 AS end_line FROM part"
SYMBOL_FILES = "SELECT DISTINCT CAST(p_size AS BIGINT) AS file_id, CAST(1 AS BIGINT) AS project_id, 'src/mod_' || p_size || '.rs' AS path FROM part"
DEFINITIONS = "SELECT o_orderkey AS definition_id, o_custkey // 10 AS file_id, 'fn_' || (o_custkey % 200) AS name, lower(o_orderstatus) AS kind, CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END AS scope, CAST(o_orderkey % 500 AS INTEGER) AS start_line, CAST(o_orderkey % 500 + 9 AS INTEGER) AS end_line FROM orders WHERE o_orderkey % 8 = 0"
CALLS = "SELECT o_orderkey AS call_id, o_custkey // 10 AS file_id, 'fn_' || (o_custkey % 200) AS caller_name, CASE WHEN o_orderkey % 5 > 0 THEN o_orderpriority END AS caller_scope, 'fn_' || (o_orderkey % 211) AS callee_name, CAST(o_orderkey % 500 AS INTEGER) AS line_number FROM orders WHERE o_orderkey % 8 <> 0"
CALL_FILES = "SELECT DISTINCT c_custkey // 10 AS file_id, (c_custkey // 10) % 3 AS project_id, 'lib/f' || (c_custkey // 10) || '.go' AS path FROM customer"
TURNS = "SELECT conv_id AS session_id, turn AS turn_id, role, text AS content FROM conversations"
CHANGES = "SELECT event_id, user_id % 50 AS project_id, 'f' || (user_id % 400) || '.py' AS file_path, CASE WHEN event_id % 7 = 0 THEN 'delete' ELSE 'modify' END AS event_type, ts AS queued_at FROM events"
_ALL = {"files_": FILES, "projects_": PROJECTS, "chunks_": CHUNKS, "symbols_": SYMBOLS, "symbol_files_": SYMBOL_FILES, "definitions_": DEFINITIONS, "calls_": CALLS, "call_files_": CALL_FILES, "turns_": TURNS, "changes_": CHANGES}


def with_tables(sql: str) -> str:
    """The statement with the definitions of the tables it names (files_, chunks_, ...)."""
    import re

    need, todo = set(), [sql]
    while todo:
        text = todo.pop()
        for name in _ALL:
            if name not in need and re.search(rf"\b{name}\b", text):
                need.add(name)
                todo.append(_ALL[name])
    head = ", ".join(f"{n} AS ({_ALL[n]})" for n in _ALL if n in need)
    body = sql.lstrip()
    if not head:
        return f"WITH RECURSIVE {body[len('WITH '):]}" if body.startswith("WITH ") else sql
    return f"WITH RECURSIVE {head}, {body[len('WITH '):]}" if body.startswith("WITH ") else f"WITH RECURSIVE {head} {sql}"
