"""The table store: Parquet tables in versioned snapshots with an atomic pointer.

A snapshot is a folder ``v<n>`` with one Parquet table per name; ``CURRENT``
names the one that readers use. A writer builds the next snapshot beside it,
reusing unchanged tables by reference, and swaps the pointer by renaming a file,
so readers see all tables of a commit or none. One writer at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SCHEMAS = {
    "projects": "project_id bigint, name string, path string, created_at timestamp, last_indexed_at timestamp",
    "files": "file_id bigint, project_id bigint, path string, content_hash string, language string, size_bytes bigint, chunk_count int, indexed_at timestamp",
    "chunks": "chunk_id bigint, file_id bigint, project_id bigint, content string, symbol string, symbol_kind string, start_line int, end_line int, language string, suspicious boolean",
    "embeddings": "chunk_id bigint, project_id bigint, embedding array<float>",
    "postings": "term string, chunk_id bigint, col string, tf int, positions array<int>",
    "doc_stats": "chunk_id bigint, len bigint",
    "definitions": "definition_id bigint, file_id bigint, project_id bigint, name string, kind string, scope string, start_line int, end_line int, signature string",
    "function_calls": "call_id bigint, file_id bigint, project_id bigint, caller_name string, caller_scope string, callee_name string, line_number int, callee_definition_id bigint",
    "sessions": "session_id string, project_name string, created_at timestamp",
    "turns": "turn_id bigint, session_id string, role string, content string, sources string, created_at timestamp",
    "reindex_queue": "project_id bigint, file_path string, event_type string, queued_at timestamp",
}
#: What goes with a row of the first table when it is deleted: (child, key), in order.
CASCADE = {"projects": [("files", "project_id"), ("chunks", "project_id"), ("embeddings", "project_id"), ("definitions", "project_id"), ("function_calls", "project_id")], "files": [("chunks", "file_id"), ("definitions", "file_id"), ("function_calls", "file_id")], "chunks": [("embeddings", "chunk_id"), ("postings", "chunk_id"), ("doc_stats", "chunk_id")], "sessions": [("turns", "session_id")]}


def latest_per_key(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """One row per key, the last by order: an aggregate with map-side combine, no window."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*key, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*rows.columns)


def upserted(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """old with new's rows in the place of those that share their key; of several new ones, one."""
    fresh = new.dropDuplicates(key)
    return old.join(fresh.select(*key), key, "left_anti").unionByName(fresh)


def without(rows: DataFrame, gone: DataFrame, key: str | list[str]) -> DataFrame:
    key = [key] if isinstance(key, str) else key
    return rows.join(gone.select(*key).distinct(), key, "left_anti")


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.root))

    # the pointer: a JSON file of table name -> folder

    def _tables(self) -> dict[str, str]:
        at = self._path(f"{self.root}/CURRENT")
        if not self._fs.exists(at):
            return {}
        stream = self._fs.open(at)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _point(self, tables: dict[str, str]) -> None:
        part, at = self._path(f"{self.root}/CURRENT.{uuid.uuid4().hex}"), self._path(f"{self.root}/CURRENT")
        out = self._fs.create(part, True)
        out.write(bytearray(json.dumps(tables).encode()))
        out.close()
        # FileContext's rename replaces the old pointer in one step
        jvm = self.spark.sparkContext._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri())
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        context.rename(self._fs.makeQualified(part), self._fs.makeQualified(at), options)

    def version(self) -> int:
        return max([0, *(int(p.split("/")[0][1:]) for p in self._tables().values())])

    def table(self, name: str) -> DataFrame:
        where = self._tables().get(name)
        if where is None:
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.root}/{where}")

    def commit(self, changes: dict[str, DataFrame]) -> int:
        """Writes the changed tables as the next version; all become visible together. Returns the version."""
        tables, number = self._tables(), self.version() + 1
        for name, rows in changes.items():
            where = f"v{number}/{name}"
            columns = [c.split()[0] for c in SCHEMAS[name].split(", ")]
            out = rows.select(*columns)
            if name == "postings":
                out = out.sort("term", "chunk_id")  # a query reads its terms' row groups only
            out.write.mode("overwrite").parquet(f"{self.root}/{where}")
            tables[name] = where
        self._point(tables)
        return number

    def update(self, name: str, change: Callable[[DataFrame], DataFrame]) -> int:
        return self.commit({name: change(self.table(name))})

    def delete(self, name: str, gone: DataFrame, key: str) -> int:
        """Deletes rows by key and what hangs on them, table by table."""
        changes: dict[str, DataFrame] = {}

        def drop(table: str, keys: DataFrame, column: str) -> None:
            rows = changes.get(table, self.table(table))
            lost = rows.join(keys.select(column).distinct(), column, "left_semi")
            changes[table] = without(rows, keys, column)
            for child, child_key in CASCADE.get(table, []):
                if child_key in lost.columns:
                    drop(child, lost.select(child_key), child_key)

        drop(name, gone, key)
        return self.commit(changes)
