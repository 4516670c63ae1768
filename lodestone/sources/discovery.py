"""Discovery of source files below a folder, as a DataFrame."""

from __future__ import annotations

import os
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from lodestone.functions.language import language_of
from lodestone.operators.store_queries import MARKERS

from . import ignore
from .config import DEPENDENCY_DIRS, Config

BINARY_HEAD = 512
SKIPPED = ("node_modules", "target")


def _folder(root: str) -> str:
    base = root.rstrip("/").split("://")[-1]
    return base if base.startswith("/") else os.path.abspath(base)


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """path (relative), length and content of the files below root that are not hidden; content is read only where it is used."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    relative = F.regexp_replace(F.regexp_replace("path", r"^[a-z0-9]+:/*", "/"), "^" + re.escape(_folder(root)) + "/", "")
    return files.select(relative.alias("path"), "length", "content")


def hidden_files(root: str) -> list[tuple[str, int]]:
    """(relative path, length) of hidden files, and of files in hidden folders, below a mounted root: Spark's reader never lists these."""
    base, found = _folder(root), []
    for top, _, names in os.walk(base):
        below = os.path.relpath(top, base)
        for n in names:
            path = n if below == "." else f"{below}/{n}"
            if any(part.startswith((".", "_")) for part in path.split("/")) and not os.path.islink(os.path.join(top, n)):
                found.append((path, os.path.getsize(os.path.join(top, n))))
    return sorted(found)


def read_hidden(spark: SparkSession, root: str) -> DataFrame:
    """The hidden files in the columns of read_files; opened by the workers, so root must be mounted there."""
    base = _folder(root)

    def run(batches):
        for pdf in batches:
            contents = []
            for p in pdf["path"]:
                with open(os.path.join(base, p), "rb") as f:
                    contents.append(f.read())
            yield pdf.assign(content=pd.Series(contents, dtype=object))

    listed = spark.createDataFrame(hidden_files(root), "path string, length long")
    return listed.mapInPandas(run, "path string, length long, content binary")


def is_likely_binary(content: Column) -> Column:
    """Whether more than a tenth of the first 512 bytes are NUL; empty files are text, unreadable ones are not."""
    head = F.hex(F.substring(content, 1, BINARY_HEAD))
    n = F.octet_length(head) / 2
    # every byte is two digits; a mark between bytes keeps pairs in step
    nuls = F.regexp_count(F.regexp_replace(head, "(..)", "$1 "), F.lit("00 "))
    return F.when(content.isNull(), True).otherwise(nuls > F.floor(n / 10))


def ignore_rules(root: str, config: Config, everything: bool = False) -> list[ignore.Rule]:
    """The rules in force below root: nested .gitignore files, the configured globs, dependency folders, and the project's own ignore file."""
    names = [config.indexing.ignore_file] + ([] if everything else [".gitignore", ".ignore"])
    found = []
    for path, _ in hidden_files(root):
        base, _, name = path.rpartition("/")
        if name in names and (name != config.indexing.ignore_file or not base):
            with open(os.path.join(_folder(root), path), encoding="utf-8", errors="replace") as f:
                found.append((base + "/" if base else "", f.read()))
    rules = [] if everything else ignore.parse("\n".join(config.ignore_patterns + [d + "/" for d in DEPENDENCY_DIRS]))
    for base, text in sorted(found, key=lambda x: x[0].count("/")):
        rules += ignore.parse(text, base)
    return rules


def walk(spark: SparkSession, root: str, config: Config | None = None, everything: bool = False) -> DataFrame:
    """path, size_bytes, language and content of the files to index.

    By default hidden files, ignored ones, dependency folders, files over the
    size limit and binary ones are left out; ``everything`` keeps all but what
    the project's own ignore file, the size limit and the binary test exclude.
    Files without bytes are not listed; they would have no chunks.
    Sizes are compared in the source, so large files are never read.
    """
    config = config or Config()
    rules = ignore_rules(root, config, everything)

    @F.pandas_udf(BooleanType())
    def kept(paths: pd.Series) -> pd.Series:
        return paths.map(lambda p: not ignore.ignored(p, rules))

    most = config.indexing.max_file_size_bytes
    files = read_files(spark, root).where(F.col("length") <= most)
    if everything:
        files = files.unionByName(read_hidden(spark, root).where(F.col("length") <= most))
    files = files.where(kept(F.col("path")))
    return files.where(~is_likely_binary(F.col("content"))).select("path", F.col("length").alias("size_bytes"), language_of(F.col("path")).alias("language"), "content")


def with_text(files: DataFrame) -> DataFrame:
    """Files with a fingerprint and their content as text; content that is no UTF-8 becomes null and has no chunks."""
    return files.withColumns({"content_hash": F.sha2("content", 256), "content": F.try_validate_utf8(F.col("content").cast("string"))})


def is_project_directory(folder: str) -> bool:
    names = os.listdir(folder) if os.path.isdir(folder) else []
    return any(n.endswith(m.lstrip("*")) if "*" in m else n == m for m in MARKERS for n in names)


def scan_for_projects(folder: str, depth: int = 3) -> list[str]:
    """Project folders at most ``depth`` levels down; nothing below one is searched."""
    if is_project_directory(folder):
        return [folder]
    if depth == 0 or not os.path.isdir(folder):
        return []
    below = sorted(e.path for e in os.scandir(folder) if e.is_dir(follow_symlinks=False) and not e.name.startswith(".") and e.name not in SKIPPED)
    return [p for b in below for p in scan_for_projects(b, depth - 1)]
