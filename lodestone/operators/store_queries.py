"""Relational queries over the index tables: counts, patterns, symbols, files, call graph, sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions.text import like_escaped


def of_project(rows: DataFrame, project_id: int | str | None) -> DataFrame:
    return rows if project_id is None else rows.where(F.col("project_id") == project_id)


# counts


def file_count(files: DataFrame, project_id=None) -> DataFrame:
    return of_project(files, project_id).agg(F.count(F.lit(1)).alias("file_count"))


def chunk_count(chunks: DataFrame, files: DataFrame, project_id=None) -> DataFrame:
    mine = of_project(files, project_id).select("file_id")
    return (chunks if project_id is None else chunks.join(mine, "file_id", "left_semi")).agg(F.count(F.lit(1)).alias("chunk_count"))


def total_size(files: DataFrame, project_id=None) -> DataFrame:
    return of_project(files, project_id).agg(F.coalesce(F.sum("size_bytes"), F.lit(0)).cast("long").alias("total_size"))


def embedded_chunk_count(embeddings: DataFrame, chunks: DataFrame, files: DataFrame, project_id=None) -> DataFrame:
    rows = embeddings.join(chunks.select("chunk_id", "file_id"), "chunk_id").join(of_project(files, project_id).select("file_id"), "file_id")
    return rows.agg(F.count(F.lit(1)).alias("embedded_count"))


def call_graph_stats(definitions: DataFrame, calls: DataFrame, files: DataFrame, project_id=None) -> DataFrame:
    mine = of_project(files, project_id).select("file_id")
    both = definitions.select("file_id", F.lit(1).alias("d"), F.lit(0).alias("c")).union(calls.select("file_id", F.lit(0), F.lit(1)))
    return both.join(mine, "file_id", "left_semi").agg(F.coalesce(F.sum("d"), F.lit(0)).alias("definitions"), F.coalesce(F.sum("c"), F.lit(0)).alias("calls"))


def list_projects(projects: DataFrame, files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Projects by name with their file and chunk counts."""
    f = files.groupBy("project_id").agg(F.count(F.lit(1)).alias("file_count"))
    c = chunks.select("file_id").join(files.select("file_id", "project_id"), "file_id").groupBy("project_id").agg(F.count(F.lit(1)).alias("chunk_count"))
    out = projects.join(f, "project_id", "left").join(c, "project_id", "left").na.fill(0, ["file_count", "chunk_count"])
    return out.orderBy("name")


def language_stats(files: DataFrame, chunks: DataFrame, project_id=None) -> DataFrame:
    """Known languages with distinct files and chunks, most chunks first."""
    # chunks are counted per file before the join, so the join carries one row per file
    per_file = chunks.groupBy("file_id").agg(F.count(F.lit(1)).alias("n"))
    rows = of_project(files, project_id).where("language <> 'unknown'").join(per_file, "file_id", "left")
    out = rows.groupBy("language").agg(F.countDistinct("file_id").alias("file_count"), F.coalesce(F.sum("n"), F.lit(0)).alias("chunk_count"))
    return out.orderBy(F.desc("chunk_count"), "language")


# patterns of a project


def _top(rows: DataFrame, name: Column, limit: int | None, least: int = 0) -> DataFrame:
    out = rows.groupBy(name.alias("name")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > least).orderBy(F.desc("n"), "name")
    return out if limit is None else out.limit(limit)


def pattern_languages(files: DataFrame, project_id=None) -> DataFrame:
    return _top(of_project(files, project_id), F.col("language"), None)


def pattern_kinds(chunks: DataFrame, limit: int = 20) -> DataFrame:
    return _top(chunks.where("symbol_kind IS NOT NULL"), F.col("symbol_kind"), limit)


def pattern_prefixes(chunks: DataFrame, limit: int = 30) -> DataFrame:
    """Symbols up to their first underscore, where more than two agree; an empty one goes after the limit."""
    named = chunks.where("length(symbol) > 0")
    return _top(named, F.substring_index("symbol", "_", 1), limit, least=2).where("length(name) > 0")


def pattern_directories(files: DataFrame, project_id=None, limit: int = 20) -> DataFrame:
    """First segments of paths; the empty one goes after the limit."""
    return _top(of_project(files, project_id), F.substring_index("path", "/", 1), limit).where("length(name) > 0")


# symbols, files, definitions


def search_symbols(chunks: DataFrame, files: DataFrame, pattern: str, project_id=None, limit: int = 20, offset: int = 0) -> DataFrame:
    """Chunks whose symbol holds the pattern, taken literally and without regard to case."""
    mine = of_project(files, project_id).select("file_id", "path")
    hits = chunks.where(F.col("symbol").isNotNull() & F.col("symbol").ilike(like_escaped(pattern)))
    out = hits.join(mine, "file_id").select("chunk_id", "symbol", "symbol_kind", "path", "start_line", "end_line")
    out = out.orderBy("symbol", "chunk_id")
    return (out.offset(offset) if offset else out).limit(limit)


def file_view(chunks: DataFrame, files: DataFrame, path: str, project_id=None, start: int | None = None, end: int | None = None) -> DataFrame:
    """The chunks of a file by start line, those that overlap the range if both bounds are given."""
    rows = chunks.join(of_project(files, project_id).where(F.col("path") == path).select("file_id", "path"), "file_id")
    if start is not None and end is not None:
        rows = rows.where((F.col("end_line") >= start) & (F.col("start_line") <= end))
    return rows.select("path", "start_line", "end_line", "content").orderBy("start_line", "end_line")


def file_text(view: DataFrame) -> DataFrame:
    """A file view as one text."""
    parts = F.array_sort(F.collect_list(F.struct("start_line", "end_line", "content")))
    return view.groupBy("path").agg(F.array_join(F.transform(parts, lambda c: c["content"]), "\n").alias("content"))


def list_definitions(definitions: DataFrame, files: DataFrame, project_id=None, kind: str | None = None) -> DataFrame:
    rows = definitions if kind is None else definitions.where(F.col("kind") == kind)
    out = rows.join(of_project(files, project_id).select("file_id", "path"), "file_id")
    return out.select("name", "kind", "path", "start_line", "end_line", "scope").orderBy("path", "start_line", "name")


def find_callers(definitions: DataFrame, calls: DataFrame, files: DataFrame, name: str, project_id=None) -> DataFrame:
    """Definitions that call ``name``: the caller's definition in the same file; scopes must agree where both are known."""
    c = calls.where(F.col("callee_name") == name).select(F.col("caller_name").alias("name"), "caller_scope", "file_id")
    d = definitions.join(of_project(files, project_id).select("file_id", "path"), "file_id")
    on = [d["name"] == c["name"], d["file_id"] == c["file_id"], c["caller_scope"].isNull() | d["scope"].isNull() | (c["caller_scope"] == d["scope"])]
    return d.join(c, on).select(d["name"], "kind", "path", "start_line", "end_line", "scope").distinct().orderBy("path", "start_line", "name")


def find_callees(definitions: DataFrame, calls: DataFrame, files: DataFrame, name: str, project_id=None) -> DataFrame:
    """Definitions, in the project, of what ``name`` calls."""
    mine = of_project(files, project_id).select("file_id", "path")
    called = calls.where(F.col("caller_name") == name).join(mine.select("file_id"), "file_id", "left_semi").select(F.col("callee_name").alias("name")).distinct()
    return definitions.join(called, "name", "left_semi").join(mine, "file_id").select("name", "kind", "path", "start_line", "end_line", "scope").distinct().orderBy("path", "start_line", "name")


def resolve_calls(calls: DataFrame, definitions: DataFrame) -> DataFrame:
    """calls with callee_definition_id: a definition of the called name, one in the same file first, then the lowest id.

    Two aggregates and two joins on keys that are unique on the right; no window over all definitions of a name.
    """
    near = definitions.groupBy("file_id", F.col("name").alias("callee_name")).agg(F.min("definition_id").alias("_near"))
    any_ = definitions.groupBy(F.col("name").alias("callee_name")).agg(F.min("definition_id").alias("_any"))
    out = calls.drop("callee_definition_id").join(near, ["file_id", "callee_name"], "left").join(any_, "callee_name", "left")
    return out.withColumn("callee_definition_id", F.coalesce("_near", "_any")).drop("_near", "_any")


# projects


def project_of(directories: DataFrame, projects: DataFrame) -> DataFrame:
    """directories(dir) with the project whose path is the longest prefix at a path boundary, or null.

    Every directory has few ancestors: they are listed and looked up by equality, so no prefix join is needed.
    """
    parts = F.split("dir", "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    up = directories.select("dir", F.explode(ancestors).alias("path"))
    best = up.join(projects.select("project_id", "path"), "path").groupBy("dir").agg(F.max_by("project_id", F.length("path")).alias("project_id"))
    return directories.join(best, "dir", "left").select("dir", "project_id")


def project_directories(paths: DataFrame) -> DataFrame:
    """(dir, is_project) of paths(path): whether a directory holds a marker file."""
    rows = paths.select(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("dir"), F.element_at(F.split("path", "/"), -1).alias("name"))
    return rows.groupBy("dir").agg(F.max(is_marker(F.col("name"))).alias("is_project"))


# Files that mark a project's directory; a star stands for any beginning.
MARKERS = ["Cargo.toml", "package.json", "pyproject.toml", "setup.py", "requirements.txt", "go.mod", "pom.xml", "build.gradle", "build.gradle.kts", "Gemfile", "composer.json", "*.csproj", "*.sln", "mix.exs", ".git"]


def is_marker(name: Column) -> Column:
    exact = name.isin([m for m in MARKERS if "*" not in m])
    for m in MARKERS:
        if "*" in m:
            exact = exact | name.endswith(m.lstrip("*"))
    return exact


# sessions


def recent_turns(turns: DataFrame, n: int = 6) -> DataFrame:
    """The last n turns of every session, oldest first by ``place``.

    A session's turns are cut to n before they meet: by a window over the session, whose rank Spark limits map-side.
    """
    back = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("turn_id")))
    rows = turns.withColumn("_back", back).where(F.col("_back") <= n)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("session_id").orderBy("turn_id"))).drop("_back")
