"""The engine: index folders or tables of files, and answer questions about them."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import format_bytes
from lodestone.operators import fulltext, retrieval, store_queries, syntax, vector
from lodestone.operators.chunking import enrich, with_chunk_ids
from lodestone.operators.limits import RateLimited, TokenBucket
from lodestone.operators.models import EchoGenerator, Embedder, Generator, HashingEmbedder, OverlapReranker, Reranker, embedded, generated
from lodestone.operators.scan import with_scan
from lodestone.plans.search import reranked, search_and_merge, with_rows
from lodestone.sources import discovery
from lodestone.sources.config import Config
from lodestone.sources.store import Store, upserted, without


#: Bits of a file's id; a chunk's id has its place in the file below them.
FILE_BITS, PROJECT_BITS = 42, 40


class UnknownProject(KeyError):
    pass


@dataclass
class Answer:
    text: str
    sources: list[str]
    warned: bool  # the answer repeats the prompt's secret code


@dataclass
class IndexReport:
    indexed: int
    unchanged: int
    removed: int
    version: int


class Engine:
    """All operations on one store. Models are objects of the protocols in operators.models; offline stand-ins by default.

    Every table carries project_id, so a project's rows can be pruned, and a
    commit replaces all tables of a change at once.
    """

    def __init__(self, spark: SparkSession, root: str, config: Config | None = None, embedder: Embedder | None = None, reranker: Reranker | None = None, generator: Generator | None = None, limiter: TokenBucket | None = None):
        self.spark, self.config = spark, config or Config()
        self.store = Store(spark, root)
        self.embedder = embedder or HashingEmbedder(self.config.embedding.dimension)
        self.reranker = reranker or OverlapReranker()
        self.generator = generator or EchoGenerator()
        self.limiter = limiter or TokenBucket()

    # indexing

    def index(self, folder: str, name: str | None = None, force: bool = False, everything: bool = False) -> IndexReport:
        """Indexes a folder: new and changed files are chunked, embedded and stored, vanished ones removed."""
        found = discovery.with_text(discovery.walk(self.spark, folder, self.config, everything))
        return self.index_files(found, name or os.path.basename(folder.rstrip("/")), folder, force)

    def dry_run(self, folder: str, everything: bool = False) -> DataFrame:
        return discovery.walk(self.spark, folder, self.config, everything).select("path", "size_bytes", "language")

    def index_files(self, found: DataFrame, name: str, path: str, force: bool = False, partial: bool = False) -> IndexReport:
        """Indexes files(path, size_bytes, language, content, content_hash); ``partial``: files not listed stay."""
        s, now = self.store, F.current_timestamp()
        project_id = self._project_id(name, path)
        old = s.table("files")
        mine = old.where(F.col("project_id") == project_id)
        found = found.dropDuplicates(["path"])
        found = found.join(self._file_ids(found, old, project_id), "path").persist()
        try:
            # unchanged: same path and same fingerprint
            fresh = found if force else without(found, mine, ["path", "content_hash"])
            gone = mine.limit(0) if partial else mine.join(found.select("path"), "path", "left_anti")
            stale = mine.join(fresh.select("path"), "path", "left_semi").unionByName(gone)
            n_all, n_fresh, n_gone = found.count(), fresh.count(), gone.count()
            chunks = self._chunks(fresh, project_id)
            counts = chunks.groupBy("file_id").agg(F.count(F.lit(1)).cast("int").alias("chunk_count"))
            files = fresh.join(counts, "file_id", "left").select("file_id", F.lit(project_id).alias("project_id"), "path", "content_hash", "language", F.col("size_bytes").cast("long"), F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), now.alias("indexed_at"))
            stale_chunks = s.table("chunks").join(stale.select("file_id"), "file_id", "left_semi").select("chunk_id")
            text = enrich(F.col("path"), F.col("content"), F.col("symbol"), F.col("symbol_kind"), F.col("language"))
            vectors = chunks.join(fresh.select("file_id", "path"), "file_id").select("chunk_id", "project_id", embedded(text, self.embedder).alias("embedding"))
            made = fulltext.build_index(chunks.join(fresh.select("file_id", F.col("path").alias("file_path")), "file_id"))
            definitions, calls = syntax.extract_call_graph(fresh)
            definitions = definitions.withColumns({"project_id": F.lit(project_id), "definition_id": F.xxhash64("file_id", "name", "scope", "start_line")})
            calls = calls.withColumns({"project_id": F.lit(project_id), "call_id": F.xxhash64("file_id", "caller_name", "callee_name", "line_number")}).dropDuplicates(["call_id"])
            definitions = without(s.table("definitions"), stale, "file_id").unionByName(definitions)
            calls = without(s.table("function_calls"), stale, "file_id").drop("callee_definition_id").unionByName(calls)
            projects = s.table("projects").where(F.col("project_id") != project_id).unionByName(self._project_row(project_id, name, path))
            version = s.commit({
                "projects": projects,
                "files": without(old, stale, "file_id").unionByName(files),
                "chunks": without(s.table("chunks"), stale, "file_id").unionByName(chunks),
                "embeddings": without(s.table("embeddings"), stale_chunks, "chunk_id").unionByName(vectors),
                "postings": without(s.table("postings"), stale_chunks, "chunk_id").unionByName(made.postings),
                "doc_stats": without(s.table("doc_stats"), stale_chunks, "chunk_id").unionByName(made.doc_stats),
                "definitions": definitions,
                "function_calls": store_queries.resolve_calls(calls, definitions),
            })
        finally:
            found.unpersist()
        return IndexReport(n_fresh, n_all - n_fresh, n_gone, version)

    def _chunks(self, files: DataFrame, project_id: int) -> DataFrame:
        made = with_chunk_ids(syntax.chunk_files(files))
        made = with_scan(made, "content").withColumn("suspicious", F.col("scan.is_suspicious"))
        return made.join(files.select("file_id", "language"), "file_id").select("chunk_id", "file_id", F.lit(project_id).alias("project_id"), "content", "symbol", "symbol_kind", "start_line", "end_line", "language", "suspicious")

    def _file_ids(self, found: DataFrame, old: DataFrame, project_id: int) -> DataFrame:
        """(path, file_id): a known path keeps its id, a new one gets a hash, hashed again with a salt until no other file has it."""
        ids = old.where(F.col("project_id") == project_id).select("path", "file_id").join(found.select("path"), "path", "left_semi")
        todo, taken, salt = found.select("path").join(ids, "path", "left_anti"), old.select("file_id"), 0
        while True:
            hashed = F.xxhash64(F.lit(project_id), "path", F.lit(salt)).bitwiseAND((1 << FILE_BITS) - 1)
            won = todo.groupBy(hashed.alias("file_id")).agg(F.min("path").alias("path")).join(taken, "file_id", "left_anti").select("path", "file_id")
            ids, taken, todo = ids.unionByName(won), taken.unionByName(won.select("file_id")), todo.join(won, "path", "left_anti")
            if todo.isEmpty():
                return ids
            salt += 1

    def _project_id(self, name: str, path: str) -> int:
        rows = self.store.table("projects")
        row = rows.where(F.col("name") == name).limit(1).collect()
        if row:
            return row[0].project_id
        salt = 0
        while True:
            i = self.spark.range(1).select(F.xxhash64(F.lit(name), F.lit(salt)).bitwiseAND((1 << PROJECT_BITS) - 1).alias("i")).collect()[0].i
            if rows.where(F.col("project_id") == i).isEmpty():
                return i
            salt += 1

    def _project_row(self, project_id: int, name: str, path: str) -> DataFrame:
        created = self.store.table("projects").where(F.col("project_id") == project_id).agg(F.coalesce(F.min("created_at"), F.current_timestamp()).alias("created_at"))
        return created.select(F.lit(project_id).alias("project_id"), F.lit(name).alias("name"), F.lit(path).alias("path"), "created_at", F.current_timestamp().alias("last_indexed_at"))

    def sync(self) -> dict[str, IndexReport]:
        """Indexes every registered project whose folder is still there."""
        rows = self.store.table("projects").orderBy("name").collect()
        return {r.name: self.index(r.path, r.name) for r in rows if os.path.isdir(r.path)}

    def remove(self, name: str) -> int:
        return self.store.delete("projects", self.store.table("projects").where(F.col("project_id") == self.resolve(name)), "project_id")

    def setup(self, folder: str) -> dict[str, IndexReport]:
        """Indexes every project found below a folder."""
        return {p: self.index(p) for p in discovery.scan_for_projects(folder)}

    def reindex(self, changes: DataFrame, project: str) -> IndexReport:
        """Works off coalesced changes (file_path, event_type): changed files again, deleted ones out. For foreachBatch."""
        project_id = self.resolve(project)
        root = self.store.table("projects").where(F.col("project_id") == project_id).collect()[0].path
        listed = changes.select(F.regexp_replace("file_path", f"^(file:)?/*{root.strip('/')}/", "").alias("path"), "event_type")
        dead = listed.where("event_type = 'delete'")
        files = self.store.table("files").where(F.col("project_id") == project_id)
        if dead.limit(1).count():
            self.store.delete("files", files.join(dead.select("path"), "path", "left_semi"), "file_id")
        found = discovery.with_text(discovery.walk(self.spark, root, self.config))
        found = found.join(listed.where("event_type <> 'delete'").select("path"), "path", "left_semi")
        return self.index_files(found, project, root, partial=True)

    def status(self) -> DataFrame:
        """Per project: files, chunks, embedded chunks and size."""
        f = self.store.table("files").groupBy("project_id").agg(F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("size_bytes"))
        c = self.store.table("chunks").groupBy("project_id").agg(F.count(F.lit(1)).alias("chunks"))
        e = self.store.table("embeddings").groupBy("project_id").agg(F.count(F.lit(1)).alias("embedded"))
        out = self.store.table("projects").join(f, "project_id", "left").join(c, "project_id", "left").join(e, "project_id", "left").na.fill(0)
        return out.select("name", "path", "files", "chunks", "embedded", format_bytes(F.col("size_bytes")).alias("size"), "last_indexed_at").orderBy("name")

    # the tools

    def resolve(self, project: str | None = None, folder: str | None = None) -> int:
        """A project's id: by name, else by the folder inside one, else the only one there is."""
        rows = self.store.table("projects")
        if project is not None:
            found = rows.where(F.col("name") == project).collect()
        else:
            found = []
            if folder:
                here = self.spark.createDataFrame([(folder.rstrip("/"),)], "dir string")
                ids = store_queries.project_of(here, rows).where("project_id IS NOT NULL").collect()
                found = [r for r in ids]
            if not found:
                found = rows.limit(2).collect()
                found = found if len(found) == 1 else []
        if not found:
            raise UnknownProject(project or "name a project")
        return found[0].project_id

    def _tool(self) -> None:
        if not self.limiter.take():
            raise RateLimited("too many calls; try again in a moment")

    def list_projects(self) -> DataFrame:
        self._tool()
        return store_queries.list_projects(self.store.table("projects"), self.store.table("files"), self.store.table("chunks"))

    def _index(self) -> fulltext.Index:
        return fulltext.Index(self.store.table("postings"), self.store.table("doc_stats"), stemming=True)

    def search_code(self, query: str, project: str | None = None, top_k: int | None = None) -> DataFrame:
        """Vectors of all projects and text of the project, fused, then cut to the project, reranked."""
        self._tool()
        q, project_id = self.config.query, self.resolve(project)
        k = top_k or q.top_k
        broad = q.broad_k if q.rerank or q.hybrid else k
        chunks, files = self.store.table("chunks"), self.store.table("files")
        mine = files.where(F.col("project_id") == project_id)
        hits = search_and_merge(chunks, self.store.table("embeddings"), self._index(), query, self.embedder.embed([query])[0], broad, q.hybrid, within=chunks.where(F.col("project_id") == project_id))
        rows = retrieval.in_scope(with_rows(hits, chunks, files), mine)
        return reranked(rows, query, self.reranker if q.rerank else None, k)

    def find_similar_code(self, snippet: str, project: str | None = None, top_k: int = 10) -> DataFrame:
        self._tool()
        chunks, files = self.store.table("chunks"), self.store.table("files")
        mine = files.where(F.col("project_id") == self.resolve(project))
        near = vector.knn(self.store.table("embeddings"), self.embedder.embed([snippet])[0], 4 * top_k, id_column="chunk_id")
        rows = retrieval.in_scope(with_rows(near, chunks, files), mine)
        return rows.orderBy(F.round("distance", 9), "chunk_id").limit(top_k)

    def search_symbols(self, pattern: str, project: str | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
        self._tool()
        return store_queries.search_symbols(self.store.table("chunks"), self.store.table("files"), pattern, None if project is None else self.resolve(project), limit, offset)

    def get_file(self, path: str, project: str | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
        self._tool()
        return store_queries.file_view(self.store.table("chunks").drop("project_id"), self.store.table("files"), path, self.resolve(project), start, end)

    def project_patterns(self, project: str | None = None) -> dict[str, DataFrame]:
        self._tool()
        i = self.resolve(project)
        chunks = self.store.table("chunks").where(F.col("project_id") == i)
        files = self.store.table("files")
        return {"languages": store_queries.pattern_languages(files, i), "symbol_kinds": store_queries.pattern_kinds(chunks), "prefixes": store_queries.pattern_prefixes(chunks).limit(15), "directories": store_queries.pattern_directories(files, i)}

    def text_search(self, query: str, project: str | None = None, limit: int = 10, offset: int = 0) -> DataFrame:
        self._tool()
        chunks, files = self.store.table("chunks"), self.store.table("files")
        mine = chunks.where(F.col("project_id") == self.resolve(project))
        return with_rows(fulltext.search(self._index(), query, limit, offset, ("content",), mine), chunks, files).orderBy(F.round("rank", 9), "chunk_id")

    def find_callers(self, name: str, project: str | None = None) -> DataFrame:
        self._tool()
        return store_queries.find_callers(self.store.table("definitions").drop("project_id"), self.store.table("function_calls"), self.store.table("files"), name, self.resolve(project))

    def find_callees(self, name: str, project: str | None = None) -> DataFrame:
        self._tool()
        return store_queries.find_callees(self.store.table("definitions").drop("project_id"), self.store.table("function_calls"), self.store.table("files"), name, self.resolve(project))

    def list_definitions(self, project: str | None = None, kind: str | None = None) -> DataFrame:
        return store_queries.list_definitions(self.store.table("definitions").drop("project_id"), self.store.table("files"), self.resolve(project), kind)

    # questions

    def query(self, question: str, project: str | None = None, scoped: bool = False) -> Answer:
        """One question. The project must exist; retrieval looks at all of them unless ``scoped``."""
        project_id = None if project is None else self.resolve(project)
        return self._answer(question, project_id if scoped else None, None, [])

    def create_session(self, project: str | None = None) -> str:
        session = str(uuid.uuid4())
        row = self.spark.range(1).select(F.lit(session).alias("session_id"), F.lit(project).cast("string").alias("project_name"), F.current_timestamp().alias("created_at"))
        self.store.update("sessions", lambda old: upserted(old, row, ["session_id"]))
        return session

    def chat(self, session: str, question: str, languages: list[str] | None = None) -> Answer:
        """A turn of a session: scope, last turns as history, the answer; both turns are stored."""
        found = self.store.table("sessions").where(F.col("session_id") == session).collect()
        if not found:
            raise KeyError(session)
        project = found[0].project_name
        turns = self.store.table("turns").where(F.col("session_id") == session)
        last = store_queries.recent_turns(turns, self.config.query.history_turns).orderBy("place").collect()
        answer = self._answer(question, None if project is None else self.resolve(project), languages, [(r.role, r.content) for r in last])
        n = turns.agg(F.coalesce(F.max("turn_id"), F.lit(0)).alias("n")).collect()[0].n
        rows = self.spark.createDataFrame([(n + 1, session, "user", question, None), (n + 2, session, "assistant", answer.text, answer.sources)], "turn_id long, session_id string, role string, content string, s array<string>")
        rows = rows.select("turn_id", "session_id", "role", "content", F.to_json("s").alias("sources"), F.current_timestamp().alias("created_at"))
        self.store.update("turns", lambda old: old.unionByName(rows))
        return answer

    def _answer(self, question: str, project_id: int | None, languages: list[str] | None, history: list[tuple[str, str]]) -> Answer:
        q = self.config.query
        chunks, files = self.store.table("chunks"), self.store.table("files")
        k = q.broad_k if q.rerank else q.top_k
        hits = search_and_merge(chunks, self.store.table("embeddings"), self._index(), question, self.embedder.embed([question])[0], k, q.hybrid)
        rows = with_rows(hits, chunks, files)
        rows = retrieval.in_scope(rows, None if project_id is None else files.where(F.col("project_id") == project_id), languages)
        rows = reranked(rows, question, self.reranker if q.rerank else None, q.top_k if q.rerank else k)
        rows = rows.withColumn("rerank_score", F.lit(0.0)) if "rerank_score" not in rows.columns else rows
        top = rows.select("path", "symbol", "start_line", "end_line", "content", "suspicious", "rerank_score", "order").collect()
        ranked = sorted(top, key=lambda r: (-r.rerank_score, r.order))
        schema = "ord long, path string, symbol string, start_line int, end_line int, content string, suspicious boolean"
        hits = self.spark.createDataFrame([(i, r.path, r.symbol, r.start_line, r.end_line, r.content, r.suspicious) for i, r in enumerate(ranked)], schema)
        entry = retrieval.context_entry(F.col("suspicious"), F.col("path"), F.col("symbol"), F.col("start_line"), F.col("end_line"), F.col("content"))
        packed = retrieval.pack_context(hits.select("ord", "path", entry.alias("entry")), q.max_context_tokens).collect() if ranked else []
        context = packed[0].context if packed else ""
        code = retrieval.canary()
        one = self.spark.createDataFrame([(question, context, [(r, c) for r, c in history])], "q string, c string, h array<struct<role:string,content:string>>")
        g = self.config.generation
        text = generated(retrieval.prompt(F.col("q"), F.col("c"), F.col("h"), retrieval.nonce(), code), self.generator, g.max_tokens, g.temperature, g.redact_secrets)
        answer = one.select(text.alias("a")).collect()[0].a
        sources = list(dict.fromkeys(f"{r.path}:{r.start_line}-{r.end_line}" for r in ranked))
        return Answer(answer, sources, code in answer)

    # streaming

    def watch(self, changes: DataFrame, project: str, checkpoint: str, once: bool = False, after: Callable[[IndexReport], None] | None = None):
        """A streaming query that reindexes what a stream of changes names."""
        from lodestone.streaming.changes import start

        def work(rows: DataFrame, _: int) -> None:
            report = self.reindex(rows, project)
            if after:
                after(report)

        return start(changes, work, checkpoint, once)
