"""The registered queries of the retrieval engine, each with the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions.language import language_of
from lodestone.functions.text import format_bytes, is_blank, tokens
from lodestone.operators import chunking, fulltext, models, retrieval, scan, syntax, vector
from lodestone.operators import store_queries as q
from lodestone.sources import store
from lodestone.streaming import changes as ch

from . import samples
from . import tables as t
from .search import hybrid

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = t.with_tables(sql)
        return f

    return add


# chunking


@query("SELECT chunk_id, file_id, start_line, end_line, md5(content) AS content_md5 FROM chunks_")
def line_chunks(spark, d):
    return t.chunks(spark, d).select("chunk_id", "file_id", "start_line", "end_line", F.md5("content").alias("content_md5"))


@query(f"""SELECT doc_id AS file_id, trim(split_part(line, '=', 1)) AS symbol, CAST(i AS INTEGER) AS start_line, md5(line) AS content_md5
FROM (SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, {t.lines_sql('text')} AS l FROM documents))
WHERE regexp_matches(line, '\\S') AND NOT starts_with(trim(line), '#')""")
def env_chunks(spark, d):
    c = chunking.chunk_env(t.files(spark, d, content=True))
    return c.select("file_id", F.trim("symbol").alias("symbol"), "start_line", F.md5("content").alias("content_md5"))


def _blocks_sql(source: str, header: str, symbol: str, preamble: bool) -> str:
    name = f"CASE WHEN max(CASE WHEN h THEN 1 ELSE 0 END) = 1 THEN arg_min({symbol}, i) WHEN bool_or(total > 0) THEN '' END" if preamble else f"arg_min({symbol}, i)"
    keep = "" if preamble else "WHERE b > 0"
    return f"""SELECT file_id, {name} AS symbol, CAST(min(i) AS INTEGER) AS start_line, CAST(max(i) AS INTEGER) AS end_line, md5(string_agg(line, chr(10) ORDER BY i)) AS content_md5
FROM (SELECT *, sum(CASE WHEN h THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY i) AS b, sum(CASE WHEN h THEN 1 ELSE 0 END) OVER (PARTITION BY file_id) AS total
FROM (SELECT *, {header} AS h FROM (SELECT file_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS i FROM (SELECT file_id, {t.lines_sql('content')} AS l FROM ({source})))))
{keep} GROUP BY file_id, b HAVING regexp_matches(string_agg(line, chr(10) ORDER BY i), '\\S')"""


# every fifth order's status and priority, as small TOML and YAML files
_TOML = "SELECT o_orderkey AS file_id, 'top = 1' || chr(10) || '[' || o_orderpriority || ']' || chr(10) || 'a = ' || o_custkey || chr(10) || '# note' || chr(10) || '[x.' || o_orderstatus || ']' || chr(10) || 'b = 2' AS content FROM orders"
_YAML = "SELECT o_orderkey AS file_id, '---' || chr(10) || o_orderstatus || ': 1' || chr(10) || '  deep: ' || o_custkey || chr(10) || '# note' || chr(10) || o_orderpriority || ':' || chr(10) || '  - x' || chr(10) || '...' AS content FROM orders"


def _lit(s: str):
    return F.lit(s)


@query(_blocks_sql(_TOML, "starts_with(trim(line), '[') AND contains(line, ']')", "split_part(ltrim(trim(line), '['), ']', 1)", True))
def toml_sections(spark, d):
    o = t.read(spark, d, "orders")
    text = F.concat(_lit("top = 1\n["), "o_orderpriority", _lit("]\na = "), F.col("o_custkey").cast("string"), _lit("\n# note\n[x."), "o_orderstatus", _lit("]\nb = 2"))
    c = chunking.chunk_toml(o.select(F.col("o_orderkey").alias("file_id"), text.alias("content")))
    return c.select("file_id", "symbol", "start_line", "end_line", F.md5("content").alias("content_md5"))


@query(_blocks_sql(_YAML, "length(line) > 0 AND NOT regexp_matches(line, '^([ \\t#]|---|\\.\\.\\.)')", "nullif(trim(split_part(line, ':', 1)), '')", False))
def yaml_blocks(spark, d):
    o = t.read(spark, d, "orders")
    text = F.concat(_lit("---\n"), "o_orderstatus", _lit(": 1\n  deep: "), F.col("o_custkey").cast("string"), _lit("\n# note\n"), "o_orderpriority", _lit(":\n  - x\n..."))
    c = chunking.chunk_yaml(o.select(F.col("o_orderkey").alias("file_id"), text.alias("content")))
    return c.select("file_id", "symbol", "start_line", "end_line", F.md5("content").alias("content_md5"))


@query("""SELECT n.n_nationkey + 0 AS file_id, k.key AS symbol, CAST(k.line AS INTEGER) AS start_line, '"' || k.key || '": ' || k.raw AS content
FROM nation n, LATERAL (VALUES ('name', 2, '"' || n.n_name || '"'), ('region', 3, '[' || n.n_regionkey || ', 1]')) AS k(key, line, raw)""")
def json_keys(spark, d):
    n = t.read(spark, d, "nation")
    text = F.concat(_lit('{\n  "name": "'), "n_name", _lit('",\n  "region": ['), F.col("n_regionkey").cast("string"), _lit(", 1]\n}"))
    c = chunking.chunk_json(n.select(F.col("n_nationkey").cast("long").alias("file_id"), text.alias("content")))
    return c.select(F.col("file_id").cast("int").alias("file_id"), "symbol", "start_line", "content")


@query("SELECT chunk_id, md5('File: ' || path || chr(10) || symbol_kind || ': ' || symbol || chr(10) || chr(10) || 'body') AS text_md5 FROM symbols_ JOIN symbol_files_ USING (file_id)")
def enrich_text(spark, d):
    s = t.symbols(spark, d).join(t.symbol_files(spark, d), "file_id")
    return s.select("chunk_id", F.md5(chunking.enrich(F.col("path"), _lit("body"), F.col("symbol"), F.col("symbol_kind"), _lit("unknown"))).alias("text_md5"))


@query()
def syntax_chunks(spark, d):
    return syntax.chunk_files(samples.sources(spark)).select("file_id", "ord", "symbol", "symbol_kind", "start_line", "end_line", "content")


@query()
def call_graph_definitions(spark, d):
    return syntax.extract_call_graph(samples.sources(spark))[0]


@query()
def call_graph_calls(spark, d):
    return syntax.extract_call_graph(samples.sources(spark))[1]


# files


@query("""SELECT page_id, CASE WHEN regexp_matches(p, '\\.html?$') THEN 'html' WHEN regexp_matches(p, '\\.(js|mjs|cjs)$') THEN 'javascript' ELSE 'unknown' END AS language
FROM (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS p FROM pages)""")
def lang_detect(spark, d):
    return t.read(spark, d, "pages").select("page_id", language_of(F.regexp_replace("url", r"[?#].*$", "")).alias("language"))


@query("SELECT file_id, size_bytes FROM files_ WHERE size_bytes <= 4096")
def size_filter(spark, d):
    return t.files(spark, d).where("size_bytes <= 4096").select("file_id", "size_bytes")


@query("SELECT doc_id AS file_id, sha256(text) AS content_hash FROM documents")
def file_hash(spark, d):
    return t.read(spark, d, "documents").select(F.col("doc_id").alias("file_id"), F.sha2("text", 256).alias("content_hash"))


@query("""WITH stored AS (SELECT doc_id, source, sha256(CASE WHEN doc_id % 10 = 0 THEN text || 'x' ELSE text END) AS h FROM documents WHERE doc_id % 17 <> 0)
SELECT d.doc_id AS file_id FROM documents d ANTI JOIN stored s ON d.doc_id = s.doc_id AND d.source = s.source AND sha256(d.text) = s.h""")
def changed_files(spark, d):
    docs = t.read(spark, d, "documents")
    found = docs.select("doc_id", "source", F.sha2("text", 256).alias("h"))
    stored = docs.where("doc_id % 17 <> 0").select("doc_id", "source", F.sha2(F.when(F.col("doc_id") % 10 == 0, F.concat("text", _lit("x"))).otherwise(F.col("text")), 256).alias("h"))
    return store.without(found, stored, ["doc_id", "source", "h"]).select(F.col("doc_id").alias("file_id"))


@query("""WITH dirs AS (SELECT DISTINCT '/work/' || source || CASE WHEN doc_id % 2 = 0 THEN '/a/b' ELSE '' END || CASE WHEN doc_id % 3 = 0 THEN 'x' ELSE '' END AS dir FROM documents)
SELECT dir, arg_max(project_id, length(path)) AS project_id FROM dirs LEFT JOIN projects_ ON dir = path OR starts_with(dir, path || '/') GROUP BY dir""")
def project_by_prefix(spark, d):
    docs = t.read(spark, d, "documents")
    dirs = docs.select(F.concat(_lit("/work/"), "source", F.when(F.col("doc_id") % 2 == 0, "/a/b").otherwise(""), F.when(F.col("doc_id") % 3 == 0, "x").otherwise("")).alias("dir")).distinct()
    return q.project_of(dirs, t.projects(spark, d))


@query("""SELECT dir, bool_or(name IN ('Cargo.toml', 'package.json', 'pyproject.toml', 'setup.py', 'requirements.txt', 'go.mod', 'pom.xml', 'build.gradle', 'build.gradle.kts', 'Gemfile', 'composer.json', 'mix.exs', '.git') OR ends_with(name, '.csproj') OR ends_with(name, '.sln')) AS is_project
FROM (SELECT 'd' || p_size AS dir, CASE WHEN p_partkey % 97 = 0 THEN 'go.mod' WHEN p_partkey % 89 = 0 THEN 'app.csproj' ELSE p_name END AS name FROM part) GROUP BY dir""")
def project_markers(spark, d):
    name = F.when(F.col("p_partkey") % 97 == 0, "go.mod").when(F.col("p_partkey") % 89 == 0, "app.csproj").otherwise(F.col("p_name"))
    return q.project_directories(t.read(spark, d, "part").select(F.concat(_lit("d"), F.col("p_size").cast("string"), _lit("/"), name).alias("path")))


# counts and patterns


@query("SELECT count(*) AS file_count FROM files_ WHERE project_id = 3")
def file_count(spark, d):
    return q.file_count(t.files(spark, d), 3)


@query("SELECT count(*) AS chunk_count FROM chunks_ WHERE project_id = 3")
def chunk_count(spark, d):
    return q.chunk_count(t.chunks(spark, d), t.files(spark, d), 3)


@query("SELECT CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS total_size FROM files_ WHERE project_id = 3")
def total_size(spark, d):
    return q.total_size(t.files(spark, d), 3)


@query("SELECT count(*) AS embedded_count FROM embeddings e JOIN files_ f ON e.vec_id = f.file_id WHERE f.project_id = 3")
def embedded_count(spark, d):
    e = t.read(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"))
    c = t.files(spark, d).select(F.col("file_id").alias("chunk_id"), "file_id")
    return q.embedded_chunk_count(e, c, t.files(spark, d), 3)


@query("SELECT f.language AS language, count(DISTINCT f.file_id) AS file_count, count(c.chunk_id) AS chunk_count FROM files_ f LEFT JOIN chunks_ c USING (file_id) GROUP BY ALL")
def lang_stats(spark, d):
    return q.language_stats(t.files(spark, d), t.chunks(spark, d))


@query("SELECT name, count(DISTINCT f.file_id) AS file_count, count(DISTINCT c.chunk_id) AS chunk_count FROM projects_ p JOIN files_ f USING (project_id) LEFT JOIN chunks_ c ON c.file_id = f.file_id GROUP BY name")
def list_projects(spark, d):
    return q.list_projects(t.projects(spark, d), t.files(spark, d), t.chunks(spark, d)).select("name", "file_count", "chunk_count")


@query("SELECT language AS name, count(*) AS n FROM files_ GROUP BY 1")
def patterns_languages(spark, d):
    return q.pattern_languages(t.files(spark, d))


@query("SELECT symbol_kind AS name, count(*) AS n FROM symbols_ WHERE symbol_kind IS NOT NULL GROUP BY 1 ORDER BY n DESC, name LIMIT 20")
def patterns_kinds(spark, d):
    return q.pattern_kinds(t.symbols(spark, d))


@query("SELECT * FROM (SELECT split_part(symbol, '_', 1) AS name, count(*) AS n FROM symbols_ WHERE length(symbol) > 0 GROUP BY 1 HAVING count(*) > 2 ORDER BY n DESC, name LIMIT 30) WHERE length(name) > 0")
def patterns_prefixes(spark, d):
    return q.pattern_prefixes(t.symbols(spark, d))


@query("SELECT * FROM (SELECT split_part(path, '/', 1) AS name, count(*) AS n FROM files_ GROUP BY 1 ORDER BY n DESC, name LIMIT 20) WHERE length(name) > 0")
def patterns_dirs(spark, d):
    return q.pattern_directories(t.files(spark, d))


@query("SELECT file_id, size_bytes, CASE WHEN size_bytes >= 1048576 THEN printf('%.1f MB', CAST(size_bytes AS DOUBLE) / 1048576.0) WHEN size_bytes >= 1024 THEN printf('%.1f KB', CAST(size_bytes AS DOUBLE) / 1024.0) ELSE printf('%d B', size_bytes) END AS shown FROM files_")
def format_sizes(spark, d):
    return t.files(spark, d).select("file_id", "size_bytes", format_bytes(F.col("size_bytes")).alias("shown"))


# symbols, definitions, call graph


@query("SELECT chunk_id, symbol, symbol_kind, path, start_line, end_line FROM symbols_ JOIN symbol_files_ USING (file_id) WHERE contains(lower(symbol), 'd_wi') ORDER BY symbol, chunk_id LIMIT 20 OFFSET 5")
def search_symbols(spark, d):
    return q.search_symbols(t.symbols(spark, d), t.symbol_files(spark, d), "D_Wi", limit=20, offset=5)


@query("SELECT path, start_line, end_line, md5(content) AS content_md5 FROM chunks_ WHERE path = (SELECT arg_max(path, (end_line, -file_id)) FROM chunks_) AND end_line >= 50 AND start_line <= 120")
def get_file_range(spark, d):
    f = t.files(spark, d)
    longest = t.chunks(spark, d).orderBy(F.desc("end_line"), "file_id").limit(1)
    path = longest.select("file_id").join(f, "file_id").collect()[0].path
    return q.file_view(t.chunks(spark, d), f, path, start=50, end=120).select("path", "start_line", "end_line", F.md5("content").alias("content_md5"))


@query("SELECT path, md5(string_agg(content, chr(10) ORDER BY start_line)) AS content_md5 FROM chunks_ WHERE project_id = 4 GROUP BY path")
def get_file(spark, d):
    f = t.files(spark, d).where("project_id = 4").select("file_id", "path")
    view = t.chunks(spark, d).join(f, "file_id").select("path", "start_line", "end_line", "content")
    return q.file_text(view).select("path", F.md5("content").alias("content_md5"))


@query("SELECT name, kind, path, start_line, end_line, scope FROM definitions_ JOIN call_files_ USING (file_id) WHERE project_id = 1 AND kind = 'f'")
def list_definitions(spark, d):
    return q.list_definitions(t.definitions(spark, d), t.call_files(spark, d), 1, "f")


@query("""SELECT DISTINCT d.name, d.kind, f.path, d.start_line, d.end_line, d.scope FROM calls_ c JOIN definitions_ d ON c.caller_name = d.name AND c.file_id = d.file_id AND (c.caller_scope IS NULL OR d.scope IS NULL OR c.caller_scope = d.scope)
JOIN call_files_ f ON d.file_id = f.file_id WHERE f.project_id = 1 AND c.callee_name = 'fn_7'""")
def find_callers(spark, d):
    return q.find_callers(t.definitions(spark, d), t.calls(spark, d), t.call_files(spark, d), "fn_7", 1)


@query("""SELECT DISTINCT d.name, d.kind, f.path, d.start_line, d.end_line, d.scope FROM calls_ c JOIN definitions_ d ON c.callee_name = d.name JOIN call_files_ f ON d.file_id = f.file_id
WHERE f.project_id = 1 AND c.caller_name = 'fn_7' AND c.file_id IN (SELECT file_id FROM call_files_ WHERE project_id = 1)""")
def find_callees(spark, d):
    return q.find_callees(t.definitions(spark, d), t.calls(spark, d), t.call_files(spark, d), "fn_7", 1)


@query("""SELECT call_id, callee_name, coalesce(near, any_) AS callee_definition_id FROM calls_ c
LEFT JOIN (SELECT file_id, name, min(definition_id) AS near FROM definitions_ GROUP BY ALL) n ON n.file_id = c.file_id AND n.name = c.callee_name
LEFT JOIN (SELECT name, min(definition_id) AS any_ FROM definitions_ GROUP BY ALL) a ON a.name = c.callee_name""")
def resolve_calls(spark, d):
    return q.resolve_calls(t.calls(spark, d), t.definitions(spark, d)).select("call_id", "callee_name", "callee_definition_id")


@query("SELECT (SELECT count(*) FROM definitions_ SEMI JOIN (SELECT * FROM call_files_ WHERE project_id = 1) USING (file_id)) AS definitions, (SELECT count(*) FROM calls_ SEMI JOIN (SELECT * FROM call_files_ WHERE project_id = 1) USING (file_id)) AS calls")
def callgraph_stats(spark, d):
    return q.call_graph_stats(t.definitions(spark, d), t.calls(spark, d), t.call_files(spark, d), 1)


# vectors

_D = "1 - list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[]))"


def _vector(spark, d, i: int) -> list[float]:
    return t.read(spark, d, "embeddings").where(F.col("vec_id") == i).select("embedding").collect()[0][0]


@query(f"SELECT e.vec_id, round({_D}, 6) AS distance FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) v ORDER BY round({_D}, 9), e.vec_id LIMIT 10")
def knn_exact(spark, d):
    return vector.knn(t.read(spark, d, "embeddings"), _vector(spark, d, 0), 10).select("vec_id", F.round("distance", 6).alias("distance"))


@query(f"""SELECT query_id, vec_id, rank, round(dist, 6) AS distance FROM (SELECT v.vec_id AS query_id, e.vec_id, {_D} AS dist, CAST(row_number() OVER (PARTITION BY v.vec_id ORDER BY round({_D}, 9), e.vec_id) AS INTEGER) AS rank
FROM embeddings e JOIN (SELECT * FROM embeddings WHERE vec_id % 50 = 0) v ON e.vec_id <> v.vec_id) WHERE rank <= 5""")
def knn_batch(spark, d):
    e = t.read(spark, d, "embeddings")
    queries = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return vector.knn_batch(t.spread(e, "vec_id"), queries, 5, exclude_self=True).select("query_id", "vec_id", F.col("rank").cast("int").alias("rank"), F.round("distance", 6).alias("distance"))


@query()
def knn_hashed(spark, d):
    return vector.knn_hashed(t.read(spark, d, "embeddings"), _vector(spark, d, 0), 10)


@query("SELECT count(*) AS n, 64 AS dimension FROM embeddings WHERE len(embedding) = 64")
def vector_dimension_check(spark, d):
    return vector.checked(t.read(spark, d, "embeddings"), 64).select(F.size("embedding").alias("s")).agg(F.count("s").alias("n"), F.max("s").alias("dimension"))


@query(f"""SELECT * FROM (SELECT e.vec_id, e.label, round({_D}, 6) AS distance FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 3) v ORDER BY round({_D}, 9), e.vec_id LIMIT 40) WHERE label = 3 ORDER BY distance, vec_id LIMIT 10""")
def find_similar(spark, d):
    """Four times as many neighbours as wanted over all projects, then those of one project, cut to the wanted number."""
    e = t.read(spark, d, "embeddings")
    near = vector.knn(e, _vector(spark, d, 3), 40).withColumn("distance", F.round("distance", 6))
    return near.join(e.select("vec_id", "label"), "vec_id").where("label = 3").orderBy("distance", "vec_id").limit(10).select("vec_id", "label", "distance")


# full text

_TOKENS = "regexp_extract_all(strip_accents(lower(content)), '[\\p{L}\\p{N}]+')"


def _bm25_sql(words: list[str], where: str = "", tail: str = "ORDER BY round(rank, 9), chunk_id LIMIT 10") -> str:
    listed = ", ".join(f"('{w}')" for w in words)
    return f"""WITH toks AS (SELECT chunk_id, project_id, {_TOKENS} AS l FROM chunks_), stats AS (SELECT count(*) AS n, avg(len(l)) AS mean FROM toks),
hits AS (SELECT chunk_id, project_id, w, len(list_filter(l, lambda x: x = w)) AS tf, len(l) AS dl FROM toks, (VALUES {listed}) AS q(w) WHERE list_contains(l, w)),
df AS (SELECT w, count(*) AS df FROM hits GROUP BY w)
SELECT chunk_id, round(rank, 6) AS rank FROM (SELECT chunk_id, -sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))) AS rank
FROM hits JOIN df USING (w), stats {where} GROUP BY chunk_id HAVING count(*) = {len(words)}) {tail}"""


def _index(spark, d) -> fulltext.Index:
    return fulltext.build_index(t.chunks(spark, d), columns=("content",), stemming=False)


@query(_bm25_sql(["that", "the"]))
def bm25_global(spark, d):
    return fulltext.search(_index(spark, d), "that the").select("chunk_id", F.round("rank", 6).alias("rank"))


@query(_bm25_sql(["the", "and"], where="WHERE project_id = 6"))
def bm25_project(spark, d):
    mine = t.files(spark, d).where("project_id = 6").select("file_id")
    return fulltext.search(_index(spark, d), "the and", within=t.chunks(spark, d).join(mine, "file_id", "left_semi")).select("chunk_id", F.round("rank", 6).alias("rank"))


@query(_bm25_sql(["of"], tail="ORDER BY round(rank, 9), chunk_id LIMIT 10 OFFSET 20"))
def text_search_page(spark, d):
    return fulltext.search(_index(spark, d), "of", limit=10, offset=20).select("chunk_id", F.round("rank", 6).alias("rank"))


@query(f"""WITH toks AS (SELECT chunk_id, {_TOKENS} AS l FROM chunks_), pairs AS (SELECT chunk_id, len(l) AS dl, len(list_filter(range(1, len(l)), lambda i: l[i] = 'of' AND l[i + 1] = 'the')) AS tf FROM toks),
stats AS (SELECT count(*) AS n, avg(dl) AS mean, count(*) FILTER (tf > 0) AS df FROM pairs)
SELECT chunk_id, round(-greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean)), 6) AS rank FROM pairs, stats WHERE tf > 0""")
def phrase_search(spark, d):
    return fulltext.search(_index(spark, d), "of_the", limit=None).select("chunk_id", F.round("rank", 6).alias("rank"))


@query(f"SELECT term, count(*) AS chunks, CAST(sum(tf) AS BIGINT) AS occurrences FROM (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest({_TOKENS}) AS term FROM chunks_) GROUP BY ALL) GROUP BY term")
def postings_build(spark, d):
    return _index(spark, d).postings.groupBy("term").agg(F.count(F.lit(1)).alias("chunks"), F.sum("tf").alias("occurrences"))


@query()
def stemmed_search(spark, d):
    index = fulltext.build_index(t.chunks(spark, d), columns=("content",), stemming=True)
    return fulltext.search(index, "thes things", limit=10)


# fusion, reranking, context

_VEC = f"SELECT e.vec_id AS chunk_id, row_number() OVER (ORDER BY round({_D}, 9), e.vec_id) - 1 AS rank FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) v QUALIFY rank < 50"
_FTS = "SELECT vec_id AS chunk_id, row_number() OVER (ORDER BY (vec_id * 7919) % 503, vec_id) - 1 AS rank FROM embeddings QUALIFY rank < 50"


def _two_lists(spark, d) -> tuple[DataFrame, DataFrame]:
    e = t.read(spark, d, "embeddings")
    vec = vector.knn(e, _vector(spark, d, 0), 50).withColumn("distance", F.round("distance", 9)).withColumnRenamed("vec_id", "chunk_id")
    fts = e.select(F.col("vec_id").alias("chunk_id"), ((F.col("vec_id") * 7919) % 503).alias("s")).orderBy("s", "chunk_id").limit(50)
    return retrieval.ranked(vec, "distance"), retrieval.ranked(fts, "s")


@query(f"SELECT chunk_id, round(sum(1.0 / (60 + CAST(rank AS DOUBLE) + 1)), 9) AS score FROM (SELECT * FROM ({_VEC}) UNION ALL SELECT * FROM ({_FTS})) GROUP BY chunk_id ORDER BY sum(1.0 / (60 + CAST(rank AS DOUBLE) + 1)) DESC, chunk_id LIMIT 20")
def rrf_fuse(spark, d):
    vec, fts = _two_lists(spark, d)
    return retrieval.reciprocal_rank_fusion(vec, fts, 20).select("chunk_id", F.round("score", 9).alias("score"))


_RERANK = f"""WITH q AS (SELECT list_distinct(regexp_extract_all(strip_accents(lower(text)), '[\\p{{L}}\\p{{N}}]+')) AS q FROM benchmark WHERE item_id = (SELECT min(item_id) FROM benchmark))
SELECT chunk_id, round(CAST(len(list_intersect(q, list_distinct({_TOKENS}))) AS DOUBLE) / len(q), 6) AS score FROM chunks_, q ORDER BY CAST(len(list_intersect(q, list_distinct({_TOKENS}))) AS DOUBLE) / len(q) DESC, chunk_id LIMIT 10"""


@query(_RERANK)
def rerank_lexical(spark, d):
    b = t.read(spark, d, "benchmark").orderBy("item_id").limit(1).collect()[0].text
    top = retrieval.rerank(t.chunks(spark, d), retrieval.lexical_score(b, F.col("content")), 10, "chunk_id")
    return top.select("chunk_id", F.round("rerank_score", 6).alias("score"))


@query("SELECT chunk_id FROM chunks_ WHERE project_id IN (1, 2, 3, 5) AND language IN ('en', 'fr')")
def scope_filter(spark, d):
    f = t.files(spark, d)
    found = t.chunks(spark, d).join(f.select("file_id", "language"), "file_id")
    return retrieval.in_scope(found, f.where("project_id IN (1, 2, 3, 5)"), ["EN", "fr"]).select("chunk_id")


@query("""WITH e AS (SELECT file_id // 10 AS query_id, row_number() OVER (PARTITION BY file_id // 10 ORDER BY chunk_id) AS ord, path, CAST(strlen('--- ' || path || ' (lines ' || start_line || '-' || end_line || ') ---' || chr(10) || content || chr(10) || chr(10)) AS BIGINT) AS n FROM chunks_),
fold AS (SELECT query_id, CAST(0 AS BIGINT) AS ord, CAST(0 AS BIGINT) AS used, MAP {}::MAP(VARCHAR, BIGINT) AS files, false AS stop, []::BIGINT[] AS picked FROM (SELECT DISTINCT query_id FROM e)
UNION ALL SELECT f.query_id, e.ord, CASE WHEN f.stop OR f.used + e.n > 8192 OR coalesce(f.files[e.path], 0) + e.n > 3276 THEN f.used ELSE f.used + e.n END,
CASE WHEN f.stop OR f.used + e.n > 8192 OR coalesce(f.files[e.path], 0) + e.n > 3276 THEN f.files ELSE map_concat(f.files, MAP {e.path: coalesce(f.files[e.path], 0) + e.n}) END,
f.stop OR f.used + e.n > 8192, CASE WHEN f.stop OR f.used + e.n > 8192 OR coalesce(f.files[e.path], 0) + e.n > 3276 THEN f.picked ELSE list_append(f.picked, e.ord) END
FROM fold f JOIN e ON e.query_id = f.query_id AND e.ord = f.ord + 1)
SELECT query_id, array_to_string(arg_max(picked, ord), ',') AS picked, CAST(max(used) AS BIGINT) AS context_bytes FROM fold GROUP BY query_id""")
def context_pack(spark, d):
    c = t.chunks(spark, d).join(t.files(spark, d).select("file_id", "path"), "file_id").withColumn("query_id", F.expr("file_id div 10"))
    c = c.withColumn("ord", F.row_number().over(Window.partitionBy("query_id").orderBy("chunk_id")))
    entry = retrieval.context_entry(F.lit(False), F.col("path"), F.lit(None).cast("string"), F.col("start_line"), F.col("end_line"), F.col("content"))
    packed = retrieval.pack_context(c.select("query_id", "ord", "path", entry.alias("entry")), 2048, by=("query_id",))
    return packed.select("query_id", F.array_join(F.col("picked").cast("array<string>"), ",").alias("picked"), F.octet_length("context").cast("long").alias("context_bytes"))


@query("SELECT conv_id, turn, md5(regexp_replace(role || ': ' || text || chr(10) || '  user: x', '(?m)^([ \\t\\r\\f\\v]*)(user:|assistant:|system:)', '\\1[source] \\2', 'g')) AS text_md5 FROM conversations")
def sanitize_roles(spark, d):
    text = F.concat("role", _lit(": "), "text", _lit("\n  user: x"))
    return t.read(spark, d, "conversations").select("conv_id", "turn", F.md5(retrieval.sanitize(text)).alias("text_md5"))


@query("SELECT conv_id, turn, contains(text, 'the') AS leaked FROM conversations")
def canary_check(spark, d):
    return t.read(spark, d, "conversations").select("conv_id", "turn", retrieval.leaks_canary(F.col("text"), "the").alias("leaked"))


@query("SELECT session_id, turn_id, role, place FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn_id) AS place FROM (SELECT * FROM turns_ QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY turn_id DESC) <= 6))")
def recent_turns(spark, d):
    return q.recent_turns(t.turns(spark, d), 6).select("session_id", "turn_id", "role", F.col("place").cast("long").alias("place"))


@query("""SELECT file_id, array_to_string(list(label ORDER BY o), ' ') AS sources FROM (SELECT file_id, label, min(o) AS o FROM (SELECT file_id, path || ':' || CAST(start_line // 56 AS VARCHAR) || '-' || 60 AS label, start_line AS o FROM chunks_) GROUP BY ALL) GROUP BY file_id""")
def source_dedup(spark, d):
    c = t.chunks(spark, d).join(t.files(spark, d).select("file_id", "path"), "file_id")
    c = c.select("file_id", F.struct(F.col("start_line").alias("o"), "path", F.expr("start_line div 56").alias("start_line"), F.lit(60).alias("end_line")).alias("r"))
    listed = c.groupBy("file_id").agg(F.array_sort(F.collect_list("r")).alias("rs"))
    return listed.select("file_id", F.array_join(retrieval.source_labels(F.col("rs")), " ").alias("sources"))


@query()
def hybrid_search(spark, d):
    return hybrid(spark, d)


@query("SELECT session_id, turn_id, '--- ' || role || ' (lines ' || turn_id || '-' || (turn_id + 1) || ') ---' || chr(10) AS header FROM turns_")
def result_headers(spark, d):
    return t.turns(spark, d).select("session_id", "turn_id", retrieval.header(F.col("role"), F.lit(None).cast("string"), F.col("turn_id"), F.col("turn_id") + 1).alias("header"))


# scanner, redaction


@query(f"""SELECT id, confidence, is_suspicious FROM (SELECT id, least(1.0, CAST(s AS DOUBLE) / 100) AS confidence, s >= 50 AS is_suspicious FROM (SELECT id, {samples.score_sql('text')} AS s FROM ({samples.scanned_sql()})))""")
def scan_confidence(spark, d):
    rows = scan.with_scan(samples.scanned(spark, d), composed=False, out="r")
    return rows.select("id", F.col("r.confidence").alias("confidence"), F.col("r.is_suspicious").alias("is_suspicious"))


@query(f"SELECT id, CAST(len(regexp_extract_all(text, '[\\x{{200B}}-\\x{{200F}}\\x{{2060}}-\\x{{2064}}\\x{{FEFF}}\\x{{00AD}}\\x00-\\x08\\x0B-\\x1F\\x7F-\\x9F]')) AS INTEGER) AS hidden, CAST(len(regexp_extract_all(text, '{scan.LOOKALIKE_PATTERN}')) AS INTEGER) AS alike FROM ({samples.scanned_sql()})")
def scan_invisible(spark, d):
    return samples.scanned(spark, d).select("id", scan.invisible_count(F.col("text")).alias("hidden"), scan.lookalike_count(F.col("text")).alias("alike"))


@query(f"SELECT conv_id, turn, CAST(len(regexp_extract_all(lower(role || ': ' || text), '(?m)^[ \\t]*(system:|assistant:|user:|human:)')) AS INTEGER) AS hits FROM conversations")
def scan_roles(spark, d):
    norm = scan.normalized(F.concat("role", _lit(": "), "text"), composed=False)
    rows = t.read(spark, d, "conversations").withColumn("_lines", scan.role_lines(norm))
    return rows.select("conv_id", "turn", F.aggregate(scan.role_hits(F.col("_lines")), F.lit(0), lambda s, r: s + r["n"]).alias("hits"))


@query()
def scan_unicode(spark, d):
    return scan.with_scan(samples.scanned(spark, d), out="r").select("id", "r.*")


_ASSIGNED = "((password|passwd|secret|token|api_key|apikey)[\"'']? ?[:=] ?[\"''])[^\"''\\s]{8,}([\"''])"


@query(f"""SELECT doc_id, CAST(len(regexp_extract_all(text, '{_ASSIGNED}')) + len(regexp_extract_all(text, '([a-zA-Z][a-zA-Z0-9+.-]*://[^\\s:/@]+:)[^\\s@/]+@')) AS INTEGER) AS redactions, md5(regexp_replace(regexp_replace(text, '([a-zA-Z][a-zA-Z0-9+.-]*://[^\\s:/@]+:)[^\\s@/]+@', '\\1[REDACTED]@', 'g'), '{_ASSIGNED}', '\\1[REDACTED]\\3', 'g')) AS text_md5 FROM documents""")
def redact_secrets(spark, d):
    text, n = scan.redact(F.col("text"))
    return t.documents(spark, d).select("doc_id", n.cast("int").alias("redactions"), F.md5(text).alias("text_md5"))


# the store and the change queue


@query("SELECT project_id, file_path, arg_max(event_type, (queued_at, event_id)) AS event_type, max(queued_at) AS queued_at FROM changes_ GROUP BY ALL")
def queue_coalesce(spark, d):
    return ch.coalesced(t.changes(spark, d), ["event_id"])


@query("SELECT * FROM (SELECT project_id, file_path, arg_max(event_type, (queued_at, event_id)) AS event_type, max(queued_at) AS queued_at FROM changes_ GROUP BY ALL) ORDER BY queued_at, project_id, file_path LIMIT 10")
def queue_oldest(spark, d):
    return ch.oldest(ch.coalesced(t.changes(spark, d), ["event_id"]), 10)


@query("""SELECT project_id, file_path, count(*) AS n_events, min(queued_at) AS first_at FROM (SELECT *, sum(fresh) OVER (PARTITION BY project_id, file_path ORDER BY queued_at, event_id) AS s FROM
(SELECT *, CASE WHEN queued_at - lag(queued_at) OVER (PARTITION BY project_id, file_path ORDER BY queued_at, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM changes_)) GROUP BY project_id, file_path, s""")
def debounce_sessions(spark, d):
    return ch.debounced(t.changes(spark, d), "6 hours").select("project_id", "file_path", "n_events", "first_at")


@query("""WITH e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS k FROM events),
fold AS (SELECT user_id, CAST(0 AS BIGINT) AS k, CAST(2 AS DOUBLE) AS tokens, CAST(NULL AS DOUBLE) AS last, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS BOOLEAN) AS allowed FROM (SELECT DISTINCT user_id FROM e)
UNION ALL SELECT f.user_id, e.k, g.grown - CASE WHEN g.grown >= 1 THEN 1 ELSE 0 END, e.t, e.event_id, g.grown >= 1 FROM fold f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1, LATERAL (SELECT least(2.0, f.tokens + coalesce(e.t - f.last, 0) * (2 / 864000.0)) AS grown) g)
SELECT user_id, event_id, allowed FROM fold WHERE k > 0""")
def rate_limit(spark, d):
    return ch.limited(t.read(spark, d, "events"), "user_id", capacity=2, per_seconds=864000.0)


@query("SELECT chunk_id, file_id FROM chunks_ ANTI JOIN (SELECT file_id FROM files_ WHERE project_id IN (2, 3)) USING (file_id)")
def cascade_delete(spark, d):
    gone = t.files(spark, d).where("project_id IN (2, 3)")
    return store.without(t.chunks(spark, d).select("chunk_id", "file_id"), gone, "file_id")


@query("SELECT l_orderkey AS key, arg_max(l_linenumber, (l_shipdate, l_linenumber)) AS line, max(l_shipdate) AS at FROM lineitem GROUP BY 1")
def upsert_latest(spark, d):
    rows = t.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("line"), F.col("l_shipdate").alias("at"))
    return store.latest_per_key(rows, ["key"], ["at", "line"])


@query("""SELECT c_custkey AS project_id, CASE WHEN c_custkey % 3 = 0 THEN c_name || '-new' ELSE c_name END AS name FROM customer UNION ALL SELECT c_custkey + 1000000, c_name FROM customer WHERE c_custkey % 5 = 0""")
def upsert_projects(spark, d):
    c = t.read(spark, d, "customer")
    old = c.select(F.col("c_custkey").alias("project_id"), F.col("c_name").alias("name"))
    new = c.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("project_id"), F.concat("c_name", _lit("-new")).alias("name"))
    return store.upserted(old, new.unionByName(c.where("c_custkey % 5 = 0").select((F.col("c_custkey") + 1000000).alias("project_id"), F.col("c_name").alias("name"))), ["project_id"])


@query()
def embed_texts(spark, d):
    b = t.read(spark, d, "benchmark")
    return b.select("item_id", models.embedded(F.col("text"), models.HashingEmbedder(64)).alias("embedding"))


@query(f"SELECT item_id, array_to_string(regexp_extract_all(strip_accents(lower(text)), '[\\p{{L}}\\p{{N}}]+'), ' ') AS tokens FROM benchmark")
def tokenize(spark, d):
    return t.read(spark, d, "benchmark").select("item_id", F.array_join(tokens(F.col("text")), " ").alias("tokens"))


@query("SELECT doc_id, regexp_matches(text, '\\S') AS has_text FROM documents")
def blank_check(spark, d):
    return t.documents(spark, d).select("doc_id", (~is_blank(F.col("text"))).alias("has_text"))
