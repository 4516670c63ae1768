"""The registered queries of this subpackage and, where SQL can express one, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kneser_ney, media, mixing, neardup, packing, quality, secrets, sharding, urlfilter, vptree
from .common import LOWER, UPPER, WORD


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.filter_urls(table(spark, sf_dir, "pages"))


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score_quality(docs, table(spark, sf_dir, "labels"), folds=4, held=2)
    return scored.select("doc_id", F.coalesce(quality.fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), F.col("_score").alias("score"), F.col("_predicted").alias("predicted"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_documents(table(spark, sf_dir, "documents"))
    shown = F.transform("output_shards", lambda s: F.concat_ws(":", s["output_shard"].cast("string"), s["words"].cast("string")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.array_join(shown, ",").alias("output_shards"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=3, percent=85)


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vptree.nearest(table(spark, sf_dir, "embeddings"), k=5, every=50)


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_of(table(spark, sf_dir, "documents"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.score_documents(table(spark, sf_dir, "documents"), folds=5, fold=1)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_url_filters, op2_secret_scans, op3_packing, op4_quality, op5_sharding, op6_mixing, op7_near_duplicates, op8_nearest_neighbours, op9_media, op10_lm_scoring)}


def _values(rows: list[tuple]) -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)
    return ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows)


_URL_SQL = f"""WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
rules(verdict, rule, h, p) AS (VALUES {_values([(v, r, r[: r.index("/")], r[r.index("/") :]) for v, r in urlfilter.RULES])}), blocked(h) AS (VALUES {_values([(h,) for h in urlfilter.BLOCKED_HOSTS])}),
fits AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM u JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id),
listed AS (SELECT DISTINCT page_id FROM u JOIN blocked ON host = h OR ends_with(host, '.' || h))
SELECT u.page_id, host, path, rule, coalesce(verdict, CASE WHEN listed.page_id IS NULL THEN 'allow' ELSE 'block' END) AS verdict FROM u LEFT JOIN fits USING (page_id) LEFT JOIN listed USING (page_id)"""


def _matches_sql(kind: str, pattern: str, group: int) -> str:
    p = "'" + pattern.replace("'", "''") + "'"
    length = lambda x: f"coalesce(list_sum(list_transform({x}, lambda x: length(x))), 0)"
    return f"""SELECT doc_id, {kind} AS k, CAST({length('g[1:i]')} + {length('m[1:i - 1]')} AS BIGINT) AS s, CAST(length(m[i]) AS BIGINT) AS n, m[i] AS m, t[i] AS tested
FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, {p}) AS m, regexp_extract_all(text, {p}, {group}) AS t, regexp_split_to_array(text, {p}) AS g FROM documents WHERE regexp_matches(text, {p})))"""


_NAMES = ", ".join(f"'{k}'" for k in secrets.KINDS)
_SECRET_SQL = f"""WITH found AS ({_matches_sql("0", secrets.ASSIGN, 1)} UNION ALL {_matches_sql("1", secrets.ACCESS, 0)} UNION ALL {_matches_sql("2", secrets.HEX, 0)}),
candidates AS ({_matches_sql("4", secrets.CANDIDATE, 0)}),
scored AS (SELECT *, regexp_full_match(m, '[0-9a-fA-F]+') AS hexed, list_max(list_transform(range(1, length(m) - {secrets.WINDOW - 2}), lambda i: list_aggregate(string_split(substr(m, i, {secrets.WINDOW}), ''), 'entropy'))) AS bits FROM candidates
WHERE regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]') AND NOT regexp_matches(m, '{secrets.ALLOWED}')),
base AS (SELECT doc_id, k, s, n FROM found WHERE k > 0 OR length(tested) >= {secrets.ASSIGN_LEAST}),
every AS (SELECT * FROM base UNION ALL SELECT doc_id, CASE WHEN hexed THEN 3 ELSE 4 END, s, n FROM scored WHERE bits >= CASE WHEN hexed THEN {secrets.THRESHOLD["entropy_hex"]} ELSE {secrets.THRESHOLD["entropy_base64"]} END),
written AS (SELECT doc_id, string_agg([{_NAMES}][k + 1] || ':' || s || ':' || (s + n), ',' ORDER BY s, k) AS spans, string_agg([{_NAMES}][k + 1] || ':' || s || ':' || (s + n), ',' ORDER BY s, k) FILTER (k < 3) AS b,
count(*) FILTER (k = 0) AS a, count(*) FILTER (k = 1) AS c, count(*) FILTER (k = 2) AS h FROM every GROUP BY doc_id)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(c, 0) AS n_access, coalesce(h, 0) AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents LEFT JOIN written USING (doc_id)"""

_NEAR_SQL = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS l FROM documents),
sets AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(l) >= 3 THEN list_transform(range(1, len(l) - 1), lambda i: l[i] || ' ' || l[i + 1] || ' ' || l[i + 2]) WHEN len(l) > 0 THEN [array_to_string(l, ' ')] ELSE [] END) AS g FROM w),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sets a JOIN sets b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
both_ AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id AS v, doc_id AS r FROM documents UNION SELECT reach.v, both_.b FROM reach JOIN both_ ON reach.r = both_.a)
SELECT d.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(r) AS component_id, d.doc_id = min(r) AS kept FROM documents d JOIN reach ON v = d.doc_id LEFT JOIN sizes ON sizes.doc_id = d.doc_id GROUP BY d.doc_id"""

ORACLE: dict[str, str] = {"op1_url_filters": _URL_SQL, "op2_secret_scans": _SECRET_SQL, "op7_near_duplicates": _NEAR_SQL}
