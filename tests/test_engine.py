import os
import shutil

import pytest
from pyspark.sql import functions as F

from lodestone.api import Engine, UnknownProject
from lodestone.operators.limits import RateLimited, TokenBucket
from lodestone.operators.models import HashingEmbedder

AUTH = "pub fn verify_password(password: &str, hash: &str) -> bool {\n    let digest = hash_password(password);\n    constant_time_eq(&digest, hash)\n}\n\npub fn hash_password(password: &str) -> String {\n    derive_key(password, ROUNDS)\n}\n"
TOKENS = "pub fn issue_token(user: &str) -> String {\n    let claims = build_claims(user);\n    sign_claims(&claims)\n}\n"


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("engine")
    for name, text in (("auth", AUTH), ("tokens", TOKENS)):
        os.makedirs(top / name / "src")
        (top / name / "Cargo.toml").write_text("[package]\nname = 'x'\n")
        (top / name / "src" / "lib.rs").write_text(text)
    e = Engine(spark, str(top / "store"), embedder=HashingEmbedder(64))
    e.top = top
    for name in ("auth", "tokens"):
        report = e.index(str(top / name))
        assert (report.indexed, report.unchanged, report.removed) == (2, 0, 0)
    return e


def test_reindex_skips_unchanged(engine):
    report = engine.index(str(engine.top / "auth"))
    assert (report.indexed, report.unchanged, report.removed) == (0, 2, 0)


def test_tools(engine):
    assert [(r.name, r.file_count) for r in engine.list_projects().collect()] == [("auth", 2), ("tokens", 2)]
    hits = engine.search_code("password hash", "auth").collect()
    assert hits and all("src" in r.path or "Cargo" in r.path for r in hits) and "password" in hits[0].content
    assert "claims" in engine.find_similar_code(TOKENS, "tokens", 2).collect()[0].content
    assert {r.symbol for r in engine.search_symbols("password").collect()} == {"verify_password", "hash_password"}
    assert engine.search_symbols("%").count() == 0
    assert engine.get_file("src/lib.rs", "auth", 1, 2).count() == 1
    assert [r.name for r in engine.find_callers("hash_password", "auth").collect()] == ["verify_password"]
    assert [r.name for r in engine.find_callees("verify_password", "auth").collect()] == ["hash_password"]
    assert engine.text_search("claims", "tokens").count() >= 1 and engine.text_search("claims", "auth").count() == 0
    p = engine.project_patterns("auth")
    assert {r.name for r in p["directories"].collect()} == {"src", "Cargo.toml"} and {r.name for r in p["languages"].collect()} == {"rust", "toml"}
    assert engine.list_definitions("auth", "function").count() == 2
    assert engine.status().count() == 2


def test_questions_and_sessions(engine):
    a = engine.query("how is a password verified?", "auth")
    assert any("lib.rs" in s for s in a.sources) and not a.warned
    s = engine.create_session("tokens")
    engine.chat(s, "who signs claims?")
    b = engine.chat(s, "and then?", languages=["rust"])
    assert all("lib.rs" in x for x in b.sources)
    assert engine.store.table("turns").where(F.col("session_id") == s).count() == 4
    with pytest.raises(KeyError):
        engine.chat("nobody", "x")


def test_projects_by_folder(engine):
    auth = engine.resolve("auth")
    assert engine.resolve(folder=str(engine.top / "auth" / "src")) == auth
    with pytest.raises(UnknownProject):
        engine.resolve("nothing")
    with pytest.raises(UnknownProject):
        engine.resolve()


def test_stream_of_changes(engine, spark, tmp_path):
    src = engine.top / "auth" / "src"
    (src / "extra.rs").write_text("pub fn extra_function_name(value: u32) -> u32 {\n    value + other_function(value)\n}\n")
    feed = str(tmp_path / "feed")
    rows = [(1, str(src / "extra.rs"), "modify", "2024-01-01 00:00:00"), (1, str(src / "extra.rs"), "modify", "2024-01-01 00:00:01")]
    spark.createDataFrame(rows, "project_id long, file_path string, event_type string, t string").withColumn("queued_at", F.to_timestamp("t")).drop("t").write.parquet(feed)
    stream = spark.readStream.schema("project_id long, file_path string, event_type string, queued_at timestamp").parquet(feed)
    seen = []
    engine.watch(stream, "auth", str(tmp_path / "ckpt"), once=True, after=seen.append).awaitTermination(120)
    assert [(r.indexed, r.removed) for r in seen] == [(1, 0)]
    assert engine.search_symbols("extra_function").count() == 1
    os.remove(src / "extra.rs")
    gone = spark.createDataFrame([(str(src / "extra.rs"), "delete")], "file_path string, event_type string")
    engine.reindex(gone, "auth")
    assert engine.search_symbols("extra_function").count() == 0 and engine.search_symbols("password").count() == 2


def test_sync_and_remove(engine):
    shutil.rmtree(engine.top / "tokens" / "src")
    reports = engine.sync()
    assert reports["tokens"].removed == 1 and reports["auth"].indexed == 0
    engine.remove("tokens")
    assert [r.name for r in engine.list_projects().collect()] == ["auth"] and engine.store.table("chunks").select("project_id").distinct().count() == 1


def test_rate_limit(engine, spark):
    engine.limiter = TokenBucket(1, 3600)
    engine.list_projects()
    with pytest.raises(RateLimited):
        engine.list_projects()


def test_ids_that_clash_are_hashed_again(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("lodestone.api.FILE_BITS", 3)
    monkeypatch.setattr("lodestone.api.PROJECT_BITS", 1)
    e = Engine(spark, str(tmp_path / "store"), embedder=HashingEmbedder(16))
    for project, names in (("one", "abcd"), ("two", "ef")):
        os.makedirs(tmp_path / project)
        for n in names:
            (tmp_path / project / f"{n}.md").write_text(f"text of {n}\n")
        e.index(str(tmp_path / project))
    ids = lambda: {(r.project_id, r.path): r.file_id for r in e.store.table("files").collect()}
    before = ids()
    assert len(before) == 6 == len(set(before.values())) and len({p for p, _ in before}) == 2
    (tmp_path / "one" / "a.md").write_text("another text\n")
    (tmp_path / "one" / "g.md").write_text("text of g\n")
    assert e.index(str(tmp_path / "one")).indexed == 2
    after = ids()
    assert len(set(after.values())) == 7 and all(after[k] == v for k, v in before.items())
    assert e.store.table("chunks").select("chunk_id").distinct().count() == 7
