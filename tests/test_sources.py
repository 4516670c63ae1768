import os

import pytest
from pyspark.sql import functions as F

from lodestone.sources import config, discovery, ignore
from lodestone.sources.store import Store, latest_per_key, upserted


def write(root, files):
    for name, data in files.items():
        path = os.path.join(root, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            f.write(data if isinstance(data, bytes) else data.encode())


@pytest.mark.parametrize("rules,path,gone", [("*.log", "a/x.log", True), ("/x", "a/x", False), ("/x", "x", True), ("build/", "build/a.c", True), ("build/", "build", False), ("*.log\n!keep.log", "keep.log", False), ("a/**/b", "a/x/y/b", True), ("a/**", "a/b", True), ("doc/*.txt", "doc/x/y.txt", False), ("[ab].c", "b.c", True), ("dir\n!dir/x", "dir/x", True), ("# c\n\n", "c", False)])
def test_ignore_rules(rules, path, gone):
    assert ignore.ignored(path, ignore.parse(rules)) is gone


def test_walk(spark, tmp_path):
    root = str(tmp_path)
    write(root, {"src/a.rs": "fn a() {}", "b.py": "x = 1", ".hidden.py": "x", "node_modules/m.js": "x", "z.bin.txt": b"\0" * 100, "big.md": "y" * 500, "c.lock": "l", "sub/.gitignore": "skip.py\n", "sub/skip.py": "x", "sub/keep.py": "x", ".indexignore": "never.py\n", "never.py": "x", "empty.txt": ""})
    c = config.Config()
    c.indexing.max_file_size_bytes = 400
    paths = lambda **k: {r.path for r in discovery.walk(spark, root, c, **k).select("path").collect()}
    assert paths() == {"src/a.rs", "b.py", "sub/keep.py"}
    assert {".hidden.py", "node_modules/m.js", "sub/skip.py", "c.lock"} <= paths(everything=True) and "never.py" not in paths(everything=True)
    text = {r.path: r for r in discovery.with_text(discovery.walk(spark, root, c)).collect()}
    assert text["b.py"].content == "x = 1" and text["b.py"].language == "python" and len(text["b.py"].content_hash) == 64


def test_projects_on_disk(tmp_path):
    root = str(tmp_path)
    write(root, {"one/Cargo.toml": "", "one/inner/go.mod": "", "two/x.sln": "", "node_modules/p/package.json": "", "deep/a/b/c/d/go.mod": "", "x.sln.bak/y": ""})
    assert [os.path.relpath(p, root) for p in discovery.scan_for_projects(root)] == ["one", "two"]
    assert not discovery.is_project_directory(os.path.join(root, "missing"))


def test_config(tmp_path):
    c = config.loads("[query]\ntop_k = 3\n")
    assert c.query.top_k == 3 and c.query.broad_k == 50 and len(c.ignore_patterns) == 24
    for bad in ("[query]\ntop_k = 0", "[generation]\ntemperature = 3.0", "[generation]\ntemperature = -0.5", "[embedding]\nbatch_size = 0", "[indexing]\nmax_file_size_bytes = 0"):
        with pytest.raises(config.ConfigError):
            config.loads(bad)
    assert config.loads(config.dumps(c)) == c
    assert config.set_value(c, "query.hybrid", "false").query.hybrid is False
    with pytest.raises(config.ConfigError):
        config.set_value(c, "query.nothing", "1")
    path = str(tmp_path / "k" / "api.key")
    config.save_private(path, "s")
    assert os.stat(path).st_mode & 0o777 == 0o600


def test_store_versions_and_cascade(spark, tmp_path):
    s = Store(spark, str(tmp_path / "store"))
    assert s.table("files").count() == 0 and s.version() == 0
    ts = F.current_timestamp()
    files = spark.range(4).select(F.col("id").alias("file_id"), (F.col("id") % 2).alias("project_id"), F.col("id").cast("string").alias("path"), F.lit("h").alias("content_hash"), F.lit("c").alias("language"), F.lit(1).cast("long").alias("size_bytes"), F.lit(1).alias("chunk_count"), ts.alias("indexed_at"))
    chunks = spark.range(8).select(F.col("id").alias("chunk_id"), (F.col("id") % 4).alias("file_id"), (F.col("id") % 2).alias("project_id"), F.lit("x").alias("content"), F.lit(None).cast("string").alias("symbol"), F.lit(None).cast("string").alias("symbol_kind"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), F.lit("c").alias("language"), F.lit(False).alias("suspicious"))
    projects = spark.range(2).select(F.col("id").alias("project_id"), F.col("id").cast("string").alias("name"), F.lit("/p").alias("path"), ts.alias("created_at"), ts.alias("last_indexed_at"))
    assert s.commit({"files": files, "chunks": chunks, "projects": projects}) == 1
    s.delete("projects", spark.createDataFrame([(1,)], "project_id long"), "project_id")
    assert [r.file_id for r in s.table("files").orderBy("file_id").collect()] == [0, 2] and s.table("chunks").count() == 4 and s.version() == 2
    assert not [f for f in os.listdir(str(tmp_path / "store")) if f.startswith("CURRENT.")]


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert {tuple(r) for r in upserted(old, new, ["k"]).collect()} == {(1, "a"), (2, "c"), (3, "d")}
    assert {tuple(r) for r in latest_per_key(old.union(new), ["k"], ["v"]).collect()} == {(1, "a"), (2, "c"), (3, "d")}
