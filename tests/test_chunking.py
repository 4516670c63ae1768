import pytest

from lodestone.operators import chunking, syntax
from lodestone.plans import samples


def run(spark, f, content):
    rows = f(spark.createDataFrame([(1, content)], "file_id long, content string")).orderBy("ord").collect()
    return [(r.symbol, r.start_line, r.end_line, r.content) for r in rows]


@pytest.mark.parametrize("n,spans", [(1, [(1, 1)]), (3, [(1, 3)]), (60, [(1, 60)]), (61, [(1, 60), (56, 61)]), (100, [(1, 60), (56, 100)]), (120, [(1, 60), (56, 115), (111, 120)])])
def test_line_windows(spark, n, spans):
    got = run(spark, chunking.chunk_by_lines, "\n".join(["x"] * n))
    assert [(a, z) for _, a, z, _ in got] == spans


@pytest.mark.parametrize("text", [None, "", "\n\n  \n"])
def test_blank_texts_have_no_chunks(spark, text):
    for f in (chunking.chunk_by_lines, chunking.chunk_env, chunking.chunk_toml, chunking.chunk_yaml, chunking.chunk_json):
        assert run(spark, f, text) == []


def test_env(spark):
    got = run(spark, chunking.chunk_env, "A=1\n# c\n\n B = x=y \n")
    assert [(s, a) for s, a, _, _ in got] == [("A", 1), ("B", 4)] and got[1][3] == " B = x=y "


def test_toml(spark):
    assert [x[:3] for x in run(spark, chunking.chunk_toml, "# c\nk = 1\n[a]\nx = 1\n[dependencies.serde]\ny = 2")] == [("", 1, 2), ("a", 3, 4), ("dependencies.serde", 5, 6)]
    assert [x[:3] for x in run(spark, chunking.chunk_toml, "k = 1\n")] == [(None, 1, 1)]


def test_yaml(spark):
    got = run(spark, chunking.chunk_yaml, "---\nname: x\nsteps:\n  - a\n# c\n...\nlast: 1")
    assert [x[:3] for x in got] == [("name", 2, 2), ("steps", 3, 6), ("last", 7, 7)]


def test_json():
    assert [x[0] for x in chunking.scan_json('{"a": 1, "b": {"c": [1, "}"]}}')] == ["a", "b"]
    assert chunking.scan_json("{}") == [(None, "{}", 1, 1)] and chunking.scan_json("[1, 2]")[0][0] is None
    assert chunking.scan_json('{"a\\"b": "x\\"y"}') == [('a"b', '"a"b": "x\\"y"', 1, 1)]
    assert [x[2:] for x in chunking.scan_json('{\n"a": 1,\n"b": [\n1]\n}')] == [(2, 2), (3, 4)]
    assert chunking.scan_json('{"a": 1, "b"')[0][0] == "a"


def test_syntax_chunks_and_router(spark):
    rows = syntax.chunk_files(samples.sources(spark)).collect()
    by = {}
    for r in rows:
        by.setdefault(r.file_id, []).append(r.symbol)
    assert by[1] == ["Account", "Account", "deposit", "check_amount"] and "fingerprint" in by[2] and "lookup" in by[2]
    assert "total" in by[3] and by[4] == ["Total"] and by[12] == [None] and by[13] == [None]


def test_small_definitions_are_no_chunks():
    assert syntax.chunk_source("fn a() {}", "rust") == []


def test_top_level_statements_where_nothing_is_defined():
    python = "import os\n\nSETTINGS = {\n    'name': 'a name that is long',\n    'place': 'somewhere else',\n}\nif SETTINGS:\n    print('the settings are set', SETTINGS, os.sep)\n"
    assert [x[1:] for x in syntax.chunk_source(python, "python")] == [(None, "expression_statement", 3, 6), (None, "if_statement", 7, 8)]
    script = "import x from 'y';\n\nregister({\n  name: 'a handler for events',\n  handler: x.handle,\n});\n"
    assert [x[1:] for x in syntax.chunk_source(script, "javascript")] == [(None, "statement", 3, 6)]
    ruby = "if ready?\n  puts 'everything is ready for the start'\n  start_it\nend\nputs 'done'\n"
    assert [x[1:] for x in syntax.chunk_source(ruby, "ruby")] == [(None, "statement", 1, 4)]
    assert syntax.chunk_source("x = 1;\n", "javascript") == [] and syntax.chunk_source("", "go") == []
    both = "use std::collections::HashMap as AnotherNameForTheMap;\n\nfn long_enough() -> u64 {\n    let value = compute(1, 2, 3);\n    value\n}\n"
    assert [x[1] for x in syntax.chunk_source(both, "rust")] == ["long_enough"]


def test_call_graph(spark):
    d, c = syntax.extract_call_graph(samples.sources(spark))
    assert ("deposit", "check_amount") in {(r.caller_name, r.callee_name) for r in c.collect()}
    got = {(r.name, r.kind, r.scope) for r in d.collect()}
    assert ("lookup", "function", "Cache") in got and ("Total", "method", "Cart") in got and ("checkout", "method", "Shop") in got


def test_enrichment(spark):
    from pyspark.sql import functions as F

    e = lambda s, k, lang: spark.range(1).select(chunking.enrich(F.lit("p"), F.lit("c"), F.lit(s).cast("string"), F.lit(k).cast("string"), F.lit(lang)).alias("t")).collect()[0].t
    assert e("f", "function", "rust") == "File: p\nfunction: f\nLanguage: rust\n\nc" and e(None, "x", "unknown") == "File: p\n\nc"
