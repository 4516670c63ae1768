import pytest
from pyspark.sql import functions as F

from lodestone.functions import language, text
from lodestone.functions.stemming import stem


def test_language_mapping(spark):
    cases = {"a/b.rs": "rust", "x.pyi": "python", "x.jsx": "typescript", "x.RS": "unknown", "Makefile": "unknown", ".env": "env", ".ENV": "env", ".env.local": "env", "development.env": "env", "environment": "unknown", "envfile": "unknown", "k.cxx": "cpp", "a.b.yml": "yaml", ".rs": "unknown"}
    rows = spark.createDataFrame([(k,) for k in cases], "p string").select("p", language.language_of(F.col("p")).alias("l")).collect()
    assert {r.p: r.l for r in rows} == cases
    assert {k: language.detect(k) for k in cases} == cases


@pytest.mark.parametrize("word,root", [("caresses", "caress"), ("ponies", "poni"), ("motoring", "motor"), ("relational", "relat"), ("hopping", "hop"), ("sky", "sky"), ("happy", "happi"), ("electricity", "electr"), ("generalizations", "gener"), ("a", "a")])
def test_porter(word, root):
    assert stem(word) == root


def test_lines_and_sizes(spark):
    cases = {"a\nb\n": ["a", "b"], "a\r\nb": ["a", "b"], "": [], "\n": [""], "x": ["x"]}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", text.lines(F.col("t")).alias("l")).collect()
    assert {r.t: r.l for r in rows} == cases
    sizes = spark.createDataFrame([(0,), (1023,), (1024,), (1536,), (1 << 20,), (5 << 30,)], "n long").select(text.format_bytes(F.col("n")).alias("s")).collect()
    assert [r.s for r in sizes] == ["0 B", "1023 B", "1.0 KB", "1.5 KB", "1.0 MB", "5.0 GB"]


def test_tokens_fold(spark):
    r = spark.createDataFrame([("Éa foo_bar x1 — ñ",), (None,)], "t string").select(text.tokens(F.col("t")).alias("t")).collect()
    assert r[0].t == ["ea", "foo", "bar", "x1", "n"] and r[1].t == []


def test_like_escape():
    assert text.like_escaped("a%b_c\\") == "%a\\%b\\_c\\\\%"


def test_sizes_round_exact_ties_to_even(spark):
    from pyspark.sql import functions as F

    from lodestone.functions.text import format_bytes

    sizes = [0, 1023, 1024, 1280, 1331, 1332, 1792, 2304, 2816, 1310720, 1835008, 3 * 1024**3 // 2]
    got = spark.createDataFrame([(n,) for n in sizes], "n long").select("n", format_bytes(F.col("n")).alias("s")).collect()
    unit = lambda n: next((u, name) for u, name in ((1024**3, "GB"), (1024**2, "MB"), (1024, "KB"), (1, "B")) if n >= u or u == 1)
    for r in got:  # as IEEE formatting rounds
        u, name = unit(r.n)
        assert r.s == (f"{r.n / u:.1f} {name}" if u > 1 else f"{r.n} B")
