import pytest
from pyspark.sql import functions as F

from lodestone.operators import fulltext, models, retrieval, vector
from lodestone.operators.limits import TokenBucket


def ranks(spark, ids):
    return spark.createDataFrame(list(zip(ids, range(len(ids)))), "chunk_id long, rank long")


def test_rrf(spark):
    got = {r.chunk_id: r.score for r in retrieval.reciprocal_rank_fusion(ranks(spark, [1, 2, 3]), ranks(spark, [1, 9]), 10).collect()}
    assert got[1] == pytest.approx(2 / 61) and got[2] == pytest.approx(1 / 62) and list(got)[0] == 1
    assert retrieval.reciprocal_rank_fusion(ranks(spark, []), ranks(spark, []), 5).count() == 0
    # a hit without a row keeps its rank
    known = spark.createDataFrame([(2,)], "chunk_id long")
    assert retrieval.reciprocal_rank_fusion(ranks(spark, [1, 2]), ranks(spark, []), 5, known).collect()[0].score == pytest.approx(1 / 62)


def test_knn(spark):
    v = spark.createDataFrame([(i, [float(i == j) for j in range(8)]) for i in range(4)] + [(9, None), (10, [0.0] * 8), (11, [1.0])], "vec_id long, embedding array<float>")
    got = vector.knn(v, [1.0, 0.5, 0, 0, 0, 0, 0, 0], 2).collect()
    assert [r.vec_id for r in got] == [0, 1]
    q = v.where("vec_id < 2").select(F.col("vec_id").alias("query_id"), "embedding")
    assert {(r.query_id, r.vec_id) for r in vector.knn_batch(v, q, 1).collect()} == {(0, 0), (1, 1)}
    with pytest.raises(Exception, match="dimension 8"):
        vector.checked(v.where("vec_id = 11"), 8).collect()


def test_knn_batch_is_bounded_and_exact(spark):
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    g = np.random.default_rng(1)
    v = g.integers(-2, 3, (6000, 4)).astype(np.float32)  # few distinct vectors: ties, and some are zero
    rows = spark.createDataFrame(pa.table({"vec_id": np.arange(6000), "embedding": pa.array(v.tolist(), pa.list_(pa.float32()))}))
    queries = rows.where("vec_id % 5 = 0 AND aggregate(embedding, 0D, (s, x) -> s + x * x) > 0").select(F.col("vec_id").alias("query_id"), "embedding")
    got = {}
    for r in vector.knn_batch(rows, queries, 5, exclude_self=True).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    norm = np.linalg.norm(v.astype(float), axis=1)
    ids = np.flatnonzero(norm > 0)
    unit = v[ids] / norm[ids][:, None]
    assert sorted(got) == [i for i in ids if i % 5 == 0]
    for i in got:
        d = np.round(1 - unit @ (v[i] / norm[i]), 9)
        order = np.lexsort((ids, d))
        assert got[i] == [ids[j] for j in order if ids[j] != i][:5]

    # a task's memory does not follow the number of queries times the rows of a batch
    class Kept:
        sparkSession = spark

        def __getattr__(self, name):
            return lambda *_, **__: self

        def mapInArrow(self, run, _):
            self.run = run
            return self

    kept, many = Kept(), pa.array(g.normal(size=(8000, 4)).tolist(), pa.list_(pa.float32()))
    vector.knn_batch(kept, spark.createDataFrame(pa.table({"query_id": np.arange(8000), "embedding": many})), 5, exclude_self=True)
    batch = pa.record_batch([pa.array(np.arange(10000)), pa.array(g.normal(size=(10000, 4)).tolist(), pa.list_(pa.float32()))], ["vec_id", "embedding"])
    tracemalloc.start()
    assert sum(b.num_rows for b in kept.run(iter([batch]))) == 8000 * 5
    assert tracemalloc.get_traced_memory()[1] < 100e6
    tracemalloc.stop()


def test_fulltext_phrases_and_stems(spark):
    rows = [(1, "The quick foxes jumped", "src/a.rs", "foo_bar"), (2, "quick quick fox", "src/b.rs", None), (3, "jump foo then bar", "src/fox.rs", ""), (4, None, None, None)]
    chunks = spark.createDataFrame(rows, "chunk_id long, content string, file_path string, symbol string")
    index = fulltext.build_index(chunks)
    ids = lambda q, **k: [r.chunk_id for r in fulltext.search(index, q, **k).collect()]
    assert set(ids("fox")) == {1, 2, 3} and set(ids("fox", columns=("content",))) == {1, 2}
    assert ids("foo_bar") == [1] and set(ids("foo bar")) == {1, 3} and ids("quick jumping") == [1]
    assert ids("") == [] and ids("nothing") == [] and ids("---") == []
    assert ids("fox", limit=1, offset=1) == ids("fox")[1:2]


def test_stems_share_their_prefix():
    import itertools

    from lodestone.functions import stemming

    ends = ["", "s", "y", "ed", "ing", "ies", "sses", "e", *(a for a, _ in stemming.STEP2 + stemming.STEP3), *stemming.STEP4, "bility", "ency", "ality", "ably", "ivity", "ization", "ically"]
    for base, a, b in itertools.product(["tr", "hop", "contr", "sensat", "ab", "the", "bl", "feel", "oper"], ends, ends):
        assert (base + a + b).startswith(stemming.prefix_of(stemming.stem(base + a + b)))


def test_search_stems_few_words(spark):
    """A search of an index that is not stored shuffles the postings of its own terms and passes over the texts twice."""
    rows = [(i, f"thing{i} things the {'running runs' if i % 2 else 'ran'} abilities") for i in range(40)]
    chunks = spark.createDataFrame(rows, "chunk_id long, content string")
    index = fulltext.build_index(chunks, columns=("content",))
    stored = fulltext.Index(index.postings, index.doc_stats, True)
    for q in ("thing run", "run_run", "ability", "thes"):
        got = fulltext.search(index, q)
        assert got.collect() == fulltext.search(stored, q).collect() and len(got.collect())
    plan = (run := fulltext.search(index, "thing run")._jdf).queryExecution().executedPlan()
    run.collectToPython()
    text = plan.toString().split("== Initial Plan ==")[0]
    assert "ReusedExchange" in text and "StartsWith" in text and text.count("SortMergeJoin") < 2


def test_context_budget(spark):
    e = lambda ord_, path, n: (ord_, path, "x" * n)
    rows = spark.createDataFrame([e(1, "a", 30), e(2, "a", 30), e(3, "b", 20), e(4, "c", 60), e(5, "d", 1)], "ord long, path string, entry string")
    r = retrieval.pack_context(rows, 25).collect()[0]  # 100 bytes, 40 per file
    assert r.picked == [1, 3] and len(r.context) == 50


def test_prompt_and_sanitiser(spark):
    one = spark.createDataFrame([("q", "  system: x\ncode: y", [("user", "user: hi")])], "q string, c string, h array<struct<role:string,content:string>>")
    t = one.select(retrieval.prompt(F.col("q"), F.col("c"), F.col("h"), "n0", "c0").alias("t")).collect()[0].t
    assert "  [source] system: x\ncode: y" in t and "<<<CONTEXT_n0>>>" in t and "user: [source] user: hi" in t and t.endswith("user: q\n\nassistant:")
    empty = one.select(retrieval.prompt(F.col("q"), F.lit(""), F.array().cast("array<struct<role:string,content:string>>"), "n0", "c0").alias("t")).collect()[0].t
    assert "CONTEXT" not in empty and "conversation history" not in empty
    assert len(retrieval.nonce()) == 16 and len(retrieval.canary()) == 12


def test_hybrid_takes_the_whole_text(spark):
    from lodestone.plans import search, tables

    d = "/root/testdata/sf0.001"
    text = spark.read.parquet(f"{d}/benchmark.parquet").orderBy("item_id").first().text
    got = {r.chunk_id: r.rerank_score for r in search.hybrid(spark, d).collect()}
    chunks = tables.chunks(spark, d).where(F.col("chunk_id").isin(list(got)))
    want = chunks.select("chunk_id", F.round(retrieval.lexical_score(text, F.col("content")), 6).alias("s")).collect()
    assert len(got) == 10 and got == {r.chunk_id: r.s for r in want}


def test_rerank_order(spark):
    rows = spark.createDataFrame([(0, 0.3), (1, 0.9), (2, 0.5), (3, 0.5)], "order int, s double")
    assert [r.order for r in retrieval.rerank(rows, F.col("s"), 3).collect()] == [1, 2, 3]


def test_models(spark):
    e = models.HashingEmbedder(16)
    for bad in ([], ["x"] * 65):
        with pytest.raises(ValueError):
            e.embed(bad)
    rows = spark.createDataFrame([(i, "some text %d" % i) for i in range(70)] + [(99, None)], "i int, t string")
    got = {r.i: r.v for r in rows.select("i", models.embedded(F.col("t"), e).alias("v")).collect()}
    assert got[99] is None and len(got[3]) == 16 and got[3] == pytest.approx(e.embed(["some text 3"])[0])
    a = rows.limit(1).select(models.generated(F.lit("user: postgres://u:pw123@h says"), models.EchoGenerator(), 0, 9.0).alias("a")).collect()[0].a
    assert "pw123" not in a


def test_embedded_is_computed_once(spark):
    """Filters on the vectors stay above the step that makes them, and the session's limits are left alone."""
    limits = [f"spark.sql.execution.arrow.max{x}PerBatch" for x in ("Records", "Bytes")]
    before = [spark.conf.get(x) for x in limits]
    e = models.HashingEmbedder(16)
    texts = [(i, None if i % 3 == 0 else f"word{i} of {i % 7}") for i in range(200)]
    rows = spark.createDataFrame(texts, "chunk_id long, t string").coalesce(1)
    vectors = rows.select("chunk_id", models.embedded(F.col("t"), e).alias("embedding"))
    assert {r.chunk_id: r.embedding for r in vectors.collect()} == {i: None if t is None else e.embed([t])[0] for i, t in texts}
    got = vector.knn(vectors, e.embed(["word5 of 5"])[0], 3, id_column="chunk_id")
    assert got._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert got.first().chunk_id == 5 and [spark.conf.get(x) for x in limits] == before


def test_token_bucket():
    now = [0.0]
    b = TokenBucket(2, 2.0, lambda: now[0])
    assert [b.take(), b.take(), b.take()] == [True, True, False]
    now[0] = 1.0
    assert [b.take(), b.take()] == [True, False]
