"""Searches in which every query meets every document."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from colonnade.operators.keyword import Chunk, Keywords, lists, rounded
from colonnade.plans.queries import ORACLE, QUERIES
from tests.oracle import connect, same

NAMES = ["bm25_search", "hybrid_search", "two_path_topk", "union_topk", "value_aware_limit", "facet_search", "query_collisions", "rrf_fusion", "sparse_dot_search"]


def shuffled(spark) -> int:
    """Rows that all stages so far have written to shuffles."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(10_000)
    stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


@pytest.fixture(scope="module")
def directory(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("common"))
    docs = [(i, f"entry sum code k{i % 7} {'code ' * (i % 5)}", ("Code wiki", "wiki", None)[i % 3], ("A", "b")[i % 2]) for i in range(1500)]
    spark.createDataFrame(docs, "doc_id bigint, text string, source string, database_id string").coalesce(2).write.parquet(f"{d}/documents.parquet")
    asked = [(100 * i, f"sum of code{', wiki' * (i % 2)} entry k{i % 9} x{i}", "aB"[i % 2]) for i in range(40)]
    spark.createDataFrame(asked, "query_id bigint, question string, db_id string").coalesce(1).write.parquet(f"{d}/nl2sql_query.parquet")
    return d


@pytest.mark.parametrize("name", NAMES)
def test_hits_are_not_shuffled(spark, directory, name):
    before = shuffled(spark)
    same(spark, name, QUERIES[name], ORACLE[name], connect(directory), directory)
    assert shuffled(spark) - before < 1500 * 40 / 2


@pytest.fixture(scope="module")
def every(spark, tmp_path_factory):
    """Questions with any key, some with equal tokens, none, or none that a document has."""
    d = str(tmp_path_factory.mktemp("every"))
    docs = [(i, f"entry sum code k{i % 7} m{i % 31} {'code ' * (i % 5)}{'wide ' * (i % 3)}") for i in range(400)] + [(400, None), (401, "")]
    spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4).write.parquet(f"{d}/documents.parquet")
    asked = [(i, f"sum of code{', wide' * (i % 2)} k{i % 9} m{i % 40}") for i in range(60)] + [(60, "sum of code k0 m0"), (61, None), (62, ""), (63, "zebra"), (64, "m3 zebra")]
    spark.createDataFrame(asked, "query_id bigint, question string").coalesce(1).write.parquet(f"{d}/nl2sql_query.parquet")
    return d


def test_hybrid_search_answers_every_question(spark, every):
    assert "% 100" not in ORACLE["hybrid_search"]
    same(spark, "hybrid_search", QUERIES["hybrid_search"], ORACLE["hybrid_search"], connect(every), every)
    assert {r.query for r in QUERIES["hybrid_search"](spark, every).collect()} == {*range(61), 64}


def test_hybrid_over_several_chunks(spark, every):
    def run(spark, d):
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
        try:
            docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("doc"), "text")
            asked = spark.read.parquet(f"{d}/nl2sql_query.parquet").select(F.col("query_id").alias("query"), F.col("question").alias("text"))
            out = Keywords(spark, docs, asked, sparse=True).hybrid(10, block=25, chunk=150)
            assert out.count()
            return spark.createDataFrame(out.toPandas())
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")

    same(spark, "hybrid_search", run, ORACLE["hybrid_search"], connect(every), every)


@pytest.mark.parametrize("dense", [0, 5, 160])
def test_chunk_leaves_out_none_of_the_best(monkeypatch, dense):
    monkeypatch.setattr(Chunk, "DENSE", dense)
    rng = np.random.default_rng(3)
    n, words = 3000, 400
    texts = [np.unique(np.minimum(rng.zipf(1.2, rng.integers(1, 120)) - 1, words - 1), return_counts=True) for _ in range(n)]
    texts[10:20] = texts[:10]  # ties
    count, code, tf = np.array([len(c) for c, _ in texts]), np.concatenate([c for c, _ in texts]), np.concatenate([f for _, f in texts])
    row, size, df = np.repeat(np.arange(n), count), np.array([f.sum() for _, f in texts]), np.bincount(code, minlength=words).astype(float)
    log = np.log(1 + n / np.maximum(df, 1))
    square = np.bincount(row, (tf * log[code]) ** 2, n)
    doc = rng.permutation(n)
    data = pa.table({"doc": doc, "length": size, "codes": lists(pa.array(code.astype(np.int32)), count), "tfs": lists(pa.array(tf.astype(np.int32)), count), "square": square})
    docs = Chunk(data, df, n, size.mean(), 1.5, 0.75)
    wb = np.log(1 + (n - df + 0.5) / (df + 0.5))[code] * tf * 2.5 / (tf + (1.5 * (0.25 + 0.75 * size / size.mean()))[row])
    ws = tf * log[code] ** 2 / np.sqrt(square[row])
    for _ in range(100):
        asked = np.unique(rng.choice(words, rng.integers(1, 25)))
        asked = asked[df[asked] > 0]
        if not len(asked):
            continue
        own = np.isin(code, asked)
        bm, dot = rounded(np.bincount(row[own], wb[own], n)), np.bincount(row[own], ws[own], n)
        score = rounded(0.5 * (bm / bm.max()) + 0.5 * rounded(dot / np.sqrt((log[asked] ** 2).sum())))
        order = [i for i in np.lexsort((doc, -score)) if dot[i] > 0][:10]
        assert docs.best(asked, 1)[1][0] == pytest.approx(bm.max())
        ids, found = docs.best(asked, 10, 0.5, bm.max())
        assert ids.tolist() == doc[order].tolist() and np.allclose(found, score[order], atol=1e-9)
