"""Approximate vector search: recall measured against the exact one."""

from pyspark.sql import functions as F

from folioscope.operators import approximate as ap
from folioscope.operators import vectors as vx
from folioscope.plans.catalog import table


def test_recall_on_the_given_vectors_at_any_block_size(spark):
    v = table(spark, "/root/testdata/sf0.01", "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    q = v.filter("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "query_id")
    for options in ({}, {"block": 7, "part": 100}):
        r = ap.recall(q, v, 10, **options).first()
        assert r.n_true == q.count() * 10 and r.recall >= 0.9
    one, other = (ap.approximate_topn(q, v, 10, **o).select("query_id", "chunk_id", "vec_rank") for o in ({}, {"block": 7, "part": 100}))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, other.collect()))


def test_distances_are_exact_and_odd_vectors_take_no_part(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [0.6, 0.8]), (5, [-1.0, 0.0])], "chunk_id long, embedding array<double>")
    q = spark.createDataFrame([(7, [1.0, 0.0]), (8, None)], "query_id long, embedding array<double>")
    got = [tuple(r) for r in ap.approximate_topn(q, v, 2).orderBy("vec_rank").collect()]
    assert got == [(7, 1, 0.0, 1), (7, 4, 0.4, 2)]
    exact = vx.knn_topn(q, v.filter("chunk_id != 2"), 2).orderBy("vec_rank").collect()
    assert got == [tuple(r) for r in exact]
    assert ap.approximate_topn(q, v.limit(0), 2).count() == 0
