"""The vector index against the exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinloom.operators import documents, vectors


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<float>")


def recall(spark, rows, **how):
    q = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    model = vectors.fit(rows, **how)
    index = vectors.build(rows, model)
    assert index.count() == rows.where("embedding is not null and size(embedding) > 0").count()
    got = {(r.query_id, r.vec_id): r.cosine for r in vectors.search(q, rows, index, model).collect()}
    want = {(r.query_id, r.vec_id): r.cosine for r in documents.nearest(q, rows, 5).collect()}
    for k in got.keys() & want.keys():
        assert abs(got[k] - want[k]) < 1e-5
    return len(got.keys() & want.keys()) / len(want), model


def test_recall_of_clusters_with_few_probes(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 32))
    # A third of all vectors is one cluster.
    of = np.where(rng.random(4000) < 0.33, 0, rng.integers(0, 40, 4000))
    found, model = recall(spark, table(spark, enumerate(centres[of] + 0.25 * rng.normal(size=(4000, 32)))), parts=8)
    assert found >= 0.9
    assert model.probes < len(model.centroids) / 2


def test_recall_without_structure(spark):
    found, _ = recall(spark, spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet"))
    assert found >= 0.9


def test_rows_without_vectors_copies_and_odd_lengths(spark):
    rng = np.random.default_rng(2)
    rows = [*enumerate(rng.normal(size=(300, 7))), (1000, None), (1001, []), (1002, [0.0] * 7)]
    rows += [(2000 + i, rows[50][1]) for i in range(8)]
    df = table(spark, rows)
    found, _ = recall(spark, df.where("vec_id not in (1000, 1001, 1002)"), parts=4, recall=1.0)
    assert found >= 0.9
    model = vectors.fit(df, parts=4, recall=1.0)
    index = vectors.build(df, model)
    near = vectors.search(df.where("vec_id = 50").withColumnRenamed("vec_id", "query_id"), df, index, model).orderBy("rank").collect()
    assert [r.vec_id for r in near] == [2000, 2001, 2002, 2003, 2004] and all(abs(r.cosine - 1) < 1e-6 for r in near)


def test_no_vectors(spark):
    with pytest.raises(ValueError):
        vectors.fit(table(spark, []))
