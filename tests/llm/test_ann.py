import numpy as np
from pyspark.sql import functions as F

from sedgewren.llm import ann


def test_search_of_a_dense_cluster_among_scattered_rows(spark):
    """Codes fitted to scattered rows cannot tell those of a dense cluster apart."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(12000, 48))
    x[::2] = rng.normal(size=48) + rng.normal(size=(6000, 48)) * 1e-2
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.search(table, F.col("id") % 500 == 0).toPandas()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(0, 12000, 500):
        near = u @ u[q]
        near[q] = -2
        assert got[got.query_id == q].sort_values("rank").vec_id.tolist() == np.argsort(-near)[:5].tolist()
