"""Vectors whose components are beyond 32 bits once scaled."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loam.llm import topk

from .test_tables import plain_top


@pytest.mark.parametrize("sizes", [(5000.0,), (5000.0, 1e6), (1e6, 3e9, 1e30), (1e300, 1.7e308)])
def test_wide_vectors_take_part(spark, sizes):
    rng = np.random.default_rng(11)
    rows = [(i, [float(x) for x in rng.normal(size=8) / 3]) for i in range(250)]
    rows += [(250 + n, [float(x * (size if n % 3 else 1)) for x in rng.uniform(-1, 1, size=8)]) for n, size in enumerate(list(sizes) * 40)]
    rows += [(600, [sizes[0]] * 8), (650, [-sizes[-1]] * 8), (701, [sizes[-1]] * 8), (702, [sizes[-1]] * 8), (750, [float("inf")] + [0.0] * 7), (751, [None] + [9e5] * 7), (752, [float("nan")] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = [tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()]
    want = [(q, rank, i, s if -(2**63) <= s < 2**63 else None) for q, rank, i, s in plain_wide(rows)]
    assert got == want and {600, 650} <= {q for q, *_ in got} and 750 not in {q for q, *_ in got}


def plain_wide(rows):
    """plain_top, on numbers whose floor(256 * x) a double need not hold."""

    class Number(float):
        def __rmul__(self, by):
            return by * int(self) if abs(self) > 2**60 else by * float(self)

    return plain_top([(i, v and [x if x is None else Number(x) for x in v]) for i, v in rows])


def test_shards_of_wide_vectors_merge(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 100)
    rng = np.random.default_rng(12)
    rows = [(i, [float(x) for x in rng.normal(size=4) * (1, 6e3, 1e12)[i % 3]]) for i in range(400)]
    got = [tuple(r) for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(7), F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(q, rank, i, s if -(2**63) <= s < 2**63 else None) for q, rank, i, s in plain_wide(rows)]
