import random
import statistics

import numpy as np
from pyspark.sql import functions as F

from sondage.functions import quantiles


def test_against_numpy(spark):
    rng = random.Random(1)
    groups = {"a": [rng.random() for _ in range(5001)], "b": [rng.choice([1.0, 2.0, 2.5]) for _ in range(400)], "c": [7.0], "d": [rng.gauss(0, 1e9) for _ in range(20_000)], "e": [1.0, 2.0]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("a", None), ("f", None), ("a", float("nan")), (None, 3.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    for q in (0.0, 1 / 3, 0.5, 1.0):
        got = {r.g: (r.n, r.quantile) for r in quantiles.exact_quantile(df.filter("g IS NOT NULL"), ["g"], "v", q).collect()}
        assert got.keys() == groups.keys()
        for g, vs in groups.items():
            assert got[g][0] == len(vs) and np.isclose(got[g][1], np.quantile(vs, q), rtol=1e-12), (g, q)
        narrowed = {r.g: r.quantile for r in quantiles.exact_quantile(df.filter("g IS NOT NULL"), ["g"], "v", q, ranked=50).collect()}
        assert narrowed == {g: x[1] for g, x in got.items()}, q  # the same by brackets, with ties and skew
    every = [v for vs in groups.values() for v in vs] + [3.0]
    assert quantiles.exact_quantile(df, [], "v", 0.5).first().quantile == statistics.median(every)
    assert quantiles.exact_quantile(df.limit(0), ["g"], "v", 0.5).count() == 0
    low = quantiles.order_statistics(df.filter("g IS NOT NULL"), ["g"], "v", [lambda n: n - 1, lambda n: F.lit(0), lambda n: n], ranked=100).collect()
    assert {r.g: r["values"] for r in low} == {g: [max(vs), min(vs), None] for g, vs in groups.items()}
