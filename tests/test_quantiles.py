import random

import numpy as np

from lexigrid.operators import metrics


def test_summary_against_numpy(spark):
    rng = random.Random(8)
    rows = [(rng.choice([1.0, 2.5, 7.0, rng.uniform(-5, 90)]), float(rng.randint(0, 3)), 4.0 if k == 9 else None, None) for k in range(701)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double").repartition(5)
    got = {r["metric"]: r for r in metrics.summary(df, ["a", "b", "c", "d"], digits=6).collect()}
    for k, name in enumerate("abc"):
        v = np.array([r[k] for r in rows if r[k] is not None])
        want = (len(v), v.mean(), np.median(v), v.min(), v.max(), v.std(), np.quantile(v, 0.25), np.quantile(v, 0.75))
        assert tuple(got[name])[1:] == tuple(np.round(want, 6)) or np.allclose(tuple(got[name])[1:], want, atol=1e-5)
    assert tuple(got["d"]) == ("d", 0, None, None, None, None, None, None, None)


def test_quantiles_in_ranges(spark):
    """Values spread over many ranges, and a value that holds most of the rows."""
    rows = [("m", float(v), 1) for v in range(500)] + [("m", 250.5, 3000)] + [("one", 3.0, 1)]
    df = spark.createDataFrame(rows, "metric string, value double, n long")
    got = {r["metric"]: r.asDict() for r in metrics.quantiles(df, {"low": 0.01, "mid": 0.5, "top": 1.0}).collect()}
    whole = np.sort(np.concatenate([np.arange(500.0), np.full(3000, 250.5)]))
    for name, q in (("low", 0.01), ("mid", 0.5), ("top", 1.0)):
        assert abs(got["m"][name] - np.quantile(whole, q)) < 1e-9 and got["one"][name] == 3.0
