import math
import random

from loomspark.llm import quantiles as Q


def test_error_and_merging(spark):
    rng = random.Random(3)
    rows = [("a", d, rng.choice([-1, 1, 1, 1]) * rng.lognormvariate(0, 4)) for d in range(5) for _ in range(300)]
    rows += [("a", 0, v) for v in (None, math.nan, math.inf, 0.0, 0.0)] + [("b", 1, None), (None, 1, 2.0)]
    df = spark.createDataFrame(rows, "g string, d int, v double")
    qs = [0.0, 0.1, 0.5, 0.99, 1.0]
    merged = Q.merge(Q.sketch(df, "v", ["g", "d"]), ["g"])
    got = {r.g: r for r in Q.percentiles(merged, ["g"], qs).collect()}
    whole = {r.g: r for r in Q.percentiles(Q.sketch(df, "v", ["g"]), ["g"], qs).collect()}
    assert got == whole
    values = sorted(v for g, _, v in rows if g == "a" and v is not None and math.isfinite(v))
    for q in qs:
        exact = values[max(1, math.ceil(q * len(values))) - 1]
        assert abs(got["a"][f"p{q * 100:g}"] - exact) <= Q.ACCURACY * abs(exact) * (1 + 1e-9)
    assert (got["a"].n, got["a"].n_skipped, got["b"].n, got["b"].p50) == (len(values), 3, 0, None)
    assert abs(got[None].p50 - 2) <= 0.02
    assert Q.percentiles(Q.sketch(df.where("false"), "v", ["g"]), ["g"], qs).count() == 0


def test_one_row_per_id(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 2.0), (None, 1.0), (2, None)], "id long, v double")
    assert sorted((r.v is None, r.v) for r in Q.one_row_per_id(df, "id", ["v"]).collect()) == [(False, 2.0), (True, None)]
