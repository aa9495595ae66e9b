"""Leave-one-out report, forecast chain and block hashes against plain Python."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwatch import constants as C
from panelwatch.operators import graph, models
from panelwatch.sources import readers


def test_leave_out_report(spark):
    r = np.random.default_rng(2)
    rows = [(f"p{i % 4}", float(x), float(x + e)) for i, (x, e) in enumerate(zip(r.normal(10, 4, 80), r.normal(0, 1, 80)))]
    got = models.leave_out_report(spark.createDataFrame(rows, "county string, monthly_cases double, predicted_cases double")).first()
    y, p = np.array([x[1] for x in rows]), np.array([x[2] for x in rows])
    place = np.array([x[0] for x in rows])
    mean = np.array([y[place != c].mean() for c in place])
    assert (got.n, got.entities) == (80, 4) and got.better_than_mean
    assert got.rmse == pytest.approx(np.sqrt(((y - p) ** 2).mean())) and got.mae == pytest.approx(np.abs(y - p).mean())
    assert got.r2 == pytest.approx(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    assert got.mean_rmse == pytest.approx(np.sqrt(((y - mean) ** 2).mean())) and got.mean_mae == pytest.approx(np.abs(y - mean).mean())
    worse = models.leave_out_report(spark.createDataFrame([(c, y, -50.0) for c, y, _ in rows], "county string, monthly_cases double, predicted_cases double")).first()
    assert not worse.better_than_mean


def test_forecast_chain(spark):
    r = np.random.default_rng(4)
    rows = [(f"p{k}", 2015 + m // 12, m % 12 + 1, float(np.sin(m / 3) + k + r.normal(0, 0.1)), float(3 * np.sin((m - 1) / 3) + 5 + k))
            for k in range(4) for m in range(60) if not (k == 3 and m in (10, 11, 57))]
    months = spark.createDataFrame(rows, "county string, year int, month int, x double, monthly_cases double")
    edges = spark.createDataFrame([("p0", "p1"), ("p1", "p2"), ("p2", "p3")], "src string, dst string")
    out = models.forecast_chain(months, graph.normalized_adjacency(edges), ["x"], 2018).collect()
    # 48 months are left, the first 6 only fill windows, a fifth of the other 42 is for the test
    tests = 42 - int(0.8 * 42)
    assert len(out) == 4 * tests and {r.test_sample for r in out} == set(range(tests))
    assert all(r.residual == pytest.approx(r.actual_cases - r.predicted_cases) and r.score_method == C.CASE_SCORE_METHOD for r in out)
    for county in {r.county for r in out}:
        own = [r for r in out if r.county == county]
        p25, p50, p75 = np.percentile([r.actual_cases for r in own], [25, 50, 75])
        for row in own:
            x = row.predicted_cases
            assert row.predicted_risk == C.TIERS[int(x >= p25) + int(x >= p50) + int(x >= p75)]
    error = np.mean([abs(r.residual) for r in out])
    actual = np.array([r.actual_cases for r in out])
    assert error < 0.7 * np.abs(actual - actual.mean()).mean()


def test_block_hashes(spark):
    rows = [(i, f"n{i}", None if i % 5 == 0 else i * 1.5) for i in range(25)]
    df = spark.createDataFrame(rows, "k long, a string, b double").repartition(4)
    got = {r.block: (r.rows, r.hash) for r in readers.block_hashes(df, "k", ["k", "a", "b"], 10).collect()}
    for block, count in ((0, 10), (1, 10), (2, 5)):
        text = "\n".join(f"{i}|{a}|{'' if b is None else b}" for i, a, b in rows if i // 10 == block)
        assert got[block] == (count, hashlib.sha256(text.encode()).hexdigest())
    before = readers.block_hashes(df, "k", ["a"], 10)
    after = readers.block_hashes(df.withColumn("a", F.when(F.col("k") == 13, "other").otherwise(F.col("a"))).filter("k < 20"), "k", ["a"], 10)
    assert sorted(r.block for r in readers.changed_blocks(before, after).collect()) == [1, 2]
