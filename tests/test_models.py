import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionlab.operators.forest import expected_depth, grow_forest, rank_by_forest, score_forest
from sessionlab.operators.models import draw_samples
from sessionlab.operators.neighbours import lof, local_outlier_factors
from sessionlab.profiles import IMPL
from sessionlab.staging import materialize


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(7)
    rows = [("d", f"n{i:03d}", *map(float, rng.normal(size=3))) for i in range(500)]
    rows += [("d", f"out{i}", *map(float, rng.choice([-1, 1], 3) * (9 + rng.random(3)))) for i in range(5)]
    return spark.createDataFrame(rows, "day string, k string, a double, b double, c double").withColumn("at", F.current_timestamp())


def ranked(df):
    return [(r["k"], r["if_raw"]) for r in rank_by_forest(df, ("day",), ["k"], IMPL, ["a", "b", "c"]).orderBy(F.desc("if_raw"), "k").collect()]


def test_planted_outliers_rank_first_and_order_of_rows_is_irrelevant(planted):
    first = ranked(planted)
    assert {k for k, _ in first[:5]} == {f"out{i}" for i in range(5)}
    assert all(0 < v < 1 for _, v in first)
    assert first == ranked(planted.orderBy(F.desc("k")).repartition(7))


def test_scores_do_not_depend_on_chunking(planted, spark):
    df = materialize(planted)
    forest = materialize(grow_forest(df, ("day",), ["k"], ["a", "b", "c"], 60))
    one = {r["k"]: r["if_raw"] for r in score_forest(df, forest, ("day",), ["k"], ["a", "b", "c"]).collect()}
    from sessionlab.operators import models
    whole, models.CHUNK_ROWS = models.CHUNK_ROWS, 50
    try:
        import sessionlab.operators.forest as fo
        many = {r["k"]: r["if_raw"] for r in fo.score_forest(df, forest, ("day",), ["k"], ["a", "b", "c"]).collect()}
    finally:
        models.CHUNK_ROWS = whole
    assert one == many


def test_draws_are_full_and_even(spark):
    for n, want in ((50, 50), (256, 256), (300, 256), (400, 256), (500, 256), (700, 256), (1000, 256), (3000, 256), (5000, 256), (60000, 256)):
        df = spark.range(n).select(F.lit("s").alias("scope"), F.col("id").alias("k"))
        d = draw_samples(df, ["scope"], ["k"], 256, 40)
        c = d.groupBy("draw").agg(F.count("*").alias("n"), F.count_distinct("k").alias("u")).collect()
        assert len(c) == 40 and all(r["n"] == r["u"] == want for r in c)
    # Rows are picked about equally often: 40 draws of 256 out of 3000.
    often = draw_samples(spark.range(3000).select(F.lit("s").alias("scope"), F.col("id").alias("k")), ["scope"], ["k"], 256, 40).groupBy("k").count()
    assert often.agg(F.max("count")).first()[0] <= 14


def test_expected_depth():
    assert expected_depth(1) == 0 and expected_depth(2) == 1
    assert abs(float(expected_depth(256)) - 10.2448) < 1e-3


def test_lof_equals_direct_form_when_all_rows_fit_the_sample(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(120, 2))
    x[0] = (12, 12)
    df = spark.createDataFrame([("d", i, float(a), float(b)) for i, (a, b) in enumerate(x)], "day string, k int, a double, b double")
    got = {r["k"]: r["lof"] for r in lof(df, ["day"], ["k"], ["a", "b"], k=10).collect()}
    med = np.median(x, axis=0)
    q1, q3 = np.percentile(x, [25, 75], axis=0)
    y = (x - med) / (q3 - q1)
    d = np.sqrt(((y[:, None] - y[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1)[:, :10]
    kd = np.sort(d, axis=1)[:, 9]
    lrd = 1 / (np.maximum(np.take_along_axis(d, near, 1), kd[near]).mean(1) + 1e-10)
    want = lrd[near].mean(1) / lrd
    np.testing.assert_allclose([got[i] for i in range(120)], want, rtol=1e-6)
    assert max(got, key=got.get) == 0


def test_lof_of_one_row():
    assert local_outlier_factors(np.zeros((1, 2)), np.array([1]), np.zeros((1, 2)), np.array([1]), 5).tolist() == [1.0]


def test_rows_without_scope_and_lone_rows_are_scored(spark):
    from sessionlab.operators.explain import why_top
    from sessionlab.operators.forest import grow_forest, score_forest
    from sessionlab.operators.stats import hygiene, percent_rank, quantiles, scale_0_100
    rows = [(None if i < 20 else "s", i, float(i)) for i in range(40)] + [("alone", 99, 1.0)]
    df = spark.createDataFrame(rows, "day string, k long, x double")
    clean = hygiene(df, ["day"], ["x"])
    scored = score_forest(clean, grow_forest(clean, ["day"], ["k"], ["x"], 20), ["day"], ["k"], ["x"])
    ranked = percent_rank(scale_0_100(scored, ["day"], "if_raw", "r", 0.05, 0.95, "rank"), ["day"], "if_raw", "p").collect()
    assert len(ranked) == 41 and all(r.p is not None and r.r is not None for r in ranked)
    assert [r.if_raw for r in ranked if r.day == "alone"] == [0.5]
    assert why_top(df, ["day"], ["x"]).count() == 41
    assert quantiles(spark.createDataFrame([(1.0,), (3.0,), (float("nan"),)], "x double"), [], "x", {"m": 0.5}).first().m == 2.0


def test_neighbours_of_many_rows_are_mostly_found(spark):
    from sessionlab.operators.neighbours import nearest, ranked
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(size=(2500, 4)), rng.normal(4, 0.5, size=(1500, 4)), np.repeat(rng.normal(size=(5, 4)), 40, axis=0)])
    df = spark.createDataFrame([("d" if i % 4 else None, f"{i:05d}", r.tolist()) for i, r in enumerate(x)], "day string, id string, x array<double>")
    got = {}
    for r in nearest(df, ["day"], 4, 10, run=256, margin=64).collect():
        got.setdefault(r.id, set()).add(r.near)
    hit = want = 0
    for part in (0, 1):
        mine = [i for i in range(len(x)) if bool(i % 4) == bool(part)]
        d = np.sqrt(((x[mine][:, None] - x[mine][None]) ** 2).sum(-1))
        np.fill_diagonal(d, np.inf)
        kth = np.sort(d, axis=1)[:, 9]
        for row, i in enumerate(mine):
            found = {mine.index(int(n)) for n in got[f"{i:05d}"]} if row % 20 == 0 else None
            if found is not None:
                hit += sum(d[row, j] <= kth[row] + 1e-9 for j in found)
                want += 10
    assert all(len(n) == 10 for n in got.values()) and len(got) == len(x) and hit / want >= 0.9
    spots = spark.createDataFrame([("p", f"{i}", float(i % 7)) for i in range(500)], "p string, id string, v double")
    places = sorted((r["rank"], r.v) for r in ranked(spots, ["p"]).collect())
    assert [p for p, _ in places] == list(range(500)) and [v for _, v in places] == sorted(v for _, v in places)
