import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from sessionlab.operators import explain, sequence as S, stats as St

KEYS, PART = ["g", "s"], ["g"]


def sample(spark, seed=3):
    rng = random.Random(seed)
    sess = {(c, f"s{i}"): [rng.choice("xyzw") for _ in range(rng.choice([1, 2, 5, 12, 40]))] for c in "ab" for i in range(25)}
    sess[("a", "hot")] = [rng.choice("xy") for _ in range(700)]
    rows = [(c, s, i, t) for (c, s), seq in sess.items() for i, t in enumerate(seq)]
    return sess, spark.createDataFrame(rows, "g string, s string, seq_no long, token string").repartition(5)


def scores(df, col="seq_raw"):
    return {(r["g"], r["s"]): r[col] for r in df.collect()}


def close(a, b, tol=1e-9):
    assert a.keys() == b.keys() and max(abs(a[k] - b[k]) for k in a) < tol


def test_markov_matches_direct_counting(spark):
    sess, ev = sample(spark)
    want = {}
    for c in "ab":
        mine = {k: v for k, v in sess.items() if k[0] == c}
        ab = Counter(p for v in mine.values() for p in zip(v, v[1:]))
        out = Counter()
        for (a, _), n in ab.items():
            out[a] += n
        vocab = len({t for v in mine.values() for t in v})
        for k, v in mine.items():
            nll = [-math.log((ab[p] + 1) / (out[p[0]] + vocab)) for p in zip(v, v[1:])]
            want[k] = sum(nll) / len(nll) if nll else 0.0
    close(scores(S.markov(ev, KEYS, PART)), want)


def test_ngrams_match_direct_counting(spark):
    sess, ev = sample(spark)
    want = {}
    for c in "ab":
        mine = {k: [tuple(v[i:i + n]) for n in (2, 3) for i in range(len(v) - n + 1)] for k, v in sess.items() if k[0] == c}
        cnt = Counter(g for v in mine.values() for g in v)
        den = sum(cnt.values()) + len(cnt)
        want |= {k: sum(-math.log((cnt[g] + 1) / den) for g in v) / len(v) if v else 0.0 for k, v in mine.items()}
    close(scores(S.ngram_rarity(ev, KEYS, PART)), want)


def test_entropy_matches_direct_counting(spark):
    sess, ev = sample(spark)
    h = {k: -sum(n / len(v) * math.log(n / len(v)) for n in Counter(v).values()) for k, v in sess.items()}
    med = {c: float(np.median([x for k, x in h.items() if k[0] == c])) for c in "ab"}
    close(scores(S.entropy_deviation(ev, KEYS, PART)), {k: abs(x - med[k[0]]) for k, x in h.items()})


def test_transition_probabilities_sum_to_one(spark):
    _, ev = sample(spark)
    steps = S.session_steps(ev, KEYS, "token")
    v = {r["g"]: r["v"] for r in S.partition_vocabulary(steps, PART).collect()}
    rows = S.transition_counts(steps, PART).collect()
    for c in "ab":
        for a in "xyzw":
            mine = [r["c_ab"] for r in rows if r["g"] == c and r["a"] == a]
            total = sum(mine) + v[c]
            assert abs(sum((n + 1) / total for n in mine) + (v[c] - len(mine)) / total - 1) < 1e-12


def test_composite_of_single_event_sessions_is_defined(spark):
    ev = spark.createDataFrame([("a", f"s{i}", 0, "x") for i in range(4)], "g string, s string, seq_no long, token string")
    rows = S.composite(ev, KEYS, PART, token="token").collect()
    assert all(r["b1_mnll"] == 0 and r["b2_score"] == 0 and r["b_risk"] == 0 for r in rows)


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(0)
    data = {"norm": rng.normal(size=501), "tied": rng.integers(0, 5, 400).astype(float), "wide": np.exp(rng.normal(0, 12, 300)) * rng.choice([-1, 1], 300),
            "one": np.array([7.0]), "close": 5 + rng.random(200) * 1e-7}
    df = spark.createDataFrame([(k, float(v)) for k, vs in data.items() for v in vs], "k string, v double").repartition(6)
    got = {r["k"]: r for r in St.quantiles(df, ["k"], "v", {"a": 0.01, "b": 0.5, "c": 0.95, "d": 0.0, "e": 1.0}).collect()}
    for k, vs in data.items():
        want = np.quantile(vs, [0.01, 0.5, 0.95, 0.0, 1.0])
        np.testing.assert_allclose([got[k][c] for c in "abcde"], want, rtol=1e-12)
        assert got[k]["n_values"] == len(vs)


def test_percent_rank_averages_ties(spark):
    rng = np.random.default_rng(1)
    v = rng.integers(0, 40, 1000).astype(float)
    df = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate(v)], "p int, i int, v double")
    got = {r["i"]: r["r"] for r in St.percent_rank(df, ["p"], "v", "r").collect()}
    for i, x in enumerate(v):
        assert abs(got[i] - ((v < x).sum() + ((v == x).sum() + 1) / 2) / len(v) * 100) < 1e-9


def test_flat_scores(spark):
    df = spark.createDataFrame([("same", 1.0)] * 4 + [("spike", 1.0)] * 40 + [("spike", 9.0)], "p string, x double")
    for flat, top in (("zero", 0.0), ("minmax", 100.0)):
        got = {(r["p"], r["x"]): r["o"] for r in St.scale_0_100(df, ["p"], "x", "o", 0.5, 0.95, flat).collect()}
        assert got == {("same", 1.0): 0.0, ("spike", 1.0): 0.0, ("spike", 9.0): top}


def test_hygiene(spark):
    df = spark.createDataFrame([("p", "1.5"), ("p", "x"), ("p", None), ("p", "Infinity"), ("p", "-Infinity"), ("p", "NaN")], "p string, v string")
    assert sorted(r["v"] for r in St.hygiene(df, ["p"], ["v"]).collect()) == [0.0, 0.0, 0.0, 0.0, 1.5, 1.5]
    assert sorted(r["v"] for r in St.hygiene(df, ["p"], ["v"], cap=9.0).collect())[-1] == 9.0


def test_why_names_rare_features_first(spark):
    rows = [("d", 1.0, 0.0, 5.0), ("d", 2.0, 0.0, 5.0), ("d", 3.0, 0.0, 5.0), ("d", 4.0, 0.0, 5.0), ("d", 50.0, 2.0, 6.0)]
    df = spark.createDataFrame(rows, "day string, a double, b double, c double")
    got = {r["a"]: r["why"] for r in explain.why_top(df, ["day"], ["a", "b", "c"], 2, "why").collect()}
    assert got[50.0] == "b=2.00 (rare_nonzero); a=50.00 (med=3.00, z=+47.00)"
    assert got[3.0] == "a=3.00 (med=3.00, z=+0.00); b=0.00 (med=0.00)"
    z = explain.robust_z_score(df.withColumn("k", F.col("a")), ["day"], ["k"], ["a"]).orderBy("k").collect()
    assert [r["z_max"] for r in z] == [2.0, 1.0, 0.0, 1.0, 47.0]


def test_median_and_mad_are_exact(spark):
    rng = np.random.default_rng(5)
    data = {"norm": rng.normal(size=501), "even": rng.normal(size=400), "tied": rng.integers(0, 5, 400).astype(float), "wide": np.exp(rng.normal(0, 12, 300)) * rng.choice([-1, 1], 300),
            "one": np.array([7.0]), "two": np.array([1.0, 4.0]), "flat": np.full(30, 2.5), "close": 5 + rng.random(200) * 1e-7, "split": np.r_[np.full(50, -3.0), np.full(50, 9.0)],
            "far": np.r_[rng.normal(1e6, 1, 150), rng.normal(-1e6, 1, 151)], None: rng.random(77)}
    df = spark.createDataFrame([(k, float(v)) for k, vs in data.items() for v in vs] + [("one", None), ("two", float("nan"))], "k string, v double").repartition(6)
    got = {r["k"]: r for r in St.median_mad(df, ["k"], "v").collect()}
    for k, vs in data.items():
        med = np.quantile(vs, 0.5)
        np.testing.assert_allclose([got[k]["med"], got[k]["mad"]], [med, np.quantile(np.abs(vs - med), 0.5)], rtol=1e-9, atol=1e-12)


def test_null_scopes_keep_their_rows(spark):
    rows = [(g, i, float(v), t) for g in ("a", None) for i, (v, t) in enumerate(zip((1, 2, 3, 40, 5), ("x", "y", None, "x", "y")))] + [("b", 9, None, "x")]
    df = spark.createDataFrame(rows, "g string, i long, v double, t string")
    dev = explain.deviations(df, ["g"], ["i"], ["v"]).collect()
    assert len(dev) == len(rows) and {r["i"]: r["z"] for r in dev if r["g"] is None} == {r["i"]: r["z"] for r in dev if r["g"] == "a"}
    z = explain.robust_z_score(df, ["g"], ["i"], ["v"]).collect()
    assert len(z) == len(rows) and {r["i"]: r["z_max"] for r in z if r["g"] is None} == {r["i"]: r["z_max"] for r in z if r["g"] == "a"} == {0: 1.0, 1: 0.5, 2: 0.0, 3: 18.5, 4: 1.0}
    ev = spark.createDataFrame([(g, s, i, t) for g in ("a", None) for s, seq in (("p", "xyxx"), ("q", "xz")) for i, t in enumerate(seq)], "g string, s string, seq_no long, token string")
    ev = ev.withColumn("token", F.when(F.col("token") != "z", F.col("token")))   # a missing token
    for scores_of in (lambda: S.markov(ev, KEYS, PART), lambda: S.ngram_rarity(ev, KEYS, PART), lambda: S.entropy_deviation(ev, KEYS, PART),
                      lambda: S.composite(ev, KEYS, PART, token="token").withColumnRenamed("b_risk", "seq_raw")):
        got = scores(scores_of())
        assert len(got) == 4 and all(abs(got[(None, s)] - got[("a", s)]) < 1e-9 for s in "pq")
    assert scores(S.markov(ev, KEYS, PART))[(None, "q")] > 0


def test_deviations_do_not_exchange_the_rows(spark):
    df = spark.createDataFrame([("d", i, float(i % 7), float(i)) for i in range(60)], "day string, i long, a double, b double")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for out in (explain.deviations(df, ["day"], ["i"], ["a", "b"]), explain.robust_z_score(df, ["day"], ["i"], ["a", "b"]), explain.why_top(df, ["day"], ["a", "b"])):
            p = out._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" not in p and "ShuffledHashJoin" not in p and "hashpartitioning(day" not in p
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_top_sets_without_common_sessions_are_counted(spark, monkeypatch):
    from sessionlab.plans import catalog, q_evaluate, registry  # noqa: F401
    made = spark.range(60).select(F.lit("c").alias("client_name"), F.lit("d").alias("day"), F.col("id").cast("string").alias("user_id"), F.lit("gap:1").alias("session_key"),
                                  F.col("id").cast("double").alias("score_markov"), (-F.col("id")).cast("double").alias("score_entropy"))
    monkeypatch.setattr(q_evaluate, "scores", lambda spark, sf: (made, None))
    got = {r["op"]: r["n"] for r in registry.QUERIES["topk_sets"](spark, "unused").collect()}
    assert got == {"intersect": 0, "union": 40}
    monkeypatch.setattr(q_evaluate, "scores", lambda spark, sf: (made.where("false"), None))
    assert {r["op"]: r["n"] for r in registry.QUERIES["topk_sets"](spark, "unused").collect()} == {"intersect": 0, "union": 0}
