import datetime as dt
import random

from pyspark.sql import functions as F

from sessionlab.operators import drilldown as D, risk as R
from sessionlab.operators.scan import number_rows

T0 = dt.datetime(2024, 1, 1, 8)
K = ["k"]


def timed(spark, rows):
    """rows: (session, seconds, route, outcome)"""
    df = spark.createDataFrame([(k, T0 + dt.timedelta(seconds=s), r, o, i) for i, (k, s, r, o) in enumerate(rows)],
                               "k string, event_time timestamp, route_group string, outcome string, i int")
    return number_rows(df, K, "event_time", ["i"])


def peaks(df, w=30):
    return {r["k"]: (r["peak_events"], (r["peak_start"] - T0).total_seconds(), (r["peak_end"] - T0).total_seconds())
            for r in D.peak_window(df, K, w).collect()}


def direct_peak(times, w):
    best = (0, None, None)
    times = sorted(times)
    j = 0
    for i, t in enumerate(times):
        while t - times[j] > w:
            j += 1
        if i - j + 1 > best[0]:
            best = (i - j + 1, times[j], t)
    return best


def test_peak_window(spark):
    df = timed(spark, [("a", s, "r", "ok") for s in (0, 0, 5, 30, 30, 31, 100)] + [("b", 7, "r", "ok")])
    assert peaks(df) == {"a": (5, 0.0, 30.0), "b": (1, 7.0, 7.0)}


def test_peak_equals_two_pointers(spark):
    rng = random.Random(4)
    times = {f"k{i}": [rng.randrange(rng.choice([50, 400, 5000])) for _ in range(rng.choice([1, 10, 120]))] for i in range(30)}
    df = timed(spark, [(k, s, "r", "ok") for k, v in times.items() for s in v])
    for w in (30, 7):
        assert peaks(df, w) == {k: direct_peak(v, w) for k, v in times.items()}


def ruled(spark, rows, start="2024-01-01", end="2024-01-02"):
    f = R.rule_features(timed(spark, rows), K, start, end)
    return {r["k"]: r for r in R.with_triage(R.with_labels(R.with_tags(R.with_risk_v2(f)))).collect()}


def spread(k, n, span, burst, outcomes):
    """n events over `span` seconds with `burst` of them in the first 20 s."""
    secs = [i * 20 // burst for i in range(burst)] + [60 + int((span - 60) * i / (n - burst - 1)) for i in range(n - burst)]
    return [(k, s, "chat", o) for s, o in zip(secs, outcomes)]


def test_two_described_sessions(spark):
    hot = ["rate_limited"] * 250 + ["error"] * 200 + ["ok"] * 23
    random.Random(0).shuffle(hot)
    calm = ["rate_limited"] * 18 + ["ok"] * 337
    random.Random(0).shuffle(calm)
    # Outside the burst the events are 47 s apart, so the peak is the burst itself.
    got = ruled(spark, spread("hot", 473, 473 * 47, 24, hot) + spread("calm", 355, 355 * 47, 18, calm), end="2024-01-03")
    a, b = got["hot"], got["calm"]
    assert (a["n_events"], a["peak30s"], round(a["error_rate"], 2)) == (473, 24, 0.42)
    assert {"ERROR_HEAVY", "RATE_LIMIT_HEAVY", "BURST", "RETRY_STORM", "POLICY_PRESSURE", "SINGLE_ROUTE_LOOP", "ROUTE_SKEW"} <= set(a["risk_tags"])
    assert a["primary_reason_code"] == "RATE_LIMIT" and a["error_band"] == "runaway" and a["retry_loop"]
    assert (b["n_events"], b["peak30s"], b["error_rate"], b["route_skew"]) == (355, 18, 0.0, 1.0)
    assert "LONG_DURATION" in b["risk_tags"] and not {"ERROR_HEAVY", "BURST", "RETRY_STORM"} & set(b["risk_tags"])
    assert b["primary_reason_code"] == "ROUTE_SKEW" and b["label_suggested"] == "normal" and b["long_normal_session"]
    assert a["risk_score_v2"] > b["risk_score_v2"]


def test_long_quiet_session_is_scored_down(spark):
    r = ruled(spark, [("x", s, f"r{s % 5}", "ok") for s in range(0, 7201, 100)])["x"]
    assert r["risk_score_v2"] == r["risk_score_v2_raw"] * 0.6 and "NORMAL_LONG_SESSION_HINT" in r["risk_tags"]
    assert (r["label_suggested"], r["confidence"], r["action_suggested"]) == ("benign_fp", 0.7, "monitor")


def test_unusable_times(spark):
    rows = [("old", -8 * 86400 - 9 * 3600, "a", "error"), ("old", 0, "a", "error"), ("epoch", -(T0 - dt.datetime(1970, 1, 1)).total_seconds() + 5, "a", "ok"), ("fine", 0, "a", "ok")]
    got = ruled(spark, [(k, int(s), r, o) for k, s, r, o in rows])
    for k, n in (("old", 2), ("epoch", 1)):
        r = got[k]
        assert (r["duration_sec"], r["peak30s"], r["time_unreliable_count"], r["primary_reason_code"]) == (0.0, 0, n, "TIME_UNRELIABLE")
    assert got["fine"]["time_unreliable_count"] == 0 and got["old"]["error_rate"] == 1.0


def labelled(spark, **kw):
    base = dict(n_events=30, error_rate=0.0, rate_limited_rate=0.0, peak30s=0, route_skew=0.5, duration_sec=0.0, time_valid=True, time_unreliable_count=0)
    base |= kw
    df = spark.createDataFrame([tuple(base.values())], "n_events long, error_rate double, rate_limited_rate double, peak30s long, route_skew double, duration_sec double, time_valid boolean, time_unreliable_count long")
    return R.with_labels(R.with_tags(R.with_risk_v2(df))).first()


def test_reason_order_and_labels(spark):
    assert labelled(spark, error_rate=0.3, rate_limited_rate=0.2, peak30s=25)["primary_reason_code"] == "ERROR"
    assert labelled(spark, peak30s=45)["primary_reason_code"] == "BURST"
    assert labelled(spark, error_rate=0.25)["primary_reason_code"] == "ERROR"
    assert labelled(spark, rate_limited_rate=0.15)["primary_reason_code"] == "RATE_LIMIT"
    assert labelled(spark, duration_sec=7200.0, error_rate=0.01)["primary_reason_code"] == "LONG"
    assert labelled(spark)["primary_reason_code"] == "MIXED"
    top = labelled(spark, error_rate=0.5, rate_limited_rate=0.5, peak30s=40, route_skew=1.0, duration_sec=21600.0)
    assert round(top["risk_score_v2"], 6) == 100.0 and round(top["confidence"], 6) == 1.0 and top["action_suggested"] == "block_candidate"
    mid = labelled(spark, error_rate=0.5, rate_limited_rate=0.25)
    assert mid["label_suggested"] == "needs_review" and abs(mid["confidence"] - (0.3 + 0.3 * (mid["risk_score_v2"] - 50) / 30)) < 1e-9


def test_details_missing_for_a_session(spark):
    top = spark.createDataFrame([("a", 10.0), ("b", 9.0)], "k string, duration_s double")
    ev = timed(spark, [("a", s, "chat", "ok") for s in range(5)]).withColumnRenamed("outcome", "outcome_class").withColumn("prev_time", F.lit(None).cast("timestamp"))
    dd = D.drilldown(ev.withColumn("token", F.lit("t")).withColumn("dt_bucket", F.lit("t_fast")), top, K)
    got = {r["k"]: r for r in R.with_ranked_tags(D.with_details(top, dd, K)).collect()}
    assert got["b"]["risk_tags"] == "" and got["b"]["token_top3"] == "" and got["b"]["n_events_dd"] is None
    assert got["a"]["risk_tags"] == "BURST_DENSE,ROUTE_SKEW" and got["a"]["max_events_in_30s"] == 5.0
