"""Shapes the physical plans must have whatever the data size."""

import re

import pytest

from sessionlab.operators import drilldown as D, sequence as S, stats as St, tokens as K
from sessionlab.operators.sessionize import session_features, sessionize
from sessionlab.plans import catalog, fixtures as X  # noqa: F401
from sessionlab.schema import SESSION_KEYS

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def frames(spark):
    ev = X.weekly_events(spark, SF)
    top = ev.select(*SESSION_KEYS).distinct().limit(5)
    return {
        "features": session_features(sessionize(X.base_events(spark, SF), 30, stage=False)),
        "markov": S.markov(ev), "ngrams": S.ngram_rarity(ev), "entropy": S.entropy_deviation(ev),
        "peak": D.peak_window(ev), "gaps": D.gap_quantiles(ev), "steps": S.drill_steps(ev, top),
        "quantiles": St.quantiles(X.read(spark, SF, "lineitem"), ["l_suppkey"], "l_quantity", {"m": 0.5}),
        "rank": St.percent_rank(X.read(spark, SF, "lineitem"), ["l_suppkey"], "l_quantity", "r"),
        "tokens": K.token_rows(ev, "v1"), "vocab": K.vocabulary(K.token_rows(ev, "v1")),
    }


def test_no_plan_gathers_or_multiplies_rows(spark):
    for name, df in frames(spark).items():
        p = plan(df)
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, name
        # A window or join must not be fed by a single partition.
        assert not re.search(r"Window \[.*\n.*\n.*Exchange SinglePartition", p), name
        assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p, name


def test_time_range_and_columns_reach_the_scan(spark):
    p = plan(X.base_events(spark, SF).select("observation_id", "route"))
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts," in p and "LessThan(ts," in p
    assert "LeftOuter" not in p        # users are required, so the outer join has become an inner one
    q = plan(X.read(spark, SF, "lineitem").select("l_orderkey"))
    assert "ReadSchema: struct<l_orderkey:bigint>" in q


def test_top_lists_are_cut_before_the_shuffle(spark):
    ev = X.weekly_events(spark, SF)
    assert "WindowGroupLimit" in plan(S.rank_sequences(S.entropies(ev, SESSION_KEYS).withColumnRenamed("entropy_session", "seq_raw")))
    assert "WindowGroupLimit" in plan(K.token_rows(ev, "v1"))
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "100000")
    assert "WindowGroupLimit" in plan(K.token_rows(ev, "v0")) and "WindowGroupLimit" in plan(K.vocabulary(K.token_rows(ev, "v1")))


def test_details_filter_events_by_semi_join(spark):
    ev = X.weekly_events(spark, SF)
    assert "LeftSemi" in plan(S.drill_steps(ev, ev.select(*SESSION_KEYS).distinct().limit(5)))


def test_session_steps_are_counted_once(spark):
    """Statistics and scoring read the staged step counts; the ordered pass over the events is not repeated."""
    for df in (S.markov(X.weekly_events(spark, SF)), S.ngram_rarity(X.weekly_events(spark, SF))):
        assert "Window [lead" not in plan(df)


@pytest.mark.parametrize("name", ["joined_events", "b3_entropy", "pack", "drilldown", "pseudo_labels", "why_top5", "lm_score", "precision_at_k", "topk_stability"])
def test_queries_equal_their_sql(spark, name):
    from oracle_check import compare, connect
    import __spark_entry__ as entry
    assert compare(entry.queries()[name](spark, SF), connect(SF).execute(entry.oracle_sql()[name]).df()) is None


def test_entry_and_contract(spark):
    import __spark_entry__ as entry
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) >= 90
    assert entry.entry(spark).count() > 0


def test_sampled_outlier_factor_is_not_registered():
    import __spark_entry__ as entry
    assert "lof" not in entry.queries()


def test_tasks_of_large_exchanges_stay_small(spark):
    from pyspark.sql import functions as F
    from sessionlab.plans import registry
    for key, value in registry.SETTINGS.items():
        spark.conf.set(key, value)
    # Over 100 MB of counts in a session of 4 partitions.
    counts = spark.range(12_000_000).groupBy(F.xxhash64("id").alias("h")).agg(F.count("*").alias("c"))
    assert counts.rdd.getNumPartitions() > 4
    assert counts.count() == 12_000_000


def test_signals_are_written_once_and_need_no_join(spark):
    from sessionlab.plans import q_drilldown as Q
    assert Q.spec_events(spark, SF) is Q.spec_events(spark, SF)
    assert "k" not in X.session_events(spark, SF).columns and "k" in X.numbered_events(spark, SF).columns
    assert "Join" not in plan(Q.spec_events(spark, SF))


def test_spec_route_equals_its_sql(spark, tmp_path):
    """One row per event of the range, also where ids repeat or are missing, on plain and on odd rows."""
    import duckdb
    from oracle_check import compare, connect
    import __spark_entry__ as entry
    run, sql = entry.queries()["spec_route"], entry.oracle_sql()["spec_route"]
    assert compare(run(spark, SF), connect(SF).execute(sql).df()) is None

    con = duckdb.connect()
    con.execute("CREATE TABLE events (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR)")
    rows = [(1, "2024-01-01 00:00:00", 0, "view", 50.0, '{"k": 5}'), (2, "2024-01-02", 1, "view", 50.0, '{"k": 1}'),
            (2, "2024-01-02", 1, "view", 50.0, '{"k": 1}'), (2, "2024-01-03", 1, "view", 2.0, '{"k": 27}'),
            (3, "2024-01-04", 2, "click", 70.0, '{"k": 41}'), (4, "2024-01-05", 2, "view", 50.0, '{"k": 13}'),
            (None, "2024-01-06", 3, "error", 50.0, '{"k": 2}'), (5, "2024-01-07", None, None, None, None),
            (6, "2024-01-31 23:59:59.999999", 3, "error", 50.0, '{"k": 12}'), (7, "2024-02-01", 3, "view", 50.0, '{"k": 1}'),
            (8, "2023-12-31", 3, "view", 50.0, '{"k": 1}'), (9, None, 3, "view", 50.0, '{"k": 1}')]
    con.executemany("INSERT INTO events VALUES (?, ?, ?, ?, ?, ?)", rows)
    con.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    out = run(spark, str(tmp_path))
    assert compare(out, con.execute(sql).df()) is None
    assert sorted(((r["observation_id"], r["route"]) for r in out.collect()), key=str) == sorted([
        ("1", "UNKNOWN_ROUTE"), ("2", "/v1/chat/completions"), ("2", "/v1/chat/completions"), ("2", "litellm-bad_request_error"),
        ("3", "litellm-rate_limit_exceed"), ("4", "litellm-acompletion"), (None, "/responses"), ("5", "litellm-acompletion"),
        ("6", "/foo")], key=str)
    assert "Join" not in plan(out)
