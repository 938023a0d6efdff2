import datetime as dt

from pyspark.sql import functions as F

from sessionlab.functions import columns as C


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr(F.col("v")).alias("o")).first()["o"]


def table(spark, pairs, expr, kind="string"):
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(pairs)], f"i int, v {kind}")
    got = {r["i"]: r["o"] for r in df.select("i", expr(F.col("v")).alias("o")).collect()}
    assert [got[i] for i in range(len(pairs))] == [b for _, b in pairs]


def test_route_groups(spark):
    table(spark, [("/completions", "inline"), ("/v1/completions", "inline"), ("/v1/chat/completions", "chat"), ("/responses", "chat"),
                  ("/embeddings", "embeddings"), ("/v1/models", "models"), ("/models/x", "other"), ("/images/generations", "images"),
                  ("/v1/audio/speech", "audio"), ("/files", "files"), ("/v1/filesystem", "files"), ("/moderations", "moderations"),
                  ("/batches/1", "batches"), ("/v1/threads/1", "assistants"), ("/runs", "assistants"), ("/assistants", "assistants"),
                  ("/v1completions", "other"), ("/v1/v1/completions", "other"), ("/foo", "other"), (None, "other")], C.route_group)


def test_outcome_class(spark):
    rows = [("litellm-rate_limit_exceed", "ERROR", "rate_limited"), ("litellm-IGNORE_THIS", "DEFAULT", "error"), ("litellm-info", "ERROR", "info"),
            ("litellm-acompletion", "ERROR", "error"), ("litellm-acompletion", "DEFAULT", "ok"), ("anything", None, "ok"), (None, None, "ok")]
    df = spark.createDataFrame(rows, "n string, l string, want string")
    assert all(r["o"] == r["want"] for r in df.withColumn("o", C.outcome_class(F.col("n"), F.col("l"))).collect())


def test_gap_buckets_at_their_edges(spark):
    table(spark, [(None, "t_start"), (0, "t_fast"), (199, "t_fast"), (200, "t_norm"), (1999, "t_norm"), (2000, "t_slow"), (29999, "t_slow"), (30000, "t_idle")],
          C.dt_bucket, "long")
    table(spark, [(None, "<NA>"), (0.1, "<0.2s"), (0.2, "0.2-1s"), (1.0, "1-5s"), (5.0, "5-30s"), (30.0, "30-120s"), (120.0, "2-10m"), (600.0, ">10m")],
          C.gap_label, "double")


def test_boundaries_are_not_elapsed_units(spark):
    t = dt.datetime
    df = spark.createDataFrame([(t(2024, 1, 1, 0, 0, 59), t(2024, 1, 1, 0, 30, 0))], "a timestamp, b timestamp")
    assert df.select(C.boundaries(F.col("a"), F.col("b"), 60_000_000).alias("m")).first()["m"] == 30


def test_outcome_parser(spark):
    table(spark, [("http:429", "rate_limited"), ("http:500", "error"), ("HTTP:404", "error"), ("http:302", "ok"), ("level:error", "error"),
                  ("http:429|level:ERROR", "rate_limited"), ("level:ERROR|http:429", "rate_limited"), ("OK", "ok"), ("Timeout", "timeout"),
                  ("http:500|canceled", "canceled"), ("junk", "ok"), ("", "ok"), (None, "ok")], C.parse_outcome)


def test_masking(spark):
    table(spark, [("/v1/threads/123", "/v1/threads/:num"), ("/a/0123456789abcdef", "/a/:hex"),
                  ("/x/123e4567-e89b-12d3-a456-426614174000/y", "/x/:uuid/y"), ("/v1/chat", "/v1/chat")], C.mask_route)


def test_lists_and_fields(spark):
    table(spark, [(None, []), ("  ", []), ("a, b,,c", ["a", "b", "c"]), ('["x","y"]', ["x", "y"]), ("[broken", ["[broken"]), ("solo", ["solo"])], C.parse_list)
    tok = "client=c|op=chat|out=ok|dt=t_fast"
    assert one(spark, tok, lambda c: C.token_field(c, "dt")) == "t_fast"
    assert one(spark, "chat:ok", lambda c: C.token_field(c, "op")) == "<NA>"
    assert one(spark, None, lambda c: C.token_field(c, "op")) == "<NA>"


def test_epoch_seconds(spark):
    table(spark, [("1704067200", 1704067200.0), ("1704067200500", 1704067200.5), ("2024-01-01 00:00:00", 1704067200.0),
                  ("2024-01-01T00:00:00Z", 1704067200.0), ("x", None), (None, None)], C.epoch_seconds)


def test_number_texts_match_exact_binary_rounding(spark):
    for v in (0.125, 0.155, 0.025, 0.075, -0.001, 1234567.891, 0.5, 2.5):
        assert one(spark, v, C.fixed, "double") == f"{v:.2f}"
        assert one(spark, v, C.signed, "double") == f"{v:+.2f}"
        assert one(spark, v, C.percent, "double") == f"{v:.0%}"


def test_users_and_clients(spark):
    df = spark.createDataFrame([("", {"user_api_key_user_id": "", "user_api_key_end_user_id": "e"}), (" ", {}), (None, {})], "u string, m map<string,string>")
    got = df.select(C.user_id(F.col("u"), F.col("m")).alias("a"), C.user_id_or_unknown(F.col("u"), F.col("m")).alias("b")).collect()
    assert [(r["a"], r["b"]) for r in got] == [("e", "e"), (" ", "UNKNOWN_USER"), (None, "UNKNOWN_USER")]
    df = spark.createDataFrame([("a", "b"), ("unknown_client", "b"), ("", ""), (None, None)], "o string, t string")
    assert [r[0] for r in df.select(C.client_name(F.col("o"), F.col("t"))).collect()] == ["a", "b", "unknown_client", "unknown_client"]


def test_time_guard(spark):
    t = dt.datetime
    rows = [([t(2024, 1, 1)],), ([t(1970, 1, 1)],), ([t(2023, 12, 24)],), ([t(2023, 12, 25)],), ([],), ([t(2024, 1, 1), None],), (None,)]
    df = spark.createDataFrame(rows, "x array<timestamp>")
    day = [F.lit(d).cast("timestamp") for d in ("2024-01-01", "2024-01-02")]
    assert [r[0] for r in df.select(C.times_valid(F.col("x"), *day)).collect()] == [True, False, False, True, False, False, False]
