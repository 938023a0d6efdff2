import datetime as dt

import pytest
from pyspark.sql import functions as F

from sessionlab.operators import evaluate as V, learned as L, tokens as K
from sessionlab.sources import readers, writers

T0 = dt.datetime(2024, 1, 1)
KEYS = ["client_name", "user_id", "session_key"]
EV = "client_name string, user_id string, session_key string, seq_no long, event_time timestamp, token string, outcome_class string, route_group string, dt_bucket string"


def ev(spark, rows):
    return spark.createDataFrame([("c", "u", "s", i, None if s is None else T0 + dt.timedelta(seconds=s), t, o, "chat", "t_fast") for i, (s, t, o) in enumerate(rows)], EV)


def seq(df, version, n=100):
    return K.sequences(K.token_rows(df, version, KEYS, n), KEYS).first()


def test_sequences_and_the_last_known_time(spark):
    df = ev(spark, [(None, "a", "ok"), (0, "b", " "), (None, "c", None), (3, "d", "error")])
    assert seq(df, "v0")["tokens"] == ["BOS", "a", "b", "c", "d", "EOS"]
    v1 = seq(df, "v1")
    assert v1["seq_len"] == 22 and v1["tokens"][1:6] == ["TOK:a", "OUT:ok", "DT:t_fast", "GAP:<BOS>", "EOV"]
    assert [t for t in v1["tokens"] if t.startswith("GAP:")] == ["GAP:<BOS>", "GAP:<BOS>", "GAP:<NA>", "GAP:1-5s"]
    assert [t for t in v1["tokens"] if t.startswith("OUT:")] == ["OUT:ok", "OUT:<NA>", "OUT:<NA>", "OUT:error"]
    tok = ev(spark, [(0, "client=x|op=chat|out=ok|dt=t_start", "ok")])
    assert seq(tok, "v2")["tokens"][1:10] == ["RG:chat", "OUT:ok", "DT:t_fast", "GAP:<BOS>", "TOK:client=x|op=chat|out=ok|dt=t_start", "OP:chat", "OUT2:ok", "DT2:t_start", "EOV"]


@pytest.mark.parametrize("version", ["v0", "v1", "v2"])
def test_the_tail_is_kept(spark, version):
    df = ev(spark, [(i, f"t{i}", "ok") for i in range(40)])
    whole = seq(df, version, 10_000)["tokens"]
    for n in (1, 2, 7, 16, len(whole) - 1, len(whole), len(whole) + 5):
        s = seq(df, version, n)
        assert s["tokens"] == whole[-n:] and s["seq_len"] == min(n, len(whole))


def test_padding_vocabulary_and_ids(spark):
    df = ev(spark, [(i, t, "ok") for i, t in enumerate("aaabbbbcc")])
    rows = K.token_rows(df, "v0", KEYS, 100)
    v = {r["token"]: r["id"] for r in K.vocabulary(rows, min_freq=3).collect()}
    assert v["PAD"] == 0 and v["GAP:<BOS>"] == 8 and v["b"] == 9 and v["a"] == 10 and "c" not in v
    assert len({r["token"] for r in K.vocabulary(rows, min_freq=3, max_vocab=10).collect()}) == 10
    ids = K.sequences(K.token_ids(rows, K.vocabulary(rows, min_freq=3)), KEYS, "token_id", "ids").first()["ids"]
    assert ids == [2, 10, 10, 10, 9, 9, 9, 9, 1, 1, 3]
    c = K.coverage(rows, K.vocabulary(rows, min_freq=3)).first()
    assert (c["total"], c["known"]) == (11, 9)
    p = K.padded(K.sequences(rows, KEYS), "tokens", 13, "PAD").first()
    assert p["tokens"][-2:] == ["PAD", "PAD"] and sum(p["attention_mask"]) == 11 and len(p["tokens"]) == 13


def test_tail_of_a_short_session_is_its_mean(spark):
    df = spark.createDataFrame([("s", i, 10, float(i)) for i in range(10)], "s string, pos long, seq_len long, loss double")
    r = L.reduce_losses(df, ["s"], 128).first()
    assert r["mean"] == r["tail"] == 4.5 and r["max"] == 9.0
    assert L.reduce_losses(df, ["s"], 128, padded_to=2048).first()["tail"] == 0.0
    a = spark.createDataFrame([([1.0, 2.0, 9.0],), ([],)], "x array<double>").select(L.reduce_loss_array(F.col("x"), 2).alias("r")).collect()
    assert tuple(a[0]["r"]) == (4.0, 5.5, 9.0) and tuple(a[1]["r"]) == (0.0, 0.0, 0.0)


def test_language_model_prefers_what_it_has_seen(spark):
    rows = []
    for i in range(20):
        rows += [("c", f"t{i}", "train", p, 4, t) for p, t in enumerate(["BOS", "a", "b", "EOS"])]
    rows += [("c", "same", "test", p, 4, t) for p, t in enumerate(["BOS", "a", "b", "EOS"])]
    rows += [("c", "new", "test", p, 4, t) for p, t in enumerate(["BOS", "z", "a", "EOS"])]
    df = spark.createDataFrame(rows, "client_name string, session_key string, split string, pos long, seq_len long, token string")
    got = {r["session_key"]: r for r in L.lm_scores(df, ["client_name", "session_key"], tail_k=1).collect()}
    assert got["new"]["score_mean_nll"] > got["same"]["score_mean_nll"] + 1
    assert got["same"]["score_max_nll"] < 1.2 and got["new"]["score_tail_nll"] <= got["new"]["score_max_nll"]


def test_weak_label_classifier_learns_also_after_rows_were_observed(spark):
    from pyspark.sql import Observation
    seen = Observation()
    spark.range(3).observe(seen, F.count(F.lit(1)).alias("n")).collect()
    assert seen.get["n"] == 3
    rows = [("c", f"s{i}", p, t) for i in range(60) for p, t in enumerate(["a", "bad" if i % 3 == 0 else "b", "c"])]
    df = spark.createDataFrame(rows, "client_name string, session_key string, seq_no long, token string")
    labels = spark.createDataFrame([("c", f"s{i}", int(i % 3 == 0), "train" if i < 45 else "test") for i in range(60)],
                                   "client_name string, session_key string, label int, split string")
    got = L.weak_label_scores(df, labels, ["client_name", "session_key"], dims=1024).collect()
    assert len(got) == 60 and min(r["score_weak_label"] for r in got if r["label"]) > 0.5 > max(r["score_weak_label"] for r in got if not r["label"])


def test_split_is_stable_and_near_ninety_percent(spark):
    df = spark.range(4000).select(F.lit("c").alias("client_name"), F.col("id").cast("string").alias("user_id"), F.lit("s").alias("session_key"))
    for blake in (False, True):
        n = {r["split"]: r["count"] for r in K.with_split(df, blake).groupBy("split").count().collect()}
        assert 0.88 < n["train"] / 4000 < 0.92 and n["val"] > 120 and n["test"] > 120


def test_weak_labels_and_precision(spark):
    df = spark.createDataFrame([(1, [" Error ", None]), (2, ["ok"]), (3, None), (4, ["rate_limited"])], "s int, o array<string>")
    assert [r[0] for r in df.orderBy("s").select(V.weak_label(F.col("o"))).collect()] == [1, 0, 0, 1]
    sc = spark.createDataFrame([(i, float(-i)) for i in range(5)], "s int, score_x double")
    lab = spark.createDataFrame([(0, 1), (1, 0), (2, 1)], "s int, label int")
    got = {r["k"]: (r["precision_at_k"], r["n_scored"], r["n_pos_total"]) for r in V.precision_at_k(sc, lab, ["score_x"], (1, 2, 50), ["s"]).collect()}
    assert got == {1: (1.0, 5, 2), 2: (0.5, 5, 2), 50: (0.4, 5, 2)}


def test_overlap_and_stability(spark):
    a = spark.createDataFrame([("c", d, u) for d, us in (("1", "abc"), ("2", "bcd"), ("4", "x")) for u in us], "client_name string, day string, user_id string")
    b = a.where(F.col("user_id") != "b")
    o = V.overlap(a.where("day = 1"), b.where("day = 1"), 3, ["client_name", "user_id"]).first()
    assert (o["common"], o["overlap"], o["jaccard"]) == (2, 2 / 3, 2 / 3)
    s = {r["day"]: (r["next_period"], r["common"], r["stability"]) for r in V.stability(a, "day", 3).collect()}
    assert s == {"1": ("2", 2, 2 / 3), "2": ("4", 0, 0.0)}


def test_writers_refuse_overwriting_and_emptiness(spark, tmp_path):
    df = spark.createDataFrame([("2024-01-01", ["a"])], "day string, x array<string>")
    writers.write_sessions(df, f"{tmp_path}/t")
    with pytest.raises(Exception, match="(?i)already exists"):
        writers.write_sessions(df, f"{tmp_path}/t")
    writers.write_sessions(df, f"{tmp_path}/t", overwrite=True)
    with pytest.raises(ValueError, match="empty"):
        writers.write_table(df.where("day = 'x'"), f"{tmp_path}/e")
    writers.write_table(df, f"{tmp_path}/c", "csv")
    assert spark.read.option("header", "true").option("escape", "\\").csv(f"{tmp_path}/c").first()["x"] == '["a"]'


def test_fingerprint_sees_changes_and_ignores_order(spark):
    df = spark.createDataFrame([(i, f"v{i % 7}") for i in range(50)], "a int, b string")
    f = [writers.fingerprint(d).first() for d in (df, df.orderBy(F.desc("a")).repartition(3), df.withColumn("b", F.when(F.col("a") == 3, "x").otherwise(F.col("b"))), df.union(df.limit(2)))]
    assert f[0] == f[1] and len({(r["rows"], r["xor_hash"], r["sum_hash"]) for r in f}) == 3
    assert writers.schema_hash(df) != writers.schema_hash(df.withColumnRenamed("a", "z"))


def test_union_with_widening_and_review_log(spark, tmp_path):
    a = spark.createDataFrame([(1, "x")], "k int, s string")
    b = spark.createDataFrame([(2.5, 7)], "k double, s long")
    u = readers.union_relaxed([a, b, spark.createDataFrame([(3,)], "k long")])
    assert dict(u.dtypes) == {"k": "double", "s": "string"} and sorted((r["k"], r["s"]) for r in u.fillna("").collect()) == [(1.0, "x"), (2.5, "7"), (3.0, "")]
    log = writers.empty_review_log(spark)
    assert log.count() == 0
    for label in ("normal", "suspicious"):
        writers.append_reviews(spark.createDataFrame([("r1", label)], "review_id string, label string"), f"{tmp_path}/log")
    got = spark.read.parquet(f"{tmp_path}/log")
    assert got.columns == log.columns and sorted(r["label"] for r in got.collect()) == ["normal", "suspicious"]


def test_an_empty_overwrite_keeps_what_is_there(spark, tmp_path):
    import pytest
    from sessionlab.sources.writers import write_table
    path = str(tmp_path / "t")
    write_table(spark.range(25).selectExpr("id", "id % 3 AS g"), path, partition_by=("g",))
    with pytest.raises(ValueError):
        write_table(spark.range(0).selectExpr("id", "id AS g"), path, partition_by=("g",), overwrite=True)
    assert spark.read.parquet(path).count() == 25


def test_a_failing_overwrite_leaves_the_old_rows(spark, tmp_path):
    from pyspark.sql import functions as F
    from sessionlab.sources.writers import write_table
    path = str(tmp_path / "t")
    write_table(spark.range(5).selectExpr("id", "id AS g"), path, partition_by=("g",))
    broken = spark.range(100).select("id", F.when(F.col("id") < 99, F.col("id")).otherwise(F.raise_error(F.lit("dies here"))).alias("g"))
    with pytest.raises(Exception, match="dies here"):
        write_table(broken, path, overwrite=True)
    assert spark.read.parquet(path).count() == 5
    write_table(spark.range(7).selectExpr("id", "id AS g"), path, overwrite=True)
    assert spark.read.parquet(path).count() == 7 and [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["t"]


def test_globs_of_three_schemas_without_suffixes_and_of_partition_folders(spark, tmp_path):
    import shutil
    from sessionlab.sources.readers import read_tables

    def one_file(df, to):
        tmp = tmp_path / f"w{len(list(tmp_path.iterdir()))}"
        df.coalesce(1).write.parquet(str(tmp))
        to.parent.mkdir(parents=True, exist_ok=True)
        shutil.copy(next(tmp.glob("part-*")), to)
    frames = [spark.range(3).selectExpr("id", "cast(id as int) AS v"), spark.range(3).selectExpr("id", "cast(id as string) AS v"), spark.range(3).selectExpr("id", "id * 0.5D AS v", "1 AS w")]
    for i in range(9):
        one_file(frames[i % 3], tmp_path / "in" / f"log{i}")
        one_file(frames[i % 3], tmp_path / "days" / f"day=2024-01-0{i + 1}" / f"log{i}.data")
    got = read_tables(spark, f"{tmp_path}/in/log*")
    assert got.count() == 27 and dict(got.dtypes)["v"] == "string" and got.where("w = 1").count() == 9
    for path in (f"{tmp_path}/days", f"{tmp_path}/days/day=*"):
        got = read_tables(spark, path)
        assert got.count() == 27 and {str(r.day): r.n for r in got.groupBy("day").agg({"id": "count"}).withColumnRenamed("count(id)", "n").collect()} == {f"2024-01-0{i}": 3 for i in range(1, 10)}


def test_hot_tokens_do_not_meet_in_one_task(spark):
    from pyspark.sql import functions as F
    rows = spark.range(60_000).select(F.lit("c").alias("client_name"), F.when(F.col("id") % 2 == 0, "OUT:ok").when(F.col("id") % 3 == 0, "unseen").otherwise(F.concat(F.lit("t"), (F.col("id") % 500).cast("string"))).alias("token"), F.col("id").alias("pos"))
    vocab = K.vocabulary(rows.where("token != 'unseen'"), max_vocab=300)
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        out = K.token_ids(rows, vocab)
        assert "SortMergeJoin" in out._jdf.queryExecution().executedPlan().toString()
        parts = out.groupBy(F.spark_partition_id()).count().collect()
        assert max(r["count"] for r in parts) < 60_000 / 8
        want = {r.token: r.id for r in vocab.collect()}
        assert all(r.token_id == want.get(r.token, 1) for r in out.select("token", "token_id").distinct().collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_many_untimed_rows_are_numbered_in_ranges(spark):
    from pyspark.sql import functions as F
    from sessionlab.operators.scan import number_rows, number_untimed
    df = spark.range(40_000).select(F.when(F.col("id") % 9 < 8, "hot").otherwise("b").alias("s"), F.when(F.col("id") % 5 == 0, F.timestamp_seconds("id")).alias("t"), F.concat(F.lit("o"), F.hash("id").cast("string")).alias("o"))
    got, want = number_untimed(df, ["s"], "t", ["o"], part_rows=3000), number_rows(df, ["s"], "t", ["o"])
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    assert "dealt" in number_untimed.__doc__ and got.where("t is null").select("s", "seq_no").distinct().count() == 32_000


def test_pca_moments_of_many_groups(spark):
    from pyspark.sql import functions as F
    from sessionlab.operators.learned import HELD, pca_models
    v = spark.range(400).coalesce(1).select(F.concat(F.lit("g"), (F.col("id") % 150).cast("string")).alias("g"), F.array((F.col("id") % 4).cast("int")).alias("slots"), F.array((F.col("id") % 7).cast("double")).alias("weights"))
    got = {r.g: r["mean"] for r in pca_models(v, "g", 4, 2).collect()}
    assert len(got) == 150 > HELD
    rows = [i for i in range(400) if i % 150 == 3]
    want = [sum(i % 7 for i in rows if i % 4 == d) / len(rows) for d in range(4)]
    assert max(abs(a - b) for a, b in zip(got["g3"], want)) < 1e-12
