import datetime as dt
import random

from pyspark.sql import functions as F

from sessionlab.operators import pack as P
from sessionlab.operators import scan
from sessionlab.operators.sessionize import join_events, session_features, sessionize, time_slice
from sessionlab.schema import OBSERVATIONS, SESSION_KEYS, TRACES

T0 = dt.datetime(2024, 1, 1)
EVENT = ("project_id string, trace_id string, observation_id string, user_id string, client_name string, session_id string, "
         "event_time timestamp, obs_name string, level string, route string, route_group string, outcome_class string")


def events(spark, rows):
    """rows: (id, user, session, seconds after midnight)"""
    data = [("p", i, i, u, "c", s, T0 + dt.timedelta(seconds=sec), "n", "L", "/x", "chat", f"o{i}") for i, u, s, sec in rows]
    return spark.createDataFrame(data, EVENT)


def by_id(df, *cols):
    return {r["observation_id"]: tuple(r[c] for c in cols) for r in df.collect()}


def test_gap_is_cut_at_minute_boundaries(spark):
    rows = [("1", "u", None, 59), ("2", "u", None, 30 * 60), ("3", "u", None, 59 * 60 + 59), ("4", "u", None, 89 * 60 + 58)]
    got = by_id(sessionize(events(spark, rows)), "session_key", "seq_no", "dt_bucket")
    # 00:00:59 -> 00:30:00 is 29 minutes and a second but crosses 30 boundaries; 00:30:00 -> 00:59:59 crosses 29.
    assert got == {"1": ("gap:1", 0, "t_start"), "2": ("gap:2", 0, "t_start"), "3": ("gap:2", 1, "t_idle"), "4": ("gap:3", 0, "t_start")}


def test_named_sessions_have_no_gap_and_no_clash(spark):
    rows = [("1", "u", "NOSESSION", 0), ("2", "u", "NOSESSION", 20 * 3600), ("3", "u", None, 0), ("4", "u", None, 60)]
    got = by_id(sessionize(events(spark, rows)), "session_key", "seq_no")
    assert got == {"1": ("sid:NOSESSION", 0), "2": ("sid:NOSESSION", 1), "3": ("gap:1", 0), "4": ("gap:1", 1)}


def test_equal_times_keep_arrays_aligned(spark):
    rows = [("2", "u", None, 0), ("1", "u", None, 0), ("3", "u", None, 0)]
    p = P.pack_numbered(sessionize(events(spark, rows))).first()
    assert p["outcome_class"] == ["o1", "o2", "o3"] and p["observation_id"] == [0, 1, 2]
    assert [t.split("|out=")[1].split("|")[0] for t in p["token"]] == ["o1", "o2", "o3"]


def brute(rows, gap=30):
    out, by = {}, {}
    for i, u, s, sec in rows:
        by.setdefault((u, s), []).append((sec, i))
    for (u, s), ev in by.items():
        no, prev, seq = 0, None, 0
        for sec, i in sorted(ev):
            if prev is None or (s is None and sec // 60 - prev // 60 >= gap):
                no, seq, before = no + 1, 0, None
            out[i] = (f"sid:{s}" if s else f"gap:{no}", seq, None if before is None else (sec - before) * 1000)
            prev = before = sec
            seq += 1
    return out


def test_sessions_equal_brute_force_and_do_not_depend_on_layout(spark):
    rng = random.Random(5)
    # One user holds half of all rows.
    rows = [(str(i), "hot" if rng.random() < 0.5 else f"u{rng.randrange(9)}", rng.choice([None, None, "s1"]), rng.randrange(86400)) for i in range(3000)]
    want = brute(rows)
    assert by_id(sessionize(events(spark, rows), stage=False), "session_key", "seq_no", "dt_ms") == want
    rng.shuffle(rows)
    assert by_id(sessionize(events(spark, rows).repartition(7)), "session_key", "seq_no", "dt_ms") == want


def test_join_drops_deleted_foreign_days_and_userless(spark):
    day = dt.datetime(2024, 1, 2, 12)
    early = dt.datetime(2024, 1, 1, 23)
    tr = spark.createDataFrame([("p", "a", "u", "", {"aap_log_name": "tc"}, day, 0), ("p", "b", "", "", {"user_api_key_end_user_id": "e"}, day, 0),
                                ("p", "c", "", "", {}, day, 0), ("p", "d", "u", "", {}, early, 0), ("p", "x", "u", "", {}, day, 1)], TRACES)
    ob = spark.createDataFrame([("p", f"o{t}", t, day, "litellm-info", "DEFAULT", {"user_api_key_request_route": "/v1/models"}, 0) for t in "abcdxz"], OBSERVATIONS)
    got = by_id(join_events(tr, ob, "2024-01-02", "2024-01-03"), "user_id", "client_name", "route_group", "outcome_class")
    assert got == {"oa": ("u", "tc", "models", "info"), "ob": ("e", "unknown_client", "models", "info")}
    late = by_id(join_events(tr, ob, "2024-01-02", "2024-01-03", trace_start="2024-01-01"), "user_id")
    assert set(late) == {"oa", "ob", "od"}


def test_time_slice_is_half_open(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1), 0), (dt.datetime(2024, 1, 2), 0), (dt.datetime(2024, 1, 1, 5), 1)], "created_at timestamp, is_deleted int")
    assert time_slice(df, "2024-01-01", "2024-01-02").count() == 1


def test_feature_counts_add_up(spark):
    rows = [(str(i), f"u{i % 3}", None, i * 7) for i in range(90)]
    for r in session_features(sessionize(events(spark, rows))).collect():
        assert r["n_t_start"] == 1 and sum(r[f"n_{b}"] for b in ("t_start", "t_fast", "t_norm", "t_slow", "t_idle")) == r["n_events"] == 30
        assert r["n_chat"] == 30 and r["duration_s"] == 29 * 21 and abs(r["events_per_s"] - 30 / (29 * 21 + 1)) < 1e-12


def test_neighbours_across_blocks(spark):
    rows = [(k, i, f"{k}{i}") for k, n in (("a", 23), ("b", 1), ("c", 8)) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, seq_no long, v string").repartition(5)
    got = scan.neighbours(df, ["k"], "seq_no", ahead={"n1": ("v", 1), "n2": ("v", 2)}, behind={"p1": ("v", 1), "p3": ("v", 3)}, block=4).collect()
    have = {(k, i): v for k, i, v in rows}
    assert len(got) == len(rows)
    for r in got:
        assert [r["n1"], r["n2"], r["p1"], r["p3"]] == [have.get((r["k"], r["seq_no"] + d)) for d in (1, 2, -1, -3)]


def test_numbering_and_last_known(spark):
    rng = random.Random(1)
    rows = [(f"k{rng.randrange(3)}", T0 + dt.timedelta(seconds=rng.randrange(500)) if rng.random() < 0.9 else None, i) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, t timestamp, i int").repartition(6)
    got = scan.number_rows(df, ["k"], "t", ["i"], slot_us=20_000_000)
    want = {}
    for k in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1] is None, r[1] or T0, r[2]))
        want |= {r[2]: n for n, r in enumerate(mine)}
    assert {r["i"]: r["seq_no"] for r in got.collect()} == want
    known = scan.last_known(got.withColumn("x", F.when(F.col("i") % 3 == 0, F.col("i"))), ["k"], "seq_no", F.col("x"), "was", block=8).collect()
    for k in {r["k"] for r in known}:
        last = None
        for r in sorted((r for r in known if r["k"] == k), key=lambda r: r["seq_no"]):
            assert r["was"] == last
            last = r["x"] if r["x"] is not None else last


def test_packing_long_sessions_in_chunks(spark):
    ev = sessionize(events(spark, [(str(i).zfill(3), "u", None, i) for i in range(25)]))
    p = P.pack_numbered(ev, chunk_events=10)
    assert sorted((r["chunk"], len(r["token"])) for r in p.collect()) == [(0, 10), (1, 10), (2, 5)]
    assert [r["seq_no"] for r in P.unpack(p).orderBy("seq_no").collect()] == list(range(25))


def test_pack_three_shapes(spark):
    ev = spark.createDataFrame([("u", "c", "s", T0 + dt.timedelta(seconds=9 - i), f"r{i}", "ok", i) for i in range(3)],
                               "user_id string, client_name string, session_key string, ts timestamp, route_group string, outcome_class string, event_id int")
    p = P.pack(ev, "2024-01-01").first()
    assert p["source_mode"] == "event_level" and p["token"] == ["r2:ok", "r1:ok", "r0:ok"] and p["day"] == "2024-01-01"
    packed = spark.createDataFrame([("u", "c", "s", ["a", "b", "c"], ["x", "y"], [], ["2024-01-01 00:00:00", "bad", "2024-01-01 00:00:01"])],
                                   "user_id string, client_name string, session_key string, route_groups array<string>, outcomes array<string>, tokens array<string>, event_times array<string>")
    p = P.pack(packed, "2024-01-01").first()
    assert p["source_mode"] == "packed_session" and p["token"] == ["a:x", "b:y"] and p["observation_id"] == [0, 1]
    assert p["event_time"] == [T0, None]
    plain = spark.createDataFrame([("u", "c", "s", "chat", "ok"), ("v", "c", "s", None, "ok")],
                                  "user_id string, client_name string, session_key string, route_group string, outcome_class string")
    got = {r["user_id"]: (r["source_mode"], r["token"]) for r in P.pack(plain, "2024-01-01").collect()}
    assert got == {"u": ("session_fallback", ["chat:ok"]), "v": ("session_fallback", [])}


def test_mismatched_arrays(spark):
    df = spark.createDataFrame([("a", [1, 2, 3], [1, 2], [1, 2, 3, 4]), ("b", [1], [], [1]), ("c", [], [], [])], "k string, x array<int>, y array<int>, z array<int>")
    cut = {r["k"]: (r["min_len"], len(r["x"]), len(r["y"]), len(r["z"])) for r in P.cut_arrays(df, ["x", "y", "z"]).collect()}
    assert cut == {"a": (2, 2, 2, 2), "b": (0, 0, 0, 0), "c": (0, 0, 0, 0)}
    loose = {r["k"]: (r["min_len"], len(r["x"]), len(r["y"])) for r in P.cut_arrays(df, ["x", "y", "z"], ignore_empty=True).collect()}
    assert loose == {"a": (2, 2, 2), "b": (1, 1, 0), "c": (0, 0, 0)}
    assert {r["k"] for r in P.empty_sessions(df, ["x", "y", "z"]).collect()} == {"b", "c"}
    m = {r["k"]: r["explode_meta"] for r in P.explode_meta(df, ["x", "y", "z"], ["x", "y"]).collect()}
    assert m["a"]["truncated_counts"] == {"x": 1, "y": 0, "z": 2} and m["a"]["original_lengths"]["z"] == 4


def test_packing_a_chunked_table_again_keeps_the_numbers(spark):
    from pyspark.sql import functions as F
    from sessionlab.operators.pack import pack, unpack
    ev = spark.range(25).select(F.lit("u").alias("user_id"), F.lit("c").alias("client_name"), F.lit("s").alias("session_key"), F.col("id").alias("observation_id"),
                                F.timestamp_seconds(F.col("id")).alias("event_time"), F.lit("chat").alias("route_group"), F.lit("ok").alias("outcome_class"))
    once = pack(ev, "2024-01-01", chunk_events=10)
    again = pack(once, "2024-01-01")
    assert once.count() == again.count() == 3
    assert sorted(r.seq_no for r in unpack(again).collect()) == sorted(r.seq_no for r in unpack(once).collect()) == list(range(25))


def test_sessionize_exchanges_the_events_once(spark):
    rows = [(str(i), f"u{i % 3}", None, i * 70) for i in range(200)]
    ev = events(spark, rows).withColumn("client_name", F.when(F.col("user_id") != "u1", F.col("client_name")))
    got = sessionize(ev, stage=False)
    p = got._jdf.queryExecution().executedPlan().toString()
    # One exchange of the events, three of the minutes: by minute, by entity, and back to meet the events.
    assert p.count("Exchange hashpartitioning(") <= 4
    # Users without a client keep their sessions.
    assert by_id(got, "session_key", "seq_no", "dt_ms") == brute(rows)
