"""Queries: token sequences, vocabularies, ids, learned scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import evaluate as V
from ..operators import learned as L
from ..operators import sequence as S
from ..operators import stats as St
from ..operators import tokens as K
from ..schema import SESSION_KEYS
from ..staging import materialize
from . import fixtures as X
from .q_sequences import B1_MEAN, B3
from .registry import query, r6
from .sql_base import KEYS, SESSIONS, WEEKLY

MAX_LEN = 64

GAP_SQL = """CASE WHEN prev_time IS NULL THEN '<BOS>' WHEN g < 0.2 THEN '<0.2s' WHEN g < 1 THEN '0.2-1s' WHEN g < 5 THEN '1-5s' WHEN g < 30 THEN '5-30s'
  WHEN g < 120 THEN '30-120s' WHEN g < 600 THEN '2-10m' ELSE '>10m' END"""


def _cells(version: str) -> list[str]:
    out, dt, gap, tok = "'OUT:' || outcome_class", "'DT:' || dt_bucket", f"'GAP:' || {GAP_SQL}", "'TOK:' || token"
    if version == "v0":
        return ["token"]
    if version == "v1":
        return [tok, out, dt, gap, "'EOV'"]
    return ["'RG:' || route_group", out, dt, gap, tok, "'OP:' || route_group", "'OUT2:' || outcome_class", "'DT2:' || dt_bucket", "'EOV'"]


def tokens_sql(version: str, max_len: int = MAX_LEN) -> str:
    """CTE `tk`: token rows with pos and seq_len."""
    cells = _cells(version)
    w = len(cells)
    parts = [f"SELECT {KEYS}, 1 + seq_no * {w} + {i} AS p, {c} AS token FROM e1" for i, c in enumerate(cells)]
    parts += [f"SELECT {KEYS}, 0, 'BOS' FROM e1 WHERE seq_no = 0", f"SELECT {KEYS}, 1 + (seq_no + 1) * {w}, 'EOS' FROM e1 WHERE seq_no = n - 1"]
    return f"""e1 AS (SELECT *, date_diff('microsecond', prev_time, event_time) / 1e6::DOUBLE AS g, count(*) OVER (PARTITION BY {KEYS}) AS n FROM ev),
tk0 AS ({' UNION ALL '.join(parts)}),
tk1 AS (SELECT *, count(*) OVER (PARTITION BY {KEYS}) AS total FROM tk0),
tk AS (SELECT {KEYS}, token, p - greatest(total - {max_len}, 0) AS pos, least(total, {max_len}) AS seq_len FROM tk1 WHERE p >= total - {max_len})"""


def rows_of(spark, sf, version, max_len=MAX_LEN):
    return K.token_rows(X.session_events(spark, sf), version, SESSION_KEYS, max_len)


def _token_query(version):
    @query(f"tok_{version}", f"""WITH {SESSIONS}, {tokens_sql(version)}
SELECT {KEYS}, CAST(any_value(seq_len) AS BIGINT) AS seq_len, string_agg(token, ' ' ORDER BY pos) AS text FROM tk GROUP BY {KEYS}""")
    def tok(spark, sf):
        return K.sequence_text(K.sequences(rows_of(spark, sf, version))).drop("tokens")


for _v in ("v0", "v1", "v2"):
    _token_query(_v)


@query("pad_mask", f"""WITH {SESSIONS}, {tokens_sql('v0', 16)}
SELECT {KEYS}, string_agg(token, ' ' ORDER BY pos) || repeat(' PAD', CAST(16 - any_value(seq_len) AS BIGINT)) AS tokens,
  repeat('1', CAST(any_value(seq_len) AS BIGINT)) || repeat('0', CAST(16 - any_value(seq_len) AS BIGINT)) AS attention_mask FROM tk GROUP BY {KEYS}""")
def pad_mask(spark, sf):
    p = K.padded(K.sequences(rows_of(spark, sf, "v0", 16)), "tokens", 16, "PAD")
    return p.select(*SESSION_KEYS, "tokens", F.array_join(F.transform("attention_mask", lambda m: m.cast("string")), "").alias("attention_mask"))


SPLIT_SQL = "CAST(('0x' || substr(md5(client_name || '|' || user_id || '|' || session_key), 1, 13)) AS BIGINT) % 100"
SPLIT_CASE = f"CASE WHEN {SPLIT_SQL} < 90 THEN 'train' WHEN {SPLIT_SQL} < 95 THEN 'val' ELSE 'test' END"


@query("split", f"""WITH {SESSIONS} SELECT DISTINCT {KEYS}, {SPLIT_CASE} AS split FROM ev""")
def split(spark, sf):
    return K.with_split(X.session_events(spark, sf).select(*SESSION_KEYS).distinct())


@query("split_blake")
def split_blake(spark, sf):
    s = K.with_split(X.session_events(spark, sf).select(*SESSION_KEYS).distinct(), blake=True)
    return s.groupBy("split").agg(F.count("*").alias("n"))


MIN_FREQ, MAX_VOCAB = 3, 60
RESERVED_SQL = ", ".join(f"('{t}', {i})" for i, t in enumerate(K.RESERVED))
VOCAB = f"""{tokens_sql('v1')},
fq AS (SELECT client_name, token, count(*) AS freq FROM tk GROUP BY ALL),
rv(token, id) AS (VALUES {RESERVED_SQL}),
vo AS (SELECT client_name, token, 8 + row_number() OVER (PARTITION BY client_name ORDER BY freq DESC, token) AS id, freq FROM fq WHERE freq >= {MIN_FREQ} AND token NOT IN (SELECT token FROM rv)),
voc AS (SELECT * FROM vo WHERE id < {MAX_VOCAB} UNION ALL SELECT c.client_name, rv.token, rv.id, coalesce(fq.freq, 0) FROM (SELECT DISTINCT client_name FROM fq) c
  CROSS JOIN rv LEFT JOIN fq ON fq.client_name = c.client_name AND fq.token = rv.token)"""


def vocab_of(rows):
    return K.vocabulary(rows, min_freq=MIN_FREQ, max_vocab=MAX_VOCAB)


@query("vocab", f"WITH {SESSIONS}, {VOCAB} SELECT client_name, token, CAST(id AS BIGINT) AS id, CAST(freq AS BIGINT) AS freq FROM voc")
def vocab(spark, sf):
    return vocab_of(rows_of(spark, sf, "v1"))


@query("coverage", f"""WITH {SESSIONS}, {VOCAB},
pads AS (SELECT client_name, sum({MAX_LEN} - seq_len) AS pad FROM tk WHERE pos = 0 GROUP BY ALL),
kn AS (SELECT client_name, sum(freq) AS total, sum(CASE WHEN token IN (SELECT token FROM voc v WHERE v.client_name = fq.client_name) THEN freq ELSE 0 END) AS known FROM fq GROUP BY ALL)
SELECT client_name, CAST(total AS BIGINT) AS total, CAST(known AS BIGINT) AS known, {r6('known / total')} AS coverage, {r6('(known + pad) / (total + pad)')} AS coverage_padded,
  (SELECT count(*) FROM voc v WHERE v.client_name = kn.client_name) AS vocab_size FROM kn JOIN pads USING (client_name)""")
def coverage(spark, sf):
    rows = materialize(rows_of(spark, sf, "v1"), "tokens")
    v = materialize(vocab_of(rows), "vocab")
    pad = K.coverage(rows, v, pad_to=MAX_LEN).select("client_name", F.col("coverage").alias("coverage_padded"))
    return K.coverage(rows, v).join(pad, "client_name")


@query("ids", f"""WITH {SESSIONS}, {VOCAB}
SELECT {KEYS}, string_agg(CAST(coalesce(id, 1) AS VARCHAR), ' ' ORDER BY pos) AS ids FROM (SELECT tk.*, voc.id FROM tk LEFT JOIN voc ON tk.client_name = voc.client_name AND tk.token = voc.token) GROUP BY {KEYS}""")
def ids(spark, sf):
    rows = materialize(rows_of(spark, sf, "v1"), "tokens")
    s = K.sequences(K.token_ids(rows, materialize(vocab_of(rows), "vocab")), col="token_id", out="ids")
    return s.select(*SESSION_KEYS, F.transform("ids", lambda i: i.cast("string")).alias("ids"))


@query("token_fields", f"""WITH {SESSIONS} SELECT token, route_group AS op, outcome_class AS out, dt_bucket AS dt, '<NA>' AS none, count(*) AS n FROM ev GROUP BY ALL""")
def token_fields(spark, sf):
    t = F.col("token")
    return X.session_events(spark, sf).groupBy("token").agg(F.count("*").alias("n")).select(
        "token", C.token_field(t, "op").alias("op"), C.token_field(t, "out").alias("out"), C.token_field(t, "dt").alias("dt"),
        C.token_field(F.concat(F.lit("x"), t), "op").alias("none"), "n")


@query("epoch_times", """SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS iso, round(epoch(date_trunc('second', ts)), 3) + 0.0 AS from_iso,
  round((epoch_us(ts) // 1000) / 1000, 3) + 0.0 AS from_ms, floor(epoch(ts)) + 0.0 AS from_s FROM events""")
def epoch_times(spark, sf):
    t = F.col("ts").cast("timestamp")
    us = F.unix_micros(t)
    e = X.read(spark, sf, "events").select("event_id", F.date_format(t, "yyyy-MM-dd HH:mm:ss").alias("iso"),
                                           ((us - us % 1000) / 1000).cast("long").alias("ms"), F.unix_seconds(t).alias("s"))
    return e.select("event_id", "iso", C.epoch_seconds(F.col("iso")).alias("from_iso"), F.round(C.epoch_seconds(F.col("ms")), 3).alias("from_ms"),
                    C.epoch_seconds(F.col("s")).alias("from_s"))


@query("text_lists", """WITH p AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN p_name || ' , ' || p_partkey || ',' WHEN 2 THEN '["a","' || p_partkey || '"]' WHEN 3 THEN ' ' ELSE '[broken' END AS t FROM
  (SELECT p_partkey, replace(replace(p_name, ',', ' '), '[', ' ') AS p_name FROM part))
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN trim(t) WHEN 1 THEN trim(split_part(t, ',', 1)) || '/' || p_partkey WHEN 2 THEN 'a/' || p_partkey WHEN 3 THEN '' ELSE '[broken' END AS items FROM p""")
def text_lists(spark, sf):
    k = F.col("p_partkey")
    name = F.regexp_replace("p_name", r"[,\[]", " ")
    t = (F.when(k % 5 == 0, name).when(k % 5 == 1, F.concat(name, F.lit(" , "), k.cast("string"), F.lit(",")))
         .when(k % 5 == 2, F.concat(F.lit('["a","'), k.cast("string"), F.lit('"]'))).when(k % 5 == 3, " ").otherwise("[broken"))
    return X.read(spark, sf, "part").select("p_partkey", F.array_join(C.parse_list(t), "/").alias("items"))


@query("loss_reduce", """WITH l AS (SELECT l_orderkey, l_quantity AS loss, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem
  WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_quantity, l_partkey, l_suppkey, l_linenumber, l_extendedprice))
SELECT l_orderkey, round(avg(loss), 6) + 0.0 AS mean, round(avg(loss) FILTER (pos >= n - 2), 6) + 0.0 AS tail, max(loss) + 0.0 AS max,
  round(coalesce(avg(loss) FILTER (pos >= 6), 0), 6) + 0.0 AS tail_padded FROM l GROUP BY ALL""")
def loss_reduce(spark, sf):
    li = X.read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_quantity")).alias("q"))
    arr = li.select("l_orderkey", L.reduce_loss_array(F.col("q"), 2).alias("r"))
    rows = li.select("l_orderkey", F.size("q").alias("seq_len"), F.posexplode("q").alias("pos", "loss"))
    pad = L.reduce_losses(rows, ["l_orderkey"], 2, padded_to=8).select("l_orderkey", F.col("tail").alias("tail_padded"))
    return arr.join(pad, "l_orderkey").select("l_orderkey", "r.mean", "r.tail", "r.max", "tail_padded")


@query("lm_score", f"""WITH {SESSIONS}, {tokens_sql('v0')},
sp AS (SELECT *, {SPLIT_CASE} AS split, lag(token) OVER s AS t2, lag(token, 2) OVER s AS t1 FROM tk WINDOW s AS (PARTITION BY {KEYS} ORDER BY pos)),
gr AS (SELECT * FROM sp WHERE pos >= 1),
tr AS (SELECT * FROM gr WHERE split = 'train'),
g3 AS (SELECT client_name, t1, t2, token, count(*) AS n123 FROM tr GROUP BY ALL), x2 AS (SELECT client_name, t1, t2, count(*) AS n12 FROM tr GROUP BY ALL),
g2 AS (SELECT client_name, t2, token, count(*) AS n23 FROM tr GROUP BY ALL), x1 AS (SELECT client_name, t2, count(*) AS n2 FROM tr GROUP BY ALL),
g1 AS (SELECT client_name, token, count(*) AS n3 FROM tr GROUP BY ALL), g0 AS (SELECT client_name, sum(n3) + count(*) + 1 AS n0 FROM g1 GROUP BY ALL),
pr AS (SELECT gr.*, -ln((0.6::DOUBLE * coalesce(n123 / n12, 0) + 0.3::DOUBLE * coalesce(n23 / n2, 0) + 0.1::DOUBLE * (coalesce(n3, 0) + 1) / coalesce(n0, 1))
  / (CASE WHEN n12 IS NULL THEN 0::DOUBLE ELSE 0.6::DOUBLE END + CASE WHEN n2 IS NULL THEN 0::DOUBLE ELSE 0.3::DOUBLE END + 0.1::DOUBLE)) AS nll FROM gr
  LEFT JOIN g3 USING (client_name, t1, t2, token) LEFT JOIN x2 USING (client_name, t1, t2) LEFT JOIN g2 USING (client_name, t2, token)
  LEFT JOIN x1 USING (client_name, t2) LEFT JOIN g1 USING (client_name, token) LEFT JOIN g0 USING (client_name) WHERE split = 'test')
SELECT {KEYS}, 'test' AS split, {r6('avg(nll)')} AS score_mean_nll, {r6('avg(nll) FILTER (seq_len - pos <= 8)')} AS score_tail_nll, {r6('max(nll)')} AS score_max_nll FROM pr GROUP BY {KEYS}""")
def lm_score(spark, sf):
    return L.lm_scores(K.with_split(rows_of(spark, sf, "v0")), tail_k=8)


@query("pca_recon")
def pca_recon(spark, sf):
    return L.reconstruction_scores(X.session_events(spark, sf), dims=64, components=6)


@query("weak_clf")
def weak_clf(spark, sf):
    ev = X.session_events(spark, sf)
    labels = K.with_split(V.weak_labels(ev))
    return L.weak_label_scores(ev, labels, token="route_group")


@query("pseudo_train", f"""WITH {B1_MEAN}, en AS (SELECT {KEYS}, ln(sum(c)) - sum(c * ln(c)) / sum(c) AS h FROM (SELECT {KEYS}, token, count(*) AS c FROM ev GROUP BY ALL) GROUP BY {KEYS}),
ra AS (SELECT {KEYS} FROM (SELECT *, row_number() OVER (PARTITION BY client_name, day ORDER BY round(seq_raw, 9) DESC, session_key, user_id) AS i FROM b1) WHERE i <= 5),
rb AS (SELECT {KEYS} FROM (SELECT *, row_number() OVER (PARTITION BY client_name, day ORDER BY round(h, 9) DESC, session_key, user_id) AS i FROM en) WHERE i <= 5),
po AS (SELECT * FROM ra UNION SELECT * FROM rb),
sz AS (SELECT client_name, count(*) AS n_all, count(po.session_key) AS n_pos FROM b1 LEFT JOIN po USING ({KEYS}) GROUP BY ALL)
SELECT {KEYS}, 1 AS label FROM po UNION ALL SELECT {KEYS}, 0 FROM b1 ANTI JOIN po USING ({KEYS}) JOIN sz USING (client_name)
WHERE CAST(('0x' || substr(md5(client_name || '|' || day || '|' || user_id || '|' || session_key), 1, 13)) AS BIGINT) % 1000000 < n_pos * 3.0::DOUBLE / (n_all - n_pos) * 1000000""")
def pseudo_train(spark, sf):
    ev = X.weekly_events(spark, sf)
    a = materialize(S.markov(ev).withColumn("seq_raw", F.round("seq_raw", 9)), "scores")
    b = S.entropies(ev, SESSION_KEYS).withColumn("h", F.round("entropy_session", 9))
    pb = St.top_k(b, ("client_name", "day"), [F.desc("h"), F.asc("session_key"), F.asc("user_id")], 5)
    return L.pseudo_training_set(a, [S.rank_sequences(a, k=5), pb])


@query("align_sides", """WITH c AS (SELECT conv_id, count(*) AS n, count(*) FILTER (role = 'user') AS nu, string_agg(text, '' ORDER BY turn) AS t FROM conversations GROUP BY ALL)
SELECT conv_id, n, rtrim(repeat('user ', nu) || repeat('<NA> ', n - nu)) AS roles FROM c""")
def align_sides(spark, sf):
    c = X.read(spark, sf, "conversations").groupBy("conv_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda s: s.text).alias("token"),
        F.collect_list(F.when(F.col("role") == "user", F.col("role"))).alias("roles"))
    return K.align_arrays(c, "token", ["roles"]).select("conv_id", F.size("token").alias("n"), "roles")
