"""Sequence scores: Markov likelihood, n-gram rarity, entropy deviation, and their composite.

Every score reads event rows with a dense `seq_no`; sessions are counted, never collected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..schema import PARTITION_KEYS, SESSION_KEYS, keys_of
from ..staging import join_scope, materialize, small_side
from .drilldown import drilldown
from .scan import neighbours
from .stats import median_mad, quantiles, scale_0_100, top_k


def exact_sum(x: Column) -> Column:
    """Sum whose result does not depend on the order of the rows, so that re-evaluated branches agree."""
    return F.sum(x.cast("decimal(28,16)")).cast("double")


def session_steps(events: DataFrame, keys: Sequence[str], token: str) -> DataFrame:
    """Per session: how often token `a` is followed by `b` (null `b` = last event). A missing token is one of its own."""
    return (neighbours(events.select(*keys, "seq_no", F.coalesce(F.col(token), F.lit(C.NA)).alias("a")), keys, "seq_no", ahead={"b": ("a", 1)})
            .groupBy(*keys, "a", "b").agg(F.count("*").alias("c")))


def transition_counts(steps: DataFrame, part: Sequence[str]) -> DataFrame:
    """c(a, b) per partition."""
    return steps.where(F.col("b").isNotNull()).groupBy(*part, "a", "b").agg(F.sum("c").alias("c_ab"))


def partition_vocabulary(steps: DataFrame, part: Sequence[str]) -> DataFrame:
    return steps.groupBy(*part).agg(F.count_distinct("a").alias("v"))


def markov(events: DataFrame, keys: Sequence[str] = SESSION_KEYS, part: Sequence[str] = PARTITION_KEYS,
           token: str = "token", reduce: str = "mean", steps: DataFrame | None = None) -> DataFrame:
    """Negative log-likelihood of a session's steps under add-one transition probabilities of its partition.

    The step counts are written once (or passed in) and then read for the statistics and for scoring.
    """
    keys = keys_of(keys, events)
    steps = steps if steps is not None else materialize(session_steps(events, keys, token), "steps")
    pair = steps.groupBy(*part, "a", "b").agg(F.sum("c").alias("c_ab"))
    out = pair.groupBy(*part, "a").agg(F.sum(F.when(F.col("b").isNotNull(), F.col("c_ab")).otherwise(0)).alias("c_a"))
    vocab = out.groupBy(*part).agg(F.count("*").alias("v"))
    logp = (join_scope(join_scope(pair.where("b is not null"), out, [*part, "a"]), vocab, part)
            .select(*part, "a", "b", F.ln((F.col("c_ab") + 1) / (F.col("c_a") + F.col("v"))).alias("lp")))
    scored = join_scope(steps, logp, [*part, "a", "b"], "left")
    nll = exact_sum(-F.col("c") * F.coalesce(F.col("lp"), F.lit(0.0)))
    n = F.sum(F.when(F.col("b").isNotNull(), F.col("c")).otherwise(0))
    raw = nll if reduce == "sum" else F.when(n > 0, nll / F.nullif(n, F.lit(0))).otherwise(F.lit(0.0))
    return scored.groupBy(*keys).agg(raw.alias("seq_raw"), F.sum("c").alias("n_events"), n.alias("n_transitions")) \
        .withColumn("model", F.lit("b1"))


def session_ngrams(events: DataFrame, keys: Sequence[str], token: str, sizes: Sequence[int] = (2, 3)) -> DataFrame:
    """Per session: count of each n-gram; `n` is its size, `t1`..`tN` its tokens (null beyond n)."""
    widest = max(sizes)
    ahead = {f"t{i + 1}": ("t1", i) for i in range(1, widest)}
    rows = neighbours(events.select(*keys, "seq_no", F.coalesce(F.col(token), F.lit(C.NA)).alias("t1")), keys, "seq_no", ahead=ahead)
    cols = [f"t{i + 1}" for i in range(widest)]
    grams = [F.when(F.col(f"t{n}").isNotNull(), F.struct(F.lit(n).alias("n"), *[
        (F.col(c) if i < n else F.lit(None).cast("string")).alias(c) for i, c in enumerate(cols)])) for n in sizes]
    return (rows.select(*keys, F.inline(F.array_compact(F.array(*grams))))
            .groupBy(*keys, "n", *cols).agg(F.count("*").alias("c")))


def ngram_log_probs(grams: DataFrame, part: Sequence[str], widest: int = 3) -> DataFrame:
    """Smoothed log probability of every n-gram of the partition, sizes pooled, with its count."""
    cols = [f"t{i + 1}" for i in range(widest)]
    table = grams.groupBy(*part, "n", *cols).agg(F.sum("c").alias("c_all"))
    total = table.groupBy(*part).agg((F.sum("c_all") + F.count("*")).alias("denom"))
    return join_scope(table, total, part).withColumn("lp", F.ln((F.col("c_all") + 1) / F.col("denom"))).drop("denom")


def _gram_key(widest: int = 3):
    """One text for the tokens of an n-gram, so that missing third tokens join as equal."""
    return F.to_json(F.array(*[F.col(f"t{i + 1}") for i in range(widest)]))


def score_ngrams(grams: DataFrame, keys: Sequence[str], part: Sequence[str], widest: int = 3) -> DataFrame:
    """n-gram rows of sessions with their log probability in the partition."""
    probs = ngram_log_probs(grams, part, widest).select(*part, "n", _gram_key(widest).alias("gram"), "c_all", "lp")
    return join_scope(grams.withColumn("gram", _gram_key(widest)), probs, [*part, "n", "gram"])


def ngram_rarity(events: DataFrame, keys: Sequence[str] = SESSION_KEYS, part: Sequence[str] = PARTITION_KEYS,
                 token: str = "token", reduce: str = "mean", sizes: Sequence[int] = (2, 3)) -> DataFrame:
    """Mean (or summed) surprise of a session's n-grams; sessions without any score 0."""
    keys = keys_of(keys, events)
    grams = materialize(session_ngrams(events, keys, token, sizes), "grams")
    scored = score_ngrams(grams, keys, part, max(sizes))
    per = scored.groupBy(*keys).agg(exact_sum(-F.col("c") * F.col("lp")).alias("_nll"), F.sum("c").alias("n_ngrams"))
    sizes_of = events.groupBy(*keys).agg(F.count("*").alias("n_events"))
    raw = F.col("_nll") if reduce == "sum" else F.col("_nll") / F.col("n_ngrams")
    return join_scope(sizes_of, per, keys, "left").select(
        *keys, F.coalesce(raw, F.lit(0.0)).alias("seq_raw"), "n_events",
        F.coalesce("n_ngrams", F.lit(0)).alias("n_ngrams"), F.lit("b2").alias("model"))


def entropies(events: DataFrame, keys: Sequence[str], token: str = "token") -> DataFrame:
    """Shannon entropy (nats) of each session's token distribution."""
    counts = events.groupBy(*keys, token).agg(F.count("*").alias("c"))
    n = F.sum("c").cast("double")
    h = F.ln(n) - exact_sum(F.col("c") * F.ln(F.col("c").cast("double"))) / n
    return counts.groupBy(*keys).agg(F.greatest(h, F.lit(0.0)).alias("entropy_session"), F.sum("c").alias("n_events"))


def entropy_deviation(events: DataFrame, keys: Sequence[str] = SESSION_KEYS, part: Sequence[str] = PARTITION_KEYS,
                      token: str = "token") -> DataFrame:
    keys = keys_of(keys, events)
    ent = materialize(entropies(events, keys, token), "entropy")
    med = quantiles(ent, part, "entropy_session", {"entropy_median_partition": 0.5}).drop("n_values")
    return join_scope(ent, small_side(med), part).withColumn(
        "seq_raw", F.abs(F.col("entropy_session") - F.col("entropy_median_partition"))).withColumn("model", F.lit("b3"))


MODELS = {"b1": markov, "b2": ngram_rarity, "b3": entropy_deviation}


def with_risk(scores: DataFrame, part: Sequence[str] = PARTITION_KEYS, flat: str = "minmax") -> DataFrame:
    """`risk_score_seq`: the raw score scaled by p50..p95 of its partition.

    Raw scores are rounded to 9 places first: sessions that are alike then have equal scores, and a flat
    partition is seen as flat.
    """
    scores = materialize(scores.withColumn("seq_raw", F.round("seq_raw", 9)), "scores")
    return scale_0_100(scores, part, "seq_raw", "risk_score_seq", 0.50, 0.95, flat)


def composite(events: DataFrame, keys: Sequence[str] = SESSION_KEYS, part: Sequence[str] = PARTITION_KEYS,
              token: str = "route_group", alpha_step: float = 0.5, alpha_pair: float = 1.0, eps: float = 1e-9) -> DataFrame:
    """Smoothed step, pair and entropy scores as robust z, summed to `b_risk`.

    The vocabulary comes from sessions with at least two events only.
    """
    keys = keys_of(keys, events)
    steps = materialize(session_steps(events, keys, token), "steps")
    pair = transition_counts(steps, part)
    out = pair.groupBy(*part, "a").agg(F.sum("c_ab").alias("c_a"))
    vocab = (pair.select(*part, F.explode(F.array("a", "b")).alias("t"), "c_ab").groupBy(*part)
             .agg(F.count_distinct("t").alias("v"), (F.sum("c_ab") / 2).alias("total")))
    probs = join_scope(join_scope(pair, out, [*part, "a"]), vocab, part).select(
        *part, "a", "b",
        F.ln((F.col("c_ab") + alpha_step) / (F.col("c_a") + alpha_step * F.col("v")) + eps).alias("lp1"),
        F.ln((F.col("c_ab") + alpha_pair) / (F.col("total") + alpha_pair * F.col("v") * F.col("v")) + eps).alias("lp2"))
    n = F.sum(F.when(F.col("b").isNotNull(), F.col("c")))

    def mean(lp: str):
        return F.coalesce(exact_sum(-F.col("c") * F.col(lp)) / n, F.lit(0.0))

    seq = join_scope(steps, probs, [*part, "a", "b"], "left").groupBy(*keys).agg(mean("lp1").alias("b1_mnll"), mean("lp2").alias("b2_score"))
    counts = events.groupBy(*keys, token).agg(F.count("*").alias("c"))
    n_ev = counts.groupBy(*keys).agg(F.sum("c").alias("n"))
    p = F.col("c") / F.col("n")
    ent = join_scope(counts, n_ev, keys).groupBy(*keys).agg(exact_sum(-p * F.ln(p + eps)).alias("b3_entropy"))
    # Rounded, so that where the MAD is 0 the tiny eps divides real differences and not summation noise.
    s = materialize(join_scope(seq, ent, keys).withColumns(
        {c: F.round(c, 9) for c in ("b1_mnll", "b2_score", "b3_entropy")}), "scores")
    long = s.select(*keys, F.inline(F.array(*[F.struct(F.lit(i).alias("m"), F.col(c).alias("x"))
                                              for i, c in enumerate(("b1_mnll", "b2_score", "b3_entropy"))])))
    mm = median_mad(long, [*part, "m"], "x")
    wide = mm.groupBy(*part).agg(*[F.max(F.when(F.col("m") == i, F.struct("med", "mad"))).alias(f"s{i}") for i in range(3)])

    def z(col: str, i: int):
        return (F.col(col) - F.col(f"s{i}.med")) / (1.4826 * (F.col(f"s{i}.mad") + eps))

    zs = join_scope(s, small_side(wide), part).select(*keys, "b1_mnll", "b2_score", "b3_entropy", z("b1_mnll", 0).alias("b1_z"),
                                         z("b2_score", 1).alias("b2_z"), F.abs(z("b3_entropy", 2)).alias("b3_z"))
    return zs.withColumn("b_risk", F.greatest("b1_z", F.lit(0.0)) + F.greatest("b2_z", F.lit(0.0)) + F.col("b3_z"))


def rank_sequences(scores: DataFrame, part: Sequence[str] = PARTITION_KEYS, k: int = 200) -> DataFrame:
    return top_k(scores, part, [F.desc("seq_raw"), F.asc("session_key"), F.asc("user_id")], k)


def top_sequences(scores: DataFrame, k: int = 200, keys: Sequence[str] = SESSION_KEYS) -> DataFrame:
    """The k highest of all partitions together."""
    keys = keys_of(keys, scores)
    return scores.orderBy(F.desc("risk_score_seq"), F.desc("seq_raw"), *keys).limit(k)


def drill_steps(events: DataFrame, wanted: DataFrame, keys: Sequence[str] = SESSION_KEYS, token: str = "token",
                counts: DataFrame | None = None, part: Sequence[str] = PARTITION_KEYS) -> DataFrame:
    """Events of the wanted sessions with the token before and after, and how common the step is."""
    keys = keys_of(keys, events, wanted)
    rows = events.join(wanted.select(*keys), list(keys), "left_semi")
    out = neighbours(rows, keys, "seq_no", ahead={"next_token": (token, 1)}, behind={"prev_token": (token, 1)})
    if counts is None:
        return out
    c = counts.select(*part, F.col("a").alias(token), F.col("b").alias("next_token"), F.col("c_ab").alias("transition_count"))
    return out.join(c, [*part, token, "next_token"], "left")


def drill_ngrams(grams: DataFrame, wanted: DataFrame, keys: Sequence[str] = SESSION_KEYS,
                 part: Sequence[str] = PARTITION_KEYS, k: int = 10) -> DataFrame:
    """The k rarest n-grams of each wanted session: size, tokens, count, surprise."""
    keys = keys_of(keys, grams, wanted)
    scored = score_ngrams(grams, keys, part).join(wanted.select(*keys), list(keys), "left_semi")
    rows = scored.select(*keys, "n", F.concat_ws("|", "t1", "t2", "t3").alias("ngram"), "c", (-F.col("lp")).alias("nll"))
    return top_k(rows, keys, [F.desc("nll"), F.asc("n"), F.asc("ngram")], k, "rarity_rank")


def top_values(events: DataFrame, keys: Sequence[str], col: str, k: int, out: str) -> DataFrame:
    """`value(count)` of the k most frequent values of each session, ties by value."""
    counts = events.where(F.col(col).isNotNull()).groupBy(*keys, F.col(col).alias("_v")).agg(F.count("*").alias("_c"))
    best = top_k(counts, keys, [F.desc("_c"), F.asc("_v")], k, "_r")
    cell = F.struct("_r", F.concat("_v", F.lit("("), F.col("_c").cast("string"), F.lit(")")).alias("s"))
    return best.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(cell)), lambda x: x.s), ", ").alias(out))


def drill_entropy(events: DataFrame, scores: DataFrame, wanted: DataFrame, keys: Sequence[str] = SESSION_KEYS,
                  token: str = "token", k: int = 10) -> DataFrame:
    """Most frequent tokens and entropy values of the wanted sessions."""
    keys = keys_of(keys, events, scores, wanted)
    rows = events.join(wanted.select(*keys), list(keys), "left_semi")
    return top_values(rows, keys, token, k, "top_tokens").join(
        scores.select(*keys, "entropy_session", "entropy_median_partition"), list(keys))


REASONS = {"b1": "TRANSITIONS", "b2": "NGRAMS", "b3": "ENTROPY"}


def sequence_summary(scores: DataFrame, model: str, k: int = 200, keys: Sequence[str] = SESSION_KEYS,
                     part: Sequence[str] = PARTITION_KEYS, events: DataFrame | None = None, window_s: int = 30) -> DataFrame:
    """Ranked sessions of every partition with model type and reason; with `events` also `timeline_1line` of the ranked sessions."""
    keys = keys_of(keys, scores)
    risk, what = F.col("risk_score_seq"), REASONS[model]
    reason = F.when(risk >= 100, f"RARE_{what}").when(risk > 0, f"UNUSUAL_{what}").otherwise("TYPICAL")
    top = rank_sequences(scores, part, k).select(
        *keys, "rank", "seq_raw", "risk_score_seq", "n_events", F.lit(model.upper()).alias("model_type"),
        reason.alias("primary_reason_code"))
    if events is None:
        return top
    top = materialize(top, "ranked")
    return top.join(drilldown(events, top, keys, window_s).select(*keys, "timeline_1line"), list(keys), "left")
