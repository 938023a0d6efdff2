"""The specified explanation artifacts: one summary row per ranked session, and its details with the timeline in chunks."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import drilldown as D
from ..operators import risk as R
from ..operators.stats import feature_stats, scale_0_100, top_k, with_stats
from ..profiles import SPEC, Profile
from ..schema import ARRAY_COLUMNS, SESSION_KEYS, SPEC_FEATURES
from ..sources.writers import fingerprint
from ..staging import join_scope, materialize, small_side

CHUNK_EVENTS = 50_000
ORDERING = "event_time ASC, observation_id ASC"

# Fixed values of the run record that readers look for.
SPEC_VERSION = "1.0.1"
REVISION = "revised-2026-02-20-frozen-2026-02-20"
TIE_BREAKERS = "ORDER BY if_raw DESC, risk_score_v2 DESC, n_events DESC, session_id_norm ASC"


def rules_hash(profile: Profile = SPEC) -> str:
    """Changes whenever a tag's condition or observed value does: the rules are hashed as the expressions they are."""
    told = [f"{tag}|{cond}|{value}" for tag, (cond, value) in sorted(R.tag_rules(profile).items())]
    return hashlib.sha256("\n".join(told).encode()).hexdigest()[:16]


def run_record(inputs: DataFrame, scope: Sequence[str], written: Mapping[str, DataFrame], keys: Sequence[str] = SESSION_KEYS, profile: Profile = SPEC,
               guard_days: int = 7, feature_version: str = "1.0.0", code_sha: str = "", masking: str = "uuid, hex and number parts of routes") -> DataFrame:
    """The mandatory record of one run. `inputs` are fingerprinted; `written` are tables, of which the rows are counted."""
    spark = inputs.sparkSession
    params = {"trees": profile.trees, "sample": profile.sample, "seed": profile.seed, "features": list(profile.features)}
    row = {
        "spec_version": SPEC_VERSION, "revision": REVISION, "feature_version": feature_version, "if_params": json.dumps(params, sort_keys=True), "model_scope": ",".join(scope),
        "code_sha": code_sha, "masking_policy": masking, "outcome_parsing_policy": "exact names first, then http:429, other http:4xx and 5xx, level:error, else ok",
        "time_window_guard": f"{guard_days} days", "epoch_sentinel_policy": "a time in 1970 makes its session TIME_UNRELIABLE",
        "feature_hygiene": "missing and NaN 0, +Inf the largest finite value, -Inf 0", "risk_tag_rules_hash": rules_hash(profile), "topk_k": profile.top_k,
        "partition_keys": ",".join(scope), "session_keys": ",".join(keys), "ranking_tiebreakers": TIE_BREAKERS}
    made = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in row.items()))
    counts = [df.agg(F.struct(F.lit(name).alias("table"), F.count("*").alias("rows")).alias("c")) for name, df in written.items()]
    listed = reduce(DataFrame.unionByName, counts).agg(F.map_from_entries(F.array_sort(F.collect_list("c"))).alias("rows_written"))
    data = fingerprint(inputs).select(F.concat_ws(":", "rows", "xor_hash", "sum_hash", "schema_hash").alias("data_fingerprint"), F.col("rows").alias("input_rows"))
    # One row each.
    return made.crossJoin(F.broadcast(data)).crossJoin(F.broadcast(listed)).withColumn("generated_at", F.current_timestamp())


def explode_meta(packed: DataFrame, keys: Sequence[str] = SESSION_KEYS, arrays: Sequence[str] = ARRAY_COLUMNS) -> DataFrame:
    """Per session of packed rows: how long each array is over all chunks, how many aligned places there are, what is cut off."""
    arrays = [c for c in arrays if c in packed.columns]
    sizes = {c: F.coalesce(F.size(c), F.lit(0)) for c in arrays}
    shortest = F.array_min(F.array(*sizes.values()))
    per = packed.groupBy(*keys).agg(F.sum(shortest).alias("_min"), *(F.sum(n).alias(f"_n_{c}") for c, n in sizes.items()))

    def named(of) -> Column:
        return F.create_map(*[x for c in arrays for x in (F.lit(c), of(F.col(f"_n_{c}")))])
    return per.select(*keys, F.struct(named(lambda n: n).alias("original_lengths"), F.col("_min").alias("min_len"),
                                      named(lambda n: n - F.col("_min")).alias("truncated_counts"), F.lit(ORDERING).alias("ordering_key")).alias("explode_meta"))


def why_ranked() -> Column:
    """The reason, then every rule that was met with the value it saw."""
    hits = F.array_join(F.transform("threshold_hits", lambda h: F.concat(h.tag, F.lit("="), C.fixed(h.value))), ", ")
    return F.concat("primary_reason_code", F.lit(": "), F.when(F.size("threshold_hits") > 0, hits).otherwise(F.lit("no rule")))


def spec_summary(scored: DataFrame, events: DataFrame, metas: DataFrame, scope: Sequence[str], keys: Sequence[str] = SESSION_KEYS, profile: Profile = SPEC) -> DataFrame:
    """The first `top_k` sessions of each scope with identity, rank, scores, features, tags, reason, timeline and `explode_meta`.

    `scored` are rule rows (features, tags, labels) with `if_raw`. Routes and metas are looked up for the ranked sessions only.
    """
    scaled = scale_0_100(scored, scope, "if_raw", "risk_score_if", *SPEC.scale, flat=profile.flat)
    order = [F.desc("if_raw"), F.desc(F.round("risk_score_v2", 9)), *(F.asc(k) for k in ("session_key", "user_id") if k in keys), *(F.asc(k) for k in keys)]
    top = materialize(top_k(scaled, scope, order, profile.top_k), "ranked")
    few = small_side(top.select(*keys))
    top = join_scope(top, R.top_routes(join_scope(events, few, keys, "left_semi"), keys), keys, "left")
    top = join_scope(top, join_scope(metas, few, keys, "left_semi"), keys, "left")
    return top.withColumns({"timeline_1line": R.rule_timeline(), "why_ranked": why_ranked()}).select(
        *dict.fromkeys([*scope, *keys]), "rank", "if_raw", "risk_score_v2", "risk_score_if", *SPEC_FEATURES, "risk_tags", "primary_reason_code",
        "why_ranked", "timeline_1line", "explode_meta", "threshold_hits", R.component_breakdown().alias("component_breakdown"))


def spec_drilldown(summary: DataFrame, scored: DataFrame, events: DataFrame, scope: Sequence[str], keys: Sequence[str] = SESSION_KEYS, chunk_events: int = CHUNK_EVENTS) -> DataFrame:
    """(keys, chunk) of every ranked session: `timeline`, an array of at most `chunk_events` of {t, route_group, outcome, token}.

    Chunk 0 also holds the session's scores, hits, deviations and histograms; later chunks hold the timeline alone, so
    no row grows with the session.
    """
    summary = materialize(summary, "summary")
    few = small_side(summary.select(*keys))
    mine = materialize(join_scope(events, few, keys, "left_semi").select(*keys, "seq_no", "event_time", "route_group", "outcome", "token"), "ranked-events")
    cell = F.struct("seq_no", F.struct(F.col("event_time").alias("t"), "route_group", "outcome", "token").alias("e"))
    lines = mine.groupBy(*keys, ((F.col("seq_no") - F.col("seq_no") % chunk_events) / chunk_events).cast("long").alias("chunk")).agg(
        F.transform(F.array_sort(F.collect_list(cell)), lambda x: x.e).alias("timeline"))
    stats = feature_stats(scored, scope, SPEC_FEATURES)
    wide = with_stats(summary, scope, stats, ("med", "mad"))

    def deviation(f: str) -> Column:
        s, x = F.col("_stats")[f], F.col(f).cast("double")
        return F.struct(F.lit(f).alias("feature"), x.alias("value"), s["med"].alias("med"), s["mad"].alias("mad"), ((x - s["med"]) / F.nullif(s["mad"], F.lit(0.0))).alias("z"))
    first = wide.withColumn("top_feature_deviation", F.array(*map(deviation, SPEC_FEATURES))).drop("_stats")
    for col, out in (("route_group", "route_histogram"), ("outcome", "outcome_histogram")):
        first = join_scope(first, D.histogram(mine, keys, col, out), keys, "left")
    first = first.withColumn("chunk", F.lit(0).cast("long"))
    return join_scope(lines, first, [*keys, "chunk"], "left")
