"""From session features and events to the ranked, explained summary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import drilldown as D
from ..operators.explain import why_top
from ..operators.forest import rank_by_forest
from ..operators.risk import with_ranked_tags
from ..profiles import IMPL, Profile
from ..schema import SESSION_KEYS
from ..staging import materialize

# The columns of the summary that its readers look for.
SUMMARY = ("risk_pct", "risk_score", "anomaly_score", *SESSION_KEYS, "n_events", "duration_s", "n_events_dd", "n_tokens_dd",
           "n_outcomes_dd", "error_rate_dd", "rate_limited_rate_dd", "burst_score", "route_skew_pct", "max_events_in_30s",
           "p50_gap_s", "p95_gap_s", "dt_bucket_top3", "route_group_top3", "outcome_top3", "token_top3", "top_error_route",
           "risk_tags", "timeline_1line", "why_ranked")


def score_features(features: DataFrame, scope: Sequence[str] = ("day",), profile: Profile = IMPL,
                   keys: Sequence[str] = SESSION_KEYS) -> DataFrame:
    return rank_by_forest(features, scope, keys, profile)


def highest(scored: DataFrame, k: int, keys: Sequence[str] = SESSION_KEYS) -> DataFrame:
    return scored.orderBy(F.desc("risk_pct"), F.desc("risk_score"), *keys).limit(k)


def summarize(scored: DataFrame, events: DataFrame, k: int = IMPL.top_k, scope: Sequence[str] = ("day",), window_s: int = 30,
              profile: Profile = IMPL, keys: Sequence[str] = SESSION_KEYS) -> tuple[DataFrame, DataFrame]:
    """(summary, drilldown) of the k sessions at the top; details are computed for those sessions only."""
    scored = materialize(scored, "scored")
    top = materialize(highest(scored, k, keys), "top")
    top = why_top(top, scope, profile.features, stats_of=scored)
    dd = D.drilldown(events, top, keys, window_s)
    summary = with_ranked_tags(D.with_details(top, dd, keys), profile).select(*SUMMARY)
    return summary, dd.join(top.select(*keys, "risk_pct", "risk_score"), list(keys), "left")
