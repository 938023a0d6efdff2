"""Column expressions: normalisers, classifiers, buckets and text formats. All stay JVM-side."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------------------------
# Fixed values. Metadata keys, route paths, outcome names and bucket limits must equal those of the
# logs being read, else the classes come out different.

META_USER = ("user_api_key_user_id", "user_api_key_end_user_id")
META_CLIENT = "aap_log_name"
META_ROUTE = "user_api_key_request_route"
UNKNOWN_CLIENT = "unknown_client"
UNKNOWN_USER = "UNKNOWN_USER"
UNKNOWN_ROUTE = "UNKNOWN_ROUTE"

# Paths are given without their optional /v1 prefix.
ROUTES_EXACT = {
    "inline": ["/completions"],
    "chat": ["/chat/completions", "/responses"],
    "embeddings": ["/embeddings"],
    "models": ["/models"],
}
ROUTES_PREFIX = {
    "images": ["/images"],
    "audio": ["/audio"],
    "files": ["/files"],
    "moderations": ["/moderations"],
    "batches": ["/batches"],
    "assistants": ["/assistants", "/threads", "/runs"],
}

OUTCOMES_BY_NAME = {
    "rate_limited": ["litellm-rate_limit_exceed"],
    "auth_fail": ["litellm-auth_error"],
    "guardrail_warn": ["litellm-guardrail_warning"],
    "guardrail_block": ["litellm-guardrail_violation"],
    "internal_error": ["litellm-internal_error"],
    "bad_request": ["litellm-bad_request_error"],
    "error": ["litellm-IGNORE_THIS"],
    "info": ["litellm-models", "litellm-/v1/models", "litellm-/models", "litellm-info"],
}

NORMAL_OUTCOMES = ["ok", "error", "rate_limited", "timeout", "canceled"]
ERROR_PATTERN = "(?i)fail|error|deny|blocked|429|5xx"
RATE_LIMIT_PATTERN = "(?i)rate_limited|429"

# (label, upper limit in ms, exclusive); the last label is open.
DT_LIMITS = [("t_fast", 200), ("t_norm", 2000), ("t_slow", 30000)]
DT_FIRST, DT_LAST = "t_start", "t_idle"
# (label, upper limit in seconds, exclusive)
GAP_LIMITS = [("<0.2s", 0.2), ("0.2-1s", 1.0), ("1-5s", 5.0), ("5-30s", 30.0), ("30-120s", 120.0), ("2-10m", 600.0)]
GAP_LAST = ">10m"
NA = "<NA>"
# ---------------------------------------------------------------------------------------------


def first_filled(*cols: Column) -> Column:
    """First value that is neither null nor the empty string."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


def first_nonblank(*cols: Column) -> Column:
    """As `first_filled`, but text of white space only is missing as well; the value is kept as it is."""
    return F.coalesce(*[F.when(F.trim(c) != "", c) for c in cols])


def user_id(user: Column, metadata: Column) -> Column:
    return first_filled(user, *[metadata[k] for k in META_USER])


def user_id_or_unknown(user: Column, metadata: Column) -> Column:
    return F.coalesce(first_nonblank(user, *[metadata[k] for k in META_USER]), F.lit(UNKNOWN_USER))


def session_id_or_trace(session: Column, trace_id: Column) -> Column:
    return F.coalesce(first_nonblank(session), F.concat(F.lit("trace:"), trace_id))


def client_name(observed: Column, traced: Column) -> Column:
    """Client of the observation, else of the trace; the word for 'unknown' counts as missing."""
    seen = F.nullif(F.nullif(observed, F.lit("")), F.lit(UNKNOWN_CLIENT))
    return F.coalesce(seen, F.nullif(traced, F.lit("")), F.lit(UNKNOWN_CLIENT))


def route(observed: Column, traced: Column) -> Column:
    return first_filled(observed, traced)


def route_or_name(traced: Column, name: Column) -> Column:
    return F.coalesce(first_nonblank(traced), first_nonblank(name), F.lit(UNKNOWN_ROUTE))


def _cases(pairs: Sequence[tuple[Column, Column]], default: Column) -> Column:
    (cond, value), *rest = pairs
    return reduce(lambda acc, cv: acc.when(*cv), rest, F.when(cond, value)).otherwise(default)


def route_group(path: Column) -> Column:
    bare = F.regexp_replace(path, "^/v1(?=/)", "")
    rules = [(bare.isin(paths), F.lit(g)) for g, paths in ROUTES_EXACT.items()]
    for group, paths in ROUTES_PREFIX.items():
        rules.append((reduce(Column.__or__, [bare.startswith(p) for p in paths]), F.lit(group)))
    return _cases(rules, F.lit("other"))


def outcome_class(name: Column, level: Column) -> Column:
    rules = [(name.isin(names), F.lit(cls)) for cls, names in OUTCOMES_BY_NAME.items()]
    return _cases(rules + [(level == "ERROR", F.lit("error"))], F.lit("ok"))


def micros_bucket(ts: Column, width_us: int) -> Column:
    """Number of the fixed-width slot that holds `ts`; slots are aligned to the epoch."""
    us = F.unix_micros(ts)
    return ((us - F.pmod(us, F.lit(width_us))) / F.lit(width_us)).cast("long")


def boundaries(start: Column, end: Column, unit_us: int) -> Column:
    """Number of unit boundaries crossed from `start` to `end` (not whole units elapsed)."""
    return micros_bucket(end, unit_us) - micros_bucket(start, unit_us)


def elapsed_s(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(1e6)


def dt_bucket(dt_ms: Column) -> Column:
    return _cases([(dt_ms.isNull(), F.lit(DT_FIRST))] + [(dt_ms < hi, F.lit(b)) for b, hi in DT_LIMITS], F.lit(DT_LAST))


def gap_label(seconds: Column) -> Column:
    return _cases([(seconds.isNull(), F.lit(NA))] + [(seconds < hi, F.lit(b)) for b, hi in GAP_LIMITS], F.lit(GAP_LAST))


def event_token(client: Column, op: Column, out: Column, dt: Column) -> Column:
    """Null as soon as one part is null."""
    return F.concat(F.lit("client="), client, F.lit("|op="), op, F.lit("|out="), out, F.lit("|dt="), dt)


def short_token(route_grp: Column, outcome: Column) -> Column:
    return F.concat(route_grp, F.lit(":"), outcome)


def token_field(token: Column, name: str) -> Column:
    """`op`, `out` or `dt` of a complete token; `<NA>` when the token has another shape."""
    shape = r"(?:^|\|)client=[^|]+\|op=([^|]+)\|out=([^|]+)\|dt=([^|]+)(?:$|\|)"
    group = {"op": 1, "out": 2, "dt": 3}[name]
    found = F.trim(F.regexp_extract(F.coalesce(token, F.lit("")), shape, group))
    return F.when(found == "", F.lit(NA)).otherwise(found)


def repair(col: Column, fixes: Mapping[str, str]) -> Column:
    trimmed = F.trim(col)
    if not fixes:
        return trimmed
    return _cases([(trimmed == bad, F.lit(good)) for bad, good in fixes.items()], trimmed)


def parse_outcome(raw: Column) -> Column:
    """Outcome of a raw signal; parts are separated by `|` and the strongest rule over all parts wins."""
    parts = F.transform(F.split(F.lower(F.coalesce(raw, F.lit(""))), r"\|"), lambda p: F.trim(p))
    known = F.filter(parts, lambda p: p.isin(NORMAL_OUTCOMES))
    status = F.transform(parts, lambda p: F.nullif(F.regexp_extract(p, r"^http:(\d{3})$", 1), F.lit("")).cast("int"))
    return (F.when(F.size(known) > 0, F.try_element_at(known, F.lit(1)))
            .when(F.array_contains(status, 429), F.lit("rate_limited"))
            .when(F.coalesce(F.exists(status, lambda s: s.between(400, 599)), F.lit(False)), F.lit("error"))
            .when(F.array_contains(parts, "level:error"), F.lit("error"))
            .otherwise(F.lit("ok")))


def mask_route(path: Column) -> Column:
    """Replace ids inside a path, longest form first."""
    out = F.regexp_replace(path, r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", ":uuid")
    out = F.regexp_replace(out, r"\b[0-9a-fA-F]{8,}\b", ":hex")
    return F.regexp_replace(out, r"\b\d+\b", ":num")


def parse_list(text: Column) -> Column:
    """Text to array: JSON list, comma list, or one value; blank is an empty array."""
    s = F.trim(text)
    comma = F.filter(F.transform(F.split(s, ","), lambda t: F.trim(t)), lambda t: t != "")
    as_json = F.from_json(s, "array<string>")
    return (F.when(s.isNull() | (s == ""), F.array().cast("array<string>"))
            .when(s.contains(",") & ~s.contains("[") & ~s.contains("{"), comma)
            .when(s.startswith("[") & s.endswith("]") & as_json.isNotNull(), as_json)
            .otherwise(F.array(s)))


def parse_times(values: Column) -> Column:
    """Array of text to array of timestamps; what is no time becomes null and keeps its place."""
    return F.transform(values, lambda v: F.try_to_timestamp(v))


def epoch_seconds(value: Column) -> Column:
    """Seconds since the epoch from a number in seconds or milliseconds, or from ISO text."""
    number = value.try_cast("double")
    iso = F.try_to_timestamp(F.regexp_replace(F.trim(value.cast("string")), "Z$", "+00:00"))
    return F.when(number.isNotNull(), F.when(number > 1e10, number / 1000.0).otherwise(number)) \
        .otherwise(F.unix_micros(iso) / 1e6)


def times_valid(times: Column, start: Column, end: Column, guard_days: int = 7) -> Column:
    """All times present, inside the run window widened by the guard, and none in 1970."""
    guard = F.make_dt_interval(F.lit(guard_days))
    ok = F.forall(times, lambda t: t.isNotNull() & (t >= start - guard) & (t <= end + guard) & (F.year(t) != 1970))
    return F.coalesce((F.size(times) > 0) & ok, F.lit(False))


def local_day(ts: Column, tz: str) -> Column:
    return F.date_format(F.from_utc_timestamp(ts, tz), "yyyy-MM-dd")


def ratio(num: Column, den: Column) -> Column:
    return num / F.nullif(den, F.lit(0))


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def clip01(x: Column) -> Column:
    return clip(x, 0.0, 1.0)


def fixed(x: Column, places: int = 2) -> Column:
    """`%.<places>f`: ties to even on the exact binary value, no thousands separator."""
    pattern = "0." + "0" * places if places else "0"
    return F.call_function("format_number", x.cast("double"), F.lit(pattern))


def signed(x: Column, places: int = 2) -> Column:
    text = fixed(x, places)
    return F.when(text.startswith("-"), text).otherwise(F.concat(F.lit("+"), text))


def percent(x: Column) -> Column:
    return F.concat(fixed(x * 100.0, 0), F.lit("%"))


def stable_bucket(text: Column, buckets: int = 100) -> Column:
    """Deterministic 0..buckets-1 from the first 52 bits of md5, equal on every engine."""
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long"), F.lit(buckets)).cast("int")


def blake_bucket(text: Column, buckets: int = 100) -> Column:
    """As `stable_bucket` with blake2b-64, for splits that must agree with ones made earlier that way."""
    @F.pandas_udf("int")
    def bucket(s: pd.Series) -> pd.Series:
        return s.map(lambda v: int.from_bytes(hashlib.blake2b(v.encode(), digest_size=8).digest(), "big") % buckets)

    return bucket(text)


def split_name(bucket: Column) -> Column:
    return F.when(bucket < 90, "train").when(bucket < 95, "val").otherwise("test")


def error_like(outcome: Column) -> Column:
    return outcome.rlike(ERROR_PATTERN)


def rate_limit_like(outcome: Column) -> Column:
    return outcome.rlike(RATE_LIMIT_PATTERN)
