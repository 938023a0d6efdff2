"""Plain SQL over the given tables for the shared inputs of the oracles."""

from __future__ import annotations

from .fixtures import END, GAP_MINUTES, START

RAW = f"""
raw AS (
  SELECT event_id, ts, user_id, event_type, value, props,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k
  FROM events
  WHERE ts >= TIMESTAMP '{START}' AND ts < TIMESTAMP '{END}'
),
named AS (
  SELECT *, CAST(event_id AS VARCHAR) AS observation_id,
    CASE WHEN user_id % 29 = 0 THEN '' ELSE 'client_' || (user_id % 4) END AS t_client,
    CASE WHEN k % 10 = 0 THEN 's' || user_id || '_' || CAST(floor((day(ts) - 1) / 7) AS INTEGER) END AS session_id,
    CASE k % 14 WHEN 0 THEN '/completions' WHEN 1 THEN '/v1/chat/completions' WHEN 2 THEN '/responses'
      WHEN 3 THEN '/v1/embeddings' WHEN 4 THEN '/models' WHEN 5 THEN '/v1/images/generations'
      WHEN 6 THEN '/audio/speech' WHEN 7 THEN '/v1/files' WHEN 8 THEN '/moderations' WHEN 9 THEN '/v1/batches'
      WHEN 10 THEN '/assistants' WHEN 11 THEN '/v1/threads/1' WHEN 12 THEN '/foo' END AS route,
    'litellm-' || CASE WHEN k = 99 THEN 'IGNORE_THIS'
      WHEN event_type = 'error' AND k % 2 = 0 THEN 'internal_error'
      WHEN event_type = 'click' AND value > 60 THEN 'rate_limit_exceed'
      WHEN event_type = 'signup' AND value > 80 THEN 'auth_error'
      WHEN event_type = 'purchase' AND value > 90 THEN 'guardrail_violation'
      WHEN event_type = 'purchase' AND value > 70 THEN 'guardrail_warning'
      WHEN event_type = 'view' AND value < 5 THEN 'bad_request_error'
      WHEN k % 11 = 0 THEN 'models' ELSE 'acompletion' END AS obs_name,
    CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'DEFAULT' END AS level
  FROM raw
),
base AS (
  SELECT observation_id, CAST(user_id AS VARCHAR) AS user_id, session_id, ts AS event_time, obs_name, level, route,
    CASE WHEN k % 17 <> 0 AND t_client <> '' THEN t_client WHEN t_client <> '' THEN t_client
      ELSE 'unknown_client' END AS client_name,
    CASE WHEN route IN ('/completions', '/v1/completions') THEN 'inline'
      WHEN route IN ('/chat/completions', '/v1/chat/completions', '/responses', '/v1/responses') THEN 'chat'
      WHEN route IN ('/embeddings', '/v1/embeddings') THEN 'embeddings'
      WHEN route IN ('/models', '/v1/models') THEN 'models'
      WHEN regexp_matches(route, '^(/v1)?/images') THEN 'images'
      WHEN regexp_matches(route, '^(/v1)?/audio') THEN 'audio'
      WHEN regexp_matches(route, '^(/v1)?/files') THEN 'files'
      WHEN regexp_matches(route, '^(/v1)?/moderations') THEN 'moderations'
      WHEN regexp_matches(route, '^(/v1)?/batches') THEN 'batches'
      WHEN regexp_matches(route, '^(/v1)?/(assistants|threads|runs)') THEN 'assistants'
      ELSE 'other' END AS route_group,
    CASE obs_name WHEN 'litellm-rate_limit_exceed' THEN 'rate_limited' WHEN 'litellm-auth_error' THEN 'auth_fail'
      WHEN 'litellm-guardrail_warning' THEN 'guardrail_warn' WHEN 'litellm-guardrail_violation' THEN 'guardrail_block'
      WHEN 'litellm-internal_error' THEN 'internal_error' WHEN 'litellm-bad_request_error' THEN 'bad_request'
      WHEN 'litellm-IGNORE_THIS' THEN 'error' WHEN 'litellm-models' THEN 'info'
      ELSE CASE WHEN level = 'ERROR' THEN 'error' ELSE 'ok' END END AS outcome_class
  FROM named WHERE k <> 13 AND user_id <> 0
)"""


def sessions(gap: int = GAP_MINUTES, day: str = "strftime(session_start, '%Y-%m-%d')") -> str:
    """CTE list ending in `ev`: the sessionised events."""
    return f"""{RAW},
w0 AS (
  SELECT *, row_number() OVER p AS rn, lag(event_time) OVER p AS prev_any
  FROM base WINDOW p AS (PARTITION BY user_id, client_name, session_id IS NOT NULL, coalesce(session_id, '')
                         ORDER BY event_time, observation_id)
),
w1 AS (
  SELECT *, sum(CASE WHEN rn = 1 THEN 1
                     WHEN session_id IS NULL AND date_diff('minute', prev_any, event_time) >= {gap} THEN 1
                     ELSE 0 END)
    OVER (PARTITION BY user_id, client_name, session_id IS NOT NULL, coalesce(session_id, '')
          ORDER BY event_time, observation_id ROWS UNBOUNDED PRECEDING) AS no
  FROM w0
),
w2 AS (
  SELECT *, CASE WHEN session_id IS NOT NULL THEN 'sid:' || session_id ELSE 'gap:' || CAST(no AS BIGINT) END AS session_key
  FROM w1
),
w3 AS (
  SELECT *, lag(event_time) OVER s AS prev_time, row_number() OVER s - 1 AS seq_no,
    min(event_time) OVER (PARTITION BY user_id, client_name, session_key) AS session_start
  FROM w2 WINDOW s AS (PARTITION BY user_id, client_name, session_key ORDER BY event_time, observation_id)
),
w4 AS (
  SELECT *, {day} AS day, date_diff('millisecond', prev_time, event_time) AS dt_ms FROM w3
),
w5 AS (
  SELECT *, CASE WHEN dt_ms IS NULL THEN 't_start' WHEN dt_ms < 200 THEN 't_fast' WHEN dt_ms < 2000 THEN 't_norm'
                 WHEN dt_ms < 30000 THEN 't_slow' ELSE 't_idle' END AS dt_bucket
  FROM w4
),
ev AS (
  SELECT *, 'client=' || client_name || '|op=' || route_group || '|out=' || outcome_class || '|dt=' || dt_bucket AS token
  FROM w5
)"""


SESSIONS = sessions()
WEEKLY = sessions(day="strftime(date_trunc('week', session_start), '%Y-%m-%d')")
KEYS = "client_name, day, user_id, session_key"
