"""DuckDB SQL with the same results as the registered queries.

``_CTES`` holds the shared tables of ``catalog/derived.py`` in SQL; a query
names the ones it needs and gets their definitions prepended.
"""

from __future__ import annotations

import re

_R = 6


def _r(*names: str) -> str:
    return ", ".join(f"round({n}, {_R}) AS {n.split('.')[-1]}" for n in names)


_PARTS = {
    # name: message opening, (label, expression) twice, z shown or NULL
    "z_score": (" anomalous on ", ("observed", "observed"), ("baseline_mean", "baseline_mean"), True),
    "ewma": (" EWMA signal on ", ("observed", "observed"), ("ewma", "ewma"), True),
    "change_point": (" change-point on ", ("prev_mean", "previous_mean"), ("recent_mean", "recent_mean"), False),
    "seasonal_decomposition": (
        " seasonal deviation on ", ("observed", "observed"), ("seasonal_mean", "seasonal_mean"), False,
    ),
    "regime_shift": (" regime shift on ", ("prior_mean", "prior_mean"), ("recent_mean", "recent_mean"), False),
}


def _message(method: str) -> str:
    opening, (label1, field1), (label2, field2), shows_z = _PARTS[method]
    text = (
        f"metric_name || '{opening}' || metric_date::VARCHAR || ': {label1}=' || printf('%.4g', {field1})"
        f" || ', {label2}=' || printf('%.4g', {field2})"
    )
    return text + (" || ', z=' || printf('%.2f', z)" if shows_z else "")


_CONTEXT = [
    "observed", "baseline_mean", "baseline_std", "z_score", "ewma", "ewma_z", "previous_mean",
    "recent_mean", "change_point_z", "seasonal_mean", "seasonal_std", "seasonal_z", "prior_mean",
    "mean_z", "prior_var", "recent_var", "var_ratio",
]


def _detector(method: str, level: str, fires: str, fields: dict[str, str], source: str, version: str) -> str:
    """One detector over its scored rows ``source`` (columns as in feats plus ``z``)."""
    shown = ", ".join(
        f"{fields.get(c, 'observed' if c == 'observed' else 'NULL::DOUBLE')} AS {c}" for c in _CONTEXT
    )
    days = "n_baseline" if method == "z_score" else "NULL::BIGINT"
    window = fields.get("window", "NULL::BIGINT")
    return f"""
SELECT metric_name, metric_date, '{method}' AS method, z, {level} AS level, persistence, {version} AS rule_version,
  {shown}, {days} AS baseline_window_days, {window} AS "window"
FROM {source} WHERE n_lookback >= 6 AND n_baseline >= 5 AND ({fires})"""


def _suite(lam: str, limit: str, w: str, cp_z: str, sea_n: str, sea_z: str, re_n: str, re_b: str,
           re_z: str, ratio: str, version: str, feats: str) -> str:
    """All five detectors; arguments are SQL expressions."""
    return " UNION ALL ".join([
        _detector(
            "z_score", "baseline_mean", "abs(z) >= 3",
            {"baseline_mean": "baseline_mean", "baseline_std": "baseline_std", "z_score": "z"},
            f"""(SELECT *, CASE WHEN baseline_std > 1e-9
                 THEN (observed - baseline_mean) / baseline_std ELSE 0 END AS z FROM {feats})""", version,
        ),
        _detector(
            "ewma", "baseline_mean", f"abs(z) >= {limit}",
            {"ewma": "ewma", "baseline_mean": "baseline_mean", "baseline_std": "baseline_std", "ewma_z": "z"},
            f"""(SELECT *, (ewma - baseline_mean) / nullif(baseline_std * sqrt({lam} / (2 - {lam})), 0) AS z
                 FROM {feats})""", version,
        ),
        _detector(
            "change_point", "baseline_mean", f"n_lookback >= 2 * {w} AND abs(z) >= {cp_z}",
            {"previous_mean": "cp_previous_mean", "recent_mean": "cp_recent_mean", "change_point_z": "z",
             "window": f"({w})::BIGINT"},
            f"""(SELECT *, (cp_recent_mean - cp_previous_mean)
                 / nullif(sqrt((cp_recent_var + cp_previous_var) / 2) * sqrt(2.0 / {w}), 0) AS z FROM {feats})""",
            version,
        ),
        _detector(
            "seasonal_decomposition", "seasonal_mean", f"n_seasonal >= {sea_n} AND abs(z) >= {sea_z}",
            {"seasonal_mean": "seasonal_mean", "seasonal_std": "seasonal_std", "seasonal_z": "z"},
            f"(SELECT *, (observed - seasonal_mean) / nullif(seasonal_std, 0) AS z FROM {feats})", version,
        ),
        _detector(
            "regime_shift", "regime_prior_mean",
            f"n_lookback >= {re_n} + {re_b} AND NOT (abs(z) < {re_z} AND ratio < {ratio} AND ratio > 1.0 / {ratio})",
            {"prior_mean": "regime_prior_mean", "recent_mean": "regime_recent_mean", "mean_z": "z",
             "prior_var": "regime_prior_var", "recent_var": "regime_recent_var", "var_ratio": "ratio"},
            f"""(SELECT *, CASE WHEN regime_prior_var > 0 THEN (regime_recent_mean - regime_prior_mean)
                 / (sqrt(regime_prior_var) / sqrt({re_n}.0)) ELSE 0 END AS z,
                 CASE WHEN regime_prior_var > 0 THEN regime_recent_var / regime_prior_var
                 ELSE 'inf'::DOUBLE END AS ratio FROM {feats})""", version,
        ),
    ])


def _scored(found: str) -> str:
    messages = " ".join(f"WHEN '{m}' THEN {_message(m)}" for m in _PARTS)
    return f"""
SELECT *, greatest(0, impact) * confidence * persistence AS risk_score,
  CASE WHEN abs(z) >= 4 THEN 'CRITICAL' WHEN abs(z) >= 3 THEN 'WARN' ELSE 'INFO' END AS severity,
  CASE method {messages} END AS message
FROM (SELECT *, least(1.0, abs(z) / 5) AS confidence,
    CASE metric_name WHEN 'tx_fail_rate' THEN greatest(0, observed - level) * 100
      WHEN 'latency_p95_ms' THEN greatest(0, observed - level) / 100
      WHEN 'tx_completed' THEN greatest(0, (level - observed) / greatest(1, level)) * 10
      ELSE greatest(0, (level - observed) / greatest(1, level)) * 5 END AS impact
  FROM ({found}))"""


def _id(*parts: str) -> str:
    joined = " || '|' || ".join(f"coalesce({p}::VARCHAR, '')" for p in parts)
    return f"('0x' || substr(md5({joined}), 1, 15))::BIGINT"


def _features(
    w: str = "7", recent: str = "7", prior: str = "14", lam: str = "0.3", source: str = "metrics"
) -> str:
    return f"""
SELECT *, CASE WHEN baseline_std > 0 AND abs(CASE WHEN baseline_std > 1e-9
      THEN (previous_value - baseline_mean) / baseline_std ELSE 0 END) > 2 THEN 1.3 ELSE 1.0 END::DOUBLE AS persistence,
  {lam} * observed + (1 - {lam}) * list_reduce(baseline_values, lambda a, b: {lam} * b + (1 - {lam}) * a) AS ewma
FROM (SELECT *, value AS observed,
  count(*) OVER lookback AS n_lookback, count(*) OVER base AS n_baseline,
  avg(value) OVER base AS baseline_mean, stddev_samp(value) OVER base AS baseline_std,
  list(value) OVER base AS baseline_values, max(value) OVER prev AS previous_value,
  avg(value) OVER cp1 AS cp_recent_mean, avg(value) OVER cp0 AS cp_previous_mean,
  var_samp(value) OVER cp1 AS cp_recent_var, var_samp(value) OVER cp0 AS cp_previous_var,
  count(*) OVER wd AS n_seasonal, avg(value) OVER wd AS seasonal_mean, stddev_samp(value) OVER wd AS seasonal_std,
  avg(value) OVER r1 AS regime_recent_mean, avg(value) OVER r0 AS regime_prior_mean,
  var_samp(value) OVER r1 AS regime_recent_var, var_samp(value) OVER r0 AS regime_prior_var
FROM {source} WINDOW
  lookback AS (PARTITION BY metric_name ORDER BY metric_date RANGE BETWEEN INTERVAL 30 DAYS PRECEDING AND CURRENT ROW),
  base AS (PARTITION BY metric_name ORDER BY metric_date
    RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND INTERVAL 1 DAYS PRECEDING),
  prev AS (PARTITION BY metric_name ORDER BY metric_date
    RANGE BETWEEN INTERVAL 1 DAYS PRECEDING AND INTERVAL 1 DAYS PRECEDING),
  wd AS (PARTITION BY metric_name, isodow(metric_date) ORDER BY metric_date
    RANGE BETWEEN INTERVAL 30 DAYS PRECEDING AND INTERVAL 1 DAYS PRECEDING),
  cp1 AS (PARTITION BY metric_name ORDER BY metric_date ROWS BETWEEN {w} - 1 PRECEDING AND CURRENT ROW),
  cp0 AS (PARTITION BY metric_name ORDER BY metric_date ROWS BETWEEN 2 * {w} - 1 PRECEDING AND {w} PRECEDING),
  r1 AS (PARTITION BY metric_name ORDER BY metric_date ROWS BETWEEN {recent} - 1 PRECEDING AND CURRENT ROW),
  r0 AS (PARTITION BY metric_name ORDER BY metric_date
    ROWS BETWEEN {recent} + {prior} - 1 PRECEDING AND {recent} PRECEDING))"""


def _ks(events: str) -> str:
    return f"""
SELECT report_date, name, event_type, n_current, n_baseline, ks_stat, p_value, p_value < 0.05 AS drifted FROM (
SELECT *, greatest(0.0, least(1.0, list_sum(list_transform(range(1, 100),
    lambda k: CASE WHEN k = 1 OR 2 * exp(-2 * lam * lam * (k - 1) * (k - 1)) >= 1e-6
      THEN (CASE WHEN k % 2 = 1 THEN 2.0 ELSE -2.0 END) * exp(-2 * lam * lam * k * k) ELSE 0.0 END)))) AS p_value
FROM (SELECT *, (en + 0.12 + 0.11 / en) * ks_stat AS lam
FROM (SELECT *, sqrt(n_current::DOUBLE * n_baseline / (n_current + n_baseline)) AS en FROM (
SELECT report_date, name, event_type, nc AS n_current, nb AS n_baseline, max(abs(cc / nc - cb / nb)) AS ks_stat FROM (
  SELECT *, sum(cur) OVER (p ORDER BY value) AS cc, sum(base) OVER (p ORDER BY value) AS cb,
    sum(cur) OVER p AS nc, sum(base) OVER p AS nb
  FROM (SELECT report_date, name, event_type, value, count(*) FILTER (WHERE own) AS cur,
      count(*) FILTER (WHERE NOT own) AS base
    FROM (SELECT d.day AS report_date, e.value, e.event_type, e.event_date = d.day AS own,
        CASE e.event_type WHEN 'transaction_completed' THEN 'transaction_value' ELSE 'latency_value' END AS name
      FROM (SELECT DISTINCT event_date AS day FROM {events}) d JOIN {events} e
        ON e.event_date BETWEEN d.day - 7 AND d.day
      WHERE e.event_type IN ('transaction_completed', 'system_latency') AND e.value IS NOT NULL)
    GROUP BY ALL)
  WINDOW p AS (PARTITION BY report_date, name))
GROUP BY ALL HAVING nc >= 20 AND nb >= 20))))"""


def _shares(events: str) -> str:
    return f"""
SELECT *, n / day_total AS share FROM (
  SELECT *, (sum(n) OVER (PARTITION BY event_date))::BIGINT AS day_total FROM (
    SELECT source_system, event_date, count(*) AS n FROM {events} GROUP BY source_system, event_date))"""


def _history(events: str) -> str:
    return f"""
SELECT event_date AS report_date, source_system, share AS current_share, count(share) OVER w AS n_days,
  avg(share) OVER w AS baseline_mean, stddev_samp(share) OVER w AS baseline_std
FROM ({_shares(events)}) WINDOW w AS (PARTITION BY source_system ORDER BY event_date
  RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND INTERVAL 1 DAYS PRECEDING)"""


def _bias(events: str) -> str:
    return f"""
SELECT * FROM (SELECT report_date, source_system, current_share, baseline_mean, baseline_std,
  (current_share - baseline_mean) / baseline_std AS z_score
FROM ({_history(events)}) WHERE n_days >= 3 AND baseline_std > 0) WHERE abs(z_score) >= 2.5"""


def _keys(events: str) -> str:
    return f"""
SELECT event_date, key, count, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY event_date ORDER BY count DESC, key) AS rank FROM (
    SELECT event_date, key, count(*) AS count
    FROM (SELECT event_date, unnest(json_keys(properties)) AS key FROM {events}) GROUP BY event_date, key))
WHERE rank <= 20"""


# Properties with keys for type, source and whole value.
_WIDE = """(SELECT event_date, properties[:-2] || ',"' || event_type || '":1,"' || source_system || '":1,"at_' ||
  coalesce(floor(value)::BIGINT::VARCHAR, 'none') || '":1}' AS properties FROM ev)"""


def _card(events: str, quarantine: str, future: str) -> str:
    """``future``: SQL for the number of future events of report date ``t.report_date``."""
    return f"""
SELECT *, CASE WHEN n_events > 0 THEN greatest(0.0, least(1.0,
    (0.6 * least(1.0, log10(n_events + 1) / 4) + 0.4 * completeness_rate) * greatest(0.0, 1 - quarantine_rate)))
    ELSE 0.0 END AS confidence,
  (n_events > 0 AND duplicate_rate <= 0.01 AND completeness_rate >= 0.99 AND quarantine_rate <= 0.01
    AND future_events = 0 AND n_drifted = 0 AND n_biased = 0) AS pass
FROM (SELECT t.report_date, n_events, duplicate_events, duplicate_events / n_events AS duplicate_rate, missing_total,
    1.0 - missing_total / (n_events * 4) AS completeness_rate, freshness_p50_sec, freshness_p95_sec,
    {future} AS future_events, coalesce(quarantine_total, 0) AS quarantine_total,
    coalesce(malformed_events, 0) AS malformed_events, coalesce(quarantine_total, 0) / n_events AS quarantine_rate,
    coalesce(n_keys, 0) AS n_keys, coalesce(n_checks, 0) AS n_checks, coalesce(n_drifted, 0) AS n_drifted,
    coalesce(n_biased, 0) AS n_biased, coalesce(keys, '') AS keys, coalesce(key_counts, '') AS key_counts,
    coalesce(checks, '') AS checks, coalesce(drifted, '') AS drifted, coalesce(biased, '') AS biased
  FROM (SELECT event_date AS report_date, count(*) AS n_events,
      greatest(0, count(*) - count(DISTINCT event_id)) AS duplicate_events,
      count(*) FILTER (WHERE event_type IS NULL) + count(*) FILTER (WHERE source_system IS NULL) AS missing_total,
      quantile_cont(epoch_us(ts_ingested) / 1e6 - epoch_us(ts_event) / 1e6, 0.5) AS freshness_p50_sec,
      quantile_cont(epoch_us(ts_ingested) / 1e6 - epoch_us(ts_event) / 1e6, 0.95) AS freshness_p95_sec
    FROM {events} GROUP BY 1) t
  LEFT JOIN (SELECT ingest_date AS report_date, count(*) AS quarantine_total,
      count(*) FILTER (WHERE reason <> 'duplicate_event_id') AS malformed_events
    FROM {quarantine} GROUP BY 1) q USING (report_date)
  LEFT JOIN (SELECT event_date AS report_date, count(*) AS n_keys, string_agg(key, ',' ORDER BY rank) AS keys,
      string_agg("count"::VARCHAR, ',' ORDER BY rank) AS key_counts FROM ({_keys(events)}) GROUP BY 1) k
    USING (report_date)
  LEFT JOIN (SELECT report_date, count(*) AS n_checks, count(*) FILTER (WHERE drifted) AS n_drifted,
      string_agg(name, ',' ORDER BY name) AS checks, string_agg(name, ',' ORDER BY name) FILTER (WHERE drifted) AS drifted
    FROM ({_ks(events)}) GROUP BY 1) d USING (report_date)
  LEFT JOIN (SELECT report_date, count(*) AS n_biased, string_agg(source_system, ',' ORDER BY source_system) AS biased
    FROM ({_bias(events)}) GROUP BY 1) b USING (report_date))"""


def _judged(feed: str = "feed", stored: str | None = None, batches: bool = False) -> str:
    """Feed rows with errors and reason."""
    wrong = "(errors <> '')" if not batches else "bool_or(errors <> '') OVER (PARTITION BY batch_id)"
    known = f"OR event_id IN (SELECT event_id FROM {stored})" if stored else ""
    return f"""
SELECT * EXCLUDE (wrong, rn), CASE WHEN wrong THEN 'validation_error'
  WHEN rn > 1 {known} THEN 'duplicate_event_id' ELSE 'ok' END AS reason
FROM (SELECT *, row_number() OVER (PARTITION BY wrong, event_id ORDER BY ts_ingested, batch_id, seq) AS rn
  FROM (SELECT *, {wrong} AS wrong FROM (SELECT *, concat_ws(';',
      CASE WHEN event_type = 'unknown_event' THEN 'event_type:not_allowed' END,
      CASE WHEN measurement_uncertainty < 0 THEN 'measurement_uncertainty:negative' END) AS errors FROM {feed})))"""


_WINDOW = "DATE '2024-01-20' AND DATE '2024-01-29'"

_CTES = {
    "ev": """
SELECT e.event_id AS id_, '00000000-0000-0000-0000-' || lpad(e.event_id::VARCHAR, 12, '0') AS event_id,
  e.ts AS ts_event, e.ts + to_seconds(e.event_id % 900) AS ts_ingested,
  CASE e.event_type WHEN 'purchase' THEN 'transaction_completed' WHEN 'error' THEN 'transaction_failed'
    WHEN 'view' THEN 'system_latency' WHEN 'signup' THEN 'transaction_initiated'
    WHEN 'click' THEN 'user_access' END AS event_type,
  CASE e.user_id % 3 WHEN 0 THEN 'payments' WHEN 1 THEN 'core' ELSE 'web' END AS source_system,
  CASE WHEN e.event_id % 50 <> 0 THEN e.user_id::VARCHAR END AS user_id,
  CASE WHEN e.event_id % 97 <> 0 THEN e.value END AS value,
  CASE WHEN e.event_id % 97 <> 0 THEN e.value END * 0.01 AS measurement_uncertainty,
  CASE WHEN e.event_id % 3 = 0 THEN '{"k":1,"currency":"EUR"}' ELSE e.props END AS properties,
  e.ts::DATE AS event_date
FROM events e""",
    "lake": """
SELECT ev.* REPLACE (CASE WHEN id_ % 71 <> 0 THEN source_system END AS source_system,
  CASE WHEN id_ % 83 <> 0 THEN event_type END AS event_type)
FROM ev, (VALUES (0), (1)) c(copy) WHERE copy = 0 OR id_ % 101 = 0""",
    "feed": """
SELECT id_ // 100 AS batch_id, id_ % 100 + copy * 100 AS seq, event_id, ts_event,
  ts_ingested + to_seconds(copy * 86400) AS ts_ingested,
  CASE WHEN id_ % 83 = 0 THEN 'unknown_event' ELSE event_type END AS event_type, source_system, user_id, value,
  CASE WHEN id_ % 89 = 0 THEN -1.0 ELSE measurement_uncertainty END AS measurement_uncertainty, properties
FROM ev, (VALUES (0), (1)) c(copy) WHERE copy = 0 OR id_ % 101 = 0""",
    "metrics": """
UNPIVOT (SELECT event_date AS metric_date, count(DISTINCT user_id)::DOUBLE AS dau,
    count(*) FILTER (WHERE event_type = 'transaction_completed')::DOUBLE AS tx_completed_count,
    coalesce(sum(value) FILTER (WHERE event_type = 'transaction_completed'), 0)::DOUBLE AS tx_completed_value,
    coalesce(count(*) FILTER (WHERE event_type = 'transaction_failed')
      / nullif(count(*) FILTER (WHERE event_type IN ('transaction_failed', 'transaction_completed')), 0), 0)::DOUBLE
      AS tx_fail_rate,
    quantile_cont(value, 0.95) FILTER (WHERE event_type = 'system_latency') AS latency_p95_ms
  FROM ev GROUP BY 1)
ON dau, tx_completed_count, tx_completed_value, tx_fail_rate, latency_p95_ms
INTO NAME metric_name VALUE value""",
    "feats": _features(),
    "found": _scored(_suite("0.3", "3", "7", "3", "3", "3", "7", "14", "3", "2.0", "'v1'", "feats")),
    "alerts": f"""
SELECT {_id("metric_name", "'{}'", "metric_date", "method", "rule_version")} AS alert_id,
  (metric_date + 1)::TIMESTAMP + INTERVAL 1 HOUR AS ts, 'OPEN' AS status, * FROM found""",
    "actions": """
SELECT alert_id, kind, actor, ts + to_hours(hours) AS action_ts, hours AS seq
FROM alerts, (VALUES ('ACK', 'ops-a', 1, 2, 0), ('RESOLVED', 'ops-b', 2, 4, 0), ('ACK', 'ops-c', 3, 8, 0),
  ('RESOLVED', 'ops-d', 4, 6, 3)) a(kind, actor, hours, every, rest)
WHERE day(metric_date) % every = rest""",
    "state": """
SELECT alert_id, arg_max(kind, seq) AS status,
  coalesce(arg_max(actor, seq) FILTER (WHERE kind = 'ACK'), arg_min(actor, seq) FILTER (WHERE kind = 'RESOLVED'))
    AS acked_by, min(action_ts) AS acked_at,
  arg_max(actor, seq) FILTER (WHERE kind = 'RESOLVED') AS resolved_by,
  min(action_ts) FILTER (WHERE kind = 'RESOLVED') AS resolved_at
FROM actions GROUP BY 1""",
    "acted": """
SELECT a.* REPLACE (coalesce(s.status, 'OPEN') AS status), s.acked_by, s.acked_at, s.resolved_by, s.resolved_at
FROM alerts a LEFT JOIN state s USING (alert_id)""",
    "notes": f"""
SELECT {_id("alert_id", "channel", "target")} AS notification_id, *,
  CASE WHEN status = 'sent' THEN created_at END AS sent_at
FROM (SELECT alert_id, 'webhook' AS channel, 'https://hooks.example/a' AS target,
    CASE day(metric_date) % 3 WHEN 0 THEN 'sent' ELSE 'failed' END AS status, '{{}}' AS payload,
    CASE day(metric_date) % 3 WHEN 1 THEN 'timeout' END AS last_error, ts + INTERVAL 10 MINUTE AS created_at
  FROM alerts WHERE day(metric_date) % 3 < 2)""",
    "judged": _judged(),
    "quarantine": "SELECT *, ts_ingested::DATE AS ingest_date FROM judged WHERE reason <> 'ok'",
    "cards": _card(
        "lake", "quarantine",
        "(SELECT count(*) FROM lake WHERE ts_event > TIMESTAMP '2024-02-01' + INTERVAL 5 MINUTE)",
    ),
    "reports": "SELECT * FROM cards",
    "odd_reports": "SELECT * FROM reports WHERE day(report_date) % 2 = 1",
    "days": "SELECT DISTINCT event_date AS day FROM ev",
    "stability": """
SELECT day, CASE WHEN sum(cv) IS NULL THEN 100.0 ELSE 100 - least(100.0, sum(cv) * 100) END::DOUBLE AS stability_index
FROM days LEFT JOIN (SELECT d.day, metric_name,
    CASE WHEN count(*) >= 2 AND avg(value) <> 0 THEN stddev_samp(value) / abs(avg(value)) END AS cv
  FROM days d JOIN metrics m ON m.metric_date BETWEEN d.day - 6 AND d.day
  WHERE metric_name IN ('tx_fail_rate', 'latency_p95_ms', 'tx_completed_value', 'dau') GROUP BY 1, 2) USING (day)
GROUP BY day""",
    "in_force": """
SELECT day, report_date, pass AS passes, confidence
FROM days ASOF LEFT JOIN odd_reports ON day >= report_date""",
    "arrived": """
SELECT *, (event_date - DATE '2024-01-01' + CASE WHEN id_ % 13 = 0 THEN 9 ELSE 0 END + copy) // 10 AS slot
FROM (SELECT id_, copy, id_ // 100 AS batch_id, id_ % 100 + copy * 100 AS seq, event_id,
  ts_ingested + to_seconds(copy * 86400) AS ts_ingested, event_date, source_system, user_id, value,
  CASE WHEN id_ % 83 = 0 THEN 'unknown_event' ELSE event_type END AS event_type,
  id_ % 83 = 0 OR id_ % 89 = 0 AS wrong
  FROM ev, (VALUES (0), (1)) c(copy) WHERE copy = 0 OR id_ % 101 = 0)""",
    "newest": """
SELECT s.slot, max(a.event_date) FILTER (NOT a.wrong) AS day
FROM (SELECT DISTINCT slot FROM arrived) s JOIN arrived a ON a.slot < s.slot GROUP BY 1""",
    "routed": """
SELECT *, CASE WHEN wrong THEN 'validation_error' WHEN late THEN 'late'
  WHEN row_number() OVER (PARTITION BY event_id, wrong, late ORDER BY slot, ts_ingested, batch_id, seq) > 1
  THEN 'duplicate_event_id' ELSE 'ok' END AS outcome
FROM (SELECT a.*, coalesce(event_date <= n.day - 7, FALSE) AND NOT wrong AS late FROM arrived a LEFT JOIN newest n USING (slot))""",
    "requests": """
SELECT 'POST' AS method, '/ingest/' || event_type AS path, CASE WHEN id_ % 61 = 0 THEN 500 ELSE 200 END AS status,
  coalesce(value, 0.0) AS latency_ms FROM ev""",
    "rules": """
SELECT 'v' || day(event_date) AS rule_version, count(*) AS n, count(value) AS v, event_date
FROM ev GROUP BY event_date""",
    "rule": "SELECT * FROM rules ORDER BY event_date DESC LIMIT 1",
}

_ORDER = list(_CTES)


def _with(body: str) -> str:
    """``body`` with the definitions of every shared table it uses."""
    needed: set[str] = set()
    texts = [body]
    while texts:
        text = texts.pop()
        for name in _ORDER:
            if name not in needed and re.search(rf"\b(FROM|JOIN|,)\s+{name}\b", text):
                needed.add(name)
                texts.append(_CTES[name])
    named = ",\n".join(f"{n} AS ({_CTES[n]})" for n in _ORDER if n in needed)
    return f"WITH {named}\n{body}" if named else body


_DETECTION = (
    f"SELECT metric_name, metric_date, severity, rule_version, {_r('risk_score')}, message, method, "
    + _r(*_CONTEXT, "impact", "confidence", "persistence")
    + ', baseline_window_days, "window" FROM {} WHERE method = \'{}\''
)
_NOTE_COLUMNS = "notification_id, alert_id, channel, target, status"
_RISK = "metric_name AS \"Risk\", severity AS \"Severity\", round(risk_score, 2) AS \"Score\", message AS \"Summary\""
_ALERT_TABLE = (
    "metric_name AS \"Alert\", severity AS \"Severity\", round(risk_score, 2) AS \"Risk\", status AS \"Status\","
    " ts::VARCHAR AS \"Timestamp\""
)
_ANOMALY_TABLE = (
    "metric_name AS \"Metric\", round(impact, 2) AS \"Impact\", method AS \"Method\", ts::VARCHAR AS \"Timestamp\""
)
_NEWEST = "ORDER BY ts DESC, alert_id"
_BOUNDS = "0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0"

# Alerts of a run that knows the KPIs of the window alone.
_RUN = f"""(SELECT *, {_id("metric_name", "'{}'", "metric_date", "method", "rule_version")} AS alert_id
  FROM ({_scored(_suite("0.3", "3", "7", "3", "3", "3", "7", "14", "3", "2.0", "'v1'", "(" + _features(
      source=f"(SELECT * FROM metrics WHERE metric_date BETWEEN {_WINDOW})") + ")"))})
  WHERE metric_name IN ('tx_fail_rate', 'latency_p95_ms', 'tx_completed', 'dau'))"""

_BODIES: dict[str, str] = {
    "kpi_daily_long": f"SELECT metric_date, metric_name, {_r('value')}, '{{}}' AS dimensions FROM metrics",
    "kpi_dau": "SELECT event_date, count(DISTINCT user_id)::DOUBLE AS dau FROM ev GROUP BY 1",
    "kpi_tx_completed": f"""
SELECT event_date, tx_completed_count, {_r('tx_completed_value')} FROM (
  SELECT event_date, count(*) FILTER (WHERE event_type = 'transaction_completed')::DOUBLE AS tx_completed_count,
    coalesce(sum(value) FILTER (WHERE event_type = 'transaction_completed'), 0) AS tx_completed_value
  FROM ev GROUP BY 1)""",
    "kpi_fail_rate": """
SELECT metric_date AS event_date, round(value, 6) AS tx_fail_rate FROM metrics WHERE metric_name = 'tx_fail_rate'""",
    "kpi_latency_p95": """
SELECT event_date, round(quantile_cont(value, 0.95), 6) AS latency_p95_ms FROM ev
WHERE event_type = 'system_latency' AND value IS NOT NULL GROUP BY 1""",
    "kpi_backfill_range": """
SELECT d.day AS metric_date, n.name AS metric_name, round(coalesce(m.value, 0), 6) AS value, '{}' AS dimensions
FROM (SELECT unnest(generate_series(DATE '2023-12-30', DATE '2024-01-10', INTERVAL 1 DAY))::DATE AS day) d
CROSS JOIN (VALUES ('dau'), ('tx_completed_count'), ('tx_completed_value'), ('tx_fail_rate'), ('latency_p95_ms')) n(name)
LEFT JOIN metrics m ON m.metric_date = d.day AND m.metric_name = n.name
WHERE n.name <> 'latency_p95_ms' OR m.value IS NOT NULL""",
    "metrics_upsert_merge": f"""
SELECT metric_date, metric_name, '{{}}' AS dimensions,
  round(CASE WHEN metric_date BETWEEN {_WINDOW} THEN value ELSE value + 1000 END, 6) AS value
FROM metrics WHERE metric_name <> 'tx_completed_count' OR metric_date BETWEEN {_WINDOW}""",
    "metric_series_lookup": f"""
SELECT metric_date::VARCHAR AS metric_date, metric_name, {_r('value')}, '{{}}' AS dimensions FROM metrics
WHERE metric_name = 'dau' AND metric_date BETWEEN {_WINDOW}""",
    "dq_totals": """
SELECT event_date, count(*) AS n_events, greatest(0, count(*) - count(DISTINCT event_id)) AS duplicate_events
FROM lake GROUP BY 1""",
    "dq_missing_required": """
SELECT *, event_id + ts_event + event_type + source_system AS total FROM (SELECT event_date,
  count(*) FILTER (WHERE event_id IS NULL) AS event_id, count(*) FILTER (WHERE ts_event IS NULL) AS ts_event,
  count(*) FILTER (WHERE event_type IS NULL) AS event_type,
  count(*) FILTER (WHERE source_system IS NULL) AS source_system FROM lake GROUP BY 1)""",
    "dq_freshness": """
SELECT event_date, round(quantile_cont((epoch_us(ts_ingested) - epoch_us(ts_event)) / 1e6, 0.5), 6) AS freshness_p50_sec,
  round(quantile_cont((epoch_us(ts_ingested) - epoch_us(ts_event)) / 1e6, 0.95), 6) AS freshness_p95_sec
FROM lake GROUP BY 1""",
    "dq_future_events": """
SELECT count(*) AS future_events FROM lake WHERE ts_event > TIMESTAMP '2024-01-30 12:00:00' + INTERVAL 5 MINUTE""",
    "dq_future_events_by_day": """
SELECT event_date, count(*) FILTER (WHERE ts_event > TIMESTAMP '2024-01-30 12:05:00') AS future_events
FROM lake GROUP BY 1""",
    "dq_quarantine_by_reason": "SELECT ingest_date, reason, count(*) AS n FROM quarantine GROUP BY ALL",
    "dq_quarantine_stats": """
SELECT ingest_date, count(*) AS quarantine_total,
  count(*) FILTER (WHERE reason <> 'duplicate_event_id') AS malformed_events,
  concat_ws(',', 'duplicate_event_id=' || nullif(count(*) FILTER (WHERE reason = 'duplicate_event_id'), 0),
    'validation_error=' || nullif(count(*) FILTER (WHERE reason = 'validation_error'), 0)) AS by_reason
FROM quarantine GROUP BY 1""",
    "dq_top_property_keys": _keys("lake"),
    "dq_heavy_property_keys": _keys(_WIDE),
    "stream_heavy_keys": _keys(_WIDE).replace("rank <= 20", "rank <= 8"),
    "dq_source_shares": f"SELECT * REPLACE (round(share, 6) AS share) FROM ({_shares('lake')})",
    "dq_share_history": f"""
SELECT report_date, source_system, n_days, {_r('current_share', 'baseline_mean', 'baseline_std')}
FROM ({_history('ev')})""",
    "dq_source_bias": f"""
SELECT report_date, source_system, {_r('current_share', 'baseline_mean', 'baseline_std', 'z_score')}
FROM ({_bias('ev')})""",
    "dq_ks_drift": f"""
SELECT report_date, name, event_type, n_current::BIGINT AS n_current, n_baseline::BIGINT AS n_baseline,
  {_r('ks_stat', 'p_value')}, drifted FROM ({_ks('ev')})""",
    "dq_drift_screened": f"""
SELECT report_date, name, event_type, n_current::BIGINT AS n_current, n_baseline::BIGINT AS n_baseline, drifted,
  TRUE AS ks_held FROM ({_ks('ev')})""",
    "stream_drift_screened": f"""
SELECT report_date, name, event_type, n_current::BIGINT AS n_current, n_baseline::BIGINT AS n_baseline, drifted
FROM ({_ks('ev')})""",
    "dq_scorecard": f"""
SELECT * REPLACE ({_r('duplicate_rate', 'completeness_rate', 'freshness_p50_sec', 'freshness_p95_sec',
                       'quarantine_rate', 'confidence')}) FROM cards""",
    "dq_pass_fail": f"""
SELECT report_date, future_events, {_r('confidence')}, pass FROM ({_card(
    'ev', 'quarantine',
    "(SELECT count(*) FROM ev WHERE event_date = t.report_date AND ts_event > TIMESTAMP '2024-01-30 12:05:00')")})""",
    "dq_latest": f"""
SELECT report_date::VARCHAR AS report_date, pass, {_r('confidence')} FROM reports ORDER BY reports.report_date DESC LIMIT 1""",
    "dq_latest_empty": """
SELECT '1970-01-01' AS report_date, FALSE AS pass, '{"note":"no reports yet"}' AS summary
WHERE NOT EXISTS (SELECT 1 FROM reports WHERE report_date > DATE '2024-02-01')""",
    "dq_asof": f"SELECT day, report_date, passes, {_r('confidence')} FROM in_force",
    "dq_summary_text": """
SELECT line, 3::BIGINT AS n_cards, 'pass=' || verdict AS card2 FROM (
  SELECT CASE WHEN pass THEN 'True' ELSE 'False' END AS verdict,
    report_date::VARCHAR || ' | pass=' || CASE WHEN pass THEN 'True' ELSE 'False' END || ' | confidence='
      || printf('%.2f', confidence) AS line
  FROM reports WHERE report_date <= DATE '2024-01-29' ORDER BY report_date DESC LIMIT 1)""",
    "reports_store_rerun": f"""
SELECT report_date, pass, n_events, quarantine_total, {_r('confidence')} FROM cards WHERE report_date BETWEEN {_WINDOW}""",
    "ingest_validate": "SELECT batch_id, seq, event_id, errors, properties FROM judged",
    "ingest_dedupe": "SELECT batch_id, seq, event_id, reason FROM judged",
    "ingest_dedupe_history": f"""
SELECT batch_id, seq, event_id, reason
FROM ({_judged(stored="(SELECT event_id FROM ev WHERE day(event_date) <= 15)")})""",
    "ingest_batch_mode": f"SELECT batch_id, seq, event_id, reason FROM ({_judged(batches=True)})",
    "ingest_accepted": """
SELECT ts_event::DATE AS event_date, event_type, count(*) AS n, round(sum(value), 6) AS value,
  round(sum(measurement_uncertainty), 6) AS uncertainty FROM judged WHERE reason = 'ok' GROUP BY ALL""",
    "ingest_receipt": """
SELECT batch_id, count(*) FILTER (WHERE reason = 'ok') AS accepted, count(*) FILTER (WHERE reason <> 'ok') AS rejected,
  concat_ws(',', 'duplicate_event_id=' || nullif(count(*) FILTER (WHERE reason = 'duplicate_event_id'), 0),
    'validation_error=' || nullif(count(*) FILTER (WHERE reason = 'validation_error'), 0)) AS reasons
FROM judged GROUP BY 1""",
    "ingest_quarantine": "SELECT ingest_date, reason, event_id, event_type FROM quarantine",
    "ingest_audit": """
SELECT 'system' AS actor, 'ingest_events' AS action, 'events_batch' AS entity_type,
  count(*) FILTER (WHERE reason = 'ok') AS accepted, count(*) FILTER (WHERE reason <> 'ok') AS rejected
FROM judged GROUP BY batch_id""",
    "ingest_bodies": f"""
SELECT batch_id, row_number() OVER (PARTITION BY batch_id, delivery ORDER BY seq) - 1 AS seq, event_id, event_type,
  user_id, {_r('value', 'measurement_uncertainty')}, errors, reason
FROM (SELECT *, 1 AS delivery FROM judged UNION ALL
  SELECT * REPLACE (CASE WHEN reason = 'ok' THEN 'duplicate_event_id' ELSE reason END AS reason), 2
  FROM judged WHERE batch_id % 10 = 0)""",
    "ingest_refused_bodies": """
SELECT path, errors, ingest_date, n_events FROM (
  SELECT batch_id, '/ingest/events' AS path, min(ts_ingested)::DATE AS ingest_date, count(*) AS n_events,
    '["' || array_to_string(list_sort(list_distinct(flatten(list(string_split(errors, ';')) FILTER (WHERE errors <> '')))), '","')
      || '"]' AS errors
  FROM judged GROUP BY 1 HAVING bool_or(errors <> ''))
JOIN (VALUES (1), (2)) d(delivery) ON delivery = 1 OR batch_id % 10 = 0""",
    "rules_seed": """
SELECT 'rules of weekday ' || (isodow(event_date) - 1)::VARCHAR AS rule_name, count(DISTINCT event_date) AS n
FROM ev GROUP BY 1 UNION ALL SELECT 'anomaly_rules', 1""",
    "kpi_latency_nonfinite": """
SELECT event_date, quantile_cont(v, 0.95)::VARCHAR = 'nan' AS p95_is_nan,
  round(CASE WHEN quantile_cont(v, 0.95)::VARCHAR <> 'nan' THEN quantile_cont(v, 0.95) END, 6) AS p95,
  round(quantile_cont(v, 0.5), 6) AS p50
FROM (SELECT event_date, CASE WHEN (day(event_date) % 2 = 0 AND id_ % 7 = 0) OR id_ % 45 = 0 THEN 'nan'::DOUBLE ELSE value END AS v
  FROM ev WHERE value IS NOT NULL) GROUP BY 1""",
    "series_features": f"""
SELECT metric_name, metric_date, n_lookback, n_baseline, n_seasonal, {_r(
    'observed', 'baseline_mean', 'baseline_std', 'previous_value', 'persistence', 'cp_recent_mean',
    'cp_previous_mean', 'seasonal_mean', 'seasonal_std', 'regime_recent_mean', 'regime_prior_mean')} FROM feats""",
    "detect_zscore": _DETECTION.format("found", "z_score"),
    "detect_ewma": _DETECTION.format("found", "ewma"),
    "detect_change_point": _DETECTION.format(
        f"""({_scored(_suite("0.3", "3", "7", "1.5", "3", "3", "7", "14", "3", "2.0", "'v1'", "feats"))})""",
        "change_point",
    ),
    "detect_seasonal": _DETECTION.format("found", "seasonal_decomposition"),
    "detect_regime": _DETECTION.format("found", "regime_shift"),
    "detect_all": f"""
SELECT metric_name, metric_date, method, severity, {_r('risk_score', 'impact', 'confidence', 'persistence')}
FROM found""",
    "detect_watched": f"""
SELECT metric_name, metric_date, method, severity, {_r('risk_score')} FROM found
WHERE metric_name IN ('tx_fail_rate', 'latency_p95_ms', 'tx_completed', 'dau')""",
    "rule_config_effective": """
SELECT rule_version, 0.25::DOUBLE AS ewma_lambda, n::DOUBLE AS ewma_limit, (v % 5 + 5)::INTEGER AS change_point_window,
  3.0::DOUBLE AS change_point_z, 3::INTEGER AS seasonal_min_points, 3.0::DOUBLE AS seasonal_z,
  7::INTEGER AS regime_recent_days, 14::INTEGER AS regime_baseline_days, 3.0::DOUBLE AS regime_z,
  v::DOUBLE AS regime_var_ratio FROM rule""",
    "detect_stored_rules": f"""
SELECT metric_name, metric_date, method, severity, rule_version, {_r('risk_score')} FROM ({_scored(_suite(
    "0.25", "n", "w", "3", "3", "3", "7", "14", "3", "v", "rule_version",
    "(" + _features(w="w", lam="0.25",
                    source="(SELECT m.*, r.*, r.v % 5 + 5 AS w FROM metrics m, rule r)") + ")"))})""",
    "detect_rules_in_force": f"""
SELECT metric_name, metric_date, method, severity, rule_version, {_r('risk_score')} FROM ({_scored(_suite(
    "0.25", "n", "w", "3", "3", "3", "7", "14", "3", "v", "rule_version",
    "(" + _features(w="w", lam="0.25",
                    source="(SELECT m.*, r.*, r.v % 5 + 5 AS w FROM metrics m JOIN rules r ON r.event_date = m.metric_date)")
    + ")"))})""",
    "detect_odd_rules": f"""
SELECT metric_name, metric_date, method, severity, rule_version, {_r('risk_score')} FROM ({_scored(_suite(
    "0.3", "2.5", "7", "3", "3", "1.5", "7", "14", "3", "2.0", "rule_version",
    "(SELECT f.*, r.rule_version FROM feats f, rule r)"))}) WHERE method NOT IN ('change_point', 'regime_shift')""",
    "alerts_rejudged": f"""
SELECT alert_id, metric_name, metric_date, method, severity, {_r('risk_score')} FROM alerts""",
    "run_days_outcome": f"""
SELECT 'dq_reports' AS what, event_date AS day, 1::BIGINT AS n FROM (SELECT DISTINCT event_date FROM ev) WHERE event_date BETWEEN {_WINDOW}
UNION ALL SELECT 'metrics_daily', metric_date, count(*) FROM metrics WHERE metric_date BETWEEN {_WINDOW} GROUP BY 2
UNION ALL SELECT 'alerts', metric_date, count(*) FROM {_RUN} GROUP BY 2
UNION ALL SELECT 'due', metric_date, count(*) FROM (SELECT *, row_number() OVER (ORDER BY ts, alert_id) AS position
  FROM (SELECT a.*, TIMESTAMP '2024-02-01' AS ts FROM {_RUN} a)), (VALUES (1), (2)) t(target)
  WHERE position <= 50 GROUP BY 2""",
    "alert_messages": "SELECT alert_id, message FROM alerts",
    "alerts_recent": f"""
SELECT alert_id, ts::VARCHAR AS ts, metric_name, metric_date::VARCHAR AS metric_date, severity, {_r('risk_score')}, status
FROM alerts ORDER BY alerts.ts DESC, alert_id LIMIT 50""",
    "alerts_lifecycle": """
SELECT alert_id, status, acked_by, acked_at::VARCHAR AS acked_at, resolved_by, resolved_at::VARCHAR AS resolved_at
FROM acted""",
    "alerts_rerun": f"""
SELECT alert_id, metric_name, metric_date FROM alerts WHERE metric_date NOT BETWEEN {_WINDOW}""",
    "alerts_audit": """
SELECT actor, CASE kind WHEN 'ACK' THEN 'alert_ack' ELSE 'alert_resolve' END AS action, 'alert' AS entity_type,
  alert_id::VARCHAR AS entity_id, kind AS status, action_ts::VARCHAR AS ts FROM actions""",
    "alerts_status_by_day": "SELECT metric_date AS day, status, count(*) AS n FROM acted GROUP BY ALL",
    "notify_pending": """
SELECT alert_id, target, position FROM (
  SELECT alert_id, target, row_number() OVER (PARTITION BY target ORDER BY ts, alert_id) AS position
  FROM alerts a, (VALUES ('https://hooks.example/a'), ('https://hooks.example/b')) t(target)
  WHERE NOT EXISTS (SELECT 1 FROM notes n WHERE n.alert_id = a.alert_id AND n.target = t.target AND n.status = 'sent'))
WHERE position <= 5""",
    "notify_email_queue": """
SELECT alert_id, 'risk@example.org,ops@example.org' AS target, position, method AS context_method,
  '[ALERT] ' || severity || ' ' || metric_name || ' ' || metric_date::VARCHAR AS subject,
  'Alert details:' || chr(10) || 'Metric: ' || metric_name || chr(10) || 'Severity: ' || severity || chr(10)
    || 'Risk score: ' || round(risk_score, 6)::VARCHAR || chr(10) || 'Message: ' || message || chr(10)
    || 'Timestamp: ' || ts::VARCHAR AS body
FROM (SELECT *, row_number() OVER (ORDER BY ts, alert_id) AS position FROM alerts) WHERE position <= 50""",
    "notify_webhook_payloads": f"""
SELECT alert_id, target, metric_name, metric_date::VARCHAR AS metric_date, severity, {_r('risk_score')}, message,
  method, ts::VARCHAR AS "timestamp" FROM (
  SELECT *, row_number() OVER (PARTITION BY target ORDER BY ts, alert_id) AS position
  FROM alerts a, (VALUES ('https://hooks.example/a'), ('https://hooks.example/b')) t(target)
  WHERE NOT EXISTS (SELECT 1 FROM notes n WHERE n.alert_id = a.alert_id AND n.target = t.target AND n.status = 'sent'))
WHERE position <= 50""",
    "notify_outcome_upsert": f"""
SELECT {_NOTE_COLUMNS.replace('status', "'sent' AS status")},
  CASE WHEN status = 'failed' THEN '{{"try":2}}' ELSE payload END AS payload, NULL::VARCHAR AS last_error,
  CASE WHEN status = 'failed' THEN '2024-02-01 00:00:00' ELSE sent_at::VARCHAR END AS sent_at,
  created_at::VARCHAR AS created_at FROM notes""",
    "notifications_recent": f"""
SELECT {', '.join('n.' + c for c in _NOTE_COLUMNS.split(', '))}, n.sent_at::VARCHAR AS sent_at,
  n.created_at::VARCHAR AS created_at, n.last_error, a.metric_name, a.severity
FROM notes n LEFT JOIN alerts a USING (alert_id) ORDER BY n.created_at DESC, notification_id LIMIT 50""",
    "recipients_parse": """
SELECT event_id, coalesce(user_id || ',', '') || event_type || ',' || source_system AS people,
  2 + (user_id IS NOT NULL)::BIGINT AS n FROM ev""",
    "stability_index": f"SELECT day, {_r('stability_index')} FROM stability",
    "overview_daily": f"""
SELECT day, health_score, {_r('stability_index', 'dq_confidence', 'financial_exposure')} FROM (
  SELECT day, greatest(0, least(100, 100 - least(60, 8 * coalesce(open_alerts, 0))
      - CASE WHEN passes THEN 0 ELSE 15 END))::BIGINT AS health_score, stability_index,
    coalesce(confidence, 0) * 100 AS dq_confidence, coalesce(exposure, 0) AS financial_exposure
  FROM in_force LEFT JOIN (SELECT metric_date AS day, count(*) FILTER (WHERE status = 'OPEN') AS open_alerts,
      sum(impact) AS exposure FROM acted GROUP BY 1) USING (day)
  JOIN stability USING (day))""",
    "overview_top_risks": f"""
SELECT day, position, metric_name, severity, {_r('risk_score')} FROM (
  SELECT *, metric_date AS day, row_number() OVER (PARTITION BY metric_date ORDER BY risk_score DESC, alert_id) AS position
  FROM alerts) WHERE position <= 5""",
    "overview_recent": f"""
SELECT DATE '2024-01-29' AS day, health_score, {_r('stability_index', 'dq_confidence', 'financial_exposure')},
  '$' || format('{{:,}}', financial_exposure::BIGINT) AS exposure_text FROM (
  SELECT greatest(0, least(100, 100 - least(60, 8 * open_alerts) - CASE WHEN pass THEN 0 ELSE 15 END))::BIGINT
      AS health_score, stability_index, confidence * 100 AS dq_confidence, exposure AS financial_exposure
  FROM (SELECT count(*) FILTER (WHERE status = 'OPEN') AS open_alerts, coalesce(sum(impact), 0) AS exposure
      FROM (SELECT * FROM acted {_NEWEST} LIMIT 50)),
    (SELECT * FROM reports ORDER BY report_date DESC LIMIT 1),
    (SELECT stability_index FROM stability WHERE day = DATE '2024-01-29'))""",
    "overview_recent_risks": f"SELECT {_RISK} FROM alerts {_NEWEST} LIMIT 5",
    "panel_window_metrics": f"""
SELECT metric_name AS "Metric", round(value, 4) AS "Value" FROM metrics
WHERE metric_date = (SELECT max(metric_date) FROM metrics WHERE metric_date BETWEEN {_WINDOW})""",
    "panel_window_alerts": f"""
SELECT {_ALERT_TABLE} FROM acted WHERE metric_date BETWEEN {_WINDOW} {_NEWEST} LIMIT 10""",
    "panel_window_anomalies": f"""
SELECT {_ANOMALY_TABLE} FROM alerts WHERE metric_date BETWEEN {_WINDOW} ORDER BY impact DESC, alert_id LIMIT 5""",
    "panel_notifications": """
SELECT n.channel AS "Channel", n.target AS "Target", n.status AS "Status", coalesce(a.metric_name, '') AS "Alert",
  coalesce(a.severity, '') AS "Severity", coalesce(n.sent_at, n.created_at)::VARCHAR AS "Sent At"
FROM notes n LEFT JOIN alerts a USING (alert_id) ORDER BY n.created_at DESC, notification_id LIMIT 10""",
    "panel_recent_metrics": """
SELECT metric_name AS "Metric", round(value, 4) AS "Value" FROM metrics WHERE metric_date = DATE '2024-01-29'
  AND metric_name IN ('tx_fail_rate', 'latency_p95_ms', 'tx_completed_value', 'dau')""",
    "panel_recent_alerts": f"SELECT {_ALERT_TABLE} FROM acted {_NEWEST} LIMIT 50",
    "panel_recent_anomalies": f"SELECT {_ANOMALY_TABLE} FROM alerts {_NEWEST} LIMIT 5",
    "panel_empty_window": f"""
SELECT {_ANOMALY_TABLE} FROM alerts WHERE metric_date = DATE '2023-12-30'
UNION ALL SELECT 'No anomalies', 0.0::DOUBLE, 'n/a', ''
WHERE NOT EXISTS (SELECT 1 FROM alerts WHERE metric_date = DATE '2023-12-30')""",
    "request_rollup": """
SELECT count(*) AS total_requests, count(*) FILTER (WHERE status >= 500) AS total_errors,
  round(sum(latency_ms) / count(*), 2) AS avg_latency_ms FROM requests""",
    "request_counts": """
SELECT method, path, status::BIGINT AS status, count(*) AS n FROM requests GROUP BY ALL""",
    "request_latency_histogram": f"""
SELECT path, CASE WHEN isinf(bound) THEN 'Infinity' ELSE bound::VARCHAR END AS le,
  count(*) FILTER (WHERE latency_ms / 1000.0 <= bound) AS n
FROM requests, (SELECT unnest([{_BOUNDS}, 'inf'::DOUBLE]::DOUBLE[]) AS bound) GROUP BY path, bound""",
    "telemetry_table": """
SELECT metric, value FROM (SELECT count(*)::DOUBLE AS total_requests,
  count(*) FILTER (WHERE status >= 500)::DOUBLE AS total_errors,
  round(sum(latency_ms) / count(*), 2) AS avg_latency_ms FROM requests)
UNPIVOT (value FOR metric IN (total_requests, total_errors, avg_latency_ms))""",
    "stream_ingest_dedupe": f"""
SELECT event_id, event_type, source_system, user_id, {_r('value')}, outcome FROM routed""",
    "stream_backfill_kpis": f"""
SELECT metric_date, metric_name, {_r('value')}, 0::BIGINT AS days_left
FROM ({_CTES['metrics'].replace('FROM ev GROUP BY 1', "FROM (SELECT * FROM ev WHERE event_id IN (SELECT event_id FROM judged WHERE reason = 'ok')) GROUP BY 1")})""",
    "stream_daily_kpis": f"SELECT metric_date, metric_name, {_r('value')}, '{{}}' AS dimensions FROM metrics",
    "stream_provisional_kpis": """
SELECT metric_date AS event_date, (max(value) FILTER (WHERE metric_name = 'tx_completed_count'))::BIGINT
    AS tx_completed_count, round(max(value) FILTER (WHERE metric_name = 'tx_completed_value'), 6) AS tx_completed_value,
  round(max(value) FILTER (WHERE metric_name = 'tx_fail_rate'), 6) AS tx_fail_rate, TRUE AS dau_near,
  metric_date > (SELECT max(ts_event)::DATE FROM ev) - 2 AS is_open
FROM metrics GROUP BY 1""",
    "stream_late_days": """
SELECT event_date, count(*) AS late_rows FROM routed WHERE outcome = 'late' GROUP BY 1""",
}

_BODIES["stream_kpi_parts"] = _BODIES["stream_daily_kpis"]
_BODIES["stream_ingest_routed"] = f"""
SELECT event_id, reason, count(*) AS n FROM ({_BODIES['ingest_bodies']}) GROUP BY ALL"""

ORACLE: dict[str, str] = {name: _with(body) for name, body in _BODIES.items()}
