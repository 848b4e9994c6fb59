"""Table schemas, closed value sets and default settings."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# These decide results and are stated as plain lists.
# ---------------------------------------------------------------------------
EVENT_TYPES = (
    "transaction_initiated",
    "transaction_completed",
    "transaction_failed",
    "system_latency",
    "user_access",
    "config_change",
)
REQUIRED_FIELDS = ("event_id", "ts_event", "event_type", "source_system")

KPI_NAMES = (
    "dau",
    "tx_completed_count",
    "tx_completed_value",
    "tx_fail_rate",
    "latency_p95_ms",
)
# Series watched by the anomaly suite when the caller names none.
WATCHED_METRICS = ("tx_fail_rate", "latency_p95_ms", "tx_completed", "dau")
# Series that enter the stability index and the recent metric snapshot.
BOARD_METRICS = ("tx_fail_rate", "latency_p95_ms", "tx_completed_value", "dau")

# Data-quality controls.
MAX_DUPLICATE_RATE = 0.01
MIN_COMPLETENESS = 0.99
MAX_QUARANTINE_RATE = 0.01
FUTURE_GRACE_MINUTES = 5
TOP_PROPERTY_KEYS = 20
BASELINE_DAYS = 7
DRIFT_MIN_SAMPLE = 20
DRIFT_P_VALUE = 0.05
DRIFT_CHECKS = {
    "transaction_value": "transaction_completed",
    "latency_value": "system_latency",
}
BIAS_MIN_DAYS = 3
BIAS_Z = 2.5

# Anomaly gates.
LOOKBACK_DAYS = 30
MIN_LOOKBACK_ROWS = 6
MIN_BASELINE_ROWS = 5
Z_SCORE_LIMIT = 3.0

# Lists and queues.
DEFAULT_LIST_LIMIT = 50
MAX_LIST_LIMIT = 200
QUEUE_LIMIT = 50

# Upper bounds of the request-latency histogram, seconds.
LATENCY_BUCKETS_SEC = (
    0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5,
    0.75, 1.0, 2.5, 5.0, 7.5, 10.0,
)

# ---------------------------------------------------------------------------
# Tables.  ``*_date`` columns are the partition columns on storage.
# ---------------------------------------------------------------------------
EVENTS_RAW = T.StructType([
    T.StructField("event_id", T.StringType()),
    T.StructField("ts_event", T.TimestampType()),
    T.StructField("ts_ingested", T.TimestampType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("source_system", T.StringType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("measurement_uncertainty", T.DoubleType()),
    T.StructField("properties", T.StringType()),
    T.StructField("event_date", T.DateType()),
])

EVENTS_QUARANTINE = T.StructType([
    T.StructField("quarantine_id", T.LongType()),
    T.StructField("ts_ingested", T.TimestampType()),
    T.StructField("reason", T.StringType()),
    T.StructField("raw_payload", T.StringType()),
    T.StructField("ingest_date", T.DateType()),
])

# One request body per row, as a message queue or a landing folder delivers it.
REQUEST_BODIES = T.StructType([
    T.StructField("batch_id", T.StringType()),
    T.StructField("received_at", T.TimestampType()),
    T.StructField("body", T.StringType()),
])

METRICS_DAILY = T.StructType([
    T.StructField("metric_name", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("dimensions", T.StringType()),
    T.StructField("computed_at", T.TimestampType()),
    T.StructField("metric_date", T.DateType()),
])

DQ_SUMMARY = T.StructType([
    T.StructField("date", T.StringType()),
    T.StructField("n_events", T.LongType()),
    T.StructField("duplicate_events", T.LongType()),
    T.StructField("duplicate_rate", T.DoubleType()),
    T.StructField("missing_required", T.StructType([
        T.StructField("event_id", T.LongType()),
        T.StructField("ts_event", T.LongType()),
        T.StructField("event_type", T.LongType()),
        T.StructField("source_system", T.LongType()),
        T.StructField("total", T.LongType()),
    ])),
    T.StructField("malformed_events", T.LongType()),
    T.StructField("completeness_rate", T.DoubleType()),
    T.StructField("freshness_p50_sec", T.DoubleType()),
    T.StructField("freshness_p95_sec", T.DoubleType()),
    T.StructField("future_events", T.LongType()),
    T.StructField("quarantine_total", T.LongType()),
    T.StructField("quarantine_by_reason", T.MapType(T.StringType(), T.LongType())),
    T.StructField("quarantine_rate", T.DoubleType()),
    T.StructField("top_property_keys", T.ArrayType(T.StructType([
        T.StructField("key", T.StringType()),
        T.StructField("count", T.LongType()),
    ]))),
    T.StructField("distribution_drift", T.ArrayType(T.StructType([
        T.StructField("name", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("n_current", T.LongType()),
        T.StructField("n_baseline", T.LongType()),
        T.StructField("ks_stat", T.DoubleType()),
        T.StructField("p_value", T.DoubleType()),
        T.StructField("drifted", T.BooleanType()),
    ]))),
    T.StructField("source_bias", T.ArrayType(T.StructType([
        T.StructField("source_system", T.StringType()),
        T.StructField("current_share", T.DoubleType()),
        T.StructField("baseline_mean", T.DoubleType()),
        T.StructField("baseline_std", T.DoubleType()),
        T.StructField("z_score", T.DoubleType()),
    ]))),
    T.StructField("confidence", T.DoubleType()),
])

DQ_REPORTS = T.StructType([
    T.StructField("pass", T.BooleanType()),
    T.StructField("summary", DQ_SUMMARY),
    T.StructField("computed_at", T.TimestampType()),
    T.StructField("report_date", T.DateType()),
])

# Union of the fields the five detectors explain themselves with.
ALERT_CONTEXT = T.StructType(
    [T.StructField("method", T.StringType())]
    + [
        T.StructField(name, T.DoubleType())
        for name in (
            "observed", "baseline_mean", "baseline_std", "z_score",
            "ewma", "ewma_z",
            "previous_mean", "recent_mean", "change_point_z",
            "seasonal_mean", "seasonal_std", "seasonal_z",
            "prior_mean", "mean_z", "prior_var", "recent_var", "var_ratio",
            "impact", "confidence", "persistence",
        )
    ]
    + [
        T.StructField("baseline_window_days", T.LongType()),
        T.StructField("window", T.IntegerType()),
    ]
)

ALERTS = T.StructType([
    T.StructField("alert_id", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("metric_name", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("rule_version", T.StringType()),
    T.StructField("risk_score", T.DoubleType()),
    T.StructField("message", T.StringType()),
    T.StructField("context", ALERT_CONTEXT),
    T.StructField("status", T.StringType()),
    T.StructField("acked_by", T.StringType()),
    T.StructField("acked_at", T.TimestampType()),
    T.StructField("resolved_by", T.StringType()),
    T.StructField("resolved_at", T.TimestampType()),
    T.StructField("metric_date", T.DateType()),
])

ALERT_ACTIONS = T.StructType([
    T.StructField("alert_id", T.LongType()),
    T.StructField("kind", T.StringType()),  # ACK or RESOLVED
    T.StructField("actor", T.StringType()),
    T.StructField("action_ts", T.TimestampType()),
    T.StructField("seq", T.LongType()),
])

ALERT_NOTIFICATIONS = T.StructType([
    T.StructField("notification_id", T.LongType()),
    T.StructField("alert_id", T.LongType()),
    T.StructField("channel", T.StringType()),
    T.StructField("target", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("payload", T.StringType()),
    T.StructField("last_error", T.StringType()),
    T.StructField("sent_at", T.TimestampType()),
    T.StructField("created_at", T.TimestampType()),
])

AUDIT_LOG = T.StructType([
    T.StructField("audit_id", T.LongType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("actor", T.StringType()),
    T.StructField("action", T.StringType()),
    T.StructField("entity_type", T.StringType()),
    T.StructField("entity_id", T.StringType()),
    T.StructField("payload", T.StringType()),
])

ANOMALY_RULES = T.StructType([
    T.StructField("rule_name", T.StringType()),
    T.StructField("rule_version", T.StringType()),
    T.StructField("config", T.StringType()),
    T.StructField("updated_at", T.TimestampType()),
])

REQUEST_LOG = T.StructType([
    T.StructField("method", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("status", T.IntegerType()),
    T.StructField("latency_ms", T.DoubleType()),
])
