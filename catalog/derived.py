"""Tables the registered queries share, derived from the sample tables.

Stored tables of the application (alerts, notifications, actions, rules,
reports) have no sample counterpart; they are computed from the whole
``events`` table by the rules below, which ``catalog/oracle.py`` restates in
SQL.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewatch.operators import alerts as alert_ops
from tidewatch.operators import detectors, kpis, notify, quality, validation
from tidewatch.sources import sample
from tidewatch.sources.staging import stage

AS_OF = datetime(2024, 2, 1)
FUTURE_AS_OF = datetime(2024, 1, 30, 12)
WINDOW = (date(2024, 1, 20), date(2024, 1, 29))
BACKFILL = (date(2023, 12, 30), date(2024, 1, 10))
WEBHOOKS = "https://hooks.example/a, https://hooks.example/b,,"
EMAILS = "risk@example.org, ops@example.org"


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kpis.kpi_rows(kpis.daily_kpis(sample.events_raw(spark, sf_dir)))


def detections(spark: SparkSession, sf_dir: str, *methods: str) -> DataFrame:
    """Anomalies of all five KPI series."""
    chosen = methods or tuple(detectors.DETECTORS)
    return detectors.detect(metrics(spark, sf_dir), names=None, methods=chosen)


def alerts_of(series: DataFrame) -> DataFrame:
    """Alerts raised at one o'clock the day after, stored as the batch job does."""
    found = detectors.detect(series, names=None)
    raised_at = F.expr("cast(date_add(metric_date, 1) AS timestamp) + INTERVAL 1 HOUR")
    return stage(alert_ops.to_alerts(found, raised_at), "alerts")


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts_of(metrics(spark, sf_dir))


# kind, actor, hours after the alert, and the days of month it happens on
_ACTIONS = (
    ("ACK", "ops-a", 1, "day % 2 = 0"),
    ("RESOLVED", "ops-b", 2, "day % 4 = 0"),
    ("ACK", "ops-c", 3, "day % 8 = 0"),
    ("RESOLVED", "ops-d", 4, "day % 6 = 3"),
)


def actions(alerts_: DataFrame) -> DataFrame:
    """Operators' actions on every alert, by its day of month."""
    entries = ", ".join(
        f"if({when}, named_struct('kind', '{kind}', 'actor', '{actor}',"
        f" 'action_ts', ts + INTERVAL {hours} HOURS, 'seq', {hours}L), null)"
        for kind, actor, hours, when in _ACTIONS
    )
    dated = alerts_.selectExpr("alert_id", "ts", "dayofmonth(metric_date) AS day")
    return dated.selectExpr("alert_id", f"inline(array_compact(array({entries})))")


def deliveries(alerts_: DataFrame) -> DataFrame:
    """Outcomes of the first target: sent on days 0 mod 3, failed on days 1 mod 3."""
    turn = alerts_.selectExpr("*", "dayofmonth(metric_date) % 3 AS turn").where("turn < 2")
    return turn.selectExpr(
        "alert_id",
        "'webhook' AS channel",
        "'https://hooks.example/a' AS target",
        "if(turn = 0, 'sent', 'failed') AS status",
        "'{}' AS payload",
        "if(turn = 1, 'timeout', null) AS error",
        "ts + INTERVAL 10 MINUTES AS at",
    )


def notifications(alerts_: DataFrame) -> DataFrame:
    return notify.outcome_rows(deliveries(alerts_), F.col("at"))


def quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.refused(validation.classify(sample.ingest_feed(spark, sf_dir)))


def scorecards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scorecard(
        sample.lake_events(spark, sf_dir), quarantine(spark, sf_dir), AS_OF
    )


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(quality.reports(scorecards(spark, sf_dir), AS_OF), "reports")


def odd_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of odd days, so that even days look back."""
    return reports(spark, sf_dir).where(F.dayofmonth("report_date") % 2 == 1)


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One rule row per event day: limits from that day's values, some keys
    absent, one malformed."""
    by_day = sample.events_raw(spark, sf_dir).groupBy("event_date").agg(
        F.count(F.lit(1)).alias("n"), F.count("value").alias("v")
    )
    config = F.concat(
        F.lit('{"ewma_lambda":0.25,"ewma_limit":'), F.col("n").cast("string"),
        F.lit(',"change_point_window":"'), (F.col("v") % 5 + 5).cast("string"),
        F.lit('","seasonal_z":"high","regime_var_ratio":'), F.col("v").cast("string"), F.lit("}"),
    )
    return by_day.select(
        F.lit("anomaly_rules").alias("rule_name"),
        F.concat(F.lit("v"), F.dayofmonth("event_date").cast("string")).alias("rule_version"),
        config.alias("config"),
        F.col("event_date").cast("timestamp").alias("updated_at"),
    )


def bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ingest feed as request bodies of one batch each (about 100 events), repeats included."""
    feed = sample.ingest_feed(spark, sf_dir)
    event = F.struct(
        "event_id",
        F.date_format("ts_event", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("ts_event"),
        "event_type", "source_system", "user_id", "value", "measurement_uncertainty",
        F.parse_json("properties").alias("properties"),
    )
    listed = F.transform(
        F.array_sort(F.collect_list(F.struct("seq", F.to_json(event).alias("json")))),
        lambda e: e["json"],
    )
    # Every tenth batch is delivered twice.
    times = F.explode(F.expr("if(batch_id % 10 = 0, array(1, 2), array(1))"))
    return feed.groupBy("batch_id").agg(F.min("ts_ingested").alias("received_at"), listed.alias("e")).select(
        F.col("batch_id").cast("string").alias("batch_id"),
        "received_at",
        F.concat(F.lit('{"events":['), F.array_join("e", ","), F.lit("]}")).alias("body"),
        times.alias("_time"),
    ).drop("_time")


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample.events_raw(spark, sf_dir).select(F.col("event_date").alias("day")).distinct()
