"""Registered queries: name -> (spark, sf_dir) -> DataFrame.

Doubles are rounded to six places and nested values flattened, so that the
results compare with SQL.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from catalog import derived as D
from tidewatch import schemas as S
from tidewatch.functions.text import address_list, currency
from tidewatch.operators import alerts as alert_ops
from tidewatch.operators import bias, drift, heavy, kpis, notify, quality, requests, screening, validation
from tidewatch.operators.detectors import detect, detect_in_force
from tidewatch.operators.merge import merge
from tidewatch.operators.percentiles import daily_percentiles
from tidewatch.operators.series import series_features
from tidewatch.plans import daily, overview, panels, reads
from tidewatch.sources import rules, sample
from tidewatch.sources.staging import file_system, fresh_path, stage
from tidewatch.sources.tables import Tables
from tidewatch.streaming import dayparts
from tidewatch.streaming import ingest as stream_ingest
from tidewatch.streaming import kpis as stream_kpis
from tidewatch.streaming import provisional, routing, summaries

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[
        F.round(F.col(f"`{f.name}`"), 6).alias(f.name)
        if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ])


def _entries(name: str) -> Column:
    """A map as text, in its own order."""
    return F.array_join(
        F.transform(F.map_entries(name), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ","
    )


def _names(entries: str | Column, field: str) -> Column:
    """One field of an array of structs as text."""
    return F.array_join(F.transform(entries, lambda e: e[field].cast("string")), ",")


def query(name: str) -> Callable[[Query], Query]:
    def register(build: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return _rounded(build(spark, sf_dir))

        QUERIES[name] = run
        return run

    return register


# --- KPIs ------------------------------------------------------------------

@query("kpi_daily_long")
def _(spark, sf_dir):
    return D.metrics(spark, sf_dir)


@query("kpi_dau")
def _(spark, sf_dir):
    return kpis.active_users(sample.events_raw(spark, sf_dir))


@query("kpi_tx_completed")
def _(spark, sf_dir):
    return kpis.completed_transactions(sample.events_raw(spark, sf_dir))


@query("kpi_fail_rate")
def _(spark, sf_dir):
    return kpis.failure_rate(sample.events_raw(spark, sf_dir))


@query("kpi_latency_p95")
def _(spark, sf_dir):
    return kpis.latency_p95(sample.events_raw(spark, sf_dir))


@query("kpi_backfill_range")
def _(spark, sf_dir):
    return kpis.backfill(sample.events_raw(spark, sf_dir), *D.BACKFILL)


@query("metrics_upsert_merge")
def _(spark, sf_dir):
    """Earlier KPIs without the transaction count, merged with a recomputed window."""
    series = D.metrics(spark, sf_dir)
    new = series.where(F.col("metric_date").between(*map(F.lit, D.WINDOW)))
    old = series.where(F.col("metric_name") != "tx_completed_count")
    stale = old.withColumn("value", F.col("value") + 1000.0)
    return merge(stale, new, ["metric_date", "metric_name", "dimensions"])


@query("metric_series_lookup")
def _(spark, sf_dir):
    return reads.metric_series(D.metrics(spark, sf_dir), "dau", *D.WINDOW)


# --- data quality ----------------------------------------------------------

@query("dq_totals")
def _(spark, sf_dir):
    return quality.event_totals(sample.lake_events(spark, sf_dir))


@query("dq_missing_required")
def _(spark, sf_dir):
    return quality.missing_required(sample.lake_events(spark, sf_dir))


@query("dq_freshness")
def _(spark, sf_dir):
    return quality.freshness(sample.lake_events(spark, sf_dir))


@query("dq_future_events")
def _(spark, sf_dir):
    return quality.future_events(sample.lake_events(spark, sf_dir), D.FUTURE_AS_OF)


@query("dq_future_events_by_day")
def _(spark, sf_dir):
    return quality.future_events_by_day(sample.lake_events(spark, sf_dir), D.FUTURE_AS_OF)


@query("dq_quarantine_by_reason")
def _(spark, sf_dir):
    return quality.quarantine_by_reason(D.quarantine(spark, sf_dir))


@query("dq_quarantine_stats")
def _(spark, sf_dir):
    return quality.quarantine_stats(D.quarantine(spark, sf_dir)).select(
        "ingest_date", "quarantine_total", "malformed_events",
        _entries("quarantine_by_reason").alias("by_reason"),
    )


@query("dq_top_property_keys")
def _(spark, sf_dir):
    keys = quality.top_property_keys(sample.lake_events(spark, sf_dir))
    return keys.withColumn("rank", F.col("rank").cast("bigint"))


@query("dq_heavy_property_keys")
def _(spark, sf_dir):
    """Top keys among many rare ones: summaries name candidates, only these are counted where that is proven to do."""
    keys = heavy.top_keys(heavy.property_keys(sample.wide_events(spark, sf_dir)))
    return keys.withColumn("rank", F.col("rank").cast("bigint"))


@query("dq_source_shares")
def _(spark, sf_dir):
    return bias.source_shares(sample.lake_events(spark, sf_dir))


@query("dq_share_history")
def _(spark, sf_dir):
    return bias.share_history(sample.events_raw(spark, sf_dir))


@query("dq_source_bias")
def _(spark, sf_dir):
    return bias.source_bias(sample.events_raw(spark, sf_dir))


@query("dq_ks_drift")
def _(spark, sf_dir):
    return drift.distribution_drift(sample.events_raw(spark, sf_dir))


@query("dq_drift_screened")
def _(spark, sf_dir):
    """Verdicts from sketches, exact where these leave them open; the exact distance must lie within the bounds."""
    events = sample.events_raw(spark, sf_dir)
    screened = screening.screened_drift(events, k=200)
    exact = drift.distribution_drift(events).select("report_date", "name", "ks_stat")
    held = (F.col("ks_low") - 1e-12 <= F.col("ks_stat")) & (F.col("ks_stat") <= F.col("ks_high") + 1e-12)
    return screened.join(exact, ["report_date", "name"], "left").select(
        "report_date", "name", "event_type", "n_current", "n_baseline", "drifted", held.alias("ks_held")
    )


@query("dq_scorecard")
def _(spark, sf_dir):
    return D.scorecards(spark, sf_dir).select(
        "report_date", "n_events", "duplicate_events", "duplicate_rate",
        F.col("missing_required")["total"].alias("missing_total"),
        "completeness_rate", "freshness_p50_sec", "freshness_p95_sec", "future_events",
        "quarantine_total", "malformed_events", "quarantine_rate",
        F.size("top_property_keys").cast("bigint").alias("n_keys"),
        F.size("distribution_drift").cast("bigint").alias("n_checks"),
        F.size(F.filter("distribution_drift", lambda c: c["drifted"])).cast("bigint").alias("n_drifted"),
        F.size("source_bias").cast("bigint").alias("n_biased"),
        _names("top_property_keys", "key").alias("keys"),
        _names("top_property_keys", "count").alias("key_counts"),
        _names("distribution_drift", "name").alias("checks"),
        _names(F.filter("distribution_drift", lambda c: c["drifted"]), "name").alias("drifted"),
        _names("source_bias", "source_system").alias("biased"),
        "confidence", "pass",
    )


@query("dq_pass_fail")
def _(spark, sf_dir):
    """Verdicts over clean events, future events by day."""
    events = sample.events_raw(spark, sf_dir)
    card = quality.scorecard(events, D.quarantine(spark, sf_dir), D.FUTURE_AS_OF, future_scope="day")
    return card.select("report_date", "future_events", "confidence", "pass")


@query("dq_latest")
def _(spark, sf_dir):
    latest = reads.latest_report(D.reports(spark, sf_dir))
    confidence = F.get_json_object("summary", "$.confidence").cast("double")
    return latest.select("report_date", "pass", confidence.alias("confidence"))


@query("dq_latest_empty")
def _(spark, sf_dir):
    """The stand-in for the newest report where none lies in the future of the run."""
    later = D.reports(spark, sf_dir).where(F.col("report_date") > F.lit(D.AS_OF.date()))
    return reads.latest_report(later)


@query("dq_asof")
def _(spark, sf_dir):
    return overview.report_in_force(D.odd_reports(spark, sf_dir), D.days(spark, sf_dir))


@query("reports_store_rerun")
def _(spark, sf_dir):
    """Reports of the window stored twice in their table: one row per day."""
    tables = Tables(spark, fresh_path(spark, "report-tables"))
    tables.append("events_raw", sample.lake_events(spark, sf_dir))
    tables.append("events_quarantine", D.quarantine(spark, sf_dir))
    for _ in range(2):
        daily.store_reports(tables, *D.WINDOW, D.AS_OF)
    return tables.read("dq_reports").select(
        "report_date", "pass", "summary.n_events", "summary.quarantine_total", "summary.confidence"
    )


@query("dq_summary_text")
def _(spark, sf_dir):
    text = panels.report_text(D.reports(spark, sf_dir), D.WINDOW[1])
    return text.select("line", F.size("cards").cast("bigint").alias("n_cards"), F.col("cards")[1].alias("card2"))


# --- ingest ----------------------------------------------------------------

def _classified(spark, sf_dir, **options):
    return validation.classify(sample.ingest_feed(spark, sf_dir), **options)


@query("ingest_validate")
def _(spark, sf_dir):
    checked = validation.check_events(sample.ingest_feed(spark, sf_dir))
    return checked.select(
        "batch_id", "seq", "event_id", F.array_join("errors", ";").alias("errors"), "properties"
    )


@query("ingest_dedupe")
def _(spark, sf_dir):
    return _classified(spark, sf_dir).select("batch_id", "seq", "event_id", "reason")


@query("ingest_dedupe_history")
def _(spark, sf_dir):
    """The feed against the stored events of the first half of the month, by the index on their ids."""
    tables = Tables(spark, fresh_path(spark, "history-tables"))
    for tens in (0, 1):
        half = sample.events_raw(spark, sf_dir).where(F.dayofmonth("event_date") <= 15)
        tables.append("events_raw", half.where(F.floor((F.dayofmonth("event_date") - 1) / 10) == tens))
    judged = _classified(spark, sf_dir, history=tables.known_ids(sample.ingest_feed(spark, sf_dir)))
    return judged.select("batch_id", "seq", "event_id", "reason")


@query("ingest_batch_mode")
def _(spark, sf_dir):
    judged = _classified(spark, sf_dir, whole_batches=True)
    return judged.select("batch_id", "seq", "event_id", "reason")


@query("ingest_accepted")
def _(spark, sf_dir):
    kept = validation.accepted(_classified(spark, sf_dir))
    return kept.groupBy("event_date", "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"),
        F.sum("measurement_uncertainty").alias("uncertainty"),
    )


@query("ingest_receipt")
def _(spark, sf_dir):
    return validation.receipts(_classified(spark, sf_dir)).select(
        "batch_id", "accepted", "rejected", _entries("rejected_reasons").alias("reasons")
    )


@query("ingest_quarantine")
def _(spark, sf_dir):
    return D.quarantine(spark, sf_dir).select(
        "ingest_date", "reason",
        F.get_json_object("raw_payload", "$.event_id").alias("event_id"),
        F.get_json_object("raw_payload", "$.event_type").alias("event_type"),
    )


@query("ingest_audit")
def _(spark, sf_dir):
    receipt = validation.receipts(_classified(spark, sf_dir))
    audit = validation.audit_of_ingest(receipt, "system", F.lit(D.AS_OF))
    return audit.select(
        "actor", "action", "entity_type",
        F.get_json_object("payload", "$.accepted").cast("bigint").alias("accepted"),
        F.get_json_object("payload", "$.rejected").cast("bigint").alias("rejected"),
    )


@query("ingest_bodies")
def _(spark, sf_dir):
    """Request bodies parsed from JSON, checked and judged."""
    rows = stage(validation.explode_bodies(D.bodies(spark, sf_dir)), "parsed")
    judged = validation.classify(rows)
    return judged.select(
        F.col("batch_id").cast("bigint").alias("batch_id"), "seq", "event_id", "event_type",
        "user_id", "value", "measurement_uncertainty", F.array_join("errors", ";").alias("errors"), "reason",
    )


@query("ingest_refused_bodies")
def _(spark, sf_dir):
    """Whole bodies refused for an invalid event, as they are quarantined."""
    posts = D.bodies(spark, sf_dir)
    judged = validation.classify(stage(validation.explode_bodies(posts), "parsed"), whole_batches=True)
    kept = validation.refused_bodies(posts, judged, "/ingest/events")
    document = lambda at: F.get_json_object("raw_payload", at)
    return kept.select(
        document("$.path").alias("path"), document("$.errors").alias("errors"), "ingest_date",
        F.json_array_length(document("$.body.events")).cast("bigint").alias("n_events"),
    )


@query("rules_seed")
def _(spark, sf_dir):
    """The default rule joins stored rules that have other names."""
    named = F.concat(F.lit("rules of weekday "), F.weekday(F.to_date("updated_at")).cast("string"))
    stored = D.rules(spark, sf_dir).withColumn("rule_name", named)
    seeded = rules.seed_if_absent(stored, rules.seed_rules(spark))
    return seeded.groupBy("rule_name").agg(F.count(F.lit(1)).alias("n"))


@query("kpi_latency_nonfinite")
def _(spark, sf_dir):
    """Percentiles of days that hold values which are no numbers."""
    number = F.substring("event_id", -12, 12).cast("bigint")
    odd = ((F.dayofmonth("event_date") % 2 == 0) & (number % 7 == 0)) | (number % 45 == 0)
    v = F.when(F.col("value").isNotNull(), F.when(odd, F.lit(float("nan"))).otherwise(F.col("value")))
    found = daily_percentiles(sample.events_raw(spark, sf_dir), "event_date", v, {"p95": 0.95, "p50": 0.5})
    return found.select(
        "event_date", F.isnan("p95").alias("p95_is_nan"),
        F.round(F.when(~F.isnan("p95"), F.col("p95")), 6).alias("p95"), F.round("p50", 6).alias("p50"),
    )


# --- series and detectors --------------------------------------------------

@query("series_features")
def _(spark, sf_dir):
    return series_features(D.metrics(spark, sf_dir)).select(
        "metric_name", "metric_date", "observed", "n_lookback", "n_baseline",
        "baseline_mean", "baseline_std", "previous_value", "persistence",
        "cp_recent_mean", "cp_previous_mean", "n_seasonal", "seasonal_mean", "seasonal_std",
        "regime_recent_mean", "regime_prior_mean",
    )


def _flat(found: DataFrame) -> DataFrame:
    return found.select(
        "metric_name", "metric_date", "severity", "rule_version", "risk_score", "message", "context.*"
    ).withColumn("window", F.col("window").cast("bigint"))


for _name, _method in {
    "detect_zscore": "z_score",
    "detect_ewma": "ewma",
    "detect_seasonal": "seasonal_decomposition",
    "detect_regime": "regime_shift",
}.items():
    query(_name)(lambda spark, sf_dir, m=_method: _flat(D.detections(spark, sf_dir, m)))


@query("detect_change_point")
def _(spark, sf_dir):
    """With half the default threshold: the sample has no large level shift."""
    halved = rules.RuleConfig(change_point_z=1.5)
    return _flat(detect(D.metrics(spark, sf_dir), halved, names=None, methods=("change_point",)))


@query("detect_all")
def _(spark, sf_dir):
    return D.detections(spark, sf_dir).select(
        "metric_name", "metric_date", "context.method", "severity", "risk_score",
        "context.impact", "context.confidence", "context.persistence",
    )


@query("detect_watched")
def _(spark, sf_dir):
    """The default list of watched series."""
    return detect(D.metrics(spark, sf_dir)).select(
        "metric_name", "metric_date", "context.method", "severity", "risk_score"
    )


@query("rule_config_effective")
def _(spark, sf_dir):
    return rules.effective_rules(D.rules(spark, sf_dir))


@query("detect_stored_rules")
def _(spark, sf_dir):
    """Detectors under the rules read from the rules table."""
    stored = rules.load_rules(D.rules(spark, sf_dir))
    return detect(D.metrics(spark, sf_dir), stored, names=None).select(
        "metric_name", "metric_date", "context.method", "severity", "rule_version", "risk_score"
    )


@query("detect_rules_in_force")
def _(spark, sf_dir):
    """Each day under the rule row that held on it: window lengths and limits differ from day to day."""
    return detect_in_force(D.metrics(spark, sf_dir), D.rules(spark, sf_dir), names=None).select(
        "metric_name", "metric_date", "context.method", "severity", "rule_version", "risk_score"
    )


@query("detect_odd_rules")
def _(spark, sf_dir):
    """Settings that are huge, no number, zero or text: each takes its default or silences its detector alone."""
    odd = (
        '{"change_point_window":1e12,"seasonal_min_points":"NaN","regime_recent_days":0,"regime_baseline_days":3000000000,'
        '"ewma_lambda":"high","ewma_limit":2.5,"seasonal_z":"1.5","regime_var_ratio":0}'
    )
    stored = D.rules(spark, sf_dir).withColumn("config", F.lit(odd))
    loaded = rules.load_rules(stored)
    return detect(D.metrics(spark, sf_dir), loaded, names=None).select(
        "metric_name", "metric_date", "context.method", "severity", "rule_version", "risk_score"
    )


# --- alerts and notifications ----------------------------------------------

@query("alert_messages")
def _(spark, sf_dir):
    return D.alerts(spark, sf_dir).select("alert_id", "message")


@query("alerts_recent")
def _(spark, sf_dir):
    newest = reads.recent_alerts(D.alerts(spark, sf_dir))
    return newest.select("alert_id", "ts", "metric_name", "metric_date", "severity", "risk_score", "status")


def _acted(spark, sf_dir, series=None):
    raised = D.alerts_of(D.metrics(spark, sf_dir) if series is None else series)
    return alert_ops.apply_actions(raised, D.actions(raised))


@query("alerts_lifecycle")
def _(spark, sf_dir):
    return _acted(spark, sf_dir).select(
        "alert_id", "status", "acked_by", F.col("acked_at").cast("string").alias("acked_at"),
        "resolved_by", F.col("resolved_at").cast("string").alias("resolved_at"),
    )


@query("alerts_rerun")
def _(spark, sf_dir):
    """A second run of all days over what a first run of the window stored."""
    raised = D.alerts(spark, sf_dir)
    stored = raised.where(F.col("metric_date").between(*map(F.lit, D.WINDOW)))
    return alert_ops.unseen(raised, stored).select("alert_id", "metric_name", "metric_date")


@query("alerts_rejudged")
def _(spark, sf_dir):
    """Alerts raised on wrong values of the window, after the right values came in: those that are not retracted."""
    tables, right = Tables(spark, fresh_path(spark, "rejudged-tables")), D.metrics(spark, sf_dir)
    right = stage(right.withColumn("computed_at", F.lit(D.AS_OF)).select(*S.METRICS_DAILY.names), "right-metrics")
    in_window = F.col("metric_date").between(*map(F.lit, D.WINDOW))
    wrong = F.when(in_window, F.col("value") * (1 + F.dayofmonth("metric_date") % 3)).otherwise(F.col("value"))
    tables.append("metrics_daily", right.withColumn("value", wrong))
    raised = D.alerts_of(tables.read("metrics_daily"))
    tables.append("alerts", raised)
    before = stage(tables.read("metrics_daily"), "wrong-metrics")
    tables.upsert("metrics_daily", right.where(in_window))
    changed = stage(daily.changed_metrics(before, tables.read("metrics_daily")), "changed")
    daily.rejudge(tables, changed, D.AS_OF, names=None)
    standing = daily.current_alerts(tables).where(F.col("status") != alert_ops.RETRACTED)
    return standing.select("alert_id", "metric_name", "metric_date", "context.method", "severity", "risk_score")


@query("run_days_outcome")
def _(spark, sf_dir):
    """The whole daily run over the window: what each stored table holds afterwards."""
    tables = Tables(spark, fresh_path(spark, "run-tables"))
    tables.append("events_raw", sample.events_raw(spark, sf_dir))
    due = daily.run_days(tables, D.AS_OF, *D.WINDOW, webhooks=D.WEBHOOKS)
    counts = [
        (name, tables.read(name).groupBy(F.col(day).alias("day")))
        for name, day in (("dq_reports", "report_date"), ("metrics_daily", "metric_date"), ("alerts", "metric_date"))
    ]
    found = [by_day.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("what"), "day", "n") for name, by_day in counts]
    alert_days = tables.read("alerts").select("alert_id", F.col("metric_date").alias("day"))
    found.append(due.join(alert_days, "alert_id").groupBy("day").agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("due").alias("what"), "day", "n"
    ))
    return reduce(DataFrame.unionByName, found)


@query("alerts_audit")
def _(spark, sf_dir):
    raised = D.alerts(spark, sf_dir)
    audit = alert_ops.audit_of_actions(D.actions(raised), raised)
    return audit.select(
        "actor", "action", "entity_type", "entity_id",
        F.get_json_object("payload", "$.status").alias("status"),
        F.col("ts").cast("string").alias("ts"),
    )


@query("alerts_status_by_day")
def _(spark, sf_dir):
    return overview.status_by_day(_acted(spark, sf_dir))


@query("notify_pending")
def _(spark, sf_dir):
    raised = D.alerts(spark, sf_dir)
    due = notify.pending(raised, D.notifications(raised), "webhook", address_list(F.lit(D.WEBHOOKS)), limit=5)
    return due.select("alert_id", "target", F.col("position").cast("bigint").alias("position"))


@query("notify_email_queue")
def _(spark, sf_dir):
    raised = D.alerts(spark, sf_dir)
    rounded = raised.withColumn("risk_score", F.round("risk_score", 6))
    return notify.email_queue(rounded, D.notifications(raised), D.EMAILS).select(
        "alert_id", "target", "subject", F.col("position").cast("bigint").alias("position"),
        F.substring_index("body", "\nContext: ", 1).alias("body"),
        F.get_json_object(F.substring_index("body", "\nContext: ", -1), "$.method").alias("context_method"),
    )


@query("notify_webhook_payloads")
def _(spark, sf_dir):
    raised = D.alerts(spark, sf_dir)
    queue = notify.webhook_queue(raised, D.notifications(raised), D.WEBHOOKS)

    def part(name: str) -> Column:
        return F.get_json_object("payload", f"$.{name}")

    return queue.select(
        "alert_id", "target", part("metric_name").alias("metric_name"),
        part("metric_date").alias("metric_date"), part("severity").alias("severity"),
        part("risk_score").cast("double").alias("risk_score"), part("message").alias("message"),
        part("context.method").alias("method"), part("timestamp").alias("timestamp"),
    )


@query("notify_outcome_upsert")
def _(spark, sf_dir):
    """A second round in which every failed delivery is sent: a delta of the stored table."""
    tables = Tables(spark, fresh_path(spark, "outcome-tables"))
    tables.upsert("alert_notifications", D.notifications(D.alerts(spark, sf_dir)))
    again = tables.read("alert_notifications").where(F.col("status") == "failed").select(
        "alert_id", "channel", "target", F.lit("sent").alias("status"),
        F.lit('{"try":2}').alias("payload"), F.lit(None).cast("string").alias("error"),
    )
    daily.store_outcomes(tables, again, D.AS_OF)
    return tables.read("alert_notifications").select(
        "notification_id", "alert_id", "channel", "target", "status", "payload", "last_error",
        F.col("sent_at").cast("string").alias("sent_at"),
        F.col("created_at").cast("string").alias("created_at"),
    )


@query("notifications_recent")
def _(spark, sf_dir):
    raised = D.alerts(spark, sf_dir)
    return reads.recent_notifications(D.notifications(raised), raised)


@query("recipients_parse")
def _(spark, sf_dir):
    """Address lists made of every event's own fields."""
    raw = F.concat_ws(" , ", "user_id", F.lit(""), "event_type", F.concat("source_system", F.lit(",")))
    people = address_list(raw)
    return sample.events_raw(spark, sf_dir).select(
        "event_id", F.array_join(people, ",").alias("people"), F.size(people).cast("bigint").alias("n")
    )


# --- read models -----------------------------------------------------------

@query("stability_index")
def _(spark, sf_dir):
    return overview.stability_by_day(D.metrics(spark, sf_dir), D.days(spark, sf_dir))


@query("overview_daily")
def _(spark, sf_dir):
    series = stage(D.metrics(spark, sf_dir), "metrics")
    return overview.daily_overview(
        D.days(spark, sf_dir), D.odd_reports(spark, sf_dir), _acted(spark, sf_dir, series), series
    ).withColumn("health_score", F.col("health_score").cast("bigint"))


@query("overview_top_risks")
def _(spark, sf_dir):
    ranked = overview.top_risks_by_day(D.alerts(spark, sf_dir))
    return ranked.withColumn("position", F.col("position").cast("bigint")).drop("message")


@query("overview_recent")
def _(spark, sf_dir):
    series = stage(D.metrics(spark, sf_dir), "metrics")
    shown = overview.recent_overview(
        D.WINDOW[1], D.reports(spark, sf_dir), _acted(spark, sf_dir, series), series
    )
    return shown.withColumn("health_score", F.col("health_score").cast("bigint")).withColumn(
        "exposure_text", currency(F.col("financial_exposure"))
    )


@query("overview_recent_risks")
def _(spark, sf_dir):
    return overview.risk_table(overview.top_risks_recent(D.alerts(spark, sf_dir)))


@query("panel_window_metrics")
def _(spark, sf_dir):
    return panels.window_metrics(D.metrics(spark, sf_dir), *D.WINDOW)


@query("panel_window_alerts")
def _(spark, sf_dir):
    return panels.window_alerts(_acted(spark, sf_dir), *D.WINDOW)


@query("panel_window_anomalies")
def _(spark, sf_dir):
    return panels.window_anomalies(D.alerts(spark, sf_dir), *D.WINDOW)


@query("panel_notifications")
def _(spark, sf_dir):
    raised = D.alerts(spark, sf_dir)
    return panels.notifications_table(D.notifications(raised), raised)


@query("panel_recent_metrics")
def _(spark, sf_dir):
    return panels.recent_metrics(D.metrics(spark, sf_dir), D.WINDOW[1])


@query("panel_recent_alerts")
def _(spark, sf_dir):
    return panels.recent_alerts_table(_acted(spark, sf_dir))


@query("panel_recent_anomalies")
def _(spark, sf_dir):
    return panels.recent_anomalies(D.alerts(spark, sf_dir))


@query("panel_empty_window")
def _(spark, sf_dir):
    """A window before the first alert shows the stand-in row."""
    early = (D.BACKFILL[0], D.BACKFILL[0])
    return panels.window_anomalies(D.alerts(spark, sf_dir), *early)


# --- telemetry -------------------------------------------------------------

@query("request_rollup")
def _(spark, sf_dir):
    return requests.request_totals(sample.request_log(spark, sf_dir))


@query("request_counts")
def _(spark, sf_dir):
    counts = requests.request_counts(sample.request_log(spark, sf_dir))
    return counts.withColumn("status", F.col("status").cast("bigint"))


@query("request_latency_histogram")
def _(spark, sf_dir):
    rows = requests.latency_histogram(sample.request_log(spark, sf_dir))
    return rows.withColumn("le", F.col("le").cast("double").cast("string"))


@query("telemetry_table")
def _(spark, sf_dir):
    return requests.telemetry_table(sample.request_log(spark, sf_dir))


# --- streams ---------------------------------------------------------------

def _sample_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``events`` table as a file stream in the sample's layout."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")


def _routed(spark: SparkSession, sf_dir: str, tables: Tables | None = None) -> routing.RoutedStream:
    """The feed as it arrives, ten days a file, of which some rows come nine days late."""
    landed, arriving = fresh_path(spark, "arrivals"), sample.arrivals(spark, sf_dir)
    schema = arriving.drop("slot").schema
    routed = routing.RoutedStream(spark, fresh_path(spark, "routed"), 7)
    checkpoint = fresh_path(spark, "routed-checkpoint")
    for slot in range(arriving.agg(F.max("slot")).first()[0] + 1):
        arriving.where(F.col("slot") == slot).drop("slot").write.mode("append").parquet(landed)
        feed = spark.readStream.schema(schema).parquet(landed)
        if tables is None:
            query = routing.route_stream(routed, feed, checkpoint)
        else:
            query = routing.ingest_routed(tables, routed, feed, checkpoint)
        query.awaitTermination()
    return routed


@query("stream_ingest_dedupe")
def _(spark, sf_dir):
    """Every row of the stream with its outcome."""
    rows = _routed(spark, sf_dir).rows()
    return rows.select("event_id", "event_type", "source_system", "user_id", "value", F.col("reason").alias("outcome"))


def _landed(rows: DataFrame, path: str, key: str, batches: int) -> DataFrame:
    """``rows`` as files below ``path``, rows of one key in one file, and those as a stream of ``batches`` micro-batches."""
    spark = rows.sparkSession
    # As many files as cores in each micro-batch, so that one is not read by a few tasks.
    rows.repartition(batches * spark.sparkContext.defaultParallelism, key).write.parquet(path)
    fs, folder = file_system(spark, path)
    files = sum(s.getPath().getName().endswith(".parquet") for s in fs.listStatus(folder))
    each = max(1, math.ceil(files / batches))
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", each).parquet(path)


@query("stream_ingest_routed")
def _(spark, sf_dir):
    """Request bodies judged in two micro-batches against all stored before: stored and quarantined events by id."""
    landed, posts = fresh_path(spark, "landed"), D.bodies(spark, sf_dir)
    feed = _landed(posts, landed, "batch_id", 2)
    tables = Tables(spark, fresh_path(spark, "routed-tables"))
    stream_ingest.ingest_stream(tables, feed, fresh_path(spark, "routed-checkpoint")).awaitTermination()
    kept = tables.read("events_raw").select("event_id", F.lit("ok").alias("reason"))
    refused = tables.read("events_quarantine").select(
        F.get_json_object("raw_payload", "$.event_id").alias("event_id"), "reason"
    )
    return kept.unionByName(refused).groupBy("event_id", "reason").agg(F.count(F.lit(1)).alias("n"))


@query("stream_daily_kpis")
def _(spark, sf_dir):
    tables = Tables(spark, fresh_path(spark, "stream-tables"))
    events = sample.model_columns(_sample_stream(spark, sf_dir)).select(*S.EVENTS_RAW.names)
    stream_kpis.kpi_stream(tables, events, fresh_path(spark, "kpi-checkpoint")).awaitTermination()
    return tables.read("metrics_daily").select("metric_date", "metric_name", "value", "dimensions")


def _in_three(spark: SparkSession, sf_dir: str, events: Query = sample.events_raw) -> DataFrame:
    """The accepted events as a stream of three micro-batches, each with events of every day."""
    rows = events(spark, sf_dir).select(*S.EVENTS_RAW.names)
    return _landed(rows, fresh_path(spark, "landed-events"), "event_id", 3)


@query("stream_kpi_parts")
def _(spark, sf_dir):
    """KPIs kept in partial states over three micro-batches."""
    tables = Tables(spark, fresh_path(spark, "part-tables"))
    parts = dayparts.DayParts(spark, fresh_path(spark, "day-parts"))
    dayparts.kpi_parts_stream(tables, parts, _in_three(spark, sf_dir), fresh_path(spark, "part-checkpoint")).awaitTermination()
    return tables.read("metrics_daily").select("metric_date", "metric_name", "value", "dimensions")


@query("stream_heavy_keys")
def _(spark, sf_dir):
    """Top keys by summaries that three micro-batches have added to."""
    store = summaries.KeySummaries(spark, fresh_path(spark, "key-summaries"), tracked=64)
    arriving = _in_three(spark, sf_dir, sample.wide_events)
    summaries.summary_stream([store], arriving, fresh_path(spark, "summary-checkpoint")).awaitTermination()
    return store.top(sample.wide_events(spark, sf_dir), 8).withColumn("rank", F.col("rank").cast("bigint"))


@query("stream_drift_screened")
def _(spark, sf_dir):
    """Drift verdicts by sketches that three micro-batches have added to."""
    store = summaries.DriftSketches(spark, fresh_path(spark, "drift-sketches"), k=200)
    arriving = _in_three(spark, sf_dir)
    summaries.summary_stream([store], arriving, fresh_path(spark, "sketch-checkpoint")).awaitTermination()
    return store.drift(sample.events_raw(spark, sf_dir)).drop("ks_low", "ks_high", "decided_by")


@query("stream_provisional_kpis")
def _(spark, sf_dir):
    """All days, the open ones flagged; user counts held against the sketch's own bound of three deviations."""
    days = provisional.ProvisionalDays(spark, fresh_path(spark, "provisional"))
    provisional.provisional_stream(days, _in_three(spark, sf_dir), fresh_path(spark, "provisional-checkpoint")).awaitTermination()
    exact = kpis.active_users(sample.events_raw(spark, sf_dir)).toDF("event_date", "_dau")
    near = F.abs(F.col("dau_approx") - F.col("_dau")) <= days.error() * F.col("_dau")
    return days.read().join(exact, "event_date", "left").withColumn("dau_near", near).drop("dau_approx", "_dau")


@query("stream_late_days")
def _(spark, sf_dir):
    """The backfill list of the stream: days with late rows, and how many."""
    return _routed(spark, sf_dir).backfill_days()


@query("stream_backfill_kpis")
def _(spark, sf_dir):
    """KPIs after the stream and the backfill of its late rows, which leaves none waiting."""
    tables = Tables(spark, fresh_path(spark, "backfill-tables"))
    routed = _routed(spark, sf_dir, tables)
    routing.backfill(tables, routed, D.AS_OF)
    left = routed.backfill_days().count()
    return tables.read("metrics_daily").select(
        "metric_date", "metric_name", "value", F.lit(left).cast("bigint").alias("days_left")
    )
