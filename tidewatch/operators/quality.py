"""Daily data-quality measurements and the combined scorecard."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewatch import schemas as S
from tidewatch.functions import scores
from tidewatch.operators import drift
from tidewatch.operators.bias import bias_of_counts
from tidewatch.operators.calendar import days_between, within
from tidewatch.operators.percentiles import daily_percentiles, ranked_percentiles, sketched_cuts, zone_and_kept
from tidewatch.sources.staging import stage


def event_totals(events: DataFrame) -> DataFrame:
    """Events per day and how many of them repeat an id."""
    counted = events.groupBy("event_date").agg(
        F.count(F.lit(1)).alias("n_events"),
        F.count_distinct("event_id").alias("_distinct"),
    )
    repeats = F.greatest(F.lit(0).cast("bigint"), F.col("n_events") - F.col("_distinct"))
    return counted.select("event_date", "n_events", repeats.alias("duplicate_events"))


def missing_required(events: DataFrame) -> DataFrame:
    """Null counts of the required fields per day, one column each and ``total``."""
    counted = events.groupBy("event_date").agg(
        *[F.count_if(F.col(name).isNull()).alias(name) for name in S.REQUIRED_FIELDS]
    )
    total = sum((F.col(name) for name in S.REQUIRED_FIELDS[1:]), F.col(S.REQUIRED_FIELDS[0]))
    return counted.withColumn("total", total)


# Freshness columns and the share of the day's lags they stand at.
_FRESHNESS = {"freshness_p50_sec": 0.5, "freshness_p95_sec": 0.95}


def _lag() -> Column:
    return (F.unix_micros("ts_ingested") - F.unix_micros("ts_event")) / 1e6


def freshness(events: DataFrame) -> DataFrame:
    """Median and 95th percentile of the ingestion lag per day, in seconds."""
    return daily_percentiles(events, "event_date", _lag(), _FRESHNESS)


def is_future(as_of: datetime) -> Column:
    """Event time more than the grace period after ``as_of``."""
    return F.col("ts_event") > F.lit(as_of) + F.make_dt_interval(mins=F.lit(S.FUTURE_GRACE_MINUTES))


def future_events(events: DataFrame, as_of: datetime) -> DataFrame:
    """One row: events of the whole table lying in the future of ``as_of``."""
    # Only the days from then on are read.
    latest = as_of + timedelta(minutes=S.FUTURE_GRACE_MINUTES)
    ahead = events.where((F.col("event_date") >= F.lit(latest.date())) & is_future(as_of))
    return ahead.agg(F.count(F.lit(1)).alias("future_events"))


def future_events_by_day(events: DataFrame, as_of: datetime) -> DataFrame:
    return events.groupBy("event_date").agg(F.count_if(is_future(as_of)).alias("future_events"))


def quarantine_by_reason(quarantine: DataFrame) -> DataFrame:
    """Refused payloads per ingest day and reason."""
    return quarantine.groupBy("ingest_date", "reason").agg(F.count(F.lit(1)).alias("n"))


def quarantine_stats(quarantine: DataFrame) -> DataFrame:
    """Per ingest day: total, map by reason, and the total less repeated ids."""
    n, reason = F.col("n"), F.col("reason")
    repeats = F.coalesce(F.sum(F.when(reason == "duplicate_event_id", n)), F.lit(0))
    return quarantine_by_reason(quarantine).groupBy("ingest_date").agg(
        F.sum(n).alias("quarantine_total"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(reason, n)))).alias(
            "quarantine_by_reason"
        ),
        F.greatest(F.lit(0), F.sum(n) - repeats).cast("bigint").alias("malformed_events"),
    )


def top_property_keys(events: DataFrame, limit: int = S.TOP_PROPERTY_KEYS) -> DataFrame:
    """Most frequent top-level property keys per day; equal counts by key."""
    counted = (
        events.select("event_date", F.explode(F.json_object_keys("properties")).alias("key"))
        .groupBy("event_date", "key")
        .agg(F.count(F.lit(1)).alias("count"))
    )
    return top_counted_keys(counted, limit)


def top_counted_keys(counted: DataFrame, limit: int = S.TOP_PROPERTY_KEYS) -> DataFrame:
    """The largest ``count`` of each day; equal counts by key."""
    order = Window.partitionBy("event_date").orderBy(F.desc("count"), "key")
    return counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def day_counts(events: DataFrame, as_of: datetime) -> DataFrame:
    """One row per day from one scan: totals, null counts, future events, and brackets for the lag percentiles."""
    lag = _lag().cast("double")
    return events.groupBy("event_date").agg(
        F.count(F.lit(1)).alias("n_events"),
        *[F.count_if(F.col(name).isNull()).alias(name) for name in S.REQUIRED_FIELDS],
        F.count_if(is_future(as_of)).alias("future_of_day"),
        F.count(lag).alias("n_lags"),
        sketched_cuts(lag, list(_FRESHNESS.values())).alias("lag_cuts"),
    )


def day_facts(events: DataFrame, days: DataFrame, judged: Column) -> DataFrame:
    """From one scan, counts per (day, kind, name, value), ``n``.

    Kinds: ``source``; ``key`` (property keys) and ``lag`` (by zone, with the
    value inside a bracket of ``days``) of the days that ``judged`` names; and
    ``check`` (values of the drift checks).  An event counts for several.
    """
    number = "cast(null AS double)"
    lag = _lag().cast("double")
    zone, kept = zone_and_kept(lag, F.col("n_lags"), F.col("lag_cuts"), len(_FRESHNESS))
    # One row per calendar day.
    near = events.join(F.broadcast(days.select("event_date", "n_lags", "lag_cuts")), "event_date", "left")
    measured = near.select(
        "event_date", "source_system", "value", drift.check_of(S.DRIFT_CHECKS).alias("_check"),
        F.when(judged, F.json_object_keys("properties")).alias("_keys"),
        F.when(judged & lag.isNotNull(), zone.cast("string")).alias("_zone"), kept.alias("_lag"),
    )
    facts = f"""concat(
        array(named_struct('kind', 'source', 'name', source_system, 'value', {number})),
        transform(coalesce(_keys, array()), k -> named_struct('kind', 'key', 'name', k, 'value', {number})),
        if(_zone IS NULL, array(), array(named_struct('kind', 'lag', 'name', _zone, 'value', _lag))),
        if(_check IS NULL, array(), array(named_struct('kind', 'check', 'name', _check, 'value', value)))
    )"""
    return (
        measured.select("event_date", F.inline(F.expr(facts)))
        .groupBy("event_date", "kind", "name", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _listed(rows: DataFrame, day: str, order: str, name: str, fields: list[str]) -> DataFrame:
    """Rows of a day as one array of structs; a handful per day."""
    entry = F.struct(F.col(order).alias("_o"), F.struct(*fields).alias("_v"))
    return rows.groupBy(F.col(day).alias("report_date")).agg(
        F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["_v"]).alias(name)
    )


def scorecard(
    events: DataFrame,
    quarantine: DataFrame,
    as_of: datetime,
    start: date | None = None,
    end: date | None = None,
    future_scope: str = "table",
) -> DataFrame:
    """One flat row per report date with every measurement, verdict and confidence.

    ``future_scope="table"`` counts future events of the whole table on every
    report; ``"day"`` counts those of the report's own day.  With both ends of
    a range each calendar day gets a report, empty days included.
    """
    day = F.col("event_date")
    rows = events.where(within(day, start, end))
    # Baselines reach back before the first report.
    reach = start if start is None else date.fromordinal(start.toordinal() - S.BASELINE_DAYS)
    history = events.where(within(day, reach, end))
    refused = quarantine.where(within(F.col("ingest_date"), start, end))

    # Two scans for all counts and a narrow one for distinct ids.
    days = stage(day_counts(rows, as_of), "day-counts")
    judged = F.col("n_lags").isNotNull()
    facts = stage(day_facts(history, days, judged), "day-facts", "kind")

    def of(kind: str, *columns: Column) -> DataFrame:
        return facts.where(F.col("kind") == kind).select("event_date", *columns)

    name, value, count = F.col("name"), F.col("value"), F.col("n")
    ids = rows.groupBy("event_date").agg(F.count_distinct("event_id").alias("_distinct"))
    missing_total = sum((F.col(field) for field in S.REQUIRED_FIELDS[1:]), F.col(S.REQUIRED_FIELDS[0]))
    # Every part has one row per calendar day.
    totals = days.join(F.broadcast(ids), "event_date").select(
        "event_date", "n_events",
        F.greatest(F.lit(0).cast("bigint"), F.col("n_events") - F.col("_distinct")).alias("duplicate_events"),
        F.struct(*S.REQUIRED_FIELDS, missing_total.alias("total")).alias("missing_required"),
        F.col("future_of_day").alias("future_events"),
    )
    if start is not None and end is not None:
        spine = days_between(events.sparkSession, start, end, "event_date")
        totals = spine.join(totals, "event_date", "left")
    report = totals.withColumnRenamed("event_date", "report_date")

    lags = of("lag", name.cast("int").alias("_zone"), value.alias("_kept"), count.alias("_c"))
    lags = lags.join(F.broadcast(days.select("event_date", F.col("n_lags").alias("_n"))), "event_date")
    lags = lags.withColumnRenamed("event_date", "_day")
    keys = top_counted_keys(of("key", name.alias("key"), count.alias("count")))
    by_source = of("source", name.alias("source_system"), count.alias("n"))
    checked = drift.drift_of_counts(of("check", name, value, count), start, end)
    drift_fields = [f.name for f in S.DQ_SUMMARY["distribution_drift"].dataType.elementType.fields]
    bias_fields = [f.name for f in S.DQ_SUMMARY["source_bias"].dataType.elementType.fields]
    parts = [
        ranked_percentiles(lags, "event_date", _FRESHNESS).withColumnRenamed("event_date", "report_date"),
        quarantine_stats(refused).withColumnRenamed("ingest_date", "report_date"),
        _listed(keys, "event_date", "rank", "top_property_keys", ["key", "count"]),
        _listed(checked, "report_date", "name", "distribution_drift", drift_fields),
        _listed(bias_of_counts(by_source), "report_date", "source_system", "source_bias", bias_fields),
    ]
    for part in parts:
        report = report.join(F.broadcast(part), "report_date", "left")
    if future_scope != "day":
        report = report.withColumn("future_events", future_events(events, as_of).scalar())

    zero = F.lit(0).cast("bigint")
    none_missing = F.struct(*[zero.alias(n) for n in (*S.REQUIRED_FIELDS, "total")])
    n, total = F.col("n_events"), F.col("quarantine_total")
    counts = ("n_events", "duplicate_events", "future_events", "quarantine_total", "malformed_events")
    filled = report.withColumns({
        **{name: F.coalesce(name, zero) for name in counts},
        "missing_required": F.coalesce("missing_required", none_missing),
        **{
            name: F.coalesce(name, F.lit(None).cast(S.DQ_SUMMARY[name].dataType), empty)
            for name, empty in (
                ("quarantine_by_reason", F.create_map().cast("map<string,bigint>")),
                ("top_property_keys", F.array().cast(S.DQ_SUMMARY["top_property_keys"].dataType)),
                ("distribution_drift", F.array().cast(S.DQ_SUMMARY["distribution_drift"].dataType)),
                ("source_bias", F.array().cast(S.DQ_SUMMARY["source_bias"].dataType)),
            )
        },
    })
    rated = filled.withColumns({
        "duplicate_rate": scores.rate(F.col("duplicate_events"), n),
        "completeness_rate": scores.completeness(n, F.col("missing_required")["total"]),
        "quarantine_rate": scores.rate(total, n),
    })
    return rated.withColumns({
        "confidence": scores.dq_confidence(n, F.col("completeness_rate"), F.col("quarantine_rate")),
        "pass": scores.dq_pass(
            n,
            F.col("duplicate_rate"),
            F.col("completeness_rate"),
            F.col("quarantine_rate"),
            F.col("future_events"),
            F.col("distribution_drift"),
            F.col("source_bias"),
        ),
    })


def reports(card: DataFrame, computed_at: datetime) -> DataFrame:
    """Scorecards as report rows ``(report_date, pass, summary, computed_at)``."""
    fields = [
        F.col("report_date").cast("string").alias("date") if f.name == "date" else F.col(f.name)
        for f in S.DQ_SUMMARY.fields
    ]
    return card.select(
        "pass",
        F.struct(*fields).alias("summary"),
        F.lit(computed_at).alias("computed_at"),
        "report_date",
    )
