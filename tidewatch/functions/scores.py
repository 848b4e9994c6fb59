"""Score, rate and severity expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from tidewatch import schemas as S


def _clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


# --- anomaly scores --------------------------------------------------------

def severity(z: Column) -> Column:
    return (
        F.when(F.abs(z) >= 4, F.lit("CRITICAL"))
        .when(F.abs(z) >= 3, F.lit("WARN"))
        .otherwise(F.lit("INFO"))
    )


def confidence(z: Column) -> Column:
    return F.least(F.lit(1.0), F.abs(z) / 5.0)


def impact(metric: Column, observed: Column, baseline: Column) -> Column:
    """Business impact of ``observed`` against ``baseline``.

    Fixed weights: failure rate 100 per unit of rise, latency 1/100 per unit of
    rise, completed transactions 10 and every other series 5 per relative drop.
    """
    rise = F.greatest(F.lit(0.0), observed - baseline)
    drop = F.greatest(
        F.lit(0.0), (baseline - observed) / F.greatest(F.lit(1.0), baseline)
    )
    return (
        F.when(metric == "tx_fail_rate", rise * 100.0)
        .when(metric == "latency_p95_ms", rise / 100.0)
        .when(metric == "tx_completed", drop * 10.0)
        .otherwise(drop * 5.0)
    )


def risk(impact_: Column, confidence_: Column, persistence: Column) -> Column:
    """Product of the three factors, each floored at zero."""
    zero = F.lit(0.0)
    return (
        F.greatest(zero, impact_)
        * F.greatest(zero, confidence_)
        * F.greatest(zero, persistence)
    )


# --- data quality ----------------------------------------------------------

def rate(part: Column, whole: Column) -> Column:
    """``part / whole``; 0 when there is nothing to divide by."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def completeness(n_events: Column, missing_total: Column) -> Column:
    cells = n_events * len(S.REQUIRED_FIELDS)
    return F.when(n_events > 0, 1.0 - missing_total / cells).otherwise(F.lit(0.0))


def dq_confidence(n_events: Column, completeness_: Column, quarantine_rate: Column) -> Column:
    """Volume and completeness blended 60:40, scaled down by the refused share."""
    volume = F.least(F.lit(1.0), F.log10(n_events + F.lit(1)) / 4.0)
    clean = F.greatest(F.lit(0.0), 1.0 - quarantine_rate)
    blended = (volume * 0.6 + completeness_ * 0.4) * clean
    return F.when(n_events > 0, _clamp(blended, 0.0, 1.0)).otherwise(F.lit(0.0))


def dq_pass(
    n_events: Column,
    duplicate_rate: Column,
    completeness_: Column,
    quarantine_rate: Column,
    future_events: Column,
    drift: Column,
    bias: Column,
) -> Column:
    """All controls hold.  ``drift`` and ``bias`` are the report's arrays."""
    return all_of([
        n_events > 0,
        duplicate_rate <= S.MAX_DUPLICATE_RATE,
        completeness_ >= S.MIN_COMPLETENESS,
        quarantine_rate <= S.MAX_QUARANTINE_RATE,
        future_events <= 0,
        ~F.exists(drift, lambda check: check["drifted"]),
        F.size(bias) == 0,
    ])


# --- board -----------------------------------------------------------------

def health_score(open_alerts: Column, report_passes: Column) -> Column:
    """100 less 8 per open alert (at most 60) less 15 without a passing report."""
    alert_part = F.least(F.lit(60), open_alerts * 8)
    report_part = F.when(F.coalesce(report_passes, F.lit(False)), 0).otherwise(15)
    return _clamp(F.lit(100) - alert_part - report_part, 0, 100)


def stability(sum_of_cv: Column) -> Column:
    """100 less the summed coefficients of variation in percent; 100 without any."""
    loss = F.least(F.lit(100.0), sum_of_cv * 100.0)
    return F.when(sum_of_cv.isNull(), 100.0).otherwise(100.0 - loss)
