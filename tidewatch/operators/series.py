"""Rolling features of daily metric series.

A series is one metric with one set of dimensions and has at most one row per
calendar day, so window partitions are bounded by the calendar.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from tidewatch import schemas as S
from tidewatch.sources.rules import RuleConfig

# Calendar frames (baseline, yesterday, lookback, weekday) count days on the
# day number; positional frames (change point, regime) count rows.
_FEATURES = """
SELECT metric_name, dimensions, metric_date, value AS observed,
  count(value) OVER lookback AS n_lookback,
  count(value) OVER baseline AS n_baseline,
  avg(value) OVER baseline AS baseline_mean,
  stddev_samp(value) OVER baseline AS baseline_std,
  -- at most seven values, oldest first
  transform(array_sort(collect_list(struct(day, value)) OVER baseline), p -> p.value) AS baseline_values,
  -- at most thirty-one values, oldest first
  transform(array_sort(collect_list(struct(day, value)) OVER lookback), p -> p.value) AS lookback_values,
  max(value) OVER yesterday AS previous_value,
  avg(value) OVER cp_recent AS cp_recent_mean,
  avg(value) OVER cp_previous AS cp_previous_mean,
  var_samp(value) OVER cp_recent AS cp_recent_var,
  var_samp(value) OVER cp_previous AS cp_previous_var,
  count(value) OVER weekdays AS n_seasonal,
  avg(value) OVER weekdays AS seasonal_mean,
  stddev_samp(value) OVER weekdays AS seasonal_std,
  avg(value) OVER re_recent AS regime_recent_mean,
  avg(value) OVER re_prior AS regime_prior_mean,
  var_samp(value) OVER re_recent AS regime_recent_var,
  var_samp(value) OVER re_prior AS regime_prior_var
FROM (SELECT *, unix_date(metric_date) AS day, weekday(metric_date) AS weekday FROM {rows})
WINDOW
  lookback AS (PARTITION BY metric_name, dimensions ORDER BY day
    RANGE BETWEEN %(lookback)d PRECEDING AND CURRENT ROW),
  baseline AS (PARTITION BY metric_name, dimensions ORDER BY day
    RANGE BETWEEN %(baseline)d PRECEDING AND 1 PRECEDING),
  yesterday AS (PARTITION BY metric_name, dimensions ORDER BY day
    RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING),
  weekdays AS (PARTITION BY metric_name, dimensions, weekday ORDER BY day
    RANGE BETWEEN %(lookback)d PRECEDING AND 1 PRECEDING),
  cp_recent AS (PARTITION BY metric_name, dimensions ORDER BY day
    ROWS BETWEEN %(w)d - 1 PRECEDING AND CURRENT ROW),
  cp_previous AS (PARTITION BY metric_name, dimensions ORDER BY day
    ROWS BETWEEN 2 * %(w)d - 1 PRECEDING AND %(w)d PRECEDING),
  re_recent AS (PARTITION BY metric_name, dimensions ORDER BY day
    ROWS BETWEEN %(recent)d - 1 PRECEDING AND CURRENT ROW),
  re_prior AS (PARTITION BY metric_name, dimensions ORDER BY day
    ROWS BETWEEN %(recent)d + %(prior)d - 1 PRECEDING AND %(recent)d PRECEDING)
"""
# Boosted when yesterday already lay more than two deviations off.
_PERSISTENCE = """
CASE WHEN baseline_std > 1e-9 AND abs((previous_value - baseline_mean) / baseline_std) > 2
  THEN 1.3D ELSE 1.0D END
"""


def series_features(
    metrics: DataFrame, rules: RuleConfig = RuleConfig(), names: tuple[str, ...] | None = None
) -> DataFrame:
    """Every row of ``metrics`` with its rolling statistics."""
    rows = metrics if names is None else metrics.where(F.col("metric_name").isin(*names))
    # Frames need a row at least, and one longer than the lookback decides nothing; a
    # detector with a window below two or beyond the lookback does not fire.
    def rows_of(window: int) -> int:
        return max(1, min(S.LOOKBACK_DAYS + 2, window))

    frames = {
        "lookback": S.LOOKBACK_DAYS,
        "baseline": S.BASELINE_DAYS,
        "w": rows_of(rules.change_point_window),
        "recent": rows_of(rules.regime_recent_days),
        "prior": rows_of(rules.regime_baseline_days),
    }
    features = metrics.sparkSession.sql(_FEATURES % frames, rows=rows)
    return features.withColumn("persistence", F.expr(_PERSISTENCE))


def _last(skip: str, n: str) -> str:
    """SQL: the ``n`` values of the lookback before the last ``skip``; null if there are not so many."""
    return (
        f"if(size(lookback_values) >= {skip} + {n},"
        f" slice(lookback_values, size(lookback_values) - ({skip}) - {n} + 1, {n}), null)"
    )


def _mean(values: str) -> str:
    return f"(aggregate({values}, 0D, (a, v) -> a + v) / size({values}))"


def _variance(values: str) -> str:
    mean = _mean(values)
    return f"(aggregate({values}, 0D, (a, v) -> a + (v - {mean}) * (v - {mean})) / nullif(size({values}) - 1, 0))"


def with_rule_frames(features: DataFrame, rules: Mapping[str, str]) -> DataFrame:
    """Features whose positional frames have the lengths of their own row's rule.

    ``rules`` is SQL for each setting.  Frames that reach beyond the lookback are null.
    """
    w, recent, prior = (
        f"greatest(1, {rules[name]})" for name in ("change_point_window", "regime_recent_days", "regime_baseline_days")
    )
    frames = {
        "cp_recent": _last("0", w), "cp_previous": _last(w, w),
        "regime_recent": _last("0", recent), "regime_prior": _last(recent, prior),
    }
    framed = features.withColumns({f"_{name}": F.expr(values) for name, values in frames.items()})
    found = framed.withColumns({
        f"{name}_{what}": F.expr(of(f"_{name}")) for name in frames for what, of in (("mean", _mean), ("var", _variance))
    })
    return found.drop(*[f"_{name}" for name in frames])


def ready(features: DataFrame) -> DataFrame:
    """Rows with enough history to be judged."""
    return features.where(
        f"n_lookback >= {S.MIN_LOOKBACK_ROWS} AND n_baseline >= {S.MIN_BASELINE_ROWS}"
    )
