"""The five anomaly detectors over the series features.

Each detector is a condition and a score with the numbers it explains itself
by.  All of them are evaluated in one projection and the hits exploded; impact,
confidence, severity and risk follow from the hit.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from tidewatch import schemas as S
from tidewatch.functions import scores, text
from tidewatch.operators.series import ready, series_features, with_rule_frames
from tidewatch.sources.rules import RuleConfig, as_columns, as_literals, rules_in_force
from tidewatch.sources.staging import stage

# SQL of each setting.
Rules = Mapping[str, str]


@dataclass(frozen=True)
class Detector:
    """SQL over the features: when it fires, its z, the level impact is measured
    against, and further context fields (``shows``, z included by name)."""

    fires: str
    z: str
    level: str
    shows: dict[str, str]


def z_score(rules: Rules) -> Detector:
    z = "if(baseline_std > 1e-9, (observed - baseline_mean) / baseline_std, 0D)"
    shows = {
        "baseline_mean": "baseline_mean",
        "baseline_std": "baseline_std",
        "z_score": z,
        "baseline_window_days": "n_baseline",
    }
    return Detector(_beyond(z, f"{S.Z_SCORE_LIMIT}D"), z, "baseline_mean", shows)


def _beyond(z: str, limit: str) -> str:
    """NaN is beyond nothing, though it sorts above all numbers."""
    return f"(abs({z}) >= {limit} AND NOT isnan({z}))"


def ewma(rules: Rules) -> Detector:
    """Weighted mean folded over the baseline, oldest first, then today's value."""
    weight = rules["ewma_lambda"]
    before = (
        "aggregate(slice(baseline_values, 2, size(baseline_values)), get(baseline_values, 0),"
        f" (mean, v) -> {weight} * v + (1 - {weight}) * mean)"
    )
    now = f"({weight} * observed + (1 - {weight}) * {before})"
    sigma = f"(baseline_std * sqrt(try_divide({weight}, 2 - {weight})))"
    z = f"if({sigma} > 0, ({now} - baseline_mean) / {sigma}, null)"
    fires = f"n_baseline >= 2 AND {_beyond(z, rules['ewma_limit'])}"
    shows = {
        "ewma": now,
        "baseline_mean": "baseline_mean",
        "baseline_std": "baseline_std",
        "ewma_z": z,
    }
    return Detector(fires, z, "baseline_mean", shows)


def change_point(rules: Rules) -> Detector:
    w = f"greatest(1, {rules['change_point_window']})"
    # Equal lengths on both sides: the pooled variance is the plain mean.
    spread = f"(sqrt((cp_recent_var + cp_previous_var) / 2) * sqrt(2D / {w}))"
    z = f"if({spread} > 0, (cp_recent_mean - cp_previous_mean) / {spread}, null)"
    fires = f"{w} > 1 AND n_lookback >= 2 * {w} AND {_beyond(z, rules['change_point_z'])}"
    shows = {
        "previous_mean": "cp_previous_mean",
        "recent_mean": "cp_recent_mean",
        "change_point_z": z,
        "window": w,
    }
    return Detector(fires, z, "baseline_mean", shows)


def seasonal_decomposition(rules: Rules) -> Detector:
    z = "if(seasonal_std > 0, (observed - seasonal_mean) / seasonal_std, null)"
    fires = f"n_seasonal >= {rules['seasonal_min_points']} AND {_beyond(z, rules['seasonal_z'])}"
    shows = {"seasonal_mean": "seasonal_mean", "seasonal_std": "seasonal_std", "seasonal_z": z}
    return Detector(fires, z, "seasonal_mean", shows)


def regime_shift(rules: Rules) -> Detector:
    recent, prior = (f"greatest(1, {rules[name]})" for name in ("regime_recent_days", "regime_baseline_days"))
    limit = rules["regime_var_ratio"]
    shift = "(regime_recent_mean - regime_prior_mean)"
    z = f"if(regime_prior_var > 0, {shift} / (sqrt(regime_prior_var) / sqrt(double({recent}))), 0D)"
    ratio = "if(regime_prior_var > 0, regime_recent_var / regime_prior_var, double('infinity'))"
    calm = f"(abs({z}) < {rules['regime_z']} AND {ratio} < {limit} AND {ratio} > try_divide(1D, {limit}))"
    fires = f"{recent} > 1 AND {prior} > 1 AND n_lookback >= {recent} + {prior} AND NOT {calm}"
    shows = {
        "prior_mean": "regime_prior_mean",
        "recent_mean": "regime_recent_mean",
        "mean_z": z,
        "prior_var": "regime_prior_var",
        "recent_var": "regime_recent_var",
        "var_ratio": ratio,
    }
    return Detector(fires, z, "regime_prior_mean", shows)


DETECTORS: dict[str, Callable[[Rules], Detector]] = {
    "z_score": z_score,
    "ewma": ewma,
    "change_point": change_point,
    "seasonal_decomposition": seasonal_decomposition,
    "regime_shift": regime_shift,
}

# Context fields known only after a hit is scored.
_SCORED = ("method", "observed", "impact", "confidence", "persistence")
_SHOWN = [f for f in S.ALERT_CONTEXT.fields if f.name not in _SCORED]


def _hit(method: str, detector: Detector) -> str:
    """SQL struct of one detector's hit, null where it does not fire."""
    fields = {"method": f"'{method}'", "z": detector.z, "level": detector.level}
    for f in _SHOWN:
        fields[f.name] = f"cast({detector.shows.get(f.name, 'null')} as {f.dataType.simpleString()})"
    struct = ", ".join(f"'{name}', {sql}" for name, sql in fields.items())
    return f"if({detector.fires}, named_struct({struct}), null)"


def detect(
    metrics: DataFrame,
    rules: RuleConfig = RuleConfig(),
    names: tuple[str, ...] | None = S.WATCHED_METRICS,
    methods: tuple[str, ...] = tuple(DETECTORS),
) -> DataFrame:
    """Anomalies of every series and day: one row per detector that fires.

    ``names=None`` watches every series in ``metrics``.
    """
    return _scored(ready(series_features(metrics, rules, names)), as_literals(rules), methods)


def detect_in_force(
    metrics: DataFrame,
    rules: DataFrame,
    names: tuple[str, ...] | None = S.WATCHED_METRICS,
    methods: tuple[str, ...] = tuple(DETECTORS),
) -> DataFrame:
    """As ``detect``, each day judged by the rule row that held on it.

    ``rules`` are all stored rule rows; a backfill of any range is one job.
    """
    features = series_features(metrics, names=names)
    held = stage(rules_in_force(rules, metrics.select(F.col("metric_date").alias("day"))), "rules-in-force")
    # One row per calendar day.
    joined = features.join(F.broadcast(held), features["metric_date"] == held["day"]).drop("day")
    columns = as_columns("rule")
    return _scored(ready(with_rule_frames(joined, columns)), columns, methods)


def _scored(judged: DataFrame, rules: Rules, methods: tuple[str, ...]) -> DataFrame:
    hits = ", ".join(_hit(m, DETECTORS[m](rules)) for m in methods)
    found = judged.selectExpr(
        "metric_name", "dimensions", "metric_date", "observed", "persistence", f"{rules['rule_version']} AS rule_version",
        f"inline(array_compact(array({hits})))",
    )
    z = F.col("z")
    scored = found.withColumns({
        "impact": scores.impact(F.col("metric_name"), F.col("observed"), F.col("level")),
        "confidence": scores.confidence(z),
    })
    return scored.select(
        "metric_name",
        "dimensions",
        "metric_date",
        scores.severity(z).alias("severity"),
        "rule_version",
        scores.risk(F.col("impact"), F.col("confidence"), F.col("persistence")).alias("risk_score"),
        F.struct(*S.ALERT_CONTEXT.names).alias("context"),
    ).withColumn("message", text.alert_message())
