"""Rule settings of the anomaly suite: stored rows over the defaults.

``load_rules`` gives the latest row, ``rules_in_force`` the row that held on each
day.  Detectors take the settings as SQL, literals or columns.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidewatch import schemas as S

RULE_NAME = "anomaly_rules"


@dataclass(frozen=True)
class RuleConfig:
    """Defaults are the seeded rule; each missing or malformed key falls back."""

    rule_version: str = "v1"
    ewma_lambda: float = 0.3
    ewma_limit: float = 3.0
    change_point_window: int = 7
    change_point_z: float = 3.0
    seasonal_min_points: int = 3
    seasonal_z: float = 3.0
    regime_recent_days: int = 7
    regime_baseline_days: int = 14
    regime_z: float = 3.0
    regime_var_ratio: float = 2.0


_NUMBERS = [f for f in fields(RuleConfig) if f.name != "rule_version"]
# A frame longer than the lookback never fires, so whole numbers are taken as this at most.
_LONGEST = S.LOOKBACK_DAYS + 2


def _whole(f) -> bool:
    return isinstance(getattr(RuleConfig(), f.name), int)


def as_literals(rules: RuleConfig) -> dict[str, str]:
    """Each setting as SQL text."""
    found = {"rule_version": "'" + rules.rule_version.replace("\\", "\\\\").replace("'", "\\'") + "'"}
    for f in _NUMBERS:
        value = getattr(rules, f.name)
        found[f.name] = f"{max(-1, min(_LONGEST, value))}" if _whole(f) else f"double('{value!r}')"
    return found


def as_columns(struct: str) -> dict[str, str]:
    """Each setting as a field of the column ``struct``."""
    return {f.name: f"{struct}.{f.name}" for f in fields(RuleConfig)}


def seed_rules(spark: SparkSession) -> DataFrame:
    """The default rule as a one-row rules table."""
    defaults = RuleConfig()
    numbers = F.struct(*[F.lit(getattr(defaults, f.name)).alias(f.name) for f in _NUMBERS])
    return spark.range(1).select(
        F.lit(RULE_NAME).alias("rule_name"),
        F.lit(defaults.rule_version).alias("rule_version"),
        F.to_json(numbers).alias("config"),
        F.lit("1970-01-01").cast("timestamp").alias("updated_at"),
    )


def seed_if_absent(rules: DataFrame, seed: DataFrame) -> DataFrame:
    """Existing rules plus the seed rows whose name is not yet there."""
    return rules.unionByName(seed.join(rules, "rule_name", "left_anti"))


def _settings(version: Column, config: Column) -> list[Column]:
    """All settings of a stored row; what is absent or cannot be converted takes its default.

    Whole numbers beyond any frame are cut to one that cannot fire.
    """
    defaults = RuleConfig()
    columns = [F.coalesce(version, F.lit(defaults.rule_version)).alias("rule_version")]
    for f in _NUMBERS:
        stored = F.get_json_object(config, f"$.{f.name}").try_cast("double")
        if _whole(f):
            finite = F.abs(stored) < float("inf")
            stored = F.when(finite, F.greatest(F.lit(-1.0), F.least(F.lit(float(_LONGEST)), stored)))
        default = F.lit(float(getattr(defaults, f.name)))
        columns.append(F.coalesce(stored, default).cast("int" if _whole(f) else "double").alias(f.name))
    return columns


def effective_rules(rules: DataFrame) -> DataFrame:
    """One row: the latest settings, defaults filled in; all defaults without a row."""
    latest = rules.where(F.col("rule_name") == RULE_NAME).agg(
        F.max_by(F.struct("rule_version", "config"), "updated_at").alias("row")
    )
    return latest.select(*_settings(F.col("row")["rule_version"], F.col("row")["config"]))


def rules_in_force(rules: DataFrame, days: DataFrame) -> DataFrame:
    """For each of ``days`` (column ``day``) the settings of the last row updated up to its end, as ``rule``.

    Days before the first row have the defaults.  Runs over one row per
    calendar day, hence the single ordered window.
    """
    by_day = rules.where(F.col("rule_name") == RULE_NAME).groupBy(F.to_date("updated_at").alias("day")).agg(
        F.max_by(F.struct("rule_version", "config"), "updated_at").alias("_row")
    )
    so_far = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    timeline = days.select("day").distinct().withColumn("_asked", F.lit(True)).join(by_day, "day", "full")
    row = F.last("_row", ignorenulls=True).over(so_far)
    asked = timeline.withColumn("_row", row).where("_asked")
    return asked.select("day", F.struct(*_settings(F.col("_row")["rule_version"], F.col("_row")["config"])).alias("rule"))


def load_rules(rules: DataFrame) -> RuleConfig:
    """The one effective row as a value: window lengths are part of the plan."""
    return RuleConfig(**effective_rules(rules).first().asDict())
