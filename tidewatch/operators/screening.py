"""Drift verdicts from sketches, exact only where a sketch leaves them open.

Each (check, day) has a quantile sketch; a report date's week is the merge of
seven.  With F the share of a sample's values up to a point, its sketch gives
every F within a rank error e, and exactly while it holds fewer than k values.
Take the quantiles of both sketches at steps of 1/m.  At any point, the number
of a sketch's quantiles up to it tells its F to less than 2/m, rounded ranks
included, so with the largest difference d of the two numbers, over m, the
distance lies within

    d  -  (e + e' + 2/m)   and   d  +  (e + e' + 2/m).

The verdict stands where both ends give the same one.  The other report dates
are counted value by value (``operators/drift.py``).
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewatch import schemas as S
from tidewatch.functions.ks import ks_p_value
from tidewatch.operators import drift
from tidewatch.operators.calendar import fan_out, within
from tidewatch.sources.staging import stage

# Size of a sketch, about 100 KB.
K = 4096
# Steps of the quantiles that are compared.
_STEPS = 1000
# Published rank error of the sketch at 99 % confidence, a / k^b.
_ERROR, _POWER = 2.446, 0.9433


def rank_error(k: int, margin: float = 2.0) -> float:
    """Rank error allowed for: the published one times ``margin``.

    The published error holds with 99 %, about 2.6 standard deviations; twice
    that is exceeded about once in five million sketches.
    """
    return margin * _ERROR / k**_POWER


def day_sketches(events: DataFrame, checks: dict[str, str] = S.DRIFT_CHECKS, k: int = K) -> DataFrame:
    """``name``, ``event_date``, ``sketch``, ``n``, ``n_nan`` of the values of each check and day."""
    # The sketch takes no NaN, the largest value: it goes in as infinity and is counted.
    nan = F.isnan("value")
    known = F.when(nan, F.lit(float("inf"))).otherwise(F.col("value"))
    name = drift.check_of(checks)
    return events.where(name.isNotNull()).groupBy(name.alias("name"), "event_date").agg(
        F.kll_sketch_agg_double(known, k).alias("sketch"),
        F.count(F.lit(1)).alias("n"),
        F.count_if(nan).alias("n_nan"),
    )


def distance_bounds(
    sketches: DataFrame,
    start: date | None = None,
    end: date | None = None,
    k: int = K,
    min_sample: int = S.DRIFT_MIN_SAMPLE,
) -> DataFrame:
    """Both ends of the distance per check and report date, ``ks_low`` and ``ks_high``, with the sample sizes."""
    spread = sketches.select("*", fan_out("event_date", "report_date", 0, S.BASELINE_DAYS))
    own = F.col("report_date") == F.col("event_date")

    def sample(side: Column, name: str) -> list[Column]:
        return [
            F.kll_merge_agg_double(F.when(side, F.col("sketch"))).alias(f"_{name}"),
            F.coalesce(F.sum(F.when(side, F.col("n"))), F.lit(0)).cast("bigint").alias(f"n_{name}"),
            F.coalesce(F.sum(F.when(side, F.col("n_nan"))), F.lit(0)).alias(f"_nan_{name}"),
        ]

    both = (
        spread.where(within(F.col("report_date"), start, end))
        .groupBy("name", "report_date")
        .agg(*sample(own, "current"), *sample(~own, "baseline"))
        .where((F.col("n_current") >= min_sample) & (F.col("n_baseline") >= min_sample))
    )
    # One literal, not a thousand.
    steps = F.split(F.lit(",".join(str(i / _STEPS) for i in range(_STEPS + 1))), ",").cast("array<double>")

    def points(side: str, current: int) -> Column:
        quantiles = F.kll_sketch_get_quantile_double(f"_{side}", steps)
        return F.transform(quantiles, lambda q: F.struct(q.alias("value"), F.lit(current).alias("is_current")))

    sizes = ["n_current", "n_baseline", "_nan_current", "_nan_baseline"]
    run = ["report_date", "name", *sizes]
    # Some two thousand rows per check and report date.
    placed = both.select(*run, F.inline(F.concat(points("current", 1), points("baseline", 0))))
    upto = Window.partitionBy(*run).orderBy("value").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = F.abs(F.sum(2 * F.col("is_current") - 1).over(upto)) / _STEPS
    gaps = placed.withColumn("_ahead", ahead).groupBy(*run).agg(F.max("_ahead").alias("_gap"))

    def error(size: str) -> Column:
        return F.when(F.col(size) < k, 0.0).otherwise(rank_error(k))

    # Values up to infinity are all but the NaN ones, which are counted exactly.
    at_nan = F.abs(F.col("_nan_current") / F.col("n_current") - F.col("_nan_baseline") / F.col("n_baseline"))
    slack = error("n_current") + error("n_baseline") + F.lit(2 / _STEPS)
    return gaps.select(
        "report_date", "name", "n_current", "n_baseline",
        F.greatest(F.lit(0.0), F.col("_gap") - slack, at_nan).alias("ks_low"),
        F.least(F.lit(1.0), F.greatest(F.col("_gap") + slack, at_nan)).alias("ks_high"),
    )


def screened_drift(
    events: DataFrame,
    sketches: DataFrame | None = None,
    start: date | None = None,
    end: date | None = None,
    checks: dict[str, str] = S.DRIFT_CHECKS,
    k: int = K,
) -> DataFrame:
    """Drift verdicts per check and report date with the bounds of the distance and what decided, ``sketch`` or ``exact``.

    ``sketches`` are kept ones of size ``k`` that hold all of ``events``; without
    them they are made here.  Absent where a sample is too small.
    """
    if sketches is None:
        sketches = day_sketches(events, checks, k)
    bounds = distance_bounds(sketches, start, end, k)

    def drifted(distance: str) -> Column:
        return ks_p_value(F.col(distance), F.col("n_current"), F.col("n_baseline")) < S.DRIFT_P_VALUE

    verdict = F.when(drifted("ks_low"), True).when(~drifted("ks_high"), False)
    kind = F.coalesce(*[F.when(F.col("name") == n, F.lit(of)) for n, of in checks.items()])
    # One row per check and report date.
    judged = stage(
        bounds.select(
            "report_date", "name", kind.alias("event_type"), "n_current", "n_baseline", "ks_low", "ks_high",
            verdict.alias("drifted"), F.lit("sketch").alias("decided_by"),
        ),
        "screened-drift",
    )
    settled = F.col("drifted").isNotNull()
    unsettled = judged.where(~settled).select("name", "report_date")
    days = unsettled.select("name", fan_out("report_date", "event_date", -S.BASELINE_DAYS, 0)).distinct()
    dates = [row[0] for row in days.select("event_date").distinct().collect()]
    if not dates:
        return judged
    # One row per check and day; as literals the dates prune the scan.
    counted = drift.value_counts(events.where(F.col("event_date").isin(dates)), checks)
    counted = counted.join(F.broadcast(days), ["name", "event_date"], "left_semi")
    exact = drift.drift_of_counts(counted, start, end, checks).join(
        F.broadcast(unsettled), ["name", "report_date"], "left_semi"
    )
    exact = exact.select(
        "report_date", "name", "event_type", "n_current", "n_baseline",
        F.col("ks_stat").alias("ks_low"), F.col("ks_stat").alias("ks_high"), "drifted", F.lit("exact").alias("decided_by"),
    )
    return judged.where(settled).unionByName(exact)
