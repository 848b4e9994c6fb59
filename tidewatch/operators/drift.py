"""Distribution drift: each day's values against the seven days before.

The Kolmogorov-Smirnov distance needs both samples in one value order, for
every report date at once.  The work is cut so that no sample is ever held or
sorted in one task:

1. values are counted per (check, day, value) and written once, cut into
   value ranges ("slots") of about equal numbers of rows; each slot is cut
   further at sketched quantiles into "cells" of about equal numbers of rows;
2. cell totals per day, a few numbers per cell, are spread over the report
   dates they count for; their running sums give both distribution functions
   at every cell end, hence a distance already reached and an upper limit for
   the inside of each cell;
3. only cells whose limit exceeds the reached distance are read value by value.
   Two samples of one distribution lie about 1/sqrt(n) apart, so a few
   thousand cells leave little to read.

The result is the exact distance.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewatch import schemas as S
from tidewatch.functions.ks import ks_p_value
from tidewatch.operators.calendar import fan_out, within
from tidewatch.sources.staging import stage, stage_in_slots

_RUN = ["name", "report_date"]
_CELL = ["slot", "cell"]
# Cells of a check over all its slots, about.
_CELLS = 16_384


def _checks(checks: dict[str, str]) -> Column:
    """Check name of an event type, null for unchecked types."""
    kind = F.col("event_type")
    return F.coalesce(*[F.when(kind == of, F.lit(name)) for name, of in checks.items()])


def check_of(checks: dict[str, str]) -> Column:
    """The check an event's value counts for, null for none."""
    return F.when(F.col("value").isNotNull(), _checks(checks))


def value_counts(events: DataFrame, checks: dict[str, str] = S.DRIFT_CHECKS) -> DataFrame:
    """Counts per (check, day, value): ``name``, ``event_date``, ``value``, ``n``."""
    return (
        events.where(F.col("event_type").isin(*checks.values()) & F.col("value").isNotNull())
        .groupBy(check_of(checks).alias("name"), "event_date", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _both_samples(counts: DataFrame, keys: list[str], start: date | None, end: date | None) -> DataFrame:
    """Counts spread over report dates: ``cur`` of the day itself, ``base`` of the week before."""
    spread = counts.select("*", fan_out("event_date", "report_date", 0, S.BASELINE_DAYS))
    own = F.col("report_date") == F.col("event_date")
    return (
        spread.where(within(F.col("report_date"), start, end))
        .groupBy(*_RUN, *keys)
        .agg(
            F.sum(F.when(own, F.col("n")).otherwise(0)).alias("cur"),
            F.sum(F.when(own, 0).otherwise(F.col("n"))).alias("base"),
        )
    )


def _with_cells(slotted: DataFrame) -> DataFrame:
    """Adds ``cell``: the number of cut points of its slot below a value.

    Cut points are quantiles of the slot's rows, sketched to an eighth of a cell,
    so cells hold about equally many rows whatever the distribution.
    """
    # Slots are folders: none of their columns is read.
    slots = slotted.select("slot").distinct().count()
    cells = max(4, _CELLS // max(1, slots))
    # The sketch knows no NaN, the largest value.
    known = F.when(F.isnan("value"), F.lit(float("inf"))).otherwise(F.col("value"))
    # One literal, not thousands.
    shares = F.split(F.lit(",".join(str(k / cells) for k in range(1, cells))), ",").cast("array<double>")
    cuts = F.array_distinct(F.percentile_approx(known, shares, 8 * cells)).alias("cuts")
    # About _CELLS numbers per check, whatever the data.
    ends = slotted.groupBy("name", "slot").agg(cuts)
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(cells.bit_length()))])
    # Binary search: a step is taken if the cut point before it is below the value.
    cell = F.aggregate(
        steps, F.lit(0), lambda at, step: at + F.when(F.get("cuts", at + step - 1) < F.col("value"), step).otherwise(0)
    )
    return slotted.join(F.broadcast(ends), ["name", "slot"]).withColumn("cell", cell).drop("cuts")


def _limits(celled: DataFrame, start: date | None, end: date | None, min_sample: int) -> DataFrame:
    """Cells of every judged report date with running sums and distance limits."""
    # A few numbers per cell and day, whatever the data volume.
    per_day = celled.groupBy("name", "event_date", *_CELL).agg(F.sum("n").alias("n"))
    both = _both_samples(per_day, _CELL, start, end)
    run = Window.partitionBy(*_RUN)
    upto = run.orderBy(*_CELL).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = both.select(
        "*",
        F.sum("cur").over(run).alias("n_current"),
        F.sum("base").over(run).alias("n_baseline"),
        F.sum("cur").over(upto).alias("cur_to"),
        F.sum("base").over(upto).alias("base_to"),
    ).where((F.col("n_current") >= min_sample) & (F.col("n_baseline") >= min_sample))

    def share(count: Column, side: str) -> Column:
        return count / F.col(f"n_{side}")

    cur_to, base_to = F.col("cur_to"), F.col("base_to")
    cur_from, base_from = cur_to - F.col("cur"), base_to - F.col("base")
    at_end = F.abs(share(cur_to, "current") - share(base_to, "baseline"))
    inside = F.greatest(
        share(cur_to, "current") - share(base_from, "baseline"),
        share(base_to, "baseline") - share(cur_from, "current"),
    )
    bounded = sums.select(
        *_RUN, *_CELL, "n_current", "n_baseline",
        cur_from.alias("cur_from"), base_from.alias("base_from"),
        at_end.alias("at_end"), inside.alias("inside"),
    )
    return bounded.withColumn("reached", F.max("at_end").over(run))


def ks_distances(
    counted: DataFrame,
    start: date | None = None,
    end: date | None = None,
    min_sample: int = S.DRIFT_MIN_SAMPLE,
    slots: int | None = None,
) -> DataFrame:
    """Exact two-sample distance per check and report date with both sample sizes, from value counts."""
    slotted = stage_in_slots(counted.select("name", "event_date", "value", "n"), "value-counts", ["name", "value"], "slot", slots)
    celled = _with_cells(slotted)
    # Report dates x cells rows; written, as it is read twice.
    limits = stage(_limits(celled, start, end, min_sample), "cell-limits")
    sizes = ["n_current", "n_baseline"]
    reached = limits.groupBy(*_RUN, *sizes).agg(F.max("at_end").alias("distance"))
    # Written, so that the join below knows how little there is.
    open_cells = stage(limits.where(F.col("inside") > F.col("reached")), "open-cells")

    days = open_cells.select(
        *_RUN, *_CELL, "cur_from", "base_from", *sizes,
        fan_out("report_date", "event_date", -S.BASELINE_DAYS, 0),
    )
    own = F.col("event_date") == F.col("report_date")
    values = (
        celled.join(days, ["name", *_CELL, "event_date"])
        .groupBy(*_RUN, *_CELL, "cur_from", "base_from", *sizes, "value")
        .agg(
            F.sum(F.when(own, F.col("n")).otherwise(0)).alias("cur"),
            F.sum(F.when(own, 0).otherwise(F.col("n"))).alias("base"),
        )
    )
    # At most one slot of eight days: a fixed fraction of the sample.
    in_cell = (
        Window.partitionBy(*_RUN, *_CELL)
        .orderBy("value")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    cur_to = F.col("cur_from") + F.sum("cur").over(in_cell)
    base_to = F.col("base_from") + F.sum("base").over(in_cell)
    inner = values.select(
        *_RUN, *sizes,
        F.abs(cur_to / F.col("n_current") - base_to / F.col("n_baseline")).alias("distance"),
    )
    return (
        reached.unionByName(inner)
        .groupBy(*_RUN, *sizes)
        .agg(F.max("distance").alias("ks_stat"))
    )


def distribution_drift(
    events: DataFrame,
    start: date | None = None,
    end: date | None = None,
    checks: dict[str, str] = S.DRIFT_CHECKS,
    slots: int | None = None,
) -> DataFrame:
    """Drift checks per report date; absent where a sample is too small."""
    return drift_of_counts(value_counts(events, checks), start, end, checks, slots)


def drift_of_counts(
    counted: DataFrame,
    start: date | None = None,
    end: date | None = None,
    checks: dict[str, str] = S.DRIFT_CHECKS,
    slots: int | None = None,
) -> DataFrame:
    """Drift checks from counts per (check, day, value)."""
    distances = ks_distances(counted, start, end, slots=slots)
    kind = F.coalesce(*[F.when(F.col("name") == n, F.lit(of)) for n, of in checks.items()])
    p = ks_p_value(F.col("ks_stat"), F.col("n_current"), F.col("n_baseline"))
    judged = distances.select(
        "report_date", "name", kind.alias("event_type"), "n_current", "n_baseline", "ks_stat",
        p.alias("p_value"),
    )
    return judged.withColumn("drifted", F.col("p_value") < S.DRIFT_P_VALUE)
