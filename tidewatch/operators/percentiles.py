"""Exact continuous percentiles per day without holding a day in one task.

1. each day is sketched, which brackets every wanted rank between two values;
2. everything outside the brackets is only counted, distinct values inside
   them are kept with their counts, a few per ten thousand of the day, and
   written once, cut into ranges ("slots") of about equal size;
3. running totals of the slots, a few numbers per slot, tell which slots hold
   the wanted ranks; only those are read and ranked.

The answer is exact; the sketch only decides how much has to be kept.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewatch.functions.scores import any_of
from tidewatch.sources.staging import stage_in_slots

# Ranks are sketched to 1/ACCURACY of the day; brackets are four times as wide.
ACCURACY = 10_000
_BRACKET = 4.0


def cut_points(probabilities: list[float], accuracy: int = ACCURACY) -> list[float]:
    """The shares of a day that bracket each wanted rank."""
    slack = _BRACKET / accuracy
    return [min(1.0, max(0.0, p + side)) for p in probabilities for side in (-slack, slack)]


def sketched_cuts(value: Column, probabilities: list[float], accuracy: int = ACCURACY) -> Column:
    """Aggregate: the values at the cut points, about."""
    # NaN is the largest value, above infinity; the sketch knows both as infinity.
    known = F.when(F.isnan(value), F.lit(float("inf"))).otherwise(value)
    return F.percentile_approx(known, cut_points(probabilities, accuracy), accuracy)


def zone_and_kept(
    value: Column, n: Column, cuts: Column, probabilities: int, accuracy: int = ACCURACY
) -> tuple[Column, Column]:
    """Where a value lies among the brackets of its day, and the value itself if inside one."""
    infinity, nan = F.lit(float("inf")), F.lit(float("nan"))
    # A wanted rank lies within two ranks of its share of the day and a sketched one
    # within 1/accuracy, so from ``accuracy`` values on a bracket holds its ranks;
    # below that the bracket is the whole day.
    short = n < accuracy
    pairs = []
    for i in range(probabilities):
        low, high = cuts[2 * i], cuts[2 * i + 1]
        pairs.append((
            F.when(short, float("-inf")).otherwise(low),
            F.when(short | (high == infinity), nan).otherwise(high),
        ))
    inside = any_of([(value >= low) & (value <= high) for low, high in pairs])
    zone = reduce(add, [(value >= low).cast("int") + (value > high).cast("int") for low, high in pairs])
    return zone, F.when(inside, value)


def _kept(rows: DataFrame, day: str, value: Column, probabilities: list[float], accuracy: int) -> DataFrame:
    """Per day: counts of the zones outside the brackets and of each value inside."""
    values = rows.select(F.col(day).alias("_day"), value.cast("double").alias("_v")).where(
        F.col("_v").isNotNull()
    )
    brackets = values.groupBy("_day").agg(
        F.count(F.lit(1)).alias("_n"), sketched_cuts(F.col("_v"), probabilities, accuracy).alias("_cuts")
    )
    zone, kept = zone_and_kept(F.col("_v"), F.col("_n"), F.col("_cuts"), len(probabilities), accuracy)
    # One row per calendar day: a few thousand rows whatever the data volume.
    return (
        values.join(F.broadcast(brackets), "_day")
        .groupBy("_day", "_n", zone.alias("_zone"), kept.alias("_kept"))
        .agg(F.count(F.lit(1)).alias("_c"))
    )


def daily_percentiles(
    rows: DataFrame,
    day: str,
    value: Column,
    wanted: dict[str, float],
    accuracy: int = ACCURACY,
    slots: int | None = None,
) -> DataFrame:
    """One row per day with a column per entry of ``wanted`` (name -> 0..1).

    Nulls are ignored; days without a value are absent.  Interpolates linearly
    between neighbouring ranks.  NaN ranks above infinity, and a percentile that
    falls on it is NaN.
    """
    return ranked_percentiles(_kept(rows, day, value, list(wanted.values()), accuracy), day, wanted, slots)


def ranked_percentiles(kept: DataFrame, day: str, wanted: dict[str, float], slots: int | None = None) -> DataFrame:
    """The percentiles of days whose values are counted by zone and kept value.

    ``kept`` has ``_day``, ``_n`` (values of the day), ``_zone``, ``_kept`` and ``_c`` (how many).
    """
    probabilities = list(wanted.values())
    slotted = stage_in_slots(kept, "ranked-values", ["_day", "_zone", "_kept"], "_slot", slots)

    places = [(F.col("_n") - 1) * F.lit(p) for p in probabilities]
    ranks = [rank for place in places for rank in (F.floor(place), F.ceil(place))]
    before, upto = F.col("_before"), F.col("_upto")

    def holds(rank: Column) -> Column:
        return (before <= rank) & (rank < upto)

    # At most one row per slot and day.
    totals = slotted.groupBy("_day", "_n", "_slot").agg(F.sum("_c").alias("_c"))
    by_slot = Window.partitionBy("_day").orderBy("_slot")
    to_here = by_slot.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    needed = (
        totals.withColumn("_upto", F.sum("_c").over(to_here))
        .withColumn("_before", F.col("_upto") - F.col("_c"))
        .where(any_of([holds(rank) for rank in ranks]))
        .select("_day", "_slot", F.col("_before").alias("_base"))
    )
    in_slot = (
        Window.partitionBy("_day", "_slot")
        .orderBy("_zone", "_kept")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    ranked = (
        slotted.join(needed, ["_day", "_slot"])
        .withColumn("_upto", F.col("_base") + F.sum("_c").over(in_slot))
        .withColumn("_before", F.col("_upto") - F.col("_c"))
    )
    picks = [
        F.max(F.when(holds(rank), F.col("_kept"))).alias(f"_r{i}") for i, rank in enumerate(ranks)
    ]
    out = [F.col("_day").alias(day)]
    for i, (name, place) in enumerate(zip(wanted, places)):
        low, high = F.col(f"_r{2 * i}"), F.col(f"_r{2 * i + 1}")
        between = low + (high - low) * (place - F.floor(place))
        # Equal infinities have no difference.
        out.append(F.when(low == high, low).otherwise(between).alias(name))
    return ranked.groupBy("_day", "_n").agg(*picks).select(*out)
