"""The most frequent keys of each day among too many different ones to shuffle.

1. each day has a frequent-items summary of fixed size; summaries merge, so
   they may be kept and added to (``streaming/summaries.py``).  A key that a
   summary does not list occurs at most as often as its least listed estimate;
2. only listed keys are counted by themselves, all others together, which the
   tasks that read them can add up: a few numbers per day are shuffled;
3. a day is proven if no other key occurs, or if the summary has seen all of the
   day and the last wanted key occurs more often than any other one can.  The
   days left are counted key by key.

The result is exact; the summary only decides how much is shuffled.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window, functions as F

from tidewatch import schemas as S
from tidewatch.operators.quality import top_counted_keys
from tidewatch.sources.staging import stage

# Keys a summary tracks, whatever the data: some 300 KB.  Keys below about 2 in 10,000
# occurrences of a day are not told apart; a day whose wanted keys are as rare is counted whole.
TRACKED = 16_384
# Keys counted by themselves, per wanted one.
_LISTED = 4


def property_keys(events: DataFrame) -> DataFrame:
    """``event_date``, ``key``: top-level property keys, one row each; rows without a day left out."""
    dated = events.where(F.col("event_date").isNotNull())
    return dated.select("event_date", F.explode(F.json_object_keys("properties")).alias("key"))


def key_summaries(keys: DataFrame, tracked: int = TRACKED) -> DataFrame:
    """``event_date``, ``summary``, ``n_keys``: one row per day."""
    return keys.groupBy("event_date").agg(
        F.expr(f"approx_top_k_accumulate(key, {tracked})").alias("summary"),
        F.count(F.lit(1)).alias("n_keys"),
    )


def listed_counts(
    keys: DataFrame, summaries: DataFrame, limit: int = S.TOP_PROPERTY_KEYS, tracked: int = TRACKED
) -> tuple[DataFrame, list[date]]:
    """Exact counts of the listed keys, and the days that they do not settle."""
    listed = stage(
        summaries.select(
            "event_date", "n_keys", F.expr(f"approx_top_k_estimate(summary, {min(_LISTED * limit, tracked)})").alias("listed")
        ),
        "listed-keys",
    )
    # A few rows per day; written, so that the join below knows how few.
    wanted = stage(listed.select("event_date", F.explode("listed.item").alias("key"), F.lit(True).alias("_listed")), "wanted-keys")
    counted = stage(
        keys.join(wanted, ["event_date", "key"], "left")
        .groupBy("event_date", F.when(F.col("_listed"), F.col("key")).alias("key"))
        .agg(F.count(F.lit(1)).alias("count")),
        "key-counts",
    )
    alone = F.col("key").isNotNull()
    ranked = top_counted_keys(counted.where(alone), limit)
    last = ranked.where(F.col("rank") == limit).select("event_date", F.col("count").alias("_last"))
    seen = counted.groupBy("event_date").agg(
        F.sum("count").alias("_seen"), F.count_if(~alone).alias("_others")
    )
    least = listed.select("event_date", "n_keys", F.array_min("listed.count").alias("_least"))
    # One row per calendar day on every side.
    judged = seen.join(F.broadcast(least), "event_date", "left").join(F.broadcast(last), "event_date", "left")
    beyond = (F.col("n_keys") == F.col("_seen")) & (F.col("_last") > F.col("_least"))
    proven = (F.col("_others") == 0) | F.coalesce(beyond, F.lit(False))
    unsettled = [row[0] for row in judged.where(~proven).select("event_date").collect()]
    return counted.where(alone), unsettled


def top_keys(
    keys: DataFrame,
    limit: int = S.TOP_PROPERTY_KEYS,
    summaries: DataFrame | None = None,
    tracked: int = TRACKED,
) -> DataFrame:
    """``event_date``, ``key``, ``count``, ``rank``: the most frequent keys per day; equal counts by key.

    ``keys`` has a row per occurrence.  Without ``summaries`` they are made here,
    in a pass of their own; ones that lack late rows cost time, never a key.
    Rows without a day or key count for nothing.
    """
    keys = keys.where(F.col("event_date").isNotNull() & F.col("key").isNotNull()).select("event_date", "key")
    if summaries is None:
        summaries = key_summaries(keys, tracked)
    counted, unsettled = listed_counts(keys, summaries, limit, tracked)
    if unsettled:
        open_day = F.col("event_date").isin(unsettled)
        whole = keys.where(open_day).groupBy("event_date", "key").agg(F.count(F.lit(1)).alias("count"))
        counted = counted.where(~open_day).unionByName(whole)
    return top_counted_keys(counted, limit)
