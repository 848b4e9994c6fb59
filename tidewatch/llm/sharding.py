"""Proportional stratified interleaving: shards that all have the mixture of the table.

Rows are shuffled by a seeded hash within their source, ranked, and ordered by
fractional rank ``(rank - 1/2) / rows of the source``; the order is cut into
shards of equal row counts.  Only DataFrame functions are used.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from tidewatch.sources.staging import stage

# Rows that are ranked in one window; more rows make more windows.
WINDOW_ROWS = 5_000


def interleave(
    rows: DataFrame,
    shards: int,
    source: str = "source",
    order: tuple[str, ...] = ("doc_id",),
    seed: int = 0,
    window_rows: int = WINDOW_ROWS,
) -> DataFrame:
    """``rows`` with ``shard`` (0 to ``shards`` - 1) and ``slot`` (gapless from 0 in its shard).

    Row counts of two shards differ by one at most, and of a source by two at
    most.  ``order`` names the columns that tell rows apart; equal rows are
    interchangeable.  A null source is a source of its own.  Columns named ``shard``
    or ``slot`` are replaced; an empty table stays empty.  Ranks are taken in
    windows of about ``window_rows`` rows: the hash of a row names its window,
    so a source that holds most rows has windows in many tasks.  Pass narrow
    rows: everything given here is shuffled twice.
    """
    carried = [c for c in rows.columns if c.lower() not in ("shard", "slot")]
    keys = [F.col(f"`{c}`") for c in order]
    # Null and text sources as one text without clashes.
    src = F.coalesce(F.concat(F.lit("="), F.col(f"`{source}`").cast("string")), F.lit(""))
    base = rows.select(
        F.struct(*[F.col(f"`{c}`") for c in carried]).alias("_row"),
        src.alias("_src"),
        F.xxhash64(F.lit(seed), *keys).alias("_hash"),
        F.struct(*keys).alias("_tie"),
    )
    base = stage(base, "shard-rows")
    total = base.count()
    windows = max(1, math.ceil(total / window_rows))

    base = base.withColumn("_win", F.pmod("_hash", F.lit(windows)))
    before, ranked = _ranks(base, ["_src"], "_win", ["_hash", "_tie"])
    count = before.groupBy("_src").agg(F.sum("_n").alias("_total"))
    ranked = ranked.join(
        before.join(count, "_src").select("_src", "_win", "_before", "_total"), ["_src", "_win"]
    )
    place = (2 * (F.col("_before") + F.col("_within")) - 1) / (2 * F.col("_total"))
    mixed = ranked.select("_row", "_src", "_hash", "_tie", place.alias("_frac"))
    mixed = stage(mixed, "shard-ranks").withColumn("_win", F.floor(F.col("_frac") * windows))

    before, ranked = _ranks(mixed, [], "_win", ["_frac", "_src"])
    at = (F.col("_before") + F.col("_within") - 1).alias("_at")
    placed = ranked.join(before.select("_win", "_before"), "_win").select("_row", at)
    shard = f"_at * {shards}L div {max(total, 1)}L"
    start = f"(({shard}) * {total}L + {shards - 1}L) div {shards}L"
    return placed.select(
        *[F.col(f"_row.`{c}`").alias(c) for c in carried],
        F.expr(shard).cast("int").alias("shard"),
        (F.col("_at") - F.expr(start)).alias("slot"),
    )


def _ranks(rows: DataFrame, group: list[str], window: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows before each window of a group, and each row's rank within its window."""
    key = [*group, window]
    sizes = rows.groupBy(*key).agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*group).orderBy(window).rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    ranked = rows.withColumn("_within", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    return before, ranked


def write_shards(rows: DataFrame, path: str) -> None:
    """One folder per shard, rows in slot order; a shard may span several files."""
    (
        rows.repartitionByRange("shard", "slot")
        .sortWithinPartitions("shard", "slot")
        .write.partitionBy("shard")
        .parquet(path)
    )
