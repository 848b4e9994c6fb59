"""Exact duplicates: group by a 128-bit content hash, compare bytes inside the groups.

Only DataFrame functions are used.  Texts are equal when they are identical
after every run of ASCII white space is replaced by one space; null counts as
empty.  Of equal rows the one with the smallest id stays; null ids come last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.sources.staging import stage

# White space runs that are not already one single space.
_RUNS = "[\\x09-\\x0D][\\x20\\x09-\\x0D]*|\\x20[\\x20\\x09-\\x0D]+"


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), _RUNS, " ")


def label_copies(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    content_hash: Callable[[Column], Column] = F.md5,
) -> DataFrame:
    """One row per row of ``docs``: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    ``keep_id`` is the smallest id among equal texts and ``kept`` marks exactly
    one row of them, also if a row with that id is repeated.  Rows with a null
    id are members like any other; ``keep_id`` is null if all ids of a group
    are.  An empty table gives an empty result; other columns are ignored.

    Copies meet in a partial aggregation by hash and text, so that a text which
    is most of the table leaves each task once.  Only ids and digests are
    joined with the groups; the join splits a hot group (adaptive skew join).
    """
    norm = normalised(F.col(f"`{text_column}`"))
    rows = docs.select(F.col(f"`{id_column}`").alias("id"), norm.alias("norm")).withColumn(
        "hash", content_hash(F.col("norm"))
    )
    texts = rows.groupBy("hash", "norm").agg(F.min("id").alias("keep_id"), F.count("*").alias("n"))
    # Texts of one hash side by side: more than one is a collision.
    groups = texts.groupBy("hash").agg(
        F.min("keep_id").alias("keep_id"), F.sum("n").alias("n"), F.count("*").alias("texts")
    )
    groups = stage(groups, "content-groups")
    members = rows.groupBy("hash", F.sha2("norm", 256).alias("sha"), "id").agg(F.count("*").alias("copies"))
    found = _members(members.join(groups.where("texts = 1").drop("texts"), "hash"), id_column)

    collided = groups.where("texts > 1").select("hash")
    if not collided.isEmpty():
        clash = rows.join(collided, "hash", "left_semi")
        # The bytes decide: groups of the text itself.
        apart = clash.groupBy("norm").agg(F.min("id").alias("keep_id"), F.count("*").alias("n"))
        members = clash.groupBy("norm", F.sha2("norm", 256).alias("sha"), "id").agg(
            F.count("*").alias("copies")
        )
        found = found.unionByName(_members(members.join(apart, "norm"), id_column))
    return found


def _members(joined: DataFrame, id_column: str) -> DataFrame:
    """One row per copy; the first of the rows with the smallest id stays."""
    spread = joined.select("id", "keep_id", "n", "sha", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("i"))
    return spread.select(
        F.col("id").alias(id_column),
        "keep_id",
        F.col("n").alias("group_size"),
        (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("i") == 1)).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def keep_first(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Of equal texts the row with the smallest id stays; among rows with that id,
    one chosen by a hash of the other columns.
    """
    own = F.col(f"`{id_column}`")
    norm = normalised(F.col(f"`{text_column}`"))
    # Maps cannot be ordered or hashed; rows that differ in nothing else are taken as equal.
    others = [F.col(f"`{c}`") for c, kind in docs.dtypes if c != id_column and "map<" not in kind and kind != "variant"]
    order = F.struct(own.isNull(), own, F.xxhash64(*others))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    keyed = docs.select(F.md5(norm).alias("_hash"), norm.alias("_norm"), row.alias("_row"), order.alias("_order"))
    # Hash and text together are the key: equal hashes with other bytes stay apart.
    first = keyed.groupBy("_hash", "_norm").agg(F.min_by("_row", "_order").alias("_row"))
    return first.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
