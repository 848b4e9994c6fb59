"""License scans by diagonal voting.

All rolling word k-grams of the texts meet, in a Spark join, the places where
the templates have them.  Hits on one diagonal (place in the text minus place
in the template) vote for a passage; neighbouring diagonals are merged, so that
a word more or less does not break a passage.  The words of each span are
compared with the template, and where spans overlap the one with most of its
words wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import BinaryType, BooleanType, DoubleType, IntegerType, LongType, StructField, StructType

from tidewatch.llm.batches import ALNUM_LOWER, encode, flat, slices, words
from tidewatch.sources.staging import stage

K = 2
# Phrases whose every place counts, and their labels.
PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}
# Passages that may differ in some words, and the labels they add.
PASSAGES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "licensed under the apache license version 2 0": "apache",
    "gnu general public license as published by the free software foundation": "gpl",
    "gnu lesser general public license as published by the free software foundation": "lgpl",
    "gnu affero general public license as published by the free software foundation": "agpl",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "subject to the terms of the mozilla public license": "mpl",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "licensed under a creative commons attribution": "cc-by",
    "made available under the terms of the eclipse public license": "epl",
}
# Words that may be put in or left out at one place: diagonals this far apart at most belong to one
# passage.  Both are tried, so that a stray hit beside a passage does not stretch it out of bounds.
NEIGHBOURS = (2, 8)
# So much of a passage must be there.
COVERED = 0.75
# A span is at most so many times as long as its template.
LONGER = 2.0
# Grams sent to the join at once, and texts whose spans are verified at once.
GRAM_ROWS = 200_000
SPAN_TEXTS = 1024


def gram_hashes(word_hashes: np.ndarray, k: int = K) -> np.ndarray:
    """Hash of each run of ``k`` words, from the hashes of the words."""
    runs = len(word_hashes) - k + 1
    mixed = np.zeros(max(runs, 0), np.uint64)
    for at in range(k if runs > 0 else 0):
        mixed = (mixed ^ word_hashes[at : at + runs]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return mixed


def word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


def template_places(templates: dict[str, str], phrases: int) -> list[tuple]:
    """Rows (gram, template, place, grams of the template, whether it is a phrase)."""
    rows = []
    for number, text in enumerate(templates):
        hashes = np.array([word_hash(w.encode()) for w in text.split()], np.uint64)
        grams = gram_hashes(hashes).astype(np.int64).tolist()
        rows += [(g, number, place, len(grams), number < phrases) for place, g in enumerate(grams)]
    return rows


def vocabulary(templates: list[str]) -> dict[bytes, int]:
    """Numbers from 1 of the templates' words; 0 is any other word."""
    distinct = dict.fromkeys(w.encode() for text in templates for w in text.split())
    return {w: number for number, w in enumerate(distinct, 1)}


def matched(template: list, span: list) -> list[int]:
    """Places of the template whose words are in the span, in the same order: as many as possible."""
    most = np.zeros((len(template) + 1, len(span) + 1), np.int64)
    for i in range(len(template) - 1, -1, -1):
        for j in range(len(span) - 1, -1, -1):
            same = template[i] == span[j]
            most[i, j] = most[i + 1, j + 1] + 1 if same else max(most[i + 1, j], most[i, j + 1])
    places, i, j = [], 0, 0
    while i < len(template) and j < len(span):
        if template[i] == span[j]:
            places.append(i)
            i, j = i + 1, j + 1
        elif most[i + 1, j] >= most[i, j + 1]:
            i += 1
        else:
            j += 1
    return places


def telling_words(templates: list[str], labels: list[str]) -> list[set[str]]:
    """Per template the words without which it could be one of another label."""
    parts = [text.split() for text in templates]
    found = []
    for own, label in zip(parts, labels):
        telling = set()
        for other, its in zip(parts, labels):
            common = matched(own, other)
            if its != label and len(common) >= COVERED * len(own):
                telling |= {w for at, w in enumerate(own) if at not in common}
        found.append(telling)
    return found


def _text_grams(docs: DataFrame, keep: str, text_column: str, templates: list[str]) -> DataFrame:
    """Rows (id, key, place, gram, near) for all k-grams, and one row with place -1 whose gram is the number of words.

    ``key`` tells rows with equal ids and other texts apart.  ``near`` has, for
    grams of the templates, the words from there on, by their numbers in the
    ``vocabulary``, as far as a span can go.
    """
    known = vocabulary(templates)
    wanted = np.array(sorted({row[0] for row in template_places(dict.fromkeys(templates), 0)}), np.int64)
    reach = int(LONGER * max((len(text.split()) for text in templates), default=0))
    rows = docs.select(F.col(f"`{keep}`").alias("id"), F.col(f"`{text_column}`").cast("string").alias("text"))
    schema = StructType([
        StructField("id", rows.schema["id"].dataType), StructField("key", LongType()),
        StructField("place", IntegerType()), StructField("gram", LongType()), StructField("near", BinaryType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1, 1 << 20):
            data, offsets = flat(part.column(1))
            bounds, found = words(data, offsets, ALNUM_LOWER)
            codes, distinct = encode(found)
            hashes = np.array([word_hash(w) for w in distinct], np.uint64)
            numbers = np.array([known.get(bytes(w), 0) for w in distinct], "<u4")[codes] if len(codes) else np.zeros(0, "<u4")
            grams = gram_hashes(hashes[codes]).astype(np.int64) if len(codes) else np.zeros(0, np.int64)
            texts, ends = len(offsets) - 1, bounds[1:]
            # A gram must end in the text it begins in.
            counts = np.maximum(np.diff(bounds) - K + 1, 0)
            place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            row = np.concatenate((np.arange(texts), np.repeat(np.arange(texts), counts)))
            at = np.repeat(bounds[:-1], counts) + place
            values = np.concatenate((ends - bounds[:-1], grams[at]))
            places = np.concatenate((np.full(texts, -1), place)).astype(np.int32)
            # Only grams of the templates need the words that follow, up to the end of the text.
            follow = np.where(np.isin(grams[at], wanted), np.minimum(reach, np.repeat(ends, counts) - at), 0)
            starts, follow = np.concatenate((np.zeros(texts, np.int64), at)), np.concatenate((np.zeros(texts, np.int64), follow))
            keys = np.array([xxhash.xxh3_64_intdigest(data[a:b]) for a, b in zip(offsets[:-1], offsets[1:])], np.uint64).astype(np.int64)
            for begin in range(0, len(row), GRAM_ROWS):
                cut = slice(begin, begin + GRAM_ROWS)
                sizes = follow[cut]
                tops = np.cumsum(sizes)
                flowing = numbers[np.repeat(starts[cut], sizes) + np.arange(sizes.sum()) - np.repeat(tops - sizes, sizes)]
                bytes_at = (np.concatenate(([0], tops)) * flowing.itemsize).astype(np.int32)
                near = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(bytes_at), pa.py_buffer(flowing)])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(row[cut])), pa.array(keys[row[cut]]), pa.array(places[cut]), pa.array(values[cut]), near],
                    names=schema.names,
                )

    return rows.mapInArrow(run, schema)


def find_passages(
    docs: DataFrame,
    phrases: dict[str, str] = PHRASES,
    passages: dict[str, str] = PASSAGES,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """The texts (id, key, copies, n_words) and the verified spans found in them.

    Spans: id, key, ``label``, ``phrase`` (whether it is a place of a phrase),
    ``first_word`` and ``last_word`` (both inclusive), ``covered`` (part of the
    template's words that is there, in order), ``outdone`` (whether a phrase is
    inside a passage with another label).  Every word of a phrase must be there,
    on one diagonal; a passage needs ``COVERED`` of its grams, on neighbouring
    diagonals, ``COVERED`` of its words, in order, and all words that tell it
    from templates of other labels.  Where passages share more than half of the
    shorter one, only the one with most words stays.  Templates need two words
    at least.
    """
    spark = docs.sparkSession
    templates = {**phrases, **passages}
    places = spark.createDataFrame(
        template_places(templates, len(phrases)),
        "gram long, template int, at int, grams int, phrase boolean",
    )
    grams = _text_grams(docs, id_column, text_column, list(templates))
    # The templates are arguments, some hundred rows; their places are broadcast.
    hits = (
        grams.join(F.broadcast(places), "gram", "left")
        .where((F.col("place") < 0) | F.col("template").isNotNull())
        .select("id", "key", "place", F.when(F.col("place") < 0, F.col("gram")).alias("n_words"),
                *[F.when(F.col("place") >= 0, F.col(c)).alias(c) for c in ("template", "at", "grams", "phrase")],
                F.when(~F.col("phrase"), F.col("near")).alias("near"),
                (F.col("place") - F.col("at")).alias("diagonal"))
    )
    # Votes: what one diagonal of one template has in one text.  A repeated row votes
    # for the same places, so places are counted once.
    voted = hits.groupBy("id", "key", "template", "diagonal", "grams", "phrase").agg(
        F.collect_set("at").alias("ats"),
        F.min_by("near", "at").alias("near"),
        F.max("n_words").alias("n_words"),
        F.sum(F.when(F.col("place") < 0, 1).otherwise(0)).alias("copies"),
    )
    # Only a diagonal with a few votes can be part of a passage.
    voted = voted.where("template is null or phrase or size(ats) >= least(2, grams)")
    # A row per text and a few per passage: read three times, so written once.
    voted = stage(voted, "license-votes")
    return voted.where("template is null").select("id", "key", "copies", "n_words"), _verified(
        voted.where("template is not null"), list(templates), list(templates.values()), len(phrases)
    )


def _verified(votes: DataFrame, templates: list[str], labels: list[str], phrases: int) -> DataFrame:
    span_columns = ["template", "phrase", "first_word", "last_word", "near"]
    exact = votes.where("phrase and size(ats) = grams").select(
        "id", "key", "template", "phrase", F.col("diagonal").alias("first_word"),
        (F.col("diagonal") + F.col("grams") + K - 2).alias("last_word"), "near",
    )
    # Diagonals next to each other make one passage; two passages in a row lie a template apart.
    own = Window.partitionBy("id", "key", "template").orderBy("diagonal")
    gap = F.col("diagonal") - F.lag("diagonal").over(own)
    groups = [
        F.sum(F.when(gap <= F.least(F.lit(most), F.col("grams")), 0).otherwise(1)).over(own).alias(f"run{most}")
        for most in NEIGHBOURS
    ]
    each = F.explode(F.array(*[F.struct(F.lit(most).alias("most"), F.col(f"run{most}").alias("run")) for most in NEIGHBOURS]))
    grouped = votes.where("not phrase").select("*", *groups).select("*", each.alias("_way"))
    merged = (
        grouped.groupBy("id", "key", "template", "_way", "phrase", "grams")
        .agg(
            F.size(F.array_distinct(F.flatten(F.collect_list("ats")))).alias("there"),
            F.min(F.col("diagonal") + F.array_min("ats")).alias("first_word"),
            (F.max(F.col("diagonal") + F.array_max("ats")) + K - 1).alias("last_word"),
            F.min_by("near", F.col("diagonal") + F.array_min("ats")).alias("near"),
        )
    )
    # Enough of it, and in a span about as long as the template.
    span = F.col("last_word") - F.col("first_word") + 1
    kept = merged.where((F.col("there") / F.col("grams") >= COVERED) & (span <= LONGER * (F.col("grams") + K - 1)))
    found = kept.select("id", "key", *span_columns).dropDuplicates(["id", "key", "template", "first_word", "last_word"])
    spans = exact.select("id", "key", *span_columns).unionByName(found)
    return _outdone(spans.groupBy("id", "key").agg(F.collect_list(F.struct(*span_columns)).alias("spans")), templates, labels, phrases)


def winners(spans: list[tuple]) -> list[tuple]:
    """Of spans (words there, covered, template, first word, last word) those that no better one shares its words with.

    Better is the one with more words, then the better covered one.  Two that
    share at most half of the shorter one both stay.
    """
    left: dict[int, list[tuple]] = {}
    longest = max((s[4] - s[3] + 1 for s in spans), default=1)
    stay = []
    for s in sorted(spans, key=lambda s: (-s[0], -s[1], s[2], s[3])):
        cells = range(s[3] // longest, s[4] // longest + 1)
        met = [o for c in range(cells.start, cells.stop) for o in left.get(c, ())]
        if all(2 * (min(s[4], o[4]) - max(s[3], o[3]) + 1) <= min(s[4] - s[3], o[4] - o[3]) + 1 for o in met):
            stay.append(s)
            for c in cells:
                left.setdefault(c, []).append(s)
    return stay


def _outdone(texts: DataFrame, templates: list[str], labels: list[str], phrases: int) -> DataFrame:
    """Compares the words of the passages of each text with the templates, and lets the best of each place stay."""
    known = vocabulary(templates)
    numbers = [[known[w.encode()] for w in text.split()] for text in templates]
    own = slice(phrases, None)
    telling = [set()] * phrases + [{known[w.encode()] for w in ws} for ws in telling_words(templates[own], labels[own])]
    schema = StructType([
        texts.schema["id"], texts.schema["key"], StructField("template", IntegerType()), StructField("phrase", BooleanType()),
        StructField("first_word", IntegerType()), StructField("last_word", IntegerType()), StructField("covered", DoubleType()),
        StructField("outdone", BooleanType()),
    ])

    def verified(found: list[dict]) -> list[tuple]:
        passages = []
        for s in found:
            if not s["phrase"]:
                t, words_there = s["template"], np.frombuffer(s["near"], "<u4")[: s["last_word"] - s["first_word"] + 1].tolist()
                n = len(matched(numbers[t], words_there))
                if n >= COVERED * len(numbers[t]) and telling[t] <= set(words_there):
                    passages.append((n, n / len(numbers[t]), t, s["first_word"], s["last_word"]))
        stay = winners(passages)
        rows = [(t, False, first, last, covered, False) for _, covered, t, first, last in stay]
        # Which passage, if any, each word of the text is in.
        inside = {at: s for s in stay for at in range(s[3], s[4] + 1)}
        for s in found:
            if s["phrase"]:
                around = inside.get(s["first_word"])
                outdone = around is not None and around is inside.get(s["last_word"]) and labels[around[2]] != labels[s["template"]]
                rows.append((s["template"], True, s["first_word"], s["last_word"], 1.0, outdone))
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, SPAN_TEXTS):
                part = batch.slice(begin, SPAN_TEXTS)
                per_text = [verified(found) for found in part.column(2).to_pylist()]
                rows = [row for found in per_text for row in found]
                at = pa.array(np.repeat(np.arange(len(per_text)), [len(found) for found in per_text]))
                columns = list(zip(*rows)) or [()] * 6
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(at), part.column(1).take(at),
                     *[pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.float64(), pa.bool_()))]],
                    names=schema.names,
                )

    label = F.element_at(F.array(*[F.lit(x) for x in labels]), F.col("template") + 1)
    return texts.mapInArrow(run, schema).select(
        "id", "key", label.alias("label"), "phrase", "first_word", "last_word", "covered", "outdone"
    )


def _joined(labels: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **templates) -> DataFrame:
    """One row per row of ``docs``: places of the phrases, labels and a score.

    ``n_words``; ``n_base``, ``first_word`` and ``last_word`` (places of the
    phrases, and their smallest and largest start, null without any);
    ``base_labels`` and ``labels`` (those of the passages too, but not those of
    phrases inside a passage with another label: an LGPL notice has the phrase
    of the GPL), distinct, sorted and comma-joined; ``score``, the largest
    covered part (0 without any).  A null text is empty.  Repeated rows and null ids keep a row each; other
    columns are ignored.
    """
    texts, spans = find_passages(docs, id_column=id_column, text_column=text_column, **templates)
    base = F.when(F.col("phrase"), F.col("first_word"))
    # Texts come as spans without a label: one grouping gives both, without a join.
    both = texts.select("id", "key", "copies", "n_words", *[
        F.lit(None).cast(t).alias(c)
        for c, t in (("label", "string"), ("phrase", "boolean"), ("first_word", "int"), ("covered", "double"), ("outdone", "boolean"))
    ]).unionByName(spans.select("id", "key", "label", "phrase", "first_word", "covered", "outdone"), allowMissingColumns=True)
    found = both.groupBy("id", "key").agg(
        F.max("copies").alias("copies"),
        F.max("n_words").alias("n_words"),
        F.count(base).cast("long").alias("n_base"),
        F.min(base).cast("long").alias("first_word"),
        F.max(base).cast("long").alias("last_word"),
        _joined(F.collect_set(F.when(F.col("phrase"), F.col("label")))).alias("base_labels"),
        _joined(F.collect_set(F.when(~F.col("outdone"), F.col("label")))).alias("labels"),
        F.coalesce(F.max("covered"), F.lit(0.0)).alias("score"),
    )
    return found.select(
        F.col("id").alias(id_column), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score",
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy"),
    ).drop("_copy")
