"""Toxicity by a classifier chain over the words of whole texts.

Categories are predicted one after the other by logistic regressions; each gets
the probabilities of the earlier ones as further inputs.  In training those are
out-of-fold predictions, so that a later model meets them as it will in use.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DoubleType, LongType, StructField, StructType

from tidewatch.llm.batches import ALNUM_LOWER, encode, flat, owners, slices, words
from tidewatch.llm.linear import Marks, fit_marks, sigmoid
from tidewatch.sources.staging import stage

# Labelled rows the chain is fitted on, at most; they also bound the words it looks for.
MAX_LABELLED = 20_000
# Documents a word must occur in to be looked for, and how far its toxic share must be above that of all
# at least, in standard errors; more if there are many words.
MIN_DOCUMENTS = 5
MIN_TELLING = 3.0
# The verdict needs at least this probability, and no more than the other, however few rows taught it.
THRESHOLDS = (0.2, 0.5)


@dataclass(frozen=True)
class Chain:
    """Words looked for and, per category, the weights (words, earlier categories, intercept)."""

    words: tuple[bytes, ...]
    categories: tuple[str, ...]
    weights: tuple[np.ndarray, ...]
    threshold: float

    def probabilities(self, x: Marks) -> np.ndarray:
        """One column per category, the verdict's last."""
        for w in self.weights:
            x = x.with_column(sigmoid(x.times(w[:-1]) + w[-1]))
        return x.dense


def presence(data: np.ndarray, offsets: np.ndarray, known: dict[bytes, int]) -> tuple[Marks, np.ndarray, np.ndarray]:
    """Which of the known words each text has; how often it has any of them; its words."""
    texts = len(offsets) - 1
    bounds, found = words(data, offsets, ALNUM_LOWER)
    nothing = np.zeros(0, np.int64)
    row, column = nothing, nothing
    if len(found) and known:
        codes, distinct = encode(found)
        numbers = np.array([known.get(w, -1) for w in distinct], np.int64)[codes]
        hit = np.flatnonzero(numbers >= 0)
        row, column = np.searchsorted(bounds, hit, side="right") - 1, numbers[hit]
    once = np.unique(row * max(len(known), 1) + column)
    marks = Marks(once // max(len(known), 1), once % max(len(known), 1), len(known), np.zeros((texts, 0)))
    return marks, np.bincount(row, minlength=texts), np.diff(bounds)


def fit_chain(x: Marks, y: np.ndarray, folds: int = 3) -> tuple[list[np.ndarray], np.ndarray]:
    """Weights per column of ``y``, and the out-of-fold probabilities.  Row i is in fold i mod ``folds``."""
    fold = np.arange(len(x)) % folds
    weights = []
    for k in range(y.shape[1]):
        weights.append(fit_marks(x, y[:, k]))
        out = np.zeros(len(x))
        for f in range(folds):
            held = fold == f
            w = fit_marks(x.only(~held), y[~held, k])
            out[held] = sigmoid(x.only(held).times(w[:-1]) + w[-1])
        # Later categories are taught by these, as they will meet them in use.
        x = x.with_column(out)
    return weights, x.dense


def best_threshold(p: np.ndarray, positive: np.ndarray) -> float:
    """The probability from which calling a row positive gives the largest F1, within ``THRESHOLDS``."""
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(positive[order])
    f1 = 2 * hits / (np.arange(1, len(p) + 1) + positive.sum())
    ends = np.append(np.diff(p[order]) != 0, True)
    at = int(np.argmax(np.where(ends, f1, -1.0)))
    low = p[order][at + 1] if at + 1 < len(p) else 0.0
    return float(np.clip((p[order][at] + low) / 2, *THRESHOLDS))


def learn_chain(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = MAX_LABELLED,
    id_column: str = "doc_id", text_column: str = "text",
) -> Chain:
    """A chain learned from at most ``most`` labelled documents, those with the smallest hashes.

    The words looked for are all whose share among toxic documents is telling,
    that is far above their share among all.  ``labels`` knows one category; two
    graver ones are made of how large a part of a toxic document such words are:
    ``severe`` from the densest tenth of the toxic documents on, ``insult`` from
    their median on.  The chain does not see that: its inputs are which words a
    text has, not how often, nor how long it is.  They lead to ``toxic``.
    """
    nothing = Chain((), ("severe", "insult", "toxic"), (np.array([-50.0]), np.array([0.0, -50.0]), np.array([0.0, 0.0, -50.0])), 0.5)
    chosen = (
        labels.where(F.col(id_column).isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col(id_column).alias("_id"))
        .agg(F.max(F.col(label).cast("int")).alias("_label"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(most)
    )
    own = docs.select(F.col(f"`{id_column}`").alias("_id"), F.col(f"`{text_column}`").cast("string").alias("_text"))
    sample = stage(own.join(F.broadcast(chosen), "_id").select("_id", "_label", "_text"), "toxic-sample")
    sizes = sample.agg(F.count("*"), F.coalesce(F.sum("_label"), F.lit(0))).first()
    if not sizes[1] or sizes[0] == sizes[1]:
        return nothing

    def word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 2):
            bounds, found = words(*flat(part.column(2)), ALNUM_LOWER)
            codes, distinct = encode(found)
            toxic = part.column(1).to_numpy() > 0
            once = np.unique(owners(bounds) * max(len(distinct), 1) + codes)
            text, code = once // max(len(distinct), 1), once % max(len(distinct), 1)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(distinct, pa.binary()),
                    pa.array(np.bincount(code, minlength=len(distinct))),
                    pa.array(np.bincount(code, toxic[text], minlength=len(distinct)).astype(np.int64)),
                ],
                names=["word", "n", "t"],
            )

    # How far the toxic share of a word's documents is above that of all, in standard errors.
    share = float(sizes[1]) / float(sizes[0])
    telling = (F.col("t") - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share))
    common = (
        sample.mapInArrow(word_rows, StructType([StructField("word", BinaryType()), StructField("n", LongType()), StructField("t", LongType())]))
        .groupBy("word")
        .agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
        .where(F.col("n") >= MIN_DOCUMENTS)
        .select("word", telling.alias("telling"))
    )
    common = stage(common, "common-words")
    # Of many words some lie far above by chance: the largest of m normal numbers is about this.
    chance = math.sqrt(2.0 * math.log(max(common.count(), 1)))
    # Words of the bounded sample.
    top = common.where(F.col("telling") >= max(MIN_TELLING, chance)).orderBy(F.desc("telling"), "word").collect()
    known = {bytes(r["word"]): i for i, r in enumerate(top)}

    def feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 2):
            x, often, size = presence(*flat(part.column(2)), known)
            ends = np.searchsorted(x.rows, np.arange(part.num_rows + 1))
            marks = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x.marks, pa.int64()))
            dense = often / np.maximum(size, 1)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), marks, pa.array(dense)], names=["_id", "_label", "marks", "dense"]
            )

    # At most ``most`` rows of a few numbers; repeated rows of a document count once.
    schema = StructType([
        *sample.schema.fields[:2], StructField("marks", ArrayType(LongType())), StructField("dense", DoubleType())
    ])
    table = sample.mapInArrow(feature_rows, schema).dropDuplicates(["_id"]).toArrow().sort_by("_id").combine_chunks()
    toxic = table.column("_label").to_numpy() > 0
    if not toxic.any() or toxic.all():
        return nothing
    marks = table.column("marks").to_pylist()
    rows = np.repeat(np.arange(len(marks)), [len(m) for m in marks])
    x = Marks(rows, np.array([m for own in marks for m in own], np.int64), len(known), np.zeros((len(marks), 0)))
    dense = table.column("dense").to_numpy()
    severe, insult = np.quantile(dense[toxic], (0.9, 0.5))
    y = np.column_stack([toxic & (dense >= severe), toxic & (dense >= insult), toxic])
    weights, out_of_fold = fit_chain(x, y)
    return Chain(tuple(known), nothing.categories, tuple(weights), best_threshold(out_of_fold[:, -1], toxic))


def judge(docs: DataFrame, chain: Chain, keep: list[str], text_column: str = "text") -> DataFrame:
    """Columns ``keep``, ``p_<category>`` for each category of the chain, and ``toxic``.

    A null or empty text has none of the words.  Repeated rows are judged each;
    columns named like the results are replaced by them.
    """
    names = [f"p_{c}" for c in chain.categories]
    keep = [c for c in keep if c.lower() not in (*names, "toxic")]
    rows = docs.select(
        F.col(f"`{text_column}`").cast("string").alias("_text"),
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_kept"),
    )
    known = {w: i for i, w in enumerate(chain.words)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 0):
            p = chain.probabilities(presence(*flat(part.column(0)), known)[0])
            columns = [pa.array(np.ascontiguousarray(c)) for c in p.T]
            yield pa.RecordBatch.from_arrays(
                [part.column(1), *columns, pa.array(p[:, -1] >= chain.threshold)], names=["_kept", *names, "toxic"]
            )

    schema = StructType([
        rows.schema["_kept"], *[StructField(n, DoubleType()) for n in names], StructField("toxic", BooleanType())
    ])
    judged = rows.mapInArrow(run, schema)
    return judged.select(*[F.col(f"_kept.`{c}`").alias(c) for c in keep], *names, "toxic")
