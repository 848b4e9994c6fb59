"""Quality rules: decision lists learned from labelled statistics of whole texts.

Sequential covering in the manner of RIPPER: a rule is a conjunction of
thresholds, grown on one part of the labelled rows by information gain, pruned
on the other, and the rows it covers are set aside for the next one.  The list
becomes ordered Spark conditional expressions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidewatch.llm.batches import WHITE, binary_array, flat, owners, per_text, slices, words

# Labelled rows that rules are learned from, at most.
MAX_LABELLED = 20_000

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE_COUNTS = ("n_lines", "n_digits", "n_upper", "n_marks", "n_distinct_words")
# What rules may test: parts of the text, so that they hold for any length.
FEATURES = {
    "n_words": "n_words",
    "mean_word_chars": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_word_share": "n_repeat_words / greatest(n_words, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "mark_share": "n_marks / greatest(word_chars, 1)",
    "distinct_word_share": "n_distinct_words / greatest(n_words, 1)",
}

_SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_DIGITS = np.isin(np.arange(256), np.arange(0x30, 0x3A))
_UPPER = np.isin(np.arange(256), np.arange(0x41, 0x5B))
_MARKS = np.isin(np.arange(256), np.frombuffer(b".,;:!?\"'()-", np.uint8))


def text_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Counts of ``COUNTS`` and ``MORE_COUNTS`` for each text."""
    bounds, found = words(data, offsets, WHITE)
    inside = WHITE[data] != 0x20
    codes = np.asarray(found.dictionary_encode().indices, np.int64)
    text_of = owners(bounds)
    line_counts = _lines(data, offsets, inside)
    return {
        "n_words": np.diff(bounds),
        "word_chars": per_text(inside & ((data & 0xC0) != 0x80), offsets),
        "n_symbols": per_text(_SYMBOLS[data], offsets),
        "n_dup_lines": line_counts[0],
        "n_repeat_words": per_text(_repeated(codes, text_of, 3), bounds),
        "n_lines": line_counts[1],
        "n_digits": per_text(_DIGITS[data], offsets),
        "n_upper": per_text(_UPPER[data], offsets),
        "n_marks": per_text(_MARKS[data], offsets),
        "n_distinct_words": _distinct(codes, text_of, len(offsets) - 1),
    }


def _distinct(codes: np.ndarray, text_of: np.ndarray, texts: int) -> np.ndarray:
    """Number of distinct codes in each text."""
    base = int(codes.max()) + 1 if len(codes) else 1
    return np.bincount(np.unique(text_of * base + codes) // base, minlength=texts)


def _lines(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word that equal an earlier line of their text, and all lines with a word."""
    texts = len(offsets) - 1
    breaks = np.flatnonzero(data == 0x0A)
    # A line ends at a break or at the end of its text; without the break bytes, lines lie end to end.
    text_ends = offsets[1:] - np.searchsorted(breaks, offsets[1:])
    line_ends = np.sort(np.concatenate((breaks - np.arange(len(breaks)), text_ends)), kind="stable")
    line_text = np.repeat(np.arange(texts), np.searchsorted(breaks, offsets[1:]) - np.searchsorted(breaks, offsets[:-1]) + 1)
    line_bounds = np.concatenate(([0], line_ends))
    kept = data != 0x0A
    worded = per_text(inside[kept], line_bounds) > 0
    codes = np.asarray(binary_array(data[kept], line_bounds).dictionary_encode().indices, np.int64)
    codes, line_text = codes[worded], line_text[worded]
    lines = np.bincount(line_text, minlength=texts)
    return lines - _distinct(codes, line_text, texts), lines


def _repeated(codes: np.ndarray, text_of: np.ndarray, size: int) -> np.ndarray:
    """Whether each word lies in a window of ``size`` words found twice or more in its text."""
    flags = np.zeros(len(codes), bool)
    if len(codes) < size:
        return flags
    last = len(codes) - size + 1
    distinct = int(codes.max()) + 1
    key, range_ = codes[:last], distinct
    for k in range(1, size):
        if range_ > (1 << 62) // distinct:
            key = np.unique(key, return_inverse=True)[1]
            range_ = int(key.max()) + 1
        key = key * distinct + codes[k : k + last]
        range_ *= distinct
    whole = np.flatnonzero(text_of[:last] == text_of[size - 1 :])
    key, owner = key[whole], text_of[whole]
    order = np.lexsort((key, owner))
    same = (key[order][1:] == key[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    again = np.zeros(len(order), bool)
    again[1:] |= same
    again[:-1] |= same
    for k in range(size):
        flags[whole[order[again]] + k] = True
    return flags


def count_texts(docs: DataFrame, keep: list[str], text_column: str = "text") -> DataFrame:
    """Columns ``keep`` of ``docs`` with the counts of each whole text; null counts as empty."""
    names = [*COUNTS, *MORE_COUNTS]
    rows = docs.select(
        F.col(f"`{text_column}`").cast("string").alias("_text"),
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_kept"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 0):
            counts = text_counts(*flat(part.column(0)))
            yield pa.RecordBatch.from_arrays(
                [part.column(1), *[pa.array(counts[n], pa.int64()) for n in names]], names=["_kept", *names]
            )

    schema = StructType([rows.schema["_kept"], *[StructField(n, LongType()) for n in names]])
    counted = rows.mapInArrow(run, schema)
    return counted.select(
        *[F.col(f"_kept.`{c}`").alias(c) for c in keep if c.lower() not in names], *names
    )


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    value: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.value if self.above else x[self.feature] <= self.value

    def column(self) -> Column:
        feature = F.expr(FEATURES[self.feature]).cast("double")
        return feature >= F.lit(self.value) if self.above else feature <= F.lit(self.value)

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<='} {self.value:.6g}"


Rule = tuple[Condition, ...]


def learn_rules(
    x: dict[str, np.ndarray],
    bad: np.ndarray,
    folds: np.ndarray,
    max_conditions: int = 3,
    max_rules: int = 12,
    min_covered: int = 5,
    min_precision: float = 0.9,
) -> list[Rule]:
    """Ordered rules that cover bad rows.

    ``folds`` (0 to 2) deals rows to growing (1 and 2) and pruning (0).  A rule
    is kept if at least ``min_precision`` of the rows it covers are bad in both
    parts, so a bad row that looks like good ones stays uncovered.
    """
    left = np.ones(len(bad), bool)
    rules: list[Rule] = []
    while len(rules) < max_rules:
        grow, prune = left & (folds != 0), left & (folds == 0)
        rule = _prune(_grow(x, bad, grow, max_conditions), x, bad, prune)
        covered = _covers(rule, x)
        good_enough = all(
            (part & covered).sum() >= least and bad[part & covered].mean() >= min_precision
            for part, least in ((grow, min_covered), (prune, 1))
        )
        if not rule or not good_enough:
            break
        rules.append(rule)
        left &= ~covered
    return rules


def _covers(rule: Rule, x: dict[str, np.ndarray]) -> np.ndarray:
    covered = np.ones(len(next(iter(x.values()))), bool)
    for condition in rule:
        covered &= condition.holds(x)
    return covered


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, rows: np.ndarray, most: int) -> Rule:
    """Add the threshold with the largest information gain until only bad rows are covered."""
    rule: Rule = ()
    covered = rows.copy()
    while len(rule) < most:
        p, n = bad[covered].sum(), (~bad[covered]).sum()
        if not p or not n:
            break
        before = np.log2(p / (p + n))
        best = (1e-9, None)
        for feature in sorted(x):
            values, is_bad = x[feature][covered], bad[covered]
            order = np.argsort(values, kind="stable")
            values, is_bad = values[order], is_bad[order]
            steps = np.flatnonzero(np.diff(values) > 0)
            below = np.cumsum(is_bad)[steps]
            for above in (False, True):
                hit = p - below if above else below
                size = len(values) - steps - 1 if above else steps + 1
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(hit > 0, hit * (np.log2(hit / size) - before), 0.0)
                if len(gain) and gain.max() > best[0]:
                    at = steps[int(gain.argmax())]
                    best = (float(gain.max()), Condition(feature, above, float((values[at] + values[at + 1]) / 2)))
        if best[1] is None:
            break
        rule = (*rule, best[1])
        covered &= best[1].holds(x)
    return rule


def _prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray, rows: np.ndarray) -> Rule:
    """Drop last conditions while the rest does better on the pruning rows."""

    def worth(candidate: Rule) -> float:
        covered = rows & _covers(candidate, x)
        p, n = bad[covered].sum(), (~bad[covered]).sum()
        return (p - n) / max(p + n, 1)

    best = rule
    for size in range(len(rule) - 1, 0, -1):
        if worth(rule[:size]) > worth(best):
            best = rule[:size]
    return best


def labelled_counts(
    docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = MAX_LABELLED,
    id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """Counts of the texts of at most ``most`` labelled rows, those with the smallest hashes."""
    chosen = (
        labels.where(F.col(id_column).isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col(id_column).alias("_id"))
        .agg(F.min(F.col(label).cast("int")).alias("_label"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(most)
    )
    own = docs.select(F.col(f"`{id_column}`").alias("_id"), F.col(f"`{text_column}`").alias("_text"))
    return count_texts(own.join(F.broadcast(chosen), "_id"), ["_id", "_label"], "_text")


def learn_from(counted: DataFrame, **settings) -> list[Rule]:
    """Rules from labelled counts (a bounded table); label 0 is bad."""
    features = [F.expr(f).cast("double").alias(n) for n, f in FEATURES.items()]
    table = counted.select("_id", "_label", *features).toArrow()
    table = table.sort_by([(n, "ascending") for n in ("_id", *FEATURES)])
    x = {n: table.column(n).to_numpy() for n in FEATURES}
    ids = table.column("_id").to_numpy()
    if not len(ids):
        return []
    bad = table.column("_label").to_numpy() == 0
    # Rows are dealt to the parts by place, bad and good ones apart.
    folds = np.where(bad, np.cumsum(bad), np.cumsum(~bad)) % 3
    return learn_rules(x, bad, folds, **settings)


def first_rule(rules: list[Rule]) -> Column:
    """Number of the first rule that holds (from 1), null if none does."""
    number = F.lit(None).cast("int")
    for k, rule in reversed(list(enumerate(rules, start=1))):
        holds = rule[0].column()
        for condition in rule[1:]:
            holds = holds & condition.column()
        number = F.when(holds, F.lit(k)).otherwise(number)
    return number


def base_failed(min_words: int = 50, repeat_percent: int = 50) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))


def judge(docs: DataFrame, rules: list[Rule], keep: list[str], text_column: str = "text") -> DataFrame:
    """Columns ``keep``, the counts, ``base_failed``, ``rule`` (first that holds) and ``kept``.

    A null or empty text has no words and fails the base rules.  Repeated rows
    are judged each; columns named like the results are replaced by them.
    """
    counted = count_texts(docs, [c for c in keep if c.lower() not in ("base_failed", "rule", "kept")], text_column)
    rule = first_rule(rules)
    return counted.select(
        "*", base_failed().alias("base_failed"), rule.alias("rule"), (~base_failed() & rule.isNull()).alias("kept")
    )
