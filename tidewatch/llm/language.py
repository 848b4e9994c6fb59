"""Language by hierarchical discrimination: the family first, then the language within it.

Texts are counted as hashed byte pairs and triples.  Linear support vector
machines, one for each two classes, vote for a family and then, among the
languages of that family, for a language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tidewatch.llm.batches import ALNUM_LOWER, flat, owners, per_text, slices
from tidewatch.llm.linear import fit_linear, margins, sigmoid

# Documents per language the machines are fitted on, at most.
MAX_PER_LANGUAGE = 600
BUCKETS = 1024
UNKNOWN = "und"

# Families of the languages; one that is missing here is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "fy", "lb", "yi"),
    "romance": ("fr", "es", "pt", "it", "ro", "ca", "gl", "oc", "la"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "mk", "sr", "hr", "bs", "sl"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
}


@dataclass(frozen=True)
class Machines:
    """One machine for each two classes; its positive side is the first."""

    classes: tuple[str, ...]
    pairs: tuple[tuple[int, int, np.ndarray], ...]

    def choose(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the class with the most votes (ties: the summed margins), and its mean probability."""
        votes = np.zeros((len(x), len(self.classes)))
        sure = np.zeros_like(votes)
        for a, b, w in self.pairs:
            p = sigmoid(2.0 * margins(x, w))
            votes[:, a] += p >= 0.5
            votes[:, b] += p < 0.5
            sure[:, a] += p
            sure[:, b] += 1.0 - p
        rivals = max(len(self.classes) - 1, 1)
        best = np.argmax(votes + sure / (rivals + 1), axis=1)
        score = sure[np.arange(len(x)), best] / rivals if self.pairs else np.ones(len(x))
        return best, score


@dataclass(frozen=True)
class Discriminator:
    families: Machines
    languages: dict[str, Machines]

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        family, sure = self.families.choose(x)
        chosen = np.empty(len(x), object)
        score = np.zeros(len(x))
        for k, name in enumerate(self.families.classes):
            rows = np.flatnonzero(family == k)
            if len(rows):
                within = self.languages[name]
                best, p = within.choose(x[rows])
                chosen[rows] = [within.classes[b] for b in best]
                score[rows] = sure[rows] * p
        return chosen.tolist(), np.clip(score, 0.0, 1.0)


def profile(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Square roots of the shares of hashed byte pairs and triples of each text, length 1.

    A-Z count as a-z, and everything that is neither letter nor digit as a space.
    """
    texts = len(offsets) - 1
    counts = np.zeros(texts * BUCKETS)
    mapped = ALNUM_LOWER[data].astype(np.uint32)
    if len(mapped):
        # One row of the matrix per text; a text's last bytes begin no pair or triple.
        row = owners(offsets).astype(np.uint32) * np.uint32(BUCKETS)
        gram = mapped.copy()
        for size in (2, 3):
            if len(data) < size:
                break
            gram = (gram[:-1] << np.uint32(8)) | mapped[size - 1 :]
            inside = row[: len(gram)] == row[size - 1 :]
            bucket = (gram * np.uint32(2654435761)) >> np.uint32(22)
            counts += np.bincount((row[: len(gram)] + bucket)[inside], minlength=len(counts))
    x = np.sqrt(counts.reshape(texts, BUCKETS))
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def has_letter(texts: pa.Array, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text has a letter of any script."""
    folded = data | 0x20
    plain = per_text((folded >= 0x61) & (folded <= 0x7A), offsets) > 0
    for k in np.flatnonzero(~plain & (per_text(data >= 0x80, offsets) > 0)):
        plain[k] = any(map(str.isalpha, texts[int(k)].as_py() or ""))
    return plain


def fit_machines(x: np.ndarray, named: np.ndarray) -> Machines:
    classes = tuple(sorted(set(named.tolist())))
    pairs = []
    for a, b in combinations(range(len(classes)), 2):
        rows = (named == classes[a]) | (named == classes[b])
        pairs.append((a, b, fit_linear(x[rows], named[rows] == classes[a], "hinge", l2=1e-4, steps=200, even=False)))
    return Machines(classes, tuple(pairs))


def fit_discriminator(x: np.ndarray, languages: np.ndarray) -> Discriminator:
    family_of = {lang: family for family, members in FAMILIES.items() for lang in members}
    family = np.array([family_of.get(lang, f"only {lang}") for lang in languages], object)
    return Discriminator(
        fit_machines(x, family),
        {name: fit_machines(x[family == name], languages[family == name]) for name in sorted(set(family.tolist()))},
    )


def learn(
    docs: DataFrame, learnable: Column, most: int = MAX_PER_LANGUAGE,
    id_column: str = "doc_id", text_column: str = "text", language_column: str = "lang",
) -> Discriminator | None:
    """A discriminator from at most ``most`` documents per language, those with the smallest hashes.

    Only rows with ``learnable``, a language and a text count; None without any.
    """
    own = docs.where(learnable & F.col(language_column).isNotNull() & F.col(text_column).isNotNull()).select(
        F.col(f"`{id_column}`").alias("_id"),
        F.col(f"`{language_column}`").cast("string").alias("_lang"),
        F.col(f"`{text_column}`").cast("string").alias("_text"),
    )
    sizes = {r["_lang"]: r["count"] for r in own.groupBy("_lang").count().collect()}
    if not sizes:
        return None
    # A hash below a language's share lets about twice the wanted rows pass; the window then takes the first.
    grain = 1 << 30
    pass_below = F.lit(0)
    for lang, n in sorted(sizes.items()):
        pass_below = F.when(F.col("_lang") == lang, F.lit(min(grain, grain * (2 * most + 100) // n))).otherwise(pass_below)
    own = own.withColumn("_hash", F.pmod(F.xxhash64("_id", F.lit("lang")), F.lit(grain))).where(F.col("_hash") < pass_below)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 3):
            x = profile(*flat(part.column(3))).astype(np.float32)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), part.column(2), pa.FixedSizeListArray.from_arrays(x.ravel(), BUCKETS).cast(pa.list_(pa.float32()))],
                names=["_id", "_lang", "_hash", "x"],
            )

    rows = own.select("_id", "_lang", "_hash", "_text")
    first = Window.partitionBy("_lang").orderBy("_hash", "_id")
    fields = ", ".join(f"{n} {t}" for n, t in rows.dtypes[:3])
    table = (
        rows.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= most).select(*rows.columns)
        .mapInArrow(run, f"{fields}, x array<float>")
        .toArrow()
    )
    table = table.take(pc.sort_indices(table.select(["_lang", "_hash", "_id"]), [(n, "ascending") for n in ("_lang", "_hash", "_id")]))
    x = table.column("x").combine_chunks().flatten().to_numpy().reshape(-1, BUCKETS).astype(float)
    return fit_discriminator(x, np.array(table.column("_lang").to_pylist(), object))


def predict(
    docs: DataFrame, model: Discriminator | None, keep: list[str], text_column: str = "text"
) -> DataFrame:
    """Columns ``keep``, ``lang_pred`` and ``score`` (0 to 1) from whole texts.

    ``und`` with score 0 if the text is null or has no letter, or nothing was
    learned.  Repeated rows are judged each; columns named like the results are
    replaced by them.
    """
    keep = [c for c in keep if c.lower() not in ("lang_pred", "score")]
    rows = docs.select(
        F.col(f"`{text_column}`").cast("string").alias("_text"),
        F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_kept"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 0):
            data, offsets = flat(part.column(0))
            known = has_letter(part.column(0), data, offsets)
            if model is None:
                known[:] = False
            named, score = model.predict(profile(data, offsets)) if known.any() else ([UNKNOWN] * len(known), np.zeros(len(known)))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(1),
                    pa.array([n if k else UNKNOWN for n, k in zip(named, known)], pa.string()),
                    pa.array(np.where(known, score, 0.0)),
                ],
                names=["_kept", "lang_pred", "score"],
            )

    schema = StructType([rows.schema["_kept"], StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    judged = rows.mapInArrow(run, schema)
    return judged.select(*[F.col(f"_kept.`{c}`").alias(c) for c in keep], "lang_pred", "score")
