"""Fill-in-the-middle: documents rearranged as prefix, suffix and middle, and put back.

Secondary sort: every document is cut into pieces of whole units, keyed by the
document and their place in the output.  Pieces are dealt by document and sorted
within partitions, so that each output streams past piece by piece; no task
holds a whole output.  The sections that are found again in the stream are
sorted back within the same partitions and stream past once more, restored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField, StructType

from tidewatch.llm.batches import SPACE, WHITE, flat, slices

# What stands before each section of an output, and their order in each form.
MARKS = {"prefix": b"<P>", "suffix": b"<S>", "middle": b"<M>"}
FORMS = {"psm": ("prefix", "suffix", "middle"), "spm": ("suffix", "prefix", "middle")}

# A piece has at most so many units, and bytes besides the mark.
PIECE_UNITS = 4096
PIECE_BYTES = 32 << 10
# Rows of a batch that is handed back to Spark.
OUT_ROWS = 2048
# Place of each section in the text.
_PLACES = {"prefix": 0, "middle": 1, "suffix": 2}


def unit_ends(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the units of all texts end in ``data``: words with the white space before them, and white space at an end."""
    if not len(data):
        return np.zeros(0, np.int64)
    white = WHITE[data] == SPACE
    last = np.zeros(len(data), bool)
    np.logical_and(~white[:-1], white[1:], out=last[:-1])
    last[offsets[1:][np.diff(offsets) > 0] - 1] = True
    return np.flatnonzero(last) + 1


def draws(seed: int, doc_id: object) -> tuple[int, int, int, int]:
    """Four numbers below 2**32 that the seed and the id decide."""
    said = "" if doc_id is None else str(doc_id)
    digest = hashlib.sha256(f"{seed}:{said}".encode()).digest()
    return tuple(int.from_bytes(digest[i:i + 4], "big") for i in (0, 4, 8, 12))


def _cuts(ends: np.ndarray, first: int, last: int, begin: int, end: int) -> list[int]:
    """Bounds of the pieces of units ``first`` to ``last``, which are bytes ``begin`` to ``end``."""
    if last - first <= PIECE_UNITS and end - begin <= PIECE_BYTES:
        return [begin, end]
    bounds = [begin]
    unit = first
    while bounds[-1] < end:
        # As many whole units as fit; of a unit that is too long by itself, as many bytes.
        fit = int(np.searchsorted(ends, bounds[-1] + PIECE_BYTES, side="right"))
        unit = min(max(unit, fit), unit + PIECE_UNITS, last)
        at = int(ends[unit - 1]) if unit else begin
        bounds.append(at if at > bounds[-1] else min(bounds[-1] + PIECE_BYTES, end))
    return bounds


def _points(data: np.ndarray) -> int:
    """Code points of UTF-8 bytes."""
    return int(np.count_nonzero((data & 0xC0) != 0x80))


def _document(doc_id, text: np.ndarray, ends: np.ndarray, seed: int, fim_percent: int, spm_percent: int):
    """Form, code points of prefix and middle, and the pieces in output order."""
    h1, h2, h3, h4 = draws(seed, doc_id)
    n = len(ends)
    raw = text.tobytes()
    if not n or h3 % 100 >= fim_percent or any(mark in raw for mark in MARKS.values()):
        bounds = _cuts(ends, 0, n, 0, len(raw))
        return "plain", None, None, [raw[a:b] for a, b in zip(bounds, bounds[1:])]
    form = "spm" if h4 % 100 < spm_percent else "psm"
    units = (0, *sorted((h1 % (n + 1), h2 % (n + 1))), n)
    at = [int(ends[u - 1]) if u else 0 for u in units]
    pieces = []
    for section in FORMS[form]:
        k = _PLACES[section]
        bounds = _cuts(ends, units[k], units[k + 1], at[k], at[k + 1])
        cut = [raw[a:b] for a, b in zip(bounds, bounds[1:])]
        pieces += [MARKS[section] + cut[0], *cut[1:]]
    return form, _points(text[: at[1]]), _points(text[at[1]: at[2]]), pieces


class _Rows:
    """Rows of one schema, handed on as Arrow batches."""

    def __init__(self, schema: pa.Schema):
        self.schema = schema
        self.rows: list[tuple] = []
        self.bytes = 0

    def batches(self, least: int = OUT_ROWS) -> Iterator[pa.RecordBatch]:
        """What has gathered, once it is ``least`` rows or some megabytes."""
        if len(self.rows) >= least or self.bytes >= 4 << 20:
            while self.rows:
                part, self.rows = self.rows[:OUT_ROWS], self.rows[OUT_ROWS:]
                columns = [pa.array(c, f.type) for c, f in zip(zip(*part), self.schema)]
                yield pa.RecordBatch.from_arrays(columns, schema=self.schema)
            self.bytes = 0


def _facts(docs: DataFrame, id_column: str) -> list[StructField]:
    return [
        StructField(id_column, docs.schema[id_column].dataType), StructField("n", LongType()),
        StructField("form", StringType()), StructField("prefix_chars", LongType()),
        StructField("middle_chars", LongType()),
    ]


def _arrow(schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def pieces(
    docs: DataFrame,
    seed: int = 42,
    fim_percent: int = 50,
    spm_percent: int = 80,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """The outputs of all documents as pieces, each partition sorted by document and place.

    Columns: ``key`` (of the document), ``place``, the id, ``n`` (units),
    ``form`` (``plain``, ``psm``, ``spm``), ``prefix_chars``, ``middle_chars``
    (null if plain) and ``piece`` (UTF-8 bytes).  The facts stand at place 0.

    A null text is empty; an empty text and one that contains a mark are plain.
    A null id draws like an empty one.  The key is a hash of id and text, so a
    task that is run again deals the same pieces; rows that agree in both give
    the same pieces once more.  Other columns are ignored, an empty table stays
    empty.  A text of any length is cut into pieces of at most 32 KB.
    """
    given = docs.select(F.col(f"`{id_column}`").alias(id_column), F.col(f"`{text_column}`").cast("string").alias("_text"))
    schema = StructType([
        StructField("key", BinaryType()), StructField("place", IntegerType()), *_facts(docs, id_column),
        StructField("piece", BinaryType()),
    ])
    arrow = _arrow(schema)

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Rows(arrow)
        for part in slices(batches, 1):
            data, offsets = flat(part.column(1))
            ends = unit_ends(data, offsets)
            first = np.searchsorted(ends, offsets, side="right")
            for i, doc_id in enumerate(part.column(0).to_pylist()):
                text = data[offsets[i]: offsets[i + 1]]
                own = ends[first[i]: first[i + 1]] - offsets[i]
                form, before, between, cut = _document(doc_id, text, own, seed, fim_percent, spm_percent)
                said = b"" if doc_id is None else b"=" + str(doc_id).encode()
                key = xxhash.xxh3_128_digest(len(said).to_bytes(4, "big") + said + text.tobytes())
                out.rows.append((key, 0, doc_id, len(own), form, before, between, cut[0]))
                out.rows += [(key, p, None, None, None, None, None, c) for p, c in enumerate(cut[1:], 1)]
                out.bytes += len(text)
                yield from out.batches()
        yield from out.batches(0)

    dealt = given.mapInArrow(cut, schema).repartition("key")
    return dealt.sortWithinPartitions("key", "place")


class Sections:
    """Finds the sections in an output that comes piece by piece; a mark lies within one piece."""

    def __init__(self, form: str):
        self.coming = list(FORMS.get(form, ()))
        self.place = 0

    def feed(self, piece: bytes) -> Iterator[tuple[int, bytes]]:
        """Place in the text and bytes of each stretch of ``piece``."""
        while self.coming and (at := piece.find(MARKS[self.coming[0]])) >= 0:
            if at:
                yield self.place, piece[:at]
            section = self.coming.pop(0)
            self.place = _PLACES[section]
            piece = piece[at + len(MARKS[section]):]
        if piece:
            yield self.place, piece


def restore(output: str, form: str) -> str:
    """The text that gave ``output``."""
    stretches = sorted(Sections(form).feed(output.encode()), key=lambda s: s[0])
    return b"".join(data for _, data in stretches).decode()


def _streamed(batches: Iterable[pa.RecordBatch], order: list[str]) -> Iterator[tuple[dict, int]]:
    """Each row of sorted batches with how often it has come; equal rows stand together."""
    held, times, last = None, 0, None
    for batch in batches:
        columns = batch.to_pydict()
        names = list(columns)
        for row in zip(*columns.values()):
            at = dict(zip(names, row))
            now = tuple(at[c] for c in order)
            if now == last:
                times += 1
                continue
            if held is not None:
                yield held, times
            held, times, last = at, 1, now
    if held is not None:
        yield held, times


def _facts_of(sorted_pieces: DataFrame) -> list[str]:
    return [c for c in sorted_pieces.columns if c not in ("key", "place", "piece")]


def outputs(sorted_pieces: DataFrame) -> DataFrame:
    """One row per document of ``pieces()``: its facts and ``output``, the rearranged text."""
    facts = _facts_of(sorted_pieces)
    schema = StructType([*[sorted_pieces.schema[c] for c in facts], StructField("output", StringType())])
    arrow = _arrow(schema)

    def join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Rows(arrow)
        held, copies, parts = None, 0, []

        def end():
            if held is not None:
                text = b"".join(parts).decode()
                for _ in range(copies):
                    out.rows.append((*held, text))
                    out.bytes += len(text)
                    yield from out.batches()

        for row, times in _streamed(batches, ["key", "place"]):
            if row["place"] == 0:
                yield from end()
                held, copies, parts = tuple(row[c] for c in facts), times, []
            parts.append(row["piece"])
        yield from end()
        yield from out.batches(0)

    return sorted_pieces.mapInArrow(join, schema)


def digests(sorted_pieces: DataFrame) -> DataFrame:
    """One row per document of ``pieces()``: its facts, ``output_sha256`` and ``restored_sha256``.

    The output streams into one digest.  Its sections, found by form and marks,
    are sorted back into the order of the text and stream into the other.
    """
    facts = _facts_of(sorted_pieces)
    kept = [sorted_pieces.schema[c] for c in facts]
    found = StructType([
        StructField("key", BinaryType()), StructField("place", IntegerType()), StructField("stretch", LongType()),
        StructField("copies", LongType()), *kept, StructField("output_sha256", StringType()),
        StructField("piece", BinaryType()),
    ])
    found_arrow = _arrow(found)
    nothing = (None,) * (len(facts) + 2)

    def take_apart(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Rows(found_arrow)
        key = sections = digest = held = None
        copies = stretch = 0
        for row, times in _streamed(batches, ["key", "place"]):
            if row["place"] == 0:
                if held is not None:
                    out.rows.append((key, -1, 0, copies, *held, digest.hexdigest(), None))
                key, copies, held = row["key"], times, tuple(row[c] for c in facts)
                digest, sections, stretch = hashlib.sha256(), Sections(row["form"]), 0
            digest.update(row["piece"])
            for place, data in sections.feed(row["piece"]):
                out.rows.append((key, place, stretch, *nothing, data))
                out.bytes += len(data)
                stretch += 1
            yield from out.batches()
        if held is not None:
            out.rows.append((key, -1, 0, copies, *held, digest.hexdigest(), None))
        yield from out.batches(0)

    # Pieces of a document are in one partition already: sorting there brings them back in order.
    back = sorted_pieces.mapInArrow(take_apart, found).sortWithinPartitions("key", "place", "stretch")
    result = StructType([*kept, StructField("output_sha256", StringType()), StructField("restored_sha256", StringType())])
    result_arrow = _arrow(result)

    def put_back(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Rows(result_arrow)
        held, copies, digest = None, 0, None

        def end():
            if held is not None:
                row = (*held, digest.hexdigest())
                for begin in range(0, copies, OUT_ROWS):
                    out.rows += [row] * min(OUT_ROWS, copies - begin)
                    yield from out.batches()

        for row, _ in _streamed(batches, ["key", "place", "stretch"]):
            if row["place"] < 0:
                yield from end()
                held, copies = (*[row[c] for c in facts], row["output_sha256"]), row["copies"]
                digest = hashlib.sha256()
            else:
                digest.update(row["piece"])
        yield from end()
        yield from out.batches(0)

    return back.mapInArrow(put_back, result)
