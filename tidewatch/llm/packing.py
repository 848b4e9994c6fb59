"""Vector bin packing of token sequences by the dot-product heuristic.

A sequence has limits on tokens, segments and loss-bearing tokens at once.
Documents are encoded, cut into pieces and packed where they are read: no text
or id is shuffled, and a task holds one block of unpacked pieces at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from tidewatch.llm.batches import WHITE_LOWER, encode, flat, gather, slices, words
from tidewatch.llm.byte_bpe import CutEncoder

@dataclass(frozen=True)
class Limits:
    """What one sequence may hold.

    Every token but the first of a piece and those of the prompt, with which a
    document may begin, bears loss: nothing precedes that one.  Pieces are packed ``block`` at a time; a gap of at least ``min_cut``
    tokens is filled with the beginning of a piece that does not fit.
    """

    tokens: int = 4096
    segments: int = 64
    loss: int = 4096
    block: int = 1024
    min_cut: int = 64


class WordEncoder:
    """Ids of the words of whole batches by a tokenizer that drops white space."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # The strings of special tokens are ordinary text in a document.
        self.tokenizer.encode_special_tokens = True
        # Lower-case letters up to U+00FF, then marks.
        plain = re.compile(rb"((?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+)([!-&(-/:-@\[-`{-~]*)")
        self.cuts = CutEncoder(self.tokenizer, plain)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text begins (with the end).

        Words between ASCII white space are encoded apart: no match of the
        tokenizer's pattern crosses white space, and A-Z are lower-cased by it.
        """
        bounds, found = words(data, offsets, WHITE_LOWER)
        if not len(found):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        codes, distinct = encode(found)
        ids = self.cuts.ids(distinct)
        lengths = np.array([len(x) // 4 for x in ids], np.int64)
        begins = np.concatenate(([0], np.cumsum(lengths)))[:-1]
        out, at = gather(np.frombuffer(b"".join(ids), np.uint32), begins, lengths, codes)
        return out, at[bounds]


@dataclass
class Piece:
    doc: object
    start: int
    ids: np.ndarray
    doc_tokens: int
    # Tokens at the beginning of the document that bear no loss.
    prompt: int = 0

    def prompt_left(self) -> int:
        """Where the prompt ends, counted from the piece's beginning."""
        return max(self.prompt - self.start, 0)

    def demand(self) -> tuple[int, int, int]:
        return len(self.ids), 1, max(len(self.ids) - max(self.prompt_left(), 1), 0)

    def cut(self, at: int) -> tuple[Piece, Piece]:
        return (
            Piece(self.doc, self.start, self.ids[:at], self.doc_tokens, self.prompt),
            Piece(self.doc, self.start + at, self.ids[at:], self.doc_tokens, self.prompt),
        )


def pack_block(pieces: list[Piece], limits: Limits) -> list[list[Piece]]:
    """Pieces in sequences; only the last sequence may have room that a piece would fill.

    A sequence takes, of the pieces that fit in every dimension, the one with
    the largest dot product of its demand and the room left, each in parts of
    the limit and weighted by the demand of the whole block.
    """
    capacity = np.array([limits.tokens, limits.segments, limits.loss], float)
    waiting = list(pieces)
    demand = np.array([p.demand() for p in waiting], float).reshape(-1, 3)
    prompts = np.array([p.prompt_left() for p in waiting], float)
    open_ = np.ones(len(waiting), bool)
    left = len(waiting)
    sequences = []
    while left:
        total = demand[open_].sum(axis=0)
        weight = total / capacity / max(float((total / capacity).max()), 1e-12)
        room, chosen = capacity.copy(), []
        score = demand * (weight / capacity**2)
        while left:
            fits = open_ & (demand <= room).all(axis=1)
            # How much of each piece's beginning there is room for.
            begins = np.minimum(room[0], room[2] + prompts)
            cuttable = open_ & (begins >= limits.min_cut)
            if fits.any():
                at = int(np.argmax(np.where(fits, score @ room, -1.0)))
                piece = waiting[at]
            elif room[1] >= 1 and cuttable.any():
                # Nothing fits: the longest piece gives its beginning and stays with the rest.
                at = int(np.argmax(np.where(cuttable, demand[:, 0], -1.0)))
                piece, rest = waiting[at].cut(int(begins[at]))
                waiting[at] = rest
                demand[at] = rest.demand()
                prompts[at] = rest.prompt_left()
                score[at] = demand[at] * (weight / capacity**2)
                chosen.append(piece)
                room = room - piece.demand()
                continue
            else:
                break
            open_[at] = False
            left -= 1
            chosen.append(piece)
            room = room - piece.demand()
        sequences.append(chosen)
    return sequences


def powers_of_two(pieces: list[Piece]) -> list[list[Piece]]:
    """The same tokens in sequences whose lengths are powers of two, longest first."""
    left = sum(len(p.ids) for p in pieces)
    queue, sequences = list(pieces), []
    while left:
        room, chosen = 1 << (left.bit_length() - 1), []
        left -= room
        while room:
            piece = queue.pop(0)
            if len(piece.ids) > room:
                piece, rest = piece.cut(room)
                queue.insert(0, rest)
            chosen.append(piece)
            room -= len(piece.ids)
        sequences.append(chosen)
    return sequences


class Packer:
    """Packs one task's documents; call ``add`` for each and ``finish`` at the end."""

    def __init__(self, limits: Limits, task: int):
        self.limits = limits
        self.next_id = task << 33
        self.waiting: list[Piece] = []

    def add(self, doc: object, ids: np.ndarray, prompt: int = 0) -> Iterator[list[Piece]]:
        """A document's ids; yields sequences that are complete."""
        piece = Piece(doc, 0, ids, len(ids), prompt)
        while len(piece.ids) >= (size := min(self.limits.tokens, self.limits.loss + max(piece.prompt_left(), 1))):
            full, piece = piece.cut(size)
            yield [full]
        if len(piece.ids):
            # A copy, or the piece would keep its whole batch.
            piece.ids = piece.ids.copy()
            self.waiting.append(piece)
        if len(self.waiting) >= self.limits.block:
            *full_ones, last = pack_block(self.waiting, self.limits)
            self.waiting = last
            yield from full_ones

    def finish(self) -> Iterator[list[Piece]]:
        """What is left; the last sequence, with room left, goes to powers of two."""
        if self.waiting:
            *full_ones, last = pack_block(self.waiting, self.limits)
            self.waiting = []
            yield from full_ones
            yield from powers_of_two(last)


_ENCODERS: dict[str, WordEncoder] = {}


def pack_documents(
    docs: DataFrame,
    path: str,
    end_id: int = 2,
    limits: Limits = Limits(),
    id_column: str = "doc_id",
    text_column: str = "text",
    prompt_column: str | None = None,
) -> DataFrame:
    """One row per piece of a document in a sequence.

    Columns: ``id_column``, ``start`` (ids of the document before the piece),
    ``length``, ``ids`` (little-endian unsigned 32-bit), ``doc_tokens`` (ids of
    the document, ``end_id`` included), ``sequence_id``, ``offset`` (in the
    sequence, gapless from 0).  A null text is empty and has ``end_id`` alone;
    repeated rows are packed each; a null id stays null; other columns are
    ignored; an empty table has no sequences.

    ``prompt_column`` says how many tokens at the beginning of the row's text
    bear no loss: null or less than 1 is none, more than the row has is all (a
    turn of a user, for instance).  Without it every text bears loss.

    Every task packs the rows of its input partition.  ``sequence_id`` holds
    the partition's number, so a task that runs again gives the same rows.
    """
    prompt = F.lit(0) if prompt_column is None else F.greatest(F.col(f"`{prompt_column}`"), F.lit(0))
    rows = docs.select(
        F.col(f"`{id_column}`"), F.col(f"`{text_column}`").cast("string").alias("_text"), prompt.cast("long").alias("_prompt")
    )
    names = [id_column, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def rows_of(packer: Packer, sequences: list[list[Piece]], kind: pa.DataType) -> pa.RecordBatch:
        pieces, numbers, offsets = [], [], []
        for sequence in sequences:
            offset = 0
            for piece in sequence:
                pieces.append(piece)
                numbers.append(packer.next_id)
                offsets.append(offset)
                offset += len(piece.ids)
            packer.next_id += 1
        return pa.RecordBatch.from_arrays(
            [
                pa.array([p.doc for p in pieces], kind),
                pa.array([p.start for p in pieces], pa.int64()),
                pa.array([len(p.ids) for p in pieces], pa.int64()),
                pa.array([p.ids.astype("<u4").tobytes() for p in pieces], pa.binary()),
                pa.array([p.doc_tokens for p in pieces], pa.int64()),
                pa.array(numbers, pa.int64()),
                pa.array(offsets, pa.int64()),
            ],
            names=names,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _ENCODERS:
            _ENCODERS[path] = WordEncoder(path)
        encoder = _ENCODERS[path]
        packer = Packer(limits, TaskContext.get().partitionId())
        kind = None
        for part in slices(batches, 1):
            kind = part.column(0).type
            ids, at = encoder.encode(*flat(part.column(1)))
            done = []
            for n, (doc, prompt) in enumerate(zip(part.column(0).to_pylist(), part.column(2).to_pylist())):
                whole = np.append(ids[at[n] : at[n + 1]], np.uint32(end_id)).astype(np.uint32)
                for sequence in packer.add(doc, whole, prompt):
                    done.append(sequence)
                    if len(done) >= 512:
                        yield rows_of(packer, done, kind)
                        done = []
            if done:
                yield rows_of(packer, done, kind)
        if kind is not None:
            yield rows_of(packer, list(packer.finish()), kind)

    schema = StructType([
        StructField(id_column, rows.schema[0].dataType),
        *[StructField(n, BinaryType() if n == "ids" else LongType()) for n in names[1:]],
    ])
    return rows.mapInArrow(run, schema)


def word_tokenizer() -> str:
    return public_tokenizers.path("word_bpe_49k.json")
