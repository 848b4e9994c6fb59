"""Byte-level BPE with the tokenizers library over Arrow batches.

The ranks of a vocabulary file become a byte-level model of the library: bytes
are mapped to printable characters, and the merges are recovered from the
ranks.  Texts are cut where no match of the pattern can cross, so that equal
cuts are encoded once per batch and kept for the next ones.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from tidewatch.llm.batches import binary_array, encode, flat, gather, slices

# A worker remembers the ids of twice as many cuts at most.
KEPT_CUTS = 350_000


def byte_characters() -> list[str]:
    """The printable character that stands for each byte."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = (b for b in range(256) if b not in set(printable))
    table = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}
    return [table[b] for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def merges_of(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """The two parts each token of several bytes is merged from, by rank.

    They are what is left of the token's bytes when all merges of lower rank
    are done.
    """
    found = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            pairs = [ranks.get(parts[i] + parts[i + 1], rank) for i in range(len(parts) - 1)]
            best = min(pairs)
            if best >= rank:
                break
            at = pairs.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) == 2:
            found.append((parts[0], parts[1]))
    return found


def build_tokenizer(ranks: dict[bytes, int], pattern: str):
    """A tokenizer of the library: each match of ``pattern`` separately, no special tokens."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    chars = byte_characters()

    def shown(token: bytes) -> str:
        return "".join(chars[b] for b in token)

    model = models.BPE(
        vocab={shown(token): rank for token, rank in ranks.items()},
        merges=[(shown(a), shown(b)) for a, b in merges_of(ranks)],
    )
    tokenizer = Tokenizer(model)
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence([
        pre_tokenizers.Split(Regex(pattern), "isolated"),
        pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False),
    ])
    return tokenizer


# A space opens a new match if one of these bytes follows: ASCII that is neither
# white space nor a control, and what begins a character beyond ASCII, unless
# white space beyond ASCII begins with it (0xC2, 0xE1, 0xE2, 0xE3).
_OPENS = np.zeros(256, bool)
_OPENS[0x21:0x7F] = True
_OPENS[0xC3:0xF5] = True
_OPENS[[0xE1, 0xE2, 0xE3]] = False


class CutEncoder:
    """Ids of short cuts of text, each encoded alone, with a bounded memory.

    ``plain`` tells cuts of a word and marks after it, which the tokenizer's
    normaliser leaves as they are and whose two parts are one match each; those
    go to the library's model directly, all others through the whole tokenizer.
    The memory has two halves: when the newer is full it takes the place of the
    older, and what is used again moves to the newer.
    """

    def __init__(self, tokenizer, plain: re.Pattern | None):
        self.tokenizer = tokenizer
        self.plain = plain
        self.model = tokenizer.model
        self.shown = dict(enumerate(byte_characters()))
        self.now: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}

    def ids(self, cuts: list[bytes]) -> list[bytes]:
        """The ids of each cut as unsigned 32-bit numbers."""
        if len(self.now) > KEPT_CUTS:
            self.now, self.before = {}, self.now
        now, before = self.now, self.before
        others = []
        for cut in cuts:
            if cut in now:
                continue
            if cut in before:
                now[cut] = before[cut]
                continue
            parts = self.plain.fullmatch(cut) if self.plain else None
            if parts is None:
                others.append(cut)
                continue
            word, marks = parts.groups()
            if word not in now:
                now[word] = self._merge(word)
            if marks:
                if marks not in now:
                    now[marks] = self._merge(marks)
                now[cut] = now[word] + now[marks]
        found = self.tokenizer.encode_batch_fast([c.decode("utf-8") for c in others], add_special_tokens=False)
        now.update((c, array("I", e.ids).tobytes()) for c, e in zip(others, found, strict=True))
        return [now[c] for c in cuts]

    def _merge(self, match: bytes) -> bytes:
        """Ids of one match of the pattern, by the library's model alone."""
        tokens = self.model.tokenize(match.decode("latin-1").translate(self.shown))
        return array("I", [t.id for t in tokens]).tobytes()


# Of the public pattern: letters up to U+00FF with a space before them at most are
# one match, and marks after them the next.  Such cuts need no pattern at all.
_WORD_AND_MARKS = re.compile(
    rb"( ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([!-&(-/:-@\[-`{-~]*)"
)


class Codec:
    """Encodes and decodes whole batches; one per Python worker."""

    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        self.tokenizer = build_tokenizer(self.ranks, pattern)
        size = max(self.ranks.values(), default=-1) + 1
        by_rank = [b""] * size
        for token, rank in self.ranks.items():
            by_rank[rank] = token
        # The byte table reversed: the bytes of every id in a row.
        self.token_bytes = np.frombuffer(b"".join(by_rank), np.uint8)
        self.token_length = np.array([len(t) for t in by_rank], np.int64)
        self.token_begin = np.concatenate(([0], np.cumsum(self.token_length)))[:-1]
        plain = _WORD_AND_MARKS if pattern == public_tokenizers.PATTERN else None
        self.cuts = CutEncoder(self.tokenizer, plain)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text begins (with the end)."""
        cut = np.zeros(len(data) + 1, bool)
        if len(data):
            cut[:-1][1:-1] = (data[1:-1] == 0x20) & _OPENS[data[2:]]
        cut[offsets] = True
        bounds = np.flatnonzero(cut)
        if len(bounds) < 2:
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        codes, cuts = encode(binary_array(data, bounds))
        ids = self.cuts.ids(cuts)
        lengths = np.array([len(x) // 4 for x in ids], np.int64)
        begins = np.concatenate(([0], np.cumsum(lengths)))[:-1]
        out, at = gather(np.frombuffer(b"".join(ids), np.uint32), begins, lengths, codes)
        return out, at[np.searchsorted(bounds, offsets)]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all id lists in a row, and where each begins (with the end)."""
        if len(ids) and int(ids.max()) >= len(self.token_length):
            raise ValueError(f"id {int(ids.max())} is not in the vocabulary")
        data, at = gather(self.token_bytes, self.token_begin, self.token_length, ids)
        return data, at[bounds]

    def character_offsets(self, data: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First character each id touches and the one after its last, counted over ``data``.

        ``data`` are the bytes of ``ids``.  A character split between ids
        belongs to all of them, so the ranges of neighbours may overlap.
        """
        ends = np.cumsum(self.token_length[ids])
        begins = ends - self.token_length[ids]
        # Characters that begin at or before each byte.
        begun = np.cumsum((data & 0xC0) != 0x80)
        return begun[begins] - 1, begun[ends - 1]


_CODECS: dict[tuple[str, str], Codec] = {}


def _codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


_ENCODED = [
    StructField("ids", ArrayType(IntegerType(), False)),
    StructField("begins", ArrayType(IntegerType(), False)),
    StructField("ends", ArrayType(IntegerType(), False)),
]


def encode_texts(
    docs: DataFrame,
    path: str,
    pattern: str = public_tokenizers.PATTERN,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """``id_column``, ``ids`` and the characters each id covers (``begins``, ``ends``).

    One row per row of ``docs``, repeated rows included; a null text is empty
    and has no ids; other columns are ignored.  Texts are encoded whole.
    """
    rows = docs.select(F.col(f"`{id_column}`"), F.col(f"`{text_column}`").cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, pattern)
        for part in slices(batches, 1):
            data, offsets = flat(part.column(1))
            ids, at = codec.encode(data, offsets)
            begins, ends = codec.character_offsets(data, ids) if len(ids) else (ids, ids)
            # Counted over the batch: make them count from each text's start.
            texts = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[offsets[:-1]]
            shift = np.repeat(texts, np.diff(at))
            columns = [ids, begins - shift, ends - shift]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *[_lists(c, at) for c in columns]], names=[id_column, "ids", "begins", "ends"]
            )

    schema = StructType([StructField(id_column, rows.schema[0].dataType), *_ENCODED])
    return rows.mapInArrow(run, schema)


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.astype(np.int32)))


def decode_ids(
    rows: DataFrame, path: str, id_column: str = "doc_id", ids_column: str = "ids"
) -> DataFrame:
    """``id_column`` and ``data``, the bytes of ``ids_column``; a null list has none.

    Ids may begin or end inside a character: the bytes are exact, and
    ``bytes.decode("utf-8", "replace")`` or joining neighbours shows them.
    """
    given = rows.select(F.col(f"`{id_column}`"), F.col(f"`{ids_column}`").cast("array<int>").alias("_ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, public_tokenizers.PATTERN)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                lists = part.column(1)
                counts = np.array([len(x) if x is not None else 0 for x in lists.to_pylist()])
                bounds = np.concatenate(([0], np.cumsum(counts))).astype(np.int64)
                ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                data, bounds = codec.decode(ids, bounds)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), binary_array(data, bounds).cast(pa.binary())], names=[id_column, "data"]
                )

    schema = StructType([StructField(id_column, given.schema[0].dataType), StructField("data", BinaryType())])
    return given.mapInArrow(run, schema)


def round_trip_digests(
    docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN,
    id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """Digests of the ids and of the bytes decoded from them, without sending ids through the JVM."""
    rows = docs.select(F.col(f"`{id_column}`"), F.col(f"`{text_column}`").cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, pattern)
        decimal = [str(i).encode() for i in range(len(codec.token_length))]
        for part in slices(batches, 1):
            data, offsets = flat(part.column(1))
            ids, at = codec.encode(data, offsets)
            decoded, bounds = codec.decode(ids, at)
            listed = [b" ".join(map(decimal.__getitem__, ids[a:b].tolist())) for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array(np.diff(at)),
                    pa.array([hashlib.sha256(x).hexdigest() for x in listed], pa.string()),
                    pa.array([hashlib.sha256(decoded[a:b]).hexdigest() for a, b in zip(bounds[:-1], bounds[1:])], pa.string()),
                ],
                names=[id_column, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    schema = StructType([
        StructField(id_column, rows.schema[0].dataType),
        StructField("n_tokens", LongType()),
        StructField("ids_sha256", StringType()),
        StructField("decoded_sha256", StringType()),
    ])
    return rows.mapInArrow(run, schema)
