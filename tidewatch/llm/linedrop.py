"""Line deduplication: lines that many documents share go from every document.

The distinct lines are indexed by a sharded minimal perfect hash: a line's
128-bit hash names its shard, and in the shard a place in two arrays, of short
fingerprints and of document counts.  A shard's arrays are a few megabytes and
are one row of the index table.  Documents do not join lines with each other:
their hashes are sent past the arrays of their shards, and what the arrays tell
of frequent lines is sent past the documents.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.llm.batches import flat, slices
from tidewatch.sources.staging import stage

# White space that does not count at the ends of a line.
ENDS = b"\x20\x09\x0a\x0b\x0c\x0d"

# Distinct lines of one shard, about 9 bytes each in its arrays.
SHARD_LINES = 1 << 17
# Look-ups of one shard that one task answers; a shard that is asked more often is answered in several.
SHARD_PROBES = 4 << 20
# Documents that share a block of answers.
BLOCK_ROWS = 64
# Rows of a batch that is handed back to Spark.
OUT_ROWS = 65_536


def line_keys(text: bytes, least_chars: int = 1) -> list[bytes | None]:
    """The 128-bit hash of each line: stripped, A-Z lower-cased; None for keys of fewer code points."""
    found = []
    for line in text.split(b"\n"):
        key = line.strip(ENDS).lower()
        if len(key) < 4 * least_chars and _points(key) < least_chars:
            found.append(None)
        else:
            found.append(xxhash.xxh3_128_digest(key))
    return found


def _points(key: bytes) -> int:
    return sum(byte & 0xC0 != 0x80 for byte in key)


def _halves(lines: Iterable[bytes]) -> np.ndarray:
    """The two 64-bit halves of each hash."""
    return np.frombuffer(b"".join(lines), "<u8").reshape(-1, 2)


def _mix(x: np.ndarray) -> np.ndarray:
    """Scrambled 64-bit numbers (the finaliser of SplitMix64, public domain)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """A number from 0 to n - 1 for each of n distinct 128-bit keys, in about 3 bits a key.

    Levels of bits: a key that falls on a bit of its own in a level is placed
    there; the others try the next level, twice as many bits as keys each.  The
    number of a key is how many bits are set before its own.
    """

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.begins = np.concatenate(([0], np.cumsum(sizes)))
        self.before = np.concatenate(([0], np.cumsum(bits, dtype=np.int64)))

    @staticmethod
    def _places(halves: np.ndarray, level: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            salted = _mix(halves[:, 1] + np.uint64((level * 0x9E3779B97F4A7C15) & (1 << 64) - 1))
            return (_mix(halves[:, 0] ^ salted) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, halves: np.ndarray) -> PerfectHash:
        """For distinct keys, given as rows of two 64-bit numbers."""
        sizes, levels = [], []
        while len(halves):
            size = 2 * len(halves) + 16
            at = cls._places(halves, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            levels.append(alone)
            halves = halves[~alone[at]]
        return cls(np.array(sizes, np.int64), np.concatenate(levels) if levels else np.zeros(0, bool))

    def numbers(self, halves: np.ndarray) -> np.ndarray:
        """The number of each key; any number or -1 for a key that was not built in."""
        found = np.full(len(halves), -1, np.int64)
        rest = np.arange(len(halves))
        for level, size in enumerate(self.sizes):
            if not len(rest):
                break
            at = self.begins[level] + self._places(halves[rest], level, int(size))
            hit = self.bits[at]
            found[rest[hit]] = self.before[at[hit]]
            rest = rest[~hit]
        return found


class Shard:
    """Fingerprints and counts of some lines, in the order of their perfect hash."""

    def __init__(self, order: PerfectHash, prints: np.ndarray, counts: np.ndarray):
        self.order, self.prints, self.counts = order, prints, counts

    @staticmethod
    def _prints(halves: np.ndarray) -> np.ndarray:
        return (halves[:, 0] ^ (halves[:, 1] >> np.uint64(32))).astype(np.uint32)

    @classmethod
    def build(cls, lines: Iterable[bytes], counts: np.ndarray) -> Shard:
        halves = _halves(lines)
        order = PerfectHash.build(halves)
        at = order.numbers(halves)
        prints = np.zeros(len(halves), np.uint32)
        by_number = np.zeros(len(halves), np.uint32)
        prints[at] = cls._prints(halves)
        by_number[at] = np.minimum(counts, 0xFFFFFFFF)
        return cls(order, prints, by_number)

    def documents(self, lines: Iterable[bytes]) -> np.ndarray:
        """In how many documents each line is; 0 for lines that are not indexed."""
        halves = _halves(lines)
        at = self.order.numbers(halves)
        known = at >= 0
        known[known] = self.prints[at[known]] == self._prints(halves[known])
        counts = np.zeros(len(halves), np.int64)
        counts[known] = self.counts[at[known]]
        return counts

    def pack(self) -> bytes:
        head = np.array([len(self.order.sizes), *self.order.sizes, len(self.prints)], "<i8")
        bits = np.packbits(self.order.bits)
        return b"".join((head.tobytes(), self.prints.astype("<u4").tobytes(), self.counts.astype("<u4").tobytes(), bits.tobytes()))

    @classmethod
    def unpack(cls, packed: bytes) -> Shard:
        levels = int(np.frombuffer(packed, "<i8", 1)[0])
        head = np.frombuffer(packed, "<i8", levels + 2)
        sizes, n = head[1:-1], int(head[-1])
        begin = 8 * (levels + 2)
        prints = np.frombuffer(packed, "<u4", n, begin)
        counts = np.frombuffer(packed, "<u4", n, begin + 4 * n)
        bits = np.unpackbits(np.frombuffer(packed, np.uint8, offset=begin + 8 * n), count=int(sizes.sum()))
        return cls(PerfectHash(sizes, bits.astype(bool)), prints, counts)


def _given(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit(""))
    return docs.select(F.col(f"`{id_column}`").alias("id"), text.alias("text"))


def count_lines(docs: DataFrame, least_chars: int = 1, text_column: str = "text") -> DataFrame:
    """``line`` (its 128-bit hash) and ``documents``: the rows of ``docs`` that have it."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 0):
            data, offsets = flat(part.column(0))
            raw = data.tobytes()
            seen = Counter()
            for a, b in zip(offsets, offsets[1:]):
                seen.update(set(line_keys(raw[a:b], least_chars)))
            seen.pop(None, None)
            items = list(seen.items())
            for begin in range(0, len(items), OUT_ROWS):
                rows = items[begin:begin + OUT_ROWS]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([line for line, _ in rows], pa.binary()), pa.array([n for _, n in rows], pa.int64())],
                    ["line", "documents"],
                )

    text = F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit(""))
    found = docs.select(text.alias("text")).mapInArrow(count, "line binary, documents long")
    return found.groupBy("line").agg(F.sum("documents").alias("documents"))


def _shard(shards: int) -> Column:
    return F.pmod(F.xxhash64("line"), F.lit(shards)).cast("int").alias("shard")


def index_lines(counted: DataFrame, shards: int, shard_probes: int = SHARD_PROBES) -> DataFrame:
    """One row per shard of the counted lines: ``shard``, ``parts`` and ``arrays``.

    ``parts`` says over how many tasks its look-ups go: one per ``shard_probes``
    of them, which one very common line may bring.
    """

    def build(group: pa.Table) -> pa.Table:
        lines = group.column("line").to_pylist()
        counts = np.asarray(group.column("documents"))
        parts = 1 + int(counts.sum()) // shard_probes
        packed = Shard.build(lines, counts).pack()
        return pa.table({
            "shard": pa.array([group.column("shard")[0].as_py()], pa.int32()),
            "parts": pa.array([parts], pa.int32()), "arrays": pa.array([packed], pa.binary()),
        })

    return counted.select(_shard(shards), "line", "documents").groupBy("shard").applyInArrow(
        build, "shard int, parts int, arrays binary"
    )


def frequent_lines(
    asked: DataFrame, index: DataFrame, shards: int, least_documents: int
) -> DataFrame:
    """Those rows of ``asked`` (``block``, ``line``) whose line is in ``least_documents`` documents or more.

    The rows of a shard follow its arrays in the same partition.
    """
    # A row for every `shard_probes` look-ups at most.
    split = index.where("parts > 1").select("shard", "parts")
    asked = asked.select(_shard(shards), "block", "line").join(F.broadcast(split), "shard", "left")
    part = F.pmod("block", F.coalesce("parts", F.lit(1))).cast("int")
    asked = asked.select("shard", part.alias("part"), "block", "line", F.lit(None).cast("binary").alias("arrays"))
    arrays = index.select(
        "shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
        F.lit(None).cast("long").alias("block"), F.lit(None).cast("binary").alias("line"), "arrays",
    )
    together = asked.unionByName(arrays).repartition("shard", "part")
    together = together.sortWithinPartitions("shard", "part", F.col("arrays").isNull())

    def answer(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for batch in batches:
            heads = np.flatnonzero(np.asarray(batch.column("arrays").is_valid()))
            for begin, end in zip([0, *heads], [*heads, batch.num_rows]):
                rows = batch.slice(begin, end - begin)
                if rows.num_rows and rows.column("arrays")[0].is_valid:
                    shard = Shard.unpack(rows.column("arrays")[0].as_py())
                    rows = rows.slice(1)
                if rows.num_rows:
                    often = shard.documents(rows.column("line").to_pylist()) >= least_documents
                    yield rows.select(["block", "line"]).filter(pa.array(often))

    return together.mapInArrow(answer, "block long, line binary")


def drop_lines(
    docs: DataFrame,
    least_documents: int = 10,
    least_chars: int = 1,
    id_column: str = "doc_id",
    text_column: str = "text",
    shard_lines: int = SHARD_LINES,
    shard_probes: int = SHARD_PROBES,
) -> DataFrame:
    """One row per row of ``docs``: id, ``n_lines``, ``n_dropped`` and ``kept``, the other lines joined by \\n.

    A line's key is the line without white space at its ends and with A-Z
    lower-cased.  Lines whose key has ``least_chars`` code points or more and
    stands in ``least_documents`` rows or more go, wherever they stand.  A null
    or empty text is one empty line.  Repeated rows and ids count each; a null
    id is an id.  Other columns are ignored, an empty table stays empty.

    Lines are told apart by 128-bit hashes.  Answers go to blocks of documents
    named by a hash of id and text, so a task that is run again asks the same.
    """
    given = _given(docs, id_column, text_column)
    counted = stage(count_lines(given, least_chars), "line-counts")
    size = counted.agg(F.count("*").alias("lines"), F.max("documents").alias("most")).first()
    shards = max(1, math.ceil(size["lines"] / shard_lines))
    index = stage(index_lines(counted, shards, shard_probes), "line-index")

    blocks = max(1, math.ceil(docs.count() / BLOCK_ROWS))
    block = F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).alias("block")

    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            data, offsets = flat(part.column(1))
            raw, numbers = data.tobytes(), part.column(0).to_pylist()
            asked = set()
            for number, a, b in zip(numbers, offsets, offsets[1:]):
                asked.update((number, line) for line in line_keys(raw[a:b], least_chars) if line is not None)
            asked = list(asked)
            for begin in range(0, len(asked), OUT_ROWS):
                rows = asked[begin:begin + OUT_ROWS]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([n for n, _ in rows], pa.int64()), pa.array([line for _, line in rows], pa.binary())],
                    ["block", "line"],
                )

    asked = given.select(block, "text").mapInArrow(ask, "block long, line binary")
    frequent = frequent_lines(asked, index, shards, least_documents)

    nothing = F.lit(None)
    answers = frequent.select(
        "block", "line", nothing.cast(given.schema["id"].dataType).alias("id"), nothing.cast("string").alias("text")
    )
    texts = given.select(block, nothing.cast("binary").alias("line"), "id", "text")
    together = answers.unionByName(texts).repartition("block")
    together = together.sortWithinPartitions("block", F.col("line").isNull())
    id_type = given.schema["id"].dataType.simpleString()

    def drop(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, often = None, set()
        for part in slices(batches, 3):
            blocks_of, lines = part.column(0).to_pylist(), part.column(1).to_pylist()
            data, offsets = flat(part.column(3))
            raw, rows = data.tobytes(), []
            for i, line in enumerate(lines):
                if blocks_of[i] != now:
                    now, often = blocks_of[i], set()
                if line is not None:
                    often.add(line)
                    continue
                text = raw[offsets[i]:offsets[i + 1]]
                keys = line_keys(text, least_chars)
                stays = [whole for whole, key in zip(text.split(b"\n"), keys) if key not in often]
                rows.append((i, len(keys), len(keys) - len(stays), b"\n".join(stays)))
            if rows:
                at, n, dropped, kept = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(2).take(pa.array(at)), pa.array(n, pa.int64()), pa.array(dropped, pa.int64()),
                        pa.array(kept, pa.binary()).cast(pa.string()),
                    ],
                    ["id", "n_lines", "n_dropped", "kept"],
                )

    done = together.mapInArrow(drop, f"id {id_type}, n_lines long, n_dropped long, kept string")
    return done.withColumnRenamed("id", id_column)
