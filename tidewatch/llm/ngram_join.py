"""Jaccard self-join on word shingles by T-occurrence search.

Two texts link if their sets of word shingles overlap enough.  For a query set
and the inverted lists of its shingles, the partners are the documents found on
at least T lists.  DivideSkip finds them: the short lists are merged by a heap,
and what is found there often enough is probed by binary search on the long ones.

Who is searched against whom follows from a prefix of each set in one global
order of the shingles, rare ones first: sets that overlap enough share a
shingle of their prefixes.  The order is (seen once, seen more often, frequent;
hash).  It is kept in two bit maps of fixed size over the hashes, counted over
all texts; a bit shared by two shingles only makes a search longer.

A group of copies is not joined pair by pair.  Equal sets are one class.  In
each list of classes with a common shingle, all search first against one of
them.  Last, lists that still hold several components are searched in blocks, all
against all, so no link between components is missed; pairs exist only inside
a search.

A search is sent the sets of the classes that could link in it: they meet on a
list, differ in component and are alike in size.  Lists and searches are worked
through in shares, so that the disk holds the shuffle files of one at a time.
"""

from __future__ import annotations

import contextlib
import heapq
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from tidewatch.llm.batches import WHITE_LOWER, encode, flat, owners, slices, words
from tidewatch.sources.staging import stage

WORDS = 5
# Two sets link if 100 * intersection >= PERCENT * union.
PERCENT = 75
# A shingle in this many texts is frequent.
FREQUENT = 32
# Bits of each map: at least one for two shingles up to this size (128 MB), whatever the data.
MAX_BITS = 30
# Text bytes whose shingles are counted in one group, and shingles a task gathers before it sends them.
GROUP_BYTES = 64 << 20
GATHERED = 2 << 20
# Shingles of the candidates that are searched at once.
BLOCK_SHINGLES = 1 << 18
# Parts that the list of a frequent shingle is dealt to when facts of it are joined.
LIST_PARTS = 1024
# Searches of every list against one of its classes before the remaining ones are searched in blocks.
STAR_ROUNDS = 2
# Shuffled bytes of a share: a fourth of the bytes of all sets, this at least; and those of a place on a list.
LEAST_SHARE = 256 << 20
PLACE_BYTES = 64
# Rows of 64 bits that tell which sets a search asks for.
ASKED_ROWS = 1 << 18


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, and where each text's begin (with the end).

    Words are what lies between ASCII white space, A-Z lower-cased.  A text of
    fewer than ``size`` words has its whole sequence as one shingle; one without
    words has none.
    """
    bounds, found = words(data, offsets, WHITE_LOWER)
    counts = np.diff(bounds)
    if not len(found):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    codes, distinct = encode(found)
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in distinct], np.uint64)[codes]
    full = np.maximum(counts - size + 1, 0)
    at = np.repeat(bounds[:-1], full) + np.arange(full.sum()) - np.repeat(np.cumsum(full) - full, full)
    mixed = np.full(len(at), np.uint64(size))
    for k in range(size):
        mixed = _mix(mixed, hashes[at + k])
    text = np.repeat(np.arange(len(counts)), full)
    short = np.flatnonzero((counts > 0) & (counts < size))
    whole = np.zeros(len(short), np.uint64)
    for k, n in enumerate(short):
        value = np.full(1, np.uint64(counts[n]))
        for w in hashes[bounds[n] : bounds[n + 1]]:
            value = _mix(value, np.full(1, w))
        whole[k] = value[0]
    # Texts hold few shingles each: sort each text's own.
    ends = np.cumsum(full)
    sets = [np.unique(mixed[e - f : e]) if f else mixed[:0] for f, e in zip(full, ends)]
    for k, n in enumerate(short):
        sets[n] = whole[k : k + 1]
    sizes = np.array([len(s) for s in sets])
    return np.concatenate(sets), np.concatenate(([0], np.cumsum(sizes)))


def _mix(value: np.ndarray, word: np.ndarray) -> np.ndarray:
    value = (value ^ word) * np.uint64(0x9E3779B97F4A7C15)
    return value ^ (value >> np.uint64(32))


def prefix_length(n: np.ndarray | int, percent: int = PERCENT):
    """Shingles of which one at least is shared with any partner."""
    return n - -(-n * percent // 100) + 1


def needed_overlap(a: int, b: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """T: the overlap from which sets of sizes ``a`` and ``b`` link."""
    return -(-percent * (a + b) // (100 + percent))


class Index:
    """Inverted lists of a block of sets: per shingle the sets that have it, in order."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        values = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        order = np.argsort(values, kind="stable")
        self.values = values[order]
        self.members = np.repeat(np.arange(len(sets)), self.sizes)[order]

    def search(self, query: np.ndarray, percent: int = PERCENT, among: np.ndarray | None = None) -> np.ndarray:
        """Numbers of the sets that link with ``query`` (sorted, distinct), by DivideSkip.

        ``among`` flags the sets that are asked for; without it all are.
        """
        need = needed_overlap(len(query), self.sizes, percent)
        possible = (need <= len(query)) & (need <= self.sizes) & (self.sizes > 0)
        if among is not None:
            possible &= among
        if not possible.any() or not len(query):
            return np.zeros(0, np.int64)
        begins = np.searchsorted(self.values, query, side="left")
        ends = np.searchsorted(self.values, query, side="right")
        full = np.flatnonzero(ends > begins)
        lists = [self.members[x:y] for x, y in zip(begins[full].tolist(), ends[full].tolist())]
        if not possible.all():
            # Sets of another size or not asked for are no longer merged.
            lists = [x for x in (y[possible[y]] for y in lists) if len(x)]
        lists.sort(key=len)
        least = int(need[possible].min())
        if len(lists) < least:
            return np.zeros(0, np.int64)
        # The paper's choice of how many lists are long.
        long = min(least - 1, int(least / (0.01 * math.log2(len(lists[-1]) + 1) + 1)))
        cut = len(lists) - long
        merged = np.fromiter(heapq.merge(*[x.tolist() for x in lists[:cut]]), np.int64)
        candidates, seen = np.unique(merged, return_counts=True)
        good = seen >= need[candidates] - long
        candidates, seen = candidates[good], seen[good]
        for probed in lists[cut:] if len(candidates) else ():
            place = np.searchsorted(probed, candidates)
            inside = place < len(probed)
            inside[inside] = probed[place[inside]] == candidates[inside]
            seen = seen + inside
        return candidates[seen >= need[candidates]]


def _count_shingles(docs: DataFrame, size: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Bits of the maps, and the maps of shingles seen twice or more and of frequent ones."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(MAX_BITS, max(16, math.ceil(math.log2(total / 12 + 1))))
    group_bits = min(bits - 3, max(5, math.ceil(math.log2(total / GROUP_BYTES + 1))))

    def sent(hashes: list[np.ndarray]) -> pa.RecordBatch:
        values = np.sort(np.concatenate(hashes))
        starts = np.flatnonzero(np.diff(values, prepend=values[0] ^ np.uint64(1)) != 0)
        # A frequent shingle is frequent whatever is added: no more copies are sent than that takes.
        copies = np.minimum(np.diff(np.append(starts, len(values))), FREQUENT)
        values = np.repeat(values[starts], copies)
        group = (values >> np.uint64(64 - group_bits)).astype(np.int64)
        rest = (values >> np.uint64(32 - group_bits)).astype(np.uint32)
        firsts = np.flatnonzero(np.diff(group, prepend=-1))
        return pa.RecordBatch.from_arrays(
            [pa.array(group[firsts]), pa.array([x.tobytes() for x in np.split(rest, firsts[1:])], pa.binary())],
            names=["group", "rest"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered, count = [], 0
        for part in slices(batches, 0):
            values, _ = shingle_sets(*flat(part.column(0)), size)
            gathered.append(values)
            count += len(values)
            if count >= GATHERED:
                yield sent(gathered)
                gathered, count = [], 0
        if count:
            yield sent(gathered)

    def marked(table: pa.Table) -> pa.Table:
        values = np.sort(np.frombuffer(b"".join(table.column("rest").to_pylist()), np.uint32))
        starts = np.flatnonzero(np.diff(values, prepend=np.uint32(values[0] ^ 1)) != 0)
        copies = np.diff(np.append(starts, len(values)))
        # The next bits of the hash are the place in this group's part of the maps.
        place = values[starts] >> np.uint32(32 - (bits - group_bits))
        maps = []
        for least in (2, FREQUENT):
            flags = np.zeros(1 << (bits - group_bits), np.uint8)
            flags[place[copies >= least]] = 1
            maps.append(np.packbits(flags, bitorder="little").tobytes())
        group = table.column("group")[0].as_py()
        return pa.table({"group": pa.array([group]), "again": pa.array([maps[0]], pa.binary()), "often": pa.array([maps[1]], pa.binary())})

    counted = docs.select("text").mapInArrow(run, "group long, rest binary")
    rows = counted.groupBy("group").applyInArrow(marked, "group long, again binary, often binary").collect()
    maps = np.zeros((2, 1 << (bits - 3)), np.uint8)
    part = 1 << (bits - group_bits - 3)
    for row in rows:
        for k, column in enumerate(("again", "often")):
            maps[k, row["group"] * part : (row["group"] + 1) * part] = np.frombuffer(row[column], np.uint8)
    return bits, maps[0], maps[1]


_PROFILE = [
    StructField("n", LongType()),
    StructField("key", BinaryType()),
    StructField("prefix", ArrayType(LongType(), False)),
    StructField("rare", LongType()),
    StructField("shingles", BinaryType()),
]


def _profiles(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Per row: size of the set and, if a partner is possible, its key, its prefix and the set itself.

    ``rare`` of the prefix, its first shingles, are not frequent.  Shingles that no other text has are left out of the prefix; a text whose
    prefix has no others has no partner and no copy.
    """
    bits, again, often = _count_shingles(docs, size)
    maps = docs.sparkSession.sparkContext.broadcast((again, often))

    def flags(bitmap: np.ndarray, values: np.ndarray) -> np.ndarray:
        place = values >> np.uint64(64 - bits)
        return (bitmap[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        again, often = maps.value
        for part in slices(batches, 1):
            values, bounds = shingle_sets(*flat(part.column(1)), size)
            kind = flags(again, values) + flags(often, values)
            n = np.diff(bounds)
            text = owners(bounds)
            # Within a text: seen once, then more often, then frequent, each by hash.
            order = np.lexsort((kind, text))
            rank = np.arange(len(order)) - np.repeat(bounds[:-1], n)
            chosen = order[(rank < np.repeat(prefix_length(n, percent), n)) & (kind[order] > 0)]
            posted = np.bincount(text[chosen], minlength=len(n))
            rare = np.bincount(text[chosen], weights=kind[chosen] < 2, minlength=len(n)).astype(np.int64)
            ends = np.cumsum(posted)
            prefix = values[chosen].astype(np.int64)
            keys, prefixes, sets = [], [], []
            for k in range(len(n)):
                if not posted[k]:
                    keys.append(None), prefixes.append(None), sets.append(None)
                    continue
                own = values[bounds[k] : bounds[k + 1]].tobytes()
                keys.append(xxhash.xxh3_128_digest(own))
                prefixes.append(prefix[ends[k] - posted[k] : ends[k]])
                sets.append(own)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0), pa.array(n), pa.array(keys, pa.binary()),
                    pa.array(prefixes, pa.list_(pa.int64())), pa.array(rare), pa.array(sets, pa.binary()),
                ],
                names=["id", "n", "key", "prefix", "rare", "shingles"],
            )

    schema = StructType([docs.schema["id"], *_PROFILE])
    return docs.select("id", "text").mapInArrow(run, schema)


def _in_shares(rows: DataFrame, by: list[str], size: int, share: int, label: str, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``work`` of all ``rows``, staged share by share.

    ``work`` treats the groups of ``by`` each by itself.  ``size`` is what it shuffles for all rows, in bytes.
    """
    shares = max(1, math.ceil(size / share))
    done = None
    for k in range(shares):
        own = rows if shares == 1 else rows.where(F.pmod(F.xxhash64(*by), F.lit(shares)) == k)
        part = stage(work(own), label)
        _free_shuffles(rows.sparkSession)
        done = part if done is None else done.unionByName(part)
    return done


def _asked(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows of ``sets`` whose node is one of ``nodes`` and few others, without a shuffle of ``sets``."""
    hashed = F.xxhash64("node")
    place, bit = F.pmod(hashed, F.lit(ASKED_ROWS)).alias("_place"), F.shiftrightunsigned(hashed, 58).cast("int")
    flag = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    flags = nodes.select(place, flag.alias("_flag")).groupBy("_place").agg(F.bit_or("_flag").alias("_flags"))
    marked = sets.select("*", place, flag.alias("_flag")).join(F.broadcast(flags), "_place")
    return marked.where(F.col("_flags").bitwiseAND(F.col("_flag")) != 0).select(*sets.columns)


def _search(requests: DataFrame, sets: DataFrame, groups: list[str], share: int, search: Callable[[pa.Table], pa.Table]) -> DataFrame:
    """Links found by ``search`` in each of the ``groups`` of ``requests`` (node, n and others) with the shingles of their nodes."""
    requests = stage(requests, "search-requests")
    size = 8 * (requests.agg(F.sum("n")).first()[0] or 0)

    def work(own: DataFrame) -> DataFrame:
        held = own.drop("n").join(_asked(sets, own), "node")
        return held.groupBy(*groups).applyInArrow(search, "lead long, node long")

    return _in_shares(requests, groups, size, share, "links", work)


def _search_leads(pairs: DataFrame, classes: DataFrame, sets: DataFrame, percent: int, share: int) -> DataFrame:
    """The pairs (lead, node) whose sets link: one DivideSkip search per lead and block of nodes."""
    sizes = classes.select("node", "n")
    sized = pairs.join(sizes, "node").join(sizes.select(F.col("node").alias("lead"), F.col("n").alias("lead_n")), "lead")
    # Sets of too unlike sizes do not link.
    sized = sized.where(f"n * {percent} <= 100 * lead_n and lead_n * {percent} <= 100 * n")
    # As many blocks per lead as its candidates' shingles fill.
    blocks = sized.groupBy("lead").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).alias("blocks"))
    dealt = sized.join(blocks, "lead").select(
        "lead", "lead_n", "node", "n", F.pmod(F.xxhash64("node"), "blocks").alias("block")
    )
    leads = dealt.select("lead", "block", F.lit(True).alias("asks"), F.col("lead").alias("node"), F.col("lead_n").alias("n"))
    requests = dealt.select("lead", "block", F.lit(False).alias("asks"), "node", "n").unionByName(leads.distinct())

    def search(table: pa.Table) -> pa.Table:
        nodes = table.column("node").to_numpy()
        sets = [np.frombuffer(s, np.uint64) for s in table.column("shingles").to_pylist()]
        at = int(np.flatnonzero(table.column("asks").to_numpy())[0])
        others = np.delete(nodes, at)
        query = sets.pop(at)
        found = others[Index(sets).search(query, percent)]
        lead = table.column("lead")[0].as_py()
        return pa.table({"lead": pa.array([lead] * len(found), pa.int64()), "node": pa.array(found, pa.int64())})

    return _search(requests, sets, ["lead", "block"], share, search)


def _block_requests(placed: DataFrame, percent: int) -> DataFrame:
    """Rows (block, other, second, node, n, root): the classes of which two blocks, or one with itself, are searched.

    Each class belongs to a block of its longest list and its size.  Of a block those
    classes are asked for that meet, on a list, one of the other block that has
    another root and, by the sizes there, could be alike in size.
    """
    lengths = _list_facts(placed, length=(F.count("*"), F.sum))
    homes = placed.join(lengths, ["shingle", "part"]).groupBy("node", "n").agg(
        F.max_by("shingle", F.struct("length", "shingle")).alias("home")
    )
    homes = stage(homes.withColumn("band", F.floor(F.log("n") / math.log(100 / percent)) if percent < 100 else F.col("n")), "search-homes")
    parts = homes.groupBy("home", "band").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).alias("parts"))
    blocks = homes.join(parts, ["home", "band"]).select(
        "node", F.xxhash64("home", "band", F.pmod(F.xxhash64("node"), "parts")).alias("block")
    )
    blocks = stage(blocks, "search-blocks")
    here = placed.select("shingle", "node", "n", "root").join(blocks, "node")
    met = here.groupBy("shingle", "block").agg(
        F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("n").alias("fewest"), F.max("n").alias("most")
    )
    other = met.select("shingle", *[F.col(c).alias(f"other_{c}") for c in ("block", "lo", "hi", "fewest", "most")])
    # Two blocks that are one component need no search.
    pairs = (
        met.join(other, "shingle").where("least(lo, other_lo) < greatest(hi, other_hi)")
        .where(f"fewest * {percent} <= 100 * other_most and other_fewest * {percent} <= 100 * most")
        .drop("lo", "hi", "fewest", "most")
    )
    asked = (
        here.join(pairs, ["shingle", "block"]).where("other_lo != root or other_hi != root")
        .where(f"n * {percent} <= 100 * other_most and other_fewest * {percent} <= 100 * n")
    )
    return asked.select(
        F.least("block", "other_block").alias("block"), F.greatest("block", "other_block").alias("other"),
        (F.col("block") > F.col("other_block")).alias("second"), "node", "n", "root",
    ).distinct()


def _search_blocks(placed: DataFrame, sets: DataFrame, percent: int, share: int) -> DataFrame:
    """Links (lead, node) that join all components which meet on a list of ``placed``.

    ``placed`` has a row (shingle, part, node, n, root) per class and list.  Blocks of
    classes that meet on a list are searched against each other, every class of one in
    the inverted lists of the other.  Pairs of classes exist inside a search only, and
    of the links found, those that connect two components so far are returned.
    """

    def search(table: pa.Table) -> pa.Table:
        side = table.column("second").to_numpy()
        nodes, roots = table.column("node").to_numpy(), table.column("root").to_numpy()
        sets = [np.frombuffer(s, np.uint64) for s in table.column("shingles").to_pylist()]
        first = np.flatnonzero(~side)
        itself = table.column("block")[0] == table.column("other")[0]
        second = first if itself else np.flatnonzero(side)
        index = Index([sets[k] for k in second])
        # Component of each row so far: only sets of other components are searched for.
        now = roots.copy()
        lead, node = [], []
        for k in first.tolist():
            others = now[second] != now[k]
            if not others.any():
                continue
            for m in second[index.search(sets[k], percent, others)].tolist():
                if now[k] != now[m]:
                    now[now == max(now[k], now[m])] = min(now[k], now[m])
                    lead.append(int(nodes[k]))
                    node.append(int(nodes[m]))
        return pa.table({"lead": pa.array(lead, pa.int64()), "node": pa.array(node, pa.int64())})

    return _search(_block_requests(placed, percent), sets, ["block", "other"], share, search)


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """Smallest node of each node's component, (node, root), for all nodes that are not roots themselves.

    ``edges`` has two long columns, ``lead`` and ``node``.  Alternating large-
    and small-star steps until nothing changes; each step is staged.  Each edge
    gives a bounded number of rows, however many neighbours its nodes have.
    """
    now = stage(_oriented(edges, "lead", "node"), label)
    sum_ = _checksum(now)
    while True:
        both = now.unionByName(now.select(F.col("root").alias("node"), F.col("node").alias("root")))
        least = both.groupBy("node").agg(F.min("root").alias("least")).withColumn("least", F.least("least", "node"))
        large = both.join(least, "node").where("root > node").select(F.col("root").alias("a"), F.col("least").alias("b"))
        now = _oriented(large, "a", "b")
        least = now.groupBy("node").agg(F.min("root").alias("least"))
        small = now.join(least, "node").select(F.col("root").alias("a"), F.col("least").alias("b"))
        now = stage(_oriented(small.unionByName(least.select(F.col("node").alias("a"), F.col("least").alias("b"))), "a", "b"), label)
        before, sum_ = sum_, _checksum(now)
        if before == sum_:
            return now


def _oriented(edges: DataFrame, a: str, b: str) -> DataFrame:
    return edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("node"), F.least(a, b).alias("root")).distinct()


def _checksum(edges: DataFrame) -> tuple:
    """Equal for equal edge sets, and for others but by a 64-bit accident."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("node", "root"))).first())


def _free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps now, not when the driver next runs short of memory."""
    spark._jvm.System.gc()


@contextlib.contextmanager
def _shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Queries made in here delete their shuffle files as soon as they end."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _with_roots(nodes: DataFrame, roots: DataFrame | None) -> DataFrame:
    if roots is None:
        return nodes.withColumn("root", F.col("node"))
    joined = nodes.join(roots.withColumnRenamed("root", "_root"), "node", "left")
    return joined.select(*nodes.columns, F.coalesce("_root", "node").alias("root"))


def _list_facts(placed: DataFrame, **facts) -> DataFrame:
    """Facts of whole lists, one row per (shingle, part), to be joined to ``placed`` part by part.

    Each fact is a pair: the aggregate over a part, and how those of the parts combine.
    """
    by_part = placed.groupBy("shingle", "part").agg(*[of_part.alias(name) for name, (of_part, _) in facts.items()])
    whole = Window.partitionBy("shingle")
    return by_part.select("shingle", "part", *[merge(name).over(whole).alias(name) for name, (_, merge) in facts.items()])


def _link_classes(classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame | None:
    """(node, root) of all classes whose component has another root; None if there are no links.

    ``sets`` has the shingles of every ``node`` of ``classes``, and maybe of others.
    """
    shingles, places = classes.agg(F.sum("n"), F.sum(F.size("prefix"))).first()
    share = max(LEAST_SHARE, 8 * (shingles or 0) // 4)
    # Each row is one class's place on one list.
    listed = classes.select(F.posexplode("prefix").alias("_place", "shingle"), "node", "n", "rare")
    part = F.when(F.col("_place") < F.col("rare"), 0).otherwise(F.pmod(F.xxhash64("node"), F.lit(LIST_PARTS)).cast("int"))
    listed = listed.select("shingle", part.alias("part"), "node", "n")
    # Only lists with two classes at least.
    listed = _in_shares(
        listed, ["shingle"], PLACE_BYTES * (places or 0), share, "shingle-lists", lambda own: _lists_with_several(own, "node")
    )
    size = PLACE_BYTES * listed.count()
    links, roots = None, None
    for step in range(STAR_ROUNDS + 1):
        placed = _with_roots(listed, roots)
        if step:
            # Lists within one component need no more searches.
            placed = _in_shares(placed, ["shingle"], size, share, "mixed-lists", lambda own: _lists_with_several(own, "root"))
            if placed.isEmpty():
                break
        if step < STAR_ROUNDS:
            found = _search_leads(_star_pairs(placed, roots, step, size, share), classes, sets, percent, share)
        else:
            found = _search_blocks(placed, sets, percent, share)
        links = found if links is None else links.unionByName(found)
        roots = components(links)
    return roots


def _lists_with_several(placed: DataFrame, column: str) -> DataFrame:
    """The rows of the lists that have more than one value of ``column``."""
    several = _list_facts(placed, lo=(F.min(column), F.min), hi=(F.max(column), F.max)).where("lo < hi")
    return placed.join(several, ["shingle", "part"], "left_semi")


def _star_pairs(placed: DataFrame, roots: DataFrame | None, step: int, size: int, share: int) -> DataFrame:
    """(lead, node): every class with the lead it shares most lists with; another lead of each list in each step."""
    shuffle = F.lit(0x5DEECE66D * step)

    def shared_lists(own: DataFrame) -> DataFrame:
        leads = _list_facts(own, lead=(F.min(F.col("node").bitwiseXOR(shuffle)), F.min))
        leads = _with_roots(leads.select("shingle", "part", F.col("lead").bitwiseXOR(shuffle).alias("node")), roots)
        leads = leads.select("shingle", "part", F.col("node").alias("lead"), F.col("root").alias("lead_root"))
        return own.join(leads, ["shingle", "part"]).where("root != lead_root").groupBy("node", "lead").agg(F.count("*").alias("met"))

    met = _in_shares(placed, ["shingle"], size, share, "shared-lists", shared_lists).groupBy("node", "lead").agg(F.sum("met").alias("met"))
    best = met.groupBy("node").agg(F.max_by("lead", F.struct("met", "lead")).alias("lead"))
    return stage(best.select("lead", "node"), "search-pairs")


def near_duplicates(
    docs: DataFrame, size: int = WORDS, percent: int = PERCENT, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: id, ``n_shingles`` and ``component_id``.

    ``component_id`` is the smallest id reachable by links, the row's own
    included.  A null or empty text has no shingles and no links.  Repeated rows
    keep a row each.  A null id counts in no minimum, and the component is null
    if it has no other.  Other columns are ignored; an empty table stays empty.
    Shingles are compared by 64-bit hashes, sets by 128-bit ones.
    """
    given = docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text_column}`").cast("string").alias("text"))
    profiles, rooted = _rooted(given, size, percent)
    smallest = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    of_class = rooted.join(smallest, "root").select("key", "component_id")
    alone = profiles.where("key is null").select("id", "n", F.col("id").alias("component_id"))
    linked = profiles.where("key is not null").select("id", "n", "key").join(of_class, "key").select("id", "n", "component_id")
    return alone.unionByName(linked).select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), "component_id")


def _rooted(given: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The staged profiles of all rows (id, text), and the classes of equal sets with the root of their component.

    A profile without a key has no partner.
    """
    with _shuffles_freed(given.sparkSession):
        numbered = _profiles(given, size, percent).withColumn("node", F.monotonically_increasing_id())
        profiles = stage(numbered, "shingle-profiles")
        _free_shuffles(given.sparkSession)
        # A class is known by one of its rows, whose shingles are read where they were staged.
        classes = profiles.where("key is not null").groupBy("key").agg(
            F.min("id").alias("id"), F.min("node").alias("node"), F.first("n").alias("n"), F.first("prefix").alias("prefix"),
            F.first("rare").alias("rare"),
        )
        classes = stage(classes, "shingle-classes")
        sets = profiles.where("key is not null").select("node", "shingles")
        roots = _link_classes(classes, sets, percent)
    return profiles, _with_roots(classes.select("key", "id", "node"), roots)


def keep_one(
    docs: DataFrame, size: int = WORDS, percent: int = PERCENT, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row of each component of linked rows, with all columns; rows without a link all stay.

    The row with the smallest id stays (null ids last), of equal ids the one with
    the smallest hash of its text; of rows that agree in both, one.  Unlike texts
    stay, whatever ids they share; a null or empty text has no link and stays.
    """
    # A row is known by its id and text together: ids may be repeated.
    kept_id, text = F.col(f"`{id_column}`"), F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit(""))
    mark = F.md5(F.concat(F.coalesce(F.concat(F.lit("="), kept_id.cast("string")), F.lit("")), F.lit("\n"), text))
    own = F.struct(kept_id.isNull().alias("nameless"), kept_id.alias("id"), mark.alias("mark"))
    given = docs.select(own.alias("id"), F.col(f"`{text_column}`").cast("string").alias("text"))
    profiles, rooted = _rooted(given, size, percent)
    members = profiles.where("key is not null").select("id", "key").join(rooted.select("key", "root"), "key")
    first = members.groupBy("root").agg(F.min("id").alias("first"))
    first = first.select(F.col("first.mark").alias("_mark"), F.lit(True).alias("_linked"))
    # Equal rows without a key each stay.
    alone = profiles.where("key is null").select(F.col("id.mark").alias("_mark"), F.lit(False).alias("_linked")).distinct()
    stays = docs.withColumn("_mark", mark).join(first.unionByName(alone), "_mark")
    one = stays.where("_linked").dropDuplicates(["_mark"])
    return one.unionByName(stays.where("not _linked")).select(*[F.col(f"`{c}`") for c in docs.columns])
