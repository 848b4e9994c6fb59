"""Prefix trie of conversations: which turns many conversations begin with.

Conversations are sorted by the hashes of their turns, so those with a common
beginning stand side by side, and neighbours give edges as deep as the beginning
they share.  Union-find takes the edges in descending depth: every merge of
components makes a branching node, and the turns between two branching nodes are
the nodes of one chain.  Ranges of the sorted conversations are worked on apart.
What a range cannot close, because a neighbour may share it, is contracted to
one open node per depth; these forests are merged across their boundaries in the
same way, some dozens at a time, until one is left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewatch.sources.staging import stage, stage_in_slots

# Bytes of a turn's hash.
STEP = 16
# Forests that are merged at a time.
FAN = 64
# Digest of nothing.
EMPTY = hashlib.sha256(b"").hexdigest()

_WORD = "[^\\x20\\x09-\\x0D]+"
_NODE = [
    ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()),
    ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends_sha256", pa.string()),
    # Keys of nodes that were open for a while, and of such a parent.
    ("own_key", pa.binary()), ("parent_key", pa.binary()),
]
_ITEM = pa.struct([
    ("last", pa.bool_()), ("depth", pa.int64()), ("n", pa.int64()), ("first", pa.int64()), ("kids", pa.int64()),
    ("leaves", pa.int64()), ("saved", pa.int64()), ("ends", pa.string()),
])
_FOREST = [
    ("slot", pa.int64()), ("left", pa.int64()), ("right", pa.int64()), ("first_path", pa.binary()),
    ("first_words", pa.list_(pa.int64())), ("last_path", pa.binary()), ("last_words", pa.list_(pa.int64())),
    ("items", pa.list_(_ITEM)),
]
_BOTH = pa.schema([*_NODE, *_FOREST])
_BOTH_DDL = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
    "ends_sha256 string, own_key binary, parent_key binary, slot long, left long, right long, first_path binary, "
    "first_words array<long>, last_path binary, last_words array<long>, items array<struct<last:boolean,depth:long,"
    "n:long,first:long,kids:long,leaves:long,saved:long,ends:string>>"
)
TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def shared_depth(a: bytes, b: bytes) -> int:
    """Turns that two paths have in common at their beginning."""
    low, high = 0, min(len(a), len(b)) // STEP
    while low < high:
        middle = (low + high + 1) // 2
        if a[low * STEP: middle * STEP] == b[low * STEP: middle * STEP]:
            low = middle
        else:
            high = middle - 1
    return low


class Node:
    """The topmost node of a component, still open: others may join it."""

    __slots__ = ("path", "words", "depth", "n", "first", "kids", "leaves", "saved", "ends", "kept", "floor", "waiting")

    def __init__(self, path, words, depth, n, first, kids=0, leaves=0, saved=0, ends=None, kept=False):
        self.path, self.words, self.depth, self.n, self.first = path, words, depth, n, first
        # Sums over the children: leaves and saved tokens of their subtrees.
        self.kids, self.leaves, self.saved, self.ends = kids, leaves, saved, ends
        # Whether it came from a contracted forest, so that rows may refer to its key.
        self.kept = kept
        # The deepest level that must stay open, and rows of children that lack their parent's id.
        self.floor, self.waiting = -1, []

    def key(self) -> bytes:
        return hashlib.md5(self.path[: self.depth * STEP]).digest()

    def lift(self, depth: int, out: list) -> None:
        """Close this node and those above it, down to an open one at ``depth``."""
        while self.depth > depth:
            for row in self.waiting:
                row[2] = self.first
            out += self.waiting
            leaves = self.leaves if self.kids else 1
            saved = self.saved + ((self.n - 1) * self.words[self.depth - 1] if self.depth else 0)
            own = self.key() if self.kept else None
            self.waiting = [[
                self.first, self.depth, None, self.n, self.kids, leaves, saved, self.ends or EMPTY, own, None,
            ]]
            self.depth, self.kids, self.leaves, self.saved, self.ends, self.kept = self.depth - 1, 1, leaves, saved, None, False

    def join(self, other: Node) -> None:
        """Take in the same node of another component."""
        self.n += other.n
        self.first = min(self.first, other.first)
        self.kids += other.kids
        self.leaves += other.leaves
        self.saved += other.saved
        self.ends = self.ends or other.ends
        self.kept |= other.kept
        self.floor = max(self.floor, other.floor)
        if len(other.waiting) > len(self.waiting):
            self.waiting, other.waiting = other.waiting, self.waiting
        self.waiting += other.waiting


def contract(nodes: list[Node], left: int, right: int) -> tuple[list[list], list[Node]]:
    """Rows of all nodes that can be closed, and what stays open, in order.

    ``nodes`` are sorted by path.  ``left`` and ``right`` are how deep the first
    and the last one share their beginning with what stands before and after;
    -1 if nothing does, and then the last open node is closed, the root.
    """
    out: list[list] = []
    nodes[0].floor = left
    nodes[-1].floor = max(nodes[-1].floor, right)
    depths = np.array([
        min(shared_depth(a.path, b.path), a.depth, b.depth) for a, b in zip(nodes, nodes[1:])
    ], np.int64)
    above = list(range(len(nodes)))

    def find(i: int) -> int:
        while above[i] != i:
            above[i] = above[above[i]]
            i = above[i]
        return i

    for i in np.argsort(-depths, kind="stable").tolist():
        depth = int(depths[i])
        a, b = find(i), find(i + 1)
        one, two = nodes[a], nodes[b]
        if depth >= one.floor and depth >= two.floor:
            one.lift(depth, out)
            two.lift(depth, out)
            one.join(two)
            above[b] = a
        elif depth >= two.floor:
            # Its parent at this depth belongs to a part that stays open.
            two.floor = depth
            two.lift(depth, out)
        elif depth >= one.floor:
            one.floor = depth
            one.lift(depth, out)
    rest = [nodes[i] for i in range(len(nodes)) if above[i] == i]
    for node in rest:
        node.lift(node.floor, out)
        if node.floor >= 0:
            key = node.key()
            for row in node.waiting:
                row[9] = key
        out += node.waiting
        node.waiting = []
    return out, [node for node in rest if node.floor >= 0]


def _table(rows: list[list], forest: dict | None) -> pa.Table:
    """Node rows and, as one more row, the forest."""
    columns = list(zip(*rows)) or [()] * len(_NODE)
    more = 1 if forest else 0
    arrays = [pa.array([*c, *[None] * more], f.type) for c, f in zip(columns, _BOTH)]
    for field in list(_BOTH)[len(_NODE):]:
        value = [forest[field.name]] if forest else []
        arrays.append(pa.array([*[None] * len(rows), *value], field.type))
    return pa.Table.from_arrays(arrays, schema=_BOTH)


def _contracted(slot: int, nodes: list[Node], left: int, right: int) -> pa.Table:
    """What `contract` finds; the open nodes lie on the beginnings of the first and last path."""
    first, last = nodes[0], nodes[-1]
    ends = [(n.path, n.words) for n in (first, last)]
    rows, rest = contract(nodes, left, right)
    if not rest:
        return _table(rows, None)
    (first_path, first_words), (last_path, last_words) = ends
    items = [
        {
            "last": node.depth > shared_depth(first_path, node.path), "depth": node.depth, "n": node.n,
            "first": node.first, "kids": node.kids, "leaves": node.leaves, "saved": node.saved, "ends": node.ends,
        }
        for node in rest
    ]
    deep = max((i["depth"] for i in items if not i["last"]), default=0)
    deep_last = max((i["depth"] for i in items if i["last"]), default=0)
    deep_last = max(deep_last, right)
    deep = max(deep, left)
    return _table(rows, {
        "slot": slot, "left": left, "right": right, "items": items,
        "first_path": first_path[: deep * STEP], "first_words": first_words[:deep],
        "last_path": last_path[: deep_last * STEP], "last_words": last_words[:deep_last],
    })


def _classes_of(range_: pa.Table, bounds: pa.Table) -> pa.Table:
    """The first step: conversations of a range, and what stands before and after it."""
    range_ = range_.sort_by("path")
    nodes = [
        Node(path, words, len(words), n, first, ends=ends)
        for path, words, n, first, ends in zip(*(range_.column(c).to_pylist() for c in ("path", "words", "n", "first", "ends")))
    ]
    before, after = bounds.column("before")[0].as_py(), bounds.column("after")[0].as_py()
    left = -1 if before is None else shared_depth(before, nodes[0].path)
    right = -1 if after is None else shared_depth(nodes[-1].path, after)
    return _contracted(bounds.column("slot")[0].as_py(), nodes, left, right)


def _merged(forests: pa.Table) -> pa.Table:
    """The next steps: neighbouring forests."""
    given = sorted(forests.to_pylist(), key=lambda f: f["slot"])
    nodes = []
    for forest in given:
        for item in forest["items"]:
            side = "last" if item.pop("last") else "first"
            nodes.append(Node(forest[f"{side}_path"], forest[f"{side}_words"], **item, kept=True))
    return _contracted(given[0]["group"], nodes, given[0]["left"], given[-1]["right"])


def _turn_hash(role: Column, text: Column) -> Column:
    """128 bits of a turn, as hex digits."""
    return F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))


def turn_lists(turns: DataFrame) -> DataFrame:
    """``conv_id`` and ``turns``: an array of (turn, hash, words) in order.

    Null turns come first; turns with the same number are in order of their hash.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    step = F.struct(
        F.col("turn"), _turn_hash(role, text).alias("hash"),
        F.regexp_count(text, F.lit(_WORD)).cast("long").alias("words"),
    )
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), step.alias("step"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("step")).alias("turns"))


def with_shared_heads(lists: DataFrame, block: int = 20, most: int = 4) -> DataFrame:
    """Conversations whose first turns are those of the first conversation of their block.

    Conversation c takes the first h turns of c - c % ``block`` (all if it has
    fewer, none if it is absent) in place of its own first h; h = crc32(c) % ``most``.
    """
    heads = lists.where(F.col("conv_id") % block == 0).select(
        F.col("conv_id").alias("_leader"), F.slice("turns", 1, most).alias("_head")
    )
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    led = lists.join(heads, F.col("conv_id") - F.col("conv_id") % block == F.col("_leader"), "left")
    nothing = F.array().cast(lists.schema["turns"].dataType)
    head = F.slice(F.coalesce("_head", nothing), F.lit(1), h)
    own = F.slice("turns", h + 1, F.size("turns"))
    return led.select("conv_id", F.concat(head, own).alias("turns"))


def conversation_classes(lists: DataFrame) -> DataFrame:
    """Equal conversations as one: ``path``, ``words``, ``n``, ``first`` (id) and ``ends`` (digest of the ids).

    A class may hold most conversations: its ids are listed by ranges, and only
    the lists stream into the digest, in ascending order.
    """
    path = F.unhex(F.array_join(F.transform("turns", lambda t: t["hash"]), ""))
    words = F.transform("turns", lambda t: t["words"])
    paths = lists.select("conv_id", path.alias("path"), words.alias("words"))
    ranged = paths.repartitionByRange("path", "conv_id").withColumn("_range", F.spark_partition_id())
    ids = F.transform(F.sort_array(F.collect_list("conv_id")), lambda i: i.cast("string"))
    listed = ranged.groupBy("_range", "path").agg(
        F.first("words").alias("words"), F.count("*").alias("n"), F.min("conv_id").alias("first"),
        F.array_join(ids, ",").alias("ids"),
    ).drop("_range")

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sha = None

        def row():
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([held[0]], pa.binary()), pa.array([held[1]], pa.list_(pa.int64())),
                    pa.array([held[2]], pa.int64()), pa.array([held[3]], pa.int64()), pa.array([sha.hexdigest()]),
                ],
                ["path", "words", "n", "first", "ends"],
            )

        for batch in batches:
            done = []
            for path, words, n, first, ids in zip(*batch.to_pydict().values()):
                if held is not None and held[0] == path:
                    held[2] += n
                    sha.update(b",")
                else:
                    if held is not None:
                        done.append((*held, sha.hexdigest()))
                    held, sha = [path, words, n, first], hashlib.sha256()
                sha.update(ids.encode())
            if done:
                columns = list(zip(*done))
                kinds = (pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds)], ["path", "words", "n", "first", "ends"]
                )
        if held is not None:
            yield row()

    streamed = listed.repartition("path").sortWithinPartitions("path", "first")
    return streamed.mapInArrow(digest, "path binary, words array<long>, n long, first long, ends string")


def prefix_trie(lists: DataFrame, slots: int | None = None, fan: int = FAN) -> DataFrame:
    """One row per distinct beginning of the conversations ``lists`` (``conv_id``, ``turns``).

    ``conv_id`` is the smallest member, ``depth`` the turns of the beginning
    (0: the root), ``parent_conv_id`` the smallest member of the parent (null for
    the root), ``n_convs`` the members, ``n_children``, ``n_leaves`` and
    ``saved_tokens`` over the subtree, ``ends_sha256`` the digest of the ids of
    the members that end there.  No conversations give no rows.

    A conversation's turns without their texts, some 40 bytes each, are one array.
    ``slots`` sets the number of ranges; by default they follow the data.
    """
    classes = stage_in_slots(conversation_classes(lists), "turn-paths", ["path"], "slot", slots)
    # One row per range.
    ranges = classes.groupBy("slot").agg(F.min("path").alias("low"), F.max("path").alias("high"))
    beside = Window.orderBy("slot")
    bounds = ranges.select(
        "slot", F.lag("high").over(beside).alias("before"), F.lead("low").over(beside).alias("after")
    )
    step = classes.groupBy("slot").cogroup(bounds.groupBy("slot")).applyInArrow(_classes_of, _BOTH_DDL)
    steps = [stage(step, "turn-forests")]
    while True:
        forests = steps[-1].where("slot is not null")
        if forests.isEmpty():
            break
        group = F.expr(f"slot div {fan}").alias("group")
        merged = forests.select(group, *[name for name, _ in _FOREST]).groupBy("group").applyInArrow(_merged, _BOTH_DDL)
        steps.append(stage(merged, "turn-forests"))

    found = steps[0]
    for step in steps[1:]:
        found = found.unionByName(step)
    nodes = found.where("slot is null")
    settled = nodes.where("parent_key is null").select(*TRIE)
    parents = nodes.where("own_key is not null").select(F.col("own_key").alias("parent_key"), F.col("conv_id").alias("_parent"))
    late = nodes.where("parent_key is not null").join(parents, "parent_key")
    late = late.withColumn("parent_conv_id", F.col("_parent")).select(*TRIE)
    return settled.unionByName(late)
