"""Operator 12: a prefix trie of conversations by one global sort.

Arrays of turns (digests of role and text) are range-sorted, so that the members of
every node stand together. A task sweeps its range with a stack: the longest common
prefix of neighbours says which nodes close. Nodes on the first and the last path of a
range may go on in the ranges beside it: they leave the task open, as parts, and one
sweep over the parts of all ranges, in their order, stitches them.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import stored, tidy

#: Rows in a batch of results, and members whose decimal ids one row holds.
ROWS, ENDS = 4096, 50_000
#: Rows of children that wait for their parent's smallest member; when more do, all
#: are handed on and meet it in a join.
WAITING = 20_000

def rebuilt_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id and turns (array of role and text): the first h turns of conversation
    c - c % 5, then those of c after its first h; h = crc32 of the decimal c, modulo 9.

    Turns are ordered by turn, role and text (null first); null roles and texts are
    empty. Rows without conv_id belong to no conversation. The turns that others may
    take are at most 8 a conversation."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    own = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", text("role").alias("role"), text("text").alias("text")).where("conv_id is not null")
    placed = own.withColumn("at", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")))
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    base = F.col("conv_id") - F.col("conv_id") % 5
    said = F.struct(F.col("at"), "role", "text")
    tails = placed.groupBy("conv_id").agg(F.collect_list(F.when(F.col("at") > head, said)).alias("own"))
    heads = placed.where((F.col("conv_id") % 5 == 0) & (F.col("at") <= 8)).groupBy(F.col("conv_id").alias("base")).agg(F.collect_list(said).alias("head"))
    both = tails.withColumn("base", base).join(heads, "base", "left")
    taken = F.filter(F.coalesce("head", F.array().cast("array<struct<at:int,role:string,text:string>>")), lambda t: t["at"] <= head)
    ordered = F.concat(F.array_sort(taken), F.array_sort("own"))
    return both.select("conv_id", F.transform(ordered, lambda t: F.struct(t["role"], t["text"])).alias("turns"))


class _Level:
    """A node on the stack, or the part of it that one range holds."""

    __slots__ = ("node", "parent", "bytes", "seq", "open", "least", "members", "children", "leaves", "saved", "ends", "waiting", "asked")

    def __init__(self, node: bytes, parent: bytes | None, size: int, seq: int, goes_on: bool):
        self.node, self.parent, self.bytes, self.seq, self.open = node, parent, size, seq, goes_on
        self.least, self.ends, self.waiting, self.asked = None, array("q"), [], False
        self.members = self.children = self.leaves = self.saved = 0

    def add(self, least: int | None, members: int, children: int, leaves: int, saved: int) -> None:
        """Counts members and what lies below the node."""
        if least is not None and (self.least is None or least < self.least):
            self.least = least
        self.members += members
        self.children += children
        self.leaves += leaves
        self.saved += saved


#: Rows of a sweep. kind: node (whole), part (of a node that may go on in other
#: ranges) or ends (decimal ids of members that end at such a node). asked: children
#: of the node may be rows that lack its smallest member.
_FIELDS = [("kind", pa.string()), ("range_no", pa.int32()), ("seq", pa.int64()), ("depth", pa.int64()), ("node", pa.binary()), ("parent", pa.binary()), ("bytes", pa.int64())]
_FIELDS += [(k, pa.int64()) for k in ("conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")] + [("ends", pa.string()), ("asked", pa.bool_())]
_ARROW = pa.schema(_FIELDS)
_SWEPT = "kind string, range_no int, seq long, depth long, node binary, parent binary, bytes long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string, asked boolean"
_PARENT_LEAST = _ARROW.get_field_index("parent_conv_id")


def _digest(ends: str) -> str:
    return hashlib.sha256(ends.encode()).hexdigest()


class _Sweep:
    """The stack of a path's nodes. Nodes are pushed in preorder; those that leave it
    give rows in `out`."""

    def __init__(self, range_no: int):
        self.stack: list[_Level] = []
        self.out: list[tuple] = []
        self.range_no, self.pushed, self.waiting = range_no, 0, 0

    def push(self, node: bytes, size: int, goes_on: bool) -> _Level:
        parent = self.stack[-1].node if self.stack else None
        self.stack.append(level := _Level(node, parent, size, self.pushed, goes_on))
        self.pushed += 1
        return level

    def row(self, kind: str, level: _Level, depth: int, ends: str | None) -> tuple:
        return (kind, self.range_no, level.seq, depth, level.node, level.parent, level.bytes, level.least, None, level.members, level.children, level.leaves, level.saved, ends, level.asked)

    def pop(self) -> None:
        """Takes the deepest node off: a whole one adds to its parent, a part stays
        for the stitching, with all its ends."""
        level, depth = self.stack.pop(), len(self.stack)
        if level.open:
            self.hand_on(level)
            for at in range(0, len(level.ends), ENDS):
                ends = ",".join(map(str, level.ends[at : at + ENDS]))
                self.out.append(("ends", self.range_no, at, depth, level.node, *[None] * 8, ends, None))
            self.out.append(self.row("part", level, depth, None))
            return
        level.saved += (level.members - 1) * level.bytes
        level.leaves = level.leaves or 1
        self.out += [(*w[:_PARENT_LEAST], level.least, *w[_PARENT_LEAST + 1 :]) for w in level.waiting]
        self.waiting -= len(level.waiting)
        made = self.row("node", level, depth, _digest(",".join(map(str, level.ends))))
        if not self.stack:
            self.out.append(made)
            return
        parent = self.stack[-1]
        parent.add(level.least, level.members, 1, level.leaves, level.saved)
        parent.waiting.append(made)
        self.waiting += 1
        if parent.open:
            self.hand_on(parent)
        elif self.waiting > WAITING:
            for other in self.stack:
                self.hand_on(other)

    def hand_on(self, level: _Level) -> None:
        """Children of a node whose smallest member is not yet known: a join finds it."""
        if level.waiting:
            level.asked = True
            self.out += level.waiting
            self.waiting -= len(level.waiting)
            level.waiting = []

    def taken(self, all_of_it: bool = False) -> Iterator[pa.RecordBatch]:
        while len(self.out) >= ROWS or (all_of_it and self.out):
            some, self.out = self.out[:ROWS], self.out[ROWS:]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), _ARROW, strict=True)], schema=_ARROW)


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sweeps one range of sorted arrays."""
    sweep = _Sweep(TaskContext.get().partitionId())
    before: list[bytes] | None = None
    for batch in batches:
        for conv, keys, sizes in zip(*[batch.column(k).to_pylist() for k in ("conv_id", "keys", "sizes")], strict=True):
            if before is None:
                same, first = 0, True
                sweep.push(b"", 0, True)
            else:
                first = False
                same = next((k for k, (a, b) in enumerate(zip(before, keys, strict=False)) if a != b), min(len(before), len(keys)))
            while len(sweep.stack) > same + 1:
                sweep.pop()
            for depth in range(same, len(keys)):
                sweep.push(hashlib.sha256(sweep.stack[-1].node + keys[depth]).digest(), sizes[depth], first)
            sweep.stack[-1].add(conv, 1, 0, 0, 0)
            sweep.stack[-1].ends.append(conv)
            before = keys
            yield from sweep.taken()
    for level in sweep.stack:
        level.open = True
    while sweep.stack:
        sweep.pop()
    yield from sweep.taken(True)


def _stitched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sweeps the parts of all ranges, by range and preorder: parts of one node follow
    one another on its level of the stack."""
    sweep = _Sweep(-1)
    for batch in batches:
        for p in batch.to_pylist():
            depth, stack = p["depth"], sweep.stack
            if len(stack) <= depth or stack[depth].node != p["node"]:
                while len(stack) > depth:
                    sweep.pop()
                sweep.push(p["node"], p["bytes"], False)
                stack[-1].asked = True
            stack[depth].add(p["conv_id"], p["n_convs"], p["n_children"], p["n_leaves"], p["saved_tokens"])
            yield from sweep.taken()
    while sweep.stack:
        sweep.pop()
    yield from sweep.taken(True)


def _ends_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest a node of its ends, which come in order; holds one row of them."""
    node, sha = None, None
    for batch in batches:
        nodes, digests = [], []
        for at, ends in zip(batch.column("node").to_pylist(), batch.column("ends").to_pylist(), strict=True):
            if at != node:
                if node is not None:
                    nodes.append(node), digests.append(sha.hexdigest())
                node, sha = at, hashlib.sha256(ends.encode())
            else:
                sha.update(b"," + ends.encode())
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(digests, pa.string())], ["node", "stitched_ends"])
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([sha.hexdigest()])], ["node", "stitched_ends"])


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The nodes of the trie of `conversations` (conv_id, turns: array of role and
    text): a row for each distinct sequence of first turns, from the textless root.

    conv_id (smallest member), depth, parent_conv_id (its parent's, null for the
    root), n_convs (members), n_children, n_leaves (childless nodes of its subtree),
    saved_tokens (over its subtree, (n_convs - 1) times the UTF-8 bytes of a node's
    last text), ends_sha256 (of the members that end here: decimal ids, ascending,
    joined by commas).

    Null turns are none, a null role or text is empty, rows without conv_id are left
    out, and each row of a repeated conv_id is a member. Further columns are not read.
    An empty table has no nodes. A range of conversations is swept by one task with
    its current path in memory, and 8 bytes for each member that ends there; what is
    stitched in one task is the first and last path of each range."""
    turn = lambda t, k: F.coalesce(t[k].cast("string"), F.lit(""))
    turns = F.coalesce("turns", F.array().cast(conversations.schema["turns"].dataType))
    key = lambda t: F.unhex(F.sha2(F.concat(F.length(turn(t, "role")).cast("string"), F.lit(":"), turn(t, "role"), turn(t, "text")), 256))
    keyed = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.transform(turns, key).alias("keys"), F.transform(turns, lambda t: F.octet_length(turn(t, "text")).cast("long")).alias("sizes"))
    # equal arrays are dealt by conv_id, so that copies of one conversation split
    ranges = keyed.repartitionByRange("keys", "conv_id").sortWithinPartitions("keys", "conv_id")
    swept = stored(ranges.mapInArrow(tidy(_swept), _SWEPT), "trie-ranges")
    parts = swept.where("kind = 'part'").repartition(1).sortWithinPartitions("range_no", "seq")
    whole = parts.mapInArrow(tidy(_stitched), _SWEPT)
    ends = swept.where("kind = 'ends'").repartition("node").sortWithinPartitions("node", "range_no", "seq").select("node", "ends")
    digests = ends.mapInArrow(_ends_digests, "node binary, stitched_ends string")
    stitched = stored(whole.join(digests, "node", "left").withColumn("ends", F.coalesce("stitched_ends", F.lit(_digest("")))).drop("stitched_ends"), "trie-stitched")
    nodes = swept.where("kind = 'node'").unionByName(stitched)
    known = F.col("parent_conv_id").isNotNull() | (F.col("depth") == 0)
    parents = nodes.where("asked").select(F.col("node").alias("parent"), F.col("conv_id").alias("least"))
    met = nodes.where(~known).join(parents, "parent").withColumn("parent_conv_id", F.col("least"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.col("ends").alias("ends_sha256")]
    return nodes.where(known).select(*columns).unionByName(met.select(*columns))
