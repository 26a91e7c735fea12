"""Conversation prefix trie: which openings conversations share, and what sharing them would save.

1. Each turn becomes an item of 20 bytes as it is read: 16 of the SHA-256 of its role and text, 4 of its text's length in UTF-8
   bytes. Texts are not shuffled. Items are dealt by family of conversations and sorted by Spark, and a conversation's items in
   order are its path.
2. Equal paths form a class. Its conv_ids are hashed in order as a stream of blocks of neighbouring ids, so that a conversation
   with very many copies is pre-aggregated and no list of all of them is held.
3. External mergesort: the tasks that make classes sort them in runs of RUN_BYTES, each row with the number of turns that it shares
   with the row before (LCP). The runs are a table in the shared folder, dealt by ranges of paths; a range's slices of all runs are merged by
   a loser tree that compares by LCP first and looks at turns only from there on, so turns known to be shared are not looked at again.
4. The merged stream passes a stack with the open path: what the next path does not share is finished and leaves the stack. Nodes
   on a range's first or last path may go on in another range; they leave as parts, which are added up by key, and a pass from the
   deepest up gives them the sums of their subtrees. These are as many as ranges times depth, not as rows.

Defined results. Turns are ordered by turn, null first; equal turns by role, then the first HEAD characters of the text, then digest.
Null roles and texts are empty. Rows without conv_id belong to no conversation and take no part. Repeated rows are turns each. A turnless
conversation ends in the root. An empty table has no nodes. Other columns play no part. One task holds one conversation's path (20 bytes a
turn) and one range of paths, of RANGE_BYTES or of the longest path if that is longer.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightline.functions.materialise import discard, materialise

ITEM = 20
HEAD = 64
#: Neighbouring conv_ids of a class that are joined to one text before they are hashed: 2 to this power.
BLOCK_BITS = 12
RUN_BYTES = 4 << 20
RANGE_BYTES = 48 << 20
#: Ranges are as many as the session's shuffle partitions as long as each has so many classes.
RANGE_ROWS = 1000
ROOT = bytes(16)
NO_ENDS = hashlib.sha256(b"").hexdigest()
#: Conversations of a family, conv_id - conv_id % FAMILY, may begin with turns of its first.
FAMILY = 5

NODE = "key binary, parent_key binary, bytes long, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def lent_turns(conv_id: int) -> int:
    """How many turns a conversation takes from the first of its family: 0 to 8, by the CRC-32 of its number."""
    return zlib.crc32(str(conv_id).encode()) % 9


def no_turns(conv_id: int) -> int:
    return 0


def paths(conversations: DataFrame, lent: Callable[[int], int] = no_turns, most_lent: int = 8) -> DataFrame:
    """conv_id, id (a digest of the path) and path of every conversation.

    lent(c): turns of conversation c - c % FAMILY that stand in the place of as many of c's own first turns; at most most_lent.
    """
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    conv = F.col("conv_id").cast("long")
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    item = F.unhex(F.concat(F.substring(digest, 1, 32), F.lpad(F.hex(F.octet_length(text).cast("long")), 8, "0")))
    turns = conversations.where(conv.isNotNull()).select(
        (conv - conv % FAMILY).alias("family"), conv.alias("conv_id"), F.col("turn").alias("turn"), role.alias("role"), F.substring(text, 1, HEAD).alias("head"), item.alias("item")
    )
    turns = turns.withColumn("later", F.col("conv_id") != F.col("family")).repartition("family")
    turns = turns.sortWithinPartitions("family", "later", "conv_id", F.col("turn").asc_nulls_first(), "role", "head", "item").select("family", "conv_id", "item")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, waiting = ([], [], []), 0
        family = now = None
        first, own = b"", bytearray()

        def done() -> int:
            nonlocal first
            if now == family:
                first = bytes(own[: ITEM * most_lent])
            h = ITEM * min(lent(now), most_lent)
            path = first[:h] + bytes(own[h:])
            for to, x in zip(out, (now, hashlib.sha256(path).digest()[:16], path), strict=True):
                to.append(x)
            return 64 + len(path)

        def batch() -> pa.RecordBatch:
            full = pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary())], names=["conv_id", "id", "path"])
            for x in out:
                x.clear()
            return full

        for b in batches:
            for f, c, item in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if c != now:
                    if now is not None:
                        waiting += done()
                        if waiting > RUN_BYTES:
                            yield batch()
                            waiting = 0
                    if f != family:
                        family, first = f, b""
                    now, own = c, bytearray()
                own += item
        if now is not None:
            done()
            yield batch()

    return turns.mapInArrow(build, "conv_id long, id binary, path binary")


def shared_turns(a: bytes, b: bytes, known: int = 0) -> int:
    """Leading turns that two paths share, known of which are known to be."""
    most, i = min(len(a), len(b)) // ITEM, known
    while i < most and a[i * ITEM : (i + 1) * ITEM] == b[i * ITEM : (i + 1) * ITEM]:
        i += 1
    return i


def sorted_runs(rebuilt: DataFrame) -> DataFrame:
    """The classes of equal paths in sorted runs: run, place, lcp, path, n (members), low (the smallest) and ends (hash of all)."""
    block = F.shiftright("conv_id", BLOCK_BITS)
    ids = F.sort_array(F.collect_list("conv_id"))
    blocks = rebuilt.groupBy("id", block.alias("block")).agg(F.first("path").alias("path"), ids.alias("ids"))
    blocks = blocks.select("id", "block", "path", F.size("ids").alias("n"), F.get("ids", F.lit(0)).alias("low"), F.array_join("ids", ",").alias("said"))
    blocks = blocks.repartition("id").sortWithinPartitions("id", "block").select("id", "path", "n", "low", "said")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, rows, held = TaskContext.get().partitionId() << 32, [], 0
        now, path, n, low, digest = None, b"", 0, 0, None

        def batch() -> pa.RecordBatch:
            rows.sort()
            lcp = [0] + [shared_turns(a[0], b[0]) for a, b in zip(rows, rows[1:])]  # noqa: B905
            p, count, least, ends = zip(*rows, strict=True)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.string())
            values = ([run] * len(rows), range(len(rows)), lcp, p, count, least, ends)
            return pa.RecordBatch.from_arrays([pa.array(list(v), k) for v, k in zip(values, kinds, strict=True)], names=["run", "place", "lcp", "path", "n", "low", "ends"])

        for b in batches:
            for i, whole, k, least, said in zip(*(b.column(c).to_pylist() for c in range(5)), strict=True):
                if i != now:
                    if now is not None:
                        rows.append((path, n, low, digest.hexdigest()))
                        held += len(path) + 200
                        if held > RUN_BYTES:
                            yield batch()
                            run, held = run + 1, 0
                            rows.clear()
                    now, path, n, low, digest = i, whole, 0, least, hashlib.sha256()
                else:
                    digest.update(b",")
                n += k
                digest.update(said.encode())
        if now is not None:
            rows.append((path, n, low, digest.hexdigest()))
            yield batch()

    return blocks.mapInArrow(build, "run long, place long, lcp long, path binary, n long, low long, ends string")


def merged(runs: list[tuple[list[bytes], list[int]]]) -> Iterator[tuple[int, int, int]]:
    """Run, place and LCP (with the one before) of all paths in order. runs: the sorted paths of each run and their LCPs within the run."""
    width = 1 << max(0, (len(runs) - 1).bit_length())
    at, lcp = [0] * width, [0] * width
    head: list[bytes | None] = [paths[0] if paths else None for paths, _ in runs] + [None] * (width - len(runs))
    losers = [0] * width

    def better(a: int, b: int) -> tuple[int, int]:
        """Of two runs whose LCPs are those with the last path put out: the one that comes first and the other, which gets its LCP with the first."""
        if head[a] is None or head[b] is None:
            return (b, a) if head[a] is None else (a, b)
        if lcp[a] != lcp[b]:
            return (a, b) if lcp[a] > lcp[b] else (b, a)
        x, y = head[a], head[b]
        both = shared_turns(x, y, lcp[a])
        first, other = (a, b) if x[both * ITEM :] <= y[both * ITEM :] else (b, a)
        lcp[other] = both
        return first, other

    winners = [0] * (2 * width)
    winners[width:] = range(width)
    for node in range(width - 1, 0, -1):
        winners[node], losers[node] = better(winners[2 * node], winners[2 * node + 1])
    top = winners[1]
    while head[top] is not None:
        yield top, at[top], lcp[top]
        at[top] += 1
        inside, within = runs[top]
        if at[top] < len(inside):
            head[top], lcp[top] = inside[at[top]], within[at[top]]
        else:
            head[top] = None
        node = (top + width) // 2
        while node:
            top, losers[node] = better(top, losers[node])
            node //= 2


class Nodes:
    """The nodes of one range of paths; those on the stack are open."""

    def __init__(self) -> None:
        self.parent, self.item, self.depth, self.n, self.low, self.kids, self.leaves, self.saved, self.ends = ([] for _ in range(9))
        self.stack: list[int] = []
        self.first = 0

    def open(self, item: bytes) -> None:
        self.parent.append(self.stack[-1] if self.stack else -1)
        self.depth.append(len(self.stack))
        self.stack.append(len(self.item))
        self.item.append(item)
        for column, value in ((self.n, 0), (self.low, None), (self.kids, 0), (self.leaves, 0), (self.saved, 0), (self.ends, None)):
            column.append(value)

    def close(self, edge: bool) -> None:
        """The top of the stack is finished; with edge it may go on in another range, and its subtree is added up elsewhere."""
        i = self.stack.pop()
        up = self.parent[i]
        if not edge:
            self.leaves[i] = self.leaves[i] or 1
            self.saved[i] += (self.n[i] - 1) * int.from_bytes(self.item[i][16:], "big")
        if up >= 0:
            self.n[up] += self.n[i]
            self.low[up] = self.low[i] if self.low[up] is None else min(self.low[up], self.low[i])
            if not edge:
                self.kids[up] += 1
                self.leaves[up] += self.leaves[i]
                self.saved[up] += self.saved[i]

    def add(self, path: bytes, shared: int, n: int, low: int, ends: str) -> None:
        if not self.stack:
            self.open(b"")
            shared = 0
        while len(self.stack) > shared + 1:
            self.close(self.stack[-1] < self.first)
        for d in range(shared, len(path) // ITEM):
            self.open(path[d * ITEM : (d + 1) * ITEM])
        self.first = self.first or len(self.item)  # the nodes of the first path come first
        i = self.stack[-1]
        self.n[i] += n
        self.low[i] = low if self.low[i] is None else min(low, self.low[i])
        self.ends[i] = ends

    def finish(self) -> Iterator[pa.RecordBatch]:
        edge = {*range(self.first), *self.stack}
        while self.stack:
            self.close(True)
        keys: dict[int, bytes] = {}
        for i in sorted(edge):  # parents were opened before their children
            keys[i] = hashlib.sha256(keys[self.parent[i]] + self.item[i]).digest()[:16] if self.parent[i] >= 0 else ROOT
        kinds = (pa.binary(), pa.binary(), *[pa.int64()] * 8, pa.string())
        for a in range(0, len(self.item), 1 << 16):
            part = range(a, min(a + (1 << 16), len(self.item)))
            up = [self.parent[i] for i in part]
            columns = (
                [keys.get(i) for i in part], [keys.get(u) for u in up], [int.from_bytes(self.item[i][16:], "big") for i in part], [self.depth[i] for i in part], [self.low[i] for i in part],
                [None if u < 0 or u in edge else self.low[u] for u in up], *([c[i] for i in part] for c in (self.n, self.kids, self.leaves, self.saved, self.ends)),
            )
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in NODE.split(", ")])


def range_nodes(runs: DataFrame, ranges: int) -> DataFrame:
    """Nodes of each range of paths: finished ones, and with a key those parts that other ranges may add to."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices, about, now = [], [], None
        for b in batches:
            for run, lcp, path, n, low, ends in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                if run != now:
                    now = run
                    slices.append(([], []))
                    about.append([])
                    lcp = 0  # the row before is in another range
                slices[-1][0].append(path)
                slices[-1][1].append(lcp)
                about[-1].append((n, low, ends))
        nodes = Nodes()
        for run, place, lcp in merged(slices):
            nodes.add(slices[run][0][place], lcp, *about[run][place])
        if slices:
            yield from nodes.finish()

    dealt = runs.repartitionByRange(ranges, "path").sortWithinPartitions("run", "place")
    return dealt.select("run", "lcp", "path", "n", "low", "ends").mapInArrow(merge, NODE)


def edge_sums(edges: DataFrame) -> DataFrame:
    """The nodes of the ranges' edges, each once and with the sums of its subtree. As many rows as ranges times depth pass one task, deepest first."""
    total = {"n_convs": F.sum, "n_children": F.sum, "n_leaves": F.sum, "saved_tokens": F.sum, "conv_id": F.min, "ends_sha256": F.max, "bytes": F.first, "depth": F.first, "parent_key": F.first}
    one = edges.groupBy("key").agg(*(f(c).alias(c) for c, f in total.items()))
    names = ["key", *total]

    def up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        below: dict[bytes, list[int]] = {}
        for b in batches:
            rows = b.to_pylist()
            for r in rows:
                kids, leaves, saved = below.pop(r["key"], (0, 0, 0))
                r["n_children"] += kids
                r["n_leaves"] = r["n_leaves"] + leaves or 1
                r["saved_tokens"] += saved + (r["n_convs"] - 1) * r["bytes"]
                if r["parent_key"] is not None:
                    to = below.setdefault(r["parent_key"], [0, 0, 0])
                    to[0] += 1
                    to[1] += r["n_leaves"]
                    to[2] += r["saved_tokens"]
            yield pa.RecordBatch.from_pylist(rows, schema=b.schema)

    return one.select(*names).coalesce(1).sortWithinPartitions(F.desc("depth")).mapInArrow(up, one.select(*names).schema)


def trie(rebuilt: DataFrame) -> DataFrame:
    """One row for each node of the trie of rows (conv_id, id, path), as paths() gives them."""
    spark = rebuilt.sparkSession
    runs = materialise(sorted_runs(rebuilt), "runs")
    n, size = runs.agg(F.count("*"), F.sum(F.octet_length("path"))).first()
    ranges = max(1, math.ceil((size or 0) / RANGE_BYTES), min(int(spark.conf.get("spark.sql.shuffle.partitions")), n // RANGE_ROWS))
    nodes = materialise(range_nodes(runs, ranges), "nodes")
    discard(runs)
    edges = materialise(edge_sums(nodes.where("key is not null")), "edges")
    above = edges.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("above"))
    inner = nodes.where("key is null")
    out = inner.where("parent_key is null").select(*COLUMNS)
    out = out.unionByName(inner.where("parent_key is not null").join(above, "parent_key").withColumn("parent_conv_id", F.col("above")).select(*COLUMNS))
    out = out.unionByName(edges.join(above, "parent_key", "left").withColumn("parent_conv_id", F.col("above")).select(*COLUMNS))
    return out.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS)))
