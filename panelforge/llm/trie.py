"""Conversation prefix trie by time-forward processing: nodes in reverse level order pass subtree totals to their parents through spilling queues."""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.kernels import U
from panelforge.llm.shared import materialize

#: A subtree that at most so many later turns, or 1 in SHARES of all, run through is worked on in one shard.
SHARD_TURNS, SHARES = 1000, 4096
#: Messages of a queue that are kept in memory; more go to the executor's scratch as sorted runs, which end with the task.
QUEUE_ROWS = 1 << 20
#: A base conversation in each run of 5; prefixes of 0 to 8 turns.
STRIDE, PREFIXES = 5, 9

_MESSAGE = np.dtype([("key", "S16"), ("children", np.int64), ("leaves", np.int64), ("saved", np.int64)])


def running_sums(rows: DataFrame, key: str, order: list[str], values: list[str], name: str) -> DataFrame:
    """rows with, for each long column v of values, v_upto and v_before: its sums (modulo 2^64) over the rows of one key (a long, never null) with and without the row itself.

    Rows are dealt by ranges of (key, order) and summed where they lie; a key that goes over several ranges is carried on from one row a
    range. So a key may hold any share of the rows.
    """
    schema = rows.schema.simpleString()[7:-1]
    both = [f"{v}_{x}" for v in values for x in ("upto", "before")]
    more = ", ".join(f"{c} long" for c in both)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, done, last, carried = TaskContext.get().partitionId(), 0, None, np.zeros(len(values), U)
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            k = b.column(b.schema.get_field_index(key)).to_numpy()
            first = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
            run = np.cumsum(np.append(0, k[1:] != k[:-1]))
            cols = []
            for j, v in enumerate(values):
                x = b.column(b.schema.get_field_index(v)).to_numpy().view(U)
                sums = np.cumsum(x, dtype=U)
                base = (sums - x)[first]
                if last == k[0]:
                    base[0] -= carried[j]
                upto = sums - base[run]
                carried[j] = upto[-1]
                cols += [upto.view(np.int64), (upto - x).view(np.int64)]
            last = k[-1]
            extra = [pa.array(c) for c in cols] + [pa.array(np.full(n, part, np.int32)), pa.array(np.arange(done, done + n))]
            done += n
            yield pa.RecordBatch.from_arrays([*b.columns, *extra], names=[*b.schema.names, *both, "__part", "__at"])

    dealt = rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    table = materialize(dealt.mapInArrow(local, f"{schema}, {more}, __part int, __at long"), name)
    upto = [f"{v}_upto" for v in values]
    edges = table.groupBy("__part").agg(F.min(key).alias("first"), F.max_by(F.struct(key, *upto), "__at").alias("last")).orderBy("__part").collect()  # a row for each range
    offsets: dict[int, tuple[int, np.ndarray]] = {}
    before, carried = None, np.zeros(len(values), U)
    for part, first, last in edges:
        own = np.array(last[1:], np.int64).view(U)
        if before == first:
            offsets[part] = (first, carried.copy())
        carried = own + carried if before == first == last[0] else own
        before = last[0]

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k, parts = b.column(b.schema.get_field_index(key)).to_numpy(), b.column(b.schema.get_field_index("__part")).to_numpy()
            cols = {c: b.column(b.schema.get_field_index(c)).to_numpy().view(U).copy() for c in both}
            for part in np.unique(parts):
                if int(part) in offsets:
                    first, off = offsets[int(part)]
                    at = (parts == part) & (k == first)
                    for j, v in enumerate(values):
                        cols[f"{v}_upto"][at] += off[j]
                        cols[f"{v}_before"][at] += off[j]
            keep = [c for c in b.schema.names if c not in cols and c not in ("__part", "__at")]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in keep), *(pa.array(c.view(np.int64)) for c in cols.values())], names=[*keep, *cols])

    return table.mapInArrow(carry, f"{schema}, {more}")


def _combined(m: np.ndarray) -> np.ndarray:
    """Messages by ascending key, one for each."""
    m = m[np.argsort(m["key"], kind="stable")]
    first = np.flatnonzero(np.append(True, m["key"][1:] != m["key"][:-1]))
    out = np.empty(len(first), _MESSAGE)
    out["key"] = m["key"][first]
    for c in ("children", "leaves", "saved"):
        out[c] = np.add.reduceat(m[c], first)
    return out


class ForwardQueue:
    """A priority queue of messages to the next higher level, smallest key first. Beyond `limit` messages sorted runs are spilled to a file without a name."""

    def __init__(self, limit: int | None = None):
        self.limit, self.depth = limit or QUEUE_ROWS, None
        self.fresh: list[np.ndarray] = []
        self.waiting: list[np.ndarray] = []  # sorted runs to the level above
        self.runs: list[list] = []  # [run, taken so far] of the level at hand

    def push(self, messages: np.ndarray) -> None:
        if len(messages):
            self.fresh.append(messages)
            if sum(map(len, self.fresh)) > self.limit:
                self._close()

    def _close(self) -> None:
        run = _combined(np.concatenate(self.fresh))
        self.fresh = []
        if len(run) > self.limit // 2:
            scratch = (os.environ.get("SPARK_LOCAL_DIRS") or "").split(",")[0] or None
            with tempfile.TemporaryFile(dir=scratch) as f:
                f.write(run.tobytes())
                f.flush()
                run = np.memmap(f, _MESSAGE, "r")
        self.waiting.append(run)

    def level(self, depth: int) -> None:
        """From now on, nodes of this depth take what was pushed by those one below it."""
        if self.fresh:
            self._close()
        self.runs = [[r, 0] for r in self.waiting] if self.depth == depth + 1 else []
        self.depth, self.waiting = depth, []

    def take(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sums of the messages to the level's next keys, which are ascending."""
        out = tuple(np.zeros(len(keys), np.int64) for _ in range(3))
        for entry in self.runs:
            run, lo = entry
            hi = lo + int(np.searchsorted(run["key"][lo:], keys[-1], "right"))
            at = np.searchsorted(keys, run["key"][lo:hi])
            for o, c in zip(out, ("children", "leaves", "saved"), strict=True):
                np.add.at(o, at, run[c][lo:hi])
            entry[1] = hi
        return out


def _keys(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """16 bytes that sort as (hi, lo) do."""
    out = np.empty((len(hi), 2), ">u8")
    out[:, 0], out[:, 1] = hi.view(U) ^ U(1 << 63), lo.view(U) ^ U(1 << 63)
    return out.view("S16").ravel()


_TOTALS = "depth long, k1 long, k2 long, p1 long, p2 long, top boolean, n_children long, n_leaves long, saved_tokens long"


def time_forward(nodes: DataFrame) -> DataFrame:
    """Totals of nodes (depth, k1, k2, p1, p2, top, own, children, leaves, saved), each partition a set of whole shards.

    top: the parent is elsewhere; own: the node's own share of saved; the last three: what has come from elsewhere. A node without
    children is a leaf. No column may be null. Partitions are sorted by Spark, deepest level first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue = ForwardQueue()
        for b in batches:
            depth, k1, k2, p1, p2, top, own, c, leaves, saved = (x.to_numpy(zero_copy_only=False) for x in b.columns)
            totals = np.empty((3, len(depth)), np.int64)
            cuts = np.flatnonzero(np.append(True, depth[1:] != depth[:-1])) if len(depth) else []
            for a, z in zip(cuts, np.append(cuts[1:], len(depth)), strict=True) if len(depth) else ():
                if queue.depth != depth[a]:
                    queue.level(int(depth[a]))
                got = queue.take(_keys(k1[a:z], k2[a:z]))
                totals[0, a:z] = c[a:z] + got[0]
                totals[1, a:z] = np.where(totals[0, a:z] == 0, 1, leaves[a:z] + got[1])
                totals[2, a:z] = saved[a:z] + got[2] + own[a:z]
                send = a + np.flatnonzero(~top[a:z])
                if len(send):
                    m = np.empty(len(send), _MESSAGE)
                    m["key"], m["children"], m["leaves"], m["saved"] = _keys(p1[send], p2[send]), 1, totals[1, send], totals[2, send]
                    queue.push(m)
            yield pa.RecordBatch.from_arrays([*b.columns[:6], *map(pa.array, totals)], names=[x.split()[0] for x in _TOTALS.split(", ")])

    columns = ["depth", "k1", "k2", "p1", "p2", "top", "own", "children", "leaves", "saved"]
    return nodes.sortWithinPartitions(F.desc("depth"), "k1", "k2").select(*columns).mapInArrow(run, _TOTALS)


def _id_lists(ends: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256) of ends (k1, k2, conv_id). A node's ids are joined in chunks, in parallel; one task streams a node's chunks through the hash."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k1, k2, ids = (c.to_numpy() for c in b.columns)
            if not len(ids):
                continue
            cuts = np.flatnonzero(np.append(True, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])))
            stops = np.append(cuts[1:], len(ids))
            text = [",".join(map(str, ids[a:z].tolist())) for a, z in zip(cuts, stops, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(k1[cuts]), pa.array(k2[cuts]), pa.array(ids[cuts]), pa.array(text)], names=["k1", "k2", "first", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for b in batches:
            done = []
            for k1, k2, ids in zip(*(b.column(c).to_pylist() for c in (0, 1, 3)), strict=True):
                if node == (k1, k2):
                    state.update(b"," + ids.encode())
                else:
                    if node:
                        done.append((*node, state.hexdigest()))
                    node, state = (k1, k2), hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.string())], names=["k1", "k2", "ends_sha256"])
        if node:
            yield pa.RecordBatch.from_arrays([pa.array([node[0]]), pa.array([node[1]]), pa.array([state.hexdigest()])], names=["k1", "k2", "ends_sha256"])

    by = ["k1", "k2"]
    lists = ends.select(*by, "conv_id").repartitionByRange(*by, "conv_id").sortWithinPartitions(*by, "conv_id").mapInArrow(chunks, "k1 long, k2 long, first long, ids string")
    return lists.repartition(*by).sortWithinPartitions(*by, "first").mapInArrow(hashed, "k1 long, k2 long, ends_sha256 string")


def rebuilt(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The turns (conv_id, at, t1, t2, bytes) of each rebuilt conversation, at from 0, and (conv_id, total) of all, also without turns.

    Conversation c is the first h turns of conversation c - c % 5 (all if fewer, none if absent) and its own from its turn h on;
    h = CRC-32 of its decimal id, modulo 9. t1 and t2 are hashes of role and text, bytes is the text's size.
    """
    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    rows = conversations.select(F.col(f"`{conv_col}`").cast("long").alias("conv_id"), F.col(f"`{turn_col}`").cast("long").alias("turn"), text(role_col).alias("role"), text(text_col).alias("text")).where("conv_id is not null")
    rows = rows.select("conv_id", "turn", F.xxhash64(F.lit(1), "role", "text").alias("t1"), F.xxhash64(F.lit(2), "role", "text").alias("t2"), F.octet_length("text").cast("long").alias("bytes"))
    rows = materialize(rows, "pt-turns").withColumn("no", F.monotonically_increasing_id()).withColumn("one", F.lit(1).cast("long"))  # no: parts equal turns, which would else fill one range
    rows = rows.withColumn("has_turn", F.col("turn").isNotNull()).withColumn("turn", F.coalesce("turn", F.lit(0)))
    rows = running_sums(rows, "conv_id", ["has_turn", "turn", "t1", "t2", "no"], ["one"], "pt-places").select("conv_id", F.col("one_before").alias("at"), "t1", "t2", "bytes")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % PREFIXES).alias("h")
    size = materialize(rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")), "pt-sizes")
    convs = size.select("conv_id", "n", h, (F.col("conv_id") - F.col("conv_id") % STRIDE).alias("base"))
    lent = F.least("h", F.coalesce("base_n", F.lit(0)))
    convs = convs.join(size.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n")), "base", "left").select("conv_id", "base", "h", lent.alias("lent"), (lent + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("total"))
    convs = materialize(convs, "pt-convs")
    heads = rows.where((F.col("at") < PREFIXES - 1) & (F.col("conv_id") % STRIDE == 0)).withColumnRenamed("conv_id", "base")
    heads = heads.join(convs, "base").where("at < lent").select("conv_id", "at", "t1", "t2", "bytes", "total")  # five conversations share a base
    own = rows.join(convs, "conv_id").where("at >= h").select("conv_id", (F.col("at") - F.col("h") + F.col("lent")).alias("at"), "t1", "t2", "bytes", "total")
    return heads.unionByName(own), convs.select("conv_id", "total")


def prefix_trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): a row for each distinct prefix of the rebuilt conversations.

    conv_id is the smallest member; n_leaves and saved_tokens are of the whole subtree. A node is its 128-bit hash: the sum of its turns'
    hashes, each taken with its place. Nodes of one conversation alone are chains, whose totals are known. The others are cut into
    shards at the highest nodes which few turns run through; each shard passes totals upwards level by level, and the sums of the shards'
    roots then go through the nodes above them in the same way. That crown holds at most 4096 nodes a level.

    Null role or text is empty. Rows without a conv_id belong to no conversation. Turns of one number (a null one comes first) go in the
    order of their hashes, repeated rows count as turns of their own. An empty table gives no rows.
    """
    turns, convs = rebuilt(conversations, conv_col, turn_col, role_col, text_col)
    turns = turns.withColumns({"e1": F.xxhash64("t1", "t2", "at"), "e2": F.xxhash64(F.lit(3), "t2", "t1", "at")})
    members = running_sums(turns.drop("t1", "t2"), "conv_id", ["at"], ["e1", "e2"], "pt-prefixes")
    left = F.col("total") - F.col("at") - 1
    members = materialize(members.select("conv_id", (F.col("at") + 1).alias("depth"), F.col("e1_upto").alias("k1"), F.col("e2_upto").alias("k2"), F.col("e1_before").alias("p1"), F.col("e2_before").alias("p2"), "bytes", left.alias("rest")), "pt-members")
    key, zero = ["k1", "k2"], F.lit(0).cast("long")
    root = convs.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.coalesce(F.sum("total"), zero).alias("weight")).where("n_convs > 0")
    root = root.select(zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), F.lit(None).cast("long").alias("p1"), F.lit(None).cast("long").alias("p2"), "n_convs", "conv_id", zero.alias("bytes"), "weight")
    nodes = members.groupBy(*key).agg(F.max("depth").alias("depth"), F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("bytes").alias("bytes"), F.sum("rest").alias("weight"))
    nodes = materialize(nodes.unionByName(root), "pt-nodes")
    limit = max(SHARD_TURNS, (convs.agg(F.sum("total")).first()[0] or 0) // SHARES)

    alone = (F.col("n_convs") == 1) & (F.col("depth") > 0)
    singles = nodes.where(alone)
    below = singles.groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count(F.lit(1)).alias("children"))
    shared = nodes.where(~alone).withColumn("own", (F.col("n_convs") - 1) * F.col("bytes"))
    shared = materialize(shared.join(below, key, "left").withColumn("children", F.coalesce("children", zero)), "pt-shared")  # a single child has one leaf and saves nothing

    heavy = (F.col("weight") > limit) | (F.col("depth") == 0)
    crown = shared.where(heavy)
    light = members.join(crown.select(*key), key, "left_anti").groupBy("conv_id").agg(F.min_by(F.struct(F.col("depth").alias("d"), F.col("k1").alias("s1"), F.col("k2").alias("s2")), "depth").alias("shard"))
    light = shared.where(~heavy).join(light, "conv_id").withColumn("top", F.col("depth") == F.col("shard.d")).withColumns({"leaves": F.col("children"), "saved": zero})
    totals = materialize(time_forward(light.repartition("shard.s1", "shard.s2")), "pt-shards")
    sent = totals.where("top").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count(F.lit(1)).alias("c"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    crown = crown.join(sent, key, "left").withColumns({"leaves": F.coalesce("leaves", zero) + F.col("children"), "children": F.col("children") + F.coalesce("c", zero), "saved": F.coalesce("saved", zero), "top": F.col("depth") == 0, "p1": F.coalesce("p1", zero), "p2": F.coalesce("p2", zero)})
    upper = time_forward(crown.repartition(1))

    found = ["n_children", "n_leaves", "saved_tokens"]
    totals = totals.select(*key, *found).unionByName(upper.select(*key, *found))
    full = shared.select(*key, "p1", "p2", "depth", "conv_id", "n_convs").join(totals, key)
    full = full.unionByName(singles.select(*key, "p1", "p2", "depth", "conv_id", "n_convs", (F.col("weight") > 0).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), zero.alias("saved_tokens")))
    ends = members.where("rest = 0").select(*key, "conv_id").unionByName(convs.where("total = 0").select(zero.alias("k1"), zero.alias("k2"), "conv_id"))
    full = full.join(nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id")), ["p1", "p2"], "left").join(_id_lists(ends), key, "left")
    return full.select("conv_id", "depth", "parent_conv_id", "n_convs", *found, F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))
