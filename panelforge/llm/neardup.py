"""Near duplicates by fast similarity sketching, banding and exact verification.

A document's sketch has t coordinates. In round i every shingle falls into one random bin with the value (i, random); a bin keeps
its least value, and a document is finished as soon as all bins are full. Rounds t to 2t-1 deal all shingles into one bin each, so
every coordinate is sure to fill. Documents that share the r coordinates of a band are candidates; candidates are confirmed on their
full shingle sets.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.components import connected_components
from panelforge.llm.kernels import U, distinct_by_doc, mix, shingle_hashes, signed, stream, word_hashes
from panelforge.llm.shared import materialize, text_blocks, text_documents

BANDS, ROWS = 32, 5
T = BANDS * ROWS
#: A component of more documents than this is met in blocks, and so are more open documents of a bucket than this.
LARGE = 16
#: Documents of a block that are compared on their full sets.
BLOCK = 256
#: Documents of a block that are compared on the low bits of their sketches.
SKETCH_BLOCK = 1024
#: Columns of a block's matrices at a time.
COLUMNS = 4096
_EMPTY = U(0xFFFFFFFFFFFFFFFF)
_SEEDS = stream(11, 2 * T)
_BAND_SEEDS = stream(12, BANDS)
_SIGN_SEEDS = stream(13, 2)
_WORDS = -(-T // 64)


def sketches(values: np.ndarray, doc: np.ndarray, n_docs: int, t: int = T) -> np.ndarray:
    """values: distinct 64-bit hashes, doc: their documents, ascending -> array (n_docs, t); documents without values stay all ones."""
    out = np.full((n_docs, t), _EMPTY)
    flat = out.reshape(-1)
    seeds = _SEEDS if t == T else stream(11, 2 * t)
    with np.errstate(over="ignore"):
        for i in range(2 * t):
            if not len(values):
                break
            h = mix(values ^ seeds[i])
            bin_ = ((h >> U(40)) * U(t) >> U(24)).astype(np.int64) if i < t else i - t
            np.minimum.at(flat, doc * t + bin_, (h & U((1 << 40) - 1)) | U(i << 40))
            open_ = np.zeros(n_docs, bool)
            left = np.unique(doc)
            open_[left] = (out[left] == _EMPTY).any(axis=1)
            if not open_[left].all():
                stay = open_[doc]
                values, doc = values[stay], doc[stay]
    return out


def _shingles(buf: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    words, doc = word_hashes(buf, offs)
    v, d = shingle_hashes(words, doc, len(offs) - 1, k)
    v, d, _ = distinct_by_doc(v, d)
    return v, d


def _signatures(v: np.ndarray, d: np.ndarray, n: int) -> list[np.ndarray]:
    """Two hashes of each document's set; 0 for an empty one."""
    sign = [np.zeros(n, U), np.zeros(n, U)]
    if len(d):
        full, first = np.unique(d, return_index=True)
        with np.errstate(over="ignore"):
            for out, seed in zip(sign, _SIGN_SEEDS, strict=True):
                out[full] = np.add.reduceat(mix(v ^ seed), first)
    return sign


def _sketch_rows(k: int):
    def run(batches):
        for rows, buf, offs in text_blocks(batches):
            n = rows.num_rows
            v, d = _shingles(buf, offs, k)
            s = sketches(v, d, n)
            size, sign = np.bincount(d, minlength=n), _signatures(v, d, n)
            with np.errstate(over="ignore"):
                keys = np.broadcast_to(_BAND_SEEDS, (n, BANDS)).copy()
                by_band = s.reshape(n, BANDS, ROWS)
                for j in range(ROWS):
                    keys = mix(keys * U(5) ^ by_band[:, :, j])
                low = np.zeros((n, _WORDS * 64), np.uint8)
                low[:, :T] = mix(s) & U(1)
            bits = np.packbits(low, axis=1).view(U)
            at = pa.array(np.arange(0, n * BANDS + 1, BANDS, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(size.astype(np.int64)), *(pa.array(signed(x)) for x in sign), *(pa.array(signed(bits[:, j])) for j in range(_WORDS)), pa.ListArray.from_arrays(at, pa.array(signed(keys.reshape(-1))))],
                names=["doc_id", "n", "s1", "s2", *(f"b{j}" for j in range(_WORDS)), "keys"],
            )

    return run


def _set_rows(k: int):
    """The sets of (node, s1, s2, text), as far as they have that signature: an id that is repeated brings texts of other sets along."""

    def run(batches):
        for rows, buf, offs in text_blocks(batches):
            v, d = _shingles(buf, offs, k)
            sign = _signatures(v, d, rows.num_rows)
            own = pa.array((signed(sign[0]) == rows.column(1).to_numpy()) & (signed(sign[1]) == rows.column(2).to_numpy()))
            at = np.searchsorted(d, np.arange(rows.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.ListArray.from_arrays(pa.array(at), pa.array(signed(v)))], names=["node", "set"]).filter(own)

    return run


def _sketch_parts(percent: int, most: int):
    """The open documents of one or two blocks of a bucket: ties each to the first of those that it may be linked with, directly or through others."""

    def run(table: pa.Table) -> pa.Table:
        node, comp, size, block = (table.column(c).to_numpy() for c in ("node", "comp", "n", "block"))
        bits = [table.column(f"b{j}").to_numpy() for j in range(_WORDS)]
        near = np.zeros((len(node), len(node)), bool)
        for a in range(0, len(node), 256):
            i = slice(a, a + 256)
            far = sum(np.bitwise_count(b[i, None] ^ b[None, :]).astype(np.int16) for b in bits)
            least, greatest = np.minimum(size[i, None], size[None, :]), np.maximum(size[i, None], size[None, :])
            near[i] = (far <= most) & (100 * least >= percent * greatest) & (comp[i, None] != comp[None, :])
        if block.min() != block.max():
            near &= block[:, None] != block[None, :]
        first = np.full(len(node), -1)
        for i in np.flatnonzero(near.any(axis=1)):
            if first[i] < 0:
                new = np.zeros(len(node), bool)
                new[i] = True
                while new.any():
                    first[new] = i
                    new = near[new].any(axis=0) & (first < 0)
        some = np.flatnonzero((first >= 0) & (first != np.arange(len(node))))
        return pa.table({"u": node[some], "v": node[first[some]]})

    return run


def _block_links(percent: int):
    """Counts the shingles that the documents of two blocks share and returns links between different components, one less than the components that they join."""

    def flat(table: pa.Table):
        sets = table.column("set").combine_chunks()
        size = np.diff(sets.offsets.to_numpy()) if len(sets) else np.zeros(0, np.int64)
        return table.column("node").to_numpy(), table.column("label").to_numpy(), size, sets.flatten().to_numpy(), np.repeat(np.arange(len(size)), size)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        (a, al, an, av, ao), (b, bl, bn, bv, bo) = flat(left), flat(right)
        shared = np.zeros((len(a), len(b)), np.float32)
        both = np.intersect1d(av, bv)
        for at in range(0, len(both), COLUMNS):
            part = both[at : at + COLUMNS]
            dense = []
            for n, v, o in ((len(a), av, ao), (len(b), bv, bo)):
                k = np.minimum(np.searchsorted(part, v), len(part) - 1)
                own = part[k] == v
                x = np.zeros((n, len(part)), np.float32)
                x[o[own], k[own]] = 1
                dense.append(x)
            shared += dense[0] @ dense[1].T
        i, j = np.nonzero((100 * shared >= percent * (an[:, None] + bn[None, :] - shared)) & (al[:, None] != bl[None, :]))
        kinds, comp = np.unique(np.concatenate([al, bl]), return_inverse=True)
        x, y = comp[: len(a)][i], comp[len(a) :][j]
        _, first = np.unique(np.minimum(x, y) * len(kinds) + np.maximum(x, y), return_index=True)
        parent, u, v = list(range(len(kinds))), [], []

        def top(c: int) -> int:
            while parent[c] != c:
                parent[c] = c = parent[parent[c]]
            return c

        for k in first.tolist():
            p, q = top(int(x[k])), top(int(y[k]))
            if p != q:
                parent[p] = q
                u.append(int(a[i[k]])), v.append(int(b[j[k]]))
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return run


class _Verifier:
    """Confirms pairs of sets on all their shingles: 100 * |A and B| >= percent * |A or B|. A set is named by its node; reps has where its text is."""

    def __init__(self, docs: DataFrame, reps: DataFrame, repeated: bool, k: int, percent: int):
        self.docs, self.reps, self.repeated, self.k, self.percent = docs, reps, repeated, k, percent
        self.marks = reps.select("node", "n", *(f"b{j}" for j in range(_WORDS)))
        # Low bits agree with probability (1 + J) / 2; the bound leaves six standard deviations.
        p = (1 + percent / 100) / 2
        self.most = math.ceil(T * (1 - p) + 6 * math.sqrt(T * p * (1 - p)))

    @staticmethod
    def far(a: str, b: str):
        return sum((F.bit_count(F.col(f"{a}.b{j}").bitwiseXOR(F.col(f"{b}.b{j}"))) for j in range(_WORDS)), F.lit(0))

    def alike(self, a: str, b: str):
        """Whether the sizes and the low bits of two sketches leave a link possible."""
        size = 100 * F.least(f"{a}.n", f"{b}.n") >= self.percent * F.greatest(f"{a}.n", f"{b}.n")
        return size & (self.far(a, b) <= self.most)

    def filtered(self, pairs: DataFrame) -> DataFrame:
        """pairs (a, b, ...) without those that can't be links; far: in how many low bits their sketches differ."""
        both = pairs.join(self.marks.alias("x"), F.col("a") == F.col("x.node")).join(self.marks.alias("y"), F.col("b") == F.col("y.node")).where(self.alike("x", "y"))
        return both.select(*pairs.columns, self.far("x", "y").alias("far"))

    def sets(self, nodes: DataFrame, name: str) -> DataFrame:
        """(node, set) of nodes (node)."""
        wanted = self.reps.select("node", "rep", "s1", "s2").join(nodes.distinct(), "node")
        texts = self.docs.join(wanted.hint("merge"), F.col("doc_id") == F.col("rep")).select("node", "s1", "s2", "text")
        sets = texts.mapInArrow(_set_rows(self.k), "node long, set array<long>")
        return materialize(sets.dropDuplicates(["node"]) if self.repeated else sets, f"{name}-sets")

    def links(self, pairs: DataFrame, name: str) -> DataFrame:
        """The pairs (a, b) that are links."""
        pairs = materialize(pairs, f"{name}-pairs")
        sets = self.sets(pairs.select(F.col("a").alias("node")).union(pairs.select("b")), name)
        both = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("sa")).hint("merge"), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("sb")).hint("merge"), "b")
        shared = F.size(F.array_intersect("sa", "sb"))
        linked = both.where(100 * shared >= self.percent * (F.size("sa") + F.size("sb") - shared)).select(F.col("a").alias("u"), F.col("b").alias("v"))
        return materialize(linked, f"{name}-links")

    def clusters(self, crowds: DataFrame, name: str) -> DataFrame:
        """crowds (key, crowd, node, comp, marks): open documents of buckets with too many for pairs -> (node, cluster).

        Documents of one bucket and different components whose sketches leave a link possible are in one cluster. They meet in blocks
        on their sketches alone, and each block gives at most a row per document.
        """
        crowds = crowds.withColumn("blocks", F.ceil(F.col("crowd") / SKETCH_BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        dealt = crowds.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))
        ties = dealt.groupBy("key", "lo", "hi").applyInArrow(_sketch_parts(self.percent, self.most), "u long, v long")
        return connected_components(materialize(ties.distinct(), f"{name}-ties")).select("node", F.col("component").alias("cluster"))

    def links_in_blocks(self, left: DataFrame, right: DataFrame, name: str) -> DataFrame:
        """left, right (node, label, group): links between those of one group with different labels, enough to join all components that such links join.

        Both sides meet in blocks of about BLOCK documents; a block's intersections are counted by one matrix product, so a large
        group costs neither a row per pair nor a task that holds all of it. A group below 0 has the same documents on both sides.
        """
        left, right = materialize(left, f"{name}-left"), materialize(right, f"{name}-right")
        sets = self.sets(left.select("node").union(right.select("node")), name)
        blocks = lambda df, to: df.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(to))
        sizes = materialize(blocks(left, "lb").join(blocks(right, "rb"), "group"), f"{name}-blocks")
        own = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        once = "group >= 0 or l <= r"
        x = left.join(sizes, "group").select("group", own("lb").alias("l"), every("rb").alias("r"), "node", "label").where(once).join(sets, "node")
        y = right.join(sizes, "group").select("group", every("lb").alias("l"), own("rb").alias("r"), "node", "label").where(once).join(sets, "node")
        y = y.select(*(F.col(c).alias(c) for c in ("group", "l", "r", "node", "label", "set")))
        found = x.groupBy("group", "l", "r").cogroup(y.groupBy("group", "l", "r")).applyInArrow(_block_links(self.percent), "u long, v long")
        return materialize(found, f"{name}-links")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept (doc_id = component_id).

    A document's set is its distinct runs of `words` words (A-Z lower-cased); with fewer words, the whole sequence as one.
    Links are pairs with 100 * intersection >= percent * union. Documents without words or text have an empty set and link to
    nothing. Rows without an id can't be named: their component is null, and they are kept. Rows that repeat an id with another text
    count as one document whose sets are linked.

    Equal sets meet in one aggregation and go on as one node. In a bucket of a band every member is first held against the
    bucket's smallest member; only pairs in different components go further, until every candidate pair lies in one component or was
    refuted: on the full sets, or as its sketches differ in more low bits than a link's would by six standard deviations (a chance
    of 1e-7 a link at the threshold). No group is expanded into all its pairs.
    """
    docs = text_documents(docs, id_col, text_col)
    schema = "doc_id long, n long, s1 long, s2 long, " + "".join(f"b{j} long, " for j in range(_WORDS)) + "keys array<long>"
    sk = materialize(docs.mapInArrow(_sketch_rows(words), schema), "nd-sketch")
    named = sk.where("n > 0 and doc_id is not null")
    reps = named.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), *(F.first(c).alias(c) for c in ("n", *(f"b{j}" for j in range(_WORDS)), "keys")))
    reps = materialize(reps.withColumn("node", F.monotonically_increasing_id()), "nd-reps")
    again = materialize(named.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("doc_id"), "nd-again")
    repeated = not again.isEmpty()
    check = _Verifier(docs.where("doc_id is not null"), reps, repeated, words, percent)

    bands = reps.select("node", F.explode("keys").alias("key"))
    centres = materialize(bands.groupBy("key").agg(F.min("node").alias("centre"), F.count(F.lit(1)).alias("members")).where("members > 1").select("key", "centre"), "nd-centres")
    buckets = materialize(bands.join(centres.hint("merge"), "key"), "nd-buckets")

    # 1: each member against the smallest centre among its buckets; 2: of the members that share a bucket with a centre in another
    # component, the pair that looks most alike for each two components; 3: all that is still open.
    stars = buckets.where("node <> centre").groupBy("node").agg(F.min("centre").alias("centre"))
    links = check.links(check.filtered(stars.select(F.col("node").alias("a"), F.col("centre").alias("b"))).select("a", "b"), "nd-1")
    if repeated:  # an id ties its sets together
        sets = named.join(again, "doc_id", "left_semi").select("doc_id", "s1", "s2").distinct().join(reps.select("s1", "s2", "node"), ["s1", "s2"])
        least = sets.groupBy("doc_id").agg(F.min("node").alias("v"))
        links = links.unionByName(materialize(sets.join(least, "doc_id").where("node <> v").select(F.col("node").alias("u"), "v").distinct(), "nd-same-id"))
    for step in (2, 3):
        label = materialize(connected_components(links), "nd-label")
        if step == 2:
            pairs = buckets.where("node <> centre").select("node", "centre").distinct()
            pairs = _labelled(_labelled(pairs, label, "node", "ca"), label, "centre", "cb").where("ca <> cb")
            pairs = check.filtered(pairs.select(F.col("node").alias("a"), F.col("centre").alias("b"), F.least("ca", "cb").alias("ca"), F.greatest("ca", "cb").alias("cb")))
            pairs = pairs.groupBy("ca", "cb").agg(F.min_by(F.struct("a", "b"), F.struct("far", "a", "b")).alias("p")).select("p.a", "p.b")
        else:
            pairs, left, right = _open_pairs(buckets, reps, label, check)
            links = links.unionByName(check.links_in_blocks(left, right, "nd-4"))
        links = links.unionByName(check.links(pairs, f"nd-{step}"))
    label = connected_components(links)
    label = reps.select("s1", "s2", "rep", F.col("node").alias("own")).join(label, F.col("own") == F.col("node"), "left").select("s1", "s2", "rep", F.coalesce("component", "own").alias("component"))
    label = materialize(label, "nd-nodes")
    names = label.groupBy("component").agg(F.min("rep").alias("component_id"))
    label = materialize(label.join(names, "component").select("s1", "s2", "component_id"), "nd-final")
    out = sk.select("doc_id", "n", "s1", "s2").join(label.hint("merge"), ["s1", "s2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _labelled(df: DataFrame, label: DataFrame, node: str, to: str) -> DataFrame:
    return df.join(label.select(F.col("node").alias(node), F.col("component").alias(to)), node, "left").withColumn(to, F.coalesce(to, node))


def _open_pairs(buckets: DataFrame, reps: DataFrame, label: DataFrame, check: _Verifier) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What is left to hold against each other: members of one bucket in different components.

    Pairs (a, b) that may be links, of buckets with few open documents; and for the others two sides (node, label, group) to meet in
    blocks: documents with a bucket's large main component, and the clusters of a bucket's many open documents.
    """
    everyone = materialize(_labelled(reps.select("node"), label, "node", "comp"), "nd-everyone")
    member = materialize(buckets.select("key", "node").join(everyone, "node"), "nd-member")
    main = member.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c")).groupBy("key").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.max("c").alias("c"), F.count(F.lit(1)).alias("comps"), F.sum("c").alias("all")).where("comps > 1")
    large = materialize(everyone.groupBy("comp").agg(F.count(F.lit(1)).alias("size")).where(f"size > {LARGE}").select(F.col("comp").alias("main"), F.lit(True).alias("large")), "nd-large")
    main = main.join(large, "main", "left").select("key", "main", F.coalesce("large", F.lit(False)).alias("large"), F.when(F.col("large"), F.col("all") - F.col("c")).otherwise(F.col("all")).alias("crowd"))
    mixed = materialize(member.join(materialize(main, "nd-main"), "key"), "nd-mixed")
    wanted = mixed.where("comp <> main and large").select("node", F.col("comp").alias("label"), F.col("main").alias("group")).distinct()
    members = everyone.join(wanted.select(F.col("group").alias("comp")).distinct(), "comp", "left_semi").select("node", F.col("comp").alias("label"), F.col("comp").alias("group"))
    marked = materialize(mixed.where("comp <> main or not large").join(check.marks, "node"), "nd-marked")
    clusters = check.clusters(marked.where(f"crowd > {LARGE}").select("key", "crowd", "node", "comp", "n", *(f"b{j}" for j in range(_WORDS))), "nd-crowds")
    clusters = materialize(clusters.join(everyone, "node").select("node", F.col("comp").alias("label"), (-1 - F.col("cluster")).alias("group")), "nd-clusters")
    few = marked.where(f"crowd <= {LARGE}")
    x, y = few.where("comp <> main").alias("x"), few.alias("y")
    # A pair outside the main component is met from both ends; one end is enough.
    once = (F.col("y.comp") == F.col("y.main")) | (F.col("x.node") < F.col("y.node"))
    pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.comp") != F.col("y.comp")) & once & check.alike("x", "y"))
    pairs = pairs.select(F.greatest("x.node", "y.node").alias("a"), F.least("x.node", "y.node").alias("b")).distinct()
    return pairs, wanted.unionByName(clusters), members.unionByName(clusters)
