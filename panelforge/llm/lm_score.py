"""Cross-entropy difference: a target and a background bigram model over one vocabulary score each document by its loss per token under both.

A loss is a sum over n-grams: -log of (count of the bigram + MASS / V) / (count of its history + MASS). So the corpus is dealt once by
n-gram hash, each task counts its n-grams in both corpora and gives back one partial sum per document. N-grams of very many documents
never travel: they are found first, counted by map-side sums, and scored where the text is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.kernels import U, distinct_by_doc, mix, signed, word_hashes
from panelforge.llm.shared import materialize, text_blocks, text_documents

#: Pseudo-count of a history, spread evenly over the vocabulary.
MASS = 2.0
#: An n-gram of this share of the documents is hot; as a document has a bounded number of n-grams in the mean, few can be.
HOT_SHARE = 0.01
#: N-grams of documents that one task counts, in the mean.
PER_TASK = 3_000_000
#: Words of blocks that a task holds before it hands on those that differ.
HELD_WORDS = 2_000_000
#: Bytes of text that are dealt at a time: a row goes to each task, so larger blocks mean fewer rows.
DEAL_BYTES = 2 << 20
#: Bytes of a key that travel; the task's number stands for the rest.
KEY_BYTES = 7
_START = U(0x5851F42D4C957F2D)
_HISTORY = U(0x14057B7EF767814F)


def _grams(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams of each document: key, document, count, whether it is a history; and the words' hashes. A document's first word follows a start mark."""
    words, doc = word_hashes(buf, offs)
    if not len(words):
        z = np.zeros(0, np.int64)
        return words, z, z, z.astype(bool), words
    before = np.empty_like(words)
    before[0], before[1:] = _START, words[:-1]
    before[np.append(True, doc[1:] != doc[:-1])] = _START
    with np.errstate(over="ignore"):
        pair, history = mix(before * U(3) + words) << U(1), mix(before ^ _HISTORY) << U(1) | U(1)
    key, at, count = distinct_by_doc(np.concatenate([pair, history]), np.concatenate([doc, doc]))
    return key, at, count, (key & U(1)) == 1, words


def _survey(batches):
    """Per task, kind 0: how many documents of a block have an n-gram that is common in it; 1: the distinct words, as keys; 2: documents (key 0) and n-grams (key 1)."""
    docs, grams, seen, held = 0, 0, [], 0

    def out(kind: int, key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int32)), pa.array(key.astype(np.int64)), pa.array(n.astype(np.int64))], names=["kind", "key", "n"])

    def distinct_words() -> pa.RecordBatch:
        words = signed(np.unique(np.concatenate([*seen, np.zeros(0, U)])))
        return out(1, words, np.ones(len(words)))

    for rows, buf, offs in text_blocks(batches):
        key, _, _, _, words = _grams(buf, offs)
        seen.append(np.unique(words))
        held += len(seen[-1])
        if held > HELD_WORDS:
            yield distinct_words()
            seen, held = [], 0
        docs, grams = docs + rows.num_rows, grams + len(key)
        k, n = np.unique(key, return_counts=True)
        own = n >= max(2, HOT_SHARE * rows.num_rows)
        yield out(0, signed(k[own]), n[own])
    yield distinct_words()
    yield out(2, np.arange(2), np.array([docs, grams]))


def _hot_counts(hot: np.ndarray):
    def run(batches):
        sums = np.zeros((2, len(hot)), np.int64)
        for rows, buf, offs in text_blocks(batches):
            key, doc, count, _, _ = _grams(buf, offs)
            side = rows.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.minimum(np.searchsorted(hot, key), max(0, len(hot) - 1))
            own = hot[at] == key if len(hot) else np.zeros(len(key), bool)
            for s in (0, 1):
                mine = own & (side[doc] == s)
                sums[s] += np.bincount(at[mine], count[mine], len(hot)).astype(np.int64)
        some = np.flatnonzero(sums.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[0][some]), pa.array(sums[1][some])], names=["at", "background", "target"])

    return run


def _losses(count: np.ndarray, history: np.ndarray, background: np.ndarray, target: np.ndarray, vocabulary: float) -> tuple[np.ndarray, np.ndarray]:
    """What an n-gram adds to a document's losses (target, background): minus log of the bigram's mass, plus log of its history's. A document's own counts are taken out of the background."""
    base = np.where(history, MASS, MASS / vocabulary)
    sign = np.where(history, 1.0, -1.0) * count
    return sign * np.log(target + base), sign * np.log(np.maximum(background - count, 0) + base)


def _pack(x: np.ndarray) -> bytes:
    """Whole numbers in the narrowest of 1, 2 or 4 bytes that holds them all."""
    top = int(x.max()) if len(x) else 0
    return x.astype("<u1" if top < 256 else "<u2" if top < 65536 else "<u4").tobytes()


def _unpack(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"<u{len(data) // n if n else 1}").astype(np.int64)


def _deal(hot: np.ndarray, hot_counts: np.ndarray, vocabulary: float, tasks: int):
    """Per block: one row with its documents and what hot n-grams add to their losses, and one row per task with the other n-grams."""

    def run(batches):
        block = TaskContext.get().partitionId() << 32
        for rows, buf, offs in text_blocks(batches, limit=DEAL_BYTES):
            n = rows.num_rows
            key, doc, count, history, words = _grams(buf, offs)
            side = rows.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.minimum(np.searchsorted(hot, key), max(0, len(hot) - 1))
            own = hot[at] == key if len(hot) else np.zeros(len(key), bool)
            sums = np.zeros((2, n))
            if own.any():
                parts = _losses(count[own], history[own], hot_counts[0][at[own]], hot_counts[1][at[own]], vocabulary)
                sums = np.stack([np.bincount(doc[own], p, n) for p in parts])
            # The others are first taken for n-grams that no other text has; the tasks give back corrections.
            zero = np.zeros(int((~own).sum()), np.int64)
            for j, part in enumerate(_losses(count[~own], history[~own], zero, zero, vocabulary)):
                sums[j] += np.bincount(doc[~own], part, n)
            # Each document's words: the counts of its bigrams.
            tokens = np.bincount(doc[~history], count[~history], n)
            marks = np.asarray(rows.column(0).is_null()).astype(np.uint8) | (side << 1).astype(np.uint8)
            key, doc, count = key[~own], doc[~own], count[~own]
            to = (((key >> U(32)) * U(tasks)) >> U(32)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            key, doc, count, to = key[order], doc[order], count[order], to[order]
            edge = np.searchsorted(to, np.arange(tasks + 1))
            some = np.flatnonzero(np.diff(edge))
            low = np.ascontiguousarray(key.view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES])
            flags = np.packbits(side.astype(np.uint8)).tobytes()
            cols = [
                pa.array(np.append(some, -1 - block % tasks).astype(np.int32)),
                pa.array(np.full(len(some) + 1, block)),
                pa.array([n] * (len(some) + 1), pa.int32()),
                pa.array([low[edge[t] : edge[t + 1]].tobytes() for t in some] + [sums.tobytes()], pa.binary()),
                pa.array([_pack(np.diff(doc[edge[t] : edge[t + 1]], prepend=0)) for t in some] + [tokens.tobytes()], pa.binary()),
                pa.array([_pack(count[edge[t] : edge[t + 1]]) for t in some] + [marks.tobytes()], pa.binary()),
                pa.array([flags] * len(some) + [rows.column(0).fill_null(0).to_numpy().astype("<i8").tobytes()], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=["task", "block", "docs", "a", "b", "c", "d"])
            block += 1

    return run


def _count_and_score(vocabulary: float):
    """Counts the n-grams of one task in both corpora and adds up, per block, how they change each document's losses against n-grams that
    no other text has. Corrections travel as 32-bit numbers. Head rows pass."""

    def run(table: pa.Table) -> pa.Table:
        names = ["block", "docs", "a", "b", "c", "d"]
        if not table.num_rows or table.column("task")[0].as_py() < 0:
            return table.select(names)
        blocks, n_docs, a, b, c, d = (table.column(x).to_pylist() for x in names)
        size = np.array([len(x) // KEY_BYTES for x in a])
        low = np.frombuffer(b"".join(a), np.uint8).reshape(-1, KEY_BYTES)
        key = np.zeros((len(low), 8), np.uint8)
        key[:, :KEY_BYTES] = low
        key = key.view(np.uint64).ravel()
        doc = np.concatenate([np.cumsum(_unpack(x, m)) for x, m in zip(b, size, strict=True)])
        count = np.concatenate([_unpack(x, m) for x, m in zip(c, size, strict=True)])
        start = np.cumsum(size) - size
        side = np.concatenate([np.unpackbits(np.frombuffer(f, np.uint8), count=k)[doc[s : s + m]] for f, k, s, m in zip(d, n_docs, start, size, strict=True)])
        distinct, at = np.unique(key, return_inverse=True)
        target = np.bincount(at, count * side, len(distinct))
        background = np.bincount(at, count * (1 - side), len(distinct))
        history, zero = (key & U(1)) == 1, np.zeros(len(key), np.int64)
        seen = _losses(count, history, background[at], target[at], vocabulary)
        shift = [x - y for x, y in zip(seen, _losses(count, history, zero, zero, vocabulary), strict=True)]
        known = (target[at] > 0) | (background[at] > count * (1 - side))
        touched, sums = [], []
        for s, m in zip(start, size, strict=True):
            own = np.flatnonzero(known[s : s + m]) + s
            some, where = np.unique(doc[own], return_inverse=True)
            touched.append(_pack(np.diff(some, prepend=0)))
            sums.append(np.stack([np.bincount(where, x[own], len(some)) for x in shift]).astype("<f4").tobytes())
        none = pa.nulls(len(blocks), pa.binary())
        return pa.table({"block": pa.array(blocks, pa.int64()), "docs": pa.array(n_docs, pa.int32()), "a": pa.array(sums, pa.binary()), "b": pa.array(touched, pa.binary()), "c": none, "d": none})

    return run


def _add_up(table: pa.Table) -> pa.Table:
    """One block: its head row and the sums of all tasks, in the order of their bytes."""
    rows = sorted(table.to_pylist(), key=lambda r: (r["d"] is None, r["a"]))
    head, n = rows[0], rows[0]["docs"]
    total = np.frombuffer(head["a"]).reshape(2, n).copy()
    for r in rows[1:]:
        part = np.frombuffer(r["a"], "<f4").reshape(2, -1)
        total[:, np.cumsum(_unpack(r["b"], part.shape[1]))] += part
    tokens, marks, ids = np.frombuffer(head["b"]), np.frombuffer(head["c"], np.uint8), np.frombuffer(head["d"], "<i8")
    own = (marks & 2) == 0
    none = (tokens == 0)[own]
    mean = (total / np.maximum(tokens, 1))[:, own]
    return pa.table({"doc_id": pa.array(ids[own], mask=(marks[own] & 1) == 1), "n_tokens": pa.array(tokens[own].astype(np.int64)), "target_loss": pa.array(mean[0], mask=none), "background_loss": pa.array(mean[1], mask=none)})


def cross_entropy_difference(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, target_loss, background_loss, score): per row of docs its loss per token (nats) under the bigram models of
    target and of docs, and their difference; the lower the score, the more a text is like target.

    Words are parted by white space, A-Z lower-cased; both models share the vocabulary of all words of docs and target, whose
    distinct hashes are counted. All texts are counted whole, without a cut-off; a document is held against the background without its own
    counts. Texts without words have no losses and no score. Rows are scored one by one, so repeated or null ids do no harm.
    """
    own = text_documents(docs, id_col, text_col).withColumn("side", F.lit(0))
    other = target.select(F.lit(None).cast("long").alias("doc_id"), F.col(f"`{target_col}`").cast("string").alias("text"), F.lit(1).alias("side"))
    both = own.unionByName(other)
    seen = both.mapInArrow(_survey, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))
    seen = materialize(seen, "lm-survey")
    totals = {r["key"]: r["n"] for r in seen.where("kind = 2").collect()}
    n_docs, grams = totals.get(0, 0), totals.get(1, 0)
    vocabulary = float(max(1, seen.where("kind = 1").count()))
    # At most (n-grams of a document in the mean) / HOT_SHARE rows, whatever the number of documents.
    hot = np.sort(seen.where((F.col("kind") == 0) & (F.col("n") >= max(2, HOT_SHARE * n_docs))).select("key").toArrow().column(0).to_numpy().view(np.uint64))
    counts = np.zeros((2, len(hot)), np.int64)
    if len(hot):
        got = both.mapInArrow(_hot_counts(hot), "at long, background long, target long").groupBy("at").agg(F.sum("background"), F.sum("target")).toArrow()
        at = got.column(0).to_numpy()
        counts[0, at], counts[1, at] = got.column(1).to_numpy(), got.column(2).to_numpy()
    tasks = grams // PER_TASK + 1
    shape = "block long, docs int, a binary, b binary, c binary, d binary"
    dealt = both.mapInArrow(_deal(hot, counts, vocabulary, tasks), f"task int, {shape}")
    parts = dealt.groupBy("task").applyInArrow(_count_and_score(vocabulary), shape)
    out = parts.groupBy("block").applyInArrow(_add_up, "doc_id long, n_tokens long, target_loss double, background_loss double")
    return out.withColumn("score", F.col("target_loss") - F.col("background_loss"))
