"""Ranked lexical search: hybrid term-at-a-time and document-at-a-time evaluation over blocks of posting lists.

In each block an item's short lists are summed term at a time into accumulators; these then count as one more list with a known
bound, beside the long lists, in a document-at-a-time pass that skips what can no longer reach the item's best documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.llm.kernels import word_hashes
from panelforge.llm.shared import column_bytes, give_back, materialize, text_blocks, text_documents

#: The bytes that part terms: ASCII but for letters and digits.
BETWEEN = np.ones(256, bool)
BETWEEN[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False
BETWEEN[128:] = False
#: Items are searched for in blocks of so many bytes of their texts; the documents are read once a block.
ITEM_BLOCK_BYTES = 8 << 20
#: Text of one block of posting lists.
INDEX_BYTES = 16 << 20
#: Lists of at most so many postings in a block are short.
SHORT = 128
#: Documents of the first window of a document-at-a-time pass; each further one is twice as wide.
WINDOW = 256
#: The best of the tasks are merged in so many groups an item first, so that no group grows with the number of tasks alone.
MERGE_GROUPS = 64

_POSTINGS = "n_docs long, n_terms long, ids binary, no_id binary, lengths binary, terms binary, starts binary, places binary, counts binary"


def postings(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """A row for each block of documents: their ids (ascending, null first) and lengths, and the posting lists of those of the terms (sorted hashes) that are there."""

    def block(ids: list[pa.Array], sizes: list[np.ndarray], at: list[np.ndarray], term: list[np.ndarray], count: list[np.ndarray]) -> pa.RecordBatch:
        id_ = pa.concat_arrays(ids)
        none = id_.is_null().to_numpy(zero_copy_only=False)
        id_, n = id_.fill_null(-(1 << 63)).to_numpy(), np.concatenate(sizes)
        order = np.lexsort((id_, ~none))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        place, term, count = rank[np.concatenate(at)], np.concatenate(term), np.concatenate(count)
        by = np.lexsort((place, term))
        found, first = np.unique(term[by], return_index=True)
        cells = (id_[order], none[order], n[order].astype(np.int32), found.astype(np.int32), np.append(first, len(by)).astype(np.int64), place[by].astype(np.int32), count[by].astype(np.int32))
        cols = [pa.array([int((n > 0).sum())], pa.int64()), pa.array([int(n.sum())], pa.int64()), *(pa.array([c.tobytes()], pa.binary()) for c in cells)]
        return pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in _POSTINGS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size, done = ([], [], [], [], []), 0, 0
        for rows, buf, offs in text_blocks(batches):
            words, doc = word_hashes(buf, offs, BETWEEN)
            at = np.minimum(np.searchsorted(terms, words), len(terms) - 1)
            known = terms[at] == words
            pair, count = np.unique(doc[known] * len(terms) + at[known], return_counts=True)
            parts = (rows.column(0), np.bincount(doc, minlength=rows.num_rows), pair // len(terms) + done, pair % len(terms), count)
            for k, x in zip(kept, parts, strict=True):
                k.append(x)
            done, size = done + rows.num_rows, size + len(buf)
            if size >= INDEX_BYTES:
                yield block(*kept)
                kept, size, done = ([], [], [], [], []), 0, 0
        if kept[0]:
            yield block(*kept)
        give_back()

    return docs.mapInArrow(run, _POSTINGS)


def _document_counts(index: DataFrame, n_terms: int) -> np.ndarray:
    """How many documents hold each term; a task sends one row per term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, np.int64)
        for b in batches:
            for terms, starts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total[np.frombuffer(terms, np.int32)] += np.diff(np.frombuffer(starts, np.int64))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int64)), pa.array(total[some])], names=["term", "df"])

    got = index.select("terms", "starts").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df")).toArrow()  # a row for each term of the items' block
    out = np.zeros(n_terms, np.int64)
    out[got.column(0).to_numpy()] = got.column(1).to_numpy()
    return out


class Best:
    """The k best (score, place) of one item so far; equal scores by ascending id."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids, self.none = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    @property
    def least(self) -> int:
        """A score below it comes too late."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, ids: np.ndarray, none: np.ndarray) -> None:
        scores, ids, none = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids]), np.concatenate([self.none, none])
        top = np.lexsort((ids, ~none, -scores))[: self.k]
        self.scores, self.ids, self.none = scores[top], ids[top], none[top]


def _summed(places: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct places, ascending, and the sums of their values."""
    if len(places) == 1:
        return places[0], values[0]
    p, v = np.concatenate(places), np.concatenate(values)
    order = np.argsort(p, kind="stable")
    p, v = p[order], v[order]
    first = np.flatnonzero(np.append(True, p[1:] != p[:-1])) if len(p) else np.zeros(0, np.int64)
    return p[first], np.add.reduceat(v, first) if len(p) else v


def best_of_block(lists: list[tuple[np.ndarray, np.ndarray]], n_docs: int, ids: np.ndarray, none: np.ndarray, best: Best) -> None:
    """Adds a block's documents to an item's best. lists: for each term of the item its places (ascending) and what it adds to their scores."""
    short = [x for x in lists if len(x[0]) <= SHORT]
    cursors = [x for x in lists if len(x[0]) > SHORT]
    if short:
        cursors.append(_summed([p for p, _ in short], [v for _, v in short]))
    bounds = [int(v.max()) for _, v in cursors]
    order = sorted(range(len(cursors)), key=bounds.__getitem__)
    cursors = [cursors[i] for i in order]
    below = np.concatenate([[0], np.cumsum([bounds[i] for i in order])])  # below[i]: the most that the first i lists add together
    lo, width = 0, WINDOW
    while lo < n_docs:
        hi = min(n_docs, lo + width)
        needed = int(np.searchsorted(below, best.least, "left")) - 1  # documents in none but the first `needed` lists come too late
        if needed >= len(cursors):
            return
        ends = [(np.searchsorted(p, lo), np.searchsorted(p, hi)) for p, _ in cursors[needed:]]
        at, score = _summed([p[a:b] for (p, _), (a, b) in zip(cursors[needed:], ends, strict=True)], [v[a:b] for (_, v), (a, b) in zip(cursors[needed:], ends, strict=True)])
        for i in range(needed - 1, -1, -1):
            open_ = score + below[i + 1] >= best.least
            at, score = at[open_], score[open_]
            p, v = cursors[i]
            there = np.minimum(np.searchsorted(p, at), len(p) - 1)
            score = score + np.where(p[there] == at, v[there], 0)
        fit = score >= best.least
        best.add(score[fit], ids[at[fit]], none[at[fit]])
        lo, width = hi, width * 2


def _searched(index: DataFrame, items: list[np.ndarray], weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(item, doc_id, score): each task's k best documents for each item, an item being the numbers of its terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in items]
        for batch in batches:
            for row in range(batch.num_rows):
                ids, none, lengths, terms, starts, places, counts = (np.frombuffer(batch.column(j)[row].as_buffer(), t) for j, t in enumerate((np.int64, bool, np.int32, np.int32, np.int64, np.int32, np.int32)))
                m = 100 - 50 + (50 * lengths.astype(np.int64) * n_docs) // n_terms
                tf, of = counts.astype(np.int64), np.repeat(terms, np.diff(starts))
                value = weights[of] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[places]))
                for item, mine in zip(items, best, strict=True):
                    at = np.searchsorted(terms, item)
                    at = at[(at < len(terms)) & (terms[np.minimum(at, len(terms) - 1)] == item)] if len(terms) else at[:0]
                    lists = [(places[starts[i] : starts[i + 1]], value[starts[i] : starts[i + 1]]) for i in at]
                    if lists:
                        best_of_block(lists, len(ids), ids, none, mine)
        for i, b in enumerate(best):
            if len(b.scores):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b.scores), i)), pa.array(b.ids, mask=b.none), pa.array(b.scores)], names=["item", "doc_id", "score"])
        give_back()

    return index.select("ids", "no_id", "lengths", "terms", "starts", "places", "counts").mapInArrow(run, "item long, doc_id long, score long")


def _top(rows: DataFrame, by: list, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_first("doc_id")))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def ranked(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k best documents with a score above 0.

    Terms are runs of letters, digits and all non-ASCII characters, A-Z lower-cased. A term's weight is floor(1000 * ln((2N + 2) /
    (2 df + 1))), N being the documents with a term and df those that hold it; a document with n terms has m = 50 + (50 n N) div L, L
    being all terms of all documents; its score sums weight * ((1000000000 tf) div (1000 tf + 20 m)) over the item's distinct terms.
    Equal scores go by ascending doc_id, a null one first.

    Terms are told apart by 64-bit hashes. Null and empty texts have no term and are never found; rows that repeat a doc_id are
    documents of their own, and rows that repeat an item_id, or lack it, are items of their own. Empty tables give no rows. Items pass through the driver
    in blocks of 8 MB, for each of which the documents are read once: meant for query sets, not for corpora of items.
    """
    spark = docs.sparkSession
    docs = text_documents(docs, id_col, text_col)
    rows = items.select(F.col(f"`{item_col}`").cast("long").alias("item_id"), F.coalesce(F.col(f"`{item_text_col}`").cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, found = int(size // ITEM_BLOCK_BYTES) + 1, []
    for b in range(blocks):
        got = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").toArrow()
        buf, offs = column_bytes(got.column("text"))
        words, doc = word_hashes(buf, offs, BETWEEN)
        terms = np.unique(words)
        if not len(terms):
            continue
        index = materialize(postings(docs, terms), "ls-postings")
        n_docs, n_terms = index.agg(F.sum("n_docs"), F.sum("n_terms")).first()
        if not n_docs:
            continue
        df = _document_counts(index, len(terms))
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)
        lists = [np.unique(np.searchsorted(terms, w)) for w in np.split(words, np.searchsorted(doc, np.arange(1, got.num_rows)))]
        best = _searched(index, lists, weights, n_docs, n_terms, k)
        best = _top(_top(best, ["item", F.pmod(F.xxhash64("doc_id"), F.lit(MERGE_GROUPS))], k).drop("rank"), ["item"], k)
        names = spark.createDataFrame(list(enumerate(got.column("item_id").to_pylist())), "item long, item_id long")  # a row for each item of the block
        found.append(best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
