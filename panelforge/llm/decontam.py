"""Benchmark decontamination: CGK random walks, bit-sampling LSH over item-sized windows, exact edit verification.

A CGK walk emits one symbol per step and moves on by one symbol or stays, by a random bit of (step, symbol). Sequences at a small edit
distance get embeddings at a small Hamming distance, so windows that agree at a few sampled steps are candidates. Symbols are words.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.kernels import U, mix, stream, word_hashes
from panelforge.llm.shared import column_bytes, text_blocks

#: Every ASCII sign that is no letter or digit parts words here, so that punctuation counts for nothing.
_BETWEEN = np.zeros(256, bool)
_BETWEEN[:128] = True
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    _BETWEEN[_a:_b] = False
#: Items of fewer words have more entries, as an edit of the first word would hide them.
SHORT = 24
#: Items are searched for in blocks of about so many bytes of text; one block's index is what a task holds.
ITEM_BLOCK_BYTES = 8 << 20


@dataclass(frozen=True)
class Search:
    """edits: edited words allowed, as a share of an item's words; walks * samples: repetitions for each class of lengths; bits: steps in a sample beyond the first."""

    edits: float = 0.15
    walks: int = 2
    samples: int = 6
    bits: int = 4


def _walk(words: np.ndarray, at: np.ndarray, steps: np.ndarray, seed: int) -> dict[int, np.ndarray]:
    """Walks from all positions `at` at once; words has a 0 after each document, where walks stay. Gives the symbols at the wanted steps."""
    out, at, wanted = {}, at.astype(np.int64), set(steps.tolist())
    for j in range(int(steps.max()) + 1):
        if j % 64 == 0:
            with np.errstate(over="ignore"):
                coins = mix(words ^ stream(1000 + seed, j // 64 + 1)[-1])
            coins[words == 0] = 0
        if j in wanted:
            out[j] = words[at]
        at = at + ((coins[at] >> U(j % 64)) & U(1)).view(np.int64)
    return out


def _classes(longest: int) -> list[tuple[int, int]]:
    """Lengths in words, from and below, each class about half as long again as the one before."""
    out, a = [], 1
    while a <= longest:
        b = max(a + 1, a * 3 // 2)
        out.append((a, b))
        a = b
    return out


def _entries(n: int, edits: int) -> list[int]:
    """Where an item of n words is entered: at its start, a quarter, half and three quarters of it, as long as 8 words follow, and a short one that may be edited at each of its first words."""
    out = {0} | {o for o in (n // 4, n // 2, 3 * n // 4) if n - o >= 8}
    return sorted(out | set(range(1, edits + 2) if edits and n < SHORT else ()))


class ItemIndex:
    """The sampled keys of a block of items; windows are what follows each of an item's entries. ids: the ids of the items with these words."""

    def __init__(self, ids: list[list[int]], words: list[np.ndarray], search: Search):
        self.search, self.ids, self.words = search, ids, words
        entries = sorted({(len(w) - o, i, o) for i, w in enumerate(words) if len(w) for o in _entries(len(w), int(search.edits * len(w)))})
        flat = np.concatenate([np.append(w, U(0)) for w in words]) if words else np.zeros(0, U)
        first = np.cumsum([0, *(len(w) + 1 for w in words)])
        self.tables: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        used: dict[int, set[int]] = {}
        rng = np.random.default_rng(5)
        for a, b in _classes(max((n for n, _, _ in entries), default=0)):
            own = [(i, o) for n, i, o in entries if a <= n < b]
            last = max(0, a * 3 // 2 - 1)
            for walk in range(search.walks):
                for _ in range(search.samples if last else 1):
                    steps = np.sort(rng.choice(np.arange(1, last + 1), min(search.bits, last), replace=False)) if last else np.zeros(0, np.int64)
                    if not own:
                        continue
                    steps = np.append(0, steps)
                    start = np.array([first[i] + o for i, o in own])
                    symbols = _walk(flat, start, steps, walk)
                    keys = self._keys(symbols, steps)
                    order = np.argsort(keys)
                    used.setdefault(walk, set()).update(steps.tolist())
                    marks = np.zeros(1 << 18, bool)
                    marks[self._brief(symbols[0], symbols[int(steps[-1])])] = True
                    self.tables.append((walk, steps, marks, keys[order], np.array([i for i, _ in own])[order], np.array([o for _, o in own])[order]))
        self.steps = {w: np.array(sorted(s)) for w, s in used.items()}
        self.starts = np.unique(np.array([words[i][o] for _, i, o in entries], U)) if entries else np.zeros(0, U)
        self.marks = np.zeros(1 << 16, bool)
        self.marks[(self.starts >> U(48)).astype(np.int64)] = True

    @staticmethod
    def _brief(first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """18 bits of a window's first and last sampled symbol: most windows end here."""
        with np.errstate(over="ignore"):
            return ((first * U(0x9E3779B97F4A7C15) + last * U(0xD6E8FEB86659FD93)) >> U(46)).view(np.int64)

    @staticmethod
    def _keys(symbols: dict[int, np.ndarray], steps: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            key = mix(symbols[0])
            for j in steps[1:]:
                key = mix(key * U(3) ^ symbols[j])
        return key

    def candidates(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in words, its offset in the item, item) of each entry that is met; words has a 0 after each document."""
        at = np.flatnonzero(self.marks[(words >> U(48)).astype(np.int64)])
        at = at[np.isin(words[at], self.starts)] if len(at) else at
        out = [np.zeros((3, 0), np.int64)]
        for walk, steps in self.steps.items() if len(at) else ():
            symbols = _walk(words, at, steps, walk)
            for w, own, marks, keys, items, offsets in self.tables:
                if w != walk:
                    continue
                live = np.flatnonzero(marks[self._brief(symbols[0], symbols[int(own[-1])])])
                if not len(live):
                    continue
                mine = self._keys({int(j): symbols[int(j)][live] for j in own}, own)
                lo = np.searchsorted(keys, mine, "left")
                hit = np.flatnonzero(keys[np.minimum(lo, len(keys) - 1)] == mine)
                if len(hit):
                    many = np.searchsorted(keys, mine[hit], "right") - lo[hit]
                    entry = np.repeat(lo[hit], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                    out.append(np.stack([np.repeat(at[live[hit]], many), offsets[entry], items[entry]]))
        found = np.concatenate(out, axis=1)
        return found[0], found[1], found[2]

    def windows(self, words: np.ndarray, begin: np.ndarray, count: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(document, item, from, to): each entry's window is as wide as the item and its edits on both sides; windows of one document and item that meet are one."""
        at, offset, item = self.candidates(words)
        if not len(at):
            return []
        length = np.array([len(w) for w in self.words])[item]
        most = (self.search.edits * length).astype(np.int64)
        doc = np.searchsorted(begin, at, "right") - 1
        a, b = np.maximum(begin[doc], at - offset - most), np.minimum(begin[doc] + count[doc], at - offset + length + most)
        order = np.lexsort((b, a, item, doc))
        doc, item, a, b = doc[order], item[order], a[order], b[order]
        new = np.append(True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (a[1:] > b[:-1]))  # an item's windows are equally wide, so ends ascend too
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(doc)) - 1
        return list(zip(doc[first].tolist(), item[first].tolist(), a[first].tolist(), b[last].tolist(), strict=True))

    def found(self, buf: np.ndarray, offs: np.ndarray) -> dict[tuple[int, int], tuple[int, int, int]]:
        """(document, item) -> (edit distance in words, first word, words) of the best place in the document, the first of equals."""
        words, doc = word_hashes(buf, offs, _BETWEEN)
        n = len(offs) - 1
        count = np.bincount(doc, minlength=n)
        ends = np.cumsum(count)
        padded = np.insert(words | U(1 << 63), ends, U(0))  # a word is never 0
        begin = np.concatenate([[0], (ends + np.arange(1, n + 1))[:-1]]) if n else np.zeros(0, np.int64)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for d, i, a, b in self.windows(padded, begin, count):
            item = self.words[i]
            dist, end = infix_distance(self.masks(i), len(item), padded[a:b].tolist())
            if dist <= int(self.search.edits * len(item)):
                start, length = self._place(item, padded[max(a, a + end - 2 * len(item)) : a + end])
                start += max(0, end - 2 * len(item))
                got = (dist, int(a - begin[d]) + start, length)
                best[d, i] = min(best.get((d, i), got), got)
        return best

    def masks(self, i: int) -> dict[int, int]:
        if not hasattr(self, "_masks"):
            self._masks: dict[int, dict[int, int]] = {}
        if i not in self._masks:
            m: dict[int, int] = {}
            for j, w in enumerate(self.words[i].tolist()):
                m[w] = m.get(w, 0) | 1 << j
            self._masks[i] = m
        return self._masks[i]

    @staticmethod
    def _place(item: np.ndarray, part: np.ndarray) -> tuple[int, int]:
        """Start and length of the match that ends with part: the item reversed against the text reversed, anchored at the end."""
        masks: dict[int, int] = {}
        for j, w in enumerate(item[::-1].tolist()):
            masks[w] = masks.get(w, 0) | 1 << j
        _, length = infix_distance(masks, len(item), part[::-1].tolist(), anchored=True)
        return len(part) - length, length


def infix_distance(masks: dict[int, int], m: int, text: list[int], anchored: bool = False) -> tuple[int, int]:
    """Bit-parallel edit distance of a pattern of m symbols (bit masks of their places) to the best part of text: distance, end; anchored: parts from the text's start only."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, (m, 0)
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & full)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1 | (1 if anchored else 0)) & full
        mh = mh << 1 & full
        pv = mh | (~(xv | ph) & full)
        mv = ph & xv
        if score < best[0]:
            best = (score, j + 1)
            if score == 0:
                break
    return best


def item_indexes(items: DataFrame, search: Search, id_col: str = "item_id", text_col: str = "text"):
    """One index per block of items; null ids and items without words are left out."""
    rows = items.select(F.col(f"`{id_col}`").cast("long").alias("item_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")).where("item_id is not null")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = int(size // ITEM_BLOCK_BYTES) + 1
    for b in range(blocks):
        got = rows.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).orderBy("item_id", "text").toArrow()
        buf, offs = column_bytes(got.column("text"))
        words, doc = word_hashes(buf, offs, _BETWEEN)
        per = [w | U(1 << 63) for w in np.split(words, np.searchsorted(doc, np.arange(1, got.num_rows)))] if got.num_rows else []
        same: dict[bytes, list[int]] = {}  # items of equal words are searched for once
        for i, w in zip(got.column("item_id").to_pylist(), per, strict=True):
            if len(w):
                same.setdefault(w.tobytes(), []).append(i)
        yield ItemIndex(list(same.values()), [np.frombuffer(w, U) for w in same], search)


def benchmark_leaks(docs: DataFrame, items: DataFrame, search: Search | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, distance, start_word, n_words): documents that hold a passage within search.edits * words edits of an item.

    Edits are of words: runs of letters and digits, A-Z lower-cased. One row per row of docs and item, its best place. Null or empty
    texts and items give nothing; a null doc_id is kept. The documents are scanned once per block of items, without a shuffle.
    """
    search = search or Search()
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    out = None
    for index in item_indexes(items, search):

        def run(batches, index=index):
            for rows, buf, offs in text_blocks(batches):
                found = [(d, item, *place) for (d, i), place in sorted(index.found(buf, offs).items()) for item in index.ids[i]]
                cols = [rows.column(0).take(pa.array([x[0] for x in found], pa.int64())), *(pa.array([x[j] for x in found], pa.int64()) for j in range(1, 5))]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "item_id", "distance", "start_word", "n_words"])

        part = docs.mapInArrow(run, "doc_id long, item_id long, distance long, start_word long, n_words long")
        out = part if out is None else out.unionByName(part)
    return out


def _leak_flag(index: ItemIndex):
    @F.arrow_udf("boolean")
    def leaks(texts: pa.Array) -> pa.Array:
        out, at = np.zeros(len(texts), bool), 0
        for rows, buf, offs in text_blocks(iter([pa.RecordBatch.from_arrays([texts], names=["text"])])):
            for d, _ in index.found(buf, offs):
                out[at + d] = True
            at += rows.num_rows
        return pa.array(out)

    return leaks


def without_leaks(docs: DataFrame, items: DataFrame, search: Search | None = None, text_col: str = "text") -> DataFrame:
    """docs without the documents that hold an item; all columns and all other rows stay. The decision is made where the text is, without a join."""
    for index in item_indexes(items, search or Search()):
        docs = docs.where(~_leak_flag(index)(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))))
    return docs
