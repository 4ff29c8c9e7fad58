"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees, boosted in turn over the features, add up to one lookup table per feature and per chosen pair of features; a score is
the sum of the tables' entries at a document's bins.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.llm.kernels import LOWER, U, WORD_HASH, distinct_by_doc, mix, word_spans
from panelforge.llm.shared import BLOCK_BYTES, column_bytes, give_back, reserved

FEATURES = (
    "log_chars", "upper", "digits", "symbols", "shouts", "stops", "bars", "breaks", "non_ascii", "log_words", "word_length", "word_spread",
    "distinct_words", "repeats", "symbol_ends", "letterless", "line_words", "distinct_pairs", "top_word", "short_words", "upper_words",
)


def _class(chars: str) -> np.ndarray:
    lut = np.zeros(256, bool)
    lut[list(chars.encode())] = True
    return lut


_UPPER = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LETTER = _UPPER | _class("abcdefghijklmnopqrstuvwxyz")
_LETTER[128:] = True
_DIGIT = _class("0123456789")
_SYMBOL = _class("*$%&#@^~+=<>_|\\/{}[]`")
_STOP = _class(".,;:")
_PLAIN_END = _LETTER | _DIGIT | _STOP


def features(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The FEATURES of each document, from its text alone; an empty text has zeros."""
    n = len(offs) - 1
    out = np.zeros((n, len(FEATURES)))
    if not len(buf):
        return out
    points = (buf & 0xC0) != 0x80
    sums = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])[offs])
    chars = sums(points)
    per = np.maximum(chars, 1)
    letters = np.maximum(sums(_LETTER[buf] & points), 1)
    lines = sums(buf == 10) + 1
    starts, ends, doc = word_spans(buf, offs)
    count = np.bincount(doc, minlength=n)
    w = np.maximum(count, 1)
    length = (ends - starts).astype(float)
    by_doc = lambda x: np.bincount(doc, weights=x, minlength=n)
    mean = by_doc(length) / w
    tally = lambda mask: np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    letter, upper = tally(_LETTER[buf]), tally(_UPPER[buf])
    in_word = letter[ends] - letter[starts]
    up = upper[ends] - upper[starts]
    hashes = WORD_HASH(LOWER[buf], starts, ends)
    _, d, times = distinct_by_doc(hashes, doc)
    same = np.zeros(len(doc), bool)
    pairs = np.zeros(n)
    if len(doc) > 1:
        inside = doc[1:] == doc[:-1]
        same[1:] = inside & (hashes[1:] == hashes[:-1])
        with np.errstate(over="ignore"):
            two = mix(hashes[:-1] * U(3) + hashes[1:])[inside]
        _, d2, _ = distinct_by_doc(two, doc[1:][inside])
        pairs = np.bincount(d2, minlength=n) / np.maximum(count - 1, 1)
    top = np.zeros(n)
    np.maximum.at(top, d, times)
    columns = (
        np.log1p(chars), sums(_UPPER[buf]) / letters, sums(_DIGIT[buf]) / per, sums(_SYMBOL[buf]) / per, sums(buf == 33) / per, sums(_STOP[buf]) / per, sums(buf == 124) / per, lines / per,
        sums((buf >= 0xC0)) / per, np.log1p(count), mean, np.sqrt(np.maximum(by_doc(length * length) / w - mean * mean, 0)), np.bincount(d, minlength=n) / w, by_doc(same) / w,
        by_doc(~_PLAIN_END[buf[ends - 1]]) / w, by_doc(in_word == 0) / w, count / lines, pairs, top / w, by_doc(length <= 3) / w, by_doc((up >= 2) & (up == in_word)) / w,
    )
    for j, c in enumerate(columns):
        out[:, j] = np.where(chars > 0, c, 0)
    return out


def _features_of(texts: pa.Array) -> np.ndarray:
    buf, offs = column_bytes(texts)
    n, a, parts = len(offs) - 1, 0, []
    while a < n:
        b = min(n, max(a + 1, int(np.searchsorted(offs, offs[a] + BLOCK_BYTES, "right")) - 1))
        parts.append(features(buf[offs[a] : offs[b]], offs[a : b + 1] - offs[a]))
        a = b
    give_back()
    return np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))


@dataclass
class AdditiveModel:
    """Lookup tables: edges[f] cuts feature f into bins, tables[f] has a value per bin, pairs has (f, g, table of coarse bins)."""

    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)
    coarse: int = 4

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], "right") for f, e in enumerate(self.edges)], axis=1) if self.edges else np.zeros((len(x), 0), int)

    def score(self, x: np.ndarray) -> np.ndarray:
        bins = self.bins(x)
        total = np.full(len(x), self.base)
        for f, table in enumerate(self.tables):
            total += table[bins[:, f]]
        for f, g, table in self.pairs:
            total += table[bins[:, f] // self.coarse, bins[:, g] // self.coarse]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _gain(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    return g * g / (h + ridge)


def _line_tree(g: np.ndarray, h: np.ndarray, ridge: float, depth: int) -> np.ndarray:
    """The leaf values per bin of a tree of that depth over the bins of one feature."""
    if depth and len(g) > 1:
        gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gain = _gain(gl, hl, ridge) + _gain(g.sum() - gl, h.sum() - hl, ridge)
        cut = int(np.argmax(gain)) + 1
        if gain[cut - 1] > _gain(g.sum(), h.sum(), ridge) + 1e-9:
            return np.concatenate([_line_tree(g[:cut], h[:cut], ridge, depth - 1), _line_tree(g[cut:], h[cut:], ridge, depth - 1)])
    return np.full(len(g), g.sum() / (h.sum() + ridge))


def _quarters(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, int, int]:
    """The best cut of a two-feature table into four quarters: gain, row, column."""
    gs, hs = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    total = 0
    for rows in (0, 1):
        for cols in (0, 1):
            part = []
            for s in (gs, hs):
                a, r, c, t = s[:-1, :-1], s[:-1, -1:], s[-1:, :-1], s[-1, -1]
                part.append(((a, r - a), (c - a, t - r - c + a))[rows][cols])
            total = total + _gain(part[0], part[1], ridge)
    at = np.unravel_index(int(np.argmax(total)), total.shape)
    return float(total[at] - _gain(g.sum(), h.sum(), ridge)), int(at[0]) + 1, int(at[1]) + 1


def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, rounds: int = 80, pair_rounds: int = 40, n_pairs: int = 10, rate: float = 0.1, ridge: float = 2.0, depth: int = 2) -> AdditiveModel:
    """Boosts shallow trees in turn over all features, then over the pairs that explain most of what is left. Without both classes the model is constant."""
    prior = (y.sum() + 0.5) / (len(y) + 1)
    model = AdditiveModel(base=float(np.log(prior / (1 - prior))) if len(y) else 0.0)
    if len(y) == 0 or y.min() == y.max():
        return model
    model.edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    b = model.bins(x)
    sizes = [len(e) + 1 for e in model.edges]
    model.tables = [np.zeros(s) for s in sizes]
    total = np.full(len(y), model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for f, table in enumerate(model.tables):
            r, v = slopes()
            step = rate * _line_tree(np.bincount(b[:, f], r, sizes[f]), np.bincount(b[:, f], v, sizes[f]), ridge, depth)
            table += step
            total += step[b[:, f]]
    wide = [(s - 1) // model.coarse + 1 for s in sizes]
    flat = lambda f, g: (b[:, f] // model.coarse) * wide[g] + b[:, g] // model.coarse
    grid = lambda f, g, x: np.bincount(flat(f, g), x, wide[f] * wide[g]).reshape(wide[f], wide[g])
    r, v = slopes()
    found = []
    for f in range(len(sizes)):
        for g in range(f + 1, len(sizes)):
            if wide[f] > 1 and wide[g] > 1:
                found.append((_quarters(grid(f, g, r), grid(f, g, v), ridge)[0], f, g))
    chosen = [(f, g) for _, f, g in sorted(found, reverse=True)[:n_pairs]]
    model.pairs = [(f, g, np.zeros((wide[f], wide[g]))) for f, g in chosen]
    for _ in range(pair_rounds):
        for f, g, table in model.pairs:
            r, v = slopes()
            gg, hh = grid(f, g, r), grid(f, g, v)
            _, i, j = _quarters(gg, hh, ridge)
            step = np.zeros_like(table)
            for a in (slice(0, i), slice(i, None)):
                for c in (slice(0, j), slice(j, None)):
                    step[a, c] = rate * gg[a, c].sum() / (hh[a, c].sum() + ridge)
            table += step
            total += step[b[:, f] // model.coarse, b[:, g] // model.coarse]
    return model


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that never teach: crc32(doc_id as text) mod 3 is 1. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = 20_000) -> AdditiveModel:
    """Fits the model on at most max_rows labelled rows that are not held out, those with the smallest hashes of their ids.

    Null labels and ids teach nothing; of several labels of one id the smallest counts. Only the bounded sample's features (max_rows
    rows of 21 numbers) come to the driver; of several documents of one id the smallest text teaches. Without labels, or with labels of one class, the model is constant.
    """
    rows = labels.where("doc_id is not null and quality is not null").where(~held_out("doc_id")).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows).select(F.col("doc_id").cast("long").alias("__id"), F.col("quality").cast("int").alias("__y"))
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("__id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    taught = texts.join(F.broadcast(rows), "__id").groupBy("__id").agg(F.min("text").alias("text"), F.first("__y").alias("__y"))  # max_rows ids at most

    def run(batches):
        for batch in batches:
            x = _features_of(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(x[:, j]) for j in range(x.shape[1]))], names=["id", "y", *FEATURES])

    got = taught.mapInArrow(run, "id long, y int, " + ", ".join(f"{f} double" for f in FEATURES)).toArrow().to_pandas().sort_values(["id", *FEATURES], kind="stable")
    return fit(got[list(FEATURES)].to_numpy(), got["y"].to_numpy(float))


def quality_score(model: AdditiveModel, text: Column) -> Column:
    """The score of a text, 0 to 1; a null text is scored as an empty one."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(model.score(_features_of(texts)))

    return score(F.coalesce(text.cast("string"), F.lit("")))


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = 20_000) -> DataFrame:
    """docs with a column score (0 to 1; higher: quality label 1 likelier). A null text is scored as an empty one; a column score is reserved."""
    reserved(docs, "score")
    return docs.withColumn("score", quality_score(fit_quality(docs, labels, id_col, text_col, max_rows), F.col(f"`{text_col}`")))
