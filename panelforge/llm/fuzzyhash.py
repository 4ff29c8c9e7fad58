"""Document fingerprints by context-triggered piecewise hashing: a rolling hash cuts the text, each chunk gives one character, and
signatures of equal block size are compared by edit distance."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.kernels import U, stream
from panelforge.llm.shared import range_index, text_documents

#: Bytes that the rolling hash sees.
WINDOW = 7
#: Characters of a signature at most; a text whose cuts are more takes the next block size.
LONGEST = 64
#: Block sizes of a fingerprint: the finest whose signature is short enough, and the next two doublings.
LEVELS = 3
#: Finer sizes, in doublings, whose boundaries are kept beside those expected to do.
SPARE_BITS = 3
#: Bytes of text in a range, and rows sampled a range.
RANGE_BYTES, SAMPLES = 16 << 20, 16
_TABLE = (stream(41, 256) >> U(32)).astype(np.uint32)
_BASE = np.uint32(0x9E3779B1)
_ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
#: Long texts are hashed in parts of so many bytes.
_PART = 1 << 20


def _rolled(data: np.ndarray) -> np.ndarray:
    """At each byte the hash of the last WINDOW bytes (fewer at the start), 32 bits."""
    x = _TABLE[data]
    h, power = x.copy(), _BASE
    for j in range(1, min(WINDOW, len(x))):
        h[j:] += x[:-j] * power
        power = power * _BASE
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    return h


def _marks(buf: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.uint64]:
    """Hashes at the boundaries of blocks of 2^bits bytes in the mean, the running sums of all hashes there, and the sum over the whole."""
    ends, sums, total = [np.zeros(0, np.uint32)], [np.zeros(0, U)], np.uint64(0)
    for a in range(0, len(buf), _PART):
        lead = min(a, WINDOW - 1)
        h = _rolled(buf[a - lead : a + _PART])[lead:]
        at = np.flatnonzero((h & np.uint32((1 << bits) - 1)) == 0)
        run = np.cumsum(h, dtype=U) + total
        ends.append(h[at])
        sums.append(run[at])
        total = run[-1]
    return np.concatenate(ends), np.concatenate(sums), total


def fingerprint(data: bytes) -> str:
    """block size:signature:signature at twice:signature at four times the block size. Equal bytes give equal fingerprints.

    The block size is the finest power of two with fewer than 64 boundaries, so that a text of some length has 32 characters or more
    unless its content repeats.
    """
    n = len(data)
    buf = np.frombuffer(data, np.uint8)
    with np.errstate(over="ignore"):
        bits = max(0, (n // (2 * LONGEST)).bit_length() - 1 - SPARE_BITS)
        cut, run, total = _marks(buf, bits)
        while bits and len(cut) < LONGEST:  # few boundaries: a finer size may do
            bits = max(0, bits - SPARE_BITS)
            cut, run, total = _marks(buf, bits)
        while (keep := (cut & np.uint32((1 << bits) - 1)) == 0).sum() >= LONGEST:
            bits += 1
        out = [str(1 << bits)]
        for k in range(LEVELS):
            keep = (cut & np.uint32((1 << bits + k) - 1)) == 0
            edges = run[keep]
            if n and (not len(edges) or edges[-1] != total):
                edges = np.append(edges, total)
            chunk = np.diff(edges, prepend=U(0)) * U(0x9E3779B97F4A7C15)
            out.append(_ALPHABET[(chunk >> U(58)).astype(np.int64)].tobytes().decode())
    return ":".join(out)


def likeness(pairs: list[tuple[str, str]]) -> np.ndarray:
    """0 to 1 for each pair of fingerprints: 1 - edit distance / longer length, at their finest common block size; 0 without one; 1 if equal."""
    out = np.zeros(len(pairs))
    left, right, at = [], [], []
    for i, (a, b) in enumerate(pairs):
        if a == b:
            out[i] = 1.0
            continue
        (ka, *sa), (kb, *sb) = a.split(":"), b.split(":")
        gap = int(ka).bit_length() - int(kb).bit_length()
        if abs(gap) < LEVELS:
            x, y = (sa[0], sb[gap]) if gap >= 0 else (sa[-gap], sb[0])
            if x and y:
                left.append(x.encode()), right.append(y.encode()), at.append(i)
    if at:
        longer = np.array([max(len(x), len(y)) for x, y in zip(left, right, strict=True)])
        out[at] = 1 - edit_distances(left, right) / longer
    return out


def edit_distances(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """Levenshtein distances of many pairs of strings of 1 to 64 characters at once, bit-parallel."""
    n = len(left)
    m, k = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    a, b = (np.frombuffer(b"".join(x.ljust(LONGEST, b"\0") for x in s), np.uint8).reshape(n, LONGEST) for s in (left, right))
    masks = np.zeros((n, 128), U)
    for j in range(int(m.max())):
        own = np.flatnonzero(j < m)
        masks[own, a[own, j]] |= U(1 << j)
    pv, mv = np.full(n, ~U(0)), np.zeros(n, U)
    top, score, rows = U(1) << (m - 1).astype(U), m.copy(), np.arange(n)
    with np.errstate(over="ignore"):
        for j in range(int(k.max())):
            eq = masks[rows, b[:, j]]
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph, mh = mv | ~(xh | pv), pv & xh
            step = ((ph & top) != 0).astype(int) - ((mh & top) != 0)
            score += np.where(j < k, step, 0)
            ph, mh = (ph << U(1)) | U(1), mh << U(1)
            pv, mv = mh | ~(xv | ph), ph & xv
    return score


def edited(text: str, following: str) -> str:
    """text with its last floor(n / 2) code points replaced by the first as many (or all) of following."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """Per row of docs: doc_id, n_chars, edited_sha256 (of the edited text), fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is that of the next smaller doc_id, after the last the first; rows of one id follow each other by the hash of
    their text, and a null id comes last. A null text is empty, an empty table gives no rows. Rows are dealt out once, by ranges of (doc_id, hash of the text)
    of about equal bytes; the first row of each range also goes to the range before it, so that every row finds its next one in its own
    task. So null ids and repeated ids spread; rows of one id and one text lie in one range, through which they stream. A document that is
    alone is its own next.
    """
    spark = docs.sparkSession
    docs = text_documents(docs, id_col, text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumns({"__o": F.bitwise_not(F.coalesce("doc_id", F.lit(-(1 << 63)))), "__h": F.xxhash64("text")})
    size = F.octet_length("text") + 1
    total = docs.agg(F.sum(size.cast("long"))).first()[0] or 0
    n = ranges or min(max(int(total // RANGE_BYTES), 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))), 1 << 16)
    per = total / (n * SAMPLES)  # rows are drawn in proportion to their bytes, SAMPLES a range in the mean
    drawn = docs.where((F.xxhash64(F.lit(9), "__o", "__h").cast("double") / float(1 << 64) + 0.5) * F.lit(float(per)) < size)
    got = drawn.groupBy("__o", "__h").agg(F.max(size).alias("size"), F.count(F.lit(1)).alias("n")).orderBy("__o", "__h").toArrow()
    weight = np.maximum(got.column(2).to_numpy() / max(per, 1), 1.0) * got.column(3).to_numpy()
    at = np.unique(np.searchsorted(np.cumsum(weight), np.linspace(0, weight.sum(), n + 1)[1:-1])) if got.num_rows else np.zeros(0, np.int64)
    at = at[at < got.num_rows]
    cuts = tuple(got.column(i).to_numpy()[at] for i in (0, 1))

    @F.arrow_udf("int")
    def range_of(order: pa.Array, hashes: pa.Array) -> pa.Array:
        return pa.array(range_index(cuts, tuple(c.to_numpy(zero_copy_only=False) for c in (order, hashes))).astype(np.int32))

    heads = docs.groupBy(range_of("__o", "__h").alias("r")).agg(F.min(F.struct("__o", "__h")).alias("head")).orderBy("r").collect()  # a row per range
    before = {(h[0], h[1]): heads[i - 1].r for i, (_, h) in enumerate(heads)}

    def deal(batches):
        copied = set()
        for b in batches:
            o, h = (b.column(i).to_numpy() for i in (2, 3))
            ids, texts = b.column(0), b.column(1)
            yield pa.RecordBatch.from_arrays([ids, texts, b.column(2), b.column(3), pa.array(range_index(cuts, (o, h)).astype(np.int32)), pa.array(np.zeros(len(o), np.int32))], names=_DEALT)
            first = [i for i, k in enumerate(zip(o.tolist(), h.tolist(), strict=True)) if k in before and k not in copied and not copied.add(k)]
            if first:
                rows = b.take(pa.array(first))
                to = [before[k] for k in zip(o[first].tolist(), h[first].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(to, pa.int32()), pa.array(np.ones(len(first), np.int32))], names=_DEALT)

    dealt = docs.mapInArrow(deal, "doc_id long, text string, __o long, __h long, range int, copy int").repartition("range")
    dealt = dealt.sortWithinPartitions("range", "copy", "__o", "__h", "text").select("doc_id", "text", "range", "copy")
    return dealt.mapInArrow(_stream, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


_DEALT = ["doc_id", "text", "__o", "__h", "range", "copy"]


def _stream(batches):
    held = None  # the last row, which waits for its next one: doc_id, text, range, fingerprint
    for batch in batches:
        for a in range(0, batch.num_rows, 256):
            rows, doc, chars, sha, prints, changed, following = batch.slice(a, 256), [], [], [], [], [], []
            for doc_id, text, part, copy in zip(*(rows.column(j).to_pylist() for j in range(4)), strict=True):
                if copy and (held is None or held[2] != part):
                    continue  # a further copy of the next range's first rows
                own = fingerprint(text.encode())
                if held is not None and held[2] == part:
                    new = edited(held[1], text).encode()
                    doc.append(held[0]), chars.append(len(held[1])), sha.append(hashlib.sha256(new).hexdigest())
                    prints.append(held[3]), changed.append(fingerprint(new)), following.append(own)
                held = None if copy else (doc_id, text, part, own)
            near = likeness(list(zip(prints + prints, changed + following, strict=True)))
            cols = [pa.array(doc, pa.int64()), pa.array(chars, pa.int64()), *(pa.array(x, pa.string()) for x in (sha, prints, changed)), pa.array(near[: len(doc)]), pa.array(near[len(doc) :])]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
