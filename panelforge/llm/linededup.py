"""Line deduplication over range-partitioned line hashes; returns keep bitmaps instead of text."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.llm.kernels import LOWER, SPACE, SpanHasher, signed
from panelforge.llm.shared import materialize, reserved, text_blocks, text_documents

_HASHES = SpanHasher(21), SpanHasher(22)
_STREAM = "kind int, h1 long, h2 long, doc_id long, pos long, docs long"
_DROP, _OPEN, _EDGE = 0, 1, 2


def _mark(text: Column) -> Column:
    """31 bits that tell the texts of one id apart; they travel above the 32 bits of a line's number."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit(""))).bitwiseAND(F.lit(0x7FFFFFFF))


def _line_spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, number in the document, start and end of every line; an empty text has one empty line."""
    n = len(offs) - 1
    cut = np.flatnonzero(buf == 10)
    doc = np.concatenate([np.arange(n), np.searchsorted(offs, cut, "right") - 1])
    order = np.argsort(doc, kind="stable")
    doc, start = doc[order], np.concatenate([offs[:-1], cut + 1])[order]
    last = np.append(doc[1:] != doc[:-1], True)[: len(doc)]
    end = np.where(last, offs[doc + 1], np.append(start[1:], 0) - 1)
    first = np.searchsorted(doc, np.arange(n))
    return doc, np.arange(len(doc)) - first[doc], start, end


def _line_rows(min_chars: int):
    def run(batches):
        for rows, buf, offs in text_blocks(batches):
            doc, pos, start, end = _line_spans(buf, offs)
            solid = np.flatnonzero(~SPACE[buf])
            lo, hi = np.searchsorted(solid, start), np.searchsorted(solid, end)
            some = np.flatnonzero(hi > lo)
            s, e = solid[lo[some]], solid[hi[some] - 1] + 1
            points = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
            long_ = points[e] - points[s] >= min_chars
            some, s, e = some[long_], s[long_], e[long_]
            low = LOWER[buf]
            h1, h2 = (h(low, s, e) for h in _HASHES)
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(h1)), pa.array(signed(h2)), rows.column(0).take(pa.array(doc[some])), pa.array(rows.column(2).to_numpy()[doc[some]] << 32 | pos[some])],
                names=["h1", "h2", "doc_id", "pos"],
            )

    return run


def _first_occurrences(min_docs: int):
    """Streams lines sorted by hash, document (descending) and position. The first document of a hash keeps its lines.

    A hash that may have begun in an earlier partition, or goes on in a later one before it is decided, stays open: its rows come out
    with a summary of the hash, two summaries a partition at most.
    """

    def out(kind, h1, h2, doc, pos, docs=None):
        n = len(doc)
        fill = lambda x: pa.nulls(n, pa.int64()) if x is None else pa.array(np.broadcast_to(np.asarray(x, np.int64), n))
        pos = pa.nulls(n, pa.int64()) if pos is None else pa.array(np.asarray(pos, np.int64))
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), fill(h1), fill(h2), pa.array(np.asarray(doc, np.int64)), pos, fill(docs)], names=["kind", "h1", "h2", "doc_id", "pos", "docs"])

    def run(batches):
        key, docs, top, at, first, held = None, 0, 0, 0, True, []
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            k1, k2, doc, pos = (batch.column(j).to_numpy(zero_copy_only=False) for j in range(4))
            turn = np.empty(n, bool)
            turn[0] = key is None or (k1[0], k2[0]) != key
            turn[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
            other = turn.copy()
            other[0] |= key is not None and doc[0] != at
            other[1:] |= doc[1:] != doc[:-1]
            cuts = np.flatnonzero(turn)
            starts = cuts if turn[0] else np.concatenate([[0], cuts])
            seen = np.cumsum(other)
            base = seen[starts] - 1
            if not turn[0]:
                base[0] = -docs
            run_of = np.cumsum(turn) - (1 if turn[0] else 0)
            rank = seen - base[run_of]
            total = rank[np.append(starts[1:], n) - 1]
            plain = np.ones(len(starts), bool)  # decided within this batch
            if turn[0] and key is not None:
                yield from end(out, first, key, docs, top, held, False, min_docs)
                first, held = False, []
            opening = first  # the partition's first hash is the first run here
            if not turn[0]:
                top0 = top
                if opening:
                    plain[0] = False
                    rows = run_of == 0
                    yield out(_OPEN, k1[rows], k2[rows], doc[rows], pos[rows])
                elif docs < min_docs <= total[0]:
                    for d, p in held:
                        yield out(_DROP, None, None, d, p)
                    held = []
            else:
                top0 = doc[0]
                if opening:
                    plain[0] = False
                    rows = run_of == 0
                    yield out(_OPEN, k1[rows], k2[rows], doc[rows], pos[rows])
            drop = plain[run_of] & (total[run_of] >= min_docs) & (rank > 1)
            if drop.any():
                yield out(_DROP, None, None, doc[drop], pos[drop])
            last = len(starts) - 1
            if last > 0 and not turn[0]:
                yield from end(out, opening, key, total[0], top0, held, False, min_docs)
                held = []
            elif last > 0 and opening:
                yield from end(out, True, (k1[0], k2[0]), total[0], top0, [], False, min_docs)
            first = opening and last == 0
            key, docs, at = (k1[-1], k2[-1]), int(total[last]), doc[-1]
            top = top0 if last == 0 else doc[starts[last]]
            if last > 0:
                held = []
            if not first and docs < min_docs:
                rows = (run_of == last) & (rank > 1)
                held.append((doc[rows], pos[rows]))
        if key is not None:
            yield from end(out, first, key, docs, top, held, True, min_docs)

    def end(out, first, key, docs, top, held, closing, min_docs):
        """Ends a run: its summary, if it may reach beyond the partition, and the rows that stay open."""
        if not first and not closing:
            return
        if not first and docs < min_docs:
            for d, p in held:
                yield out(_OPEN, key[0], key[1], d, p)
        yield out(_EDGE, key[0], key[1], [top], None, docs)

    return run


def line_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3, partitions: int | None = None) -> DataFrame:
    """(doc_id, n_lines, n_dropped, keep, mark): keep is a zlib-compressed bitmap of the lines that stay, most significant bit first.

    A line's key is the line without the white space `[\\x20\\x09-\\x0D]` at its ends, A-Z lower-cased. A key of min_chars code points
    or more that is found in min_docs documents or more loses all its lines except in the largest doc_id that holds it. A null or
    empty text has one empty line, which stays. Rows without an id count for nothing and lose nothing. Rows that repeat an id are one
    document; each of its texts has its own bitmap, told apart by mark.

    Lines are range-partitioned by (hash, document), so that a line of very many documents spreads over many partitions.
    """
    docs = text_documents(docs, id_col, text_col).withColumn("mark", _mark(F.col("text")))
    named = docs.where("doc_id is not null")
    lines = named.mapInArrow(_line_rows(min_chars), "h1 long, h2 long, doc_id long, pos long")
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("h1"), F.col("h2"), F.col("doc_id").desc()]
    dealt = lines.repartitionByRange(n, *order).sortWithinPartitions(*order, F.col("pos"))
    found = materialize(dealt.mapInArrow(_first_occurrences(min_docs), _STREAM), "ld-stream")
    edges = found.where(f"kind = {_EDGE}").groupBy("h1", "h2").agg(F.sum("docs").alias("docs"), F.max("doc_id").alias("top")).where(f"docs >= {min_docs}")
    opened = found.where(f"kind = {_OPEN}").select("h1", "h2", "doc_id", "pos")
    opened = opened.join(F.broadcast(edges), ["h1", "h2"]).where("doc_id < top")  # two rows a partition at most
    drops = found.where(f"kind = {_DROP}").select("doc_id", "pos").unionByName(opened.select("doc_id", "pos"))
    drops = drops.groupBy("doc_id", F.shiftright("pos", 32).alias("mark")).agg(F.collect_set(F.col("pos").bitwiseAND(F.lit(0xFFFFFFFF))).alias("dropped"))

    @F.pandas_udf("binary")
    def bitmap(n_lines: pd.Series, dropped: pd.Series) -> pd.Series:
        made = []
        for k, d in zip(n_lines, dropped, strict=True):
            bits = np.ones(int(k), np.uint8)
            if d is not None and len(d):
                d = np.asarray(d, np.int64)
                bits[d[d < k]] = 0
            made.append(zlib.compress(np.packbits(bits).tobytes(), 1))
        return pd.Series(made)

    text = F.coalesce("text", F.lit(""))
    counted = docs.select("doc_id", "mark", (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"))
    out = counted.join(drops, ["doc_id", "mark"], "left")
    return out.select("doc_id", "n_lines", F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"), bitmap("n_lines", "dropped").alias("keep"), "mark")


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text", dropped_col: str | None = None) -> DataFrame:
    """docs with each text reduced to the lines its bitmap keeps; all other columns stay. Texts that lose nothing never reach Python.

    dropped_col, if given, names a further column with the number of lines that went. Columns __id, __mark, __keep and __n are reserved.
    """
    reserved(docs, "__id", "__mark", "__keep", "__n", *([dropped_col] if dropped_col else []))

    @F.pandas_udf("string")
    def kept(text: pd.Series, keep: pd.Series) -> pd.Series:
        made = []
        for t, k in zip(text, keep, strict=True):
            if t is None or k is None:
                made.append(None)
                continue
            lines = t.split("\n")
            bits = np.unpackbits(np.frombuffer(zlib.decompress(k), np.uint8), count=len(lines))
            made.append("\n".join(x for x, b in zip(lines, bits.tolist(), strict=True) if b))
        return pd.Series(made)

    marks = bitmaps.where("n_dropped > 0").select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark"), F.col("keep").alias("__keep"), F.col("n_dropped").alias("__n")).dropDuplicates(["__id", "__mark"])
    # Always by a shuffle: which texts change grows with the input, so a broadcast would only serve small ones.
    both = docs.hint("merge").join(marks, (F.col(f"`{id_col}`").cast("long") == F.col("__id")) & (_mark(F.col(f"`{text_col}`")) == F.col("__mark")), "left")
    cut = kept(F.when(F.col("__keep").isNotNull(), F.col(f"`{text_col}`")), F.col("__keep"))
    text = F.when(F.col("__keep").isNotNull(), cut).otherwise(F.col(f"`{text_col}`"))
    more = [F.coalesce("__n", F.lit(0)).cast("long").alias(dropped_col)] if dropped_col else []
    return both.select(*(text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns), *more)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """docs without the repeated lines; rows and columns are the same. Columns __id, __mark, __keep and __n are reserved; for nulls and repeated ids see line_bitmaps."""
    return apply_bitmaps(docs, line_bitmaps(docs, id_col, text_col, min_chars, min_docs), id_col, text_col)
