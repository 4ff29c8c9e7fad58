"""Sharding by sampled splitters: size-weighted key samples give the boundaries of many small ranges, and runs of ranges make the shards."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.llm.shared import materialize, range_index, reserved, text_documents

#: Size of a row beyond its text.
ROW_BYTES = 8


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, key): UTF-8 bytes plus 8, CRC-32 of the text, and the 64-bit hash by which rows are ordered. A null text is empty."""
    docs = text_documents(docs, id_col, text_col)
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("key"))


def shards(rows: DataFrame, n_shards: int = 24, ranges_per_shard: int = 256, samples_per_range: int = 8) -> DataFrame:
    """rows (doc_id, size, key, ...) with shard (0 to n_shards - 1, sizes near equal) and slot (gapless from 0 in each shard).

    Rows are ordered by (key, doc_id, number of the row), so that equal texts lie side by side and share a shard, save where one group is
    itself too large for its range. A row is sampled with a probability in proportion to its size; the sample's quantiles cut the order into
    n_shards * ranges_per_shard ranges, a number that does not grow with the input. Overfull ranges are cut again, by sampling them
    more densely. Shards are runs of whole ranges, cut where the running size is nearest to equal shares. Only the sampled keys and one
    sum per range come to the driver, n_shards * ranges_per_shard * samples_per_range of them in the mean: rows are drawn one by one,
    also where they are equal, and a group of equal rows is cut by their numbers.
    A null doc_id comes first among equal texts; rows that repeat an id and a text each have a place. An empty table gives no rows.
    Columns __tie, __row, __range, __base, shard and slot are reserved.
    """
    reserved(rows, "__tie", "__row", "__range", "__base", "shard", "slot")
    rows = rows.withColumns({"__tie": F.coalesce("doc_id", F.lit(-(1 << 63))), "__row": F.monotonically_increasing_id()})
    rows = materialize(rows, "sh-rows")  # with its numbers, which stay
    total = rows.agg(F.sum("size")).first()[0] or 0
    n_ranges = n_shards * ranges_per_shard
    target = max(1.0, total / n_ranges)

    def sample(df: DataFrame, per: float) -> np.ndarray:
        """Keys (key, tie, row) of rows drawn with probability size / per, the same rows in every run."""
        draw = (F.xxhash64(F.lit(7), "key", "__tie", "__row").cast("double") / float(1 << 64) + 0.5) * F.lit(per) < F.col("size")
        got = df.where(draw).select("key", "__tie", "__row", "size").toArrow()
        k = np.empty(got.num_rows, [("key", np.int64), ("tie", np.int64), ("row", np.int64)])
        for i, c in enumerate(k.dtype.names):
            k[c] = got.column(i).to_numpy()
        weight = np.maximum(1.0, got.column(3).to_numpy() / per)
        order = np.argsort(k, order=k.dtype.names, kind="stable")
        return k[order], weight[order]

    def quantiles(k: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
        if not len(k) or n < 2:
            return k[:0]
        at = np.searchsorted(np.cumsum(weight), np.linspace(0, weight.sum(), n + 1)[1:-1])
        return np.unique(k[np.minimum(at, len(k) - 1)])

    def placed(cuts: np.ndarray) -> DataFrame:
        columns = tuple(cuts[c].copy() for c in cuts.dtype.names)

        @F.arrow_udf("int")
        def range_of(keys: pa.Array, ties: pa.Array, numbers: pa.Array) -> pa.Array:
            return pa.array(range_index(columns, tuple(c.to_numpy(zero_copy_only=False) for c in (keys, ties, numbers))).astype(np.int32))

        return rows.withColumn("__range", range_of("key", "__tie", "__row"))

    cuts = quantiles(*sample(rows, target / samples_per_range), n_ranges)
    dealt = placed(cuts)
    sizes = {r[0]: r[1] for r in dealt.groupBy("__range").agg(F.sum("size")).collect()}
    over = sorted(r for r, s in sizes.items() if s > 2 * target)
    if over:
        dense = sample(dealt.where(F.col("__range").isin(over)), target / samples_per_range / 8)
        parts = np.searchsorted(cuts, dense[0], "right")
        more = [quantiles(dense[0][parts == r], dense[1][parts == r], int(np.ceil(sizes[r] / target))) for r in over]
        cuts = np.unique(np.concatenate([cuts, *more]))
        dealt = placed(cuts)
        sizes = {r[0]: r[1] for r in dealt.groupBy("__range").agg(F.sum("size")).collect()}
    dealt = materialize(dealt, "sh-ranges")
    counts = {r[0]: r[1] for r in dealt.groupBy("__range").count().collect()}
    plan, done, rows_before, shard_rows = [], 0, {}, [0] * n_shards
    for r in sorted(sizes):
        shard = min(n_shards - 1, int((done + sizes[r] / 2) * n_shards // max(1, total)))
        plan.append((r, shard, shard_rows[shard]))
        done += sizes[r]
        shard_rows[shard] += counts[r]
    plan = dealt.sparkSession.createDataFrame(plan, "__range int, shard int, __base long")
    out = dealt.join(F.broadcast(plan), "__range")  # a row per range
    rank = F.row_number().over(Window.partitionBy("__range").orderBy("key", "__tie", "__row"))
    return out.withColumn("slot", F.col("__base") + rank - 1).drop("__range", "__base", "__tie", "__row")
