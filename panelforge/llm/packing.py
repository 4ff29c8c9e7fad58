"""Best-fit packing: a configuration linear program over the length histogram, solved by multiplicative weights, then rounded."""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelforge.llm.kernels import LOWER, SpanHasher, U
from panelforge.llm.shared import materialize, reserved, text_blocks, text_documents

#: Chunks whose ids a Python worker keeps, about 32 bytes each.
CACHE_CHUNKS = 1_000_000
#: Words that normalizing leaves as they are and that are one word for the tokenizer; they skip these two steps.
_PLAIN = re.compile("[a-zß-öø-ÿ]+")
_BLANK, _SMALL, _SIGN = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_BLANK[list(b" \n")] = True
_SMALL[97:123] = True
_SIGN[list(b".,;:!?*%&#$|)]")] = True
_CHUNK_HASH = SpanHasher(31)
_KNOWN: dict[str, _Chunks] = {}


class _Chunks:
    """Token ids of chunks of text by their 64-bit hashes: keys ascending, begin and size of their ids in one array."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole, self.plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.plain.normalizer = None
        self.plain.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.keys, self.begin, self.size, self.ids = np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.uint32)

    def tokenized(self, chunks: list[bytes]) -> list[list[int]]:
        texts = [c.decode() for c in chunks]
        simple = [_PLAIN.fullmatch(t) is not None for t in texts]
        plain = iter(self.plain.encode_batch_fast([t for t, s in zip(texts, simple, strict=True) if s], add_special_tokens=False))
        whole = iter(self.whole.encode_batch_fast([t for t, s in zip(texts, simple, strict=True) if not s], add_special_tokens=False))
        return [next(plain if s else whole).ids for s in simple]

    def look_up(self, keys: np.ndarray, chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """keys, ascending; chunk(k): the bytes of the k-th -> all ids, and where the keys' ids begin in them and how many they are."""
        at = np.searchsorted(self.keys, keys)
        hit = self.keys[np.minimum(at, len(self.keys) - 1)] == keys if len(self.keys) else np.zeros(len(keys), bool)
        begin, size = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int32)
        begin[hit], size[hit] = self.begin[at[hit]], self.size[at[hit]]
        new = np.flatnonzero(~hit)
        made = self.tokenized([chunk(k) for k in new.tolist()])
        size[new] = [len(x) for x in made]
        begin[new] = len(self.ids) + np.cumsum(size[new]) - size[new]
        ids = np.concatenate([self.ids, np.fromiter((i for x in made for i in x), np.uint32)])
        if len(self.keys) + len(new) <= CACHE_CHUNKS:
            self.keys, self.begin, self.size, self.ids = np.insert(self.keys, at[new], keys[new]), np.insert(self.begin, at[new], begin[new]), np.insert(self.size, at[new], size[new]), ids
        return ids, begin, size


def token_ids(buf: np.ndarray, offs: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of the texts in buf, without special tokens, and how many each text has.

    For vocabularies that drop white space and lower-case: a text's ids are those of its chunks between blanks, so each chunk is
    looked up, and only new chunks go through the tokenizer. Before an ASCII sign that follows a letter a word always ends, so a cut
    there changes no ids and makes more chunks equal. Two chunks of one block and the cache share a hash with a chance below 1e-8.
    """
    if path not in _KNOWN:
        _KNOWN[path] = _Chunks(path)
    n, size = len(offs) - 1, len(buf)
    if not size:
        return np.zeros(0, np.uint32), np.zeros(n, np.int64)
    low = LOWER[buf]
    cut = np.zeros(size + 1, bool)
    cut[1:-1] = _SMALL[low[:-1]] & _SIGN[low[1:]]
    # A special token's string may be in the text; it must not be lower-cased or cut.
    special = np.zeros(n, bool)
    special[np.searchsorted(offs, np.flatnonzero((buf[:-1] == 60) & (buf[1:] == 124)), "right") - 1] = True
    if special.any():
        raw = np.repeat(special, np.diff(offs))
        low[raw] = buf[raw]
        cut[:-1][raw] = False
    cut[offs] = True
    blank = np.ones(size + 2, bool)
    blank[1:-1] = _BLANK[low]
    starts = np.flatnonzero(~blank[1:-1] & (blank[:-2] | cut[:-1]))
    ends = np.flatnonzero(~blank[1:-1] & (blank[2:] | cut[1:])) + 1
    doc = np.searchsorted(offs, starts, "right") - 1
    keys, first, kind = np.unique(_CHUNK_HASH(low, starts, ends), return_index=True, return_inverse=True)
    ids, begin, many = _KNOWN[path].look_up(keys, lambda k: low[starts[first[k]] : ends[first[k]]].tobytes())
    many = many[kind]
    at = np.repeat(begin[kind] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
    return ids[at], np.bincount(doc, many, n).astype(np.int64)


def _rank_in_partition() -> Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Gives, for the lengths of one batch after the other, the partition and the rank of each piece among those of its length there."""
    seen: Counter[int] = Counter()
    part = TaskContext.get().partitionId()

    def ranks(length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(length, kind="stable")
        kinds, first, many = np.unique(length[order], return_index=True, return_counts=True)
        at = np.empty(len(length), np.int64)
        at[order] = np.arange(len(length)) - np.repeat(first, many) + np.repeat([seen[int(k)] for k in kinds], many)
        seen.update(dict(zip(kinds.tolist(), many.tolist(), strict=True)))
        return np.full(len(length), part, np.int32), at

    return ranks


def token_pieces(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", ranked: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids): every document's token ids and then end_id, cut into pieces of size ids if longer.

    ids are little-endian unsigned 32-bit numbers. A null or empty text is the end_id alone; rows with a null or repeated id are
    documents of their own. Whole texts are tokenized. ranked adds `__part` and `__at`, which spare pack() a pass of its own.
    """
    docs = text_documents(docs, id_col, text_col)

    def run(batches):
        ranks = _rank_in_partition()
        for rows, buf, offs in text_blocks(batches):
            ids, count = token_ids(buf, offs, tokenizer)
            ids = np.insert(ids, np.cumsum(count), end_id).astype("<u4")
            count += 1
            pieces = -(-count // size)
            doc = np.repeat(np.arange(rows.num_rows), pieces)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * size
            length = np.minimum(size, count[doc] - start)
            edges = np.concatenate([[0], np.cumsum(4 * length)])
            cols = [rows.column(0).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), _binary(edges, ids)]
            names = ["doc_id", "piece", "start", "length", "ids"]
            if ranked:
                cols, names = cols + [pa.array(x) for x in ranks(length)], [*names, "__part", "__at"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary" + (", __part int, __at long" if ranked else ""))


def _binary(edges: np.ndarray, data: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def price(values: np.ndarray, lengths: np.ndarray, size: int, many: int = 64, slack: float = 0.5) -> list[dict[int, int]]:
    """Configurations of items (lengths, ascending) that fill size exactly, the most valuable first, by knapsack dynamic programming.

    After the best one come the best with another item each, as long as they are worth (1 - slack) of it and share no item with those
    before them; [] if no fill is exact.
    """
    best, last = np.full(size + 1, -np.inf), np.full(size + 1, -1)
    best[0] = 0
    back = size - lengths  # best[c - lengths] for c = size, moved along with c
    for c in range(int(lengths[0]), size + 1):
        k = int(np.searchsorted(lengths, c, "right"))
        got = values[:k] + best[back[:k] - (size - c)]
        i = int(got.argmax())
        best[c], last[c] = got[i], i
    if best[size] == -np.inf:
        return []
    worth = values + best[back]
    used, out = np.zeros(len(lengths), bool), []
    for first in np.argsort(-worth, kind="stable").tolist():
        if len(out) == many or worth[first] < best[size] * (1 - slack) or worth[first] == -np.inf:
            break
        if used[first]:
            continue
        config, c = Counter([first]), size - int(lengths[first])
        while c:
            i = int(last[c])
            config[i] += 1
            c -= int(lengths[i])
        if not used[list(config)].any():
            used[list(config)] = True
            out.append(dict(config))
    return out


def program(counts: dict[int, int], size: int, rounds: int = 400, rate: float = 4.0, part: float = 0.25) -> dict[tuple[tuple[int, int], ...], float]:
    """The covering program over a histogram: ((length, pieces a sequence), ...) -> how often, in fractions.

    Multiplicative weights hold a price per length, which falls by exp(-rate) as the length is covered. Each round the knapsack prices
    full configurations, and each of them is taken for `part` of what its scarcest length still allows, so all lengths are covered
    evenly and none more than once. It ends with 98 % of the pieces, as the last ones take the most rounds.
    """
    lengths = np.array(sorted(counts))
    need = np.array([counts[int(k)] for k in lengths], float)
    share = np.zeros(len(lengths))  # of each length, covered so far
    chosen: Counter[tuple[tuple[int, int], ...]] = Counter()
    for _ in range(rounds):
        if share @ need >= 0.98 * need.sum():
            break
        some = np.flatnonzero(share < 1 - 1e-9)
        # A piece costs one token of its value, so that of equal fills the one with fewer pieces is taken and short pieces last.
        found = price(lengths[some] * np.exp(-rate * share[some]) - 1, lengths[some], size) if len(some) else []
        if not found:
            break
        for config in found:
            key = [(int(some[i]), n) for i, n in config.items()]
            allowed = min((1 - share[i]) * need[i] / n for i, n in key)
            step = min(allowed, max(1.0, part * min(need[i] / n for i, n in key)))
            chosen[tuple(sorted(((int(lengths[i]), n) for i, n in key), reverse=True))] += step
            for i, n in key:
                share[i] += n * step / need[i]
    return dict(chosen)


def configurations(counts: dict[int, int], size: int, rounds: int = 400, covered: float = 0.95, solves: int = 3) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """How to pack counts (length -> pieces): (times, ((length, pieces a sequence), ...)), the largest length first.

    The linear program covers the histogram with as few configurations as it can, which are those without waste. Its fractions are
    rounded to the nearest whole number of sequences that the pieces allow, the largest first; what is left makes a program of its
    own, until `covered` of the pieces are in such sequences. The residue is packed best-fit. If that ends above the volume bound, a
    part of every configuration is taken back for best-fit to mix; of all that is tried the fewest sequences count, then the most of
    the program; only where most pieces are long and few fills are exact does best-fit alone win. The histogram has at most size lengths, so all this is small however many pieces there are.
    """
    left = {k: n for k, n in counts.items() if n > 0}
    out: list[tuple[int, tuple[tuple[int, int], ...]]] = []
    if left.get(size):
        out.append((left.pop(size), ((size, 1),)))
    everything, pieces = dict(left), sum(left.values())
    fewest = -(-sum(k * n for k, n in left.items()) // size)
    made: Counter[tuple[tuple[int, int], ...]] = Counter()
    for _ in range(solves):
        if sum(left.values()) <= (1 - covered) * pieces:
            break
        before = sum(left.values())
        for key, x in sorted(program(left, size, rounds).items(), key=lambda kx: (-kx[1], kx[0])):
            times = int(min(np.floor(x + 0.5), *(left.get(k, 0) // n for k, n in key)))
            if times > 0:
                made[key] += times
                for k, n in key:
                    left[k] -= times * n
        left = {k: n for k, n in left.items() if n}
        if sum(left.values()) == before:
            break
    tried = []
    for part in (1.0, 0.98, 0.95, 0.9, 0.8, 0.6, 0.3, 0.0):
        kept, rest, total = [], dict(everything), 0.0
        for key, times in sorted(made.items(), key=lambda kt: (-kt[1], kt[0])):
            whole = int(total + part * times + 1e-9) - int(total + 1e-9)  # part of all, spread evenly over the configurations
            total += part * times
            if whole:
                kept.append((whole, key))
                for k, n in key:
                    rest[k] -= whole * n
        kept += best_fit(rest, size)
        tried.append((sum(t for t, _ in kept), len(tried), kept))
        if tried[-1][0] <= fewest:
            break
    return out + min(tried)[2]


def best_fit(counts: dict[int, int], size: int) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """Best-fit decreasing over a histogram: each sequence takes the longest piece left, then again and again the longest that still fits; equal sequences are made together."""
    left = dict(sorted(((k, n) for k, n in counts.items() if n > 0), reverse=True))
    out = []
    while left:
        room, config = size, {}
        for k in list(left):
            n = min(left[k], room // k)
            if n:
                config[k] = n
                room -= n * k
        times = min(left[k] // n for k, n in config.items())
        out.append((times, tuple(config.items())))
        for k, n in config.items():
            left[k] -= times * n
            if not left[k]:
                del left[k]
    return out


def pack(pieces: DataFrame, size: int = 2048, rounds: int = 400) -> DataFrame:
    """pieces (doc_id, piece, length, ...) with sequence_id and offset: as few sequences of at most size as the rounded program gives; an empty table gives none, and ids play no part.

    Offsets are gapless from 0. Only the length histogram (at most size rows) comes to the driver. Each piece gets its rank among
    pieces of its length from the rank inside its partition and a sum over earlier partitions; a table of configurations then turns
    (length, rank) into a place. A length outside 1..size is an error. Columns n, __before, __place, sequence_id and offset are reserved.
    """
    reserved(pieces, "n", "__before", "__place", "sequence_id", "offset")
    names = [c for c in pieces.columns if c not in ("__part", "__at")]
    rows = pieces
    if "__at" not in pieces.columns:

        def run(batches):
            ranks = _rank_in_partition()
            for batch in batches:
                length = batch.column(batch.schema.get_field_index("length")).to_numpy()
                yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, ranks(length))], names=[*names, "__part", "__at"])

        rows = pieces.mapInArrow(run, T.StructType([*pieces.schema.fields, T.StructField("__part", T.IntegerType()), T.StructField("__at", T.LongType())]))
    rows = materialize(rows, "pk-pieces")
    tally = rows.groupBy("__part", "length").agg(F.count(F.lit(1)).alias("n"))
    before = tally.withColumn("__before", F.sum("n").over(Window.partitionBy("length").orderBy("__part")) - F.col("n"))
    before = materialize(before, "pk-tally")
    counts = {int(r[0]): int(r[1]) for r in before.groupBy("length").agg(F.sum("n")).collect()}
    if counts and not 1 <= min(counts) <= max(counts) <= size:
        raise ValueError(f"lengths must be from 1 to {size}, not {min(counts)} to {max(counts)}")
    places, sequence, used = [], 0, Counter()
    for times, config in configurations(counts, size, rounds):
        offset = 0
        for length, n in config:
            places.append((length, used[length], used[length] + times * n, n, sequence, offset))
            used[length] += times * n
            offset += length * n
        sequence += times
    # For each length the places in order of rank: from which rank, pieces a sequence, first sequence, offset.
    by_length: dict[int, list] = {}
    for length, a, _, n, s, o in sorted(places):
        by_length.setdefault(length, []).append((a, n, s, o))
    table = {k: np.array(v, np.int64).T for k, v in by_length.items()}

    def placed(length: pa.Array, rank: pa.Array) -> pa.Array:
        length, rank = length.to_numpy(zero_copy_only=False), rank.to_numpy(zero_copy_only=False)
        seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for k in np.unique(length):
            own = np.flatnonzero(length == k)
            a, n, s, o = table[int(k)]
            i = np.searchsorted(a, rank[own], "right") - 1
            r = rank[own] - a[i]
            seq[own], off[own] = s[i] + r // n[i], o[i] + r % n[i] * k
        return pa.StructArray.from_arrays([pa.array(seq), pa.array(off)], names=["sequence_id", "offset"])

    place = F.arrow_udf(placed, "sequence_id long, offset long")
    out = rows.join(before.select("__part", "length", "__before"), ["__part", "length"])
    out = out.withColumn("__place", place("length", F.col("__before") + F.col("__at")))
    return out.select(*(f"`{c}`" for c in names), "__place.sequence_id", "__place.offset")
