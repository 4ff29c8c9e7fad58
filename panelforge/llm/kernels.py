"""Vectorised numpy kernels over the bytes of many documents at once: words, hashes of spans, shingles."""

from __future__ import annotations

import numpy as np

U = np.uint64
#: Powers of a hash's base that are kept from block to block, at most.
KEPT_POWERS = 1 << 20
#: The bytes that part words: space and \t \n \v \f \r.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: Lower-cases A-Z and leaves all other bytes alone.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection on 64 bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def stream(seed: int, n: int) -> np.ndarray:
    """n pseudo-random 64-bit numbers that depend on seed alone."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=U) + U(seed) * U(0x1000193)) * U(0x9E3779B97F4A7C15))


class SpanHasher:
    """64-bit hashes of byte spans from one prefix sum: sum of R[byte] * K^i, shifted back to the span's start by K^-start."""

    def __init__(self, seed: int):
        table = stream(seed, 258)
        self.seed, self.table = seed, table[:256] | U(1)
        self.base = int(table[256]) | 1
        self.inverse = pow(self.base, -1, 1 << 64)
        self.end = table[257]
        self._powers = [np.ones(1, U), np.ones(1, U)]

    def _power(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Powers of the base and of its inverse; those for an ordinary block are kept, those for a very long text are not."""
        if len(self._powers[0]) >= n:
            return self._powers[0][:n], self._powers[1]
        made = []
        for b in (self.base, self.inverse):
            step = np.full(max(n, 1 << 16), U(b))
            step[0] = 1
            made.append(np.multiply.accumulate(step, out=step))
        if n <= KEPT_POWERS:
            self._powers = made
        return made[0][:n], made[1]

    def __call__(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            forth, back = self._power(len(buf) + 1)
            sums = np.zeros(len(buf) + 1, U)
            np.cumsum(self.table[buf] * forth[: len(buf)], out=sums[1:])
            return mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(U) * self.end)


WORD_HASH = SpanHasher(1)


def word_spans(buf: np.ndarray, offs: np.ndarray, between: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words (by default `[^\\x20\\x09-\\x0D]+`), and the document each is in. Words never cross documents."""
    n = len(buf)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    space = between[buf]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    before = np.empty(n, bool)
    before[0], before[1:] = True, space[:-1]
    after = np.empty(n, bool)
    after[-1], after[:-1] = True, space[1:]
    starts = np.flatnonzero(~space & (before | edge[:-1]))
    ends = np.flatnonzero(~space & (after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def word_hashes(buf: np.ndarray, offs: np.ndarray, between: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, A-Z lower-cased, and the document it is in."""
    starts, ends, doc = word_spans(buf, offs, between)
    return WORD_HASH(LOWER[buf], starts, ends), doc


def shingle_hashes(words: np.ndarray, doc: np.ndarray, n_docs: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words inside a document; a document of 1 to k-1 words gives its whole sequence as one."""
    if not len(words):
        return words, doc
    with np.errstate(over="ignore"):
        runs = np.zeros(0, U)
        at = np.zeros(0, np.int64)
        if len(words) >= k:
            m = len(words) - k + 1
            runs = mix(words[:m] + U(k))
            for j in range(1, k):
                runs = mix(runs * U(3) + words[j : m + j])
            whole = doc[:m] == doc[k - 1 :]
            runs, at = runs[whole], doc[:m][whole]
        count = np.bincount(doc, minlength=n_docs)
        few = np.flatnonzero((count > 0) & (count < k))
        if len(few):
            first = np.searchsorted(doc, few)
            short = mix(words[first] + count[few].astype(U))
            for j in range(1, k - 1):
                more = count[few] > j
                short[more] = mix(short[more] * U(3) + words[first[more] + j])
            runs, at = np.concatenate([runs, short]), np.concatenate([at, few])
    return runs, at


def distinct_by_doc(values: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values of each document, ordered by document and value: values, documents, how often each occurs."""
    if not len(values):
        return values, doc, np.zeros(0, np.int64)
    order = np.argsort(values)
    order = order[np.argsort(doc[order], kind="stable")]
    v, d = values[order], doc[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (d[1:] != d[:-1])
    first = np.flatnonzero(new)
    return v[first], d[first], np.diff(np.append(first, len(v)))


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)
