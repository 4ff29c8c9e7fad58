"""License scans: Aho-Corasick finds identifier tags and notice phrases; a shunting-yard parser evaluates the tags' expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from panelforge.llm.kernels import LOWER, word_spans
from panelforge.llm.search import BETWEEN
from panelforge.llm.shared import text_blocks, text_documents

# Phrases (words parted by one space) and their labels.
BASE_PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Further notices; of two that begin at one word, the longer counts.
NOTICES = {
    "released under the mit license": "mit", "mit license": "mit", "licensed under the apache license": "apache-2", "bsd 2 clause": "bsd-2", "bsd 3 clause": "bsd-3", "isc license": "isc", "mozilla public license": "mpl-2",
    "gnu general public license": "gpl", "gnu general public license version 2": "gpl-2", "gnu general public license version 3": "gpl-3",
    "gnu lesser general public license": "lgpl", "gnu affero general public license": "agpl", "eclipse public license": "epl-2",
    "cc0": "cc0", "cc by": "cc-by", "cc by sa": "cc-by-sa", "cc by nd": "cc-by-nd", "cc by nc": "cc-by-nc", "cc by nc sa": "cc-by-nc-sa", "cc by nc nd": "cc-by-nc-nd",
    "dedicated to the public domain": "public-domain", "all rights reserved": "reserved",
}
#: What names a licence by an expression that follows it after : or =.
TAGS = ("spdx license identifier", "license expression", "license")
#: Identifiers of expressions and their labels.
IDENTIFIERS = {
    "mit": "mit", "apache-2.0": "apache-2", "bsd-2-clause": "bsd-2", "bsd-3-clause": "bsd-3", "isc": "isc", "zlib": "zlib", "unlicense": "public-domain", "cc0-1.0": "cc0", "mpl-2.0": "mpl-2", "epl-2.0": "epl-2",
    "gpl-2.0": "gpl-2", "gpl-2.0-only": "gpl-2", "gpl-2.0-or-later": "gpl-2", "gpl-3.0": "gpl-3", "gpl-3.0-only": "gpl-3", "gpl-3.0-or-later": "gpl-3",
    "lgpl-2.1": "lgpl", "lgpl-2.1-only": "lgpl", "lgpl-2.1-or-later": "lgpl", "lgpl-3.0": "lgpl", "lgpl-3.0-only": "lgpl", "lgpl-3.0-or-later": "lgpl", "agpl-3.0": "agpl", "agpl-3.0-only": "agpl", "agpl-3.0-or-later": "agpl",
    "cc-by-4.0": "cc-by", "cc-by-sa-4.0": "cc-by-sa", "cc-by-nd-4.0": "cc-by-nd", "cc-by-nc-4.0": "cc-by-nc", "cc-by-nc-sa-4.0": "cc-by-nc-sa", "cc-by-nc-nd-4.0": "cc-by-nc-nd",
}
EXCEPTIONS = ("classpath-exception-2.0", "gcc-exception-3.1", "llvm-exception", "linux-syscall-note", "autoconf-exception-3.0", "bison-exception-2.2", "font-exception-2.0")
#: How freely a text may be used, from 0 to 1.
GRADES = {
    "public-domain": 1.0, "cc0": 1.0, "mit": 1.0, "isc": 1.0, "zlib": 1.0, "bsd-2": 1.0, "bsd-3": 1.0, "apache-2": 1.0, "cc-by": 0.9, "mpl-2": 0.75, "epl-2": 0.75, "lgpl": 0.7,
    "cc-by-sa": 0.6, "gpl": 0.5, "gpl-2": 0.5, "gpl-3": 0.5, "agpl": 0.4, "cc-by-nd": 0.3, "cc-by-nc": 0.2, "cc-by-nc-sa": 0.2, "cc-by-nc-nd": 0.1, "reserved": 0.0,
}
_PRECEDENCE = {"or": 1, "and": 2, "with": 3}
_SIGN = re.compile(rb"[\"']?[ \t]*[:=][ \t]*[\"']?")
_TOKEN = re.compile(rb"[ \t]*(\(|\)|[A-Za-z0-9][A-Za-z0-9.+-]*)")

#: (grade, labels) of an expression.
Value = tuple[float, frozenset]


def _apply(op: str, a: Value, b: Value) -> Value:
    """or: the freer side, both at equal grades; and: both sides, the stricter grade; with: the exception takes away half of what is kept back."""
    if op == "or":
        return a if a[0] > b[0] else b if b[0] > a[0] else (a[0], a[1] | b[1])
    if op == "and":
        return min(a[0], b[0]), a[1] | b[1]
    return (a[0] + 1) / 2, frozenset(f"{x}-with-{next(iter(b[1]))}" for x in a[1])


def evaluate(text: bytes, start: int, end: int) -> tuple[float, frozenset, int] | None:
    """The grade and labels of the longest licence expression at text[start:end], and where it ends; None if there is none.

    Shunting-yard: with binds before and, and before or; values are combined as operators leave the stack. What follows the last whole
    operand (an operator without its right side, an unknown name) is left out, and parentheses that are open then are closed.
    """
    values: list[Value] = []
    ops: list[str] = []
    pending = 0  # entries of ops since the last operand
    at = done = start
    operand = True

    def reduce() -> None:
        b, a = values.pop(), values.pop()
        values.append(_apply(ops.pop(), a, b))

    while m := _TOKEN.match(text, at, end):
        word = m[1].lower().decode()
        if operand:
            if word == "(":
                if ops[-1:] == ["with"]:
                    break
                ops.append(word)
                pending += 1
            elif ops[-1:] == ["with"]:
                if word not in EXCEPTIONS:
                    break
                values.append((1.0, frozenset([word])))
                operand, pending, done = False, 0, m.end()
            elif word in IDENTIFIERS or word.rstrip("+") in IDENTIFIERS:
                label = IDENTIFIERS.get(word) or IDENTIFIERS[word.rstrip("+")]
                values.append((GRADES[label], frozenset([label])))
                operand, pending, done = False, 0, m.end()
            else:
                break
        elif word == ")":
            while ops and ops[-1] != "(":
                reduce()
            if not ops:
                break
            ops.pop()
            done = m.end()
        elif word in _PRECEDENCE:
            while ops and ops[-1] != "(" and _PRECEDENCE[ops[-1]] >= _PRECEDENCE[word]:
                reduce()
            ops.append(word)
            operand, pending = True, 1
        else:
            break
        at = m.end()
    if not values:
        return None
    if operand:
        del ops[len(ops) - pending :]
    while ops:
        if ops[-1] == "(":
            ops.pop()
        else:
            reduce()
    return values[0][0], values[0][1], done


def automaton() -> ahocorasick.Automaton:
    """Over words with a space on both sides: the entries (kind, label, number of words) of each phrase."""
    entries: dict[str, list[tuple[str, str, int]]] = {}
    for kind, phrases in (("base", BASE_PHRASES), ("notice", NOTICES), ("tag", dict.fromkeys(TAGS, ""))):
        for phrase, label in phrases.items():
            entries.setdefault(f" {phrase} ", []).append((kind, label, phrase.count(" ") + 1))
    out = ahocorasick.Automaton()
    for phrase, found in entries.items():
        out.add_word(phrase, (len(phrase), found))
    out.make_automaton()
    return out


def _plain(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, doc: np.ndarray) -> tuple[str, np.ndarray]:
    """The words with one space before each, each document's closed by a space and a line's end, byte for byte; and where each word starts."""
    size = ends - starts
    breaks = np.cumsum(np.append(0, doc[1:] != doc[:-1]))
    at = np.append(0, np.cumsum(size)[:-1]) + np.arange(1, len(size) + 1) + 2 * breaks
    out = np.full(int(at[-1] + size[-1]) + 2, 0x20, np.uint8)
    within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(at, size) + within] = LOWER[buf[np.repeat(starts, size) + within]]
    last = np.flatnonzero(np.append(breaks[1:] != breaks[:-1], True))
    out[at[last] + size[last] + 1] = 0x0A
    return out.tobytes().decode("latin-1"), at


def findings(buf: np.ndarray, offs: np.ndarray, trie: ahocorasick.Automaton) -> Iterator[tuple[int, str, str, float, int, int, str | None]]:
    """(document, kind, label, grade, first word, words, expression) of all documents, in order; an expression has a row for each label."""
    starts, ends, doc = word_spans(buf, offs, BETWEEN)
    if not len(starts):
        return
    plain, at = _plain(buf, starts, ends, doc)
    first = np.searchsorted(doc, np.arange(len(offs) - 1))
    hits = [(end - size + 2, *entry) for end, (size, entries) in trie.iter(plain) for entry in entries]
    if not hits:
        return
    word = np.searchsorted(at, [h[0] for h in hits])
    hits = sorted((int(w), -n, kind, label) for w, (_, kind, label, n) in zip(word, hits, strict=True))
    text, covered, tagged = buf.tobytes(), (-1, ""), -1
    for w, n, kind, label in hits:
        d, n = int(doc[w]), -n
        place = w - int(first[d])
        if kind == "base":
            yield d, kind, label, GRADES[label], place, n, None
        elif kind == "notice":
            if covered != (w, kind):
                covered = (w, kind)  # the longest at this word comes first
                yield d, kind, label, GRADES[label], place, n, None
        elif w >= tagged:
            end = int(offs[d + 1])
            sign = _SIGN.match(text, int(ends[w + n - 1]), end)
            got = sign and evaluate(text, sign.end(), end)
            if got:
                tagged = int(np.searchsorted(starts, got[2]))  # a tag inside another one's expression isn't a tag
                expression = text[sign.end() : got[2]].decode(errors="replace").strip()
                for x in sorted(got[1]):
                    yield d, kind, x, got[0], place, n, expression


_FINDING = pa.struct([("kind", pa.string()), ("label", pa.string()), ("grade", pa.float64()), ("start", pa.int64()), ("n_words", pa.int64()), ("expression", pa.string())])


def license_findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, findings): words of each whole text, and what tells of a licence in it, in order.

    A finding has kind (base, notice or tag), label, grade (0 to 1, how freely the text may be used), start (its first word, from 0),
    n_words, and for a tag the expression as written. Words are runs of letters, digits and all non-ASCII characters, A-Z lower-cased.
    Null and empty texts have no words and no findings; a null doc_id is kept, repeated rows each have a result, an empty table gives no
    rows. The work follows the text's length, also where it is one long expression.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = automaton()
        for rows, buf, offs in text_blocks(batches):
            _, _, doc = word_spans(buf, offs, BETWEEN)
            found = list(findings(buf, offs, trie))
            count = np.bincount(np.array([f[0] for f in found], np.int64), minlength=rows.num_rows)
            cells = pa.StructArray.from_arrays([pa.array([f[i] for f in found], _FINDING[i - 1].type) for i in range(1, 7)], fields=list(_FINDING))
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)), pa.int32()), cells)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.bincount(doc, minlength=rows.num_rows)), lists], names=["doc_id", "n_words", "findings"])

    schema = "doc_id long, n_words long, findings array<struct<kind string, label string, grade double, start long, n_words long, expression string>>"
    return text_documents(docs, id_col, text_col).mapInArrow(run, schema)
