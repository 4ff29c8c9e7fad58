"""The prefix trie, the license scan and the ranked search against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from panelforge.llm import licenses, queries, search, trie
from tests.llm.conftest import prose

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---- 11

def brute_trie(turns):
    own = defaultdict(list)
    for conv, turn, role, text in turns:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(rows)] for c, rows in own.items()}
    full = {}
    for c, rows in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(math.fmod(c, 5))
        full[c] = (own.get(base, [])[:h] + rows[h:],)
    members = defaultdict(list)
    for c, (rows,) in full.items():
        for d in range(len(rows) + 1):
            members[tuple(rows[:d])].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    leaves, saved = Counter(), Counter()
    for node, convs in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not kids[node]
            saved[node[:d]] += (len(convs) - 1) * (len(node[-1][1].encode()) if node else 0)
    out = []
    for node, convs in members.items():
        ends = ",".join(str(c) for c in sorted(convs) if len(full[c][0]) == len(node))
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(kids[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return Counter(out)


def conversations():
    rng = random.Random(5)
    turns = []
    for c in range(-12, 90):
        same = rng.random() < 0.4
        for t in range(rng.randint(1, 10)):
            turns.append((c, t if t else None, ("user", "assistant")[t % 2] if c % 7 else None, f"turn {t} é" if same else rng.choice(("a", "b", "", None))))
    turns += [(200, t, "user", "x" * (t % 3)) for t in range(600)] + [(205, t, "user", "x" * (t % 3)) for t in range(640)]  # a third of all rows, twice nearly
    turns += [(None, 1, "user", "no conversation"), (None, None, None, None)]
    return turns


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


@pytest.mark.parametrize("small", [False, True])
def test_prefix_trie(spark, monkeypatch, small):
    if small:  # many shards, a crown, queues that spill
        monkeypatch.setattr(trie, "SHARD_TURNS", 20)
        monkeypatch.setattr(trie, "SHARES", 10**9)
        monkeypatch.setattr(trie, "QUEUE_ROWS", 2)
    turns = conversations()
    table = spark.createDataFrame([(*t, 1, "clash", 2) for t in turns], "conv_id long, turn long, role string, text string, k1 int, depth string, total int")
    got = Counter(tuple(r[c] for c in COLUMNS) for r in trie.prefix_trie(table).collect())
    assert got == brute_trie(turns)


def test_prefix_trie_of_repeated_rows_and_of_nothing(spark):
    """A conversation of equal turns is split over ranges; an empty table gives no rows; a turn of the same number counts."""
    turns = [(1, 0, "u", "same")] * 300 + [(2, 0, "u", "same")] * 200
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    assert Counter(tuple(r[c] for c in COLUMNS) for r in trie.prefix_trie(table).collect()) == brute_trie(turns)
    assert trie.prefix_trie(table.limit(0)).count() == 0


def test_running_sums_go_over_ranges(spark):
    rows = spark.createDataFrame([(k, i, (i * 7919 + k) * 10**12) for k, n in ((1, 500), (2, 3), (-4, 900), (9, 1)) for i in range(n)], "k long, i long, v long")
    got = trie.running_sums(rows, "k", ["i"], ["v"], "sums").collect()
    assert len(got) == 1404
    sums = defaultdict(int)
    for r in sorted(got, key=lambda r: (r.k, r.i)):
        assert r.v_before % 2**64 == sums[r.k] % 2**64
        sums[r.k] += r.v
        assert r.v_upto % 2**64 == sums[r.k] % 2**64


def test_forward_queue_spills():
    queue = trie.ForwardQueue(8)
    keys = np.array([f"{i:016d}".encode() for i in range(40)], "S16")
    queue.level(5)
    rng, want = np.random.default_rng(1), np.zeros((40, 3), np.int64)
    for _ in range(30):
        at, x = rng.integers(0, 40, 7), rng.integers(0, 9, (7, 3))
        m = np.empty(7, trie._MESSAGE)
        m["key"], m["children"], m["leaves"], m["saved"] = keys[at], x[:, 0], x[:, 1], x[:, 2]
        queue.push(m)
        np.add.at(want, at, x)
    assert any(isinstance(r, np.memmap) for r in queue.waiting)
    queue.level(4)
    got = np.concatenate([np.column_stack(queue.take(keys[a : a + 9])) for a in range(0, 40, 9)])
    assert (got == want).all()
    queue.level(2)
    assert not np.column_stack(queue.take(keys)).any()


# ---- 12

def brute_licenses(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    base = [(i, label) for phrase, label in licenses.BASE_PHRASES.items() for p in [phrase.split()] for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    notices = set()
    for i in range(len(words)):
        fit = [p for p in licenses.NOTICES if words[i : i + p.count(" ") + 1] == p.split()]
        if fit:
            notices.add(licenses.NOTICES[max(fit, key=lambda p: p.count(" "))])
    places = [i for i, _ in base]
    labels = {label for _, label in base}
    return len(words), len(base), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), notices | labels


TEXTS = [
    "Released under the MIT License.", "under the mit license under THE mit-license; under the mit licenses", "Licensed under the Apache License, Version 2.0.\ncc by nc 4.0", "CC BY-NC-SA 4.0 cc by nc", "under the\nmit  license é under the éMIT license",
    "This work is licensed under the GNU General Public License, version 3.", "gnu general public license", "cc by", "apache license version 2" * 3, "", None, "   ", "under the mit", "license", "字 cc_by_nc 字", "All rights reserved. Under the MIT License",
]


def test_license_phrases(spark, docs, rows, empty):
    table = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, findings string, n_words int")
    table = table.unionByName(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id + 1000 as doc_id", "text", "'' as findings", "0 as n_words"))
    texts = {r.doc_id: r.text for r in table.collect()}
    for r in licenses.license_findings(table).collect():
        base = [f for f in r.findings if f.kind == "base"]
        got = (r.n_words, len(base), min((f.start for f in base), default=None), max((f.start for f in base), default=None), ",".join(sorted({f.label for f in base})), {f.label for f in r.findings})
        assert got == brute_licenses(texts[r.doc_id]), r.doc_id
    assert licenses.license_findings(docs).count() == len(rows) and licenses.license_findings(empty).count() == 0


@pytest.mark.parametrize(("text", "grade", "labels", "rest"), [
    ("MIT", 1.0, {"mit"}, ""), ("mit OR gpl-3.0-only", 1.0, {"mit"}, ""), ("MIT AND GPL-3.0-only", 0.5, {"mit", "gpl-3"}, ""), ("GPL-2.0+ WITH Classpath-exception-2.0", 0.75, {"gpl-2-with-classpath-exception-2.0"}, ""),
    ("MIT AND GPL-3.0 OR CC0-1.0", 1.0, {"cc0"}, ""), ("MIT AND (GPL-3.0 OR CC-BY-4.0)", 0.9, {"mit", "cc-by"}, ""), ("(MIT OR Apache-2.0)", 1.0, {"mit", "apache-2"}, ""), ("MIT and then more", 1.0, {"mit"}, " and then more"),
    ("MIT OR (", 1.0, {"mit"}, " OR ("), ("(MIT OR GPL-3.0 AND", 1.0, {"mit"}, " AND"), ("GPL-3.0 WITH nothing", 0.5, {"gpl-3"}, " WITH nothing"), ("MIT)", 1.0, {"mit"}, ")"), ("MIT GPL-3.0", 1.0, {"mit"}, " GPL-3.0"),
])
def test_license_expressions(text, grade, labels, rest):
    raw = text.encode()
    got = licenses.evaluate(raw, 0, len(raw))
    assert got[0] == grade and set(got[1]) == labels and text[got[2] :] == rest
    assert licenses.evaluate(b"(((", 0, 3) is None and licenses.evaluate(b"or mit", 0, 6) is None


def test_license_tags(spark):
    """Tags are read where they stand, each document by itself, also in very long texts."""
    import time

    long = "license: " + "(" * 200_000 + " mit " + "and mit " * 200_000
    texts = ["# SPDX-License-Identifier: (MIT OR GPL-3.0-only) AND BSD-3-Clause\nword", '"license": "Apache-2.0",', "License: this is none", "SPDX-License-Identifier:", "license: MIT license: GPL-3.0", long, "license:" * 50_000]
    start = time.monotonic()
    got = {r.doc_id: [(f.kind, f.label, f.expression and f.expression[:40], f.grade) for f in r.findings] for r in licenses.license_findings(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [x for x in got[0] if x[0] == "tag"] == [("tag", "bsd-3", "(MIT OR GPL-3.0-only) AND BSD-3-Clause", 1.0), ("tag", "mit", "(MIT OR GPL-3.0-only) AND BSD-3-Clause", 1.0)]
    assert [x[:3] for x in got[1] if x[0] == "tag"] == [("tag", "apache-2", "Apache-2.0")] and got[2] == [] and got[3] == [] and got[6] == []
    assert [x[1] for x in got[4] if x[0] == "tag"] == ["mit", "gpl-3"] and [x[1] for x in got[5]] == ["mit"]
    assert time.monotonic() - start < 30


# ---- 13

def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute_ranked(docs, items, k):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * x + 1))) for t, x in df.items()}
    out = Counter()
    for item, text in items:
        scored = []
        for i, c in counts:
            m = 50 + 50 * sum(c.values()) * n // total
            s = sum(weight[t] * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if t in c)
            if s > 0:
                scored.append((-s, i is not None, i or 0))
        out.update((item, rank, i if there else None, -s) for rank, (s, there, i) in enumerate(sorted(scored)[:k], 1))
    return out


ITEMS = [(1, "kata kasen lotar"), (2, "losel losel LOSEL nothing"), (3, None), (4, ""), (5, "zzzz unknown"), (None, "mivosh"), (7, prose(1, 40)), (7, prose(1, 40)), (8, "this line is found in very many documents")]


@pytest.mark.parametrize("window", [False, True])
def test_ranked_search(spark, rows, empty, monkeypatch, window):
    if window:  # many blocks and windows, few short lists, several blocks of items
        monkeypatch.setattr(search, "WINDOW", 2)
        monkeypatch.setattr(search, "SHORT", 3)
        monkeypatch.setattr(search, "INDEX_BYTES", 3000)
        monkeypatch.setattr(search, "ITEM_BLOCK_BYTES", 300)
    more = [(100 + i, prose(100 + i % 60, 5 + i % 50)) for i in range(300)]  # with ties
    table = spark.createDataFrame([(i, t, "c", 1, 2) for i, t in [*rows, *more]], "doc_id long, text string, item string, score int, rank int")
    items = spark.createDataFrame([(i, t, 3) for i, t in ITEMS], "item_id long, text string, doc_id int")
    got = Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in search.ranked(table, items, 20).collect())
    assert got == brute_ranked([*rows, *more], ITEMS, 20)
    assert search.ranked(empty, items).count() == 0 and search.ranked(table, items.limit(0)).count() == 0


def test_blocks_skip_and_stay_exact():
    """Random posting lists: the pass equals a full sum, with few documents looked at in the long lists of low bounds."""
    rng = np.random.default_rng(7)
    for _ in range(30):
        n = int(rng.integers(1, 3000))
        lists = []
        for size in rng.integers(1, n + 1, int(rng.integers(1, 9))):
            lists.append((np.sort(rng.choice(n, size, replace=False)).astype(np.int32), rng.integers(0, int(rng.integers(2, 2000)), size)))
        total = np.zeros(n, np.int64)
        for p, v in lists:
            total[p] += v
        ids, none = np.arange(n) * 3, np.zeros(n, bool)
        best = search.Best(10)
        search.best_of_block(lists, n, ids, none, best)
        want = [i for i in np.lexsort((ids, -total)) if total[i] > 0][:10]
        assert best.ids.tolist() == [int(ids[i]) for i in want] and best.scores.tolist() == total[want].tolist()


def test_queries_return_the_contract(spark):
    sf = "/root/testdata/sf0.001"
    got = queries.op12_license_scan(spark, sf)
    assert dict(got.dtypes) == {"doc_id": "bigint", "n_words": "bigint", "n_base": "bigint", "first_word": "bigint", "last_word": "bigint", "base_labels": "string", "labels": "string", "score": "double"}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in got.collect():
        want = brute_licenses(texts[r.doc_id])
        assert tuple(r)[:6] == (r.doc_id, *want[:5]) and r.labels == ",".join(sorted(want[5])) and 0 <= r.score <= 1
    turns = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert Counter(tuple(r[c] for c in COLUMNS) for r in queries.op11_prefix_trie(spark, sf).collect()) == brute_trie(turns)
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    assert Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in queries.op13_ranked_search(spark, sf).collect()) == brute_ranked(docs, items, 50)
