"""Rows that every operator must bear: null and empty texts, null ids, repeated rows, long texts, columns whose names clash."""

from __future__ import annotations

import random

import pytest

WORDS = [a + b + c for a in ("ka", "lo", "mi", "ne", "ru") for b in ("ta", "se", "vo", "pi") for c in ("n", "r", "l", "sh")]


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(("", "", "", ".", ",")) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    base = prose(1, 120)
    near = base.split()
    near[60] = "zzz"
    line = "this line is found in very many documents"
    out = [
        (1, base), (2, base), (3, " ".join(near)), (4, None), (5, ""), (6, "short"), (7, "short"), (8, prose(2, 5000)), (9, f"{prose(3, 40)}\n{line}\n{prose(4, 30)}"), (10, f"{line}\nother words here"),
        (11, f"  {line.upper()}\t\n{line}"), (None, prose(5, 30)), (12, prose(6, 50)), (12, prose(6, 50)), (13, "   \n\t "), (14, "é ü ß 字 字 字 字"),
    ]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    """With further columns, some under names that operators use inside."""
    return spark.createDataFrame([(i, t, "en", "s", 1, "x", 7) for i, t in rows], "doc_id long, text string, lang string, source string, n long, key string, rep int")


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
