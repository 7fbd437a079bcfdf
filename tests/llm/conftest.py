from __future__ import annotations

import random

import pytest

EXTRA = "score double, kept boolean, digest string, node string, shard string, ids string, entities string, comp string"


def words(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null, empty, blank, short, very long, equal and near texts, ties, repeated rows, a null id, clashing columns."""
    base = words(1, 120)
    near = base.replace(base.split()[60], "changed", 1)
    long = words(2, 60_000)
    rows = [
        (1, None, "en"), (2, "", "en"), (3, " \t\n\x0b ", None), (4, "one", "en"), (5, long, "en"), (6, base, "en"),
        (7, base.upper(), "en"), (8, near, "en"), (8, near, "en"), (9, "Ünï cödé 日本語 text", "de"), (10, "12 34 !!", "en"),
        (None, "a text without an id", "en"), (11, "one two three four five", None), (12, "one two three four five", "fr"),
        (13, words(3, 80) + "\n" + words(9, 70) + "\n" + words(4, 30), "en"),
        (14, words(5, 40) + "\n" + words(9, 70), "en"),
        (15, words(6, 30) + " " + words(9, 70) + " " + words(7, 30), "en"),
    ]
    full = [(*r, "src", len(r[1] or ""), 1.0, True, "d", "n", "s", "i", "e", "c") for r in rows]
    df = spark.createDataFrame(full, f"doc_id bigint, text string, lang string, source string, n_chars bigint, {EXTRA}")
    return df.coalesce(2)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
