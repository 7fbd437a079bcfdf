"""Similarity and word changes of two texts, as one Arrow-batched function."""

from __future__ import annotations

import difflib
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEMA = "struct<similarity:double, deltas:array<struct<op:string,text:string>>>"
_TOKEN = re.compile(r"\S+|\n")


def similarity(old: str, new: str, autojunk: bool = True) -> float:
    return round(difflib.SequenceMatcher(None, old, new, autojunk).ratio(), 3)


def word_deltas(old: str, new: str) -> list[dict]:
    a, b = _TOKEN.findall(old), _TOKEN.findall(new)
    found = []
    for tag, i, j, k, m in difflib.SequenceMatcher(None, a, b).get_opcodes():
        if tag == "equal":
            runs = [("equal", a[i:j])]
        else:
            runs = [("delete", a[i:j]), ("insert", b[k:m])]
        for op, words in runs:
            text = " ".join(words)
            if text.strip():
                found.append({"op": op, "text": text})
    return found


def compare_texts(old: Column, new: Column, autojunk: bool = True) -> Column:
    """STRUCT<similarity, deltas>; null texts give 0.0 and no deltas."""

    @F.pandas_udf(SCHEMA)
    def compare(olds: pd.Series, news: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(
            {
                "similarity": [0.0 if o is None else similarity(o, n, autojunk) for o, n in zip(olds, news)],
                "deltas": [[] if o is None else word_deltas(o, n) for o, n in zip(olds, news)],
            }
        )

    return compare(old, new)
