"""Token counts of whole texts: batches of about equal bytes are encoded in Arrow functions, lengths come back.

A text longer than PART_BYTES is cut at safe boundaries first, so that one very long text is many calls of
usual size and no call's ids take much memory. Parts go into calls of about CALL_BYTES, whatever texts they
are of; the lengths are added up per text. Ids never leave the call.

A boundary is safe where the parts' counts add up to the whole's. For SentencePiece models that is a single
space between two other characters, if no piece goes on past a space, nothing is normalised, and the space
comes back as the next part's dummy prefix; texts of other models stay whole. For tokenizers files it is the
place before a single space between two ASCII letters; `split_json=False` keeps those whole, too, for
tokenizers that join words. A stretch without a safe boundary stays whole, however long.

Defined results: null counts as empty, 0 bytes and 0 tokens. No begin, end or other special token is added;
their strings in a text are read as the library reads them by default. Every row gets a row, repeated or
without an id. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausedelta.llm.segments import slices, texts_of
from clausedelta.llm.sentencepiece_backend import parse_model, splits_at_marks

PART_BYTES, CALL_BYTES, SLICE = 64 << 10, 1 << 20, 16 << 20
COUNTED = "doc_id bigint, n_bytes bigint, n_tokens bigint"

# A space that the next part's dummy prefix stands for; and a space that begins the next part.
DROPPED_SPACE = re.compile("(?<=[^ ▁]) (?=[^ ▁])")
KEPT_SPACE = re.compile("(?<=[A-Za-z])(?= [A-Za-z])")


def parts_of(text: str, boundary: re.Pattern | None, most: int = PART_BYTES) -> list[str]:
    """The text cut at the first safe boundary after every `most` characters."""
    if boundary is None or len(text) <= most:
        return [text]
    parts, start = [], 0
    while found := boundary.search(text, start + most):
        parts.append(text[start : found.start()])
        start = found.end()
    return [*parts, text[start:]]


class Counter:
    """Counts tokens of many texts, in calls of about equal bytes."""

    def __init__(self, encode: Callable[[list[str]], list], boundary: re.Pattern | None) -> None:
        self.encode, self.boundary = encode, boundary

    def __call__(self, texts: list[str]) -> np.ndarray:
        parts = [parts_of(t, self.boundary) for t in texts]
        owner = np.repeat(np.arange(len(texts)), [len(p) for p in parts])
        flat = [p for each in parts for p in each]
        upto = np.cumsum([len(p) for p in flat], dtype=np.int64)
        calls = np.flatnonzero(np.diff(upto // CALL_BYTES, prepend=0)).tolist()
        counts = np.zeros(len(flat), dtype=np.int64)
        for a, b in zip([0, *calls], [*calls, len(flat)], strict=True):
            if a < b:
                counts[a:b] = [len(ids) for ids in self.encode(flat[a:b])]
        return np.bincount(owner, weights=counts, minlength=len(texts)).astype(np.int64)


@cache
def worker_counter(path: str, threads: int, split_json: bool) -> Counter:
    """One per Python worker; the model is read once."""
    if path.endswith(".model"):
        import sentencepiece

        with open(path, "rb") as file:
            raw = file.read()
        model = parse_model(raw)
        plain = not model.charsmap and not model.trim_spaces and model.escape and model.dummy_prefix
        processor = sentencepiece.SentencePieceProcessor(model_proto=raw)
        safe = DROPPED_SPACE if plain and splits_at_marks(model) else None
        return Counter(lambda texts: processor.encode(texts, num_threads=threads), safe)
    os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
    os.environ["RAYON_NUM_THREADS"] = str(threads)
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return Counter(
        lambda texts: tokenizer.encode_batch_fast(texts, add_special_tokens=False), KEPT_SPACE if split_json else None
    )


def count_tokens(docs: DataFrame, path: str, split_json: bool = True) -> DataFrame:
    """COUNTED of every row; `path` is a .model of sentencepiece or a .json of tokenizers, on every executor."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        counter = worker_counter(path, int(TaskContext.get().cpus()), split_json)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                texts = texts_of(part, "text")
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").cast(pa.int64()), pc.binary_length(texts).cast(pa.int64()),
                        pa.array(counter(texts.to_pylist())),
                    ],
                    ["doc_id", "n_bytes", "n_tokens"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(count, COUNTED)
