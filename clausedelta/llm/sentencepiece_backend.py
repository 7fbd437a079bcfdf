"""SentencePiece models run by the tokenizers library.

The model protobuf is read here; normaliser, metaspace marker, piece scores and byte fallback are
rebuilt as a tokenizers pipeline. Unigram models keep their scores; BPE models get the merges that
their scores imply. Batches are encoded in threads, one per core of the task. Parity with the
sentencepiece library is verified, row by row where asked for.

Defined results: null and empty texts have no ids and decode to an empty text; no control piece is
ever recognised in a text. A unigram model with byte fallback takes a byte piece's name, such as <0x41>,
spelled out in a text for that piece, unlike sentencepiece; parity is false for such a row. Extra columns are not read; repeated rows give equal rows.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausedelta.llm.segments import SegmentEncoder, slices, texts_of

NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # piece types of the format
UNIGRAM, BPE = 1, 2  # model types of the format
MARK = "▁"
ENCODED = (
    "doc_id bigint, n_ids bigint, ids_crc32 bigint, decoded_crc32 bigint, round_trip boolean, parity boolean, ids binary"
)


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    trim_spaces: bool = True
    escape: bool = True


def varint(raw: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = raw[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protobuf message."""
    at = 0
    while at < len(raw):
        tag, at = varint(raw, at)
        wire = tag & 7
        if wire == 0:
            value, at = varint(raw, at)
        else:
            size, at = varint(raw, at) if wire == 2 else ({1: 8, 5: 4}[wire], at)
            value, at = raw[at : at + size], at + size
        yield tag >> 3, value


def parse_model(raw: bytes) -> Model:
    model = Model()
    for number, value in fields(raw):
        if number == 1:
            piece = dict(fields(value))
            score = float(np.frombuffer(piece[2], "<f4")[0]) if 2 in piece else 0.0
            model.pieces.append((piece.get(1, b"").decode(), score, piece.get(3, NORMAL)))
        elif number == 2:
            spec = dict(fields(value))
            model.kind, model.byte_fallback = spec.get(3, UNIGRAM), bool(spec.get(35, 0))
        elif number == 3:
            spec = dict(fields(value))
            model.charsmap = spec.get(2, b"")
            model.dummy_prefix, model.trim_spaces = bool(spec.get(3, 1)), bool(spec.get(4, 1))
            model.escape = bool(spec.get(5, 1))
    return model


def implied_merges(model: Model) -> list[tuple[str, str]]:
    """Every split of a piece into two pieces, best score first."""
    known = {p for p, _, kind in model.pieces if kind in (NORMAL, USER)}
    at = {p: i for i, (p, _, _) in enumerate(model.pieces)}
    order = sorted((p for p in known if len(p) > 1), key=lambda p: (-model.pieces[at[p]][1], at[p]))
    return [(p[:i], p[i:]) for p in order for i in range(1, len(p)) if p[:i] in known and p[i:] in known]


def splits_at_marks(model: Model) -> bool:
    """Whether no piece goes on into the mark of a next word, so that words can be encoded alone."""
    return not any(MARK in p.lstrip(MARK) for p, _, kind in model.pieces if kind in (NORMAL, USER))


def build_tokenizer(model: Model):
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    vocab = [(p, score) for p, score, _ in model.pieces]
    unknown = next((i for i, x in enumerate(model.pieces) if x[2] == UNKNOWN), 0)
    if model.kind == UNIGRAM:
        lowest = min((s for _, s, kind in model.pieces if kind == NORMAL), default=0.0)
        # Control and unused pieces get a space, which no escaped text holds; byte pieces need their names.
        closed = [
            (p, s) if kind in (NORMAL, USER) else (p, lowest) if kind == BYTE else (" " + p, lowest)
            for p, s, kind in model.pieces
        ]
        core = models.Unigram(closed, unk_id=unknown, byte_fallback=model.byte_fallback)
    elif model.kind == BPE:
        core = models.BPE(
            {p: i for i, (p, _) in enumerate(vocab)}, implied_merges(model), unk_token=vocab[unknown][0],
            fuse_unk=True, byte_fallback=model.byte_fallback,
        )
    else:
        raise ValueError(f"model type {model.kind} is neither unigram nor BPE")
    tokenizer = Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.trim_spaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.escape:
        steps.append(normalizers.Replace(" ", MARK))
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(MARK))
    tokenizer.normalizer = normalizers.Sequence(steps)
    if splits_at_marks(model):
        tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*"), "isolated")
    tail = [decoders.Strip(" ", 1, 0)] if model.dummy_prefix else []
    tokenizer.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *tail])
    return tokenizer


def reference_processor(raw: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=raw)


class Codec:
    """Texts to ids and back. Words are encoded once per batch where the model lets them be alone."""

    def __init__(self, raw: bytes, threads: int = 1, parity: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ["RAYON_NUM_THREADS"] = str(threads)
        self.model = parse_model(raw)
        self.tokenizer, self.threads, self.differ = build_tokenizer(self.model), threads, 0
        self.other = reference_processor(raw) if parity else None
        self.words = SegmentEncoder(lambda words: [np.array(x, dtype="<u4").tobytes() for x in self.encode_batch(words)])
        plain = not self.model.charsmap and not self.model.trim_spaces and self.model.escape
        self.by_word = plain and self.model.dummy_prefix and splits_at_marks(self.model)

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        """Whatever is encoded is compared with sentencepiece, where parity is asked for."""
        rows = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        if self.other is not None:
            self.differ += sum(a != b for a, b in zip(rows, self.other.encode(texts, num_threads=self.threads), strict=True))
        return rows

    def parity_of(self, texts: list[str], rows: list[list[int]]) -> list[bool]:
        """Row by row once any word or text has differed in this task; until then all have been equal."""
        if not self.differ:
            return [True] * len(rows)
        return [a == b for a, b in zip(rows, self.other.encode(texts, num_threads=self.threads), strict=True)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts in turn, and how many each has. Texts with empty words are encoded whole."""
        if not self.by_word:
            return self.joined(self.encode_batch(texts.to_pylist()))
        odd = np.asarray(pc.match_substring_regex(texts, f"^ | $|  |{MARK}"))
        ids, counts = self.words(pc.if_else(pa.array(odd), "", texts), lambda x: pc.split_pattern(x, " "))
        if not odd.any():
            return ids, counts
        rows = np.split(ids, np.cumsum(counts)[:-1])
        whole = iter(self.encode_batch(texts.filter(pa.array(odd)).to_pylist()))
        return self.joined([np.array(next(whole), dtype=np.uint32) if o else r for o, r in zip(odd, rows, strict=True)])

    @staticmethod
    def joined(rows: list) -> tuple[np.ndarray, np.ndarray]:
        counts = np.fromiter(map(len, rows), dtype=np.int64, count=len(rows))
        flat = [np.asarray(r, dtype=np.uint32) for r in rows]
        return np.concatenate([np.empty(0, np.uint32), *flat]), counts

    def decode_batch(self, rows: list[list[int]]) -> list[str]:
        return self.tokenizer.decode_batch(rows, skip_special_tokens=False)


@cache
def worker_codec(model_path: str, threads: int, parity: bool) -> Codec:
    """One per Python worker, so that what a task has encoded serves the next one."""
    with open(model_path, "rb") as file:
        return Codec(file.read(), threads, parity)


def code_documents(docs: DataFrame, model_path: str, parity: bool = True, with_ids: bool = True) -> DataFrame:
    """ENCODED: ids and their checksum, that of the decoded text, whether it is the text again, and
    whether sentencepiece gives the same ids (null if not asked for).

    Every distinct word that a task encodes is also encoded by sentencepiece; a model whose pieces may
    join words, and texts with runs of spaces, are compared whole.
    """

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        codec = worker_codec(model_path, int(TaskContext.get().cpus()), parity)
        for batch in batches:
            for part in slices(batch, "text", 8 << 20):
                texts = texts_of(part, "text")
                ids, counts = codec.encode(texts)
                rows = [x.astype("<u4") for x in np.split(ids, np.cumsum(counts)[:-1])]
                plain, lists = texts.to_pylist(), [r.tolist() for r in rows]
                decoded = codec.decode_batch(lists)
                same = codec.parity_of(plain, lists) if parity else [None] * len(rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").cast(pa.int64()),
                        pa.array(counts),
                        pa.array([zlib.crc32(r) for r in rows], type=pa.int64()),
                        pa.array([zlib.crc32(x.encode()) for x in decoded], type=pa.int64()),
                        pa.array([a == b for a, b in zip(plain, decoded, strict=True)]),
                        pa.array(same, type=pa.bool_()),
                        pa.array([r.tobytes() if with_ids else None for r in rows], type=pa.binary()),
                    ],
                    ["doc_id", "n_ids", "ids_crc32", "decoded_crc32", "round_trip", "parity", "ids"],
                )

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(code, ENCODED)
