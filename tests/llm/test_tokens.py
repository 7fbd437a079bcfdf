"""Packing, the SentencePiece backend and the n-gram trie."""

from __future__ import annotations

import math
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from clausedelta.llm import hilbert_packing, ngram_trie
from clausedelta.llm import sentencepiece_backend as sp
from clausedelta.llm.elias_fano import EliasFano
from clausedelta.llm.language_profiles import held_out
from clausedelta.llm.queries import op8_hilbert_packing

WORDS, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "a  b", " x ", "x▁y", "日本語 😀 ok", "\n\na\tb", "<s> hi </s>", "it's <|endoftext|> I'Ve", "a\x1fb", "é İ K ΑΣ", "nul\x00l", "x" * 3000]


def check_packing(texts, rows, length=4096):
    model = Tokenizer.from_file(WORDS)
    ids = {d: [*model.encode(t or "", add_special_tokens=False).ids, 2] for d, t in texts}
    pieces, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert (r.doc_tokens, r.ids_crc32) == (len(ids[r.doc_id]), zlib.crc32(np.array(part, "<u4").tobytes()))
        pieces[r.doc_id].append((r.start, r.length))
        seqs[r.sequence_id].append((r.offset, r.length))
    padding = 0
    for parts in (*pieces.values(), *seqs.values()):
        at = 0
        for start, n in sorted(parts):
            assert start == at and n > 0
            at += n
    for parts in seqs.values():
        n = sum(p[1] for p in parts)
        assert n <= length
        padding += 0 if n & (n - 1) == 0 else length - n
    assert all(sum(n for _, n in pieces[d]) == len(x) for d, x in ids.items()) and padding == 0


def test_packing(spark, odd_docs, no_docs):
    docs = odd_docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    texts = [(r.doc_id, r.text) for r in docs.collect()] + [(1000 + i, t) for i, t in enumerate(ODD)]
    both = docs.select("doc_id", "text").union(spark.createDataFrame(texts[docs.count() :], "doc_id bigint, text string"))
    check_packing(texts, hilbert_packing.pack_documents(both, WORDS, with_ids=False).collect())
    assert hilbert_packing.pack_documents(odd_docs, WORDS).count() >= odd_docs.count()
    assert hilbert_packing.pack_documents(no_docs, WORDS).isEmpty()


def test_packing_query(spark):
    sf = "/root/testdata/sf0.001"
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check_packing(texts, op8_hilbert_packing(spark, sf).collect())


def test_hilbert_curve():
    side = np.stack(np.meshgrid(range(8), range(8), range(8)), -1).reshape(-1, 3)
    keys = hilbert_packing.hilbert_keys(side, 3)
    assert sorted(keys) == list(range(512))
    walk = side[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()  # neighbours on the curve are neighbours


def field(number, wire, payload):
    head = bytes([number << 3 | wire]) if number < 16 else bytes([(number << 3 | wire) & 127 | 128, number >> 4])
    return head + (bytes([len(payload)]) + payload if wire == 2 else payload)


def unigram_model():
    """A small unigram model with byte fallback, written by hand."""
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{i:02X}>", 0.0, 6) for i in range(256)]
    pieces += [(p, -1.0 - i / 7, 1) for i, p in enumerate(["▁", "a", "b", "c", "▁a", "ab", "▁ab", "abc", "bc", "é", "▁é", "ca"])]
    raw = b"".join(field(1, 2, field(1, 2, p.encode()) + field(2, 5, struct.pack("<f", s)) + field(3, 0, bytes([k]))) for p, s, k in pieces)
    raw += field(2, 2, field(3, 0, b"\x01") + field(35, 0, b"\x01"))
    return raw + field(3, 2, field(1, 2, b"identity") + field(3, 0, b"\x01") + field(4, 0, b"\x00") + field(5, 0, b"\x01"))


@pytest.mark.parametrize("raw", [open(PIECES, "rb").read(), unigram_model()], ids=["bpe", "unigram"])
def test_sentencepiece_parity(raw):
    codec, other = sp.Codec(raw, 2), sentencepiece.SentencePieceProcessor(model_proto=raw)
    texts = [*ODD, "abcab cab", "é ab  abc", "zab"]
    ids, counts = codec.encode(pa.array(texts, pa.large_string()))
    rows = [r.tolist() for r in np.split(ids, np.cumsum(counts)[:-1])]
    assert rows == other.encode(texts)
    assert codec.decode_batch(rows) == other.decode(rows)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab c é▁\n<s>日\x00x", max_size=30))
def test_sentencepiece_round_trip(text):
    codec = test_sentencepiece_round_trip.__dict__.setdefault("codec", sp.Codec(open(PIECES, "rb").read()))
    ids, _ = codec.encode(pa.array([text], pa.large_string()))
    assert codec.decode_batch([ids.tolist()]) == [text.replace("▁", " ")]


def test_sentencepiece_documents(odd_docs, no_docs):
    rows = sp.code_documents(odd_docs, PIECES).collect()
    text = {r.doc_id: r.text for r in odd_docs.collect()}
    assert len(rows) == odd_docs.count() and all(r.parity and r.round_trip for r in rows)
    for r in rows:
        assert len(r.ids) == 4 * r.n_ids and zlib.crc32(r.ids) == r.ids_crc32
        assert r.decoded_crc32 == zlib.crc32((text[r.doc_id] or "").encode())
    assert sp.code_documents(no_docs, PIECES).isEmpty()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 1 << 40), max_size=200), st.integers(0, 5))
def test_elias_fano(values, shift):
    values = np.sort(np.array(values, dtype=np.uint64)) >> np.uint64(8 * shift)
    seq = EliasFano.build(values, (1 << 41) >> (8 * shift))
    assert (seq.decode() == values).all() and (seq.access(np.arange(len(values))) == values).all()
    asked = np.unique(np.concatenate([values, values + np.uint64(1), np.array([0, 5], np.uint64)]))
    for x, i in zip(asked, seq.find(asked), strict=True):
        assert (i >= 0) == (x in values) and (i < 0 or values[i] == x)


def tokens_of(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


class Plain:
    """The model by dictionaries."""

    def __init__(self, texts):
        self.c = [Counter(tuple(w[i : i + n]) for w in map(tokens_of, texts) for i in range(len(w) - n + 1)) for n in (1, 2, 3)]
        self.fan = [Counter(g[:-1] for g in c) for c in self.c]
        self.total, self.distinct = sum(self.c[0].values()), len(self.c[0])

    def p(self, gram):
        if len(gram) == 1:
            return (self.c[0][gram] + 0.5) / (self.total + 0.5 * (self.distinct + 1))
        n, d = len(gram) - 1, ngram_trie.DISCOUNT
        often = self.c[n - 1][gram[:-1]]
        if not often or not self.fan[n][gram[:-1]]:
            return self.p(gram[1:])
        return max(self.c[n][gram] - d, 0) / often + d * self.fan[n][gram[:-1]] / often * self.p(gram[1:])


def check_scores(texts, learned, rows):
    plain = Plain(learned)
    for text, r in zip(texts, rows, strict=True):
        w = tokens_of(text)
        assert (r.n_tokens, r.n_known) == (len(w), sum(plain.c[0][(x,)] > 0 for x in w))
        assert math.isclose(r.base_score, sum(math.log10(plain.p((x,))) for x in w), rel_tol=1e-9)
        exact = sum(math.log10(plain.p(tuple(w[max(0, i - 2) : i + 1]))) for i in range(len(w)))
        assert abs(r.score - exact) <= 0.03 * len(w)  # 8-bit codes


def test_trie_of_odd_documents(odd_docs, no_docs):
    kept = held_out(F.col("doc_id"), 5)
    texts = {r.doc_id: (r.text, r.h) for r in odd_docs.withColumn("h", kept).collect()}
    learned = [r.text for r in odd_docs.where(~kept).collect()]
    rows = [r for r in ngram_trie.score_held_out(odd_docs, kept).collect()]
    assert all(r.train_tokens == Plain(learned).total for r in rows)
    check_scores([texts[r.doc_id][0] for r in rows], learned, rows)
    assert ngram_trie.score_held_out(no_docs, kept).isEmpty()
    nothing = ngram_trie.score(odd_docs, ngram_trie.train(no_docs)).collect()
    assert {(r.base_score, r.score, r.n_known) for r in nothing} == {(0.0, 0.0, 0)}


def test_trie_with_a_word_of_a_third_of_all_tokens(spark):
    texts = [f"the w{i % 50} the v{i % 31} of x{i} the" for i in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    trie = ngram_trie.train(docs, shards=7)
    assert (np.diff(trie.pairs) > 0).sum() >= 6
    rows = sorted(ngram_trie.score(docs, trie).collect(), key=lambda r: r.doc_id)
    check_scores(texts, texts, rows)


def test_trie_sums_to_one(spark):
    docs = spark.createDataFrame([(0, "a b a c"), (1, "b a b c a")], "doc_id bigint, text string")
    trie = ngram_trie.train(docs, shards=2)
    starts = ["a", "b", "a b", "b a"]
    asked = [f"{s} {w}".strip() for s in starts for w in ("a", "b", "c", "never")]
    plain = Plain(["a b a c", "b a b c a"])
    for s in starts:
        gram = tuple(s.split())
        assert math.isclose(sum(plain.p((*gram, w)) for w in ("a", "b", "c", None, "never")), 1, rel_tol=1e-9)
    rows = ngram_trie.score(spark.createDataFrame(list(enumerate(asked)), "doc_id bigint, text string"), trie)
    assert rows.count() == len(asked)
