"""Token counts, the conversation trie and ranked search, against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from clausedelta.llm import prefix_trie, ranked_search, token_counts
from clausedelta.llm.queries import op11_prefix_trie, op12_ranked_search, op13_token_counts

SF = "/root/testdata/sf0.001"
PIECES, BYTES, WORDS = (public_tokenizers.path(p) for p in ("piece_bpe_32k.model", "byte_bpe_50k.json", "word_bpe_49k.json"))
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


# --- token counts -----------------------------------------------------------


def test_token_counts_query(spark):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op13_token_counts(spark, SF).collect()
    want = {d: (len(t.encode()), len(model.encode(t)), len(model.encode(t)) > 4096) for d, t in texts.items()}
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in rows} == want and len(rows) == len(texts)


@pytest.mark.parametrize("path", [PIECES, BYTES, WORDS])
def test_cut_texts_count_as_whole_ones(path):
    """Parts of a few characters: every kind of boundary is cut at or kept, and counts stay those of the whole."""
    counter = token_counts.worker_counter(path, 1, True)
    if path.endswith(".model"):
        whole = sentencepiece.SentencePieceProcessor(model_file=path).encode
    else:
        plain = Tokenizer.from_file(path)
        whole = lambda ts: [e.ids for e in plain.encode_batch(ts, add_special_tokens=False)]
    rng = random.Random(1)
    odd = ["a", "Ab", "it's", " ", "  ", "\n", "▁", "é", "日本", "😀", "<s>", "</s>", "<|endoftext|>", "12", "...", "x" * 90, "\x00", "Σ"]
    texts = ["", " ", *("".join(rng.choice(odd) + rng.choice(["", " ", " "]) for _ in range(300)) for _ in range(40))]
    for text, ids in zip(texts, whole(texts), strict=True):
        parts = token_counts.parts_of(text, counter.boundary, 8)
        assert sum(map(len, counter.encode(parts))) == len(ids)
    assert max(len(token_counts.parts_of(t, counter.boundary, 8)) for t in texts) > 10
    assert counter(texts).tolist() == [len(x) for x in whole(texts)]


def test_token_counts_of_odd_documents(odd_docs, no_docs, monkeypatch):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = Counter((r.doc_id, len((r.text or "").encode()), len(model.encode(r.text or ""))) for r in odd_docs.collect())
    assert Counter(map(tuple, token_counts.count_tokens(odd_docs, PIECES).collect())) == want
    assert token_counts.count_tokens(no_docs, PIECES).isEmpty()


# --- conversation trie ------------------------------------------------------


def brute_trie(turns):
    """turns: (conv_id, turn, role, text), without ties."""
    own = defaultdict(list)
    for c, _, role, text in sorted(turns, key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own[c].append((role or "", text or ""))
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        built[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    nodes = defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            nodes[built[c][:d]].append(c)
    children = defaultdict(list)
    for path in nodes:
        if path:
            children[path[:-1]].append(path)
    below = {}
    for path in sorted(nodes, key=len, reverse=True):
        saved = (len(nodes[path]) - 1) * (len(path[-1][1]) if path else 0) + sum(below[c][1] for c in children[path])
        below[path] = (sum(below[c][0] for c in children[path]) or 1, saved)
    return Counter(
        (
            min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), len(children[p]), *below[p],
            hashlib.sha256(",".join(str(c) for c in m if len(built[c]) == len(p)).encode()).hexdigest(),
        )
        for p, m in nodes.items()
    )


def trie_of(df, shard_turns):
    built = prefix_trie.with_shared_heads(prefix_trie.turn_ids(df))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return Counter(tuple(r) for r in prefix_trie.trie_nodes(built, shard_turns).select(*columns).collect())


def test_prefix_trie_query(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    assert Counter(tuple(r) for r in op11_prefix_trie(spark, SF).collect()) == brute_trie([tuple(r) for r in rows])


@pytest.mark.parametrize("shard_turns", [1 << 20, 40])
def test_prefix_trie_of_odd_conversations(spark, shard_turns):
    """Copies that go over many shards, long and turnless conversations, nulls, absent first conversations."""
    rng = random.Random(3)
    same = [(t, "user" if t % 2 else None, f"turn {t}") for t in range(6)]
    long = [(t, "user", f"long {t}") for t in range(130)]
    rows = [(c, t, r, x) for c in range(150, 330) for t, r, x in same]
    rows += [(c, t, r, x) for c in (400, 401, 402) for t, r, x in (long if c != 402 else long[:70])]
    rows += [(c, t, "user", rng.choice("ab😀") * rng.randint(0, 2)) for c in range(500, 620) for t in range(rng.randint(1, 9))]
    rows += [(c, None, None, None) for c in range(700, 720)] + [(805, 0, "user", "alone"), (-7, 3, "a", "b"), (-100, 1, "a", "c")]
    rows += [(900, 0, "ab", "c"), (901, 0, "a", "bc"), (902, 2, "a", "x"), (902, None, "a", "bc")]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id bigint, turn bigint, role string, text string, depth string")
    spark.conf.set("spark.sql.shuffle.partitions", "1" if shard_turns > 40 else "4")
    try:
        assert trie_of(df.repartition(3), shard_turns) == brute_trie(rows)
        assert trie_of(df.union(df.selectExpr("null", "turn", "role", "text", "depth").limit(5)), shard_turns) == brute_trie(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_prefix_trie_of_nothing(spark):
    df = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert not trie_of(df, 10)


def test_equal_turn_numbers_and_repeated_rows(spark):
    df = spark.createDataFrame([(7, 0, "u", "a"), (7, 0, "u", "a"), (8, 0, "u", "a"), (8, 0, "u", "a")], "conv_id bigint, turn bigint, role string, text string")
    built = prefix_trie.turn_ids(df)
    rows = prefix_trie.trie_nodes(built).orderBy("depth").collect()
    assert [(r.conv_id, r.depth, r.n_convs, r.n_children, r.saved_tokens) for r in rows] == [(7, 0, 2, 1, 2), (7, 1, 2, 1, 2), (7, 2, 2, 0, 1)]


# --- ranked search ----------------------------------------------------------


def terms_of(text):
    return TERM.findall((text or "").translate(LOWER))


def brute_search(docs, items, k):
    """docs: (doc_id, text); items: (item_id, text)."""
    counted = [(d, Counter(terms_of(t))) for d, t in docs if d is not None]
    counted = [(d, c, sum(c.values())) for d, c in counted if c]
    n, total = len(counted), sum(x[2] for x in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(terms_of(t))
    out = []
    for i, terms in asked.items():
        found = []
        for d, c, size in counted:
            m = 100 - 50 + (50 * size * n) // total
            s = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if t in c
            )
            if s > 0:
                found.append((-s, d))
        out += [(i, r, d, -s) for r, (s, d) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


def test_ranked_search_query(spark):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet").collect() for t in ("documents", "benchmark"))
    want = brute_search([(r.doc_id, r.text) for r in docs], [(r.item_id, r.text) for r in items], 50)
    assert sorted(map(tuple, op12_ranked_search(spark, SF).collect())) == want


def test_ranked_search_over_many_segments(spark, odd_docs):
    """Segments of a few documents, ties over their borders, floors from two seeds, a few best ones."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)]
    pick = lambda n: " ".join(vocabulary[min(int(rng.expovariate(0.08)), 59)] for _ in range(n))
    rows = [(100 + i, pick(rng.randint(1, 40))) for i in range(600)]
    rows += [(1000 + i, "tied text w3 W9 ünï") for i in range(30)] + [(2000, "rareone, raretwo"), (2000, "rareone"), (None, "w1 w2")]
    rows += [(r.doc_id, r.text) for r in odd_docs.collect()]
    items = [(i, pick(rng.randint(1, 30))) for i in range(12)] + [
        (20, "w3 w9 ÜNÏ ünï"), (21, None), (22, ""), (23, "absent"), (24, "raretwo rareone"), (25, "RareOne"), (25, "w1"), (26, "日本語 text w0"),
    ]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id bigint, text string, score double").repartition(4)
    queries = spark.createDataFrame([(*r, 1) for r in items], "item_id bigint, text string, rank int")
    asked = ranked_search.query_terms(queries)
    lists = ranked_search.build_lists(ranked_search.build_index(docs, segment_bytes=2000), asked)
    assert lists.where("other is not null").count() > 100 and lists.select("segment").distinct().count() > 12
    for k in (3, 10, 2000):
        assert sorted(map(tuple, ranked_search.search(lists, asked, k, seeds=2).collect())) == brute_search(rows, items, k)
    none = docs.where("false")
    assert ranked_search.rank_documents(none, queries).isEmpty() and ranked_search.rank_documents(docs, queries.where("false")).isEmpty()


def test_pairs_tighten_bounds_and_skip_postings():
    """Terms whose maxima never meet: with the pair's bound fewer postings are read, for the same result."""
    rng = np.random.default_rng(0)
    n, read, found = 4000, [], []
    for with_pair in (False, True):
        rng = np.random.default_rng(0)
        s = ranked_search.Segment(np.arange(n))
        peak = np.sort(rng.choice(n // 2, 60, replace=False))
        s.put("a", None, 1000, peak, np.full(60, 1000))
        s.put("b", None, 900, np.arange(n // 2, n), np.full(n // 2, 900))
        s.put("c", None, 150, np.arange(0, n), rng.integers(1, 150, n))
        if with_pair:
            s.put("a", "b", 1000, np.empty(0, int), np.empty(0, int))
        ids, scores = s.search(["a", "b", "c"], 10)
        found.append((ids.tolist(), scores.tolist()))
        read.append(s.added)
    assert found[0] == found[1] and read[1] <= read[0]
    units = ranked_search.combined_bounds(["a", "b", "c"], {"a": 10, "b": 9, "c": 5}, {("a", "b"): 11, ("b", "c"): 14})
    assert units == [(11, ("a", "b")), (5, ("c",))]
