"""Digest index, Jaccard groups, paragraph banding, components and shards against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from brute import groups_of, lowered, near_pairs, shingles
from hypothesis import given, settings
from hypothesis import strategies as st

from clausedelta.llm import balanced_shards, components, digest_index, jaccard_groups, paragraph_minhash
from clausedelta.llm.queries import op5_grouped_prefix_join

def test_digest_index(spark, odd_docs, no_docs):
    index = digest_index.DigestIndex(spark, "digests_of_test", 4)
    rows = index.add(odd_docs, "b1").collect()
    texts = odd_docs.select("doc_id", "text").collect()
    by = defaultdict(list)
    for r in texts:
        by[hashlib.sha256(lowered(r.text).encode()).digest()].append(r.doc_id)
    assert len(rows) == len(texts)
    for r in rows:
        ids = by[bytes(r.digest)]
        keep = max((i for i in ids if i is not None), default=None)
        assert (r.keep_id, r.group_size, r.kept) == (keep, len(ids), r.doc_id == keep)
    # A later batch: the index decides, in its buckets and without a shuffle of it.
    later = spark.createDataFrame([(99, texts[5].text), (100, "new text"), (101, "NEW text")], "doc_id bigint, text string")
    got = {r.doc_id: (r.keep_id, r.kept) for r in index.add(later, "b2").collect()}
    assert got == {99: (7, False), 100: (101, False), 101: (101, True)}
    assert index.rows().groupBy("digest").count().where("count > 1").isEmpty()
    assert index.add(no_docs, "b3").isEmpty()
    before = sorted(map(tuple, index.rows().collect()), key=str)
    index.compact()
    assert sorted(map(tuple, index.rows().collect()), key=str) == before
    again = digest_index.DigestIndex(spark, "digests_of_test", 4)
    assert {r.doc_id: r.kept for r in again.add(later, "b4").collect()} == {99: False, 100: False, 101: True}
    plan = spark.table("digests_of_test").groupBy("digest").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    index.drop()
    assert not spark.catalog.tableExists("digests_of_test")


def test_corpus_through_a_filled_index(spark, odd_docs, no_docs, monkeypatch):
    """Batches by descending id find their copies in the index: the same as one pass over all."""
    texts = odd_docs.select("doc_id", "text")
    more = spark.createDataFrame([(100 + i, f"text {i % 7}") for i in range(60)], "doc_id bigint, text string")
    both = texts.union(more)
    fresh, plain = [], digest_index.DigestIndex._append
    monkeypatch.setattr(digest_index.DigestIndex, "_append", lambda self, rows: (fresh.append(rows.count()), plain(self, rows)))
    rows = digest_index.deduplicated(both).collect()
    by = defaultdict(list)
    for r in both.collect():
        by[hashlib.sha256(lowered(r.text).encode()).digest()].append(r.doc_id)
    assert len(rows) == both.count() and len(fresh) == 5 and sum(fresh) == len(by)
    for r in rows:
        ids = by[bytes(r.digest)]
        keep = max((i for i in ids if i is not None), default=None)
        assert (r.keep_id, r.group_size, r.kept) == (keep, len(ids), r.doc_id == keep)
    assert digest_index.deduplicated(no_docs).isEmpty()
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("digests_")]


def test_jaccard_of_odd_documents(odd_docs, no_docs):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_groups.jaccard_components(odd_docs).collect()}
    sets = {r.doc_id: shingles(r.text) for r in odd_docs.collect() if r.doc_id is not None}
    want = groups_of(near_pairs(sets), sets)
    assert got == {d: (len(s), want[d]) for d, s in sets.items()}
    assert jaccard_groups.jaccard_components(no_docs).isEmpty()


def test_jaccard_of_chains_and_hot_groups(spark):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(90)]
    common = " ".join(f"c{i}" for i in range(30))
    texts = []
    for i in range(300):  # one large group of near copies, each changed elsewhere
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(90)] = f"x{rng.randrange(40)}"
        texts.append(" ".join(w))
    texts += [texts[0]] * 100
    texts += [common + " " + " ".join(f"u{i}v{j}" for j in range(rng.randint(3, 9))) for i in range(60)]
    for step in range(25):  # a chain whose ends are far apart
        texts.append(" ".join(f"k{i}" for i in range(step * 2, step * 2 + 60)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_groups.jaccard_components(docs).collect()}
    sets = {i: shingles(t) for i, t in enumerate(texts)}
    want = groups_of(near_pairs(sets), sets)
    assert got == {d: (len(s), want[d]) for d, s in sets.items()}


def test_a_group_of_near_copies_is_linear_work(spark, monkeypatch):
    """Copies of one text, each changed elsewhere, most pairs too far apart: few pairs reach the join's end."""
    rng, base = random.Random(5), [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(600):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(60)] = f"x{rng.randrange(400)}"
        texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    asked, plain = [], jaccard_groups.verified
    monkeypatch.setattr(jaccard_groups, "verified", lambda pairs, sets: asked.append(pairs.count()) or plain(pairs, sets))
    got = {r.doc_id: r.component_id for r in jaccard_groups.jaccard_components(docs).collect()}
    sets = {i: shingles(t) for i, t in enumerate(texts)}
    true = near_pairs(sets)
    assert got == groups_of(true, sets)
    assert sum(asked) < 3 * len(texts) < len(true) and asked[-1] < len(texts) / 4


def test_jaccard_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    sets = {r.doc_id: shingles(r.text) for r in rows}
    want = groups_of(near_pairs(sets), sets)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op5_grouped_prefix_join(spark, sf).collect()}
    assert got == {d: (len(s), want[d]) for d, s in sets.items()}


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 140)] + [(139, 200), (7, 7), (300, 300)]
    random.Random(1).shuffle(edges)
    df = spark.createDataFrame([*edges, (None, 5)], "a bigint, b bigint")
    got = {r.node: r.comp for r in components.components(df).collect()}
    assert got == groups_of(edges, {n for e in edges for n in e})
    assert components.components(df.where("false")).isEmpty()


def test_paragraphs(odd_docs, no_docs):
    rows = paragraph_minhash.repeated_passages(odd_docs).collect()
    text = {r.doc_id: r.text for r in odd_docs.collect()}
    by = defaultdict(list)
    for r in rows:
        by[r.cluster_id].append(r)
        assert text[r.doc_id][r.start : r.stop].split() and (r.start == 0 or text[r.doc_id][r.start - 1].isspace())
    for rs in by.values():
        assert len({r.doc_id for r in rs}) > 1 and sum(not r.removed for r in rs) >= 1
        first = text[rs[0].doc_id][rs[0].start : rs[0].stop]
        for r in rs:
            a, b = shingles(first), shingles(text[r.doc_id][r.start : r.stop])
            assert len(a & b) * 100 >= 80 * len(a | b)
    assert {6, 7, 8, 13, 14, 15} == {r.doc_id for r in rows}  # the passage inside a line too; no clean document
    assert {r.doc_id for r in rows if r.kind == "paragraph"} == {6, 7, 8, 13, 14}
    assert paragraph_minhash.repeated_passages(no_docs).isEmpty()


def brute_paragraphs(rows, min_words, line_ends):
    """Clusters of paragraphs in two documents or more as sets of (doc_id, start, stop), each with the one that stays."""
    cut = re.compile(r"(?:[ \t\r\x0b\x0c]*\n){%d}" % line_ends)
    places = []
    for d, text in rows:
        at = 0
        while at <= len(text or ""):
            end = cut.search(text, at) if text else None
            part = text[at : end.start() if end else len(text)] if text else ""
            words = list(re.finditer(r"[^\x20\x09-\x0D]+", part))
            if len(words) >= min_words:
                places.append((d, at + words[0].start(), at + words[-1].end(), shingles(part)))
            if not end:
                break
            at = end.end()
    comps = groups_of(near_pairs({i: p[3] for i, p in enumerate(places)}), range(len(places)))
    clusters = defaultdict(set)
    for i, c in comps.items():
        clusters[c].add(places[i][:3])
    return {(frozenset(c), min(c)) for c in clusters.values() if len({d for d, _, _ in c}) > 1}


@pytest.mark.parametrize("min_words, line_ends", [(20, 1), (1, 1), (1, 2), (20, 2)])
def test_paragraph_clusters_are_those_of_brute_force(spark, min_words, line_ends):
    rng = random.Random(4)

    def prose(n):
        return [f"{rng.choice('abcdefgh')}{rng.randrange(10**6)}" for _ in range(n)]

    pool = [prose(n) for n in (1, 3, 4, 5, 9, 19, 20, 21, 40, 40, 60, 120)]
    pool += [[*p[:20], "other", *p[21:]] for p in pool if len(p) >= 60]
    pool += [[*p[:30], "more", *p[30:]] for p in pool if len(p) >= 120]
    rows = []
    for d in range(60):
        text = ""
        for _ in range(rng.randint(0, 4)):
            words = rng.choice(pool) if rng.random() < 0.6 else prose(rng.randint(1, 50))
            wrap = rng.choice([7, 11, 500])
            lines = [" ".join(words[i : i + wrap]) for i in range(0, len(words), wrap)]
            text += "\n".join(x.upper() if rng.random() < 0.1 else x for x in lines) + rng.choice(["\n\n", "\n \t\n", "\r\n\r\n\n", "\n"])
        rows.append((d, text))
    rows += [(60, None), (61, ""), (5, " ".join(pool[8]) + "\n\n" + " ".join(prose(30))), (7, rows[7][1])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = defaultdict(set)
    for r in paragraph_minhash.repeated_passages(df, min_words, line_ends).where("kind = 'paragraph'").collect():
        got[r.cluster_id].add((r.doc_id, r.start, r.stop, r.removed))
    found = {(frozenset(x[:3] for x in c), next(x[:3] for x in c if not x[3])) for c in got.values()}
    want = brute_paragraphs(rows, min_words, line_ends)
    assert found == want and len(want) >= 3


def test_passages_of_fifty_words(spark):
    """Exactly the words of the runs of 50 words that an earlier document has, wherever lines end."""
    rng = random.Random(11)

    def prose(n):
        return [f"{rng.choice('abcdefgh')}{rng.randrange(10**6)}" for _ in range(n)]

    def lined(words, least, most):
        out = ""
        for i, w in enumerate(words):
            out += w + ("\n" if rng.randint(least, most) == least else " ")
        return out

    base = prose(400)
    docs = [base, prose(60) + base[100:151] + prose(60), prose(33) + base[120:175] + prose(9), base[:70] + prose(20) + base[60:130]]
    docs += [prose(30) + base[i : i + 50] + prose(30) for i in range(0, 340, 17)]
    docs += [["again"] * 90 + prose(20), prose(9) + ["again"] * 70, prose(300), base[3:52] + prose(80)]
    docs += [prose(20) + docs[1][20:125], docs[2][:80] + docs[1][70:160]]
    texts = [lined(w, 1, 12 if i % 2 else 200) for i, w in enumerate(docs)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)
    first, want, got, clusters = {}, set(), set(), defaultdict(list)
    for d, w in enumerate(docs):
        for i in range(len(w) - 49):
            if first.setdefault(tuple(w[i : i + 50]), d) != d:
                want |= {(d, j) for j in range(i, i + 50)}
    for r in paragraph_minhash.repeated_passages(df).where("kind = 'passage'").collect():
        cut = texts[r.doc_id][r.start : r.stop]
        before = len(texts[r.doc_id][: r.start].split())
        clusters[r.cluster_id].append((r.doc_id, r.removed, cut.split()))
        got |= {(r.doc_id, before + j) for j in range(len(cut.split()))} if r.removed else set()
    assert got == want
    for rows in clusters.values():
        (kept,) = [(d, w) for d, removed, w in rows if not removed]
        assert all(w == kept[1] and d > kept[0] for d, removed, w in rows if removed)


def test_band_recall():
    recall = 1 - (1 - 0.8**paragraph_minhash.ROWS) ** paragraph_minhash.BANDS
    assert recall > 0.99


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 4), st.integers(0, 30))), st.lists(st.integers(0, 20), min_size=5, max_size=5))
def test_quotas(wishes, slack):
    held = [20] * 5
    wanted = {(a, b): min(n, 5) for a, b, n in wishes if a != b}
    room = [h + s for h, s in zip(held, slack)]
    granted = balanced_shards.quotas(wanted, held, room)
    now = list(held)
    for (a, b), n in granted.items():
        assert 0 <= n <= wanted[a, b]
        now[a] -= n
        now[b] += n
    assert all(n <= r for n, r in zip(now, room))


def test_shards(spark, odd_docs, no_docs):
    rows = balanced_shards.shard_documents(odd_docs, 4).collect()
    assert len(rows) == odd_docs.count() and balanced_shards.shard_documents(no_docs, 4).isEmpty()
    texts = [f"text {i}" for i in range(800)] + [f"pair {i // 2}" for i in range(160)] + ["hot"] * 480
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    rows = balanced_shards.shard_documents(docs, 24).collect()
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.size == len(texts[r.doc_id].encode()) + 8
    sizes = [len(slots[s]) for s in range(24)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in slots.values())
    shard = {r.doc_id: r.shard for r in rows}
    together = sum(shard[i] == shard[i + 1] for i in range(800, 960, 2))
    assert together >= 70  # of 80 pairs; 1 in 24 by chance
    hot = Counter(shard[i] for i in range(960, 1440))
    assert max(hot.values()) >= 50  # the hot group gathers in one shard, up to the quota of 60 less what else is there


def test_shards_join_every_pair(spark):
    texts = [f"text {i}" for i in range(1600)] + [f"pair {i // 2}" for i in range(1600)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    shard = {r.doc_id: r.shard for r in balanced_shards.shard_documents(docs, 8).collect()}
    assert [i for i in range(1600, 3200, 2) if shard[i] != shard[i + 1]] == []


def test_shards_take_few_rounds_and_keep_groups_whole_beside_a_hot_one(spark, monkeypatch):
    """A hot group that fits no shard takes no room of groups that fit; pairs and stars need no chance to meet."""
    texts = [f"text {i}" for i in range(1000)] + [f"star {i // 5}" for i in range(1000)] + ["hot"] * 1000
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    tried, real = [], balanced_shards.quotas
    monkeypatch.setattr(balanced_shards, "quotas", lambda *a: tried.append(a) or real(*a))
    rows = balanced_shards.shard_documents(docs, 8).collect()
    shards = defaultdict(set)
    for r in rows:
        shards[texts[r.doc_id]].add(r.shard)
    assert [t for t, s in shards.items() if t.startswith("star") and len(s) > 1] == []
    assert sorted(Counter(r.shard for r in rows).values()) == [375] * 8
    assert len(tried) <= 15


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_shards_of_any_graph(spark, links):
    """Chains, cycles, repeated links, self-links and links to nodes that are not there end, within the caps."""
    nodes = spark.createDataFrame([(i,) for i in range(28)], "node bigint")
    edges = spark.createDataFrame(links, "src bigint, dst bigint")
    rows = balanced_shards.assign(nodes, edges, 4, 3).collect()
    assert sorted(r.node for r in rows) == list(range(28))
    assert Counter(r.shard for r in rows) == {s: 7 for s in range(4)}
