"""Ranked lexical search: MaxScore over segments of documents, its bounds tightened by pairs of terms.

Index. Each slice of about SEGMENT_BYTES of text is a segment; its postings are one row per term (documents
and occurrences as packed numbers) and one row without a term (ids and lengths).

Lists. For the terms of a log of queries, postings become impacts (a term's exact part of a document's
score) with their maximum. For pairs of terms that the log asks for together, the intersection is stored
with the joint impacts and the most that the pair can add to any document: no document may hold both
maxima, so this bound is at most the sum of the two.

Search. In a segment, a query's terms are matched into disjoint pairs, those first that lower the sum of
bounds most; what stays single keeps its own maximum. Units go by falling bound. Once the bounds still to
come cannot lift an unseen document to the threshold, the rest is only looked up for the documents that may
still reach it, and these are pruned unit by unit. The threshold is the k-th best sum so far, and a floor:
the k-th best score in SEED_SEGMENTS segments, which are searched first. Both are lower bounds of the final
one, so results are exact; seeds and pairs change the work alone.

Pairs are those of neighbours among a query's PAIR_TERMS heaviest terms, where bounds are high; all other
terms keep their own bounds. Queries go in blocks of about BLOCK_QUERIES; a block meets a segment in one
group, which holds the segment's lists of the block's terms.

Scores are 64-bit integers: with tf occurrences in a document of n terms, N documents that have terms, L
terms in all, df documents with the term, w = floor(1000 * ln((2N+2) / (2df+1))), m = 50 + (50 * n * N) div L,
a term adds w * ((10^9 * tf) div (1000 * tf + 20 * m)).

Defined results: a term is a longest run of ASCII letters, digits and any non-ASCII characters, A-Z lowered;
null and empty texts have none and are never found. A query without terms, or whose terms no document has,
finds nothing; rows that repeat a query's id are one query. Equal scores go by smaller doc_id. Documents
without an id are left out; rows that repeat an id are documents of their own, counted and ranked each.
Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausedelta.llm.common import parts_for, written
from clausedelta.llm.segments import slices, texts_of, words_by_row

SEGMENT_BYTES = 8 << 20
PAIR_TERMS = 16
BLOCK_QUERIES = 256
SEED_SEGMENTS = 8
POSTINGS = "segment bigint, term string, n_docs bigint, n_terms bigint, docs binary, counts binary"
LISTS = "segment bigint, term string, other string, top bigint, docs binary, impacts binary"
FOUND = "item_id bigint, doc_id bigint, score bigint"

# Every byte of UTF-8 that is no part of a term becomes a space.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or chr(b).isalnum() else 32 for b in range(256))


def split_terms(texts: pa.Array) -> pa.Array:
    """The terms of each text, with empty strings between them."""
    import pyarrow.compute as pc

    _, offsets, data = texts.buffers()
    raw = (data.to_pybytes() if data is not None else b"").translate(TERM_BYTES)
    return pc.ascii_split_whitespace(pa.LargeStringArray.from_buffers(len(texts), offsets, pa.py_buffer(raw)))


def packed(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Runs of 32-bit numbers as binary values."""
    offsets = (np.append(starts, len(values)) * 4).astype(np.int32)
    return pa.BinaryArray.from_buffers(
        pa.binary(), len(starts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.astype("<u4").tobytes())]
    )


def segment_rows(segment: int, ids: np.ndarray, texts: pa.Array) -> Iterator[pa.RecordBatch]:
    """POSTINGS of one segment."""
    names = [x.split()[0] for x in POSTINGS.split(", ")]
    sizes, index, distinct = words_by_row(texts, split_terms)
    head = [[segment], [None], [int((sizes > 0).sum())], [int(sizes.sum())], [ids.astype("<i8").tobytes()], [sizes.astype("<i8").tobytes()]]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(head, kinds, strict=True)], names)
    if not len(index):
        return
    key = np.sort(index * len(ids) + np.repeat(np.arange(len(ids)), sizes))
    first = np.flatnonzero(np.diff(key, prepend=-1))
    counts = np.diff(np.append(first, len(key)))
    term, doc = key[first] // len(ids), key[first] % len(ids)
    starts = np.flatnonzero(np.diff(term, prepend=-1))
    n_docs = np.diff(np.append(starts, len(term)))
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(len(starts), segment)), distinct.cast(pa.string()).take(pa.array(term[starts])),
            pa.array(n_docs), pa.array(np.add.reduceat(counts, starts)), packed(doc, starts), packed(counts, starts),
        ],
        names,
    )


def build_index(docs: DataFrame, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """POSTINGS of all documents, written: every term of every whole text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held, size = [], 0

        def flush():
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            yield from segment_rows(number, rows.column("doc_id").to_numpy(), texts_of(rows, "text"))

        for batch in batches:
            for part in slices(batch, "text", segment_bytes):
                if size and size + part.nbytes > segment_bytes:
                    yield from flush()
                    number, held, size = number + 1, [], 0
                held.append(part)
                size += part.nbytes
        if held:
            yield from flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written(rows.where("doc_id is not null").mapInArrow(cut, POSTINGS), "postings", compression="zstd")


def query_terms(items: DataFrame) -> DataFrame:
    """item_id, term: the distinct terms of every query, written."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sizes, index, distinct = words_by_row(texts_of(part, "text"), split_terms)
                owner = np.repeat(np.arange(len(sizes)), sizes)
                yield pa.RecordBatch.from_arrays(
                    [part.column("item_id").take(pa.array(owner)), distinct.cast(pa.string()).take(pa.array(index))], ["item_id", "term"]
                )

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return written(rows.where("item_id is not null").mapInArrow(cut, "item_id bigint, term string").distinct(), "query-terms")


def weight(n: int, df: Column) -> Column:
    return F.floor(F.lit(1000.0) * F.log((F.lit(2.0) * n + 2.0) / (2.0 * df + 1.0))).cast("long")


def neighbours(weighted: DataFrame, most: int = PAIR_TERMS) -> DataFrame:
    """term, others: the pairs (term < other) that stand side by side among a query's heaviest terms."""
    heavy = Window.partitionBy("item_id").orderBy(F.desc("w"), "term")
    ranked = weighted.withColumn("_rank", F.row_number().over(heavy)).where(F.col("_rank") <= most)
    pairs = ranked.withColumn("_next", F.lead("term").over(Window.partitionBy("item_id").orderBy("_rank"))).where("_next is not null")
    return (
        pairs.select(F.least("term", "_next").alias("term"), F.greatest("term", "_next").alias("other"))
        .groupBy("term").agg(F.collect_set("other").alias("others"))
    )


def segment_lists(n_all: int, terms_all: int):
    """LISTS of one segment, from its postings with weights and wanted pairs."""

    def make(table: pa.Table) -> pa.Table:
        terms = table["term"].to_pylist()
        head = terms.index(None)
        size = np.frombuffer(table["counts"][head].as_buffer(), dtype="<i8")
        m20 = 20 * (50 + 50 * size * n_all // max(terms_all, 1))
        lists, rows = {}, []
        for t, w, docs, counts in zip(terms, table["w"].to_pylist(), table["docs"], table["counts"], strict=True):
            if t is not None:
                at, tf = (np.frombuffer(x.as_buffer(), dtype="<u4").astype(np.int64) for x in (docs, counts))
                lists[t] = at, w * (1_000_000_000 * tf // (1000 * tf + m20[at]))
                rows.append((t, None, int(lists[t][1].max()), *lists[t]))
        for t, others in zip(terms, table["others"].to_pylist(), strict=True):
            for o in others or ():
                if o in lists:
                    both, i, j = np.intersect1d(lists[t][0], lists[o][0], assume_unique=True, return_indices=True)
                    joint = lists[t][1][i] + lists[o][1][j]
                    rows.append((t, o, max(int(lists[t][1].max()), int(lists[o][1].max()), int(joint.max(initial=0))), both, joint))
        rows.append((None, None, 0, np.frombuffer(table["docs"][head].as_buffer(), dtype="<i8"), np.empty(0, np.int64)))
        segment = table["segment"][0].as_py()
        out = [(segment, *r[:3], r[3].astype("<i8" if r[0] is None else "<u4").tobytes(), r[4].astype("<i8").tobytes()) for r in rows]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.binary()]
        names = [x.split()[0] for x in LISTS.split(", ")]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return make


def build_lists(postings: DataFrame, asked: DataFrame) -> DataFrame:
    """LISTS for the terms and pairs that the queries `asked` (item_id, term) use, written."""
    totals = postings.where("term is null").agg(F.sum("n_docs"), F.sum("n_terms")).first()
    n_all, terms_all = totals[0] or 0, totals[1] or 0
    # Spark broadcasts the queries' distinct terms while they are small, and joins by key beyond.
    used = written(postings.join(asked.select("term").distinct(), "term"), "used-postings", compression="zstd")
    df = written(used.groupBy("term").agg(F.sum("n_docs").alias("df")).withColumn("w", weight(n_all, F.col("df"))), "weights")
    lexicon = df.join(neighbours(asked.join(df, "term")), "term", "left").select("term", "w", "others")
    heads = postings.where("term is null").select("segment", "term", F.lit(0).cast("long").alias("w"), "docs", "counts")
    heads = heads.withColumn("others", F.lit(None).cast("array<string>"))
    rows = used.join(lexicon, "term").select("segment", "term", "w", "docs", "counts", "others").unionByName(heads)
    return written(rows.groupBy("segment").applyInArrow(segment_lists(n_all, terms_all), LISTS), "impact-lists")


def combined_bounds(terms: list[str], tops: dict[str, int], pairs: dict[tuple[str, str], int]) -> list[tuple[int, tuple[str, ...]]]:
    """Disjoint pairs and single terms with the most each can add, by falling bound: largest savings are paired first."""
    here = set(terms)
    gains = sorted(
        ((tops[a] + tops[b] - top, a, b) for (a, b), top in pairs.items() if a in here and b in here), key=lambda x: (-x[0], x[1:])
    )
    units = []
    for gain, a, b in gains:
        if gain > 0 and a in here and b in here:
            here -= {a, b}
            units.append((tops[a] + tops[b] - gain, (a, b)))
    return sorted([*units, *((tops[t], (t,)) for t in here)], key=lambda x: (-x[0], x[1]))


class Segment:
    """The lists of one segment in memory. `added` counts the postings read, for tests."""

    def __init__(self, ids: np.ndarray) -> None:
        self.ids, self.lists, self.tops = ids, {}, {}
        self.joint, self.pair_tops, self.pairs_of, self.added = {}, {}, {}, 0

    def put(self, term: str, other: str | None, top: int, docs: np.ndarray, impacts: np.ndarray) -> None:
        if other is None:
            self.lists[term], self.tops[term] = (docs, impacts), top
        else:
            self.joint[term, other], self.pair_tops[term, other] = impacts, top
            self.pairs_of.setdefault(term, []).append(other)

    def search(self, terms: list[str], k: int, floor: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best documents, those below the floor left out."""
        terms = [t for t in terms if t in self.lists]
        known = set(terms)
        pairs = {(t, o): self.pair_tops[t, o] for t in terms for o in self.pairs_of.get(t, ()) if o in known}
        units = combined_bounds(terms, self.tops, pairs)
        threshold = max([floor, 1, *(kth(self.joint[p], k) for p in pairs)])
        left = sum(bound for bound, _ in units)
        score, seen = np.zeros(len(self.ids), dtype=np.int64), None
        for bound, unit in units:
            if seen is None and left < threshold:  # a document not met so far cannot get there
                seen = np.flatnonzero(score + left >= threshold)
            for t in unit:
                docs, impacts = self.lists[t]
                if seen is None:
                    score[docs] += impacts
                    self.added += len(docs)
                else:
                    at = np.minimum(np.searchsorted(docs, seen), len(docs) - 1)
                    hit = docs[at] == seen
                    score[seen[hit]] += impacts[at[hit]]
                    self.added += int(hit.sum())
            left -= bound
            threshold = max(threshold, kth(score if seen is None else score[seen], k))
            if seen is not None:
                seen = seen[score[seen] + left >= threshold]
        found = np.flatnonzero(score >= threshold) if seen is None else seen
        found = found[score[found] >= threshold]
        best = found[np.lexsort((self.ids[found], -score[found]))][:k]
        return self.ids[best], score[best]


def kth(values: np.ndarray, k: int) -> int:
    """The k-th largest value; 0 where there are fewer."""
    return int(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else 0


def search_block(k: int):
    """FOUND of one segment and block of queries."""

    def find(table: pa.Table) -> pa.Table:
        terms = table["term"].to_pylist()
        head = terms.index(None)
        segment = Segment(np.frombuffer(table["docs"][head].as_buffer(), dtype="<i8"))
        for t, o, top, docs, impacts in zip(
            terms, table["other"].to_pylist(), table["top"].to_pylist(), table["docs"], table["impacts"], strict=True
        ):
            if t is not None:
                segment.put(t, o, top, np.frombuffer(docs.as_buffer(), "<u4"), np.frombuffer(impacts.as_buffer(), "<i8"))
        items, ids, scores = [], [], []
        for q in table["queries"][head].as_py():
            docs, score = segment.search(q["terms"], k, q["floor"])
            items.append(np.full(len(docs), q["item_id"]))
            ids.append(docs)
            scores.append(score)
        flat = [np.concatenate([np.empty(0, np.int64), *x]) for x in (items, ids, scores)]
        return pa.table([pa.array(x, pa.int64()) for x in flat], names=["item_id", "doc_id", "score"])

    return find


def search_segments(lists: DataFrame, asked: DataFrame, floors: DataFrame | None, k: int) -> DataFrame:
    """FOUND over the segments in `lists`: of each at most k documents a query, all that can be among the k best."""
    queries = asked.groupBy("item_id").agg(F.collect_list("term").alias("terms"))
    queries = queries.withColumn("floor", F.lit(0).cast("long")) if floors is None else queries.join(floors, "item_id", "left").fillna(0, "floor")
    blocks = parts_for(queries.count(), BLOCK_QUERIES)
    block = F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int")
    wanted = asked.select(block.alias("block"), "term").distinct()
    in_block = lists.where("term is not null").join(wanted, "term").withColumn(
        "queries", F.lit(None).cast("array<struct<item_id:bigint,terms:array<string>,floor:bigint>>")
    )
    packs = queries.groupBy(block.alias("block")).agg(F.collect_list(F.struct("item_id", "terms", "floor")).alias("queries"))
    heads = lists.where("term is null").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(packs, "block")
    return in_block.unionByName(heads).groupBy("segment", "block").applyInArrow(search_block(k), FOUND)


def best_of(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def search(lists: DataFrame, asked: DataFrame, k: int, seeds: int = SEED_SEGMENTS) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of every query."""
    chosen = written(
        lists.where("term is null").select("segment").orderBy(F.xxhash64("segment"), "segment").limit(seeds), "seed-segments"
    )
    first = written(best_of(search_segments(lists.join(chosen, "segment", "left_semi"), asked, None, k), k), "seed-results")
    floors = first.where(F.col("rank") == k).select("item_id", F.col("score").alias("floor"))
    rest = search_segments(lists.join(chosen, "segment", "left_anti"), asked, floors, k)
    return best_of(first.drop("rank").unionByName(rest), k)


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """The whole way: an index of all documents, lists for the items' terms and pairs, and the search."""
    asked = query_terms(items)
    return search(build_lists(build_index(docs), asked), asked, k)
