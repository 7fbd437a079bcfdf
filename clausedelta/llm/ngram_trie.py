"""Language-model scores from an Elias-Fano n-gram trie of order three.

Level 1 holds the words by the rank of their hash, level 2 the successors of each word, level 3 the
successors of each pair. A level is one Elias-Fano sequence per shard of numbers
`context * width + successor`, counted from the shard's first context; a place in level 2 is the
context in level 3, and a level-3 successor is not a word but its rank among the successors of the
pair's second word, which monotone pointers from level 1 into level 2 give. A lookup is a successor
search within the context. Probabilities and back-off weights are 8-bit codes of per-shard tables. The
levels are files in the shared folder that tasks map into memory, so a task's memory doesn't follow the
model. Once level 1 is there, texts are written as word numbers, a slice of texts a row, and not cut again.
Counts travel as Elias-Fano cells, folded per slice of texts, and meet by shard.

Shards follow the words' cumulative counts, and a frequent word's pairs are split by the second word's,
so no shard holds more than its share of a word that is a third of all tokens.

Model: interpolated absolute discounting, P(w|uv) = max(c(uvw) - D, 0) / c(uv) + D * N(uv) / c(uv) *
P(w|v), N the number of distinct successors; the same for P(w|v); P(w) = (c + 0.5) / (N + 0.5 (V + 1)).
Words are told apart by 64-bit hashes.

Defined results: A-Z is lowered, words end at ASCII white space, each text has one end token. Null and
empty texts are the end alone. Nothing to learn from gives every token probability 1. Repeated rows count as
often as they occur and score alike; a null id is learned from. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausedelta.llm.common import parts_for, shared_file_path, work_path, written
from clausedelta.llm.elias_fano import EliasFano, map_sequence, mapped, save, save_sequence
from clausedelta.llm.segments import slices, texts_of
from clausedelta.llm.shingles import distinct_word_hashes

DISCOUNT = 0.75
SHARD_BYTES, SLICE = 48 << 20, 8 << 20
END = np.uint64(xxhash.xxh64_intdigest(b" end"))  # no word holds a space
NUMBERED = "learned boolean, docs array<bigint>, sizes binary, ids binary"
CELL = "shard int, n bigint, width int, low binary, words binary, counts binary"
DONE = "shard int, n bigint, total bigint, first_ctx bigint, first_n bigint, last_ctx bigint, last_n bigint, most bigint"
SCORES = "doc_id bigint, n_tokens bigint, n_known bigint, base_score double, score double"


def quantised(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """8-bit codes and their table: equal steps, each standing for the mean of its values."""
    if not len(values):
        return np.empty(0, np.uint8), np.zeros(256, np.float32)
    low, high = values.min(), values.max()
    codes = np.minimum((values - low) / max(high - low, 1e-12) * 256, 255).astype(np.uint8)
    often = np.bincount(codes, minlength=256)
    return codes, (np.bincount(codes, weights=values, minlength=256) / np.maximum(often, 1)).astype(np.float32)


@dataclass
class Trie:
    """Where the levels are and how they are cut. Arrays over shards, numbered as in the files."""

    folder: str
    shards: int
    words: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))  # words before each shard of level 1
    tokens: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))  # tokens before it
    first: np.ndarray | None = None  # first context word of each shard of level 2
    last: np.ndarray | None = None
    pairs: np.ndarray | None = None  # pairs before each shard of level 2
    width: int = 1  # more than any word's number of successors

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("_open", "total", "distinct")}

    def at(self, level: str, shard: int) -> str:
        return f"{self.folder}/{level}-{shard}"

    def opened(self, level: str, shard: int, name: str, how: Callable) -> object:
        kept = self.__dict__.setdefault("_open", {})
        key = (level, shard, name)
        if key not in kept:
            kept[key] = how(self.at(level, shard), name)
        return kept[key]

    @cached_property
    def total(self) -> int:
        return int(self.tokens[-1])

    @cached_property
    def distinct(self) -> int:
        return int(self.words[-1])

    def by_shard(self, shard: np.ndarray, ask: Callable[[int, np.ndarray], np.ndarray], kind: type) -> np.ndarray:
        """Answers of each shard for its part of the queries."""
        out = np.zeros(len(shard), dtype=kind)
        order, ends = shard_order(shard, self.shards)
        start = 0
        for s, end in enumerate(ends):
            if end > start:
                out[order[start:end]] = ask(s, order[start:end])
            start = end
        return out

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Rank of each word hash, -1 for an unknown one."""
        shard = hash_shard(hashes, self.shards)

        def ask(s: int, which: np.ndarray) -> np.ndarray:
            step = span(s, self.shards)[0]
            got = self.opened("l1", s, "hash", map_sequence).find(hashes[which] - np.uint64(step))
            return np.where(got < 0, -1, got + self.words[s])

        return self.by_shard(shard, ask, np.int64)

    def before(self, ids: np.ndarray) -> np.ndarray:
        """Training tokens of the words before each id; id V gives all."""
        shard = np.minimum(np.searchsorted(self.words, ids, side="right") - 1, self.shards - 1)
        return self.by_shard(
            shard, lambda s, q: self.opened("l1", s, "before", mapped)[ids[q] - self.words[s]], np.int64
        )

    def counts(self, ids: np.ndarray) -> np.ndarray:
        return self.before(ids + 1) - self.before(ids)

    def pair_shard(self, v_before: np.ndarray, v_count: np.ndarray, w_before: np.ndarray) -> np.ndarray:
        """Shard of a pair: by its first word's share of all tokens, within that by the second word's."""
        low = v_before * self.shards // self.total
        high = np.minimum((v_before + v_count - 1) * self.shards // self.total, self.shards - 1)
        inside = (v_before + v_count * (w_before / self.total)) * (self.shards / self.total)
        return np.clip(inside.astype(np.int64), low, high)

    def first_shard(self, v_before: np.ndarray) -> np.ndarray:
        return v_before * self.shards // self.total

    def find_pairs(self, v: np.ndarray, w: np.ndarray, shard: np.ndarray) -> np.ndarray:
        """Place of each pair in level 2, -1 for one that isn't there."""

        def ask(s: int, q: np.ndarray) -> np.ndarray:
            got = self.opened("l2", s, "key", map_sequence).find((v[q] - self.first[s]) * self.distinct + w[q])
            return np.where(got < 0, -1, got + self.pairs[s])

        return self.by_shard(shard, ask, np.int64)

    def start_of(self, v: np.ndarray, shard: np.ndarray) -> np.ndarray:
        """Place of the first successor of each word, by its pointer in its first shard."""

        def ask(s: int, q: np.ndarray) -> np.ndarray:
            return self.opened("l2", s, "ptr", map_sequence).access(v[q] - self.first[s]).astype(np.int64) + self.pairs[s]

        return self.by_shard(shard, ask, np.int64)

    def coded(self, level: str, name: str, shard: np.ndarray, place: np.ndarray) -> np.ndarray:
        def ask(s: int, q: np.ndarray) -> np.ndarray:
            table = self.opened(level, s, f"{name}.table", mapped)
            return np.asarray(table)[self.opened(level, s, name, mapped)[place[q]]]

        return self.by_shard(shard, ask, np.float64)

    def pair_places(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shard = np.searchsorted(self.pairs, place, side="right") - 1
        return shard, place - self.pairs[shard]

    def find_triples(self, context: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shard and place of each (pair, rank of the successor) in level 3, place -1 for none."""
        shard, local = self.pair_places(context)

        def ask(s: int, q: np.ndarray) -> np.ndarray:
            return self.opened("l3", s, "key", map_sequence).find(local[q] * self.width + rank[q])

        return shard, self.by_shard(shard, ask, np.int64)

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.5) / (self.total + 0.5 * (self.distinct + 1)))


def shard_order(shard: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The order that brings each shard's rows together, and where each ends. Two-byte numbers sort by radix."""
    small = shard.astype(np.uint16 if shards <= 1 << 16 else np.int64)
    return np.argsort(small, kind="stable"), np.cumsum(np.bincount(shard, minlength=shards))


def hash_shard(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def span(shard: int, shards: int) -> tuple[int, int]:
    """First hash of a shard and how many it has."""
    cut = [-(-(s << 32) // shards) << 32 for s in (shard, shard + 1)]
    return cut[0], cut[1] - cut[0]


def folded(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of their counts (ones without)."""
    if not len(keys):
        return keys, np.empty(0, np.int64)
    order = np.argsort(keys, kind="stable") if counts is not None else None
    keys = keys[order] if order is not None else np.sort(keys)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sums = np.diff(np.append(first, len(keys))) if order is None else np.add.reduceat(counts[order], first)
    return keys[first], sums.astype(np.int64)


def cells(
    shard: np.ndarray, keys: np.ndarray, universe: Callable[[int], int], shards: int, often: np.ndarray | None = None
) -> pa.RecordBatch:
    """CELL rows of the counted keys of each shard; often: how often each key is there, once without."""
    order, ends = shard_order(shard, shards)
    rows, start = [], 0
    for s, end in enumerate(ends):
        if end > start:
            part = order[start:end]
            mine, counts = folded(keys[part], None if often is None else often[part])
            seq = EliasFano.build(mine, universe(s))
            rows.append((s, len(mine), seq.width, seq.low.tobytes(), seq.words.tobytes(), counts.astype("<u4").tobytes()))
        start = end
    types = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    cols = list(zip(*rows, strict=True)) or [[] for _ in types]
    names = [x.split()[0] for x in CELL.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(cols, types, strict=True)], names)


def merged(table: pa.Table) -> tuple[int, np.ndarray, np.ndarray]:
    """Shard, keys and counts of the cells of a shard."""
    keys, counts = [], []
    for row in table.to_batches():
        for n, width, low, words, c in zip(*(row[x].to_pylist() for x in ("n", "width", "low", "words", "counts")), strict=True):
            lows = np.frombuffer(low, dtype=np.uint8).reshape(n, width)
            keys.append(EliasFano(n, lows, np.frombuffer(words, dtype="<u8")).decode())
            counts.append(np.frombuffer(c, dtype="<u4"))
    return table["shard"][0].as_py(), *folded(np.concatenate(keys), np.concatenate(counts).astype(np.int64))


def done_row(shard: int, n: int, total: int = 0, ends: tuple = (0, 0, 0, 0), most: int = 0) -> pa.Table:
    names = [x.split()[0] for x in DONE.split(", ")]
    values = [shard, n, total, *ends, most]
    return pa.table([pa.array([int(v)], pa.int32() if i == 0 else pa.int64()) for i, v in enumerate(values)], names=names)


class Tokens:
    """The tokens of some texts, an end after each: number among the distinct ones, and hashes of those."""

    def __init__(self, texts: pa.Array) -> None:
        rows, index, hashes = distinct_word_hashes(texts)
        self.rows = rows + 1
        self.hashes = np.append(hashes, END)
        self.index = np.insert(index, np.cumsum(rows), len(hashes))


class Known:
    """What level 1 has of the distinct words of some texts, then the neighbouring tokens that are both known.

    sizes: tokens of each text; ids: the word number of every token of all texts in turn, -1 for unknown words.
    """

    def __init__(self, trie: Trie, sizes: np.ndarray, ids: np.ndarray) -> None:
        self.trie, self.sizes = trie, sizes
        self.text = np.repeat(np.arange(len(sizes)), sizes)
        self.ids, self.index = np.unique(ids, return_inverse=True)
        known = self.ids >= 0
        self.before, self.counts, self.home = (np.zeros(len(known), dtype=np.int64) for _ in range(3))
        self.before[known] = trie.before(self.ids[known])
        self.counts[known] = trie.before(self.ids[known] + 1) - self.before[known]
        if trie.total:
            self.home = trie.first_shard(self.before)  # shard of the word's first pairs
        seen = known[self.index]
        self.same = self.text[1:] == self.text[:-1]
        self.at = np.flatnonzero(self.same & seen[1:] & seen[:-1]) + 1  # place of the second word
        self.first, self.second = self.index[self.at - 1], self.index[self.at]
        self.shard = np.zeros(0, dtype=np.int64)
        if len(self.at):
            self.shard = trie.pair_shard(self.before[self.first], self.counts[self.first], self.before[self.second])

    def find(self) -> None:
        """Places of the pairs in level 2 and of the tokens' pairs before: context, rank of the token, token."""
        trie = self.trie
        self.place = np.full(len(self.index), -1, dtype=np.int64)
        self.place[self.at] = trie.find_pairs(self.ids[self.first], self.ids[self.second], self.shard)
        self.third = np.flatnonzero(self.same[1:] & (self.place[2:] >= 0) & (self.place[1:-1] >= 0)) + 2
        starts = np.zeros(len(self.ids), dtype=np.int64)
        used = np.flatnonzero(self.ids >= 0)
        starts[used] = trie.start_of(self.ids[used], self.home[used])
        self.context = self.place[self.third - 1]
        self.rank = self.place[self.third] - starts[self.index[self.third - 1]]


def number_type(trie: Trie) -> np.dtype:
    """The largest value stands for unknown words."""
    return np.dtype("<u4" if trie.distinct < (1 << 32) - 1 else "<u8")


def numbered(docs: DataFrame, trie: Trie) -> DataFrame:
    """NUMBERED of docs (doc_id, text, learned): a row per slice of texts and value of learned."""
    kind = number_type(trie)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                learned = part.column("learned").to_numpy(zero_copy_only=False)
                for flag in (True, False):
                    mine = part.filter(pa.array(learned == flag))
                    if mine.num_rows:
                        tokens = Tokens(texts_of(mine, "text"))
                        ids = trie.ids(tokens.hashes)[tokens.index].astype(kind)
                        cols = [[flag], [mine.column("doc_id").to_pylist()], [tokens.rows.astype("<i8").tobytes()], [ids.tobytes()]]
                        types = [pa.bool_(), pa.list_(pa.int64()), pa.binary(), pa.binary()]
                        names = [x.split()[0] for x in NUMBERED.split(", ")]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    return docs.mapInArrow(cut, NUMBERED)


def numbers_of(batch: pa.RecordBatch, trie: Trie) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Per row of NUMBERED the doc_ids, the sizes of their texts, and all word numbers."""
    kind = number_type(trie)
    for i in range(batch.num_rows):
        ids = np.frombuffer(batch["ids"][i].as_buffer(), kind)
        plain = ids.astype(np.int64)
        plain[ids == np.iinfo(kind).max] = -1
        yield batch["docs"][i].values, np.frombuffer(batch["sizes"][i].as_buffer(), "<i8"), plain


def word_cells(docs: DataFrame, keyed: Callable[[Tokens], pa.RecordBatch]) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                yield keyed(Tokens(texts_of(part, "text")))

    return docs.select("text").mapInArrow(cut, CELL)


def level_cells(numbers: DataFrame, trie: Trie, keyed: Callable[[Known], pa.RecordBatch]) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, sizes, ids in numbers_of(batch, trie):
                yield keyed(Known(trie, sizes, ids))

    return numbers.mapInArrow(cut, CELL)


def collected(done: DataFrame, shards: int) -> dict[str, np.ndarray]:
    """One row of numbers per shard reaches the driver; a shard without cells has zeros."""
    rows = {r["shard"]: r for r in done.collect()}
    names = [x.split()[0] for x in DONE.split(", ")][1:]
    return {n: np.array([rows[s][n] if s in rows else 0 for s in range(shards)], dtype=np.int64) for n in names}


def summed(values: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(values)])


def build_words(trie: Trie, docs: DataFrame) -> None:
    shards = trie.shards
    starts = np.array([span(s, shards)[0] for s in range(shards)], dtype=np.uint64)

    def keyed(tokens: Tokens) -> pa.RecordBatch:
        shard = hash_shard(tokens.hashes, shards)
        often = np.bincount(tokens.index, minlength=len(tokens.hashes))
        return cells(shard, tokens.hashes - starts[shard], lambda s: span(s, shards)[1], shards, often)

    def write(table: pa.Table) -> pa.Table:
        shard, keys, counts = merged(table)
        save_sequence(trie.at("l1", shard), "hash", EliasFano.build(keys, span(shard, shards)[1]))
        save(trie.at("l1", shard), counts=counts)
        return done_row(shard, len(keys), counts.sum())

    found = collected(word_cells(docs, keyed).groupBy("shard").applyInArrow(write, DONE), shards)
    trie.words, trie.tokens = summed(found["n"]), summed(found["total"])
    empty = np.empty(0, np.uint64)
    for s in range(shards):  # cumulative counts need the totals of the shards before
        if not found["n"][s]:
            save_sequence(trie.at("l1", s), "hash", EliasFano.build(empty, span(s, shards)[1]))
            save(trie.at("l1", s), counts=np.empty(0, np.int64))
    per_shard(trie, docs, cumulate)


def cumulate(trie: Trie, shard: int) -> None:
    counts = mapped(trie.at("l1", shard), "counts")
    save(trie.at("l1", shard), before=trie.tokens[shard] + summed(counts))


def per_shard(trie: Trie, docs: DataFrame, work: Callable[[Trie, int], None]) -> None:
    """Runs the work for every shard as Spark tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch["id"].to_pylist():
                work(trie, shard)
            yield batch

    docs.sparkSession.range(0, trie.shards, 1, trie.shards).mapInArrow(run, "id bigint").write.format("noop").mode(
        "overwrite"
    ).save()


def context_bounds(trie: Trie) -> tuple[np.ndarray, np.ndarray]:
    """First and last word whose pairs can lie in each shard of level 2."""
    first, last = [], []
    for s in range(trie.shards):
        low, high = -(-s * trie.total // trie.shards), -(-(s + 1) * trie.total // trie.shards) - 1
        first.append(word_at(trie, low))
        last.append(word_at(trie, max(high, low)))
    return np.array(first, dtype=np.int64), np.array(last, dtype=np.int64)


def word_at(trie: Trie, token: int) -> int:
    """The word that the token with that number, words in order, belongs to."""
    token = min(token, trie.total - 1)
    s = int(np.searchsorted(trie.tokens, token, side="right")) - 1
    before = trie.opened("l1", s, "before", mapped)
    return int(np.searchsorted(before, token, side="right")) - 1 + int(trie.words[s])


def build_pairs(trie: Trie, numbers: DataFrame) -> None:
    trie.first, trie.last = context_bounds(trie)
    shards, distinct = trie.shards, trie.distinct

    def universe(s: int) -> int:
        return int(trie.last[s] - trie.first[s] + 1) * distinct

    def keyed(k: Known) -> pa.RecordBatch:
        keys = (k.ids[k.first] - trie.first[k.shard]) * distinct + k.ids[k.second]
        return cells(k.shard, keys.astype(np.uint64), universe, shards)

    def write(table: pa.Table) -> pa.Table:
        shard, keys, counts = merged(table)
        save_sequence(trie.at("l2", shard), "key", EliasFano.build(keys, universe(shard)))
        save(trie.at("l2", shard), **small_counts(counts))
        v = keys // np.uint64(distinct)
        fan = np.diff(np.append(np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]])), len(v)))
        ends = (int(v[0]) + trie.first[shard], fan[0], int(v[-1]) + trie.first[shard], fan[-1])
        return done_row(shard, len(keys), counts.sum(), ends, fan.max())

    found = collected(level_cells(numbers, trie, keyed).groupBy("shard").applyInArrow(write, DONE), shards)
    trie.pairs = summed(found["n"])
    for s in np.flatnonzero(found["n"] == 0):
        save_sequence(trie.at("l2", s), "key", EliasFano.build(np.empty(0, np.uint64), max(universe(s), 1)))
        save(trie.at("l2", s), **small_counts(np.empty(0, np.int64)))
    spread: dict[int, int] = {}  # successors of words whose pairs lie in several shards
    for s in np.flatnonzero(found["n"]):
        edges = {(found["first_ctx"][s], found["first_n"][s]), (found["last_ctx"][s], found["last_n"][s])}
        for word, n in edges:
            spread[int(word)] = spread.get(int(word), 0) + int(n)
    trie.width = max([int(found["most"].max(initial=0)), *spread.values(), 0]) + 1
    per_shard(trie, numbers, lambda t, s: weigh_pairs(t, s, spread))


def small_counts(counts: np.ndarray) -> dict[str, np.ndarray]:
    """A byte each; those of 255 and more apart."""
    big = np.flatnonzero(counts >= 255)
    return {"count": np.minimum(counts, 255).astype(np.uint8), "big": big, "big_count": counts[big]}


def all_counts(folder: str) -> np.ndarray:
    counts = mapped(folder, "count").astype(np.int64)
    counts[mapped(folder, "big")] = mapped(folder, "big_count")
    return counts


def weigh_pairs(trie: Trie, shard: int, spread: dict[int, int]) -> None:
    """Probabilities of a shard's pairs, back-off weights and pointers of its context words."""
    folder = trie.at("l2", shard)
    keys = map_sequence(folder, "key").decode()
    counts = all_counts(folder)
    local = (keys // np.uint64(trie.distinct)).astype(np.int64)
    w = (keys % np.uint64(trie.distinct)).astype(np.int64)
    contexts = np.arange(trie.first[shard], trie.last[shard] + 1)
    fan = np.bincount(local, minlength=len(contexts))
    starts = summed(fan)
    for word, n in spread.items():
        if trie.first[shard] <= word <= trie.last[shard]:
            fan[word - trie.first[shard]] = n
    often = trie.counts(contexts)
    rest = DISCOUNT * np.maximum(fan, 1) / np.maximum(often, 1)
    lower = 10.0 ** trie.unigram(trie.counts(w)) if len(w) else np.empty(0)
    prob = np.maximum(counts - DISCOUNT, 0) / np.maximum(often, 1)[local] + rest[local] * lower
    codes, table = quantised(np.log10(prob))
    back, back_table = quantised(np.log10(rest))
    save(folder, **{"prob": codes, "prob.table": table, "back": back, "back.table": back_table})
    save_sequence(folder, "ptr", EliasFano.build(starts.astype(np.uint64), len(keys) + 1))


def build_triples(trie: Trie, numbers: DataFrame) -> None:
    shards = trie.shards

    def universe(s: int) -> int:
        return max(int(trie.pairs[s + 1] - trie.pairs[s]), 1) * trie.width

    def keyed(k: Known) -> pa.RecordBatch:
        k.find()
        shard, local = trie.pair_places(k.context)
        return cells(shard, (local * trie.width + k.rank).astype(np.uint64), universe, shards)

    def write(table: pa.Table) -> pa.Table:
        shard, keys, counts = merged(table)
        write_triples(trie, shard, keys, counts, universe(shard))
        return done_row(shard, len(keys), counts.sum())

    found = collected(level_cells(numbers, trie, keyed).groupBy("shard").applyInArrow(write, DONE), shards)
    for s in np.flatnonzero(found["n"] == 0):
        write_triples(trie, s, np.empty(0, np.uint64), np.empty(0, np.int64), universe(s))


def write_triples(trie: Trie, shard: int, keys: np.ndarray, counts: np.ndarray, universe: int) -> None:
    """A shard of level 3, and the back-off weights of its contexts, the pairs of the same shard."""
    context = (keys // np.uint64(trie.width)).astype(np.int64)
    rank = (keys % np.uint64(trie.width)).astype(np.int64)
    often = all_counts(trie.at("l2", shard))
    fan = np.bincount(context, minlength=len(often))
    rest = DISCOUNT * np.maximum(fan, 1) / np.maximum(often, 1)
    second = (map_sequence(trie.at("l2", shard), "key").decode() % np.uint64(max(trie.distinct, 1))).astype(np.int64)
    used = np.flatnonzero(fan)
    starts = np.zeros(len(often), dtype=np.int64)
    if len(used):
        starts[used] = trie.start_of(second[used], trie.first_shard(trie.before(second[used])))
    lower = trie.coded("l2", "prob", *trie.pair_places(starts[context] + rank))
    prob = np.maximum(counts - DISCOUNT, 0) / np.maximum(often, 1)[context] + rest[context] * 10.0**lower
    codes, table = quantised(np.log10(prob))
    back, back_table = quantised(np.log10(rest))
    save_sequence(trie.at("l3", shard), "key", EliasFano.build(keys, universe))
    save(trie.at("l3", shard), **{"prob": codes, "prob.table": table, "back": back, "back.table": back_table})


def score_tokens(trie: Trie, sizes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per token: count in training, log10 of the base probability, log10 of the model's."""
    if not trie.total:
        zero = np.zeros(len(ids))
        return zero, zero, zero
    k = Known(trie, sizes, ids)
    k.find()
    base = trie.unigram(k.counts)[k.index]
    back = np.zeros(len(k.ids))
    used = np.flatnonzero(k.ids >= 0)
    back[used] = trie.coded("l2", "back", k.home[used], k.ids[used] - trie.first[k.home[used]])
    score = base.copy()
    score[1:] += back[k.index[:-1]] * k.same
    found = k.place[k.at] >= 0
    seen, shard = k.at[found], k.shard[found]
    local = k.place[seen] - trie.pairs[shard]
    score[seen] = trie.coded("l2", "prob", shard, local)
    inside = seen + 1 < len(k.index)
    wide = np.flatnonzero(inside)[k.same[seen[inside]]]  # pairs that a token follows
    score[seen[wide] + 1] += trie.coded("l3", "back", shard[wide], local[wide])
    shard, place = trie.find_triples(k.context, k.rank)
    hit = place >= 0
    score[k.third[hit]] = trie.coded("l3", "prob", shard[hit], place[hit])
    return k.counts[k.index], base, score


def new_trie(docs: DataFrame, shards: int | None) -> Trie:
    """An empty trie; the number of shards follows the bytes of the texts to learn from."""
    if shards is None:
        total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
        shards = parts_for(total, SHARD_BYTES, 4)
    return Trie(shared_file_path(work_path(docs.sparkSession, "ngram-trie")), shards)


def texts_and_ids(docs: DataFrame, learned: Column) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
        F.coalesce(learned, F.lit(False)).alias("learned"),
    )


def train(docs: DataFrame, shards: int | None = None) -> Trie:
    """Builds the levels from the texts."""
    return learned_and_numbered(texts_and_ids(docs, F.lit(True)), shards)[0]


def learned_and_numbered(docs: DataFrame, shards: int | None) -> tuple[Trie, DataFrame | None]:
    """The levels of the texts marked as learned, and NUMBERED of all; none if there is nothing to learn."""
    trie = new_trie(docs.where("learned"), shards)
    build_words(trie, docs.where("learned"))
    if not trie.total:
        return trie, None
    numbers = written(numbered(docs, trie), "word-numbers", compression="zstd")
    build_pairs(trie, numbers.where("learned"))
    build_triples(trie, numbers.where("learned"))
    return trie, numbers


def judged(numbers: DataFrame, trie: Trie) -> DataFrame:
    """SCORES of NUMBERED texts."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for docs, sizes, ids in numbers_of(batch, trie):
                counts, base, points = score_tokens(trie, sizes, ids)
                n, text = len(sizes), np.repeat(np.arange(len(sizes)), sizes)
                sums = [np.bincount(text, weights=x, minlength=n) for x in ((counts > 0), base, points)]
                yield pa.RecordBatch.from_arrays(
                    [docs, pa.array(sizes), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2])],
                    [x.split()[0] for x in SCORES.split(", ")],
                )

    return numbers.mapInArrow(judge, SCORES)


def score(docs: DataFrame, trie: Trie) -> DataFrame:
    """SCORES of every text."""
    return judged(numbered(texts_and_ids(docs, F.lit(False)), trie), trie)


def score_held_out(docs: DataFrame, held_out: Column) -> DataFrame:
    """Learns from the documents that are not held out and scores all."""
    rows = texts_and_ids(docs, ~held_out)
    trie, numbers = learned_and_numbered(rows, None)
    found = score(docs, trie) if numbers is None else judged(numbers, trie)
    return found.withColumn("train_tokens", F.lit(trie.total).cast("long"))
