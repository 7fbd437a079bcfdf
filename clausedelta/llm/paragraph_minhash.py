"""Substring dedup: paragraphs that repeat across documents, by MinHash banding.

A paragraph ends at `line_ends` line feeds in a row, white space between them not counting: at 1 every line is
a paragraph, at 2 blank lines part paragraphs and wrapped lines are joined. Those under `min_words` words are
not compared, as headings and greetings repeat in clean documents; at 1 all are, and one of fewer than five words
is one shingle, so it is compared whole. A paragraph's word shingles give BANDS x ROWS MinHash values;
at similarity 0.8 two paragraphs share a band with probability 1 - (1 - 0.8^5)^14 = 0.996. Paragraphs
that meet in a band are verified by exact Jaccard and clustered by components.

A passage is a run of PASSAGE words or more, anywhere in a document and across line ends, that an earlier
document (smaller id) has too. Each window of PASSAGE words is keyed by its smallest hash of ANCHOR words,
its anchor; windows in a row with one anchor are a segment. Segments whose anchor no other document has
go. Equal segments are copies of the first one as a whole; where different segments have an anchor in
common, their windows are compared one by one. So exactly the words of the windows that an earlier document has are
found; windows in a row with the same source are one removal, its source is the row that stays.

A cluster of paragraphs counts when it spans two documents; its first occurrence (smallest doc_id, then
place) stays, the others are removals. Removals can overlap. Nodes are 64-bit digests of the words, so exact copies are one node.

Defined results: A-Z is lowered, words end at ASCII white space, lines at a line feed. Null, empty and
short texts give no rows. Rows that repeat an id are one document: its copies alone are no repeat. Rows
without an id are left out. Other columns are not read. A document's own repeats are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clausedelta.llm.bucket_links import SKETCH_LONGS, link_buckets, sketch
from clausedelta.llm.common import written
from clausedelta.llm.segments import gather, slices, texts_of
from clausedelta.llm.shingles import GOLDEN, finish, shingle_sets, window_hashes, word_hashes

MIN_WORDS, PASSAGE, ANCHOR = 20, 50, 25
SPREAD = PASSAGE - ANCHOR + 1
BANDS, ROWS = 14, 5
UNITS = (
    "doc_id bigint, row bigint, node bigint, anchor bigint, pos int, n int, start int, stop int, "
    "n_shingles int, bands array<bigint>"
)
WINDOWS = "doc_id bigint, row bigint, pos int, start int, stop int, window bigint"


def word_places(texts: pa.Array) -> tuple[np.ndarray, ...]:
    """Of every word of all texts: character offset of start and end in its text, and number of its line."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    gap = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.ones(len(raw) + 1, dtype=bool)
    edge[1:-1] = gap[:-1]
    edge[offsets] = True
    starts = np.flatnonzero(~gap & edge[:-1])
    edge[:-1] = gap
    edge[offsets] = True
    ends = np.flatnonzero(~gap & edge[1:]) + 1
    chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    line = np.concatenate([[0], np.cumsum(raw == 10)])
    text = np.searchsorted(offsets, starts, side="right") - 1
    base = chars[offsets[text]]
    return chars[starts] - base, chars[ends] - base, line[starts], text


def digests(words: np.ndarray, starts: np.ndarray, lens: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit digest of each run of words, order counting."""
    if not len(starts):
        return np.empty(0, np.uint64)
    at = gather(starts, lens)
    place = (np.arange(len(at)) - np.repeat(np.cumsum(lens) - lens, lens)).astype(np.uint64)
    mixed = finish(words[at] + (place + np.uint64(seed)) * GOLDEN)
    return finish(np.add.reduceat(mixed, np.cumsum(lens) - lens) ^ (lens.astype(np.uint64) * GOLDEN))


def band_values(words: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bands of each run of words, and its number of distinct shingles."""
    values, counts = window_hashes(lens, words[gather(starts, lens)])
    if not len(starts):
        return np.empty((0, BANDS), np.uint64), counts
    first = np.cumsum(counts) - counts
    owner = np.repeat(np.arange(len(starts)), counts)
    keyed = finish(values + owner.astype(np.uint64) * GOLDEN)
    order = np.argsort(keyed)
    fresh = np.concatenate([[True], keyed[order][1:] != keyed[order][:-1]])
    counts = np.bincount(owner[order[fresh]], minlength=len(starts))
    bands = []
    for band in range(BANDS):
        state = np.full(len(starts), band, dtype=np.uint64)
        for row in range(ROWS):
            odd = finish(np.array([band * ROWS + row + 1], dtype=np.uint64)) | np.uint64(1)
            state = finish(state * GOLDEN + np.minimum.reduceat(values * odd, first))
        bands.append(state)
    return np.stack(bands, axis=1), counts


def window_keys(words: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First words of all windows of PASSAGE words within a text; hash and anchor of the windows."""
    if len(words) < PASSAGE:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)
    joined = {1: words}
    for k in (1, 2, 4, 8):
        joined[2 * k] = finish(joined[k][:-k] * GOLDEN + joined[k][k:])
    size = len(words) - ANCHOR + 1
    run = finish(finish(joined[16][:size] * GOLDEN + joined[8][16 : 16 + size]) * GOLDEN + words[24:])
    whole = finish(run[:-ANCHOR] * GOLDEN + run[ANCHOR:])
    width, low = 1, run
    while width * 2 <= SPREAD:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    rest = SPREAD - width
    low = np.minimum(low[: len(low) - rest], low[rest:])
    at = np.flatnonzero(text[: len(whole)] == text[PASSAGE - 1 :])
    return at, whole[at], low[at]


def segment_runs(at: np.ndarray, whole: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, ...]:
    """First window, number of windows (SPREAD at most, so first and last hold all words), digest and anchor."""
    if not len(at):
        return at, at, whole, low
    new = np.concatenate([[True], (np.diff(at) != 1) | (low[1:] != low[:-1])])
    first = np.flatnonzero(new)
    place = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
    first = np.flatnonzero(place % SPREAD == 0)
    n = np.diff(np.append(first, len(at)))
    digest = finish(finish(whole[first] * GOLDEN + whole[first + n - 1]) + n.astype(np.uint64) * GOLDEN)
    return at[first], n, digest, low[first]


def units(docs: DataFrame, min_words: int, line_ends: int) -> DataFrame:
    """UNITS: paragraphs with their bands, segments with their anchor; places in characters of the text.

    row tells texts of one id apart; pos is a segment's first word, n its number of windows.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = texts_of(part, "text")
                ids = part.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
                row = part.column("row").to_numpy(zero_copy_only=False).astype(np.int64)
                _, words = word_hashes(texts)
                start, stop, line, text = word_places(texts)
                if not len(words):
                    continue
                new = np.concatenate([[True], (line[1:] - line[:-1] >= line_ends) | (text[1:] != text[:-1])])
                first = np.flatnonzero(new)
                lens = np.diff(np.append(first, len(words)))
                first, lens = first[lens >= min_words], lens[lens >= min_words]
                bands, counts = band_values(words, first, lens)
                runs, n, digest, anchor = segment_runs(*window_keys(words, text))
                at, last = np.concatenate([first, runs]), np.concatenate([first + lens - 1, runs + n + PASSAGE - 2])
                node = np.concatenate([digests(words, first, lens, 1), digest])
                pos = runs - np.searchsorted(text, text[runs])
                none = pa.nulls(len(first), pa.int32())
                flat = pa.array(bands.reshape(-1).view(np.int64))
                steps = np.arange(len(first) + 1, dtype=np.int32) * BANDS
                listed = pa.ListArray.from_arrays(pa.array(steps), flat)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[text[at]]), pa.array(row[text[at]]), pa.array(node.view(np.int64)),
                        pa.concat_arrays([pa.nulls(len(first), pa.int64()), pa.array(anchor.view(np.int64))]),
                        pa.concat_arrays([none, pa.array(pos.astype(np.int32))]),
                        pa.concat_arrays([none, pa.array(n.astype(np.int32))]),
                        pa.array(start[at].astype(np.int32)), pa.array(stop[last].astype(np.int32)),
                        pa.concat_arrays([pa.array(counts.astype(np.int32)), pa.nulls(len(runs), pa.int32())]),
                        pa.concat_arrays([listed, pa.nulls(len(runs), pa.list_(pa.int64()))]),
                    ],
                    [x.split()[0] for x in UNITS.split(", ")],
                )

    return texts_with_row(docs).mapInArrow(cut, UNITS)


def texts_with_row(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    return rows.where("doc_id is not null").withColumn("row", F.xxhash64("text"))


def windows_of(docs: DataFrame, own: DataFrame) -> DataFrame:
    """WINDOWS: the windows of the segments in own (doc_id, row, pos, n), one by one."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = texts_of(part, "text")
                ids, row = (part.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("doc_id", "row"))
                _, words = word_hashes(texts)
                start, stop, _, text = word_places(texts)
                at, whole, _ = window_keys(words, text)
                lists = part.column("segments")
                each = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                flat = lists.flatten()
                pos, n = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
                begin = np.searchsorted(text, np.repeat(np.arange(len(each)), each)) + pos
                want = np.unique(gather(begin, n))
                window = whole[np.searchsorted(at, want)]
                mine = text[want]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[mine]), pa.array(row[mine]),
                        pa.array((want - np.searchsorted(text, mine)).astype(np.int32)),
                        pa.array(start[want].astype(np.int32)), pa.array(stop[want + PASSAGE - 1].astype(np.int32)),
                        pa.array(window.view(np.int64)),
                    ],
                    [x.split()[0] for x in WINDOWS.split(", ")],
                )

    lists = own.groupBy("doc_id", "row").agg(F.collect_list(F.struct("pos", "n")).alias("segments"))
    return texts_with_row(docs).join(lists, ["doc_id", "row"]).mapInArrow(cut, WINDOWS)


def shared_passages(found: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, start, stop, kind, cluster_id, removed: the passages, and the source of each."""
    segs = found.where("anchor is not null").drop("n_shingles", "bands")
    both = F.min("doc_id").alias("low"), F.max("doc_id").alias("high")
    groups = written(segs.groupBy("anchor", "node").agg(*both), "segments", compression="zstd")
    mixed = groups.groupBy("anchor").agg(F.min("low").alias("a"), F.max("high").alias("b"), F.count("*").alias("c"))
    mixed = written(mixed.where("c > 1 and a <> b").select("anchor", F.lit(True).alias("mixed")), "anchors")
    live = written(groups.join(mixed, "anchor", "left").where("mixed or low <> high"), "live-segments", compression="zstd")
    met = written(segs.join(live, ["anchor", "node"]), "met-segments", compression="zstd")

    place = F.struct("doc_id", "row", "pos", "start", "stop")
    first = met.where("doc_id = low and low <> high").groupBy("anchor", "node").agg(F.min(place).alias("head"))
    first = written(first, "first-segments", compression="zstd")
    copies = met.where("doc_id <> low").join(first, ["anchor", "node"]).select("doc_id", "row", "pos", "n", "start", "stop", "head")

    windows = written(windows_of(docs, met.where("mixed and doc_id = low")), "windows", compression="zstd")
    twice = written(windows.groupBy("window").agg(*both).where("low <> high"), "met-windows")
    close = written(windows.join(twice, "window"), "shared-windows", compression="zstd")
    first = written(close.where("doc_id = low").groupBy("window").agg(F.min(place).alias("head")), "first-windows", compression="zstd")
    single = close.where("doc_id <> low").join(first, "window").select(
        "doc_id", "row", "pos", F.lit(1).alias("n"), "start", "stop", "head"
    )

    # Runs of windows that follow each other in both the document and its source.
    source = F.struct("head.doc_id", "head.row").alias("source")
    parts = copies.union(single).select("*", source, (F.col("head.pos") - F.col("pos")).alias("shift"))
    keys = ["doc_id", "row", "source", "shift"]
    order = Window.partitionBy(*keys).orderBy("pos", "n")
    fresh = F.col("pos") > F.lag(F.col("pos") + F.col("n"), 1, -1).over(order)
    parts = parts.withColumn("fresh", fresh.cast("int")).withColumn("run", F.sum("fresh").over(order))
    runs = parts.groupBy(*keys, "run").agg(
        F.min("start").alias("start"), F.max("stop").alias("stop"),
        F.min("head.start").alias("from_start"), F.max("head.stop").alias("from_stop"),
    )
    cluster = F.xxhash64("source.doc_id", "source.row", "from_start", "from_stop").alias("cluster_id")
    runs = written(runs.select("doc_id", "start", "stop", F.col("source.doc_id").alias("from_doc"), "from_start", "from_stop", cluster), "runs")
    kind = F.lit("passage").alias("kind")
    gone = runs.select("doc_id", "start", "stop", kind, "cluster_id", F.lit(True).alias("removed"))
    stay = runs.select("from_doc", "from_start", "from_stop", kind, "cluster_id", F.lit(False).alias("removed")).distinct()
    return gone.union(stay)


def verified(pairs: DataFrame, passages: DataFrame) -> DataFrame:
    """a, b: the pairs whose passages have exact Jaccard similarity 0.8 or more of their shingles."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [list(shingle_sets(batch[c].cast(pa.large_string()))) for c in ("ta", "tb")]
            keep = []
            for x, y in zip(*sides, strict=True):
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= 80 * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one, two = (passages.select(F.col("node").alias(x), F.col("passage").alias(f"t{x}")) for x in "ab")
    return pairs.join(one, "a").join(two, "b").mapInArrow(check, "a bigint, b bigint")


def passage_sketches(passages: DataFrame) -> DataFrame:
    """node, rest (0), bits of the shingle set of each passage."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [sketch(s) for s in shingle_sets(batch["passage"].cast(pa.large_string()))]
            flat = pa.array(np.concatenate([np.empty(0, np.int64), *bits]))
            steps = pa.array(np.arange(len(bits) + 1, dtype=np.int32) * SKETCH_LONGS)
            zero = pa.array(np.zeros(len(bits), dtype=np.int64))
            yield pa.RecordBatch.from_arrays([batch["node"], zero, pa.ListArray.from_arrays(steps, flat)], ["node", "rest", "bits"])

    return written(passages.mapInArrow(cut, "node bigint, rest bigint, bits array<bigint>"), "sketches")


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, line_ends: int = 1) -> DataFrame:
    """doc_id, start, stop (characters), kind, cluster_id, removed: every occurrence in a cluster of two documents or more.

    min_words, line_ends: which paragraphs there are; passages are found across them all the same.
    """
    if min_words < 1 or line_ends < 1:
        raise ValueError("min_words and line_ends start at 1")
    found = written(units(docs, min_words, line_ends), "units", compression="zstd")
    lines = found.where("bands is not null")
    met = lines.select(F.explode("bands").alias("token"), F.col("node").alias("grp"), F.col("n_shingles").alias("n"))
    shared = met.groupBy("token").agg(F.min("grp").alias("low"), F.max("grp").alias("high")).where("low <> high")
    entries = written(
        met.join(shared.select("token"), "token", "left_semi").distinct().withColumn("pos", F.lit(0)), "entries"
    )
    members = written(entries.select("grp", F.col("grp").alias("node")).distinct(), "members")
    places = lines.join(members.select("node"), "node", "left_semi").groupBy("node").agg(
        F.min_by(F.struct("doc_id", "row", "start", "stop"), F.struct("doc_id", "start")).alias("p")
    )
    passages = written(
        texts_with_row(docs).join(places.select("node", "p.*"), ["doc_id", "row"])
        .select("node", F.substring("text", F.col("start") + 1, F.col("stop") - F.col("start")).alias("passage"))
        .dropDuplicates(["node"]),
        "passages", compression="zstd",
    )
    labels = members.select("node", F.col("node").alias("comp"))
    labels = link_buckets(entries, members, labels, lambda pairs: verified(pairs, passages), passage_sketches(passages))

    placed = lines.select("doc_id", "node", "start", "stop", F.lit("paragraph").alias("kind"))
    moved = labels.where("node <> comp")
    placed = placed.join(moved, "node", "left").withColumn("cluster_id", F.coalesce("comp", "node")).drop("node", "comp")
    heads = placed.groupBy("cluster_id").agg(
        F.min(F.struct("doc_id", "start", "stop")).alias("head"), F.max("doc_id").alias("last_doc")
    ).where("head.doc_id <> last_doc")
    rows = placed.join(heads, "cluster_id").select(
        "doc_id", "start", "stop", "kind", "cluster_id",
        (F.struct("doc_id", "start", "stop") != F.col("head")).alias("removed"),
    )
    return rows.union(shared_passages(found, docs))
