"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram of letters binds its three vectors, each
rotated by its place, by multiplication; a text bundles (sums) the vectors of its trigrams, a language
those of its training texts. A text belongs to the language whose prototype is nearest by cosine.
A word's first and last trigram hold one boundary symbol; trigrams don't span words.

Prototypes are exact integer sums, so they depend neither on order nor on partitions. They are
languages x DIM numbers and the only thing sent to the tasks; the number of languages is checked.

Defined results: text that is null or has no letter gives `und` with score 0, and so does every text if
nothing could be learned; a cosine below 0 counts as 0; equal cosines go to the first language by name.
Other columns pass through; a column named like one of `out` is replaced. Repeated rows give equal rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from clausedelta.llm.segments import give_back, slices, texts_of

DIM = 1024
UNKNOWN = "und"
MOST_LANGUAGES = 5000  # x DIM x 8 bytes = 40 MB to every task; more labels than that are no languages
BLOCK, SLICE = 8192, 1 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def letter_vectors(symbols: np.ndarray) -> np.ndarray:
    """A fixed random vector of +1 and -1 per code point; 0 stands for the word boundary."""
    seeds = mixed(symbols.astype(np.uint64))[:, None] + np.arange(DIM // 64, dtype=np.uint64)[None, :]
    bits = np.unpackbits(mixed(seeds).view(np.uint8), axis=1)
    return bits.astype(np.int8) * 2 - 1


class Trigrams:
    """The trigrams of some texts: for each occurrence its text and its number among the distinct ones."""

    def __init__(self, texts: list[str]) -> None:
        lowered = [t.lower() for t in texts]
        points = np.frombuffer("\n".join(lowered).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        sizes = np.fromiter(map(len, lowered), dtype=np.int64, count=len(lowered))
        row = np.repeat(np.arange(len(texts)), sizes + 1)[: len(points)]
        symbol = np.concatenate([[0], np.where(letters()[points], points, 0), [0]]).astype(np.int64)
        middle = np.flatnonzero(symbol[1:-1]) + 1
        self.symbols, index = np.unique(symbol, return_inverse=True)
        n = len(self.symbols)
        keys = (index[middle - 1] * n + index[middle]) * n + index[middle + 1]
        if n**3 <= 1 << 24:
            seen = np.zeros(n**3, dtype=bool)
            seen[keys] = True
            self.keys = np.flatnonzero(seen)
            number = np.cumsum(seen, dtype=np.int64) - 1
            self.number = number[keys]
        else:
            self.keys, self.number = np.unique(keys, return_inverse=True)
        self.row, self.rows = row[middle - 1], len(texts)
        self.base = letter_vectors(self.symbols)
        self.turned = np.roll(self.base, 1, axis=1), np.roll(self.base, 2, axis=1)
        self.whole = self.bound(self.keys) if len(self.keys) <= 2 * BLOCK else None

    def bound(self, keys: np.ndarray) -> np.ndarray:
        n = len(self.symbols)
        once, twice = self.turned
        return (twice[keys // n // n] * once[keys // n % n] * self.base[keys % n]).astype(np.float32)

    def bundle(self, numbers: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Sum of the trigrams' vectors, each times its count; whole numbers, exact in float64."""
        total = np.zeros(DIM)
        for at in range(0, len(numbers), BLOCK):
            part = numbers[at : at + BLOCK]
            vectors = self.whole[part] if self.whole is not None else self.bound(self.keys[part])
            total += counts[at : at + BLOCK].astype(np.float32) @ vectors if counts[at : at + BLOCK].sum() < 1 << 24 else (
                counts[at : at + BLOCK].astype(np.float64) @ vectors
            )
        return total

    def of_rows(self) -> Iterator[np.ndarray | None]:
        """The bundle of each text in turn; None without a letter."""
        ends = np.searchsorted(self.row, np.arange(self.rows), side="right")
        start = 0
        for end in ends:
            if end == start:
                yield None
            else:
                numbers, counts = np.unique(self.number[start:end], return_counts=True)
                yield self.bundle(numbers, counts)
            start = end


def learn(docs: DataFrame, label: str = "lang", text: str = "text") -> dict[str, np.ndarray]:
    """Prototype of every language: the bundle of its texts. Rows without label or text teach nothing."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                grams = Trigrams(texts_of(part, "text").to_pylist())
                names = np.array(part.column("label").to_pylist(), dtype=object)
                owner = names[grams.row]
                for name in set(names):
                    counts = np.bincount(grams.number[owner == name], minlength=len(grams.keys))
                    numbers = np.flatnonzero(counts)
                    total[name] = total.get(name, np.zeros(DIM)) + grams.bundle(numbers, counts[numbers])
        if total:
            vectors = [v.astype(np.int64).tolist() for v in total.values()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(total), pa.string()), pa.array(vectors, pa.list_(pa.int64()))], ["label", "vector"]
            )

    known = docs.select(F.col(label).cast("string").alias("label"), F.col(text).cast("string").alias("text")).dropna()
    cells = known.mapInArrow(sums, "label string, vector array<bigint>").select("label", F.posexplode("vector"))
    sums_of = cells.groupBy("label", "pos").agg(F.sum("col").alias("value"))
    rows = sums_of.groupBy("label").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]).alias("vector")
    )
    found = rows.limit(MOST_LANGUAGES + 1).collect()
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} labels; prototypes go to every task")
    return {r["label"]: np.array(r["vector"], dtype=np.float64) for r in sorted(found, key=lambda r: r["label"])}


def identify(
    docs: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text", out: tuple[str, str] = ("lang_pred", "score"),
    usual: np.ndarray | None = None, counts: tuple[str, str] = ("n_letters", "n_usual"),
) -> DataFrame:
    """Adds the language and the cosine, 0 to 1; with `usual` (see usual_letters) in the same pass `counts`:
    how many letters the text has, and how many of them are usual ones."""
    names = list(prototypes)
    table = np.array([prototypes[n] / max(np.linalg.norm(prototypes[n]), 1e-300) for n in names])
    points = None if usual is None else np.flatnonzero(usual)
    new = [*out, *(counts if usual is not None else ())]
    rest = docs.drop(*new)
    kinds = [StringType(), DoubleType(), LongType(), LongType()]
    schema = StructType([*rest.schema.fields, *(StructField(c, t) for c, t in zip(new, kinds, strict=False))])

    def letter_counts(texts: list[str], known: np.ndarray) -> list[pa.Array]:
        found, owner = letter_points(texts)
        n, seen = (np.bincount(x, minlength=len(texts)) for x in (owner, owner[known[found]]))
        return [pa.array(n.astype(np.int64)), pa.array(seen.astype(np.int64))]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.zeros(0x110000, dtype=bool)
        if points is not None:
            known[points] = True
        for batch in batches:
            for part in slices(batch, text, SLICE):
                texts = texts_of(part, text).to_pylist()
                best, scores = [], []
                for v in Trigrams(texts).of_rows():
                    size = 0.0 if v is None else float(np.linalg.norm(v))
                    if not names or size == 0:
                        best.append(UNKNOWN)
                        scores.append(0.0)
                        continue
                    near = table @ v / size
                    i = int(np.argmax(near))
                    best.append(names[i])
                    scores.append(min(max(float(near[i]), 0.0), 1.0))
                more = [] if points is None else letter_counts(texts, known)
                columns = [*part.columns, pa.array(best, pa.string()), pa.array(scores, pa.float64()), *more]
                yield pa.RecordBatch.from_arrays(columns, [*part.schema.names, *new])
        give_back()

    return rest.mapInArrow(judge, schema)


def letter_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The lower-case letters of all texts as code points, and the text of each."""
    lowered = [t.lower() for t in texts]
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    owner = np.repeat(np.arange(len(texts)), np.fromiter(map(len, lowered), dtype=np.int64, count=len(texts)))
    real = letters()[points]
    return points[real], owner[real]


def usual_letters(docs: DataFrame, label: str = "lang", text: str = "text", share: float = 0.99) -> np.ndarray:
    """Whether a code point is among the commonest letters that make up `share` of a language's training letters."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                names = np.array(part.column("label").to_pylist(), dtype=object)
                points, owner = letter_points(texts_of(part, "text").to_pylist())
                for name in set(names[owner]):
                    found, n = np.unique(points[names[owner] == name], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(found), pa.string()), pa.array(found.astype(np.int32)), pa.array(n.astype(np.int64))],
                        ["label", "letter", "n"],
                    )

    known = docs.select(F.col(label).cast("string").alias("label"), F.col(text).cast("string").alias("text")).dropna()
    counts = known.mapInArrow(count, "label string, letter int, n bigint").groupBy("label", "letter").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("label").orderBy(F.desc("n"), "letter").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    placed = placed.withColumn("total", F.sum("n").over(Window.partitionBy("label")))
    usual = np.zeros(0x110000, dtype=bool)
    usual[[r[0] for r in placed.where(F.col("before") < share * F.col("total")).select("letter").distinct().collect()]] = True
    return usual


def held_out(doc_id: Column, parts: int = 3, part: int = 1) -> Column:
    """Whether a document is kept from training; a null id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))
