"""Benchmark decontamination by winnowing.

Of each span of ``WINDOW`` words, texts and benchmark items alike keep the least hash of its ``GRAM``-word grams
(the rightmost of equal ones). Any shared span of WINDOW words therefore has a fingerprint in common. Fingerprints
of texts are joined with those of the items, and each hit is extended to the windows around it, which must be windows of an
item too; their union are the shared spans. A text's cost doesn't grow with how often a window is in the items or in
itself. An item of fewer words is one window and must occur whole.

Items of up to ``BLOCK_BYTES`` go to the executors as an index. Beyond it their windows stay a table: bitmaps of a fixed size
tell which windows of a text may be in it, and these are joined with it.

Null text has no words, and such an item occurs nowhere. A null item id is written as "null". Rows are kept one
for one, with null or repeated ids as they are. An empty benchmark hits nothing. Columns of the input that are named like
an added one are replaced. Words and windows are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import more_columns, own_names, python_rows, shipped, small, stored, table, text_last
from .sketch import bucket_counts
from .textkernel import ALNUM, Words, as_bytes, chunks, shingles, shingles_at

WINDOW, GRAM = 10, 5
BLOCK_BYTES = 32 << 20
#: Buckets of the bitmaps.
BITS = 26


def fingerprints(words: np.ndarray, text_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the grams that winnowing keeps; text_of: which text each word is in."""
    n = len(words) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    grams = shingles(words, GRAM)
    least, at = grams[:n].copy(), np.zeros(n, dtype=np.int64)
    for j in range(1, WINDOW - GRAM + 1):
        other = grams[j : j + n]
        take = other <= least
        np.copyto(least, other, where=take)
        at[take] = j
    whole = text_of[:n] == text_of[WINDOW - 1 :]
    kept = np.zeros(len(grams), dtype=bool)
    kept[(np.arange(n) + at)[whole]] = True
    places = np.flatnonzero(kept)
    return places, grams[places]


def item_windows(words: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Size, hashes and items of the windows, for each size there is."""
    counts = np.diff(first)
    for size in range(1, WINDOW + 1):
        which = np.flatnonzero(counts == size if size < WINDOW else counts >= WINDOW)
        if len(which):
            each = counts[which] - size + 1
            starts = np.repeat(first[which] - np.concatenate([[0], np.cumsum(each)[:-1]]), each) + np.arange(each.sum())
            yield size, shingles_at(words, starts, size), np.repeat(which, each)


def _member(of: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes are in a sorted array."""
    if not len(of):
        return np.zeros(len(hashes), dtype=bool)
    return of[np.minimum(np.searchsorted(of, hashes), len(of) - 1)] == hashes


def candidates(words: np.ndarray, first: np.ndarray, known, sizes: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Size, starts and hashes of the windows of texts that are in the items as far as known(size, hashes) tells; size 0 stands
    for fingerprints."""
    text_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    for size in sizes:
        if size == WINDOW:
            places, hashes = fingerprints(words, text_of)
            places = places[known(0, hashes)]
            # The windows that have the gram: each hit extends to these, and those to the whole span.
            starts = np.unique((places[:, None] - np.arange(WINDOW - GRAM + 1)).reshape(-1))
            starts = starts[(starts >= 0) & (starts + WINDOW <= len(words))]
        else:
            starts = np.arange(max(0, len(words) - size + 1))
        starts = starts[text_of[starts] == text_of[starts + size - 1]]
        hashes = shingles_at(words, starts, size)
        hit = known(size, hashes)
        yield size, starts[hit], hashes[hit]


class Index:
    """Items' fingerprints, and their windows by size with the items that have each."""

    def __init__(self, items: list[tuple[str, bytes]]):
        words = Words([t for _, t in items], ALNUM)
        hashes, first = words.hashes(), words.first
        self.names = [i for i, _ in items]
        self.known = {0: np.unique(fingerprints(hashes, np.repeat(np.arange(len(items)), np.diff(first)))[1])}
        self.items: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size, found, which in item_windows(hashes, first):
            pairs = np.unique(np.rec.fromarrays([found, which], names="h,i"))
            self.known[size], begin = np.unique(pairs.h, return_index=True)
            self.items[size] = np.append(begin, len(pairs)), np.asarray(pairs.i)

    def search(self, words: np.ndarray, first: np.ndarray) -> tuple[list[tuple[int, int]], list[set[int]]]:
        """Runs of words that are hit, and the items found in each text."""
        found: list[set[int]] = [set() for _ in range(len(first) - 1)]
        covered = np.zeros(len(words) + 1, dtype=np.int64)
        for size, starts, hashes in candidates(words, first, lambda k, h: _member(self.known[k], h), sorted(self.items)):
            np.add.at(covered, starts, 1)
            np.add.at(covered, starts + size, -1)
            begin, which = self.items[size]
            texts = np.searchsorted(first, starts, side="right") - 1
            for t, w in np.unique(np.stack([texts, np.searchsorted(self.known[size], hashes)], axis=1), axis=0):
                found[t].update(which[begin[w] : begin[w + 1]].tolist())
        places = np.flatnonzero(np.cumsum(covered)[:-1] > 0)
        text = np.searchsorted(first, places, side="right")
        cut = np.flatnonzero((np.diff(places) > 1) | (np.diff(text) > 0)) + 1
        return [(int(x[0]), int(x[-1]) + 1) for x in np.split(places, cut) if len(x)], found


def _union(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_HITS = pa.list_(pa.list_(pa.int64()))


def _search(index):
    """Adds to each row (..., text as the last column) its words, its hits as [first word, end] and its items."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Index = index.value
        for batch in batches:
            counts, hits, names = [], [], []
            for _, texts in chunks(as_bytes(batch.column(batch.num_columns - 1))):
                words = Words(texts, ALNUM)
                runs, found = held.search(words.hashes(), words.first)
                counts += np.diff(words.first).tolist()
                of_text: list[list[list[int]]] = [[] for _ in texts]
                for a, b in runs:
                    t = int(np.searchsorted(words.first, a, side="right")) - 1
                    of_text[t].append([a - int(words.first[t]), b - int(words.first[t])])
                hits += of_text
                names += [sorted({held.names[i] for i in s}) for s in found]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(counts, pa.int64()), pa.array(hits, _HITS), pa.array(names, pa.list_(pa.string()))],
                [*batch.schema.names, "__n_words", "__hits", "__items"],
            )

    return rows


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of items; fingerprints as those of size 0."""
    for batch in batches:
        for at, texts in chunks(as_bytes(batch.column(1))):
            words = Words(texts, ALNUM)
            hashes, first = words.hashes(), words.first
            prints = fingerprints(hashes, np.repeat(np.arange(len(texts)), np.diff(first)))[1]
            found = [(0, prints, np.zeros(len(prints), dtype=np.int64)), *item_windows(hashes, first)]
            for size, h, which in found:
                yield pa.RecordBatch.from_arrays([pa.array([size] * len(h), pa.int32()), pa.array(h.view(np.int64)), batch.column(0).take(pa.array(which + at))], ["size", "h", "item"])


def _of_size(size: int, hashes: np.ndarray) -> np.ndarray:
    return hashes ^ np.uint64(size * 0x9E3779B97F4A7C15 % 2**64)


def _hashes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    sizes, h = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
    for size in np.unique(sizes):
        yield _of_size(int(size), h[sizes == size])


def _maybe(bitmap, sizes: list[int]):
    """Of each text its words, and windows that may be in the items: a row without a size counts the words."""
    mask = np.uint64((1 << BITS) - 1)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = bitmap.value
        known = lambda size, h: held[_of_size(size, h) & mask] > 0
        for batch in batches:
            for at, texts in chunks(as_bytes(batch.column(1))):
                words = Words(texts, ALNUM)
                hashes, first = words.hashes(), words.first
                found = [(0, np.arange(len(texts)), np.diff(first), np.zeros(len(texts), dtype=np.int64))]
                for size, starts, h in candidates(hashes, first, known, sizes):
                    t = np.searchsorted(first, starts, side="right") - 1
                    found.append((size, t, starts - first[t], h.view(np.int64)))
                for size, t, starts, h in found:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(t + at)), pa.array([size] * len(t), pa.int32()), pa.array(starts, pa.int64()), pa.array(h, pa.int64())], ["rid", "size", "start", "h"])

    return rows


def _unions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hits = [_union([(r["start"], r["start"] + r["size"]) for r in x]) for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hits, _HITS)], ["r", "hits"])


def _joined(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs (..., text) against items of any size: joins of windows, nothing of either comes to the driver but a bitmap of fixed size."""
    spark = docs.sparkSession
    windows = stored(python_rows(items, _windows, "size int, h long, item string").distinct(), "winnow-items")
    sizes = sorted(r.size for r in windows.select("size").distinct().collect() if r.size)
    bitmap = spark.sparkContext.broadcast(bucket_counts(windows.select("size", "h"), _hashes, BITS))
    docs = stored(docs.withColumn("__rid", F.monotonically_increasing_id()), "winnow-docs")
    found = stored(python_rows(docs.select("__rid", "text"), _maybe(bitmap, sizes), "rid long, size int, start long, h long"), "winnow-maybe")
    counts = found.filter("size = 0").select(F.col("rid").alias("c"), F.col("start").alias("__n_words"))
    known = windows.filter("size > 0").select(F.col("size").alias("s"), F.col("h").alias("k"), "item")
    on = (F.col("size") == F.col("s")) & (F.col("h") == F.col("k"))
    hits = stored(found.filter("size > 0").join(known, on, "left_semi"), "winnow-hits")
    runs = hits.groupBy("rid").agg(F.collect_set(F.struct("start", "size")).alias("all"))
    runs = python_rows(runs, _unions, "r long, hits array<array<bigint>>")
    names = hits.select("rid", "size", "h").distinct().join(known, on).groupBy(F.col("rid").alias("i")).agg(F.array_sort(F.collect_set("item")).alias("items"))
    out = docs.join(counts, F.col("__rid") == F.col("c")).join(runs, F.col("__rid") == F.col("r"), "left").join(names, F.col("__rid") == F.col("i"), "left")
    out = out.withColumn("__hits", F.coalesce("hits", F.array().cast("array<array<bigint>>"))).withColumn("__items", F.coalesce("items", F.array().cast("array<string>")))
    return out.drop("c", "r", "i", "hits", "items", "__rid")


def find_benchmark(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs (text, ...) with the columns __n_words, __hits (runs of words, [first, end]) and __items (ids as strings, sorted)."""
    spark = docs.sparkSession
    shipped(spark)
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("i"), F.coalesce("text", F.lit("")).alias("t"))
    docs = text_last(docs.drop("__n_words", "__hits", "__items", "__rid"))
    more = "__n_words long, __hits array<array<bigint>>, __items array<string>"
    if (items.agg(F.sum(F.octet_length("t"))).first()[0] or 0) > block_bytes:
        rest = [c for c in docs.columns if c != "text"]
        packed = docs.select(F.struct(*rest).alias("others") if rest else F.lit(None).cast("int").alias("others"), "text")
        out = _joined(packed, items)
        return out.select(*[F.col(f"others.`{c}`").alias(c) for c in rest], "text", "__n_words", "__hits", "__items")
    index = spark.sparkContext.broadcast(Index([(r.i, r.t.encode()) for r in items.collect()]))
    return python_rows(docs, _search(index), more_columns(docs, more))


def op6_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_benchmark(own_names(table(spark, sf_dir, "documents"), ["doc_id", "text"]), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("__hits", F.lit(0).cast("long"), lambda n, h: n + h[1] - h[0])
    return found.select(
        "doc_id", F.col("__n_words").alias("n_words"), n_hit.alias("n_hit"), F.size("__items").cast("long").alias("n_items"),
        F.sha2(F.array_join("__items", ","), 256).alias("items_sha256"), (F.size("__hits") > 0).alias("contaminated"),
    )
