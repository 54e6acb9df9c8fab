"""Suffix-array dedup with a run-length index: bytes that a repeated string of ``LENGTH`` bytes covers.

A window of LENGTH bytes keeps the place of the least hash of its ``GRAM``-byte grams (all places, if equal ones tie),
so that equal windows keep equal grams at equal places; so does each window of ``PASSAGE`` bytes. Stretches of tied places
are one row. Grams kept at two places or more mark the regions that can repeat; a region is all bytes of the windows
that keep the gram. Regions are dealt into buckets by gram, or by the least of the texts that have it, which any text
with the gram agrees on, and regions of one text that overlap in a bucket are merged, so that a bucket holds each place of
the corpus once, and all windows equal to one of its own. Equal regions are indexed once.

In a bucket the regions' text is suffix-sorted; its Burrows-Wheeler transform is kept as runs with the sampled
suffixes at run ends. Longest matches with the neighbouring suffixes are computed at run ends only. Between these,
the match of the next position is one byte shorter, so that streaming the text through the samples gives the matching
statistics of every position against the rest of the bucket. Windows whose match is LENGTH or longer repeat; those whose
match with another text is PASSAGE or longer are shared, and a run of them with more than ``WORDS`` words is a passage.

Equal texts are one text in the index, and repeat whole. A text is cut into pieces by where its windows start, ``PIECE``
starts each. A bucket of more than ``MOST_BYTES`` is dealt out by region; there, windows also meet by their hash across its
parts, so that no task holds such a group.

Null text is empty. Texts shorter than LENGTH have nothing to remove. Rows are kept one for one; rows equal in id and
text are texts of their own, as any other copies are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import own_names, python_rows, shipped, small, stored, table
from .textkernel import _TABLE, _power_tables, as_bytes, chunks, mix

LENGTH, GRAM = 400, 64
#: A passage: more than so many words, all in strings of so many bytes that other texts have too.
WORDS, PASSAGE = 50, 240
#: Starts of windows in a piece of a text; bytes of regions in a bucket, about; at most, but for one region; and in a task, about.
PIECE, BUCKET_BYTES, MOST_BYTES, TASK_BYTES = 1 << 20, 1_000_000, 2_000_000, 4_000_000
#: A gram in at most so many texts goes to a bucket by the least of them.
FEW = 64
#: Bytes that the spans of all texts may have in a broadcast.
BROADCAST_BYTES = 64 << 20


def _sliding(x: np.ndarray, w: int, op) -> np.ndarray:
    """op (minimum or maximum) over each w values."""
    n = len(x)
    if w == 1:
        return x
    pad = -n % w
    fill = np.iinfo(np.uint64).max if op is np.minimum else np.uint64(0)
    y = np.concatenate([x, np.full(pad, fill, dtype=np.uint64)]).reshape(-1, w)
    before = op.accumulate(y, axis=1).reshape(-1)
    after = op.accumulate(y[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return op(after[: n - w + 1], before[w - 1 : n])


def rolling(data: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k bytes from each place."""
    n = len(data)
    powers, inverse = _power_tables(n + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_TABLE[data] * powers[:n], out=sums[1:])
        return mix((sums[k:] - sums[:-k]) * inverse[: n - k + 1])


def _least_kept(hashes: np.ndarray, w: int, length: int, ends: np.ndarray) -> np.ndarray:
    """Which grams the windows of w grams (length bytes) keep; windows across two texts keep nothing."""
    if len(hashes) < w:
        return np.zeros(len(hashes), dtype=bool)
    least = _sliding(hashes, w, np.minimum)
    for e in ends[:-1]:
        if 0 < e:
            least[max(0, e - length + 1) : e] = 0
    padded = np.concatenate([np.zeros(w - 1, dtype=np.uint64), least, np.zeros(w - 1, dtype=np.uint64)])
    return _sliding(padded, w, np.maximum) == hashes


def anchors(texts: list[bytes], length: int = LENGTH, gram: int = GRAM, passage: int = PASSAGE) -> tuple[np.ndarray, ...]:
    """Text, first and last place, hash, and whether a window of length bytes keeps it, of the grams that windows keep.

    Places with the same gram one after another are one row, as long as their windows meet.
    """
    texts = [t if len(t) >= passage else b"" for t in texts]
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    ends = np.cumsum(sizes)
    if len(data) < passage:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none.astype(np.uint64), none.astype(bool)
    hashes = rolling(data, gram)
    wide = _least_kept(hashes, length - gram + 1, length, ends)
    places = np.flatnonzero(wide | _least_kept(hashes, passage - gram + 1, passage, ends))
    which, kept, wide = np.searchsorted(ends, places, side="right"), hashes[places], wide[places]
    opens = np.ones(len(places), dtype=bool)
    opens[1:] = (which[1:] != which[:-1]) | (kept[1:] != kept[:-1]) | (wide[1:] != wide[:-1]) | (np.diff(places) > passage)
    firsts = np.flatnonzero(opens)
    lasts = np.concatenate([firsts[1:] - 1, [len(places) - 1]]) if len(firsts) else firsts
    which = which[firsts]
    begin = (ends - sizes)[which]
    return which, places[firsts] - begin, places[lasts] - begin, kept[firsts], wide[firsts]


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = as_bytes(batch.column(3))
        for at, part in chunks(texts):
            which, first, last, hashes, wide = anchors(part)
            rows = pa.array(which + at)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i).take(rows) for i in range(3)], pa.array(first, pa.int32()), pa.array(last, pa.int32()), pa.array(hashes.view(np.int64)), pa.array(wide)],
                ["doc_id", "th", "piece", "place", "upto", "gram", "wide"],
            )


def _regions(length: int, gram: int, passage: int):
    """Merged regions of each piece and bucket: with their bytes once in a batch, and where they are."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[tuple[int, int]] = set()
            out: list[tuple] = []
            size = 0
            for i, text in enumerate(as_bytes(batch.column(2))):
                for bucket, first, end in _merged(batch.column(3)[i].values, len(text), length, gram, passage):
                    content = text[first:end]
                    key = xxhash.xxh3_64_intdigest(content) - 2**63
                    new = (bucket, key) not in seen
                    seen.add((bucket, key))
                    out.append((i, bucket, key, first, end - first, content if new else None))
                    size += len(content) if new else 0
                    if size > 32 << 20:
                        yield _region_batch(batch, out)
                        out, size = [], 0
            yield _region_batch(batch, out)

    return rows


def _merged(places: pa.StructArray, n: int, length: int, gram: int, passage: int) -> Iterator[tuple[int, int, int]]:
    last: dict[int, list[int]] = {}
    columns = [places.field(name).to_pylist() for name in ("place", "upto", "wide", "bucket")]
    for place, upto, wide, bucket in sorted((p - (length if w else passage), u + (length if w else passage), w, b) for p, u, w, b in zip(*columns, strict=True)):
        first, end = max(0, place + gram), min(n, upto)
        held = last.get(bucket)
        if held and first <= held[1]:
            held[1] = max(end, held[1])
        else:
            if held:
                yield bucket, held[0], held[1]
            last[bucket] = [first, end]
    for bucket, (first, end) in last.items():
        yield bucket, first, end


def _region_batch(batch: pa.RecordBatch, out: list[tuple]) -> pa.RecordBatch:
    rows = pa.array([r[0] for r in out], pa.int64())
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays(
        [batch.column(0).take(rows), batch.column(1).take(rows), *[pa.array([r[j + 1] for r in out], k) for j, k in enumerate(kinds)]],
        ["th", "piece", "bucket", "region", "first", "size", "content"],
    )


def suffix_ranks(data: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """The suffix array, and the ranks of all places by their first 7, 14, 28, ... bytes until all differ."""
    n = len(data)
    # Seven digits to base 257; the end counts as 0, below all bytes.
    padded = np.concatenate([data.astype(np.int64) + 1, np.zeros(7, dtype=np.int64)])
    key = np.zeros(n, dtype=np.int64)
    for j in range(7):
        key = key * 257 + padded[j : j + n]
    order = np.argsort(key, kind="stable")
    depth, levels = 7, []
    new = np.concatenate([[False], key[order][1:] != key[order][:-1]])
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.cumsum(new)
    levels.append((depth, rank.astype(np.int32)))
    while rank[order[-1]] < n - 1:
        after = np.zeros(n, dtype=np.int64)
        after[: max(0, n - depth)] = rank[depth:] + 1
        key = rank * (n + 1) + after
        # Only places that aren't alone with their rank move.
        shared = np.concatenate([~new[1:], [False]]) | ~new
        shared[0] = n > 1 and not new[1]
        at = np.flatnonzero(shared)
        part = order[at]
        order[at] = part[np.argsort(key[part], kind="stable")]
        sorted_key = key[order]
        new = np.concatenate([[False], sorted_key[1:] != sorted_key[:-1]])
        rank[order] = np.cumsum(new)
        depth *= 2
        levels.append((depth, rank.astype(np.int32)))
    return order, levels


class RunIndex:
    """Run-compressed Burrows-Wheeler transform of a text with the suffixes at run ends."""

    def __init__(self, data: np.ndarray):
        self.n = len(data)
        self.data = data
        order, self._levels = suffix_ranks(data)
        before = np.where(order > 0, data[order - 1].astype(np.int16), -1)
        self.order, self.before = order, before
        heads = np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]]))
        tails = np.concatenate([heads[1:] - 1, [self.n - 1]])
        self.symbols, self.lengths = before[heads], tails - heads + 1
        # Samples: the suffix at each run's head with the one above it, and at its tail with the one below it.
        self.heads, self.above = order[heads], order[np.maximum(heads - 1, 0)]
        self.tails, self.below = order[tails], order[np.minimum(tails + 1, self.n - 1)]

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of the suffixes at a and b (which differ)."""
        a, b = a.copy(), b.copy()
        out = np.zeros(len(a), dtype=np.int64)
        for depth, rank in reversed(self._levels):
            same = (a < self.n) & (b < self.n)
            same[same] = rank[a[same]] == rank[b[same]]
            step = same * depth
            a, b, out = a + step, b + step, out + step
        for _ in range(6):
            same = (a < self.n) & (b < self.n)
            same[same] = self.data[a[same]] == self.data[b[same]]
            a, b, out = a + same, b + same, out + same
        return out

    def _samples(self, owner: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places with the nearest suffix of another owner above, then below, where the transform isn't one run up to there.

        Within a run the places before have the same neighbours; those behind an end of a region have none before.
        """
        index, of = np.arange(self.n), owner[self.order]
        starts = self.before == 255
        new = np.concatenate([[True], of[1:] != of[:-1]])
        run = np.concatenate([[True], self.before[1:] != self.before[:-1]])
        first, run_first = (np.maximum.accumulate(np.where(x, index, 0)) for x in (new, run))
        at = np.flatnonzero((first > 0) & ((run_first >= first) | starts | (self.order == 0)))
        yield self.order[at], self.order[first[at] - 1]
        last, run_last = (np.minimum.accumulate(np.where(np.concatenate([x[1:], [True]]), index, self.n)[::-1])[::-1] for x in (new, run))
        at = np.flatnonzero((last < self.n - 1) & ((run_last <= last) | starts | (self.order == 0)))
        yield self.order[at], self.order[last[at] + 1]

    def matching_statistics(self, owner: np.ndarray | None = None) -> np.ndarray:
        """For each place the longest match of its suffix with another place's, or with a place of another owner's."""
        out = np.zeros(self.n, dtype=np.int64)
        places = np.arange(self.n)
        for at, other in ((self.heads, self.above), (self.tails, self.below)) if owner is None else self._samples(owner):
            real = at != other
            found = np.zeros(len(at), dtype=np.int64)
            found[real] = self.extension(at[real], other[real])
            reach = np.full(self.n, -1, dtype=np.int64)
            reach[at] = at + found
            last = np.maximum.accumulate(np.where(reach >= 0, places, 0))
            np.maximum(out, np.maximum(reach[last] - places, 0), out=out)
        return out


def repeated_windows(regions: list[bytes], owners: list[int], again: list[bool], length: int, passage: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each region the places of windows of length bytes that are anywhere else too, and of those of passage bytes that another
    owner has. owners: the text a region is of, -1 for one of several texts; again: whether a region is at two places or more."""
    data = np.frombuffer(b"\xff".join(regions) + b"\xff", dtype=np.uint8)
    sizes = np.array([len(r) + 1 for r in regions])
    if len(regions) > 1 or len(data) > length + 1:
        index = RunIndex(data)
        anywhere = index.matching_statistics()
        # A region of several texts is an owner of its own.
        of = np.where(np.array(owners) < 0, -1 - np.arange(len(regions)), np.array(owners))
        elsewhere = index.matching_statistics(np.repeat(of, sizes))
    else:
        anywhere = elsewhere = np.zeros(len(data), dtype=np.int64)
    out, at = [], 0
    for r, owner, twice in zip(regions, owners, again, strict=True):
        n, m = max(0, len(r) - length + 1), max(0, len(r) - passage + 1)
        out.append((np.arange(n) if twice else np.flatnonzero(anywhere[at : at + n] >= length), np.arange(m) if owner < 0 else np.flatnonzero(elsewhere[at : at + m] >= passage)))
        at += len(r) + 1
    return out


def _runs(windows: np.ndarray, length: int) -> list[list[int]]:
    """Bytes that the windows cover, as [first, end]."""
    if not len(windows):
        return []
    cut = np.flatnonzero(np.diff(windows) > length)
    firsts, lasts = windows[np.concatenate([[0], cut + 1])], windows[np.concatenate([cut, [len(windows) - 1]])]
    return [[int(a), int(b) + length] for a, b in zip(firsts, lasts, strict=True)]


_INDEXED = "bucket long, region long, removed array<array<bigint>>, shared array<array<bigint>>"


def _index(length: int, passage: int):
    def rows(pdf):
        import pandas as pd

        pdf = pdf.sort_values("region")
        regions = [bytes(c) for c in pdf["content"]]
        numbers: dict[bytes, int] = {}
        owners = [-1 if several else numbers.setdefault(bytes(o), len(numbers)) for o, several in zip(pdf["owner"], pdf["several"], strict=True)]
        found = repeated_windows(regions, owners, pdf["again"].tolist(), length, passage)
        columns = {"bucket": pdf["bucket"].to_numpy(), "region": pdf["region"].to_numpy()}
        return pd.DataFrame({**columns, "removed": [_runs(a, length) for a, _ in found], "shared": [_runs(b, passage) for _, b in found]})

    return rows


def _window_hashes(region: bytes, width: int) -> np.ndarray:
    return rolling(np.frombuffer(region, dtype=np.uint8), width).view(np.int64) if len(region) >= width else np.zeros(0, dtype=np.int64)


def _distinct(length: int, passage: int):
    """Of a part of a bucket: each window's hash once, with the least and the greatest number of the owners that have it."""

    def rows(pdf):
        import pandas as pd

        owners = np.array([xxhash.xxh3_64_intdigest(bytes(o)) - 2**63 for o in pdf["owner"]], dtype=np.int64)
        out = []
        for width in (length, passage):
            hashes = [_window_hashes(bytes(c), width) for c in pdf["content"]]
            of = np.repeat(owners, [len(h) for h in hashes])
            found = pd.DataFrame({"h": np.concatenate(hashes), "lo": of, "hi": of}).groupby("h", as_index=False).agg({"lo": "min", "hi": "max"})
            out.append(found.assign(width=width))
        out = pd.concat(out)
        return out.assign(bucket=pdf["bucket"].iloc[0], part=pdf["part"].iloc[0])[["bucket", "part", "width", "h", "lo", "hi"]]

    return rows


def _elsewhere(length: int, passage: int):
    """The windows of a part of a bucket whose hashes other parts have too, as regions' spans."""

    def rows(pdf, known):
        import pandas as pd

        wanted = {w: known["h"][known["width"] == w].to_numpy(dtype=np.int64) for w in (length, passage)}
        spans = [[_runs(np.flatnonzero(np.isin(_window_hashes(bytes(c), w), wanted[w])), w) for c in pdf["content"]] for w in (length, passage)]
        return pd.DataFrame({"bucket": pdf["bucket"].to_numpy(), "region": pdf["region"].to_numpy(), "removed": spans[0], "shared": spans[1]})

    return rows


def _dealt(unique: DataFrame, large: DataFrame) -> DataFrame:
    """Regions of the buckets in large, each part a group, and windows that meet across parts: a hash is a row a part at most."""
    dealt = unique.join(large, F.col("bucket") == F.col("b")).withColumn("part", F.pmod(F.xxhash64("region"), F.col("parts"))).drop("b", "parts")
    dealt = stored(dealt, "dealt")
    hashes = dealt.groupBy("bucket", "part").applyInPandas(_distinct(LENGTH, PASSAGE), "bucket long, part long, width int, h long, lo long, hi long")
    apart = (F.min("part") < F.max("part")) & ((F.col("width") == LENGTH) | (F.min("lo") < F.max("hi")))
    met = hashes.groupBy("bucket", "width", "h").agg(apart.alias("apart"), F.collect_set("part").alias("parts")).filter("apart")
    met = stored(met.select("bucket", "width", "h", F.explode("parts").alias("part")), "met")
    inside = dealt.groupBy("bucket", "part").applyInPandas(_index(LENGTH, PASSAGE), _INDEXED)
    across = dealt.groupBy("bucket", "part").cogroup(met.groupBy("bucket", "part")).applyInPandas(_elsewhere(LENGTH, PASSAGE), _INDEXED)
    return inside.unionByName(across)


def _union(spans: list | None) -> list[list[int]]:
    runs: list[list[int]] = []
    for a, b in sorted(map(tuple, spans or ())):
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(b, runs[-1][1])
        else:
            runs.append([a, b])
    return runs


_SPANS = pa.list_(pa.list_(pa.int64()))


def _unions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        removed, shared = (pa.array([_union(x) for x in batch.column(i).to_pylist()], _SPANS) for i in (1, 2))
        yield pa.RecordBatch.from_arrays([batch.column(0), removed, shared], ["t", "removed", "shared"])


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, runs, shared in zip(as_bytes(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            runs = runs or []
            digest, at = hashlib.sha256(), 0
            for a, b in runs:
                digest.update(text[at:a])
                at = b
            digest.update(text[at:])
            words = [len(text[a:b].split()) for a, b in shared or ()]
            out.append((len(text), sum(b - a for a, b in runs), len(runs), digest.hexdigest(), sum(w for w in words if w > WORDS), runs))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), _SPANS]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *[pa.array([r[j] for r in out], k) for j, k in enumerate(kinds)]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "passage_words", "removed"]
        )


def mark_repeats(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES, most_bytes: int = MOST_BYTES, piece: int = PIECE) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256, passage_words (words in passages) and
    removed ([first, end] in bytes)."""
    shipped(docs.sparkSession)
    docs = own_names(docs, ["doc_id", "text"]).withColumn("text", F.coalesce("text", F.lit("")))
    docs = docs.select("doc_id", F.unhex(F.md5("text")).alias("th"), "text")
    long = docs.filter(F.octet_length("text") >= PASSAGE)
    cuts = F.sequence(F.lit(0), F.floor((F.octet_length("text") - PASSAGE) / piece).cast("int"))
    pieces = long.select("doc_id", "th", F.encode("text", "UTF-8").alias("whole"), F.explode(cuts).alias("piece"))
    pieces = pieces.select("doc_id", "th", "piece", F.expr(f"substring(whole, piece * {piece} + 1, {piece + LENGTH - 1})").alias("text"))
    kept = stored(python_rows(pieces, _anchor_rows, "doc_id long, th binary, piece int, place int, upto int, gram long, wide boolean"), "anchors")
    # Rows of equal texts are the same here, so that their grams count once.
    of_gram = kept.groupBy("gram", "th", "piece").agg(F.min("place").alias("first"), F.max("upto").alias("last"))
    twice = of_gram.groupBy("gram").agg(F.sum(F.when(F.col("last") > F.col("first"), 2).otherwise(1)).alias("n"), F.count("*").alias("texts"), F.min("th").alias("least"))
    # Grams of the same few texts share a bucket, where the regions of a text meet and are one.
    near = F.when(F.col("texts") <= FEW, F.xxhash64("least")).otherwise(F.xxhash64("gram"))
    twice = stored(twice.filter("n > 1").select(F.col("gram").alias("g"), "texts", near.alias("near")), "twice")
    buckets = max(1, (twice.agg(F.sum("texts")).first()[0] or 0) * (2 * LENGTH - GRAM) // bucket_bytes)
    places = kept.join(twice, F.col("gram") == F.col("g"))
    bucket = F.when(F.col("texts") <= FEW, F.pmod("near", F.lit(buckets))).otherwise(F.col("near").bitwiseOR(F.lit(-(2**63))))
    of_piece = places.groupBy("th", "piece").agg(F.min("doc_id").alias("rep"), F.collect_set(F.struct(bucket.alias("bucket"), "place", "upto", "wide")).alias("places"))
    of_piece = of_piece.select(F.col("th").alias("t"), F.col("piece").alias("p"), "rep", "places")
    texts = pieces.join(of_piece, F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("th") == F.col("t")) & (F.col("piece") == F.col("p")))
    schema = "th binary, piece int, bucket long, region long, first long, size long, content binary"
    regions = stored(python_rows(texts.select("th", "piece", "text", "places"), _regions(LENGTH, GRAM, PASSAGE), schema), "regions")

    sizes = stored(regions.groupBy("bucket", "region").agg(F.max("size").alias("size")).groupBy("bucket").agg(F.sum("size").alias("size")), "sizes")
    large = stored(sizes.filter(F.col("size") > most_bytes).select(F.col("bucket").alias("b"), F.ceil(F.col("size") / most_bytes).alias("parts")), "large")
    n_large, total = large.count(), sizes.agg(F.sum("size")).first()[0] or 0
    place = F.struct("th", "piece", "first")
    unique = regions.groupBy("bucket", "region").agg(
        F.first("content", ignorenulls=True).alias("content"), F.min("th").alias("owner"), (F.min("th") < F.max("th")).alias("several"), (F.min(place) < F.max(place)).alias("again")
    )
    # A region of several texts is an owner of its own, told by its hash.
    own = F.encode(F.concat(F.lit("region "), F.col("region").cast("string")), "UTF-8")
    unique = unique.withColumn("owner", F.when(F.col("several"), own).otherwise(F.col("owner")))
    large = small(large, n_large)
    whole = unique.join(large.select("b"), F.col("bucket") == F.col("b"), "left_anti") if n_large else unique
    # Tasks by bytes: sorting takes about a second a megabyte.
    found = whole.repartition(int(total // TASK_BYTES) + 1, "bucket").groupBy("bucket").applyInPandas(_index(LENGTH, PASSAGE), _INDEXED)
    found = stored(found.unionByName(_dealt(unique, large)) if n_large else found, "repeats")
    found = found.filter((F.size("removed") > 0) | (F.size("shared") > 0)).select(F.col("bucket").alias("b"), F.col("region").alias("r"), "removed", "shared")

    where = regions.select("th", "piece", "bucket", "region", "first").join(found, (F.col("bucket") == F.col("b")) & (F.col("region") == F.col("r")))
    at = F.col("first") + F.col("piece").cast("long") * piece
    moved = lambda spans: F.transform(spans, lambda s: F.array(s[0] + at, s[1] + at)).alias(spans)
    where = where.select(F.col("th").alias("t"), moved("removed"), moved("shared"))
    size = F.max(F.octet_length("text")).cast("long")
    all_of_it = F.array(F.array(F.lit(0).cast("long"), F.col("size")))
    copies = long.groupBy(F.col("th").alias("t")).agg(F.count("*").alias("n"), size.alias("size")).filter("n > 1")
    copies = copies.select("t", F.when(F.col("size") >= LENGTH, all_of_it).otherwise(F.array().cast("array<array<bigint>>")).alias("removed"), all_of_it.alias("shared"))
    where = where.unionByName(copies).groupBy("t").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("removed", "shared")])
    where = stored(python_rows(where, _unions, "t binary, removed array<array<bigint>>, shared array<array<bigint>>"), "spans")
    rows, spans = where.agg(F.count("*"), F.coalesce(F.sum(F.size("removed") + F.size("shared")), F.lit(0))).first()
    near = where if 120 * rows + 40 * spans > BROADCAST_BYTES else F.broadcast(where)
    texts = docs.join(near, F.col("th") == F.col("t"), "left").select("doc_id", "text", "removed", "shared")
    return python_rows(texts, _removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, passage_words long, removed array<array<bigint>>")


def op10_run_length_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark_repeats(table(spark, sf_dir, "documents")).drop("removed")
