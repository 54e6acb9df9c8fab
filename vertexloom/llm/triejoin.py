"""N-gram Jaccard join with a prefix tree.

Texts become sets of word n-grams (64-bit hashes), and equal sets one class. All sets share a global order, from
rare to common by a count sketch over the whole corpus. Two sets with a Jaccard of at least t share l of the
first n - ceil(t n) + l grams in that order, so that a class has few keys; l grows with a set's size, and of two the lesser holds.
Pairs that share too few keys aren't linked, so that a key that unrelated texts share by chance brings nothing together. First
classes that follow each other by size under enough keys are put together, then groups of these that share enough keys.
Only under a key of more than ``FEW`` classes pairs aren't counted: there, classes of one size are linked
with the least of them, and these are chained by size while the next size isn't too large, so that any pair that could be linked
is within one chain. What meets forms a block. A block's sets go to one task, once, where they are stored in a path-compressed trie, common
grams first. Each set is carried through the trie; overlaps are shared by all sets below a node, and a subtree is
left when the grams still to come can't reach the overlap that its sizes ask for, or when all its sets are linked
with the query already. The links found this way connect exactly the classes that all links would connect.

Blocks of more than ``BLOCK_GRAMS`` grams are cut into parts by size, and by hash within a size that has more; every pair of parts whose sizes allow a link is
a task of its own. No task holds more than two parts.

Null texts and texts without words have no grams and are linked with nothing. A text of fewer words than n is one gram, of
its whole sequence. Rows are kept one for one; those with a null or repeated id keep it, and the component of a
class is its least id (null if it has none). A class is represented by one text of one id, told by the text's hash. Distinct grams and classes are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import apart, own_names, python_rows, shipped, small, stored, table, together
from .components import components
from .sketch import bucket_counts
from .textkernel import NON_SPACE, Words, as_bytes, chunks, shingles

#: The count sketch has a bucket of a byte for each gram of the corpus, about, and 2**SKETCH_BITS at most. Counts are scaled by
#: logarithm, so that common grams stand out in any corpus.
SKETCH_BITS = 25
BLOCK_GRAMS = 1_000_000
#: Classes that a key may have for its pairs to be counted. Where the sketch is full (at 30 GB some 360 grams a bucket) keys of up
#: to 50 classes still look rare.
FEW = 64


def gram_sets(texts: list[bytes], n: int) -> Iterator[np.ndarray]:
    """Each text's distinct n-grams, as sorted hashes."""
    for _, part in chunks(texts):
        words = Words(part, NON_SPACE)
        hashes, first = words.hashes(), words.first
        grams = shingles(hashes, n)
        for i in range(len(part)):
            lo, hi = first[i], first[i + 1]
            if hi - lo >= n:
                yield np.unique(grams[lo : hi - n + 1])
            elif hi > lo:
                yield shingles(hashes[lo:hi], int(hi - lo))
            else:
                yield np.zeros(0, dtype=np.uint64)


def least_shared(n: int, percent: int) -> int:
    """How many keys a set of n grams shares at least with any that it is linked with and that isn't smaller."""
    return max(1, min(1 + min(n // 8, 2 + n // 100), (n * percent + 99) // 100))


def _least_shared(n: str, percent: int):
    """least_shared() of a column."""
    return F.expr(f"greatest(1, least(1 + least({n} div 8, 2 + {n} div 100), ({n} * {percent} + 99) div 100))")


def class_of(grams: np.ndarray) -> int | None:
    return xxhash.xxh3_64_intdigest(grams.tobytes()) - 2**63 if len(grams) else None


def count_sketch(texts: DataFrame, n: int) -> np.ndarray:
    """In how many texts the grams of each hash bucket are, scaled: 32 MB at most, whatever the corpus."""
    grams = (texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 6
    bits = min(SKETCH_BITS, max(16, int(grams).bit_length()))
    return bucket_counts(texts, lambda batch: gram_sets(as_bytes(batch.column(0)), n), bits)


def _prefixes(n: int, percent: int, sketch):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sketch.value
        mask = np.uint64(len(counts) - 1)
        for batch in batches:
            sizes, classes, keys = [], [], []
            for grams in gram_sets(as_bytes(batch.column(2)), n):
                sizes.append(len(grams))
                classes.append(class_of(grams))
                size = len(grams) - -(-len(grams) * percent // 100) + least_shared(len(grams), percent) if len(grams) else 0
                order = np.argsort(counts[grams & mask], kind="stable")[:size]
                keys.append(grams[order].view(np.int64))
            offsets = np.zeros(len(keys) + 1, dtype=np.int32)
            np.cumsum([len(k) for k in keys], out=offsets[1:])
            flat = np.concatenate(keys) if keys else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(classes, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int64()))],
                ["doc_id", "th", "n_shingles", "class", "keys"],
            )

    return rows


def _sets(n: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[int] = set()
            which, grams_out = [], []
            classes = batch.column(1).to_pylist()
            for i, grams in enumerate(gram_sets(as_bytes(batch.column(0)), n)):
                # Another text with the same id and hash would be left out here.
                if class_of(grams) == classes[i] and classes[i] not in seen:
                    seen.add(classes[i])
                    which.append(i)
                    grams_out.append(grams.tobytes())
            keep = pa.array(which, pa.int64())
            columns = [batch.column(i).take(keep) for i in range(1, batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(grams_out, pa.binary())], [*batch.schema.names[1:], "grams"])

    return rows


class _Node:
    __slots__ = ("begin", "end", "rep", "lo", "hi", "below", "ends", "least", "most", "rest")


def linked(sets: list[np.ndarray], percent: int, side: list[int] | None = None) -> list[tuple[int, int]]:
    """Links that connect what all pairs with a Jaccard of percent / 100 or more would; with side, pairs within one
    side are left to another task unless the side is -1."""
    sizes = np.array([len(s) for s in sets])
    total = np.concatenate(sets) if sets else np.zeros(0, dtype=np.uint64)
    _, local, counts = np.unique(total, return_inverse=True, return_counts=True)
    # Common grams first; those of one set alone only count for its size.
    rank = np.empty(len(counts), dtype=np.int64)
    rank[np.argsort(-counts, kind="stable")] = np.arange(len(counts))
    shared = int((counts > 1).sum())
    ranks, at = [], 0
    for s in sets:
        r = np.sort(rank[local[at : at + len(s)]])
        ranks.append(r[: np.searchsorted(r, shared)])
        at += len(s)
    order = sorted(range(len(sets)), key=lambda i: ranks[i].astype(">i4").tobytes())
    ranks, sizes = [ranks[i] for i in order], sizes[order]
    sides = np.array([side[i] for i in order]) if side else None

    def common(a: np.ndarray, b: np.ndarray) -> int:
        m = min(len(a), len(b))
        differ = np.flatnonzero(a[:m] != b[:m])
        return int(differ[0]) if len(differ) else m

    m = len(ranks)
    lcp = [0, *(common(ranks[i - 1], ranks[i]) for i in range(1, m))]
    lengths = np.array([len(r) for r in ranks])

    def node(begin: int, end: int, lo: int) -> _Node:
        x = _Node()
        x.begin, x.end, x.rep, x.lo, x.hi, x.below, x.ends = begin, end, lo, lo, m, [], []
        return x

    # A stack of open nodes along the last set's path; a node ends at the depth where its sets part.
    root = node(0, 0, 0)
    stack = [root]
    for i in range(m):
        depth = lcp[i]
        last = None
        while stack[-1].end > depth:
            last = stack.pop()
            last.hi = i
        if stack[-1].end < depth:  # the sets part inside the node just closed: cut it
            upper = node(last.begin, depth, last.lo)  # its sets begin with those of the lower part
            stack[-1].below[-1] = upper
            last.begin = depth
            upper.below.append(last)
            stack.append(upper)
        if len(ranks[i]) > depth:
            x = node(depth, len(ranks[i]), i)
            stack[-1].below.append(x)
            stack.append(x)
        stack[-1].ends.append(i)
    todo, every = [root], []
    while todo:
        x = todo.pop()
        every.append(x)
        part = slice(x.lo, x.hi)
        x.least, x.most = int(sizes[part].min(initial=1 << 60)), int(sizes[part].max(initial=0))
        x.rest = int(lengths[part].max(initial=0)) - x.end
        todo += x.below

    label = np.arange(m)
    marked = np.zeros(max(1, shared), dtype=np.int64)
    out = []
    for q in range(m):
        mine, size = ranks[q], int(sizes[q])
        if not len(mine):
            continue
        marked[mine] = 1
        todo = [(root, 0)]
        while todo:
            x, overlap = todo.pop()
            if x.hi <= q + 1 or x.most * 100 < size * percent or size * 100 < x.least * percent:
                continue
            from_ = max(x.lo, q + 1)
            if (label[from_ : x.hi] == label[q]).all():
                continue
            if x.end > x.begin:
                segment = ranks[x.rep][x.begin : x.end]
                overlap += int(marked[segment].sum())
                # The query's grams beyond this rank are the most that can still be shared.
                left = len(mine) - int(np.searchsorted(mine, segment[-1], side="right"))
            else:
                left = len(mine)
            if (overlap + min(left, x.rest)) * (100 + percent) < percent * (size + max(x.least, -(-size * percent // 100))):
                continue
            for j in x.ends:
                if j > q and label[j] != label[q] and (sides is None or sides[j] != sides[q] or sides[j] < 0):
                    if overlap * (100 + percent) >= percent * (size + int(sizes[j])):
                        out.append((order[q], order[j]))
                        label[label == label[j]] = label[q]
            todo += [(y, overlap) for y in x.below]
        marked[mine] = 0
    return out


def _join_blocks(percent: int):
    def rows(pdf):
        import pandas as pd

        found = []
        pdf = pdf.drop_duplicates(["class", "pair"])
        for _, block in pdf.groupby(["block", "pair"], sort=False):
            sets = [np.frombuffer(g, dtype=np.uint64) for g in block["grams"]]
            pair = block["pair"].iloc[0]
            side = None if pair < 0 or block["alone"].iloc[0] else block["part"].tolist()
            classes = block["class"].to_numpy()
            found += [(int(classes[a]), int(classes[b])) for a, b in linked(sets, percent, side)]
        return pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    return rows


def _chained(keyed: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that bring together all classes of a key whose sizes allow a link."""
    # Counts and chains are of sizes, not of classes, so that no task holds all classes of a key.
    heads = stored(keyed.groupBy("key", "size").agg(F.min("class").alias("head"), F.count("*").alias("n")), "heads")
    chain = Window.partitionBy("key").orderBy("size")
    near = heads.withColumn("before", F.lag("head").over(chain)).withColumn("smaller", F.lag("size").over(chain))
    near = near.filter(F.col("smaller") * 100 >= F.col("size") * percent).select(F.col("before").alias("a"), F.col("head").alias("b"))
    alike = heads.filter("n > 1").select(F.col("key").alias("k"), F.col("size").alias("z"), "head")
    alike = keyed.join(alike, (F.col("key") == F.col("k")) & (F.col("size") == F.col("z"))).select(F.col("head").alias("a"), F.col("class").alias("b"))
    return near.unionByName(alike)


def _counted(keyed: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that bring together all classes whose sizes allow a link and that share as many keys as linked ones do at least.

    A key has FEW classes at most here.
    """
    follow = Window.partitionBy("key").orderBy("size", "class")
    near = keyed.select("class", "size", F.lag("class").over(follow).alias("a"), F.lag("size").over(follow).alias("smaller"))
    near = near.filter(F.col("smaller") * 100 >= F.col("size") * percent).groupBy("a", F.col("class").alias("b"))
    near = near.agg(F.count("*").alias("n"), F.min("smaller").alias("z")).filter(F.col("n") >= _least_shared("z", percent)).select("a", "b")
    near = stored(near, "near")
    groups = stored(components(near), "groups")
    # Under each key the groups there, with the sizes that they have there; the pairs of these, counted over all keys.
    own = keyed.join(small(groups, groups.count()), F.col("class") == F.col("node"), "left").select("key", "size", F.coalesce("component", "class").alias("g"))
    own = own.repartition("key").groupBy("key", "g").agg(F.min("size").alias("least"), F.max("size").alias("most"))
    sides = own.groupBy("key").agg(F.collect_list(F.struct("g", "least", "most")).alias("all")).filter(F.size("all") > 1).select("all")
    pairs = sides.select(F.explode("all").alias("x"), "all").select("x", F.explode("all").alias("y")).filter("x.g < y.g")
    pairs = pairs.filter((F.col("x.most") * 100 >= F.col("y.least") * percent) & (F.col("y.most") * 100 >= F.col("x.least") * percent))
    pairs = pairs.select(F.col("x.g").alias("a"), F.col("y.g").alias("b"), F.least("x.least", "y.least").alias("z"))
    pairs = pairs.groupBy("a", "b").agg(F.count("*").alias("n"), F.min("z").alias("z")).filter(F.col("n") >= _least_shared("z", percent))
    return near.unionByName(pairs.select("a", "b"))


def jaccard_components(docs: DataFrame, n: int, percent: int, block_grams: int = BLOCK_GRAMS) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_shingles, class, component_id."""
    spark = docs.sparkSession
    shipped(spark)
    docs = own_names(docs, ["doc_id", "text"])
    sketch = spark.sparkContext.broadcast(count_sketch(docs.select("text"), n))
    docs = docs.withColumn("th", F.xxhash64("text"))
    schema = "doc_id long, th long, n_shingles long, class long, keys array<long>"
    rows = stored(python_rows(docs.select("doc_id", "th", "text"), _prefixes(n, percent, sketch), schema), "grams")
    # One row a class; equal sets have equal keys.
    classes = rows.filter("class is not null").groupBy("class").agg(
        F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "th")).alias("rep"), F.max("n_shingles").alias("size"), F.first("keys").alias("keys")
    )
    classes = stored(classes, "classes")
    keyed = classes.select("class", "size", F.explode("keys").alias("key"))
    # A key of two classes brings them together only if their sizes allow a link; most that are shared by chance go here.
    shared = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("size").alias("least"), F.max("size").alias("most"))
    shared = shared.filter((F.col("n") > 2) | (F.col("n") == 2) & (F.col("least") * 100 >= F.col("most") * percent))
    shared = stored(shared.select(F.col("key").alias("k"), "n"), "keys")
    keyed = stored(keyed.join(shared, F.col("key") == F.col("k")).select("class", "size", "key", "n"), "keyed")
    links = _chained(keyed.filter(F.col("n") > FEW), percent).unionByName(_counted(keyed.filter(F.col("n") <= FEW), percent))
    blocks = components(links.filter("a <> b").distinct())
    members = classes.select("class", "rep", "size").join(blocks, F.col("class") == F.col("node")).select("class", "rep", "size", F.col("component").alias("block"))
    members = stored(members, "blocks")

    large = stored(members.groupBy("block").agg(F.sum("size").alias("grams")).filter(F.col("grams") > block_grams).select(F.col("block").alias("of")), "large")
    n_large = large.count()
    parts = members.withColumn("part", F.lit(0).cast("long"))
    if n_large:
        # Parts of the few large blocks, from the grams of each size.
        cells = members.join(small(large, n_large), F.col("block") == F.col("of"), "left_semi").groupBy("block", "size").agg(F.sum("size").alias("grams"))
        upto = F.sum("grams").over(Window.partitionBy("block").orderBy("size"))
        cells = cells.withColumn("first", F.floor((upto - F.col("grams")) / block_grams)).withColumn("splits", F.ceil(F.col("grams") / block_grams))
        cells = stored(cells.select(F.col("block").alias("of"), F.col("size").alias("z"), "first", "splits"), "cells")
        parts = members.join(small(cells, cells.count()), (F.col("block") == F.col("of")) & (F.col("size") == F.col("z")), "left")
        split = F.when(F.col("splits") > 1, 1 + F.pmod(F.xxhash64("class"), F.col("splits"))).otherwise(0)
        parts = parts.withColumn("part", F.coalesce(F.col("first") * (1 << 24) + split, F.lit(0)).cast("long")).drop("of", "z", "first", "splits")
    parts = stored(parts, "parts")
    ranges = parts.groupBy("block", "part").agg(F.min("size").alias("least"), F.max("size").alias("most"), F.sum("size").alias("grams"))
    ranges = stored(ranges, "ranges")
    n_ranges, all_grams = ranges.agg(F.count("*"), F.coalesce(F.sum("grams"), F.lit(0))).first()
    # Pairs of parts, each with itself too, whose sizes allow a link. A block of one part is the pair (0, 0).
    a, b = ranges.alias("a"), ranges.alias("b")
    pairs = a.join(b, (F.col("a.block") == F.col("b.block")) & (F.col("a.part") <= F.col("b.part")) & (F.col("a.most") * 100 >= F.col("b.least") * percent))
    pairs = pairs.select(F.col("a.block").alias("of"), F.col("a.part").alias("p"), F.col("b.part").alias("q"))
    pairs = pairs.withColumn("at", F.explode(F.array_distinct(F.array("p", "q"))))
    pairs = stored(pairs, "pairs")

    # Blocks of one part share tasks; a pair of parts has its own. Tasks are known before the sets are made, so
    # that these move once.
    tasks = max(1, int(all_grams) // block_grams)
    pair = F.when(F.col("q") == 0, F.lit(-1).cast("long")).otherwise(F.shiftrightunsigned(F.xxhash64("p", "q"), 1))
    task = F.when(F.col("q") == 0, F.pmod(F.xxhash64("of"), F.lit(tasks))).otherwise(F.xxhash64("of", pair).bitwiseOR(F.lit(-(2**63))))
    pairs = pairs.select("of", "at", F.struct(task.alias("task"), pair.alias("pair"), (F.col("p") == F.col("q")).alias("alone")).alias("to"))
    pairs = pairs.groupBy("of", "at").agg(F.collect_list("to").alias("to"))
    wanted = parts.join(small(pairs, n_ranges), (F.col("block") == F.col("of")) & (F.col("part") == F.col("at")))
    wanted = stored(wanted.select(F.col("class").alias("c"), "rep", "block", "part", "to"), "wanted")
    represents = F.col("doc_id").eqNullSafe(F.col("rep.doc_id")) & (F.col("th") == F.col("rep.th"))
    texts = docs.join(small(wanted, members.count()), represents).select("text", F.col("c").alias("class"), "block", "part", "to")
    schema = "class long, block long, part long, to array<struct<task:bigint,pair:bigint,alone:boolean>>, grams binary"
    sets = python_rows(texts, _sets(n), schema).select("class", "block", "part", "grams", F.explode("to").alias("to")).select("*", "to.*").drop("to")
    found = sets.groupBy("task").applyInPandas(_join_blocks(percent), "a long, b long")
    found = components(stored(found, "links"))

    ids = classes.join(found, F.col("class") == F.col("node"), "left").select("class", "least", F.coalesce("component", "class").alias("root"))
    least = ids.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = ids.join(least.withColumnRenamed("root", "r"), F.col("root") == F.col("r")).select(F.col("class").alias("c"), "component_id")
    out = rows.join(ids, F.col("class") == F.col("c"), "left")
    return out.select("doc_id", "n_shingles", "class", F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each component: that with the least id. Where ids are null or repeated, it is the
    first row that comes. Texts without words all stay."""
    needed = ["doc_id", "text"]
    named = apart(docs, needed)
    rows, ids = docs.agg(F.count("*"), F.count_distinct("doc_id")).first()
    if rows != ids:
        named = stored(named.withColumn("rid", F.monotonically_increasing_id()), "numbered")
    key = "doc_id" if rows == ids else "rid"
    found = jaccard_components(named.select(F.col(key).cast("long").alias("doc_id"), "text"), n, percent)
    gone = stored(found.filter("doc_id <> component_id").select(F.col("doc_id").alias("gone")), "copies")
    out = named.join(small(gone, gone.count()), F.col(key).cast("long") == F.col("gone"), "left_anti")
    return together(out, needed, docs.columns)


def op4_jaccard_trie_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), 3, 90).select("doc_id", "n_shingles", "component_id")
