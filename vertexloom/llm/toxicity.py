"""Toxic passages by maximum-scoring segment search.

Log-odds of tokens between toxic and clean training texts, with a Dirichlet prior from both together, give each
word a score, if its log-likelihood ratio shows that its share isn't chance; words without evidence get the pooled log-odds of all of them, which is a little below zero. One
linear scan finds all maximal-scoring segments of a text. The best segment's score is calibrated as an extreme
value: E = K n exp(-lambda S) for n words, with lambda and K fitted on clean texts; a logistic curve over the
evidence and the number of significant segments gives the text's score. Both are fitted on training texts scored with
log-odds from the other half of them.

Tokens are words of ASCII letters, digits and all other characters, lower-cased in ASCII, and their first 4, 5
and 6 bytes, so that inflected and compounded forms share evidence.

The classifier is fitted on at most ``SAMPLE`` labelled texts of each label, the first by hash, copies once; all
texts are scored whole. Null text is empty and gets the score of no evidence. Labels that are null or whose
document is missing are left out; a document labelled twice, or a text in documents of either label, counts as toxic if
any label says so. Without any training texts of either label all scores are 0. Rows are kept one for one, with null or
repeated ids as they are. Columns of the input that are named like an added one are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import more_columns, own_names, python_rows, shipped, stored, table, text_last
from .textkernel import ALNUM, Words, as_bytes, chunks

#: PRIOR: weight of the prior against the counts. CHANCE: tokens that may be in the lexicon by chance, about. The lexicon has
#: all tokens that pass, which are some of those in the sample.
SAMPLE, PRIOR, CHANCE, MOST = 30_000, 0.1, 20.0, 8.0
PREFIXES = (4, 5, 6)
THRESHOLD = 0.3


def tokens(words: Words) -> list[np.ndarray]:
    """For each kind of token its hash for each word; 0 where the word is too short for it."""
    size = words.ends - words.starts
    out = [words.hashes()]
    for k in PREFIXES:
        out.append(np.where(size >= k, words.hashes(k) ^ np.uint64(k), np.uint64(0)))
    return out


class Model:
    def __init__(self, hashes: np.ndarray, odds: np.ndarray, pooled: float):
        order = np.argsort(hashes)
        self.hashes, self.odds, self.pooled = hashes[order], odds[order], pooled
        self.seen = np.zeros(1 << 20, dtype=bool)
        self.seen[self.hashes & np.uint64((1 << 20) - 1)] = True
        self.scale, self.shift, self.curve = 1.0, 0.0, (-3.0, 1.0, 1.0)

    def word_scores(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Words with evidence and the most of their tokens' log-odds."""
        best = np.full(len(words.starts), -np.inf)
        if len(self.hashes):
            for h in tokens(words):
                maybe = np.flatnonzero(self.seen[h & np.uint64((1 << 20) - 1)])
                at = np.minimum(np.searchsorted(self.hashes, h[maybe]), len(self.hashes) - 1)
                hit = self.hashes[at] == h[maybe]
                best[maybe[hit]] = np.maximum(best[maybe[hit]], self.odds[at[hit]])
        places = np.flatnonzero(best > -np.inf)
        return places, best[places]

    def evidence(self, n: int, top: float) -> float:
        """-ln E of the best segment; nothing below zero."""
        return max(0.0, self.scale * top - self.shift - np.log(max(n, 1))) if top > 0 else 0.0

    def features(self, n: int, segments: list[tuple[int, int, float]]) -> tuple[float, float]:
        strong = sorted((self.evidence(n, s) for _, _, s in segments), reverse=True)
        return min(strong[0], 40.0) / 10 if strong else 0.0, float(np.log1p(sum(e > 3 for e in strong)))

    def score(self, n: int, segments: list[tuple[int, int, float]]) -> float:
        if not len(self.hashes):
            return 0.0
        a, b, c = self.curve
        x, y = self.features(n, segments)
        return float(1 / (1 + np.exp(-(a + b * x + c * y))))


def segments(places: list[int], scores: list[float], pooled: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first word, end, score) of a text in which words at places have scores > 0 and all
    others ``pooled`` < 0: one scan, each candidate is joined to an earlier one at most once."""
    out: list[tuple[int, int, float, float]] = []  # first, end, sum before, sum after
    links: list[int] = []  # nearest earlier candidate with a smaller sum before it
    total, last = 0.0, -1
    for p, s in zip(places, scores, strict=True):
        total += pooled * (p - last - 1)
        first, before, after = p, total, total + s
        total, last = after, p
        while True:
            j = len(out) - 1
            while j >= 0 and out[j][2] >= before:
                j = links[j]
            if j < 0 or out[j][3] >= after:
                out.append((first, p + 1, before, after))
                links.append(j)
                break
            first, before = out[j][0], out[j][2]
            del out[j:], links[j:]
    return [(a, b, r - l) for a, b, l, r in out]


def _found(model: Model, words: Words) -> Iterator[tuple[int, list[tuple[int, int, float]]]]:
    places, scores = model.word_scores(words)
    bounds = np.searchsorted(places, words.first)
    for i in range(len(words.first) - 1):
        lo, hi, start = bounds[i], bounds[i + 1], words.first[i]
        yield int(words.first[i + 1] - start), segments((places[lo:hi] - start).tolist(), scores[lo:hi].tolist(), model.pooled) if hi > lo else []


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of a batch with each token, by half and label; token 0 counts all words."""
    for batch in batches:
        # Columns of the counts: clean and toxic of one half, clean and toxic of the other.
        toxic = np.array(batch.column(0).to_pylist(), dtype=np.int64) + 2 * np.array(batch.column(1).to_pylist(), dtype=np.int64)
        for at, texts in chunks(as_bytes(batch.column(2))):
            words = Words(texts, ALNUM)
            counts = np.diff(words.first)
            label = np.repeat(toxic[at : at + len(texts)], counts)
            text_of = np.repeat(np.arange(len(texts)), counts)
            found, sides = [], []
            for h in tokens(words):
                order = np.lexsort((text_of, h))
                h, t = h[order], text_of[order]
                new = np.ones(len(h), dtype=bool)
                new[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
                new &= h != 0
                found.append(h[new])
                sides.append(label[order][new])
            keys, which = np.unique(np.concatenate(found), return_inverse=True)
            sides = np.concatenate(sides)
            totals = [np.append(np.bincount(which[sides == k], minlength=len(keys)), (label == k).sum()) for k in range(4)]
            keys = np.append(keys, np.uint64(0))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *[pa.array(t.astype(np.int64)) for t in totals]], ["token", "no0", "yes0", "no1", "yes1"])


def _tops(model):
    """Of each text its words and best score, for the extreme values."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = model.value
        for batch in batches:
            ns, tops = [], []
            for _, texts in chunks(as_bytes(batch.column(1))):
                for n, found in _found(held, Words(texts, ALNUM)):
                    ns.append(n)
                    tops.append(max((s for *_, s in found), default=0.0))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ns, pa.int64()), pa.array(tops, pa.float64())], ["toxic", "n", "top"])

    return rows


def _features(model):
    """Of each text the inputs of the logistic curve, over all its segments."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = model.value
        for batch in batches:
            found = [held.features(n, f) for _, texts in chunks(as_bytes(batch.column(1))) for n, f in _found(held, Words(texts, ALNUM))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([x[k] for x in found], pa.float64()) for k in (0, 1)]], ["toxic", "x", "y"])

    return rows


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """From labels (doc_id, toxic) and docs (doc_id, text); the caller leaves out what must not be learned from."""
    spark = docs.sparkSession
    labels = labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("toxic")).dropna().groupBy("id").agg(F.max("toxic").alias("toxic"))
    labels = labels.withColumn("h", F.xxhash64("id", F.lit(5)))
    picked = None
    for label in (0, 1):
        part = labels.filter(F.col("toxic") == label).orderBy("h", "id").limit(sample)
        picked = part if picked is None else picked.unionByName(part)
    own = own_names(docs, ["doc_id", "text"]).filter("text is not null")
    rows = own.join(F.broadcast(picked), F.col("doc_id") == F.col("id"))  # at most 2 * sample rows of three numbers
    rows = rows.groupBy(F.xxhash64("text").alias("th")).agg((F.max("toxic") == 1).alias("toxic"), F.first("text").alias("text"))
    rows = stored(rows, "toxic-sample")
    half = F.pmod(F.col("th"), F.lit(2))
    counted = python_rows(rows.select("toxic", half.alias("half"), "text"), _counts, "token long, no0 long, yes0 long, no1 long, yes1 long")
    counts = stored(counted.groupBy("token").agg(*[F.sum(c).alias(c) for c in ("no0", "yes0", "no1", "yes1")]), "toxic-tokens")
    shipped(spark)
    model = lexicon(counts, F.col("yes0") + F.col("yes1"), F.col("no0") + F.col("no1"))
    if not len(model.hashes):
        return model
    # Each half is scored with the other half's log-odds; a few numbers of each text of the sample come back.
    halves = [lexicon(counts, F.col(f"yes{1 - k}"), F.col(f"no{1 - k}")) for k in (0, 1)]
    tops, inputs = [], []
    for k in (0, 1):
        tops += python_rows(rows.filter(half == k).select("toxic", "text"), _tops(spark.sparkContext.broadcast(halves[k])), "toxic boolean, n long, top double").collect()
    extreme_values(model, tops)
    for k in (0, 1):
        halves[k].scale, halves[k].shift = model.scale, model.shift
        inputs += python_rows(rows.filter(half == k).select("toxic", "text"), _features(spark.sparkContext.broadcast(halves[k])), "toxic boolean, x double, y double").collect()
    curve(model, inputs)
    return model


def lexicon(counts: DataFrame, yes: F.Column, no: F.Column) -> Model:
    """Log-odds of the tokens that are more in toxic texts than chance would have it."""
    counts = counts.select("token", yes.alias("yes"), no.alias("no")).filter("yes + no > 0")
    total = counts.filter("token = 0").first()
    counts = counts.filter("token <> 0")
    kinds, n_yes, n_no = counts.agg(F.count("*"), F.sum("yes"), F.sum("no")).first()
    if total is None or not total.yes or not total.no or not n_yes or not n_no:
        return Model(np.zeros(0, dtype=np.uint64), np.zeros(0), -0.01)
    n_yes, n_no = float(n_yes), float(n_no)
    prior, weight = (F.col("yes") + F.col("no")) * F.lit(PRIOR), PRIOR * (n_yes + n_no)
    y, n = F.col("yes") + prior, F.col("no") + prior
    odds = F.ln(y / (n_yes + weight - y)) - F.ln(n / (n_no + weight - n))
    share = n_yes / (n_yes + n_no)
    part = lambda c, p: F.when(F.col(c) > 0, F.col(c) * F.ln(F.col(c) / ((F.col("yes") + F.col("no")) * p))).otherwise(0.0)
    scored = counts.withColumn("odds", odds).withColumn("ratio", part("yes", share) + part("no", 1 - share))
    found = scored.filter((F.col("odds") > 0) & (F.col("ratio") >= float(np.log(max(kinds / CHANCE, 1.0))))).select("token", "odds", "yes", "no").toArrow()
    token, odds, yes, no = (found.column(k).to_numpy() for k in range(4))
    more = int(yes.sum()) / total.yes - int(no.sum()) / total.no
    pooled = min(-0.01, float(np.log1p(-min(max(more, 0.0), 0.5))))
    return Model(token.astype(np.int64).view(np.uint64), np.minimum(odds, MOST), pooled)


def extreme_values(model: Model, tops: list) -> None:
    """Sets lambda and K from the best scores of clean texts."""
    clean = np.array([(r.n, r.top) for r in tops if not r.toxic and r.n > 0], dtype=float).reshape(-1, 2)
    above = clean[clean[:, 1] > 0]
    if len(above):
        # The tail over the least scores is exponential: its mean gives lambda, its share for the words searched K.
        floor = above[:, 1].min()
        model.scale = 1 / max(0.25, (above[:, 1] - floor).mean())
        model.shift = float(np.log(len(above) / clean[:, 0].sum()) + model.scale * floor)
    else:
        model.scale, model.shift = 1.0, float(-np.log(max(clean[:, 0].sum(), 1.0)))


def curve(model: Model, inputs: list) -> None:
    """Sets the logistic curve, by Newton steps with a ridge; rows are sorted, so that their order can't change it."""
    rows = sorted((r.x, r.y, r.toxic) for r in inputs)
    x = np.array([(1.0, a, b) for a, b, _ in rows])
    y = np.array([t for *_, t in rows], dtype=float)
    if not len(x) or y.min() == y.max():
        return
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(3), x.T @ (y - p) - 0.1 * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    model.curve = tuple(w)


def _scored(model):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = model.value
        for batch in batches:
            scores, passages = [], []
            for _, texts in chunks(as_bytes(batch.column(batch.num_columns - 1))):
                for n, found in _found(held, Words(texts, ALNUM)):
                    scores.append(held.score(n, found))
                    passages.append([[a, b] for a, b, s in found if held.evidence(n, s) > 3])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(scores, pa.float64()), pa.array(passages, pa.list_(pa.list_(pa.int64())))], [*batch.schema.names, "__score", "__passages"]
            )

    return rows


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """docs (text, ...) with __score and __passages: significant segments as [first word, end]."""
    shipped(docs.sparkSession)
    docs = text_last(docs.drop("__score", "__passages"))
    rows = _scored(docs.sparkSession.sparkContext.broadcast(model))
    return python_rows(docs, rows, more_columns(docs, "__score double, __passages array<array<bigint>>"))


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def training_labels(labels: DataFrame) -> DataFrame:
    return own_names(labels, ["doc_id", "toxic"]).filter(~held_out("doc_id"))


def op2_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = own_names(table(spark, sf_dir, "documents"), ["doc_id", "text"])
    scored = score_toxicity(docs, fit(docs, training_labels(table(spark, sf_dir, "labels"))))
    return scored.select(
        "doc_id", held_out("doc_id").alias("held_out"), F.col("__score").alias("score"),
        (F.col("__score") >= THRESHOLD).cast("int").alias("predicted"), F.size("__passages").alias("n_passages"),
    )
