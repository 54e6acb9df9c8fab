"""Secret scans with linking of parts of a credential; DataFrame operations only.

Strong spans come from three patterns. Weak candidates (access identifiers, secrets, endpoints) are too common
to report alone: an interval join reports one only where another part of a complementary role, strong or weak, lies within
``GAP`` characters in the same text without overlapping it. A candidate that overlaps a strong span is that span's. The
joins' keys are text and position range, so that a very long text is dealt out over many tasks.

Null text is empty and has no spans. Rows are kept one for one, with null or repeated ids as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import own_names, stored, table

#: Fixed patterns: kind, pattern, the group whose length counts, its least length, role.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
STRONG = [
    ("assign", ASSIGN, 2, 12, "secret"),
    ("access", r"AKIA[A-Z0-9]{14,}", 0, 18, "id"),
    ("hex", r"[0-9a-f]{16,}", 0, 16, "secret"),
]
#: Weak kinds: kind, pattern, group that must be long enough, its least length, role, roles that complete it. A token is a secret
#: by its looks alone; one beside an endpoint isn't enough for either.
WEAK = [
    ("link_id", r"""(?i)(client_?id|account_?id|access_?key_?id|user_?name|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]+)""", 2, 3, "id", ["secret", "token"]),
    ("link_secret", r"(?<![A-Za-z0-9+/=_-])(?=[A-Za-z0-9+/=_-]*[0-9])(?=[A-Za-z0-9+/=_-]*[A-Z])(?=[A-Za-z0-9+/=_-]*[a-z])[A-Za-z0-9+/=_-]{20,}", 0, 20, "token", ["id"]),
    ("link_endpoint", r"""(?i)(?:https?|ftp|s3|postgres(?:ql)?|mysql|mongodb|redis|amqps?)://[^\x20\x09-\x0D"'<>]+""", 0, 8, "endpoint", ["id", "secret"]),
]
GAP = 256
BIN = 512
#: Matches whose starts are summed up together.
BLOCK = 256
_SPAN = "array<struct<start:bigint,ord:int,end:bigint,kind:string>>"


def spans_of(text: F.Column, ord_: int, kind: str, pattern: str, group: int, least: int) -> F.Column:
    """Leftmost non-overlapping matches, in code points; those with a shorter group are dropped, without a retry.

    Starts are running sums over the pieces between matches and the matches. An array grows by copying, so that sums run
    within blocks of ``BLOCK`` matches first, then over blocks.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    counted = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    # The pieces beyond the last match have no use.
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("p"), found.alias("m"), counted.alias("g"))
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(_SPAN).alias("out"))

    def step(acc, x):
        start = acc["at"] + F.length(x["p"])
        end = start + F.coalesce(F.length(x["m"]), F.lit(0))
        span = F.struct(start.alias("start"), F.lit(ord_).alias("ord"), end.alias("end"), F.lit(kind).alias("kind"))
        more = F.when(F.length(x["g"]) >= least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"])
        return F.struct(end.cast("bigint").alias("at"), more.cast(_SPAN).alias("out"))

    def blocks(parts):
        at = F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / BLOCK).cast("int"))
        return F.transform(at, lambda b: F.aggregate(F.slice(parts, b * BLOCK + 1, F.lit(BLOCK)), zero, step))

    def moved(done):
        none = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("all"))
        before = F.aggregate(done, none, lambda a, b: F.struct((a["at"] + b["at"]).alias("at"), F.concat(a["all"], F.array(a["at"])).alias("all")))["all"]
        shift = lambda s, by: F.struct((s["start"] + by).alias("start"), s["ord"].alias("ord"), (s["end"] + by).alias("end"), s["kind"].alias("kind"))
        return F.flatten(F.transform(F.arrays_zip(done.alias("done"), before.alias("by")), lambda x: F.transform(x["done"]["out"], lambda s: shift(s, x["by"]))))

    # A lambda over an array of one names a value that is used often, and computes it once.
    whole = F.transform(F.array(parts), lambda v: F.transform(F.array(blocks(v)), moved)[0])[0]
    return F.when(F.regexp_like(text, F.lit(pattern)), whole).otherwise(F.array().cast(_SPAN))


def as_text(spans: F.Column) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, strong and linked, both arrays of (start, ord, end, kind) by start."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select("doc_id", text.alias("text"), *[spans_of(text, i, k, p, g, n).alias(k) for i, (k, p, g, n, _) in enumerate(STRONG)])
    strong = F.array_sort(F.concat(*[F.col(k) for k, *_ in STRONG]))
    found = found.select("doc_id", "text", strong.alias("strong"))
    weak = F.concat(*[spans_of(F.col("text"), len(STRONG) + i, k, p, g, n) for i, (k, p, g, n, *_) in enumerate(WEAK)])
    rows = stored(found.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "strong", weak.alias("weak")), "secrets")

    bins = lambda lo, hi: F.explode(F.sequence(F.floor(lo / BIN), F.floor(hi / BIN))).alias("bin")
    role = F.create_map(*[F.lit(x) for k, _, _, _, r, *_ in STRONG + WEAK for x in (k, r)])
    one = lambda of, to: rows.select("rid", F.explode(of).alias(to))
    held = one("strong", "s").select("rid", F.col("s.start").alias("lo"), F.col("s.end").alias("hi"), role[F.col("s.kind")].alias("role"))
    weak = one("weak", "w").alias("l")
    # Which candidates overlap a strong span.
    left = one("weak", "w").select("*", bins(F.col("w.start"), F.col("w.end") - 1)).alias("l")
    right = held.select("*", bins(F.col("lo"), F.col("hi") - 1)).alias("r")
    on = (F.col("l.rid") == F.col("r.rid")) & (F.col("l.bin") == F.col("r.bin"))
    known = left.join(right, on & (F.col("r.lo") < F.col("l.w.end")) & (F.col("r.hi") > F.col("l.w.start"))).select("l.rid", "w").distinct().alias("k")
    free = stored(weak.join(known, (F.col("l.rid") == F.col("k.rid")) & (F.col("l.w") == F.col("k.w")), "left_anti"), "weak")
    # Of the others those with a part nearby that completes them.
    parts = held.unionByName(free.select("rid", F.col("w.start").alias("lo"), F.col("w.end").alias("hi"), role[F.col("w.kind")].alias("role")))
    needs = F.create_map(*[x for k, _, _, _, _, r in WEAK for x in (F.lit(k), F.array(*map(F.lit, r)))])
    left = free.select("*", needs[F.col("w.kind")].alias("needs"), bins(F.col("w.start") - GAP, F.col("w.end") + GAP)).alias("l")
    right = parts.select("*", bins(F.col("lo"), F.col("hi"))).alias("r")
    near = (F.col("r.lo") <= F.col("l.w.end") + GAP) & (F.col("r.hi") >= F.col("l.w.start") - GAP)
    apart = (F.col("r.lo") >= F.col("l.w.end")) | (F.col("r.hi") <= F.col("l.w.start"))
    linked = left.join(right, on & near & apart & F.array_contains("l.needs", F.col("r.role"))).select(F.col("l.rid").alias("rid"), "w").distinct()
    linked = linked.groupBy(F.col("rid").alias("linked_rid")).agg(F.array_sort(F.collect_list("w")).alias("linked"))
    out = rows.join(linked, F.col("rid") == F.col("linked_rid"), "left")
    return out.select("doc_id", "strong", F.coalesce("linked", F.array().cast(_SPAN)).alias("linked"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(own_names(table(spark, sf_dir, "documents"), ["doc_id", "text"]))
    n = lambda kind: F.size(F.filter("strong", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", n("assign"), n("access"), n("hex"), F.sha2(as_text(F.col("strong")), 256).alias("base_sha256"),
        as_text(F.array_sort(F.concat("strong", "linked"))).alias("spans"),
    )
