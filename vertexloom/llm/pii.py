"""Personal data by anchor expansion: Aho-Corasick finds cues, local parsers expand and validate around them.

Cues are at-signs, plus signs, scheme ends, digits and words that announce an account. Each parser moves from
its cue to the boundaries of the item and checks it; a parser never looks further than the item reaches, and
digits inside an item that was just parsed are passed over, so a text costs one scan.

Null text is empty and has no spans. Rows are kept one for one, with null or repeated ids as they are.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import own_names, python_rows, table

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "iban", "account")
#: Words that announce an account number, in the cases they come in.
ACCOUNT_CUES = ("account", "Account", "ACCOUNT", "acct", "Acct", "ACCT", "passport", "Passport", "PASSPORT")
IBAN_CUES = ("IBAN", "iban", "Iban")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Each starts at a given place and ends with the item: no search.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_CHAIN = re.compile(r"[0-9](?:[ -]?[0-9])*")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+")
_URL_TAIL = re.compile(r"[^\s<>\"']+")
_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*\Z")
_IBAN = re.compile(r"[A-Za-z]*[ :#=]{0,3}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)")
_ACCOUNT = re.compile(r"[A-Za-z]*(?: ?(?:no|nr|number|id))?\.?[ :#=]{1,3}([A-Z]{0,2}[0-9]{6,20})(?![0-9A-Za-z])")


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for cue, kind in [("@", "@"), ("+", "+"), ("://", "s"), *[(str(d), "d") for d in range(10)], *[(c, "a") for c in ACCOUNT_CUES], *[(c, "i") for c in IBAN_CUES]]:
        found.add_word(cue, (kind, len(cue)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def iban_valid(text: str) -> bool:
    s = text.replace(" ", "")
    if not 15 <= len(s) <= 34:
        return False
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def find_personal(text: str, cues: ahocorasick.Automaton) -> list[tuple[int, int, int, str]]:
    """(start, order of the kind, end, kind) by start; positions are code points."""
    spans: list[tuple[int, int, int, str]] = []
    add = lambda kind, lo, hi: spans.append((lo, KINDS.index(kind), hi, kind))
    email_end = dotted_end = chain_end = phone_end = url_end = other_end = 0
    for last, (kind, size) in cues.iter(text):
        at = last - size + 1
        if kind == "d":
            if at >= dotted_end:
                m = _DOTTED.match(text, at)
                dotted_end = m.end()
                if m.end() - at >= 7 and m[0].count(".") >= 3:
                    lo, parts = at, m[0].split(".")
                    for k in range(0, len(parts) - 3, 4):
                        hi = lo + sum(map(len, parts[k : k + 4])) + 3
                        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in parts[k : k + 4]):
                            add("ip", lo, hi)
                        lo = hi + 1
            if at >= chain_end:
                m = _CHAIN.match(text, at)
                chain_end = m.end()
                if m.end() - at >= 14:
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 14 <= len(digits) <= 19 and luhn(digits):
                        add("card", at, m.end())
        elif kind == "@":
            lo = at
            while lo > email_end and text[lo - 1] in _LOCAL:
                lo -= 1
            if lo < at and (m := _DOMAIN.match(text, at + 1)):
                email_end = m.end()
                add("email", lo, m.end())
        elif kind == "+":
            if at >= phone_end and (m := _PHONE.match(text, at)):
                hi = m.end()
                while not "0" <= text[hi - 1] <= "9":
                    hi -= 1
                if hi - at >= 4:
                    phone_end = hi
                    if 10 <= sum("0" <= c <= "9" for c in text[at:hi]) <= 15:
                        add("phone", at, hi)
        elif kind == "s":
            if at >= url_end and (m := _SCHEME.search(text, max(url_end, at - 16), at)) and (tail := _URL_TAIL.match(text, last + 1)):
                hi = last + 1 + len(tail[0].rstrip(".,;:!?)]}"))
                if hi > last + 1:
                    url_end = hi
                    add("url", m.start(), hi)
        elif at >= other_end:
            m = (_IBAN if kind == "i" else _ACCOUNT).match(text, last + 1)
            if m and (kind == "a" or iban_valid(m[1])):
                other_end = m.end()
                add("iban" if kind == "i" else "account", m.start(1), m.end(1))
    spans.sort()
    return spans


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cues = automaton()
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        counts: list[list[int]] = [[] for _ in BASE_KINDS]
        digests, joined, personal = [], [], []
        for t in texts:
            spans = find_personal(t.as_py() or "", cues)
            base = ",".join(f"{k}:{a}:{b}" for a, o, b, k in spans if o < len(BASE_KINDS))
            for o, c in enumerate(counts):
                c.append(sum(s[1] == o for s in spans))
            personal.append(sum(s[3] != "url" for s in spans))
            digests.append(hashlib.sha256(base.encode()).hexdigest())
            joined.append(",".join(f"{k}:{a}:{b}" for a, _, b, k in spans))
        yield pa.RecordBatch.from_arrays(
            [ids, *[pa.array(c, pa.int64()) for c in counts], pa.array(digests, pa.string()), pa.array(joined, pa.string()), pa.array(personal, pa.int64())],
            ["doc_id", *[f"n_{k}" for k in BASE_KINDS], "base_sha256", "spans", "n_personal"],
        )


def scan_personal(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): counts by kind, a digest of the base spans, all spans as kind:start:end, and how many of
    these aren't addresses of pages."""
    return python_rows(
        own_names(docs, ["doc_id", "text"]), _rows,
        "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_personal long"
    )


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_personal(table(spark, sf_dir, "documents"))
