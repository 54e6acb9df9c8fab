"""Checksummed text form of ids (Bech32m of BIP-350), vectorised over Arrow batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..runtime import shipped

#: Fixed values of the published scheme.
ALPHABET = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"
GENERATOR = (0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)
CONSTANT = 0x2BC830A3
PREFIXES = {"galactic": "g3d1", "index": "i3d1", "route": "r3d1", "cell": "cx3d"}


def _polymod(values) -> int:
    check = 1
    for v in values:
        top, check = check >> 25, (check & 0x1FFFFFF) << 5 ^ v
        for i, g in enumerate(GENERATOR):
            check ^= g if top >> i & 1 else 0
    return check


def _expanded(prefix: str) -> list[int]:
    return [ord(c) >> 5 for c in prefix] + [0] + [ord(c) & 31 for c in prefix]


def _regroup(values, have: int, want: int, pad: bool) -> list[int] | None:
    held = bits = 0
    out = []
    for v in values:
        held, bits = held << have | v, bits + have
        while bits >= want:
            bits -= want
            out.append(held >> bits & (1 << want) - 1)
    if pad and bits:
        out.append(held << want - bits & (1 << want) - 1)
    elif not pad and (bits >= have or held << want - bits & (1 << want) - 1):
        return None
    return out


def encode(prefix: str, payload: bytes) -> str:
    data = _regroup(payload, 8, 5, True)
    check = _polymod([*_expanded(prefix), *data, 0, 0, 0, 0, 0, 0]) ^ CONSTANT
    return prefix + "1" + "".join(ALPHABET[v] for v in [*data, *(check >> 5 * (5 - i) & 31 for i in range(6))])


def decode(prefix: str, text: str, size: int) -> bytes | None:
    """None for a wrong prefix, character, checksum or length."""
    if text != text.lower() and text != text.upper():
        return None
    head, _, tail = text.lower().rpartition("1")
    if head != prefix or len(tail) < 6 or any(c not in ALPHABET for c in tail):
        return None
    values = [ALPHABET.index(c) for c in tail]
    if _polymod(_expanded(prefix) + values) != CONSTANT:
        return None
    out = _regroup(values[:-6], 5, 8, False)
    return bytes(out) if out is not None and len(out) == size else None


def bech32m(prefix: str, payload: Column) -> Column:
    """Text of a binary column."""
    shipped()

    @F.pandas_udf("string")
    def encoded(values: pd.Series) -> pd.Series:
        return values.map(lambda b: None if b is None else encode(prefix, bytes(b)))

    return encoded(payload)


def bech32m_decode(prefix: str, text: Column, size: int) -> Column:
    shipped()

    @F.pandas_udf("binary")
    def decoded(values: pd.Series) -> pd.Series:
        return values.map(lambda t: None if t is None else decode(prefix, t, size))

    return decoded(text)


def key_text(prefix: str, key: Column) -> Column:
    """Text of a BIGINT key, as its eight bytes, highest first."""
    return bech32m(prefix, F.unhex(F.lpad(F.hex(key), 16, "0")))
