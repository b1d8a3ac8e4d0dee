"""String, digest and identifier functions."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value.
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"


def cut_nul(s: Column) -> Column:
    """Up to the first NUL."""
    return F.substring_index(s, "\0", 1)


def canonical_json(**fields: Column) -> Column:
    """Compact JSON with its keys in order."""
    return F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))), {"ignoreNullFields": "false"})


def domain_digest(domain: str, payload: Column) -> Column:
    """SHA-256 over domain, a NUL and the payload, in lower-case hexadecimal."""
    return F.sha2(F.concat(F.lit(domain), F.lit("\0"), payload), 256)


def is_base58(s: Column) -> Column:
    return s.rlike("^[1-9A-HJ-NP-Za-km-z]+$")


def _decode(s: str | None) -> bytes | None:
    if s is None:
        return None
    n = 0
    for c in s:
        at = BASE58.find(c)
        if at < 0:
            return None
        n = n * 58 + at
    return b"\0" * (len(s) - len(s.lstrip("1"))) + n.to_bytes((n.bit_length() + 7) // 8, "big")


def _encode(b: bytes | None) -> str | None:
    if b is None:
        return None
    n, out = int.from_bytes(b, "big"), ""
    while n:
        n, r = divmod(n, 58)
        out = BASE58[r] + out
    return "1" * (len(b) - len(b.lstrip(b"\0"))) + out


def base58_decode(s: Column | str) -> Column:
    @F.pandas_udf("binary")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            yield x.map(_decode)

    return decode(s)


def base58_encode(b: Column | str) -> Column:
    @F.pandas_udf("string")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            yield x.map(lambda v: None if v is None else _encode(bytes(v)))

    return encode(b)


def keyed_random(seed: str, component: str, index: Column) -> Column:
    """The first eight bytes of an HMAC-SHA256 as an unsigned number; equal for equal inputs everywhere.

    The two hashes of the HMAC over the padded key are plain SHA-256.
    """
    key = seed.encode() if len(seed.encode()) <= 64 else hashlib.sha256(seed.encode()).digest()
    pad = lambda x: F.lit(bytes(k ^ x for k in key.ljust(64, b"\0")))
    message = F.encode(F.concat(F.lit(f"{component}\0"), index.cast("long").cast("string")), "utf-8")
    inner = F.unhex(F.sha2(F.concat(pad(0x36), message), 256))
    return F.conv(F.substring(F.sha2(F.concat(pad(0x5C), inner), 256), 1, 16), 16, 10).cast("decimal(20,0)")
