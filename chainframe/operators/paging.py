"""Keyset pages and their cursors."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def keyset_page(df: DataFrame, order: list[str], after: tuple | None, size: int, descending: bool = False) -> DataFrame:
    """Rows strictly after a key, one more than ``size`` so that the caller sees whether another page follows."""
    if after is not None:
        kinds = dict(df.dtypes)
        key, seen = F.struct(*order), F.struct(*(F.lit(v).cast(kinds[c]).alias(c) for c, v in zip(order, after, strict=True)))
        df = df.where(key < seen if descending else key > seen)
    return df.orderBy(*(F.col(c).desc_nulls_last() if descending else F.col(c).asc_nulls_last() for c in order)).limit(size + 1)


def _mark(secret: bytes, body: str) -> str:
    return hmac.new(secret, body.encode(), hashlib.sha256).hexdigest()[:32]


def encode_cursor(view: str, key: tuple, secret: bytes) -> str:
    """A cursor is bound to its view, and only who knows ``secret`` can make one."""
    body = json.dumps([view, list(key)], separators=(",", ":"))
    return base64.urlsafe_b64encode(f"{_mark(secret, body)}{body}".encode()).decode()


def decode_cursor(view: str, cursor: str, secret: bytes) -> tuple:
    try:
        text = base64.urlsafe_b64decode(cursor.encode()).decode()
        mark, body = text[:32], text[32:]
        if not hmac.compare_digest(mark, _mark(secret, body)):
            raise ValueError("forged")
        own, key = json.loads(body)
    except Exception as error:
        raise ValueError("not a cursor") from error
    if own != view:
        raise ValueError("a cursor of another view")
    return tuple(key)
