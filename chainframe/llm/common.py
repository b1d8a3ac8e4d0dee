"""Helpers shared by the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

#: ASCII white space, the separators of ``[^\x20\x09-\x0D]+``.
SPACE = " \t\n\x0b\f\r"
SPACE_RE = "[ \\t-\\r]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one input table; only Spark opens the path, so any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bounds of an Arrow batch between the JVM and a Python worker.
BATCH_ROWS, BATCH_BYTES = 512, 4 << 20


def ready(spark: SparkSession) -> SparkSession:
    """Ship the package and bound the Arrow batches, which the JVM and the worker both hold whole."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return ship(spark)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body`` as a variable.

    A column that is used inside a higher-order function would otherwise be
    evaluated again for every element.
    """
    return F.transform(F.array(value), body)[0]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; set a local one only in tests."""
    from_conf = spark.conf.get("spark.checkpoint.dir", None)
    if from_conf:
        return from_conf
    own = spark.sparkContext.getCheckpointDir()
    if own is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir("/tmp/checkpoints")
        own = spark.sparkContext.getCheckpointDir()
    return own


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage with a copy that survives a lost executor, and the
    reader has no inherited partitioning, so adaptive execution may split
    skewed joins on either side.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


#: The tables that ``written`` has made in this process and nobody has deleted yet.
_WRITTEN: list[str] = []


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def discard(*tables: DataFrame) -> None:
    """Delete written tables that no later step reads."""
    for df in tables:
        _WRITTEN.remove(df._written_to)
        delete(df.sparkSession, df._written_to)


def discard_since(spark: SparkSession, mark: int, *keep: DataFrame) -> None:
    """Delete what was written since ``mark`` = ``written_so_far()`` but for ``keep``; nothing else may read it later."""
    kept = {df._written_to for df in keep}
    made = _WRITTEN[mark:]
    _WRITTEN[mark:] = [path for path in made if path in kept]
    for path in made:
        if path not in kept:
            delete(spark, path)


def written_so_far() -> int:
    return len(_WRITTEN)


def batches_of(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A string column as UTF-8 bytes; null becomes the empty text."""
    column = batch.column(batch.schema.get_field_index(name))
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b"" if x is None else x for x in column.cast(kind).to_pylist()]


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Arrow batches in small pieces, so that a worker holds few texts and results as Python objects."""
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)


_MASK = (1 << 64) - 1


def word_hashes(words: list[bytes], cache: dict[bytes, int], seed: int = 0, most: int = 150_000) -> np.ndarray:
    """64-bit hashes of words; ``cache`` spares repeated ones and is emptied when it has grown to ``most``."""
    if len(cache) > most:
        cache.clear()
    digest = xxhash.xxh3_64_intdigest
    get = cache.get
    out = []
    add = out.append
    for w in words:
        h = get(w)
        if h is None:
            h = cache[w] = digest(w, seed)
        add(h)
    return np.array(out, dtype=np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit words (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base & _MASK, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, min(2 * len(self.up), n + (1 << 18)))
            with np.errstate(over="ignore"):
                for name, b in (("up", self.base), ("down", self.inverse)):
                    steps = np.full(size, b, dtype=np.uint64)
                    steps[0] = 1
                    setattr(self, name, np.multiply.accumulate(steps))
        return self.up, self.down


def window_hashes(values: np.ndarray, width: int, powers: Powers) -> np.ndarray:
    """Polynomial hashes of all runs of ``width`` values, by prefix sums modulo 2**64."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    up, down = powers.upto(len(values) + 1)
    with np.errstate(over="ignore"):
        prefix = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * up[: len(values)], out=prefix[1:])
        return mix64((prefix[width:] - prefix[:-width]) * down[:n])


_POS = np.uint64((1 << 24) - 1)
_PIECE = 1 << 23


def window_anchors(hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The anchor (smallest hash, leftmost of equals) of every run of ``width`` hashes.

    Returns for each run the number of its anchor, and for each anchor its position.
    Equal runs have anchors with equal hashes, whatever surrounds them.
    """
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    if len(hashes) > int(_POS):  # positions are told apart by 24 bits: take the runs piece by piece
        found = [(k, window_anchors(hashes[k : k + _PIECE + width - 1], width)) for k in range(0, n, _PIECE)]
        numbers = np.cumsum([0] + [len(at) for _, (_, at) in found[:-1]])
        return np.concatenate([which + m for m, (_, (which, _)) in zip(numbers, found, strict=True)]), np.concatenate([at + k for k, (_, at) in found])
    index = np.arange(len(hashes), dtype=np.uint64)
    rank = (hashes & ~_POS) | (index & _POS)
    pad = -len(rank) % width
    rows = np.concatenate([rank, np.full(pad, _MASK, dtype=np.uint64)]).reshape(-1, width)
    left = np.minimum.accumulate(rows, axis=1).ravel()
    right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    best = np.minimum(right[:n], left[width - 1 : width - 1 + n])
    new = np.empty(n, dtype=bool)
    new[0] = True
    np.not_equal(best[1:], best[:-1], out=new[1:])
    first = np.flatnonzero(new)
    offset = (best[first].astype(np.int64) - first) & int(_POS)  # the anchor is less than `width` after its first run's start
    return np.cumsum(new) - 1, first + offset
