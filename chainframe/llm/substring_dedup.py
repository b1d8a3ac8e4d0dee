"""Substring dedup on word windows, with a count-min prefilter.

Rows with equal texts are told by SHA-256 first: all but those with the
smallest id lose every word (if they have 50), and only that one goes on.
Pass one gives every partition a sketch of window counts.  A window is counted
through its anchor, the 25-word gram with the smallest hash inside it: equal
windows have equal anchors, so a repeated window always has a repeated anchor,
and neighbouring windows share one.  Merged sketches only overestimate.  Pass
two writes the windows whose anchor is estimated repeated, with a 128-bit
fingerprint, groups them exactly and finds the smallest document of each; none
is lost.

Rows are told apart by document id and text.  Ids are integers.  Defined
cases: null text has no words; a null id counts as larger than any other; rows
with equal ids never remove each other's words; a text may be as long as a row
can be; an empty table gives an empty result.  Only the id and text columns are
read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Powers, batches_of, discard, mix64, sliced, window_anchors, window_hashes, word_hashes, written
from .sketch import CELLS_SCHEMA, Membership, cell_of, membership, partial_sketch, repeated_filter

WINDOW = 50
GRAM = 25
_LAST = (1 << 63) - 1
_BASES = (0x5851F42D4C957F2D, 0x14057B7EF767814F, 0x2545F4914F6CDD1D)
_OTHER = np.uint64(0x9E3779B97F4A7C15)
_FLUSH = 1 << 19


def _keyed(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    doc = F.coalesce(F.col(id_col), F.lit(_LAST)).alias("doc")
    return documents.select(doc, F.sha2(text, 256).alias("sha"), text.alias("text"), F.col(id_col).alias("id")).withColumn("row", F.xxhash64("sha"))


def _firsts(keyed: DataFrame) -> Membership:
    """A bitmap of the rows with the smallest id of their text: whatever it does not list is a later copy."""
    cells = written(keyed.groupBy("sha").agg(F.min("doc").alias("doc")).select(cell_of("sha", "doc").alias("cell")), "substring-copies")
    found = membership(cells)
    discard(cells)
    return found


def _anchored(words: list[bytes], cache: dict, powers: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, the anchor number of every window, and the anchors' gram hashes."""
    h = word_hashes(words, cache)
    grams = window_hashes(h, GRAM, powers)
    which, at = window_anchors(grams, WINDOW - GRAM + 1)
    return h, which, grams[at]


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache: dict = {}
    powers, held, n = Powers(_BASES[0]), [], 0

    def flush() -> pa.RecordBatch:
        cell, count = partial_sketch(np.concatenate(held))
        return pa.RecordBatch.from_arrays([pa.array(cell), pa.array(count)], ["cell", "n"])

    for batch in sliced(batches):
        for text in batches_of(batch, "text"):
            words = text.split()
            if len(words) >= WINDOW:
                held.append(_anchored(words, cache, powers)[2])
                n += len(held[-1])
        if n >= _FLUSH:
            yield flush()
            held, n = [], 0
    if held:
        yield flush()


def repeated_windows(keyed: DataFrame, firsts: Broadcast) -> DataFrame:
    """(h1, h2, doc, row, pos) of all windows of first copies whose anchor is estimated repeated."""

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(firsts.value.may_contain(batch.column("cell").to_numpy())))

    rows = keyed.select("doc", "row", "text", cell_of("sha", "doc").alias("cell"))
    found = repeated_filter(rows.select("text", "cell").mapInArrow(lambda b: _sketches(chosen(b)), CELLS_SCHEMA), "substring-sketch")
    shared = keyed.sparkSession.sparkContext.broadcast(found)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        gram_powers, powers = Powers(_BASES[0]), (Powers(_BASES[1]), Powers(_BASES[2]))
        for batch in sliced(chosen(batches)):
            docs, rows, out = batch.column("doc").to_pylist(), batch.column("row").to_pylist(), []
            for doc, row, text in zip(docs, rows, batches_of(batch, "text"), strict=True):
                words = text.split()
                if len(words) < WINDOW:
                    continue
                h, which, anchors = _anchored(words, cache, gram_powers)
                pos = np.flatnonzero(shared.value.may_repeat(anchors)[which])
                if len(pos):
                    a, b = window_hashes(h, WINDOW, powers[0])[pos], window_hashes(mix64(h ^ _OTHER), WINDOW, powers[1])[pos]
                    out.append((a, b, np.full(len(pos), doc), np.full(len(pos), row), pos))
            if out:
                a, b, d, r, p = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(d), pa.array(r), pa.array(p.astype(np.int32))], ["h1", "h2", "doc", "row", "pos"])

    return rows.mapInArrow(emit, "h1 long, h2 long, doc long, row long, pos int")


def covered_starts(keyed: DataFrame, firsts: Broadcast) -> DataFrame:
    """Per first copy the sorted starts of windows that also start in a smaller document."""
    windows = written(repeated_windows(keyed, firsts), "substring-windows")
    smallest = windows.groupBy("h1", "h2").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").select("h1", "h2", "first")
    # written, so that adaptive execution may split a window that very many documents hold
    smallest = written(smallest, "substring-first")
    found = windows.join(smallest, ["h1", "h2"]).where("doc > first")
    starts = written(found.groupBy("doc", "row").agg(F.sort_array(F.collect_set("pos")).alias("starts")), "substring-starts")
    discard(windows, smallest)
    return starts


def _with_kept(documents: DataFrame, id_col: str, text_col: str, schema: str, make: Callable[[pa.RecordBatch, list], pa.RecordBatch]) -> DataFrame:
    """``make`` applied to rows with a mask of kept words each: None keeps all, an empty one none.

    Only texts that lose some of their words are shuffled.
    """
    keyed = _keyed(documents, id_col, text_col)
    context = documents.sparkSession.sparkContext
    firsts = context.broadcast(_firsts(keyed))
    starts = covered_starts(keyed, firsts)
    touched = context.broadcast(membership(starts.select(cell_of("doc", "row").alias("cell"))))
    rows = keyed.select("doc", "row", "id", "text", cell_of("sha", "doc").alias("copy"), cell_of("doc", "row").alias("cell"))

    def split(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        first = firsts.value.may_contain(batch.column("copy").to_numpy())
        return first, first & touched.value.may_contain(batch.column("cell").to_numpy())

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            first, meets = split(batch)
            own = batch.filter(pa.array(~meets))
            yield make(own, [None if f else [] for f in first[~meets].tolist()])

    def meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.select(["doc", "row", "id", "text"]).filter(pa.array(split(batch)[1]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            yield make(batch, batch.column("starts").to_pylist())

    kind = documents.schema[id_col].dataType.simpleString()
    joined = rows.mapInArrow(meeting, f"doc long, row long, id {kind}, text string").join(starts, ["doc", "row"], "left").select("id", "text", "starts")
    return rows.mapInArrow(alone, schema).union(joined.mapInArrow(cut, schema))


def kept_mask(n_words: int, starts: list[int] | None) -> np.ndarray:
    edge = np.zeros(n_words + 1, dtype=np.int64)
    if starts:
        at = np.asarray(starts)
        np.add.at(edge, at, 1)
        np.add.at(edge, np.minimum(at + WINDOW, n_words), -1)
    return np.cumsum(edge[:-1]) == 0


def _kept(words: list[bytes], starts: list[int] | None) -> list[bytes]:
    """``starts`` as ``_with_kept`` passes them."""
    if starts is None or len(words) < WINDOW:
        return words
    return [w for w, k in zip(words, kept_mask(len(words), starts).tolist(), strict=True) if k] if starts else []


def remove_repeats(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_only: bool = False) -> DataFrame:
    """id, n_words, n_removed and the kept words, joined by one space (or their SHA-256)."""
    last = "kept_sha256" if digest_only else "text"

    def make(batch: pa.RecordBatch, masks: list) -> pa.RecordBatch:
        total, removed, kept = [], [], []
        for text, starts in zip(batches_of(batch, "text"), masks, strict=True):
            words = text.split()
            rest = _kept(words, starts)
            total.append(len(words))
            removed.append(len(words) - len(rest))
            joined = b" ".join(rest)
            kept.append(hashlib.sha256(joined).hexdigest() if digest_only else joined.decode())
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["id", "n_words", "n_removed", last])

    kind = documents.schema[id_col].dataType.simpleString()
    return _with_kept(documents, id_col, text_col, f"id {kind}, n_words long, n_removed long, {last} string", make).withColumnRenamed("id", id_col)


def digest(documents: DataFrame) -> DataFrame:
    """The query's columns; the digest is taken where the words are, so that kept texts need not travel."""
    return remove_repeats(documents, digest_only=True)
