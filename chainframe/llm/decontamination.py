"""Benchmark decontamination by a prefix-filtered set join.

A benchmark item is cut into windows of ten consecutive words (an item of
fewer words is one window).  A document that contains a window contains each of
its three-word shingles, so for full containment the necessary prefix of a
window, its shingles ordered by rarity in the corpus, is its rarest shingle.
Documents are joined with the windows on that token alone; the shingle's offset
fixes where the window would start, positional and length bounds drop what does
not fit, and the words are then compared one by one.

Items are cut into pieces of at most ``PIECE_WORDS`` words that overlap by nine,
equal pieces are one class, and the classes are dealt to blocks of at most
``BLOCK_BYTES`` (checked before any is read).  A block is all that the driver
and the executors hold of the benchmark; which items have a class stays in a
table.  Every block costs two passes over the documents.

Defined cases: null or empty texts have no words; equal items are one window
set with several ids; an item without an id is reported as ''; rows of
documents that repeat are judged each on their own; texts, items and words may
be of any length (a word of more than ``LONG`` bytes is told by its SHA-256);
of equally rare shingles the first is the prefix; an empty table on either side
hits nothing.  Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, discard, sliced, written

WINDOW = 10
SHINGLE = 3
BLOCK_BYTES = 4 << 20
PIECE_WORDS = 4096
LONG = 200
#: 4 MB of text have fewer than 2**21 different words: those of up to two bytes are few, the others take four bytes each with their space.
_BITS = 21

#: A-Z to a-z; every byte that is no digit, letter or part of a wider character to a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def shortened(words: list[bytes]) -> list[bytes]:
    """Long words as 65 bytes; no word has a zero byte."""
    return [w if len(w) <= LONG else b"\0" + hashlib.sha256(w).hexdigest().encode() for w in words]


@dataclass
class Block:
    """The windows of a block of classes and, once counts are known, their prefix index."""

    vocabulary: dict[bytes, int]
    any_long: bool
    windows: np.ndarray  # word numbers, padded with 0
    lengths: np.ndarray
    first: np.ndarray  # where each window's classes begin, and the end
    classes: np.ndarray
    shingles: dict[int, np.ndarray]  # by shingle length, sorted codes
    prefix: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] | None = None

    def numbers(self, text: bytes) -> np.ndarray:
        get, words = self.vocabulary.get, words_of(text)
        return np.array([get(w, 0) for w in (shortened(words) if self.any_long else words)], dtype=np.int64)

    def classes_of(self, windows: np.ndarray) -> list[int]:
        own = np.unique(windows)
        if not len(own):
            return []
        return np.unique(np.concatenate([self.classes[a:b] for a, b in zip(self.first[own].tolist(), self.first[own + 1].tolist(), strict=True)])).tolist()


def codes_of(ids: np.ndarray, q: int) -> np.ndarray:
    """One number for every run of ``q`` word numbers; -1 where a word is not in the vocabulary."""
    n = len(ids) - q + 1
    if n <= 0:
        return np.empty(0, dtype=np.int64)
    code, known = np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool)
    for j in range(q):
        part = ids[j : j + n]
        code = (code << _BITS) | part
        known &= part > 0
    code[~known] = -1
    return code


def build_block(rows: list[tuple[int, str]]) -> Block:
    """``rows`` are classes and their pieces, words joined by spaces."""
    vocabulary: dict[bytes, int] = {}
    made, owner = [], []
    for number, piece in rows:
        ids = np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in piece.encode().split(b" ")], dtype=np.int32)
        padded = np.concatenate([ids, np.zeros(max(0, WINDOW - len(ids)), dtype=np.int32)])
        made.append(np.lib.stride_tricks.sliding_window_view(padded, WINDOW))
        owner.append(np.full(len(made[-1]), number, dtype=np.int64))
    all_windows = np.concatenate(made) if made else np.zeros((0, WINDOW), dtype=np.int32)
    windows, which = np.unique(all_windows, axis=0, return_inverse=True) if made else (all_windows, np.empty(0, dtype=np.int64))
    pairs = np.unique(np.stack([which.ravel(), np.concatenate(owner)], axis=1), axis=0) if made else np.empty((0, 2), dtype=np.int64)
    windows = windows.astype(np.int64)
    lengths = (windows > 0).sum(axis=1)
    shingles = {}
    for q in range(1, SHINGLE + 1):
        of_q = [codes_of(windows[i, :n], q) for i, n in enumerate(lengths.tolist()) if min(n, SHINGLE) == q]
        shingles[q] = np.unique(np.concatenate(of_q)) if of_q else np.empty(0, dtype=np.int64)
    return Block(vocabulary, any(w[:1] == b"\0" for w in vocabulary), windows, lengths, np.searchsorted(pairs[:, 0], np.arange(len(windows) + 1)), pairs[:, 1].copy(), shingles)


def _lookup(sorted_codes: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose code is listed, and the code's rank."""
    if not len(sorted_codes) or not len(codes):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    pos = np.flatnonzero(codes >= 0)
    rank = np.minimum(np.searchsorted(sorted_codes, codes[pos]), len(sorted_codes) - 1)
    hit = sorted_codes[rank] == codes[pos]
    return pos[hit], rank[hit]


def _count_shingles(documents: DataFrame, text_col: str, block: Block) -> dict[int, np.ndarray]:
    """How often each shingle of the block occurs in the whole corpus."""
    shared = documents.sparkSession.sparkContext.broadcast(block)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = shared.value
        totals = {q: np.zeros(len(s), dtype=np.int64) for q, s in b.shingles.items()}
        for batch in sliced(batches):
            for text in batches_of(batch, "text"):
                ids = b.numbers(text)
                for q, listed in b.shingles.items():
                    if len(listed):
                        rank = _lookup(listed, codes_of(ids, q))[1]
                        if len(rank):
                            np.add.at(totals[q], rank, 1)
        for q, total in totals.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), q, dtype=np.int64)), pa.array(at), pa.array(total[at])], ["q", "rank", "n"])

    rows = documents.select(F.col(text_col).alias("text")).mapInArrow(count, "q long, rank long, n long").groupBy("q", "rank").agg(F.sum("n").alias("n"))
    out = {q: np.zeros(len(s), dtype=np.int64) for q, s in block.shingles.items()}
    for r in rows.collect():  # at most one row for each shingle of the block
        out[r["q"]][r["rank"]] = r["n"]
    return out


def index_by_rarity(block: Block, counts: dict[int, np.ndarray]) -> Block:
    """Give every window its necessary prefix: the rarest shingle, the first of equals."""
    entries: dict[int, list[tuple[int, int, int]]] = {q: [] for q in block.shingles}
    for w, n in enumerate(block.lengths.tolist()):
        q = min(n, SHINGLE)
        codes = codes_of(block.windows[w, :n], q)
        offset = int(np.argmin(counts[q][np.searchsorted(block.shingles[q], codes)]))
        entries[q].append((int(codes[offset]), w, offset))
    block.prefix = {}
    for q, rows in entries.items():
        if rows:
            table = np.array(sorted(rows), dtype=np.int64)
            block.prefix[q] = (np.unique(table[:, 0]), *(table[:, i].copy() for i in range(3)))
    return block


def occurrences(ids: np.ndarray, block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(start, window) of every window that occurs in a document."""
    starts, found = [], []
    for q, (listed, codes, window, offset) in block.prefix.items():
        own = codes_of(ids, q)
        pos, _ = _lookup(listed, own)
        if not len(pos):
            continue
        low, high = np.searchsorted(codes, own[pos], "left"), np.searchsorted(codes, own[pos], "right")
        times = high - low
        at = np.repeat(low - np.cumsum(times) + times, times) + np.arange(times.sum())
        start, w = np.repeat(pos, times) - offset[at], window[at]
        fits = (start >= 0) & (start + block.lengths[w] <= len(ids))  # positional and length bounds
        start, w = start[fits], w[fits]
        for s in range(0, len(start), 1 << 16):
            a, b = start[s : s + (1 << 16)], w[s : s + (1 << 16)]
            place = np.minimum(a[:, None] + np.arange(WINDOW), len(ids) - 1)
            same = ((ids[place] == block.windows[b]) | (np.arange(WINDOW) >= block.lengths[b][:, None])).all(axis=1)
            starts.append(a[same])
            found.append(b[same])
    if not starts:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    return np.concatenate(starts), np.concatenate(found)


def benchmark_classes(benchmark: DataFrame, item_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(class, piece) of the different pieces, and (class, item)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 64):
            for item, text in zip(batch.column("item").to_pylist(), batches_of(batch, "text"), strict=True):
                words = shortened(words_of(text))
                step = PIECE_WORDS - WINDOW + 1
                pieces = [b" ".join(words[s : s + PIECE_WORDS]).decode() for s in range(0, max(len(words) - WINDOW + 1, 1), step)] if words else []
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(pieces), pa.string()), pa.array(pieces, pa.string())], ["item", "piece"])

    rows = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    pieces = written(rows.mapInArrow(cut, "item string, piece string").distinct(), "benchmark-pieces")
    classes = written(pieces.select("piece").distinct().withColumn("class", F.monotonically_increasing_id()), "benchmark-classes")
    names = written(pieces.join(classes, "piece").select("class", "item"), "benchmark-names")
    discard(pieces)
    return classes, names


def _blocks(classes: DataFrame) -> Iterator[Block]:
    """Classes dealt by hash to as many blocks as keep each within ``BLOCK_BYTES``."""
    size = F.octet_length("piece") + 1
    total = classes.agg(F.sum(size)).first()[0] or 0
    parts = max(1, -(-total // BLOCK_BYTES))
    block = lambda n: F.pmod(F.xxhash64("class"), F.lit(n))
    while parts > 1 and classes.groupBy(block(parts).alias("b")).agg(F.sum(size).alias("s")).agg(F.max("s")).first()[0] > BLOCK_BYTES:
        parts *= 2
    for p in range(parts if total else 0):
        rows = [(r["class"], r["piece"]) for r in classes.where(block(parts) == p).toLocalIterator()]
        if rows:
            yield build_block(rows)


def _indexed_blocks(documents: DataFrame, classes: DataFrame, text_col: str) -> Iterator[Block]:
    for block in _blocks(classes):
        yield index_by_rarity(block, _count_shingles(documents, text_col, block))


def _with_items(found: DataFrame, names: DataFrame) -> DataFrame:
    """``classes`` replaced by ``items``: every different set of classes is named once, however many documents have it."""
    hit = found.where(F.size("classes") > 0)
    sets = hit.select("classes").distinct()
    named = sets.select("classes", F.explode("classes").alias("class")).join(names, "class").groupBy("classes").agg(F.sort_array(F.collect_set("item")).alias("items"))
    named = written(named, "decontamination-items")
    none = found.where(F.size("classes") == 0).select("id", "n_words", "hit_words", F.array().cast("array<string>").alias("items"))
    return none.union(hit.join(named, "classes").select("id", "n_words", "hit_words", "items"))


def find_contamination(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Per row: id, n_words, ``hit_words`` (sorted positions) and ``items`` (sorted ids) of all blocks."""
    kind = documents.schema[id_col].dataType.simpleString()
    state = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.array().cast("array<int>").alias("hit_words"), F.array().cast("array<long>").alias("classes"))
    schema = f"id {kind}, n_words long, hit_words array<int>, classes array<long>"

    def marked(block: Block | None, rows: DataFrame, last: bool) -> DataFrame:
        """The text goes on only if another block follows."""
        shared = rows.sparkSession.sparkContext.broadcast(block)

        def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            b = shared.value
            for batch in sliced(batches):
                totals, hits, classes = [], [], []
                for text, before, listed in zip(batches_of(batch, "text"), batch.column("hit_words").to_pylist(), batch.column("classes").to_pylist(), strict=True):
                    if b is None:
                        totals.append(len(words_of(text)))
                    else:
                        ids = b.numbers(text)
                        totals.append(len(ids))
                        start, w = occurrences(ids, b)
                        if len(start):
                            edge = np.zeros(len(ids) + 1, dtype=np.int64)
                            np.add.at(edge, start, 1)
                            np.add.at(edge, start + b.lengths[w], -1)
                            covered = np.cumsum(edge[:-1]) > 0
                            covered[np.asarray(before, dtype=np.int64)] = True
                            before = np.flatnonzero(covered).tolist()
                            listed = sorted({*listed, *b.classes_of(w)})
                    hits.append(before)
                    classes.append(listed)
                made = [batch.column("id"), pa.array(totals, pa.int64()), pa.array(hits, pa.list_(pa.int32())), pa.array(classes, pa.list_(pa.int64()))]
                names = ["id", "n_words", "hit_words", "classes"]
                yield pa.RecordBatch.from_arrays(made, names) if last else pa.RecordBatch.from_arrays([*made, batch.column("text")], [*names, "text"])

        return rows.select("id", "text", "hit_words", "classes").mapInArrow(mark, schema if last else f"{schema}, text string")

    classes, names = benchmark_classes(benchmark, item_col, item_text_col)
    blocks = _indexed_blocks(documents, classes, text_col)
    block, out, stages = next(blocks, None), state, []
    while (following := next(blocks, None)) is not None:
        out, block = written(marked(block, out, False), "decontamination"), following
        stages.append(out)
        if len(stages) > 1:
            discard(stages.pop(0))
    found = written(marked(block, out, True), "decontamination-found")
    discard(classes, *stages)
    return _with_items(found, names).withColumnRenamed("id", id_col)


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The documents in which no window occurs, all columns unchanged, without a shuffle."""

    def clean(block: Block, rows: DataFrame) -> DataFrame:
        shared = rows.sparkSession.sparkContext.broadcast(block)

        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            b = shared.value
            for batch in sliced(batches):
                yield batch.filter(pa.array([not len(occurrences(b.numbers(t), b)[0]) for t in batches_of(batch, text_col)], pa.bool_()))

        return rows.mapInArrow(keep, rows.schema)

    out, stages = documents, 0
    for block in _indexed_blocks(documents, benchmark_classes(benchmark, item_col, item_text_col)[0], text_col):
        out = clean(block, written(out, "decontamination") if stages and stages % 4 == 0 else out)
        stages += 1
    return out


def digest(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = find_contamination(documents, benchmark)
    n_hit = F.size("hit_words").cast("long")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
