"""Suffix-array dedup: bytes covered by a 400-byte string that starts twice or more.

A string is filed under its anchor, the 64-byte gram with the smallest hash
inside it, so equal strings are filed together wherever they stand.

1.  Equal texts, told by SHA-256, are one text.  One that several rows have
    loses all its bytes if it has 400; only its first row goes on.
2.  Anchors are counted.  Around one that occurs again lies a fragment of at
    most 736 bytes: all strings of a text that share it.
3.  The fragments of an anchor meet in one task.  Their suffixes from the
    anchor on are sorted by hashed comparison, and so are, read backwards, the
    bytes before it.  A class of neighbours that agree for f bytes from the
    anchor on, and inside the class neighbours that agree for b bytes before
    it, have in common every string that starts 400 - f to b bytes before the
    anchor.  All agreements are verified byte by byte.
4.  An anchor with more than ``HOT`` fragments would be too much for a task:
    equal fragments of it become one first.  If more than ``HOT`` different
    ones remain, they are cut into their single strings; equal ones are
    counted by a 160-bit BLAKE2b digest with partial counts on the map side.

Defined cases: null is the empty text; a text below 400 bytes loses nothing;
rows that repeat count as several places, whatever their ids; a text may be as
long as a row can be, its positions are 32-bit; an empty table gives an empty
result.  Only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Powers, batches_of, discard, mix64, sliced, window_anchors, window_hashes, written
from .sketch import Listed, cell_of, listed, membership
from .suffix_sort import HashCollision, HashedText, RangeMinimum, byte_codes, classes, ranked

LENGTH = 400
GRAM = 64
HOT = 2048
#: Distinct fragments of hot anchors are sent to the texts up to this number (and four runs each), and joined with the places beyond.
MOST_BROADCAST = 200_000
_BASE = 0x5851F42D4C957F2D
_BATCH_BYTES = 1 << 20
_MEMBERS = 1 << 18


def _keyed(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return documents.select(F.col(id_col).alias("id"), F.sha2(text, 256).alias("sha"), F.octet_length(text).alias("n_bytes"), text.alias("text"))


def _anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per text its anchors: hash, position, and the first of the strings that have it."""
    powers = Powers(_BASE)
    longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())
    for batch in sliced(batches, 64):
        out = []
        for text in batches_of(batch, "text"):
            grams = window_hashes(byte_codes(text), GRAM, powers)
            which, at = window_anchors(grams, LENGTH - GRAM + 1)
            first = np.flatnonzero(np.diff(which, prepend=-1))
            out.append((mix64(grams[at]).view(np.int64), at.astype(np.int32), first.astype(np.int32)))
        cols = list(zip(*out, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([batch.column("sha"), batch.column("text"), *(pa.array(list(c), k) for c, k in zip(cols, (longs, ints, ints), strict=True))], ["sha", "text", "hash", "at", "first"])


def _distinct_texts(keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sha, rep, n) of every distinct text, and the texts with their anchors; those of rows that a bitmap lets pass twice count twice."""
    reps = written(keyed.where(F.col("n_bytes") >= LENGTH).groupBy("sha").agg(F.min("id").alias("rep"), F.count("*").alias("n")), "suffix-reps")
    shared = keyed.sparkSession.sparkContext.broadcast(membership(reps.select(cell_of("sha", "rep").alias("cell"))))

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = batch.column("n_bytes").to_numpy() >= LENGTH
            yield batch.filter(pa.array(keep & shared.value.may_contain(batch.column("cell").to_numpy())))

    rows = keyed.select("sha", cell_of("sha", "id").alias("cell"), "n_bytes", "text")
    texts = rows.mapInArrow(lambda b: _anchored(chosen(b)), "sha string, text string, hash array<long>, at array<int>, first array<int>")
    return reps, written(texts.withColumn("tid", F.monotonically_increasing_id()), "suffix-texts")


def _cut(text: bytes, wanted: Listed, unwanted: Listed | None, names: np.ndarray, at: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, bytes]]:
    """(anchor, start, place of the anchor in it, fragment) for the anchors that one bitmap lists and the other does not."""
    keep = wanted.may_contain(names.view(np.uint64))
    if unwanted is not None:
        keep &= ~unwanted.may_contain(names.view(np.uint64))
    i = np.flatnonzero(keep)
    end = np.append(first[1:], len(text) - LENGTH + 1) + LENGTH - 1
    return [(a, s, p - s, text[s:e]) for a, p, s, e in zip(names[i].tolist(), at[i].tolist(), first[i].tolist(), end[i].tolist(), strict=True)]


def _fragments(texts: DataFrame, wanted, unwanted=None) -> DataFrame:
    """The surroundings of the anchors that one bitmap lists and the other does not."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 128):
            out = []
            for tid, text, *lists in zip(batch.column("tid").to_pylist(), batches_of(batch, "text"), *(batch.column(c) for c in ("hash", "at", "first")), strict=True):
                out += [(a, tid, s, p, piece) for a, s, p, piece in _cut(text, wanted.value, unwanted and unwanted.value, *(x.values.to_numpy() for x in lists))]
            if out:
                cols = list(zip(*out, strict=True))
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["anchor", "tid", "s", "at", "bytes"])

    return texts.select("tid", "text", "hash", "at", "first").mapInArrow(cut, "anchor long, tid long, s int, at int, bytes binary")


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) of every run of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist(), strict=True))


def _by_bytes(fragments: list[bytes], at: list[int], groups: np.ndarray) -> list[np.ndarray]:
    """What ``repeated_in`` returns, without hashes."""
    seen: dict[tuple, list[tuple[int, int]]] = {}
    for i, (f, g) in enumerate(zip(fragments, groups.tolist(), strict=True)):
        for s in range(len(f) - LENGTH + 1):
            seen.setdefault((g, at[i] - s, f[s : s + LENGTH]), []).append((i, s))
    flags = [np.zeros(len(f) - LENGTH + 1, dtype=bool) for f in fragments]
    for places in seen.values():
        if len(places) > 1:
            for i, s in places:
                flags[i][s] = True
    return flags


def repeated_in(fragments: list[bytes], at: list[int], anchors: list[int]) -> list[np.ndarray]:
    """Per fragment, flags of the strings that another fragment of its anchor has as well.

    ``at`` is the anchor's place in the fragment; fragments of an anchor must be neighbours.
    """
    groups = np.cumsum(np.diff(np.array(anchors), prepend=anchors[0]) != 0)
    try:
        return _by_suffixes(fragments, np.array(at, dtype=np.int64), groups)
    except HashCollision:
        return _by_bytes(fragments, at, groups)


def _by_suffixes(fragments: list[bytes], at: np.ndarray, groups: np.ndarray) -> list[np.ndarray]:
    blob = np.frombuffer(b"".join(fragments), dtype=np.uint8)
    sizes = np.array([len(f) for f in fragments])
    count = sizes - LENGTH + 1
    start = np.cumsum(sizes) - sizes + at
    order, ahead = ranked(HashedText(blob), start, np.minimum(sizes - at, LENGTH), groups)
    back, behind = ranked(HashedText(blob[::-1].copy()), len(blob) - start, at, groups)
    rank = np.empty(len(back), dtype=np.int64)
    rank[back] = np.arange(len(back))
    least = RangeMinimum(behind)
    string = np.cumsum(count) - count  # the number of each fragment's first string
    edge = np.zeros(int(count.sum()) + 1, dtype=np.int64)
    first, last, agreed, outer = classes(ahead)
    useful = agreed >= GRAM
    first, last, agreed, outer = first[useful], last[useful], agreed[useful], outer[useful]
    size = last - first + 1
    chunk = np.cumsum(size) // _MEMBERS
    for c in range(int(chunk[-1]) + 1) if len(chunk) else ():
        own = np.flatnonzero(chunk == c)
        of = np.repeat(own, size[own])
        step = np.arange(len(of)) - np.repeat(np.cumsum(size[own]) - size[own], size[own])
        member = order[first[of] + step]
        able = at[member] >= LENGTH - agreed[of]  # enough bytes before the anchor
        of, member = of[able], member[able]
        by = np.lexsort((rank[member], of))
        of, member = of[by], member[by]
        near = np.flatnonzero(of[1:] == of[:-1])
        if not len(near):
            continue
        shared = least.over(rank[member[near]] + 1, rank[member[near + 1]])
        best = np.full(len(of), -1, dtype=np.int64)
        np.maximum.at(best, near, shared)
        np.maximum.at(best, near + 1, shared)
        low = LENGTH - agreed[of]
        high = np.minimum(best, LENGTH - 1 - outer[of])  # further back, the larger class decides
        hit = np.flatnonzero(high >= low)
        base = string[member[hit]] + at[member[hit]]
        np.add.at(edge, base - high[hit], 1)
        np.add.at(edge, base - low[hit] + 1, -1)
    return np.split(np.cumsum(edge[:-1]) > 0, np.cumsum(count)[:-1])


_SOLVED = "tid long, s int, e int"


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole anchors, a few MB at a time, from partitions sorted by anchor: (tid, first, last) of repeated strings."""
    held: list[tuple] = []
    size = 0

    def solve() -> pa.RecordBatch:
        out = []
        for (_, tid, s, _, _), flags in zip(held, repeated_in([h[4] for h in held], [h[3] for h in held], [h[0] for h in held]), strict=True):
            out += [(tid, s + a, s + b) for a, b in _runs(flags)]
        cols = list(zip(*out, strict=True)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.int32()), strict=True)], ["tid", "s", "e"])

    for batch in sliced(batches):
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if size > _BATCH_BYTES and row[0] != held[-1][0]:
                yield solve()
                held, size = [], 0
            held.append(row)
            size += len(row[4])
    if held:
        yield solve()


def _solved(fragments: DataFrame) -> DataFrame:
    return fragments.select("anchor", "tid", "s", "at", "bytes").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_solve, _SOLVED)


def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The single strings of a fragment, as digests."""
    for batch in sliced(batches, 256):
        digests, tids, at = [], [], []
        for tid, f in zip(batch.column("tid").to_pylist(), batch.column("bytes").to_pylist(), strict=True):
            n = len(f) - LENGTH + 1
            digests += [hashlib.blake2b(f[s : s + LENGTH], digest_size=20).digest() for s in range(n)]
            tids.append(np.full(n, tid))
            at.append(np.arange(n, dtype=np.int32))
        if digests:
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(np.concatenate(tids)), pa.array(np.concatenate(at))], ["digest", "tid", "s"])


class _Kinds:
    """The runs of distinct fragments, found by the first 16 bytes of their SHA-256."""

    def __init__(self, rows: list[tuple[bytes, list]]):
        keys = np.frombuffer(b"".join(k for k, _ in rows), dtype=np.uint64).reshape(-1, 2)
        by = np.lexsort((keys[:, 1], keys[:, 0]))
        self.keys = keys[by]
        sizes = np.array([len(rows[i][1]) for i in by.tolist()], dtype=np.int64)
        self.first = np.concatenate([[0], np.cumsum(sizes)])
        self.runs = np.array([r for i in by.tolist() for r in rows[i][1]], dtype=np.int32).reshape(-1, 2)

    def of(self, at: int, fragment: bytes) -> np.ndarray:
        key = np.frombuffer(hashlib.sha256(b"%d:" % at + fragment).digest()[:16], dtype=np.uint64)
        i = int(np.searchsorted(self.keys[:, 0], key[0]))
        while i < len(self.keys) and self.keys[i, 0] == key[0]:
            if self.keys[i, 1] == key[1]:
                return self.runs[self.first[i] : self.first[i + 1]]
            i += 1
        return self.runs[:0]


def _own_runs(texts: DataFrame, hot, kinds) -> DataFrame:
    """(tid, own) of the texts with runs at hot anchors, from a broadcast of the kinds' runs."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 128):
            tids, runs = [], []
            for tid, text, *lists in zip(batch.column("tid").to_pylist(), batches_of(batch, "text"), *(batch.column(c) for c in ("hash", "at", "first")), strict=True):
                own = [{"s": s + a, "e": s + b} for _, s, at, piece in _cut(text, hot.value, None, *(x.values.to_numpy() for x in lists)) for a, b in kinds.value.of(at, piece).tolist()]
                if own:
                    tids.append(tid)
                    runs.append(own)
            if tids:
                yield pa.RecordBatch.from_arrays([pa.array(tids, pa.int64()), pa.array(runs, pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())])))], ["tid", "own"])

    return texts.select("tid", "text", "hash", "at", "first").mapInArrow(look, "tid long, own array<struct<s:int,e:int>>")


def _hot_runs(texts: DataFrame, hot, most: int, most_broadcast: int) -> DataFrame:
    """(tid, own): all runs of a text at anchors with very many fragments."""
    fid = F.sha2(F.concat(F.col("at").cast("string").cast("binary"), F.lit(":").cast("binary"), "bytes"), 256).alias("fid")
    places = _fragments(texts, hot).select("anchor", "tid", "s", "at", "bytes", fid)
    # the number of a distinct fragment stands in for the text in what follows
    kinds = places.groupBy("fid").agg(F.count("*").alias("n"), F.first("anchor").alias("anchor"), F.first("at").alias("at"), F.first("bytes").alias("bytes"))
    kinds = written(kinds.select(F.monotonically_increasing_id().alias("tid"), F.lit(0).alias("s"), "*"), "suffix-kinds")
    many = written(kinds.groupBy("anchor").agg(F.count("*").alias("m")).where(F.col("m") > most).select("anchor"), "suffix-many")
    few = _solved(kinds.join(many, "anchor", "left_anti"))
    strings = kinds.join(many, "anchor", "left_semi").select("tid", "bytes").mapInArrow(_strings, "digest binary, tid long, s int")
    strings = written(strings, "suffix-strings")
    again = written(strings.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest"), "suffix-again")
    single = strings.join(again, "digest").select("tid", "s", F.col("s").alias("e"))
    own = few.union(single).groupBy("tid").agg(F.collect_set(F.struct("s", "e")).alias("own"))
    whole = F.when(F.col("n") > 1, F.array(F.struct("s", (F.octet_length("bytes") - LENGTH).cast("int").alias("e"))))
    runs = kinds.join(own, "tid", "left").select("fid", F.coalesce(whole, "own").alias("own")).where("own IS NOT NULL")
    found = written(runs, "suffix-hot-runs")
    size = found.agg(F.count("*"), F.coalesce(F.sum(F.size("own")), F.lit(0))).first()
    if size[0] <= most_broadcast and size[1] <= 4 * most_broadcast:
        rows = [(bytes.fromhex(r["fid"])[:16], [(x["s"], x["e"]) for x in r["own"]]) for r in found.toLocalIterator()]
        out = _own_runs(texts, hot, texts.sparkSession.sparkContext.broadcast(_Kinds(rows)))
    else:
        shifted = F.transform("own", lambda r: F.struct((F.col("s") + r["s"]).alias("s"), (F.col("s") + r["e"]).alias("e")))
        out = written(places.select("fid", "tid", "s"), "suffix-places").join(found, "fid").select("tid", shifted.alias("own"))
    out = written(out, "suffix-hot")
    discard(kinds, many, strings, again, found)
    return out


def repeated_strings(texts: DataFrame, most: int = HOT, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """Per text (tid): ``runs``, the ranges of starts of repeated strings."""
    counts = written(texts.select(F.explode("hash").alias("h")).groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "suffix-anchors")
    spark = texts.sparkSession
    repeated = spark.sparkContext.broadcast(listed(counts, "h"))
    above = written(counts.where(F.col("n") > most), "suffix-above")
    one = F.array(F.struct("s", "e")).alias("own")
    if above.isEmpty():
        found = _solved(_fragments(texts, repeated)).select("tid", one)
    else:
        hot = spark.sparkContext.broadcast(listed(above, "h"))
        found = _solved(_fragments(texts, repeated, hot)).select("tid", one).union(_hot_runs(texts, hot, most, most_broadcast))
    return written(found.groupBy("tid").agg(F.flatten(F.collect_list("own")).alias("runs")), "suffix-runs")


def kept_mask(n_bytes: int, runs: list[dict] | None) -> np.ndarray:
    edge = np.zeros(n_bytes + 1, dtype=np.int64)
    if runs:
        s, e = (np.array([r[k] for r in runs], dtype=np.int64) for k in ("s", "e"))
        np.add.at(edge, s, 1)
        np.add.at(edge, e + LENGTH, -1)
    return np.cumsum(edge[:-1]) == 0


def _cut_texts(texts: DataFrame, runs: DataFrame, digest_only: bool) -> DataFrame:
    """(sha, n_removed, n_spans, kept or its digest) of the texts that lose something; no other text is shuffled."""
    shared = texts.sparkSession.sparkContext.broadcast(membership(runs.select(cell_of("tid").alias("cell"))))

    def touched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.select(["tid", "sha", "text"]).filter(pa.array(shared.value.may_contain(batch.column("cell").to_numpy())))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 128):
            out = []
            for text, runs_ in zip(batches_of(batch, "text"), batch.column("runs").to_pylist(), strict=True):
                keep = kept_mask(len(text), runs_)
                rest = np.frombuffer(text, dtype=np.uint8)[keep].tobytes()
                out.append((len(text) - len(rest), len(_runs(~keep)), hashlib.sha256(rest).hexdigest() if digest_only else rest))
            cols = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column("sha"), *(pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.string() if digest_only else pa.binary()), strict=True))], ["sha", "n_removed", "n_spans", "rest"])

    rows = texts.select("tid", "sha", "text", cell_of("tid").alias("cell")).mapInArrow(touched, "tid long, sha string, text string")
    made = rows.join(runs, "tid").select("sha", "text", "runs").mapInArrow(cut, f"sha string, n_removed long, n_spans long, rest {'string' if digest_only else 'binary'}")
    return written(made, "suffix-cut")


def remove_repeats(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_only: bool = False, most: int = HOT, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """id, n_bytes, n_removed, n_spans and the remaining bytes (or their SHA-256)."""
    keyed = _keyed(documents, id_col, text_col)
    reps, texts = _distinct_texts(keyed)
    runs = repeated_strings(texts, most, most_broadcast)
    made = _cut_texts(texts, runs, digest_only)
    discard(texts, runs)
    # a text of several rows loses everything, whatever its strings say
    several = reps.where("n > 1").select("sha", F.lit(True).alias("gone"))
    change = written(made.join(several, "sha", "full_outer").dropDuplicates(["sha"]), "suffix-change")
    discard(made, reps)
    gone, n = F.coalesce("gone", F.lit(False)), F.col("n_bytes").cast("long")
    nothing, unchanged = (F.lit(hashlib.sha256(b"").hexdigest()), F.col("sha")) if digest_only else (F.lit(b""), F.col("text").cast("binary"))
    rows = keyed.drop("text") if digest_only else keyed
    out = rows.join(change, "sha", "left")
    return out.select(
        F.col("id").alias(id_col),
        n.alias("n_bytes"),
        F.when(gone, n).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(gone, F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", F.lit(0).cast("long"))).alias("n_spans"),
        F.when(gone, nothing).otherwise(F.coalesce("rest", unchanged)).alias("kept_sha256" if digest_only else "kept"),
    )


def digest(documents: DataFrame) -> DataFrame:
    return remove_repeats(documents, digest_only=True)
