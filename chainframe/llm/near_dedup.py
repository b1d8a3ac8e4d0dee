"""Near-duplicate documents by SuperMinHash, banding, verification and union-find.

1.  One pass over the texts makes signatures; documents with equal shingle sets
    are one class, and only the smallest document of each goes on.
2.  In every bucket of equal bands a member drawn by hash is the centre; all
    others are compared with it.  Verified links give first components.
3.  A bucket that still holds several components is compared in full across
    them: small buckets by signature and then by full sets, large ones in
    blocks of members with their full sets, which return a spanning forest.
    So a group of copies costs one comparison per member and bucket, no pair is
    left out, and no task holds more than two blocks of a bucket.

Links are confirmed on full sets (64-bit shingle fingerprints).  With 40 bands
of 5 slots a pair at similarity 0.75 shares no bucket with probability 2e-5.

Ids are integers.  Defined cases: no words (null, empty or white space) means an
empty set, which links with nothing; a null id counts as the largest; rows with
equal ids are one document; of equal or linked texts the smallest id names the
class; a text may be of any length, its set is held whole; an empty table gives
an empty result.  Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, discard_since, sliced, written, written_so_far
from .components import UnionFind, components
from .sketch import Membership, cell_of, membership
from .superminhash import SLOTS, band_keys, intersection, new_powers, shingle_set, signatures

PERCENT = 75
#: Pairs whose signatures agree less are not verified: five standard deviations below 0.75.
PLAUSIBLE = 0.60
SMALL = 64
BLOCK = 256
_LAST = (1 << 63) - 1


def _linked(a: np.ndarray, b: np.ndarray) -> bool:
    common = intersection(a, b)
    return 100 * common >= PERCENT * (len(a) + len(b) - common)


def _ratio(a: str, b: str):
    return 100 * F.least(a, b) >= PERCENT * F.greatest(a, b)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache: dict = {}
    powers = new_powers()
    for batch in sliced(batches):
        texts, docs = batches_of(batch, "text"), batch.column("doc")
        for first in range(0, len(texts), 256):
            sets = [shingle_set(t, cache, powers) for t in texts[first : first + 256]]
            sig = signatures(sets)
            prints = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            f1, f2 = (np.frombuffer(b"".join(p[i : i + 8] for p in prints), dtype=np.int64) for i in (0, 8))
            low = (sig & np.uint32(0xFF)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [docs.slice(first, len(sets)), pa.array([len(s) for s in sets], pa.int64()), pa.array(f1), pa.array(f2), pa.array([r.tobytes() for r in low], pa.binary()), pa.array(list(band_keys(sig).view(np.int64)), pa.list_(pa.int64()))],
                ["doc", "n", "f1", "f2", "sig", "bands"],
            )


def _sets_of(documents: DataFrame, wanted: Membership, label: str) -> DataFrame:
    """(doc, set) of the documents that a bitmap lists; their shingles are made again from the text."""
    shared = documents.sparkSession.sparkContext.broadcast(wanted)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        powers = new_powers()
        for batch in sliced(batches):
            keep = shared.value.may_contain(batch.column("cell").to_numpy())
            own = batch.filter(pa.array(keep))
            if own.num_rows:
                sets = [shingle_set(t, cache, powers).tobytes() for t in batches_of(own, "text")]
                yield pa.RecordBatch.from_arrays([own.column("doc"), pa.array(sets, pa.binary())], ["doc", "set"])

    rows = documents.select("doc", cell_of("doc").alias("cell"), "text").mapInArrow(make, "doc long, set binary")
    return written(rows.dropDuplicates(["doc"]), label)


def _plausible(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs (a, b) whose signatures agree enough."""
    sig = reps.select("doc", "sig")
    both = pairs.join(sig.select(F.col("doc").alias("a"), F.col("sig").alias("s")), "a").join(sig.select(F.col("doc").alias("b"), F.col("sig").alias("t")), "b")

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            s, t = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint8).reshape(-1, SLOTS) for c in ("s", "t"))
            keep = pa.array((s == t).mean(axis=1) >= PLAUSIBLE)
            yield batch.select(["a", "b"]).filter(keep)

    return both.select("a", "b", "s", "t").mapInArrow(agree, "a long, b long")


def _verified(pairs: DataFrame, documents: DataFrame, label: str) -> DataFrame:
    """The pairs that are links, decided on full sets."""
    pairs = written(pairs, f"{label}-pairs")
    ends = pairs.select(F.col("a").alias("doc")).union(pairs.select(F.col("b").alias("doc"))).distinct()
    sets = _sets_of(documents, membership(ends.select(cell_of("doc").alias("cell"))), f"{label}-sets")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            s, t = ([np.frombuffer(x, dtype=np.uint64) for x in batch.column(c).to_pylist()] for c in ("s", "t"))
            yield batch.select(["a", "b"]).filter(pa.array([_linked(x, y) for x, y in zip(s, t, strict=True)], pa.bool_()))

    both = pairs.join(sets.select(F.col("doc").alias("a"), F.col("set").alias("s")), "a").join(sets.select(F.col("doc").alias("b"), F.col("set").alias("t")), "b")
    return written(both.select("a", "b", "s", "t").mapInArrow(confirm, "a long, b long"), f"{label}-links")


def _groups(batches: Iterator[pa.RecordBatch], names: list[str], keys: int) -> Iterator[list[tuple]]:
    """Runs of rows with equal leading ``keys`` columns of a sorted partition."""
    group: list[tuple] = []
    for batch in sliced(batches):
        for row in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
            if group and row[:keys] != group[0][:keys]:
                yield group
                group = []
            group.append(row)
    if group:
        yield group


def _pairs_in_small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs across the components of a small bucket whose sizes and signatures allow a link."""
    out: set[tuple[int, int]] = set()

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in out], pa.int64()), pa.array([p[1] for p in out], pa.int64())], ["a", "b"])

    for group in _groups(batches, ["key", "doc", "n", "comp", "sig"], 1):
        doc, n, comp = (np.array([g[i] for g in group], dtype=np.int64) for i in (1, 2, 3))
        sig = np.frombuffer(b"".join(g[4] for g in group), dtype=np.uint8).reshape(-1, SLOTS)
        i, j = np.triu_indices(len(group), 1)
        fits = (comp[i] != comp[j]) & (100 * np.minimum(n[i], n[j]) >= PERCENT * np.maximum(n[i], n[j]))
        i, j = i[fits], j[fits]
        close = (sig[i] == sig[j]).mean(axis=1) >= PLAUSIBLE if len(i) else np.empty(0, dtype=bool)
        a, b = np.minimum(doc[i], doc[j])[close], np.maximum(doc[i], doc[j])[close]
        out.update(zip(a.tolist(), b.tolist(), strict=True))
        if len(out) > 1 << 16:
            yield flush()
            out.clear()
    if out:
        yield flush()


def _links_in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the links between a block of others and a block of members."""
    for group in _groups(batches, ["key", "i", "j", "other", "doc", "comp", "set"], 3):
        forest, links = UnionFind(), []
        sets = [np.frombuffer(g[6], dtype=np.uint64) for g in group]
        sizes = np.array([len(s) for s in sets])
        elements, number = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(len(group)), sizes)
        order = np.argsort(number, kind="stable")
        bounds = np.searchsorted(number[order], np.arange(len(elements) + 1))
        starts = np.concatenate([[0], np.cumsum(sizes)])
        for x in (k for k, g in enumerate(group) if g[3]):
            mine = number[starts[x] : starts[x + 1]]
            low, times = bounds[mine], bounds[mine + 1] - bounds[mine]
            at = np.repeat(low - np.cumsum(times) + times, times) + np.arange(times.sum())
            common = np.bincount(owner[order[at]], minlength=len(group))
            for y in np.flatnonzero(100 * common >= PERCENT * (sizes + sizes[x] - common)).tolist():
                if y != x and forest.union(group[x][5], group[y][5]):
                    links.append((group[x][4], group[y][4]))
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in links], pa.int64()), pa.array([p[1] for p in links], pa.int64())], ["a", "b"])


def _large_buckets(members: DataFrame, documents: DataFrame) -> DataFrame:
    """Links across components in large buckets: every member outside the bucket's main component meets all others.

    A member goes to the block pairs (i, j) of its bucket: others' block i with
    every block j of members.
    """
    counts = members.groupBy("key", "comp").agg(F.count("*").alias("n"))
    per_key = counts.groupBy("key").agg(F.max(F.struct("n", "comp")).alias("main"), F.sum("n").alias("total"))
    sizes = written(per_key.select("key", F.col("main.comp").alias("main"), (F.col("total") - F.col("main.n")).alias("n_other"), "total"), "near-large")
    rows = members.join(sizes, "key").withColumn("other", F.col("comp") != F.col("main"))
    blocks = lambda n: F.greatest(F.ceil(F.col(n) / BLOCK), F.lit(1)).cast("int")
    i_of, j_of = (F.pmod(F.xxhash64("doc", F.lit(salt)), blocks(n)).cast("int") for salt, n in ((1, "n_other"), (2, "total")))
    as_other = rows.where("other").select("key", "doc", "comp", i_of.alias("i"), F.explode(F.sequence(F.lit(0), blocks("total") - 1)).alias("j"), F.lit(True).alias("other"))
    as_member = rows.select("key", "doc", "comp", F.explode(F.sequence(F.lit(0), blocks("n_other") - 1)).alias("i"), j_of.alias("j"), F.lit(False).alias("other"))
    placed = as_other.union(as_member)
    sets = _sets_of(documents, membership(members.select("doc").distinct().select(cell_of("doc").alias("cell"))), "near-large-sets")
    dealt = placed.join(sets, "doc").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "other", "doc")
    return dealt.select("key", "i", "j", "other", "doc", "comp", "set").mapInArrow(_links_in_blocks, "a long, b long")


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_shingles, component (smallest linked id)."""
    mark = written_so_far()
    docs = documents.select(F.coalesce(F.col(id_col), F.lit(_LAST)).cast("long").alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    signed = written(docs.mapInArrow(_signed, "doc long, n long, f1 long, f2 long, sig binary, bands array<long>"), "near-signed")
    first = signed.where("n > 0").groupBy("f1", "f2").agg(F.min(F.struct("doc", "n", "sig", "bands")).alias("m"))
    reps = written(first.select("f1", "f2", "m.*"), "near-reps")

    banded = reps.select("doc", "n", F.explode("bands").alias("key"))
    drawn = banded.groupBy("key").agg(F.count("*").alias("size"), F.min(F.struct(F.xxhash64("doc", "key").alias("r"), "doc", "n")).alias("c")).where("size > 1")
    centres = written(drawn.select("key", "size", F.col("c.doc").alias("centre"), F.col("c.n").alias("cn")), "near-centres")
    found = membership(centres.select(cell_of("key").alias("cell")))
    shared = documents.sparkSession.sparkContext.broadcast(found)

    def in_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            yield batch.select(["doc", "n", "key"]).filter(pa.array(shared.value.may_contain(batch.column("cell").to_numpy())))

    joined = banded.select("doc", "n", "key", cell_of("key").alias("cell")).mapInArrow(in_bucket, "doc long, n long, key long").join(centres, "key")
    members = written(joined, "near-members")

    stars = members.where((F.col("doc") != F.col("centre")) & _ratio("n", "cn")).select(F.least("doc", "centre").alias("a"), F.greatest("doc", "centre").alias("b")).distinct()
    links = _verified(_plausible(stars, reps), docs, "near-star")
    comps = components(links, "near-star-cc")

    labelled = members.select("key", "doc", "n", "size").join(comps, "doc", "left").withColumn("comp", F.coalesce("comp", "doc"))
    labelled = written(labelled, "near-labelled")
    mixed = written(labelled.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key"), "near-mixed")
    several = labelled.join(mixed, "key")
    small = several.where(F.col("size") <= SMALL).join(reps.select("doc", "sig"), "doc").repartition("key").sortWithinPartitions("key", "doc")
    pairs = small.select("key", "doc", "n", "comp", "sig").mapInArrow(_pairs_in_small, "a long, b long").distinct()
    links = links.union(_verified(pairs, docs, "near-small"))
    large = written(several.where(F.col("size") > SMALL), "near-large-members")
    if not large.isEmpty():
        links = links.union(_large_buckets(large, docs))
    comps = components(links, "near-cc")

    # by id a class has one row; its documents may be very many, so both sides are read from files
    classes = reps.select("f1", "f2", "doc").join(comps, "doc", "left").select("f1", "f2", F.coalesce("comp", "doc").alias("comp"))
    classes = written(classes, "near-classes")
    discard_since(documents.sparkSession, mark, signed, classes)
    out = signed.select("doc", "n", "f1", "f2").join(classes, ["f1", "f2"], "left")
    comp = F.when(F.col("n") > 0, F.coalesce("comp", "doc")).otherwise(F.col("doc"))
    named = lambda c: F.when(c != _LAST, c)
    return out.select(named(F.col("doc")).alias(id_col), F.col("n").alias("n_shingles"), named(comp).alias("component_id"))


def keep_one(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The smallest document of every group, all columns unchanged."""
    own = near_duplicates(documents, id_col, text_col)
    dropped = own.where(~F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias("_cf_dropped")).distinct()
    return documents.join(written(dropped, "near-dropped"), F.col(id_col) == F.col("_cf_dropped"), "left_anti")


def digest(documents: DataFrame) -> DataFrame:
    out = near_duplicates(documents)
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
