"""Mixing sources to target weights by hash-threshold histograms.

Every document has a fixed 60-bit key.  Sizes are summed per source and leading
key bits; per source one bucket holds the place where its budget ends.  Only
that bucket is refined by the next bits, down to single keys, and the mix is a
filter ``key < threshold``: nothing is sorted, and a larger budget keeps what a
smaller one took.

Defined cases: null text has size 0; a null source is a source of its own,
after all others; a null id has the key of the empty string; rows with equal
ids have equal keys and are taken together; a text of any length is one
document and may be taken in part; sources of equal cap and weight are filled
in their order by code point; an empty table gives an empty mix.  Other columns
may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_RE, discard, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_REPEATS = 2
KEY_BITS = 60
LEVEL_BITS = 12
#: Per-source tables are broadcast up to this many sources, and joined by shuffle beyond.
MOST_BROADCAST = 100_000


def size_of(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    return F.size(F.filter(F.split(t, SPACE_RE), lambda w: w != "")).cast("long")


def key_of(doc_id: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, KEY_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target): shares by weight, filled up to the caps.

    With the sources in the order of cap / weight, the level at which every
    source below it is capped is largest at the true water level.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in WEIGHTS)), F.pmod(rank - 1, F.lit(len(WEIGHTS))) + 1)
    per = per.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(MOST_REPEATS))
    order = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    below = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    total = F.sum("source_size").over(Window.partitionBy()) * SHARE
    leveled = per.withColumn("below", below).withColumn("rest", rest).withColumn("total", total)
    leveled = leveled.withColumn("level", F.max((F.col("total") - F.col("below")) / F.col("rest")).over(Window.partitionBy()))
    return leveled.select("source", "source_size", F.least("cap", F.col("level") * F.col("weight")).alias("target"))


def _by_source(rows: DataFrame, per_source: DataFrame, few: bool) -> DataFrame:
    side = per_source.withColumnRenamed("source", "_s")
    return rows.join(F.broadcast(side) if few else side, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")


def thresholds(sizes: DataFrame, wanted: DataFrame, few: bool) -> DataFrame:
    """(source, budget, threshold, base, n): keys below the threshold are taken once more.

    ``wanted`` has source and ``budget``.  The document at the threshold itself
    ends the budget: ``base`` words come before it, it has ``n``, and only the
    words that are left of the budget are taken from it.
    """
    found = wanted.select("source", "budget", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("base"))
    end = F.lit(1 << KEY_BITS).cast("long")
    for done in range(0, KEY_BITS, LEVEL_BITS):
        inside = _by_source(sizes, found, few).where(F.shiftright("key", KEY_BITS - done) == F.col("prefix")) if done else _by_source(sizes, found, few)
        bucket = F.shiftright("key", KEY_BITS - done - LEVEL_BITS).alias("bucket")
        sums = inside.where("size > 0").groupBy("source", "budget", "base", bucket).agg(F.sum("size").alias("n"))
        running = F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        passed = sums.withColumn("upto", F.col("base") + running).where(F.col("upto") > F.col("budget"))
        first = passed.groupBy("source", "budget").agg(F.min(F.struct("bucket", "upto", "n")).alias("m"))
        step = first.select("source", "budget", F.col("m.bucket").alias("prefix"), (F.col("m.upto") - F.col("m.n")).alias("base"), F.col("m.n").alias("n"))
        before, found = found, written(step, "mixing-level")
        if done:
            discard(before)
    # a source whose budget takes every document has no boundary
    last = found.select(F.col("source").alias("_t"), F.col("prefix").alias("threshold"), "base", "n")
    return wanted.select("source", "budget").join(last, F.col("source").eqNullSafe(F.col("_t")), "left").select("source", "budget", F.coalesce("threshold", end).alias("threshold"), "base", "n")


def _plan(documents: DataFrame, id_col: str, text_col: str, source_col: str) -> tuple[DataFrame, DataFrame, bool]:
    """The documents' sizes and keys; per source what it takes; and whether the sources are few enough to broadcast."""
    doc, source = F.col(id_col), F.col(source_col)
    sizes = written(documents.select(doc.alias("id"), source.cast("string").alias("source"), size_of(F.col(text_col)).alias("size"), key_of(doc).alias("key")), "mixing-sizes")
    plan = written(targets(sizes), "mixing-targets")
    few = plan.count() <= MOST_BROADCAST
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = plan.withColumn("copies", F.least(copies, F.lit(MOST_REPEATS).cast("long")))
    plan = plan.withColumn("budget", F.col("target") - F.col("copies") * F.col("source_size"))
    cuts = written(thresholds(sizes.select("source", "size", "key"), plan.select("source", "budget"), few), "mixing-cuts").withColumnRenamed("source", "_c")
    full = plan.drop("budget").join(cuts, F.col("source").eqNullSafe(F.col("_c"))).drop("_c", "weight", "cap")
    return sizes, full, few


def _taken(size: Column, key: Column) -> Column:
    """The words that the mix takes of a document, from the columns of its source's plan."""
    in_part = F.floor((F.col("budget") - F.col("base")) * size / F.col("n")).cast("long")
    more = F.when(F.col("copies") >= MOST_REPEATS, 0).when(key < F.col("threshold"), size).when(key == F.col("threshold"), in_part).otherwise(0)
    return F.col("copies") * size + more


def mix(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per row: id, size, source_size, target, taken."""
    sizes, full, few = _plan(documents, id_col, text_col, source_col)
    out = _by_source(sizes, full, few)
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", _taken(F.col("size"), F.col("key")).alias("taken"))


def take_mix(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents of the mix, with ``taken`` words of each; what the mix leaves out is not returned.

    Each row is filtered by its own key against its source's cut, so texts are
    not shuffled (beyond ``MOST_BROADCAST`` sources they meet their source's
    cut by a join).  A column ``taken`` of the documents is replaced.
    """
    sizes, full, few = _plan(documents, id_col, text_col, source_col)
    discard(sizes)
    rows = documents.drop("taken").select(F.struct("*").alias("row"), F.col(source_col).cast("string").alias("source"), size_of(F.col(text_col)).alias("size"), key_of(F.col(id_col)).alias("key"))
    out = _by_source(rows, full, few).withColumn("taken", _taken(F.col("size"), F.col("key")))
    return out.where("taken > 0").select("row.*", "taken")


def digest(documents: DataFrame) -> DataFrame:
    return mix(documents)


#: The same mix in DuckDB's SQL; the keys order as their hexadecimal digits do.
ORACLE = r"""
WITH sizes AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS key
  FROM {documents}
), per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source
), ranked AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM per
), capped AS (
  SELECT *, source_size * 2.0::DOUBLE AS cap, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS total FROM ranked
), filled AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM capped
), plan AS (
  SELECT source, source_size, least(cap, weight * max(level) OVER ()) AS target FROM filled
), cut AS (
  SELECT *, CAST(CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS BIGINT) AS copies FROM plan
), running AS (
  SELECT s.doc_id, s.size, c.source_size, c.target, c.copies, c.target - c.copies * c.source_size AS budget,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
         sum(s.size) OVER (PARTITION BY s.source, s.key) AS own
  FROM sizes s JOIN cut c ON s.source IS NOT DISTINCT FROM c.source
)
SELECT doc_id, size, source_size, target,
       copies * size + CASE WHEN copies >= 2 THEN 0 WHEN upto <= budget THEN size
         WHEN upto - own < budget THEN CAST(floor((budget - (upto - own)) * size / own) AS BIGINT) ELSE 0 END AS taken
FROM running
"""
