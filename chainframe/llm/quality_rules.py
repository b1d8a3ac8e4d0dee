"""Quality rules by a rule bitmask ledger (DataFrame functions only).

Every rule is evaluated once per document.  The ledger keeps the measurements
and one bit per failed rule; policies are versioned sets of rules that are
applied to the ledger afterwards, and ablations are computed from counts per
distinct bitmask without touching a text again.

Defined cases: a null or empty text has no words and fails ``few_words``; rows
that repeat are judged each on their own; a text may be of any length, its
windows are sorted inside its row; a measurement exactly at a rule's bound
passes; an empty table gives an empty ledger.  Only the id and text columns are
read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, SPACE_RE, let

WINDOW = 5
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Rule:
    """``failed`` maps the ledger's measurement columns to a boolean."""

    name: str
    failed: Callable[[Callable[[str], Column]], Column]


#: The order fixes each rule's bit; append only, so that old ledgers stay readable.
RULES: tuple[Rule, ...] = (
    Rule("few_words", lambda c: c("n_words") < 10),
    Rule("repeated_words", lambda c: 100 * c("n_repeat_words") > 20 * c("n_words")),
    Rule("symbol_heavy", lambda c: 100 * c("n_symbols") > 20 * c("n_words")),
    Rule("duplicate_lines", lambda c: 100 * c("n_dup_lines") > 50 * c("n_lines")),
    Rule("word_length", lambda c: (c("word_chars") < 2 * c("n_words")) | (c("word_chars") > 15 * c("n_words"))),
    Rule("shouting", lambda c: 100 * c("n_upper") > 50 * c("word_chars")),
)
BIT = {r.name: 1 << i for i, r in enumerate(RULES)}

#: Versioned policies: a document is rejected if any rule of the policy failed.
POLICIES: dict[str, tuple[str, ...]] = {
    "base-1": ("few_words", "repeated_words"),
    "full-1": tuple(r.name for r in RULES),
}


def policy_mask(version: str) -> int:
    return sum(BIT[name] for name in POLICIES[version])


def _words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE_RE), lambda w: w != "")


def _covered(words: Column, hashes: Column) -> Column:
    """Words in windows that occur twice or more; equality is decided on the words themselves."""

    def keyed(h: Column, i: Column) -> Column:
        return F.struct(h.alias("h"), F.concat_ws(" ", F.slice(words, i + 1, WINDOW)).alias("k"), i.alias("i"))

    def repeated(s: Column) -> Column:
        same = lambda a, b: (a["h"] == b["h"]) & (a["k"] == b["k"])
        last = F.size(s) - 1
        before = lambda e, j: F.when(j > 0, same(s[F.greatest(j - 1, F.lit(0))], e)).otherwise(False)
        after = lambda e, j: F.when(j < last, same(s[F.least(j + 1, last)], e)).otherwise(False)
        return F.array_sort(F.transform(F.filter(s, lambda e, j: before(e, j) | after(e, j)), lambda e: e["i"]))

    def lengths(p: Column) -> Column:
        last = F.size(p) - 1
        return F.aggregate(
            F.transform(p, lambda x, j: F.when(j < last, F.least(F.lit(WINDOW), p[F.least(j + 1, last)] - x)).otherwise(WINDOW)),
            F.lit(0),
            lambda a, x: a + x,
        )

    return let(F.array_sort(F.transform(hashes, keyed)), lambda s: let(repeated(s), lengths))


def _repeat_words(words: Column) -> Column:
    """Hash every window first: a document without equal hashes has no equal windows and needs no sort."""
    starts = F.sequence(F.lit(0), F.size(words) - WINDOW)
    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(words, i + 1, WINDOW)))
    counted = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_covered(words, h)))
    return F.when(F.size(words) < WINDOW, F.lit(0)).otherwise(counted)


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def measurements(text: Column) -> Column:
    """All measurements of a text as one struct."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.ltrim(x, F.lit(SPACE)) != "")
    word_part = let(_words(t), lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeat_words(w).cast("long").alias("r")))
    line_part = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("d")))
    return let(
        F.struct(word_part.alias("w"), line_part.alias("l")),
        lambda m: F.struct(
            m["w"]["n"].alias("n_words"),
            F.length(_without(t, SPACE)).cast("long").alias("word_chars"),
            (F.length(t) - F.length(_without(t, SYMBOLS))).cast("long").alias("n_symbols"),
            m["l"]["d"].alias("n_dup_lines"),
            m["w"]["r"].alias("n_repeat_words"),
            m["l"]["n"].alias("n_lines"),
            (F.length(t) - F.length(_without(t, UPPER))).cast("long").alias("n_upper"),
        ),
    )


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")


def _bits(measure: Callable[[str], Column]) -> Column:
    bits = F.lit(0).cast("long")
    for rule in RULES:
        bits = bits + F.when(rule.failed(measure), F.lit(BIT[rule.name])).otherwise(F.lit(0)).cast("long")
    return bits


def ledger(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, measurements, ``failed_bits``."""
    measured = documents.select(F.col(id_col), measurements(F.col(text_col)).alias("_m"))
    flat = measured.select(id_col, *(F.col("_m")[m].alias(m) for m in MEASURES))
    return flat.withColumn("failed_bits", _bits(F.col))


def rejected(bits: Column, version: str) -> Column:
    return bits.bitwiseAND(F.lit(policy_mask(version)).cast("long")) != 0


def apply_policy(book: DataFrame, version: str = "full-1") -> DataFrame:
    return book.withColumn("base_failed", rejected(F.col("failed_bits"), "base-1")).withColumn("kept", ~rejected(F.col("failed_bits"), version))


def ablation(book: DataFrame, version: str = "full-1") -> DataFrame:
    """Per rule of a policy: documents that fail it, and documents that only it rejects.

    Counts per distinct bitmask (at most 2**rules rows) are aggregated first.
    """
    mask = policy_mask(version)
    per_mask = book.groupBy(F.col("failed_bits").bitwiseAND(F.lit(mask).cast("long")).alias("m")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.lit(BIT[n]).cast("long").alias("bit")) for n in POLICIES[version])))
    rows = per_mask.select("m", "n", rules.alias("r"))
    failing = F.when(F.col("m").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)
    alone = F.when(F.col("m") == F.col("r.bit"), F.col("n")).otherwise(0)
    return rows.groupBy(F.col("r.rule").alias("rule")).agg(F.sum(failing).alias("n_failed"), F.sum(alone).alias("n_only_this_rule"))


def keep_good(documents: DataFrame, version: str = "full-1", text_col: str = "text") -> DataFrame:
    """The documents that a policy keeps, columns unchanged, without a shuffle."""

    def passes(m: Column) -> Column:
        return ~rejected(_bits(lambda n: m[n]), version)

    # one expression, so that a filter pushed down to the scan measures each text once
    return documents.where(let(measurements(F.col(text_col)), passes))


def digest(documents: DataFrame) -> DataFrame:
    judged = apply_policy(ledger(documents))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_bits")
