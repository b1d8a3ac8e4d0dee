"""A corpus pipeline: quality rules, near-dedup, decontamination, PII, mixing.

Every stage takes what its predecessor kept, as a Parquet table.  All stages
but the last return the columns of ``documents``; the last adds ``taken``, the
words that the mix takes of each document.

Defined cases: a document without words (null, empty, white space) fails the
quality rules and goes; rows that repeat are judged alike by the rules, and of
equal or near texts the row with the smallest id stays (rows with the same id
are one document, so all of them stay); a null id counts as the largest; texts
may be of any length; columns besides ``doc_id``, ``text`` and ``source`` pass
through under any name, but ``taken`` is replaced; an empty table, or one of
which nothing is left, gives an empty table.  The tables of a stage are deleted
when its result is written, and its result when the next one's is; the last
result stays in the shared folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from chainframe.llm import decontamination, mixing, near_dedup, pii, quality_rules
from chainframe.llm.common import discard_since, ready, shared_dir, table, written_so_far
from chainframe.llm.common import delete as delete_table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule of the full policy rejects go."""
    return quality_rules.keep_good(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id."""
    return near_dedup.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark window go."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind."""
    return pii.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix and how many words it takes of each."""
    return mixing.take_mix(docs)


def _ready(stage):
    return lambda spark, docs, sf_dir: stage(ready(spark), docs, sf_dir)


STAGES = [
    ("quality_rules", _ready(quality_stage)),
    ("near_dedup", _ready(near_dedup_stage)),
    ("decontamination", _ready(decontamination_stage)),
    ("pii", _ready(pii_stage)),
    ("mixing", _ready(mixing_stage)),
]

#: The PII stage has no SQL form; a test holds run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        mark = written_so_far()
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        discard_since(spark, mark)
        if before:
            delete_table(spark, before)
        before = path
    return docs
