r"""Chat formatting from reply trees.

Messages point to the message they answer.  Iterative self-joins that double
their reach enumerate every root-to-leaf path in a logarithmic number of
rounds; branches are ranked by their mean score, and each chosen path becomes
one conversation.

Template: ``### role: text </turn>`` and a newline for each turn.  In texts and
roles a backslash, ``###`` and ``</turn>`` get a backslash in front, in roles a
colon as well, so every turn can be read back exactly.

Defined cases: null roles and texts are empty; a message whose parent does not
exist is a root; turns of one conversation with equal numbers come in the order
of role and text, and rows that repeat are turns of their own; a null turn
comes last; of branches with equal scores the smallest leaf wins; a null score
is 0; texts and conversations may be of any length, one conversation's turns
are one row in the end; a parent that follows its own answers is an error; no
messages, no conversations.  Columns besides those named are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard_since, sliced, written, written_so_far

_MOST_ROUNDS = 40
_ESCAPED = re.compile(r"\\(\\|###|</turn>|:)")
_CONTROL = re.compile(r"\\(?:\\|###|</turn>|:)|###|</turn>")
_COLON = re.compile(r"\\(?:\\|###|</turn>|:)|:")
ASSISTANT = "assistant"


def escape(text: str, role: bool = False) -> str:
    return re.sub(r"\\|###|</turn>|:" if role else r"\\|###|</turn>", lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text)


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The conversation and its loss mask: ranges of code points with the assistant's texts."""
    parts, mask, at = [], [], 0
    for role, text in turns:
        head, body, tail = f"### {escape(role, True)}: ", escape(text), " </turn>\n"
        if role == ASSISTANT:
            mask.append((at + len(head), at + len(head) + len(body)))
        parts += (head, body, tail)
        at += len(head) + len(body) + len(tail)
    return "".join(parts), mask


def read_turns(formatted: str) -> list[tuple[str, str]]:
    turns, start = [], None
    for m in _CONTROL.finditer(formatted):
        if m[0] == "###" and start is None:
            start = m.end() + 1
        elif m[0] == "</turn>":
            body = formatted[start : m.start() - 1]
            colon = next(c.start() for c in _COLON.finditer(body) if c[0] == ":")
            turns.append((unescape(body[:colon]), unescape(body[colon + 2 :])))
            start = None
    return turns


def linear_trees(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Conversations without links as trees: every turn answers the one before; a null turn comes last."""
    order = Window.partitionBy(conv_col).orderBy(F.col(turn_col).asc_nulls_last(), *(F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col)))
    rows = conversations.select(conv_col, turn_col, role_col, text_col).withColumn("_n", F.row_number().over(order).cast("long"))
    return rows.select(F.col(conv_col).alias("conv"), F.col("_n").alias("msg"), F.when(F.col("_n") > 1, F.col("_n") - 1).alias("parent"), F.col(role_col).alias("role"), F.col(text_col).alias("text"), F.lit(0.0).alias("score"))


def _on(left: str, right: str):
    return F.col(f"l.{left}").eqNullSafe(F.col(f"r.{right}")) & F.col("l.conv").eqNullSafe(F.col("r.conv"))


def paths(messages: DataFrame) -> DataFrame:
    """(conv, leaf, node, dist): the nodes of every leaf's path, ``dist`` counted from the leaf."""
    nodes = messages.select("conv", "msg")
    answers = messages.where(F.col("parent").isNotNull()).select("conv", "msg", F.col("parent").alias("up"))
    known = answers.alias("l").join(nodes.alias("r"), _on("up", "msg"), "left_semi").select("conv", "msg", "up")
    jump = written(known, "chat-jump")
    leaves = nodes.alias("l").join(jump.alias("r"), _on("msg", "up"), "left_anti")
    found = written(leaves.select("conv", F.col("msg").alias("leaf"), F.col("msg").alias("node"), F.lit(0).cast("long").alias("dist")), "chat-paths")
    for k in range(_MOST_ROUNDS):
        further = found.alias("l").join(jump.alias("r"), _on("node", "msg")).select("l.conv", "l.leaf", F.col("r.up").alias("node"), (F.col("l.dist") + (1 << k)).alias("dist"))
        more = written(further, "chat-paths")
        if more.isEmpty():
            return found
        found = found.unionByName(more)
        jump = written(jump.alias("l").join(jump.alias("r"), _on("up", "msg")).select("l.conv", "l.msg", F.col("r.up").alias("up")), "chat-jump")
    raise ValueError("a message answers one of its own answers")


def chosen_paths(messages: DataFrame, best: int = 1) -> DataFrame:
    """The ``best`` highest-scored branches of every root, with their turns in order."""
    mark = written_so_far()
    steps = paths(messages).alias("l").join(messages.alias("r"), _on("node", "msg")).select("l.conv", "l.leaf", "l.node", "l.dist", "r.role", "r.text", "r.score")
    steps = written(steps, "chat-steps")
    discard_since(messages.sparkSession, mark, steps)
    per_leaf = steps.groupBy("conv", "leaf").agg(F.avg(F.coalesce("score", F.lit(0.0))).alias("mean"), F.max(F.struct("dist", "node")).alias("top"))
    rank = F.row_number().over(Window.partitionBy("conv", "top.node").orderBy(F.col("mean").desc(), F.col("leaf").asc()))
    good = per_leaf.withColumn("rank", rank).where(F.col("rank") <= best).select("conv", "leaf")
    kept = steps.alias("l").join(good.alias("r"), _on("leaf", "leaf"), "left_semi")
    turn = F.struct((-F.col("dist")).alias("o"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return kept.groupBy("conv", "leaf").agg(F.sort_array(F.collect_list(turn)).alias("turns"))


def format_trees(messages: DataFrame, best: int = 1) -> DataFrame:
    """(conv, leaf, formatted, mask) of each chosen path."""
    kind = messages.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            made = [format_turns([(t["role"], t["text"]) for t in turns]) for turns in batch.column("turns").to_pylist()]
            mask = pa.array([[{"s": s, "e": e} for s, e in m[1]] for m in made], pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("leaf"), pa.array([m[0] for m in made], pa.string()), mask], ["conv", "leaf", "formatted", "mask"])

    return chosen_paths(messages, best).mapInArrow(run, f"conv {kind}, leaf long, formatted string, mask array<struct<s:long,e:long>>")


def digest(conversations: DataFrame) -> DataFrame:
    """The query's columns, read back from the formatted conversations."""
    spark = conversations.sparkSession
    own = spark.sql(r"SELECT -7L AS conv_id, t AS turn, element_at(array('user', 'assistant'), int(t) + 1) AS role, r'\### Assistant: </turn> ok' AS text FROM (SELECT explode(array(0L, 1L)) AS t)")
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            out = []
            for formatted, mask in zip(batch.column("formatted").to_pylist(), batch.column("mask").to_pylist(), strict=True):
                turns = read_turns(formatted)
                said = "".join(f"{r}\n{t}\n" for r, t in turns)
                loss = "".join(unescape(formatted[m["s"] : m["e"]]) for m in mask)
                out.append((len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(formatted)))
            cols = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("conv"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return format_trees(linear_trees(rows)).select("conv", "formatted", "mask").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
