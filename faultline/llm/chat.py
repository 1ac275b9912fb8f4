"""Chat formatting of reply trees: every chosen root-to-leaf path becomes one conversation.

Paths are enumerated by iterative self-joins that double their reach: a pointer
table holds each message's 2**k-th ancestor, and a path table that knows the
ancestors of every leaf up to distance 2**k gains those up to 2**(k + 1) by one
join.  A tree of depth d takes log2(d) rounds.

A turn is written as ``<|im_start|>role\\ntext<|im_end|>\\n``.  Inside roles and
texts a backslash, and a ``<`` before ``|``, are escaped with a backslash (in
roles a line feed as well), so no text can forge a control string and every
conversation can be read back exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.shared import discard, stored

START, END = "<|im_start|>", "<|im_end|>"
LEARNED_ROLE = "assistant"
_TURN = regex.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", regex.DOTALL)
_ESCAPED = regex.compile(r"\\(.)", regex.DOTALL)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def unescape_role(role: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], role)


def format_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """(the conversation, the (start, length) of each learned text in it, in code points)."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape_role(role)}\n", escape(text)
        if role == LEARNED_ROLE:
            spans.append((at + len(head), len(body)))
        part = f"{head}{body}{END}\n"
        parts.append(part)
        at += len(part)
    return "".join(parts), spans


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation; raises if anything is left over."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError("not a formatted conversation")
        turns.append((unescape_role(m[1]), unescape(m[2])))
        at = m.end()
    return turns


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        done = [format_turns([(t["role"], t["text"]) for t in turns]) for turns in batch.column(batch.num_columns - 1).to_pylist()]
        spans = pa.array([[{"start": s, "length": n} for s, n in x[1]] for x in done], pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([x[0] for x in done], pa.string()), spans], [*batch.schema.names[:-1], "formatted", "loss_spans"])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for conv, formatted, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            turns = parse_turns(formatted)
            learned = "".join(unescape(formatted[s["start"] : s["start"] + s["length"]]) for s in spans)
            every = "".join(f"{role}\n{text}\n" for role, text in turns)
            rows.append((conv, len(turns), hashlib.sha256(every.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest(), len(formatted)))
        columns = list(zip(*rows, strict=True)) or [[]] * 6
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def as_reply_tree(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, node, parent, role, text) of linear conversations: each row replies to the one before it.

    Rows of a conversation are ordered by (turn, role, text), nulls first, so repeated
    turns each keep a place.
    """
    order = Window.partitionBy("conv_id").orderBy("_turn", "role", "text")
    rows = turns.select(
        F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("_turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    numbered = rows.withColumn("node", F.row_number().over(order).cast("long"))
    return numbered.select("conv_id", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text")


def _same(a: str, b: str) -> Column:
    return F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col(a) == F.col(b))


def _without_circles(jump: DataFrame, longest: int) -> DataFrame:
    """The reply links (conv_id, node, to) without the one of each circle's smallest node, which becomes a root.

    Pointers double their reach, and carry the smallest node passed, until they have gone
    further than any path; whatever they point at then is on a circle.
    """
    walk, reach = jump.withColumn("low", F.col("to")), 1
    while reach < longest:
        step = walk.select(F.col("conv_id").alias("_c"), F.col("node").alias("_n"), F.col("to").alias("_to"), F.col("low").alias("_low"))
        last, walk = walk, stored(walk.join(step, _same("to", "_n")).select("conv_id", "node", F.col("_to").alias("to"), F.least("low", "_low").alias("low")), "walks")
        if reach > 1:
            discard(last)
        reach *= 2
    broken = walk.where("node = low").join(walk.select(F.col("conv_id").alias("_c"), F.col("to").alias("_t")).distinct(), _same("node", "_t"), "left_semi")
    return stored(jump.join(broken.select(F.col("conv_id").alias("_c"), F.col("node").alias("_n")), _same("node", "_n"), "left_anti"), "parents")


def leaf_paths(messages: DataFrame) -> DataFrame:
    """(conv_id, leaf, node, up): every message on the path from each leaf to its root, ``up`` replies above the leaf.

    Conversations are matched null-safely, and of the parents that rows of one node name
    the smallest counts.  A parent that does not exist makes its child a root.  Where
    messages reply in a circle, the smallest of them becomes the root of the others.
    """
    links = messages.groupBy("conv_id", "node").agg(F.min("parent").alias("parent"))
    known = links.select(F.col("conv_id").alias("_c"), F.col("node").alias("_n"))
    jump = links.join(known, _same("parent", "_n")).select("conv_id", "node", F.col("parent").alias("to"))
    jump = stored(jump, "parents")
    longest = links.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    paths = _paths(links, jump, longest)
    return paths if paths is not None else _paths(links, _without_circles(jump, longest), longest)


def _paths(links: DataFrame, jump: DataFrame, longest: int) -> DataFrame | None:
    """The leaf paths, or nothing if some pointer goes on for longer than a path can."""
    parents = jump.select(F.col("conv_id").alias("_c"), F.col("to").alias("_n")).distinct()
    leaves = links.select("conv_id", "node").join(parents, _same("node", "_n"), "left_anti")
    paths = stored(leaves.select("conv_id", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up")), "paths")
    reach, first = 1, jump
    while True:
        step = jump.select(F.col("conv_id").alias("_c"), F.col("node").alias("_n"), F.col("to").alias("_to"))
        if reach >= max(longest, 2):  # only circles are left
            return None if not jump.isEmpty() else paths
        further = paths.join(step, _same("node", "_n"))
        further = stored(further.select("conv_id", "leaf", F.col("_to").alias("node"), (F.col("up") + reach).alias("up")), "further")
        doubled = stored(jump.join(step, _same("to", "_n")).select("conv_id", "node", F.col("_to").alias("to")), "jumps")
        if jump is not first:
            discard(jump)
        if further.isEmpty() and doubled.isEmpty():
            return paths
        last, paths = paths, stored(paths.unionByName(further), "paths")
        discard(last, further)
        jump, reach = doubled, reach * 2


def format_conversations(messages: DataFrame, branches: int = 1, score: Column | None = None) -> DataFrame:
    """(conv_id, leaf, rank, score, n_turns, formatted, loss_spans) of the best paths of each conversation.

    ``messages`` has (conv_id, node, parent, role, text); of rows with one node in a
    conversation the first by (role, text) counts.  A path's score is the mean of ``score`` over its messages (default:
    learned messages count one for a text, none for an empty one); the ``branches``
    best leaves are kept, ties going to the smaller leaf.  Null roles and texts are
    empty, extra columns are not carried, and an empty table gives no rows.  A
    conversation is one string, so its messages meet in one row: its size, not the
    size of the table, is what a task must hold.
    """
    value = score if score is not None else F.when((F.col("role") == LEARNED_ROLE) & (F.length("text") > 0), 1.0).otherwise(0.0)
    texts = messages.groupBy("conv_id", "node").agg(F.min(F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))).alias("_m"))
    held = texts.select("conv_id", "node", "_m.role", "_m.text").withColumn("_value", value)
    paths = leaf_paths(messages)
    named = held.select(F.col("conv_id").alias("_c"), F.col("node").alias("_n"), "role", "text", "_value")
    full = paths.join(named, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("node") == F.col("_n")))
    scores = full.groupBy("conv_id", "leaf").agg(F.avg("_value").alias("score"))
    best = Window.partitionBy("conv_id").orderBy(F.col("score").desc(), "leaf")
    chosen = scores.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= branches)
    chosen = chosen.select(F.col("conv_id").alias("_cc"), F.col("leaf").alias("_l"), "rank", "score")
    kept = full.drop("_c", "_n").join(chosen, F.col("conv_id").eqNullSafe(F.col("_cc")) & (F.col("leaf") == F.col("_l")))
    turns = kept.groupBy("conv_id", "leaf").agg(F.first("rank").alias("rank"), F.first("score").alias("score"), F.sort_array(F.collect_list(F.struct((-F.col("up")).alias("at"), "role", "text"))).alias("turns"))
    rows = turns.select("conv_id", "leaf", "rank", "score", F.size("turns").cast("long").alias("n_turns"), "turns")
    return rows.mapInArrow(_format, "conv_id long, leaf long, rank int, score double, n_turns long, formatted string, loss_spans array<struct<start:long,length:long>>")


def read_back(formatted: DataFrame) -> DataFrame:
    """What a conversation's string and loss spans say when they are parsed again."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(_digest, schema)
