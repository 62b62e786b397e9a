"""Chat formatting of reply trees.

Messages know their parent. Iterative self-joins double the distance of a
pointer to the ancestors until every message has reached its root, which gives
depth and score of every root-to-leaf path without walking it. The best branches
of each tree are chosen, their paths listed by the same pointers, and each path
is formatted as one conversation.

A formatted conversation is a run of rows, one per turn, whose pieces joined in
order are its text; so a conversation of any length is written and read as a
stream.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common as C

# The template: "### role: text</turn>\n". A backslash in a text or role is
# doubled, and one is put before each control string.
OPEN, CLOSE, END = "### ", ": ", "</turn>\n"
# nothing is tried twice, so a turn of any length is parsed in little memory
TURN = re.compile(r"### ((?:[^\\:]++|\\.)*+): ((?:[^\\<]++|\\.|<(?!/turn>))*+)</turn>\n", re.S)
ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    text = F.replace(text, F.lit("###"), F.lit("\\###"))
    return F.replace(text, F.lit("</turn>"), F.lit("\\</turn>"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(":"), F.lit("\\:"))


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def best_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """Turns of the chosen paths: ``tree``, ``leaf``, ``rank``, ``pos`` (0 at the
    root), ``id``.

    ``messages``: ``tree``, ``id`` (unique, not null), ``parent``, ``score``. A
    message whose parent is null or not there is a root; null scores count 0;
    a null tree is a tree. Of each tree the ``branches`` leaves with the highest
    mean score of their path are kept, longer paths first in ties, then smaller
    ids. A cycle of parents raises an error. An empty table gives no turns.
    """
    start = messages.select("tree", "id", F.col("parent").alias("anc"), F.lit(1).cast("long").alias("depth"), F.coalesce("score", F.lit(0.0)).cast("double").alias("total"))
    known = messages.select(F.col("id").alias("anc"), F.lit(True).alias("_there"))
    state = start.join(known, "anc", "left").withColumn("anc", F.when(F.col("_there"), F.col("anc"))).drop("_there")
    state = C.stored(state.select("tree", "id", "anc", "depth", "total"), "chat-level")
    levels, most = [], max(1, state.count()).bit_length() + 1
    while not state.where("anc is not null").isEmpty():
        if len(levels) > most:
            raise ValueError("the parents of some messages form a cycle")
        # messages that have reached their root stand aside: only the others are joined
        done, moving = state.where("anc is null"), state.where("anc is not null")
        levels.append(moving.select(F.col("id").alias("node"), F.col("anc").alias("_up")))
        further = state.select(F.col("id").alias("anc"), F.col("anc").alias("_anc"), F.col("depth").alias("_depth"), F.col("total").alias("_total"))
        moved = moving.join(further, "anc").select("tree", "id", F.col("_anc").alias("anc"), (F.col("depth") + F.col("_depth")).alias("depth"), (F.col("total") + F.col("_total")).alias("total"))
        state = C.stored(done.unionByName(moved), "chat-level")
    inner = messages.where("parent is not null").select(F.col("parent").alias("id")).distinct()
    order = Window.partitionBy("tree").orderBy((F.col("total") / F.col("depth")).desc(), F.col("depth").desc(), "id")
    leaves = state.join(inner, "id", "left_anti").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= branches)
    pairs = leaves.select("tree", F.col("id").alias("leaf"), "rank", F.col("id").alias("node"), (F.col("depth") - 1).alias("pos"))
    # jumps of 2^k steps, largest first: each ancestor is reached once, by the binary form of its distance
    for k in reversed(range(len(levels))):
        both = F.array(F.struct(F.col("node").alias("node"), F.col("pos").alias("pos")), F.when(F.col("_up").isNotNull(), F.struct(F.col("_up").alias("node"), (F.col("pos") - (1 << k)).alias("pos"))))
        pairs = pairs.join(levels[k], "node", "left").select("tree", "leaf", "rank", F.explode(F.array_compact(both)).alias("_p")).select("tree", "leaf", "rank", "_p.node", "_p.pos")
    return pairs.select("tree", "leaf", "rank", "pos", F.col("node").alias("id"))


def as_chains(rows: DataFrame, tree_col: str, order_cols: list[str]) -> DataFrame:
    """Linear conversations as reply trees: ``rows`` with ``tree``, ``id`` and
    ``parent``, where a row answers the row before it in its conversation. Rows
    are range-sorted and stored; ids are gapless over all, so the row before is
    found by an equi join, and a long conversation is spread over tasks."""
    names = {f"_k{i}": rows[f"`{c}`"] for i, c in enumerate([tree_col, *order_cols])}
    packed = C.packed(rows, **names, _all=F.xxhash64(*[rows[f"`{c}`"] for c in rows.columns]))
    numbered = C.numbered(packed, [*names, "_all"], "chat-rows").select(F.col("_index").alias("id"), F.col("_k0").alias("tree"), C.ROW)
    earlier = numbered.select((F.col("id") + 1).alias("id"), F.col("tree").alias("_tree"), F.lit(True).alias("_there"))
    return numbered.join(earlier, "id", "left").select("id", "tree", F.when(F.col("_there") & F.col("tree").eqNullSafe(F.col("_tree")), F.col("id") - 1).alias("parent"), C.ROW)


def format_turns(turns: DataFrame, *, loss_role: str = "assistant") -> DataFrame:
    """Formatted pieces of turns (``conv_id``, ``branch``, ``pos``, ``role``,
    ``text``): ``piece``, and ``loss_begin``, ``loss_end``, the code points of it
    under the loss mask (equal where there are none). Null roles and texts are
    empty."""
    role, text = F.coalesce("role", F.lit("")), escape(F.coalesce("text", F.lit("")))
    head = F.concat(F.lit(OPEN), escape_role(role), F.lit(CLOSE))
    begin = F.length(head)
    return turns.select(
        "conv_id", "branch", "pos",
        F.concat(head, text, F.lit(END)).alias("piece"),
        begin.alias("loss_begin"),
        (begin + F.when(role == loss_role, F.length(text)).otherwise(0)).alias("loss_end"),
    )


def write_formatted(pieces: DataFrame, path: str) -> None:
    pieces.repartitionByRange("conv_id", "branch", "pos").sortWithinPartitions("conv_id", "branch", "pos").write.parquet(path)


def read_formatted(spark: SparkSession, path: str) -> DataFrame:
    """Digests of formatted conversations, from their text and loss mask alone:
    the text is parsed by the template and unescaped in one pass, in order, with
    one turn in memory at a time. One task reads a conversation, however long, as
    its digests run from turn to turn."""
    pieces = spark.read.schema("conv_id long, branch long, pos long, piece string, loss_begin int, loss_end int").parquet(path)
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, done = None, None, []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*done, strict=True), kinds, strict=True)], names=names)

        def close() -> None:
            if held["rest"]:
                raise ValueError(f"conversation {now[0]} doesn't end with a turn")
            done.append((now[0], held["turns"], held["all"].hexdigest(), held["loss_chars"], held["loss"].hexdigest(), held["chars"]))

        for batch in batches:
            for conv, branch, piece, a, b in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "branch", "piece", "loss_begin", "loss_end")), strict=True):
                if (conv, branch) != now:
                    if now:
                        close()
                    now, held = (conv, branch), {"rest": "", "turns": 0, "all": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0}
                text, at = held["rest"] + piece, 0
                while m := TURN.match(text, at):
                    held["all"].update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
                    held["turns"] += 1
                    at = m.end()
                held["rest"] = text[at:]
                loss = unescape(piece[a:b])
                held["loss"].update(loss.encode())
                held["loss_chars"] += len(loss)
                held["chars"] += len(piece)
            if done:
                yield out()
                done = []
        if now:
            close()
            yield out()

    ordered = pieces.repartition("conv_id", "branch").sortWithinPartitions("conv_id", "branch", "pos")
    return ordered.mapInArrow(digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: every conversation formatted, written, and read back."""
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = C.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    messages = C.stored(as_chains(rows, "conv_id", ["turn"]), "chat-messages")
    paths = best_paths(messages.withColumn("score", F.lit(0.0)), branches=1)
    turns = paths.join(messages.select("id", F.col(f"{C.ROW}.role").alias("role"), F.col(f"{C.ROW}.text").alias("text")), "id")
    path = C.shared_path(spark, "chat-formatted")
    write_formatted(format_turns(turns.select(F.col("tree").alias("conv_id"), F.col("leaf").alias("branch"), "pos", "role", "text")), path)
    return read_formatted(spark, path)


OP9_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, role, COALESCE(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id, COUNT(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       COALESCE(SUM(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(COALESCE(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       SUM(length('### ' || role || ': ' || replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>') || '</turn>' || chr(10)))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""
