"""Chat formatting from reply trees: iterative self-joins find root-to-leaf paths, branches are ranked, each chosen path is one conversation.

The self-joins double: round k joins each message's ancestor of 2^k steps with its own, so a tree of depth d needs
log2(d) rounds and each message has one row a round. The messages of a chosen leaf's path are marked by the same tables,
from the longest step down.

Template: ``[INST] user [/INST]``, ``assistant</s>``, ``<<SYS>>system<</SYS>>``, and ``[ROLE=name]text[/ROLE]`` for other roles.
Inside texts a backslash goes before every backslash and control string, which is undone on reading.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut

# The control strings.
CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE=", "[/ROLE]", "\\"]
_ESCAPE = "(" + "|".join(re.escape(c) for c in CONTROLS) + ")"
_TURN = re.compile(r"\[INST\] (?P<user>(?:\\[\s\S]|(?!\[/INST\])[\s\S])*?) \[/INST\]|<<SYS>>(?P<system>(?:\\[\s\S]|(?!<</SYS>>)[\s\S])*?)<</SYS>>|\[ROLE=(?P<role>(?:\\[\s\S]|[^\]\\])*?)\](?P<other>(?:\\[\s\S]|(?!\[/ROLE\])[\s\S])*?)\[/ROLE\]|(?P<assistant>(?:\\[\s\S]|(?!</s>)[\s\S])*?)</s>")


def once(messages: DataFrame) -> DataFrame:
    """One row a node_id, that with the least other values (in the order of the columns, null first); rows without a node_id go."""
    rest = [c for c in messages.columns if c != "node_id"]
    one = messages.where("node_id is not null").groupBy("node_id").agg(F.min(F.struct(*rest)).alias("one"))
    return one.select(*(F.col("node_id") if c == "node_id" else F.col(f"one.{c}").alias(c) for c in messages.columns))


def paths(messages: DataFrame, top: int = 1) -> DataFrame:
    """``(tree_id, leaf_id, node_id, depth)``: the messages on the ``top`` best root-to-leaf paths of each tree.

    ``messages``: tree_id, node_id, parent_id (null or unknown: a root) and score (null: 0). A branch's score
    is the mean over its messages; ties go to the smaller leaf. Messages on a cycle have no root and are left out, and so are
    those without a node_id; rows that repeat one should be made one by :func:`once` before.
    """
    nodes = messages.select("tree_id", F.col("node_id").alias("node"), F.col("parent_id").alias("up"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("s"))
    ids = nodes.select(F.col("node").alias("known"))
    first = nodes.join(ids, F.col("up") == F.col("known"), "left").select("tree_id", "node", F.col("known").alias("up"), "s", F.lit(1).alias("d"))
    state = cut(first)
    whole_first, jumps = state, []
    more = state.where("up is not null").count()
    while more:
        # only messages whose root isn't reached yet are joined
        active = state.where("up is not null")
        jumps.append(active.select(F.col("node").alias("from"), "up"))
        up = state.select(F.col("node").alias("n2"), F.col("up").alias("u2"), F.col("s").alias("s2"), F.col("d").alias("d2"))
        moved = cut(active.join(up, active["up"] == up["n2"]).select("tree_id", "node", F.col("u2").alias("up"), (F.col("s") + F.col("s2")).alias("s"), (F.col("d") + F.col("d2")).alias("d")))
        state = state.where("up is null").unionByName(moved)
        left = moved.where("up is not null").count()
        if left == more:  # only cycles are left
            break
        more = left
    whole = state.where("up is null")
    inner = whole_first.where("up is not null").select(F.col("up").alias("inner")).distinct()
    leaves = whole.join(inner, whole["node"] == inner["inner"], "left_anti").withColumn("mean", F.col("s") / F.col("d"))
    best = Window.partitionBy("tree_id").orderBy(F.desc("mean"), "node")
    marked = leaves.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select(F.col("node").alias("leaf"), "node")
    for jump in reversed(jumps):
        marked = cut(marked.union(marked.join(jump, marked["node"] == jump["from"]).select("leaf", F.col("up").alias("node"))).distinct())
    return marked.join(whole, "node").select("tree_id", F.col("leaf").alias("leaf_id"), F.col("node").alias("node_id"), F.col("d").alias("depth"))


def format_paths(messages: DataFrame, chosen: DataFrame) -> DataFrame:
    """``(tree_id, leaf_id, formatted, loss_spans)``: each path as one string, and the spans (code points) of its assistant texts in it."""
    text = F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), _ESCAPE, r"\\$1")
    role = F.coalesce(F.col("role"), F.lit(""))
    named = F.regexp_replace(role, r"([\\\]\[<])", r"\\$1")
    turn = (
        F.when(role == "user", F.concat(F.lit("[INST] "), text, F.lit(" [/INST]")))
        .when(role == "assistant", F.concat(text, F.lit("</s>")))
        .when(role == "system", F.concat(F.lit("<<SYS>>"), text, F.lit("<</SYS>>")))
        .otherwise(F.concat(F.lit("[ROLE="), named, F.lit("]"), text, F.lit("[/ROLE]")))
    )
    one = messages.select("node_id", turn.alias("turn"), (role == "assistant").alias("loss"))
    upto = F.sum(F.char_length("turn")).over(Window.partitionBy("tree_id", "leaf_id").orderBy("depth"))
    each = chosen.join(one, "node_id").withColumn("b", upto).withColumn("a", F.col("b") - F.char_length("turn"))
    whole = each.groupBy("tree_id", "leaf_id").agg(F.array_sort(F.collect_list(F.struct("depth", "turn", "loss", "a", "b"))).alias("t"))
    spans = F.expr("transform(filter(t, x -> x.loss), x -> struct(int(x.a) as a, int(x.b - 4) as b))")
    return whole.select("tree_id", "leaf_id", F.concat_ws("", F.expr("transform(t, x -> x.turn)")).alias("formatted"), spans.alias("loss_spans"))


def unescape(text: str) -> str:
    return re.sub(r"\\([\s\S])", r"\1", text)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        role = next(k for k in ("user", "system", "role", "assistant") if m[k] is not None)
        out.append((unescape(m["role"]), unescape(m["other"])) if role == "role" else (role, unescape(m[role])))
        at = m.end()
    return out


def digests(formatted: DataFrame) -> DataFrame:
    """``(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)`` read back from the formatted strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column("formatted").to_pylist(), batch.column("loss_spans").to_pylist(), strict=True):
                turns = read_back(text)
                loss = "".join(unescape(text[s["a"] : s["b"]]) for s in spans)
                rows.append((len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 5
            types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("tree_id"), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select("tree_id", "formatted", "loss_spans").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def conversation_trees(conversations: DataFrame) -> DataFrame:
    """Reply trees ``(tree_id, node_id, parent_id, role, text, score)`` of a table of turns: each turn answers the one before.

    Turns are ordered by turn (null first), role and text. Rows with a null conv_id are one conversation, id null.
    """
    turns = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).withColumn("i", F.row_number().over(turns))
    name = lambda i: F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("null")), i.cast("string"))
    return rows.select(F.col("conv_id").alias("tree_id"), name(F.col("i")).alias("node_id"), F.when(F.col("i") > 1, name(F.col("i") - 1)).alias("parent_id"), "role", "text", F.lit(0.0).alias("score"))


def format_conversations(conversations: DataFrame) -> DataFrame:
    """Every conversation of a table of turns, formatted: ``(tree_id, leaf_id, formatted, loss_spans)``. An empty table gives no rows."""
    trees = cut(conversation_trees(conversations))
    return format_paths(trees, paths(trees))
