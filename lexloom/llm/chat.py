"""Chat formatting: reply trees to conversations.

Messages form trees by parent. The chosen branch of each tree is the root-to-leaf path with the highest score. Paths are
found by pointer doubling, self-joins of narrow id tables whose number is the logarithm of the depth; texts join at the
end, once. The template is <s>[role]text</s> for each turn. Backslash, <, [ and ] are escaped by a backslash inside roles
and texts, so no text can hold a control string, and unescaping gives it back exactly.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.session import materialize


def linear_tree(df: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The rows of conversations as messages (conv, msg, parent, role, text, score): each turn replies to the one before.

    Order is by turn, null last, then role and text, so ties and repeated rows have one order. Null roles and texts are
    empty. Rows with a null conversation id are one conversation. Other columns are not read.
    """
    m = df.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    w = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    at = F.row_number().over(w).cast("long")
    m = m.withColumn("msg", at).withColumn("parent", F.when(F.col("msg") > 1, F.col("msg") - 1))
    return m.select("conv", "msg", "parent", "role", "text", F.lit(0.0).alias("score"))


def chosen_paths(messages: DataFrame) -> DataFrame:
    """conv, root, msg, turn (0 at the root) of the best root-to-leaf path of every tree.

    messages: conv, msg (unique in a conversation), parent (null at roots), score (null: 0). A path's score is the sum of its
    messages'; ties go to the deeper path, then the smaller leaf. A message whose parent is missing is a root. Messages
    on a cycle have no root and are in no path.
    """
    known = messages.select(
        F.struct("conv", "msg").alias("id"), F.when(F.col("parent").isNotNull(), F.struct("conv", F.col("parent").alias("msg"))).alias("wish"),
        F.coalesce("score", F.lit(0.0)).cast("double").alias("score"),
    )
    parents = known.select(F.col("id").alias("up"), F.col("score").alias("up_score"))
    nodes = known.join(parents, _same("wish", "up"), "left").select("id", "up", "score", F.coalesce("up_score", F.lit(0.0)).alias("gain"))
    # up is the ancestor 2^k above, step and gain count and sum the ancestors up to it, root is set once they reach it.
    # A message that has reached its root is done and joins no more, so a few deep trees cost the others nothing.
    step = F.when(F.col("up").isNull(), 0).otherwise(1).cast("long")
    at = materialize(nodes.withColumn("step", step).withColumn("root", F.when(F.col("up").isNull(), F.col("id"))), "chat-jumps")
    every, open_ = at.filter("up IS NULL"), at.filter("up IS NOT NULL")
    jumps, limit = [open_.select("id", "up")], at.count()
    while (1 << len(jumps)) <= 2 * limit and not open_.isEmpty():
        b = every.unionByName(open_).select(*[F.col(c).alias(f"b_{c}") for c in ("id", "up", "gain", "step", "root")])
        at = open_.join(b, _same("up", "b_id")).select(
            "id", F.col("b_up").alias("up"), "score", (F.col("gain") + F.col("b_gain")).alias("gain"), (F.col("step") + F.col("b_step")).alias("step"), F.col("b_root").alias("root")
        )
        at = materialize(at, "chat-jumps")
        every, open_ = every.unionByName(at.filter("up IS NULL")), at.filter("up IS NOT NULL")
        jumps.append(open_.select("id", "up"))
    inner = jumps[0].select(F.col("up").alias("p")).distinct()
    leaves = every.join(inner, _same("id", "p"), "left_anti")
    rank = F.struct((F.col("gain") + F.col("score")).alias("score"), "step", (-F.col("id.msg")).alias("msg"))
    best = leaves.groupBy("root").agg(F.max_by(F.struct("id", "step"), rank).alias("leaf"))
    path = best.select("root", "leaf.id", F.col("leaf.step").alias("turn"))
    for k in range(len(jumps) - 1, -1, -1):  # the leaf, then with each table all nodes 2^k above those found
        j = jumps[k].select(F.col("id").alias("j"), F.col("up").alias("j_up"))
        path = materialize(path, "chat-path")  # it is read twice
        path = path.unionByName(path.join(j, _same("id", "j")).select("root", F.col("j_up").alias("id"), (F.col("turn") - (1 << k)).alias("turn")))
    return path.select("id.conv", F.col("root.msg").alias("root"), "id.msg", "turn")


def _same(a: str, b: str) -> Column:
    return F.col(f"{a}.conv").eqNullSafe(F.col(f"{b}.conv")) & (F.col(f"{a}.msg") == F.col(f"{b}.msg"))


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"([\\<\[\]])", r"\\$1")


def format_paths(messages: DataFrame, path: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row for each path: conv, root, formatted, loss_spans.

    loss_spans are (start, end) offsets in code points of the texts of loss_role inside formatted, in order. The pieces
    of a conversation meet in one row, as the result demands; nothing else is gathered.
    """
    m = messages.select(F.col("conv").alias("c"), F.col("msg").alias("m"), "role", "text")
    turns = path.join(m, F.col("conv").eqNullSafe(F.col("c")) & (F.col("msg") == F.col("m")))
    head = F.concat(F.lit("<s>["), escape("role"), F.lit("]"))
    turns = turns.withColumns({"head": head, "body": escape("text"), "loss": F.col("role") == loss_role})
    turns = turns.withColumn("piece", F.concat("head", "body", F.lit("</s>")))
    w = Window.partitionBy("conv", "root").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = F.sum(F.length("piece")).over(w) - F.length("piece") + F.length("head")
    turns = turns.withColumn("span", F.struct(first.cast("int").alias("start"), (first + F.length("body")).cast("int").alias("end")))
    g = turns.groupBy("conv", "root").agg(F.array_sort(F.collect_list(F.struct("turn", "piece", "loss", "span"))).alias("pieces"))
    spans = F.transform(F.filter("pieces", lambda x: x["loss"]), lambda x: x["span"])
    return g.select("conv", "root", F.array_join(F.transform("pieces", lambda x: x["piece"]), "").alias("formatted"), spans.alias("loss_spans"))


_TURN = re.compile(r"<s>\[((?:[^\\\[\]<]|\\.)*)\]((?:[^\\<\[\]]|\\.)*)</s>", re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def unescape(s: str) -> str:
    return _ESCAPED.sub(r"\1", s)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


def _parse_turns(formatted: pa.Array) -> pa.Array:
    kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
    return pa.array([[{"role": r, "text": t} for r, t in parse(x)] for x in formatted.to_pylist()], kind)


def _loss_texts(formatted: pa.Array, spans: pa.Array) -> pa.Array:
    return pa.array([[unescape(x[s["start"] : s["end"]]) for s in y] for x, y in zip(formatted.to_pylist(), spans.to_pylist(), strict=True)], pa.list_(pa.string()))


def parse_turns(formatted: Column) -> Column:
    """The turns read back from formatted conversations."""
    return F.arrow_udf(_parse_turns, "array<struct<role:string,text:string>>")(formatted)


def loss_texts(formatted: Column, spans: Column) -> Column:
    """What the loss mask covers, unescaped, span by span."""
    return F.arrow_udf(_loss_texts, "array<string>")(formatted, spans)


def format_conversations(df: DataFrame, **names) -> DataFrame:
    """linear_tree(), chosen_paths() and format_paths() of a conversations table; an empty table gives an empty result."""
    messages = materialize(linear_tree(df, **names), "chat-messages")
    return format_paths(messages, chosen_paths(messages))
