"""Conversations from reply trees.

Messages point to the message they answer. Self-joins that double in reach give
each message's ancestors at the distances 1, 2, 4 and so on; from these the path
from every leaf to its root is unfolded, one row per step. The branches are
ranked by score within their tree, and each chosen one is written as one
conversation:

    <s>role[INST]text[/INST]</s><s>role[INST]text[/INST]</s>...

Inside roles and texts ``\\``, ``<`` and ``[`` are written ``\\e``, ``\\l`` and
``\\b``, so no mark can occur there and the writing can be undone. The loss mask
is the list of character ranges that hold assistant texts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from laplake.llm.frames import staged
from laplake.operators.groups import join_on

TURN, OPEN, CLOSE = "<s>", "[INST]", "[/INST]</s>"
ASSISTANT = "assistant"


def _replaced(text: Column, pairs: list[tuple[str, str]]) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def escaped(text: Column) -> Column:
    return _replaced(text, [("\\", "\\e"), ("<", "\\l"), ("[", "\\b")])


def unescaped(text: Column) -> Column:
    return _replaced(text, [("\\l", "<"), ("\\b", "["), ("\\e", "\\")])


def turns_as_replies(conversations: DataFrame, tree: str = "conv_id", turn: str = "turn",
                     role: str = "role", text: str = "text") -> DataFrame:
    """Conversations with numbered turns as trees of one branch: (tree, node, parent, role, text, score).

    Equal turn numbers follow each other by role and text; repeated rows stay.
    """
    order = Window.partitionBy(tree).orderBy(turn, role, text)
    node = F.row_number().over(order).cast("long")
    return conversations.select(
        F.col(tree).alias("tree"), node.alias("node"), F.nullif(node - 1, F.lit(0)).alias("parent"),
        F.col(role).alias("role"), F.col(text).alias("text"), F.lit(0.0).alias("score"))


def ancestors(messages: DataFrame) -> list[DataFrame]:
    """(tree, node, above) at the distances 1, 2, 4, ... for the messages that have such an ancestor.

    Below and on a circle there is no end of ancestors; the last table is then at a
    distance of more than the number of all messages.
    """
    links = messages.select("tree", "node", "parent")
    total = links.count()
    known = links.select("tree", F.col("node").alias("parent"))
    found = join_on(links.where(F.col("parent").isNotNull()), known, ["tree", "parent"], "left_semi")
    tables, reach = [staged(found.select("tree", "node", F.col("parent").alias("above")), "ancestors")], 1
    while reach <= total and not tables[-1].isEmpty():
        last = tables[-1]
        upper = last.select("tree", F.col("node").alias("above"), F.col("above").alias("_above"))
        further = join_on(last, upper, ["tree", "above"], "inner").select("tree", "node", F.col("_above").alias("above"))
        tables.append(staged(further, "ancestors"))
        reach *= 2
    return tables


def reply_paths(messages: DataFrame) -> DataFrame:
    """(tree, leaf, node, at): one row per message on the path of each leaf; ``at`` grows from the root.

    A message without parent, or whose parent is missing, is a root. Leaves below
    a circle have no path. Node ids are unique within a tree; the tree id may be
    null and is then a tree of its own.
    """
    tables = ancestors(messages)
    parents = messages.where(F.col("parent").isNotNull()).select("tree", F.col("parent").alias("node")).distinct()
    leaves = join_on(messages.select("tree", "node"), parents, ["tree", "node"], "left_anti")
    leaves = join_on(leaves, tables[-1].select("tree", "node"), ["tree", "node"], "left_anti")
    parts = [staged(leaves.select(
        "tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("at")), "reply-paths")]
    for power in reversed(range(len(tables) - 1)):
        above = join_on(reduce(DataFrame.union, parts), tables[power], ["tree", "node"], "inner").select(
            "tree", "leaf", F.col("above").alias("node"), (F.col("at") - (1 << power)).alias("at"))
        parts.append(staged(above, "reply-paths"))
    return reduce(DataFrame.union, parts)


def branches(messages: DataFrame, best: int | None = 1) -> DataFrame:
    """Messages of the chosen branches: (tree, leaf, rank, score, at, role, text).

    A branch's score is the mean of its messages' scores, null counting as 0. The
    ``best`` branches of each tree are taken, or all; equal scores by leaf id.
    """
    steps = reply_paths(messages)
    scores = messages.select("tree", "node", F.coalesce("score", F.lit(0.0)).alias("score"))
    scored = join_on(steps, scores, ["tree", "node"], "inner").groupBy("tree", "leaf").agg(F.avg("score").alias("score"))
    ranked = scored.withColumn(
        "rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "leaf")))
    if best is not None:
        ranked = ranked.where(F.col("rank") <= best)
    chosen = join_on(steps, ranked, ["tree", "leaf"], "inner")
    return join_on(chosen, messages.select("tree", "node", "role", "text"), ["tree", "node"], "inner")


def format_branches(chosen: DataFrame) -> DataFrame:
    """One row per branch: (tree, leaf, rank, score, formatted, loss).

    ``loss`` lists the character ranges [begin, end) of assistant texts. Null roles
    and texts are written as empty.
    """
    role, text = escaped(F.coalesce("role", F.lit(""))), escaped(F.coalesce("text", F.lit("")))
    start = F.concat(F.lit(TURN), role, F.lit(OPEN))
    pieces = chosen.withColumns({"_start": start, "_text": text})
    order = Window.partitionBy("tree", "leaf").orderBy("at")
    size = F.length("_start") + F.length("_text") + F.lit(len(CLOSE))
    pieces = pieces.withColumn("_end", F.sum(size).over(order) - len(CLOSE))
    span = F.when(F.col("role") == ASSISTANT, F.struct(
        (F.col("_end") - F.length("_text")).alias("begin"), F.col("_end").alias("end")))
    held = F.sort_array(F.collect_list(F.struct(
        "at", F.concat("_start", "_text", F.lit(CLOSE)).alias("piece"), span.alias("span"))))
    whole = pieces.groupBy("tree", "leaf").agg(F.first("rank").alias("rank"), F.first("score").alias("score"), held.alias("_held"))
    return whole.select(
        "tree", "leaf", "rank", "score", F.concat_ws("", F.transform("_held", lambda p: p["piece"])).alias("formatted"),
        F.filter(F.transform("_held", lambda p: p["span"]), lambda s: s.isNotNull()).alias("loss"))


def read_turns(formatted: Column | str) -> Column:
    """The turns of a formatted conversation, as an array of (role, text)."""
    column = F.col(formatted) if isinstance(formatted, str) else formatted
    parts = F.slice(F.split(column, TURN), F.lit(2), F.size(F.split(column, TURN)))
    return F.transform(parts, lambda part: F.struct(
        unescaped(F.substring_index(part, OPEN, 1)).alias("role"),
        unescaped(F.substring_index(F.substring_index(part, OPEN, -1), CLOSE, 1)).alias("text")))


def read_loss(formatted: str = "formatted", loss: str = "loss") -> Column:
    """All text under the loss mask, as it was before escaping."""
    return F.concat_ws("", F.transform(loss, lambda s: unescaped(F.substring(
        F.col(formatted), (s["begin"] + 1).cast("int"), (s["end"] - s["begin"]).cast("int")))))
