"""Chat formatting of reply trees.

Iterative self-joins enumerate root-to-leaf paths by pointer doubling: after round k every message
knows its ancestor 2^k replies up and the score of the replies between, so a tree of depth d takes
log2(d) rounds.  The branches of a tree are ranked by mean score, and each chosen path becomes one
conversation.  Rounds are written to the shared folder; only ids and scores move in them.

A conversation is one string, so its messages meet in one row; that row is as long as the
conversation, never longer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lociq.llm.common import Stages, plain, whole

START, END = "<|im_start|>", "<|im_end|>"


def escaped(text: Column) -> Column:
    """No control string of the template is left: ``~`` becomes ``~0``, ``<|`` becomes ``<~1|``."""
    return F.replace(F.replace(text, F.lit("~"), F.lit("~0")), F.lit("<|"), F.lit("<~1|"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<~1|"), F.lit("<|")), F.lit("~0"), F.lit("~"))


def escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit("~2"))


def unescaped_role(role: Column) -> Column:
    return unescaped(F.replace(role, F.lit("~2"), F.lit("\n")))


def _jumps(nodes: DataFrame, stages: Stages) -> list[DataFrame]:
    """Tables ``(tree, node, up, sum, steps)`` for jumps of 1, 2, 4, ... replies.

    The last one has no ``up`` left: ``sum`` and ``steps`` then cover the path from the root.
    Messages whose parents form a circle never reach a root; they are left out.
    """
    known = nodes.select("tree", F.col("node").alias("up"))
    linked = nodes.select("tree", "node", F.col("parent").alias("up"), "score")
    roots = linked.join(known, ["tree", "up"], "left_anti").withColumn("up", F.lit(None).cast(nodes.schema["node"].dataType))
    inner = linked.join(known, ["tree", "up"], "left_semi")
    jump = inner.select("tree", "node", "up", "score").unionByName(roots.select("tree", "node", "up", "score"))
    jump = stages.keep(jump.select("tree", "node", "up", F.col("score").alias("sum"), F.lit(1).cast("long").alias("steps")), "jump0")
    tables, open_rows = [jump], None
    while (left := jump.where(F.col("up").isNotNull()).count()) not in (0, open_rows):
        open_rows = left
        above = jump.select("tree", F.col("node").alias("up"), F.col("up").alias("far"), F.col("sum").alias("s"), F.col("steps").alias("n"))
        # Only messages that are not at their root yet go on.
        farther = jump.where(F.col("up").isNotNull()).join(above, ["tree", "up"]).select(
            "tree", "node", F.col("far").alias("up"), (F.col("sum") + F.col("s")).alias("sum"), (F.col("steps") + F.col("n")).alias("steps")
        )
        jump = farther.unionByName(jump.where(F.col("up").isNull()))
        jump = stages.keep(jump, f"jump{len(tables)}")
        tables.append(jump)
    return tables


def chosen_paths(nodes: DataFrame, branches: int = 1) -> DataFrame:
    """``(tree, leaf, rank, node, depth)`` of the ``branches`` best root-to-leaf paths of each tree.

    ``nodes`` has ``tree, node, parent, score``; a parent that does not exist counts as none.
    Branches rank by mean score, ties by the smaller leaf.
    """
    stages = Stages(nodes.sparkSession, "paths")
    nodes = plain(nodes, "tree", "node", "parent", "score")
    tables = _jumps(nodes, stages)
    full = tables[-1].where(F.col("up").isNull())
    parents = tables[0].where(F.col("up").isNotNull()).select("tree", F.col("up").alias("node"))
    leaves = full.join(parents, ["tree", "node"], "left_anti")
    best = Window.partitionBy("tree").orderBy((F.col("sum") / F.col("steps")).desc(), "node")
    leaves = leaves.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= branches)
    path = stages.keep(leaves.select("tree", F.col("node").alias("leaf"), "rank", "node"), "path0")
    for k, jump in enumerate(tables):
        up = path.join(jump.where(F.col("up").isNotNull()).select("tree", "node", "up"), ["tree", "node"])
        path = stages.keep(path.unionByName(up.select("tree", "leaf", "rank", F.col("up").alias("node"))), f"path{k + 1}")
    last = len(tables)
    stages.drop(*[f"path{k}" for k in range(last)], *[f"jump{k}" for k in range(last - 1)])
    return path.join(full.select("tree", "node", F.col("steps").alias("depth")), ["tree", "node"])


def formatted(messages: DataFrame) -> DataFrame:
    """One row per ``conv``: ``formatted`` text and ``mask`` spans over assistant texts.

    ``messages`` has ``conv, depth, role, text``.  Spans are code points into ``formatted``.
    """
    head = F.concat(F.lit(START), escaped_role(F.col("role")), F.lit("\n"))
    body = escaped(F.col("text"))
    parts = messages.select(
        "conv", "depth", head.alias("head"), body.alias("body"), (F.col("role") == "assistant").alias("learn")
    ).withColumn("piece", F.concat("head", "body", F.lit(END + "\n")))
    before = Window.partitionBy("conv").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)) + F.length("head")
    placed = parts.select("conv", "depth", "piece", "learn", start.alias("start"), F.length("body").alias("length"))
    whole_conv = placed.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("depth", "piece", "learn", "start", "length"))).alias("all"))
    return whole_conv.select(
        "conv",
        F.concat_ws("", F.transform("all", lambda x: x["piece"])).alias("formatted"),
        F.transform(F.filter("all", lambda x: x["learn"]), lambda x: F.struct(x["start"], x["length"])).alias("mask"),
    )


def read_back(conversations: DataFrame) -> DataFrame:
    """Adds ``turns`` (role and text), parsed from ``formatted``, and ``loss_text`` under the mask."""
    pieces = F.split("formatted", r"<\|im_end\|>\n")

    def turn(piece):
        role = F.substring_index(piece, "\n", 1)
        return F.struct(
            unescaped_role(F.substr(role, F.lit(len(START) + 1))).alias("role"),
            unescaped(F.substr(piece, F.length(role) + 2)).alias("text"),
        )

    under = F.transform("mask", lambda s: unescaped(F.substr("formatted", (s["start"] + 1).cast("int"), s["length"])))
    return conversations.withColumns(
        {"turns": F.transform(F.slice(pieces, 1, F.size(pieces) - 1), turn), "loss_text": F.concat_ws("", under)}
    )


def format_trees(messages: DataFrame, branches: int = 1) -> DataFrame:
    """Formats the best ``branches`` of each reply tree.

    ``messages`` has ``tree, node, parent, score, role, text``; null roles and texts are empty.
    ``conv`` is ``(tree, rank)``.
    """
    paths = chosen_paths(messages, branches)
    rows = plain(messages, "tree", "node", "role", "text").join(paths, ["tree", "node"])
    return formatted(
        rows.select(F.struct("tree", "rank").alias("conv"), "depth", whole("role").alias("role"), whole("text").alias("text"))
    )


def as_reply_chain(conversations: DataFrame) -> DataFrame:
    """Turns of ``(conv_id, turn, role, text)`` as a tree in which each answers the one before.

    Order within a conversation: turn (null first), then role and text, so repeated turns are kept
    and rows that are equal are interchangeable.  Assistant texts score their length.
    """
    rows = plain(conversations, "conv_id", "turn", "role", "text")
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    node = F.row_number().over(order).cast("long")
    tree = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("-"))
    score = F.when(F.col("role") == "assistant", F.length(whole("text"))).otherwise(0).cast("double")
    chain = rows.withColumn("node", node)
    return chain.select(
        tree.alias("tree"), "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), score.alias("score"),
        "role", "text", "conv_id",
    )


def chat_report(conversations: DataFrame) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``, read back."""
    stages = Stages(conversations.sparkSession, "chat")
    chain = stages.keep(as_reply_chain(conversations), "chain")
    back = read_back(format_trees(chain))
    turns = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    tree = F.col("conv")["tree"]
    return back.select(
        F.when(tree != "-", F.substr(tree, F.lit(2))).cast("long").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
