"""Chat formatting over reply trees.

Messages point to their parents. Iterative self-joins double the jump that each message knows (its
ancestor 1, 2, 4 ... steps up), so depth, root and branch score of all messages, and then the members
of the chosen root-to-leaf paths, take a number of joins that follows the logarithm of the depth.
Branches of a tree are ranked by score; each chosen path becomes one formatted conversation.

Template: ``<turn ROLE>\\n TEXT </turn>\\n``, without the blanks. Inside roles and texts a backslash is
put before ``turn`` wherever it follows ``<`` or ``</`` and any backslashes, and in roles before a line
feed that follows ``>`` and any backslashes; reading takes one away again. So the control strings never occur inside, and all else stays as it was.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelog.llm.shared import stored

LOSS_ROLE = "assistant"
END = "</turn>\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"(</?\\*)turn", r"$1\\turn")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(</?\\*)\\turn", r"$1turn")


def _escape_role(role: Column) -> Column:
    return F.regexp_replace(escape(role), r"(>\\*)\n", "$1\\\\\n")


def _unescape_role(role: Column) -> Column:
    return unescape(F.regexp_replace(role, r"(>\\*)\\\n", "$1\n"))


def chain_parents(turns: DataFrame, conv_col: str = "conv_id", order: tuple[str, ...] = ("turn", "role", "text")) -> DataFrame:
    """(node, parent, tree, role, text, score) of conversations without branches: a row's parent is the one before.

    Rows with the same turn follow each other by role and text. Null conv_ids make one conversation.
    """
    by_turn = Window.partitionBy(conv_col).orderBy(*order)
    at = turns.withColumn("_at", F.row_number().over(by_turn).cast("long"))
    node = F.struct(F.col(conv_col).alias("tree"), F.col("_at").alias("at"))
    parent = F.when(F.col("_at") > 1, F.struct(F.col(conv_col).alias("tree"), (F.col("_at") - 1).alias("at")))
    return at.select(
        F.to_json(node).alias("node"), F.to_json(parent).alias("parent"), F.col(conv_col).alias("tree"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.lit(0.0).alias("score"),
    )


def _ancestors(tree: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(node, depth, total score) of all messages that have a root, and the jump tables of 1, 2, 4 ... steps.

    Messages on a cycle or below one never come to a root; the turns end when only they are left.
    """
    known = tree.select("node", F.col("parent").alias("up"), F.lit(1).cast("long").alias("depth"), F.col("score").alias("total"))
    known = stored(known, "jumps")
    jumps, going, before = [], known.where("up is not null"), None
    # among messages that still have something above, those of half the depth drop out in each turn
    while (n := going.count()) and n != before:
        before = n
        jumps.append(going.select("node", "up"))
        above = known.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("d2"), F.col("total").alias("t2"))
        moved = going.join(above, "up").select(
            "node", F.col("up2").alias("up"),
            (F.col("depth") + F.col("d2")).alias("depth"), (F.col("total") + F.col("t2")).alias("total"),
        )
        known = stored(known.where("up is null").unionByName(moved), "jumps")
        going = known.where("up is not null")
    return known.where("up is null").select("node", "depth", "total"), jumps


def paths(tree: DataFrame, per_tree: int | None = 1) -> DataFrame:
    """(tree, leaf, rank, depth, node) of the members of each tree's best root-to-leaf paths.

    tree: (node, parent, tree, score), nodes unique. A branch's score is the mean of its messages';
    ties go to the longer branch, then to the smaller leaf. per_tree None takes all branches. A
    message whose parent isn't in the table is the root of its branch; members of a cycle, which no
    leaf ends, give no path.
    """
    tree = tree.select("node", "parent", "tree", F.coalesce("score", F.lit(0.0)).alias("score"))
    present = tree.select(F.col("node").alias("parent"), F.lit(True).alias("there"))
    tree = stored(tree.join(present, "parent", "left").withColumn("parent", F.when(F.col("there"), F.col("parent"))).drop("there"), "tree")
    depths, jumps = _ancestors(tree)
    leaves = tree.join(tree.select(F.col("parent").alias("node")), "node", "left_anti").join(depths, "node")
    best = Window.partitionBy("tree").orderBy(F.desc(F.col("total") / F.col("depth")), F.desc("depth"), "node")
    leaves = leaves.withColumn("rank", F.row_number().over(best))
    if per_tree is not None:
        leaves = leaves.where(F.col("rank") <= per_tree)
    found = stored(leaves.select("tree", F.col("node").alias("leaf"), "rank", "node"), "paths")
    for jump in jumps:
        up = found.join(jump, "node").select("tree", "leaf", "rank", F.col("up").alias("node"))
        found = stored(found.unionByName(up), "paths")
    return found.join(depths.select("node", "depth"), "node").select("tree", "leaf", "rank", "depth", "node")


def format_paths(tree: DataFrame, per_tree: int | None = 1) -> DataFrame:
    """(tree, leaf, rank, formatted, segments): each chosen path as one conversation.

    segments: (text, loss) in order; together they are ``formatted``, and those under the loss mask are
    the texts of the assistant. Null roles and texts are empty.
    """
    told = paths(tree, per_tree).join(tree.select("node", "role", "text"), "node")
    turn = F.struct("depth", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    each = told.groupBy("tree", "leaf", "rank").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    parts = F.flatten(F.transform("turns", lambda t: F.array(
        F.struct(F.concat(F.lit("<turn "), _escape_role(t["role"]), F.lit(">\n")).alias("text"), F.lit(False).alias("loss")),
        F.struct(escape(t["text"]).alias("text"), (t["role"] == LOSS_ROLE).alias("loss")),
        F.struct(F.lit(END).alias("text"), F.lit(False).alias("loss")),
    )))
    each = each.withColumn("segments", parts)
    return each.select("tree", "leaf", "rank", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation, unescaped."""
    told = F.filter(F.split(formatted, "</turn>\n", -1), lambda t: t != "")
    head = lambda t: F.instr(t, ">\n")
    return F.transform(told, lambda t: F.struct(
        _unescape_role(F.substring(t, 7, head(t) - 7)).alias("role"),
        unescape(F.substr(t, head(t) + 2)).alias("text"),
    ))


def read_loss(segments: Column) -> Column:
    """The text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
