"""Chat formatting of reply trees: the best root-to-leaf paths, each as one conversation.

Messages name the message they reply to. Ancestors are found by iterative self-joins that
double their reach, so a chain of n messages takes log2(n) rounds, and no tree is gathered
into one task. Leaves are ranked by the score of their whole path; the chosen paths list
their messages through the same jump tables.

A formatted conversation is a run of turns ``### role: text</turn>\\n``. Inside texts and
roles a backslash, every ``#`` and every ``</`` are escaped, so no control string can occur
there, and ``read_back`` restores them exactly.

Defined cases: a null role or text is empty; a message whose parent is missing is a root;
messages on or below a cycle of replies have no root and belong to no path; a repeated
(tree, node) is one message, the smallest; null trees form one tree, messages with a null
node are left out; equal scores rank by node; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlake.session import cut

END = "</turn>\n"
HEAD = "### "
BLOCK = 256  # turns that are put together before the blocks of a conversation are


def _join(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]], how: str = "inner"):
    """Join where null equals null; the right side's key columns are dropped."""
    renamed = right.withColumnsRenamed({r: f"_r_{r}" for _, r in pairs})
    same = F.lit(True)
    for a, b in pairs:
        same = same & F.col(a).eqNullSafe(F.col(f"_r_{b}"))
    return left.join(renamed, same, how).drop(*[f"_r_{b}" for _, b in pairs])


def reply_paths(messages: DataFrame, best: int = 1) -> DataFrame:
    """(tree, path, rank, pos, role, text): the messages of the ``best`` paths of each tree.

    ``messages`` has tree, node, parent, role, text, score. A path is named by its leaf and
    ranked by the sum of its scores, highest first; ``pos`` counts its messages from 0.
    """
    whole = F.min(F.struct("parent", "role", "text", "score"))
    nodes = cut(
        messages.filter(F.col("node").isNotNull())
        .groupBy("tree", "node")
        .agg(whole.alias("m"))
        .select("tree", "node", "m.*")
    )
    keys = nodes.select("tree", F.col("node").alias("known"), F.lit(True).alias("there"))
    state = cut(
        _join(nodes, keys, [("tree", "tree"), ("parent", "known")], "left").select(
            "tree",
            "node",
            F.when(F.col("there"), F.col("parent")).alias("anc"),
            F.when(F.col("there"), 1).otherwise(0).cast("long").alias("steps"),
            F.coalesce(F.col("score"), F.lit(0.0)).cast("double").alias("total"),
        )
    )
    parents = state.filter(F.col("anc").isNotNull()).select("tree", F.col("anc").alias("node"))
    most, jumps, done = state.count(), [], []
    while 2 ** len(jumps) <= 2 * most:
        moving = state.filter(F.col("anc").isNotNull())
        if moving.isEmpty():
            break
        jumps.append(moving.select("tree", "node", "anc"))
        # Only trees that have a message below their root's reach take part in the round.
        deep = moving.select("tree").distinct()
        done.append(cut(_join(state, deep, [("tree", "tree")], "left_anti")))
        state = _join(state, deep, [("tree", "tree")], "left_semi")
        above = state.select(
            "tree",
            "node",
            F.col("anc").alias("anc2"),
            F.col("steps").alias("steps2"),
            F.col("total").alias("total2"),
        )
        state = cut(
            _join(state, above, [("tree", "tree"), ("anc", "node")], "left").select(
                "tree",
                "node",
                F.col("anc2").alias("anc"),
                (F.col("steps") + F.coalesce("steps2", F.lit(0))).alias("steps"),
                (F.col("total") + F.coalesce("total2", F.lit(0.0))).alias("total"),
            )
        )
    for part in done:
        state = state.unionByName(part)
    rooted = cut(state.filter(F.col("anc").isNull()).select("tree", "node", "steps", "total"))
    order = Window.partitionBy("tree").orderBy(F.col("total").desc(), "node")
    leaves = (
        _join(rooted, parents.distinct(), [("tree", "tree"), ("node", "node")], "left_anti")
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= best)
    )
    members = leaves.select("tree", F.col("node").alias("path"), "rank", "node")
    for jump in reversed(jumps):  # farthest first: the list doubles only where paths are long
        further = _join(members, jump, [("tree", "tree"), ("node", "node")])
        further = further.select("tree", "path", "rank", F.col("anc").alias("node"))
        members = cut(members.unionByName(further))
    told = _join(
        rooted.select("tree", "node", F.col("steps").alias("pos")),
        nodes.select("tree", "node", "role", "text"),
        [("tree", "tree"), ("node", "node")],
    )
    return _join(members, told, [("tree", "tree"), ("node", "node")]).select(
        "tree", "path", "rank", "pos", "role", "text"
    )


def escape(text: Column) -> Column:
    text = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(text, F.lit("#"), F.lit("\\#")), F.lit("</"), F.lit("<\\/"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _escape_role(role: Column) -> Column:
    role = F.replace(escape(role), F.lit("%"), F.lit("%25"))
    return F.replace(role, F.lit(":"), F.lit("%3A"))


def _unescape_role(role: Column) -> Column:
    role = F.replace(role, F.lit("%3A"), F.lit(":"))
    return unescape(F.replace(role, F.lit("%25"), F.lit("%")))


def format_chats(
    turns: DataFrame, keys: Sequence[str], trained: Sequence[str] = ("assistant",)
) -> DataFrame:
    """(keys, formatted, loss), one row per conversation, from rows (keys, pos, role, text).

    ``loss`` has an entry per turn: the code points (start, end) of the turn's text, counted
    from the turn's own start, if its role is one of ``trained``, else null.
    """
    head = F.concat(F.lit(HEAD), _escape_role(F.col("role")), F.lit(": "))
    pieces = (
        turns.withColumn("_head", head)
        .withColumn("_said", escape(F.col("text")))
        .select(
            *keys,
            "pos",
            F.floor(F.col("pos") / BLOCK).alias("_block"),
            F.concat("_head", "_said", F.lit(END)).alias("piece"),
            F.when(
                F.coalesce(F.col("role").isin(*trained), F.lit(False)),
                F.struct(
                    F.length("_head").alias("start"),
                    (F.length("_head") + F.length("_said")).alias("end"),
                ),
            ).alias("span"),
        )
    )

    def together(rows: DataFrame, by: Sequence[str], order: str, loss: Column) -> DataFrame:
        listed = rows.groupBy(*by).agg(
            F.array_sort(F.collect_list(F.struct(order, "piece", loss.alias("loss")))).alias("all")
        )
        return listed.select(
            *by, F.array_join("all.piece", "").alias("piece"), F.flatten("all.loss").alias("loss")
        )

    blocks = together(pieces, [*keys, "_block"], "pos", F.array("span"))
    return together(blocks, list(keys), "_block", F.col("loss")).withColumnRenamed(
        "piece", "formatted"
    )


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (segment, role, text)."""
    segments = F.split(formatted, "</turn>\n")
    segments = F.slice(segments, F.lit(1), F.size(segments) - 1)

    def turn(segment: Column) -> Column:
        role = F.regexp_extract(segment, "^### ([^:]*+): ", 1)
        said = F.substring(segment, F.length(role) + F.lit(len(HEAD) + 3), F.length(segment))
        return F.struct(
            segment.alias("segment"),
            _unescape_role(role).alias("role"),
            unescape(said).alias("text"),
        )

    return F.transform(segments, turn)
