"""Chat formatting of reply trees, in DataFrame functions only.

Messages form trees by parent. Iterative self-joins double the reach of each message's ancestor pointer, and give every
leaf its ancestors along the way, so a path of n messages takes log2 n rounds and no more than its own n rows. A tree's
branches are ranked by score (summed over the path, ties to the smaller leaf) and each chosen path is formatted as one
conversation.

The template writes a turn as `<|im_start|>role`, a line feed, the text and `<|im_end|>` with a line feed. A control string (this template's or
those of the [INST] family) inside a role or text gets a backslash after its first character, one more if some are there
already, which unescaping takes off; line feeds in roles are written as `\\n`. So no control string that isn't a mark
stands in the output, and the turns can be read back exactly.

Null texts and roles count as empty. Messages whose parent is missing are roots. A cycle has no leaf, so its messages are on no path;
a leaf that hangs on a cycle has no root and is an error. A message id must be unique.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skeinwatch.llm.common import cuts, scratch, written

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: What must not stand inside a text, without its first character: marks of this template and of the [INST] family.
_TAILS = r"\|im_start\|>|\|im_end\|>|/?s>|/?INST\]|</?SYS>>"
LOSS_ROLE = "assistant"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*)({_TAILS})", r"$1$2\\$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*)\\({_TAILS})", "$1$2$3")


def _role_out(role: Column) -> Column:
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _role_in(role: Column) -> Column:
    parts = F.split(unescaped(role), r"\\\\")  # at pairs of backslashes
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def paths(messages: DataFrame, per_tree: int = 1) -> DataFrame:
    """tree, leaf, depth, id: the messages on each chosen root-to-leaf path, depth counted from the root.

    messages: id, parent (null at a root), score (null counts as 0).
    """
    with scratch(messages.sparkSession):
        ids = messages.select("id", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
        nodes = written(
            ids.join(
                ids.select(F.col("id").alias("__p")),
                F.col("parent") == F.col("__p"),
                "left",
            ).select("id", F.col("__p").alias("up"), "score"),
            "messages",
        )
        path = _reach(nodes).join(nodes.select("id", "score"), "id")
        of_leaf = path.groupBy("leaf").agg(F.sum("score").alias("score"), F.max("height").alias("top"), F.max_by("id", "height").alias("tree"))
        best = Window.partitionBy("tree").orderBy(F.desc("score"), "leaf")
        chosen = of_leaf.withColumn("__rank", F.row_number().over(best)).where(F.col("__rank") <= per_tree)
        found = path.join(
            chosen.select("leaf", "tree", "top", F.col("__rank").alias("branch"), F.col("score").alias("path_score")),
            "leaf",
        ).select("tree", "leaf", "branch", "path_score", (F.col("top") - F.col("height")).alias("depth"), "id")
        return written(found, "chosen-paths", keep=True)


def _reach(nodes: DataFrame) -> DataFrame:
    """leaf, id, height: every leaf's ancestors and itself. Each round writes only the rows that it finds."""
    jump = nodes.select("id", "up").where("up is not null")
    leaves = nodes.join(jump.select(F.col("up").alias("id")).distinct(), "id", "left_anti")
    reach = written(leaves.select(F.col("id").alias("leaf"), "id", F.lit(0).cast("long").alias("height")), "reach")
    step, most = 1, nodes.count()
    while step <= most:
        further = reach.join(jump, "id").select("leaf", F.col("up").alias("id"), (F.col("height") + step).alias("height"))
        further = written(further, "reach")
        reach = reach.unionByName(further)
        jump = written(
            jump.alias("a").join(
                jump.select(F.col("id").alias("up"), F.col("up").alias("__next")),
                "up",
            ).select("id", F.col("__next").alias("up")),
            "jump",
        )
        step *= 2
        if jump.isEmpty() or further.isEmpty():
            return reach
    if most:
        raise RuntimeError("messages hang on a cycle of replies")
    return reach


def formatted(turns: DataFrame, keys: list[str], order: str) -> DataFrame:
    """keys, formatted, loss_spans (start, end in code points of each assistant text): one row a conversation.

    A turn's place is a running sum over its conversation, in the order in which the turns are joined.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit(OPEN), _role_out(role), F.lit("\n"))
    rows = turns.select(*keys, F.col(order).alias("o"), head.alias("head"), escaped(text).alias("body"), (role == LOSS_ROLE).alias("loss"))
    rows = rows.withColumn("size", F.length("head") + F.length("body") + len(CLOSE))
    end = F.sum("size").over(Window.partitionBy(*keys).orderBy("o", "head", "body").rowsBetween(Window.unboundedPreceding, 0))
    turn = F.struct("o", "head", "body", "loss", (end - len(CLOSE)).cast("int").alias("end"))
    rows = rows.select(*keys, turn.alias("turn")).groupBy(*keys).agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))), "")
    spans = F.transform(
        F.filter("turns", lambda t: t["loss"]),
        lambda t: F.struct((t["end"] - F.length(t["body"])).alias("start"), t["end"].alias("end")),
    )
    return rows.select(*keys, whole.alias("formatted"), spans.alias("loss_spans"))


def read_back(text: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation."""
    parts = F.split(text, r"<\|im_end\|>\n")
    parts = F.slice(parts, F.lit(1), F.size(parts) - 1)
    return F.transform(
        parts,
        lambda p: F.struct(
            _role_in(F.regexp_extract(p, r"(?s)^<\|im_start\|>([^\n]*)\n", 1)).alias("role"),
            unescaped(F.regexp_extract(p, r"(?s)^<\|im_start\|>[^\n]*\n(.*)$", 1)).alias("text"),
        ),
    )


def chat_paths(messages: DataFrame, per_tree: int = 1) -> DataFrame:
    """tree, leaf, branch, path_score, formatted, loss_spans: each chosen path as one conversation.

    messages: id, parent, score, role, text.
    """
    turns = paths(messages, per_tree).join(messages.select("id", "role", "text"), "id")
    return formatted(turns, ["tree", "leaf", "branch", "path_score"], "depth")


def as_replies(conversations: DataFrame) -> DataFrame:
    """conv_id, turn rows as reply chains: each row answers the one before it in its conversation (ties by role, text)."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", "turn", "role", "text").withColumn("__n", F.row_number().over(order))
    key = lambda n: F.struct("conv_id", n.alias("n"))
    return rows.select(
        "conv_id",
        key(F.col("__n")).alias("id"),
        F.when(F.col("__n") > 1, key(F.col("__n") - 1)).alias("parent"),
        F.lit(0.0).alias("score"),
        "role",
        "text",
    )


def chat_digest(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars: all read back from the formatted text."""
    chats = chat_paths(as_replies(conversations))
    turns, loss = F.col("__turns"), F.col("__loss")
    read = chats.select(
        F.col("tree")["conv_id"].alias("conv_id"), "formatted", read_back(F.col("formatted")).alias("__turns"),
        F.array_join(F.transform(cuts(F.col("formatted"), F.col("loss_spans")), unescaped), "").alias("__loss"),
    )
    said = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
