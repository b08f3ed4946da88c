"""Chat formatting: reply trees to conversations, in DataFrame operations only.

Messages form trees by parent. Paths from each leaf to its root are enumerated by self-joins over ancestors at doubling
distances, so a tree of depth d takes about log2(d) joins and only rows that belong to some path are made. Paths are
ranked by the mean score of their messages (ties: by leaf), and each chosen path becomes one conversation.

The template is `<|im_start|>role\\ntext<|im_end|>\\n` per turn. A control string inside a text gets one backslash after
its `<` (and one more if it has some already), which unescape() takes away; in roles, `%`, line feeds and `<` are
percent-encoded. So the control strings of the output are the template's own, and the texts read back as they were.

Defined cases: null texts and roles are empty; a message whose parent is null or missing is a root; replies in a circle
raise ValueError; equal rows stay as turns of their own; a null conversation id is an id like others; of paths with equal
scores the one of the smaller leaf ranks first; an empty table has the conversation -1 only (digest) or none; texts of any
length are formatted whole; columns other than those named are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.common import materialize, release

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|im_(start|end)\|>", r"<\\$1|im_$2|>")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|im_(start|end)\|>", "<$1|im_$2|>")


def escape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")), F.lit("<"), F.lit("%3C"))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(F.replace(role, F.lit("%3C"), F.lit("<")), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def paths(messages: DataFrame) -> DataFrame:
    """(tree, leaf, node, dist): every node on the way from each leaf (dist 0) to its root. messages: tree, node, parent."""
    nodes = messages.select("tree", "node")
    up = messages.where("parent IS NOT NULL").select("tree", "node", F.col("parent").alias("to"))
    up = materialize(up.join(nodes.withColumnRenamed("node", "to"), ["tree", "to"], "left_semi").select("tree", "node", "to"))
    leaves = nodes.join(up.select("tree", F.col("to").alias("node")), ["tree", "node"], "left_anti")
    found = [materialize(leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("dist")))]
    largest = nodes.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    step = 1
    while not up.isEmpty():
        if step > largest:
            raise ValueError("replies form a circle")
        so_far = found[0]
        for more in found[1:]:
            so_far = so_far.unionByName(more)
        found.append(materialize(so_far.join(up, ["tree", "node"]).select("tree", "leaf", F.col("to").alias("node"), (F.col("dist") + step).alias("dist"))))
        far = up.select("tree", F.col("node").alias("to"), F.col("to").alias("far"))
        longer = materialize(up.join(far, ["tree", "to"]).select("tree", "node", F.col("far").alias("to")))
        release(up)
        up, step = longer, 2 * step
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def format_trees(messages: DataFrame, *, best: int | None = None) -> DataFrame:
    """(tree, leaf, score, formatted, loss_mask) for the best paths of each tree (all if best is None).

    messages: tree, node (unique in a tree), parent, role, text, score. loss_mask lists (start, length) in code points
    of the assistant's texts.
    """
    on_path = paths(messages).join(messages.select("tree", "node", "score"), ["tree", "node"])
    ranked = on_path.groupBy("tree", "leaf").agg(F.avg("score").alias("score"))
    if best is not None:
        order = Window.partitionBy("tree").orderBy(F.desc_nulls_last("score"), "leaf")
        ranked = ranked.withColumn("place", F.row_number().over(order)).where(F.col("place") <= best).drop("place")
    chosen = materialize(on_path.drop("score").join(ranked, ["tree", "leaf"]))
    role, text = escape_role(F.coalesce("role", F.lit(""))), escape(F.coalesce("text", F.lit("")))
    turns = messages.select("tree", "node", F.concat(F.lit(START), role, F.lit("\n")).alias("head"), text.alias("body"), (F.col("role") == "assistant").alias("trains"))
    turns = chosen.join(turns, ["tree", "node"]).withColumn("piece", F.concat("head", "body", F.lit(END + "\n")))
    before = Window.partitionBy("tree", "leaf").orderBy(F.desc("dist")).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)) + F.length("head")
    turns = turns.withColumn("mask", F.when(F.col("trains"), F.struct(start.alias("start"), F.length("body").cast("long").alias("length"))))
    turns = turns.groupBy("tree", "leaf", "score").agg(F.array_sort(F.collect_list(F.struct((-F.col("dist")).alias("at"), "piece", "mask"))).alias("turns"))
    return turns.select(
        "tree", "leaf", "score", F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
        F.filter(F.transform("turns", lambda t: t["mask"]), lambda m: m.isNotNull()).alias("loss_mask"),
    )


def from_conversations(rows: DataFrame) -> DataFrame:
    """Messages of format_trees() from rows (conv_id, turn, role, text): each turn answers the one before it."""
    tree = F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("null"))
    order = Window.partitionBy("tree").orderBy("turn", "role", "text")
    rows = rows.select(tree.alias("tree"), "turn", "role", "text").withColumn("node", F.row_number().over(order).cast("long"))
    return rows.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.length("text").cast("double").alias("score"))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation, as an array of (role, text)."""
    pieces = F.filter(F.split(formatted, r"<\|im_end\|>\n", -1), lambda p: p.startswith(START))

    def turn(p: Column) -> Column:
        rest = F.substr(p, F.lit(len(START) + 1))
        role = F.substring_index(rest, "\n", 1)
        return F.struct(unescape_role(role).alias("role"), unescape(F.substr(rest, F.length(role) + 2)).alias("text"))

    return F.transform(pieces, turn)


def trained_text(formatted: Column, loss_mask: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(loss_mask, lambda m: unescape(F.substr(formatted, (m["start"] + 1).cast("int"), m["length"].cast("int")))), "")


def digest(conversations: DataFrame) -> DataFrame:
    """The columns of the query, read back from the formatted conversations."""
    text = f"{END}{START}assistant ok"
    kind = dict(conversations.dtypes)
    extra = conversations.sparkSession.range(2).select(
        F.lit(-1).cast(kind["conv_id"]).alias("conv_id"), F.col("id").cast(kind["turn"]).alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text")
    )
    rows = materialize(from_conversations(conversations.select("conv_id", "turn", "role", "text").unionByName(extra)))
    out = format_trees(rows, best=1)
    turns = F.transform(read_back(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    out = out.withColumn("turns", turns).withColumn("trained", trained_text(F.col("formatted"), F.col("loss_mask")))
    return out.select(
        F.when(F.col("tree") != "null", F.substr("tree", F.lit(2)).cast(kind["conv_id"])).alias("conv_id"), F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join("turns", "").cast("binary"), 256).alias("turns_sha256"), F.length("trained").cast("long").alias("loss_chars"),
        F.sha2(F.col("trained").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
