"""Chat formatting: root-to-leaf paths of reply trees, ranked, each formatted as one conversation. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import column, distinct_names, written


def escape(text: Column) -> Column:
    r"""Backslash, < and > as \\, \l and \g: no text can then hold a mark of the template."""
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("\\l")), F.lit(">"), F.lit("\\g"))


def unescape(text: Column) -> Column:
    """Undoes escape(). The pairs of backslashes are cut out first, so that none of them is read with what follows."""
    plain = F.transform(F.split(text, r"\\\\", -1), lambda p: F.replace(F.replace(p, F.lit("\\l"), F.lit("<")), F.lit("\\g"), F.lit(">")))
    return F.array_join(plain, "\\")


def paths(messages: DataFrame, best: int | None = None) -> DataFrame:
    """(tree, leaf, depth, node) of each root-to-leaf path, depth from 0 at the leaf; and path_score, the mean of its scores.

    messages: tree, node, parent, score. Iterative self-joins: after k rounds a
    leaf's path holds its 2^k lowest messages, and each message knows its
    ancestor 2^k above, so there are as many rounds as the longest path's
    length has binary digits; rows grow with the paths' own length. `best`
    keeps that many paths of each tree, by score, then smaller leaf.

    A parent that isn't in the tree makes a root. Messages above no leaf (on a
    circle of parents) are on no path. Null scores count 0. Nodes are unique.
    """
    nodes = messages.select("tree", "node", "parent")
    known = nodes.select(F.col("tree").alias("t"), F.col("node").alias("n"))
    up = written(nodes.join(known, (F.col("tree") == F.col("t")) & (F.col("parent") == F.col("n")), "left_semi"), "up")
    parents = up.select(F.col("tree").alias("t"), F.col("parent").alias("n"))
    leaves = nodes.join(parents, (F.col("tree") == F.col("t")) & (F.col("node") == F.col("n")), "left_anti")
    found = written(leaves.select("tree", F.col("node").alias("leaf"), F.lit(0).cast("long").alias("depth"), "node"), "path0")
    jump, step = up.select("tree", "node", F.col("parent").alias("above")), 1
    on_path, rounds = found.count(), 0
    while rounds < 40:
        a = jump.select(F.col("tree").alias("t"), F.col("node").alias("n"), "above")
        more = found.join(a, (F.col("tree") == F.col("t")) & (F.col("node") == F.col("n"))).select("tree", "leaf", (F.col("depth") + step).alias("depth"), F.col("above").alias("node"))
        found = written(found.union(more), "path")
        if (n := found.count()) == on_path:
            break
        on_path, step, rounds = n, 2 * step, rounds + 1
        b = jump.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("above").alias("higher"))
        jump = written(jump.join(b, (F.col("tree") == F.col("t")) & (F.col("above") == F.col("n"))).select("tree", "node", F.col("higher").alias("above")), "jump")
    if best is None:
        return found.withColumn("path_score", F.lit(None).cast("double"))
    score = messages.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("s"))
    scored = found.join(score, (F.col("tree") == F.col("t")) & (F.col("node") == F.col("n"))).groupBy("tree", "leaf").agg(F.avg("s").alias("path_score"))
    rank = F.row_number().over(W.partitionBy("tree").orderBy(F.desc("path_score"), "leaf"))
    kept = scored.withColumn("r", rank).where(F.col("r") <= best).select(F.col("tree").alias("t"), F.col("leaf").alias("l"), "path_score")
    return found.join(kept, (F.col("tree") == F.col("t")) & (F.col("leaf") == F.col("l"))).select("tree", "leaf", "depth", "node", "path_score")


def format_paths(messages: DataFrame, best: int | None = None) -> DataFrame:
    """tree, leaf, path_score, formatted and segments (text, loss): each path as one conversation.

    messages: tree, node, parent, score, role, text. A turn is written as
    <turn ROLE>, newline, text, newline, </turn>, newline; role and text are
    escaped. segments joined are the formatted text; those with loss are the
    escaped texts of assistant turns and nothing else. Null texts and roles are empty.
    """
    told = messages.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = paths(messages, best).join(told, (F.col("tree") == F.col("t")) & (F.col("node") == F.col("n")))
    turns = rows.groupBy("tree", "leaf").agg(F.first("path_score").alias("path_score"), F.array_sort(F.collect_list(F.struct((-F.col("depth")).alias("at"), "role", "text"))).alias("turns"))

    def segment(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    segments = F.flatten(F.transform("turns", lambda t: F.array(
        segment(F.concat(F.lit("<turn "), escape(t["role"]), F.lit(">\n")), F.lit(False)),
        segment(escape(t["text"]), t["role"] == "assistant"),
        segment(F.lit("\n</turn>\n"), F.lit(False)))))
    return turns.select("tree", "leaf", "path_score", segments.alias("segments")).withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    parts = F.split(formatted, "\n</turn>\n", -1)
    return F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda p: F.struct(
        unescape(F.substring_index(F.substring(p, 7, 2**31 - 1), ">\n", 1)).alias("role"),
        unescape(F.regexp_replace(p, "^<turn [^>]*>\n", "")).alias("text")))


def read_loss(formatted: Column) -> Column:
    """The texts under the loss mask of a formatted conversation: what stands between an assistant's mark and its end. No text can hold a mark."""
    found = F.regexp_extract_all(formatted, F.lit("<turn assistant>\n([^<]*)\n</turn>\n"), F.lit(1))
    return F.transform(found, unescape)


def conversations(table: DataFrame) -> DataFrame:
    """Messages of a table of turns: each turn answers the one before it (by turn, role, text; null first).

    tree is conv_id as text ('null' for null), so that null is a conversation too.
    """
    table = distinct_names(table)
    rows = table.select(column(table, "conv_id", "long").alias("conv_id"), column(table, "turn", "long").alias("turn"), column(table, "role", "string").alias("role"), column(table, "text", "string").alias("text"))
    tree = F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))
    node = F.row_number().over(W.partitionBy("tree").orderBy("turn", "role", "text")).cast("long")
    rows = rows.withColumn("tree", tree).withColumn("node", node)
    return rows.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.lit(0.0).alias("score"), "role", "text")


def digests(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars, all read back from the formatted text."""
    turns, lost = read_turns(F.col("formatted")), F.array_join(read_loss(F.col("formatted")), "")
    read = formatted.select("tree", "formatted", turns.alias("turns"), lost.alias("lost"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        F.expr("try_cast(tree AS bigint)").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("lost").cast("long").alias("loss_chars"), F.sha2(F.col("lost").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def op10_chat(spark, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, formatted; see format_paths()."""
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    text = "\\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return digests(format_paths(conversations(table.unionByName(own))))
