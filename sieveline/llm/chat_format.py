"""Chat formatting: reply trees to root-to-leaf paths by iterative self joins, ranked and formatted.

Pointer doubling finds each message's depth, root and path score in as many self joins as the logarithm of the deepest
tree; the same jump tables then list the messages of the chosen paths. A path is formatted piece by piece, one row a
message, so that a conversation of any length is never held whole.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import written

# The template's fixed marks.
START, END = "<|im_start|>", "<|im_end|>"
MAX_DOUBLINGS = 40


def messages_of(turns: DataFrame) -> DataFrame:
    """Linear conversations (conv_id, turn, role, text) as reply trees: tree, node, parent, role, text, score.

    A turn replies to the one before it. Turns are ordered by turn (nulls first), then role and text; repeated rows are
    turns of their own. Null roles and texts are empty. Rows with a null conv_id belong to no conversation and are left
    out. One global sort by ranges deals long conversations over many partitions; the row before is found by its number.
    """
    rows = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("tree"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ("tree", "turn", "role", "text")
    ordered = written(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("node", F.monotonically_increasing_id()), "ordered")
    # A node is its partition's number times 2^33 plus its place there; partitions follow the sort order.
    ends = sorted((r["p"], r["first"], r["last"]) for r in ordered.groupBy(F.shiftright("node", 33).alias("p")).agg(F.min("node").alias("first"), F.max("node").alias("last")).collect())
    before = turns.sparkSession.createDataFrame([(b[1], a[2]) for a, b in zip(ends, ends[1:], strict=False)], "node long, across long")  # one row a partition
    linked = ordered.join(F.broadcast(before), "node", "left").withColumn("previous", F.coalesce("across", F.col("node") - 1))
    other = ordered.select(F.col("node").alias("previous"), F.col("tree").alias("other"))
    return linked.join(other, "previous", "left").select("tree", "node", F.when(F.col("other") == F.col("tree"), F.col("previous")).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def paths(messages: DataFrame, branches: int | None = 1) -> DataFrame:
    """path (the leaf's node), tree, position (from 0), node of each message on each chosen root-to-leaf path.

    messages: tree, node (unique), parent (null at a root), score. Paths of a tree are ranked by mean score, then
    length, then the smaller leaf; `branches` of them are chosen, all if None. A null score counts as 0. A parent that
    is not there makes its reply a root. A cycle of replies raises an error.
    """
    known = messages.select(F.col("node").alias("parent"))
    links = messages.select("tree", "node", "parent", "score").join(known, "parent", "left_semi").select("tree", "node", F.col("parent").alias("up"), "score")
    roots = messages.select("tree", "node", "parent", "score").join(known, "parent", "left_anti").select("tree", "node", F.lit(None).cast("long").alias("up"), "score")
    step = written(
        links.unionByName(roots).select("tree", "node", "up", F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("depth"), F.coalesce("score", F.lit(0.0)).alias("total")), "jump0"
    )
    jumps = [step]
    while not step.where("up is not null").isEmpty():
        if len(jumps) > MAX_DOUBLINGS:
            raise ValueError("the replies form a cycle")
        above = step.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"), F.col("total").alias("rest"))
        done = step.where("up is null")
        moved = step.where("up is not null").join(above, "up").select("tree", "node", F.col("next").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("total") + F.col("rest")).alias("total"))
        step = written(done.unionByName(moved), f"jump{len(jumps)}")
        jumps.append(step)
    leaves = step.join(jumps[0].where("up is not null").select(F.col("up").alias("node")).distinct(), "node", "left_anti")
    ranked = leaves.select("tree", "node", "depth", F.struct((F.col("total") / (F.col("depth") + 1)).alias("mean"), "depth", (-F.col("node")).alias("first")).alias("merit"))
    if branches == 1:
        chosen = ranked.groupBy("tree").agg(F.max_by(F.struct("node", "depth"), "merit").alias("leaf")).select("tree", "leaf.*")
    elif branches is None:
        chosen = ranked.select("tree", "node", "depth")
    else:
        chosen = ranked.withColumn("place", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("merit")))).where(F.col("place") <= branches).select("tree", "node", "depth")
    listed = written(chosen.select(F.col("node").alias("path"), "tree", F.col("depth").alias("position"), "node"), "listed0")
    for k, jump in enumerate(jumps[:-1]):
        hop = jump.where("up is not null").select("node", "up")
        further = listed.join(hop, "node").select("path", "tree", (F.col("position") - 2**k).alias("position"), F.col("up").alias("node"))
        listed = written(listed.unionByName(further), f"listed{k + 1}")
    return listed


def escaped(text: Column) -> Column:
    """Reversible: backslashes are doubled, then a backslash parts < from |, so no mark of the template can appear."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def _escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit("\\n"))


def format_paths(listed: DataFrame, messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """path, tree, position, piece, loss_start and loss_length of each message; a path's pieces in order are its text.

    A piece is the start mark, the role, a newline, the text, the end mark and a newline, with role and text escaped. The
    loss span (code points within the piece; null for other roles) covers the escaped text of loss_role.
    """
    found = listed.join(messages.select("node", "role", "text"), "node")
    role, text = _escaped_role(F.col("role")), escaped(F.col("text"))
    masked = F.col("role") == loss_role
    return found.select(
        "path", "tree", "position", F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(END + "\n")).alias("piece"),
        F.when(masked, F.lit(len(START) + 1) + F.length(role)).cast("long").alias("loss_start"), F.when(masked, F.length(text)).cast("long").alias("loss_length"),
    )


_UNESCAPE = re.compile(r"\\(.)", re.S)
_MESSAGE = re.compile(re.escape(START) + r"(.*?)\n(.*?)" + re.escape(END) + "\n", re.S)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each message of a formatted text."""
    return [(_UNESCAPE.sub(lambda m: "\n" if m[1] == "n" else m[1], role), unescape(text)) for role, text in _MESSAGE.findall(formatted)]


def assembled(pieces: DataFrame) -> DataFrame:
    """path, tree and formatted: each path as one text. For conversations that fit into a row."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct("position", "piece"))), lambda x: x["piece"])
    return pieces.groupBy("path", "tree").agg(F.array_join(rows, "").alias("formatted"))


def digests(pieces: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of each path, read back from its pieces.

    Pieces are hashed one after the other in the order of the path, so memory does not grow with a conversation; a hash
    of a whole conversation cannot be split between tasks. Two branches of one tree are two rows.
    """

    def fold(batches):
        at, state = None, None

        def row():
            n, turns, chars, loss, size = state
            return (at[0], n, turns.hexdigest(), chars, loss.hexdigest(), size)

        for b in batches:
            out = []
            for tree, path, piece, start, length in zip(b["tree"], b["path"], b["piece"], b["loss_start"], b["loss_length"], strict=True):
                if (tree, path) != at:
                    if state:
                        out.append(row())
                    at, state = (tree, path), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in parse(piece):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                if not pd.isna(start):
                    masked = unescape(piece[int(start) : int(start) + int(length)])
                    state[2] += len(masked)
                    state[3].update(masked.encode("utf-8", "surrogatepass"))
                state[4] += len(piece)
            if out:
                yield pd.DataFrame(out, columns=_COLUMNS)
        if state:
            yield pd.DataFrame([row()], columns=_COLUMNS)

    ordered = pieces.select("tree", "path", "position", "piece", "loss_start", "loss_length").repartition("tree", "path").sortWithinPartitions("tree", "path", "position")
    return ordered.mapInPandas(fold, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


_COLUMNS = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
