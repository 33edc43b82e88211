"""Chat formatting: the best paths of reply trees as one conversation each."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postlens.llm.common import slices
from postlens.sources.staging import stage

# The marks of the template.
START, END = "<|im_start|>", "<|im_end|>\n"
LEARNED_ROLE = "assistant"


def escaped(text: str) -> str:
    """Text without a control string: ``<|`` cannot occur in it."""
    return text.replace("%", "%25").replace("<|", "%3C|")


def unescaped(text: str) -> str:
    return text.replace("%3C", "<").replace("%25", "%")


def format_turns(turns: Iterable[tuple[str | None, str | None]]) -> tuple[str, list[int], list[int]]:
    """The formatted conversation, and starts and ends of the escaped texts of the learned role."""
    pieces, starts, ends, at = [], [], [], 0
    for role, text in turns:
        head = f"{START}{escaped(role or '').replace('\n', '%0A')}\n"
        body = escaped(text or "")
        pieces += [head, body, END]
        if role == LEARNED_ROLE:
            starts.append(at + len(head))
            ends.append(at + len(head) + len(body))
        at += len(head) + len(body) + len(END)
    return "".join(pieces), starts, ends


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation, as they were."""
    turns = []
    for piece in formatted.split(START)[1:]:
        role, _, text = piece.partition("\n")
        turns.append((unescaped(role.replace("%0A", "\n")), unescaped(text.removesuffix(END))))
    return turns


def _climbed(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Every node with the root, score and length of its path, and the tables of jumps.

    Each self-join doubles the length of the jumps, so a path of n nodes takes log2(n) of them. Nodes
    on a cycle reach no root and are left out.
    """
    parents = nodes.select(F.col("node_id").alias("p"))
    linked = nodes.join(parents, nodes["parent_id"] == F.col("p"), "left")
    score = F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score")
    state = linked.select(
        "node_id", F.col("p").alias("up"), F.col("node_id").alias("root"), score, F.lit(1).alias("depth")
    )
    state, jumps, most = stage(state, "paths"), [], nodes.count()
    while 2 ** len(jumps) <= most and not (step := state.where("up is not null")).isEmpty():
        jumps.append(step.select("node_id", "up"))
        above = state.select(
            F.col("node_id").alias("u"),
            F.struct("up", "root", "score", "depth").alias("above"),
        )
        both = state.join(above, F.col("up") == F.col("u"), "left")
        there = F.col("above").isNotNull()
        state = stage(
            both.select(
                "node_id",
                F.col("above.up").alias("up"),
                F.when(there, F.col("above.root")).otherwise(F.col("root")).alias("root"),
                (F.col("score") + F.coalesce("above.score", F.lit(0.0))).alias("score"),
                (F.col("depth") + F.coalesce("above.depth", F.lit(0))).alias("depth"),
            ),
            "paths",
        )
    return state.where("up is null").drop("up"), jumps


def best_paths(nodes: DataFrame, paths_per_tree: int | None = 1) -> DataFrame:
    """``path_id, node_id, depth``: the nodes of the best root-to-leaf paths of each tree.

    Takes ``tree_id, node_id, parent_id, score``; ids of nodes are unique. The paths of a root are
    ranked by mean score (a null is 0), then length, then the leaf's id; ``path_id`` is that leaf.
    Scores and lengths come from jumps of doubling length, so no path is held as a
    list before it is chosen; the nodes of the chosen ones are then marked through the same
    jumps, longest first. A parent that is not there makes a root. No nodes give no paths.
    """
    climbed, jumps = _climbed(nodes)
    parents = nodes.select(F.col("parent_id").alias("node_id")).where("node_id is not null")
    leaves = climbed.join(parents.distinct(), "node_id", "left_anti")
    chosen = leaves.select(F.col("node_id").alias("path_id"), "node_id", "root", "score", "depth")
    if paths_per_tree is not None:
        order = [(F.col("score") / F.col("depth")).desc(), F.col("depth").desc(), "node_id"]
        nth = F.row_number().over(Window.partitionBy("root").orderBy(*order))
        chosen = chosen.withColumn("nth", nth).where(F.col("nth") <= paths_per_tree)
    marked = chosen.select("path_id", "node_id")
    for jump in reversed(jumps):
        marked = stage(marked, "marked")
        marked = marked.union(marked.join(jump, "node_id").select("path_id", F.col("up").alias("node_id")))
    return marked.join(climbed.select("node_id", "depth"), "node_id")


def _formatted(batches) -> Iterator[pa.RecordBatch]:
    for rows in slices(batches, 16):
        found = [
            format_turns((t["role"], t["text"]) for t in turns)
            for turns in rows.column(1).to_pylist()
        ]
        spans = pa.list_(pa.int64())
        columns = [rows.column(0), pa.array([f[0] for f in found], pa.string())]
        columns += [pa.array([f[n] for f in found], spans) for n in (1, 2)]
        names = ["path_id", "formatted", "loss_starts", "loss_ends"]
        yield pa.RecordBatch.from_arrays(columns, names)


def format_conversations(nodes: DataFrame, paths_per_tree: int | None = 1) -> DataFrame:
    """``tree_id, path_id, formatted, loss_starts, loss_ends``: a row for each chosen path.

    Takes ``tree_id, node_id, parent_id, role, text, score``. Null roles and texts are empty;
    only texts of the assistant are under the loss mask. A row of the result holds a whole
    conversation, which is what bounds the texts that meet in one task.
    """
    paths = best_paths(nodes, paths_per_tree)
    turns = paths.join(nodes.select("node_id", "role", "text"), "node_id").groupBy("path_id")
    turns = turns.agg(F.array_sort(F.collect_list(F.struct("depth", "role", "text"))).alias("turns"))
    done = turns.mapInArrow(
        _formatted,
        "path_id long, formatted string, loss_starts array<long>, loss_ends array<long>",
    )
    trees = nodes.select("tree_id", F.col("node_id").alias("path_id"))
    return done.join(trees, "path_id")


def conversation_nodes(conversations: DataFrame) -> DataFrame:
    """Conversations as trees in which each turn replies to the one before.

    Turns that share a number follow each other by role and text; a null conversation is one more.
    """
    rows = conversations.select(
        F.col("conv_id").alias("tree_id"), "turn", "role", "text", F.monotonically_increasing_id().alias("node_id")
    )
    rows = stage(rows, "turns")
    before = Window.partitionBy("tree_id").orderBy("turn", "role", "text", "node_id")
    nodes = rows.withColumn("parent_id", F.lag("node_id").over(before))
    return stage(nodes.withColumn("score", F.lit(0.0)).drop("turn"), "nodes")
