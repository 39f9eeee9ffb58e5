"""Questions about a finished forest, and moving a branch in it.

A thread's nodes are numbered in preorder, each with the size of its branch: what is below a node then is a
range of numbers, and no walk is needed to ask for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.operators.fold import fold_groups
from colloquy.schema import NODE_SCHEMA


def with_payload(forest: DataFrame, messages: DataFrame) -> DataFrame:
    """``forest`` with all columns of each node's message, null for dummies, in one struct column ``payload``.

    A struct keeps columns apart whatever their names and types; messages are met by mailbox and position.
    """
    box = F.coalesce("mailbox_id", F.lit("")) if "mailbox_id" in messages.columns else F.lit("")
    found = messages.select(F.nullif(box, F.lit("")).alias("_b"), F.col("input_pos").cast("long").alias("_pos"), F.struct("*").alias("payload"))
    same = F.col("mailbox_id").eqNullSafe(F.col("_b")) & (F.col("input_pos") == F.col("_pos"))
    return forest.join(found, same, "left").drop("_b", "_pos")


def _numbered(rows: list[tuple]) -> list[tuple]:
    """(box, node_id, preorder, branch) from one thread's (box, root_id, node_id, parent_id, sibling_ord)."""
    below: dict = {}
    for _, _, node, parent, place in rows:
        below.setdefault(parent, []).append((place, node))
    order: list[tuple[str, str | None]] = []
    stack: list[tuple[str, str | None]] = [(n, None) for _, n in sorted(below.get(None, []), reverse=True)]
    while stack:
        node, parent = stack.pop()
        order.append((node, parent))
        stack += [(n, node) for _, n in sorted(below.get(node, []), reverse=True)]
    size = dict.fromkeys((n for n, _ in order), 1)
    for node, parent in reversed(order):
        if parent is not None:
            size[parent] += size[node]
    return [(rows[0][0], node, i, size[node]) for i, (node, _) in enumerate(order, 1)]


def preorder(forest: DataFrame) -> DataFrame:
    """``forest`` with preorder (from 1, within the thread) and branch, the number of nodes of the branch that a node heads."""
    box = F.coalesce("mailbox_id", F.lit(""))
    numbered = fold_groups(forest.select(box.alias("box"), "root_id", "node_id", "parent_id", "sibling_ord"), ["box", "root_id"], _numbered, "box string, _node string, preorder int, branch int")
    return forest.join(numbered, (box == F.col("box")) & (F.col("node_id") == F.col("_node"))).drop("box", "_node")


def _in(mailbox_id: str | None) -> Column:
    return F.col("mailbox_id").eqNullSafe(F.lit(mailbox_id))


def descendants(forest: DataFrame, node_id: str, mailbox_id: str | None = None) -> DataFrame:
    """The rows below a node, with their preorder; the node itself isn't one of them."""
    numbered = preorder(forest.where(_in(mailbox_id)))
    top = numbered.where(F.col("node_id") == node_id).select("root_id", "preorder", "branch").first()
    if top is None:
        raise KeyError(node_id)
    return numbered.where((F.col("root_id") == top["root_id"]) & (F.col("preorder") > top["preorder"]) & (F.col("preorder") < top["preorder"] + top["branch"]))


def has_descendant(forest: DataFrame, node_id: str, other: str, mailbox_id: str | None = None) -> bool:
    """Whether ``other`` is the node itself or below it."""
    return node_id == other or bool(descendants(forest, node_id, mailbox_id).where(F.col("node_id") == other).limit(1).count())


def add_child(forest: DataFrame, parent_id: str, child_id: str, mailbox_id: str | None = None) -> DataFrame:
    """``forest`` with a branch moved to the end of a parent's children; unchanged where that would close a cycle or is so already."""
    numbered = preorder(forest.where(_in(mailbox_id)))
    found = {r["node_id"]: r for r in numbered.where(F.col("node_id").isin(parent_id, child_id)).collect()}
    parent, child = found[parent_id], found[child_id]
    inside = parent["root_id"] == child["root_id"] and child["preorder"] <= parent["preorder"] < child["preorder"] + child["branch"]
    if inside or child["parent_id"] == parent_id:
        return forest
    last = numbered.where(F.col("parent_id") == parent_id).agg(F.max("sibling_ord")).first()[0] or 0
    moved = (F.col("root_id") == child["root_id"]) & F.col("preorder").between(child["preorder"], child["preorder"] + child["branch"] - 1)
    itself, was_root = F.col("node_id") == child_id, child["parent_id"] is None
    beside = F.col("parent_id").isNull() if was_root else F.col("parent_id") == child["parent_id"]
    up = lambda c: F.when(c > child["sibling_ord"], c - 1).otherwise(c)
    root_ord = parent["root_ord"] - (1 if was_root and parent["root_ord"] > child["root_ord"] else 0)
    changed = {
        "parent_id": F.when(itself, F.lit(parent_id)).otherwise(F.col("parent_id")),
        "root_id": F.when(moved, F.lit(parent["root_id"])).otherwise(F.col("root_id")),
        "sibling_ord": F.when(itself, F.lit(last + 1)).when(beside, up(F.col("sibling_ord"))).otherwise(F.col("sibling_ord")),
        "root_ord": F.when(moved, F.lit(root_ord)).otherwise(up(F.col("root_ord")) if was_root else F.col("root_ord")),
        "depth": F.when(moved, F.col("depth") + (parent["depth"] + 1 - child["depth"])).otherwise(F.col("depth")),
    }
    names = NODE_SCHEMA.names
    return forest.where(~_in(mailbox_id)).select(*names).unionByName(numbered.select(*[changed[n].cast(NODE_SCHEMA[n].dataType).alias(n) if n in changed else n for n in names]))
