"""Iterative graph operators over edge tables; every round is written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.staging import staged, staged_with


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): the smallest node that it is connected with.

    Large and small stars in turn; hub nodes are met by a join with their smallest neighbour alone.
    """
    now = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while (mark := now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()) != before and mark[0]:
        before = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = staged(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = staged(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least = staged(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        hung = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = staged(hung.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


class CycleError(ValueError):
    """Parents that lead back to a node itself, or to one that isn't in the table."""


def climb(parents: DataFrame, rows: int | None = None, strict: bool = True) -> DataFrame:
    """(node, root, depth) for every row of ``parents`` (node, parent; null for roots): an acyclic forest.

    Pointers double their reach in every round, so a chain of n nodes takes log n rounds; settled rows are
    left out of later joins. As long as any node that isn't on or below a cycle is unsettled, each round settles some, so a
    round that settles none ends the search. ``rows``: how many are not roots, about, where that is known. Where parents lead in a
    circle, or to no row, that is an error, or without ``strict`` those nodes are left out.
    """
    now = parents.select(
        "node", F.coalesce("parent", "node").alias("at"), F.col("parent").isNotNull().cast("int").alias("depth"), F.col("parent").isNull().alias("settled")
    )
    left = F.count(F.when(~F.col("settled"), 1))
    if rows is None:
        now, got = staged_with(now, "climb", left=left)
        waiting = got["left"]
    else:
        waiting = rows
    before = None
    while waiting and waiting != before:
        before = waiting
        step = now.select(F.col("node").alias("_n"), F.col("at").alias("_at"), F.col("depth").alias("_d"), F.col("settled").alias("_s"))
        moving = now.where("not settled").join(step, F.col("at") == F.col("_n"))
        # At a node that is settled and has depth 0 is a root; one that is settled lower knows its root.
        moved = moving.select("node", F.col("_at").alias("at"), (F.col("depth") + F.col("_d")).alias("depth"), F.col("_s").alias("settled"))
        now = staged(now.where("settled").unionByName(moved), "climb")
        waiting = now.where("not settled").count()
    if waiting and strict:
        raise CycleError("the parents of some nodes form a cycle")
    return now.where("settled").select("node", F.col("at").alias("root"), "depth")


def circular_core(edges: DataFrame, most_rounds: int = 6) -> tuple[DataFrame, int]:
    """The edges (a, b) that may be on a cycle, and their number (0: there is no cycle).

    A node without edges into it is on no cycle, nor is any that hangs below it by nodes with one edge in each; pointer doubling finds
    those at once. They go with the edges out of them, from both directions in turn, until nothing
    more goes. Every edge on a cycle stays.
    """
    now, got = staged_with(edges.select("a", "b").distinct(), "core", n=F.count(F.lit(1)))
    n, still = got["n"], 0
    for k in range(2 * most_rounds):
        if not n or still == 2:
            break
        above, below = ("a", "b") if k % 2 == 0 else ("b", "a")
        only = now.groupBy(F.col(below).alias("node")).agg(F.min(above).alias("parent"), F.max(above).alias("_other"))
        free = now.select(F.col(above).alias("node")).distinct().join(only, "node", "left_anti").select("node", F.lit(None).cast("string").alias("parent"))
        hung = only.where("parent = _other").select("node", "parent").unionByName(free)
        clear = climb(hung, strict=False).select(F.col("node").alias("_clear"))
        before = n
        now, got = staged_with(now.join(clear, F.col(above) == F.col("_clear"), "left_anti"), "core", n=F.count(F.lit(1)))
        n = got["n"]
        still = still + 1 if n == before else 0
    return now, n


def ranked(df: DataFrame, group: list[str], order: list, name: str, large: int = 2_000_000, rows: int | None = None) -> DataFrame:
    """``df`` with an ordinal from 1 within ``group``, ordered by ``order``; ``rows``: about how many there are, where that is known.

    A table beyond ``large`` rows is ordered over ranges, whose counts give each range its first ordinal,
    so no task has to hold a whole group.
    """
    from pyspark.sql import Window

    if (df.limit(large + 1).count() if rows is None else rows) <= large:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    keys = [F.col(g) for g in group]
    parts = max(8, df.sparkSession.sparkContext.defaultParallelism)
    laid = staged(df.repartitionByRange(parts, *keys, *order).sortWithinPartitions(*keys, *order).withColumn("_place", F.monotonically_increasing_id()), "ranges")
    laid = laid.withColumn("_range", F.shiftright("_place", 33)).withColumn("_row", F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)))
    counts = laid.groupBy("_range").agg(F.count("*").alias("_n"))  # as many rows as ranges
    firsts = F.broadcast(counts.withColumn("_first", F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).select("_range", "_first"))
    numbered = laid.join(firsts, "_range").withColumn("_at", F.col("_first") + F.col("_row")).drop("_place", "_range", "_row", "_first")
    starts = numbered.groupBy(*group).agg(F.min("_at").alias("_start")).select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], "_start")
    same = F.lit(True)
    for i, g in enumerate(group):
        same &= F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return numbered.join(starts, same).withColumn(name, (F.col("_at") - F.col("_start") + 1).cast("int")).drop("_at", "_start", *[f"_g{i}" for i in range(len(group))])
