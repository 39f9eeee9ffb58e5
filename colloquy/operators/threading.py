"""Conversation forests from mailbox tables.

The plan: identifiers and reference chains (expressions) -> nodes and proposed edges (shuffles by identifier)
-> one parent per node -> dummies spliced -> optional date order and subject groups -> ordinals.

Parents. A message proposes each reference as the parent of the next, and the last one as its own. A node's
parent is its own last reference, or else the earliest proposal, whatever the order of arrival, wherever no proposal into
it is on a cycle of proposals: two aggregations. That there is no cycle at all is certified, in the same pass, by any of three values
that grow along every edge: the highest place at which a node stands in any chain, the place at which it is first met, or
that place from the end. Where none holds, edges that can't be on a cycle are peeled off (``graph.circular_core``). Only nodes with
a proposal that remains, with the proposals into them, go through a kernel that follows the order of arrival.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions.dates import EARLIEST, sent_us
from colloquy.functions.headers import effective_references, normalize_message_id
from colloquy.functions.text import base_subject, unicode_casemap_key
from colloquy.operators.fold import fold_groups
from colloquy.operators.graph import circular_core, climb, components, ranked
from colloquy.operators.kernel import LAST, PARENTS, link_core
from colloquy.schema import MESSAGE_SCHEMA, NODE_SCHEMA, as_mailbox
from colloquy.session import ship
from colloquy.staging import staged, staged_with

SEPARATOR = "\x00"


class SequenceNumberError(ValueError):
    """A sequence number that isn't positive, or that two messages of a mailbox share."""


@dataclass
class Linked:
    """``messages`` with their nodes and chains, and for every node its place of creation, parent and place of attachment."""

    messages: DataFrame
    nodes: DataFrame
    #: Of the concrete nodes: how many there are, are roots, and hang below a dummy.
    counts: dict


def _box(name: str = "mailbox_id") -> Column:
    """A mailbox as a key that is never null."""
    return F.coalesce(F.col(name), F.lit(""))


def _named(node: str) -> tuple[Column, Column]:
    """Mailbox and node under names of their own (_b, _n), for the other side of a join."""
    return _box().alias("_b"), F.col(node).alias("_n")


def _is(node: str) -> Column:
    """Whether ``node`` is the one that ``_named`` names."""
    return (_box() == F.col("_b")) & (F.col(node) == F.col("_n"))


def identified(messages: DataFrame, strict: bool = True) -> DataFrame:
    """Messages with ``id``, their normalized identifier, and ``refs``, their chain of ancestors; ``strict`` as for ``as_mailbox``."""
    box = as_mailbox(messages, strict).withColumn("mailbox_id", F.nullif("mailbox_id", F.lit("")))
    return box.withColumn("id", normalize_message_id("message_id")).withColumn("refs", effective_references("references", "in_reply_to"))


def owners(messages: DataFrame) -> DataFrame:
    """(mailbox_id, id, owner_pos): the first message of each identifier owns it."""
    return messages.where("id is not null").groupBy("mailbox_id", "id").agg(F.min("input_pos").alias("owner_pos"))


def _node_of(position: Column) -> Column:
    return F.concat(F.lit("n:"), position.cast("string"))


def mentions(messages: DataFrame) -> DataFrame:
    """Each reference of each message: (mailbox_id, input_pos, idx from 1, ref)."""
    return messages.select("mailbox_id", "input_pos", F.posexplode("refs").alias("idx", "ref")).withColumn("idx", F.col("idx") + 1)


def place_nodes(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(mentions with the node of each reference, nodes of all messages and of the identifiers that no message has).

    A message whose identifier was taken before has a node of its own that no reference reaches.
    """
    named = owners(messages)
    said = mentions(messages)
    right = named.select(_box().alias("_box"), F.col("id").alias("_id"), "owner_pos")
    met = said.join(right, (_box() == F.col("_box")) & (F.col("ref") == F.col("_id")), "left").select(
        "mailbox_id", "input_pos", "idx", "ref", F.coalesce(_node_of(F.col("owner_pos")), F.concat(F.lit("d:"), "ref")).alias("node_id")
    )
    met = staged(met, "mentions")
    first = met.groupBy("mailbox_id", "node_id").agg(F.min(F.struct("input_pos", "idx")).alias("said"), F.max("idx").alias("height"))
    own = messages.select("mailbox_id", _node_of(F.col("input_pos")).alias("node_id"), "input_pos", "id", F.size("refs").alias("size"))
    a = own.select(*_named("node_id"), "mailbox_id", "input_pos", "id", "size")
    b = first.select(*_named("node_id"), F.col("mailbox_id").alias("_m"), "said", "height")
    never = F.lit(1 << 62)
    met_at = lambda pos, idx: F.struct(F.coalesce(pos, never).alias("pos"), F.coalesce(idx, F.lit(0)).alias("idx"))
    dummy_id = F.when(F.col("input_pos").isNull(), F.substring("_n", 3, 1 << 30))
    nodes = a.join(b, ["_b", "_n"], "full").select(
        F.coalesce("mailbox_id", "_m").alias("mailbox_id"), F.col("_n").alias("node_id"), "input_pos", F.coalesce("id", dummy_id).alias("message_id"),
        F.least(met_at(F.col("input_pos"), F.lit(0)), met_at(F.col("said.input_pos"), F.col("said.idx"))).alias("created"),
        F.greatest(F.coalesce("height", F.lit(0)), F.coalesce(F.col("size") + 1, F.lit(0))).alias("height"),
    )
    return met, staged(nodes, "nodes")


def proposals(messages: DataFrame, met: DataFrame) -> DataFrame:
    """Proposed edges (mailbox_id, parent, child, at_pos, at_idx, own): by a chain, or (own) by the child's message itself."""
    pairs = F.sort_array(F.collect_list(F.struct("idx", "node_id")))
    chains = met.groupBy("mailbox_id", "input_pos").agg(F.transform(pairs, lambda s: s["node_id"]).alias("chain"))
    last = F.size("chain")
    edge = lambda above, i: F.struct(
        above.alias("parent"),
        F.coalesce(F.get("chain", i + 1), _node_of(F.col("input_pos"))).alias("child"),
        F.when(i + 1 == last, F.lit(LAST)).otherwise(i + 1).alias("at_idx"),
        (i + 1 == last).alias("own"),
    )
    edges = chains.select("mailbox_id", F.col("input_pos").alias("at_pos"), F.explode(F.transform("chain", edge)).alias("e"))
    return edges.select("mailbox_id", "e.parent", "e.child", "at_pos", "e.at_idx", "e.own").where("parent <> child")


def _key(node: str) -> Column:
    """A node of any mailbox as one text."""
    return F.concat(_box(), F.lit(SEPARATOR), F.col(node))


#: Whether a value fails to grow along some edge: a flag of ``link``'s nodes each.
CERTIFICATES = ("height_falls", "later_falls", "earlier_falls")
#: Edges that may be on a cycle up to which one task takes them all; beyond, each of their components is a group.
SMALL_CORE = 20_000
COUNTS = ("all", "roots", "below_dummies")


def _counts() -> dict[str, Column]:
    real, parent = F.col("input_pos").isNotNull(), F.col("parent_id")
    found = (real, real & parent.isNull(), real & parent.startswith("d:"))
    return {name: F.count(F.when(c, 1)) for name, c in zip(COUNTS, found, strict=True)}


def link(messages: DataFrame, strict: bool = True) -> Linked:
    """A parent for every node that has one."""
    ship(messages.sparkSession)
    absent = [f for f in MESSAGE_SCHEMA if f.name not in messages.columns]
    messages = staged(identified(messages, strict), "messages")
    # What isn't there is a constant again, so that the planner leaves out all that would be computed from it.
    messages = messages.withColumns({f.name: F.lit(None).cast(f.dataType) for f in absent if f.name != "mailbox_id"})
    met, nodes = place_nodes(messages)
    edges = proposals(messages, met)
    above = nodes.select(*_named("node_id"), F.col("height").alias("low"), F.col("created").alias("from"))
    chosen = F.min_by(F.struct("parent", "at_pos", "at_idx"), F.struct(~F.col("own"), "at_pos", "at_idx"))
    parents = edges.join(above, _is("parent")).groupBy(*_named("child"))
    parents = parents.agg(chosen.alias("c"), F.max("low").alias("low"), F.max("from").alias("last_from"), F.min("from").alias("first_from"))
    linked = nodes.join(parents, _is("node_id"), "left").select(
        "mailbox_id", "node_id", "input_pos", "message_id", "created",
        F.col("c.parent").alias("parent_id"), F.struct("c.at_pos", "c.at_idx").alias("attached"),
        (F.col("low") >= F.col("height")).alias("height_falls"),
        (F.col("last_from") >= F.col("created")).alias("later_falls"),
        (F.col("first_from") <= F.col("created")).alias("earlier_falls"),
    )
    linked, got = staged_with(linked, "linked", **{c: F.count(F.when(F.col(c), 1)) for c in CERTIFICATES}, **_counts())
    linked = linked.drop(*CERTIFICATES)
    sure = Linked(messages, linked, {c: got[c] for c in COUNTS})
    if not all(got[c] for c in CERTIFICATES):
        return sure
    edges = edges.withColumns({"above": _key("parent"), "below": _key("child")})
    core, n = circular_core(edges.select(F.col("above").alias("a"), F.col("below").alias("b")))
    if not n:
        return sure
    asked = core.select(F.col("b").alias("node")).distinct()
    asked = asked.withColumn("root", F.lit("")) if n <= SMALL_CORE else staged(asked.join(components(core), "node"), "doubtful")
    rows = edges.join(asked, F.col("below") == F.col("node"))
    walked = fold_groups(rows.select("root", "at_pos", "at_idx", "above", "below", "own"), ["root"], link_core, PARENTS)
    walked = asked.select(F.col("node").alias("_k")).join(walked, F.col("_k") == F.col("node"), "left").drop("node")
    walked = walked.select("_k", F.substring_index("parent", SEPARATOR, -1).alias("_p"), F.struct("at_pos", "at_idx").alias("_a"))
    walked_too = F.col("_k").isNotNull()
    linked = linked.join(walked, _key("node_id") == F.col("_k"), "left").select(
        "mailbox_id", "node_id", "input_pos", "message_id", "created",
        F.when(walked_too, F.col("_p")).otherwise(F.col("parent_id")).alias("parent_id"),
        F.when(walked_too, F.col("_a")).otherwise(F.col("attached")).alias("attached"),
    )
    linked, got = staged_with(linked, "linked", **_counts())
    return Linked(messages, linked, {c: got[c] for c in COUNTS})


def prune(linked: Linked) -> DataFrame:
    """Dummies spliced: concrete nodes, and the dummies that stay as roots of two or more.

    Gives mailbox_id, node_id, input_pos, message_id, parent_id, created (of roots) and path, the places of
    attachment below the new parent, by which siblings are ordered.
    """
    nodes = linked.nodes
    renamed = {"parent_id": "_p", "attached": "_a", "created": "_c"}
    dummies = nodes.where("input_pos is null").select(*_named("node_id"), *[F.col(c).alias(n) for c, n in renamed.items()])
    columns = ["mailbox_id", "node_id", "input_pos", "message_id"]
    now = nodes.where("input_pos is not null").select(*columns, "created", F.col("parent_id").alias("up"), F.array("attached").alias("path"))
    # ``up`` climbs over dummies; at a dummy root it stays, with ``top`` set.
    more = linked.counts["below_dummies"]
    if not more:
        return now.withColumnRenamed("up", "parent_id")
    now = now.withColumn("top", F.lit(False))
    waiting, ends = F.col("up").startswith("d:") & ~F.col("top"), F.col("_p").isNull()
    while more:
        up = now.where(waiting).join(dummies, _is("up"))
        up = up.select(
            *columns, F.when(ends, F.col("_c")).otherwise(F.col("created")).alias("created"), F.coalesce("_p", "up").alias("up"),
            F.when(ends, F.col("path")).otherwise(F.concat(F.array("_a"), "path")).alias("path"), ends.alias("top"),
        )
        now, got = staged_with(now.where(~waiting | waiting.isNull()).unionByName(up), "prune", more=F.count(F.when(waiting, 1)))
        more = got["more"]
    tops = now.where("top").groupBy("mailbox_id", "up").agg(F.count("*").alias("n"), F.min("created").alias("created")).where("n > 1")
    tops = tops.select(
        "mailbox_id", F.col("up").alias("node_id"), F.lit(None).cast("long").alias("input_pos"),
        F.substring("up", 3, 1 << 30).alias("message_id"), F.lit(None).cast("string").alias("parent_id"), "created",
    )
    kept = tops.select(*_named("node_id"))
    real = now.join(kept, _is("up") & F.col("top"), "left")
    parent = F.when(F.col("top"), F.col("_n")).otherwise(F.col("up"))
    real = real.select("mailbox_id", "node_id", "input_pos", "message_id", parent.alias("parent_id"), "created", "path")
    return real.unionByName(tops.withColumn("path", F.lit(None).cast(real.schema["path"].dataType)))


def check_sequence_numbers(messages: DataFrame) -> None:
    """Raises for numbers that aren't positive and for those that two messages of a mailbox have (or take by position)."""
    bad = messages.where("sequence_number <= 0").select("sequence_number").first()
    if bad:
        raise SequenceNumberError("sequence_number must be a positive integer")
    twice = messages.groupBy("mailbox_id", F.coalesce("sequence_number", "input_pos").alias("n")).count().where("count > 1").select("n").first()
    if twice:
        raise SequenceNumberError(f"duplicate sequence number: {twice['n']}")


def sort_keys(messages: DataFrame) -> DataFrame:
    """The key (sent_us, seq, pos) of every message: its date, its number or else position, its position."""
    date = sent_us("sent_date", "internal_date", F.col("sent_ts"), F.col("internal_ts"))
    key = F.struct(date.alias("sent_us"), F.coalesce("sequence_number", "input_pos").alias("seq"), F.col("input_pos").alias("pos"))
    return messages.select(_box().alias("_b"), F.col("input_pos").alias("_pos"), key.alias("key"))


def _with_keys(forest: DataFrame, messages: DataFrame, dummies: bool = True) -> DataFrame:
    """``key`` of every node: its date, number and position; a dummy, if there may be some, has that of its earliest child."""
    keyed = forest.join(sort_keys(messages), (_box() == F.col("_b")) & (F.col("input_pos") == F.col("_pos")), "left").drop("_b", "_pos")
    if not dummies:
        return keyed
    first = keyed.where("parent_id is not null and input_pos is not null").groupBy(*_named("parent_id")).agg(F.min("key").alias("_k"))
    earliest = F.struct(F.lit(EARLIEST).alias("sent_us"), F.lit(0).cast("long").alias("seq"), F.lit(0).cast("long").alias("pos"))
    out = keyed.join(first, _is("node_id"), "left")
    return out.withColumn("key", F.coalesce("key", F.when(F.col("input_pos").isNull(), F.col("_k")), earliest)).drop("_b", "_n", "_k")


def group_subjects(forest: DataFrame, messages: DataFrame) -> DataFrame:
    """Roots of a mailbox that share a base subject become one thread; ``forest`` has ``place``, the order of its roots.

    A dummy among them takes the others in; else the first that isn't a reply takes the replies before the
    second such, and from that one on (or for replies alone) a new dummy takes the rest. A merged thread
    stands where its first member stood.
    """
    subjects = messages.select(_box().alias("_b"), F.col("input_pos").alias("_pos"), "subject")
    roots = forest.where("parent_id is null").select("mailbox_id", "node_id", "input_pos", "place")
    # A dummy's subject is that of its first child.
    below = forest.where("parent_id like 'd:%' and input_pos is not null")
    firsts = below.groupBy("mailbox_id", F.col("parent_id").alias("node_id")).agg(F.min_by("input_pos", "rank_key").alias("child_pos"))
    f = firsts.select(*_named("node_id"), "child_pos")
    roots = roots.join(f, _is("node_id"), "left").drop("_b", "_n")
    roots = roots.withColumn("subject_pos", F.coalesce("input_pos", "child_pos"))
    roots = roots.join(subjects, (_box() == F.col("_b")) & (F.col("subject_pos") == F.col("_pos")), "left").withColumn("s", base_subject("subject"))
    facts = [F.col("input_pos").isNull().alias("dummy"), F.col("s.is_reply").alias("reply"), unicode_casemap_key(F.col("s.base")).alias("base")]
    roots = roots.select("mailbox_id", "node_id", "place", *facts).where("base <> ''")
    roots = staged(roots, "subjects")
    original = ~F.col("dummy") & ~F.col("reply")
    first = lambda c: F.min(F.when(c, F.col("place")))
    groups = roots.groupBy(_box().alias("_b"), F.col("base").alias("_base")).agg(
        F.count("*").alias("n"), first(F.col("dummy")).alias("dummy_at"), first(original).alias("original_at"), F.min("place").alias("first_at")
    ).where("n > 1")
    met = staged(roots.join(groups, (_box() == F.col("_b")) & (F.col("base") == F.col("_base"))), "members")
    # From here on a new dummy takes members, where the group has none of its own.
    second_reply = F.when(F.col("place") > F.col("first_at"), F.col("place"))
    second_original = F.when(original & (F.col("place") > F.col("original_at")), F.col("place"))
    start = F.when(F.col("dummy_at").isNull(), F.min(F.when(F.col("original_at").isNull(), second_reply).otherwise(second_original)))
    starts = met.groupBy("_b", "_base", "dummy_at").agg(start.alias("start"))
    starts = starts.select(F.col("_b").alias("_b2"), F.col("_base").alias("_base2"), "start")
    met = met.join(starts, (F.col("_b") == F.col("_b2")) & (F.col("_base") == F.col("_base2")))
    owner_at = F.coalesce("dummy_at", "original_at", "first_at")
    owners_ = met.where(F.col("place") == owner_at).select(F.col("_b").alias("_b3"), F.col("_base").alias("_base3"), F.col("node_id").alias("owner"))
    met = met.join(owners_, (F.col("_b") == F.col("_b3")) & (F.col("_base") == F.col("_base3")))
    new = F.concat(F.lit("m:"), F.col("owner"))
    owned = F.col("node_id") == F.col("owner")
    to = F.when(F.col("start").isNotNull() & (owned | (F.col("place") >= F.col("start"))), new).when(~owned, F.col("owner"))
    leads = owned & F.col("start").isNotNull()
    met = met.select("mailbox_id", "_b", "node_id", "place", "dummy", to.alias("to"), leads.alias("leads"), "first_at", "owner", "start")
    met = staged(met, "moves")
    moves = met.where("to is not null").select("_b", F.col("node_id").alias("_n"), "to", F.col("place").alias("moved_at"), "leads", F.col("dummy").alias("emptied"))
    # 1. Members under their new parents, after the children that those have; the owner comes first under a new dummy.
    out = forest.join(moves, _is("node_id"), "left").where("emptied is null or not emptied")
    late = F.when(F.col("to").isNull(), F.lit(-1)).when(F.col("leads"), F.lit(0)).otherwise(F.col("moved_at")).cast("int")
    out = out.withColumn("late", late).withColumn("parent_id", F.coalesce("parent_id", "to"))
    out = out.drop("_b", "_n", "to", "moved_at", "leads", "emptied")
    # 2. Children of dummies that gave theirs away.
    given = moves.where("emptied").select("_b", "_n", F.col("to").alias("_to"), F.col("moved_at").alias("_at"))
    out = out.join(given, _is("parent_id"), "left")
    out = out.withColumn("parent_id", F.coalesce("_to", "parent_id")).withColumn("late", F.coalesce(F.col("_at").cast("int"), "late")).drop("_b", "_n", "_to", "_at")
    # 3. The new dummies, and the places of merged threads.
    made = met.where("leads").select("mailbox_id", "to", "first_at")
    blank = out.select(*[F.lit(None).cast(out.schema[c].dataType).alias(c) for c in out.columns]).limit(0)
    fresh = made.select("mailbox_id", F.col("to").alias("node_id"), F.col("first_at").alias("place"), F.lit(-1).alias("late"))
    fresh = fresh.select(*[F.col(c) if c in fresh.columns else F.lit(None).cast(out.schema[c].dataType).alias(c) for c in blank.columns])
    moved = met.where(F.col("start").isNull() & (F.col("node_id") == F.col("owner"))).select(F.col("_b"), F.col("node_id").alias("_n"), "first_at")
    out = out.join(moved, _is("node_id"), "left").withColumn("place", F.coalesce("first_at", "place")).drop("_b", "_n", "first_at")
    return out.unionByName(fresh)


def thread_messages(messages: DataFrame, *, group_by_subject: bool = False, sort_by_sent_date: bool = False) -> DataFrame:
    """The conversation forest of every mailbox: a table of ``NODE_SCHEMA``.

    ``messages`` needs input_pos, unique within its mailbox; see ``MESSAGE_SCHEMA``. Rows without mailbox_id are one mailbox.
    Types of dates and numbers are refused only where they are sorted by.
    """
    numbered = "sequence_number" in messages.columns
    linked = link(messages, strict=sort_by_sent_date)
    messages = linked.messages
    if sort_by_sent_date and numbered:
        check_sequence_numbers(messages)
    counts = {"roots": F.count(F.when(F.col("parent_id").isNull(), 1)), "all": F.count(F.lit(1))}
    forest, n, dummies = prune(linked).withColumn("late", F.lit(-1)), linked.counts, linked.counts["below_dummies"]
    if dummies:
        forest, n = staged_with(forest, "forest", **counts)
    if sort_by_sent_date:
        forest = staged(_with_keys(forest, messages, bool(dummies)), "keyed")
    order = F.struct("key") if sort_by_sent_date else F.struct("created")
    if group_by_subject:
        roots = forest.where("parent_id is null").select("mailbox_id", "node_id", order.alias("o"))
        roots = ranked(roots, ["mailbox_id"], [F.col("o")], "place", rows=n["roots"])
        roots = roots.select(*_named("node_id"), "place")
        forest = forest.join(roots, _is("node_id"), "left").drop("_b", "_n")
        forest = staged(forest.withColumn("rank_key", F.struct("key") if sort_by_sent_date else F.struct("path")), "placed")
        forest, n = staged_with(group_subjects(forest, messages), "grouped", **counts)
        if sort_by_sent_date:  # new dummies have no key yet
            forest = staged(_with_keys(forest.drop("key"), messages), "rekeyed")
    place = F.struct("key") if sort_by_sent_date else F.struct("place") if group_by_subject else F.struct("created")
    among = [F.col("key")] if sort_by_sent_date else [F.col("late"), F.col("path")]
    columns = ["mailbox_id", "node_id", "input_pos", "message_id", "parent_id"]
    roots = ranked(forest.where("parent_id is null").select(*columns, place.alias("o")), ["mailbox_id"], [F.col("o")], "root_ord", rows=n["roots"])
    children = ranked(forest.where("parent_id is not null"), ["mailbox_id", "parent_id"], among, "sibling_ord", rows=n["all"] - n["roots"])
    tops = climb(forest.select(_key("node_id").alias("node"), _key("parent_id").alias("parent")), n["all"] - n["roots"])
    roots = roots.select(*columns, F.col("root_ord").alias("sibling_ord"))
    placed = children.select(*columns, "sibling_ord").unionByName(roots)
    out = placed.join(tops, _key("node_id") == F.col("node"))
    ords = roots.select(_key("node_id").alias("_root"), F.col("node_id").alias("root_id"), F.col("sibling_ord").alias("root_ord"))
    out = out.join(ords, F.col("root") == F.col("_root"))
    return out.select(
        "mailbox_id", "node_id", "input_pos", "message_id", "parent_id", "root_id",
        *[F.col(c).cast("int").alias(c) for c in ("sibling_ord", "root_ord", "depth")], F.col("input_pos").isNull().alias("is_dummy"),
    ).select(*NODE_SCHEMA.names)
