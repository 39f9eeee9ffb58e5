"""THREAD responses: search results projected onto a forest, and their text.

A node that isn't selected (or is a dummy) gives its branches to its parent; at the top, two or more branches
that lost their root stand together under none. A thread's text is a fold in order, so each thread is rendered by one
call of a grouped map. ``thread_texts`` gives these texts as rows in order, which is what scales: a response joins
all texts of a mailbox into one string, which one task has to hold.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.operators.fold import fold_groups
from colloquy.operators.graph import CycleError, climb
from colloquy.schema import NODE_SCHEMA
from colloquy.session import ship
from colloquy.staging import staged

#: Largest identifier of a response.
MOST = 4_294_967_295
LINE_ENDINGS = ("", "\r\n")


class ThreadSerializationError(ValueError):
    """A forest or identifiers that no THREAD response can express."""


def _flatten(rope) -> str:
    out, stack = [], [rope]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        else:
            stack.extend(reversed(x))
    return "".join(out)


def _nested(branches: list):
    return [["(", b, ")"] for b in branches]


def render_thread(nodes: list[tuple[str, str | None, int, int | None]]) -> str:
    """Text of one thread from (node, parent, sibling ordinal, identifier or None where it isn't selected)."""
    below: dict = {}
    for node, parent, place, number in nodes:
        below.setdefault(parent, []).append((place, node, number))
    tops = sorted(below.get(None, []))
    order, stack = [], [(n, x) for _, n, x in tops]
    while stack:
        node, number = stack.pop()
        order.append((node, number))
        stack += [(n, x) for _, n, x in below.get(node, [])]
    branches: dict = {}
    for node, number in reversed(order):
        own = [b for _, n, _ in sorted(below.get(node, [])) for b in branches.pop(n)]
        if number is None:
            branches[node] = own
        elif len(own) > 1:
            branches[node] = [[str(number), " ", _nested(own)]]
        else:
            branches[node] = [[str(number), " ", own[0]] if own else str(number)]
    out = []
    for _, node, _ in tops:
        got = branches[node]
        if len(got) == 1:
            out.append(["(", got[0], ")"])
        elif got:
            out.append(["(", _nested(got), ")"])
    return _flatten(out)


def _render_group(rows: list[tuple]) -> list[tuple]:
    """A row of (box, root_ord, text) from one thread's (box, root_id, node_id, parent_id, sibling_ord, root_ord, number)."""
    return [(rows[0][0], rows[0][5], render_thread([(r[2], r[3], r[4], r[6]) for r in rows]))]


def _asked(facts: DataFrame, identifier: Callable | None, include: Callable | None) -> DataFrame:
    """_b, _pos, _chosen and _number of messages, by functions of their rows; an identifier is asked for only where a message is included."""
    ship(facts.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list, list, list] = ([], [], [], [])
            for row in batch.to_pylist():
                box, pos, chosen, number = (row.pop(n) for n in ("_b", "_pos", "_chosen", "_number"))
                if include:
                    chosen = bool(include(row))
                if identifier:
                    number = identifier(row) if chosen else None
                    if isinstance(number, bool) or not isinstance(number, int) or not 0 < number <= MOST:
                        number = None  # refused below, where the message is included
                for column, value in zip(out, (box, pos, chosen, number), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.int64(), pa.bool_(), pa.int64()), strict=True)], names=["_b", "_pos", "_chosen", "_number"])

    return facts.mapInArrow(run, "_b string, _pos long, _chosen boolean, _number long")


def _checked(selected: DataFrame) -> None:
    bad = selected.where("selected and (number is null or number <= 0 or number > 4294967295)").select("number").first()
    if bad:
        raise ThreadSerializationError("message identifier must be a positive integer in the unsigned 32-bit range")
    twice = selected.where("selected").groupBy("box", "number").count().where("count > 1").select("number").first()
    if twice:
        raise ThreadSerializationError(f"duplicate identifier in THREAD response: {twice['number']}")
    if selected.groupBy("box", "node_id").count().where("count > 1").limit(1).count():
        raise ThreadSerializationError("a node appears in multiple positions")


def check_forest(forest: DataFrame) -> None:
    """Raises where a table isn't a forest. Depths that grow by one from parent to child prove that it is, by one join; else it is walked."""
    box = F.coalesce("mailbox_id", F.lit(""))
    rows = forest.select(box.alias("box"), "node_id", "parent_id", "root_id", "depth")
    above = rows.select(F.col("box").alias("_b"), F.col("node_id").alias("_n"), F.col("root_id").alias("_root"), F.col("depth").alias("_depth"))
    met = rows.join(above, (F.col("box") == F.col("_b")) & (F.coalesce("parent_id", "node_id") == F.col("_n")), "left")
    fits = (F.col("_root") == F.col("root_id")) & (F.col("depth") == F.col("_depth") + F.col("parent_id").isNotNull().cast("int"))
    if not met.where(~F.coalesce(fits, F.lit(False))).limit(1).count():
        return  # a node that is twice in the table is told by ``_checked``
    key = lambda n: F.concat(F.coalesce("mailbox_id", F.lit("")), F.lit("\x00"), F.col(n))
    try:
        reached = climb(forest.select(key("node_id").alias("node"), key("parent_id").alias("parent"))).count()
    except CycleError as e:
        raise ThreadSerializationError(str(e)) from e
    if reached != forest.count():
        raise ThreadSerializationError("a node's parent isn't in the forest, or a node appears in multiple positions")


def _require_nodes(forest: DataFrame) -> None:
    """Raises for what isn't a table of nodes."""
    if not isinstance(forest, DataFrame) or not set(NODE_SCHEMA.names) <= set(forest.columns):
        raise TypeError("a forest must be a table with the columns of NODE_SCHEMA")
    for f in NODE_SCHEMA:
        if type(forest.schema[f.name].dataType) is not type(f.dataType):
            raise TypeError(f"{f.name} of a forest must be {f.dataType.simpleString()}")


def _selected(forest: DataFrame, messages: DataFrame, identifier: str | Column | Callable, include: Column | Callable | None, validate: bool) -> DataFrame:
    """The forest's nodes with ``number``, null where a node isn't selected."""
    _require_nodes(forest)
    ask_id = identifier if not isinstance(identifier, (str, Column)) else None
    ask_in = include if include is not None and not isinstance(include, Column) else None
    if ask_id is not None and not callable(ask_id) or isinstance(identifier, str) and identifier not in ("sequence_number", "uid"):
        raise ValueError("identifier must be 'sequence_number', 'uid', a column or a function")
    if ask_in is not None and not callable(ask_in):
        raise TypeError("include must be a column or a function")
    if isinstance(identifier, str) and identifier not in messages.columns:
        messages = messages.withColumn(identifier, F.lit(None).cast("long"))
    number = F.lit(None).cast("long") if ask_id else identifier if isinstance(identifier, Column) else F.col(identifier)
    box = F.coalesce("mailbox_id", F.lit("")) if "mailbox_id" in messages.columns else F.lit("")
    chosen = F.lit(True) if include is None or ask_in else F.coalesce(include, F.lit(False))
    facts = {"_b": box, "_pos": F.col("input_pos").cast("long"), "_chosen": chosen, "_number": number.cast("long")}
    if ask_id or ask_in:
        facts = _asked(messages.withColumns(facts), ask_id, ask_in)
    else:
        facts = messages.select(*[c.alias(n) for n, c in facts.items()])
    if validate:
        check_forest(forest)
    nodes = forest.select(F.coalesce("mailbox_id", F.lit("")).alias("box"), "node_id", "parent_id", "root_id", "sibling_ord", "root_ord", "input_pos")
    found = nodes.join(facts, (F.col("box") == F.col("_b")) & (F.col("input_pos") == F.col("_pos")), "left")
    found = found.withColumn("selected", F.coalesce("_chosen", F.lit(False))).withColumn("number", F.when(F.col("selected"), F.col("_number")))
    found = staged(found.drop("_b", "_pos", "_chosen", "_number", "input_pos"), "selected")
    _checked(found)
    return found


def _texts(selected: DataFrame) -> DataFrame:
    threads = selected.select("box", "root_id", "node_id", "parent_id", "sibling_ord", "root_ord", "number")
    return fold_groups(threads, ["box", "root_id"], _render_group, "box string, root_ord int, text string").where("text <> ''")


def thread_texts(
    forest: DataFrame, messages: DataFrame, *, identifier: str | Column | Callable = "sequence_number", include: Column | Callable | None = None, validate: bool = True
) -> DataFrame:
    """(mailbox_id, root_ord, text): the list of every thread that has a selected message; a response is their texts by root_ord.

    Arguments as for ``serialize_thread_data``. No task holds more than a thread.
    """
    found = _texts(_selected(forest, messages, identifier, include, validate))
    return found.select(F.nullif("box", F.lit("")).alias("mailbox_id"), "root_ord", "text")


def serialize_thread_data(
    forest: DataFrame, messages: DataFrame, *, identifier: str | Column | Callable = "sequence_number", include: Column | Callable | None = None, validate: bool = True
) -> DataFrame:
    """(mailbox_id, data): the THREAD data of every mailbox in ``forest``, each one string.

    ``identifier`` is "sequence_number", "uid", a column over ``messages`` or a function of a message's row as a dict; ``include`` a
    condition over them or such a function, null counts as false. Both may use payload columns. They apply to the
    finished forest, so excluded ancestors still connect. Columns stay in the JVM; functions don't. ``validate`` refuses
    tables that are no forest.
    """
    selected = _selected(forest, messages, identifier, include, validate)
    in_order = F.sort_array(F.collect_list(F.struct("root_ord", "text")))
    lists = _texts(selected).groupBy("box").agg(F.array_join(F.transform(in_order, lambda s: s["text"]), "").alias("lists"))
    data = F.when(F.col("lists").isNull(), F.lit("THREAD")).otherwise(F.concat(F.lit("THREAD "), F.col("lists")))
    return selected.select("box").distinct().join(lists, "box", "left").select(F.nullif("box", F.lit("")).alias("mailbox_id"), data.alias("data"))


def serialize_thread_response(
    forest: DataFrame, messages: DataFrame, *, identifier: str | Column | Callable = "sequence_number", include: Column | Callable | None = None,
    line_ending: str = "\r\n", validate: bool = True,
) -> DataFrame:
    """(mailbox_id, response): the data framed as an untagged response."""
    if line_ending not in LINE_ENDINGS:
        raise ValueError("line_ending must be '' or CRLF")
    data = serialize_thread_data(forest, messages, identifier=identifier, include=include, validate=validate)
    return data.select("mailbox_id", F.concat(F.lit("* "), "data", F.lit(line_ending)).alias("response"))


def response_text(forest: DataFrame, messages: DataFrame, **options) -> str:
    """The response of a forest with at most one mailbox, as text; an empty one is an empty THREAD response."""
    line_ending = options.get("line_ending", "\r\n")
    rows = serialize_thread_response(forest, messages, **options).limit(2).collect()
    if len(rows) > 1:
        raise ValueError("the forest has several mailboxes")
    return rows[0]["response"] if rows else f"* THREAD{line_ending}"
