import itertools
import random

import model
import pytest
from pyspark.sql import functions as F

from colloquy.operators import threading as engine
from colloquy.operators.kernel import LAST, choose_parents
from colloquy.operators.threading import SequenceNumberError, thread_messages

SCHEMA = "mailbox_id string, input_pos long, message_id string, in_reply_to array<string>, references array<string>, subject string, sent_date string, sequence_number long"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


def box(name, *rows):
    """Rows as (id, references, further columns)."""
    return [dict.fromkeys(COLUMNS) | {"mailbox_id": name, "input_pos": i, "message_id": m, "references": [f"<{x}>" for x in refs.split()] or None} | (more[0] if more else {}) for i, (m, refs, *more) in enumerate(rows, 1)]


def frame(spark, boxes):
    return spark.createDataFrame([tuple(m[c] for c in COLUMNS) for b in boxes for m in b], SCHEMA)


def shapes(df, **options):
    by = {}
    for r in thread_messages(df, **options).collect():
        by.setdefault(r["mailbox_id"], []).append(r.asDict())
    return {k: model.table_shape(v) for k, v in by.items()}


CASES = {
    "chain": ([("a", ""), ("b", "a"), ("c", "a b")], [(1, [(2, [(3, [])])])]),
    "fork": ([("a", ""), ("b", "a"), ("c", "a")], [(1, [(2, []), (3, [])])]),
    "missing root": ([("b", "a"), ("c", "a b")], [(1, [(2, [])])]),
    "two below a missing root": ([("b", "a"), ("c", "a")], [(None, [(1, []), (2, [])])]),
    "self": ([("a", "a")], [(1, [])]),
    "mutual": ([("a", "b"), ("b", "a")], [(2, [(1, [])])]),
    "duplicate": ([("dup", ""), ("dup", ""), ("later", "")], [(1, []), (2, []), (3, [])]),
    "duplicate below itself": ([("dup", ""), ("dup", "dup")], [(1, [(2, [])])]),
    "no id": ([(None, ""), ("a", "")], [(1, []), (2, [])]),
    "presumed": ([("a", ""), ("b", ""), ("c", "a b")], [(1, [(2, [(3, [])])])]),
    "own id last": ([("a", "b a")], [(1, [])]),
    "reply fallback": ([("a", ""), ("b", ""), ("c", "", {"in_reply_to": ["<a> <b>"]})], [(1, [(3, [])]), (2, [])]),
}


def test_cases(spark):
    got = shapes(frame(spark, [box(k, *rows) for k, (rows, _) in CASES.items()]))
    assert got == {k: want for k, (_, want) in CASES.items()}


SUBJECT_CASES = {
    "order": ([("a", "", {"subject": "Shared"}), ("b", "", {"subject": "Shared"}), ("c", "", {"subject": "Later"})], [(None, [(1, []), (2, [])]), (3, [])]),
    "reply first": ([("a", "", {"subject": "Re: Topic"}), ("b", "", {"subject": "Topic"})], [(2, [(1, [])])]),
    "replies alone": ([("a", "", {"subject": "Re: T"}), ("b", "", {"subject": "Re: t"}), ("c", "", {"subject": "fw: T"})], [(None, [(1, []), (2, []), (3, [])])]),
    "dummies": ([("a", "x", {"subject": "T"}), ("b", "x"), ("c", "y", {"subject": "T"}), ("d", "y")], [(None, [(1, []), (2, []), (3, []), (4, [])])]),
    "then a dummy": ([("o", "", {"subject": "T"}), ("a", "x", {"subject": "Re: T"}), ("b", "x")], [(None, [(2, []), (3, []), (1, [])])]),
    "empty": ([("a", "", {"subject": ""}), ("b", "", {"subject": None}), ("c", "", {"subject": "Re:"})], [(1, []), (2, []), (3, [])]),
}


def test_subject_cases(spark):
    df = frame(spark, [box(k, *rows) for k, (rows, _) in SUBJECT_CASES.items()])
    assert shapes(df, group_by_subject=True) == {k: want for k, (_, want) in SUBJECT_CASES.items()}


def randomized(seed):
    r = random.Random(seed)
    n, tangled = r.randint(1, 12), seed % 2
    names = [f"m{i}@x" for i in range(n + 3)]
    rows = []
    for i in range(1, n + 1):
        pool = names if tangled else [*names[: i - 1], "z0@x", "z1@x", "z2@x"]
        refs = r.sample(pool, min(len(pool), r.randint(0, 4))) if r.random() < 0.7 else []
        if not tangled:
            refs.sort(key=lambda x: (x[0] == "m", int(x[1:-2])))
        own = r.choice([None, names[i - 1], names[i - 1], names[r.randint(0, n)]]) if tangled or r.random() < 0.2 else names[i - 1]
        rows.append((own, " ".join(refs), {"subject": r.choice(["T", "Re: T", "[x] T", "Fwd: U", "U", "", None, "t"]), "sent_date": f"{r.randint(1, 5)} Jan 2020 10:00:00 +0000" if r.random() < 0.8 else None, "in_reply_to": [f"<{names[0]}>"] if r.random() < 0.1 else None}))
    return box(f"b{seed}", *rows)


@pytest.mark.parametrize(("by_subject", "by_date"), [*itertools.product((False, True), repeat=2)])
def test_against_model(spark, by_subject, by_date):
    boxes = [randomized(s) for s in range(120)]
    df = frame(spark, boxes)
    want = {b[0]["mailbox_id"]: [model.shape(x) for x in model.thread(b, by_subject, by_date)] for b in boxes}
    assert shapes(df, group_by_subject=by_subject, sort_by_sent_date=by_date) == want


def test_partitioning_does_not_matter(spark):
    df = frame(spark, [randomized(s) for s in range(40)])
    assert shapes(df, group_by_subject=True) == shapes(df.repartition(7, "subject"), group_by_subject=True)


def test_one_mailbox_without_id_and_invariants(spark):
    df = frame(spark, [randomized(s) for s in range(20)])
    df = df.withColumn("input_pos", df["input_pos"] + 100 * df["mailbox_id"].substr(2, 9).cast("int")).drop("mailbox_id")
    rows = thread_messages(df).collect()
    real = [r["input_pos"] for r in rows if not r["is_dummy"]]
    assert sorted(real) == sorted(r["input_pos"] for r in df.collect())
    assert len({r["node_id"] for r in rows}) == len(rows)
    assert all(r["parent_id"] is None for r in rows if r["is_dummy"])


def test_deep_chain(spark):
    n = 3000
    df = spark.createDataFrame([("deep", i + 1, f"m{i}", None, [f"<m{i - 1}>"] if i else None, None, None, None) for i in range(n)], SCHEMA)
    rows = thread_messages(df).collect()
    assert len(rows) == n and max(r["depth"] for r in rows) == n - 1 and {r["root_id"] for r in rows} == {"n:1"}


def test_sequence_numbers(spark):
    for rows in ([("a", "", {"sequence_number": 0})], [("a", "", {"sequence_number": 1}), ("b", "", {"sequence_number": 1})], [("a", "", {"sequence_number": 2}), ("b", "")]):
        df = frame(spark, [box("x", *rows)])
        with pytest.raises(SequenceNumberError):
            thread_messages(df, sort_by_sent_date=True)
        thread_messages(df)
    same = {"sent_date": "1 Jan 2020 10:00:00 +0000"}
    df = frame(spark, [box("x", ("a", "", same | {"sequence_number": 4}), ("b", "", same | {"sequence_number": 1}), ("c", "", same))])
    assert shapes(df, sort_by_sent_date=True) == {"x": [(2, []), (3, []), (1, [])]}


def test_empty(spark):
    assert thread_messages(frame(spark, []), group_by_subject=True, sort_by_sent_date=True).count() == 0


def test_kernel_keeps_the_first_of_contradicting_edges():
    assert choose_parents([(1, "a", ["b"]), (2, "b", ["a"])]) == {"a": ("b", 1, 2_147_483_647)}


def naive_parents(messages):
    parent = {}

    def above(node):
        while node is not None:
            yield node
            node = parent[node][0] if node in parent else None

    for position, own, chain in sorted(messages):
        for index, (a, b) in enumerate(zip(chain, chain[1:]), 1):
            if b not in parent and b not in above(a):
                parent[b] = (a, position, index)
        if chain and own not in above(chain[-1]):
            parent[own] = (chain[-1], position, LAST)
    return parent


def test_kernel_against_a_naive_one():
    r = random.Random(11)
    for _ in range(3000):
        names = [str(i) for i in range(r.randint(1, 12))]
        messages = [(i, r.choice(names), r.sample(names, r.randint(0, min(4, len(names))))) for i in range(r.randint(1, 15))]
        assert choose_parents(messages) == naive_parents(messages)


def test_kernel_takes_long_chains():
    n = 100_000
    r = random.Random(12)
    for places in (range(n), range(n, 0, -1), r.sample(range(n), n)):
        found = choose_parents([(p, f"{i + 1}", [f"{i}"]) for i, p in enumerate(places)] + [(2 * n, "0", [f"{n}"])])
        assert len(found) == n and "0" not in found


@pytest.fixture
def no_kernel(monkeypatch):
    def refuse(*_):
        raise AssertionError("the kernel is asked")

    monkeypatch.setattr(engine, "fold_groups", refuse)


@pytest.mark.parametrize("order", ["oldest", "newest", "any"])
def test_chains_of_replies_need_no_kernel(spark, no_kernel, order):
    n = 100_000 if order != "any" else 20_000
    places = F.col("id") + 1 if order == "oldest" else n - F.col("id") if order == "newest" else F.pmod(F.col("id") * 7919, F.lit(n)) + 1
    named = lambda c: F.concat(F.lit("m"), c.cast("string"))
    df = spark.range(n).select(places.alias("input_pos"), named(F.col("id")).alias("message_id"), F.when(F.col("id") > 0, F.array(named(F.col("id") - 1))).alias("in_reply_to"), "id")
    got = thread_messages(df).join(df.select(F.col("input_pos").alias("p"), "id"), F.col("input_pos") == F.col("p"))
    assert got.where(F.col("depth") == F.col("id")).count() == n


def test_consistent_mail_needs_no_kernel(spark, no_kernel):
    """Truncated references, forks and gaps, in any order of arrival."""
    r = random.Random(13)
    boxes = []
    for k in range(20):
        n = 40
        up = [None] + [r.randrange(i) for i in range(1, n)]
        rows = []
        for i in range(n):
            chain, at = [], up[i]
            while at is not None and len(chain) < r.randint(1, 4):
                chain.append(f"m{at}")
                at = up[at]
            rows.append((f"m{i}", " ".join(reversed(chain))))
        r.shuffle(rows)
        boxes.append(box(f"b{k}", *rows))
    want = {b[0]["mailbox_id"]: [model.shape(x) for x in model.thread(b)] for b in boxes}
    assert shapes(frame(spark, boxes)) == want


def test_only_the_core_goes_to_the_kernel(spark, monkeypatch):
    """A long thread with one contradiction: nodes on no cycle don't travel, and both ways to send the core agree."""
    sent = []
    fold = engine.fold_groups
    monkeypatch.setattr(engine, "fold_groups", lambda df, *a: sent.append(df.count()) or fold(df, *a))
    rows = [(f"m{i}", f"m{i - 1}" if i else "") for i in range(300)] + [("x", "y m299"), ("y", "x m299")]
    r = random.Random(14)
    r.shuffle(rows)
    b = box("b", *rows)
    want = {"b": [model.shape(x) for x in model.thread(b)]}
    assert shapes(frame(spark, [b])) == want
    monkeypatch.setattr(engine, "SMALL_CORE", 0)
    assert shapes(frame(spark, [b, [m | {"mailbox_id": "c"} for m in b]])) == want | {"c": want["b"]}
    assert sent and max(sent) <= 12


def test_odd_types_matter_only_where_they_are_sorted_by(spark):
    df = frame(spark, [box("x", ("a", ""), ("b", "a"))]).withColumn("sent_date", F.lit(True))
    assert thread_messages(df).count() == 2
    with pytest.raises(TypeError):
        thread_messages(df, sort_by_sent_date=True)
