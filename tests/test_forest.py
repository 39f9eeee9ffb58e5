import pytest
from pyspark.sql import functions as F

import colloquy
from colloquy.operators.forest import add_child, descendants, has_descendant, preorder, with_payload
from colloquy.operators.threading import thread_messages


@pytest.fixture(scope="module")
def forest(spark):
    refs = {1: None, 2: "1", 3: "2", 4: "1", 5: None, 6: "5"}
    rows = [(box, i, str(i), [f"<{r}>"] if r else None) for box in ("a", None) for i, r in refs.items()]
    return thread_messages(spark.createDataFrame(rows, "mailbox_id string, input_pos long, message_id string, references array<string>")).cache()


def test_preorder(forest):
    got = {r["input_pos"]: (r["preorder"], r["branch"]) for r in preorder(forest).where("mailbox_id = 'a'").collect()}
    assert got == {1: (1, 4), 2: (2, 2), 3: (3, 1), 4: (4, 1), 5: (1, 2), 6: (2, 1)} and preorder(forest).count() == 12


def test_descendants(forest):
    assert [r["input_pos"] for r in descendants(forest, "n:1", "a").orderBy("preorder").collect()] == [2, 3, 4]
    assert has_descendant(forest, "n:1", "n:3") and has_descendant(forest, "n:3", "n:3") and not has_descendant(forest, "n:3", "n:1") and not has_descendant(forest, "n:1", "n:6")
    with pytest.raises(KeyError):
        descendants(forest, "n:77")


def test_add_child(forest):
    def of(df, box="a"):
        return {r["input_pos"]: (r["parent_id"], r["sibling_ord"], r["root_id"], r["root_ord"], r["depth"]) for r in df.where(F.col("mailbox_id").eqNullSafe(box)).collect()}

    moved = of(add_child(forest, "n:6", "n:2", "a"))
    assert moved == {1: (None, 1, "n:1", 1, 0), 4: ("n:1", 1, "n:1", 1, 1), 5: (None, 2, "n:5", 2, 0), 6: ("n:5", 1, "n:5", 2, 1), 2: ("n:6", 1, "n:5", 2, 2), 3: ("n:2", 1, "n:5", 2, 3)}
    whole = of(add_child(forest, "n:6", "n:1", "a"))
    assert whole[5] == (None, 1, "n:5", 1, 0) and whole[1] == ("n:6", 1, "n:5", 1, 2) and whole[3][4] == 4
    assert of(add_child(forest, "n:6", "n:1", "a"), None) == of(forest, None)
    for parent, child in (("n:3", "n:1"), ("n:1", "n:1"), ("n:1", "n:2")):
        assert of(add_child(forest, parent, child, "a")) == of(forest)


def test_public_names():
    assert all(getattr(colloquy, n) is not None for n in colloquy.__all__)
    with pytest.raises(AttributeError):
        colloquy.nothing


def test_payload_of_clashing_names(spark):
    messages = spark.createDataFrame([(1, "<a>", None, "x", "y"), (2, "<b>", ["<a> <z>"], "z", None)], "input_pos long, message_id string, references array<string>, node_id string, payload string")
    got = {r["input_pos"]: r["payload"] for r in with_payload(thread_messages(messages), messages).collect() if not r["is_dummy"]}
    assert {k: (p["node_id"], p["payload"], p["message_id"]) for k, p in got.items()} == {1: ("x", "y", "<a>"), 2: ("z", None, "<b>")}
