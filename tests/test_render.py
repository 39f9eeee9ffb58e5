import pytest
from pyspark.sql import functions as F

from colloquy.operators.render import ThreadSerializationError, render_thread, response_text, serialize_thread_data, serialize_thread_response, thread_texts
from colloquy.schema import NODE_SCHEMA


def tree(edges):
    """Nodes from {child: parent}, in order."""
    return [(str(c), None if p is None else str(p), i, c if c > 0 else None) for i, (c, p) in enumerate(edges.items())]


def test_texts():
    assert render_thread(tree({2: None})) == "(2)"
    assert render_thread(tree({3: None, 6: 3, 4: 6, 23: 4, 44: 6, 7: 44, 96: 7})) == "(3 6 (4 23)(44 7 96))"
    assert render_thread(tree({-1: None, 3: -1, 5: -1})) == "((3)(5))"
    assert render_thread(tree({-1: None, 3: -1})) == "(3)"
    assert render_thread(tree({1: None, -2: 1, 3: -2, 5: -2})) == "(1 (3)(5))"
    assert render_thread(tree({-1: None, -2: -1})) == ""


def test_depth():
    n = 5000
    assert render_thread(tree({i: i - 1 or None for i in range(1, n + 1)})) == "(" + " ".join(map(str, range(1, n + 1))) + ")"
    split = {1: None}
    for i in range(2, 3000, 2):
        split |= {i: i - 1 if i == 2 else i - 2, i + 1: i - 1 if i == 2 else i - 2}
    assert render_thread(tree(split)).count("(") == 2999


def forest(spark, rows):
    """Rows as (position or None, name, parent)."""
    out, place = [], 0
    for pos, name, parent in rows:
        place += 1
        out.append((None, name, pos, name, parent, rows[0][1], place, 1, 0, pos is None))
    return spark.createDataFrame(out, NODE_SCHEMA)


def messages(spark, numbers):
    return spark.createDataFrame([(i + 1, n) for i, n in enumerate(numbers)], "input_pos long, uid long")


def test_projection_and_frame(spark):
    f = forest(spark, [(1, "a", None), (2, "b", "a"), (3, "c", "b"), (4, "d", "b")])
    m = messages(spark, [1, 2, 3, 5])
    assert response_text(f, m, identifier="uid") == "* THREAD (1 2 (3)(5))\r\n"
    assert response_text(f, m, identifier="uid", include=F.col("uid") != 2, line_ending="") == "* THREAD (1 (3)(5))"
    assert response_text(f, m, identifier="uid", include=F.col("uid") > 2, line_ending="") == "* THREAD ((3)(5))"
    assert response_text(f, m, identifier="uid", include=F.lit(False)) == "* THREAD\r\n"
    assert response_text(f, m, identifier="uid", include=F.lit(None).cast("boolean")) == "* THREAD\r\n"
    assert response_text(f.limit(0), m, identifier="uid") == "* THREAD\r\n"
    assert response_text(f, m, identifier=lambda r: 10 // (r["uid"] - 2) + 100, include=lambda r: r["uid"] != 2, line_ending="") == "* THREAD (90 (110)(103))"
    assert response_text(f, m, identifier=lambda r: r["uid"], include=F.col("uid") > 2, line_ending="") == "* THREAD ((3)(5))"
    for bad in ("1", True, 1.5, None):
        with pytest.raises(ThreadSerializationError):
            response_text(f, m, identifier=lambda r, bad=bad: bad)
    assert response_text(f, m, identifier=F.col("uid") * 10, line_ending="", validate=True) == "* THREAD (10 20 (30)(50))"


def test_errors(spark):
    f, m = forest(spark, [(1, "a", None), (2, "b", "a")]), messages(spark, [1, 2])
    with pytest.raises(ValueError):
        serialize_thread_data(f, m, identifier="number")
    with pytest.raises(ValueError):
        serialize_thread_data(f, m, identifier=3)
    with pytest.raises(TypeError):
        serialize_thread_data(f, m, identifier="uid", include=3)
    with pytest.raises(ValueError):
        serialize_thread_response(f, m, identifier="uid", line_ending="\n")
    for bad in ([1, None], [1, 0], [1, -1], [1, 1], [1, 1 << 32]):
        with pytest.raises(ThreadSerializationError):
            serialize_thread_data(f, messages(spark, bad), identifier="uid")
    assert response_text(f, messages(spark, [1, None]), identifier="uid", include=F.col("uid").isNotNull()) == "* THREAD (1)\r\n"
    assert "4294967295" in response_text(f, messages(spark, [1, (1 << 32) - 1]), identifier="uid")
    for rows in ([(1, "a", "b"), (2, "b", "a")], [(1, "a", None), (2, "b", "z")], [(1, "a", None), (2, "b", "a"), (2, "b", None)]):
        with pytest.raises(ThreadSerializationError):
            serialize_thread_data(forest(spark, rows), m, identifier="uid", validate=True)


def test_threads_as_rows_and_default_refusals(spark):
    f, m = forest(spark, [(1, "a", None), (2, "b", "a"), (3, "c", "b"), (4, "d", "b")]), messages(spark, [1, 2, 3, 5])
    assert [tuple(r) for r in thread_texts(f, m, identifier="uid").collect()] == [(None, 1, "(1 2 (3)(5))")]
    with pytest.raises(ThreadSerializationError):
        serialize_thread_data(forest(spark, [(1, "a", "b"), (2, "b", "a")]), m, identifier="uid")
    for bad in (m, None, f.withColumn("depth", F.lit("1"))):
        with pytest.raises(TypeError):
            serialize_thread_data(bad, m, identifier="uid")
