"""Keyed state over restarts: numbers go on, lives end by rows or by the watermark, cached values are forgotten."""

import time

import pytest
from pyspark.sql import Row

from alertmill.streaming import stateful

SCHEMA = "id long, run string, verdict string, ts timestamp"


@pytest.fixture
def feed(spark, tmp_path):
    def add(name, *rows):
        df = spark.createDataFrame(list(rows), "id long, run string, verdict string, s string")
        df.selectExpr("id", "run", "verdict", "cast(s as timestamp) ts").coalesce(1).write.parquet(str(tmp_path / "in" / name))
        return spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in" / "*"))

    def go(df, **kind):
        return sorted(map(tuple, stateful.drain(df, str(tmp_path / "out"), str(tmp_path / "ck"), **kind).collect()), key=str)

    return add, go, str(tmp_path / "ck")


def at(minute, second=0):
    return f"2024-01-01 00:{minute:02}:{second:02}"


def test_numbers_go_on_after_a_restart(feed):
    add, go, _ = feed
    step = lambda s: stateful.numbered(s, "run", "ts", "id")
    assert go(step(add("a", (2, "r", "tp", at(1)), (1, "r", "tp", at(1)), (9, None, "tp", at(0))))) == sorted([("r", 1, 1), ("r", 2, 2), (None, 9, 1)], key=str)
    got = go(step(add("b", (3, "r", "tp", at(0)), (4, "q", "tp", None))))
    assert got == sorted([("r", 1, 1), ("r", 2, 2), ("r", 3, 3), ("q", 4, 1), (None, 9, 1)], key=str)


def test_lives_end_by_rows_and_by_the_watermark(spark, feed):
    add, go, ck = feed
    step = lambda s: stateful.lives(s, "run", "ts", "id", 60)
    got = go(step(add("a", (1, "r", "", at(1)), (2, "r", "", at(2)), (3, "r", "", at(3, 1)), (4, "q", "", at(3)), (5, "x", "", None))))
    assert ("r", 1, 2, 2) in got and ("r", 3, 3, 1) not in got
    got = go(step(add("b", (6, "q", "", at(4)), (7, "z", "", at(30)))))
    got = go(step(add("c", (8, "z", "", at(31)))))
    assert got == [("q", 4, 6, 2), ("r", 1, 2, 2), ("r", 3, 3, 1)]
    assert [tuple(r)[:3] for r in stateful.held(spark, ck, "live").collect()] == [("z", 7, 8)]


def test_cached_values_are_forgotten(feed):
    add, go, _ = feed
    step = lambda s: stateful.cached(s, "run", "id", "verdict", 6)
    got = go(step(add("a", (1, "r", None, None), (2, "r", "tp", None), (3, "r", None, None), (4, "q", None, None))), one_batch=True)
    assert got == [("q", 4, None), ("r", 1, None), ("r", 3, "tp")]
    time.sleep(8)
    assert ("r", 5, None) in go(step(add("b", (5, "r", None, None))), one_batch=True)


class Held:
    """A state variable that lies here."""

    def __init__(self):
        self.now = None

    def exists(self):
        return self.now is not None

    def get(self):
        return self.now

    def update(self, value):
        self.now = value


def test_keyed_state_works_on_rows():
    """A key's rows are not made into a table, which cost more than the rows did; those without an order come last."""
    p = stateful._Numbers()
    p.seen = Held()
    feed = lambda *rows: [tuple(r) for r in p.handleInputRows(("r",), iter([Row(k="r", ord=o, i=i) for o, i in rows]), None)]
    assert feed((2, 7), (None, 1), (2, 5), (float("nan"), 3), (1, 9)) == [("r", 9, 1), ("r", 5, 2), ("r", 7, 3), ("r", 1, 4), ("r", 3, 5)]
    assert feed((0, 8)) == [("r", 8, 6)] and p.seen.now == (6,)
