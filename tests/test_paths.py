"""Paths and components of random graphs against plain searches, and on graphs that plain searches cannot finish."""

import random
import sys

import pytest

from alertmill.operators import facts, graph


def frames(spark, edges, starts, targets):
    one = lambda rows, c: spark.createDataFrame([(x,) for x in rows], f"{c} long")
    return spark.createDataFrame(list(edges), "src long, dst long"), one(starts, "start"), one(targets, "node")


def simple(edges, start, most, stop=()):
    out = {}
    for a, b in set(edges):
        out.setdefault(a, []).append(b)
    found, front = [(start,)], [(start,)]
    for _ in range(most):
        front = [(*p, x) for p in front if p[-1] not in stop for x in out.get(p[-1], []) if x not in p]
        found += front
    return found


def some_graph(seed, acyclic):
    rng = random.Random(seed)
    n = 9
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(15)]
    return [(min(e), max(e)) for e in edges if e[0] != e[1]] if acyclic else edges


@pytest.mark.parametrize("seed,acyclic", [(1, True), (2, False)])
def test_random_graphs(spark, seed, acyclic):
    e = some_graph(seed, acyclic)
    starts, targets, most = list(range(9)), [2, 5, 7], 3
    edges, begin, ends = frames(spark, e, starts, targets)
    every = {s: simple(e, s, most) for s in starts}
    want = sorted((s, p) for s in starts for p in every[s] if p[-1] in targets)
    assert sorted((r.start, tuple(r.path)) for r in graph.paths_between(edges, begin, ends, most).collect()) == want

    onward = {a for a, _ in e}
    off = {s for s in starts if any(len(p) == most + 1 and p[-1] in onward for p in every[s])}
    assert {r.start for r in graph.cut_off(edges, begin, most).collect()} == off
    back = [(b, a) for a, b in e]
    upward = {a for a, _ in back}
    traces = sorted(((s, p[::-1]) for s in starts for p in simple(back, s, most) if p[-1] in targets), key=str)
    cut = {s for s in starts if any(len(p) == most + 1 and p[-1] in upward for p in simple(back, s, most))}
    got = facts.source_traces(edges, begin, ends, most).collect()
    assert sorted(((r.start, tuple(r.path)) for r in got if r.path), key=str) == traces
    assert all(r.exhausted == (r.start in cut) for r in got) and {r.start for r in got if r.path is None} == cut - {s for s, _ in traces}

    longest = {}
    for s in starts:
        hits = [p for p in simple(e, s, 6, targets) if p[-1] in targets]
        if hits:
            longest[s] = min(hits, key=lambda p: (-len(p), p))
    assert {r.start: tuple(r.path) for r in graph.forward_trace(edges, begin, ends, 6).collect()} == longest


def reach(edges, n):
    out = {i: {i} for i in range(n)}
    for _ in range(n):
        for a, b in edges:
            for s in out:
                if a in out[s]:
                    out[s] |= {b}
    return out


@pytest.mark.parametrize("seed", range(3))
def test_components_of_random_graphs(spark, seed):
    rng = random.Random(seed)
    n, e = 40, []
    for _ in range(rng.choice([30, 45, 60])):
        a = rng.randrange(n)
        e.append((a, (a + 1) % n if rng.random() < 0.5 else rng.randrange(n)))
    r = reach(e, n)
    known = {x for p in e for x in p}
    want = {a: min(b for b in r[a] if a in r[b]) for a in known}
    got = graph.strong_components(spark.createDataFrame(e, "src long, dst long"))
    assert {x.node: x.component for x in got.collect()} == want
    assert {x.node for x in graph.on_cycles(spark.createDataFrame(e, "src long, dst long")).collect()} == {a for a in known if (a, a) in e or sum(want[b] == want[a] for b in known) > 1}


def test_a_ring_takes_logarithmic_rounds(spark, monkeypatch):
    """10**4 nodes in one ring with a tail on either side: a round a node would not end."""
    rounds, real = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: rounds.append(1) or real(df))
    n = 10_000
    ring = spark.range(n).selectExpr("id + 100 as src", f"(id + 1) % {n} + 100 as dst")
    tails = spark.createDataFrame([(i, i + 1) for i in range(99)] + [(99, 100), (500, 20_000)] + [(20_000 + i, 20_001 + i) for i in range(50)], "src long, dst long")
    got = graph.strong_components(ring.union(tails)).groupBy("component").count().where("count > 1").collect()
    assert [(r.component, r["count"]) for r in got] == [(100, n)] and len(rounds) < 150


def test_dead_ends_cost_nothing(spark):
    """Twenty layers of two nodes are 2**20 ways that lead nowhere; one way beside them leads to the target."""
    layers = [(2 * i + a, 2 * i + 2 + b) for i in range(20) for a in (0, 1) for b in (0, 1)]
    e = [*layers, (0, 1000), (1000, 1001)]
    edges, begin, ends = frames(spark, e, [0], [1001])
    assert [r.path for r in graph.paths_between(edges, begin, ends, 24).collect()] == [[0, 1000, 1001]]
    back, begin, _ = frames(spark, [(b, a) for a, b in e], [0], [])
    got = facts.source_traces(back, begin, ends, 10).collect()
    assert [(r.path, r.exhausted) for r in got] == [([1001, 1000, 0], True)]
    assert [r.path for r in graph.forward_trace(edges, begin, ends, 24).collect()] == [[0, 1000, 1001]]


def test_limited_paths_are_the_shortest(spark):
    e = [(0, 1), (1, 9), (0, 2), (2, 1), (2, 9), (0, 9)]
    edges, begin, ends = frames(spark, [*e, (5, 9)], [0, 5, 7], [9])
    got = facts.flow_paths(edges.selectExpr("*", "true as passes"), begin, ends, begin.withColumnRenamed("start", "node"), 5, 3).collect()
    assert sorted((r.start, tuple(r.path)) for r in got) == [(0, (0, 1, 9)), (0, (0, 2, 9)), (0, (0, 9)), (5, (5, 9))]


def test_walk_order_against_a_walk(spark):
    rng, rows = random.Random(3), []
    for g in range(12):
        n = rng.randint(1, 30)
        names = [f"n{i}" for i in range(n)]
        rows += [(g, i, x, rng.choice([*names, "", "0", "gone", None])) for i, x in enumerate(names)]
    rows += [(99, i, f"c{i}", f"c{i + 1}") for i in range(3000)]
    rows += [(98, 0, "a", ""), (98, 1, "b", "a"), (98, 2, "b", "")]

    def walk(g):
        mine = sorted(r[1:] for r in rows if r[0] == g)
        names, below, order = {x for _, x, _ in mine}, {}, []
        for _, x, p in mine:
            below.setdefault(p if p in names else None, []).append(x)

        def go(x):
            if x not in order:
                order.append(x)
                for y in below.get(x, []):
                    go(y)

        for x in below.get(None, []):
            go(x)
        for _, x, _ in mine:
            if x not in order:
                order.append(x)
        return {(g, x, i) for i, x in enumerate(order, 1)}

    sys.setrecursionlimit(20000)
    got = {tuple(r) for r in graph.preorder(spark.createDataFrame(rows, "g int, ord int, node string, parent string"), "g").collect()}
    assert got == set().union(*(walk(g) for g in {r[0] for r in rows}))
