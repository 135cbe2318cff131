"""Graph operators by iterative joins: closures, least depths, simple paths, bounded chains, orders, hierarchies.

Edges are (src, dst). Loops run on the driver, data on the executors; every round is cut off as a table in the shared folder,
new rows are found by anti join, and a loop ends when nothing new appears or its depth is reached. Tables of a loop grow with
the graph, whatever their files seem to weigh, so they meet by sort-merge joins and none is broadcast through the driver.
"""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or on one machine a folder of our own where it is unset."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="alertmill-")
        spark.conf.set("spark.checkpoint.dir", where)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(where)
    return where


def cut(df: DataFrame) -> DataFrame:
    """``df`` without its lineage, as a table in the folder that all executors share: its size is known to the plans that read it.

    What a table cannot hold, columns of one name or without a type, is checkpointed instead.
    """
    where = shared_dir(df.sparkSession)
    if len({c.lower() for c in df.columns}) < len(df.columns) or "void" in df.schema.simpleString():
        return df.checkpoint(eager=True)
    path = f"{where}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that one task of a join or a grouping is dealt, about.
TASK_ROWS = 200_000


def tasks_for(*frames: DataFrame) -> int:
    """Tasks for a join or a grouping of tables, by the rows of the largest."""
    return max([1, *[-(-df.count() // TASK_ROWS) for df in frames]])


def meet(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner", tasks: int | None = None) -> DataFrame:
    """A join by equal columns whose sides are both dealt over so many tasks: nothing is sent to the driver to be broadcast, and no task is
    dealt more as tables grow. Without ``tasks`` there are as many as a shuffle has."""
    keys = [on] if isinstance(on, str) else on
    if tasks:
        left, right = left.repartition(tasks, *keys), right.repartition(tasks, *keys)
    return left.join(right.hint("merge"), keys, how)


#: Rows of a block, at most.
BLOCK_ROWS = 128


def in_blocks(rows: DataFrame, by: list[str], item: str | Column, order: list[str], *more: Column) -> DataFrame:
    """``by``, ``_items`` and ``more``: what rows that agree in ``by`` have as ``item``, which is not null, in arrays of ``BLOCK_ROWS`` at
    most, in order; a join moves and compares a block where it would a row."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    rows = rows.withColumn("_block", F.floor((n - 1) / BLOCK_ROWS))
    return rows.groupBy(*by, "_block").agg(F.collect_list(item).alias("_items"), *more).drop("_block")


class Deltas:
    """What a loop found, round by round: nothing is written again but every ``COMPACT`` rounds, when the rounds become one table."""

    COMPACT = 16

    def __init__(self, first: DataFrame):
        self.parts = [first]

    def all(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.parts)

    def without(self, rows: DataFrame, keys: list[str]) -> DataFrame:
        """The rows whose keys no round has found."""
        return rows.join(self.all().select(*keys).hint("merge"), keys, "left_anti")

    def add(self, rows: DataFrame) -> None:
        self.parts.append(rows)
        if len(self.parts) > self.COMPACT:
            self.parts = [cut(self.all())]


#: A bucket of ``Buckets`` is one file, so its order may be used.
IN_ORDER = "spark.sql.legacy.bucketedTableScan.outputOrdering"


class Buckets:
    """Tables in the shared folder that lie in buckets of some columns, sorted: joins on these columns read them in step, without a shuffle or a sort of theirs."""

    def __init__(self, spark: SparkSession, by: list[str]):
        self.spark, self.by, self.n = spark, by, int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.names, self.live = [], []

    def __enter__(self) -> Buckets:
        self.was = self.spark.conf.get(IN_ORDER)
        self.spark.conf.set(IN_ORDER, "true")
        return self

    def __exit__(self, *_) -> None:
        """The tables' names go, their files stay."""
        self.spark.conf.set(IN_ORDER, self.was)
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def add(self, df: DataFrame) -> DataFrame:
        """``df``, dealt by these columns, as one more table; of ``Deltas.COMPACT`` tables the smaller half becomes one, so large ones are not written again."""
        if len(self.live) >= Deltas.COMPACT:
            self.live.sort(key=lambda x: x[2])
            half, self.live = self.live[: Deltas.COMPACT // 2], self.live[Deltas.COMPACT // 2 :]
            self.add(self.read(half).repartition(self.n, *self.by))
        name = f"cut_{uuid.uuid4().hex}"
        df.write.format("parquet").option("path", f"{shared_dir(self.spark)}/{name}").bucketBy(self.n, *self.by).sortBy(*self.by).saveAsTable(name)
        self.names.append(name)
        table = self.spark.table(name)
        self.live.append((f"{shared_dir(self.spark)}/{name}", table, table.count()))
        return table

    def without(self, rows: DataFrame) -> DataFrame:
        """The rows whose columns no table holds."""
        for _, table, _ in self.live:
            rows = rows.join(table.select(*self.by).hint("merge"), self.by, "left_anti")
        return rows

    def read(self, tables: list[tuple]) -> DataFrame:
        """The rows of tables, by their paths: names are not needed."""
        return self.spark.read.schema(tables[0][1].schema).parquet(*[path for path, _, _ in tables])

    def all(self) -> DataFrame:
        return self.read(self.live)


def closure(edges: DataFrame, starts: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(start, node, depth): what each start reaches, at its least depth; the start itself at 0.

    What was found lies in buckets of (start, node), the edges in buckets of their source, so a round shuffles its own rows only.
    """
    spark, pair = edges.sparkSession, ["start", "node"]
    with Buckets(spark, ["src"]) as of_edges, Buckets(spark, pair) as seen:
        edges = of_edges.add(edges.select("src", "dst").distinct().repartition(of_edges.n, "src"))
        front, depth = seen.add(starts.select(F.col("start"), F.col("start").alias("node"), F.lit(0).alias("depth")).distinct()), 0
        while max_depth is None or depth < max_depth:
            depth += 1
            step = front.join(edges.hint("merge"), front["node"] == edges["src"]).select("start", F.col("dst").alias("node")).distinct()
            front = seen.add(seen.without(step).withColumn("depth", F.lit(depth)))
            if front.isEmpty():
                break
        return seen.all()


def reachable(edges: DataFrame, starts: DataFrame, targets: DataFrame, max_depth: int = 24) -> DataFrame:
    """(start, node, depth) of the targets (node) that a start reaches, itself not counted."""
    found = closure(edges, starts, max_depth).where("depth > 0 and node <> start")
    return found.join(targets.select("node").distinct().hint("merge"), "node", "left_semi").select("start", "node", "depth")


def simple_paths(edges: DataFrame, starts: DataFrame, max_depth: int, stop: DataFrame | None = None) -> DataFrame:
    """(start, node, path): every path without a repeated node, up to ``max_depth`` edges; paths do not go on from ``stop`` nodes."""
    edges = edges.select("src", "dst").distinct()
    ends = stop.select(F.col("node").alias("end")).distinct() if stop is not None else None
    front = cut(starts.select("start", F.col("start").alias("node"), F.array("start").alias("path")).distinct())
    out = front
    for _ in range(max_depth):
        go = front if ends is None else front.join(ends.hint("merge"), front["node"] == ends["end"], "left_anti")
        front = cut(go.join(edges.hint("merge"), go["node"] == edges["src"]).where(~F.array_contains("path", F.col("dst"))).select("start", F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path")))
        if front.isEmpty():
            break
        out = out.unionByName(front)
    return out


def distances(edges: DataFrame, sources: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(node, depth): the least number of edges from any of ``sources`` (node); one row a node, whatever the number of sources."""
    edges = edges.select("src", "dst")
    seen = Deltas(cut(sources.select("node").distinct().withColumn("depth", F.lit(0))))
    front, depth = seen.all(), 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = front.join(edges.hint("merge"), front["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct()
        front = cut(seen.without(step, ["node"]).withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            break
        seen.add(front)
    return seen.all()


def flipped(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def between(edges: DataFrame, starts: DataFrame, targets: DataFrame, max_depth: int) -> DataFrame:
    """(src, dst, left): the edges that lie on some walk of ``max_depth`` edges at most from a start to a target (node); ``left`` edges
    at least lead on from dst. Forward and backward reach cut the graph before any path is built."""
    edges = cut(edges.select("src", "dst").distinct())
    ahead = distances(edges, starts.select(F.col("start").alias("node")), max_depth).select(F.col("node").alias("src"), F.col("depth").alias("ahead"))
    left = distances(flipped(edges), targets, max_depth).select(F.col("node").alias("dst"), F.col("depth").alias("left"))
    return cut(edges.join(ahead.hint("merge"), "src").join(left.hint("merge"), "dst").where(F.col("ahead") + 1 + F.col("left") <= max_depth).select("src", "dst", "left"))


def paths_between(edges: DataFrame, starts: DataFrame, targets: DataFrame, max_depth: int, limit: int | None = None) -> DataFrame:
    """(start, node, path): every simple path of ``max_depth`` edges at most from a start to a target (node), the start itself if it is one.

    Paths are unrolled on what ``between`` leaves, so dead ends cost nothing, and only as far as a target can still be met. With
    ``limit``, a start that has so many paths after a round is left out of the next one: its shortest ones are found.
    """
    live = between(edges, starts, targets, max_depth)
    ends = cut(targets.select("node").distinct())
    front = cut(starts.select("start", F.col("start").alias("node"), F.array("start").alias("path")).distinct())
    out = cut(front.join(ends.hint("merge"), "node", "left_semi").select("start", "node", "path"))
    for depth in range(max_depth):
        step = front.join(live.hint("merge"), (front["node"] == live["src"]) & (live["left"] < max_depth - depth)).where(~F.array_contains("path", F.col("dst")))
        front = cut(step.select("start", F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path")))
        if front.isEmpty():
            break
        out = out.unionByName(front.join(ends.hint("merge"), "node", "left_semi").select("start", "node", "path"))
        if limit is not None:
            out = cut(out)
            full = out.groupBy("start").count().where(F.col("count") >= limit)
            front = front.join(full.hint("merge"), "start", "left_anti")
    return out


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges: its strongly connected component, named by its least node; null ends are dropped.

    Nodes with one way on are contracted first, forwards and backwards, by pointer doubling, so rings and chains of n nodes take
    log n rounds. What is left is trimmed, then coloured: the least node that reaches a node (forward reach) is its colour, and those
    that reach the colour's own node inside the colour (backward reach) are its component; all colours at once, until no node is left.
    """
    edges = edges.select("src", "dst").where("src is not null and dst is not null").distinct()
    nodes = cut(edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct())
    live, undo, found = cut(edges.where("src <> dst")), [], []
    for back in (False, True):
        live, rings, steps = _contracted(flipped(live) if back else live)
        live = cut(flipped(live)) if back else live
        found.append(rings)
        undo.append(steps)
    while True:
        live = _trimmed(live)
        if live.isEmpty():
            break
        core = cut(_coloured(live))
        found.append(core)
        live = cut(live.join(core.select(F.col("node").alias("src")).hint("merge"), "src", "left_anti").join(core.select(F.col("node").alias("dst")).hint("merge"), "dst", "left_anti"))
    named = cut(reduce(DataFrame.unionByName, found))
    for steps in reversed(undo):
        named = cut(named.unionByName(_restored(steps, named)))
    # a component takes its name from all members, the contracted ones too
    low = named.groupBy("component").agg(F.min("node").alias("low"))
    named = named.join(low.hint("merge"), "component").select("node", F.col("low").alias("component"))
    return cut(nodes.join(named.hint("merge"), "node", "left").select("node", F.coalesce("component", "node").alias("component")))


def _contracted(edges: DataFrame) -> tuple[DataFrame, DataFrame, dict]:
    """The edges without the nodes that have one way on, edges into those leading to where their chain ends; the rings found among
    them (node, component); and what ``_restored`` needs."""
    single = cut(edges.groupBy("src").agg(F.count("*").alias("n"), F.min("dst").alias("to")).where("n = 1").select(F.col("src").alias("node"), "to"))
    jumps, n = [single], single.count()
    at = cut(single.select("node", "to", F.least("node", "to").alias("low")))
    covered = 1
    while covered <= n:
        beyond = at.select(F.col("node").alias("to"), F.col("to").alias("next"), F.col("low").alias("lower"))
        at = cut(at.join(beyond.hint("merge"), "to", "left").select("node", F.coalesce("next", "to").alias("to"), F.least("low", F.coalesce("lower", "low")).alias("low"), F.col("next").isNotNull().alias("on")))
        if not at.where("on").limit(1).count():
            break
        jumps.append(at.where("on").select("node", "to"))
        at = at.drop("on")
        covered *= 2
    at = at.drop("on")
    # pointers that never left the single nodes ended on rings, and every node of a ring is where some pointer ended
    inside = at.join(single.select(F.col("node").alias("to")).hint("merge"), "to", "left_semi")
    ring = cut(inside.select(F.col("to").alias("node")).distinct().join(at.hint("merge"), "node").select("node", F.col("low").alias("component")))
    out = cut(at.join(single.select(F.col("node").alias("to")).hint("merge"), "to", "left_anti").select("node", F.col("to").alias("exit")))
    rest = edges.join(single.select(F.col("node").alias("src")).hint("merge"), "src", "left_anti")
    short = rest.join(out.withColumnRenamed("node", "dst").hint("merge"), "dst", "left").join(ring.select(F.col("node").alias("dst"), F.lit(True).alias("_ring")).hint("merge"), "dst", "left")
    # a way into a chain that ends in a ring comes back from nowhere
    lost = inside.select(F.col("node").alias("dst"), F.lit(True).alias("_lost")).distinct()
    short = short.join(lost.hint("merge"), "dst", "left").where("_ring is null and _lost is null").select("src", F.coalesce("exit", "dst").alias("dst")).where("src <> dst").distinct()
    entries = cut(rest.join(out.withColumnRenamed("node", "dst").hint("merge"), "dst").select(F.col("dst").alias("node"), F.col("src").alias("from"), "exit"))
    return cut(short), ring, {"jumps": jumps, "entries": entries, "exits": out}


def _restored(steps: dict, named: DataFrame) -> DataFrame:
    """(node, component) of the contracted nodes that are part of a component: those that lie behind a way into their chain from a node of
    the component that the chain ends in."""
    name = lambda c: named.select(F.col("node").alias(c), F.col("component").alias(f"{c}_c"))
    # a node without a component of its own may still close a ring through its own chain
    entries = steps["entries"].join(name("from").hint("merge"), "from", "left").join(name("exit").hint("merge"), "exit", "left")
    entries = entries.select("node", F.coalesce("from_c", "from").alias("f"), F.coalesce("exit_c", "exit").alias("component")).where("f = component")
    marks = cut(entries.select("node", "component").distinct())
    for jump in steps["jumps"]:
        far = marks.join(jump.hint("merge"), "node").select(F.col("to").alias("node"), "component")
        marks = cut(marks.unionByName(far.join(steps["exits"].hint("merge"), "node", "left_semi")).distinct())
    ends = marks.select("component").distinct().select(F.col("component").alias("node"), "component")
    # where an exit stood alone until now, its own row comes with its chain
    return marks.unionByName(ends.join(named.hint("merge"), "node", "left_anti"))


def _trimmed(edges: DataFrame) -> DataFrame:
    """The edges less those of nodes that nothing leads to or that lead nowhere, and less those that this leaves loose."""
    for _ in range(2):
        heads, tails = edges.select(F.col("dst").alias("src")).distinct(), edges.select(F.col("src").alias("dst")).distinct()
        edges = cut(edges.join(heads.hint("merge"), "src", "left_semi").join(tails.hint("merge"), "dst", "left_semi").select("src", "dst"))
    return edges


def _coloured(edges: DataFrame) -> DataFrame:
    """(node, component): the component of every colour's own node."""
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    colour = cut(nodes.select("node", F.col("node").alias("c")))
    while True:
        seen = edges.join(colour.withColumnRenamed("node", "src").hint("merge"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("c").alias("m"))
        after = cut(colour.join(seen.hint("merge"), "node", "left").select("node", F.least("c", F.coalesce("m", "c")).alias("c"), (F.col("m") < F.col("c")).alias("new")))
        colour = after.select("node", "c")
        if not after.where("new").limit(1).count():
            break
    own = edges.join(colour.select(F.col("node").alias("src"), F.col("c").alias("a")).hint("merge"), "src").join(colour.select(F.col("node").alias("dst"), F.col("c").alias("b")).hint("merge"), "dst").where("a = b")
    return distances(flipped(cut(own.select("src", "dst"))), colour.where("node = c").select("node")).select("node").join(colour.hint("merge"), "node").select("node", F.col("c").alias("component"))


def on_cycles(edges: DataFrame) -> DataFrame:
    """(node) of nodes on a cycle: with others in a component, or with an edge to itself."""
    parts = strong_components(edges)
    big = parts.groupBy("component").count().where("count > 1")
    return parts.join(big.hint("merge"), "component", "left_semi").select("node").union(edges.where("src = dst").select(F.col("src").alias("node"))).distinct()


def shortest_first(paths: DataFrame, limit: int = 500) -> DataFrame:
    """Paths once each, the shortest first, at most ``limit``; ties by the path itself."""
    return paths.dropDuplicates(["path"]).orderBy(F.size("path"), "path").limit(limit)


def longest_to(paths: DataFrame, targets: DataFrame) -> DataFrame:
    """The longest path from each start to a target (node); of equal ones the first in order."""
    hits = paths.join(targets.select("node").distinct().hint("merge"), "node", "left_semi")
    w = Window.partitionBy("start").orderBy(F.desc(F.size("path")), "path")
    return hits.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def forward_trace(edges: DataFrame, starts: DataFrame, targets: DataFrame, max_depth: int = 24) -> DataFrame:
    """(start, node, path): for each start the longest simple path of ``max_depth`` edges at most that ends at its first target; of equal ones the first in order.

    Which lengths lead from a node to a target is worked out backwards, one row a node and length, and the path is read off forwards.
    That is exact where no cycle lies between; starts with a cycle between have their paths unrolled.
    """
    ends = cut(targets.select("node").distinct())
    # a path ends at the first target
    inner = edges.select("src", "dst").distinct().join(ends.withColumnRenamed("node", "src").hint("merge"), "src", "left_anti")
    live = between(inner, starts, ends, max_depth).select("src", "dst")
    around = cut(distances(flipped(live), on_cycles(live)).select(F.col("node").alias("start")))
    starts = starts.select("start").distinct()
    plain, twisted = cut(starts.join(around.hint("merge"), "start", "left_anti")), cut(starts.join(around.hint("merge"), "start", "left_semi"))
    lengths = Deltas(ends.select("node", F.lit(0).alias("k")))
    front = lengths.all()
    # nodes from which a cycle can be entered are no part of a plain start's way
    straight = cut(live.join(around.withColumnRenamed("start", "src").hint("merge"), "src", "left_anti"))
    for k in range(1, max_depth + 1):
        front = cut(front.join(straight.hint("merge"), front["node"] == straight["dst"]).select(F.col("src").alias("node"), F.lit(k).alias("k")).distinct())
        if front.isEmpty():
            break
        lengths.add(front)
    far = lengths.all()
    best = plain.join(far.groupBy(F.col("node").alias("start")).agg(F.max("k").alias("k")).hint("merge"), "start")
    walk = cut(best.select("start", F.col("start").alias("node"), "k", F.array("start").alias("path")))
    done = []
    while True:
        done.append(walk.where("k = 0").select("start", "node", "path"))
        going = walk.where("k > 0")
        if going.isEmpty():
            break
        ways = going.join(straight.hint("merge"), going["node"] == straight["src"]).select("start", "dst", "path", (F.col("k") - 1).alias("k"))
        ways = ways.join(far.withColumnRenamed("node", "dst").hint("merge"), ["dst", "k"])
        walk = cut(ways.groupBy("start", "k", "path").agg(F.min("dst").alias("node")).select("start", "node", "k", F.concat("path", F.array("node")).alias("path")))
    unrolled = longest_to(paths_between(live, twisted, ends, max_depth), ends)
    return reduce(DataFrame.unionByName, [*done, unrolled.select("start", "node", "path")])


def cut_off(edges: DataFrame, starts: DataFrame, max_depth: int) -> DataFrame:
    """(start) of starts with a simple path of ``max_depth`` edges that could go on: what a search of that depth leaves out.

    A start with no walk that long has none; one that reaches no cycle then has one; so has one whose shortest way somewhere is
    that long. Only for what is left are paths unrolled.
    """
    edges = cut(edges.select("src", "dst").distinct())
    able = edges.select(F.col("src").alias("node")).distinct()
    for _ in range(max_depth):
        able = cut(edges.join(able.withColumnRenamed("node", "dst").hint("merge"), "dst", "left_semi").select(F.col("src").alias("node")).distinct())
        if able.isEmpty():
            break
    left = cut(starts.select("start").distinct().join(able.withColumnRenamed("node", "start").hint("merge"), "start", "left_semi"))
    if left.isEmpty():
        return left
    around = distances(flipped(edges), on_cycles(edges)).select(F.col("node").alias("start"))
    sure, unsure = left.join(around.hint("merge"), "start", "left_anti"), cut(left.join(around.hint("merge"), "start", "left_semi"))
    if unsure.isEmpty():
        return sure
    on = edges.select(F.col("src").alias("node")).distinct()
    far = closure(edges, unsure, max_depth).where(F.col("depth") == max_depth).join(on.hint("merge"), "node", "left_semi").select("start").distinct()
    rest = cut(unsure.join(far.hint("merge"), "start", "left_anti"))
    long = simple_paths(edges, rest, max_depth).where(F.size("path") == max_depth + 1).join(on.hint("merge"), "node", "left_semi").select("start").distinct()
    return reduce(DataFrame.unionByName, [sure, far, long]).distinct()


def top_per_group(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group, and in ``truncated`` how many the group has beyond them."""
    w = Window.partitionBy(*group)
    ranked = df.withColumns({"_rank": F.row_number().over(w.orderBy(*order)), "_size": F.count("*").over(w)})
    return ranked.where(F.col("_rank") <= n).withColumn("truncated", F.greatest(F.col("_size") - n, F.lit(0))).drop("_rank", "_size")


def bounded_chain(edges: DataFrame, methods: DataFrame, starts: DataFrame, depth: int = 4, breadth: int = 5) -> DataFrame:
    """(start, node, caller, level, truncated): callers of callers, at each node the first ``breadth``: entry points, then others, tests last, then by key.

    ``edges`` go from caller to callee; ``methods`` has (node, is_entry, is_test).
    """
    info = methods.select(F.col("node").alias("caller"), F.coalesce("is_entry", F.lit(False)).alias("is_entry"), F.coalesce("is_test", F.lit(False)).alias("is_test"))
    calls = edges.select(F.col("dst").alias("node"), F.col("src").alias("caller")).distinct().join(info, "caller", "left").na.fill(False, ["is_entry", "is_test"])
    capped = cut(top_per_group(calls, ["node"], [F.desc("is_entry"), F.asc("is_test"), F.asc("caller")], breadth))
    front = cut(starts.select("start", F.col("start").alias("node"), F.array("start").alias("path")))
    out = None
    for level in range(1, depth + 1):
        step = front.join(capped, "node").where(~F.array_contains("path", F.col("caller")))
        step = cut(step.select("start", "node", "caller", F.lit(level).alias("level"), "truncated", F.concat("path", F.array("caller")).alias("path")))
        out = step if out is None else out.unionByName(step)
        if step.isEmpty():
            break
        front = step.select("start", F.col("caller").alias("node"), "path")
    return out.select("start", "node", "caller", "level", "truncated", "path")


def caller_tree(edges: DataFrame, starts: DataFrame, max_depth: int) -> DataFrame:
    """(start, node, caller, level, cycle, path): the whole tree of callers; a caller already on the path ends it and is marked."""
    back = edges.select(F.col("dst").alias("node"), F.col("src").alias("caller")).distinct()
    front = cut(starts.select("start", F.col("start").alias("node"), F.array("start").alias("path")))
    out = None
    for level in range(1, max_depth + 1):
        step = cut(front.join(back, "node").select("start", "node", "caller", F.lit(level).alias("level"), F.array_contains("path", F.col("caller")).alias("cycle"), F.concat("path", F.array("caller")).alias("path")))
        out = step if out is None else out.unionByName(step)
        front = step.where("not cycle").select("start", F.col("caller").alias("node"), "path")
        if front.isEmpty():
            break
    return out


def topological_levels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, level): nodes peeled off when nothing before them is left; members of cycles get null, to be appended last."""
    left = cut(nodes.select("node").distinct())
    edges = cut(edges.select("src", "dst").where("src <> dst").distinct())
    out, level = None, 0
    while True:
        held = edges.join(left.withColumnRenamed("node", "src"), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        free = cut(left.join(held, "node", "left_anti"))
        if free.isEmpty():
            rest = left.withColumn("level", F.lit(None).cast("int"))
            return rest if out is None else out.unionByName(rest)
        done = free.withColumn("level", F.lit(level))
        out = done if out is None else out.unionByName(done)
        left = cut(left.join(free, "node", "left_anti"))
        level += 1


def preorder(nodes: DataFrame, group: str) -> DataFrame:
    """(group, node, rank): walk order of each group's forest.

    ``nodes`` is (group, ord, node, parent) in file order; a node without a known parent is a root, children follow in file
    order, a node is visited once, and nodes that no root reaches (cycles) come last in file order. Of rows that share a node,
    each row links it to a parent, and the earliest visit counts.

    Groups whose nodes have one row each are forests and ranked along their tours; the others are walked level by level.
    """
    rows = cut(nodes.select(group, "ord", "node", "parent"))
    several = cut(rows.groupBy(group, "node").agg(F.count("*").alias("n")).where("n > 1").select(group).distinct())
    if several.isEmpty():
        return _toured(rows, group)
    return _toured(cut(rows.join(several, group, "left_anti")), group).unionByName(_walked(rows.join(several, group, "left_semi"), group))


def _toured(rows: DataFrame, group: str) -> DataFrame:
    """Walk order of forests by list ranking: the tour enters and leaves each node, goes on to the next sibling and back to the parent,
    and every step's distance to the end is found by pointer doubling, so a chain of n nodes takes log n rounds. Rings have no end."""
    known = rows.select(group, F.col("node").alias("parent"), F.lit(True).alias("has"))
    rows = rows.join(known, [group, "parent"], "left").withColumn("up", F.when(F.col("has") & ~F.col("parent").isin("", "0"), F.col("parent")))
    rows = cut(rows.withColumn("next", F.lead("node").over(Window.partitionBy(group, "up").orderBy("ord"))).select(group, "ord", "node", "up", "next"))
    first = rows.where("up is not null").groupBy(group, F.col("up").alias("node")).agg(F.min_by("node", "ord").alias("child"))
    enter = rows.join(first, [group, "node"], "left").select(group, "node", F.lit(False).alias("out"), F.coalesce("child", "node").alias("to"), F.col("child").isNull().alias("to_out"), F.lit(1).cast("long").alias("w"))
    leave = rows.select(group, "node", F.lit(True), F.coalesce("next", "up"), F.col("next").isNull(), F.lit(0).cast("long"))
    tour = cut(enter.union(leave))
    most = rows.groupBy(group).count().agg(F.max("count")).first()[0] or 0
    for _ in range((2 * most).bit_length()):
        far = tour.select(group, F.col("node").alias("to"), F.col("out").alias("to_out"), F.col("to").alias("far"), F.col("to_out").alias("far_out"), F.col("w").alias("more"))
        tour = cut(tour.join(far, [group, "to", "to_out"], "left").select(group, "node", "out", F.col("far").alias("to"), F.col("far_out").alias("to_out"), (F.col("w") + F.coalesce("more", F.lit(0))).alias("w")))
        if tour.where("to is not null").isEmpty():
            break
    left = tour.where("not out").select(group, "node", F.when(F.col("to").isNull(), F.col("w")).alias("left"))
    order = Window.partitionBy(group).orderBy(F.col("left").desc_nulls_last(), "ord")
    return rows.join(left, [group, "node"]).select(group, "node", F.row_number().over(order).alias("rank"))


def _walked(nodes: DataFrame, group: str) -> DataFrame:
    """Walk order where nodes have several rows: the least of the ways that lead to a node, level by level."""
    known = nodes.select(group, "node").distinct().withColumnsRenamed({"node": "parent"}).withColumn("has", F.lit(True))
    rows = nodes.join(known, [group, "parent"], "left").withColumn("root", F.coalesce(F.col("parent").isin("", "0"), F.lit(True)) | F.col("has").isNull())
    pad = F.lpad(F.col("ord").cast("string"), 10, "0")
    front = cut(rows.where("root").select(group, "node", F.array(pad).alias("at"), F.array("node").alias("path")))
    seen, links = front, cut(rows.where("not root").select(group, "node", F.col("parent").alias("up"), pad.alias("p")))
    while True:
        step = front.withColumnRenamed("node", "up").join(links, [group, "up"]).where(~F.array_contains("path", F.col("node")))
        front = cut(step.select(group, "node", F.concat("at", F.array("p")).alias("at"), F.concat("path", F.array("node")).alias("path")))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    reached = seen.groupBy(group, "node").agg(F.min("at").alias("at")).withColumn("late", F.lit(0))
    lost = nodes.join(reached, [group, "node"], "left_anti").groupBy(group, "node").agg(F.array(F.min(pad)).alias("at")).withColumn("late", F.lit(1))
    return reached.unionByName(lost).withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy("late", "at"))).select(group, "node", "rank")


def ancestors(parents: DataFrame, interfaces: DataFrame, classes: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(start, node, depth) over parents and interfaces alike, nearest first."""
    edges = parents.select(F.col("class").alias("src"), F.col("parent").alias("dst")).union(interfaces.select("class", "iface"))
    return closure(edges, classes.select(F.col("class").alias("start")), max_depth)


def nearest_member(lookups: DataFrame, members: DataFrame, parents: DataFrame, interfaces: DataFrame) -> DataFrame:
    """Where a class's member is defined: (class, member, args) to the nearest (owner, key), an arity match preferred, else the first overload.

    ``members`` has (owner, member, key, params).
    """
    up = ancestors(parents, interfaces, lookups.select("class").distinct()).select(F.col("start").alias("class"), F.col("node").alias("owner"), "depth")
    hits = lookups.join(up, "class").join(members, ["owner", "member"])
    w = Window.partitionBy("class", "member", "args").orderBy("depth", "owner", F.desc(F.coalesce(F.col("params") == F.col("args"), F.lit(False))), "key")
    return hits.withColumn("n", F.row_number().over(w)).where("n = 1").select("class", "member", "args", "owner", "key", "depth")


def implementations(parents: DataFrame, interfaces: DataFrame) -> DataFrame:
    """(iface, class): direct implementers, their subclasses, and both for every super-interface (``interfaces`` also links interfaces to those they extend)."""
    down = parents.select(F.col("parent").alias("src"), F.col("class").alias("dst"))
    direct = interfaces.select("iface", "class").distinct()
    below = closure(down, direct.select(F.col("class").alias("start")).distinct()).select(F.col("start").alias("class"), "node")
    own = direct.join(below, "class").select("iface", F.col("node").alias("class")).distinct()
    supers = closure(interfaces.select(F.col("class").alias("src"), F.col("iface").alias("dst")), direct.select(F.col("iface").alias("start")).distinct())
    lifted = own.join(supers.select(F.col("start").alias("iface"), "node"), "iface").select(F.col("node").alias("iface"), "class")
    return lifted.distinct()


def inherited_methods(parents: DataFrame, methods: DataFrame, max_depth: int = 20) -> DataFrame:
    """(class, owner, signature): what a class inherits, nearest definition first, less what it or a nearer ancestor overrides."""
    up = closure(parents.select(F.col("class").alias("src"), F.col("parent").alias("dst")), methods.select(F.col("class").alias("start")).distinct().union(parents.select("class")).distinct(), max_depth)
    seen = up.join(methods.select(F.col("class").alias("node"), "signature"), "node")
    w = Window.partitionBy("start", "signature").orderBy("depth", "node")
    return seen.withColumn("n", F.row_number().over(w)).where("n = 1 and depth > 0").select(F.col("start").alias("class"), F.col("node").alias("owner"), "signature")


def unresolved(edges: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """Calls that no method answers, of the wanted call types."""
    out = edges.where(~F.coalesce("resolved", F.lit(False)))
    return out.where(F.col("call_type").isin(*kinds)) if kinds else out


def graph_stats(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, rows) of each table."""
    out = None
    for name, df in sorted(tables.items()):
        one = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


