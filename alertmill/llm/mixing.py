"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern, the set of sources they belong to. Word capacity flows from the
patterns to source quotas; the second and later copies of a pattern's words cost more and more, so the flow
repeats as little as it can. Sources that no document links are separate flows: one flow is solved in one task for
each set of sources that overlaps link, a source alone being such a set too.
Within a pattern, seeded documents then carry what the flow allots to it.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertmill.llm.common import components, mix64, stage

WORD = r"[^\x20\x09-\x0D]+"
#: Documents that the last selection bin may hold; it is filled one document at a time.
BIN = 1024
#: Bits of the selection hash that one step narrows the last bin by, and all of them.
STEP, BITS = 10, 60
#: Seeded orders that the last bin is tried in; the one that leaves least is taken.
ORDERS = 16
#: Copies of equal rows that one task numbers.
COPIES = 1 << 16


def words_in(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def ranked(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` with ``rank`` from 0 on, by sorted ranges: the driver sees a count for each range only."""
    rows = stage(df.orderBy(*order).withColumn("mid", F.monotonically_increasing_id()), "ranked")
    counts = {r.part: r.c for r in rows.groupBy(F.shiftright("mid", 33).alias("part")).agg(F.count("*").alias("c")).collect()}
    ends, at = [], 0
    for part in sorted(counts):
        ends += [part, at]
        at += counts[part]
    before = F.create_map(*[F.lit(int(x)).cast("long") for x in ends]) if ends else F.create_map(F.lit(0).cast("long"), F.lit(0).cast("long"))
    return rows.withColumn("rank", before[F.shiftright("mid", 33)] + F.col("mid").bitwiseAND(F.lit((1 << 33) - 1))).drop("mid")


def targets_of(sources: DataFrame, weights: tuple[float, ...], most: float) -> DataFrame:
    """(source, size, target): 100 % of all sizes by weight; a target stops at ``most`` times its source's size and the excess is shared again.

    A share grows with every sharing, so a source is full if its weight times the last level is: each step is one aggregate.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights)).cast("int") + 1)
    rows = stage(ranked(sources, F.col("source").isNull(), F.col("source")).select("source", "size", w.alias("w")), "weights")
    total, level, full = float(rows.agg(F.sum("size")).first()[0] or 0), -1.0, -1
    while True:
        over = F.col("w") * F.lit(level) > F.lit(float(most)) * F.col("size")
        r = rows.agg(F.count_if(over).alias("n"), F.sum(F.when(~over, F.col("w"))).alias("w"), F.sum(F.when(over, F.lit(float(most)) * F.col("size"))).alias("gone")).first()
        if r.n == full or not r.w:
            return rows.select("source", "size", F.when(over | F.lit(not r.w), F.lit(float(most)) * F.col("size")).otherwise(F.col("w") * F.lit(level)).alias("target"))
        full, level = r.n, (total - (r.gone or 0.0)) / r.w


class Flow:
    """Successive shortest paths with potentials on integer capacities."""

    def __init__(self, n: int):
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []
        self.out: list[list[int]] = [[] for _ in range(n)]

    def arc(self, a: int, b: int, room: int, cost: int) -> int:
        self.out[a].append(len(self.to))
        self.to.append(b), self.room.append(room), self.cost.append(cost)
        self.out[b].append(len(self.to))
        self.to.append(a), self.room.append(0), self.cost.append(-cost)
        return len(self.to) - 2

    def send(self, s: int, t: int) -> int:
        n, total = len(self.out), 0
        lift = [0] * n
        while True:
            dist, via = [1 << 60] * n, [-1] * n
            dist[s], heap = 0, [(0, s)]
            while heap:
                d, u = heapq.heappop(heap)
                if d > dist[u]:
                    continue
                for e in self.out[u]:
                    v, nd = self.to[e], d + self.cost[e] + lift[u] - lift[self.to[e]]
                    if self.room[e] > 0 and nd < dist[v]:
                        dist[v], via[v] = nd, e
                        heapq.heappush(heap, (nd, v))
            if via[t] < 0:
                return total
            lift = [x + min(d, dist[t]) for x, d in zip(lift, dist)]
            # all paths of this length at once: a blocking flow over tight arcs, depth first
            pushed = self._block(s, t, lift)
            total += pushed

    def _block(self, s: int, t: int, lift: list[int]) -> int:
        total, at, dead = 0, [0] * len(self.out), [False] * len(self.out)
        while True:
            path, on, u = [], {s}, s
            while u != t:
                step = None
                while at[u] < len(self.out[u]):
                    e = self.out[u][at[u]]
                    v = self.to[e]
                    if self.room[e] > 0 and v not in on and not dead[v] and self.cost[e] + lift[u] - lift[v] == 0:
                        step = e
                        break
                    at[u] += 1
                if step is None:
                    if u == s:
                        return total
                    dead[u] = True
                    on.discard(u)
                    u = self.to[path.pop() ^ 1]
                    at[u] += 1
                    continue
                path.append(step)
                u = self.to[step]
                on.add(u)
            room = min(self.room[e] for e in path)
            for e in path:
                self.room[e] -= room
                self.room[e ^ 1] += room
            total += room


@dataclass(frozen=True)
class Mix:
    """What the flow decided: (source, size, target), (pattern, m, n, words, given), and (pattern, source, words)."""

    sources: DataFrame
    patterns: DataFrame
    flows: DataFrame


def route(patterns: list[tuple[str, list[str | None], int, int]], targets: dict[str | None, float], most: int) -> tuple[dict[str, int], dict]:
    """Min-cost flow from patterns (key, members, documents, words) to source quotas; copy number c costs c - 1 squared a word."""
    names = list(targets)
    place = {s: 2 + len(patterns) + i for i, s in enumerate(names)}
    net = Flow(2 + len(patterns) + len(names))
    into = {}
    for i, (key, members, _, words) in enumerate(patterns):
        for c in range(most):
            net.arc(0, 2 + i, words, c * c)
        for s in members:
            into[key, s] = net.arc(2 + i, place[s], most * words, 0)
    for s in names:
        net.arc(place[s], 1, round(targets[s]), 0)
    net.send(0, 1)
    flows = {k: net.room[e ^ 1] for k, e in into.items() if net.room[e ^ 1]}
    given = {key: 0 for key, *_ in patterns}
    for (key, _), n in flows.items():
        given[key] += n
    return given, flows


def pattern_key(members: Column) -> Column:
    """A text that tells any two sets of sources apart, null being a source too."""
    each = F.transform(F.array_sort(F.array_distinct(members)), lambda x: F.when(x.isNull(), "n").otherwise(F.concat(F.lit("s"), F.length(x).cast("string"), F.lit(":"), x)))
    return F.array_join(each, "")


def routed(patterns: DataFrame, sources: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """(pattern, given) and (pattern, source, words): the flow of each set of linked sources."""
    rows = patterns.select("pattern", "words", F.explode("m").alias("source"), F.size("m").alias("k")).withColumn("s", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))
    links = rows.where("k > 1")
    if links.isEmpty():
        held = rows.withColumn("component", F.col("s"))
    else:
        comps = components(links.select(F.concat(F.lit("p"), "pattern").alias("a"), F.col("s").alias("b")))
        held = rows.join(comps.withColumnRenamed("id", "s"), "s", "left").withColumn("component", F.coalesce("component", "s"))
    held = held.join(sources.select(F.col("source").alias("name"), "target"), F.col("source").eqNullSafe(F.col("name")))

    def solve(pdf):
        own = pdf.sort_values(["pattern", "s"])
        quota = {r.s: r.target for r in own.itertuples()}
        words = {r.pattern: r.words for r in own.itertuples()}
        members = own.groupby("pattern")["s"].agg(list)
        _, flows = route([(p, members[p], 0, int(words[p])) for p in sorted(words)], {k: quota[k] for k in sorted(quota)}, most)
        out = pd.DataFrame([(p, s, n) for (p, s), n in flows.items()], columns=["pattern", "s", "words"])
        return out.merge(own[["s", "source"]].drop_duplicates("s"), on="s")[["pattern", "source", "words"]]

    flows = stage(held.select("component", "pattern", "s", "source", "words", "target").groupBy("component").applyInPandas(solve, "pattern string, source string, words long"), "flows")
    return flows.groupBy("pattern").agg(F.sum("words").alias("given")), flows


def mix(docs: DataFrame, id_col: str, members: Column, size: Column, weights: tuple[float, ...] = (1, 2, 3), most: int = 3, seed: int = 7) -> tuple[DataFrame, Mix]:
    """Takes documents so that each source comes near its target.

    ``members`` is the array of a document's sources; a null or empty array is the null source alone. Sources by code
    point, null last, take ``weights`` in turn; targets share 100 % of all sizes (an overlapping document counts for each
    of its sources when their sizes are measured) and stop at ``most`` times their source's size. No document is
    taken more than ``most`` times.

    Returns (id, size, pattern, taken) and the plan. Selection hangs on the seed, the id and the size alone, so reruns
    agree; equal rows are separate documents and are numbered; a null id is an id; a null size is 0; an empty table gives
    an empty one.
    """
    own = F.when(members.isNull() | (F.size(members) == 0), F.array(F.lit(None).cast("string"))).otherwise(members)
    sized = stage(docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(size.cast("long"), F.lit(0)).alias("size"), own.alias("m")).select("id", "size", F.array_distinct("m").alias("m"), pattern_key(F.col("m")).alias("pattern")), "sized")
    patterns = stage(sized.groupBy("pattern").agg(F.first("m").alias("m"), F.count("*").alias("n"), F.sum("size").alias("words")), "patterns")
    by = patterns.select("words", F.explode("m").alias("source")).groupBy("source").agg(F.sum("words").alias("size"))
    sources = targets_of(by, weights, most)
    total, listed = patterns.agg(F.sum("words")).first()[0] or 0, sources.agg(F.sum("size")).first()[0] or 0
    if listed and listed != total:
        sources = sources.withColumn("target", F.col("target") * F.lit(total / listed))
    given, flows = routed(patterns, sources, most)
    plan = Mix(sources, patterns.join(given, "pattern", "left").na.fill(0, ["given"]), flows)
    return select(sized.select("id", "size", "pattern"), plan, seed, most), plan


def numbered(sized: DataFrame) -> DataFrame:
    """Every row with its number ``j`` among equal ones; copies are counted before they are dealt out again, many of them by many tasks."""
    counts = sized.groupBy(*sized.columns).agg(F.count("*").alias("c"))
    few = counts.where(F.col("c") <= COPIES).select(*sized.columns, F.explode(F.sequence(F.lit(1).cast("long"), "c")).alias("j"))
    blocks = counts.where(F.col("c") > COPIES).withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("c") - 1) / COPIES)))).repartition(*sized.columns, "b")
    many = blocks.select(*sized.columns, F.explode(F.sequence(F.col("b") * COPIES + 1, F.least("c", (F.col("b") + 1) * COPIES))).alias("j"))
    return few.unionByName(many)


def select(sized: DataFrame, plan: Mix, seed: int, most: int) -> DataFrame:
    """Whole rounds of a pattern first, then seeded documents up to what is left: those below a threshold of their hashes entirely, those of the threshold's bin by first fit, then by further copies of what still fits.

    The bin is found from the top bits down, a sum for each value of ``STEP`` bits at a time, until it is small. Where no
    documents fit exactly, the total is the nearer of what is below and above the target.
    """
    turns = F.when(F.col("words") > 0, F.floor(F.col("given") / F.col("words"))).otherwise(0).cast("long")
    rules = stage(plan.patterns.withColumn("rounds", turns).select("pattern", "n", "rounds", (F.col("given") - F.col("rounds") * F.col("words")).alias("rest")), "rules")
    dealt = stage(numbered(sized).join(rules.drop("n"), "pattern").select("id", "size", "pattern", "rounds", "rest", F.xxhash64(F.lit(seed), "id", "size", "j").alias("h")), "dealt")
    p = F.shiftrightunsigned("h", 64 - BITS)
    edge = stage(rules.where("rest > 0").select("pattern", F.lit(0).cast("long").alias("edge"), F.lit(BITS).alias("bits"), F.col("rest").alias("room"), F.col("n").alias("c")), "edges")
    large = (F.col("c") > BIN) & (F.col("bits") > 0)
    while not edge.where(large).isEmpty():
        inside = dealt.select("pattern", "size", p.alias("p")).join(edge.where(large).drop("c"), "pattern").where("shiftright(p, bits) = edge").withColumn("bits", F.col("bits") - STEP)
        sums = inside.groupBy("pattern", "room", "bits", F.expr("shiftright(p, bits)").alias("edge")).agg(F.sum("size").alias("s"), F.count("*").alias("c"))
        sums = sums.withColumn("upto", F.sum("s").over(Window.partitionBy("pattern").orderBy("edge")))  # 2**STEP rows a pattern
        narrow = sums.where("upto > room and upto - s <= room").select("pattern", "edge", "bits", (F.col("room") - F.col("upto") + F.col("s")).alias("room"), "c")
        edge = stage(edge.where(~large).unionByName(narrow), "edges")
    known = dealt.join(edge.drop("c"), "pattern", "left").withColumn("p", p)
    at = F.expr("shiftright(p, bits)")
    extra = F.when((F.col("rest") > 0) & (at < F.col("edge")), 1).otherwise(0)
    sure = known.where(F.col("edge").isNull() | (at != F.col("edge"))).select("id", "size", "pattern", (F.col("size") * (F.col("rounds") + extra)).alias("taken"))

    def fit(pdf):
        pdf = pdf.sort_values(["h", "id", "size"], kind="stable")
        sizes, h = pdf["size"].tolist(), pdf["h"].to_numpy()
        rounds = int(pdf["rounds"].iloc[0])
        best: tuple[int, list[int]] | None = None
        for trial in range(ORDERS):
            order = np.argsort(mix64(h.view(np.uint64) + np.uint64(trial)), kind="stable").tolist()
            room, extra = int(pdf["room"].iloc[0]), [0] * len(sizes)
            for copies in range(1, most - rounds + 1):
                for i in order:
                    if 0 < sizes[i] <= room and extra[i] == copies - 1:
                        extra[i] += 1
                        room -= sizes[i]
            # one more copy of the smallest that does not fit, if that comes nearer than stopping short
            over = min((i for i in order if sizes[i] > room and extra[i] < most - rounds), key=lambda i: sizes[i], default=None) if room else None
            if over is not None and sizes[over] - room < room:
                extra[over] += 1
                room = sizes[over] - room
            if best is None or room < best[0]:
                best = room, extra
            if not room:
                break
        pdf["taken"] = pdf["size"] * (pdf["rounds"] + best[1])
        return pdf[["id", "size", "pattern", "taken"]]

    last = known.where(at == F.col("edge")).select("id", "size", "pattern", "h", "rounds", "room").groupBy("pattern").applyInPandas(fit, "id long, size long, pattern string, taken long")
    return sure.unionByName(last)


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One source a document: (doc_id, size, source_size, target, taken, source)."""
    chosen, plan = mix(docs, id_col, F.array(F.col(source_col).cast("string")), words_in(text_col))
    named = plan.sources.select(pattern_key(F.array("source")).alias("pattern"), "source", F.col("size").alias("source_size"), "target")
    return chosen.join(named, "pattern").select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "source")


def op4_mixing(spark, sf_dir):
    return mixed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
