"""Hard negatives by ball-tree branch and bound over whole-number inner products.

Rows are dealt to blocks of bounded size, each packed with its ball tree; blocks of anchors meet the blocks that can hold
their partners. In a block a node's centre and radius bound every inner product below it from above and below: nodes outside
the score window go, then leaves are read best bound first, and those strictly beneath the current kth score are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertmill.llm.common import stage, unstage
from alertmill.llm.whitening import valid, with_dimension

#: Rows of a block, rows of a leaf, and anchors that meet a block together.
BLOCK_ROWS, LEAF_ROWS, ANCHOR_ROWS = 4096, 64, 1024
#: Entries from which inner products may pass a long.
MOST = 1 << 27
#: Leaves that a round reads for each query, before it compares the rest with the scores found.
ROUNDS = (1, 3, 1 << 30)
PACKED = "rows array<long>, ids array<long>, labels array<long>, v array<long>, centers array<double>, radii array<double>"


# -- the tree of a block


def levels_of(n: int) -> list[np.ndarray]:
    """The bounds of the nodes on each level, from the root down: halves of halves until leaves are small."""
    out = [np.array([0, n])]
    while (np.diff(out[-1])).max() > LEAF_ROWS:
        last = out[-1]
        out.append(np.sort(np.concatenate([last, (last[:-1] + last[1:]) // 2])))
    return out


def ball_tree(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order of the rows in which each node is a slice, and the centre and radius of every node, level by level.

    A node is split at the median along the line between two rows that lie far apart.
    """
    order, levels, x = np.arange(len(v)), levels_of(len(v)), v.astype(np.float64)
    for bounds in levels[:-1]:
        for a, b in zip(bounds[:-1], bounds[1:]):
            own = x[order[a:b]]
            one = own[np.argmax(((own - own.mean(0)) ** 2).sum(1))]
            two = own[np.argmax(((own - one) ** 2).sum(1))]
            order[a:b] = order[a:b][np.argpartition(own @ (two - one), (b - a) // 2)]
    x = x[order]
    slices = [(a, b) for bounds in levels for a, b in zip(bounds[:-1], bounds[1:])]
    centers = np.array([x[a:b].mean(0) for a, b in slices])
    radii = np.array([np.sqrt(((x[a:b] - c) ** 2).sum(1).max()) for (a, b), c in zip(slices, centers)])
    return order, centers, radii


class Block:
    """A packed block, a row of a batch: rows in tree order, ready to be searched."""

    def __init__(self, batch: pa.RecordBatch, i: int, d: int):
        part = {c: batch.column(c)[i].values for c in ("rows", "ids", "labels", "v", "centers", "radii")}
        self.ids = part.pop("ids")
        self.order = self.ids.fill_null(np.iinfo(np.int64).max).to_numpy()
        self.rows, self.labels, v, centers, self.radii = (x.to_numpy() for x in part.values())
        self.v, self.centers = v.reshape(-1, d), centers.reshape(-1, d)
        self.levels = levels_of(len(self.v))

    def search(self, q: np.ndarray, k: int, least: np.ndarray, most: np.ndarray, fits) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row of the block, score): for each query its first ``k`` rows (higher scores first, then smaller ids, nulls
        last, then rows) among those with ``least <= score <= most`` that ``fits(queries, slice)`` allows."""
        big = max(1, int(np.abs(q).max(initial=0))) * max(1, int(np.abs(self.v).max(initial=0))) * q.shape[1]
        kind = np.float64 if big < 1 << 52 else np.int64  # doubles hold such sums exactly
        low = -np.inf if kind is np.float64 else np.iinfo(np.int64).min
        exact, points, least, most = q.astype(kind), self.v.astype(kind), least.astype(kind), most.astype(kind)
        real = q.astype(np.float64)
        size = np.sqrt((real**2).sum(1))[:, None]
        alive, first = np.ones((len(q), 1), bool), 0
        for bounds in self.levels:
            nodes = slice(first, first + len(bounds) - 1)
            first = nodes.stop
            c, r = self.centers[nodes], self.radii[nodes]
            mid, slack = real @ c.T, size * (r + 1e-9 * (r + np.sqrt((c**2).sum(1)))) + 1e-6
            if alive.shape[1] != len(r):
                alive = np.repeat(alive, 2, axis=1)
            upper = mid + slack
            alive &= (upper >= least[:, None]) & (mid - slack <= most[:, None])
        leaf_bounds, kth = self.levels[-1], np.full(len(q), low, kind)
        turn = np.argsort(np.argsort(np.where(alive, -upper, np.inf), axis=1, kind="stable"), axis=1)
        found, at = [np.zeros(0, np.int64)] * 2 + [np.zeros(0, kind)], 0
        for many in ROUNDS:
            now = alive & (turn >= at) & (turn < at + many) & (upper >= kth[:, None])
            at += many
            parts = [found]
            for leaf in np.flatnonzero(now.any(0)):
                who, own = np.flatnonzero(now[:, leaf]), slice(leaf_bounds[leaf], leaf_bounds[leaf + 1])
                s = exact[who] @ points[own].T
                good = fits(who, own) & (s >= np.maximum(least, kth)[who, None]) & (s <= most[who, None])
                if s.shape[1] > k:
                    s_good = np.where(good, s, low)
                    good &= s >= np.partition(s_good, -k, axis=1)[:, -k, None]
                i, j = np.nonzero(good)
                parts.append([who[i], j + own.start, s[i, j]])
            found = self._first([np.concatenate(x) for x in zip(*parts)], k)
            counts = np.bincount(found[0], minlength=len(q))
            full = np.flatnonzero(counts >= k)
            kth[full] = found[2][np.cumsum(counts)[full] - 1]
        return found[0], found[1], found[2].astype(np.int64)

    def _first(self, found: list[np.ndarray], k: int) -> list[np.ndarray]:
        by = np.lexsort((self.rows[found[1]], self.order[found[1]], -found[2], found[0]))
        q, rows, s = (x[by] for x in found)
        start = np.flatnonzero(np.append(True, q[1:] != q[:-1])[: len(q)])
        rank = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q))))
        return [x[rank < k] for x in (q, rows, s)]


# -- blocks and their pairs


def packed(rows: DataFrame, by: list[str], d: int) -> DataFrame:
    """One row for each group of ``by`` (row, id, label, v): a group is a block, and its size is bounded by how rows are dealt."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(f"{c} {kinds[c]}" for c in by) + ", " + PACKED

    def pack(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("row")
        v = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
        order, centers, radii = ball_tree(v)
        lists = {"rows": table.column("row").to_numpy()[order], "ids": table.column("id").combine_chunks().take(pa.array(order)), "labels": table.column("label").to_numpy()[order], "v": v[order].ravel(), "centers": centers.ravel(), "radii": radii}
        one = lambda x, kind: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x if isinstance(x, pa.Array) else pa.array(x, kind))
        return pa.table({**{c: table.column(c).slice(0, 1) for c in by}, **{c: one(x, pa.float64() if c in ("centers", "radii") else pa.int64()) for c, x in lists.items()}})

    return rows.groupBy(*by).applyInArrow(pack, schema)


def dealt(rows: DataFrame) -> DataFrame:
    """``rows`` with ``home``, which rows of one label share, and ``part``: labels of more than a block are dealt over parts, small ones
    share homes. ``anchor_parts`` is the number of parts that the anchors of a home fill."""
    counts = rows.groupBy("label").agg(F.count("*").alias("n"), F.sum(F.col("anchor").cast("long")).alias("a"))
    homes = F.ceil(F.lit(counts.agg(F.sum("n")).collect()[0][0] or 1) / BLOCK_ROWS)
    big = F.col("n") > BLOCK_ROWS
    counts = counts.select("label", "n", "a", F.when(big, F.concat(F.lit("label "), F.col("label").cast("string"))).otherwise(F.concat(F.lit("home "), F.pmod(F.xxhash64("label"), homes).cast("string"))).alias("home"))
    parts = counts.groupBy("home").agg(F.ceil(F.sum("n") / BLOCK_ROWS).alias("parts"), F.ceil(F.sum("a") / ANCHOR_ROWS).alias("anchor_parts"))
    spread = F.xxhash64("row", F.lit(1))
    return rows.join(counts.select("label", "home").join(parts, "home"), "label").withColumn("part", F.pmod(spread, "parts")).withColumn("anchor_part", F.when(F.col("anchor"), F.pmod(spread, "anchor_parts")))


def joined(blocks: DataFrame, anchors: DataFrame, on: list[str]) -> DataFrame:
    """Each block beside each block of anchors that it must meet (a_-columns)."""
    return blocks.join(anchors.select(*on, *[F.col(c).alias(f"a_{c}") for c in anchors.columns if c not in on]), on)


def first_rows(found: DataFrame, by: list[str], k: int) -> DataFrame:
    """The first ``k`` of each query's finds over all blocks; Spark cuts each partition's to ``k`` before the shuffle."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def positives_of(rows: DataFrame, d: int, k: int) -> DataFrame:
    """(a_row, rank, row, id, score): the first ``k`` other rows of each anchor's label."""
    home = dealt(rows)
    blocks = stage(packed(home.select("home", "part", "anchor_parts", "row", "id", "label", "v"), ["home", "part", "anchor_parts"], d), "negatives-blocks")
    anchors = stage(packed(home.where("anchor").select("home", "anchor_part", "row", "id", "label", "v"), ["home", "anchor_part"], d), "negatives-anchors")
    pairs = joined(blocks.where("anchor_parts > 0").withColumn("anchor_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("anchor_parts") - 1))), anchors, ["home", "anchor_part"])

    def run(batches):
        for batch in batches:
            for n in range(batch.num_rows):
                block = Block(batch, n, d)
                own, label, v = (batch.column(c)[n].values.to_numpy() for c in ("a_rows", "a_labels", "a_v"))
                q = v.reshape(-1, d)
                free = np.full(len(q), np.iinfo(np.int64).max)
                who, at, score = block.search(q, k, -free, free, lambda w, s: (label[w, None] == block.labels[None, s]) & (own[w, None] != block.rows[None, s]))
                yield pa.RecordBatch.from_arrays([pa.array(own[who]), pa.array(block.rows[at]), block.ids.take(pa.array(at)), pa.array(score)], names=["a_row", "row", "id", "score"])

    found = pairs.mapInArrow(run, "a_row long, row long, id long, score long")
    out = stage(first_rows(found, ["a_row"], k), "negatives-positives")
    unstage(blocks, anchors)
    return out


def mine(vectors: DataFrame, anchor: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "v", positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): hard negatives for each anchor and positive.

    ``vector_col`` holds whole numbers, the score of a row is its inner product with the anchor. The positives of an anchor are
    its first ``positives`` other rows of its label; the negatives of both are the first ``negatives`` rows of other labels with
    low * positive_score <= 100 * score <= high * positive_score. Higher scores come first, then smaller ids (null last).

    Rows without a label or a vector, with a null entry, an entry of 2**27 or more (its products pass a long), or another length than
    most vectors take no part. ``anchor`` is a condition on the columns; where it is null the row is none. Ids may be null or
    repeated: every row counts for itself. Where nothing fits, and for an empty table, there are no rows. Columns of other names
    are ignored.
    """
    cols = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"), F.col(f"`{vector_col}`").cast("array<long>").alias("v"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    numbered = stage(cols.where(F.col("label").isNotNull()).where(valid("v", MOST)).where("size(v) > 0").withColumn("row", F.monotonically_increasing_id()), "negatives-rows")
    rows, d = with_dimension(numbered, "v")
    best = positives_of(rows, d, positives)

    wanted = best.groupBy(F.col("a_row").alias("row")).agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("p"))
    asked = rows.where("anchor").join(wanted, "row")
    fragments = max(1, -(-asked.count() // ANCHOR_ROWS))
    n_blocks = max(1, -(-rows.count() // BLOCK_ROWS))
    asked = stage(asked.withColumn("fragment", F.pmod(F.xxhash64("row", F.lit(2)), F.lit(fragments))).groupBy("fragment").agg(F.collect_list(F.struct("row", "id", "label", "v", "p")).alias("anchors")), "negatives-asked")
    blocks = stage(packed(rows.withColumn("part", F.pmod(F.xxhash64("row", F.lit(3)), F.lit(n_blocks))).select("part", "row", "id", "label", "v"), ["part"], d), "negatives-blocks")
    unstage(numbered, best)
    pairs = blocks.withColumn("fragment", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(fragments - 1).cast("long")))).join(asked, "fragment")

    def run(batches):
        for batch in batches:
            for n in range(batch.num_rows):
                block, ask = Block(batch, n, d), batch.column("anchors")[n].values
                p = ask.field("p")
                of = np.repeat(np.arange(len(ask)), p.value_lengths().to_numpy())  # the anchor of each anchor and positive
                p = p.flatten()
                base = p.field("score").to_numpy()
                least, most = -(-low * base // 100), high * base // 100
                open_ = np.flatnonzero(least <= most)
                of, p, least, most = of[open_], p.take(pa.array(open_)), least[open_], most[open_]
                label = ask.field("label").to_numpy()[of]
                who, at, score = block.search(ask.field("v").flatten().to_numpy().reshape(-1, d)[of], negatives, least, most, lambda w, s: label[w, None] != block.labels[None, s])
                whose, which = pa.array(of[who]), p.take(pa.array(who))
                yield pa.RecordBatch.from_arrays(
                    [ask.field("row").take(whose), ask.field("id").take(whose), which.field("rank"), which.field("id"), which.field("score"), pa.array(block.rows[at]), block.ids.take(pa.array(at)), pa.array(score)],
                    names=["a_row", "anchor_id", "p_rank", "positive_id", "positive_score", "row", "id", "score"],
                )

    found = pairs.mapInArrow(run, "a_row long, anchor_id long, p_rank int, positive_id long, positive_score long, row long, id long, score long")
    out = first_rows(found, ["a_row", "p_rank"], negatives)
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_hard_negatives(spark, sf_dir):
    """All of ``embeddings``; anchors are the rows whose id is divisible by 50."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("label is not null").where(valid("embedding", MOST / 256))
    shifted = F.when(F.coalesce(F.col("vec_id") % 7 == 0, F.lit(False)), (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = F.transform(F.col("embedding").cast("array<double>"), lambda c: F.floor(c * F.lit(256.0)).cast("long"))
    return mine(rows.select("vec_id", shifted.alias("label"), whole.alias("v")), F.col("vec_id") % 50 == 0)


OP11_SQL = """
with rows as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda c: cast(floor(256 * cast(c as double)) as bigint)) as v
  from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
scored as (
  select a.vec_id as anchor_id, a.label as anchor_label, b.vec_id, b.label,
         cast(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) as bigint) as score
  from rows a cross join rows b where a.vec_id % 50 = 0 and b.vec_id <> a.vec_id),
positives as (
  select anchor_id, vec_id as positive_id, score as positive_score from scored where label = anchor_label
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
ranked as (
  select p.anchor_id, p.positive_id, s.vec_id as negative_id, p.positive_score, s.score as negative_score,
         row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.vec_id) as rank
  from positives p join scored s on s.anchor_id = p.anchor_id and s.label <> s.anchor_label
  where 50 * p.positive_score <= 100 * s.score and 100 * s.score <= 95 * p.positive_score)
select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, positive_score, negative_score from ranked where rank <= 3
"""
