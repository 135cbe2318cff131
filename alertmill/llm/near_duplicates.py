"""N-gram Jaccard join: MinHash banding, then every pair verified on full n-gram sets.

Texts with equal n-gram sets are one item. Items that share a band hash are candidates; the connected components
of candidates hold every pair that banding finds, and inside a component all pairs are compared on their full
sets, in blocks. Links are counted where they are found, and only a spanning forest leaves each block, so no
group is expanded into its pairs and no link between different texts is lost.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertmill.llm.common import Bloom, arrow_map, buffer_of, components, lean, mix64, partitions, shared, stage, unstage, without
from alertmill.llm.repeats import LEAST, keyed, row_key
from alertmill.llm.scan import Rolling, word_hashes, words_of

#: Members of a component that one block holds, and grams that its members hold together; two blocks meet in a task.
BLOCK, BLOCK_GRAMS = 512, 2_000_000


def blocks(members: str, grams: str) -> Column:
    """How many blocks a component of so many members and grams makes."""
    return F.ceil(F.greatest(F.col(members) / F.lit(BLOCK), F.col(grams) / F.lit(BLOCK_GRAMS), F.lit(1.0))).cast("int")


def banding(threshold: float, recall: float, most: int = 128) -> tuple[int, int]:
    """Bands and rows that find a pair at the threshold with at least this probability: the most rows, so the fewest false candidates, that ``most`` hashes allow."""
    best = (math.ceil(math.log(1 - recall) / math.log(1 - threshold)) if threshold < 1 else 1, 1)
    for rows in range(2, most + 1):
        p = threshold**rows
        bands = 1 if p >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-p))
        if bands * rows <= most:
            best = (bands, rows)
    return best


def gram_sets(batch: pa.RecordBatch, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's ``n``-word runs, rows joined, and where each row's begin; a shorter text is one gram of all its words."""
    buf, offs = buffer_of(batch.column("text"))
    starts, ends, row = words_of(buf, offs)
    at = np.searchsorted(row, np.arange(len(offs)))
    count = np.diff(at)
    roll = Rolling(word_hashes(buf, starts, ends))
    grams = np.maximum(count - n + 1, 1)
    first = np.cumsum(grams) - grams
    which = np.repeat(np.arange(len(count)), grams)
    a = at[:-1][which] + np.arange(len(which)) - first[which]
    z = np.minimum(a + n, at[1:][which])
    return mix64(roll.runs(a, z) ^ (z - a).astype(np.uint64)), first


def functions(k: int) -> tuple[np.ndarray, np.ndarray]:
    x = mix64(np.arange(1, 2 * k + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return x[:k], x[k:] | np.uint64(1)


def signatures(rows: DataFrame, n: int, bands: int, per: int) -> DataFrame:
    """(id, k, place, size, bands): the hash ``k`` of each text's gram set, its row's place, the grams of the text and its band hashes."""

    def step(batch):
        h, first = gram_sets(batch, n)
        ids = batch.column("id").to_numpy(zero_copy_only=False)
        xor, mul = functions(bands * per)
        least = np.empty((bands * per, len(first)), dtype=np.uint64)
        for i in range(bands * per):
            least[i] = np.minimum.reduceat((h ^ xor[i]) * mul[i], first)
        keys = np.zeros((bands, len(first)), dtype=np.uint64)
        for i in range(bands * per):
            keys[i // per] = mix64(keys[i // per] ^ least[i]) + np.uint64(i)
        k = set_keys(h, first)
        flat = pa.array(keys.T.reshape(-1).view(np.int64))
        return {"id": ids, "k": k, "place": row_key(ids, k), "size": np.diff(np.append(first, len(h))), "bands": pa.ListArray.from_arrays(pa.array(np.arange(0, bands * len(first) + 1, bands, dtype=np.int32)), flat)}

    return arrow_map(rows, "id long, k long, place long, size long, bands array<long>", step, "text")


def set_keys(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row's set of grams."""
    ends = np.append(first[1:], len(h))
    return np.array([mix64(np.unique(h[a:z])).sum(dtype=np.uint64) for a, z in zip(first.tolist(), ends.tolist())], dtype=np.uint64).view(np.int64)


def full_sets(rows: DataFrame, n: int, sieve: Bloom) -> DataFrame:
    """(k, grams): the sorted gram hashes of the rows whose place may be in the sieve."""
    b = shared(rows.sparkSession, sieve)

    def step(batch):
        h, first = gram_sets(batch, n)
        k = set_keys(h, first)
        ids = batch.column("id").to_numpy(zero_copy_only=False)
        keep = np.flatnonzero(b.value.has(row_key(ids, k)))
        ends = np.append(first[1:], len(h))
        return {"k": k[keep], "grams": pa.array([np.unique(h[first[i] : ends[i]]).tobytes() for i in keep], pa.binary())}

    return arrow_map(rows, "k long, grams binary", step, "text")


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every set in ``a`` with every set in ``b``."""
    la, lb = np.repeat(np.arange(len(a)), [len(x) for x in a]), np.repeat(np.arange(len(b)), [len(x) for x in b])
    values, code = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    ca, cb = code[: len(la)], code[len(la) :]
    both = np.zeros(len(values), dtype=bool)
    both[np.intersect1d(ca, cb)] = True
    renamed = np.cumsum(both) - 1
    width, out = int(both.sum()), np.zeros((len(a), len(b)), dtype=np.float32)
    la, ca = la[both[ca]], renamed[ca[both[ca]]]
    lb, cb = lb[both[cb]], renamed[cb[both[cb]]]
    for lo in range(0, width, 8192):
        w = min(8192, width - lo)
        x, y = np.zeros((len(a), w), np.float32), np.zeros((len(b), w), np.float32)
        sa, sb = (ca >= lo) & (ca < lo + w), (cb >= lo) & (cb < lo + w)
        x[la[sa], ca[sa] - lo] = 1
        y[lb[sb], cb[sb] - lo] = 1
        out += x @ y.T
    return out


def forest(linked: np.ndarray, keys: np.ndarray) -> list[tuple[int, int]]:
    """Edges from each member to the least key of its component, over a symmetric matrix of links."""
    seen, out = np.zeros(len(keys), dtype=bool), []
    for i in range(len(keys)):
        if seen[i]:
            continue
        seen[i], part, todo = True, [i], [i]
        while todo:
            near = np.flatnonzero(linked[todo.pop()] & ~seen)
            seen[near] = True
            part += near.tolist()
            todo += near.tolist()
        least = min(keys[j] for j in part)
        out += [(keys[j], least) for j in part if keys[j] != least]
    return out


def in_blocks(members: DataFrame) -> DataFrame:
    """Members (comp, k, w, grams, n_blocks), each once for every pair of blocks (bi, bj) that its block ``b`` is in."""
    n = F.col("n_blocks")
    dealt = members.withColumn("b", F.pmod(F.xxhash64("k"), n).cast("int")).withColumn("x", F.explode(F.sequence(F.lit(0), n - 1)))
    return dealt.select("comp", "k", "w", "grams", F.least("b", "x").alias("bi"), F.greatest("b", "x").alias("bj"), "b")


def verified(members: DataFrame, threshold: float, decode=lambda many: [np.frombuffer(x, dtype=np.uint64) for x in many], count: bool = True) -> DataFrame:
    """(k, links, to), ``decode`` giving the sorted gram hashes of a list of ``grams``, from members (comp, k, w, grams, bi, bj, b): the weight of the links found for ``k``, or an edge of a block's spanning forest; without ``count`` edges alone."""

    schema = pa.schema([("k", pa.int64()), ("links", pa.int64()), ("to", pa.int64())])

    def pair(out, keys, w, sets):
        inter = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        if inter < threshold * (len(sets[0]) + len(sets[1]) - inter) - 1e-6:
            return
        low, high = (0, 1) if keys[0] < keys[1] else (1, 0)
        out += [(keys[low], w[high], None)] * count + [(keys[high], w[low], keys[low])]

    def check(out, rows):
        """One block with itself, or two blocks; every key once, though a sieve may let a row through twice."""
        rows = list({r[0]: r for r in rows}.values())
        keys, w, sets = [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]
        same = rows[0][3] == rows[0][4]
        ia = np.array([i for i, r in enumerate(rows) if r[5] == r[3]], dtype=np.int64)
        ib = ia if same else np.array([i for i, r in enumerate(rows) if r[5] != r[3]], dtype=np.int64)
        if not len(ia) or not len(ib) or len(rows) < 2:
            return
        if len(rows) == 2:
            return pair(out, keys, w, sets)
        size, w = np.array([len(x) for x in sets], dtype=np.float64), np.array(w, dtype=np.int64)
        inter = overlaps([sets[i] for i in ia], [sets[i] for i in ib])
        near = inter >= threshold * (size[ia][:, None] + size[ib][None, :] - inter) - 1e-6
        if same:
            np.fill_diagonal(near, False)
        links = np.zeros(len(keys), dtype=np.int64)
        np.add.at(links, ia, near @ w[ib])
        if not same:
            np.add.at(links, ib, near.T @ w[ia])
        square = np.zeros((len(keys), len(keys)), dtype=bool)
        square[np.ix_(ia, ib)] = near
        if count:
            out += [(k, int(n), None) for k, n in zip(keys, links) if n]
        out += [(a, 0, b) for a, b in forest(square | square.T, keys)]

    def run(batches):
        held, at, out = [], None, []
        emit = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
        for batch in batches:
            k, w, grams, *rest = (batch.column(c).to_pylist() for c in ("k", "w", "grams", "bi", "bj", "b", "comp"))
            for r in zip(k, w, decode(grams), *rest):
                key = (r[6], r[3], r[4])
                if key != at and held:
                    check(out, held)
                    held = []
                at = key
                held.append(r)
            if out:
                yield emit(out)
                out = []
        if held:
            check(out, held)
        if out:
            yield emit(out)

    spark = members.sparkSession
    dealt = members.select("k", "w", "grams", "bi", "bj", "b", "comp").repartition(partitions(spark), "comp", "bi", "bj").sortWithinPartitions("comp", "bi", "bj")
    return dealt.mapInArrow(lean(run), "k long, links long, to long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: float = 0.8, recall: float = 0.9995) -> DataFrame:
    """One row a document: (id, class_id, n_links).

    Two documents are linked where the Jaccard similarity of their sets of ``n``-word runs is at least ``threshold``;
    ``n_links`` counts the other documents linked to it, copies included, and ``class_id`` is the least id that it
    reaches over links. Bands and rows are chosen so that a pair at the threshold meets with probability ``recall``.

    Words are ``[^\\x20\\x09-\\x0D]+`` as they stand. A null text is empty; texts without words are equal to one another;
    a text of fewer than ``n`` words is one run. Repeated rows are documents of their own; a null id sorts first; an empty
    table gives an empty one.
    """
    rows = keyed(docs, id_col, text_col)
    bands, per = banding(threshold, recall)
    seen = stage(signatures(rows, n, bands, per), "signatures")
    items = stage(seen.groupBy("k").agg(F.count("*").alias("w"), F.min("place").alias("place"), F.min("size").alias("size"), F.min("id").alias("id")), "items")
    one = seen.join(items.select("place", "k"), ["k", "place"], "left_semi").select("k", F.posexplode("bands").alias("band", "key")).distinct()
    held = stage(one, "bands")
    star = held.groupBy("band", "key").agg(F.min("k").alias("head"), F.count("*").alias("c")).where("c > 1")
    edges = stage(held.join(star, ["band", "key"]).where("k <> head").select(F.col("k").alias("a"), F.col("head").alias("b")).distinct(), "candidates")
    unstage(held)
    comps = components(edges)
    unstage(edges)
    held_by = comps.withColumnRenamed("id", "k").join(items.drop("id"), "k")
    sizes = held_by.groupBy("component").agg(F.count("*").alias("m"), F.sum("size").alias("grams")).select("component", blocks("m", "grams").alias("n_blocks"))
    placed = stage(held_by.join(sizes, "component").select(F.col("component").alias("comp"), "k", "w", "place", "n_blocks"), "members")
    sets = full_sets(rows, n, Bloom.of(placed, "place")).dropDuplicates(["k"])
    dealt = in_blocks(sets.join(placed, "k"))
    found = stage(verified(dealt, threshold), "links")
    classes = components(found.where("to is not null").select(F.col("k").alias("a"), F.col("to").alias("b")))
    links = found.groupBy("k").agg(F.sum("links").alias("links"))
    named = items.join(links, "k", "left").join(classes.withColumnRenamed("id", "k"), "k", "left").select("k", "w", "id", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "k").alias("component"))
    heads = named.groupBy("component").agg(F.min("id").alias("class_id"))
    known = stage(named.join(heads, "component").select("k", "class_id", (F.col("links") + F.col("w") - 1).alias("n_links")), "classes")
    unstage(items, placed, found)
    null = lambda c: F.when(F.col(c) != LEAST, F.col(c))
    return seen.select("id", "k").join(known, "k").select(null("id").alias(id_col), null("class_id").alias("class_id"), "n_links")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each class: the one with the least id; of rows that repeat it, one."""
    found = stage(near_duplicates(docs, id_col, text_col).select(F.coalesce(F.col(id_col), F.lit(LEAST).cast("long")).alias("id"), F.coalesce("class_id", F.lit(LEAST).cast("long")).alias("class_id")), "near")
    heads = found.where("id = class_id").groupBy("id").agg(F.count("*").alias("c")).where("c > 1").select("id", F.lit(True).alias("once"))
    return without(docs, id_col, found.where("id <> class_id").select("id", F.lit(False).alias("once")).distinct().unionByName(heads))


def op7_jaccard_join(spark, sf_dir):
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP7_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(ws[k:k + 4], ' ') AS s FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 4, 1))) AS k FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE c >= 0.8 * (a.n + b.n - c) - 1e-9),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
d AS (SELECT x, count(*) AS n FROM l GROUP BY x)
SELECT r.x AS doc_id, min(r.y) AS class_id, coalesce(any_value(d.n), 0) AS n_links FROM r LEFT JOIN d ON d.x = r.x GROUP BY r.x
"""
