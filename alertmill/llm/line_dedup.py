"""Fuzzy line dedup: character-shingle MinHash, banding, exact Jaccard, union-find, one line kept per component.

A line is named by its place: its document's id, ``h`` and its number ``at`` there; ``h`` is a 64-bit hash of the text where
an id has several rows, and 0 where it has one. Equal
lines (by xxh3-128) meet first, and only the first place of each goes on as a vertex: signatures, buckets, exact
comparison and union-find all work on distinct lines. Places are ordered, so the label of a component is the line
that stays, and every other place goes without another join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertmill.llm.common import Bloom, arrow_map, buffer_of, components, lean, mix64, partitions, session, shared, stage, unstage
from alertmill.llm.near_duplicates import banding, blocks, forest, functions, overlaps
from alertmill.llm.repeats import LEAST, row_key
from alertmill.llm.scan import SPACE, Rolling

#: Characters in a shingle.
GRAM = 5
#: Hashes in a signature at most.
HASHES = 120
PLACE = ["id", "h", "at"]

_UNIT = mix64(np.arange(1, 257, dtype=np.uint64))


def texts_of(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """(id, h, text) and more columns: a null id is the least one, a null text empty; ``h`` hashes the whole text."""
    session(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LEAST).cast("long")).alias("id"), F.xxhash64(text).alias("h"), text.alias("text"), *more)


def repeated_ids(rows: DataFrame) -> tuple[Bloom, bool]:
    """A sieve of the ids that more than one row has, and whether there are any; of the others the hash is not needed, and a 0 in its place takes no room."""
    again = rows.groupBy("id").agg(F.count("*").alias("c")).where("c > 1").select(F.xxhash64("id").alias("k"))
    n = again.count()
    return Bloom.of(again if n else again.limit(0), "k", n), n > 0


def hashes_of(batch: pa.RecordBatch, several: Bloom) -> np.ndarray:
    ids, h = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("id", "h"))
    return np.where(several.has(row_key(ids)), h, 0)


def lines_of(batch: pa.RecordBatch, several: Bloom) -> dict:
    """The lines with ink of each text: row, place (``id``, ``h``, ``at``), first and last byte."""
    buf, offs = buffer_of(batch.column("text"))
    cuts = np.flatnonzero(buf == 10)
    starts = np.sort(np.concatenate([offs[:-1], cuts + 1]), kind="stable")
    ends = np.sort(np.concatenate([offs[1:], cuts]), kind="stable")
    row = np.sort(np.concatenate([np.arange(len(offs) - 1), np.searchsorted(offs, cuts, side="right") - 1]), kind="stable")
    ink = np.zeros(len(buf) + 1, dtype=np.int32)
    np.cumsum(~SPACE[buf], dtype=np.int32, out=ink[1:])
    number = np.arange(len(row)) - np.searchsorted(row, row)
    full = ink[ends] > ink[starts]
    row, ids = row[full], batch.column("id").to_numpy(zero_copy_only=False)
    return {"buf": buf, "id": ids[row], "h": hashes_of(batch, several)[row], "at": number[full].astype(np.int64), "start": starts[full], "end": ends[full]}


def of_lines(x: dict, keep: np.ndarray) -> dict:
    """Some of the lines, in their order."""
    return {k: v if k == "buf" else v[keep] for k, v in x.items()}


def _characters(x: dict) -> tuple[np.ndarray | None, np.ndarray, np.ndarray]:
    """Where characters begin (None where every byte is one), and each line's first and last character."""
    lead = (x["buf"] & 0xC0) != 0x80
    if lead.all():
        return None, x["start"], x["end"]
    place = np.zeros(len(lead) + 1, dtype=np.int64)
    np.cumsum(lead, out=place[1:])
    return np.append(np.flatnonzero(lead), len(lead)), place[x["start"]], place[x["end"]]


def minima(x: dict, hashes: int) -> np.ndarray:
    """MinHash values (hash, line) of each line's set of ``GRAM``-character runs; a shorter line is one run."""
    at, a, z = _characters(x)
    roll = Rolling(_UNIT[x["buf"]])
    sums, inv = roll.sums, roll.inv
    n = max(0, (len(sums) if at is None else len(at)) - GRAM)
    h = (sums[GRAM:] - sums[:n]) * inv[:n] if at is None else (sums[at[GRAM:]] - sums[at[:n]]) * inv[at[:n]]
    h = ((h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53) >> np.uint64(32)).astype(np.uint32)
    short = np.flatnonzero(z - a < GRAM)
    own = (mix64(roll.runs(x["start"][short], x["end"][short])) >> np.uint64(32)).astype(np.uint32)
    long = np.flatnonzero(z - a >= GRAM)
    # the runs inside lines, side by side; those that reach over a line's end go
    edge = np.zeros(n + 1, dtype=np.int8)
    edge[a[long]] += 1
    edge[z[long] - GRAM + 1] -= 1
    h = h[np.cumsum(edge[:n], dtype=np.int8).view(bool)]
    count = (z - a - GRAM + 1)[long]
    first = np.cumsum(count) - count
    mul = (functions(hashes)[1] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    out, v = np.empty((hashes, len(a)), dtype=np.uint32), np.empty_like(h)
    for i in range(hashes):
        np.multiply(h, mul[i], out=v)
        if len(first):
            out[i, long] = np.minimum.reduceat(v, first)
        out[i, short] = own * mul[i]
    return out


def shingle_sets(lines: list[bytes]) -> list[np.ndarray]:
    """Sorted hashes of each line's distinct ``GRAM``-character runs."""
    buf = np.frombuffer(b"".join(lines), dtype=np.uint8)
    cuts = np.append(0, np.cumsum([len(x) for x in lines]))
    at = np.append(np.flatnonzero((buf & 0xC0) != 0x80), len(buf))
    first = np.searchsorted(at, cuts)
    roll, out = Rolling(_UNIT[buf]), []
    whole = roll.runs(at[:-GRAM], at[GRAM:]) if len(at) > GRAM else np.zeros(0, np.uint64)
    for a, z in zip(first[:-1].tolist(), first[1:].tolist()):
        out.append(np.unique(whole[a : z - GRAM + 1]) if z - a >= GRAM else roll.runs(at[[a]], at[[z]]))
    return out


def shared_with_first(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of the first of some sorted sets with each of the others."""
    rest, first = np.concatenate(sets[1:]), sets[0]
    at = np.minimum(np.searchsorted(first, rest), len(first) - 1)
    return np.add.reduceat((first[at] == rest).astype(np.int64), np.append(0, np.cumsum([len(x) for x in sets[1:-1]], dtype=np.int64)))


SKETCH = ["s0", "s1"]


def sketches(least: np.ndarray) -> dict[str, np.ndarray]:
    """Two bits of each of the first MinHash values, 32 values to a long: what two lines share of them tells how similar they are."""
    out = {}
    for i, name in enumerate(SKETCH):
        word = np.zeros(least.shape[1], dtype=np.uint64)
        for j, v in enumerate(least[32 * i : 32 * i + 32]):
            word |= ((v * np.uint32(0x9E3779B1)) >> np.uint32(30)).astype(np.uint64) << np.uint64(2 * j)
        out[name] = word.view(np.int64)
    return out


def farthest(hashes: int, threshold: float) -> int:
    """Differences beyond which a pair at the threshold lies with a probability under one in ten thousand."""
    p = (1 - threshold) * 0.75
    n = min(hashes, 32 * len(SKETCH))
    return int(n * p + 3.8 * (n * p * (1 - p)) ** 0.5) + 1


def occurrences(rows: DataFrame, several) -> DataFrame:
    """(id, h, at, hi, lo): every line with ink and the two halves of the xxh3-128 of its bytes."""

    def step(batch):
        x = lines_of(batch, several.value)
        raw = x["buf"].tobytes()
        both = b"".join([xxhash.xxh3_128_digest(raw[a:z]) for a, z in zip(x["start"].tolist(), x["end"].tolist())])
        d = np.frombuffer(both, dtype=np.int64).reshape(-1, 2)
        return {**{k: x[k] for k in PLACE}, "hi": d[:, 0].copy(), "lo": d[:, 1].copy()}

    return arrow_map(rows, "id long, h long, at long, hi long, lo long", step, "text")


#: Bytes of a band hash; chance meetings of longer ones are rare at any size, and all meetings are compared anyway.
KEY = 6


def packed(keys: np.ndarray) -> np.ndarray:
    """The low ``KEY`` bytes of each hash, side by side."""
    return np.ascontiguousarray(keys.reshape(-1).view(np.uint8).reshape(-1, 8)[:, :KEY])


def unpacked(raw: bytes | np.ndarray) -> np.ndarray:
    out = np.zeros((len(raw) // KEY, 8), dtype=np.uint8)
    out[:, :KEY] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, KEY)
    return out.reshape(-1).view(np.int64)


def signatures(rows: DataFrame, several, places: Bloom, bands: int, per: int) -> DataFrame:
    """(id, h, at, size, bands, s0, s1) of the lines whose place may be in the sieve: their length in bytes, packed band hashes and sketch."""
    b = shared(rows.sparkSession, places)

    def step(batch):
        x = lines_of(batch, several.value)
        x = of_lines(x, np.flatnonzero(b.value.has(row_key(*(x[k] for k in PLACE)))))
        n = len(x["id"])
        if not n:
            return None
        least = minima(x, bands * per)
        keys = np.zeros((bands, n), dtype=np.uint64)
        for i in range(bands * per):
            keys[i // per] = mix64(keys[i // per] ^ least[i]) + np.uint64(i)
        ends = np.arange(n + 1, dtype=np.int32) * np.int32(KEY * bands)
        bands_ = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(packed(mix64(np.ascontiguousarray(keys.T))))])
        return {**{k: x[k] for k in PLACE}, "size": (x["end"] - x["start"]).astype(np.int32), "bands": bands_, **sketches(least)}

    return arrow_map(rows, "id long, h long, at long, size int, bands binary, s0 long, s1 long", step, "text")


#: Band hashes that a task gathers before it deals them out.
GATHER = 1 << 19


def repeated_keys(found: DataFrame) -> DataFrame:
    """(key, c): band hashes that occur on two lines or more, and on how many.

    Tasks deal their hashes out in packed runs, each hash once, with a count where they saw it again, so a hash that half of
    all lines share costs no more than the tasks that saw it.
    """
    n = partitions(found.sparkSession)
    schema = pa.schema([("part", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])

    def deal(held):
        v, c = np.unique(np.concatenate(held), return_counts=True)
        part = (mix64(v.view(np.uint64)) % np.uint64(n)).astype(np.int32)
        order = np.lexsort((c > 1, part))  # in each part the single ones first
        v, c, part = v[order], c[order].astype(np.int64), part[order]
        ends = np.searchsorted(part, np.arange(n + 1))
        full = [i for i in range(n) if ends[i + 1] > ends[i]]
        cut = lambda i: slice(ends[i], ends[i + 1])
        return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([packed(v[cut(i)]).tobytes() for i in full], pa.binary()), pa.array([c[cut(i)][c[cut(i)] > 1].tobytes() for i in full], pa.binary())], schema=schema)

    def send(batches):
        held, size = [], 0
        for batch in batches:
            held.append(unpacked(buffer_of(batch.column("bands"))[0]))
            size += len(held[-1])
            if size >= GATHER:
                yield deal(held)
                held, size = [], 0
        if size:
            yield deal(held)

    def count(batches):
        keys, seen = [], []
        for batch in batches:
            for k, c in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist()):
                k, more = unpacked(k), np.frombuffer(c, dtype=np.int64)
                keys.append(k)
                seen.append(np.concatenate([np.ones(len(k) - len(more), dtype=np.int64), more]))
        if keys:
            k, c = np.concatenate(keys), np.concatenate(seen)
            order = np.argsort(k, kind="stable")
            k, c = k[order], c[order]
            first = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
            k, c = k[first], np.add.reduceat(c, first)
            k, c = k[c > 1], c[c > 1]
            for a in range(0, len(k), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(k[a : a + (1 << 16)]), pa.array(c[a : a + (1 << 16)])], names=["key", "c"])

    dealt = found.select("bands").mapInArrow(lean(send), "part int, keys binary, counts binary").repartition(n, "part")
    return dealt.select("keys", "counts").mapInArrow(lean(count), "key long, c long")


def band_keys(found: DataFrame, again: Bloom) -> DataFrame:
    """(key, id, h, at, size, s0, s1) of the keys that may be in the sieve."""
    b = shared(found.sparkSession, again)
    names = [*PLACE, "size", *SKETCH]

    def run(batches):
        for batch in batches:
            keys = unpacked(buffer_of(batch.column("bands"))[0])
            keep = np.flatnonzero(b.value.has(row_key(keys)))
            row = keep // max(1, len(keys) // max(1, batch.num_rows))
            yield pa.RecordBatch.from_arrays([pa.array(keys[keep]), *(pa.array(batch.column(x).to_numpy(zero_copy_only=False)[row].astype("int64")) for x in names)], names=["key", *names])

    return found.select("bands", *names).mapInArrow(lean(run), ", ".join(f"{f} long" for f in ["key", *names]))


#: Lines of a bucket that one block holds; two blocks meet in a task.
BUCKET = 512
#: Lines of a bucket up to which each near pair is an edge; larger ones give a spanning forest.
FEW = 4


def whole_groups(batches, width: int, work):
    """Feeds ``work`` with matrices of whole groups, side by side; a group is a run of equal first ``width`` columns."""
    tail = None
    for batch in batches:
        rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1)
        rows = rows if tail is None else np.concatenate([tail, rows])
        ends = np.flatnonzero((rows[1:, :width] != rows[:-1, :width]).any(axis=1)) + 1
        cut = int(ends[-1]) if len(ends) else 0
        if cut:
            yield work(rows[:cut])
        tail = rows[cut:]
    if tail is not None and len(tail):
        yield work(tail)


def _two_places(df: DataFrame, *more: str) -> DataFrame:
    """(a, b) and more columns: the six columns of two places as structs."""
    side = lambda s: F.struct(*[F.col(s + k[0]).alias(k) for k in PLACE]).alias(s)
    return df.select(side("a"), side("b"), *more)


#: The columns of two places, id, hash and number.
TWO = [s + k[0] for s in "ab" for k in PLACE]


def near_in_buckets(held: DataFrame, again: DataFrame, most: int) -> DataFrame:
    """(a, b, a_size, b_size): edges that join, in every bucket ``key``, the lines whose sketches differ in at most ``most`` values; all pairs are compared, in blocks."""
    large = again.where(F.col("c") > BUCKET).select("key", F.ceil(F.col("c") / F.lit(BUCKET)).cast("int").alias("n"))
    n, names = F.coalesce("n", F.lit(1)), [*PLACE, "size", *SKETCH]
    own = held.join(large, "key", "left").withColumn("b", F.pmod(F.xxhash64(*PLACE), n).cast("int")).withColumn("x", F.explode(F.sequence(F.lit(0), n - 1)))
    order = ["key", "bi", "bj"]
    dealt = own.select("key", F.least("b", "x").alias("bi"), F.greatest("b", "x").alias("bj"), "b", *names).repartition(partitions(held.sparkSession), *order).sortWithinPartitions(*order, *PLACE)

    def far(x, y):
        d = x ^ y
        return np.bitwise_count((d | (d >> np.uint64(1))) & np.uint64(0x5555555555555555)).sum(axis=-1)

    def edges(rows):
        """Of whole groups of ``key``, ``bi``, ``bj``."""
        group, side, place = rows[:, :3], rows[:, 3], rows[:, 4:8]
        sketch = np.ascontiguousarray(rows[:, 8:]).view(np.uint64)
        first = np.flatnonzero(np.append(True, (group[1:] != group[:-1]).any(axis=1)))
        length = np.diff(np.append(first, len(rows)))
        left = np.repeat(np.where(length <= FEW, length, 0), length) - (np.arange(len(rows)) - np.repeat(first, length))
        out = []
        for d in range(1, FEW):
            i = np.flatnonzero(left > d)
            i = i[(place[i, :3] != place[i + d, :3]).any(axis=1) & (far(sketch[i], sketch[i + d]) <= most)]
            out.append(np.stack([i, i + d], axis=1))
        # where all lines of a block are near its first one, that is the forest
        head = np.repeat(first, length)
        close = np.minimum.reduceat(far(sketch, sketch[head]) <= most, first) & (group[first, 1] == group[first, 2]) & (length > FEW)
        i = np.flatnonzero(np.repeat(close, length) & (head != np.arange(len(rows))))
        out.append(np.stack([i, head[i]], axis=1))
        rest = (length > FEW) & ~close
        for a, m in zip(first[rest].tolist(), length[rest].tolist()):
            z = a + m
            one, other = np.flatnonzero(side[a:z] == group[a, 1]), np.flatnonzero(side[a:z] == group[a, 2])
            linked = np.zeros((m, m), dtype=bool)
            for k in range(0, len(one), 64):
                linked[np.ix_(one[k : k + 64], other)] = far(sketch[a:z][one[k : k + 64], None], sketch[a:z][None, other]) <= most
            np.fill_diagonal(linked, False)
            if linked.any():
                out.append(np.array(forest(linked | linked.T, list(range(a, z))), dtype=np.int64).reshape(-1, 2))
        pairs = np.concatenate(out)
        return pa.RecordBatch.from_arrays([pa.array(place[pairs[:, i], j]) for i in (0, 1) for j in range(4)], names=columns)

    columns = [*TWO[:3], "a_size", *TWO[3:], "b_size"]
    found = dealt.mapInArrow(lean(lambda batches: whole_groups(batches, 3, edges)), ", ".join(f"{c} long" for c in columns)).distinct()
    return _two_places(found, "a_size", "b_size")


def candidate_lines(rows: DataFrame, several, places: Bloom) -> DataFrame:
    """(id, h, at, line): the bytes of the lines whose place may be in the sieve."""
    b = shared(rows.sparkSession, places)

    def step(batch):
        x = lines_of(batch, several.value)
        x = of_lines(x, np.flatnonzero(b.value.has(row_key(*(x[k] for k in PLACE)))))
        raw = x["buf"].tobytes()
        return {**{k: x[k] for k in PLACE}, "line": pa.array([raw[a:z] for a, z in zip(x["start"].tolist(), x["end"].tolist())], pa.binary())} if len(x["id"]) else None

    return arrow_map(rows, "id long, h long, at long, line binary", step, "text")


def linked_lines(members: DataFrame, threshold: float) -> DataFrame:
    """(a, b): a spanning forest of the lines at the threshold, of members (c, id, h, at, line, n_blocks) of a component ``c``: all are compared exactly, in blocks."""
    n = F.col("n_blocks")
    dealt = members.withColumn("b", F.pmod(F.xxhash64(*PLACE), n).cast("int")).withColumn("x", F.explode(F.sequence(F.lit(0), n - 1)))
    order = ["ci", "ch", "ca", "bi", "bj"]
    dealt = dealt.select(*[F.col(f"c.{k}").alias("c" + k[0]) for k in PLACE], F.least("b", "x").alias("bi"), F.greatest("b", "x").alias("bj"), "b", *PLACE, "line")
    dealt = dealt.repartition(partitions(members.sparkSession), *order).sortWithinPartitions(*order, *PLACE)

    def check(out, held):
        """One block with itself, or two blocks."""
        place, sets, side = [r[6:9] for r in held], [r[9] for r in held], np.array([r[5] for r in held])
        if len(held) == 2:
            inter = int(shared_with_first(sets)[0])
            if side.tolist() in ([held[0][3], held[0][4]], [held[0][4], held[0][3]]) and inter >= threshold * (len(sets[0]) + len(sets[1]) - inter) - 1e-6:
                out.append((*place[1], *place[0]))
            return
        one, other = np.flatnonzero(side == held[0][3]), np.flatnonzero(side == held[0][4])
        if not len(one) or not len(other):
            return
        size = np.array([len(x) for x in sets], dtype=np.float64)
        if held[0][3] == held[0][4]:  # where all are linked to the first, that is the forest
            inter = shared_with_first(sets)
            if (inter >= threshold * (size[0] + size[1:] - inter) - 1e-6).all():
                out += [(*p, *place[0]) for p in place[1:]]
                return
        inter = overlaps([sets[i] for i in one], [sets[i] for i in other])
        near = np.zeros((len(held), len(held)), dtype=bool)
        near[np.ix_(one, other)] = inter >= threshold * (size[one][:, None] + size[other][None, :] - inter) - 1e-6
        np.fill_diagonal(near, False)
        out += [(*place[a], *place[b]) for a, b in forest(near | near.T, list(range(len(held))))]

    def run(batches):
        held, out = [], []
        emit = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=TWO)
        for batch in batches:
            *rest, lines = (c.to_pylist() for c in batch.columns)
            for r in zip(*rest, shingle_sets(lines)):
                if held and r[:5] != held[0][:5]:
                    if len(held) > 1:
                        check(out, held)
                    held = []
                if not held or r[6:9] != held[-1][6:9]:
                    held.append(r)
            if out:
                yield emit(out)
                out = []
        if len(held) > 1:
            check(out, held)
        if out:
            yield emit(out)

    return _two_places(dealt.mapInArrow(lean(run), ", ".join(f"{c} long" for c in TWO)))


def place_key(c: str) -> Column:
    """What ``row_key`` gives for a place."""
    return F.xxhash64(*[f"{c}.{k}" for k in PLACE]).alias("k")


def line_classes(rows: DataFrame, several, twice: bool, places: Bloom, threshold: float, bands: int, per: int) -> DataFrame:
    """(id, component): the places linked to others and the first place of their class.

    A place that the sieve lets through though it is not the first of its line is linked to the first, so it is never a label.
    """
    signed = found = stage(signatures(rows, several, places, bands, per), "signatures")
    if twice:  # rows of one id and text have the same places: one of each goes on
        found = signed.where("h = 0").unionByName(signed.where("h <> 0").dropDuplicates(PLACE))
    again = stage(repeated_keys(found), "keys")
    held = band_keys(found, Bloom.of(again.select(F.xxhash64("key").alias("k")), "k"))
    edges = stage(near_in_buckets(held, again, farthest(bands * per, threshold)), "candidates")
    unstage(signed, again)
    comps = components(edges)
    size = edges.select(F.col("a").alias("id"), F.col("a_size").alias("size")).union(edges.select("b", "b_size")).distinct()
    sized = comps.join(size, "id").select("id.*", F.col("component").alias("c"), "size")
    sizes = sized.groupBy("c").agg(F.count("*").alias("m"), F.sum("size").alias("grams")).select("c", blocks("m", "grams").alias("n_blocks"))
    placed = stage(sized.join(sizes, "c").select(*PLACE, "c", "n_blocks"), "members")
    unstage(edges)
    lines = candidate_lines(rows, several, Bloom.of(placed.select(F.xxhash64(*PLACE).alias("k")), "k"))
    lines = lines.dropDuplicates(PLACE) if twice else lines
    # lines and texts are dealt at every size, also where one side could be broadcast, so that what is shuffled grows as the input does
    links = stage(linked_lines(lines.join(placed.hint("merge"), PLACE), threshold), "links")
    unstage(placed)
    return components(links)


def copies_of(found: DataFrame, again: DataFrame) -> DataFrame:
    """(id, h, at) of the occurrences of the lines ``again`` (hi, lo, first) other than the first; a sieve spares single lines the shuffle."""
    sieve = shared(found.sparkSession, Bloom.of(again, "hi"))

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(sieve.value.has(batch.column("hi").to_numpy())))

    return found.mapInArrow(lean(run), found.schema).join(again, ["hi", "lo"]).where("id <> first.id or h <> first.h or at <> first.at").select(*PLACE)


def removed_lines(rows: DataFrame, several, twice: bool, threshold: float, recall: float) -> DataFrame:
    """(id, h, lines): the numbers of the lines that go, by document."""
    bands, per = banding(threshold, recall, HASHES)
    found = stage(occurrences(rows, several), "occurrences")
    distinct = stage(found.groupBy("hi", "lo").agg(F.count("*").alias("c"), F.min(F.struct(*PLACE)).alias("first")), "lines")
    copies = stage(copies_of(found, distinct.where("c > 1").select("hi", "lo", "first")), "copies")
    places = Bloom.of(distinct.select(place_key("first")), "k")
    unstage(found, distinct)
    # a copy goes unless it is the first of its line, and a first one unless it is its component's label
    classes = line_classes(rows, several, twice, places, threshold, bands, per)
    # rows of one id and text name the same places: each is gathered once, so a list is as long as its text has lines
    going = copies.unionByName(classes.where("id <> component").select("id.*"))
    going = going.distinct() if twice else going
    out = stage(going.groupBy("id", "h").agg(F.collect_list(F.col("at").cast("int")).alias("lines")), "going")
    unstage(copies, classes)
    return out


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, recall: float = 0.995, carry: list[str] | None = None) -> DataFrame:
    """Keeps one line of each component of similar lines: (id, n_lines, n_removed, kept), and the columns to ``carry``.

    Lines are cut at ``\\n``; those of whitespace alone are never compared and stay. Lines are linked where the Jaccard
    similarity of their sets of five-character runs is at least ``threshold``; the one that stays is the first of its
    component, by id and then by number. ``kept`` is the text without the others.

    A null text has one empty line and is kept as the empty text; a null id sorts first; rows that repeat an id and its
    text are one document, so a line of theirs stays or goes in each; rows that repeat an id with other texts are
    documents of their own, in the order of a hash of their texts; an empty table gives an empty one.
    """
    rows = texts_of(docs, id_col, text_col)
    ids, twice = repeated_ids(rows)
    several = shared(docs.sparkSession, ids)
    gone = removed_lines(rows, several, twice, threshold, recall)
    whole = rows if not carry else texts_of(docs, id_col, text_col, F.struct(*[F.col(f"`{c}`") for c in carry]).alias("rest"))
    more = f", rest {whole.schema['rest'].dataType.simpleString()}" if carry else ""
    sieve = shared(docs.sparkSession, Bloom.of(gone.select(F.xxhash64("id", "h").alias("k")), "k"))

    extra = lambda batch: {"rest": batch.column("rest")} if carry else {}

    def suspects(maybe: bool, batch: pa.RecordBatch) -> tuple[pa.RecordBatch, np.ndarray]:
        h = hashes_of(batch, several.value)
        keep = sieve.value.has(row_key(batch.column("id").to_numpy(zero_copy_only=False), h)) == maybe
        return batch.filter(pa.array(keep)), h[keep]

    def stay(batch):
        own, _ = suspects(False, batch)
        raw, offs = buffer_of(own.column("text"))
        ends = np.append(0, np.cumsum(raw == 10))[offs]
        return {"id": own.column("id"), "n_lines": np.diff(ends) + 1, "n_removed": np.zeros(own.num_rows, np.int64), "kept": own.column("text"), **extra(own)}

    def send(batch):
        own, h = suspects(True, batch)
        press = zstandard.ZstdCompressor(level=1)
        return {"id": own.column("id"), "h": h, "z": [press.compress(t) for t in own.column("text").cast(pa.binary()).to_pylist()], **extra(own)}

    def last(batch):
        un, out = zstandard.ZstdDecompressor(), {"n_lines": [], "n_removed": [], "kept": []}
        for z, lines in zip(batch.column("z").to_pylist(), batch.column("lines").to_pylist()):
            parts = un.decompress(z).split(b"\n")
            drop = {x for x in lines or () if x < len(parts)}
            out["n_lines"].append(len(parts))
            out["n_removed"].append(len(drop))
            out["kept"].append(b"\n".join(p for i, p in enumerate(parts) if i not in drop))
        return {"id": batch.column("id"), **out, "kept": pa.array(out["kept"], pa.binary()).cast(pa.string()), **extra(batch)}

    result = "id long, n_lines long, n_removed long, kept string" + more
    going = arrow_map(whole, "id long, h long, z binary" + more, send, "text").join(gone.hint("merge"), ["id", "h"], "left")
    cut = arrow_map(going, result, last, "z").unionByName(arrow_map(whole, result, stay, "text"))
    return cut.select(F.when(F.col("id") != LEAST, F.col("id")).alias(id_col), "n_lines", "n_removed", "kept", *(["rest.*"] if carry else []))


def op5_line_dedup(spark, sf_dir):
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_lines", "n_removed", F.length("kept").cast("long").alias("n_kept"), F.sha2("kept", 256).alias("kept_sha256"))
