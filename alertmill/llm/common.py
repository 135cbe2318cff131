"""What the operators of this subpackage share: shared-folder staging, fixed-size Bloom filters,
Arrow batch handling and distributed connected components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch handed to Python; a batch is cut further by bytes (see ``slices``).
ARROW_ROWS = "256"
#: Bytes of text that one numpy step works on; a longer text is worked on alone.
STEP_BYTES = 1 << 19
BLOOM_MAX_BITS = 27


def session(spark: SparkSession) -> None:
    """Small Arrow batches, so that very long texts do not meet in one Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or a folder of our own where it is unset."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not where:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="alertmill-")
        spark.conf.set("spark.checkpoint.dir", where)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(where)
    return where


def trim() -> None:
    """Gives memory that Python, Arrow and the C library hold without need back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library can
        ctypes.CDLL(None).malloc_trim(0)


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files and checkpoints of plans that nobody holds any longer."""
    trim()
    spark.sparkContext._jvm.System.gc()


def stage(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it back: lineage ends there, and lost executors cost nothing before it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    out = df.write.option("compression", "zstd")
    (out.partitionBy(*by) if by else out).parquet(path)
    read = spark.read.schema(df.schema).parquet(path)
    read._staged = path
    release(spark)
    return read


def unstage(*frames: DataFrame) -> None:
    """Deletes staged tables that are no longer read."""
    for df in frames:
        path = getattr(df, "_staged", None)
        if path:
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batch: pa.RecordBatch, column: str, most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that each part holds at most ``most`` bytes of ``column``, or one row."""
    n = batch.num_rows
    if not n:
        return
    col = batch.column(column)
    ends = np.cumsum(lengths_of(col))
    at = 0
    while at < n:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def lengths_of(col: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def buffer_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column, rows joined, and the offsets of the rows; a null is empty."""
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offs, data = col.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def lean(run: Callable) -> Callable:
    """``run`` for ``mapInArrow``, started by a collection: what came with the last task's code holds itself in cycles, tables included.

    A worker's first collection sets the imported modules apart, so that later ones only look at what tasks brought.
    """

    def go(batches):
        trim()
        if not gc.get_freeze_count():
            gc.freeze()
        yield from run(batches)

    return go


def arrow_map(df: DataFrame, schema: str, step: Callable[[pa.RecordBatch], dict | None], column: str) -> DataFrame:
    """``mapInArrow`` whose ``step`` turns a small record batch into named columns."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        for batch in batches:
            for part in slices(batch, column):
                got = step(part)
                if got is not None:
                    yield pa.RecordBatch.from_arrays([x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x, type=f.type) for f, x in ((f, got[f.name]) for f in target)], schema=target)

    return df.mapInArrow(lean(run), schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over unsigned 64-bit words."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Bloom:
    """A bitmap of a fixed number of bits over 64-bit keys: no key is missed, strangers pass rarely.

    Built by ``bit_or`` on the executors, so at most ``2**bits / 64`` words reach the driver whatever the
    input; where the keys outnumber the bits it prunes less, and results stay the same.
    """

    def __init__(self, words: np.ndarray, bits: int):
        self.words, self.bits = words, bits

    @staticmethod
    def of(keys: DataFrame, column: str, count: int | None = None, most: int = BLOOM_MAX_BITS) -> Bloom:
        n = keys.count() if count is None else count
        bits = int(min(most, max(16, np.ceil(np.log2(max(1, n))) + 4)))
        x = F.col(column).cast("long")
        one = lambda h: F.struct(F.shiftright(h, 6).alias("w"), F.expr("1L").alias("one"), h.bitwiseAND(F.lit(63)).cast("int").alias("b"))
        mask = F.lit((1 << bits) - 1).cast("long")
        spots = keys.select(F.explode(F.array(one(x.bitwiseAND(mask)), one(F.shiftrightunsigned(x, 32).bitwiseAND(mask) if bits <= 32 else x))).alias("s"))
        words = spots.select(F.col("s.w").alias("w"), F.expr("shiftleft(s.one, s.b)").alias("v")).groupBy("w").agg(F.bit_or("v").alias("v"))
        table = np.zeros(1 << (bits - 6), dtype=np.int64)
        got = words.toArrow()
        if got.num_rows:
            table[got.column("w").to_numpy()] = got.column("v").to_numpy()
        return Bloom(table.view(np.uint64), bits)

    def has(self, keys: np.ndarray) -> np.ndarray:
        k = keys.view(np.uint64)
        mask = np.uint64((1 << self.bits) - 1)
        out = np.ones(len(k), dtype=bool)
        for h in (k & mask, (k >> np.uint64(32)) & mask):
            out &= (self.words[(h >> np.uint64(6)).astype(np.int64)] >> (h & np.uint64(63))) & np.uint64(1) == 1
        return out


class Shared:
    """A broadcast of a value whose size its maker bounds; it travels with its class, and is unpacked once a task."""

    def __init__(self, spark: SparkSession, value):
        self.sent, self.got = spark.sparkContext.broadcast(cloudpickle.dumps(value)), None

    def __getstate__(self):
        return {"sent": self.sent, "got": None}

    @property
    def value(self):
        if self.got is None:
            self.got = cloudpickle.loads(self.sent.value)
        return self.got


def shared(spark: SparkSession, value) -> Shared:
    return Shared(spark, value)


def without(docs: DataFrame, id_col: str, gone: DataFrame) -> DataFrame:
    """``docs`` less the rows whose id is among the ids of ``gone`` (id, once); of ids marked ``once`` one row stays.

    A sieve of the ids lets all other rows pass where they are read; only suspects are shuffled and looked up.
    """
    spark = docs.sparkSession
    session(spark)
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)).cast("long"))
    gone = stage(gone, "gone")
    sieve = shared(spark, Bloom.of(gone.select(F.xxhash64("id").alias("k")), "k"))
    rows = docs.select(F.xxhash64(key).alias("k"), key.alias("id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))

    def part(maybe: bool):
        def run(batches):
            for b in batches:
                yield b.filter(pa.array(sieve.value.has(b.column("k").to_numpy(zero_copy_only=False)) == maybe))

        return rows.mapInArrow(lean(run), rows.schema)

    suspects = part(True).join(gone, "id", "left")
    kept = suspects.where("once is null").select("row").unionByName(suspects.where("once").dropDuplicates(["id"]).select("row"))
    return part(False).select("row").unionByName(kept).select("row.*")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components by label hooking and pointer jumping: (id, component), the least id of each.

    Every round takes the least label among neighbours, offers it to the old label's own vertex and halves the
    paths to the roots. Labels move by ``min`` aggregates, which combine before the shuffle, so a vertex with a
    third of all edges costs no more than its edges; rounds grow with the logarithm of the longest path. Each
    round ends in the shared folder. A label whose vertices have no neighbour of another label is a whole component:
    once such ones are most of the vertices they are set aside with their edges, so later rounds carry the rest only.
    """
    spark = edges.sparkSession
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v and u is not null and v is not null")
    e = stage(e.union(e.select("v", "u")).distinct(), "cc-edges")
    labels = stage(e.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("id"), F.least("u", "m").alias("l")), "cc")
    done: list[DataFrame] = []
    while True:
        near = e.join(labels.select(F.col("id").alias("v"), "l"), "v").groupBy("u").agg(F.min("l").alias("m"), F.max("l").alias("x"))
        hooked = labels.join(near.withColumnRenamed("u", "id"), "id").select("id", "l", F.least("l", "m").alias("m"), ((F.col("m") < F.col("l")) | (F.col("x") > F.col("l"))).alias("open"))
        # the old label's vertex learns the least label that its followers saw
        offer = hooked.where("m < l").groupBy(F.col("l").alias("id")).agg(F.min("m").alias("o"))
        step = hooked.join(offer, "id", "left").select("id", F.col("l").alias("old"), F.least("m", F.coalesce("o", "m")).alias("l"), "open")
        up = step.select(F.col("id").alias("l"), F.col("l").alias("up"))
        after = stage(step.join(up, "l", "left").select("id", "old", F.coalesce("up", "l").alias("l"), "open"), "cc")
        n, moved, opened = after.agg(F.count("*"), F.count_if(F.col("l") != F.col("old")), F.count_if("open")).first()
        unstage(labels)
        if not moved:
            unstage(e)
            done.append(after)
            return reduce(DataFrame.unionByName, [d.select("id", F.col("l").alias("component")) for d in done])
        labels = after.select("id", "l")
        labels._staged = after._staged
        if opened * 2 < n:
            busy = after.where("open").select("old").distinct().withColumn("busy", F.lit(True))
            parted = stage(after.join(busy, "old", "left").select("id", "l", F.col("busy").isNotNull().alias("busy")), "cc-parted")
            unstage(labels)
            done.append(parted.where("not busy"))
            labels = parted.where("busy").select("id", "l")
            fewer = stage(e.join(labels.select(F.col("id").alias("u")), "u", "left_semi"), "cc-edges")
            unstage(e)
            e = fewer
