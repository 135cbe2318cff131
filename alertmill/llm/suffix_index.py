"""Suffix-array dedup on a logarithmic family of index levels.

A level is a sparse suffix array: it holds the suffixes at anchors, which a rule on the content samples (about one in
fifty bytes), so equal windows hold equal anchors at equal offsets and no match is lost. A suffix is known by the name
of its leading piece and the name of the chunk around it, 64-bit hashes in place of the ranks that prefix doubling
gives; the order is that of the names, so suffixes with a long common start lie side by side, and only chunks of one
leading piece are ever compared with one another.

Levels are bucketed tables, sorted within buckets: ``heads`` (anchor, c) and ``chunks`` (anchor, chunk, c, place). A new
batch gets its own arrays, is merge-scanned with the heads of every level, and merges with levels of its own size, so
a corpus of B batches is rewritten log2(B) times. Scans and merges are sort-merge joins of tables with one bucketing
and order: they read both sides in step, and neither shuffle nor sort them.
"""

from __future__ import annotations

import json
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertmill.llm.common import partitions, shared_dir, stage, unstage
from alertmill.llm.repeats import LEAST, Windows, chunk_places, keyed, remove, spans_elsewhere

KEY = ["anchor", "chunk"]
COLUMNS = {"heads": "anchor BIGINT, c BIGINT", "chunks": "anchor BIGINT, chunk BIGINT, c BIGINT, place BIGINT"}
ORDER = {"heads": ["anchor"], "chunks": KEY}
#: A bucket is one file, so its order may be used.
IN_ORDER = "spark.sql.legacy.bucketedTableScan.outputOrdering"


@contextmanager
def ordered(spark: SparkSession):
    was = spark.conf.get(IN_ORDER)
    spark.conf.set(IN_ORDER, "true")
    try:
        yield
    finally:
        spark.conf.set(IN_ORDER, was)


class SuffixIndex:
    """Levels of sampled suffixes; ``add`` takes batches as they come, in any number, in this session or a later one.

    ``levels`` pairs the number of batches in a level with its folder; ``hits`` are the folders of the leading pieces
    found by the merge-scans to occur more than once. ``folder`` keeps the index; an index that is there is opened, with
    its own window, piece and buckets. Without a folder the index is the session's and ends with ``close``.
    """

    def __init__(self, spark: SparkSession, window: int = 200, piece: int = 96, folder: str | None = None):
        self.spark, self.tables = spark, {}
        self.folder = folder or f"{shared_dir(spark)}/suffixes-{uuid.uuid4().hex}"
        self.buckets, self.levels, self.hits, self.version = partitions(spark), [], [], 0
        fs, path = self._fs(f"{self.folder}/manifest")
        if fs.exists(path):
            last = spark.read.json(f"{self.folder}/manifest").orderBy(F.desc("version")).first()
            state = json.loads(last.state)
            self.version, self.buckets, window, piece = last.version, state["buckets"], state["window"], state["piece"]
            self.levels, self.hits = [tuple(x) for x in state["levels"]], state["hits"]
        self.win = Windows("byte", window, piece)

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), p

    def _save(self) -> None:
        """A new line of the manifest: what a reader finds is the old index or the new one."""
        self.version += 1
        state = {"buckets": self.buckets, "window": self.win.length, "piece": self.win.piece, "levels": self.levels, "hits": self.hits}
        self.spark.createDataFrame([(self.version, json.dumps(state))], "version long, state string").coalesce(1).write.mode("append").json(f"{self.folder}/manifest")

    def _delete(self, *folders: str) -> None:
        for folder in folders:
            for part in COLUMNS:
                name = self.tables.pop((folder, part), None)
                if name:
                    self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            fs, path = self._fs(folder)
            fs.delete(path, True)

    def table(self, folder: str, part: str) -> DataFrame:
        """``heads`` or ``chunks`` of a level, with their buckets and order."""
        name = self.tables.get((folder, part))
        if name is None:
            name = self.tables[folder, part] = f"suffixes_{uuid.uuid4().hex}"
            by = ", ".join(ORDER[part])
            self.spark.sql(f"CREATE TABLE {name} ({COLUMNS[part]}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {self.buckets} BUCKETS LOCATION '{folder}/{part}'")
        return self.spark.table(name)

    def _write(self, df: DataFrame, folder: str, part: str) -> None:
        name = self.tables[folder, part] = f"suffixes_{uuid.uuid4().hex}"
        by = ORDER[part]
        df.write.format("parquet").option("compression", "zstd").option("path", f"{folder}/{part}").bucketBy(self.buckets, by[0], *by[1:]).sortBy(by[0], *by[1:]).saveAsTable(name)

    def arrays(self, rows: DataFrame) -> str:
        """The sorted suffixes of one batch."""
        folder = f"{self.folder}/level-{uuid.uuid4().hex}"
        found = chunk_places(rows, self.win).groupBy(*KEY).agg(F.count("*").alias("c"), F.min("place").alias("place"))
        self._write(found, folder, "chunks")
        self._write(self.table(folder, "chunks").groupBy("anchor").agg(F.sum("c").alias("c")), folder, "heads")
        return folder

    def scan(self, new: str, level: str) -> DataFrame:
        """Leading pieces that both levels hold: both are read in their order."""
        return self.table(new, "heads").select("anchor").join(self.table(level, "heads").select("anchor").hint("merge"), "anchor")

    def merge(self, a: str, b: str) -> str:
        folder = f"{self.folder}/level-{uuid.uuid4().hex}"
        for part, by in ORDER.items():
            one, other = self.table(a, part).alias("x"), self.table(b, part).hint("merge").alias("y")
            both = one.join(other, by, "full_outer")
            sums = [(F.coalesce("x.c", F.lit(0)) + F.coalesce("y.c", F.lit(0))).alias("c")]
            self._write(both.select(*by, *sums, *([F.least("x.place", "y.place").alias("place")] if part == "chunks" else [])), folder, part)
        return folder

    def add(self, rows: DataFrame) -> None:
        """Takes a batch (id, text) in."""
        with ordered(self.spark):
            new, size, gone = self.arrays(rows), 1, []
            seen = self.table(new, "heads").where("c > 1").select("anchor")
            for _, level in self.levels:
                seen = seen.unionByName(self.scan(new, level))
            self.hits.append(f"{self.folder}/hits-{uuid.uuid4().hex}")
            seen.write.parquet(self.hits[-1])
            while self.levels and self.levels[-1][0] == size:
                _, level = self.levels.pop()
                gone += [level, new]
                new, size = self.merge(level, new), 2 * size
            self.levels.append((size, new))
        self._save()
        self._delete(*gone)

    def repeated(self) -> DataFrame:
        """(anchor, chunk, c, place): the different chunks of all leading pieces that occur more than once, over all levels."""
        seen = self.spark.read.schema("anchor long").parquet(*self.hits)
        rows = self.table(self.levels[0][1], "chunks")
        for _, level in self.levels[1:]:
            rows = rows.unionByName(self.table(level, "chunks"))
        if len(self.levels) > 1:
            rows = rows.groupBy(*KEY).agg(F.sum("c").alias("c"), F.min("place").alias("place"))
        return rows.join(seen.distinct().hint("merge"), "anchor", "left_semi")

    def close(self) -> None:
        """Deletes the index."""
        self._delete(*(x for _, x in self.levels), self.folder)
        self.levels, self.hits = [], []


def dedup_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 200, batches: int = 4) -> DataFrame:
    """Removes each UTF-8 byte covered by a ``window``-byte string that also starts anywhere else.

    The same document counts as elsewhere, overlaps count, matches never cross documents, and strings are judged
    on the input. The documents enter the index in ``batches`` batches, dealt by a hash of the id.

    Returns (id, n_bytes, n_removed, n_spans, kept_sha256). A null text is empty; a null id is an id of its own;
    repeated rows are documents of their own, so each loses what the other holds; an empty table gives an empty one.
    Ids are whole numbers, or texts of them.
    """
    rows = keyed(docs, id_col, text_col)
    index = SuffixIndex(docs.sparkSession, window, max(1, min(96, window - 1)))
    for b in range(batches):
        index.add(rows.where(F.pmod(F.xxhash64("id"), F.lit(batches)) == b))
    table = stage(index.repeated(), "chunks")
    index.close()
    spans = spans_elsewhere(rows, index.win, table)
    unstage(table)
    out = remove(rows, index.win, spans)
    return out.select(F.when(F.col("id") != LEAST, F.col("id")).alias(id_col), F.col("n_units").alias("n_bytes"), "n_removed", "n_spans", "kept_sha256")


def op10_suffix_dedup(spark, sf_dir):
    return dedup_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
