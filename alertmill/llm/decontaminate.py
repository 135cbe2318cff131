"""Benchmark decontamination: size-partitioned MinHash containment search in DataFrame functions alone.

Test items are partitioned by size (powers of two of their shingle counts); the items of a partition keep bottom-k
MinHash sketches of one length k. A long document is screened against the sketches: the share of an item's sketch
that the document holds estimates the item's containment, whatever the document's length, because the sketch is a
uniform sample of the item and the document is looked up whole. (The document's own MinHash would thin out just the
few shingles that it shares with a short item.) An item of n shingles of which a document holds t * n or more misses
at most floor((1 - t) * n), so at least k less that many sketch values are found: pairs with fewer are dropped, and
only those left are verified, on all shingles, compared as texts. No pair over the threshold is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertmill.llm.common import stage

#: Item shingles up to which the scan itself tests for them; beyond it they are joined, by a plan that goes by measured sizes.
IN_SCAN = 50_000
#: Sketch values beyond those that a match may miss: the more, the fewer candidates fail.
SPARE = 2
GAP = r"[^\p{L}\p{M}\p{N}]+"


def words(text: Column) -> Column:
    """Lower-case runs of letters, marks and digits; a null text has none."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), GAP), "")


def shingles(ws: str, m: int) -> str:
    """SQL for (i, m, h) of each run of ``m`` words; none where there are fewer."""
    parts = ", ".join(f"{ws}[i + {j}]" for j in range(m))
    return f"CASE WHEN size({ws}) >= {m} THEN transform(sequence(0, size({ws}) - {m}), i -> named_struct('i', i, 'm', {m}, 'h', xxhash64({parts}))) ELSE array() END"


def item_shingles(items: DataFrame, id_col: str, text_col: str, n: int, threshold: float) -> DataFrame:
    """(item_id, m, sh, h, n_item, need, in_sig) of each distinct shingle; an item of fewer than ``n`` words is one shingle of them all.

    ``in_sig``: the shingle is in its item's sketch; ``need``: values of the sketch that a match cannot do without.
    """
    w = items.select(F.col(id_col).alias("item_id"), words(F.col(text_col)).alias("ws")).where("size(ws) > 0")
    w = w.withColumn("m", F.least(F.lit(n), F.size("ws")))
    each = w.select("item_id", "m", F.explode(F.expr("array_distinct(transform(sequence(1, size(ws) - m + 1), i -> array_join(slice(ws, i, m), ' ')))")).alias("sh")).distinct()
    by_size = F.expr(f"CASE m {' '.join(f'WHEN {k} THEN ' + 'xxhash64(' + ', '.join(f'p[{j}]' for j in range(k)) + ')' for k in range(1, n + 1))} END")
    own = Window.partitionBy("item_id")  # an item is short: its own shingles; a null id is one item
    ranked = each.withColumn("p", F.split("sh", " ")).withColumn("h", by_size)
    ranked = ranked.withColumn("n_item", F.count("*").over(own)).withColumn("r", F.row_number().over(own.orderBy("h", "sh")))
    # the size partition, the sketch length of its largest items, and what an item of this size may miss
    missed = lambda size: F.floor((1 - F.lit(threshold)) * size + 1e-9)
    sized = ranked.withColumn("most", F.expr("shiftleft(1, cast(floor(log2(n_item)) as int) + 1) - 1")).withColumn("k", F.least(missed(F.col("most")) + 1 + SPARE, F.col("n_item")))
    return sized.select("item_id", "m", "sh", "h", "n_item", F.greatest(F.col("k") - missed(F.col("n_item")), F.lit(1)).alias("need"), (F.col("r") <= F.col("k")).alias("in_sig"))


def hits(docs: DataFrame, marks: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, m, h, sh): the shingles of each document that some item holds."""
    count = marks.count()
    lengths = sorted(r.m for r in marks.select("m").distinct().collect())  # at most n values
    # Words leave a generator, and hits an outer one: Catalyst neither copies these expressions into others nor infers filters that compute them again.
    ws = docs.select(F.col(id_col).alias("doc_id"), F.explode_outer(F.array(words(F.col(text_col)))).alias("ws"))
    held = ", ".join(shingles("ws", m) for m in lengths)
    found = F.explode_outer(F.expr("transform(x, s -> named_struct('m', s.m, 'h', s.h, 'sh', array_join(slice(ws, s.i + 1, s.m), ' ')))")).alias("s")
    if count <= IN_SCAN:
        inside = ", ".join(f"{r.h}L" for r in marks.select("h").distinct().orderBy("h").collect()).replace("-9223372036854775808L", "(-9223372036854775807L - 1L)")
        return ws.withColumn("x", F.expr(f"filter(concat({held}), s -> s.h IN ({inside}))")).select("doc_id", found).select("doc_id", "s.*").where("h is not null")
    rows = ws.withColumn("x", F.expr(f"concat({held})")).select("doc_id", found).select("doc_id", "s.*").where("h is not null")
    return rows.join(marks.select("h").distinct(), "h", "left_semi").select("doc_id", "m", "h", "sh")


def contained(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = 5, threshold: float = 0.8) -> DataFrame:
    """Pairs (doc_id, item_id, n_item, n_shared, containment) with at least ``threshold`` of the item's distinct ``n``-word shingles in the document.

    Null or empty texts and items match nothing; null ids are ids; rows that repeat a document or an item under one id
    give one row with the shingles that any of them holds; an empty table gives none. Documents are read once and only
    shingles that some item holds leave the scan.
    """
    marks = stage(item_shingles(items, item_id, item_text, n, threshold), "items")
    if marks.isEmpty():
        none = lambda name, of: F.lit(None).cast(of).alias(name)
        return docs.where(F.lit(False)).select(F.col(id_col).alias("doc_id"), none("item_id", items.schema[item_id].dataType), none("n_item", "long"), none("n_shared", "long"), none("containment", "double"))
    found = stage(hits(docs, marks, id_col, text_col).distinct(), "hits")
    # first the sketches: documents with enough values of an item's sketch are candidates
    signed = found.join(marks.where("in_sig"), ["m", "h", "sh"]).groupBy("doc_id", "item_id", "need").agg(F.count("*").alias("c")).where("c >= need")
    candidates = stage(signed.select(F.col("doc_id").alias("d"), F.col("item_id").alias("i")), "candidates")
    # then all shingles of the candidates
    both = found.join(marks, ["m", "h", "sh"])
    pairs = both.join(candidates, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("item_id").eqNullSafe(F.col("i")), "left_semi").groupBy("doc_id", "item_id", "n_item").agg(F.count("*").alias("n_shared"))
    return pairs.where(F.col("n_shared") >= F.lit(threshold) * F.col("n_item") - 1e-9).select("doc_id", "item_id", "n_item", "n_shared", (F.col("n_shared") / F.col("n_item")).alias("containment"))


def op6_decontamination(spark, sf_dir):
    return contained(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP6_SQL = r"""
WITH b AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{M}\p{N}]+') AS ws FROM benchmark),
i AS (SELECT DISTINCT item_id, least(5, len(ws)) AS m, array_to_string(ws[k:k + least(5, len(ws)) - 1], ' ') AS sh
      FROM (SELECT *, unnest(generate_series(1, len(ws) - least(5, len(ws)) + 1)) AS k FROM b WHERE len(ws) > 0)),
n AS (SELECT item_id, count(*) AS n_item FROM i GROUP BY item_id),
w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{M}\p{N}]+') AS ws FROM documents),
d AS (SELECT DISTINCT doc_id, m, array_to_string(ws[k:k + m - 1], ' ') AS sh
      FROM (SELECT w.*, m, unnest(generate_series(1, len(ws) - m + 1)) AS k FROM w, (SELECT DISTINCT m FROM i) WHERE len(ws) >= m))
SELECT doc_id, item_id, n_item, count(*) AS n_shared, count(*) / n_item AS containment
FROM d JOIN i USING (m, sh) JOIN n USING (item_id)
GROUP BY doc_id, item_id, n_item HAVING count(*) >= 0.8 * n_item - 1e-9
"""
