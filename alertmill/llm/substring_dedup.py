"""Substring dedup by level-wise doubling of repeated word windows.

Level after level, windows of one length that occur at least twice are extended to twice that length; a window can
only repeat where the shorter windows in it do. One anchor stands for each run of windows that share it, so a level
counts a fraction of its windows. Levels go up to the length that decides removal, or end where no candidate survives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertmill.llm.common import Bloom, arrow_map, shared, stage, unstage
from alertmill.llm.repeats import LEAST, Windows, chunks, distinct_chunks, keyed, remove, spans_earlier
from alertmill.llm.scan import anchor_of_windows, anchored_chunks

#: Words of the shortest level's pieces at most.
SHORTEST = 5


def levels(window: int) -> list[int]:
    """The lengths of the levels, each at most half of the next, rounded up: 5, 10, 20 for 20."""
    out = [window]
    while out[-1] > SHORTEST or len(out) == 1 and window > 1:
        out.append((out[-1] + 1) // 2)
    return out[::-1]


def candidates(rows: DataFrame, win: Windows, before: tuple[Windows, Bloom] | None) -> DataFrame:
    """(anchor): the pieces at the anchors of ``win``, of those that the level before left."""
    known = shared(rows.sparkSession, before[1]) if before else None

    def step(batch):
        _, _, units, offs, *_ = win.units(batch)
        c = anchored_chunks(units, offs, win.length, win.piece)
        if c is None:
            return None
        anchor = c["anchor"]
        if known is not None:  # a piece is a window of the level before, and is left if its anchor repeats
            own = anchor_of_windows(units, before[0].length, before[0].piece)
            anchor = anchor[known.value.has(own[c["at"] + c["o"]])]
        return {"anchor": anchor.view("int64")}

    return arrow_map(rows, "anchor long", step, "text")


def survivors(rows: DataFrame, window: int) -> tuple[Windows, Bloom] | None:
    """The last level below ``window`` and a sieve of its pieces that repeat; None where a level has none."""
    sizes, left = levels(window), None
    for piece, length in zip(sizes, sizes[1:] or sizes):
        win = Windows("word", length, piece)
        again = stage(candidates(rows, win, left).groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1").select("anchor"), "anchors")
        n = again.count()
        left = (win, Bloom.of(again, "anchor", n)) if n else None
        unstage(again)
        if left is None:
            return None
    return left


def dedup_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20) -> DataFrame:
    """Removes each word covered by a ``window``-word window whose sequence also starts earlier.

    Earlier is a smaller id, or the same document at a smaller start; windows are judged on the input.

    Returns (id, n_words, n_removed, n_spans, kept_sha256); ids as given, whole numbers or texts of them. A null text
    has no words; a null id sorts first; rows that repeat an id and its text are one place, so neither is the earlier one
    and both keep their words; an empty table gives an empty one.
    """
    rows = keyed(docs, id_col, text_col)
    left = survivors(rows, window)
    if left is None:
        win = Windows("word", window, window)
        spans = docs.sparkSession.createDataFrame([], "id long, h long, starts array<int>, counts array<int>")
    else:
        win, sieve = left
        table = stage(distinct_chunks(chunks(rows, win, sieve)), "chunks")
        spans = spans_earlier(rows, win, table)
        unstage(table)
    out = remove(rows, win, spans)
    return out.select(F.when(F.col("id") != LEAST, F.col("id")).alias(id_col), F.col("n_units").alias("n_words"), "n_removed", "n_spans", "kept_sha256")


def op9_substring_dedup(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return dedup_windows(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP9_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
f AS (SELECT doc_id, k, row_number() OVER (PARTITION BY array_to_string(ws[k:k + 19], ' ') ORDER BY doc_id, k) AS n FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 19)) AS k FROM w)),
gone AS (SELECT DISTINCT doc_id, k + i AS p FROM f, range(20) r(i) WHERE n > 1),
pos AS (SELECT doc_id, ws[p] AS word, p FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws))) AS p FROM w)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t FROM pos ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, len(ws) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) USING (doc_id)
"""
