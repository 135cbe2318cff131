"""Bounded, seeded samples of labelled documents for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertmill.llm.common import session


def bounded(docs: DataFrame, labels: DataFrame, id_col: str, columns: list[str], most: int, text_col: str = "text", seed: int = 11) -> DataFrame:
    """The labelled documents to fit on, with their labels: at most ``most`` rows, by seeded hash of the id.

    Only ids and labels are shuffled to choose; the chosen ids are broadcast to the scan. Of several label rows for one id
    the least values count, of rows that repeat an id the one with the least hash of its text; rows with a null id or label
    are not labelled.
    """
    session(docs.sparkSession)
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(*[F.min(F.col(c).try_cast("int")).alias(c) for c in columns])
    marks = marks.where(" and ".join(f"{c} is not null" for c in columns))
    ids = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id")).distinct()
    chosen = ids.join(marks, "id").orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(most)
    small = docs.sparkSession.createDataFrame(chosen.collect(), chosen.schema)
    rest = [c for c in docs.columns if c not in ("id", *columns)]
    taken = docs.withColumn("id", F.col(id_col).cast("long")).select("id", *rest).join(F.broadcast(small), "id")
    one = taken.groupBy("id").agg(F.min_by(F.struct(*rest, *columns), F.xxhash64(text_col)).alias("one"))
    return one.select("id", "one.*")
