"""Toxicity by a classifier chain: each category's linear model also sees the probabilities of the categories before it."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertmill.llm.common import arrow_map, buffer_of, mix64, shared, stage, unstage
from alertmill.llm.linear import Logistic, fit, out_of_fold, sigmoid
from alertmill.llm.repeats import LEAST
from alertmill.llm.samples import bounded
from alertmill.llm.scan import word_hashes, words_of

#: Labelled documents the chain is fitted on, and words it looks at.
MOST_LABELLED, VOCABULARY = 16_000, 1024
GAP = np.ones(256, dtype=bool)
GAP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_sets(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each word of each text: ASCII letters folded to lower case, cut at other ASCII signs."""
    buf, offs = buffer_of(batch.column("text"))
    buf = LOWER[buf]
    starts, ends, row = words_of(buf, offs, GAP)
    return row, word_hashes(buf, starts, ends, GAP)


@dataclass(frozen=True)
class Chain:
    """The categories in order, the vocabulary's sorted hashes, and one model each; probabilities go on as log-odds."""

    names: list[str]
    words: np.ndarray
    models: list[Logistic]

    def presence(self, row: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
        x = np.zeros((n, len(self.words)), dtype=np.float32)
        if len(self.words) and len(h):
            at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
            hit = self.words[at] == h
            x[row[hit], at[hit]] = 1
        return x

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), 0), dtype=np.float32)
        for m in self.models:
            out = np.hstack([out, m.score(np.hstack([x, out]))[:, None].astype(np.float32)])
        return sigmoid(out)


def informative(marks: DataFrame, n_kinds: int, most: int) -> np.ndarray:
    """The words whose presence tells most about any category, by the likelihood ratio statistic; ties by hash. ``marks``: (id, words, c0..)."""
    kinds = [f"c{i}" for i in range(n_kinds)]
    total = marks.agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in kinds]).first()
    seen = marks.select(F.explode("words").alias("w"), *kinds).groupBy("w").agg(F.count("*").alias("seen"), *[F.sum(c).alias(c) for c in kinds]).where("seen >= 3")
    part = lambda a, e: F.when(a > 0, a * F.log(a / F.greatest(e, F.lit(1e-12)))).otherwise(0.0)
    n, s, scores = F.lit(float(total.n)), F.col("seen"), []
    for c in kinds:
        pos, a = F.lit(float(total[c] or 0)), F.col(c)
        scores.append(part(a, s * pos / n) + part(s - a, s * (n - pos) / n) + part(pos - a, (n - s) * pos / n) + part(n - s - pos + a, (n - s) * (n - pos) / n))
    best = seen.select("w", (F.greatest(*scores) if len(scores) > 1 else scores[0]).alias("g")).where("g > 2").orderBy(F.desc("g"), "w").limit(most)
    return np.sort(np.array([r.w for r in best.collect()], dtype=np.int64).view(np.uint64))


def fit_chain(names: list[str], words: np.ndarray, x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> Chain:
    """Trains category after category; earlier probabilities in training are out of fold, so later models see them as they will be on new texts."""
    chain = Chain(names, words, [])
    for c in range(len(names)):
        chain.models.append(fit(x, y[:, c], ridge=1e-4, standard=False, default=0.0, steps=400))
        x = np.hstack([x, out_of_fold(x, y[:, c], fold, ridge=1e-4, standard=False, default=0.0, steps=400)[:, None].astype(np.float32)])
    return chain


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, str], id_col: str = "doc_id", text_col: str = "text", most: int = MOST_LABELLED, columns: tuple[str, ...] = ("quality", "toxic")) -> Chain:
    """``categories``: SQL over the label ``columns``, by name, in the order of the chain; rows with a null in one of them are not labelled.

    Words are counted on the executors; the driver gets the chosen ones and, for at most ``most`` documents, which of them
    each holds. Null texts are empty; without labels every probability is 0.
    """
    spark = docs.sparkSession
    rows = bounded(docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text")), labels, id_col, list(columns), most)
    kinds = [f"c{i}" for i in range(len(categories))]
    marks = rows.select("id", "text", *[F.expr(f"cast({e} as int)").alias(k) for k, e in zip(kinds, categories.values())])

    def step(batch):
        row, h = word_sets(batch)
        per = np.searchsorted(row, np.arange(batch.num_rows + 1))
        return {"id": batch.column("id"), "words": [np.unique(h[a:z]).view(np.int64) for a, z in zip(per[:-1], per[1:])], **{k: batch.column(k) for k in kinds}}

    marks = stage(arrow_map(marks, "id long, words array<long>, " + ", ".join(f"{k} int" for k in kinds), step, "text"), "marks")
    words = informative(marks, len(kinds), VOCABULARY)
    known = F.broadcast(spark.createDataFrame([(int(w), i) for i, w in enumerate(words.view(np.int64))], "w long, i int"))  # VOCABULARY rows at most
    held = marks.select("id", F.explode("words").alias("w")).join(known, "w").groupBy("id").agg(F.collect_list("i").alias("held"))
    got = marks.drop("words").join(held, "id", "left").orderBy("id").toArrow()
    x = np.zeros((got.num_rows, len(words)), dtype=np.float32)
    for i, h in enumerate(got.column("held").to_pylist()):
        x[i, h or []] = 1
    y = np.stack([got.column(k).to_numpy().astype(float) for k in kinds], axis=1) if got.num_rows else np.zeros((0, len(kinds)))
    ids = got.column("id").to_numpy()
    unstage(marks)
    return fit_chain(list(categories), words, x, y, (mix64(ids.astype(np.int64).view(np.uint64)) % np.uint64(5)).astype(int))


def score(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, p_<category>...) of every document; a null text is empty, ids and repeated rows come back as they are."""
    b = shared(docs.sparkSession, chain)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LEAST).cast("long")).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def step(batch):
        c = b.value
        row, h = word_sets(batch)
        p = c.probabilities(c.presence(row, h, batch.num_rows))
        return {"id": batch.column("id"), **{f"p_{n}": np.round(p[:, i].astype(float), 6) for i, n in enumerate(c.names)}}

    out = arrow_map(rows, "id long, " + ", ".join(f"p_{n} double" for n in chain.names), step, "text")
    return out.withColumn("id", F.when(F.col("id") != LEAST, F.col("id"))).withColumnRenamed("id", id_col)


#: The table of labels judges quality and toxicity; the chain's categories are what these two can tell apart.
CATEGORIES = {"low_quality": "quality = 0", "toxic": "toxic = 1", "toxic_low_quality": "toxic = 1 and quality = 0"}


def op3_toxicity(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    chain = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), CATEGORIES)
    return score(docs, chain).withColumn("toxic", F.col("p_toxic") >= 0.5)
