"""Quality by co-training: a text view and a page-metadata view teach each other, then their calibrated scores are combined."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertmill.llm.common import arrow_map, buffer_of, lean, mix64, shared, slices, stage, unstage
from alertmill.llm.linear import Logistic, Pool, fit, logit, out_of_fold, platt, refit, rows_of, sigmoid, weights_of
from alertmill.llm.repeats import LEAST
from alertmill.llm.samples import bounded
from alertmill.llm.scan import word_hashes, words_of

#: Labelled documents that the views are fitted on; pseudo-labels come from all documents without.
MOST_LABELLED = 16_000
#: What all pseudo-labels together weigh of the labels.
POOL_SHARE = 0.5
#: Tasks that add up what a pass over the pool found; one more adds up theirs, so a single row reaches the driver.
SUMS = 64
#: Rounds of exchange, and the calibrated probability that makes a pseudo-label.
ROUNDS, CONFIDENT = 3, 0.98
SOURCES, LANGS = 64, 16
PAGE = ("source", "lang", "n_chars", "n_lines")


def text_view(batch: pa.RecordBatch) -> np.ndarray:
    """What a text is made of: rates of the ASCII signs, share of other bytes, word length, repetition of words, doubled signs."""
    buf, offs = buffer_of(batch.column("text"))
    n = np.diff(offs)
    row = np.repeat(np.arange(len(n)), n)
    size = np.maximum(n, 1).astype(float)[:, None]
    counts = np.bincount(row * 256 + buf, minlength=256 * len(n)).reshape(-1, 256)
    starts, ends, wrow = words_of(buf, offs)
    words = np.bincount(wrow, minlength=len(n))
    h = word_hashes(buf, starts, ends)
    per = np.searchsorted(wrow, np.arange(len(n) + 1))
    kinds = np.array([len(np.unique(h[a:z])) for a, z in zip(per[:-1].tolist(), per[1:].tolist())], dtype=float)
    same = np.zeros(len(wrow), dtype=bool)
    same[1:] = (h[1:] == h[:-1]) & (wrow[1:] == wrow[:-1])
    twin = np.zeros(len(buf), dtype=bool)
    twin[1:] = (buf[1:] == buf[:-1]) & (buf[1:] < 64) & (buf[1:] > 32)
    w = np.maximum(words, 1)
    more = np.stack([counts[:, 128:].sum(axis=1) / size[:, 0], np.log1p(np.bincount(wrow, weights=ends - starts, minlength=len(n)) / w), kinds / w, np.bincount(wrow, weights=same, minlength=len(n)) / w, np.bincount(row, weights=twin, minlength=len(n)) / size[:, 0], words == 0], axis=1)
    return np.hstack([np.log1p(1000 * counts[:, :128] / size), more]).astype(np.float32)


def page_view(batch: pa.RecordBatch) -> np.ndarray:
    """What is known about a page without its words: source, language, length, lines."""
    rows = batch.num_rows
    x = np.zeros((rows, SOURCES + LANGS + 4), dtype=np.float32)
    x[np.arange(rows), batch.column("source").to_numpy(zero_copy_only=False)] = 1
    x[np.arange(rows), SOURCES + batch.column("lang").to_numpy(zero_copy_only=False)] = 1
    chars, lines = (np.maximum(batch.column(c).to_numpy(zero_copy_only=False), 0).astype(float) for c in ("n_chars", "n_lines"))
    x[:, -4:] = np.stack([np.log1p(chars), np.log1p(lines), np.log1p(chars / (lines + 1)), chars == 0], axis=1)
    return x


def page_columns(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """(id, text, source, lang, n_chars, n_lines): nulls have a value of their own, or 0."""
    kind = lambda c, n: F.pmod(F.xxhash64(F.col(c).cast("string")), F.lit(n)).cast("int").alias(c) if c in docs.columns else F.lit(0).alias(c)
    text = F.coalesce(F.col(text_col), F.lit(""))
    chars = F.coalesce(F.col("n_chars").cast("long"), F.length(text).cast("long")) if "n_chars" in docs.columns else F.length(text).cast("long")
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LEAST).cast("long")).alias("id"), text.alias("text"), kind("source", SOURCES), kind("lang", LANGS), chars.alias("n_chars"), (F.length(text) - F.length(F.replace(text, F.lit("\n")))).cast("long").alias("n_lines"), *more)


@dataclass(frozen=True)
class View:
    """A view's model and the slope and intercept that calibrate it."""

    model: Logistic
    a: float
    b: float

    def p(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.a * self.model.score(x) + self.b)


@dataclass(frozen=True)
class CoTrained:
    """Both views and the weights that combine their calibrated log-odds."""

    text: View
    page: View
    mix: tuple[float, float, float]
    exchanged: tuple[int, int] = (0, 0)

    def score(self, text: np.ndarray, page: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        t, p = self.text.p(text), self.page.p(page)
        return t, p, sigmoid(self.mix[0] * logit(t) + self.mix[1] * logit(p) + self.mix[2])


def pooled(pool: DataFrame, views: list[View], confident: float) -> tuple[list[Pool], list[int]]:
    """What the documents of ``pool`` (t, source, lang, n_chars, n_lines) teach each view, by the other's confident labels, and how many they are.

    One pass: every task adds up the gradient and curvature of its documents, and the sums are added up on the executors.
    """
    spark = pool.sparkSession
    b = shared(spark, views)
    dims = [len(v.model.w) + 1 for v in views]
    size = sum(2 + d + d * d for d in dims)

    def add(batches):
        out = np.zeros(size)
        for batch in batches:
            x = [buffer_of(batch.column("t"))[0].view(np.float32).reshape(batch.num_rows, -1), page_view(batch)]
            p, at = [v.p(f) for v, f in zip(b.value, x)], 0
            for i, v in enumerate(b.value):
                sure = np.flatnonzero((p[1 - i] >= confident) | (p[1 - i] <= 1 - confident))
                z, own = rows_of(v.model, x[i][sure]), sigmoid(v.model.score(x[i][sure]))
                y, d = (p[1 - i][sure] >= confident).astype(float), dims[i]
                out[at : at + 2] += len(sure), y.sum()
                out[at + 2 : at + 2 + d] += z.T @ (own - y)
                out[at + 2 + d : at + 2 + d + d * d] += ((z * (own * (1 - own))[:, None]).T @ z).ravel()
                at += 2 + d + d * d
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["s"])

    def total(batches):
        out = np.zeros(size)
        for batch in batches:
            for s in batch.column("s").to_pylist():
                out += np.frombuffer(s)
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["s"])

    sums = pool.mapInArrow(lean(add), "s binary").select("s", F.pmod(F.xxhash64("s"), F.lit(SUMS)).alias("part")).repartition(SUMS, "part").select("s").mapInArrow(lean(total), "s binary")
    found = sums.repartition(1).mapInArrow(lean(total), "s binary").first()
    every, at, out, n = np.frombuffer(found.s) if found else np.zeros(size), 0, [], []
    for v, d in zip(views, dims):
        out.append(Pool(weights_of(v.model), float(every[at]), every[at + 2 : at + 2 + d], every[at + 2 + d : at + 2 + d + d * d].reshape(d, d)))
        n.append(int(every[at]))
        at += 2 + d + d * d
    return out, n


@dataclass(frozen=True)
class Labelled:
    """The labelled documents: both views' features, labels ``y`` (1 good, 0 bad) and folds. ``taught`` and ``started`` give fitted views and how to combine them."""

    views: tuple[np.ndarray, np.ndarray]
    y: np.ndarray
    fold: np.ndarray

    def combined(self, fitted: list[View], scores: list[np.ndarray]) -> tuple[float, float, float]:
        both = np.stack([fitted[v].a * scores[v] + fitted[v].b for v in (0, 1)], axis=1).clip(-13, 13).astype(np.float32)
        top = fit(both, self.y.astype(float), ridge=1e-4)
        w = top.w / top.scale
        return float(w[0]), float(w[1]), float(top.b - (w * top.mean).sum())

    def started(self) -> tuple[list[View], tuple[float, float, float] | None]:
        """Without a way to combine the views where all labels are of one kind."""
        y = self.y.astype(float)
        models = [fit(x, y, ridge=1e-3, default=1.0) for x in self.views]
        scores = [out_of_fold(x, y, self.fold, ridge=1e-3, default=1.0) for x in self.views]
        fitted = [View(m, *platt(s, y)) for m, s in zip(models, scores)]
        return fitted, self.combined(fitted, scores) if len(np.unique(self.y)) == 2 else None

    def taught(self, fitted: list[View], learnt: list[Pool]) -> tuple[list[View], tuple[float, float, float]]:
        fitted, y, scores = list(fitted), self.y.astype(float), []
        for v, x in enumerate(self.views):
            m = refit(fitted[v].model, x, y, learnt[v], POOL_SHARE)
            held = np.zeros(len(y))
            for k in np.unique(self.fold):
                own = self.fold == k
                held[own] = refit(m, x[~own], y[~own], learnt[v], POOL_SHARE, steps=3).score(x[own])
            scores.append(held)
            fitted[v] = View(m, *platt(held, y))
        return fitted, self.combined(fitted, scores)


def fitted_in_task(rows: DataFrame, name: str, *args):
    """What the method ``name`` of the labelled ``rows`` (id, y, t, p) gives: one task on the executors reads them, and the models alone reach the driver."""
    b = shared(rows.sparkSession, args)

    def run(batches):
        own = pa.Table.from_batches(batches)
        ids, flat = own.column("id").to_numpy().astype(np.int64), lambda c: np.concatenate([np.zeros(0, np.uint8), *(buffer_of(x)[0] for x in own.column(c).chunks)]).view(np.float32).reshape(own.num_rows, -1)
        order = np.argsort(ids)
        rows = Labelled((flat("t")[order], flat("p")[order]), own.column("y").to_numpy()[order], (mix64(ids[order].view(np.uint64)) % np.uint64(5)).astype(int))
        yield pa.RecordBatch.from_arrays([pa.array([cloudpickle.dumps(getattr(rows, name)(*b.value))], pa.binary())], names=["m"])

    return cloudpickle.loads(rows.coalesce(1).mapInArrow(lean(run), "m binary").first().m)


def co_train(call: Callable, pool: DataFrame | None = None, rounds: int = ROUNDS, confident: float = CONFIDENT) -> CoTrained:
    """Views fitted on labels, then taught by each other's confident labels of the ``pool`` in rounds; ``call`` runs a method of ``Labelled``.

    Calibration and the combination go by labelled documents only, scored out of fold. Without labels everything is good;
    with labels of one kind everything is of that kind.
    """
    fitted, mix = call("started")
    if mix is None:
        return CoTrained(fitted[0], fitted[1], (0.5, 0.5, 0.0))
    n = [0, 0]
    for _ in range(rounds if pool is not None else 0):
        learnt, n = pooled(pool, fitted, confident)
        fitted, mix = call("taught", fitted, learnt)
    return CoTrained(fitted[0], fitted[1], mix, (n[0], n[1]))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", labelled: int = MOST_LABELLED) -> CoTrained:
    """Co-trains on at most ``labelled`` labelled documents and on all documents without a label.

    Null texts are empty, null sources and languages a kind of their own; rows without an id and rows that repeat one count as
    documents of the pool; a null label is none; an empty table or no labels give a model that calls everything good.
    """
    rows = bounded(page_columns(docs, id_col, text_col).where(F.col("id") != LEAST).withColumnRenamed("id", "key"), labels.select(F.col(id_col).alias("key"), label), "key", [label], labelled)
    rows = rows.select("id", "text", "source", "lang", "n_chars", "n_lines", F.col(label).cast("int").alias("y"))

    def step(batch):
        return {"id": batch.column("id"), "y": batch.column("y"), "t": [x.tobytes() for x in text_view(batch)], "p": [x.tobytes() for x in page_view(batch)]}

    known = stage(arrow_map(rows, "id long, y int, t binary, p binary", step, "text"), "labelled")
    ids = known.select("id").toArrow().column("id").to_numpy().astype(np.int64)
    if not len(ids):
        none = Labelled((np.zeros((1, 134), np.float32), np.zeros((1, SOURCES + LANGS + 4), np.float32)), np.array([1]), np.array([0]))
        return co_train(lambda name: getattr(none, name)())
    told = shared(docs.sparkSession, np.sort(ids))

    def features(batch):
        free = batch.filter(pa.array(~np.isin(batch.column("id").to_numpy(zero_copy_only=False), told.value)))
        return {"t": [x.tobytes() for x in text_view(free)], **{c: free.column(c) for c in PAGE}} if free.num_rows else None

    pool = stage(arrow_map(page_columns(docs, id_col, text_col), "t binary, source int, lang int, n_chars long, n_lines long", features, "text"), "pool")
    model = co_train(partial(fitted_in_task, known), pool)
    unstage(known, pool)
    return model


def score(docs: DataFrame, model: CoTrained, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, p_text, p_page, quality) of every document: the calibrated probability of each view and of both together.

    Null columns count as a kind of their own, a null text as empty; ids and repeated rows come back as they are.
    """
    b = shared(docs.sparkSession, model)

    def step(batch):
        t, p, q = b.value.score(text_view(batch), page_view(batch))
        return {"id": batch.column("id"), **{k: np.round(v.astype(float), 6) for k, v in (("p_text", t), ("p_page", p), ("quality", q))}}

    out = arrow_map(page_columns(docs, id_col, text_col), "id long, p_text double, p_page double, quality double", step, "text")
    return out.select(F.when(F.col("id") != LEAST, F.col("id")).alias(id_col), "p_text", "p_page", "quality")


def good_ones(docs: DataFrame, model: CoTrained, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose combined quality is at least ``least``, all columns as they are, in one pass; nulls as in ``score``."""
    name = "row"
    while name in {*docs.columns, "id", "text", *PAGE}:
        name += "_"
    whole = docs.select("*", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(name))
    rows = page_columns(whole, id_col, text_col, name)
    b = shared(docs.sparkSession, model)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                keep = b.value.score(text_view(part), page_view(part))[2] >= least
                yield pa.RecordBatch.from_arrays([part.column(name).filter(pa.array(keep))], names=[name])

    return rows.mapInArrow(lean(run), rows.select(name).schema).select(f"{name}.*")


#: A document stays unless it is more likely bad than good.
KEEP = 0.5


def op8_quality(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))).withColumn("keep", F.col("quality") >= KEEP)
