"""Logs, overlays, keyed stores and caches: the latest row wins, by an explicit sequence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertmill.functions import text as t


def latest(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The last row of each key."""
    return _edge(df, keys, F.desc(seq))


def earliest(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The first row of each key."""
    return _edge(df, keys, F.asc(seq))


def _edge(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("_n = 1").drop("_n")


def label_history(log: DataFrame, run_id: str, key: str) -> DataFrame:
    """All labels of one alert of one run, oldest first."""
    return log.where((F.col("run_id") == run_id) & (F.col("bughash") == key)).orderBy("seq")


def overlay(details: DataFrame, log: DataFrame, run_id: str) -> DataFrame:
    """Details with label, labeler, labelled_at and label_status of the run's latest label, null where there is none."""
    own = log.where((F.col("run_id") == run_id) & (t.text(F.col("bughash")) != ""))
    last = latest(own, ["bughash"], "seq").select("bughash", "label", "labeler", "labelled_at", F.col("status").alias("label_status"))
    return details.drop("label", "labeler", "labelled_at", "label_status").join(last, "bughash", "left")


def upsert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``table`` with ``rows`` put in, the new row of a key replacing the old; of several new rows the last by ``seq``."""
    both = table.withColumn("_new", F.lit(0)).unionByName(rows.withColumn("_new", F.lit(1)))
    return both.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_new"), F.desc("seq")))).where("_n = 1").drop("_n", "_new")


def cache_lookup(requests: DataFrame, cache: DataFrame, now: Column, ttl_seconds: int) -> DataFrame:
    """Requests with the cached verdict, null on a miss: an entry is stale only when older than the limit, and uncertain ones are not used."""
    live = cache.where((F.unix_timestamp(now) - F.unix_timestamp("created_at") <= ttl_seconds) & (F.col("verdict") != "uncertain"))
    return requests.join(live.select("key", F.col("verdict").alias("cached_verdict"), F.col("confidence").alias("cached_confidence")), "key", "left")


def purge(cache: DataFrame, now: Column, ttl_seconds: int) -> DataFrame:
    """The cache without what is older than the limit; stamps are compared as text, as they are stored."""
    cutoff = F.date_format(F.timestamp_seconds(F.unix_timestamp(now) - ttl_seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return cache.where(~(F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'") < cutoff))


def run_listing(meta: DataFrame, summaries: DataFrame) -> DataFrame:
    """Runs with their counts, null where a run has no summary, the newest id first."""
    return meta.join(summaries.select("run_id", "counts"), "run_id", "left").orderBy(F.desc("run_id"))


def history_faces(runs: DataFrame, newest: int = 60) -> DataFrame:
    """(bughash, family): families that any of the newest runs confirmed. ``runs`` has (run_id, bughash, verdict, actual_types)."""
    from alertmill.functions.vocab import family

    recent = runs.select("run_id").distinct().orderBy(F.desc("run_id")).limit(newest)
    rows = runs.where("verdict = 'true_positive'").join(recent, "run_id", "left_semi").select("bughash", F.explode("actual_types").alias("kind"))
    return rows.select("bughash", family(F.col("kind")).alias("family")).where("family <> ''").distinct()


def attach_facts(judged: DataFrame, traces: DataFrame) -> DataFrame:
    """Judgements with the facts of their last trace; a trace without authorisation facts brings none at all."""
    last = latest(traces, ["bughash"], "seq").where("authz is not null").select("bughash", "authz", "upload")
    return judged.join(last, "bughash", "left")


def safe_name(key: Column) -> Column:
    """File name of a trace: the first 16 harmless characters of its key."""
    return F.substring(F.regexp_replace(t.text(key), "[^A-Za-z0-9_-]", ""), 1, 16)
