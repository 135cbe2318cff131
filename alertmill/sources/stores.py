"""Tables that outlive a run: runs, label log, dependency scans, keyed verdicts. All are Parquet folders written through Spark."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertmill.functions import text as t
from alertmill.operators import history, policy
from alertmill.schemas import LABEL, LABELS, STATUSES
from alertmill.sources import versions


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A folder's rows, none where it is not there yet; of a table with versions the last one's."""
    if exists(spark, f"{path}/versions"):
        return versions.read(spark, path, schema)
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def replace(df: DataFrame, path: str) -> None:
    """Puts ``df`` in the folder's place: written beside it, then renamed, so that a failed write leaves the old rows."""
    spark = df.sparkSession
    new, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    df.write.parquet(new)
    fs, at = _fs(spark, path)
    p = lambda x: spark._jvm.org.apache.hadoop.fs.Path(x)
    if fs.exists(at):
        fs.rename(at, p(old))
    fs.rename(p(new), at)
    fs.delete(p(old), True)


# ---- runs ----


def run_id(stamp: str, repo: str) -> str:
    """The stamp of a run and its repository's name, harmless characters only."""
    return f"{stamp}_" + "".join(c if c.isalnum() or c in "-_." else "_" for c in repo)


def write_run(base: str, run: str, meta: dict, alerts: DataFrame, details: DataFrame, summary: DataFrame, traces: DataFrame) -> None:
    """Adds or replaces one run's partition in each of the five tables."""
    spark = alerts.sparkSession
    one = spark.createDataFrame([{**meta, "run_id": run}])
    for name, df in (("meta", one), ("alerts", alerts), ("details", details), ("summary", summary), ("traces", traces)):
        df.drop("run_id").write.mode("overwrite").parquet(f"{base}/{name}/run_id={run}")


def list_runs(spark: SparkSession, base: str) -> DataFrame:
    """Runs with their summary's counts as JSON, null without one, the newest first; a run without meta is none."""
    meta = spark.read.option("mergeSchema", "true").parquet(f"{base}/meta")
    if not exists(spark, f"{base}/summary"):
        return meta.withColumn("counts", F.lit(None).cast("string")).orderBy(F.desc("run_id"))
    s = spark.read.option("mergeSchema", "true").parquet(f"{base}/summary")
    return history.run_listing(meta, s.select("run_id", F.to_json(F.struct(*[c for c in s.columns if c != "run_id"])).alias("counts")))


def get_run(spark: SparkSession, base: str, run: str, log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Details of one run with its latest labels, and how many fingerprints have none. Only the run's partition is read."""
    details = history.overlay(spark.read.parquet(f"{base}/details").where(F.col("run_id") == run), log, run)
    from alertmill.operators.summary import unlabelled

    return details, unlabelled(details)


def get_alert(spark: SparkSession, base: str, run: str, key: str) -> tuple[DataFrame, DataFrame]:
    """All details of a fingerprint in a run (there may be several), and its trace."""
    one = lambda name: spark.read.parquet(f"{base}/{name}").where((F.col("run_id") == run) & (F.col("bughash") == key))
    return one("details"), one("traces")


def delete_run(spark: SparkSession, base: str, run: str) -> bool:
    """Removes one run; names that lead anywhere else are refused."""
    if not run or run in (".", "..") or any(c in run for c in "/\\"):
        return False
    found = False
    for name in ("meta", "alerts", "details", "summary", "traces"):
        fs, p = _fs(spark, f"{base}/{name}/run_id={run}")
        if fs.exists(p):
            found = fs.delete(p, True) or found
    return found


def traces_of(details: DataFrame, traces: DataFrame) -> DataFrame:
    """Traces of true positives alone: a semi join ahead of the wide columns."""
    return traces.join(details.where("verdict = 'true_positive'").select("bughash").distinct(), "bughash", "left_semi")


# ---- labels ----


def append_labels(rows: DataFrame, path: str) -> None:
    """Adds labels to the log as a new version of it, beside those of other writers; status is ``candidate`` unless given. A label or status outside the vocabulary stops the write."""
    rows = rows.withColumn("status", F.coalesce(F.nullif(t.text(F.col("status")), F.lit("")), F.lit("candidate")))
    bad = rows.where(~F.coalesce(F.col("label").isin(*LABELS), F.lit(False)) | ~F.col("status").isin(*STATUSES)).limit(1).collect()
    if bad:
        raise ValueError(f"label {bad[0].label!r} with status {bad[0].status!r} is not in the vocabulary")
    names = [f.split()[0] for f in LABEL.split(", ")]
    rows = rows.select(*[F.col(n) if n in rows.columns else F.lit(None).cast(k).alias(n) for n, k in (f.split() for f in LABEL.split(", "))]).select(*names)
    versions.append(rows, path)


def parse_label_log(lines: DataFrame) -> DataFrame:
    """Labels of a JSON-lines log given as (seq, line); blank lines, ``//`` lines and broken ones are left out."""
    x = F.trim("line")
    parsed = lines.where((x != "") & ~F.startswith(x, F.lit("//"))).select("seq", F.from_json("line", ", ".join(f for f in LABEL.split(", ") if not f.startswith("seq")) + ", _broken string", {"columnNameOfCorruptRecord": "_broken", "mode": "PERMISSIVE"}).alias("r"))
    return parsed.where("r is not null and r._broken is null").select("seq", "r.*").drop("_broken")


# ---- dependency scans ----


def scan_id(repo: str) -> str:
    """A repository's scan: scanned again, it is replaced."""
    return "".join(c if c.isalnum() or c in "-_." else "_" for c in repo)


def save_scan(base: str, scan: str, tables: dict[str, DataFrame], findings: DataFrame, meta: dict) -> None:
    """Replaces one scan's partition in each table; counts by severity go into its meta row."""
    spark = findings.sparkSession
    counts = {r.severity: r["count"] for r in findings.groupBy("severity").count().collect()}  # five severities at most
    row = {**meta, **{s: counts.get(s, 0) for s in ("critical", "high", "medium", "low")}}
    for name, df in {**tables, "findings": findings, "meta": spark.createDataFrame([row])}.items():
        df.write.mode("overwrite").parquet(f"{base}/{name}/scan_id={scan}")


def list_scans(spark: SparkSession, base: str, repo: str | None = None) -> DataFrame:
    meta = spark.read.option("mergeSchema", "true").parquet(f"{base}/meta")
    return (meta.where(F.col("repo_key") == repo) if repo else meta).orderBy(F.desc("scan_id"))


def reevaluate(spark: SparkSession, base: str, scan: str, pol: policy.Policy) -> DataFrame:
    """Findings of a stored scan under another policy; only they are written again."""
    one = lambda name: spark.read.parquet(f"{base}/{name}/scan_id={scan}")
    found = policy.evaluate(pol, one("components"), one("vulns"), one("licenses"))
    replace(found, f"{base}/findings/scan_id={scan}")
    return one("findings")


def warehouse(df: DataFrame, url: str, table: str, key: str, value: str, properties: dict[str, str]) -> None:
    """Replaces the rows of one key in a JDBC table, delete and insert in one transaction on the executor that holds them."""
    spark = df.sparkSession
    conn = spark._jvm.java.sql.DriverManager.getConnection(url, properties.get("user", ""), properties.get("password", ""))
    conn.setAutoCommit(False)
    try:
        gone = conn.prepareStatement(f"DELETE FROM {table} WHERE {key} = ?")
        gone.setString(1, value)
        gone.executeUpdate()
        put = conn.prepareStatement(f"INSERT INTO {table} ({', '.join(df.columns)}) VALUES ({', '.join('?' for _ in df.columns)})")
        for row in df.toLocalIterator():  # one scan's rows, streamed
            for i, x in enumerate(row, 1):
                put.setObject(i, x)
            put.addBatch()
        put.executeBatch()
        conn.commit()
    except Exception:
        conn.rollback()
        raise
    finally:
        conn.close()


# ---- keyed verdicts ----

VERDICTS = "bughash string, verdict string, confidence int, seq long"
CACHE = "key string, verdict string, confidence int, created_at timestamp"


def put_verdicts(spark: SparkSession, path: str, rows: DataFrame) -> None:
    """Upserts by fingerprint, as a new version; writers that meet both have their rows in it."""
    new = rows.select("bughash", "verdict", "confidence", "seq")
    versions.change(spark, path, VERDICTS, lambda old: history.upsert(old, new, "bughash"))


def verdict_of(spark: SparkSession, path: str, key: str) -> DataFrame:
    return read(spark, path, VERDICTS).where(F.col("bughash") == key)


def completed(spark: SparkSession, path: str) -> DataFrame:
    """(alert_id) of checkpointed judgements that did not fail."""
    return read(spark, path, "alert_id string, fail_reason string").where(t.text(F.col("fail_reason")) == "").select("alert_id").distinct()


# ---- snapshots ----


def save_facts(tables: dict[str, DataFrame], path: str, version: int) -> None:
    """All fact tables of an analysis under one version."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/v{version}/{name}")


def load_facts(spark: SparkSession, path: str, version: int, names: list[str]) -> dict[str, DataFrame] | None:
    """The tables of that version, or nothing if it was never saved."""
    return {n: spark.read.parquet(f"{path}/v{version}/{n}") for n in names} if exists(spark, f"{path}/v{version}") else None
