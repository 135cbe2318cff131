"""The audit of alerts and the scan of dependencies as whole plans; the judge's answers are an input table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertmill.functions import vocab as v
from alertmill.operators import guards, history, policy, routing, summary


@dataclass(frozen=True)
class Audit:
    """What an audit gives: all rows with their class, one row of metrics, reasons of false positives, skip counts, new verdicts."""

    details: DataFrame
    summary: DataFrame
    patterns: DataFrame
    skipped_languages: DataFrame
    skipped_severities: DataFrame
    verdicts: DataFrame


def audit(alerts: DataFrame, judged: DataFrame, known: DataFrame, calibration: DataFrame, languages: list[str] | None = None, least: str = "", mode: str = "normal", rules: list | None = None) -> Audit:
    """Filters, inherits, excludes, joins the judge's answers, applies the rules, and sums up.

    Inheritance comes before exclusion, so a known fingerprint in a test file is inherited. An alert without an answer fails open.
    """
    kept, lang = routing.language_filter(alerts, routing.alert_language(F.col("sink.file"), F.col("source.file")), languages or [])
    kept, sev = routing.severity_filter(kept, F.col("severity"), least)
    ask, inherited = routing.inheritance(kept, known, mode=mode)
    survivors, excluded = routing.partitioned(routing.exclusion(ask, F.col("source.file"), F.col("is_generated"), F.col("cwe_id")))
    answers = judged.drop("bughash", "vulnerability_type", "severity")
    rows = survivors.drop("exclusion_reason").join(answers, "alert_id", "left")
    rows = rows.withColumns({"fail_reason": F.when(F.col("verdict").isNull(), F.coalesce("fail_reason", F.lit("no_answer"))).otherwise(F.col("fail_reason")), "confidence": F.coalesce("confidence", F.lit(0))}).withColumn("verdict", F.coalesce("verdict", F.lit("uncertain")))
    rows = guards.enforce(rows, rules or [])
    rows = routing.calibrated(rows, "vulnerability_type", calibration)
    inherited = inherited.withColumns({"verdict": F.col("inherited_verdict"), "confidence": F.col("inherited_confidence")}).drop("inherited_verdict", "inherited_confidence")
    everything = summary.union_all(judged=rows, inherited=inherited, excluded=routing.final_excluded(excluded))
    return Audit(everything, summary.summary(rows, inherited, excluded), summary.fp_patterns(rows, "alert_id"), lang, sev, new_verdicts(rows))


def new_verdicts(rows: DataFrame) -> DataFrame:
    """(bughash, verdict, confidence, seq) to keep: true positives, and false positives that need no review."""
    quiet = v.suppressible(F.col("confidence"), F.col("vulnerability_type"), F.col("calibrated"), F.col("type_mismatch_types"), F.col("buried_types"))
    keep = rows.where((F.col("verdict") == "true_positive") | ((F.col("verdict") == "false_positive") & quiet)).withColumn("seq", F.lit(0).cast("long"))
    return history.earliest(keep.select("bughash", "verdict", "confidence", "seq", "alert_id"), ["bughash"], "alert_id").drop("alert_id")


def dependency_scan(results: DataFrame, pol: policy.Policy) -> tuple[dict[str, DataFrame], DataFrame]:
    """Scanner results as tables, and their findings."""
    tables = policy.translate(results)
    return tables, policy.evaluate(pol, tables["components"], tables["vulns"], tables["licenses"])
