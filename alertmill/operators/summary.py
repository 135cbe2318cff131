"""Run summaries: conditional counts, first reasons, funnel, gates, cubes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertmill.functions import text as t
from alertmill.functions import vocab as v


def _some(c: str) -> Column:
    return F.coalesce(F.size(c), F.lit(0)) > 0


def summary(judged: DataFrame, inherited: DataFrame, excluded: DataFrame) -> DataFrame:
    """One row of run metrics. ``judged`` has a boolean ``calibrated``."""
    quiet = v.suppressible(F.col("confidence"), F.col("vulnerability_type"), F.col("calibrated"), F.col("type_mismatch_types"), F.col("buried_types"))
    fp = F.col("verdict") == "false_positive"
    mutex = F.coalesce("control_flow_mutex", F.lit(False))
    fp0, other = F.coalesce(fp, F.lit(False)), ~F.coalesce(F.col("verdict").isin("false_positive", "true_positive"), F.lit(False))
    empty = F.array().cast("array<string>")
    one = judged.agg(
        F.count("*").alias("ai_processed"),
        F.count_if(fp0).alias("ai_false_positives"),
        F.count_if(F.col("verdict") == "true_positive").alias("ai_true_positives"),
        F.count_if(other).alias("ai_uncertain"),
        F.count_if(fp0 & quiet).alias("auto_suppressed"),
        F.count_if(other | (fp0 & ~quiet)).alias("human_review_needed"),
        F.count_if(t.text(F.col("fail_reason")).startswith("empty_slice:")).alias("blind_alerts"),
        F.count_if(_some("type_mismatch_types")).alias("type_mismatches"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce("type_mismatch_types", empty))))).alias("type_mismatch_types"),
        F.count_if(_some("buried_types")).alias("buried_count"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce("buried_types", empty))))).alias("buried_types"),
        F.count_if(F.col("verification_action") == "downgraded_to_uncertain").alias("probe_downgrades"),
        F.count_if(F.col("model_used") == "symbolic_cf_prefilter").alias("control_flow_pruned"),
        F.count_if(mutex).alias("mutex_total"),
        F.count_if(mutex & fp0).alias("mutex_agreed_fp"),
        F.count_if(mutex & ~fp0).alias("mutex_overridden"),
    )
    n = lambda df, name: df.agg(F.count("*").alias(name))
    return one.join(n(inherited, "bughash_inherited"), F.lit(True)).join(n(excluded, "hard_excluded"), F.lit(True)).withColumn("sast_in", F.col("ai_processed") + F.col("bughash_inherited") + F.col("hard_excluded"))


def counts_by(df: DataFrame, column: str) -> DataFrame:
    """Rows of each value that is not null."""
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("rows"))


def fp_patterns(judged: DataFrame, order: str, first: int = 5) -> DataFrame:
    """(vulnerability_type, count, reasons): what looks like a false positive, with the first distinct reasons in the order of ``order``."""
    disp = t.text(F.col("disposition"))
    like = disp.isin("false_positive", "likely_fp") | ((disp == "") & (F.col("verdict") == "false_positive"))
    kind = F.coalesce(F.nullif(t.text(F.col("vulnerability_type")), F.lit("")), F.lit("unknown"))
    why = F.when(t.text(F.col("path_broken_at")) != "", F.col("path_broken_at")).otherwise(F.col("sanitization_found"))
    rows = judged.where(like).select(kind.alias("kind"), F.nullif(t.text(why), F.lit("")).alias("why"), F.col(order).alias("ord"))
    return first_reasons(rows, first).withColumnRenamed("kind", "vulnerability_type")


def first_reasons(rows: DataFrame, first: int = 5) -> DataFrame:
    """(kind, count, reasons) from (kind, why, ord): the first distinct reasons of each kind, in the order of their first mention."""
    counts = rows.groupBy("kind").agg(F.count("*").alias("count"))
    seen = rows.where("why is not null").groupBy("kind", "why").agg(F.min("ord").alias("ord"))
    w = Window.partitionBy("kind").orderBy("ord", "why")
    top = seen.withColumn("n", F.row_number().over(w)).where(F.col("n") <= first)
    lists = top.groupBy("kind").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "why"))), lambda x: x["why"]).alias("reasons"))
    return counts.join(lists, "kind", "left").withColumn("reasons", F.coalesce("reasons", F.array().cast("array<string>")))


def funnel(stages: DataFrame) -> DataFrame:
    """(stage, rows) of rows that carry their stage."""
    return stages.groupBy("stage").agg(F.count("*").alias("rows"))


def union_all(**classes: DataFrame) -> DataFrame:
    """All classes of rows in the order given; ``ord`` keeps it, ``stage`` names the class."""
    out = None
    for i, (name, df) in enumerate(classes.items()):
        one = df.withColumns({"ord": F.lit(i), "stage": F.lit(name)})
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def type_level_cube(bugs: DataFrame, level: str, rule: str, name: str, pos: str) -> DataFrame:
    """(level, rule, name, rows): counts by level and rule, by level, and over all; a null marks what is summed over, the name is the first that is not null.

    Bugs without a level count in the total and in the rule rows of the null level; ``grain`` says which row is which.
    """
    rows = bugs.select(F.col(level).alias("level"), F.col(rule).alias("rule"), F.struct(F.col(pos).alias("p"), F.col(name).alias("n")).alias("x"), F.col(name).alias("n"))
    named = F.min(F.when(F.col("n").isNotNull(), F.col("x")))["n"]
    out = rows.groupingSets([["level", "rule"], ["level"], []], "level", "rule").agg(F.count("*").alias("rows"), named.alias("name"), F.grouping_id("level", "rule").alias("g"))
    grain = F.when(F.col("g") == 0, "rule").when(F.col("g") == 1, "level").otherwise("total")
    return out.select(grain.alias("grain"), "level", "rule", F.when(F.col("g") == 0, F.col("name")).alias("name"), "rows").orderBy("grain", "level", F.desc("rows"), "rule")


def discovery(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Findings without false positives, and counts by disposition and severity with the dropped in them."""
    return rows.where("verdict <> 'false_positive'"), rows.groupBy("disposition", "severity").agg(F.count("*").alias("rows"))


def gate(details: DataFrame) -> DataFrame:
    """One row: whether open verdicts block, and what is confirmed. ``details`` carries label and label_status of the latest label."""
    live = details.where(t.text(F.col("exclusion_reason")) == "")
    label = t.text(F.col("label"))
    open_ = F.col("verdict").isin("true_positive", "uncertain") & label.isin("", "uncertain")
    push = label.isin("true_positive", "needs-hardening")
    return live.agg(
        F.coalesce(F.bool_or(open_), F.lit(False)).alias("blocked"),
        F.count_if(open_).alias("blocking_count"),
        F.count_if(label == "true_positive").alias("confirmed_tp"),
        F.count_if((label == "false_positive") | ((label == "") & (F.col("verdict") == "false_positive"))).alias("confirmed_fp"),
        F.count_if(label == "needs-hardening").alias("confirmed_hardening"),
        F.count_if((label != "") & (F.col("label_status") == "confirmed")).alias("confirmed_count"),
        F.count_if(push).alias("to_push"),
        F.coalesce(F.max_by(F.when(push & v.lookup({"critical": 4, "high": 3, "medium": 2, "low": 1}, F.col("severity")).isNotNull(), F.col("severity")), F.when(push, v.lookup({"critical": 4, "high": 3, "medium": 2, "low": 1}, F.col("severity")))), F.lit("")).alias("max_severity"),
    )


def primary(rows: DataFrame, *keys: str, severity: str = "severity", pos: str = "pos") -> DataFrame:
    """The row of highest severity of each group, the first on a tie."""
    best = F.max_by(F.struct(*rows.columns), F.struct(v.severity_rank(F.col(severity), -1), -F.col(pos)))
    return rows.groupBy(*keys).agg(best.alias("row")).select("row.*") if keys else rows.agg(best.alias("row")).select("row.*")


def unlabelled(details: DataFrame) -> DataFrame:
    """How many different fingerprints have neither label nor exclusion."""
    return details.agg(F.count_distinct(F.when(F.col("label").isNull() & (t.text(F.col("exclusion_reason")) == ""), t.text(F.col("bughash")))).alias("unlabelled"))


def function_profile(methods: DataFrame, callers: DataFrame, callees: DataFrame, taints: DataFrame) -> DataFrame:
    """Each method with the numbers of its call sites, callees and taints, and whether its name is ambiguous."""
    n = lambda df, key, cols, name: df.select(F.col(key).alias("method_key"), *cols).distinct().groupBy("method_key").agg(F.count("*").alias(name))
    out = methods.join(n(callers, "callee_key", ["caller_key", "line", "file_path"], "callers"), "method_key", "left").join(n(callees, "caller_key", ["callee_class", "callee_method"], "callees"), "method_key", "left").join(n(taints, "location_key", ["source_method"], "taints"), "method_key", "left")
    same = methods.groupBy(t.pattern_of(F.col("method_key")).alias("pattern")).agg((F.count("*") > 1).alias("ambiguous"))
    return out.na.fill(0, ["callers", "callees", "taints"]).withColumn("pattern", t.pattern_of(F.col("method_key"))).join(same, "pattern").drop("pattern")


def breakpoints(edges: DataFrame, candidates: DataFrame) -> DataFrame:
    """Unresolved calls of a method by callee: lines, the last call type that is named, candidates; with candidates an unresolved call is one to an interface."""
    rows = edges.where(~F.coalesce("resolved", F.lit(False)))
    kind = F.max_by(F.col("call_type"), F.when(t.text(F.col("call_type")) != "", F.col("line")))
    g = rows.groupBy("caller_key", "callee_class", "callee_method").agg(F.array_sort(F.collect_set("line")).alias("lines"), F.coalesce(kind, F.lit("unresolved")).alias("call_type"))
    c = candidates.groupBy(F.col("iface").alias("callee_class"), F.col("method").alias("callee_method")).agg(F.array_sort(F.collect_set("method_key")).alias("candidates"))
    out = g.join(c, ["callee_class", "callee_method"], "left").withColumn("candidates", F.coalesce("candidates", F.array().cast("array<string>")))
    return out.withColumn("call_type", F.when((F.col("call_type") == "unresolved") & (F.size("candidates") > 0), "interface").otherwise(F.col("call_type")))
