"""Steps of a narrative matched to hops of a trace."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alertmill.operators.graph import cut, tasks_for


def candidates(steps: DataFrame, hops: DataFrame) -> DataFrame:
    """(alert_id, step, hop, rank): pairs that meet by citation, by file and name, by file alone or by name alone, the best of these.

    Ranks order an alert's pairs: how they meet, the step, tainted hops first, the hop.
    """
    s, h = steps.select("alert_id", "step", "cited", F.col("file").alias("s_file"), F.col("name").alias("s_name")), hops.select("alert_id", "hop", F.col("file").alias("h_file"), F.col("name").alias("h_name"), F.coalesce("tainted", F.lit(False)).alias("tainted"))
    ways = ((F.col("cited") == F.col("hop"), None), (F.col("s_file") == F.col("h_file"), "s_file"), (F.col("s_name") == F.col("h_name"), "s_name"))
    file, name = ((F.coalesce((F.col(f"s_{x}") == F.col(f"h_{x}")) & (F.col(f"s_{x}") != ""), F.lit(False))) for x in ("file", "name"))
    tier = F.when(F.col("cited") == F.col("hop"), 0).when(file & name, 1).when(file, 2).otherwise(3)
    # all that follows stays inside an alert, so steps and hops are dealt by it once
    tasks = tasks_for(steps, hops)
    s, h = s.repartition(tasks, "alert_id"), h.withColumnRenamed("alert_id", "h_alert").repartition(tasks, "h_alert")
    rows = None
    for meet, filled in ways:
        one = s.where(F.col(filled) != "") if filled else s.where("cited is not null")
        pairs = one.join(h.hint("merge"), (F.col("alert_id") == F.col("h_alert")) & meet).select("alert_id", "step", "hop", F.struct(tier.alias("tier"), "step", (~F.col("tainted")).alias("clean"), "hop").alias("rank"))
        rows = pairs if rows is None else rows.unionByName(pairs)
    return rows.groupBy("alert_id", "step", "hop").agg(F.min("rank").alias("rank"))


def match_steps(steps: DataFrame, hops: DataFrame) -> DataFrame:
    """(alert_id, step, hop): each step and each hop at most once, as if pairs were taken in the order of their ranks.

    ``steps`` (alert_id, step, cited, file, name), ``hops`` (alert_id, hop, file, name, tainted). In each round every step names
    its best hop and every hop its best step; those that name each other are a match, which no later pair can undo, and leave.
    """
    live, found = cut(candidates(steps, hops)), []
    over = lambda f, c, by: f(c).over(Window.partitionBy("alert_id", by))
    while True:
        # one shuffle a round, by alert: the windows of its steps and hops need no other
        near = live.repartition(tasks_for(live), "alert_id").withColumns({"of_step": over(F.min, "rank", "step"), "of_hop": over(F.min, "rank", "hop")})
        near = near.withColumn("met", F.col("rank").eqNullSafe(F.col("of_step")) & F.col("rank").eqNullSafe(F.col("of_hop")))
        near = near.withColumns({"step_gone": over(F.max, "met", "step"), "hop_gone": over(F.max, "met", "hop")}).where("met or not (step_gone or hop_gone)")
        left = cut(near.select("alert_id", "step", "hop", "rank", "met"))
        found.append(left.where("met").select("alert_id", "step", "hop"))
        live = left.where("not met").drop("met")
        if live.isEmpty():
            break
    out = found[0]
    for pairs in found[1:]:
        out = out.unionByName(pairs)
    return out
