"""Stability of judgements over repeated runs: verdict sets, sequences, chains, coverage signals."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alertmill.functions.vocab import family


def wobble(cells: DataFrame) -> DataFrame:
    """(alert_id, verdicts, wobbles, same_families): the verdicts that runs without errors gave, and whether all found the same families."""
    good = cells.where("error is null")
    fam = F.array_join(F.array_sort(F.array_distinct(F.transform(F.coalesce("actual_types", F.array().cast("array<string>")), family))), "+")
    return good.groupBy("alert_id").agg(F.array_sort(F.collect_set("verdict")).alias("verdicts"), (F.count_distinct("verdict") > 1).alias("wobbles"), (F.count_distinct(fam) <= 1).alias("same_families"))


def common_length(x: list, y: list) -> int:
    """Length of the longest common subsequence, all of a row at once: a bit for each element of ``x``, cleared where the length grows."""
    at: dict = {}
    for i, e in enumerate(x):
        at[e] = at.get(e, 0) | 1 << i
    full = (1 << len(x)) - 1
    row = full
    for e in y:
        hit = row & at.get(e, 0)
        row = (row + hit | row - hit) & full
    return len(x) - row.bit_count()


@F.pandas_udf(T.DoubleType())
def lcs_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Length of the longest common subsequence over the longer length; 1 for two empty sequences."""

    def one(x, y):
        x, y = list(x), list(y)
        return common_length(x, y) / max(len(x), len(y)) if x or y else 1.0

    return pd.Series([one(x, y) for x, y in zip(a, b)])


def common_prefix(a: str, b: str):
    """Length of the common prefix of two array columns."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    return F.aggregate(same, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, e: F.struct((s["n"] + F.when(s["on"] & e, 1).otherwise(0)).alias("n"), (s["on"] & e).alias("on")), lambda s: s["n"])


def sequence_stability(cells: DataFrame) -> DataFrame:
    """(alert_id, min_ratio, prefix, forks): the least ratio over pairs of runs, the common prefix of the first two, and whether they part at once. ``cells`` has (alert_id, run, seq)."""
    a = cells.select("alert_id", F.col("run").alias("r1"), F.col("seq").alias("a"))
    b = cells.select("alert_id", F.col("run").alias("r2"), F.col("seq").alias("b"))
    pairs = a.join(b, "alert_id").where("r1 < r2").withColumns({"ratio": lcs_ratio("a", "b"), "prefix": common_prefix("a", "b")})
    out = pairs.groupBy("alert_id").agg(F.min("ratio").alias("min_ratio"), F.min_by("prefix", F.struct("r1", "r2")).alias("prefix"))
    return out.withColumn("forks", F.col("prefix") <= 1)


def longest_run(steps: DataFrame, key: str, order: str, what: str, value: str) -> DataFrame:
    """(key, longest): the longest run of ``value`` in the order of ``order``, 0 without one."""
    w = Window.partitionBy(key).orderBy(order)
    rows = steps.withColumn("_i", F.row_number().over(w)).withColumn("_hit", F.coalesce(F.col(what) == value, F.lit(False)))
    isles = rows.where("_hit").withColumn("_g", F.col("_i") - F.row_number().over(w)).groupBy(key, "_g").agg(F.count("*").alias("n"))
    return rows.select(key).distinct().join(isles.groupBy(key).agg(F.max("n").alias("longest")), key, "left").na.fill(0, ["longest"])


def chain_length(calls: DataFrame, key: str, order: str, name: str, result: str) -> DataFrame:
    """(key, chain, cut): the longest run of calls each named in the result before it (0 without a pair), and whether a result in a run was nearly full."""
    w = Window.partitionBy(key).orderBy(order)
    rows = calls.withColumn("_prev", F.lag(result).over(w)).withColumn("_link", F.coalesce(F.contains("_prev", F.col(name)), F.lit(False)))
    rows = rows.withColumn("_g", F.sum(F.when(F.col("_link"), 0).otherwise(1)).over(w))
    runs = rows.groupBy(key, "_g").agg(F.count("*").alias("n"), F.bool_or(F.col("_link") & (F.length("_prev") >= 490)).alias("cut"))
    return runs.groupBy(key).agg(F.max(F.when(F.col("n") >= 2, F.col("n")).otherwise(0)).alias("chain"), F.coalesce(F.bool_or("cut"), F.lit(False)).alias("cut"))


def bypass(longest: DataFrame, chains: DataFrame, key: str) -> DataFrame:
    """(key, bypass): three searches in a row, or a chain of two, do by hand what a graph query does."""
    j = longest.join(chains, key, "full").na.fill(0, ["longest", "chain"])
    return j.select(key, ((F.col("longest") >= 3) | (F.col("chain") >= 2)).alias("bypass"), "longest", "chain")


def signals(cells: DataFrame, flags: list[str], metrics: list[str], lists: list[str]) -> DataFrame:
    """Roll-up by alert: any of the flags, the greatest of the metrics, the distinct entries of the lists."""
    aggs = [F.coalesce(F.bool_or(f), F.lit(False)).alias(f) for f in flags] + [F.max(m).alias(m) for m in metrics] + [F.array_sort(F.array_distinct(F.flatten(F.collect_list(x)))).alias(x) for x in lists]
    return cells.groupBy("alert_id").agg(*aggs)


# fixed values: phrases of uncertainty, of negation, and of each category
UNCERTAIN = r"(?:无法|不能|未能|难以|没法)(?:确定|验证|排除|判断|确认|得出|断定)|不清楚|不确定|未知|存疑"
NEGATED = r"无|未|没有|不|缺乏|缺少|未经|未做|无任何"
CATEGORIES = {
    "who_calls": r"(?i)调用方|谁调|谁在调|谁调用|caller|who calls|call site|invoked by",
    "list_breakpoints": r"(?i)分支|分叉|不同路径|if\s*\{|switch|breakpoint|条件分支",
    "has_sanitizer": r"(?i)sanitize|sanitise|escape|encode|过滤|净化|转义|消毒|白名单|安全措施|magic|content-type",
    "field_query": r"(?i)set[A-Z]\w+|\.\s*set\s*\(|字段|field\s+assignment|赋值|\w+\s*\.\s*\w+\s*=\s*",
}


def uncertain_categories(texts: pd.Series, window: int = 80, back: int = 10) -> pd.Series:
    """For each text the categories mentioned within ``window`` bytes after a phrase of uncertainty and not negated in the ``back`` bytes before."""
    import re

    unsure, negated = re.compile(UNCERTAIN.encode()), re.compile(NEGATED.encode())
    cats = {k: re.compile(p.encode()) for k, p in CATEGORIES.items()}

    def one(x):
        data = (x or "").encode()
        ends = [m.end() for m in unsure.finditer(data)]
        out = []
        for name, p in cats.items():
            hits = [m.span() for m in p.finditer(data)]
            if any(a >= u and z <= u + window and not (a > 0 and negated.search(data[max(0, a - back) : a])) for u in ends for a, z in hits):
                out.append(name)
        return out

    return pd.Series([one(x) for x in texts])


@F.pandas_udf(T.ArrayType(T.StringType()))
def coverage_gaps(texts: pd.Series) -> pd.Series:
    return uncertain_categories(texts)
