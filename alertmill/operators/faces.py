"""Faces: what siblings of the same class and shape were found to have, and this alert was not asked about."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertmill.functions import text as t
from alertmill.functions.vocab import family


@dataclass(frozen=True)
class Grouping:
    """A fact that siblings share: its name, the expression of its shape (empty where the fact is missing), and the families it can tell."""

    name: str
    shape: Column
    inferable: tuple[str, ...]


def authz_shape() -> Column:
    """Shape of authorisation facts: both guards and the global interceptor, empty without facts."""
    bit = lambda c: F.when(F.coalesce(F.col(c), F.lit(False)), "1").otherwise("0")
    return F.when(F.col("authz").isNull(), "").otherwise(F.concat(bit("authz.method_guard"), bit("authz.class_guard"), F.lit("|"), t.text(F.col("authz.global_interceptor"))))


def class_in(alert_id: Column) -> Column:
    return F.regexp_extract(t.text(alert_id), r"([A-Za-z_][A-Za-z0-9_]*)\.java:", 1)


def sibling_faces(alerts: DataFrame, grouping: Grouping, history: DataFrame | None = None, group: Column | None = None) -> DataFrame:
    """(bughash, family, flag, counterpart, siblings): faces for members that are no true positives of groups of two or more.

    ``alerts`` has (pos, bughash, alert_id, verdict, actual_types) and what the shape needs. A face goes to a member that has
    not named it itself; the counterpart is the group's first other confirmed member. A member whose own history holds the face
    gets the regression flag instead. Members meet only through one row for each group and family, so no group is paired with itself.
    """
    cls = class_in(F.col("alert_id")) if group is None else group
    rows = alerts.select("pos", "bughash", "verdict", F.coalesce("actual_types", F.array().cast("array<string>")).alias("types"), cls.alias("cls"), grouping.shape.alias("shape")).where("cls <> '' and shape <> ''")
    rows = rows.withColumn("own", F.array_distinct(F.transform("types", family)))
    big = rows.groupBy("cls", "shape").agg(F.count("*").alias("n")).where("n >= 2").select("cls", "shape")
    rows = rows.join(big, ["cls", "shape"], "left_semi")
    named = rows.where("verdict = 'true_positive'").select("cls", "shape", "pos", "bughash", F.explode("own").alias("family"))
    past = None
    if history is not None:
        past = rows.select("cls", "shape", "pos", "bughash").join(history.where(F.col("family").isin(*grouping.inferable)), "bughash").select("cls", "shape", "pos", "bughash", "family")
        named = named.unionByName(past)
    named = named.where("family <> ''").groupBy("cls", "shape", "family", "bughash").agg(F.min("pos").alias("pos"))
    # the first two places are all a counterpart needs: one of them is another alert
    ranked = F.array_sort(F.collect_list(F.struct("pos", "bughash")))
    from alertmill.operators.graph import top_per_group

    two = top_per_group(named, ["cls", "shape", "family"], [F.asc("pos"), F.asc("bughash")], 2).groupBy("cls", "shape", "family").agg(ranked.alias("firsts"))
    size = named.groupBy("cls", "shape", "family").agg(F.count("*").alias("siblings"))
    judged = two.join(size, ["cls", "shape", "family"]).where(F.col("family").isin(*grouping.inferable))
    out = rows.where("verdict <> 'true_positive'").join(judged, ["cls", "shape"]).where(~F.array_contains("own", F.col("family")))
    if past is not None:
        mine = past.select("bughash", "family").distinct().withColumn("again", F.lit(True))
        out = out.join(mine, ["bughash", "family"], "left")
    else:
        out = out.withColumn("again", F.lit(None).cast("boolean"))
    other = F.get(F.filter("firsts", lambda x: x["bughash"] != F.col("bughash")), F.lit(0))["bughash"]
    again = F.coalesce("again", F.lit(False))
    return out.select("bughash", "family", F.when(again, "regressed_from_history").otherwise("inconsistent_within_run").alias("flag"), F.when(~again, other).alias("counterpart"), "siblings").where("counterpart is not null or flag = 'regressed_from_history'")
