"""Alert formats as DataFrames of ``schemas.ALERT``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from alertmill.functions import text as t
from alertmill.functions import vocab as v
from alertmill.operators.graph import preorder

_PHYSICAL = "struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:int>>,message:struct<text:string>>"
SARIF = (
    "runs array<struct<tool:struct<driver:struct<rules:array<struct<id:string,properties:struct<tags:array<string>,`security-severity`:string>,defaultConfiguration:struct<level:string>>>>>,"
    f"results:array<struct<ruleId:string,ruleIndex:int,level:string,locations:array<{_PHYSICAL}>,codeFlows:array<struct<threadFlows:array<struct<locations:array<struct<location:{_PHYSICAL}>>>>>>>>>>"
)


def read_sarif(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SARIF).option("multiLine", "true").json(path)


def location(loc: Column) -> Column:
    """File, line, function and message of a physical location; the function is the first of three phrases in the message."""
    msg = t.text(loc["message"]["text"])
    found = [F.nullif(F.regexp_extract(msg, p, 1), F.lit("")) for p in (r"(?i)in method (\S+)", r"(?i)call to (\S+)", r"(?i)(\S+\([^)]*\))")]
    phys = loc["physicalLocation"]
    return F.struct(t.text(phys["artifactLocation"]["uri"]).alias("file"), F.coalesce(phys["region"]["startLine"], F.lit(0)).alias("line"), F.coalesce(*found, F.lit("")).alias("function"), F.lit("").alias("variable"), msg.alias("message"))


def sarif_alerts(raw: DataFrame, tool: str = "sarif") -> DataFrame:
    """One alert for each non-empty flow of each result of the first run; one at the primary location where there is none."""
    run = raw.select(F.monotonically_increasing_id().alias("doc"), F.get("runs", F.lit(0)).alias("run"))
    rules = run.select("doc", F.posexplode("run.tool.driver.rules").alias("idx", "rule"))
    last = Window.partitionBy("doc", "rule.id").orderBy(F.desc("idx"))
    by_id = rules.withColumn("n", F.row_number().over(last)).where("n = 1").select("doc", F.col("rule.id").alias("ruleId"), F.col("rule").alias("by_id"))
    by_idx = rules.select("doc", F.col("idx").alias("ruleIndex"), F.col("rule").alias("by_idx"))
    res = run.select("doc", F.posexplode("run.results").alias("pos", "res")).select("doc", "pos", "res", t.text(F.col("res.ruleId")).alias("ruleId"), F.col("res.ruleIndex").alias("ruleIndex"))
    res = res.join(by_id, ["doc", "ruleId"], "left").join(by_idx, ["doc", "ruleIndex"], "left").withColumn("rule", F.coalesce("by_id", "by_idx"))
    flows = F.filter(F.transform(F.coalesce("res.codeFlows", F.array()), lambda c: F.get(c["threadFlows"], F.lit(0))["locations"]), lambda x: F.size(x) > 0)
    res = res.withColumn("flows", flows).withColumn("several", F.size("flows") > 1).withColumn("primary", location(F.get("res.locations", F.lit(0))))
    each = res.select("*", F.posexplode_outer("flows").alias("flow_no", "flow"))
    hops = F.transform(F.col("flow"), lambda x: location(x["location"]))
    each = each.withColumn("hops", F.coalesce(hops, F.array().cast(each.select(hops.alias("x")).schema["x"].dataType)))
    full = F.size("hops") > 0
    source = F.when(full, F.get("hops", F.lit(0))).otherwise(F.col("primary"))
    sink = F.when(full, F.element_at("hops", -1)).otherwise(F.col("primary"))
    path = F.transform("hops", lambda h: F.struct(h["file"].alias("file"), h["function"].alias("function"), h["line"].alias("line"), h["message"].alias("message")))
    props = F.col("rule.properties")
    out = each.select(
        "doc", "pos", "flow_no",
        F.concat(F.lit(f"{tool}-"), "ruleId", F.lit("-"), F.col("primary.file"), F.lit(":"), F.col("primary.line").cast("string"), F.when(F.col("several"), F.concat(F.lit("#"), F.col("flow_no").cast("string"))).otherwise("")).alias("alert_id"),
        v.rule_type(F.col("ruleId")).alias("vulnerability_type"),
        v.cwe_of_tags(F.coalesce(props["tags"], F.array().cast("array<string>"))).alias("cwe_id"),
        v.rule_severity(props["security-severity"], F.col("res.level"), F.col("rule.defaultConfiguration.level")).alias("severity"),
        source.alias("source"), sink.alias("sink"), path.alias("taint_path"), full.alias("taint_path_complete"), F.lit(False).alias("is_generated"), F.to_json("res").alias("raw_output"),
    )
    return _with_fingerprint(out.orderBy("doc", "pos", "flow_no").drop("doc", "pos", "flow_no"))


def _with_fingerprint(alerts: DataFrame) -> DataFrame:
    key = t.alert_fingerprint(F.col("vulnerability_type"), F.col("cwe_id"), F.col("source"), F.col("sink"), F.col("taint_path"))
    return alerts.withColumn("bughash", key)


_TRACE = "struct<traceId:string,fatherTraceid:string,kind:int,bugFile:string,codeBeginline:int,codePart:string>"
BUGS = (
    "bugs array<struct<bugId:string,ruleCode:string,ruleName:string,bugLevel:string,ruleVO:struct<refs:array<struct<referenceType:string,referenceTypeId:string>>,level:string>,"
    f"bugFile:string,bugBeginline:int,bugFunc:string,bugTraces:array<{_TRACE}>,traces:array<{_TRACE}>>>"
)


def read_bugs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BUGS).option("multiLine", "true").json(path)


def bug_alerts(raw: DataFrame, slugs: dict[str, str] | None = None, tool: str = "bugs") -> DataFrame:
    """One alert a bug: trace nodes in walk order are the path, the first of kind 2 the source, the bug's own place the sink."""
    bugs = raw.select(F.monotonically_increasing_id().alias("doc"), F.posexplode("bugs").alias("pos", "bug")).select(F.struct("doc", "pos").alias("key"), "bug.*")
    traces = F.when(F.size("bugTraces") > 0, F.col("bugTraces")).otherwise(F.coalesce("traces", F.array().cast(f"array<{_TRACE}>")))
    nodes = bugs.select("key", F.posexplode(traces).alias("ord", "n")).select("key", "ord", t.text(F.col("n.traceId")).alias("node"), t.text(F.col("n.fatherTraceid")).alias("parent"), "n").where("node <> ''")
    walked = preorder(nodes.select("key", "ord", "node", "parent"), "key")
    last = Window.partitionBy("key", "node").orderBy(F.desc("ord"))
    latest = nodes.withColumn("r", F.row_number().over(last)).where("r = 1").select("key", "node", "n")
    ordered = walked.join(latest, ["key", "node"]).groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "n"))), lambda x: x["n"]).alias("order"))
    b = bugs.join(ordered, "key", "left").withColumn("order", F.coalesce("order", F.array().cast(f"array<{_TRACE}>")))
    hop = lambda n: F.struct(t.slashes(n["bugFile"]).alias("file"), F.lit("").alias("function"), F.coalesce(n["codeBeginline"], F.lit(0)).alias("line"), t.text(n["codePart"]).alias("message"))
    place = F.struct(t.slashes(F.col("bugFile")).alias("file"), F.coalesce("bugBeginline", F.lit(0)).alias("line"), t.text(F.col("bugFunc")).alias("function"), F.lit("").alias("variable"), F.lit("").alias("message"))
    start = F.get(F.filter("order", lambda n: n["kind"] == 2), F.lit(0))
    at = lambda n, variable, message: F.struct(t.slashes(n["bugFile"]).alias("file"), F.coalesce(n["codeBeginline"], F.lit(0)).alias("line"), F.lit("").alias("function"), variable.alias("variable"), message.alias("message"))
    head = F.get("order", F.lit(0))
    source = F.when(start.isNotNull(), at(start, t.text(start["codePart"]), F.lit(""))).when(F.size("order") > 0, at(head, F.lit(""), t.text(head["codePart"]))).otherwise(place)
    cwe_ref = F.filter(F.coalesce("ruleVO.refs", F.array().cast("array<struct<referenceType:string,referenceTypeId:string>>")), lambda r: (r["referenceType"] == "CWE") & F.rlike(r["referenceTypeId"], F.lit(r"(?i)^-?\d+$|cwe-?\d+")))
    ref = F.regexp_extract(F.get(cwe_ref, F.lit(0))["referenceTypeId"], r"(\d+)", 1)
    cwe = F.coalesce(F.concat(F.lit("CWE-"), F.nullif(ref, F.lit(""))), v.cwe_in(F.col("ruleCode"), F.col("ruleName")), F.lit("CWE-UNKNOWN"))
    out = b.withColumn("cwe_id", cwe).select(
        F.concat(F.lit(f"{tool}-"), t.text(F.col("bugId")), F.lit("-"), t.text(F.col("bugFile")), F.lit(":"), F.coalesce("bugBeginline", F.lit(0)).cast("string")).alias("alert_id"),
        v.type_of_bug(F.col("cwe_id"), F.col("ruleCode"), F.col("ruleName"), slugs or {}).alias("vulnerability_type"),
        "cwe_id",
        v.bug_severity(F.col("bugLevel"), F.col("ruleVO.level")).alias("severity"),
        source.alias("source"), place.alias("sink"), F.transform("order", hop).alias("taint_path"),
        (F.exists("order", lambda n: n["kind"] == 2) & F.exists("order", lambda n: n["kind"] == 1)).alias("taint_path_complete"),
        F.lit(False).alias("is_generated"), F.to_json(F.struct("bugId", "ruleCode", "ruleName", "bugLevel", "bugFile", "bugBeginline", "bugFunc")).alias("raw_output"),
    )
    return _with_fingerprint(out)


#: Formats by name; a format of one's own is one more function.
FORMATS: dict[str, Callable[[DataFrame], DataFrame]] = {"sarif": sarif_alerts, "bugs": bug_alerts}


def parse(name: str, raw: DataFrame) -> DataFrame:
    if name not in FORMATS:
        raise ValueError(f"unknown alert format {name!r}; known: {sorted(FORMATS)}")
    return FORMATS[name](raw)


def normalized(alerts: DataFrame) -> DataFrame:
    """Function names without parameter lists, in both ends and every hop."""
    cut = lambda s: s.withField("function", F.substring_index(t.text(s["function"]), "(", 1))
    return alerts.withColumns({"source": cut(F.col("source")), "sink": cut(F.col("sink")), "taint_path": F.transform("taint_path", cut)})


# ---- project, task and bug listings of a scanning service ----

PAGED = "totalCount int, list array<struct<bugId:string,level:int,ruleCode:string,ruleName:string>>"


def bug_listing(pages: DataFrame, levels: list[int] | None = None, rules: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Rows of listing pages (page, body): page order, first row of a bug, wanted levels and rules, at most ``limit``."""
    rows = pages.select("page", F.from_json("body", PAGED).alias("b")).select("page", F.posexplode("b.list").alias("pos", "r")).select("page", "pos", "r.*").where("bugId is not null and bugId <> ''")
    first = Window.partitionBy("bugId").orderBy("page", "pos")
    rows = rows.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")
    if levels:
        rows = rows.where(F.col("level").isin(*levels))
    if rules:
        rows = rows.where(F.col("ruleCode").isin(*rules))
    rows = rows.orderBy("page", "pos")
    return (rows.limit(limit) if limit else rows).select("bugId", "level", "ruleCode", "ruleName")


def nested_listing(bodies: DataFrame, outer: str, inner: str, schema: str, key: str) -> DataFrame:
    """Projects with their tasks (or tasks with their bugs) flattened to rows; rows without a key go, a missing count is the number of rows."""
    parsed = bodies.select(F.from_json("body", schema).alias("b")).select(F.explode(f"b.{outer}").alias("o"))
    rows = parsed.select(F.col("o"), F.explode(f"o.{inner}").alias("i")).select("o.*", "i.*").drop(inner)
    return rows.na.drop(subset=[key])
