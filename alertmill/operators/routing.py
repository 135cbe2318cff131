"""The funnel: filters with skip counts, inheritance, exclusion, resume, and the splits that follow a verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertmill.functions import text as t
from alertmill.functions import vocab as v


def alert_language(sink_file: Column, source_file: Column) -> Column:
    """Extension of the sink's file, of the source's where the sink has none."""
    return t.extension(F.when(t.text(sink_file) != "", sink_file).otherwise(source_file))


def language_filter(df: DataFrame, language: Column, allowed: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows in an allowed language or in none that is known, and (language, skipped) of the others. No list, or ``*`` in it, filters nothing."""
    lang = F.lower(t.text(language))
    wanted = [a.strip().lower() for a in allowed]
    keep = F.lit(True) if not wanted or "*" in wanted else (lang == "") | lang.isin(*wanted)
    return df.where(keep), df.where(~keep).groupBy(lang.alias("language")).agg(F.count("*").alias("skipped"))


def severity_filter(df: DataFrame, severity: Column, least: str) -> tuple[DataFrame, DataFrame]:
    """Rows of at least this severity or of an unknown one, and (severity, skipped) of the others. An unknown threshold filters nothing."""
    rank = v.SEVERITY_RANK.get((least or "").strip().lower())
    keep = F.lit(True) if rank is None else F.coalesce(v.severity_rank(severity) >= rank, F.lit(True))
    return df.where(keep), df.where(~keep).groupBy(F.lower(F.trim(t.text(severity))).alias("severity")).agg(F.count("*").alias("skipped"))


def exclusion(df: DataFrame, path: Column, generated: Column, cwe: Column) -> DataFrame:
    """``df`` with ``exclusion_reason``, null for survivors."""
    return df.withColumn("exclusion_reason", v.exclusion_reason(path, generated, cwe))


def partitioned(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Survivors, and the excluded with the verdict ``false_positive`` that ``final_excluded`` takes back."""
    return df.where("exclusion_reason is null"), df.where("exclusion_reason is not null").withColumn("verdict", F.lit("false_positive"))


def final_excluded(excluded: DataFrame) -> DataFrame:
    """Excluded rows as they are reported: uncertain, the reason kept."""
    return excluded.withColumn("verdict", F.lit("uncertain"))


def inheritance(alerts: DataFrame, history: DataFrame, key: str = "bughash", mode: str = "normal") -> tuple[DataFrame, DataFrame]:
    """Alerts to judge, and those whose known verdict (true or false positive) is inherited. In ``experiment`` mode nothing is."""
    if mode == "experiment":
        return alerts, alerts.withColumns({"inherited_verdict": F.lit(None).cast("string"), "inherited_confidence": F.lit(None).cast("int")}).where(F.lit(False))
    known = history.where(F.col("verdict").isin("true_positive", "false_positive")).select(key, F.col("verdict").alias("inherited_verdict"), F.col("confidence").alias("inherited_confidence"))
    both = alerts.join(known, key, "left")
    return both.where("inherited_verdict is null").select(*alerts.columns), both.where("inherited_verdict is not null")


def resume(alerts: DataFrame, done: DataFrame, key: str = "alert_id") -> DataFrame:
    """Alerts without a finished judgement; one that failed does not count as finished."""
    finished = done.where(t.text(F.col("fail_reason")) == "").select(key).distinct()
    return alerts.join(finished, key, "left_anti")


def fail_open(alerts: DataFrame, reason: Column, model: str) -> DataFrame:
    """Rows whose judge failed, as uncertain with confidence 0."""
    return alerts.withColumns({"verdict": F.lit("uncertain"), "confidence": F.lit(0), "fail_reason": reason, "model_used": F.lit(model)})


def calibrated(df: DataFrame, kind: str, registry: DataFrame) -> DataFrame:
    """``df`` with ``calibrated``: the first registry row (vulnerability_type, calibrated, pos) for the type, any case; false without one."""
    first = registry.groupBy(F.lower("vulnerability_type").alias("_kind")).agg(F.min_by("calibrated", "pos").alias("calibrated"))
    return df.withColumn("_kind", F.lower(t.text(F.col(kind)))).join(F.broadcast(first), "_kind", "left").drop("_kind").withColumn("calibrated", F.coalesce("calibrated", F.lit(False)))


def confirmed(verdict: Column) -> Column:
    return verdict == "true_positive"


def suspected(verdict: Column, disposition: Column, action: Column) -> Column:
    """Uncertain by verdict, likely by disposition, and not because a check took it down."""
    return (verdict == "uncertain") & (disposition == "likely_tp") & (t.text(action) != "downgraded_to_uncertain")


def environment_exemption(df: DataFrame, exempt: list[str], forced: list[str], public: bool) -> tuple[DataFrame, DataFrame]:
    """Kept and exempted rows: in an application that is not public, true positives of exempt types are exempted. Those that are
    forced are kept all the same, and recorded among the exempted as ``forced``."""
    if public or not exempt:
        return df, df.where(F.lit(False)).withColumn("forced", F.lit(False))
    held = (F.col("verdict") == "true_positive") & F.substring_index(t.text(F.col("vulnerability_type")), ":", 1).isin(*exempt)
    held, forces = F.coalesce(held, F.lit(False)), F.coalesce(F.col("bughash").isin(*forced), F.lit(False))
    return df.where(~held | forces), df.where(held).withColumn("forced", forces)


def selected(details: DataFrame, keys: DataFrame) -> DataFrame:
    """The details with a chosen fingerprint, excluded rows left out."""
    return details.where(t.text(F.col("exclusion_reason")) == "").join(keys.select("bughash").distinct(), "bughash", "left_semi")


def selection_counts(rows: DataFrame) -> DataFrame:
    """True positives, hardening cases and confirmed labels of a selection."""
    return rows.agg(F.count_if(F.col("label") == "true_positive").alias("tp"), F.count_if(F.col("label") == "needs-hardening").alias("hardening"), F.count_if(F.col("label_status") == "confirmed").alias("confirmed"))


# fixed values: annotations that make a method an entry point
CONTROLLERS = ("Controller", "RestController")
CONTROLLER_ADVICE = ("ControllerAdvice", "RestControllerAdvice")
HTTP_MAPPINGS = ("RequestMapping", "GetMapping", "PostMapping", "PutMapping", "DeleteMapping", "PatchMapping")
MESSAGE_LISTENERS = ("RabbitListener", "KafkaListener", "JmsListener", "MessageMapping", "SubscribeMapping")
EVENT_LISTENERS = ("EventListener", "TransactionalEventListener")
ASPECTS = ("Before", "After", "Around", "AfterReturning", "AfterThrowing", "Pointcut")


def entry_point(method_annotations: Column, class_annotations: Column, container: tuple[str, ...] = ("PostConstruct", "PreDestroy")) -> Column:
    """Kind of entry point of a method, the empty string for none, by the first rule that holds."""
    has = lambda col, names: F.arrays_overlap(F.coalesce(col, F.array().cast("array<string>")), F.array(*[F.lit(n) for n in names]))
    m, c = method_annotations, class_annotations
    return (
        F.when(has(m, HTTP_MAPPINGS) & (has(c, CONTROLLERS) | has(m, ("ResponseBody",))), "HTTP")
        .when(has(m, ("ExceptionHandler",)), F.when(has(c, CONTROLLERS + CONTROLLER_ADVICE), "HTTP").otherwise(""))
        .when(has(m, ("Bean",)), "CONTAINER")
        .when(has(m, ("Scheduled",)), "SCHEDULED")
        .when(has(m, MESSAGE_LISTENERS), "MESSAGE_LISTENER")
        .when(has(m, EVENT_LISTENERS), "EVENT_LISTENER")
        .when(has(m, ASPECTS), "")
        .when(has(m, container), "CONTAINER")
        .otherwise("")
    )


def http_path(class_path: Column, method_path: Column) -> Column:
    """Class and method paths joined, slashes single, one at the front, none at the end."""
    joined = F.regexp_replace(F.concat(F.lit("/"), t.text(class_path), F.lit("/"), t.text(method_path)), "/+", "/")
    return F.when(joined == "/", joined).otherwise(F.regexp_replace(joined, "/$", ""))


def reachability_state(definitions: Column, truncated: Column, hits: Column, slice_hits: Column) -> Column:
    """A callee with a definition is ``reachable``; a search that was cut says ``unknown``; of a whole search, hits in files
    outside the slice leave it ``uncertain``, and no hit, or hits (``slice_hits``) in the slice alone, ``unreachable``."""
    outside = F.coalesce(hits, F.lit(0)) - F.coalesce(slice_hits, F.lit(0))
    return F.when(definitions > 0, "reachable").when(truncated, "unknown").when(outside > 0, "uncertain").otherwise("unreachable")


def forward_reachable(definitive: Column, uncertain: Column, truncated: Column) -> Column:
    """What the callees ahead say, as lists: ``unknown`` if any is uncertain or some were cut off, ``anchored`` if all are definitive, else nothing."""
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    return F.when(some(uncertain) | F.coalesce(truncated, F.lit(False)), "unknown").when(some(definitive), "anchored").otherwise("")


def sink_match(calls: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Calls (callee_class, callee_method) with their sink, looked up as class.method, then as the bare method; benign sinks have no type."""
    entries = catalogue.select("key", F.struct("vuln_type", "cwe", "severity", "benign", "source_side").alias("e"))
    keys = [F.concat_ws(".", "callee_class", "callee_method"), F.substring_index("callee_method", ".", -1), F.col("callee_method")]
    out = calls
    for i, k in enumerate(keys):
        out = out.join(F.broadcast(entries.select(F.col("key").alias(f"_k{i}"), F.col("e").alias(f"_e{i}"))), k == F.col(f"_k{i}"), "left")
    hit = F.coalesce("_e0", "_e1", "_e2")
    out = out.withColumn("_s", hit).drop(*[f"_k{i}" for i in range(3)], *[f"_e{i}" for i in range(3)])
    harm = ~F.coalesce("_s.benign", F.lit(True))
    return out.withColumns({"sink_type": F.when(harm, F.col("_s.vuln_type")), "sink_cwe": F.when(harm, F.col("_s.cwe")), "sink_severity": F.col("_s.severity"), "is_benign": F.coalesce("_s.benign", F.lit(False))}).drop("_s")


def catalogue(base: DataFrame, *overrides: DataFrame) -> DataFrame:
    """The catalogue with overrides, later tables winning."""
    out = base.withColumn("_n", F.lit(0))
    for i, o in enumerate(overrides, 1):
        out = out.unionByName(o.withColumn("_n", F.lit(i)))
    cols = [c for c in base.columns if c != "key"]
    return out.groupBy("key").agg(F.max_by(F.struct(*cols), "_n").alias("_e")).select("key", "_e.*")


def dynamic_sinks(calls: DataFrame, mappers: DataFrame, tainted: DataFrame) -> DataFrame:
    """Calls that run SQL put together at run time: mapper statements with concatenation, and query builders whose argument is tainted.

    ``calls`` (caller_key, callee_class, callee_method, line, is_builder), ``mappers`` (namespace, short_class, id, has_concat), ``tainted`` (caller_key, line).
    """
    stmts = mappers.where("has_concat").select(F.col("namespace").alias("callee_class"), F.col("id").alias("callee_method")).union(mappers.where("has_concat").select("short_class", "id")).distinct()
    mapped = calls.join(stmts, ["callee_class", "callee_method"], "left_semi")
    built = calls.where("is_builder").join(tainted.select("caller_key", "line").distinct(), ["caller_key", "line"], "left_semi")
    return mapped.unionByName(built).distinct().withColumns({"sink_type": F.lit("sql_injection"), "sink_cwe": F.lit("CWE-89")})


def candidate_callees(hops: DataFrame, stop: list[str]) -> DataFrame:
    """(key, name, pos): names called in the code of hops (key, pos, code), the first mention of each, stop words left out."""
    names = hops.select("key", "pos", F.posexplode(F.expr(r"regexp_extract_all(coalesce(code, ''), '\\b([A-Za-z_][A-Za-z0-9_]*)\\s*\\(', 1)")).alias("at", "name"))
    return names.where(~F.col("name").isin(*stop) if stop else F.lit(True)).groupBy("key", "name").agg(F.min(F.struct("pos", "at")).alias("first")).select("key", "name", F.col("first.pos").alias("pos"))


# fixed values: parts of names that clean a value, and names too common to follow
SANITIZER_PARTS = ("sanitize", "filter", "escape", "validate", "encode", "clean", "safe", "check")
NOISE = ("toString", "equals", "hashCode", "valueOf", "get", "set", "size", "length", "isEmpty", "add", "put", "append", "format", "println", "print")


def sanitizer_name(name: Column, parts: tuple[str, ...] = SANITIZER_PARTS) -> Column:
    low, out = F.lower(t.text(name)), F.lit(False)
    for p in parts:
        out = out | F.contains(low, F.lit(p))
    return out


def noise_name(name: Column) -> Column:
    """Whether a callee, its signature aside, is too common to follow."""
    return F.substring_index(t.text(name), "(", 1).isin(*NOISE)


def gate(taint: Column, args: Column, tier: Column, least: int) -> Column:
    """Whether a call is followed: its tier is high enough, or a tainted name stands in its arguments."""
    return (tier >= least) | F.exists(taint, lambda x: t.whole_word(x, args))
