"""Rules over judgement rows, in order; each sees what the ones before it decided.

A judgement has verdict, disposition, confidence, actual_types, type_mismatch_types, fail_reason, exploit_payload,
decisive_checks; its slice adds declared (type), decisive_facts (map), and whatever a rule names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertmill.functions import text as t
from alertmill.functions.vocab import verdict_of

_c = F.col


def _lower(a: str) -> Column:
    return F.transform(F.coalesce(a, F.array().cast("array<string>")), lambda x: F.lower(x))


def _when(df: DataFrame, hit: Column, **new: Column) -> DataFrame:
    hit = F.coalesce(hit, F.lit(False))
    cols = dict.fromkeys(df.columns)
    return df.withColumn("_hit", hit).withColumns({k: F.when(_c("_hit"), x).otherwise(_c(k)) if k in cols else F.when(_c("_hit"), x) for k, x in new.items()}).drop("_hit")


def _likely(df: DataFrame, hit: Column, reason: Column | str) -> DataFrame:
    reason = F.lit(reason) if isinstance(reason, str) else reason
    return _when(df, hit, disposition=F.lit("likely_tp"), verdict=verdict_of(F.lit("likely_tp")), confidence=F.lit(6), fail_reason=reason)


def _uncertain(df: DataFrame, hit: Column, reason: Column) -> DataFrame:
    return _when(df, hit, verdict=F.lit("uncertain"), confidence=F.least("confidence", F.lit(4)), fail_reason=reason)


def decisive_fact_known(df: DataFrame, required: DataFrame | None = None) -> DataFrame:
    """A verdict that rests on an unknown fact is uncertain. ``required`` (vulnerability_type, facts) or a column required_facts names the facts."""
    if required is not None:
        rows = required.select(F.lower("vulnerability_type").alias("_t"), F.transform("facts", lambda x: F.trim(F.lower(x))).alias("_f"))
        need = F.broadcast(rows)
        kinds = F.array_distinct(F.concat(F.array(F.lower(t.text(_c("declared")))), _lower("actual_types")))
        df = df.withColumn("_id", F.monotonically_increasing_id())
        got = df.select("_id", F.posexplode(kinds).alias("_p", "_t")).join(need, "_t").groupBy("_id").agg(F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_f"))), lambda x: x["_f"]))).alias("required_facts"))
        df = df.join(got, "_id", "left").drop("_id")
    unknown = F.filter(F.coalesce("required_facts", F.array().cast("array<string>")), lambda f: (f != "") & (F.try_element_at("decisive_facts", f) == "unknown"))
    return _uncertain(df, (_c("verdict") != "uncertain") & (F.size(unknown) > 0), F.concat(F.lit("decisive_fact_unknown:"), F.array_join(unknown, ",")))


def no_bare_fp(df: DataFrame) -> DataFrame:
    """A false positive that names another loaded type is uncertain."""
    out = F.concat(F.array(F.lower(t.text(_c("declared")))), _lower("type_mismatch_types"))
    other = F.filter(F.coalesce("actual_types", F.array().cast("array<string>")), lambda x: ~F.array_contains(out, F.lower(x)))
    return _uncertain(df, (_c("verdict") == "false_positive") & (F.size(other) > 0), F.concat(F.lit("bare_fp_buries_actual:"), F.array_join(other, ",")))


def parameterized_sql(df: DataFrame) -> DataFrame:
    """A true positive of SQL injection alone, where values are bound as parameters, is only likely."""
    types = _lower("actual_types")
    hit = (_c("verdict") == "true_positive") & (F.try_element_at("decisive_facts", F.lit("sink_param_style")) == "parameterized") & (F.size(types) > 0) & F.forall(types, lambda x: x == "sql_injection")
    return _likely(df, hit, "parameterized_contradicts_sqli_tp")


def evidence_on_tp(df: DataFrame) -> DataFrame:
    """A confident true positive with neither payload nor checks is only likely."""
    hit = (_c("verdict") == "true_positive") & (_c("confidence") > 6) & (t.text(_c("exploit_payload")) == "") & (F.coalesce(F.size("decisive_checks"), F.lit(0)) <= 0)
    return _likely(df, hit, "hollow_tp_no_evidence")


def grounded_data_flow(df: DataFrame) -> DataFrame:
    """A confident true positive with a step that neither a hop nor a tool read backs is only likely, unless its checks are backed.

    ``data_flow`` are the steps' texts, ``hop_anchors`` and ``tool_anchors`` texts (file names, functions) that back them, ``evidence_grounded`` a flag.
    """
    anchors = F.concat(F.coalesce("hop_anchors", F.array().cast("array<string>")), F.coalesce("tool_anchors", F.array().cast("array<string>")))
    loose = F.filter(F.coalesce("data_flow", F.array().cast("array<string>")), lambda s: ~F.exists(anchors, lambda a: (a != "") & F.contains(s, a)))
    hit = (_c("verdict") == "true_positive") & (_c("confidence") > 6) & (F.size(loose) > 0) & ~F.coalesce("evidence_grounded", F.lit(False))
    return _likely(df, hit, "ungrounded_data_flow_step")


def guard_rollup(checks: DataFrame) -> DataFrame:
    """(alert_id, effective, bypassable, unverifiable, bypassed): statuses of guards by alert; ``status`` is guard_effective, guard_bypassable or not_verifiable, ``kind`` variable_bypass marks a guard on another variable."""
    s = _c("status")
    return checks.groupBy("alert_id").agg(F.count_if(s == "guard_effective").alias("effective"), F.count_if(s == "guard_bypassable").alias("bypassable"), F.count_if(s == "not_verifiable").alias("unverifiable"), F.coalesce(F.bool_or(_c("kind") == "variable_bypass"), F.lit(False)).alias("bypassed"))


def verified(df: DataFrame, rollup: DataFrame) -> DataFrame:
    """Takes back verdicts that the guards contradict: a false positive whose guards are all bypassable or guard another variable, a true positive with a guard that works and none that can be bypassed."""
    j = df.join(rollup, "alert_id", "left").na.fill(0, ["effective", "bypassable", "unverifiable"]).withColumn("bypassed", F.coalesce("bypassed", F.lit(False)))
    fp, tp = _c("verdict") == "false_positive", _c("verdict") == "true_positive"
    against = (fp & (_c("bypassed") | ((_c("bypassable") > 0) & (_c("effective") == 0)))) | (tp & (_c("effective") > 0) & (_c("bypassable") == 0) & ~_c("bypassed"))
    status = F.when(against, "contradicted").when(fp & (_c("effective") > 0), "guard_effective").when(tp & (_c("bypassable") > 0), "guard_bypassable").when(tp & _c("bypassed"), "bypass_confirmed_tp_kept").otherwise("kept")
    j = j.withColumn("_against", F.coalesce(against, F.lit(False))).withColumn("verification_status", status)
    j = j.withColumn("verification_action", F.when(_c("_against"), "downgraded_to_uncertain").otherwise("kept"))
    return _when(j, _c("_against"), verdict=F.lit("uncertain"), confidence=F.least("confidence", F.lit(4))).drop("_against", "effective", "bypassable", "unverifiable", "bypassed")


def dynamic(df: DataFrame, mode: str = "ir") -> DataFrame:
    """An executed payload speaks against a verdict: CONFIRMED against a false positive, NOT_REPRODUCED against a true one; INCONCLUSIVE against none."""
    if mode != "ir":
        return df
    o = _c("dynamic_outcome")
    return _when(df, ((o == "CONFIRMED") & (_c("verdict") == "false_positive")) | ((o == "NOT_REPRODUCED") & (_c("verdict") == "true_positive")), verdict=F.lit("uncertain"), confidence=F.least("confidence", F.lit(4)))


def falsified(df: DataFrame, parity: bool = False) -> DataFrame:
    """Merges the refuter's answer: a refuted true positive is uncertain. Only true positives that no execution settled go to it.

    With ``parity`` the routing compares the outcome with its lower-case name, as it was once written, so that executed ones never go.
    """
    settled = F.coalesce(_c("dynamic_outcome") != ("inconclusive" if parity else "INCONCLUSIVE"), F.lit(False))
    return _when(df, (_c("verdict") == "true_positive") & ~settled & F.coalesce("refuted", F.lit(False)), verdict=F.lit("uncertain"), disposition=F.lit("likely_tp"), confidence=F.least("confidence", F.lit(6)))


#: The chain in its order, without the rules that need other tables.
CHAIN: list[Callable[[DataFrame], DataFrame]] = [decisive_fact_known, no_bare_fp, parameterized_sql, evidence_on_tp, grounded_data_flow]


def enforce(df: DataFrame, rules: list[Callable[[DataFrame], DataFrame]] | None = None) -> DataFrame:
    for rule in CHAIN if rules is None else rules:
        df = rule(df)
    return df


# fixed values: reasons by which a rule rejected a judgement
REJECTED = ("decisive_fact_unknown:", "bare_fp_buries_actual:")


def contract_rejected(fail_reason: Column, prefixes: tuple[str, ...] = REJECTED) -> Column:
    """Whether a second judgement is called for."""
    out = F.lit(False)
    for p in prefixes:
        out = out | t.text(fail_reason).startswith(p)
    return out


def first_known(*probers: Column) -> Column:
    """Tri-state evaluation: of structs (verdict, by, grain) in their order the first that knows, else unknown."""
    known = [F.when(p["verdict"] != "unknown", p) for p in probers]
    return F.coalesce(*known, F.struct(F.lit("unknown").alias("verdict"), F.lit("").alias("by"), F.lit("").alias("grain")))


def coverage(hits: Column, complete: Column) -> Column:
    """``present`` on a hit; ``none`` only where the whole scan found nothing; else ``unknown``."""
    return F.when(hits > 0, "present").when(F.coalesce(complete, F.lit(False)), "none").otherwise("unknown")


def roles(hops: Column, sources: Column, sanitizers: Column, sinks: Column) -> Column:
    """Hops with a role: source before sanitizer before sink, else passthrough; matched by name in their code."""
    any_in = lambda words, code: F.exists(words, lambda w: (w != "") & F.contains(code, w))
    role = lambda h: F.when(any_in(sources, h["code"]), "source").when(any_in(sanitizers, h["code"]), "sanitizer").when(any_in(sinks, h["code"]), "sink").otherwise("passthrough")
    return F.transform(hops, lambda h: h.withField("role", role(h)))


def param_style(bodies: Column, mapper: Column) -> Column:
    """How values reach a statement: concat, parameterized, unknown, or empty where no placeholder is seen."""
    concat, param = F.rlike(bodies, F.lit(r"\$\{\w+\}")), F.rlike(bodies, F.lit(r"#\{\w+\}"))
    prepared = F.rlike(bodies, F.lit(r"\bprepareStatement\b|\.setString\s*\("))
    raw = ~prepared & F.rlike(bodies, F.lit(r"\bcreateStatement\b|\.execute\s*\(|createNativeQuery"))
    return F.when(~concat & ~param, "").when(concat, F.when(mapper | raw, "concat").otherwise("unknown")).when(mapper | prepared, "parameterized").otherwise("unknown")


def mapper_style(sql: Column) -> tuple[Column, Column, Column]:
    """Names put in as text, names bound, and the statement's style: mixed, concat, parameterized or empty."""
    cat, par = F.regexp_extract_all(sql, F.lit(r"\$\{(\w+)\}"), F.lit(1)), F.regexp_extract_all(sql, F.lit(r"#\{(\w+)[^}]*\}"), F.lit(1))
    a, b = F.size(cat) > 0, F.size(par) > 0
    return F.array_distinct(cat), F.array_distinct(par), F.when(a & b, "mixed").when(a, "concat").when(b, "parameterized").otherwise("")


def degraded(hops: Column, budget: int) -> tuple[Column, Column]:
    """Hops within a token budget, and whether any went: over it only the first, the last and sanitizing hops stay."""
    total = F.aggregate(hops, F.lit(0).cast("long"), lambda s, h: s + t.tokens(h["code"]))
    over = total > budget
    n = F.size(hops)
    kept = F.filter(hops, lambda h, i: (i == 0) | (i == n - 1) | F.coalesce(h["sanitizer"], F.lit(False)))
    return F.when(over, kept).otherwise(hops), over


def reindexed(hops: Column, more: Column) -> Column:
    """Hops and new ones, each once, numbered by their place."""
    both = F.array_distinct(F.concat(hops, more))
    return F.transform(both, lambda h, i: F.struct(i.alias("hop_index"), h.alias("hop")))
