"""Driver queries: each applies library operators to the test tables; the SQL beside it gives the same rows.

A query names its tables' columns after the operator's domain and calls the operator; it adds no logic of its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertmill.functions import text as t
from alertmill.functions import vocab as v
from alertmill.operators import calls, faces, graph, guards, history, policy, ranges, routing, search, stability, summary, taint

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
_c = F.col


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ---- dependency policy ----

POLICY = policy.Policy(
    license_allowlist=("ECONOMY", "SMALL"),
    vuln_min_severity="high",
    blacklist=(("Brand#11", "MEDIUM", "withdrawn", "critical"), ("Brand#23", "LARGE", "withdrawn", "high"), ("Brand#3", "MEDIUM", "withdrawn", "high")),
    copyright_rules=(("Brand-*", "family", "high"), ("PROMO", "exact", "medium"), ("LARGE", "exact", "medium")),
)


def _scan(spark, sf):
    part, item = table(spark, sf, "part"), table(spark, sf, "lineitem")
    comp = part.select(_c("p_brand").alias("name"), _c("p_partkey").cast("string").alias("version"), _c("p_type").alias("ecosystem"), F.when(_c("p_size") % 5 != 0, F.concat(F.lit("src/"), "p_name")).alias("source_file"), _c("p_partkey").alias("pos"))
    lic = part.select(_c("p_brand").alias("component"), _c("p_partkey").cast("string").alias("version"), _c("p_type").alias("ecosystem"), _c("p_type").alias("license"))
    j = item.join(part, item.l_partkey == part.p_partkey)
    score = F.round(_c("l_discount") * 100, 0)
    vuln = j.select(_c("p_brand").alias("component"), _c("p_partkey").cast("string").alias("version"), _c("p_type").alias("ecosystem"), F.concat(F.lit("ID-"), "l_orderkey", F.lit("-"), "l_linenumber").alias("osv_id"), F.when(_c("l_tax") > 0.04, F.concat(F.lit("CVE-"), "l_orderkey", F.lit("-"), "l_linenumber")).otherwise("").alias("cve"), v.dependency_severity(score.cast("string")).alias("severity"), score.cast("int").cast("string").alias("cvss_score"), _c("l_returnflag").alias("summary"))
    return comp, vuln, lic


_FINDINGS = r"""
WITH comp AS (SELECT p_brand AS name, CAST(p_partkey AS VARCHAR) AS version, p_type AS ecosystem, CASE WHEN p_size % 5 <> 0 THEN 'src/' || p_name END AS source_file, p_partkey AS pos FROM part),
vul AS (SELECT p_brand AS component, CAST(p_partkey AS VARCHAR) AS version, p_type AS ecosystem, 'ID-' || l_orderkey || '-' || l_linenumber AS osv_id,
  CASE WHEN l_tax > 0.04 THEN 'CVE-' || l_orderkey || '-' || l_linenumber ELSE '' END AS cve,
  CASE WHEN round(l_discount * 100, 0) > 9 THEN 'critical' WHEN round(l_discount * 100, 0) >= 7 THEN 'high' WHEN round(l_discount * 100, 0) >= 4 THEN 'medium' ELSE 'low' END AS severity
  FROM lineitem JOIN part ON l_partkey = p_partkey),
deny(name, ecosystem, reason, sev) AS (VALUES ('Brand#11', 'MEDIUM', 'withdrawn', 'critical'), ('Brand#23', 'LARGE', 'withdrawn', 'high'), ('Brand#3', 'MEDIUM', 'withdrawn', 'high')),
f AS (
  SELECT 'vuln-' || severity AS rule_id, 'vulnerability' AS category, severity, component, version, ecosystem, CASE WHEN cve <> '' THEN cve ELSE osv_id END AS evidence FROM vul WHERE severity IN ('high', 'critical')
  UNION ALL SELECT 'license-' || trim(regexp_replace(lower(ecosystem), '[^a-z0-9]+', '-', 'g'), '-'), 'license', 'high', name, version, ecosystem, ecosystem FROM comp WHERE ecosystem NOT IN ('ECONOMY', 'SMALL')
  UNION ALL SELECT 'blacklist-' || c.name, 'blacklist', sev, c.name, version, c.ecosystem, reason FROM comp c JOIN deny d ON c.name = d.name AND c.ecosystem = d.ecosystem
  UNION ALL SELECT 'copyright-' || lower(ecosystem), 'copyright', 'medium', name, version, ecosystem, 'exact（' || ecosystem || '）' FROM comp WHERE ecosystem IN ('PROMO', 'LARGE')),
s AS (SELECT name AS component, arg_min(source_file, pos) AS source_file FROM comp WHERE source_file IS NOT NULL AND source_file <> '' GROUP BY name)
"""


@query(_FINDINGS + "SELECT rule_id, category, severity, f.component, version, ecosystem, evidence, source_file FROM f LEFT JOIN s ON f.component = s.component")
def policy_findings(spark, sf):
    comp, vuln, lic = _scan(spark, sf)
    return policy.evaluate(POLICY, comp, vuln, lic).drop("detail")


@query(_FINDINGS + "SELECT component, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low FROM f GROUP BY component")
def policy_severity_pivot(spark, sf):
    comp, vuln, lic = _scan(spark, sf)
    return policy.by_severity(policy.evaluate(POLICY, comp, vuln, lic), "component")


@query("""SELECT p_type AS license, rule FROM (SELECT DISTINCT p_type FROM part), (VALUES ('PROMO', 'PROMO'), ('STANDARD', 'STANDARD'), ('SMALL', 'S-*')) r(m, rule) WHERE rule NOT LIKE '%-*' AND p_type = m OR rule LIKE '%-*' AND p_type LIKE 'S-%'""")
def prefix_theta_join(spark, sf):
    lic = table(spark, sf, "part").select(_c("p_type").alias("license")).distinct().withColumns({c: F.lit("") for c in ("component", "version", "ecosystem")})
    rules = policy.Policy(copyright_rules=(("PROMO", "PROMO", "high"), ("STANDARD", "STANDARD", "high"), ("S-*", "S-*", "high")))
    return policy.families(lic, rules).select(F.regexp_extract("evidence", "（(.*)）", 1).alias("license"), F.regexp_extract("evidence", "^(.*)（", 1).alias("rule"))


@query("""WITH h AS (SELECT CAST(l_orderkey AS VARCHAR) AS scan_id, p_brand AS name, CAST(p_partkey AS VARCHAR) AS version, p_type AS ecosystem FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON o_orderkey = l_orderkey
WHERE o_orderstatus = 'F' AND p_brand = (SELECT min(p_brand) FROM part)) SELECT ecosystem, count(*) AS n, string_agg(scan_id || '/' || version, ',' ORDER BY scan_id, name, version) AS hits FROM h GROUP BY ecosystem""")
def component_search(spark, sf):
    item, part, orders = (table(spark, sf, x) for x in ("lineitem", "part", "orders"))
    scans = orders.select(_c("o_orderkey").cast("string").alias("scan_id"), F.when(_c("o_orderstatus") == "F", "done").otherwise("failed").alias("status"))
    comp = item.join(part, item.l_partkey == part.p_partkey).select(_c("l_orderkey").cast("string").alias("scan_id"), _c("p_brand").alias("name"), _c("p_partkey").cast("string").alias("version"), _c("p_type").alias("ecosystem"))
    name = part.agg(F.min("p_brand").alias("b")).first().b
    hits = policy.grouped_by_ecosystem(policy.search_components(scans, comp, name))
    return hits.select("ecosystem", F.size("hits").cast("long").alias("n"), F.array_join(F.transform("hits", lambda h: F.concat(h["scan_id"], F.lit("/"), h["version"])), ",").alias("hits"))


# ---- routing ----


@query("""SELECT 'kept' AS kind, lang AS value, count(*) AS n FROM documents WHERE lang IN ('en', 'de') GROUP BY lang UNION ALL SELECT 'skipped', lang, count(*) FROM documents WHERE lang NOT IN ('en', 'de') GROUP BY lang""")
def skip_counts_filter(spark, sf):
    kept, skipped = routing.language_filter(table(spark, sf, "documents"), _c("lang"), ["EN ", "de"])
    return kept.groupBy("lang").agg(F.count("*").alias("n")).select(F.lit("kept").alias("kind"), _c("lang").alias("value"), "n").unionByName(skipped.select(F.lit("skipped").alias("kind"), _c("language").alias("value"), _c("skipped").alias("n")))


@query("""WITH o AS (SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium' WHEN '4-NOT SPECIFIED' THEN 'odd' ELSE 'low' END AS sev FROM orders)
SELECT sev, CASE WHEN sev IN ('critical', 'high', 'odd') THEN 'kept' ELSE 'skipped' END AS kind, count(*) AS n FROM o GROUP BY ALL""")
def severity_filter(spark, sf):
    names = {"1-URGENT": "critical", "2-HIGH": "high", "3-MEDIUM": "medium", "4-NOT SPECIFIED": "odd"}
    o = table(spark, sf, "orders").select(F.coalesce(v.lookup(names, _c("o_orderpriority")), F.lit("low")).alias("sev"))
    kept, skipped = routing.severity_filter(o, _c("sev"), "High")
    return kept.groupBy("sev").agg(F.count("*").alias("n")).withColumn("kind", F.lit("kept")).select("sev", "kind", "n").unionByName(skipped.select(_c("severity").alias("sev"), F.lit("skipped").alias("kind"), _c("skipped").alias("n")))


_PATHS = "SELECT doc_id, source || CASE doc_id % 7 WHEN 0 THEN '/README.MD' WHEN 1 THEN '/src/FooTest.java' WHEN 2 THEN '/target/A.java' WHEN 3 THEN '/src/a.c' WHEN 4 THEN '/tests/x.py' ELSE '/src/B.java' END AS path, doc_id % 11 = 0 AS gen, CASE doc_id % 3 WHEN 0 THEN 'CWE-787' WHEN 1 THEN 'CWE-89' ELSE 'cwe-125' END AS cwe FROM documents"


def _paths(spark, sf):
    d = table(spark, sf, "documents")
    tail = v.lookup({0: "/README.MD", 1: "/src/FooTest.java", 2: "/target/A.java", 3: "/src/a.c", 4: "/tests/x.py"}, (_c("doc_id") % 7).cast("int"))
    return d.select("doc_id", F.concat("source", F.coalesce(tail, F.lit("/src/B.java"))).alias("path"), (_c("doc_id") % 11 == 0).alias("gen"), F.when(_c("doc_id") % 3 == 0, "CWE-787").when(_c("doc_id") % 3 == 1, "CWE-89").otherwise("cwe-125").alias("cwe"))


@query(f"""WITH p AS ({_PATHS}) SELECT doc_id, CASE WHEN regexp_matches(path, '(?i)\\.md$') THEN 'HE-101' WHEN regexp_matches(path, '(?i)(Test|Tests|IT)\\.java$|/test/|/tests/') THEN 'HE-002' WHEN gen THEN 'HE-010'
WHEN regexp_matches(path, '(?i)(^|/)(target|build|generated|generated-sources|node_modules|vendor)/') THEN 'HE-102' WHEN lower(cwe) IN ('cwe-787', 'cwe-125') AND NOT regexp_matches(path, '\\.c$') THEN 'HE-201' END AS rule FROM p""")
def exclusion_case(spark, sf):
    return routing.exclusion(_paths(spark, sf), _c("path"), _c("gen"), _c("cwe")).select("doc_id", F.substring_index("exclusion_reason", " ", 1).alias("rule"))


@query("""SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'judge' ELSE 'inherited' END AS route, CASE WHEN l.toxic = 1 THEN 'true_positive' WHEN l.toxic = 0 THEN 'false_positive' END AS verdict FROM documents d LEFT JOIN (SELECT * FROM labels WHERE quality = 1) l USING (doc_id)""")
def inheritance_split(spark, sf):
    alerts = table(spark, sf, "documents").select(_c("doc_id").alias("bughash"))
    known = table(spark, sf, "labels").select(_c("doc_id").alias("bughash"), F.when(_c("quality") == 0, "uncertain").when(_c("toxic") == 1, "true_positive").otherwise("false_positive").alias("verdict"), F.lit(7).alias("confidence"))
    judge, inherited = routing.inheritance(alerts, known)
    return judge.select(_c("bughash").alias("doc_id"), F.lit("judge").alias("route"), F.lit(None).cast("string").alias("verdict")).unionByName(inherited.select(_c("bughash").alias("doc_id"), F.lit("inherited").alias("route"), _c("inherited_verdict").alias("verdict")))


def _judged(spark, sf):
    """Documents with labels as judgements."""
    j = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    null = lambda kind: F.lit(None).cast(kind)
    return j.select(
        "doc_id", _c("doc_id").cast("string").alias("bughash"), F.when(_c("lang") == "de", "ssrf").when(_c("lang") != "fr", "xss").alias("vulnerability_type"),
        F.when(_c("toxic") == 1, "true_positive").when(_c("quality") == 1, "false_positive").otherwise("uncertain").alias("verdict"),
        F.when(_c("doc_id") % 4 == 0, "likely_fp").when(_c("doc_id") % 4 == 1, "false_positive").alias("disposition"), F.when(_c("doc_id") % 2 == 0, "high").when(_c("doc_id") % 3 == 0, "critical").otherwise("low").alias("severity"),
        (_c("n_chars") % 11).cast("int").alias("confidence"), (_c("lang") != "es").alias("calibrated"), F.when(_c("doc_id") % 9 == 0, F.array("lang")).alias("type_mismatch_types"),
        F.when(_c("doc_id") % 10 == 0, F.array("source")).alias("buried_types"), F.when(_c("doc_id") % 13 == 0, "empty_slice: none").alias("fail_reason"), F.when(_c("doc_id") % 17 == 0, "symbolic_cf_prefilter").otherwise("m").alias("model_used"),
        F.when(_c("doc_id") % 3 == 0, _c("source")).alias("path_broken_at"), _c("lang").alias("sanitization_found"), F.when(_c("doc_id") % 19 == 0, "downgraded_to_uncertain").alias("verification_action"), (_c("doc_id") % 8 == 0).alias("control_flow_mutex"), null("string").alias("exclusion_reason"),
    )


_JUDGED = """j AS (SELECT doc_id, CASE WHEN lang = 'de' THEN 'ssrf' WHEN lang <> 'fr' THEN 'xss' END AS kind, CASE WHEN toxic = 1 THEN 'true_positive' WHEN quality = 1 THEN 'false_positive' ELSE 'uncertain' END AS verdict,
CASE doc_id % 4 WHEN 0 THEN 'likely_fp' WHEN 1 THEN 'false_positive' END AS disposition, CASE WHEN doc_id % 2 = 0 THEN 'high' WHEN doc_id % 3 = 0 THEN 'critical' ELSE 'low' END AS severity, n_chars % 11 AS confidence, lang <> 'es' AS calibrated,
doc_id % 9 = 0 AS tm, doc_id % 10 = 0 AS bu, lang, source FROM documents JOIN labels USING (doc_id))"""


@query(f"""WITH {_JUDGED}, q AS (SELECT *, confidence >= 7 AND coalesce(kind, '') <> 'ssrf' AND calibrated AND NOT tm AND NOT bu AS quiet FROM j)
SELECT count(*) AS ai_processed, count(*) FILTER (verdict = 'false_positive') AS ai_false_positives, count(*) FILTER (verdict = 'true_positive') AS ai_true_positives, count(*) FILTER (verdict = 'uncertain') AS ai_uncertain,
count(*) FILTER (verdict = 'false_positive' AND quiet) AS auto_suppressed, count(*) FILTER (verdict = 'uncertain' OR verdict = 'false_positive' AND NOT quiet) AS human_review_needed, count(*) FILTER (doc_id % 13 = 0) AS blind_alerts, count(*) FILTER (tm) AS type_mismatches,
coalesce(string_agg(DISTINCT lang, ',' ORDER BY lang) FILTER (tm), '') AS type_mismatch_types, count(*) FILTER (bu) AS buried_count, coalesce(string_agg(DISTINCT source, ',' ORDER BY source) FILTER (bu), '') AS buried_types, count(*) FILTER (doc_id % 19 = 0) AS probe_downgrades, count(*) FILTER (doc_id % 17 = 0) AS control_flow_pruned,
count(*) FILTER (doc_id % 8 = 0) AS mutex_total, count(*) FILTER (doc_id % 8 = 0 AND verdict = 'false_positive') AS mutex_agreed_fp, count(*) FILTER (doc_id % 8 = 0 AND verdict <> 'false_positive') AS mutex_overridden,
(SELECT count(*) FROM documents WHERE doc_id % 5 = 0) AS bughash_inherited, (SELECT count(*) FROM documents WHERE doc_id % 6 = 0) AS hard_excluded, count(*) + (SELECT count(*) FILTER (doc_id % 5 = 0) + count(*) FILTER (doc_id % 6 = 0) FROM documents) AS sast_in FROM q""")
def funnel_summary(spark, sf):
    d = table(spark, sf, "documents")
    out = summary.summary(_judged(spark, sf), d.where("doc_id % 5 = 0"), d.where("doc_id % 6 = 0"))
    return out.withColumns({c: F.array_join(c, ",") for c in ("type_mismatch_types", "buried_types")})


@query(f"""WITH {_JUDGED}, k AS (SELECT coalesce(kind, 'unknown') AS kind, CASE WHEN doc_id % 3 = 0 THEN source ELSE lang END AS why, doc_id FROM j WHERE disposition IS NOT NULL OR verdict = 'false_positive'),
f AS (SELECT kind, why, min(doc_id) AS o FROM k GROUP BY kind, why), r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY o, why) AS n FROM f)
SELECT kind AS vulnerability_type, (SELECT count(*) FROM k WHERE k.kind = r.kind) AS count, string_agg(why, ',' ORDER BY n) AS reasons FROM r WHERE n <= 5 GROUP BY kind""")
def fp_patterns_judged(spark, sf):
    return summary.fp_patterns(_judged(spark, sf), "doc_id").withColumn("reasons", F.array_join("reasons", ","))


@query("""WITH f AS (SELECT event_type AS kind, props AS why, min(event_id) AS o FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY o, why) AS n FROM f)
SELECT kind, (SELECT count(*) FROM events WHERE event_type = kind) AS count, string_agg(why, ',' ORDER BY n) AS reasons FROM r WHERE n <= 5 GROUP BY kind""")
def fp_patterns_first5(spark, sf):
    e = table(spark, sf, "events").select(_c("event_type").alias("kind"), _c("props").alias("why"), _c("event_id").alias("ord"))
    return summary.first_reasons(e).withColumn("reasons", F.array_join("reasons", ","))


@query(f"""WITH {_JUDGED} SELECT 'disposition' AS what, disposition AS value, count(*) AS n FROM j WHERE disposition IS NOT NULL GROUP BY 2 UNION ALL SELECT 'severity', severity, count(*) FROM j GROUP BY 2""")
def disposition_counts(spark, sf):
    j = _judged(spark, sf)
    one = lambda c: summary.counts_by(j, c).select(F.lit(c).alias("what"), _c(c).alias("value"), _c("rows").alias("n"))
    return one("disposition").unionByName(one("severity"))


@query("""SELECT CASE WHEN grouping(o_orderpriority) = 1 THEN 'total' WHEN grouping(o_orderstatus) = 1 THEN 'level' ELSE 'rule' END AS grain, o_orderpriority AS level, o_orderstatus AS rule, CASE WHEN grouping(o_orderstatus) = 0 THEN arg_min(o_custkey % 10, o_orderkey) FILTER (o_custkey % 3 <> 0) END AS name, count(*) AS rows
FROM orders GROUP BY GROUPING SETS ((o_orderpriority, o_orderstatus), (o_orderpriority), ())""")
def bug_type_level_cube(spark, sf):
    o = table(spark, sf, "orders").withColumn("nm", F.when(_c("o_custkey") % 3 != 0, _c("o_custkey") % 10))
    return summary.type_level_cube(o, "o_orderpriority", "o_orderstatus", "nm", "o_orderkey")


# ---- history ----


@query("SELECT user_id, event_type, arg_max(props, event_id) AS props, max(event_id) AS event_id FROM events GROUP BY 1, 2")
def latest_label(spark, sf):
    return history.latest(table(spark, sf, "events"), ["user_id", "event_type"], "event_id").select("user_id", "event_type", "props", "event_id")


@query("SELECT user_id, event_type, arg_min(props, event_id) AS props, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def first_claim(spark, sf):
    return history.earliest(table(spark, sf, "events"), ["user_id", "event_type"], "event_id").select("user_id", "event_type", "props", "event_id")


_LOG = "log AS (SELECT event_id AS seq, 'r' || (event_id % 3) AS run_id, event_id % 500 AS bughash, CASE event_type WHEN 'view' THEN 'true_positive' WHEN 'click' THEN 'false_positive' WHEN 'error' THEN 'uncertain' ELSE 'needs-hardening' END AS label, CASE WHEN event_id % 2 = 0 THEN 'confirmed' ELSE 'candidate' END AS status FROM events), lab AS (SELECT bughash, arg_max(label, seq) AS label, arg_max(status, seq) AS status FROM log WHERE run_id = 'r1' GROUP BY bughash)"


def _labelled(spark, sf):
    e = table(spark, sf, "events")
    label = F.when(_c("event_type") == "view", "true_positive").when(_c("event_type") == "click", "false_positive").when(_c("event_type") == "error", "uncertain").otherwise("needs-hardening")
    log = e.select(_c("event_id").alias("seq"), F.concat(F.lit("r"), _c("event_id") % 3).alias("run_id"), (_c("event_id") % 500).cast("string").alias("bughash"), label.alias("label"), F.when(_c("event_id") % 2 == 0, "confirmed").otherwise("candidate").alias("status"), _c("user_id").cast("string").alias("labeler"), _c("ts").cast("string").alias("labelled_at"))
    return history.overlay(_judged(spark, sf), log, "r1")


@query(f"WITH {_LOG} SELECT d.doc_id, lab.label AS label, lab.status AS label_status FROM documents d JOIN labels USING (doc_id) LEFT JOIN lab ON lab.bughash = d.doc_id")
def label_overlay(spark, sf):
    return _labelled(spark, sf).select("doc_id", "label", "label_status")


@query(f"WITH {_LOG} SELECT count(DISTINCT d.doc_id) AS unlabelled FROM documents d JOIN labels USING (doc_id) LEFT JOIN lab ON lab.bughash = d.doc_id WHERE label IS NULL")
def unlabelled_count(spark, sf):
    return summary.unlabelled(_labelled(spark, sf))


@query(f"""WITH {_JUDGED}, {_LOG}, d AS (SELECT j.*, lab.label, lab.status FROM j LEFT JOIN lab ON lab.bughash = j.doc_id)
SELECT bool_or(verdict IN ('true_positive', 'uncertain') AND coalesce(label, '') IN ('', 'uncertain')) AS blocked, count(*) FILTER (verdict IN ('true_positive', 'uncertain') AND coalesce(label, '') IN ('', 'uncertain')) AS blocking_count, count(*) FILTER (label = 'true_positive') AS confirmed_tp,
count(*) FILTER (label = 'false_positive' OR label IS NULL AND verdict = 'false_positive') AS confirmed_fp, count(*) FILTER (label = 'needs-hardening') AS confirmed_hardening, count(*) FILTER (label IS NOT NULL AND status = 'confirmed') AS confirmed_count,
count(*) FILTER (label IN ('true_positive', 'needs-hardening')) AS to_push, CASE max(CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'low' THEN 1 END) FILTER (label IN ('true_positive', 'needs-hardening')) WHEN 4 THEN 'critical' WHEN 3 THEN 'high' WHEN 1 THEN 'low' ELSE '' END AS max_severity FROM d""")
def gate_counts(spark, sf):
    return summary.gate(_labelled(spark, sf))


@query("""WITH n AS (SELECT max(ts) AS now FROM events), c AS (SELECT user_id AS key, arg_max(event_type, event_id) AS verdict, max(ts) AS created_at FROM events GROUP BY 1)
SELECT key AS user_id, CASE WHEN epoch(date_trunc('second', now)) - epoch(date_trunc('second', created_at)) <= 864000 AND verdict <> 'error' THEN verdict END AS cached_verdict FROM c CROSS JOIN n""")
def ttl_cache(spark, sf):
    """Every event is cached under its own user; age and type tell hit from miss."""
    e = table(spark, sf, "events").withColumn("ts", _c("ts").cast("timestamp"))
    now = e.agg(F.max("ts").alias("now")).first().now
    c = e.groupBy(_c("user_id").alias("key")).agg(F.max_by("event_type", "event_id").alias("verdict"), F.max("ts").alias("created_at")).withColumns({"verdict": F.when(_c("verdict") == "error", "uncertain").otherwise(_c("verdict")), "confidence": F.lit(5)})
    return history.cache_lookup(e.select("user_id", _c("user_id").alias("key")).distinct(), c, F.lit(now), 864000).select("user_id", "cached_verdict")


@query("SELECT o_custkey AS key, coalesce(arg_max(o_totalprice, o_orderkey) FILTER (o_orderstatus <> 'F'), arg_max(o_totalprice, o_orderkey)) AS price, coalesce(max(o_orderkey) FILTER (o_orderstatus <> 'F'), max(o_orderkey)) AS seq FROM orders GROUP BY 1")
def history_upsert(spark, sf):
    """Finished orders are the old rows, all others the new ones."""
    o = table(spark, sf, "orders").select(_c("o_custkey").alias("key"), _c("o_totalprice").alias("price"), _c("o_orderkey").alias("seq"), _c("o_orderstatus").eqNullSafe("F").alias("old"))
    return history.upsert(history.latest(o.where("old").drop("old"), ["key"], "seq"), o.where("not old").drop("old"), "key")


@query("""SELECT 'judged' AS stage, doc_id, 0 AS ord FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT 'inherited', doc_id, 1 FROM documents WHERE doc_id % 3 = 1 UNION ALL SELECT 'excluded', doc_id, 2 FROM documents WHERE doc_id % 3 = 2""")
def union_details(spark, sf):
    d = table(spark, sf, "documents").select("doc_id")
    return summary.union_all(judged=d.where("doc_id % 3 = 0"), inherited=d.where("doc_id % 3 = 1"), excluded=d.where("doc_id % 3 = 2")).select("stage", "doc_id", "ord")


# ---- text ----


@query("""SELECT 'd' || doc_id AS id, left(sha256(trim(regexp_replace(regexp_replace(regexp_replace(text, '(?s)/\\*.*?\\*/', ' ', 'g'), '//[^\\n]*', '', 'g'), '[\\t\\n\\f\\r ]+', ' ', 'g'))), 16) AS fp FROM documents
UNION ALL SELECT 'p' || page_id, left(sha256(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?s)/\\*.*?\\*/', ' ', 'g'), '//[^\\n]*', '', 'g'), '[\\t\\n\\f\\r ]+', ' ', 'g'))), 16) FROM pages""")
def code_fingerprint(spark, sf):
    d = table(spark, sf, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), t.code_fingerprint(_c("text"), F.lit("")).alias("fp"))
    return d.unionByName(table(spark, sf, "pages").select(F.concat(F.lit("p"), "page_id").alias("id"), t.code_fingerprint(_c("html"), F.lit("")).alias("fp")))


@query("""SELECT left(sha256(trim(regexp_replace(regexp_replace(regexp_replace(text, '(?s)/\\*.*?\\*/', ' ', 'g'), '//[^\\n]*', '', 'g'), '[\\t\\n\\f\\r ]+', ' ', 'g'))), 16) AS fp, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1""")
def dup_groups(spark, sf):
    return table(spark, sf, "documents").groupBy(t.code_fingerprint(_c("text"), F.lit("")).alias("fp")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@query("SELECT conv_id, left(sha256(string_agg(role || ':' || turn, '|' ORDER BY turn)), 12) AS sig, count(*) AS hops FROM conversations GROUP BY conv_id")
def path_signature(spark, sf):
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(_c("turn").alias("line"), _c("role").alias("file")))).alias("p"))
    return c.select("conv_id", t.path_signature(_c("p")).alias("sig"), F.size("p").cast("long").alias("hops"))


@query("SELECT p_partkey, sha256('v5:' || p_type || ':' || 'CWE-' || p_size || ':' || p_name || ':' || CASE WHEN p_size % 2 = 0 THEN p_brand ELSE p_name || '#' || p_size END || ':' || p_type || ':' || p_brand || ':' || left(sha256(''), 16) || ':') AS bughash FROM part")
def alert_key(spark, sf):
    p = table(spark, sf, "part")
    source = F.struct(_c("p_name").alias("file"), F.when(_c("p_size") % 2 == 0, _c("p_brand")).otherwise("").alias("function"), _c("p_size").alias("line"))
    sink = F.struct(_c("p_type").alias("file"), _c("p_brand").alias("function"), F.lit(0).alias("line"))
    none = F.array().cast("array<struct<file:string,line:int>>")
    rows = p.select("p_partkey", "p_type", F.concat(F.lit("CWE-"), "p_size").alias("cwe"), source.alias("a"), sink.alias("z"), none.alias("path"))
    return rows.select("p_partkey", t.alert_fingerprint(_c("p_type"), _c("cwe"), _c("a"), _c("z"), _c("path")).alias("bughash"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"))


@query("""SELECT page_id, len(l) AS n, list_aggregate(l[1:5], 'string_agg', ' ') AS links FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]+)"', 1) AS l FROM pages)""")
def citation_parse(spark, sf):
    links = F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))
    return table(spark, sf, "pages").select("page_id", links.alias("l")).select("page_id", F.size("l").cast("long").alias("n"), F.when(F.size("l") > 0, F.array_join(F.slice("l", 1, 5), " ")).alias("links"))


@query("SELECT page_id, lower(regexp_extract(url, '\\.([^./\\\\]*)$', 1)) AS ext, regexp_extract(url, '([^/\\\\]*)$', 1) AS base, trim(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '-') AS dashed, greatest(length(url) // 4, 1) AS tokens FROM pages")
def path_helpers(spark, sf):
    u = _c("url")
    return table(spark, sf, "pages").select("page_id", t.extension(u).alias("ext"), t.basename(u).alias("base"), t.dashed(u).alias("dashed"), t.tokens(u).alias("tokens"))


@query("""SELECT event_id, CASE event_type WHEN 'view' THEN 'true_positive' WHEN 'click' THEN 'false_positive' ELSE 'uncertain' END AS verdict FROM events""")
def disposition_fold(spark, sf):
    d = F.when(_c("event_type") == "view", "true_positive").when(_c("event_type") == "click", "false_positive").when(_c("event_type") == "error", "likely_tp").otherwise(_c("event_type"))
    return table(spark, sf, "events").select("event_id", v.verdict_of(d).alias("verdict"))


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, CAST(round(l_discount * 100) AS INTEGER) AS n FROM lineitem) SELECT l_orderkey, l_linenumber, CASE WHEN n > 9 THEN 'critical' WHEN n >= 7 THEN 'high' WHEN n >= 4 THEN 'medium' ELSE 'low' END AS dependency,
CASE WHEN l_linenumber = 1 THEN 'medium' WHEN n >= 9 THEN 'critical' WHEN n >= 7 THEN 'high' WHEN n >= 4 THEN 'medium' ELSE 'low' END AS rule FROM s""")
def severity_scales(spark, sf):
    """Every row of the table, those at the edges 7 and 9 too; scores are whole numbers."""
    score = F.round(_c("l_discount") * 100, 0).cast("int").cast("string")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", v.dependency_severity(score).alias("dependency"), v.rule_severity(F.when(_c("l_linenumber") != 1, score), F.lit("warning"), F.lit(None).cast("string")).alias("rule"))


# ---- graphs ----

#: Every part calls one or two smaller ones; 0 calls 1, so there is a cycle.
_EDGES = "e AS (SELECT p_partkey AS src, p_partkey // 2 AS dst FROM part UNION SELECT p_partkey, p_partkey // 3 FROM part WHERE p_size % 2 = 0 UNION SELECT 0, 1)"


def _edges(spark, sf):
    p = table(spark, sf, "part")
    half = lambda n: F.floor(_c("p_partkey") / n).alias("dst")
    return p.select(_c("p_partkey").alias("src"), half(2)).union(p.where("p_size % 2 = 0").select("p_partkey", half(3))).union(spark.range(1).select("id", _c("id") + 1)).distinct()


def _starts(spark, sf):
    return table(spark, sf, "part").select(_c("p_partkey").alias("start"))


@query(f"WITH RECURSIVE {_EDGES}, r AS (SELECT p_partkey AS start, p_partkey AS node FROM part UNION SELECT r.start, e.dst FROM r JOIN e ON r.node = e.src) SELECT start, node FROM r")
def call_closure(spark, sf):
    return graph.closure(_edges(spark, sf), _starts(spark, sf)).select("start", "node")


@query(f"WITH RECURSIVE {_EDGES}, r AS (SELECT p_partkey AS start, p_partkey AS node, 0 AS depth FROM part UNION SELECT r.start, e.dst, depth + 1 FROM r JOIN e ON r.node = e.src WHERE depth < 4) SELECT start, node, min(depth) AS depth FROM r WHERE node % 5 = 0 GROUP BY ALL HAVING node <> start AND min(depth) > 0")
def reachable_sinks(spark, sf):
    p = table(spark, sf, "part")
    return graph.reachable(_edges(spark, sf), _starts(spark, sf), p.where("p_partkey % 5 = 0").select(_c("p_partkey").alias("node")), 4)


@query(f"WITH RECURSIVE {_EDGES}, r AS (SELECT p_partkey AS start, p_partkey AS node, [p_partkey] AS path FROM part UNION ALL SELECT r.start, e.dst, list_append(path, e.dst) FROM r JOIN e ON r.node = e.src WHERE len(path) <= 3 AND NOT list_contains(path, e.dst)) SELECT start, node, list_aggregate(path, 'string_agg', '>') AS path FROM r")
def call_paths(spark, sf):
    p = graph.simple_paths(_edges(spark, sf), _starts(spark, sf), 3)
    return p.select("start", "node", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


@query(f"WITH RECURSIVE {_EDGES}, r AS (SELECT p_partkey AS start, p_partkey AS node, [p_partkey] AS path FROM part UNION ALL SELECT r.start, e.dst, list_append(path, e.dst) FROM r JOIN e ON r.node = e.src WHERE len(path) <= 2 AND NOT list_contains(path, e.dst)), s AS (SELECT DISTINCT start, node, path FROM r ORDER BY len(path), path LIMIT 500) SELECT start, node, list_aggregate(path, 'string_agg', '>') AS path FROM s")
def shortest_paths(spark, sf):
    """The first 500 paths, as a report shows them; the limit is the feature."""
    p = graph.shortest_first(graph.simple_paths(_edges(spark, sf), _starts(spark, sf), 2))
    return p.select("start", "node", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


@query("SELECT o_custkey, o_orderkey, o_totalprice, greatest(n - 3, 0) AS truncated FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE r <= 3")
def bounded_chain(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return graph.top_per_group(o, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3)


@query(f"""WITH RECURSIVE {_EDGES}, c AS (SELECT * FROM (SELECT dst AS node, src AS caller, row_number() OVER (PARTITION BY dst ORDER BY (src % 7 = 0)::INT DESC, (src % 3 = 0)::INT, src) AS n, greatest(count(*) OVER (PARTITION BY dst) - 2, 0) AS truncated FROM e) WHERE n <= 2),
r AS (SELECT p_partkey AS start, c.node, c.caller, 1 AS level, truncated, [p_partkey, c.caller] AS path FROM part JOIN c ON c.node = p_partkey WHERE c.caller <> p_partkey UNION ALL SELECT r.start, c.node, c.caller, level + 1, c.truncated, list_append(path, c.caller) FROM r JOIN c ON c.node = r.caller WHERE level < 3 AND NOT list_contains(path, c.caller))
SELECT start, node, caller, level, truncated FROM r""")
def caller_chain(spark, sf):
    m = _edges(spark, sf).select(_c("src").alias("node")).distinct().select("node", (_c("node") % 7 == 0).alias("is_entry"), (_c("node") % 3 == 0).alias("is_test"))
    return graph.bounded_chain(_edges(spark, sf), m, _starts(spark, sf), 3, 2).drop("path")


@query("""WITH RECURSIVE g AS (SELECT DISTINCT 'F' || l_partkey AS a, 'F' || l_partkey // CASE WHEN l_linenumber <= 3 THEN 2 ELSE 3 END AS b FROM lineitem), r AS (SELECT 'F' || p_partkey AS k, 'src' || p_partkey % 2 AS m, 'USER_INPUT' AS st, '' AS sf FROM part WHERE p_size % 10 = 0 UNION SELECT g.b, r.m, 'FIELD_PROPAGATION', r.k FROM r JOIN g ON r.k = g.a)
SELECT 'field' AS location_type, k AS location_key, '' AS param_name, st AS source_type, m AS source_method, sf AS source_field FROM r""")
def fixpoint_facts(spark, sf):
    """Tainted fields are those of parts of some sizes; line items assign fields to one another."""
    name = lambda c: F.concat(F.lit("F"), c.cast("string"))
    e = table(spark, sf, "lineitem").select(name(_c("l_partkey")).alias("src_field"), name(F.floor(_c("l_partkey") / F.when(_c("l_linenumber") <= 3, 2).otherwise(3))).alias("dst_field")).distinct()
    seed = table(spark, sf, "part").where("p_size % 10 = 0").select(F.lit("field").alias("location_type"), name(_c("p_partkey")).alias("location_key"), F.lit("").alias("param_name"), F.lit("USER_INPUT").alias("source_type"), F.concat(F.lit("src"), _c("p_partkey") % 2).alias("source_method"), F.lit("").alias("source_field"), F.array(F.lit("seed")).alias("path"))
    return taint.propagate(seed, taint.Store({"field_edges": e}), {"field_to_field": taint.field_to_field}).drop("path")


@query("""WITH RECURSIVE e AS (SELECT 'N' || n_nationkey AS src, 'R' || n_regionkey AS dst FROM nation UNION SELECT 'N' || n_nationkey, 'N' || (n_nationkey + 5) FROM nation WHERE n_nationkey + 5 < 25), n AS (SELECT src AS node FROM e UNION SELECT dst FROM e),
r AS (SELECT node, 0 AS l FROM n UNION SELECT e.dst, r.l + 1 FROM r JOIN e ON e.src = r.node WHERE l < 50) SELECT node, max(l) AS level FROM r GROUP BY node""")
def topological_levels(spark, sf):
    n = table(spark, sf, "nation")
    name = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    e = n.select(name("N", _c("n_nationkey")).alias("src"), name("R", _c("n_regionkey")).alias("dst")).unionByName(n.where("n_nationkey + 5 < 25").select(name("N", _c("n_nationkey")).alias("src"), name("N", _c("n_nationkey") + 5).alias("dst")))
    return graph.topological_levels(e, e.select(_c("src").alias("node")).union(e.select("dst")))


# ---- ranges and windows ----


_DAYS = "o AS (SELECT o_orderkey, o_orderkey % 1000 AS k, epoch(o_orderdate) // 86400 AS a, epoch(o_orderdate) // 86400 + o_custkey % 30 AS b FROM orders), l AS (SELECT l_orderkey, l_linenumber, l_orderkey % 1000 AS k, epoch(l_shipdate) // 86400 AS x, epoch(l_shipdate) // 86400 + l_linenumber AS y FROM lineitem)"


def _spans(spark, sf):
    """Orders and line items as ranges of days; both fold their order's number, so every order meets items."""
    day = lambda c: F.floor(F.unix_timestamp(_c(c).cast("timestamp")) / 86400)
    o = table(spark, sf, "orders").select((_c("o_orderkey") % 1000).alias("k"), "o_orderkey", day("o_orderdate").alias("start"), (day("o_orderdate") + _c("o_custkey") % 30).alias("end"))
    h = table(spark, sf, "lineitem").select((_c("l_orderkey") % 1000).alias("k"), "l_orderkey", "l_linenumber", day("l_shipdate").alias("from"), (day("l_shipdate") + _c("l_linenumber")).alias("to"))
    return o, h


@query(f"WITH {_DAYS} SELECT o_orderkey, l_orderkey, l_linenumber FROM o JOIN l ON l.k = o.k AND a <= y AND b >= x")
def range_overlap(spark, sf):
    pairs = ranges.overlap_pairs(*_spans(spark, sf), "k")
    return pairs.select("span.o_orderkey", "hunk.l_orderkey", "hunk.l_linenumber")


@query(f"WITH {_DAYS} SELECT o_orderkey FROM o WHERE EXISTS (SELECT 1 FROM l WHERE l.k = o.k AND a <= y AND b >= x)")
def range_touched(spark, sf):
    return ranges.overlaps(*_spans(spark, sf), "k").select("o_orderkey")


@query("""WITH m AS (SELECT 'f' || p_partkey % 200 AS f, 'm' || p_size AS fn, p_partkey // 200 * 5 AS a, p_partkey // 200 * 5 + p_size % 7 AS b, p_partkey AS k FROM part), h AS (SELECT DISTINCT 'f' || l_partkey % 200 AS f, l_suppkey % 97 * 3 AS x, l_suppkey % 97 * 3 + l_linenumber // 3 AS y FROM lineitem WHERE l_returnflag = 'R'),
e AS (SELECT DISTINCT l_suppkey AS c, l_partkey AS d FROM lineitem WHERE l_linenumber = 1), c AS (SELECT * FROM m WHERE EXISTS (SELECT 1 FROM h WHERE h.f = m.f AND a <= y AND b >= x)), u AS (SELECT f, fn, 0 AS hop FROM c UNION ALL SELECT m.f, m.fn, 1 FROM e JOIN c ON c.k = e.d JOIN m ON m.k = e.c)
SELECT f AS file, fn AS function, CASE WHEN min(hop) = 0 THEN 'changed' ELSE 'caller' END AS reason FROM u GROUP BY ALL""")
def changed_functions(spark, sf):
    """Parts are functions with lines, line items the hunks of a diff and the calls."""
    file = lambda c: F.concat(F.lit("f"), _c(c) % 200)
    at = F.floor(_c("p_partkey") / 200) * 5
    m = table(spark, sf, "part").select(file("p_partkey").alias("file"), F.concat(F.lit("m"), "p_size").alias("function"), at.alias("start"), (at + _c("p_size") % 7).alias("end"), _c("p_partkey").alias("method_key"))
    li = table(spark, sf, "lineitem")
    x = _c("l_suppkey") % 97 * 3
    h = li.where("l_returnflag = 'R'").select(file("l_partkey").alias("file"), x.alias("from"), (x + F.floor(_c("l_linenumber") / 3)).alias("to"))
    return ranges.changed_functions(m, h, li.where("l_linenumber = 1").select(_c("l_suppkey").alias("caller_key"), _c("l_partkey").alias("callee_key")))


@query("""SELECT event_id, (SELECT max(s.event_id) FROM events s WHERE s.event_type = 'signup' AND s.user_id = p.user_id AND s.ts = (SELECT max(q.ts) FROM events q WHERE q.event_type = 'signup' AND q.user_id = p.user_id AND q.ts <= p.ts)) AS signup_id FROM events p WHERE event_type = 'purchase'""")
def asof_method(spark, sf):
    e = table(spark, sf, "events")
    out = ranges.as_of(e.where("event_type = 'purchase'").select("user_id", "ts", "event_id"), e.where("event_type = 'signup'").select("user_id", "ts", _c("event_id").alias("signup_id")), ["user_id"], "ts", ["signup_id"])
    return out.select("event_id", _c("prev_signup_id").alias("signup_id"))


@query("""WITH b AS (SELECT event_id, user_id, event_type = 'view' AS h, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events), g AS (SELECT user_id, i - row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM b WHERE h), n AS (SELECT user_id, g, count(*) AS n FROM g GROUP BY ALL)
SELECT u.user_id, coalesce(max(n), 0) AS longest FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN n USING (user_id) GROUP BY u.user_id""")
def longest_run(spark, sf):
    return stability.longest_run(table(spark, sf, "events"), "user_id", "event_id", "event_type", "view")


@query("""WITH p AS (SELECT conv_id, turn, coalesce(contains(lag(text) OVER w, left(text, 3)), false) AS l FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), g AS (SELECT conv_id, l, sum(CASE WHEN l THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn) AS g FROM p), n AS (SELECT conv_id, g, count(*) AS n FROM g GROUP BY ALL)
SELECT conv_id, CAST(max(CASE WHEN n >= 2 THEN n ELSE 0 END) AS BIGINT) AS chain FROM n GROUP BY conv_id""")
def chain_lag(spark, sf):
    c = table(spark, sf, "conversations").withColumn("name", F.substring("text", 1, 3))
    return stability.chain_length(c, "conv_id", "turn", "name", "text").select("conv_id", "chain")


@query("SELECT user_id AS alert_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS verdicts, count(DISTINCT event_type) > 1 AS wobbles, count(DISTINCT CASE WHEN value > 90 THEN 'access_control' ELSE 'xss' END) <= 1 AS same_families FROM events WHERE event_id % 10 <> 0 GROUP BY user_id")
def wobble_sets(spark, sf):
    return _wobble(table(spark, sf, "events"))


def _wobble(e):
    cells = e.select(_c("user_id").alias("alert_id"), _c("event_type").alias("verdict"), F.when(_c("value") > 90, F.array(F.lit("IDOR"), F.lit("missing_auth"))).otherwise(F.array(F.lit("XSS"))).alias("actual_types"), F.when(_c("event_id") % 10 == 0, "failed").alias("error"))
    return stability.wobble(cells).withColumn("verdicts", F.array_join("verdicts", ","))


@query()
def lcs_pairs(spark, sf):
    """Sequences of roles, compared over conversations that share a group as runs do an alert."""
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("seq"))
    return stability.sequence_stability(c.select(F.floor(_c("conv_id") / 3).alias("alert_id"), (_c("conv_id") % 3).cast("int").alias("run"), "seq"))


@query("""SELECT p_partkey AS key FROM part WHERE list_has_all(list_distinct([substr(lower(p_name), i, 3) for i in range(1, greatest(len(p_name) - 1, 1))]), [substr(s, i, 3) for i in range(1, len(s) - 1)]) ORDER BY key LIMIT 40""".replace("[substr(s, i, 3) for i in range(1, len(s) - 1)]", "(SELECT [substr(s, i, 3) for i in range(1, len(s) - 1)] FROM (SELECT lower(split_part(min(p_name), ' ', 1)) AS s FROM part))"))
def trigram_search(spark, sf):
    p = table(spark, sf, "part")
    word = p.agg(F.min("p_name").alias("n")).first().n.split(" ")[0]
    return search.trigram_search(search.postings(p, "p_partkey", "p_name"), word, 40)


@query("""WITH b AS (SELECT doc_id, lang, source, text, (lang = 'en')::INT * 10 AS s1, regexp_matches(text, '[0-9]')::INT AS s2, contains(source, 'src1')::INT * 4 AS s3, (doc_id % 6 = 0)::INT * 5 AS s4 FROM documents), s AS (SELECT doc_id, 0 AS pos, 'general' AS name, true AS a, 0 AS sc FROM b UNION ALL SELECT doc_id, 1, 'english', false, s1 FROM b UNION ALL SELECT doc_id, 2, 'numbers', false, s2 + s3 FROM b UNION ALL SELECT doc_id, 3, 'open', false, s4 FROM b),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY a DESC, sc DESC, pos) AS rank FROM s WHERE a OR sc > 0) SELECT doc_id AS id, name, CAST(sc AS BIGINT) AS score, rank FROM r WHERE rank <= 3""")
def strategy_topk(spark, sf):
    d = table(spark, sf, "documents").select(_c("doc_id").alias("id"), _c("text").alias("body"), _c("source").alias("paths"), _c("lang").alias("vulnerability_type"), (_c("doc_id") % 6 == 0).alias("authz_none"))
    rules = [(0, "general", True, "none", ""), (1, "english", False, "cwes", "EN"), (2, "numbers", False, "function_keywords", "[0-9]"), (2, "numbers", False, "paths", "src1"), (3, "open", False, "authz_none", "")]
    return search.strategies(d, spark.createDataFrame(rules, "pos int, name string, always_on boolean, kind string, pattern string"))


@query("""WITH f AS (SELECT doc_id, lang, regexp_replace(lower(text), '\\s+', '', 'g') AS x FROM documents) SELECT doc_id, coalesce(CASE WHEN (contains(x, 'apachelicense') OR contains(x, 'licensedunder')) AND lang <> 'en' THEN 'licence' END, '') || coalesce(CASE WHEN contains(x, 'theand') AND lang <> 'fr' THEN '+words' END, '') AS buried FROM f""")
def buried_terms(spark, sf):
    kinds = {"licence": ["Apache License", "licensed under"], "+words": ["the and"]}
    actual = F.when(_c("lang") == "en", F.array(F.lit("licence"))).when(_c("lang") == "fr", F.array(F.lit("+words"))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf, "documents").select("doc_id", F.array_join(search.buried_types(_c("text"), actual, kinds), "").alias("buried"))


@query("WITH h AS (SELECT 's' || doc_id % 50 AS file, doc_id AS line FROM documents WHERE regexp_matches(text, '[0-9]{4}') ORDER BY file, line LIMIT 31) SELECT file, line, (SELECT count(*) > 30 FROM h) AS truncated FROM (SELECT * FROM h ORDER BY file, line LIMIT 30)")
def grep_capped(spark, sf):
    lines = table(spark, sf, "documents").select(F.concat(F.lit("s"), _c("doc_id") % 50).alias("file"), _c("doc_id").alias("line"), "text")
    hits, cut = search.grep(lines, "[0-9]{4}")
    return hits.select("file", "line").join(F.broadcast(cut), F.lit(True))


# ---- faces, guards ----


@query(f"""WITH {_JUDGED}, a AS (SELECT doc_id, verdict, lang AS cls, CASE WHEN doc_id % 5 = 0 THEN '' ELSE 's' || doc_id % 3 END AS shape, CASE WHEN doc_id % 4 = 0 THEN 'access_control' WHEN doc_id % 4 = 1 THEN 'file_upload' WHEN doc_id % 4 = 2 THEN 'xss' END AS own FROM j), g AS (SELECT * FROM a WHERE shape <> ''), b AS (SELECT cls, shape FROM g GROUP BY ALL HAVING count(*) >= 2),
tp AS (SELECT cls, shape, own AS family, min(doc_id) AS cp, count(*) AS n FROM g WHERE verdict = 'true_positive' AND own IN ('access_control', 'file_upload') GROUP BY ALL) SELECT g.doc_id, family, 'inconsistent_within_run' AS flag, cp AS counterpart, n AS siblings FROM g JOIN b USING (cls, shape) JOIN tp USING (cls, shape) WHERE verdict <> 'true_positive' AND coalesce(own, '') <> family""")
def sibling_faces(spark, sf):
    own = F.when(_c("doc_id") % 4 == 0, F.array(F.lit("IDOR"))).when(_c("doc_id") % 4 == 1, F.array(F.lit("unrestricted_file_upload"))).when(_c("doc_id") % 4 == 2, F.array(F.lit("xss")))
    a = _judged(spark, sf).join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").select(_c("doc_id").alias("pos"), "bughash", F.concat(F.lit("x-"), "lang", F.lit(".java:1")).alias("alert_id"), "verdict", own.alias("actual_types"), "doc_id")
    shape = F.when(_c("doc_id") % 5 == 0, "").otherwise(F.concat(F.lit("s"), _c("doc_id") % 3))
    out = faces.sibling_faces(a, faces.Grouping("authz", shape, ("access_control", "file_upload")))
    return out.select(_c("bughash").cast("long").alias("doc_id"), "family", "flag", _c("counterpart").cast("long").alias("counterpart"), "siblings")


@query("""WITH r AS (SELECT user_id, count(*) FILTER (event_type = 'view') AS effective, count(*) FILTER (event_type = 'click') AS bypassable, count(*) FILTER (event_type NOT IN ('view', 'click')) AS unverifiable, bool_or(event_type = 'error' AND value > 200) AS bypassed FROM events GROUP BY user_id),
v AS (SELECT DISTINCT user_id, CASE user_id % 3 WHEN 0 THEN 'false_positive' WHEN 1 THEN 'true_positive' ELSE 'uncertain' END AS verdict FROM events), j AS (SELECT v.user_id, verdict, coalesce(effective, 0) AS e, coalesce(bypassable, 0) AS b, coalesce(bypassed, false) AS x FROM v LEFT JOIN r USING (user_id)), k AS (SELECT *, verdict = 'false_positive' AND (x OR b > 0 AND e = 0) OR verdict = 'true_positive' AND e > 0 AND b = 0 AND NOT x AS c FROM j)
SELECT user_id, CASE WHEN c THEN 'uncertain' ELSE verdict END AS verdict, CASE WHEN c THEN 4 ELSE 8 END AS confidence, CASE WHEN c THEN 'downgraded_to_uncertain' ELSE 'kept' END AS action FROM k""")
def guard_rollup(spark, sf):
    e = table(spark, sf, "events")
    return _guarded(e, e)


def _guarded(e, checked):
    checks = checked.select(_c("user_id").alias("alert_id"), F.when(_c("event_type") == "view", "guard_effective").when(_c("event_type") == "click", "guard_bypassable").otherwise("not_verifiable").alias("status"), F.when((_c("event_type") == "error") & (_c("value") > 200), "variable_bypass").otherwise("name").alias("kind"))
    alerts = e.select(_c("user_id").alias("alert_id")).distinct().select("alert_id", F.when(_c("alert_id") % 3 == 0, "false_positive").when(_c("alert_id") % 3 == 1, "true_positive").otherwise("uncertain").alias("verdict"), F.lit(8).alias("confidence"))
    return guards.verified(alerts, guards.guard_rollup(checks)).select(_c("alert_id").alias("user_id"), "verdict", "confidence", _c("verification_action").alias("action"))


@query(f"""WITH {_JUDGED}, a AS (SELECT doc_id, verdict, disposition, confidence, kind, CASE doc_id % 4 WHEN 0 THEN ['sql_injection'] WHEN 1 THEN ['xss', 'ssrf'] ELSE [] END AS t, CASE WHEN doc_id % 5 = 0 THEN 'unknown' WHEN doc_id % 5 = 1 THEN 'parameterized' ELSE 'concat' END AS style FROM j),
b AS (SELECT *, verdict <> 'uncertain' AND style = 'unknown' AS h1 FROM a), c AS (SELECT *, CASE WHEN h1 THEN 'uncertain' ELSE verdict END AS v1, CASE WHEN h1 THEN least(confidence, 4) ELSE confidence END AS c1, CASE WHEN h1 THEN 'decisive_fact_unknown:sink_param_style' END AS f1 FROM b),
o AS (SELECT *, list_filter(t, lambda x: x <> coalesce(kind, '')) AS oth FROM c), d AS (SELECT *, v1 = 'false_positive' AND len(oth) > 0 AS h2 FROM o), e AS (SELECT *, CASE WHEN h2 THEN 'uncertain' ELSE v1 END AS v2, CASE WHEN h2 THEN least(c1, 4) ELSE c1 END AS c2, CASE WHEN h2 THEN 'bare_fp_buries_actual:' || list_aggregate(oth, 'string_agg', ',') ELSE f1 END AS f2 FROM d),
g AS (SELECT *, v2 = 'true_positive' AND style = 'parameterized' AND len(t) = 1 AS h3 FROM e), h AS (SELECT *, CASE WHEN h3 THEN 'uncertain' ELSE v2 END AS v3, CASE WHEN h3 THEN 6 ELSE c2 END AS c3, CASE WHEN h3 THEN 'parameterized_contradicts_sqli_tp' ELSE f2 END AS f3, CASE WHEN h3 THEN 'likely_tp' ELSE disposition END AS d3 FROM g),
i AS (SELECT *, v3 = 'true_positive' AND c3 > 6 AND doc_id % 2 = 0 AS h4 FROM h), k AS (SELECT *, v3 = 'true_positive' AND c3 > 6 AND NOT h4 AND doc_id % 3 <> 1 AND doc_id % 7 <> 0 AS h5 FROM i)
SELECT doc_id, CASE WHEN h4 OR h5 THEN 'uncertain' ELSE v3 END AS verdict, CASE WHEN h4 OR h5 THEN 'likely_tp' ELSE d3 END AS disposition, CAST(CASE WHEN h4 OR h5 THEN 6 ELSE c3 END AS INTEGER) AS confidence, CASE WHEN h4 THEN 'hollow_tp_no_evidence' WHEN h5 THEN 'ungrounded_data_flow_step' ELSE f3 END AS fail_reason FROM k""")
def guard_chain(spark, sf):
    """The default chain; its fifth rule, too, has its columns."""
    flow = F.array(F.lit("read a.java"), F.concat(F.lit("call m"), _c("doc_id") % 3))
    j = _evidence(spark, sf).withColumns({"data_flow": flow, "hop_anchors": F.array(F.lit("a.java")), "tool_anchors": F.array(F.lit("m1")), "evidence_grounded": _c("doc_id") % 7 == 0})
    return guards.enforce(j).select("doc_id", "verdict", "disposition", "confidence", "fail_reason")


def _evidence(spark, sf):
    kinds = F.when(_c("doc_id") % 4 == 0, F.array(F.lit("sql_injection"))).when(_c("doc_id") % 4 == 1, F.array(F.lit("xss"), F.lit("ssrf"))).otherwise(F.array().cast("array<string>"))
    style = F.when(_c("doc_id") % 5 == 0, "unknown").when(_c("doc_id") % 5 == 1, "parameterized").otherwise("concat")
    return _judged(spark, sf).withColumns({"declared": _c("vulnerability_type"), "actual_types": kinds, "type_mismatch_types": F.array().cast("array<string>"), "decisive_facts": F.create_map(F.lit("sink_param_style"), style), "required_facts": F.array(F.lit("sink_param_style")), "fail_reason": F.lit(None).cast("string"), "exploit_payload": F.when(_c("doc_id") % 2 == 1, "x"), "decisive_checks": F.lit(None).cast("array<map<string,string>>")})


@query(f"WITH {_JUDGED} SELECT DISTINCT lang, first_value(doc_id) OVER (PARTITION BY lang ORDER BY CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 ELSE 1 END DESC, doc_id) AS doc_id FROM j")
def primary_row(spark, sf):
    j = _judged(spark, sf).join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    return summary.primary(j.select("lang", "doc_id", "severity", _c("doc_id").alias("pos")), "lang").select("lang", "doc_id")


@query(f"WITH {_EDGES}, s AS (SELECT DISTINCT dst AS k FROM e WHERE dst % 2 = 0), n AS (SELECT k // 4 AS m, count(*) AS c FROM s GROUP BY 1) SELECT a.i AS method, CASE WHEN coalesce(c, 0) > 1 THEN 'ambiguous' ELSE 'name' END AS tier, CASE WHEN coalesce(c, 0) > 1 THEN NULL ELSE e.src END AS caller FROM (SELECT DISTINCT dst // 4 AS i FROM e) a LEFT JOIN n ON n.m = a.i LEFT JOIN e ON e.dst // 4 = a.i AND coalesce(c, 0) <= 1 WHERE coalesce(c, 0) > 1 OR e.src IS NOT NULL GROUP BY ALL")
def callers_robust(spark, sf):
    e = _edges(spark, sf)
    key = F.when(_c("dst") % 2 == 0, F.concat(F.lit("C.m"), F.floor(_c("dst") / 4), F.lit("("), _c("dst"), F.lit(")"))).otherwise(F.concat(F.lit("C.m"), F.floor(_c("dst") / 4)))
    resolved = _c("dst") % 2 == 0
    rev = e.select(key.alias("callee_key"), _c("src").cast("string").alias("caller_key"), F.lit(1).alias("line"), F.lit("f").alias("file_path"), resolved.alias("resolved"))
    rev = rev.unionByName(rev.where("resolved").withColumns({"callee_key": t.pattern_of(_c("callee_key")), "resolved": F.lit(False)}))
    asked = e.select(F.concat(F.lit("C.m"), F.floor(_c("dst") / 4)).alias("method_key")).distinct()
    out = calls.callers(asked, rev)
    return out.select(F.substring("method_key", 4, 9).cast("long").alias("method"), "tier", _c("caller_key").cast("long").alias("caller")).distinct()


def entry(spark: SparkSession, sf: str) -> DataFrame:
    return policy_findings(spark, sf)


from alertmill.plans import code_queries, path_queries, stream_queries  # noqa: E402, F401  register the queries on code facts, paths and streams
