"""Readers and writers on small files."""

import json

import pytest
from pyspark.sql import functions as F

from alertmill.operators import history, policy
from alertmill.operators.graph import closure
from alertmill.operators.taint import Store, propagate, seeds
from alertmill.plans import audit as plans
from alertmill.schemas import LABEL
from alertmill.sources import alerts, code, registries, stores


def loc(uri, line, msg=""):
    return {"physicalLocation": {"artifactLocation": {"uri": uri}, "region": {"startLine": line}}, "message": {"text": msg}}


def sarif(tmp_path):
    rules = [{"id": "java/sql-injection", "properties": {"tags": ["external/cwe/cwe-089"], "security-severity": "9.0"}}, {"id": "other", "defaultConfiguration": {"level": "error"}}]
    flow = lambda *ls: {"threadFlows": [{"locations": [{"location": x} for x in ls]}]}
    results = [
        {"ruleId": "java/sql-injection", "locations": [loc("B.java", 9)], "codeFlows": [flow(loc("A.java", 1, "in method get(x)"), loc("B.java", 9, "call to run(y)")), flow(loc("C.java", 2), loc("B.java", 9)), flow()]},
        {"ruleId": "java/sql-injection", "locations": [loc("D.java", 3)], "codeFlows": [flow(loc("A.java", 1), loc("D.java", 3))]},
        {"ruleId": "gone", "ruleIndex": 1, "locations": [loc("src/test/E.java", 4)]},
        {"ruleId": "odd-rule", "level": "note"},
    ]
    p = tmp_path / "a.sarif"
    p.write_text(json.dumps({"runs": [{"tool": {"driver": {"rules": rules}}, "results": results}, {"results": results}]}))
    return str(p)


def test_sarif(spark, tmp_path):
    got = alerts.parse("sarif", alerts.read_sarif(spark, sarif(tmp_path))).collect()
    assert [r.alert_id for r in got] == ["sarif-java/sql-injection-B.java:9#0", "sarif-java/sql-injection-B.java:9#1", "sarif-java/sql-injection-D.java:3", "sarif-gone-src/test/E.java:4", "sarif-odd-rule-:0"]
    a = got[0]
    assert (a.vulnerability_type, a.cwe_id, a.severity, a.source.file, a.source.function, a.sink.function, a.taint_path_complete, len(a.taint_path)) == ("sql_injection", "CWE-089", "critical", "A.java", "get(x)", "run(y)", True, 2)
    assert [r.severity for r in got[3:]] == ["high", "low"] and not got[3].taint_path_complete and len({r.bughash for r in got}) == 5
    with pytest.raises(ValueError):
        alerts.parse("odd", None)
    assert alerts.normalized(alerts.parse("sarif", alerts.read_sarif(spark, sarif(tmp_path)))).first().source.function == "get"


def test_bugs_flatten_traces(spark, tmp_path):
    n = lambda i, f, k, line, part="p": {"traceId": i, "fatherTraceid": f, "kind": k, "bugFile": "\\src\\A.java", "codeBeginline": line, "codePart": part}
    bugs = [
        {"bugId": "1", "ruleCode": "R_CWE-89", "bugLevel": "5", "bugFile": "/src/B.java", "bugBeginline": 7, "bugFunc": "f", "bugTraces": [n("3", "2", 1, 30), n("1", "0", 2, 10, "src"), n("2", "1", 0, 20), n("9", "8", 0, 90), n("5", "6", 0, 50), n("6", "5", 0, 60)]},
        {"bugId": "2", "ruleName": "Odd Rule", "ruleVO": {"level": "1", "refs": [{"referenceType": "CWE", "referenceTypeId": "79"}]}, "bugFile": "C.java", "bugBeginline": 1, "bugFunc": "g", "bugTraces": []},
    ]
    p = tmp_path / "b.json"
    p.write_text(json.dumps({"bugs": bugs}))
    got = {r.alert_id.split("-")[1]: r for r in alerts.parse("bugs", alerts.read_bugs(spark, str(p))).collect()}
    a, b = got["1"], got["2"]
    assert [h.line for h in a.taint_path] == [10, 20, 30, 90, 50, 60] and a.taint_path_complete and a.source.line == 10 and a.source.variable == "src" and a.sink.file == "src/B.java"
    assert (a.severity, a.cwe_id, a.vulnerability_type) == ("high", "CWE-89", "r_cwe_89")
    assert (b.severity, b.cwe_id, b.vulnerability_type, b.source.function, b.taint_path, b.taint_path_complete) == ("low", "CWE-79", "odd_rule", "g", [], False)


def test_audit(spark, tmp_path):
    rows = alerts.sarif_alerts(alerts.read_sarif(spark, sarif(tmp_path)))
    first = rows.first()
    known = spark.createDataFrame([(first.bughash, "true_positive", 9, 1), ("x", "uncertain", 1, 1)], stores.VERDICTS)
    judged = spark.createDataFrame([("sarif-java/sql-injection-B.java:9#1", "false_positive", None, 8, ["a"], None, None, None, None, None, None, None, False)], "alert_id string, verdict string, disposition string, confidence int, type_mismatch_types array<string>, buried_types array<string>, fail_reason string, model_used string, path_broken_at string, sanitization_found string, verification_action string, exploit_payload string, control_flow_mutex boolean")
    cal = spark.createDataFrame([("SQL_injection", True, 0), ("sql_injection", False, 1)], "vulnerability_type string, calibrated boolean, pos int")
    out = plans.audit(rows, judged, known, cal, languages=["java"], least="medium")
    s = out.summary.first()
    assert (s.ai_processed, s.bughash_inherited, s.hard_excluded, s.sast_in, s.human_review_needed, s.type_mismatches) == (2, 1, 1, 4, 2, 1)
    stage = {r.alert_id: (r.stage, r.verdict, r.exclusion_reason) for r in out.details.select("alert_id", "stage", "verdict", "exclusion_reason").collect()}
    assert stage["sarif-gone-src/test/E.java:4"][:2] == ("excluded", "uncertain") and stage["sarif-gone-src/test/E.java:4"][2].startswith("HE-002")
    assert stage[first.alert_id][:2] == ("inherited", "true_positive") and stage["sarif-java/sql-injection-D.java:3"][:2] == ("judged", "uncertain")
    assert [tuple(r) for r in out.skipped_severities.collect()] == [("low", 1)] and out.verdicts.count() == 0
    assert plans.audit(rows, judged, known, cal, mode="experiment").summary.first().bughash_inherited == 0


def test_policy_traps(spark):
    pol = policy.Policy.of({"license_allowlist": ["MIT"], "vuln_min_severity": "typo", "blacklist": [{"name": "a", "ecosystem": "npm", "reason": "r", "severity": "low"}], "copyright_rules": [{"match": "GPL-*", "reason": "x", "severity": "high"}]})
    comp = spark.createDataFrame([("a", "1", "Maven", "", 0), ("a", "2", "npm", "p.json", 1), ("b", "1", "npm", None, 2)], "name string, version string, ecosystem string, source_file string, pos int")
    vul = spark.createDataFrame([("a", "1", "Maven", "G-1", "", "low", "1", "s"), ("b", "1", "npm", "G-2", "CVE-2", "critical", "9.8", "s")], "component string, version string, ecosystem string, osv_id string, cve string, severity string, cvss_score string, summary string")
    lic = spark.createDataFrame([("b", "1", "npm", x) for x in ("MIT", "GPL", "GPL-3.0-only", "A AND B")], "component string, version string, ecosystem string, license string")
    got = {(r.rule_id, r.component, r.version, r.evidence, r.source_file) for r in policy.evaluate(pol, comp, vul, lic).collect()}
    assert got == {("vuln-low", "a", "1", "G-1", "p.json"), ("vuln-critical", "b", "1", "CVE-2", None), ("license-gpl", "b", "1", "GPL", None), ("license-gpl-3-0-only", "b", "1", "GPL-3.0-only", None), ("license-a-and-b", "b", "1", "A AND B", None), ("blacklist-a", "a", "2", "r", "p.json"), ("copyright-gpl", "b", "1", "x（GPL-3.0-only）", None)}
    detail = policy.evaluate(pol, comp, vul, lic).where("component = 'a' and category = 'vulnerability'").first().detail
    assert "cve" not in detail and detail["osv_id"] == "G-1"
    with pytest.raises(ValueError):
        policy.Policy.of({"blacklist": [{"name": "a"}]})


def test_dependency_scan(spark):
    schema = "results array<struct<source:struct<path:string>,packages:array<struct<package:struct<name:string,version:string,ecosystem:string>,vulnerabilities:array<struct<id:string,aliases:array<string>,summary:string>>,groups:array<struct<ids:array<string>,maxSeverity:string>>,licenses:array<string>>>>>"
    pk = (("lib", "1", "npm"), [("G-1", ["X", "CVE-1"], "s"), ("G-2", None, "t")], [(["G-1", "G-2"], "5.0"), (["G-1"], "9.1")], ["MIT", "GPL-2.0"])
    tables, found = plans.dependency_scan(spark.createDataFrame([([(("lock",), [pk])],)], schema), policy.Policy(license_allowlist=("MIT",), vuln_min_severity="high"))
    assert tables["components"].first().license == "MIT AND GPL-2.0"
    assert {(r.osv_id, r.cve, r.severity, r.cvss_score) for r in tables["vulns"].collect()} == {("G-1", "CVE-1", "critical", "9.1"), ("G-2", "", "medium", "5.0")}
    assert {(r.rule_id, r.source_file) for r in found.collect()} == {("vuln-critical", "lock"), ("license-gpl-2-0", "lock")}


def test_runs_and_labels(spark, tmp_path):
    base, log = str(tmp_path / "runs"), str(tmp_path / "labels")
    details = spark.createDataFrame([("h1", "true_positive", None), ("h1", "uncertain", None), ("h2", "false_positive", "HE-1"), ("h3", "uncertain", None)], "bughash string, verdict string, exclusion_reason string")
    one = spark.createDataFrame([(1,)], "ai_processed int")
    for run in ("2024_r", "2025_r"):
        stores.write_run(base, run, {"repo_key": "r"}, details, details, one, details.select("bughash"))
    assert [r.run_id for r in stores.list_runs(spark, base).collect()] == ["2025_r", "2024_r"]
    rows = [(1, "2024_r", "h1", "a", "uncertain", "confirmed"), (2, "2024_r", "h1", "a", "true_positive", None), (3, "2025_r", "h3", "a", "uncertain", "")]
    stores.append_labels(spark.createDataFrame(rows, "seq long, run_id string, bughash string, alert_id string, label string, status string"), log)
    with pytest.raises(ValueError):
        stores.append_labels(spark.createDataFrame([(9, "r", "h", "a", "odd", "candidate")], "seq long, run_id string, bughash string, alert_id string, label string, status string"), log)
    labels = stores.read(spark, log, LABEL)
    got, left = stores.get_run(spark, base, "2024_r", labels)
    assert {(r.bughash, r.label, r.label_status) for r in got.collect()} == {("h1", "true_positive", "candidate"), ("h2", None, None), ("h3", None, None)} and left.first()[0] == 1
    assert [r.seq for r in history.label_history(labels, "2024_r", "h1").collect()] == [1, 2]
    assert stores.get_alert(spark, base, "2024_r", "h1")[0].count() == 2 and stores.traces_of(details, details.select("bughash").distinct()).count() == 1
    assert not stores.delete_run(spark, base, "../x") and stores.delete_run(spark, base, "2024_r") and not stores.delete_run(spark, base, "2024_r")
    text = ['{"run_id": "r", "bughash": "h", "label": "uncertain"}', "", "// note", "{broken", '{"run_id": "r", "bughash": "h", "label": "true_positive"}']
    parsed = stores.parse_label_log(spark.createDataFrame(list(enumerate(text)), "seq long, line string"))
    assert sorted((r.seq, r.label) for r in parsed.collect()) == [(0, "uncertain"), (4, "true_positive")]


def test_keyed_stores(spark, tmp_path):
    path = str(tmp_path / "v")
    put = lambda *rows: stores.put_verdicts(spark, path, spark.createDataFrame(list(rows), stores.VERDICTS))
    put(("a", "true_positive", 8, 1), ("a", "uncertain", 2, 2), ("b", "false_positive", 9, 1))
    put(("b", "true_positive", 7, 0))
    assert sorted(tuple(r)[:2] for r in stores.read(spark, path, stores.VERDICTS).collect()) == [("a", "uncertain"), ("b", "true_positive")]
    assert stores.verdict_of(spark, path, "zz").count() == 0 and stores.completed(spark, str(tmp_path / "none")).count() == 0
    cache = spark.sql("select * from values ('k', 'true_positive', 5, timestamp'2024-01-01 00:00:00'), ('u', 'uncertain', 5, timestamp'2024-01-01 00:00:00') t(key, verdict, confidence, created_at)")
    ask = spark.createDataFrame([("k",), ("u",)], "key string")
    hit = lambda s: {r.key: r.cached_verdict for r in history.cache_lookup(ask, cache, F.lit(s).cast("timestamp"), 60).collect()}
    assert hit("2024-01-01 00:01:00") == {"k": "true_positive", "u": None} and hit("2024-01-01 00:01:01")["k"] is None
    assert history.purge(cache, F.lit("2024-01-01 00:01:00").cast("timestamp"), 60).count() == 2 and history.purge(cache, F.lit("2024-01-01 00:01:01").cast("timestamp"), 60).count() == 0


def test_scan_store(spark, tmp_path):
    base = str(tmp_path)
    comp = spark.createDataFrame([("a", "1", "npm", "f", 0)], "name string, version string, ecosystem string, source_file string, pos int")
    vul = spark.createDataFrame([("a", "1", "npm", "G", "", "low", "1", "s")], "component string, version string, ecosystem string, osv_id string, cve string, severity string, cvss_score string, summary string")
    lic = spark.createDataFrame([("a", "1", "npm", "GPL")], "component string, version string, ecosystem string, license string")
    tables = {"components": comp, "vulns": vul, "licenses": lic}
    pol = policy.Policy(license_allowlist=("GPL",), vuln_min_severity="high")
    stores.save_scan(base, stores.scan_id("my repo"), tables, policy.evaluate(pol, comp, vul, lic), {"repo_key": "my repo", "status": "done"})
    assert stores.list_scans(spark, base, "my repo").first().scan_id == "my_repo"
    assert stores.reevaluate(spark, base, "my_repo", policy.Policy()).count() == 2


def test_mapper_and_config(spark):
    xml = '<mapper namespace="a.b.M">\n<select id="q"> select * from t where n = ${n} <!-- #{x} --> </select><update id="u">set x=#{x}</update><insert id="open">'
    got = {r.id: r for r in code.mappers(spark.createDataFrame([("M.xml", xml)], "path string, content string")).collect()}
    assert set(got) == {"q", "u"} and got["q"].has_concat and not got["q"].has_param and got["u"].has_param and got["q"].line == 2 and got["q"].short_class == "M"
    files = [("application.properties", "a=1\n# no\nb=x\\\n y\nc=${a}-${zz:d}\nl1=${l2}\nl2=${l1}"), ("application-dev.properties", "a=2\nd=${e}\ne=ok"), ("application.yml", "s:\n  t: 5 # five\n  u:\n    v: 'w'")]
    entries = code.config(spark.createDataFrame(files, "path string, content string"))
    merged = code.merged_config(entries, ["dev"])
    got = {r.key: r.value for r in code.resolved_config(merged).collect()}
    assert got["a"] == "1" and got["b"] == "xy" and got["c"] == "1-d" and got["d"] == "ok" and got["s.t"] == "5" and got["s.u.v"] == "w" and "${l" in got["l1"]
    assert "e" not in {r.key for r in code.merged_config(entries, []).collect()}


JAVA = """package p;
/* class Fake { } */
@RestController
public class A extends Base implements I {
    private String name;
    @GetMapping("/x")
    public String get(@RequestParam String q, int n) {
        this.name = q;
        Helper h = null; // helper.run(q)
        if (n > 1) { Helper.run(q, "a(b)"); }
        return name;
    }
    private Helper helper;
    String show(String z) { return helper.run(z, 1); }
}
class Base { }
class Helper { static String run(String s, String t) { return s; } }
interface I { String get(String q, int n); }
"""


def test_java_facts_to_taint(spark):
    tables = code.fact_tables(code.java(spark.createDataFrame([("p/A.java", JAVA)], "path string, content string")).cache())
    assert {r.method_key for r in tables["methods"].collect()} == {"p.A.get(String,int)", "p.A.show(String)", "p.Helper.run(String,String)", "p.I.get(String,int)"}
    assert [tuple(r) for r in tables["class_parent"].collect()] == [("p.A", "p.Base")] and [tuple(r) for r in tables["class_iface"].collect()] == [("p.A", "p.I")]
    assert {(r.caller_key, r.callee_class, r.callee_method, r.arg_count) for r in tables["call_edges"].collect()} == {("p.A.get(String,int)", "p.Helper", "run", 2), ("p.A.show(String)", "p.Helper", "run", 2)}
    empty = lambda s: spark.createDataFrame([], s)
    store = Store({**tables, "call_return_to_local": empty("callee_key string, caller_key string, local string"), "local_sources": empty("method_key string, local string, source string"), "local_returned": empty("method_key string, local string"), "local_to_field": empty("method_key string, local string, field_key string"), "call_site_field": empty("callee_key string, callee_class string, callee_method string, arg_count int, caller_key string, line int, field_key string"), "field_assignments": empty("field_key string, method_key string, line int"), "field_edges": empty("src_field string, dst_field string"), "return_sources": empty("method_key string, source string"), "field_read_params": empty("field_key string, method_key string, param_name string")})
    seed = seeds(empty("field_key string, source_type string, source_method string, source_field string"), spark.createDataFrame([("p.A.get(String,int)", "q", "http")], "method_key string, param_name string, source string"), empty("method_key string, source string"), empty("caller_key string, callee_class string, callee_method string, arg_index int, source string"), tables["method_params"])
    got = {(r.location_type, r.location_key, r.param_name) for r in propagate(seed, store).collect()}
    assert got == {("method_param", "p.A.get(String,int)", "q"), ("field", "p.A.name", ""), ("method_return", "p.A.get(String,int)", ""), ("method_param", "p.Helper.run(String,String)", "s"), ("method_return", "p.Helper.run(String,String)", "")}
    assert closure(tables["class_parent"].select(F.col("class").alias("src"), F.col("parent").alias("dst")), spark.createDataFrame([("p.A",)], "start string")).count() == 2


def test_registries(spark, tmp_path):
    reg = spark.createDataFrame([(0, "sqli", "CWE-089", ["sql"]), (1, "other", "CWE-89", ["SQL", "x"])], "pos int, vulnerability_type string, cwe string, aliases array<string>")
    assert {r.alias: r.vulnerability_type for r in registries.first_claims(reg).collect()} == {"sqli": "sqli", "sql": "sqli", "other": "other", "x": "other"}
    assert [tuple(r) for r in registries.type_of_cwe(reg).collect()] == [(89, "sqli")]
    bad = spark.createDataFrame([("function_keywords", "("), ("function_keywords", "a+"), ("paths", "(")], "kind string, pattern string")
    assert registries.usable_signals(bad).count() == 2 and registries.sinks(spark).where("benign").count() == 14
    p = tmp_path / "r.json"
    p.write_text('[{"a": "x"}]')
    with pytest.raises(Exception):  # noqa: B017
        registries.read_json(spark, str(p), "a int").collect()


def test_listing_pages(spark):
    body = lambda *ids: json.dumps({"totalCount": 4, "list": [{"bugId": i, "level": n, "ruleCode": "r"} for i, n in ids]})
    pages = spark.createDataFrame([(2, body(("b", 5), ("d", 5))), (1, body(("a", 5), ("b", 1), (None, 5)))], "page int, body string")
    assert [(r.bugId, r.level) for r in alerts.bug_listing(pages).collect()] == [("a", 5), ("b", 1), ("d", 5)]
    assert [r.bugId for r in alerts.bug_listing(pages, levels=[5], limit=1).collect()] == ["a"]


def test_paged_source(spark):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from alertmill.sources.rest import PagedListing

    class H(BaseHTTPRequestHandler):
        def do_GET(self):
            page = int(self.path.rpartition("=")[2])
            self.send_response(500 if page == 2 else 200)
            self.end_headers()
            self.wfile.write(json.dumps({"totalCount": 5, "page": page}).encode())

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), H)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(PagedListing)
    got = spark.read.format("paged_listing").option("url", f"http://127.0.0.1:{server.server_port}/?page={{page}}").option("pagesize", 2).load().collect()
    server.shutdown()
    assert sorted(r.page for r in got) == [1, 3]
