"""Schemas of alerts, judgements, dependency scans and code facts."""

from __future__ import annotations

LOCATION = "struct<file:string,line:int,function:string,variable:string,message:string>"
HOP = "struct<file:string,function:string,line:int,message:string>"
ALERT = (
    "alert_id string, bughash string, vulnerability_type string, cwe_id string, severity string, "
    f"source {LOCATION}, sink {LOCATION}, taint_path array<{HOP}>, taint_path_complete boolean, is_generated boolean, raw_output string"
)
JUDGEMENT = (
    "alert_id string, bughash string, vulnerability_type string, verdict string, disposition string, severity string, confidence int, "
    "type_mismatch_types array<string>, buried_types array<string>, actual_types array<string>, fail_reason string, model_used string, "
    "path_broken_at string, sanitization_found string, verification_action string, control_flow_mutex boolean, exploit_payload string, "
    "decisive_checks array<map<string,string>>, missing_info string"
)
LABEL = "seq long, run_id string, bughash string, alert_id string, label string, status string, labeler string, labelled_at string, note string"
# fixed values: what a label and its status may be
LABELS = ("true_positive", "false_positive", "uncertain", "needs-hardening")
STATUSES = ("candidate", "confirmed")

COMPONENT = "name string, version string, ecosystem string, license string, direct_or_transitive string, source_file string"
VULNERABILITY = "component string, version string, ecosystem string, osv_id string, cve string, severity string, cvss_score string, summary string"
LICENSE = "component string, version string, ecosystem string, license string"
FINDING = "rule_id string, category string, severity string, component string, version string, ecosystem string, evidence string, source_file string, detail map<string,string>"

METHODS = "method_key string, class string, method string, line int, file_path string, param_count int, is_entry boolean, entry_type string, http_path string, http_method string, is_test boolean, is_native boolean"
CALL_EDGES = "caller_key string, callee_class string, callee_method string, line int, file_path string, arg_count int, confidence string, rule string, condition string, call_type string"
FACTS = "location_type string, location_key string, param_name string, source_type string, source_method string, source_field string"
FACT_KEY = ("location_type", "location_key", "param_name", "source_type", "source_method", "source_field")
SINKS = "key string, vuln_type string, cwe string, severity int, benign boolean, source_side boolean"
