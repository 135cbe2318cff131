"""Expressions and small parsers."""

import hashlib

import pytest
from pyspark.sql import functions as F

from alertmill.functions import microsyntax as m
from alertmill.functions import text as t
from alertmill.functions import vocab as v


def values(spark, expr, rows, schema):
    return [r.x for r in spark.createDataFrame(rows, schema).coalesce(1).select(expr.alias("x")).collect()]


def test_code_normaliser_order(spark):
    rows = [("a /* x\ny */ b // c\n  d",), ('String u = "http://x.y"; z',), ("",)]
    assert values(spark, t.normalize_code(F.col("c")), rows, "c string") == ["a b d", 'String u = "http:', ""]


def test_alert_fingerprint_uses_line_only_without_function(spark):
    schema = "a struct<file:string,function:string,line:int>, z struct<file:string,function:string,line:int>, p array<struct<file:string,line:int>>"
    rows = [(("A.java", "f(int)", 3), ("B.java", "", 9), [("A.java", 3), ("B.java", 9)]), (("A.java", "f(int)", 4), ("B.java", None, 9), [])]
    got = values(spark, t.alert_fingerprint(F.lit("xss"), F.lit("CWE-79"), F.col("a"), F.col("z"), F.col("p")), rows, schema)
    body = hashlib.sha256(b"").hexdigest()[:16]
    sig = hashlib.sha256(b"A.java:3|B.java:9").hexdigest()[:12]
    want = [f"v5:xss:CWE-79:A.java:f(int):B.java:B.java#9:{body}:{s}" for s in (sig, "")]
    assert got == [hashlib.sha256(w.encode()).hexdigest() for w in want]


def test_paths_and_keys(spark):
    one = lambda f, *xs: values(spark, f(F.col("c")), [(x,) for x in xs], "c string")
    assert one(t.extension, "a/b.JAVA", "a.d/b", ".env", None) == ["java", "", "env", ""]
    assert one(t.slashes, "\\a\\b", "//x", None) == ["a/b", "x", ""]
    assert one(t.dashed, "GPL-3.0 (only)", "--", None) == ["gpl-3-0-only", "", ""]
    assert one(t.slug, "SQL Injection!", "", None) == ["sql_injection", "unknown", "unknown"]
    assert one(t.class_of, "a.B.c(x.Y,Z)", "c()") == ["a.B", ""] and one(t.method_of, "a.B.c(x.Y,Z)") == ["c"]
    assert one(t.param_count, "A.f()", "A.f(Map<String,List<int>>,int)") == [0, 2]
    assert one(t.tokens, "", "abcdefgh") == [1, 2]
    assert values(spark, t.whole_word(F.lit("id"), F.col("c")), [("f(id, x)",), ("grid",), (None,)], "c string") == [True, False, False]


def test_severities_differ_at_nine(spark):
    rows = [("9.0",), ("9.1",), ("7.0",), ("4.0",), (None,), ("abc",)]
    assert values(spark, v.dependency_severity(F.col("c")), rows, "c string") == ["high", "critical", "high", "medium", "low", "low"]
    none = F.lit(None).cast("string")
    assert values(spark, v.rule_severity(F.col("c"), F.lit("error"), none), rows + [("",), ("0",)], "c string") == ["critical", "critical", "high", "medium", "high", "high", "high", "low"]
    assert values(spark, v.rule_severity(none, F.lit(""), F.col("c")), [("note",), (None,), ("odd",)], "c string") == ["low", "medium", "medium"]
    assert values(spark, v.severity_rank(F.col("c")), [(" HIGH ",), ("odd",), (None,)], "c string") == [3, None, None]


def test_types_and_families(spark):
    assert values(spark, v.rule_type(F.col("c")), [("java/sql-injection",), ("java/xss-stored",), ("js/odd-rule",)], "c string") == ["sql_injection", "xss", "odd_rule"]
    assert values(spark, v.family(F.col("c")), [(" IDOR ",), ("path-traversal",), ("xss",)], "c string") == ["access_control", "path_traversal", "xss"]
    assert values(spark, v.cwe_of_tags(F.col("c")), [(["a", "external/cwe/cwe-089"],), ([],)], "c array<string>") == ["CWE-089", "CWE-UNKNOWN"]
    assert values(spark, v.verdict_of(F.col("c")), [("likely_fp",), ("true_positive",), (None,)], "c string") == ["uncertain", "true_positive", "uncertain"]
    assert values(spark, v.recovered_disposition(F.col("c")), [('x "disposition": "likely_tp",',), ('"disposition": "odd"',)], "c string") == ["likely_tp", ""]
    assert values(spark, v.not_nullish(F.col("c")), [(" N/A ",), ("无。",), ("x",), (None,)], "c string") == [None, None, "x", None]
    shown = v.display_type(F.col("c"), F.array(F.lit("x-y")), F.lit("cwe-1"), {"x_y": "XY", "z": "Z"}, {"CWE-1": "one"}, {"zz": "z"})
    assert values(spark, shown, [("ZZ",), ("q",)], "c string") == ["Z", "XY"]


def test_two_test_path_rules(spark):
    rows = [("src/FooTest.java",), ("src/testcase.java",), ("a\\test\\b",), ("src/Latest.java",), ("src/a.java",)]
    assert values(spark, v.test_path(F.col("c")), rows, "c string") == [True, False, False, True, False]
    assert values(spark, v.test_path_wide(F.col("c")), rows, "c string") == [True, True, True, True, False]


def test_citations(spark):
    rows = [("see [跳 2] and (跳3→跳4) [工具:read_file@a/B.java:12]",), ("none",)]
    assert values(spark, m.cited_hops(F.col("c")), rows, "c string") == [[2, 3, 4], []]
    got = values(spark, m.cited_tool(F.col("c")), rows, "c string")
    assert tuple(got[0]) == ("read_file", "a/B.java", 12) and got[1] is None
    assert values(spark, m.without_cites(F.col("c")), [("a [跳1] b",)], "c string") == ["a  b"]
    places = values(spark, m.location(F.col("c")), [("src/A.java:12-19 (sink)",), ("nowhere",), ("n/a",), ("a.b:3",)], "c string")
    assert [tuple(p) for p in places] == [(True, "src/A.java", "12-19", "sink"), (False, "", "", "nowhere"), (False, "", "", ""), (True, "a.b", "3", "")]
    assert m.rewrite_cites("跳2: A.java:9 x 跳3:B", {2: "10"}) == "跳2: A.java:10 x 跳3:B"


def test_fix_and_framing():
    got = m.fix_anchor("[A.java:3] old() → new()\n说明：why")
    assert got == {"has_anchor": True, "loc": "A.java:3", "before": "old()", "after": "new()", "desc": "why"}
    sides = lambda code: tuple(m.fix_anchor(f"A.java:3 {code}\n说明: why")[k] for k in ("before", "after"))
    assert sides("修改前片段 String p = a;\n→ 修改后代码：\nString p = b;") == ("String p = a;", "String p = b;")
    assert sides("修改前：a() → 修改后：b()") == ("a()", "b()") and sides("(f) 修改前片段 a() → b()") == ("a()", "b()")
    assert sides("修改前 → 修改后\n修改前：a()\n修改后：\nb()") == ("a()", "b()")
    assert sides("修改前\na()\n修改后\nb()") == ("a()", "b()") and sides("a()") == ("a()", "")
    # the words inside code are no labels
    assert sides("修改前缀 = 1 → 修改后置(x)") == ("修改前缀 = 1", "修改后置(x)") and sides("foo(bar) → baz") == ("foo(bar)", "baz")
    assert m.fix_anchor("[A.java:3] a → b\n说明：x 修改前 → 修改后：y")["desc"] == "x y"
    assert not m.fix_anchor("text")["has_anchor"] and not m.fix_anchor(None)["has_anchor"]
    assert m.unescape(r"a\nb\\n") == "a\nb\\n" and m.unescape("x\ny\\n") == "x\ny\\n"
    assert m.recovered_fields('v</arg_value><arg_key>odd</arg_key><arg_value>x') == ('v", "odd": x', {})
    assert m.recovered_fields('v", "severity</arg_key>"low", "design_note": null"}') == ("v", {"severity": "low", "design_note": "null"})
    assert m.recovered_fields('v", "severity</arg_key><arg_value>"high"') == ("v", {"severity": "high"}) and m.recovered_fields("plain") == ("plain", {})


def test_json_repair():
    assert m.judge_json('{"a": 1}') == {"a": 1} and m.judge_json('x ```json\n{"a": 1}\n``` y') == {"a": 1} and m.judge_json('say {"a": {"b": 2}} end') == {"a": {"b": 2}}
    assert m.judge_json('{"a": 1, "b": }') == {"a": 1, "b": ""} and m.judge_json('{"a": "x') == {"a": "x"} and m.judge_json("nothing") is None and m.judge_json(None) is None


def test_probes():
    assert m.escapes_base("/base/", "../x") and not m.escapes_base("/base/", "a/b") and m.clean_path("") == "." and m.clean_path("//a//b/..") == "/a"
    assert len(m.PROBES) == 12
    assert m.probe("string_replace", 'replace("../","")', "/base/") == "guard_bypassable"
    assert m.probe("regex", '"[a-z]+"', "/base/") == "guard_effective" and m.probe("odd", "", "/b/") == "not_verifiable"
    body = 'String s = clean(raw);\nrun(s + raw);'
    assert m.variable_bypass(body, ["clean"]) and not m.variable_bypass(body, []) and not m.variable_bypass("String s = clean(raw);\nraw = s;\nrun(s + raw);", ["clean"])
    assert [k for k, *_ in m.guards_in('x.matches("[a-z]+"); #{id} ${name}')] == ["regex", "mybatis_param", "mybatis_concat"]


@pytest.mark.parametrize(("generated", "path", "cwe", "rule"), [(True, "x/README.md", "", "HE-101"), (True, "x/ATest.java", "", "HE-002"), (True, "x/A.java", "", "HE-010"), (None, "build/A.java", "", "HE-102"), (None, "A.java", "CWE-787", "HE-201"), (None, "a.c", "CWE-787", None), (None, "A.java", "CWE-79", None)])
def test_exclusion_is_ordered(spark, generated, path, cwe, rule):
    (got,) = values(spark, v.exclusion_reason(F.col("p"), F.col("g"), F.col("c")), [(path, generated, cwe)], "p string, g boolean, c string")
    assert (got or "").split(" ")[0] == (rule or "")
