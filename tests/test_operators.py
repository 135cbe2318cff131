"""Operators on small rows, the traps of their rules among them."""

import random

import pytest
from pyspark.sql import functions as F

from alertmill.operators import calls, faces, graph, guards, history, ranges, routing, search, stability, summary, taint


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def make(spark, schema, *data):
    return spark.createDataFrame(list(data), schema)


# ---- routing ----


def test_filters_fail_open(spark):
    df = make(spark, "f string, s string", ("a.java", "HIGH"), ("", "odd"), ("b.PY", "low"), ("c", None))
    kept, skipped = routing.language_filter(df, F.regexp_extract("f", r"\.(\w+)$", 1), [" Java "])
    assert [r[0] for r in rows(kept)] == ["", "a.java", "c"] and rows(skipped) == [("py", 1)]
    assert routing.language_filter(df, F.col("f"), ["java", "*"])[0].count() == 4 and routing.language_filter(df, F.col("f"), [])[0].count() == 4
    kept, skipped = routing.severity_filter(df, F.col("s"), "Medium")
    assert kept.count() == 3 and rows(skipped) == [("low", 1)] and routing.severity_filter(df, F.col("s"), "typo")[0].count() == 4
    got = df.select(routing.alert_language(F.col("f"), F.lit("z.Go")).alias("x")).collect()
    assert [r.x for r in got] == ["java", "go", "py", ""]


def test_resume_and_selection(spark):
    a = make(spark, "alert_id string, bughash string, exclusion_reason string, verdict string, vulnerability_type string, label string, label_status string", ("1", "x", None, "true_positive", "xss: stored", "true_positive", "confirmed"), ("2", "y", "HE", "uncertain", "xss", None, None), ("3", "z", "", "true_positive", "idor", "needs-hardening", "candidate"))
    done = make(spark, "alert_id string, fail_reason string", ("1", None), ("3", "timeout"))
    assert [r[0] for r in rows(routing.resume(a, done))] == ["2", "3"]
    sel = routing.selected(a, make(spark, "bughash string", ("x",), ("y",), ("x",)))
    assert sel.count() == 1 and rows(routing.selection_counts(a)) == [(1, 1, 1)]
    kept, gone = routing.environment_exemption(a, ["xss"], [], public=False)
    assert [r.alert_id for r in gone.collect()] == ["1"] and kept.count() == 2 and not gone.first().forced
    kept, gone = routing.environment_exemption(a, ["xss"], ["x"], False)
    assert kept.count() == 3 and [(r.alert_id, r.forced) for r in gone.collect()] == [("1", True)] and routing.environment_exemption(a, ["xss"], [], True)[1].count() == 0
    assert rows(routing.fail_open(a.limit(1), F.lit("boom"), "m").select("verdict", "confidence", "fail_reason")) == [("uncertain", 0, "boom")]


def test_entry_points(spark):
    df = make(spark, "m array<string>, c array<string>", (["GetMapping"], ["RestController"]), (["GetMapping", "ResponseBody"], []), (["GetMapping"], []), (["ExceptionHandler"], ["ControllerAdvice"]), (["ExceptionHandler"], []), (["Bean", "Scheduled"], []), (["Scheduled"], None), (["KafkaListener"], []), (["EventListener"], []), (["Around", "PostConstruct"], []), (["PostConstruct"], []), ([], []))
    got = [r.x for r in df.coalesce(1).select(routing.entry_point(F.col("m"), F.col("c")).alias("x")).collect()]
    assert got == ["HTTP", "HTTP", "", "HTTP", "", "CONTAINER", "SCHEDULED", "MESSAGE_LISTENER", "EVENT_LISTENER", "", "CONTAINER", ""]
    p = make(spark, "a string, b string", ("/api/", "//x/"), (None, ""), ("a", "b")).coalesce(1).select(routing.http_path(F.col("a"), F.col("b")).alias("x"))
    assert [r.x for r in p.collect()] == ["/api/x", "/", "/a/b"]


def test_sinks(spark):
    base = make(spark, "key string, vuln_type string, cwe string, severity int, benign boolean, source_side boolean", ("A.run", "x", "CWE-1", 5, False, False), ("run", "y", "CWE-2", 4, False, False), ("log", "l", "CWE-3", 1, True, False))
    cat = routing.catalogue(base, base.where("key = 'run'").withColumn("vuln_type", F.lit("z")))
    c = make(spark, "callee_class string, callee_method string", ("A", "run"), ("B", "run"), ("B", "log"), ("B", "other"))
    got = {(r.callee_class, r.callee_method): (r.sink_type, r.is_benign) for r in routing.sink_match(c, cat).collect()}
    assert got == {("A", "run"): ("x", False), ("B", "run"): ("z", False), ("B", "log"): (None, True), ("B", "other"): (None, False)}
    dyn = routing.dynamic_sinks(make(spark, "caller_key string, callee_class string, callee_method string, line int, is_builder boolean", ("m", "a.M", "q", 1, False), ("m", "M", "q", 2, False), ("m", "M", "p", 3, False), ("m", "E", "createQuery", 4, True), ("m", "E", "createQuery", 5, True)), make(spark, "namespace string, short_class string, id string, has_concat boolean", ("a.M", "M", "q", True), ("a.M", "M", "p", False)), make(spark, "caller_key string, line int", ("m", 4)))
    assert sorted(r.line for r in dyn.collect()) == [1, 2, 4]
    names = routing.candidate_callees(make(spark, "key string, pos int, code string", ("k", 0, "a(b(1)); if (x)"), ("k", 1, "b(2)")), ["if"])
    assert rows(names) == [("k", "a", 0), ("k", "b", 0)]


# ---- graphs ----


def edges(spark, *pairs):
    return make(spark, "src string, dst string", *pairs)


def starts(spark, *names):
    return make(spark, "start string", *[(n,) for n in names])


def test_closure_is_bfs(spark):
    rng = random.Random(4)
    pairs = {(str(rng.randrange(25)), str(rng.randrange(25))) for _ in range(45)}
    got = {(r.start, r.node): r.depth for r in graph.closure(edges(spark, *pairs), starts(spark, "0", "1")).collect()}
    want = {}
    for s in ("0", "1"):
        front, depth = {s}, 0
        want[s, s] = 0
        while front:
            depth += 1
            front = {b for a, b in pairs if a in front and (s, b) not in want}
            want |= {(s, b): depth for b in front}
    assert got == want
    assert graph.closure(edges(spark, *pairs).limit(0), starts(spark, "0")).count() == 1


def test_paths_and_chains(spark):
    e = edges(spark, ("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("c", "d"))
    p = {r.path for r in graph.simple_paths(e, starts(spark, "a"), 3).select(F.array_join("path", "").alias("path")).collect()}
    assert p == {"a", "ab", "ac", "abc", "acd", "abcd"}
    longest = graph.longest_to(graph.simple_paths(e, starts(spark, "a"), 3), make(spark, "node string", ("d",))).first()
    assert longest.path == ["a", "b", "c", "d"]
    stop = make(spark, "node string", ("c",))
    assert graph.simple_paths(e, starts(spark, "a"), 3, stop).where("node = 'd'").count() == 0
    tree = graph.caller_tree(e, starts(spark, "a"), 5)
    assert tree.where("cycle").count() == 2 and tree.agg(F.max("level")).first()[0] == 3
    wide = edges(spark, *[(f"c{i}", "m") for i in range(7)], ("x", "c6"))
    info = make(spark, "node string, is_entry boolean, is_test boolean", ("c6", True, False), ("c0", False, True))
    chain = graph.bounded_chain(wide, info, starts(spark, "m"), 2, 2).collect()
    assert sorted((r.caller, r.level, r.truncated) for r in chain) == [("c1", 1, 5), ("c6", 1, 5), ("x", 2, 0)]


def test_orders(spark):
    e = edges(spark, ("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("x", "y"), ("y", "x"))
    got = {r.node: r.level for r in graph.topological_levels(e, e.select(F.col("src").alias("node")).union(e.select("dst"))).collect()}
    assert got == {"a": 0, "b": 1, "c": 1, "d": 2, "x": None, "y": None}
    n = make(spark, "g int, ord int, node string, parent string", (1, 0, "c", "b"), (1, 1, "a", "0"), (1, 2, "b", "a"), (1, 3, "z", "gone"), (1, 4, "p", "q"), (1, 5, "q", "p"), (2, 0, "a", ""))
    assert rows(graph.preorder(n, "g").orderBy("g", "rank")) == sorted([(1, "a", 1), (1, "b", 2), (1, "c", 3), (1, "z", 4), (1, "p", 5), (1, "q", 6), (2, "a", 1)], key=str)


def test_hierarchy(spark):
    par, ifc = make(spark, "class string, parent string", ("C", "B"), ("B", "A")), make(spark, "class string, iface string", ("A", "I"), ("I", "J"), ("Z", "J"))
    assert {tuple(r) for r in graph.implementations(par, ifc).collect()} >= {("I", "A"), ("I", "B"), ("I", "C"), ("J", "A"), ("J", "B"), ("J", "C"), ("J", "Z")}
    members = make(spark, "owner string, member string, key string, params int", ("A", "m", "A.m(x)", 1), ("A", "m", "A.m()", 0), ("I", "m", "I.m()", 0), ("B", "n", "B.n()", 0))
    asked = make(spark, "class string, member string, args int", ("C", "m", 1), ("C", "m", 9), ("C", "n", 3))
    assert rows(graph.nearest_member(asked, members, par, ifc).select("member", "args", "key")) == [("m", 1, "A.m(x)"), ("m", 9, "A.m()"), ("n", 3, "B.n()")]
    got = graph.inherited_methods(par, make(spark, "class string, signature string", ("A", "m"), ("A", "k"), ("B", "m")))
    assert rows(got) == [("B", "A", "k"), ("C", "A", "k"), ("C", "B", "m")]


# ---- taint and calls ----


def test_return_rule_is_negated_by_seeds_only(spark):
    empty = lambda s: make(spark, s)
    store = taint.Store({
        "call_return_to_local": make(spark, "callee_key string, caller_key string, local string", ("g", "f", "x"), ("g", "h", "y")),
        "local_sources": make(spark, "method_key string, local string, source string", ("f", "x", "s1")),
        "local_returned": make(spark, "method_key string, local string", ("f", "x"), ("h", "y")),
        "local_to_field": make(spark, "method_key string, local string, field_key string", ("h", "y", "F.a")),
        "field_edges": make(spark, "src_field string, dst_field string", ("F.a", "F.b"), ("F.b", "F.a")),
    })
    rules = {k: taint.RULES[k] for k in ("return_to_caller", "field_to_field")}
    f = "field_key string, source_type string, source_method string, source_field string"
    seed = taint.seeds(empty(f), empty("method_key string, param_name string, source string"), make(spark, "method_key string, source string", ("g", "s1"), ("g", "s2")), empty("caller_key string, callee_class string, callee_method string, arg_index int, source string"), empty("method_key string, param_name string, ord int"))
    facts = taint.propagate(seed, store, rules)
    got = {(r.location_key, r.source_method) for r in facts.collect()}
    assert got == {("g", "s1"), ("g", "s2"), ("f", "s2"), ("h", "s1"), ("h", "s2"), ("F.a", "s1"), ("F.a", "s2"), ("F.b", "s1"), ("F.b", "s2")}
    assert taint.propagate(seed, store, rules, max_rounds=1).where("location_key = 'F.b'").count() == 0
    assert taint.sync(facts)["returns"].count() == 5 and taint.derivations(facts, store, rules).where("size(paths) > 1").count() > 0


def test_argument_seed_binds_to_an_overload_with_room(spark):
    params = make(spark, "method_key string, param_name string, ord int", ("C.m(a)", "p", 0), ("C.m(a,b)", "q", 0), ("C.m(a,b)", "r", 1))
    empty = lambda s: make(spark, s)
    got = taint.seeds(empty("field_key string, source_type string, source_method string, source_field string"), empty("method_key string, param_name string, source string"), empty("method_key string, source string"), make(spark, "caller_key string, callee_class string, callee_method string, arg_index int, source string", ("f", "C", "m", 1, "s"), ("f", "C", "m", 0, "s")), params)
    assert sorted((r.location_key, r.param_name) for r in got.collect()) == [("C.m(a)", "p"), ("C.m(a,b)", "r")]


def test_callers(spark):
    rev = make(spark, "callee_key string, caller_key string, line int, file_path string, resolved boolean", ("A.f(int)", "x", 1, "p", True), ("A.f(int)", "x", 1, "p", True), ("A.f(String)", "y", 2, "p", True), ("A.g", "z", 3, "p", False), ("A.g()", "w", 4, "p", True))
    got = {(r.method_key, r.tier, r.caller_key) for r in calls.callers(make(spark, "method_key string", ("A.f(int)",), ("A.f",), ("A.g",), ("A.none",)), rev).collect()}
    assert got == {("A.f(int)", "exact", "x"), ("A.f", "ambiguous", None), ("A.g", "name", "z")}
    keys = calls.callee_keys(make(spark, "callee_class string, callee_method string", ("A", "f"), ("A", "h")), make(spark, "method_key string", ("A.f(int)",), ("A.f(String)",), ("A.h",), ("A.h(int)",)))
    assert rows(keys.select("callee_key")) == [("A.f(String)",), ("A.f(int)",), ("A.h",)]


def test_danger_reasons(spark):
    e = make(spark, "caller_key string, callee_key string, ord int, call_type string, sink_type string, sink_cwe string", ("a", None, 0, "direct", "sql", "89"), ("a", None, 1, "direct", "xss", "79"), ("a", "b", 2, "direct", None, None), ("b", None, 0, "direct", "cmd", "78"), ("c", "b", 0, "direct", None, None), ("d", None, 0, "reflection", None, None), ("e", None, 0, "interface", None, None), ("f", None, 0, "native", None, None), ("g", None, 0, "unresolved", None, None), ("h", "i", 0, "direct", None, None))
    got = {r.start: (r.dangerous, r.vuln, r.reason) for r in calls.danger(starts(spark, *"abcdefghs"), e, make(spark, "method_key string, sink_type string, sink_cwe string", ("s", "ssrf", "918")), make(spark, "caller_key string", ("f",))).collect()}
    assert got["a"] == (True, "sql+xss", "DANGER_HIT") and got["c"] == (True, "cmd", "INDIRECT_DANGER") and got["s"] == (True, "ssrf", "SINK_SELF")
    assert [got[x][2] for x in "defgh"] == ["REFLECTION_UNRESOLVED", "PROXY_UNRESOLVED", "NATIVE_UNRESOLVED", "LAMBDA_UNTRACED", "VERIFIED_SAFE"]
    deep = make(spark, e.schema.simpleString()[7:-1].replace(":", " "), ("a", "b", 0, "direct", None, None), ("b", "c", 0, "direct", None, None))
    assert calls.danger(starts(spark, "a"), deep, make(spark, "method_key string, sink_type string, sink_cwe string"), make(spark, "caller_key string"), max_depth=1).first().reason == "DEPTH_TRUNCATED"


def test_added_edges(spark):
    e = make(spark, "caller_key string, callee_class string, callee_method string, line int, file_path string, arg_count int", ("f", "I", "m", 1, "p", 1))
    meth = make(spark, "method_key string, class string, method string, param_count int", ("A.m(x)", "A", "m", 1), ("B.m()", "B", "m", 0), ("C.m(x)", "C", "m", 1))
    assert rows(calls.polymorphic(e, meth, make(spark, "iface string, class string", ("I", "A"), ("I", "B"))).select("callee_class")) == [("A",)]
    pub = calls.published(make(spark, "publisher_key string, event_type string, line int, file_path string", ("P.p()", "E", 1, "f")), make(spark, "event_type string, listener_key string", ("E", "L.a(E)"), ("Child", "L.b(E)"), ("If", "L.c(E)"), ("Other", "L.d(E)")), make(spark, "class string, parent string", ("Child", "E")), make(spark, "class string, iface string", ("E", "If")))
    assert rows(pub.select("callee_method")) == [("a",), ("b",), ("c",)]
    adv = calls.advised(make(spark, "advice_key string, kind string, pointcut string", ("X.before()", "Before", "execution(* p.S.*(..))"), ("X.after()", "After", "p.S.run")), make(spark, "method_key string", ("p.S.run(int)",), ("q.T.run()",)))
    assert rows(adv.select("caller_key", "callee_class", "callee_method")) == [("X.before()", "p.S", "run"), ("p.S.run(int)", "X", "after")]
    life = calls.lifecycle_entries(make(spark, "class string, method string, is_entry boolean", ("A", "init", None), ("A", "x", None)), make(spark, "class string, iface string", ("A", "Init")), make(spark, "iface string, method string", ("Init", "init")))
    assert rows(life.select("method", "is_entry")) == [("init", True), ("x", False)]


# ---- faces, guards, summary ----


def test_faces(spark):
    schema = "pos int, bughash string, alert_id string, verdict string, actual_types array<string>, authz struct<method_guard:boolean,class_guard:boolean,global_interceptor:string>"
    none = (False, False, "none")
    a = make(spark, schema, (0, "h0", "x-A.java:1", "true_positive", ["IDOR"], none), (1, "h1", "x-A.java:2", "false_positive", ["xss"], none), (2, "h2", "x-A.java:3", "uncertain", ["cwe-862"], none), (3, "h3", "x-A.java:4", "uncertain", [], None), (4, "h4", "x-B.java:1", "uncertain", [], none), (5, "h5", "x-A.java:9", "true_positive", ["xss"], none))
    g = faces.Grouping("authz", faces.authz_shape(), ("access_control",))
    assert rows(faces.sibling_faces(a, g)) == [("h1", "access_control", "inconsistent_within_run", "h0", 1)]
    past = make(spark, "bughash string, family string", ("h1", "access_control"), ("h1", "xss"))
    assert rows(faces.sibling_faces(a, g, past)) == [("h1", "access_control", "regressed_from_history", None, 2)]
    old = make(spark, "run_id string, bughash string, verdict string, actual_types array<string>", ("1", "a", "true_positive", ["idor"]), ("2", "b", "true_positive", ["IDOR", "id_or"]), ("3", "c", "uncertain", ["idor"]))
    assert rows(history.history_faces(old, 2)) == [("b", "access_control")]
    traces = make(spark, "bughash string, seq int, authz string, upload string", ("a", 1, "x", "u1"), ("a", 2, None, "u2"), ("b", 1, "y", "u3"))
    assert rows(history.attach_facts(make(spark, "bughash string", ("a",), ("b",)), traces)) == [("a", None, None), ("b", "y", "u3")]


def test_verified(spark):
    j = make(spark, "alert_id string, verdict string, confidence int", ("1", "false_positive", 9), ("2", "true_positive", 9), ("3", "true_positive", 9), ("4", "false_positive", 9), ("5", "uncertain", 5))
    c = make(spark, "alert_id string, status string, kind string", ("1", "guard_bypassable", "x"), ("2", "guard_effective", "x"), ("3", "guard_effective", "x"), ("3", "x", "variable_bypass"), ("4", "guard_effective", "x"))
    got = {r.alert_id: (r.verdict, r.confidence, r.verification_status) for r in guards.verified(j, guards.guard_rollup(c)).collect()}
    assert got == {"1": ("uncertain", 4, "contradicted"), "2": ("uncertain", 4, "contradicted"), "3": ("true_positive", 9, "bypass_confirmed_tp_kept"), "4": ("false_positive", 9, "guard_effective"), "5": ("uncertain", 5, "kept")}
    d = make(spark, "verdict string, disposition string, confidence int, dynamic_outcome string, refuted boolean", ("false_positive", None, 9, "CONFIRMED", False), ("true_positive", None, 9, "NOT_REPRODUCED", True), ("true_positive", None, 9, "INCONCLUSIVE", True), ("true_positive", None, 9, None, True))
    assert [r.verdict for r in guards.dynamic(d.coalesce(1)).collect()] == ["uncertain", "uncertain", "true_positive", "true_positive"] and guards.dynamic(d, "off") is d
    assert [r.verdict for r in guards.falsified(d.coalesce(1)).collect()][2:] == ["uncertain", "uncertain"] and [r.verdict for r in guards.falsified(d.coalesce(1), parity=True).collect()][2:] == ["true_positive", "uncertain"]


def test_grounding_and_required_facts(spark):
    j = make(spark, "verdict string, disposition string, confidence int, fail_reason string, data_flow array<string>, hop_anchors array<string>, tool_anchors array<string>, evidence_grounded boolean, declared string, actual_types array<string>, decisive_facts map<string,string>", ("true_positive", None, 9, None, ["in A.java", "made up"], ["A.java"], None, None, "SQLi", [], {"style": "unknown"}), ("true_positive", None, 9, None, ["in A.java"], ["A.java"], None, None, "xss", ["sqli"], {"style": "concat"}))
    assert [r.verdict for r in guards.grounded_data_flow(j.coalesce(1)).collect()] == ["uncertain", "true_positive"]
    need = make(spark, "vulnerability_type string, facts array<string>", ("sqli", [" Style "]))
    assert sorted((r.verdict, r.fail_reason or "") for r in guards.decisive_fact_known(j, need).collect()) == [("true_positive", ""), ("uncertain", "decisive_fact_unknown:style")]


def test_styles_and_roles(spark):
    df = make(spark, "b string, m boolean", ("x = ${a}", True), ("x = ${a}", False), ("#{a} prepareStatement", False), ("#{a}", False), ("plain", True)).coalesce(1)
    assert [r.x for r in df.select(guards.param_style(F.col("b"), F.col("m")).alias("x")).collect()] == ["concat", "unknown", "parameterized", "unknown", ""]
    one = make(spark, "h array<struct<code:string,sanitizer:boolean>>", ([("src(x)" * 40, False), ("clean(x)" * 40, True), ("mid" * 40, False), ("sink(x)" * 40, False)],))
    kept, over = guards.degraded(F.col("h"), 10)
    r = one.select(kept.alias("k"), over.alias("o"), F.transform(guards.roles(F.col("h"), F.array(F.lit("src")), F.array(F.lit("clean")), F.array(F.lit("sink"))), lambda h: h["role"]).alias("r")).first()
    assert len(r.k) == 3 and r.o and r.r == ["source", "sanitizer", "passthrough", "sink"]
    s = guards.mapper_style(F.lit("a ${x} #{y,jdbc} ${x}"))
    assert tuple(one.select(*[c.alias(f"c{i}") for i, c in enumerate(s)]).first()) == (["x"], ["y"], "mixed")


def test_fp_patterns_and_cube(spark):
    j = make(spark, "ord int, vulnerability_type string, verdict string, disposition string, path_broken_at string, sanitization_found string", *[(i, None, "false_positive", "", f"r{i % 7}", "s") for i in range(20)], (30, "x", "true_positive", "likely_fp", "", "z"), (31, "x", "false_positive", "uncertain", "q", "z"))
    assert rows(summary.fp_patterns(j, "ord")) == [("unknown", 20, ["r0", "r1", "r2", "r3", "r4"]), ("x", 1, ["z"])]
    b = make(spark, "l int, r string, n string, p int", (5, "a", None, 0), (5, "a", "N", 1), (2, "b", "M", 2), (None, "b", "M", 3))
    got = rows(summary.type_level_cube(b, "l", "r", "n", "p"))
    assert (("rule", 5, "a", "N", 2) in got) and ("total", None, None, None, 4) in got and ("level", 2, None, None, 1) in got
    best = summary.primary(make(spark, "severity string, pos int", ("low", 0), ("high", 1), ("high", 2), (None, 3)))
    assert rows(best) == [("high", 1)]


# ---- ranges, search, stability ----


def test_ranges(spark):
    s = make(spark, "f string, m string, start int, `end` int", ("a", "m1", 1, 5), ("a", "m2", 6, 9), ("b", "m3", 1, 9))
    h = make(spark, "f string, `from` int, `to` int", ("a", 5, 6), ("a", 5, 5), ("c", 1, 9))
    assert [r.m for r in ranges.overlaps(s, h, "f").orderBy("m").collect()] == ["m1", "m2"]
    left, right = make(spark, "k int, t int, x string", (1, 5, "a"), (1, 5, "a"), (1, 0, "b"), (2, 9, "c")), make(spark, "k int, t int, v int", (1, 1, 10), (1, 5, 11), (1, 5, 12), (1, 6, 13))
    assert rows(ranges.as_of(left, right, ["k"], "t", ["v"]).select("x", "prev_v")) == [("a", 12), ("a", 12), ("b", None), ("c", None)]
    m = make(spark, "method_key string, line int, file_path string", ("A.f", 3, "x/A.java"), ("A.g", 10, "x/A.java"), ("B.f", 1, "y/A.java"))
    assert rows(ranges.method_at(make(spark, "id int, file string, line int", (1, "/r/x/A.java", 9), (2, "/r/x/A.java", 10), (3, "/r/z.java", 1)), m)) == [(1, "A.f", 3), (2, "A.g", 10)]
    p = make(spark, "id int, method_key string, source_line int, sink_line int", (1, "f", 2, 6), (2, "f", 9, 8), (3, "f", 22, 21), (4, "f", 1, 30))
    got = ranges.control_feasible(p, make(spark, "method_key string, then_start int, then_end int, else_start int, else_end int", ("f", 1, 3, 5, 7)), make(spark, "method_key string, start int, `end` int", ("f", 20, 25)))
    assert rows(got) == [(1, False, "opposite_branches"), (2, False, "sink_before_source"), (3, True, ""), (4, True, "")]


def test_diff(spark):
    text = ["diff --git a/x b/x", "--- a/x", "+++ b/x\r", "@@ -1,2 +3,4 @@ f", "@@ -9 +9,0 @@", "+++ /dev/null", "+++ b/y", "@@ -1 +7 @@", "+++ b/z"]
    got = ranges.diff_hunks(make(spark, "doc int, n int, text string", *[(0, i, x) for i, x in enumerate(text)]))
    assert rows(got.select("file", "from", "to")) == [("x", 3, 6), ("x", 9, 9), ("y", 7, 7), ("z", None, None)]


def test_search(spark):
    p = search.postings(make(spark, "k int, x string", (1, "getUser"), (2, "serUsage"), (3, "ab"), (4, None)), "k", "x")
    assert [r.key for r in search.trigram_search(p, "User", 5).collect()] == [1] and [r.key for r in search.trigram_search(p, "us", 5).collect()] == [1, 2]
    hits, cut = search.grep(make(spark, "file string, line int, text string", *[("f", i, "hit") for i in range(5)], ("g", 1, "hit")), "h.t", 3, 1)
    assert hits.count() == 3 and cut.first().truncated and not search.grep(make(spark, "file string, line int, text string", ("f", 1, "x")), "h", 3)[1].first().truncated
    s = make(spark, "id int, body string, paths string, vulnerability_type string, authz_none boolean", (1, "runQuery(", "src/dao/A.java\nB.xml", "XSS", True))
    rules = [(0, "g", True, "none", ""), (1, "a", False, "paths", "dao"), (2, "b", False, "includes", "B.xml"), (3, "c", False, "function_keywords", "run\\w+\\("), (4, "d", False, "cwes", "xss"), (5, "e", False, "authz_none", "")]
    got = search.strategies(s, spark.createDataFrame(rules, "pos int, name string, always_on boolean, kind string, pattern string"))
    assert rows(got) == [(1, "b", 5, 3), (1, "d", 10, 2), (1, "g", 0, 1)]


def test_stability(spark):
    c = make(spark, "alert_id int, run int, seq array<string>", (1, 0, ["a", "b", "c"]), (1, 1, ["a", "c"]), (1, 2, ["a", "b", "c"]), (2, 0, []), (2, 1, []))
    got = {r.alert_id: (round(r.min_ratio, 3), r.prefix, r.forks) for r in stability.sequence_stability(c).collect()}
    assert got == {1: (0.667, 1, True), 2: (1.0, 0, True)}
    s = make(spark, "k int, o int, t string", *[(1, i, x) for i, x in enumerate("ssxsss")], (2, 0, "x"))
    assert rows(stability.longest_run(s, "k", "o", "t", "s")) == [(1, 3), (2, 0)]
    calls_ = make(spark, "k int, o int, n string, r string", (1, 0, "f", "calls g"), (1, 1, "g", "calls h" + " " * 490), (1, 2, "h", "x"), (1, 3, "q", ""), (2, 0, "a", ""))
    assert rows(stability.chain_length(calls_, "k", "o", "n", "r")) == [(1, 3, True), (2, 0, False)]
    w = stability.wobble(make(spark, "alert_id int, verdict string, actual_types array<string>, error string", (1, "a", ["idor"], None), (1, "b", ["missing_auth", "idor"], None), (1, "c", [], "boom")))
    assert rows(w) == [(1, ["a", "b"], True, True)]
    g = make(spark, "x string", ("无法确定是否有调用方",), ("无法确定，但没有调用方",), ("调用方明确",), (None,)).coalesce(1).select(stability.coverage_gaps("x").alias("g"))
    assert [r.g for r in g.collect()] == [["who_calls"], [], [], []]


@pytest.mark.parametrize("name", ["graph", "taint"])
def test_rule_registry_names(name):
    assert set(taint.RULES) >= {"param_to_field", "field_to_field"} and all(callable(r) for r in taint.RULES.values())


def test_arguments_at_the_top_level(spark):
    from pyspark.sql import functions as F

    from alertmill.operators import calls

    cases = {
        "f(a, g(b, c), d), e": ["f(a, g(b, c), d)", "e"],
        "new int[]{1, 2}, x": ["new int[]{1, 2}", "x"],
        r""""a\", b", ',', "\\", c""": [r'"a\", b"', "','", r'"\\"', "c"],
        " a ,, b\n,": ["a", "", "b"],
        "": [],
        "  ": [],
        "日本, 😀x, é": ["日本", "😀x", "é"],
    }
    df = spark.createDataFrame([(x,) for x in cases] + [(None,)], "a string").select("a", calls.split_args(F.col("a")).alias("got"))
    assert {r.a: r.got for r in df.collect()} == {**cases, None: []}


def test_tainted_parameter_is_certain_or_null(spark):
    from alertmill.operators import calls

    rows = [("m", "one", "one", 1, "x, id", "id"), ("m", "two", "two", 1, "id, id", "id"), ("m", "many", "many", 1, "id", "id"), ("m", "many", "many", 2, "x", "id"), ("m", "far", "far", 1, "x, x, id", "id"), ("m", "own", "own", 1, "x, a.b(p)", None), ("m", "no", "no", 1, "idx", "id")]
    params = [("m", 0, "p")] + [(n, i, f"{n}{i}") for n in ("one", "two", "many", "far", "own", "no") for i in range(2)]
    got = calls.tainted_parameters(spark.createDataFrame(rows, "caller_key string, callee_key string, name string, ord int, args string, taint_var string"), spark.createDataFrame(params, "method_key string, ord int, param_name string"))
    assert {r.callee_key: r.param_name for r in got.collect()} == {"one": "one1", "two": None, "many": None, "far": None, "own": "own1", "no": None}


def test_common_subsequences_against_a_table():
    import random

    from alertmill.operators.stability import common_length

    def table(x, y):
        row = [0] * (len(y) + 1)
        for p in x:
            last = 0
            for j, q in enumerate(y, 1):
                last, row[j] = row[j], last + 1 if p == q else max(row[j], row[j - 1])
        return row[-1]

    rng = random.Random(5)
    for n in [0, 1, 5, 63, 64, 65, 200]:
        for kinds in (1, 2, 5, 40):
            x, y = ([rng.choice([None, *map(str, range(kinds))]) for _ in range(m)] for m in (n, rng.randint(0, 150)))
            assert common_length(x, y) == common_length(y, x) == table(x, y)


def test_steps_match_hops_as_a_greedy_loop_does(spark):
    import random

    from alertmill.operators import matching

    rng, steps, hops, want = random.Random(11), [], [], set()
    for a in range(90):
        word = lambda: rng.choice(["A", "B", "C", "", None])
        ss = [(a, i, rng.choice([None, None, rng.randint(0, 7)]), word(), word()) for i in range(rng.randint(0, 7))]
        hh = [(a, i, word(), word(), rng.choice([True, False, None])) for i in range(rng.randint(0, 7))]
        edges = []
        for _, s, cited, f, n in ss:
            for _, h, hf, hn, tainted in hh:
                file, name = bool(f) and f == hf, bool(n) and n == hn
                if cited == h or file or name:
                    edges.append((0 if cited == h else 1 if file and name else 2 if file else 3, s, not tainted, h))
        taken = (set(), set())
        for _, s, _, h in sorted(edges):
            if s not in taken[0] and h not in taken[1]:
                taken[0].add(s), taken[1].add(h), want.add((a, s, h))
        steps, hops = steps + ss, hops + hh
    s = spark.createDataFrame(steps, "alert_id int, step int, cited int, file string, name string")
    h = spark.createDataFrame(hops, "alert_id int, hop int, file string, name string, tainted boolean")
    got = [tuple(r) for r in matching.match_steps(s, h).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 60
    assert matching.match_steps(s.limit(0), h).count() == 0


def test_tainted_parameters_send_no_table_to_the_driver(spark):
    from alertmill.operators import calls

    sites = spark.range(3).selectExpr("concat('m', id) as caller_key", "concat('c', id) as callee_key", "concat('f', id) as name", "cast(id as int) as ord", "'p' as args", "'p' as taint_var")
    plan = calls.tainted_parameters(sites, spark.range(3).selectExpr("concat('c', id) as method_key", "cast(id as int) as ord", "concat('q', id) as param_name"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_narrowing_ranks_once_for_calls_alike(spark):
    """Calls of one name and receiver share their ranks; calls that share an id are ranked together, as before."""
    import re

    from alertmill.operators import calls

    c = make(spark, "id int, name string, receiver string", (1, "n", "A"), (2, "n", "a"), (3, "n", None), (4, "n", "Z"), (5, "n", "B"), (5, "n", "Z"), (6, "n", "A"), (6, "o", "A"), (7, None, "A"), (None, "n", "A"), (None, "o", "B"))
    d = make(spark, "name string, class string, key int, is_sanitizer boolean", ("n", "a", 1, False), ("n", "A", 2, True), ("n", "b", 3, False), ("o", "C", 4, True), ("o", None, 5, False))
    got = sorted(((r.id or 0), r.key, r.rank) for r in calls.narrowed(c, d).collect())
    every = [(2, 1), (1, 2), (3, 3)]
    assert got == sorted([(0, 2, 1), (0, 4, 2), (0, 1, 3), (0, 5, 4), (1, 2, 1), (1, 1, 2), (2, 2, 1), (2, 1, 2), *[(3, k, r) for k, r in every], *[(4, k, r) for k, r in every], (5, 3, 1), (6, 2, 1), (6, 4, 2), (6, 1, 3), (6, 5, 4)])
    plan = calls.narrowed(c, d)._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"row_number\(\) windowspecdefinition\(name#\d+, receiver#", plan)


def test_narrowing_in_blocks(spark, monkeypatch):
    """Calls and definitions that fill several blocks, the last in part, come out as from a plain loop."""
    import random

    from alertmill.operators import calls, graph

    monkeypatch.setattr(graph, "BLOCK_ROWS", 3, raising=False)
    monkeypatch.setattr(calls, "DEF_ROWS", 2, raising=False)
    rng = random.Random(5)
    asked = [(i, rng.choice(["n", "n", "o", "", None]), rng.choice(["A", "b", "", None])) for i in range(150)]
    known = [(rng.choice(["n", "o", ""]), rng.choice(["a", "B", "C", "", None]), k, rng.random() < 0.3) for k in range(40)]
    want = []
    for i, name, receiver in asked:
        of = [d for d in known if d[0] == name]
        own = [d for d in of if None not in (d[1], receiver) and d[1].lower() == receiver.lower()]
        want += [(i, name, d[1], d[2], d[3], r) for r, d in enumerate(sorted(own or of, key=lambda d: (not d[3], d[2])), 1)]
    got = calls.narrowed(make(spark, "id int, name string, receiver string", *asked), make(spark, "name string, class string, key int, is_sanitizer boolean", *known))
    assert sorted(tuple(r) for r in got.select("id", "name", "key", "rank").collect()) == sorted((w[0], w[1], w[3], w[5]) for w in want)
    assert {(r.key, r["class"], r.is_sanitizer) for r in got.collect()} <= {(d[2], d[1], d[3]) for d in known}


def test_narrowing_stores_little(spark, tmp_path, monkeypatch):
    """Each of 64 calls without a match takes over 30,000 definitions: stored, a row takes under a byte and a half (it took twelve)."""
    from alertmill.operators import calls

    monkeypatch.setattr(calls, "PARTS", 1, raising=False)
    c = spark.range(64).selectExpr("id", "concat('n', id % 1) as name", "concat('Z', id % 1) as receiver")
    d = spark.range(30_000).selectExpr("concat('n', id % 1) as name", "concat('C', pmod(xxhash64(id), 25)) as class", "xxhash64(id) as key", "id % 9 = 0 as is_sanitizer")
    calls.narrowed(c, d).select("id", "class", "key", "rank").write.parquet(f"{tmp_path}/out")
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.count() == 64 * 30_000 and out.select("id", "rank").distinct().count() == 64 * 30_000
    assert sum(p.stat().st_size for p in (tmp_path / "out").glob("*.parquet")) < 64 * 30_000 * 1.5


def test_polymorphic_edges_meet_methods_before_callers(spark):
    from alertmill.operators import calls

    e = make(spark, "caller_key string, callee_class string, callee_method string, line int, file_path string, arg_count int", ("f", "I", "m", 1, "p", 1), ("f", "J", "m", 1, "p", 1), ("f", "I", "m", 1, "p", 1), ("f", "A", "m", 9, "p", 1), ("g", "I", "m", 2, None, 1), ("g", "I", "m", 3, "p", None))
    meth = make(spark, "method_key string, class string, method string, param_count int", *[(f"{c}.m(x)", c, "m", 1) for c in "ABCI"], ("B.m(y)", "B", "m", 1), ("D.m", "D", "m", 0))
    impl = make(spark, "iface string, class string", *[(i, c) for i, c in ("IA", "IB", "JB", "JC", "ID", "II")], ("J", "C"))
    got = sorted((r.caller_key, r.callee_class, r.line) for r in calls.polymorphic(e, meth, impl).collect())
    assert got == [("f", "B", 1), ("f", "C", 1), ("g", "A", 2), ("g", "B", 2)]
    # only rows that may repeat or be there already are made distinct and compared
    assert "Union" in calls.polymorphic(e, meth, impl)._jdf.queryExecution().optimizedPlan().toString()


def test_taint_rules_broadcast_nothing_and_deal_by_rows(spark, monkeypatch):
    """Rules join facts and tables that grow alike: no join is broadcast, and twice the rows take twice the tasks."""
    n = lambda c, k: F.concat(F.lit(c), (F.col("id") % k).cast("string"))
    fact = lambda kind: spark.range(600).select(F.lit(kind).alias("location_type"), n("k", 60).alias("location_key"), F.lit("").alias("param_name"), F.lit("USER_INPUT").alias("source_type"), n("s", 3).alias("source_method"), F.lit("").alias("source_field"), F.array(F.lit("seed")).alias("path"))
    store = taint.Store({
        "field_edges": spark.range(600).select(n("k", 60).alias("src_field"), n("f", 7).alias("dst_field")), "return_fields": spark.range(600).select(n("k", 60).alias("field_key"), n("m", 7).alias("method_key")),
        "return_sources": spark.range(3).select(n("m", 7).alias("method_key"), n("s", 3).alias("source")), "call_return_to_local": spark.range(600).select(n("k", 60).alias("callee_key"), n("c", 7).alias("caller_key"), F.lit("v").alias("local")),
        "local_sources": spark.range(3).select(n("c", 7).alias("method_key"), F.lit("v").alias("local"), n("s", 3).alias("source")), "local_returned": spark.range(7).select(n("c", 7).alias("method_key"), F.lit("v").alias("local")),
        "local_to_field": spark.range(7).select(n("c", 7).alias("method_key"), F.lit("v").alias("local"), n("f", 7).alias("field_key")),
    })
    monkeypatch.setattr("alertmill.operators.graph.TASK_ROWS", 100)
    for rule, kind in (("field_to_field", "field"), ("field_to_return", "field"), ("return_to_caller", "method_return")):
        got = taint.step(fact(kind), store, taint.RULES[rule])
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan and ", 6)" in plan
        assert got.count() == got.select(*taint.KEY).distinct().count() > 0


def test_seeds_choose_an_overload_once_for_each_name(spark):
    """The overload is ranked for each name and place, not for each call, and nothing is broadcast."""
    empty = lambda schema: spark.createDataFrame([], schema)
    calls = spark.range(40).select(F.concat(F.lit("c"), F.col("id")).alias("caller_key"), F.lit("A").alias("callee_class"), F.substring(F.concat(F.lit("m"), F.col("id")), 1, 1).alias("callee_method"), (F.col("id") % 2).cast("int").alias("arg_index"), F.lit("s").alias("source"))
    params = make(spark, "method_key string, param_name string, ord int", ("A.m(A)", "p", 0), ("A.m(A,B)", "p", 0), ("A.m(A,B)", "q", 1))
    two = "method_key string, source string"
    got = taint.seeds(empty("field_key string, source_type string, source_method string, source_field string"), empty("method_key string, param_name string, source string"), empty(two), calls, params)
    assert {(r.location_key, r.param_name, r.path[0]) for r in got.collect()} == {("A.m(A)", "p", "c0 -> A.m(A).p (arg#0)"), ("A.m(A,B)", "q", "c1 -> A.m(A,B).q (arg#1)")}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    window = next(x for x in plan.splitlines() if "Window [" in x)
    assert "caller_key" not in window and "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def test_loops_over_graphs_broadcast_nothing(spark, monkeypatch):
    """Tables of a loop grow with the graph, however small their files: no round sends one to the driver to be broadcast."""
    from alertmill.operators import facts

    plans, kept = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), kept(df))[1])
    e = make(spark, "src int, dst int", (1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 6), (6, 5), (7, 6))
    node = lambda *n: make(spark, "node int", *[(x,) for x in n])
    starts = make(spark, "start int", (1,), (4,), (7,))
    got = {r.node: r.component for r in graph.strong_components(e).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5, 7: 7}
    out = [graph.forward_trace(e, starts, node(6), 8), facts.source_traces(e, starts, node(2), 3), facts.flow_paths(e.withColumn("passes", F.lit(True)), starts, node(6), node(1, 4), 8, 5), graph.closure(e, starts)]
    plans += [df._jdf.queryExecution().executedPlan().toString() for df in out]
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)


def test_callee_keys_deal_by_rows(spark, monkeypatch):
    """Calls meet their keys once, dealt by rows; a name that is a key hides its overloads."""
    monkeypatch.setattr(graph, "TASK_ROWS", 10)
    e = spark.range(60).select("id", F.lit("A").alias("callee_class"), F.concat(F.lit("f"), F.col("id") % 3).alias("callee_method"))
    got = calls.callee_keys(e, make(spark, "method_key string", ("A.f0(int)",), ("A.f0(String)",), ("A.f1",), ("A.f1(int)",), (None,)))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert got.count() == 20 * 2 + 20 and plan.count("SortMergeJoin") == 1 and ", 6)" in plan and "Broadcast" not in plan
    assert got.where("callee_key = 'A.f1'").count() == 20


def test_a_round_of_matching_shuffles_once(spark, monkeypatch):
    """Steps and hops of an alert stay together: a round deals the pairs once and joins nothing."""
    from alertmill.operators import matching

    plans, kept = [], matching.cut
    monkeypatch.setattr(matching, "cut", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), kept(df))[1])
    s = spark.range(6).select((F.col("id") % 2).alias("alert_id"), F.col("id").alias("step"), F.lit(None).cast("long").alias("cited"), F.lit("f").alias("file"), F.concat(F.lit("n"), F.col("id") % 3).alias("name"))
    h = spark.range(6).select((F.col("id") % 2).alias("alert_id"), F.col("id").alias("hop"), F.lit("f").alias("file"), F.concat(F.lit("n"), F.col("id") % 3).alias("name"), F.lit(True).alias("tainted"))
    assert matching.match_steps(s, h).count() == 6
    assert len(plans) > 1 and not any("Broadcast" in p for p in plans)
    assert all(p.count("Exchange hash") + p.count("Exchange Single") == 1 and "Join" not in p for p in plans[1:])


def test_closure_shuffles_what_is_new(spark, monkeypatch):
    """What was found is read from its buckets: of a round's joins none shuffles it, however many rounds there were."""
    plans, write = [], graph.Buckets.add

    def add(self, df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(self, df)

    monkeypatch.setattr(graph.Buckets, "add", add)
    chain = [(f"n{i}", f"n{i + 1}") for i in range(20)]
    got = {(r.start, r.node): r.depth for r in graph.closure(edges(spark, *chain), starts(spark, "n0", "n15")).collect()}
    assert got == {(f"n{a}", f"n{b}"): b - a for a in (0, 15) for b in range(a, 21)}
    rounds = [x for x in plans if "LeftAnti" in x]
    # a round deals its front by node and its new rows by both columns, nothing else
    assert len(rounds) == 21 and all(x.count("Exchange hashpartitioning") == 2 and "Broadcast" not in x for x in rounds)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("cut_")]
