"""Facts derived from code facts."""

from pyspark.sql import functions as F

from alertmill.operators import facts
from alertmill.operators.graph import caller_tree


def make(spark, schema, *data):
    return spark.createDataFrame(list(data), schema)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_call_types(spark):
    e = make(spark, "caller_key string, callee_class string, callee_method string, line int", *[("m()", c, n, 1) for c, n in (("java.lang.Class", "forName"), ("p.A", "run"), ("p.A", "nat"), ("p.Feign", "get"), ("java.util.X", "y"), ("List", "add"), ("p.I", "z"), ("p.I$Inner", "z"), ("q.U", "u"), ("p.G", "call"))])
    ann = make(spark, "class string, annotation string", ("p.Feign", "FeignClient"))
    m = make(spark, "method_key string, is_native boolean, annotations array<string>", ("p.A.run()", False, []), ("p.A.nat()", True, []), ("p.G.call()", False, ["GrpcMethod"]))
    got = {(r.callee_class, r.callee_method): r.call_type for r in facts.call_types(e, ann, make(spark, "iface string", ("p.I",)), m).collect()}
    assert list(got.values()) and got == {("java.lang.Class", "forName"): "reflection", ("p.A", "run"): "direct", ("p.A", "nat"): "native", ("p.Feign", "get"): "rpc_feign", ("java.util.X", "y"): "stdlib", ("List", "add"): "stdlib", ("p.I", "z"): "interface", ("p.I$Inner", "z"): "interface", ("q.U", "u"): "unresolved", ("p.G", "call"): "rpc_grpc"}


def test_branches(spark):
    b = make(spark, "method_key string, condition string, start int, `end` int", ("A.f()", "isValid(x)", 2, 5))
    e = make(spark, "caller_key string, callee_class string, callee_method string, line int, receiver string, in_lambda boolean", ("A.f()", "B", "g", 3, "this", False), ("A.f()", "A", "f", 9, "this", None), ("A.f()", "B", "h", 9, "b", False), ("A.f()", "A", "f", 10, "a", False), ("A.f()", "B", "h", 4, "b", True))
    assert rows(facts.call_conditions(e, b).select("line", "callee_method", "condition")) == [(10, "f", "none"), (3, "g", "if"), (4, "h", "lambda"), (9, "f", "self"), (9, "h", "none")]
    a = make(spark, "method_key string, variable string, line int", ("A.f()", "y", 4), ("A.f()", "z", 6))
    assert rows(facts.implicit_flows(a, b, make(spark, "method_key string, variable string", ("A.f()", "x"), ("A.f()", "isV")))) == [("A.f()", "y", 4, "x")]
    c = make(spark, "method_key string, line int", ("A.f()", 3), ("A.f()", 8), ("S.m()", 1))
    assert rows(facts.validated(c, b, make(spark, "method_key string, annotation string", ("S.m()", "Secured"))).select("method_key", "line", "validated")) == [("A.f()", 3, True), ("A.f()", 8, False), ("S.m()", 1, True)]


def test_traces(spark):
    e = make(spark, "src string, dst string, passes boolean", ("e", "a", True), ("a", "b", True), ("b", "a", True), ("b", "s", True), ("a", "s", False))
    start = lambda *x: make(spark, "start string", *[(i,) for i in x])
    node = lambda *x: make(spark, "node string", *[(i,) for i in x])
    assert rows(facts.source_traces(e, start("s"), node("e"), 5)) == [("s", ["e", "a", "b", "s"], False), ("s", ["e", "a", "s"], False)]
    assert {r.exhausted for r in facts.source_traces(e, start("s"), node("a"), 1).collect()} == {True}
    assert rows(facts.flow_paths(e, start("a", "b"), node("s"), node("a"))) == [("a", ["a", "b", "s"])]
    got = facts.transitive_callers(e, start("s"), 5, 2).collect()
    assert [(r.node, r.depth) for r in got] == [("a", 1), ("b", 1)] and all(r.truncated for r in got)
    assert [r.node for r in facts.transitive_callees(e, start("e"), F.col("passes"), 2).orderBy("depth").collect()] == ["a", "b"]
    tree = caller_tree(e, start("b"), 4)
    assert facts.mermaid(tree).startswith("graph TD") and "b (cycle)" in facts.indented(tree)


def test_values_and_slices(spark):
    one = lambda *d: make(spark, "field_key string, value string, source string", *d)
    assert rows(facts.field_values(one(("f", None, "a")), one(("f", "1", "b"), ("g", "2", "b")), one(("f", "9", "c")))) == [("f", "1", "b"), ("g", "2", "b")]
    src = make(spark, "file string, line int, text string", *[("F", i, f"l{i}") for i in range(1, 9)])
    got = facts.self_contained(make(spark, "file string, line int", ("F", 3), ("F", 4)), make(spark, "file string, start int, `end` int", ("F", 1, 8), ("F", 2, 5)), src)
    assert rows(got) == [("F", 2, 5, "l2\nl3\nl4\nl5")]
    h = make(spark, "alert_id string, pos int, file string, line int, text string", ("a", 0, "F", 1, "x"), ("a", 1, "F", 2, "y"))
    r = make(spark, "alert_id string, pos int, file string, line int, text string", ("a", 0, "F", 2, "y"), ("a", 1, "M.xml", 7, "q"), ("a", 2, "M.xml", 7, "q"))
    assert rows(facts.promoted(h, r).select("pos", "file", "line")) == [(0, "F", 1), (1, "F", 2), (2, "M.xml", 7)]
    n = lambda *x: make(spark, "name string", *[(i,) for i in x])
    assert rows(facts.reach_classes(n("a", "b", "c"), n("a"), n("a", "b"))) == [("a", "definitive"), ("b", "uncertain"), ("c", "unreachable")]
    assert facts.projected(make(spark, "a string, b int", (None, 1)), ["a", "b"]).first().json == '{"a":"UNKNOWN","b":"1"}'


def test_expression_taint(spark):
    x = make(spark, "id int, method_key string, receiver string, callee string, args string", (1, "m", "req", "getParameter", '"q"'), (2, "m", "q", "trim", ""), (3, "m", "Enc", "escape", "q"), (4, "m", "q", "escape", "z"), (5, "m", "", "run", "a, q"), (6, "m", "", None, "q == 1"), (7, "m", "", "run", "qq"), (8, "n", "", "run", "q"))
    got = {r.id: r.source for r in facts.tainted_expressions(x, make(spark, "method_key string, variable string, source string", ("m", "q", "http")), ["getParameter"], ["escape"]).collect()}
    assert got == {1: "getParameter", 2: "http", 3: None, 4: "http", 5: "http", 6: None, 7: None, 8: None}
