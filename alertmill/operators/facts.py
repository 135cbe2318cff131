"""Facts derived from code facts: call types, conditions, implicit flows, values of fields, traces, slices, renderings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertmill.functions import text as t
from alertmill.operators.graph import closure, cut, cut_off, flipped, paths_between, top_per_group

# fixed values: prefixes and short names of library classes, names of reflective and proxy calls
LIBRARIES = ("java.", "javax.", "sun.", "jdk.", "android.", "kotlin.", "scala.")
LIBRARY_CLASSES = (
    "Object", "String", "Integer", "Long", "Double", "Boolean", "Float", "Short", "Byte", "Character", "Math", "System", "Runtime", "Process", "ProcessBuilder", "File", "List", "Map", "Set", "Collection", "HashMap",
    "ArrayList", "StringBuilder", "StringBuffer", "Thread", "Throwable", "Exception", "RuntimeException", "Arrays", "Collections", "Class", "ClassLoader", "URL", "URI", "InputStream", "OutputStream", "BufferedReader",
    "PrintWriter", "Logger",
)
REFLECTIVE = ("Class.forName", "Method.invoke", "Constructor.newInstance", "Field.get", "Field.set")
PROXIES = ("Proxy.newProxyInstance", "Enhancer.create")


def call_types(edges: DataFrame, annotations: DataFrame, interfaces: DataFrame, methods: DataFrame) -> DataFrame:
    """Edges with ``call_type``, by the first rule that holds: reflection and proxies, then for callees that no method answers RPC by
    annotation, libraries, interfaces (of nested classes the outer one counts), else unresolved; for the others native or direct.

    ``annotations`` (class, annotation), ``interfaces`` (iface), ``methods`` (method_key, is_native, annotations).
    """
    e = edges.withColumn("_name", F.concat_ws(".", "callee_class", "callee_method")).withColumn("_short", F.concat_ws(".", F.substring_index("callee_class", ".", -1), "callee_method"))
    ann = annotations.groupBy(F.col("class").alias("callee_class")).agg(F.collect_set("annotation").alias("_ann"))
    m = methods.groupBy(t.pattern_of(F.col("method_key")).alias("_name")).agg(F.coalesce(F.bool_or("is_native"), F.lit(False)).alias("_native"), F.array_distinct(F.flatten(F.collect_list("annotations"))).alias("_mann"), F.lit(True).alias("_known"))
    i = interfaces.select(F.col("iface").alias("_iface")).distinct().withColumn("_isif", F.lit(True))
    e = e.join(ann, "callee_class", "left").join(m, "_name", "left").withColumn("_outer", F.substring_index("callee_class", "$", 1)).join(i, F.col("_outer") == F.col("_iface"), "left")
    has = lambda c, *names: F.coalesce(F.arrays_overlap(F.col(c), F.array(*[F.lit(n) for n in names])), F.lit(False))
    library = F.col("callee_class").isin(*LIBRARY_CLASSES)
    for p in LIBRARIES:
        library = library | F.col("callee_class").startswith(p)
    kind = (
        F.when(F.col("_short").isin(*REFLECTIVE), "reflection").when(F.col("_short").isin(*PROXIES), "dynamic_proxy")
        .when(F.col("_known") & F.col("_native"), "native").when(F.col("_known") & ~has("_mann", "GrpcMethod", "GrpcStub"), "direct")
        .when(has("_ann", "FeignClient"), "rpc_feign").when(has("_ann", "DubboService", "DubboReference", "Reference"), "rpc_dubbo").when(has("_mann", "GrpcMethod", "GrpcStub"), "rpc_grpc")
        .when(library, "stdlib").when(F.col("_isif"), "interface").otherwise("unresolved")
    )
    return e.withColumn("call_type", kind).select(*[c for c in edges.columns if c != "call_type"], "call_type")


def call_conditions(edges: DataFrame, branches: DataFrame) -> DataFrame:
    """Edges (caller_key, callee_class, callee_method, line, receiver, in_lambda) with ``condition``, by the first that holds: ``lambda`` for the
    body of a lambda, ``if`` inside a branch (method_key, start, end), ``self`` for a call on ``this``, else ``none``."""
    inside = edges.join(branches.withColumnRenamed("method_key", "caller_key"), "caller_key").where("line between start and end").select("caller_key", "callee_class", "callee_method", "line").distinct().withColumn("_in", F.lit(True))
    return edges.join(inside, ["caller_key", "callee_class", "callee_method", "line"], "left").withColumn("condition", F.when(F.col("in_lambda"), "lambda").when(F.col("_in"), "if").when(F.col("receiver") == "this", "self").otherwise("none")).drop("_in")


def implicit_flows(assigns: DataFrame, branches: DataFrame, tainted: DataFrame) -> DataFrame:
    """(method_key, variable, line, source): assignments inside a branch whose condition names a tainted variable."""
    j = assigns.join(branches, "method_key").where("line between start and end").join(tainted.select("method_key", F.col("variable").alias("source")), "method_key")
    return j.where(t.whole_word(F.col("source"), F.col("condition"))).select("method_key", "variable", "line", "source").distinct()


# fixed values: annotations that guard a method
GUARDING = ("PreAuthorize", "PostAuthorize", "Secured", "RolesAllowed", "DenyAll", "PermitAll")


def validated(calls: DataFrame, branches: DataFrame, annotations: DataFrame, words: tuple[str, ...] = ("valid", "check", "verify", "permission", "isempty", "null")) -> DataFrame:
    """Calls (method_key, line) with ``validated``: a security annotation on the method, or a condition around them that sounds like a check."""
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(F.lower("condition"), F.lit(w))
    ok = calls.join(branches, "method_key").where(F.col("line").between(F.col("start"), F.col("end")) & hit).select("method_key", "line").distinct().withColumn("_by", F.lit(True))
    sec = annotations.where(F.col("annotation").isin(*GUARDING)).select("method_key").distinct().withColumn("_ann", F.lit(True))
    return calls.join(ok, ["method_key", "line"], "left").join(sec, "method_key", "left").withColumn("validated", F.coalesce("_by", "_ann", F.lit(False))).drop("_by", "_ann")


def field_values(*candidates: DataFrame) -> DataFrame:
    """(field_key, value, source): of candidate tables in order of trust the first value of each field; ties by value."""
    out = None
    for i, c in enumerate(candidates):
        one = c.where("value is not null").select("field_key", "value", "source", F.lit(i).alias("_p"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("field_key").agg(F.min(F.struct("_p", "value", "source")).alias("m")).select("field_key", "m.value", "m.source")


def source_traces(edges: DataFrame, starts: DataFrame, sources: DataFrame, max_depth: int = 20) -> DataFrame:
    """(start, path, exhausted): every simple path from a method back to an entry or tainted method (node), written source first.

    ``exhausted`` says that depth cut some path of the start off, so that its traces may not be all; a start that is cut off and has no
    trace comes once with a null path.
    """
    back = cut(flipped(edges))
    hit = paths_between(back, starts, sources, max_depth).select("start", F.reverse("path").alias("path"))
    short = cut(cut_off(back, starts, max_depth)).withColumn("exhausted", F.lit(True))
    found = hit.join(short.hint("merge"), "start", "left").withColumn("exhausted", F.coalesce("exhausted", F.lit(False)))
    none = short.join(hit.select("start").distinct().hint("merge"), "start", "left_anti").select("start", F.lit(None).cast(hit.schema["path"].dataType).alias("path"), "exhausted")
    return found.unionByName(none)


def flow_paths(edges: DataFrame, starts: DataFrame, sinks: DataFrame, tainted: DataFrame, max_depth: int = 24, limit: int = 500) -> DataFrame:
    """(start, path): tainted paths to methods that call a sink, of each start the ``limit`` shortest, ties by the path itself. ``edges`` (src, dst, passes) says whether a call passes the value on."""
    live = edges.where("passes").select("src", "dst")
    begin = starts.join(tainted.select(F.col("node").alias("start")).distinct().hint("merge"), "start", "left_semi")
    hit = paths_between(live, begin, sinks, max_depth, limit)
    w = Window.partitionBy("start").orderBy(F.size("path"), "path")
    return hit.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit).select("start", "path")


def transitive_callers(edges: DataFrame, starts: DataFrame, max_depth: int = 5, most: int = 15) -> DataFrame:
    """(start, node, depth, truncated): callers of callers, the farthest first, at most ``most`` for each start (nearest kept)."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    found = closure(back, starts, max_depth).where("depth > 0")
    return top_per_group(found, ["start"], [F.asc("depth"), F.asc("node")], most).withColumn("truncated", F.col("truncated") > 0).orderBy("start", F.desc("depth"), "node")


def transitive_callees(edges: DataFrame, starts: DataFrame, gate: Column, depth: int, most: int = 24) -> DataFrame:
    """(start, node, depth, truncated): callees over edges that the gate lets through, at most ``most`` for each start."""
    found = closure(edges.where(gate).select("src", "dst"), starts, depth).where("depth > 0")
    return top_per_group(found, ["start"], [F.asc("depth"), F.asc("node")], most).withColumn("truncated", F.col("truncated") > 0)


def self_contained(lines: DataFrame, blocks: DataFrame, source: DataFrame) -> DataFrame:
    """(file, start, end, text): the smallest block (file, start, end) around all wanted lines of a file, else the lines' own span, with its source (file, line, text)."""
    span = lines.groupBy("file").agg(F.min("line").alias("lo"), F.max("line").alias("hi"))
    around = span.join(blocks, "file").where("start <= lo and `end` >= hi").groupBy("file").agg(F.min(F.struct((F.col("end") - F.col("start")).alias("n"), "start", "end")).alias("b"))
    got = span.join(around, "file", "left").select("file", F.coalesce("b.start", "lo").alias("start"), F.coalesce("b.end", "hi").alias("end"))
    body = got.join(source, "file").where("line between start and `end`").groupBy("file", "start", "end").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), "\n").alias("text"))
    return body


def projected(rows: DataFrame, columns: list[str], missing: str = "UNKNOWN") -> DataFrame:
    """(json): rows for a tool's answer, missing texts filled in."""
    return rows.select(F.to_json(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit(missing)).alias(c) for c in columns])).alias("json"))


def promoted(hops: DataFrame, read: DataFrame) -> DataFrame:
    """Hops (alert_id, pos, file, line, text) with what tools read appended once, numbered on; what a hop holds already is left out."""
    new = read.join(hops.select("alert_id", "file", "line").distinct(), ["alert_id", "file", "line"], "left_anti").dropDuplicates(["alert_id", "file", "line"]).withColumn("_late", F.lit(1))
    both = hops.withColumn("_late", F.lit(0)).unionByName(new)
    return both.withColumn("pos", F.row_number().over(Window.partitionBy("alert_id").orderBy("_late", "pos", "file", "line")) - 1).drop("_late")


def reach_classes(referenced: DataFrame, included: DataFrame, known: DataFrame) -> DataFrame:
    """(name, state) of referenced callees: ``definitive`` if their body is in the slice, ``uncertain`` if it exists elsewhere, else ``unreachable``."""
    a, b = included.select("name").distinct().withColumn("_in", F.lit(True)), known.select("name").distinct().withColumn("_known", F.lit(True))
    return referenced.select("name").distinct().join(a, "name", "left").join(b, "name", "left").select("name", F.when(F.col("_in"), "definitive").when(F.col("_known"), "uncertain").otherwise("unreachable").alias("state"))


def mermaid(tree: DataFrame) -> str:
    """A caller tree (node, caller) as a graph drawing, each edge once; the tree of one question is small."""
    names: dict[str, str] = {}
    node = lambda k: names.setdefault(k, f"n{len(names)}")
    lines = []
    for r in tree.select("node", "caller").distinct().orderBy("node", "caller").toLocalIterator():
        for k in (r.caller, r.node):
            if k not in names:
                lines.append(f'  {node(k)}["{k}"]')
        lines.append(f"  {names[r.caller]} --> {names[r.node]}")
    return "\n".join(["graph TD", *lines])


def indented(tree: DataFrame) -> str:
    """A caller tree (path, cycle) as indented text."""
    lines = []
    for r in tree.select("path", "cycle").orderBy("path").toLocalIterator():
        lines.append("  " * (len(r.path) - 1) + r.path[-1] + (" (cycle)" if r.cycle else ""))
    return "\n".join(lines)


def tainted_expressions(expressions: DataFrame, scope: DataFrame, sources: list[str], sanitizers: list[str]) -> DataFrame:
    """Expressions (id, method_key, receiver, callee, args) with ``tainted`` and ``source``: a call of a known source, a tainted receiver, or a
    tainted argument of a call that does not clean; cleaning drops argument taint and keeps the receiver's. Comparisons (callee null, with an operator) are clean.

    ``scope`` (method_key, variable, source) are tainted names; a method's are few, and nested calls come as their own rows.
    """
    names = scope.groupBy("method_key").agg(F.array_sort(F.collect_set(F.struct("variable", "source"))).alias("_scope"))
    e = expressions.join(names, "method_key", "left").withColumn("_scope", F.coalesce("_scope", F.array().cast("array<struct<variable:string,source:string>>")))
    of = lambda text: F.get(F.filter("_scope", lambda v: t.whole_word(v["variable"], text)), F.lit(0))["source"]
    compared = F.col("callee").isNull() & F.rlike(t.text(F.col("args")), F.lit(r"==|!=|<|>|&&|\|\||^\s*!"))
    clean = F.lower(t.text(F.col("callee"))).isin(*[s.lower() for s in sanitizers])
    src = F.when(F.col("callee").isin(*sources), F.col("callee")).when(compared, F.lit(None).cast("string")).otherwise(F.coalesce(of(F.col("receiver")), F.when(~clean, of(F.col("args")))))
    return e.withColumn("source", src).withColumn("tainted", F.col("source").isNotNull()).drop("_scope")


