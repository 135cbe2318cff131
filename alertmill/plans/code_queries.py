"""Driver queries on code facts: taint rules, calls, types, slices and the expressions of alerts, over whole tables.

Parts, suppliers and customers number classes, methods and fields, line items the facts that link them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from alertmill.functions import text as t
from alertmill.functions import vocab as v
from alertmill.operators import calls, facts, graph, guards, history, matching, policy, ranges, routing, search, stability, summary, taint
from alertmill.plans.queries import query, table

_c = F.col


def _s(*parts) -> Column:
    """Texts and columns side by side; a text is a literal."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


# ---- taint rules, one step each ----

_FACTS = """fact AS (SELECT DISTINCT CASE o_orderkey % 3 WHEN 0 THEN 'field' WHEN 1 THEN 'method_param' ELSE 'method_return' END AS lt,
CASE WHEN o_orderkey % 3 = 0 THEN 'F' || o_custkey ELSE 'C.m' || o_custkey || '()' END AS lk, CASE WHEN o_orderkey % 3 = 1 THEN 'p' || o_orderkey % 2 ELSE '' END AS pn, 'USER_INPUT' AS st, 's' || o_orderkey % 4 AS sm, '' AS sf FROM orders),
li AS (SELECT 'C.m' || l_partkey || '()' AS pm, 'C.m' || l_orderkey || '()' AS sp, 'F' || l_partkey AS pf, 'F' || l_suppkey AS sup, 'p' || l_linenumber % 2 AS pn, 'v' || l_linenumber % 3 AS loc, 's' || l_linenumber % 4 AS src, * FROM lineitem)"""
_OUT = "AS location_type, {} AS location_key, {} AS param_name, {} AS source_type, sm AS source_method, {} AS source_field"


def _taint_sql(kind, key, param, st, field, body):
    return f"WITH {_FACTS} SELECT DISTINCT '{kind}' {_OUT.format(key, param, st, field)} {body}"


def _facts_of(spark, sf):
    o = table(spark, sf, "orders")
    k = _c("o_orderkey") % 3
    key = F.when(k == 0, _s("F", _c("o_custkey"))).otherwise(_s("C.m", _c("o_custkey"), "()"))
    return o.select(
        F.when(k == 0, "field").when(k == 1, "method_param").otherwise("method_return").alias("location_type"), key.alias("location_key"), F.when(k == 1, _s("p", _c("o_orderkey") % 2)).otherwise("").alias("param_name"),
        F.lit("USER_INPUT").alias("source_type"), _s("s", _c("o_orderkey") % 4).alias("source_method"), F.lit("").alias("source_field"), F.array(F.lit("seed")).alias("path"),
    ).distinct()


def _store(spark, sf):
    li = table(spark, sf, "lineitem").select(
        _s("C.m", _c("l_partkey"), "()").alias("pm"), _s("C.m", _c("l_orderkey"), "()").alias("sp"), _s("F", _c("l_partkey")).alias("pf"), _s("F", _c("l_suppkey")).alias("sup"), _s("p", _c("l_linenumber") % 2).alias("pn"),
        _s("v", _c("l_linenumber") % 3).alias("loc"), _s("s", _c("l_linenumber") % 4).alias("src"), "*")
    part, ab = table(spark, sf, "part"), lambda a, b: F.when(_c("l_linenumber") > 4, a).otherwise(b)
    return taint.Store({
        "param_to_field": li.select(_c("pm").alias("method_key"), _c("pn").alias("param_name"), _c("sup").alias("field_key")),
        "param_to_return": li.where("l_returnflag = 'A'").select(_c("pm").alias("method_key"), _c("pn").alias("param_name")),
        "call_return_to_local": li.select(_c("pm").alias("callee_key"), _c("sp").alias("caller_key"), _c("loc").alias("local")),
        "local_sources": li.where("l_returnflag = 'A'").select(_c("sp").alias("method_key"), _c("loc").alias("local"), _c("src").alias("source")),
        "local_returned": li.where("l_returnflag = 'R'").select(_c("sp").alias("method_key"), _c("loc").alias("local")),
        "local_to_field": li.where("l_linestatus = 'O'").select(_c("sp").alias("method_key"), _c("loc").alias("local"), _c("pf").alias("field_key")),
        "call_site_field": li.select(ab(_c("pm"), F.lit("")).alias("callee_key"), F.lit("C").alias("callee_class"), _s("m", _c("l_partkey")).alias("callee_method"), (_c("l_linenumber") % 3).cast("int").alias("arg_count"), _c("sp").alias("caller_key"), _c("l_linenumber").alias("line"), _c("sup").alias("field_key")),
        "field_assignments": li.where("l_linestatus = 'F'").select(_c("sup").alias("field_key"), _c("sp").alias("method_key"), _c("l_linenumber").alias("line")),
        "field_edges": li.select(_c("pf").alias("src_field"), _c("sup").alias("dst_field")),
        "return_fields": li.where("l_returnflag = 'N'").select(_c("pf").alias("field_key"), _c("sp").alias("method_key")),
        "return_sources": li.where("l_returnflag = 'R'").select(_c("sp").alias("method_key"), _c("src").alias("source")),
        "param_to_call_param": li.select(_c("pm").alias("method_key"), _c("pn").alias("param_name"), F.lit("C").alias("callee_class"), _s("m", _c("l_suppkey")).alias("callee_method"), (_c("l_linenumber") % 2).cast("int").alias("arg_index")),
        "method_params": part.select(_s("C.m", _c("p_partkey"), "()").alias("method_key"), F.explode(F.sequence(F.lit(0), (_c("p_size") % 2).cast("int"))).alias("ord")).withColumn("param_name", _s("p", _c("ord"))),
        "field_read_params": li.where("l_linestatus = 'O'").select(_c("pf").alias("field_key"), _c("sp").alias("method_key"), _c("pn").alias("param_name")),
        "field_types": part.select(_s("F", _c("p_partkey")).alias("field_key"), F.when(_c("p_size") % 3 == 0, "List<A>").when(_c("p_size") % 3 == 1, "HashMap<K,V>").otherwise("String").alias("type")),
    })


def _step(spark, sf, rule):
    return taint.step(_facts_of(spark, sf), _store(spark, sf), taint.RULES[rule]).drop("path")


@query(_taint_sql("field", "sup", "''", "st", "''", "FROM fact JOIN li ON lt = 'method_param' AND lk = pm AND fact.pn = li.pn"))
def taint_param_to_field(spark, sf):
    return _step(spark, sf, "param_to_field")


@query(_taint_sql("method_return", "lk", "''", "st", "''", "FROM fact JOIN li ON lt = 'method_param' AND lk = pm AND fact.pn = li.pn AND l_returnflag = 'A'"))
def taint_param_to_return(spark, sf):
    return _step(spark, sf, "param_to_return")


_CALLER = """, j AS (SELECT DISTINCT fact.*, sp AS ck, loc FROM fact JOIN li ON lt = 'method_return' AND lk = pm WHERE NOT EXISTS (SELECT 1 FROM li x WHERE x.l_returnflag = 'A' AND x.sp = li.sp AND x.loc = li.loc AND x.src = fact.sm)
AND EXISTS (SELECT 1 FROM li y WHERE y.sp = li.sp AND y.loc = li.loc AND (y.l_returnflag IN ('A', 'R') OR y.l_linestatus = 'O')))"""


@query(f"""WITH {_FACTS}{_CALLER} SELECT DISTINCT 'method_return' AS location_type, ck AS location_key, '' AS param_name, st AS source_type, sm AS source_method, '' AS source_field FROM j JOIN li ON li.sp = ck AND li.loc = j.loc AND l_returnflag = 'R'
UNION SELECT 'field', li.pf, '', 'FIELD_PROPAGATION', sm, 'return:' || lk FROM j JOIN li ON li.sp = ck AND li.loc = j.loc AND l_linestatus = 'O'""")
def taint_return_to_caller(spark, sf):
    return _step(spark, sf, "return_to_caller")


@query(f"""WITH {_FACTS}, s AS (SELECT DISTINCT CASE WHEN l_linenumber > 4 THEN pm ELSE '' END AS ck, 'C.m' || l_partkey AS pat, l_linenumber % 3 AS n, sup FROM li WHERE EXISTS (SELECT 1 FROM li x WHERE x.l_linestatus = 'F' AND x.sup = li.sup AND x.sp = li.sp AND x.l_linenumber = li.l_linenumber)),
a AS (SELECT 'C.m' || p_partkey || '()' AS k, p_size % 2 + 1 AS n FROM part), r AS (SELECT fact.*, coalesce(n, 0) AS n FROM fact LEFT JOIN a ON a.k = lk WHERE lt = 'method_return')
SELECT DISTINCT 'field' AS location_type, sup AS location_key, '' AS param_name, 'FIELD_PROPAGATION' AS source_type, sm AS source_method, 'return:' || lk AS source_field FROM r JOIN s ON ck = lk OR ck = '' AND pat || '()' = lk AND s.n = r.n""")
def taint_return_to_field(spark, sf):
    return _step(spark, sf, "return_to_field_at_call")


@query(_taint_sql("field", "sup", "''", "'FIELD_PROPAGATION'", "lk", "FROM fact JOIN li ON lt = 'field' AND lk = pf"))
def taint_field_to_field(spark, sf):
    return _step(spark, sf, "field_to_field")


@query(_taint_sql("method_return", "sp", "''", "st", "lk", "FROM fact JOIN li ON lt = 'field' AND lk = pf AND l_returnflag = 'N' WHERE NOT EXISTS (SELECT 1 FROM li x WHERE x.l_returnflag = 'R' AND x.sp = li.sp AND x.src = fact.sm)"))
def taint_field_to_return(spark, sf):
    return _step(spark, sf, "field_to_return")


@query(_taint_sql("method_param", "'C.m' || l_suppkey || '()'", "'p' || l_linenumber % 2", "st", "fact.sf", "FROM fact JOIN li ON lt = 'method_param' AND lk = pm AND fact.pn = li.pn JOIN part ON p_partkey = l_suppkey AND l_linenumber % 2 <= p_size % 2"))
def taint_param_to_param(spark, sf):
    return _step(spark, sf, "param_to_param")


@query(_taint_sql("method_param", "sp", "li.pn", "st", "lk", "FROM fact JOIN li ON lt = 'field' AND lk = pf AND l_linestatus = 'O'"))
def taint_field_to_param(spark, sf):
    return _step(spark, sf, "field_to_param")


@query(_taint_sql("method_return", "sp", "''", "st", "lk", "FROM fact JOIN li ON lt = 'field' AND lk = pf AND l_returnflag = 'N' JOIN part ON lk = 'F' || p_partkey AND p_size % 3 < 2"))
def taint_collection_element(spark, sf):
    return _step(spark, sf, "collection_element")


@query(f"WITH {_FACTS} SELECT lt AS kind, lk AS key, pn AS param_name, sm AS source FROM fact")
def taint_sync(spark, sf):
    got = taint.sync(_facts_of(spark, sf))
    row = lambda df, kind, key, param, source: df.select(F.lit(kind).alias("kind"), _c(key).alias("key"), param.alias("param_name"), _c(source).alias("source"))
    return row(got["fields"], "field", "field_key", F.lit(""), "source_method").unionByName(row(got["params"], "method_param", "method_key", _c("param_name"), "source")).unionByName(row(got["returns"], "method_return", "method_key", F.lit(""), "source"))


@query("""WITH mp AS (SELECT 'C.m' || p_partkey // 2 || CASE WHEN p_partkey % 2 = 0 THEN '(A)' ELSE '(A,B)' END AS mk, 'C.m' || p_partkey // 2 AS pat, p_partkey % 2 + 1 AS n FROM part), arg AS (SELECT DISTINCT 'k' || l_suppkey AS ck, 'C.m' || l_partkey // 2 AS pat, l_linenumber % 2 AS i, 's' || l_linenumber AS src FROM lineitem),
b AS (SELECT *, row_number() OVER (PARTITION BY ck, arg.pat, i, src ORDER BY (n > i)::INT DESC, mk) AS k FROM arg JOIN mp ON arg.pat = mp.pat)
SELECT DISTINCT 'field' AS location_type, 'F' || s_suppkey AS location_key, '' AS param_name, 'USER_INPUT' AS source_type, 's' || s_nationkey AS source_method, '' AS source_field FROM supplier UNION SELECT 'method_param', 'C.m' || c_custkey, 'p', 'USER_INPUT', 's' || c_nationkey, '' FROM customer
UNION SELECT 'method_return', 'C.r' || c_custkey, '', 'USER_INPUT', 's' || c_nationkey, '' FROM customer UNION SELECT 'method_param', mk, 'p' || i, 'USER_INPUT', src, '' FROM b WHERE k = 1 AND i < n""")
def taint_seeds(spark, sf):
    sup, cus, li, part = (table(spark, sf, x) for x in ("supplier", "customer", "lineitem", "part"))
    f = sup.select(_s("F", _c("s_suppkey")).alias("field_key"), F.lit("USER_INPUT").alias("source_type"), _s("s", _c("s_nationkey")).alias("source_method"), F.lit("").alias("source_field"))
    p = cus.select(_s("C.m", _c("c_custkey")).alias("method_key"), F.lit("p").alias("param_name"), _s("s", _c("c_nationkey")).alias("source"))
    r = cus.select(_s("C.r", _c("c_custkey")).alias("method_key"), _s("s", _c("c_nationkey")).alias("source"))
    a = li.select(_s("k", _c("l_suppkey")).alias("caller_key"), F.lit("C").alias("callee_class"), _s("m", F.floor(_c("l_partkey") / 2)).alias("callee_method"), (_c("l_linenumber") % 2).cast("int").alias("arg_index"), _s("s", _c("l_linenumber")).alias("source")).distinct()
    key = _s("C.m", F.floor(_c("p_partkey") / 2), F.when(_c("p_partkey") % 2 == 0, "(A)").otherwise("(A,B)"))
    mp = part.select(key.alias("method_key"), F.explode(F.sequence(F.lit(0), (_c("p_partkey") % 2).cast("int"))).alias("ord")).withColumn("param_name", _s("p", _c("ord")))
    return taint.seeds(f, p, r, a, mp).drop("path")


# ---- calls ----

_KEYS = "m AS (SELECT CASE WHEN p_partkey % 3 = 0 THEN 'C' || p_partkey % 50 || '.m' || p_partkey // 50 ELSE 'C' || p_partkey % 50 || '.m' || p_partkey // 50 || CASE WHEN p_size % 2 = 0 THEN '(A)' ELSE '(A,B)' END END AS k FROM part UNION SELECT 'C' || p_partkey % 50 || '.m' || p_partkey // 50 || '(X)' FROM part WHERE p_size % 5 = 0)"


def _methods(spark, sf):
    p = table(spark, sf, "part")
    name = _s("C", _c("p_partkey") % 50, ".m", F.floor(_c("p_partkey") / 50))
    one = p.select(F.when(_c("p_partkey") % 3 == 0, name).otherwise(F.concat(name, F.when(_c("p_size") % 2 == 0, "(A)").otherwise("(A,B)"))).alias("method_key"))
    return one.union(p.where("p_size % 5 = 0").select(F.concat(name, F.lit("(X)")))).distinct()


@query(f"""WITH {_KEYS}, e AS (SELECT DISTINCT l_suppkey AS caller, 'C' || l_partkey % 50 || '.m' || l_partkey // 50 AS n FROM lineitem) SELECT caller, k AS callee_key FROM e JOIN m ON k = n
UNION SELECT caller, k FROM e JOIN m ON split_part(k, '(', 1) = n WHERE NOT EXISTS (SELECT 1 FROM m b WHERE b.k = e.n)""")
def callee_keys(spark, sf):
    li = table(spark, sf, "lineitem")
    n = graph.tasks_for(li)
    e = li.select("l_suppkey", "l_partkey").repartition(n, "l_suppkey", "l_partkey").distinct()
    e = e.select(_c("l_suppkey").alias("caller"), _s("C", _c("l_partkey") % 50).alias("callee_class"), _s("m", F.floor(_c("l_partkey") / 50)).alias("callee_method"))
    return calls.callee_keys(e, _methods(spark, sf)).select("caller", "callee_key").repartition(n, "caller", "callee_key").distinct()


@query(f"""WITH {_KEYS}, q AS (SELECT p_partkey AS id, 'm' || p_partkey // 50 AS name, CASE WHEN p_partkey % 4 = 0 THEN 'src/C' || p_partkey % 50 || '.java' ELSE '' END AS f, CASE WHEN p_partkey % 5 = 0 THEN 'C' || p_partkey % 50 || '.m' || p_partkey // 50 || '(A)' ELSE '' END AS mk FROM part),
c AS (SELECT id, k, k = mk AS e, f <> '' AND f = 'src/' || split_part(k, '.', 1) || '.java' AS i FROM q JOIN m ON split_part(split_part(k, '(', 1), '.', 2) = name), d AS (SELECT *, bool_or(e) OVER (PARTITION BY id) AS se FROM c), g AS (SELECT *, bool_or(i) OVER (PARTITION BY id) AS si FROM d WHERE e OR NOT se)
SELECT id, CASE WHEN count(*) = 1 THEN 'found' ELSE 'ambiguous' END AS status, CASE WHEN count(*) = 1 THEN min(k) END AS method_key, string_agg(k, ';' ORDER BY k) AS candidates FROM g WHERE i OR NOT si GROUP BY id""")
def resolve_method(spark, sf):
    m = _methods(spark, sf).select("method_key", t.class_of(F.concat("method_key", F.lit("("))).alias("class"), t.method_of(_c("method_key")).alias("method")).withColumn("file_path", _s("src/", _c("class"), ".java"))
    cls = _s("C", _c("p_partkey") % 50)
    asked = table(spark, sf, "part").select(_c("p_partkey").alias("id"), _s("m", F.floor(_c("p_partkey") / 50)).alias("name"), F.when(_c("p_partkey") % 4 == 0, F.concat(F.lit("src/"), cls, F.lit(".java"))).otherwise("").alias("file_path"), F.when(_c("p_partkey") % 5 == 0, F.concat(cls, _s(".m", F.floor(_c("p_partkey") / 50), "(A)"))).otherwise("").alias("method_key"))
    return calls.resolve_method(asked, m).withColumn("candidates", F.array_join("candidates", ";"))


@query("""SELECT DISTINCT 'k' || l_suppkey AS caller_key, 'C.m' || l_partkey AS callee, l_linenumber AS line, l_linenumber % 3 AS arg_index, CASE WHEN l_linenumber % 3 <= p_size % 2 THEN 'p' || l_linenumber % 3 END AS param_name, p_type AS sink_type FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size % 4 <> 0""")
def sink_bindings(spark, sf):
    part = table(spark, sf, "part")
    args = table(spark, sf, "lineitem").select(F.concat(_s("k", _c("l_suppkey")), F.when(_c("l_linenumber") > 3, "$lambda").otherwise("")).alias("caller_key"), F.lit("C").alias("callee_class"), _s("m", _c("l_partkey")).alias("callee_method"), _c("l_linenumber").alias("line"), (_c("l_linenumber") % 3).cast("int").alias("arg_index"))
    sinks = part.select(_s("C.m", _c("p_partkey")).alias("key"), _c("p_type").alias("vuln_type"), (_c("p_size") % 4 == 0).alias("benign"))
    params = part.select(_s("C.m", _c("p_partkey"), "()").alias("method_key"), F.explode(F.sequence(F.lit(0), (_c("p_size") % 2).cast("int"))).alias("ord")).withColumn("param_name", _s("p", _c("ord")))
    return calls.sink_bindings(args, sinks, params).distinct()


@query("""WITH e AS (SELECT DISTINCT 'k' || l_suppkey AS ck, 'I' || l_partkey % 40 AS cc, 'm' || l_linenumber AS cm, l_linenumber % 2 AS n, l_linenumber AS line FROM lineitem), m AS (SELECT 'K' || p_partkey AS impl, 'm' || p_size % 8 AS cm, p_size % 2 AS n, 'I' || p_partkey % 40 AS iface FROM part)
SELECT DISTINCT ck AS caller_key, impl AS callee_class, cm AS callee_method, line, 'polymorphic' AS rule FROM e JOIN m USING (cm, n) WHERE iface = cc""")
def polymorphic(spark, sf):
    part = table(spark, sf, "part")
    e = table(spark, sf, "lineitem").select(_s("k", _c("l_suppkey")).alias("caller_key"), _s("I", _c("l_partkey") % 40).alias("callee_class"), _s("m", _c("l_linenumber")).alias("callee_method"), (_c("l_linenumber") % 2).cast("int").alias("arg_count"), _c("l_linenumber").alias("line"), F.lit("f").alias("file_path"))
    m = part.select(_s("K", _c("p_partkey"), ".m").alias("method_key"), _s("K", _c("p_partkey")).alias("class"), _s("m", _c("p_size") % 8).alias("method"), (_c("p_size") % 2).cast("int").alias("param_count"))
    impl = part.select(_s("I", _c("p_partkey") % 40).alias("iface"), _s("K", _c("p_partkey")).alias("class"))
    # the operator returns a row once; the columns left out are one value, and a function of the line
    return calls.polymorphic(e, m, impl).select("caller_key", "callee_class", "callee_method", "line", "rule")


@query("""WITH a(k, kind, re) AS (VALUES ('Asp.before(A)', 'Before', 'app\\.C1'), ('Asp.after(A)', 'After', 'app\\.C[^(]*\\.m2'), ('Asp.around(A)', 'Around', 'm3')), m AS (SELECT 'app.C' || p_partkey || '.m' || p_size % 5 || '()' AS mk FROM part), h AS (SELECT * FROM m, a WHERE regexp_matches(mk, re))
SELECT CASE WHEN kind = 'After' THEN mk ELSE k END AS caller_key, CASE WHEN kind = 'After' THEN split_part(k, '.', 1) ELSE regexp_extract(mk, '^(.*)\\.', 1) END AS callee_class, CASE WHEN kind = 'After' THEN regexp_extract(k, '\\.([a-z]+)', 1) ELSE regexp_extract(mk, '\\.([^.]*)\\(', 1) END AS callee_method FROM h""")
def advised(spark, sf):
    advice = spark.createDataFrame([("Asp.before(A)", "Before", "execution(* app.C1)"), ("Asp.before(A)", "Pointcut", ""), ("Asp.after(A)", "After", "app.C*.m2"), ("Asp.around(A)", "Around", "m3")], "advice_key string, kind string, pointcut string").withColumn("pointcut", F.when(_c("kind") == "Before", "app.C1").otherwise(_c("pointcut")))
    m = table(spark, sf, "part").select(_s("app.C", _c("p_partkey"), ".m", _c("p_size") % 5, "()").alias("method_key"))
    return calls.advised(advice, m).select("caller_key", "callee_class", "callee_method")


@query("""SELECT p_partkey, p_size % 7 = 0 OR p_type = 'PROMO' AND p_size % 3 = 1 AS is_entry FROM part""")
def lifecycle_entries(spark, sf):
    part = table(spark, sf, "part")
    m = part.select("p_partkey", _s("K", _c("p_partkey")).alias("class"), _s("m", _c("p_size") % 3).alias("method"), F.when(_c("p_size") % 7 == 0, True).alias("is_entry"))
    callbacks = spark.createDataFrame([("PROMO", "m1"), ("ABSENT", "m2")], "iface string, method string")
    return calls.lifecycle_entries(m, part.select(_s("K", _c("p_partkey")).alias("class"), _c("p_type").alias("iface")), callbacks).select("p_partkey", "is_entry")


@query("""WITH n AS (SELECT 'C.m' || p_partkey // 2 AS name, count(*) AS n FROM part GROUP BY 1), r AS (SELECT DISTINCT l_suppkey AS s, 'C.m' || l_partkey // 2 AS name, CASE WHEN l_linenumber = 7 THEN 'interface' ELSE 'direct' END AS ct FROM lineitem),
k AS (SELECT r.*, n, row_number() OVER (PARTITION BY s ORDER BY name, ct) AS i, count(*) OVER (PARTITION BY s) AS c FROM (SELECT r.*, n FROM r LEFT JOIN n USING (name)) r), g AS (SELECT *, CASE WHEN ct = 'interface' THEN 'dispatch' WHEN n = 1 THEN 'definitive' ELSE 'uncertain' END AS kind FROM k WHERE i <= 30)
SELECT s AS caller_key, coalesce(string_agg(DISTINCT name, ',' ORDER BY name) FILTER (kind = 'definitive'), '') AS definitive, coalesce(string_agg(DISTINCT name, ',' ORDER BY name) FILTER (kind = 'uncertain'), '') AS uncertain, coalesce(string_agg(DISTINCT name, ',' ORDER BY name) FILTER (kind = 'dispatch'), '') AS dispatch, max(c) > 30 AS truncated FROM g GROUP BY s""")
def forward_callees(spark, sf):
    e = table(spark, sf, "lineitem").select(_c("l_suppkey").alias("caller_key"), F.lit("C").alias("callee_class"), _s("m", F.floor(_c("l_partkey") / 2)).alias("callee_method"), F.when(_c("l_linenumber") == 7, "interface").otherwise("direct").alias("call_type"))
    over = table(spark, sf, "part").select(_s("C.m", F.floor(_c("p_partkey") / 2), "(", _c("p_partkey") % 2, ")").alias("method_key"))
    return calls.forward_callees(e, over, 30).withColumns({c: F.array_join(c, ",") for c in ("definitive", "uncertain", "dispatch")})


@query("""WITH d AS (SELECT 'n' || p_partkey % 100 AS name, p_brand AS class, p_partkey AS key, p_size % 9 = 0 AS z FROM part), q AS (SELECT o_orderkey AS id, 'n' || o_custkey % 100 AS name, 'BRAND#' || o_custkey % 40 AS r FROM orders),
j AS (SELECT id, q.name, class, key, z, lower(class) = lower(r) AS own FROM q JOIN d USING (name)), s AS (SELECT *, bool_or(own) OVER (PARTITION BY id, name) AS so FROM j) SELECT id, class, key, row_number() OVER (PARTITION BY id ORDER BY z DESC, key) AS rank FROM s WHERE own OR NOT so""")
def narrowed_callees(spark, sf):
    d = table(spark, sf, "part").select(_s("n", _c("p_partkey") % 100).alias("name"), _c("p_brand").alias("class"), _c("p_partkey").alias("key"), (_c("p_size") % 9 == 0).alias("is_sanitizer"))
    q = table(spark, sf, "orders").select(_c("o_orderkey").alias("id"), _s("n", _c("o_custkey") % 100).alias("name"), _s("BRAND#", _c("o_custkey") % 40).alias("receiver"))
    return calls.narrowed(q, d).select("id", "class", "key", _c("rank").cast("long").alias("rank"))


# ---- facts ----


@query("""WITH a AS (SELECT p_brand AS c, list(DISTINCT p_type) AS t FROM part GROUP BY 1) SELECT s_suppkey AS id, CASE WHEN s_suppkey % 11 = 0 THEN 'reflection' WHEN s_suppkey % 11 = 1 THEN 'dynamic_proxy' WHEN s_suppkey % 11 IN (2, 3) THEN CASE WHEN s_nationkey % 2 = 0 THEN 'native' ELSE 'direct' END
WHEN s_suppkey % 11 = 4 THEN 'stdlib' WHEN s_suppkey % 11 = 5 THEN 'interface' WHEN s_suppkey % 11 = 6 THEN 'rpc_feign' ELSE 'unresolved' END AS call_type FROM supplier""")
def call_types(spark, sf):
    k = _c("s_suppkey") % 11
    cls = F.when(k == 0, "java.lang.Class").when(k == 1, "Proxy").when(k.isin(2, 3), _s("K", _c("s_nationkey"))).when(k == 4, "java.util.List").when(k == 5, "app.Face$Inner").when(k == 6, "app.Client").otherwise("app.Other")
    name = F.when(k == 0, "forName").when(k == 1, "newProxyInstance").otherwise("m")
    e = table(spark, sf, "supplier").select(_c("s_suppkey").alias("id"), cls.alias("callee_class"), name.alias("callee_method"))
    m = table(spark, sf, "nation").select(_s("K", _c("n_nationkey"), ".m()").alias("method_key"), (_c("n_nationkey") % 2 == 0).alias("is_native"), F.array().cast("array<string>").alias("annotations"))
    ann = spark.createDataFrame([("app.Client", "FeignClient")], "class string, annotation string")
    return facts.call_types(e, ann, spark.createDataFrame([("app.Face",)], "iface string"), m).select("id", "call_type")


_CODE = "cd AS (SELECT l_orderkey, l_linenumber, l_suppkey, 'C.m' || l_partkey AS mk, l_linenumber * 10 AS line, 'x' || l_suppkey % 3 AS vari FROM lineitem), br AS (SELECT 'C.m' || p_partkey AS mk, p_size % 40 AS a, p_size % 40 + 25 AS z, CASE WHEN p_size % 2 = 0 THEN 'isValid(x0)' ELSE 'x1 > 2' END AS cond FROM part)"


def _code(spark, sf):
    cd = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", _s("C.m", _c("l_partkey")).alias("method_key"), (_c("l_linenumber") * 10).alias("line"), _s("x", _c("l_suppkey") % 3).alias("variable"), "l_suppkey", F.lit("C").alias("callee_class"), _s("m", F.when(_c("l_suppkey") % 5 == 0, _c("l_partkey")).otherwise(_c("l_suppkey") + 10000000)).alias("callee_method"))
    br = table(spark, sf, "part").select(_s("C.m", _c("p_partkey")).alias("method_key"), (_c("p_size") % 40).alias("start"), (_c("p_size") % 40 + 25).alias("end"), F.when(_c("p_size") % 2 == 0, "isValid(x0)").otherwise("x1 > 2").alias("condition"))
    return cd, br


@query(f"WITH {_CODE} SELECT cd.l_orderkey, cd.l_linenumber, CASE WHEN l_suppkey % 7 = 0 THEN 'lambda' WHEN line BETWEEN a AND z THEN 'if' WHEN l_suppkey % 5 = 0 THEN 'self' ELSE 'none' END AS condition FROM cd JOIN br USING (mk)")
def call_conditions(spark, sf):
    cd, br = _code(spark, sf)
    cd = cd.withColumns({"receiver": F.when(_c("l_suppkey") % 5 == 0, "this").otherwise("dao"), "in_lambda": _c("l_suppkey") % 7 == 0})
    return facts.call_conditions(cd.withColumnRenamed("method_key", "caller_key"), br.drop("condition")).select("l_orderkey", "l_linenumber", "condition")


@query(f"WITH {_CODE} SELECT DISTINCT mk AS method_key, vari AS variable, line, 'x1' AS source FROM cd JOIN br USING (mk) WHERE line BETWEEN a AND z AND cond LIKE 'x1%'")
def implicit_flows(spark, sf):
    cd, br = _code(spark, sf)
    return facts.implicit_flows(cd.select("method_key", "variable", "line"), br, br.select("method_key", F.lit("x1").alias("variable")).distinct())


@query(f"WITH {_CODE} SELECT l_orderkey, l_linenumber, line BETWEEN a AND z AND cond LIKE 'isValid%' OR p_size % 6 = 1 AS validated FROM cd JOIN br USING (mk) JOIN part ON mk = 'C.m' || p_partkey")
def validated_calls(spark, sf):
    cd, br = _code(spark, sf)
    ann = table(spark, sf, "part").select(_s("C.m", _c("p_partkey")).alias("method_key"), F.when(_c("p_size") % 12 == 1, "PreAuthorize").when(_c("p_size") % 12 == 7, "PermitAll").otherwise("Valid").alias("annotation"))
    return facts.validated(cd.select("l_orderkey", "l_linenumber", "method_key", "line"), br, ann).select("l_orderkey", "l_linenumber", "validated")


@query("""WITH c AS (SELECT 'F' || l_partkey AS k, 0 AS p, 'v' || l_suppkey AS v, 'assigned' AS s FROM lineitem WHERE l_linenumber = 7 UNION ALL SELECT 'F' || p_partkey, 1, CASE WHEN p_size % 2 = 0 THEN p_name END, 'config' FROM part UNION ALL SELECT 'F' || p_partkey, 2, p_brand, 'default' FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY p, v, s) AS n FROM c WHERE v IS NOT NULL) SELECT k AS field_key, v AS value, s AS source FROM r WHERE n = 1""")
def field_values(spark, sf):
    part, li = table(spark, sf, "part"), table(spark, sf, "lineitem")
    row = lambda df, key, value, source: df.select(_s("F", _c(key)).alias("field_key"), value.alias("value"), F.lit(source).alias("source"))
    return facts.field_values(row(li.where("l_linenumber = 7"), "l_partkey", _s("v", _c("l_suppkey")), "assigned"), row(part, "p_partkey", F.when(_c("p_size") % 2 == 0, _c("p_name")), "config"), row(part, "p_partkey", _c("p_brand"), "default"))


@query("""WITH src AS (SELECT conv_id AS file, turn AS line, text FROM conversations), w AS (SELECT file, min(line) AS lo, max(line) AS hi FROM src WHERE length(text) % 2 = 0 GROUP BY file), b AS (SELECT DISTINCT file, line AS s, line + 2 AS e FROM src), a AS (SELECT w.file, s, e, row_number() OVER (PARTITION BY w.file ORDER BY e - s, s, e) AS n FROM w JOIN b ON b.file = w.file AND s <= lo AND e >= hi)
SELECT file, coalesce(s, lo) AS start, coalesce(e, hi) AS "end", (SELECT string_agg(text, chr(10) ORDER BY line, text) FROM src WHERE src.file = w.file AND line BETWEEN coalesce(s, lo) AND coalesce(e, hi)) AS text FROM w LEFT JOIN a USING (file) WHERE coalesce(n, 1) = 1""")
def self_contained(spark, sf):
    src = table(spark, sf, "conversations").select(_c("conv_id").alias("file"), _c("turn").alias("line"), "text")
    return facts.self_contained(src.where("length(text) % 2 = 0").select("file", "line"), src.select("file", _c("line").alias("start"), (_c("line") + 2).alias("end")).distinct(), src)


@query("""SELECT '{"role":"' || role || '","turn":"' || turn || '","who":"UNKNOWN"}' AS json FROM conversations""")
def tool_projection(spark, sf):
    return facts.projected(table(spark, sf, "conversations").withColumn("who", F.lit(None).cast("string")), ["role", "turn", "who"])


@query("""WITH h AS (SELECT conv_id AS a, turn AS pos, role AS f, turn % 3 AS l FROM conversations), r AS (SELECT DISTINCT conv_id AS a, role AS f, turn % 5 AS l FROM conversations), n AS (SELECT * FROM r WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.a = r.a AND h.f = r.f AND h.l = r.l))
SELECT a AS alert_id, row_number() OVER (PARTITION BY a ORDER BY late, p, f, l) - 1 AS pos, f AS file, l AS line FROM (SELECT a, 0 AS late, pos AS p, f, l FROM h UNION ALL SELECT a, 1, 0, f, l FROM n)""")
def slice_promotion(spark, sf):
    c = table(spark, sf, "conversations")
    h = c.select(_c("conv_id").alias("alert_id"), _c("turn").alias("pos"), _c("role").alias("file"), (_c("turn") % 3).alias("line"))
    return facts.promoted(h, c.select(_c("conv_id").alias("alert_id"), F.lit(0).cast("long").alias("pos"), _c("role").alias("file"), (_c("turn") % 5).alias("line"))).select("alert_id", _c("pos").cast("long").alias("pos"), "file", "line")


@query("SELECT 'm' || p_partkey AS name, CASE WHEN p_size % 4 = 0 THEN 'definitive' WHEN p_size % 4 < 3 THEN 'uncertain' ELSE 'unreachable' END AS state FROM part")
def reach_classes(spark, sf):
    p = table(spark, sf, "part").withColumn("name", _s("m", _c("p_partkey")))
    return facts.reach_classes(p, p.where("p_size % 4 = 0"), p.where("p_size % 4 < 3"))


@query("SELECT DISTINCT 'm' || l_partkey AS name FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size % 4 = 0)")
def frontier(spark, sf):
    return search.frontier(table(spark, sf, "lineitem").select(_s("m", _c("l_partkey")).alias("name")), table(spark, sf, "part").where("p_size % 4 = 0").select(_s("m", _c("p_partkey")).alias("name")))


@query("""SELECT p_partkey AS id, CASE WHEN p_size % 6 = 0 THEN 'getParameter' WHEN p_size % 6 = 1 THEN NULL WHEN p_size % 6 = 2 THEN 'src' WHEN p_size % 6 = 3 THEN NULL WHEN p_size % 6 = 4 AND p_partkey % 2 = 0 THEN 'src' END AS source FROM part""")
def expression_taint(spark, sf):
    k = _c("p_size") % 6
    callee = F.when(k == 0, "getParameter").when(k == 1, F.lit(None)).when(k == 3, "escapeHtml").otherwise("run")
    receiver = F.when(k == 2, "tainted").otherwise("other")
    args = F.when(k == 1, "tainted == 1").when(k == 3, "tainted").when((k == 4) & (_c("p_partkey") % 2 == 0), "1, tainted").when(k == 4, "taintedness").otherwise("x")
    e = table(spark, sf, "part").select(_c("p_partkey").alias("id"), _s("m", _c("p_partkey")).alias("method_key"), receiver.alias("receiver"), callee.alias("callee"), args.alias("args"))
    scope = e.select("method_key", F.lit("tainted").alias("variable"), F.lit("src").alias("source"))
    return facts.tainted_expressions(e, scope, ["getParameter"], ["escapeHTML"]).select("id", "source")


# ---- graphs and types ----


@query("""WITH RECURSIVE e AS (SELECT 'N' || n_nationkey AS a, 'R' || n_regionkey AS b FROM nation UNION SELECT 'N' || n_nationkey, 'N' || n_nationkey // 2 FROM nation WHERE n_nationkey > 0), r AS (SELECT DISTINCT a AS s, a AS n, 0 AS d FROM e UNION SELECT s, e.b, d + 1 FROM r JOIN e ON n = a WHERE d < 9), u AS (SELECT s, n, min(d) AS d FROM r GROUP BY ALL),
mem AS (SELECT 'N' || n_nationkey AS o, 'm' || n_nationkey % 4 AS m, 'k' || n_nationkey AS k, n_nationkey % 2 AS p FROM nation UNION ALL SELECT 'R' || r_regionkey, 'm' || r_regionkey, 'r' || r_regionkey, 1 FROM region), h AS (SELECT s, m, o, k, d, row_number() OVER (PARTITION BY s, m ORDER BY d, o, (p = 1)::INT DESC, k) AS i FROM u JOIN mem ON o = n)
SELECT s AS class, m AS member, o AS owner, k AS key, d AS depth FROM h WHERE i = 1""")
def nearest_member(spark, sf):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    name = _s("N", _c("n_nationkey"))
    mem = n.select(name.alias("owner"), _s("m", _c("n_nationkey") % 4).alias("member"), _s("k", _c("n_nationkey")).alias("key"), (_c("n_nationkey") % 2).cast("int").alias("params")).unionByName(r.select(_s("R", _c("r_regionkey")).alias("owner"), _s("m", _c("r_regionkey")).alias("member"), _s("r", _c("r_regionkey")).alias("key"), F.lit(1).alias("params")))
    asked = n.select(name.alias("class"), F.explode(F.array(*[F.lit(f"m{i}") for i in range(5)])).alias("member"), F.lit(1).alias("args"))
    parents = n.where("n_nationkey > 0").select(name.alias("class"), _s("N", F.floor(_c("n_nationkey") / 2)).alias("parent"))
    return graph.nearest_member(asked, mem, parents, n.select(name.alias("class"), _s("R", _c("n_regionkey")).alias("iface"))).select("class", "member", "owner", "key", "depth")


@query("""WITH RECURSIVE p AS (SELECT n_nationkey AS c, n_nationkey // 2 AS p FROM nation WHERE n_nationkey > 0), r AS (SELECT n_nationkey AS s, n_nationkey AS n, 0 AS d FROM nation UNION ALL SELECT s, p.p, d + 1 FROM r JOIN p ON n = c), m AS (SELECT n_nationkey AS c, 'm' || n_nationkey % 3 AS g FROM nation UNION SELECT n_nationkey, 'x' || n_regionkey FROM nation),
h AS (SELECT s, n, g, d, row_number() OVER (PARTITION BY s, g ORDER BY d, 'N' || n) AS i FROM r JOIN m ON m.c = n) SELECT 'N' || s AS class, 'N' || n AS owner, g AS signature FROM h WHERE i = 1 AND d > 0""")
def inherited_methods(spark, sf):
    n = table(spark, sf, "nation")
    name = _s("N", _c("n_nationkey"))
    m = n.select(name.alias("class"), _s("m", _c("n_nationkey") % 3).alias("signature")).union(n.select(name, _s("x", _c("n_regionkey"))))
    return graph.inherited_methods(n.where("n_nationkey > 0").select(name.alias("class"), _s("N", F.floor(_c("n_nationkey") / 2)).alias("parent")), m)


@query("""WITH RECURSIVE p AS (SELECT 'N' || n_nationkey AS c, 'N' || n_nationkey // 2 AS p FROM nation WHERE n_nationkey > 0), i AS (SELECT 'R' || n_regionkey AS f, 'N' || n_nationkey AS c FROM nation UNION SELECT 'Top', 'R' || r_regionkey FROM region WHERE r_regionkey < 3), below AS (SELECT c AS s, c AS n FROM i UNION SELECT s, p.c FROM below JOIN p ON n = p.p),
up AS (SELECT f AS s, f AS n FROM i UNION SELECT s, i.f FROM up JOIN i ON n = i.c) SELECT DISTINCT up.n AS iface, below.n AS class FROM i JOIN below ON below.s = i.c JOIN up ON up.s = i.f""")
def implementations(spark, sf):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    name = _s("N", _c("n_nationkey"))
    i = n.select(name.alias("class"), _s("R", _c("n_regionkey")).alias("iface")).union(r.where("r_regionkey < 3").select(_s("R", _c("r_regionkey")), F.lit("Top")))
    return graph.implementations(n.where("n_nationkey > 0").select(name.alias("class"), _s("N", F.floor(_c("n_nationkey") / 2)).alias("parent")), i)


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag <> 'A' AND l_linestatus = 'O'")
def unresolved_edges(spark, sf):
    li = table(spark, sf, "lineitem").withColumns({"resolved": F.when(_c("l_returnflag") == "A", True), "call_type": F.when(_c("l_linestatus") == "O", "reflection").otherwise("unresolved")})
    return graph.unresolved(li, ["reflection"]).select("l_orderkey", "l_linenumber")


@query("SELECT 'orders' AS name, count(*) AS rows FROM orders UNION ALL SELECT 'part', count(*) FROM part UNION ALL SELECT 'supplier', count(*) FROM supplier")
def graph_stats(spark, sf):
    return graph.graph_stats({n: table(spark, sf, n) for n in ("orders", "part", "supplier")})


# ---- routing ----


@query("SELECT doc_id, 'uncertain' AS verdict, 0 AS confidence, 'timeout: ' || lang AS fail_reason, 'm1' AS model_used FROM documents")
def fail_open(spark, sf):
    return routing.fail_open(table(spark, sf, "documents"), F.concat(F.lit("timeout: "), "lang"), "m1").select("doc_id", "verdict", "confidence", "fail_reason", "model_used")


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND quality = 1)")
def stream_resume(spark, sf):
    done = table(spark, sf, "labels").select(_c("doc_id").alias("alert_id"), F.when(_c("quality") == 0, "failed").alias("fail_reason"))
    return routing.resume(table(spark, sf, "documents").select(_c("doc_id").alias("alert_id")), done).select(_c("alert_id").alias("doc_id"))


@query("SELECT p_partkey, CASE lower(p_type) WHEN 'economy' THEN true WHEN 'promo' THEN false ELSE false END AS calibrated FROM part")
def calibrated_lookup(spark, sf):
    reg = spark.createDataFrame([("Economy", True, 1), ("ECONOMY", False, 2), ("promo", False, 1), ("PROMO", True, 3)], "vulnerability_type string, calibrated boolean, pos int")
    return routing.calibrated(table(spark, sf, "part"), "p_type", reg).select("p_partkey", "calibrated")


@query("""SELECT o_orderkey, o_orderstatus = 'F' AS confirmed, o_orderstatus = 'O' AND o_orderpriority LIKE '1%' AND o_orderkey % 3 <> 0 AS suspected FROM orders""")
def confirmed_suspected(spark, sf):
    o = table(spark, sf, "orders")
    verdict = F.when(_c("o_orderstatus") == "F", "true_positive").when(_c("o_orderstatus") == "O", "uncertain").otherwise("false_positive")
    disposition = F.when(_c("o_orderpriority").startswith("1"), "likely_tp").otherwise("likely_fp")
    return o.select("o_orderkey", routing.confirmed(verdict).alias("confirmed"), routing.suspected(verdict, disposition, F.when(_c("o_orderkey") % 3 == 0, "downgraded_to_uncertain")).alias("suspected"))


@query("""WITH o AS (SELECT o_orderkey, o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '5-LOW') AS held, o_custkey IN (1, 2, 3) AS f FROM orders)
SELECT o_orderkey, 'kept' AS kind FROM o WHERE NOT held OR f UNION ALL SELECT o_orderkey, CASE WHEN f THEN 'forced' ELSE 'exempt' END FROM o WHERE held""")
def environment_exemption(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.when(_c("o_orderstatus") == "F", "true_positive").otherwise("uncertain").alias("verdict"), F.concat("o_orderpriority", F.lit(":x")).alias("vulnerability_type"), _c("o_custkey").cast("string").alias("bughash"))
    kept, gone = routing.environment_exemption(o, ["1-URGENT", "5-LOW"], ["1", "2", "3"], False)
    return kept.select("o_orderkey", F.lit("kept").alias("kind")).unionByName(gone.select("o_orderkey", F.when(_c("forced"), "forced").otherwise("exempt").alias("kind")))


@query("SELECT count(*) FILTER (l.toxic = 1) AS tp, count(*) FILTER (l.toxic = 0 AND l.quality = 0) AS hardening, count(*) FILTER (d.lang = 'en') AS confirmed FROM documents d JOIN labels l USING (doc_id) WHERE d.source <> 'src1' AND d.lang <> 'fr'")
def selection(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    rows = d.select(_c("doc_id").alias("bughash"), F.when(_c("source") == "src1", "HE-1").otherwise("").alias("exclusion_reason"), F.when(_c("toxic") == 1, "true_positive").when(_c("quality") == 0, "needs-hardening").otherwise("x").alias("label"), F.when(_c("lang") == "en", "confirmed").otherwise("candidate").alias("label_status"), "lang")
    return routing.selection_counts(routing.selected(rows, rows.where("lang <> 'fr'")))


@query("""SELECT p_partkey, CASE p_size % 8 WHEN 0 THEN CASE WHEN p_partkey % 2 = 0 THEN 'HTTP' ELSE '' END WHEN 1 THEN 'HTTP' WHEN 2 THEN CASE WHEN p_partkey % 2 = 0 THEN 'HTTP' ELSE '' END WHEN 3 THEN 'CONTAINER' WHEN 4 THEN 'SCHEDULED' WHEN 5 THEN 'MESSAGE_LISTENER' WHEN 6 THEN '' ELSE 'CONTAINER' END AS kind,
CASE WHEN p_size % 3 = 0 THEN '/' ELSE '/api/' || lower(p_type) || '/x' END AS path FROM part""")
def entry_points(spark, sf):
    pick = [["GetMapping"], ["PostMapping", "ResponseBody"], ["ExceptionHandler"], ["Bean", "Scheduled"], ["Scheduled"], ["KafkaListener"], ["Around", "PostConstruct"], ["PostConstruct"]]
    m = F.array().cast("array<string>")
    for i, names in enumerate(pick):
        m = F.when(_c("p_size") % 8 == i, F.array(*[F.lit(x) for x in names])).otherwise(m)
    cls = F.when(_c("p_partkey") % 2 == 0, F.array(F.lit("RestController")))
    root, sub = F.when(_c("p_size") % 3 != 0, "//api/"), F.when(_c("p_size") % 3 != 0, F.concat(F.lower("p_type"), F.lit("//x/"))).otherwise("/")
    return table(spark, sf, "part").select("p_partkey", routing.entry_point(m, cls).alias("kind"), routing.http_path(root, sub).alias("path"))


@query("""SELECT p_partkey, CASE WHEN p_size % 3 > 0 THEN 'reachable' WHEN p_size % 2 = 0 THEN 'unknown' WHEN p_size % 7 = 0 THEN 'unreachable' WHEN p_size % 7 > p_size % 4 THEN 'uncertain' ELSE 'unreachable' END AS state,
CASE WHEN p_size % 4 = 1 OR p_size % 5 = 0 THEN 'unknown' WHEN p_size % 4 > 1 THEN 'anchored' ELSE '' END AS ahead FROM part""")
def reachability_state(spark, sf):
    n = _c("p_size")
    names = lambda when: F.when(when, F.array(F.lit("m")))
    ahead = routing.forward_reachable(names(n % 4 > 1), names(n % 4 == 1), n % 5 == 0)
    return table(spark, sf, "part").select("p_partkey", routing.reachability_state(n % 3, n % 2 == 0, n % 7, F.least(n % 7, n % 4)).alias("state"), ahead.alias("ahead"))


@query("""WITH c AS (SELECT conv_id, turn, role || '(x' || turn % 3 || '(if (y' || CASE WHEN turn % 2 = 0 THEN ' (z))' ELSE '))' END AS code FROM conversations), n AS (SELECT conv_id, turn, unnest(regexp_extract_all(code, '\\b([A-Za-z_][A-Za-z0-9_]*)\\s*\\(', 1)) AS name FROM c) SELECT conv_id AS key, name, min(turn) AS pos FROM n WHERE name <> 'if' GROUP BY ALL""")
def candidate_callees(spark, sf):
    code = F.concat("role", F.lit("(x"), _c("turn") % 3, F.lit("(if (y"), F.when(_c("turn") % 2 == 0, " (z))").otherwise("))"))
    return routing.candidate_callees(table(spark, sf, "conversations").select(_c("conv_id").alias("key"), _c("turn").alias("pos"), code.alias("code")), ["if"])


@query("""SELECT p_partkey, p_size % 5 IN (0, 2) AS sanitizer, p_size % 5 = 3 AS noise, p_size % 3 >= 2 OR p_partkey % 4 = 0 AS gate, p_partkey % 4 = 0 AS word, p_size % 4 < 2 AS keyword FROM part""")
def callee_gates(spark, sf):
    args = F.when(_c("p_partkey") % 4 == 0, "f(a, b)").otherwise("f(ab, a_)")
    name = F.element_at(F.array(*[F.lit(x) for x in ("makeSafeHtml", "verify", "CHECKED", "toString()", "toStringer")]), (_c("p_size") % 5 + 1).cast("int"))
    callee = F.element_at(F.array(*[F.lit(x) for x in ("Stmt.execute", "execute(q)", "Stmt.executeQuery", "execute.run")]), (_c("p_size") % 4 + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", routing.sanitizer_name(name).alias("sanitizer"), routing.noise_name(name).alias("noise"), t.keyword_hit(F.lit("execute"), callee).alias("keyword"), routing.gate(F.array(F.lit("a"), F.lit("q")), args, _c("p_size") % 3, 2).alias("gate"), t.whole_word(F.lit("a"), args).alias("word"))


@query("""WITH s(k, ty, cwe, sev, ben) AS (VALUES ('PROMO.m1', 'sql', 'CWE-89', 4, false), ('m2', 'xss', 'CWE-79', 3, false), ('m1', 'low', 'CWE-1', 1, true)) SELECT p_partkey, CASE WHEN NOT coalesce(a.ben, b.ben) THEN coalesce(a.ty, b.ty) END AS sink_type, CASE WHEN NOT coalesce(a.ben, b.ben) THEN coalesce(a.cwe, b.cwe) END AS sink_cwe, coalesce(a.sev, b.sev) AS sink_severity, coalesce(a.ben, b.ben, false) AS is_benign
FROM part LEFT JOIN s a ON a.k = p_type || '.m' || p_size % 4 LEFT JOIN s b ON b.k = 'm' || p_size % 4""")
def sink_match(spark, sf):
    base = [("PROMO.m1", "sqli", "CWE-0", 4, False, False), ("m2", "xss", "CWE-79", 3, False, False), ("m1", "low", "CWE-1", 1, True, False)]
    schema = "key string, vuln_type string, cwe string, severity int, benign boolean, source_side boolean"
    cat = routing.catalogue(spark.createDataFrame(base, schema), spark.createDataFrame([("PROMO.m1", "sql", "CWE-89", 4, False, False)], schema))
    c = table(spark, sf, "part").select("p_partkey", _c("p_type").alias("callee_class"), _s("m", _c("p_size") % 4).alias("callee_method"))
    return routing.sink_match(c, cat).select("p_partkey", "sink_type", "sink_cwe", "sink_severity", "is_benign")


@query("""SELECT DISTINCT l_suppkey AS caller, l_partkey AS callee, l_linenumber AS line FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size % 3 = 0 OR l_linenumber = 2 AND l_suppkey % 2 = 0""")
def dynamic_sinks(spark, sf):
    c = table(spark, sf, "lineitem").select(_s("k", _c("l_suppkey")).alias("caller_key"), F.lit("Mapper").alias("callee_class"), _s("m", _c("l_partkey")).alias("callee_method"), _c("l_linenumber").alias("line"), (_c("l_linenumber") == 2).alias("is_builder"), _c("l_suppkey").alias("caller"), _c("l_partkey").alias("callee"))
    m = table(spark, sf, "part").select(F.lit("app.Mapper").alias("namespace"), F.lit("Mapper").alias("short_class"), _s("m", _c("p_partkey")).alias("id"), (_c("p_size") % 3 == 0).alias("has_concat"))
    tainted = c.where("caller % 2 = 0").select("caller_key", "line")
    return routing.dynamic_sinks(c, m, tainted).select("caller", "callee", "line").distinct()


# ---- history, summaries ----


@query("""WITH x AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) SELECT user_id AS id, CASE WHEN event_type <> 'error' THEN event_type END AS authz, CASE WHEN event_type <> 'error' THEN props END AS upload FROM x WHERE n = 1""")
def attach_facts(spark, sf):
    e = table(spark, sf, "events")
    traces = e.select(_c("user_id").alias("bughash"), _c("event_id").alias("seq"), F.when(_c("event_type") != "error", _c("event_type")).alias("authz"), _c("props").alias("upload"))
    return history.attach_facts(e.select(_c("user_id").alias("bughash")).distinct(), traces).select(_c("bughash").alias("id"), "authz", "upload")


@query("""WITH r AS (SELECT DISTINCT 'r' || event_id % 90 AS r FROM events ORDER BY r DESC LIMIT 60) SELECT DISTINCT user_id AS bughash, CASE event_id % 3 WHEN 0 THEN 'access_control' WHEN 1 THEN 'file_upload' ELSE 'xss' END AS family FROM events WHERE event_type = 'view' AND 'r' || event_id % 90 IN (SELECT r FROM r)""")
def history_faces(spark, sf):
    kinds = F.when(_c("event_id") % 3 == 0, F.array(F.lit("IDOR"), F.lit(""))).when(_c("event_id") % 3 == 1, F.array(F.lit("unrestricted-file-upload"))).otherwise(F.array(F.lit(" XSS ")))
    runs = table(spark, sf, "events").select(_s("r", _c("event_id") % 90).alias("run_id"), _c("user_id").alias("bughash"), F.when(_c("event_type") == "view", "true_positive").otherwise("uncertain").alias("verdict"), kinds.alias("actual_types"))
    return history.history_faces(runs)


@query("""SELECT event_id, event_type FROM events WHERE event_id % 3 = 1 AND user_id = (SELECT min(user_id) FROM events)""")
def label_history(spark, sf):
    e = table(spark, sf, "events")
    log = e.select(_s("r", _c("event_id") % 3).alias("run_id"), _c("user_id").cast("string").alias("bughash"), _c("event_id").alias("seq"), "event_id", "event_type")
    return history.label_history(log, "r1", str(e.agg(F.min("user_id").alias("u")).first().u)).select("event_id", "event_type")


@query("""WITH n AS (SELECT max(ts) AS now FROM events) SELECT event_id FROM events, n WHERE epoch(date_trunc('second', ts)) >= epoch(date_trunc('second', now)) - 864000""")
def cache_purge(spark, sf):
    e = table(spark, sf, "events").withColumn("created_at", _c("ts").cast("timestamp"))
    now = e.agg(F.max("created_at").alias("now")).first().now
    return history.purge(e, F.lit(now), 864000).select("event_id")


@query("SELECT 'r' || c_custkey AS run_id, CASE WHEN n > 0 THEN n END AS counts FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def run_listing(spark, sf):
    sums = table(spark, sf, "orders").groupBy(_s("r", _c("o_custkey")).alias("run_id")).agg(F.count("*").alias("counts"))
    return history.run_listing(table(spark, sf, "customer").select(_s("r", _c("c_custkey")).alias("run_id")), sums)


@query("""SELECT 'stage' AS what, o_orderstatus AS a, '' AS b, count(*) AS n FROM orders GROUP BY o_orderstatus UNION ALL SELECT 'kept', '', '', count(*) FROM orders WHERE o_orderstatus <> 'F' UNION ALL SELECT 'count', o_orderpriority, o_orderstatus, count(*) FROM orders GROUP BY ALL""")
def funnel_discovery(spark, sf):
    o = table(spark, sf, "orders").select(_c("o_orderstatus").alias("stage"), F.when(_c("o_orderstatus") == "F", "false_positive").otherwise("uncertain").alias("verdict"), _c("o_orderpriority").alias("disposition"), _c("o_orderstatus").alias("severity"))
    kept, counts = summary.discovery(o)
    row = lambda df, what, a, b: df.select(F.lit(what).alias("what"), a.alias("a"), b.alias("b"), "n")
    one = row(summary.funnel(o).withColumnRenamed("rows", "n"), "stage", _c("stage"), F.lit(""))
    return one.unionByName(row(kept.agg(F.count("*").alias("n")), "kept", F.lit(""), F.lit(""))).unionByName(row(counts.withColumnRenamed("rows", "n"), "count", _c("disposition"), _c("severity")))


@query("""WITH m AS (SELECT 'C.m' || p_partkey // 2 || CASE WHEN p_partkey % 2 = 0 THEN '()' ELSE '(A)' END AS k, 'C.m' || p_partkey // 2 AS pat FROM part), up AS (SELECT l_partkey, count(DISTINCT (l_suppkey, l_linenumber)) AS n FROM lineitem GROUP BY 1), dn AS (SELECT l_suppkey, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1)
SELECT p_partkey, coalesce(up.n, 0) AS callers, coalesce(dn.n, 0) AS callees, CAST(0 AS BIGINT) AS taints, count(*) OVER (PARTITION BY p_partkey // 2) > 1 AS ambiguous FROM part LEFT JOIN up ON up.l_partkey = p_partkey LEFT JOIN dn ON dn.l_suppkey = p_partkey""")
def function_profile(spark, sf):
    key = lambda c: _s("C.m", F.floor(_c(c) / 2), F.when(_c(c) % 2 == 0, "()").otherwise("(A)"))
    li = table(spark, sf, "lineitem")
    up = li.select(key("l_partkey").alias("callee_key"), _c("l_suppkey").alias("caller_key"), _c("l_linenumber").alias("line"), F.lit("f").alias("file_path"))
    down = li.select(key("l_suppkey").alias("caller_key"), F.lit("C").alias("callee_class"), _c("l_partkey").alias("callee_method"))
    none = li.where(F.lit(False)).select(F.lit("").alias("location_key"), F.lit("").alias("source_method"))
    return summary.function_profile(table(spark, sf, "part").select("p_partkey", key("p_partkey").alias("method_key")), up, down, none).select("p_partkey", "callers", "callees", "taints", "ambiguous")


@query("""WITH e AS (SELECT * FROM lineitem WHERE l_returnflag <> 'A'), g AS (SELECT l_suppkey AS s, l_partkey % 50 AS m, string_agg(DISTINCT l_linenumber::VARCHAR, ',' ORDER BY l_linenumber::VARCHAR) AS lines, coalesce(max(l_linenumber) FILTER (l_linenumber > 3), 0) AS k FROM e GROUP BY 1, 2), c AS (SELECT p_size % 60 AS m, count(*) AS n FROM part GROUP BY 1)
SELECT s AS caller, m AS callee, lines, CASE WHEN k > 0 THEN 't' || k WHEN coalesce(n, 0) > 0 THEN 'interface' ELSE 'unresolved' END AS call_type, coalesce(n, 0) AS n FROM g LEFT JOIN c USING (m)""")
def breakpoints(spark, sf):
    e = table(spark, sf, "lineitem").select(_c("l_suppkey").alias("caller_key"), F.lit("C").alias("callee_class"), (_c("l_partkey") % 50).alias("callee_method"), _c("l_linenumber").alias("line"), (_c("l_returnflag") == "A").alias("resolved"), F.when(_c("l_linenumber") > 3, _s("t", _c("l_linenumber"))).otherwise("").alias("call_type"))
    c = table(spark, sf, "part").select(F.lit("C").alias("iface"), (_c("p_size") % 60).cast("long").alias("method"), _c("p_partkey").alias("method_key"))
    out = summary.breakpoints(e, c)
    return out.select(_c("caller_key").alias("caller"), _c("callee_method").alias("callee"), F.array_join(F.array_sort(F.transform("lines", lambda x: x.cast("string"))), ",").alias("lines"), F.coalesce("call_type", F.lit("")).alias("call_type"), F.size("candidates").cast("long").alias("n"))


@query("""SELECT user_id AS alert_id, bool_or(event_type = 'error') AS failed, max(value) AS peak, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds FROM events GROUP BY 1""")
def coverage_signals(spark, sf):
    cells = table(spark, sf, "events").select(_c("user_id").alias("alert_id"), (_c("event_type") == "error").alias("failed"), _c("value").alias("peak"), F.array("event_type").alias("kinds"))
    return stability.signals(cells, ["failed"], ["peak"], ["kinds"]).withColumn("kinds", F.array_join("kinds", ","))


@query("SELECT o_orderstatus || '/' || o_orderpriority AS tally, count(*) AS rows FROM orders GROUP BY ALL")
def fire_control_tally(spark, sf):
    return summary.counts_by(table(spark, sf, "orders").select(_s(_c("o_orderstatus"), "/", _c("o_orderpriority")).alias("tally")), "tally")


@query("""WITH g AS (SELECT o_orderkey AS pos, 'id' || o_custkey AS i, CAST(o_totalprice AS VARCHAR) AS s FROM orders) SELECT i AS osv_id, max(pos) AS pos FROM g GROUP BY i""")
def severity_of_ids(spark, sf):
    g = table(spark, sf, "orders").select(_c("o_orderkey").alias("pos"), F.array(_s("id", _c("o_custkey"))).alias("ids"), _c("o_orderkey").alias("max_severity"))
    return policy.severity_of_ids(g).select("osv_id", _c("cvss_score").alias("pos"))


# ---- slices, ranges ----


@query("""WITH d AS (SELECT p_partkey AS doc, p_size AS n FROM part) SELECT doc, 'src/a.java' AS file, n + 1 AS "from", n + 1 + greatest(n % 4, 1) - 1 AS "to" FROM d UNION ALL SELECT doc, 'src/a.java', 90, 90 FROM d WHERE n % 2 = 0 UNION ALL SELECT doc, 'b.java', NULL, NULL FROM d""")
def diff_hunks(spark, sf):
    n = _c("p_size")
    lines = F.array(F.lit("--- a/src/a.java"), F.lit("+++ b/src/a.java\r"), _s("@@ -1,3 +", n + 1, ",", n % 4, " @@ x"), F.lit("+y"), F.when(n % 2 == 0, "@@ -9 +90 @@").otherwise(" z"), F.lit("+++ b.java"), F.lit("-gone"), F.lit("+++ /dev/null"))
    rows = table(spark, sf, "part").select(_c("p_partkey").alias("doc"), F.posexplode(lines).alias("n", "text"))
    return ranges.diff_hunks(rows)


@query("""WITH w AS (SELECT DISTINCT l_partkey AS f, l_linenumber * 5 AS l FROM lineitem), x AS (SELECT f, unnest(range(l - 2, l + 3)) AS l FROM w) SELECT f AS file, l AS line FROM w UNION SELECT f, l FROM x JOIN part ON p_partkey = f WHERE l BETWEEN 1 AND 30 AND l BETWEEN p_size % 20 AND p_size % 20 + 12""")
def context_lines(spark, sf):
    w = table(spark, sf, "lineitem").select(_c("l_partkey").alias("file"), (_c("l_linenumber") * 5).cast("long").alias("line")).distinct()
    p = table(spark, sf, "part").select(_c("p_partkey").alias("file"), (_c("p_size") % 20).alias("start"), (_c("p_size") % 20 + 12).alias("end"))
    return ranges.around(w, p, 2, p.select("file", F.lit(30).alias("last")))


@query("""SELECT l_partkey AS k, min(CASE WHEN l_linenumber = 7 THEN 0 ELSE 1 END) AS hop FROM (SELECT l_partkey, l_linenumber FROM lineitem WHERE l_linenumber = 7 UNION ALL SELECT s.l_suppkey, 1 FROM lineitem s WHERE s.l_partkey IN (SELECT l_partkey FROM lineitem WHERE l_linenumber = 7)) GROUP BY 1""")
def changed_with_callers(spark, sf):
    li = table(spark, sf, "lineitem")
    e = li.select(_c("l_suppkey").alias("caller_key"), _c("l_partkey").alias("callee_key"))
    return ranges.with_callers(li.where("l_linenumber = 7").select(_c("l_partkey").alias("method_key")), e).select(_c("method_key").alias("k"), "hop")


@query("""WITH q AS (SELECT o_orderkey AS id, o_custkey AS m, o_orderkey % 40 AS a, o_orderkey // 7 % 40 AS z FROM orders), x AS (SELECT q.*, (a BETWEEN 5 AND 9 AND z BETWEEN 10 + p_size % 3 AND 15 OR z BETWEEN 5 AND 9 AND a BETWEEN 10 + p_size % 3 AND 15) AND p_partkey IS NOT NULL AS apart, coalesce(a BETWEEN 1 AND 20 AND z BETWEEN 1 AND 20 AND p_size % 2 = 0, false) AS looped FROM q LEFT JOIN part ON p_partkey = m),
r AS (SELECT id, CASE WHEN coalesce(apart, false) THEN 'opposite_branches' WHEN z < a AND NOT looped THEN 'sink_before_source' ELSE '' END AS reason FROM x) SELECT id, reason = '' AS feasible, reason FROM r""")
def control_feasible(spark, sf):
    q = table(spark, sf, "orders").select(_c("o_orderkey").alias("id"), _c("o_custkey").alias("method_key"), (_c("o_orderkey") % 40).alias("source_line"), (F.floor(_c("o_orderkey") / 7) % 40).alias("sink_line"))
    p = table(spark, sf, "part").withColumnRenamed("p_partkey", "method_key")
    b = p.select("method_key", F.lit(5).alias("then_start"), F.lit(9).alias("then_end"), (F.lit(10) + _c("p_size") % 3).alias("else_start"), F.lit(15).alias("else_end"))
    return ranges.control_feasible(q, b, p.where("p_size % 2 = 0").select("method_key", F.lit(1).alias("start"), F.lit(20).alias("end")))


@query("""WITH c AS (SELECT l_partkey AS m, 'x' || l_suppkey % 3 AS v, 'clean' || l_linenumber AS cal, l_linenumber AS l FROM lineitem WHERE l_returnflag = 'A') SELECT o_orderkey AS id, (SELECT min(cal) FROM c WHERE c.m = o_custkey AND c.v = 'x' || o_orderkey % 3) AS sanitizer FROM orders""")
def sanitized_flows(spark, sf):
    f = table(spark, sf, "orders").select(_c("o_orderkey").alias("id"), _c("o_custkey").alias("method_key"), _s("x", _c("o_orderkey") % 3).alias("variable"))
    c = table(spark, sf, "lineitem").select(_c("l_partkey").alias("method_key"), _s("x", _c("l_suppkey") % 3).alias("variable"), _s("clean", _c("l_linenumber")).alias("callee"), _c("l_linenumber").alias("line"), (_c("l_returnflag") == "A").alias("is_sanitizer"))
    return ranges.sanitized(f, c).select("id", "sanitizer")


@query("""SELECT p_partkey, p_size % 5 + 3 > 5 AND p_size % 5 + 3 > 6 AS cut, CASE WHEN p_size % 5 + 3 > 6 THEN 3 ELSE p_size % 5 + 3 END AS n FROM part""")
def budget_degradation(spark, sf):
    hops = F.transform(F.sequence(F.lit(1), _c("p_size") % 5 + 3), lambda i: F.struct(i.alias("i"), F.lit("abcdefgh").alias("code"), (i == 2).alias("sanitizer")))
    kept, over = guards.degraded(hops, 12)
    return table(spark, sf, "part").select("p_partkey", over.alias("cut"), F.size(kept).alias("n"))


@query("""SELECT p_partkey, string_agg(i || '=' || h, ',' ORDER BY i) AS hops FROM (SELECT p_partkey, unnest(range(CASE WHEN p_size % 2 = 0 THEN 3 ELSE 2 END)) AS i, unnest(CASE WHEN p_size % 2 = 0 THEN ['a', 'b', 'c'] ELSE ['a', 'b'] END) AS h FROM part) GROUP BY 1""")
def merged_hops(spark, sf):
    more = F.when(_c("p_size") % 2 == 0, F.array(F.lit("b"), F.lit("c"))).otherwise(F.array(F.lit("a")))
    out = guards.reindexed(F.array(F.lit("a"), F.lit("b")), more)
    return table(spark, sf, "part").select("p_partkey", F.array_join(F.transform(out, lambda h: F.concat(h["hop_index"].cast("string"), F.lit("="), h["hop"])), ",").alias("hops"))


@query("""SELECT p_partkey FROM part WHERE p_size = 7 ORDER BY 'C' || p_partkey || '.m7(A)' LIMIT 10""")
def definition_search(spark, sf):
    m = table(spark, sf, "part").select("p_partkey", _s("C", _c("p_partkey"), ".m", _c("p_size"), "(A)").alias("method_key"))
    return search.definitions(m, "m7").select("p_partkey")


@query("SELECT o_custkey, o_orderkey, greatest(n - 5, 0) AS omitted FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) WHERE r <= 5")
def enrich_cap(spark, sf):
    return search.capped(table(spark, sf, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey")


# ---- rules on verdicts ----


@query("""SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '1%' AND o_orderstatus = 'F' OR o_orderpriority LIKE '2%' AND o_orderstatus = 'O' THEN 'uncertain' ELSE CASE o_orderstatus WHEN 'F' THEN 'false_positive' WHEN 'O' THEN 'true_positive' ELSE 'uncertain' END END AS dynamic,
CASE WHEN o_orderstatus = 'O' AND o_orderpriority NOT LIKE '1%' AND o_orderpriority NOT LIKE '2%' AND o_custkey % 2 = 0 THEN 'uncertain' ELSE CASE o_orderstatus WHEN 'F' THEN 'false_positive' WHEN 'O' THEN 'true_positive' ELSE 'uncertain' END END AS falsified,
o_orderpriority LIKE '3%' OR o_orderpriority LIKE '4%' AS rejected FROM orders""")
def dynamic_and_falsified(spark, sf):
    p = lambda n: _c("o_orderpriority").startswith(n)
    o = table(spark, sf, "orders").select(
        "o_orderkey", F.when(_c("o_orderstatus") == "F", "false_positive").when(_c("o_orderstatus") == "O", "true_positive").otherwise("uncertain").alias("verdict"), F.lit(8).alias("confidence"), F.lit("x").alias("disposition"),
        F.when(p("1"), "CONFIRMED").when(p("2"), "NOT_REPRODUCED").when(p("3"), "INCONCLUSIVE").alias("dynamic_outcome"), (_c("o_custkey") % 2 == 0).alias("refuted"), F.when(p("3"), "decisive_fact_unknown: style").when(p("4"), "bare_fp_buries_actual: xss").otherwise("late").alias("fail_reason"))
    a = guards.dynamic(o).select("o_orderkey", _c("verdict").alias("dynamic"))
    return a.join(guards.falsified(o).select("o_orderkey", _c("verdict").alias("falsified"), guards.contract_rejected(_c("fail_reason")).alias("rejected")), "o_orderkey")


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'present:scan' WHEN p_size % 3 = 0 THEN 'none:tree' ELSE 'unknown:' END AS fact, CASE WHEN p_size % 4 > 0 THEN 'present' WHEN p_size % 8 = 0 THEN 'none' ELSE 'unknown' END AS coverage,
CASE p_size % 4 WHEN 0 THEN 'source' WHEN 1 THEN 'sanitizer' WHEN 2 THEN 'sink' ELSE 'passthrough' END AS role FROM part""")
def tri_state_facts(spark, sf):
    n = _c("p_size")
    p = lambda hit, verdict, by: F.struct(F.when(hit, verdict).otherwise("unknown").alias("verdict"), F.lit(by).alias("by"), F.lit("g").alias("grain"))
    known = guards.first_known(p(n % 2 == 0, "present", "scan"), p(n % 3 == 0, "none", "tree"))
    code = F.when(n % 4 == 0, "x = read(); clean(x); run(x)").when(n % 4 == 1, "clean(x); run(x)").when(n % 4 == 2, "run(x)").otherwise("y")
    hop = guards.roles(F.array(F.struct(code.alias("code"))), F.array(F.lit("read(")), F.array(F.lit("clean(")), F.array(F.lit("run("), F.lit("")))
    return table(spark, sf, "part").select("p_partkey", F.concat(known["verdict"], F.lit(":"), known["by"]).alias("fact"), guards.coverage(n % 4, n % 8 == 0).alias("coverage"), hop[0]["role"].alias("role"))


@query("""SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'concat' WHEN p_size % 4 = 1 THEN 'parameterized' WHEN p_size % 4 = 2 THEN '' ELSE 'unknown' END AS style, CASE p_size % 4 WHEN 0 THEN 'mixed' WHEN 1 THEN 'parameterized' WHEN 2 THEN '' ELSE 'concat' END AS mapper, CASE p_size % 4 WHEN 0 THEN 'a|b' WHEN 1 THEN '|b' WHEN 2 THEN '|' ELSE 'a|' END AS names FROM part""")
def parameter_styles(spark, sf):
    n = _c("p_size") % 4
    sql = F.when(n == 0, "x = ${a} and y = #{b,jdbcType=INT}").when(n == 1, "y = #{b}").when(n == 2, "y = 1").otherwise("x = ${a} or ${a}")
    body = F.when(n == 0, "x = ${a}; stmt.execute (q)").when(n == 1, "#{b} prepareStatement(q)").when(n == 2, "none").otherwise("${a}")
    cat, par, style = guards.mapper_style(sql)
    return table(spark, sf, "part").select("p_partkey", guards.param_style(body, F.lit(False)).alias("style"), style.alias("mapper"), F.concat(F.array_join(cat, ","), F.lit("|"), F.array_join(par, ",")).alias("names"))


# ---- expressions ----


@query("""SELECT p_partkey, left(sha256(p_name || chr(0) || p_brand || chr(0) || p_size), 20) AS cache_key, CASE WHEN p_size % 3 = 0 THEN 'CWE-' || p_size END AS cwe, CASE WHEN p_size % 2 = 0 THEN 'CVE-' || p_partkey ELSE '' END AS cve, CASE p_type WHEN 'PROMO' THEN 'sql_injection' WHEN 'SMALL' THEN 'xss' ELSE 'some_rule' END AS rule_type,
CASE p_type WHEN 'PROMO' THEN 'sqli' ELSE lower(p_type) END AS canonical, least(greatest(p_size - 5, 0), 10) AS capped, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_brand END AS told, CASE p_type WHEN 'PROMO' THEN 0 WHEN 'SMALL' THEN 1 WHEN 'LARGE' THEN 2 ELSE 5 END AS severity_order,
CASE p_type WHEN 'PROMO' THEN 'critical' WHEN 'SMALL' THEN 'medium' WHEN 'LARGE' THEN 'low' ELSE 'medium' END AS bug_severity, CASE WHEN p_size % 3 = 0 THEN p_size END AS cwe_number, CASE WHEN p_size % 3 = 0 THEN 'known_' || p_size % 2 ELSE regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g') END AS bug_type, p_size % 4 <> 1 AS cacheable FROM part""".replace("WHEN 'PROMO' THEN 'critical' WHEN 'SMALL' THEN 'medium' WHEN 'LARGE' THEN 'low' ELSE 'medium' END AS bug_severity", "WHEN 'PROMO' THEN 'high' WHEN 'SMALL' THEN 'medium' WHEN 'LARGE' THEN 'low' ELSE 'medium' END AS bug_severity"))
def alert_expressions(spark, sf):
    n, ty = _c("p_size"), _c("p_type")
    by = lambda a, b, c, d: F.when(ty == "PROMO", a).when(ty == "SMALL", b).when(ty == "LARGE", c).otherwise(d)
    cwe = F.when(n % 3 == 0, _s("see cwe", n))
    slugs = {f"CWE{i}": f"known_{i % 2}" for i in range(0, 200, 3)}
    return table(spark, sf, "part").select(
        "p_partkey", F.substring(t.cache_key(_c("p_name"), _c("p_brand"), n), 1, 20).alias("cache_key"), v.cwe_in(F.lit("none"), cwe).alias("cwe"), t.first_with_prefix(F.array(F.lit("GHSA-1"), F.when(n % 2 == 0, _s("CVE-", _c("p_partkey"))).otherwise("X")), "CVE-").alias("cve"),
        v.rule_type(by("java/sql-injection", "java/stored-xss", "java/some-rule", "java/some-rule")).alias("rule_type"), v.canonical_type(by(" SQL-Inj ", ty, ty, ty), {"sql_inj": "sqli"}).alias("canonical"), v.capped(n - 5).alias("capped"),
        v.not_nullish(F.when(n % 5 == 0, " N/A ").otherwise(_c("p_brand"))).alias("told"), v.severity_order(by("Critical", "high", " medium", "odd")).alias("severity_order"), v.bug_severity(by("5", "2", "1", "9"), by("1", "3", "5", "x")).alias("bug_severity"),
        v.cwe_number(cwe).alias("cwe_number"), v.type_of_bug(F.when(n % 3 == 0, _s("cwe", n)), F.lit(""), _c("p_name"), slugs).alias("bug_type"), v.cacheable(F.when(n % 4 == 1, "timeout").when(n % 4 == 2, "contract_x").otherwise(""), ("contract_",)).alias("cacheable"),
    )


@query("""SELECT event_id, strftime(ts, '%Y-%m-%dT%H%M%S') AS stamp, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS back FROM events""")
def timestamps(spark, sf):
    stamp = t.utc_stamp(_c("ts").cast("timestamp"))
    return table(spark, sf, "events").select("event_id", stamp.alias("stamp"), F.unix_timestamp(t.instant(stamp)).alias("back"))


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'b' ELSE 'c' END AS mismatched, CASE WHEN p_size % 3 = 0 THEN 'a,m,n' ELSE 'a,n' END AS loaded, p_size % 2 = 0 AS same, 'a,b' AS sorted FROM part""")
def type_sets(spark, sf):
    n = _c("p_size")
    lits = lambda *x: F.array(*[F.lit(i) for i in x])
    pick = F.when(n % 2 == 0, lits("a", "b", "b")).otherwise(lits("c", "a", "c"))
    return table(spark, sf, "part").select("p_partkey", F.array_join(search.mismatched(pick, lits("a")), ",").alias("mismatched"), F.array_join(search.loaded_types(F.lit("a"), F.when(n % 3 == 0, lits("m", "a")), lits("n")), ",").alias("loaded"), t.same_set(pick, lits("b", "a")).alias("same"), F.array_join(t.sorted_unique(lits("b", "a", "b")), ",").alias("sorted"))


@query(r"""WITH s AS (SELECT p_partkey AS k, ['g(p' || p_partkey % 3 || ', b)', '"a, p\" (' || p_name || '"', 'new int[]{1, p' || p_size % 4 || '}', 'p' || p_partkey % 5] AS l, CASE WHEN p_size % 3 = 0 THEN 'p' || p_partkey % 2 ELSE 'p' || p_size % 3 END AS v FROM part),
h AS (SELECT k, [j for j in range(1, 5) if regexp_matches(l[j], '\b' || v || '\b')] AS h FROM s)
SELECT 'm' || k AS caller_key, 'c' || k AS callee_key, CASE WHEN k % 7 <> 0 AND len(h) = 1 AND NOT (k % 11 = 0 AND h[1] > 2) AND k % 13 <> 0 THEN 'q' || (h[1] - 1) END AS param_name FROM h""")
def tainted_parameters(spark, sf):
    """Calls with nested calls, strings and initialisers among their arguments; some callers call twice, some methods have fewer or unnamed parameters."""
    p, k = table(spark, sf, "part"), _c("p_partkey")
    var = lambda c: F.concat(F.lit("p"), c.cast("string"))
    args = F.concat(F.lit(" g("), var(k % 3), F.lit(', b), "a, p\\" ('), "p_name", F.lit('",new int[]{1, '), var(_c("p_size") % 4), F.lit("} ,\n"), var(k % 5))
    caller, callee = F.concat(F.lit("m"), k), F.concat(F.lit("c"), k)
    places = F.explode(F.when(k % 7 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    sites = p.select(caller.alias("caller_key"), callee.alias("callee_key"), F.concat(F.lit("f"), k % 50).alias("name"), args.alias("args"), F.when(_c("p_size") % 3 != 0, var(_c("p_size") % 3)).alias("taint_var"), places.alias("ord"))
    own = p.select(caller.alias("method_key"), F.lit(0).alias("ord"), var(k % 2).alias("param_name"))
    formal = p.select(callee.alias("method_key"), F.posexplode(F.when(k % 11 == 0, F.array(F.lit("q"), F.lit("q"))).otherwise(F.array_repeat(F.lit("q"), 4))).alias("ord", "q"), k.alias("k"))
    formal = formal.select("method_key", "ord", F.concat(F.when(_c("k") % 13 == 0, "1q").otherwise("q"), "ord").alias("param_name"))
    return calls.tainted_parameters(sites, own.unionByName(formal))


@query()
def step_matching(spark, sf):
    """Lines of a part that were not returned are steps, the others hops; compared with a loop in the tests."""
    i = table(spark, sf, "lineitem").select(_c("l_partkey").alias("alert_id"), (_c("l_orderkey") * 10 + _c("l_linenumber")).alias("id"), (_c("l_suppkey") % 5).cast("string").alias("file"), F.month("l_shipdate").cast("string").alias("name"), "l_returnflag", (_c("l_linestatus") == "O").alias("tainted"))
    steps = i.where("l_returnflag = 'N'").select("alert_id", _c("id").alias("step"), F.when(_c("id") % 3 == 0, _c("id") + 1).alias("cited"), F.when(_c("id") % 5 != 0, _c("file")).alias("file"), "name")
    return matching.match_steps(steps, i.where("l_returnflag <> 'N'").select("alert_id", _c("id").alias("hop"), "file", "name", "tainted"))
