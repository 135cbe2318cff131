"""Driver queries on the paths of call graphs: traces, flows, components, trees, over whole tables.

Parts are methods, each calls one or two smaller ones; nodes 0 and 1 call each other.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from alertmill.operators import facts, graph, taint
from alertmill.plans.queries import _EDGES, _edges, _starts, query, table
from alertmill.sources import stores, versions

_c = F.col


def _shown(path: str):
    return F.array_join(F.transform(path, lambda x: x.cast("string")), ">")


def _nodes(spark, sf, condition: str):
    return table(spark, sf, "part").where(condition).select(_c("p_partkey").alias("node"))


@query(f"""WITH RECURSIVE {_EDGES}, r AS (SELECT p_partkey AS s, p_partkey AS n, [p_partkey] AS p FROM part UNION ALL SELECT s, e.src, list_append(p, e.src) FROM r JOIN e ON n = e.dst WHERE len(p) <= 3 AND NOT list_contains(p, e.src)),
x AS (SELECT DISTINCT s FROM r WHERE len(p) = 4 AND n IN (SELECT dst FROM e)), h AS (SELECT s, p FROM r JOIN part ON p_partkey = n WHERE p_size % 7 = 0)
SELECT s AS start, list_aggregate(list_reverse(p), 'string_agg', '>') AS path, s IN (SELECT s FROM x) AS exhausted FROM h UNION ALL SELECT s, NULL, true FROM x WHERE s NOT IN (SELECT s FROM h)""")
def source_traces(spark, sf):
    out = facts.source_traces(_edges(spark, sf), _starts(spark, sf), _nodes(spark, sf, "p_size % 7 = 0"), 3)
    return out.select("start", _shown("path").alias("path"), "exhausted")


@query(f"""WITH RECURSIVE {_EDGES}, l AS (SELECT * FROM e WHERE src % 3 <> 1), r AS (SELECT p_partkey AS s, p_partkey AS n, [p_partkey] AS p FROM part WHERE p_size % 2 = 1 UNION ALL SELECT s, l.dst, list_append(p, l.dst) FROM r JOIN l ON n = l.src WHERE len(p) <= 24 AND NOT list_contains(p, l.dst)),
h AS (SELECT s, p, row_number() OVER (PARTITION BY s ORDER BY len(p), p) AS i FROM r WHERE n IN (SELECT p_partkey FROM part WHERE p_size % 5 = 0)) SELECT s AS start, list_aggregate(p, 'string_agg', '>') AS path FROM h WHERE i <= 20""")
def flow_paths(spark, sf):
    """The first 20 paths of a method, as a report shows them; the limit is the feature."""
    e = _edges(spark, sf).withColumn("passes", _c("src") % 3 != 1)
    out = facts.flow_paths(e, _starts(spark, sf), _nodes(spark, sf, "p_size % 5 = 0"), _nodes(spark, sf, "p_size % 2 = 1"), 24, 20)
    return out.select("start", _shown("path").alias("path"))


@query(f"""WITH RECURSIVE {_EDGES}, l AS (SELECT * FROM e UNION SELECT 6, 12), r AS (SELECT p_partkey AS s, p_partkey AS n, [p_partkey] AS p FROM part UNION ALL SELECT s, l.dst, list_append(p, l.dst) FROM r JOIN l ON n = l.src WHERE len(p) <= 8 AND NOT list_contains(p, l.dst) AND n % 11 <> 3),
h AS (SELECT s, p, row_number() OVER (PARTITION BY s ORDER BY len(p) DESC, p) AS i FROM r WHERE n % 11 = 3) SELECT s AS start, list_aggregate(p, 'string_agg', '>') AS path FROM h WHERE i = 1""")
def forward_trace(spark, sf):
    """The longest way to a first sink; one more call, 6 to 12, closes a cycle that some of them pass."""
    e = _edges(spark, sf).union(spark.range(1).select(_c("id") + 6, _c("id") + 12))
    out = graph.forward_trace(e, _starts(spark, sf), e.select(_c("dst").alias("node")).union(e.select("src")).where("node % 11 = 3"), 8)
    return out.select("start", _shown("path").alias("path"))


@query(f"""WITH RECURSIVE {_EDGES}, r AS (SELECT p_partkey AS s, p_partkey AS node, e.src AS caller, 1 AS l, e.src = p_partkey AS cy, [p_partkey, e.src] AS p FROM part JOIN e ON e.dst = p_partkey UNION ALL SELECT s, e.dst, e.src, l + 1, list_contains(p, e.src), list_append(p, e.src) FROM r JOIN e ON e.dst = caller WHERE l < 3 AND NOT cy)
SELECT s AS start, node, caller, l AS level, cy AS cycle, list_aggregate(p, 'string_agg', '>') AS path FROM r""")
def caller_tree(spark, sf):
    return graph.caller_tree(_edges(spark, sf), _starts(spark, sf), 3).withColumn("path", _shown("path"))


#: Rings of ten parts, some with gaps, and calls between rings.
_RINGS = "e AS (SELECT p_partkey AS src, CASE WHEN p_partkey % 10 < 9 THEN p_partkey + 1 ELSE p_partkey - 9 END AS dst FROM part WHERE p_size % 9 <> 0 UNION SELECT p_partkey, p_partkey // 2 FROM part WHERE p_size % 3 = 0 UNION SELECT p_partkey // 10 * 10, p_partkey FROM part WHERE p_size % 4 = 0)"


def _rings(spark, sf):
    p, k = table(spark, sf, "part"), _c("p_partkey")
    ring = p.where("p_size % 9 <> 0").select(k.alias("src"), F.when(k % 10 < 9, k + 1).otherwise(k - 9).alias("dst"))
    return ring.union(p.where("p_size % 3 = 0").select(k, F.floor(k / 2))).union(p.where("p_size % 4 = 0").select(F.floor(k / 10) * 10, k)).distinct()


@query(f"""WITH RECURSIVE {_RINGS}, v AS (SELECT src AS n FROM e UNION SELECT dst FROM e), r AS (SELECT n AS s, n FROM v UNION SELECT s, dst FROM r JOIN e ON n = src) SELECT a.s AS node, min(a.n) AS component FROM r a JOIN r b ON a.s = b.n AND a.n = b.s GROUP BY a.s""")
def strong_components(spark, sf):
    return graph.strong_components(_rings(spark, sf))


@query(f"""WITH RECURSIVE {_RINGS}, r AS (SELECT dst AS n, 0 AS d FROM e WHERE dst % 50 = 0 UNION SELECT e.dst, d + 1 FROM r JOIN e ON n = src WHERE d < 12) SELECT n AS node, min(d) AS depth FROM r GROUP BY n""")
def least_distances(spark, sf):
    e = _rings(spark, sf)
    return graph.distances(e, e.where("dst % 50 = 0").select(_c("dst").alias("node")), 12)


# ---- all taint rules together ----

#: Fields F, methods C.m and their parameters stand for parts; facts flow from a part to its half or third.
_TREE = """p AS (SELECT p_partkey AS k, p_partkey // 2 AS h, p_partkey // 3 AS t, p_size AS z, 'F' || p_partkey AS f, 'C.m' || p_partkey || '()' AS m, 'F' || p_partkey // 2 AS fh, 'F' || p_partkey // 3 AS ft, 'C.m' || p_partkey // 2 || '()' AS mh, 'C.m' || p_partkey // 3 || '()' AS mt FROM part)"""


def _tree(spark, sf):
    k = _c("p_partkey")
    name = lambda a, n, z="": F.concat(F.lit(a), F.floor(k / n).cast("string"), F.lit(z))
    p = table(spark, sf, "part").select(k.alias("k"), _c("p_size").alias("z"), name("F", 1).alias("f"), name("F", 2).alias("fh"), name("F", 3).alias("ft"), name("C.m", 1, "()").alias("m"), name("C.m", 2, "()").alias("mh"), name("C.m", 3, "()").alias("mt"), name("m", 1).alias("nm"), name("m", 2).alias("nh"))
    one, call = F.lit("x"), F.lit("C")
    return p, {
        "param_to_field": p.where("z % 5 = 0").select(_c("m").alias("method_key"), one.alias("param_name"), _c("ft").alias("field_key")),
        "param_to_return": p.where("z % 4 = 0").select(_c("m").alias("method_key"), one.alias("param_name")),
        "call_return_to_local": p.where("z % 3 = 0").select(_c("m").alias("callee_key"), _c("mh").alias("caller_key"), F.lit("v").alias("local")),
        "local_sources": p.where("z % 13 = 0").select(_c("m").alias("method_key"), F.lit("v").alias("local"), F.lit("s0").alias("source")),
        "local_returned": p.where("z % 2 = 0").select(_c("m").alias("method_key"), F.lit("v").alias("local")),
        "local_to_field": p.where("z % 7 = 0").select(_c("m").alias("method_key"), F.lit("v").alias("local"), _c("f").alias("field_key")),
        "call_site_field": p.where("z % 6 = 1").select(F.when(_c("k") % 2 == 0, _c("m")).otherwise("").alias("callee_key"), call.alias("callee_class"), _c("nm").alias("callee_method"), F.lit(1).alias("arg_count"), _c("mh").alias("caller_key"), _c("k").alias("line"), _c("fh").alias("field_key")),
        "field_assignments": p.where("z % 3 = 1").select(_c("fh").alias("field_key"), _c("mh").alias("method_key"), _c("k").alias("line")),
        "field_edges": p.where("z % 9 = 0").select(_c("f").alias("src_field"), _c("fh").alias("dst_field")),
        "return_fields": p.where("z % 8 = 3").select(_c("f").alias("field_key"), _c("mh").alias("method_key")),
        "return_sources": p.where("z % 11 = 0").select(_c("m").alias("method_key"), F.lit("s1").alias("source")),
        "param_to_call_param": p.where("z % 2 = 1").select(_c("m").alias("method_key"), one.alias("param_name"), call.alias("callee_class"), _c("nh").alias("callee_method"), F.lit(0).alias("arg_index")),
        "method_params": p.select(_c("m").alias("method_key"), one.alias("param_name"), F.lit(0).alias("ord")),
        "field_read_params": p.where("z % 6 = 5").select(_c("f").alias("field_key"), _c("mt").alias("method_key"), one.alias("param_name")),
        "field_types": p.where("z % 4 = 3").select(_c("f").alias("field_key"), F.lit("List<A>").alias("type")),
    }


def _seed(p):
    fact = lambda df, kind, key, param, source: df.select(F.lit(kind).alias("location_type"), _c(key).alias("location_key"), F.lit(param).alias("param_name"), F.lit("USER_INPUT").alias("source_type"), F.lit(source).alias("source_method"), F.lit("").alias("source_field"), F.array(F.lit("seed")).alias("path"))
    return fact(p.where("z % 10 = 1"), "field", "f", "", "s0").unionByName(fact(p.where("z % 10 = 2"), "method_param", "m", "x", "s1"))


_NINE = f"""WITH RECURSIVE {_TREE}, e AS (
SELECT 1 AS rule, 'method_param' AS lt, m AS lk, 'x' AS pn, 'field' AS lt2, ft AS lk2, '' AS pn2 FROM p WHERE z % 5 = 0
UNION ALL SELECT 2, 'method_param', m, 'x', 'method_return', m, '' FROM p WHERE z % 4 = 0
UNION ALL SELECT 3, 'method_return', a.m, '', 'method_return', a.mh, '' FROM p a JOIN p b ON b.k = a.h WHERE a.z % 3 = 0 AND b.z % 2 = 0
UNION ALL SELECT 4, 'method_return', a.m, '', 'field', b.f, '' FROM p a JOIN p b ON b.k = a.h WHERE a.z % 3 = 0 AND b.z % 7 = 0
UNION ALL SELECT 5, 'method_return', m, '', 'field', fh, '' FROM p WHERE z % 6 = 1
UNION ALL SELECT 6, 'field', f, '', 'field', fh, '' FROM p WHERE z % 9 = 0
UNION ALL SELECT 7, 'field', f, '', 'method_return', mh, '' FROM p WHERE z % 8 = 3
UNION ALL SELECT 8, 'method_param', m, 'x', 'method_param', mh, 'x' FROM p WHERE z % 2 = 1 AND h IN (SELECT k FROM p)
UNION ALL SELECT 9, 'field', f, '', 'method_param', mt, 'x' FROM p WHERE z % 6 = 5
UNION ALL SELECT 10, 'field', f, '', 'method_return', mh, '' FROM p WHERE z % 8 = 3 AND z % 4 = 3),
r AS (SELECT 'field' AS lt, f AS lk, '' AS pn, 'USER_INPUT' AS st, 's0' AS sm, '' AS sf FROM p WHERE z % 10 = 1 UNION ALL SELECT 'method_param', m, 'x', 'USER_INPUT', 's1', '' FROM p WHERE z % 10 = 2
UNION SELECT lt2, lk2, pn2, CASE WHEN rule IN (4, 5, 6) THEN 'FIELD_PROPAGATION' ELSE st END, sm, CASE WHEN rule IN (4, 5) THEN 'return:' || r.lk WHEN rule IN (6, 7, 9, 10) THEN r.lk WHEN rule = 8 THEN sf ELSE '' END
FROM r JOIN e USING (lt, lk, pn) WHERE NOT (rule IN (3, 4) AND sm = 's0' AND EXISTS (SELECT 1 FROM p WHERE z % 13 = 0 AND m = CASE WHEN rule = 3 THEN lk2 ELSE 'C.m' || substr(lk2, 2) || '()' END))
AND NOT (rule = 7 AND sm = 's1' AND EXISTS (SELECT 1 FROM p WHERE z % 11 = 0 AND m = lk2)))
SELECT lt AS location_type, lk AS location_key, pn AS param_name, st AS source_type, sm AS source_method, sf AS source_field FROM r"""


@query(_NINE)
def taint_fixpoint(spark, sf):
    """All nine rules to their fixpoint."""
    p, tables = _tree(spark, sf)
    return taint.propagate(_seed(p), taint.Store(tables)).drop("path")


@query(_NINE)
def taint_extended(spark, sf):
    """The same facts in two steps: first without the seeds and edges of odd parts, then with them."""
    p, tables = _tree(spark, sf)
    late = ("param_to_field", "field_edges", "param_to_call_param", "return_fields", "call_return_to_local")
    of = lambda n, odd: _tree_rows(p, tables[n], odd)
    first = taint.Store({n: of(n, 0) if n in late else df for n, df in tables.items()})
    seed = _seed(p.where("k % 2 = 0"))
    facts_ = taint.propagate(seed, first)
    return taint.extended(facts_, seed, first, {n: of(n, 1) for n in late}, _seed(p.where("k % 2 = 1")))[0].drop("path")


def _tree_rows(p, rows, odd):
    """The rows of a table whose first column names an odd or even part."""
    return rows.where(F.regexp_extract(_c(rows.columns[0]), r"(\d+)", 1).cast("long") % 2 == odd)


# ---- stores ----


@query("""WITH o AS (SELECT CAST(o_custkey AS VARCHAR) AS k, o_orderstatus AS v, o_orderkey % 11 AS c, o_orderkey AS q, o_orderstatus = 'F' AS old FROM orders), a AS (SELECT k, arg_max(v, q) AS v, arg_max(c, q) AS c, max(q) AS q FROM o WHERE old GROUP BY k), b AS (SELECT k, arg_max(v, q) AS v, arg_max(c, q) AS c, max(q) AS q FROM o WHERE NOT old GROUP BY k)
SELECT 1 AS version, k AS bughash, v AS verdict, CAST(c AS INTEGER) AS confidence, q AS seq FROM a UNION ALL SELECT 2, * FROM b UNION ALL SELECT 2, * FROM a WHERE k NOT IN (SELECT k FROM b)""")
def verdict_versions(spark, sf):
    """Finished orders are put into a verdict store, then all others; both versions are read back."""
    o = table(spark, sf, "orders").select(_c("o_custkey").cast("string").alias("bughash"), _c("o_orderstatus").alias("verdict"), (_c("o_orderkey") % 11).cast("int").alias("confidence"), _c("o_orderkey").alias("seq"))
    root = f"{graph.shared_dir(spark)}/verdicts-{uuid.uuid4().hex}"
    for old in (True, False):
        stores.put_verdicts(spark, root, o.where((_c("verdict") == "F") == old).groupBy("bughash").agg(*[F.max_by(c, "seq").alias(c) for c in ("verdict", "confidence")], F.max("seq").alias("seq")))
    of = lambda n: versions.read(spark, root, stores.VERDICTS, n).withColumn("version", F.lit(n))
    return of(1).unionByName(of(2))


@query("""WITH RECURSIVE n AS (SELECT p_partkey % 50 AS grp, p_partkey AS k, CASE WHEN p_partkey % 97 = 0 THEN p_partkey + 50 ELSE p_partkey - 50 * (1 + p_size % 3) END AS up FROM part),
r AS (SELECT grp, k, [k] AS p FROM n WHERE up NOT IN (SELECT k FROM n) UNION ALL SELECT n.grp, n.k, list_append(p, n.k) FROM r JOIN n ON n.up = r.k)
SELECT n.grp, n.k AS node, row_number() OVER (PARTITION BY n.grp ORDER BY p IS NULL, p, n.k) AS rank FROM n LEFT JOIN r ON n.k = r.k""")
def walk_order(spark, sf):
    """Parts of a group under earlier parts; some stand under later ones and close cycles."""
    k = _c("p_partkey")
    up = F.when(k % 97 == 0, k + 50).otherwise(k - 50 * (1 + _c("p_size") % 3))
    nodes = table(spark, sf, "part").select((k % 50).alias("grp"), k.alias("ord"), k.cast("string").alias("node"), up.cast("string").alias("parent"))
    return graph.preorder(nodes, "grp").withColumn("node", _c("node").cast("long"))
