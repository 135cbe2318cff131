"""Taint propagation as Datalog over fact tables: seeds, nine rules, a semi-naive fixpoint, and the facts' way back into the store.

A fact is (location_type, location_key, param_name, source_type, source_method, source_field); the six columns are its
identity. A rule maps new facts to facts; ``path`` carries the steps. Strings that are absent are empty, never null.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alertmill.functions import text as t
from alertmill.operators.graph import Deltas, cut, meet, tasks_for
from alertmill.schemas import FACT_KEY

KEY = list(FACT_KEY)
FIELD, PARAM, RETURN = "field", "method_param", "method_return"
USER_INPUT, FIELD_PROPAGATION = "USER_INPUT", "FIELD_PROPAGATION"
# fixed values: collection types, and accessors that are no element reads
COLLECTIONS = ("List", "ArrayList", "LinkedList", "Set", "HashSet", "TreeSet", "Map", "HashMap", "TreeMap", "Collection")
ACCESSORS = ("size", "isEmpty", "contains", "containsKey", "containsValue", "indexOf", "clear")

Rule = Callable[[DataFrame, "Store"], DataFrame]


@dataclass
class Store:
    """The fact tables that rules join with; any of them may be empty.

    param_to_field (method_key, param_name, field_key); param_to_return (method_key, param_name); call_return_to_local
    (callee_key, caller_key, local); local_sources (method_key, local, source); local_returned (method_key, local);
    local_to_field (method_key, local, field_key); call_site_field (callee_key, callee_class, callee_method, arg_count,
    caller_key, line, field_key), the callee key empty where it is unknown; field_assignments (field_key, method_key, line);
    field_edges (src_field, dst_field); return_fields (field_key, method_key); return_sources (method_key, source);
    param_to_call_param (method_key, param_name, callee_class, callee_method, arg_index); method_params (method_key,
    param_name, ord); field_read_params (field_key, method_key, param_name); field_types (field_key, type).
    """

    tables: dict[str, DataFrame]
    #: tasks over which rules deal what they join; without it as many as a shuffle has
    tasks: int | None = None
    #: whether each row of the tables is known to come once
    single: bool = False

    def __getattr__(self, name: str) -> DataFrame:
        try:
            return self.tables[name]
        except KeyError:
            raise AttributeError(name) from None

    def kept(self) -> Store:
        """The tables, each row once, computed once for all rounds."""
        return Store({name: cut(df.distinct()) for name, df in self.tables.items()}, single=True)

    def dealt(self, tasks: int) -> Store:
        """The same tables for rules that deal what they join over so many tasks."""
        return replace(self, tasks=tasks)

    def meet(self, rows: DataFrame, other: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
        """A join of a rule: facts and tables grow alike, so neither is broadcast, and rows of ``other`` count once."""
        if how == "inner" and not self.single:
            keys = [on] if isinstance(on, str) else on
            other = (other.repartition(self.tasks, *keys) if self.tasks else other).distinct()
            return (rows.repartition(self.tasks, *keys) if self.tasks else rows).join(other.hint("merge"), keys)
        return meet(rows, other, on, how, self.tasks)


def _fact(kind, key, param, source_type, method, field, step):
    return [F.lit(kind).alias("location_type"), key.alias("location_key"), param.alias("param_name"), source_type.alias("source_type"), method.alias("source_method"), field.alias("source_field"), F.concat("path", F.array(step)).alias("path")]


def _of(facts: DataFrame, kind: str) -> DataFrame:
    return facts.where(F.col("location_type") == kind)


_c = F.col


def _none():
    return F.lit("")


def param_to_field(facts: DataFrame, s: Store) -> DataFrame:
    j = s.meet(_of(facts, PARAM), s.param_to_field.withColumnRenamed("method_key", "location_key"), ["location_key", "param_name"])
    return j.select(*_fact(FIELD, _c("field_key"), _none(), _c("source_type"), _c("source_method"), _none(), F.concat("location_key", F.lit("."), "param_name", F.lit(" -> "), "field_key")))


def param_to_return(facts: DataFrame, s: Store) -> DataFrame:
    j = s.meet(_of(facts, PARAM), s.param_to_return.withColumnRenamed("method_key", "location_key"), ["location_key", "param_name"], "left_semi")
    return j.select(*_fact(RETURN, _c("location_key"), _none(), _c("source_type"), _c("source_method"), _none(), F.concat("location_key", F.lit("."), "param_name", F.lit(" -> return:"), "location_key")))


def return_to_caller(facts: DataFrame, s: Store) -> DataFrame:
    """To the local that takes the result, unless the seed store already names the source for it; on to what the caller returns and to fields.

    What follows a local is put beside the calls before facts meet them, so facts meet only calls that lead on.
    """
    place = ["caller_key", "local"]
    calls = s.call_return_to_local.select(_c("callee_key").alias("location_key"), *place)
    up = s.meet(calls, s.local_returned.select(_c("method_key").alias("caller_key"), "local"), place, "left_semi").withColumns({"field_key": F.lit(""), "field": F.lit(False)})
    on = up.unionByName(s.meet(calls, s.local_to_field.select(_c("method_key").alias("caller_key"), "local", "field_key"), place).withColumn("field", F.lit(True)))
    j = s.meet(_of(facts, RETURN), on, "location_key")
    old = s.local_sources.select(_c("method_key").alias("caller_key"), "local", _c("source").alias("source_method"))
    j = s.meet(j, old, [*place, "source_method"], "left_anti")
    field = _c("field")
    step = F.concat(F.lit("return:"), "location_key", F.lit(" -> "), "caller_key", F.lit("."), "local", F.when(field, F.concat(F.lit(" -> "), "field_key")).otherwise(""))
    kind, key = F.when(field, FIELD).otherwise(RETURN), F.when(field, _c("field_key")).otherwise(_c("caller_key"))
    fact = _fact(FIELD, key, _none(), F.when(field, FIELD_PROPAGATION).otherwise(_c("source_type")), _c("source_method"), F.when(field, F.concat(F.lit("return:"), "location_key")).otherwise(""), step)
    return j.select(kind.alias("location_type"), *fact[1:])


def return_to_field_at_call(facts: DataFrame, s: Store) -> DataFrame:
    """To fields assigned at the call, by exact callee, or by name and arity where the callee is unknown."""
    sites = s.meet(s.call_site_field, s.field_assignments.select("field_key", _c("method_key").alias("caller_key"), "line"), ["field_key", "caller_key", "line"], "left_semi")
    exact = s.meet(_of(facts, RETURN), sites.where("callee_key <> ''").select(_c("callee_key").alias("location_key"), "field_key").distinct(), "location_key")
    params = s.method_params.select(_c("method_key").alias("location_key"))
    arity = (params.repartition(s.tasks, "location_key") if s.tasks else params).groupBy("location_key").agg(F.count("*").cast("int").alias("n"))
    named = (_of(facts, RETURN).repartition(s.tasks, "location_key") if s.tasks else _of(facts, RETURN)).join(arity.hint("merge"), "location_key", "left")
    named = named.withColumn("n", F.coalesce("n", F.lit(0))).withColumn("pattern", t.pattern_of(_c("location_key")))
    loose = sites.where("callee_key = ''").select(F.concat_ws(".", "callee_class", "callee_method").alias("pattern"), _c("arg_count").alias("n"), "field_key").distinct()
    both = exact.select(*facts.columns, "field_key").unionByName(s.meet(named, loose, ["pattern", "n"]).select(*facts.columns, "field_key"))
    return both.select(*_fact(FIELD, _c("field_key"), _none(), F.lit(FIELD_PROPAGATION), _c("source_method"), F.concat(F.lit("return:"), "location_key"), F.concat(F.lit("return:"), "location_key", F.lit(" -> "), "field_key")))


def field_to_field(facts: DataFrame, s: Store) -> DataFrame:
    j = s.meet(_of(facts, FIELD), s.field_edges.select(_c("src_field").alias("location_key"), "dst_field"), "location_key")
    return j.select(*_fact(FIELD, _c("dst_field"), _none(), F.lit(FIELD_PROPAGATION), _c("source_method"), _c("location_key"), F.concat("location_key", F.lit(" -> "), "dst_field")))


def field_to_return(facts: DataFrame, s: Store) -> DataFrame:
    """To methods that return the field, unless the seed store already names the source for them."""
    j = s.meet(_of(facts, FIELD), s.return_fields.withColumnRenamed("field_key", "location_key"), "location_key")
    j = s.meet(j, s.return_sources.withColumnRenamed("source", "source_method"), ["method_key", "source_method"], "left_anti")
    return j.select(*_fact(RETURN, _c("method_key"), _none(), _c("source_type"), _c("source_method"), _c("location_key"), F.concat("location_key", F.lit(" -> return:"), "method_key")))


def param_to_param(facts: DataFrame, s: Store) -> DataFrame:
    """Over calls, to the parameter at the argument's place of every overload."""
    flows = s.param_to_call_param.select(_c("method_key").alias("location_key"), "param_name", F.concat_ws(".", "callee_class", "callee_method").alias("pattern"), "arg_index")
    params = s.method_params.select(t.pattern_of(_c("method_key")).alias("pattern"), _c("ord").alias("arg_index"), _c("method_key").alias("callee_key"), _c("param_name").alias("callee_param"))
    j = s.meet(s.meet(_of(facts, PARAM), flows, ["location_key", "param_name"]), params, ["pattern", "arg_index"])
    return j.select(*_fact(PARAM, _c("callee_key"), _c("callee_param"), _c("source_type"), _c("source_method"), _c("source_field"), F.concat("location_key", F.lit("."), "param_name", F.lit(" -> "), "callee_key", F.lit("."), "callee_param")))


def field_to_param(facts: DataFrame, s: Store) -> DataFrame:
    j = s.meet(_of(facts, FIELD), s.field_read_params.select(_c("field_key").alias("location_key"), "method_key", _c("param_name").alias("read")), "location_key")
    return j.select(*_fact(PARAM, _c("method_key"), _c("read"), _c("source_type"), _c("source_method"), _c("location_key"), F.concat("location_key", F.lit(" -> "), "method_key", F.lit("."), "read")))


def collection_element(facts: DataFrame, s: Store) -> DataFrame:
    """From a field that is a collection to the methods that hand out its elements."""
    kinds = s.field_types.where(F.trim(F.regexp_extract("type", r"^([^<]*)", 1)).isin(*COLLECTIONS)).select(_c("field_key").alias("location_key"))
    handed = s.return_fields.withColumnRenamed("field_key", "location_key").where(~t.method_of(_c("method_key")).isin(*ACCESSORS))
    j = s.meet(s.meet(_of(facts, FIELD), kinds, "location_key", "left_semi"), handed, "location_key")
    return j.select(*_fact(RETURN, _c("method_key"), _none(), _c("source_type"), _c("source_method"), _c("location_key"), F.concat("location_key", F.lit("[element] -> return:"), "method_key")))


#: The rules by name; one more rule is one more entry.
RULES: dict[str, Rule] = {
    "param_to_field": param_to_field,
    "param_to_return": param_to_return,
    "return_to_caller": return_to_caller,
    "return_to_field_at_call": return_to_field_at_call,
    "field_to_field": field_to_field,
    "field_to_return": field_to_return,
    "param_to_param": param_to_param,
    "field_to_param": field_to_param,
    "collection_element": collection_element,
}


#: The tables that each rule reads.
READS = {
    "param_to_field": ("param_to_field",), "param_to_return": ("param_to_return",), "return_to_caller": ("call_return_to_local", "local_sources", "local_returned", "local_to_field"),
    "return_to_field_at_call": ("call_site_field", "field_assignments", "method_params"), "field_to_field": ("field_edges",), "field_to_return": ("return_fields", "return_sources"),
    "param_to_param": ("param_to_call_param", "method_params"), "field_to_param": ("field_read_params",), "collection_element": ("field_types", "return_fields"),
}


def seeds(field_taints: DataFrame, param_taints: DataFrame, return_taints: DataFrame, argument_taints: DataFrame, method_params: DataFrame) -> DataFrame:
    """Facts from tainted fields, parameters, results and call arguments.

    A tainted argument (caller_key, callee_class, callee_method, arg_index, source) binds to the first overload, by key, with
    enough parameters, else to the first one.
    """
    f = field_taints.select(F.lit(FIELD).alias("location_type"), _c("field_key").alias("location_key"), _none().alias("param_name"), "source_type", "source_method", "source_field", F.array(F.concat(F.lit("AST_Seed:"), "field_key")).alias("path"))
    p = param_taints.select(F.lit(PARAM).alias("location_type"), _c("method_key").alias("location_key"), "param_name", F.lit(USER_INPUT).alias("source_type"), _c("source").alias("source_method"), _none().alias("source_field"), F.array(F.concat(F.lit("Param_Seed:"), "method_key", F.lit("."), "param_name", F.lit("<-"), "source")).alias("path"))
    r = return_taints.select(F.lit(RETURN).alias("location_type"), _c("method_key").alias("location_key"), _none().alias("param_name"), F.lit(USER_INPUT).alias("source_type"), _c("source").alias("source_method"), _none().alias("source_field"), F.array(F.concat(F.lit("Return_Seed:"), "method_key", F.lit("<-"), "source")).alias("path"))
    # the overload hangs on the name and the place alone: it is chosen once for each, not for each call
    calls = argument_taints.withColumn("pattern", F.concat_ws(".", "callee_class", "callee_method"))
    tasks = tasks_for(argument_taints, method_params)
    place = ["pattern", "arg_index"]
    sizes = method_params.repartition(tasks, "method_key").groupBy("method_key").agg(F.count("*").alias("n")).withColumn("pattern", t.pattern_of(_c("method_key")))
    asked = calls.select(*place).repartition(tasks, "pattern").distinct()
    w = Window.partitionBy(*place).orderBy(F.desc(_c("n") > _c("arg_index")), "method_key")
    chosen = asked.join(sizes.repartition(tasks, "pattern").hint("merge"), "pattern").withColumn("k", F.row_number().over(w)).where("k = 1")
    chosen = meet(chosen.select(*place, "method_key"), method_params.select("method_key", "param_name", _c("ord").alias("arg_index")), ["method_key", "arg_index"], "inner", tasks)
    bound = meet(calls, chosen, place, "inner", tasks)
    a = bound.select(F.lit(PARAM).alias("location_type"), _c("method_key").alias("location_key"), "param_name", F.lit(USER_INPUT).alias("source_type"), _c("source").alias("source_method"), _none().alias("source_field"), F.array(F.concat("caller_key", F.lit(" -> "), "method_key", F.lit("."), "param_name", F.lit(" (arg#"), _c("arg_index").cast("string"), F.lit(")"))).alias("path"))
    return once(f.unionByName(p).unionByName(r).unionByName(a), max(tasks, tasks_for(field_taints, param_taints, return_taints)))


def step(facts: DataFrame, store: Store, rule: Rule) -> DataFrame:
    """What one rule makes of the facts, each identity once; tasks are counted by the rows that it reads."""
    tasks = tasks_for(facts, *[store.tables[name] for name in READS[rule.__name__]])
    return once(rule(facts, store.dealt(tasks)), tasks)


def once(facts: DataFrame, tasks: int | None = None) -> DataFrame:
    """A row for each identity, with its shortest path, the first in order of equal ones; ``tasks`` deals them before they are grouped."""
    facts = facts.repartition(tasks, *KEY) if tasks else facts
    return facts.groupBy(*KEY).agg(F.min(F.struct(F.size("path").alias("n"), "path")).alias("p")).select(*KEY, _c("p.path").alias("path"))


def propagate(seed: DataFrame, store: Store, rules: dict[str, Rule] | None = None, max_rounds: int | None = None) -> DataFrame:
    """Semi-naive fixpoint: each round applies the rules to the facts that the last one found. ``max_rounds`` bounds it; without it the fixpoint is complete."""
    rules = RULES if rules is None else rules
    store, delta, rounds = store.kept(), cut(seed), 0
    facts, size = Deltas(delta), tasks_for(*store.tables.values())
    while max_rounds is None or rounds < max_rounds:
        rounds += 1
        delta = _new(facts, [rule(delta, store.dealt(size)) for rule in rules.values()], max(size, tasks_for(facts.all())))
        if delta.isEmpty():
            break
        facts.add(delta)
    return facts.all()


def _new(seen: Deltas, found: list[DataFrame], tasks: int) -> DataFrame:
    """The facts that no round has found, each once, as a table."""
    rows = once(reduce(DataFrame.unionByName, found), tasks)
    return cut(rows.join(seen.all().select(*KEY).repartition(tasks, *KEY).hint("merge"), KEY, "left_anti"))


#: Tables whose new rows may take facts back: sources that are named already, and the arities of methods.
UNMAKING = ("local_sources", "return_sources", "method_params")


def extended(facts: DataFrame, seed: DataFrame, store: Store, more: dict[str, DataFrame], more_seed: DataFrame | None = None, rules: dict[str, Rule] | None = None) -> tuple[DataFrame, Store]:
    """The fixpoint after new rows of some tables and new seeds, from the ``facts`` of the fixpoint before, and the store with the new rows.

    A new row can only bring facts through the rules that read its table: those are applied once to all facts with the new rows alone in the
    table's place, and what they bring goes on as in ``propagate``. Facts that stay are not derived again; they keep the path they
    had. New rows of ``UNMAKING`` tables may end derivations, so they start over from the seeds.
    """
    rules = RULES if rules is None else rules
    grown = Store({n: df.unionByName(more[n]) if n in more else df for n, df in store.tables.items()} | {n: df for n, df in more.items() if n not in store.tables})
    whole = seed if more_seed is None else seed.unionByName(more_seed)
    if set(more) & set(UNMAKING):
        return propagate(whole, grown, rules), grown
    kept = grown.kept()
    known, new = cut(facts), [] if more_seed is None else [more_seed.select(*KEY, "path")]
    size = tasks_for(*kept.tables.values())
    kept, whole_size = kept.dealt(size), max(size, tasks_for(known))
    for name, rows in more.items():
        alone = Store({**kept.tables, name: cut(rows.distinct())}, whole_size, single=True)
        new += [rule(known, alone).select(*KEY, "path") for rule in rules.values() if name in READS[rule.__name__]]
    seen = Deltas(known)
    delta = _new(seen, new, whole_size) if new else known.limit(0)
    while not delta.isEmpty():
        seen.add(delta)
        delta = _new(seen, [rule(delta, kept) for rule in rules.values()], max(size, tasks_for(seen.all())))
    return seen.all(), grown


def derivations(facts: DataFrame, store: Store, rules: dict[str, Rule] | None = None) -> DataFrame:
    """Every path by which a known fact is derived in one step from the known facts, beside its own: the paths kept for each identity."""
    rules = RULES if rules is None else rules
    out = facts
    for rule in rules.values():
        out = out.unionByName(rule(facts, store))
    return meet(out, facts.select(*KEY), KEY, "left_semi").groupBy(*KEY).agg(F.array_sort(F.collect_set("path")).alias("paths"))


def sync(facts: DataFrame) -> dict[str, DataFrame]:
    """Facts as the taint tables of fields, parameters and results."""
    return {
        "fields": _of(facts, FIELD).select(_c("location_key").alias("field_key"), "source_type", "source_method", "source_field").distinct(),
        "params": _of(facts, PARAM).select(_c("location_key").alias("method_key"), "param_name", _c("source_method").alias("source")).distinct(),
        "returns": _of(facts, RETURN).select(_c("location_key").alias("method_key"), _c("source_method").alias("source")).distinct(),
    }
