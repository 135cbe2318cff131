"""Files of a source tree as facts: SQL mappers, configuration, Java declarations and calls.

Files are (path, content) rows, as ``binaryFile`` or ``wholetext`` reads give them; parsers run over Arrow batches, a file
at a time. The Java scan is lexical: braces, comments and strings are followed, expressions are not parsed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# fixed values: folders that hold no sources, and manifests of dependencies
IGNORED = ("node_modules", "target", "build", ".git")
MANIFESTS = ("pom.xml", "build.gradle", "package-lock.json", "requirements.txt", "go.mod")


def files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """(path, content) of the files below ``root`` whose name fits, ignored folders left out."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    inside = ~F.rlike("path", F.lit("/(" + "|".join(re.escape(x) for x in IGNORED) + ")/"))
    return raw.where(inside).select("path", F.decode("content", F.lit("UTF-8")).alias("content"))


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """Manifests of dependencies below ``root``."""
    return files(spark, root, "{" + ",".join(MANIFESTS) + "}")


def _scan(df: DataFrame, parse, schema: str) -> DataFrame:
    from pyspark.sql.types import _parse_datatype_string

    names = _parse_datatype_string(schema).names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [r for path, content in zip(pdf["path"], pdf["content"]) for r in parse(path, content or "")]
            yield pd.DataFrame(rows, columns=names)

    return df.select("path", "content").mapInPandas(run, schema)


MAPPER = "namespace string, short_class string, id string, sql_text string, file_path string, line int, has_concat boolean, has_param boolean"


def mapper_statements(path: str, text: str) -> list[tuple]:
    """Statements of a mapper file: every select, insert, update and delete with an id, up to its closing tag."""
    out = []
    opens = list(re.finditer(r"<mapper\b[^>]*\bnamespace\s*=\s*[\"']([^\"']+)[\"'][^>]*>", text))
    for m, nxt in zip(opens, [*opens[1:], None]):
        end = nxt.start() if nxt else len(text)
        for s in re.finditer(r"(?i)<(select|insert|update|delete)\b[^>]*\bid\s*=\s*[\"']([^\"']+)[\"'][^>]*>", text[m.end() : end]):
            at = m.end() + s.end()
            close = text.lower().find(f"</{s[1].lower()}>", at, end)
            if close < 0:
                continue
            sql = " ".join(re.sub(r"(?s)<!--.*?-->", " ", text[at:close]).replace("<![CDATA[", " ").replace("]]>", " ").split())
            out.append((m[1], m[1].rpartition(".")[2], s[2], sql, path, text.count("\n", 0, at) + 1, bool(re.search(r"\$\{\w+", sql)), bool(re.search(r"#\{\w+", sql))))
    return out


def mappers(df: DataFrame) -> DataFrame:
    return _scan(df, mapper_statements, MAPPER)


CONFIG = "profile string, key string, value string, ord int, path string"


def config_entries(path: str, text: str) -> list[tuple]:
    """Keys of a properties or YAML file with the profile in its name; a trailing backslash goes on, ``#`` starts a comment line."""
    name = path.rpartition("/")[2]
    m = re.match(r"application-([\w-]+)\.(?:properties|ya?ml)$", name)
    profile, out = m[1] if m else "", []
    if name.endswith(".properties"):
        key = None
        for raw in text.split("\n"):
            line = raw.strip()
            if not line or line.startswith("#"):
                continue
            if key is None:
                k, eq, val = line.partition("=")
                if not eq or not k:
                    continue
                key, value = k.strip(), ""
                line = val.strip()
            more = line.endswith("\\")
            value += line[:-1] if more else line
            if not more:
                out.append((profile, key, value.strip(), len(out), path))
                key = None
        return out
    stack: list[tuple[int, str]] = []
    for raw in text.split("\n"):
        m = re.match(r"^(\s*)([\w.\-]+)\s*:\s*(.*)$", raw)
        if not m or raw.lstrip().startswith("#"):
            continue
        depth = len(m[1])
        while stack and stack[-1][0] >= depth:
            stack.pop()
        stack.append((depth, m[2]))
        value = re.sub(r"\s+#.*$", "", m[3]).strip().strip("\"'")
        if value:
            out.append((profile, ".".join(k for _, k in stack), value, len(out), path))
    return out


def config(df: DataFrame) -> DataFrame:
    return _scan(df, config_entries, CONFIG)


def merged_config(entries: DataFrame, active: list[str], groups: dict[str, list[str]] | None = None) -> DataFrame:
    """(key, value): base keys first, then what active profiles and the profiles they include add; the first value of a key stays."""
    wanted, todo = [], list(active)
    while todo:
        p = todo.pop(0)
        if p not in wanted:
            wanted.append(p)
            todo += (groups or {}).get(p, [])
    order = F.when(F.col("profile") == "", F.lit(-1))
    for i, p in enumerate(wanted):
        order = order.when(F.col("profile") == p, F.lit(i))
    rows = entries.withColumn("_o", order).where("_o is not null")
    return rows.groupBy("key").agg(F.min_by("value", F.struct("_o", "path", "ord")).alias("value"))


def resolved_config(config_: DataFrame, max_depth: int = 10) -> DataFrame:
    """(key, value) with ``${key:default}`` replaced, ``max_depth`` levels deep; a key that leads back to itself stays as it is, and so does one without value or default."""
    from alertmill.operators.graph import cut

    out = config_.select("key", "value", F.array("key").alias("seen"))
    base = config_.select(F.col("key").alias("_k"), F.col("value").alias("_v"))
    hole = r"\$\{([^}:]+)(?::([^}]*))?\}"
    done = None
    for _ in range(max_depth):
        name, default = F.regexp_extract("value", hole, 1), F.regexp_extract("value", hole, 2)
        whole = F.regexp_extract("value", hole, 0)
        rows = out.withColumns({"_name": name, "_default": default, "_whole": whole})
        plain = rows.where("_whole = ''").select("key", "value")
        done = plain if done is None else done.unionByName(plain)
        left = rows.where("_whole <> ''").join(base, F.col("_name") == F.col("_k"), "left")
        again = F.array_contains("seen", F.col("_name"))
        new = F.when(F.col("_v").isNotNull() & ~again, F.col("_v")).when(~again & (F.col("_default") != ""), F.col("_default"))
        kept = F.replace("_whole", F.lit("${"), F.lit("\u0001{"))
        out = cut(left.select("key", F.replace("value", F.col("_whole"), F.coalesce(new, kept)).alias("value"), F.concat("seen", F.array("_name")).alias("seen")))
        if out.isEmpty():
            break
    done = done.unionByName(out.select("key", "value"))
    return done.withColumn("value", F.replace("value", F.lit("\u0001{"), F.lit("${")))


# ---- Java ----

JAVA = "tag string, class string, method_key string, name string, value string, line int, end_line int, file_path string, ord int, annotations array<string>"
_KEYWORDS = {"if", "for", "while", "switch", "catch", "return", "new", "throw", "synchronized", "super", "this", "else", "do", "try", "assert"}


def _masked(src: str) -> str:
    """The source with comments and what stands in quotes blanked, as long as before."""

    def blank(m: re.Match) -> str:
        x = re.sub(r"[^\n]", " ", m[0])
        return m[0][0] + x[1:-1] + m[0][-1] if m[0][0] in "\"'" else x

    return re.sub(r"(?s)/\*.*?\*/|//[^\n]*|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'", blank, src)


def _closing(s: str, at: int, a: str, z: str) -> int:
    depth = 0
    for i in range(at, len(s)):
        depth += (s[i] == a) - (s[i] == z)
        if depth == 0:
            return i
    return len(s) - 1


def _pieces(params: str) -> list[str]:
    out, depth, last = [], 0, 0
    for i, ch in enumerate(params):
        depth += (ch in "<([") - (ch in ">)]")
        if ch == "," and depth == 0:
            out.append(params[last:i])
            last = i + 1
    return [p.strip() for p in [*out, params[last:]] if p.strip()]


def java_facts(path: str, text: str) -> list[tuple]:
    """Tagged facts of a Java file: class, extends, implements, field, method, param, call (value: receiver), argument, return, assign."""
    s, out = _masked(text), []
    line = lambda i: s.count("\n", 0, i) + 1
    package = (re.search(r"\bpackage\s+([\w.]+)\s*;", s) or [None, ""])[1]
    add = lambda tag, cls, key, name, value, at, end=None, ord_=0, ann=(): out.append((tag, cls, key, name, value, line(at), line(at if end is None else end), path, ord_, list(ann)))
    for c in re.finditer(r"((?:@\w+(?:\([^)]*\))?\s*)*)(?:\b(?:public|protected|private|abstract|final|static|sealed)\s+)*\b(class|interface|enum)\s+(\w+)([^{;]*)\{", s):
        cls = f"{package}.{c[3]}" if package else c[3]
        end = _closing(s, c.end() - 1, "{", "}")
        add(c[2], cls, "", c[3], "", c.start(2), end, ann=re.findall(r"@(\w+)", c[1]))
        for tag, names in re.findall(r"\b(extends|implements)\s+([\w.<>, ]+?)(?=\bimplements\b|\bextends\b|$)", c[4].strip()):
            for n in _pieces(names):
                add("parent" if tag == "extends" and c[2] != "interface" else "iface", cls, "", re.sub(r"<.*", "", n).strip(), "", c.start(4))
        body, base = s[c.end() : end], c.end()
        at = 0
        for m in re.finditer(r"((?:@\w+(?:\([^)]*\))?\s*)*)((?:\b(?:public|protected|private|static|final|abstract|synchronized|native|default)\s+)*)(?:<[^>]+>\s+)?([\w.<>\[\], ?]+?)\s+(\w+)\s*\(", body):
            if m.start() < at or m[4] in _KEYWORDS or m[3].split()[-1] in _KEYWORDS or body.count("{", at, m.start()) != body.count("}", at, m.start()):
                continue
            close = _closing(body, m.end() - 1, "(", ")")
            stop = re.match(r"\s*(?:throws\s+[\w.,\s]+)?([{;])", body[close + 1 :])
            if not stop:
                continue
            params = _pieces(body[m.end() : close])
            types = [re.sub(r"@\w+(?:\([^)]*\))?\s*|\bfinal\s+", "", p).rpartition(" ")[0].strip() for p in params]
            key = f"{cls}.{m[4]}({','.join(types)})"
            ann = re.findall(r"@(\w+)", m[1])
            first = close + 1 + stop.start(1)
            last = _closing(body, first, "{", "}") if stop[1] == "{" else first
            add("method", cls, key, m[4], m[3], base + m.start(4), base + last, len(params), ann + (["native"] if "native" in m[2] else []))
            for i, p in enumerate(params):
                add("param", cls, key, p.rpartition(" ")[2], types[i], base + m.end(), ord_=i, ann=re.findall(r"@(\w+)", p))
            inner = body[first:last]
            for k in re.finditer(r"(?:([\w.]+)\.)?\b(\w+)\s*\(", inner):
                if k[2] in _KEYWORDS:
                    continue
                stop_at = _closing(inner, k.end() - 1, "(", ")")
                args = _pieces(inner[k.end() : stop_at])
                add("call", cls, key, k[2], k[1] or "", base + first + k.start(2), ord_=len(args))
                for i, a in enumerate(args):
                    add("argument", cls, key, k[2], a, base + first + k.start(2), ord_=i)
            for k in re.finditer(r"\breturn\s+([^;]+);", inner):
                add("return", cls, key, "", k[1].strip(), base + first + k.start())
            for k in re.finditer(r"(?:\bthis\s*\.\s*)?(\w+)\s*=(?!=)\s*([^;]+);", inner):
                add("assign", cls, key, k[1], k[2].strip(), base + first + k.start())
            for k in re.finditer(r"\bif\s*\(", inner):
                z = _closing(inner, k.end() - 1, "(", ")")
                block = re.match(r"\s*\{", inner[z + 1 :])
                add("if", cls, key, "", inner[k.end() : z].strip(), base + first + k.start(), base + first + (_closing(inner, z + block.end(), "{", "}") if block else z))
            at = last + 1
        for f in re.finditer(r"(?:^|[;{}])\s*((?:@\w+(?:\([^)]*\))?\s*)*)(?:(?:private|protected|public|static|final|transient|volatile)\s+)+([\w.<>\[\], ?]+?)\s+(\w+)\s*(?:=\s*([^;]+))?;", body):
            if body.count("{", 0, f.start(3)) == body.count("}", 0, f.start(3)):
                add("field", cls, "", f[3], f[2], base + f.start(3), ann=re.findall(r"@(\w+)", f[1]))
    return out


def java(df: DataFrame) -> DataFrame:
    """Tagged facts of Java files; ``fact_tables`` splits them."""
    return _scan(df, java_facts, JAVA)


def fact_tables(tagged: DataFrame) -> dict[str, DataFrame]:
    """The tagged rows as the fact tables that graph and taint operators read."""
    of = lambda *tags: tagged.where(F.col("tag").isin(*tags))
    classes = of("class", "interface", "enum").select("class", "name", F.col("annotations").alias("class_annotations")).distinct()
    short = classes.select(F.col("name").alias("short"), F.col("class").alias("full"))
    w = Window.partitionBy("short").orderBy("full")
    short = short.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")
    full = lambda df, c: df.join(F.broadcast(short), F.col(c) == F.col("short"), "left").withColumn(c, F.coalesce("full", F.col(c))).drop("short", "full")
    methods = of("method").join(classes.select("class", "class_annotations"), "class", "left").select("method_key", "class", F.col("name").alias("method"), "line", "end_line", "file_path", F.col("ord").alias("param_count"), "annotations", "class_annotations", F.array_contains("annotations", "native").alias("is_native"))
    fields = of("field").select("class", F.col("name").alias("receiver"), F.regexp_replace("value", "<.*", "").alias("type")).distinct()
    calls = of("call").select("class", F.col("method_key").alias("caller_key"), F.col("name").alias("callee_method"), F.col("value").alias("receiver"), "line", "file_path", F.col("ord").alias("arg_count"))
    calls = calls.join(fields, ["class", "receiver"], "left").withColumn("callee_class", F.when(F.col("receiver").isin("", "this"), F.col("class")).otherwise(F.coalesce("type", "receiver"))).drop("type", "class")
    keyed = lambda c: F.concat("class", F.lit("."), c)
    word = lambda col, name: F.rlike(col, F.concat(F.lit(r"\b"), name, F.lit(r"\b")))
    params = of("param").select("class", "method_key", F.col("name").alias("param_name"), F.col("value").alias("type"), "ord", "annotations")
    own = of("field").select("class", F.col("name").alias("field"))
    flows = of("assign").select("class", "method_key", F.col("name").alias("field"), F.col("value").alias("expr"), "line").join(own, ["class", "field"])
    returns = of("return").select("class", "method_key", F.col("value").alias("expr"))
    args = of("argument").select("class", "method_key", F.col("name").alias("callee_method"), F.col("value").alias("expr"), "line", F.col("ord").alias("arg_index"))
    passed = args.join(params.select("method_key", "param_name"), "method_key").where(word("expr", F.col("param_name"))).join(full(calls, "callee_class").select(F.col("caller_key").alias("method_key"), "callee_method", "line", "callee_class").distinct(), ["method_key", "callee_method", "line"])
    return {
        "methods": methods,
        "method_params": params.select("method_key", "param_name", "ord"),
        "class_parent": full(of("parent").select("class", F.col("name").alias("parent")), "parent"),
        "class_iface": full(of("iface").select("class", F.col("name").alias("iface")), "iface"),
        "call_edges": full(calls, "callee_class"),
        "field_types": of("field").select(keyed("name").alias("field_key"), F.col("value").alias("type")),
        "param_to_field": flows.join(params.select("method_key", "param_name"), "method_key").where(word("expr", F.col("param_name"))).select("method_key", "param_name", keyed("field").alias("field_key")),
        "param_to_return": returns.join(params.select("method_key", "param_name"), "method_key").where(word("expr", F.col("param_name"))).select("method_key", "param_name").distinct(),
        "return_fields": returns.join(own, "class").where(word("expr", F.col("field"))).select(keyed("field").alias("field_key"), "method_key").distinct(),
        "param_to_call_param": passed.select("method_key", "param_name", "callee_class", "callee_method", "arg_index").distinct(),
        "branches": of("if").select("method_key", F.col("value").alias("condition"), F.col("line").alias("start"), F.col("end_line").alias("end")),
    }
