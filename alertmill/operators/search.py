"""Search: trigram postings, bounded grep, definitions, strategies by score, buried terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alertmill.functions import text as t


def trigrams(c: Column) -> Column:
    """Distinct three-character pieces of the lower-case text."""
    low = F.lower(t.text(c))
    return F.when(F.length(low) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(low) - 2), lambda i: F.substring(low, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))


def postings(df: DataFrame, key: str, text: str) -> DataFrame:
    """(trigram, key)."""
    return df.select(F.explode(trigrams(F.col(text))).alias("trigram"), F.col(key).alias("key")).distinct()


def trigram_search(index: DataFrame, pattern: str, most: int) -> DataFrame:
    """(key) of texts that hold all trigrams of the pattern, in order, at most ``most``; a shorter pattern matches inside trigrams. Whether the whole pattern occurs is not asked."""
    low = pattern.lower()
    if len(low) < 3:
        hits = index.where(F.contains("trigram", F.lit(low))).select("key").distinct()
    else:
        want = sorted({low[i : i + 3] for i in range(len(low) - 2)})
        hits = index.where(F.col("trigram").isin(*want)).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") == len(want)).select("key")
    return hits.orderBy("key").limit(most)


def grep(lines: DataFrame, pattern: str, most: int = 30, files: int | None = 2000) -> tuple[DataFrame, DataFrame]:
    """The first ``most`` matching lines by (file, line) of the first ``files`` files, and one row (truncated) that says whether there were more."""
    if files is not None:
        first = lines.select("file").distinct().orderBy("file").limit(files)
        lines = lines.join(first, "file", "left_semi")
    hits = lines.where(F.rlike("text", F.lit(pattern))).orderBy("file", "line").limit(most + 1)
    return hits.limit(most), hits.agg((F.count("*") > most).alias("truncated"))


def definitions(methods: DataFrame, name: str, most: int = 10) -> DataFrame:
    return methods.where(t.method_of(F.col("method_key")) == name).orderBy("method_key").limit(most)


def strategies(slices: DataFrame, table: DataFrame, most: int = 3) -> DataFrame:
    """(id, name, score, rank): the strategies of a slice, those always on first, then by score, at most ``most`` with all that are always on.

    ``slices`` (id, body, paths, vulnerability_type, authz_none), ``table`` (pos, name, always_on, kind, pattern), one row a signal, small and broadcast.
    A path counts its pattern's length, a file name too, a keyword 1, the type 10, missing authorisation 5.
    """
    k, p = F.col("kind"), t.text(F.col("pattern"))
    base = F.transform(F.split("paths", "\n"), lambda x: F.substring_index(x, "/", -1))
    points = (
        F.when((k == "paths") & (p != "") & F.contains("paths", p), F.length(p))
        .when((k == "includes") & (p != "") & F.array_contains(base, p), F.length(p))
        .when((k == "function_keywords") & (p != "") & F.rlike("body", p), 1)
        .when((k == "cwes") & (p != "") & (F.lower(p) == F.lower(t.text(F.col("vulnerability_type")))), 10)
        .when((k == "authz_none") & F.coalesce("authz_none", F.lit(False)), 5)
        .otherwise(0)
    )
    scored = slices.join(F.broadcast(table), F.lit(True)).withColumn("points", points).groupBy("id", "pos", "name", "always_on").agg(F.sum("points").cast("long").alias("score")).where("always_on or score > 0")
    order = Window.partitionBy("id").orderBy(F.desc("always_on"), F.desc(F.when(F.col("always_on"), 0).otherwise(F.col("score"))), "pos")
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).where((F.col("rank") <= most) | F.col("always_on")).select("id", "name", F.when(F.col("always_on"), 0).otherwise(F.col("score")).cast("long").alias("score"), "rank")


def buried_types(reasoning: Column, actual: Column, synonyms: dict[str, list[str]]) -> Column:
    """Types whose synonyms stand in a text, white space aside, less the actual ones; in the table's order."""
    flat = F.regexp_replace(F.lower(t.text(reasoning)), r"\s+", "")
    found = []
    for kind, names in synonyms.items():
        hit = F.lit(False)
        for n in names:
            hit = hit | F.contains(flat, F.lit("".join(n.lower().split())))
        found.append(F.when(hit, F.lit(kind)))
    return F.array_except(F.array_compact(F.array(*found)), F.coalesce(actual, F.array().cast("array<string>")))


def mismatched(actual: Column, loaded: Column) -> Column:
    """Actual types that were not among the loaded ones, each once, in order."""
    return F.array_except(F.array_distinct(actual), loaded)


def loaded_types(declared: Column, matched: Column, adjacent: Column) -> Column:
    return F.array_distinct(F.concat(F.array(declared), F.coalesce(matched, F.array().cast("array<string>")), F.coalesce(adjacent, F.array().cast("array<string>"))))


def frontier(referenced: DataFrame, included: DataFrame, key: str = "name") -> DataFrame:
    """What is referenced and not included yet."""
    return referenced.select(key).distinct().join(included.select(key).distinct(), key, "left_anti")


def capped(candidates: DataFrame, key: str, order: str, most: int = 5) -> DataFrame:
    """The first candidates of each key with how many were left out."""
    from alertmill.operators.graph import top_per_group

    return top_per_group(candidates, [key], [F.asc(order)], most).withColumnRenamed("truncated", "omitted")
