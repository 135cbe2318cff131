"""Text, path, hash and key expressions. Every function maps columns to a column and stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: fingerprint version and the digest lengths of its parts
FINGERPRINT_VERSION = 5
BODY_DIGITS, PATH_DIGITS = 16, 12


def text(c: Column) -> Column:
    """The value as a string, null as the empty one."""
    return F.coalesce(c.cast("string"), F.lit(""))


def normalize_code(code: Column) -> Column:
    """Code without comments: block comments become a space, then line comments vanish, then whitespace folds.

    A ``//`` inside a string literal starts a comment too; the order of the steps is part of the fingerprint.
    """
    x = F.regexp_replace(code, r"(?s)/\*.*?\*/", " ")
    x = F.regexp_replace(x, r"//[^\n]*", "")
    return F.trim(F.regexp_replace(x, r"[\t\n\f\r ]+", " "))


def sha256(c: Column) -> Column:
    return F.sha2(text(c), 256)


def code_fingerprint(source_body: Column, sink_body: Column) -> Column:
    return F.substring(sha256(F.concat(normalize_code(text(source_body)), normalize_code(text(sink_body)))), 1, BODY_DIGITS)


def path_signature(path: Column) -> Column:
    """Digest of ``file:line`` of each hop, joined by ``|``; no hops give the empty string."""
    parts = F.transform(path, lambda h: F.concat(text(h["file"]), F.lit(":"), F.coalesce(h["line"], F.lit(0)).cast("string")))
    return F.when(path.isNull() | (F.size(path) == 0), F.lit("")).otherwise(F.substring(F.sha2(F.array_join(parts, "|"), 256), 1, PATH_DIGITS))


def alert_fingerprint(vuln_type: Column, cwe: Column, source: Column, sink: Column, path: Column, source_body: Column | None = None, sink_body: Column | None = None) -> Column:
    """The stable key of an alert: version, type, CWE, both ends, code bodies and path, joined by colons and hashed.

    An end is named by its function as it stands, or by ``file#line`` only where the function is empty.
    """
    empty = F.lit("")

    def end(e: Column) -> Column:
        return F.when(text(e["function"]) == "", F.concat(text(e["file"]), F.lit("#"), F.coalesce(e["line"], F.lit(0)).cast("string"))).otherwise(text(e["function"]))

    body = code_fingerprint(empty if source_body is None else source_body, empty if sink_body is None else sink_body)
    return sha256(F.concat_ws(":", F.lit(f"v{FINGERPRINT_VERSION}"), text(vuln_type), text(cwe), text(source["file"]), end(source), text(sink["file"]), end(sink), body, path_signature(path)))


def cache_key(*parts: Column) -> Column:
    """Digest of the parts joined by NUL."""
    joined: list[Column] = []
    for p in parts:
        joined += [text(p), F.lit("\u0000")]
    return sha256(F.concat(*joined[:-1]))


def model_family(model: Column) -> Column:
    """A model's name up to its first dash."""
    return F.split(model, "-")[0]


def slashes(path: Column) -> Column:
    """Forward slashes, none at the front."""
    return F.regexp_replace(F.replace(text(path), F.lit("\\"), F.lit("/")), "^/+", "")


def extension(path: Column) -> Column:
    """Lower-case extension of the last path segment, or the empty string."""
    return F.lower(F.regexp_extract(text(path), r"\.([^./\\]*)$", 1))


def basename(path: Column) -> Column:
    return F.regexp_extract(text(path), r"([^/\\]*)$", 1)


def without_line(path: Column) -> Column:
    """``a/B.java:12`` as ``a/B.java``."""
    return F.regexp_replace(text(path), r":\d+$", "")


def dashed(c: Column) -> Column:
    """Lower-case letters and digits, everything else folded to single dashes, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(text(c)), "[^a-z0-9]+", "-"), "^-|-$", "")


def slug(c: Column) -> Column:
    """As ``dashed`` with underscores; ``unknown`` where nothing is left."""
    x = F.regexp_replace(F.regexp_replace(F.lower(text(c)), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(x == "", F.lit("unknown")).otherwise(x)


def first_with_prefix(values: Column, prefix: str) -> Column:
    return F.coalesce(F.get(F.filter(values, lambda v: v.startswith(prefix)), F.lit(0)), F.lit(""))


def tokens(c: Column) -> Column:
    """Rough token count: a quarter of the characters, one at least."""
    return F.greatest(F.floor(F.length(text(c)) / 4), F.lit(1)).cast("long")


def sorted_unique(values: Column) -> Column:
    return F.array_sort(F.array_distinct(values))


def same_set(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def class_of(method_key: Column) -> Column:
    """``pkg.Class`` of ``pkg.Class.method(T,T)``."""
    return F.regexp_extract(F.substring_index(method_key, "(", 1), r"^(.*)\.[^.]*$", 1)


def method_of(method_key: Column) -> Column:
    return F.substring_index(F.substring_index(method_key, "(", 1), ".", -1)


def pattern_of(method_key: Column) -> Column:
    """``Class.method``, the overload-blind key."""
    return F.substring_index(method_key, "(", 1)


def param_count(method_key: Column) -> Column:
    """Number of parameter types, commas inside type arguments not counted (three levels deep)."""
    x = F.regexp_extract(method_key, r"\((.*)\)", 1)
    for _ in range(4):
        x = F.regexp_replace(x, "<[^<>]*>", "")
    return F.when(F.trim(x) == "", F.lit(0)).otherwise(F.size(F.split(x, ",")))


def whole_word(needle: Column, haystack: Column) -> Column:
    """Whether a non-empty identifier stands in a text as a word of its own."""
    return (text(needle) != "") & F.rlike(text(haystack), F.concat(F.lit(r"\b\Q"), text(needle), F.lit(r"\E\b")))


def keyword_hit(keyword: Column, callee: Column) -> Column:
    """Whether the last dotted part of a callee is a keyword, or starts with it and goes on with something else than an identifier's character."""
    last = F.substring_index(text(callee), ".", -1)
    rest = F.substr(last, F.length(text(keyword)) + 1)
    return (text(keyword) != "") & F.startswith(last, text(keyword)) & ~F.rlike(rest, F.lit("^[a-zA-Z0-9_]"))


def utc_stamp(ts: Column) -> Column:
    """The run stamp of an instant in UTC."""
    return F.date_format(ts, "yyyy-MM-dd'T'HHmmss")


def instant(stamp: Column) -> Column:
    """RFC 3339 or run stamps as timestamps; anything else is null."""
    return F.coalesce(F.try_to_timestamp(stamp), F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd'T'HHmmss")))
