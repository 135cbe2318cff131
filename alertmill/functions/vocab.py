"""Closed vocabularies and the expressions that map into them."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from alertmill.functions.text import extension, slug, text

# fixed values: severities, best first
SEVERITIES = ("critical", "high", "medium", "low", "info")
SEVERITY_RANK = {"critical": 4, "high": 3, "medium": 2, "low": 1, "info": 0}
# fixed values: severity of a rule level, and of a bug level
LEVEL_SEVERITY = {"error": "high", "warning": "medium", "note": "low", "recommendation": "low"}
BUG_LEVEL_SEVERITY = {"1": "low", "3": "medium", "5": "high"}
# fixed values: dispositions and the verdict each folds to
DISPOSITION_VERDICT = {
    "true_positive": "true_positive",
    "false_positive": "false_positive",
    "likely_tp": "uncertain",
    "likely_fp": "uncertain",
    "out_of_scope": "uncertain",
    "uncertain": "uncertain",
}
# fixed values: words that mean nothing was said
NULLISH = ("", "null", "none", "nil", "n/a", "na", "unknown", "无", "无。")
# fixed values: types that are never suppressed automatically
HIGH_RISK = ("command_injection", "insecure_deserialization", "ssrf")
# fixed values: memory-safety weaknesses, and the extensions of languages that can have them
MEMORY_SAFETY = (119, 120, 121, 122, 125, 126, 415, 416, 476, 787, 788, 824)
NATIVE = ("c", "cc", "cpp", "cxx", "h", "hpp", "m", "mm")
# fixed values: types of rules by name; the first name contained in a rule's last segment decides
RULE_TYPES = {
    "sql-injection": "sql_injection",
    "stored-sql-injection": "sql_injection",
    "sql-injection-local": "sql_injection",
    "path-injection": "path_traversal",
    "tainted-permissions-check": "path_traversal",
    "partial-path-traversal": "path_traversal",
    "partial-path-traversal-from-remote": "path_traversal",
    "command-line-injection": "command_injection",
    "os-command-injection": "command_injection",
    "ssrf": "ssrf",
    "request-forgery": "ssrf",
    "xss": "xss",
    "unsafe-deserialization": "insecure_deserialization",
    "insecure-deserialization": "insecure_deserialization",
    "xxe": "xxe",
    "xxe-local": "xxe",
    "groovy-injection": "code_injection",
    "jexl-expression-injection": "code_injection",
    "ognl-injection": "code_injection",
    "spel-expression-injection": "code_injection",
    "server-side-template-injection": "code_injection",
    "jndi-injection": "code_injection",
    "weak-cryptographic-algorithm": "weak_crypto",
    "potentially-weak-cryptographic-algorithm": "weak_crypto",
    "unvalidated-url-redirection": "open_redirect",
    "unvalidated-url-redirect": "open_redirect",
    "ldap-injection": "ldap_injection",
    "unrestricted-file-upload": "arbitrary_file_upload",
    "information-exposure-through-an-error-message": "error_message_exposure",
    "stack-trace-exposure": "error_message_exposure",
    "error-message-exposure": "error_message_exposure",
}
# fixed values: families of names for one weakness
FAMILIES = {
    "access_control": (
        "missing_authorization", "missing-authorization", "missing_authentication", "missing-authentication", "missing_auth", "missing-auth",
        "missing-authz", "missing_authz", "cwe-862", "cwe-862-missing-authorization", "cwe-863", "cwe-639", "broken_access_control",
        "broken-access-control", "improper_access_control", "improper-access-control", "broken_object_level_authorization",
        "broken-object-level-authorization", "idor", "id_or", "idr", "insecure-direct-object-reference", "insecure_direct_object_reference",
        "id_or_broken_access_control",
    ),
    "file_upload": ("arbitrary_file_upload", "arbitrary-file-upload", "unrestricted_file_upload", "unrestricted-file-upload"),
    "path_traversal": ("path_traversal", "path-traversal", "arbitrary-file-read", "arbitrary_file_read"),
    "stored_xss": ("stored_xss", "stored-xss", "stored_xss_via_upload", "stored-xss-via-upload"),
}


def lookup(table: dict, key: Column) -> Column:
    """The table's value, null for a key that it lacks."""
    pairs = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in table.items()))
    return F.try_element_at(pairs, key)


def severity_rank(c: Column, missing: int | None = None) -> Column:
    got = lookup(SEVERITY_RANK, F.lower(F.trim(text(c))))
    return got if missing is None else F.coalesce(got, F.lit(missing))


def severity_order(c: Column) -> Column:
    """Report order: 0 for critical, unknown last."""
    return F.coalesce(F.lit(4) - severity_rank(c), F.lit(5))


def dependency_severity(score: Column) -> Column:
    """Severity of a dependency's score: above 9 (not at 9) is critical; what is no number is low."""
    s = score.try_cast("double")
    return F.when(s > 9.0, "critical").when(s >= 7.0, "high").when(s >= 4.0, "medium").otherwise("low")


def rule_severity(score: Column, level: Column, default_level: Column) -> Column:
    """Severity of a rule: its score (9 is critical), else the result's level, else the rule's, else ``warning``.

    ``score`` is text; an empty one, or the number 0 unquoted (given as null), is absent.
    """
    s = F.when(text(score) != "", score).try_cast("double")
    by_level = F.coalesce(lookup(LEVEL_SEVERITY, F.when(text(level) != "", level).otherwise(F.coalesce(default_level, F.lit("warning")))), F.lit("medium"))
    return F.when(s >= 9.0, "critical").when(s >= 7.0, "high").when(s >= 4.0, "medium").when(s.isNotNull(), "low").otherwise(by_level)


def bug_severity(level: Column, rule_level: Column) -> Column:
    return F.coalesce(lookup(BUG_LEVEL_SEVERITY, level.cast("string")), lookup(BUG_LEVEL_SEVERITY, rule_level.cast("string")), F.lit("medium"))


def cwe_of_tags(tags: Column) -> Column:
    """The first CWE tag, or ``CWE-UNKNOWN``."""
    hits = F.filter(F.transform(tags, lambda t: F.regexp_extract(t, r"(?i)^external/cwe/cwe-(\d+)", 1)), lambda n: n != "")
    return F.coalesce(F.concat(F.lit("CWE-"), F.get(hits, F.lit(0))), F.lit("CWE-UNKNOWN"))


def cwe_in(*texts: Column) -> Column:
    """The first CWE number in any of the texts, or null."""
    found = [F.nullif(F.regexp_extract(text(t), r"(?i)cwe-?(\d+)", 1), F.lit("")) for t in texts]
    return F.concat(F.lit("CWE-"), F.coalesce(*found))


def rule_type(rule: Column) -> Column:
    """Type of a rule: exact name, else the first listed name that it contains, else its own name with underscores."""
    short = F.substring_index(rule, "/", -1)
    out = F.replace(short, F.lit("-"), F.lit("_"))
    for name, kind in reversed(RULE_TYPES.items()):
        out = F.when(F.contains(short, F.lit(name)), kind).otherwise(out)
    return F.coalesce(lookup(RULE_TYPES, short), out)


def verdict_of(disposition: Column) -> Column:
    return F.coalesce(lookup(DISPOSITION_VERDICT, disposition), F.lit("uncertain"))


def recovered_disposition(raw: Column) -> Column:
    """A known disposition quoted inside broken output, or the empty string."""
    got = F.regexp_extract(text(raw), r'"disposition":\s*"([^"]+)"', 1)
    return F.when(got.isin(*DISPOSITION_VERDICT), got).otherwise("")


def not_nullish(c: Column) -> Column:
    """The value, or null where it says nothing."""
    return F.when(~F.lower(F.trim(text(c))).isin(*NULLISH), c)


def family(kind: Column) -> Column:
    """The family of a type, or the type itself."""
    low = F.trim(F.lower(text(kind)))
    return F.coalesce(lookup({alias: name for name, all_ in FAMILIES.items() for alias in all_}, low), low)


def canonical_type(kind: Column, aliases: dict[str, str]) -> Column:
    low = F.replace(F.lower(F.trim(text(kind))), F.lit("-"), F.lit("_"))
    return F.coalesce(lookup(aliases, low), low) if aliases else low


def display_type(kind: Column, actual: Column, cwe: Column, names: dict[str, str], cwes: dict[str, str], aliases: dict[str, str]) -> Column:
    """Display name of a type: its own, else of the first actual type that has one, else of the CWE, else empty."""
    own = lookup(names, canonical_type(kind, aliases))
    others = F.get(F.filter(F.transform(F.coalesce(actual, F.array().cast("array<string>")), lambda t: lookup(names, canonical_type(t, aliases))), lambda d: d.isNotNull()), F.lit(0))
    return F.coalesce(own, others, lookup(cwes, F.upper(F.trim(text(cwe)))), F.lit(""))


def cwe_number(cwe: Column) -> Column:
    return F.regexp_extract(text(cwe), r"(\d+)", 1).try_cast("int")


def type_of_bug(cwe: Column, rule_code: Column, rule_name: Column, slugs: dict[str, str]) -> Column:
    """The registry's type for a CWE, else the slug of the rule's code or name."""
    by_cwe = lookup(slugs, F.upper(text(cwe))) if slugs else F.lit(None).cast("string")
    return F.coalesce(by_cwe, slug(F.coalesce(F.nullif(text(rule_code), F.lit("")), rule_name)))


def capped(confidence: Column, most: int = 10) -> Column:
    return F.least(F.greatest(confidence, F.lit(0)), F.lit(most))


def test_path(path: Column) -> Column:
    """Test sources by name or folder, any case."""
    return F.rlike(text(path), F.lit(r"(?i)(Test|Tests|IT)\.java$|/test/|/tests/"))


def test_path_wide(path: Column) -> Column:
    """The wider rule of the code graph: ``TestCase.java`` counts and back slashes are folded."""
    low = F.lower(F.replace(text(path), F.lit("\\"), F.lit("/")))
    return F.contains(low, F.lit("/test/")) | F.contains(low, F.lit("/tests/")) | F.rlike(low, F.lit(r"(test|tests|it|testcase)\.java$"))


def exclusion_reason(path: Column, generated: Column, cwe: Column) -> Column:
    """Why an alert needs no judge, by the first rule that holds; null where none does."""
    f = text(path)
    memory = F.regexp_extract(text(cwe), r"(?i)CWE-(\d+)", 1).try_cast("int").isin(*MEMORY_SAFETY)
    return (
        F.when(F.rlike(f, F.lit(r"(?i)\.md$")), "HE-101 markdown_file: doc files produce no executable code")
        .when(test_path(f), "HE-002 test_file: test code does not run in production")
        .when(F.coalesce(generated, F.lit(False)), "HE-010 generated_code: generator owns the security of its output")
        .when(F.rlike(f, F.lit(r"(?i)(^|/)(target|build|generated|generated-sources|node_modules|vendor)/")), "HE-102 build_or_vendored: built/generated/vendored code, not team-owned source")
        .when(memory & ~extension(f).isin(*NATIVE), "HE-201 lang_mismatch: memory-safety CWE cannot occur in managed-memory code")
    )


def cacheable(fail_reason: Column, prefixes: tuple[str, ...]) -> Column:
    """A verdict may be cached without a failure, or with one of the given kinds."""
    out = text(fail_reason) == ""
    for p in prefixes:
        out = out | text(fail_reason).startswith(p)
    return out


def suppressible(confidence: Column, kind: Column, calibrated: Column, mismatch: Column, buried: Column) -> Column:
    """A false positive that nobody needs to review."""
    none = lambda a: F.coalesce(F.size(a), F.lit(0)) <= 0
    return F.coalesce((confidence >= 7) & ~text(kind).isin(*HIGH_RISK) & F.coalesce(calibrated, F.lit(False)) & none(mismatch) & none(buried), F.lit(False))
