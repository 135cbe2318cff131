"""Dependency policy: thresholds, allow and deny lists, licence families, and the joins that explain a finding."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertmill.functions import text as t
from alertmill.functions import vocab as v


@dataclass(frozen=True)
class Policy:
    """What is allowed: licences by name, components by (name, ecosystem, reason, severity), licence families by (match, reason, severity)."""

    license_allowlist: tuple[str, ...] = ()
    vuln_min_severity: str = ""
    blacklist: tuple[tuple[str, str, str, str], ...] = ()
    copyright_rules: tuple[tuple[str, str, str], ...] = ()
    extra: dict = field(default_factory=dict)

    @staticmethod
    def of(raw: dict) -> Policy:
        """From its JSON form; a denied component without both keys is an error, so that no policy loads half."""
        for b in raw.get("blacklist", []):
            if not b.get("name") or not b.get("ecosystem"):
                raise ValueError(f"a denied component needs name and ecosystem: {b}")
        return Policy(
            tuple(raw.get("license_allowlist", [])),
            raw.get("vuln_min_severity", ""),
            tuple((b["name"], b["ecosystem"], b.get("reason", ""), b.get("severity", "")) for b in raw.get("blacklist", [])),
            tuple((c["match"], c.get("reason", ""), c.get("severity", "")) for c in raw.get("copyright_rules", [])),
        )


_RANK = {"critical": 4, "high": 3, "medium": 2, "low": 1}


def _finding(rule, category, severity, evidence, detail=None):
    return [rule.alias("rule_id"), F.lit(category).alias("category"), severity.alias("severity"), F.col("component"), F.col("version"), F.col("ecosystem"), evidence.alias("evidence"), F.lit(None).cast("string").alias("source_file"), (F.lit(None).cast("map<string,string>") if detail is None else detail).alias("detail")]


def vulnerabilities(vulns: DataFrame, policy: Policy) -> DataFrame:
    """Vulnerabilities at or above the threshold; a threshold that is no severity lets all through, an unknown severity has rank 0."""
    rank = F.coalesce(v.lookup(_RANK, F.col("severity")), F.lit(0))
    rows = vulns.where(rank >= _RANK.get(policy.vuln_min_severity, 0))
    cve = t.text(F.col("cve"))
    detail = F.map_filter(F.create_map(F.lit("osv_id"), F.col("osv_id"), F.lit("summary"), F.col("summary"), F.lit("cvss_score"), F.col("cvss_score"), F.lit("cve"), F.nullif(cve, F.lit(""))), lambda k, x: (k != "cve") | x.isNotNull())
    return rows.select(*_finding(F.concat(F.lit("vuln-"), t.text(F.col("severity"))), "vulnerability", F.col("severity"), F.when(cve != "", cve).otherwise(F.col("osv_id")), detail))


def licences(rows: DataFrame, policy: Policy) -> DataFrame:
    """Licences that are not on the allow list."""
    spark = rows.sparkSession
    allowed = spark.createDataFrame([(x,) for x in policy.license_allowlist], "license string")
    return rows.join(F.broadcast(allowed), "license", "left_anti").select(*_finding(F.concat(F.lit("license-"), t.dashed(F.col("license"))), "license", F.lit("high"), F.col("license")))


def denied(components: DataFrame, policy: Policy) -> DataFrame:
    """Components on the deny list, once for each row of either side."""
    rules = components.sparkSession.createDataFrame(list(policy.blacklist), "name string, ecosystem string, reason string, sev string")
    hit = components.select(F.col("name"), "version", "ecosystem").join(F.broadcast(rules), ["name", "ecosystem"]).withColumn("component", F.col("name"))
    return hit.select(*_finding(F.concat(F.lit("blacklist-"), "name"), "blacklist", F.col("sev"), F.col("reason")))


def families(rows: DataFrame, policy: Policy) -> DataFrame:
    """Licences of a family: ``X-*`` stands for whatever begins with ``X-``, anything else for itself."""
    rules = rows.sparkSession.createDataFrame([(m, r, s, m[:-1] if m.endswith("-*") else None) for m, r, s in policy.copyright_rules], "match string, reason string, sev string, prefix string")
    hit = rows.join(F.broadcast(rules), (F.col("license") == F.col("match")) & F.col("prefix").isNull() | F.coalesce(F.startswith("license", "prefix"), F.lit(False)))
    return hit.select(*_finding(F.concat(F.lit("copyright-"), t.dashed(F.col("match"))), "copyright", F.col("sev"), F.concat("reason", F.lit("（"), "license", F.lit("）"))))


def source_files(components: DataFrame) -> DataFrame:
    """(component, source_file): the first file that is named for a component's name, whatever its version or ecosystem; needs ``pos``."""
    return components.where(t.text(F.col("source_file")) != "").groupBy(F.col("name").alias("component")).agg(F.min_by("source_file", "pos").alias("source_file"))


def evaluate(policy: Policy, components: DataFrame, vulns: DataFrame, licences_: DataFrame) -> DataFrame:
    """All findings of a scan, with the file their component comes from."""
    found = vulnerabilities(vulns, policy).unionByName(licences(licences_, policy)).unionByName(denied(components, policy)).unionByName(families(licences_, policy))
    return found.drop("source_file").join(source_files(components), "component", "left").select("rule_id", "category", "severity", "component", "version", "ecosystem", "evidence", "source_file", "detail")


def by_severity(findings: DataFrame, *keys: str) -> DataFrame:
    """Counts by severity as four columns, 0 where there are none."""
    return findings.groupBy(*keys).pivot("severity", ["critical", "high", "medium", "low"]).count().na.fill(0)


def severity_of_ids(groups: DataFrame) -> DataFrame:
    """(osv_id, cvss_score): scores of grouped identifiers (pos, ids, max_severity); of several groups the last counts."""
    each = groups.select("pos", F.explode("ids").alias("osv_id"), F.col("max_severity").alias("cvss_score"))
    return each.groupBy("osv_id").agg(F.max_by("cvss_score", "pos").alias("cvss_score"))


def translate(results: DataFrame) -> dict[str, DataFrame]:
    """Scanner results as components, vulnerabilities and licences.

    ``results`` has an array ``results`` of structs (source.path, packages of (package, vulnerabilities, groups, licenses)).
    Each licence is a row; a component carries them joined by `` AND ``.
    """
    pk = results.select(F.monotonically_increasing_id().alias("d"), F.posexplode("results").alias("i", "r")).select("d", "i", F.col("r.source.path").alias("path"), F.posexplode("r.packages").alias("j", "p")).withColumn("pos", F.struct("d", "i", "j"))
    base = [F.col("p.package.name").alias("component"), F.col("p.package.version").alias("version"), F.col("p.package.ecosystem").alias("ecosystem")]
    components = pk.select(F.col("p.package.name").alias("name"), *base[1:], F.when(F.size("p.licenses") > 0, F.array_join("p.licenses", " AND ")).alias("license"), F.lit("direct").alias("direct_or_transitive"), F.col("path").alias("source_file"), "pos")
    vulns = pk.select("pos", *base, F.col("p.groups").alias("groups"), F.posexplode("p.vulnerabilities").alias("k", "x"))
    scores = vulns.select("pos", "k", F.posexplode("groups").alias("g", "grp")).select("pos", "k", "g", F.explode("grp.ids").alias("osv_id"), F.col("grp.maxSeverity").alias("s"))
    last = scores.groupBy("pos", "k", "osv_id").agg(F.max_by("s", "g").alias("cvss_score"))
    rows = vulns.withColumn("osv_id", F.col("x.id")).join(last, ["pos", "k", "osv_id"], "left")
    found = rows.select("component", "version", "ecosystem", "osv_id", t.first_with_prefix(F.coalesce("x.aliases", F.array().cast("array<string>")), "CVE-").alias("cve"), v.dependency_severity(F.col("cvss_score")).alias("severity"), "cvss_score", F.col("x.summary").alias("summary"))
    lic = pk.select(*base, F.explode("p.licenses").alias("license"))
    return {"components": components, "vulns": found, "licenses": lic}


def search_components(scans: DataFrame, components: DataFrame, name: str, ecosystem: str | None = None) -> DataFrame:
    """Uses of a component in finished scans, the newest scan id first."""
    want = (F.col("name") == name) if not ecosystem else (F.col("name") == name) & (F.col("ecosystem") == ecosystem)
    return scans.where("status = 'done'").join(components.where(want), "scan_id").orderBy(F.desc("scan_id"), "version")


def grouped_by_ecosystem(hits: DataFrame) -> DataFrame:
    """(ecosystem, hits): an array of structs for each ecosystem, in a fixed order."""
    return hits.groupBy("ecosystem").agg(F.array_sort(F.collect_list(F.struct("scan_id", "name", "version"))).alias("hits"))
