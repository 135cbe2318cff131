"""Small dimension tables: types, strategies, sinks, display names."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from alertmill.functions.vocab import cwe_number
from alertmill.schemas import SINKS


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON registry; rows that do not fit the schema stop the load."""
    return spark.read.schema(schema).option("multiLine", "true").option("mode", "FAILFAST").json(path)


def first_claims(registry: DataFrame) -> DataFrame:
    """(alias, vulnerability_type, cwe): who an alias or a CWE belongs to, the first row by ``pos`` that claims it. ``registry`` (pos, vulnerability_type, cwe, aliases)."""
    each = registry.select("pos", "vulnerability_type", cwe_number(F.col("cwe")).alias("cwe"), F.explode(F.array_distinct(F.concat(F.array("vulnerability_type"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("alias"))
    w = Window.partitionBy(F.lower("alias")).orderBy("pos")
    return each.withColumn("n", F.row_number().over(w)).where("n = 1").select(F.lower("alias").alias("alias"), "vulnerability_type", "cwe")


def type_of_cwe(registry: DataFrame) -> DataFrame:
    """(cwe, vulnerability_type): the first type of each CWE."""
    w = Window.partitionBy("cwe").orderBy("pos")
    rows = registry.select("pos", "vulnerability_type", cwe_number(F.col("cwe")).alias("cwe")).where("cwe is not null")
    return rows.withColumn("n", F.row_number().over(w)).where("n = 1").select("cwe", "vulnerability_type")


def usable_signals(signals: DataFrame) -> DataFrame:
    """Signals without the keyword patterns that are no regular expressions. The table is small; patterns are tried on the driver."""
    bad = []
    for r in signals.where("kind = 'function_keywords'").select("pattern").distinct().collect():
        try:
            re.compile(r.pattern)
        except re.error:
            bad.append(r.pattern)
    return signals.where(~((F.col("kind") == "function_keywords") & F.col("pattern").isin(*bad))) if bad else signals


# fixed values: sinks by key: type, CWE, severity
_SQL = ("sql_injection", "CWE-89", 4)
_CMD = ("command_injection", "CWE-78", 5)
_XXE = ("xxe", "CWE-611", 4)
_DES = ("deserialization", "CWE-502", 5)
_EXP = ("expression_injection", "CWE-94", 5)
SINK_KEYS = {
    _CMD: ("getRuntime", "Runtime.getRuntime", "exec", "getRuntime().exec", "ProcessBuilder", "ProcessBuilder.start", "Runtime.exec", "RpcCallTemplate.execute", "DubboInvoker.invoke", "GrpcStub.call", "RpcProxy.call", "RpcProxy.invoke"),
    _SQL: (
        "java.sql.Statement.execute", "java.sql.Statement.executeQuery", "java.sql.Statement.executeUpdate", "java.sql.Statement.executeLargeUpdate", "java.sql.PreparedStatement.execute", "java.sql.PreparedStatement.executeQuery",
        "java.sql.PreparedStatement.executeUpdate", "executeQuery", "executeUpdate", "JdbcTemplate.query", "JdbcTemplate.update", "JdbcTemplate.queryForObject", "JdbcTemplate.queryForList", "JdbcTemplate.execute",
        "javax.persistence.EntityManager.createQuery", "javax.persistence.EntityManager.createNativeQuery", "javax.persistence.TypedQuery.getResultList", "org.hibernate.Session.createQuery", "org.hibernate.Session.createSQLQuery",
        "org.hibernate.query.Query.getResultList", "EntityManager.createQuery", "EntityManager.createNativeQuery", "Session.createQuery", "Session.createSQLQuery", "javax.persistence.criteria.CriteriaBuilder.like",
        "javax.persistence.criteria.CriteriaBuilder.equal", "CriteriaBuilder.like", "CriteriaBuilder.equal", "Statement.execute", "Statement.executeQuery", "Statement.executeUpdate", "PreparedStatement.execute",
        "PreparedStatement.executeQuery", "PreparedStatement.executeUpdate",
    ),
    ("ssrf", "CWE-918", 3): ("getInputStream",),
    ("ssrf", "CWE-918", 4): ("URL.openConnection", "openStream", "HttpClient.send", "HttpURLConnection", "FeignClient.invoke"),
    _XXE: ("newSAXParser", "SAXParser.parse", "DocumentBuilder.parse", "newTransformer", "Transformer.transform"),
    ("path_traversal", "CWE-22", 4): ("new FileInputStream", "new FileOutputStream"),
    ("path_traversal", "CWE-22", 3): ("new File", "new RandomAccessFile"),
    _DES: ("readObject", "XMLDecoder.readObject", "ObjectInputStream"),
    _EXP: ("GroovyShell.evaluate", "ScriptEngine.eval", "SpelExpressionParser.parseExpression"),
    ("logging", "CWE-532", 1): ("log.info", "logger.info", "printStackTrace", "printf", "println", "Logger.error", "Logger.warn", "Logger.info", "Logger.debug", "System.out"),
    ("value_parse", "CWE-20", 1): ("Long.parseLong", "Integer.parseInt"),
    ("value_convert", "CWE-20", 1): ("toString", "valueOf"),
}


def sinks(spark: SparkSession) -> DataFrame:
    """The built-in catalogue; logging and conversions are benign, conversions stand on the source side."""
    rows = [(k, kind, cwe, sev, kind in ("logging", "value_parse", "value_convert"), kind.startswith("value_")) for (kind, cwe, sev), keys in SINK_KEYS.items() for k in keys]
    return spark.createDataFrame(rows, SINKS)
