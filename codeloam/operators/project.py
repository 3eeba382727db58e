"""Project-level aggregates: composites, language shares, posture, grades, risky files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloam.functions import rules
from codeloam.operators import detect as dt
from codeloam.operators import features as ft
from codeloam.operators import vectors as vx


def composite(fns: DataFrame, connections: DataFrame, modules: DataFrame) -> DataFrame:
    """(project, dim, value): language shares of files, sums of primitives, cost signals, sinks, values written into the
    code, functions, connections (project, n) and modules (project, n); unit length per project."""
    files = fns.select("project", "file", "lang").distinct().groupBy("project", "lang").agg(F.count("*").alias("n"))
    lang = files.select("project", F.concat(F.lit("LANG:"), "lang").alias("dim"), (F.col("n") / F.sum("n").over(Window.partitionBy("project"))).alias("value")).where("dim is not null")
    rows = ft.with_tokens(fns)
    prims = vx.exploded(rows, ["project"], vx.packed({f"PRIM:{p}": c for p, c in ft.token_primitives(F.col("toks"), F.col("code")).items()} | {"FUNC": F.lit(1)}))
    cost = vx.unit_rows(ft.with_efficiency(fns), ["project"], vx.packed(ft.efficiency_dims())).select("project", F.concat(F.lit("EFF:"), "dim").alias("dim"), "value")
    sums = prims.union(cost).groupBy("project", "dim").agg(F.sum("value").alias("value"))
    sinks = dt.named_sinks(fns, ["project", "fn_id"]).groupBy("project", F.concat(F.lit("SINK:"), "category").alias("dim")).agg(F.count("*").cast("double").alias("value"))
    hard = dt.hardcoded(fns, ["project", "fn_id"]).groupBy("project", F.concat(F.lit("HARD:"), "kind").alias("dim")).agg(F.count("*").cast("double").alias("value"))
    more = connections.select("project", F.lit("CONN").alias("dim"), F.col("n").cast("double").alias("value")).union(modules.select("project", F.lit("IMP").alias("dim"), F.col("n").cast("double")))
    every = lang.unionByName(sums).unionByName(sinks).unionByName(hard).unionByName(more)
    norm = F.sqrt(F.sum(F.col("value") * F.col("value")).over(Window.partitionBy("project")))
    return every.withColumn("value", F.round(F.col("value") / norm, 4)).where("value <> 0")


def findings_of(table: DataFrame) -> DataFrame:
    """Distinct findings with severity in its plain form; without one it is MEDIUM."""
    severity = F.coalesce(F.upper(F.trim("severity")), F.lit("MEDIUM"))
    return table.select("finding_id", "project", "file", "vuln_type", severity.alias("severity"), "line", "cwe_id", "sink", "detector").distinct()


def weight(severity: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in rules.SEVERITY_WEIGHT.items() for x in kv])[severity], F.lit(0.4))


def grade(score: Column) -> Column:
    out = F.when(score.isNull() | (score <= 0), "A+")
    for least, letter in rules.GRADES[:-1]:
        out = out.when(score >= least, letter)
    return out.otherwise(rules.GRADES[-1][1])


def posture(findings: DataFrame) -> DataFrame:
    """Counts and worst weight by kind, severity, CWE, file and over all, from one scan by grouping sets."""
    f = findings.withColumn("weight", weight(F.col("severity")))
    f.createOrReplaceTempView("codeloam_posture")
    return f.sparkSession.sql(
        """SELECT CASE WHEN grouping(vuln_type) = 0 THEN 'kind' WHEN grouping(severity) = 0 THEN 'severity' WHEN grouping(cwe_id) = 0 THEN 'cwe' WHEN grouping(file) = 0 THEN 'file' ELSE 'all' END AS facet,
             coalesce(vuln_type, severity, cwe_id, file) AS name, count(*) AS findings, max(weight) AS risk
           FROM codeloam_posture GROUP BY GROUPING SETS ((vuln_type), (severity), (cwe_id), (file), ())"""
    )


def severities(findings: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of the four severities as columns."""
    return findings.groupBy(*keys).pivot("severity", list(rules.SEVERITY_WEIGHT)).count().na.fill(0)


def grades(findings: DataFrame, keys: list[str]) -> DataFrame:
    out = findings.groupBy(*keys).agg(F.count("*").alias("findings"), F.round(F.max(weight(F.col("severity"))), 3).alias("risk"))
    return out.withColumn("grade", grade(F.col("risk")))


def risky_files(findings: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` files of greatest risk, then most findings, then first by name."""
    return grades(findings.where("file is not null"), ["project", "file"]).orderBy(F.desc("risk"), F.desc("findings"), "project", "file").limit(n)


def remediations(findings: DataFrame) -> DataFrame:
    """(project, file, lines): distinct texts per file in the order of line and kind."""
    text = F.concat(F.lit("L"), F.coalesce(F.col("line").cast("string"), F.lit("None")), F.lit(" "), "vuln_type", F.lit(": Review this code path."))
    per = findings.groupBy("project", "file").agg(F.array_sort(F.collect_set(F.struct(F.coalesce("line", F.lit(-1)).alias("o"), text.alias("t")))).alias("a"))
    return per.select("project", "file", F.array_join(F.array_distinct(F.transform("a", lambda x: x["t"])), "\n").alias("lines"))
