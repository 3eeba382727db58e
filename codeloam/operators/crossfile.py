"""Flows of inputs over functions and files: per-parameter summaries in the batch, reach over calls as joins."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloam.functions import security as rules
from codeloam.operators import values as vl
from codeloam.operators.graph import hops
from codeloam.session import cut

SUMMARY = "unit_id bigint, project string, file string, name string, found array<struct<param:string,position:int,is_entry:boolean,sink:string,sink_line:int,passed:array<struct<callee:string,position:int>>>>"
MOST = 21  # calls from an entry to a sink


def summary_of(body: str, params: list[str], sites: list) -> list[dict]:
    """Per parameter: whether the function reads an input, the first sink its value meets, else where it is passed on.

    Names assigned from an expression with the parameter carry its value; the first line that has such a name and the
    word of a sink is the hit, the first word by the fixed order names it.
    """
    entry = any(vl.holds(s, body, True) for s in rules.FLOW_SOURCES)
    pairs = [(m[1], m[2].strip()) for m in re.finditer(r"\b(\w+)\s*=\s*([^;\n]+)", body)]
    lines = body.splitlines()
    out = []
    for k, p in enumerate(params):
        names = {p} | {v for v, rhs in pairs if not rhs.startswith(("=", "==", "!=", "<=", ">=")) and vl.holds(p, rhs)}
        hit = next(((s, n) for n, line in enumerate(lines, 1) if any(vl.holds(x, line) for x in names) for s in rules.FLOW_SINKS if vl.holds(s, line.lower())), None)
        passed = [] if hit else [{"callee": c["callee"], "position": i} for c in sites for i, a in enumerate(c["args"] if c["args"] is not None else []) if a and c["callee"] and any(vl.holds(x, a) for x in names)]
        out.append({"param": p, "position": k, "is_entry": entry, "sink": hit[0] if hit else None, "sink_line": hit[1] if hit else None, "passed": passed})
    return out


def summaries(units: DataFrame) -> DataFrame:
    """(unit_id, project, file, name, param, position, is_entry, sink, sink_line, passed) of functions with parameters."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["found"] = [summary_of(b or "", [x for x in p if x], list(c) if c is not None else []) for b, p, c in zip(pdf["body"], pdf["params"], pdf["call_sites"])]
            yield pdf[["unit_id", "project", "file", "name", "found"]]

    src = units.where("size(params) > 0 and name is not null and name <> '<module>'").select("unit_id", "project", "file", "name", "params", "call_sites", "body")
    return src.mapInPandas(run, SUMMARY).select("unit_id", "project", "file", "name", F.explode("found").alias("f")).select("unit_id", "project", "file", "name", "f.*")


def cross_file_flows(units: DataFrame) -> DataFrame:
    """(project, file, function, param, sink, sink_line, hops): parameters that inputs reach, over calls, and that meet a sink.

    Entries are the parameters of functions that read an input. A value that meets a sink goes no further, else it goes
    where it is passed: to the function of that name in the same file, or to the first of the project by file and
    id. Steps are joins over (project, function, parameter) as 64-bit keys; each drops what was reached. One row per
    file, line and sink, from the function and parameter with the fewest hops.
    """
    s = cut(summaries(units))
    node = lambda *c: F.xxhash64(*c)
    heads = s.select("project", F.col("file").alias("to_file"), F.col("name").alias("callee"), F.col("unit_id").alias("to_unit"), "position", F.col("param").alias("to_param"))
    sites = s.where("sink is null").select("project", "file", "name", "param", F.explode("passed").alias("c")).select("project", "file", "name", "param", "c.callee", "c.position").distinct()
    # of the functions of a name one in the same file, else the first of the project; ids of candidates only, per name and file
    units_of = heads.select("project", "callee", "to_file", "to_unit").distinct()
    own = units_of.groupBy("project", "callee", "to_file").agg(F.min("to_unit").alias("own_unit")).withColumnRenamed("to_file", "file")
    any_ = units_of.groupBy("project", "callee").agg(F.min(F.struct("to_file", "to_unit")).alias("m")).select("project", "callee", F.col("m.to_unit").alias("first_unit"))
    sites = sites.join(any_, ["project", "callee"]).join(own, ["project", "callee", "file"], "left").withColumn("to_unit", F.coalesce("own_unit", "first_unit"))
    edges = sites.join(heads.select("to_unit", "position", "to_param"), ["to_unit", "position"]).select(node("project", "name", "param").alias("src"), node("project", "callee", "to_param").alias("dst"))
    reached = hops(edges, s.where("is_entry").select(node("project", "name", "param").alias("node")), MOST)
    hit = s.where("sink is not null").withColumn("node", node("project", "name", "param")).join(reached, "node")
    w = Window.partitionBy("project", "file", "sink_line", "sink").orderBy("hops", "name", "param", "unit_id")
    return hit.withColumn("nth", F.row_number().over(w)).where("nth = 1").select("project", "file", F.col("name").alias("function"), "param", "sink", "sink_line", "hops")


def passed_arguments(units: DataFrame) -> DataFrame:
    """(project, file, caller, callee, arg, param): arguments of calls by the parameter they stand for, in the function of
    that name in the same file or else the first of the project; surplus arguments stand for none."""
    c = units.select("project", "file", F.col("name").alias("caller"), F.explode("call_sites").alias("c")).select("project", "file", "caller", "c.callee", F.posexplode("c.args").alias("position", "arg"))
    defs = units.where("name is not null and name <> '<module>' and size(params) > 0").select("project", F.col("name").alias("callee"), F.col("file").alias("f"), "unit_id", "params").groupBy("project", "callee", "f").agg(F.min_by("params", "unit_id").alias("params"))
    own = defs.select("project", "callee", F.col("f").alias("file"), F.col("params").alias("own"))
    first = defs.groupBy("project", "callee").agg(F.min_by("params", "f").alias("first"))
    both = c.join(first, ["project", "callee"]).join(own, ["project", "callee", "file"], "left").withColumn("params", F.coalesce("own", "first"))
    return both.where("position < size(params)").select("project", "file", "caller", "callee", "arg", F.element_at("params", F.col("position") + 1).alias("param")).distinct()
