"""Entry points over a text or a project: what a user calls first, and the command line behind ``python -m codeloam``."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloam.functions import rules
from codeloam.operators import adapters as ad
from codeloam.operators import dataflow as flow
from codeloam.operators import detect as dt
from codeloam.operators import features as ft
from codeloam.operators import issues as iss
from codeloam.operators import paths as pt
from codeloam.operators import project as pj
from codeloam.operators import vectors as vx
from codeloam.plans import html
from codeloam.session import local_session
from codeloam.sources.files import scan_project

INLINE = 4096  # characters from which an argument is code and no path


def file_of(arg: str) -> Path | None:
    """The file that ``arg`` names, or None if it is code: text over lines, with a NUL, or very long is."""
    if "\n" in arg or "\0" in arg or len(arg) > INLINE:
        return None
    return Path(arg) if Path(arg).is_file() else None


def text_of(arg: str) -> str:
    """The content of the file that ``arg`` names, else ``arg`` itself."""
    path = file_of(arg)
    return path.read_text(errors="replace") if path else arg


class Codeloam:
    """Analyses by name. A text gives a frame of one snippet, a project one row per file and function."""

    def __init__(self, spark: SparkSession | None = None) -> None:
        self.spark = spark or local_session()

    def snippet(self, arg: str, lang: str | None = None) -> DataFrame:
        return self.spark.createDataFrame([(1, lang, text_of(arg))], "fn_id bigint, lang string, code string")

    def project(self, root: str) -> DataFrame:
        """(fn_id, project, file, lang, code): the files below ``root``, numbered by a hash of their path."""
        return scan_project(self.spark, root).select(F.xxhash64("project", "path").alias("fn_id"), "project", F.col("path").alias("file"), "lang", "code")

    def shape(self, fns: DataFrame) -> DataFrame:
        return vx.with_top_names(ad.recursive_counts(fns, ["fn_id"]), "shape", ad.entries(F.col("counts")), rules.PRIMITIVES, 8).select("fn_id", "shape")

    def vector(self, fns: DataFrame) -> DataFrame:
        return vx.unit_rows(ad.recursive_counts(fns, ["fn_id"]), ["fn_id"], ad.entries(F.col("counts")))

    def functions(self, fns: DataFrame) -> DataFrame:
        return flow.extract_functions(fns)

    def findings(self, fns: DataFrame) -> DataFrame:
        return iss.verdicts(iss.enriched_findings(fns, ["fn_id"]))

    def paths(self, fns: DataFrame) -> DataFrame:
        found = iss.enriched_findings(fns, ["fn_id"]).select("fn_id", "line", "weakness", "cwe", "severity")
        return pt.with_issues(pt.in_out_paths(fns), found)

    def algorithms(self, fns: DataFrame) -> DataFrame:
        return dt.algorithms(fns, ["fn_id"])

    def languages(self, root: str) -> DataFrame:
        return self.project(root).groupBy("lang").agg(F.count("*").alias("files"))

    def dims(self, fns: DataFrame, contributors: int = 8) -> DataFrame:
        """(dim, mean, files): the mean vector over all files, zeros included, and the first files that hold each dim."""
        vec = vx.unit_rows(ft.with_tokens(fns), ["fn_id", "file"], vx.packed(ft.token_primitives(F.col("toks"), F.col("code"))))
        n = fns.count() or 1
        few = F.slice(F.array_sort(F.collect_set("file")), 1, contributors)
        return vec.groupBy("dim").agg(F.round(F.sum("value") / n, 6).alias("mean"), few.alias("files"))

    def report(self, root: str, out: str) -> dict[str, str]:
        """Writes ``data.json`` and ``report.html`` about a project into ``out`` and tells their paths."""
        fns = self.project(root)
        found = self.findings(fns).join(fns.select("fn_id", "file"), "fn_id").cache()
        by = lambda c: [(r[0], r[1]) for r in found.groupBy(c).agg(F.count("*").alias("n")).orderBy(F.desc("n"), c).collect()]
        languages = [(r.lang, r.files) for r in fns.groupBy("lang").agg(F.count("*").alias("files")).orderBy("lang").collect()]
        dims = [(r.dim, r["mean"]) for r in self.dims(fns).orderBy("dim").collect()]
        severities, weaknesses, files = by("severity"), by("weakness"), by("file")[:10]
        data = {"project": root, "languages": dict(languages), "severities": dict(severities), "weaknesses": dict(weaknesses), "dims": dict(dims)}
        sections = [
            ("Languages", html.ring(languages) if languages else ""),
            ("Mean shape", html.radar(dims) if dims else ""),
            ("Severity", html.ring(severities) if severities else ""),
            ("Weaknesses", html.bars(weaknesses) if weaknesses else ""),
            ("Files with most findings", html.bars(files) if files else ""),
            ("Findings", html.table(found.select("file", "line", "weakness", "cwe", "severity", "function", "sink", "remediation").orderBy("file", "line"), 200) if weaknesses else ""),
        ]
        folder = Path(out)
        folder.mkdir(parents=True, exist_ok=True)
        (folder / "data.json").write_text(json.dumps(data, indent=1))
        (folder / "report.html").write_text(html.page(f"Report on {root}", sections))
        found.unpersist()
        return {"data": str(folder / "data.json"), "html": str(folder / "report.html")}


def main(argv: list[str] | None = None) -> None:
    """``codeloam COMMAND TARGET [--lang L] [--out DIR]``: a command per analysis of a text, file or project."""
    p = argparse.ArgumentParser(prog="codeloam", description="Structural analysis of source code on Spark")
    p.add_argument("command", choices=["shape", "vector", "functions", "findings", "paths", "algorithms", "languages", "report"])
    p.add_argument("target", help="a file, inline code, or a directory")
    p.add_argument("--lang")
    p.add_argument("--out", default="report")
    a = p.parse_args(argv)
    c = Codeloam()
    if a.command == "report":
        print(json.dumps(c.report(a.target, a.out)))
        return
    if a.command == "languages":
        rows = c.languages(a.target)
    else:
        is_dir = file_of(a.target) is None and "\n" not in a.target and Path(a.target).is_dir()
        rows = getattr(c, a.command)(c.project(a.target) if is_dir else c.snippet(a.target, a.lang))
    for line in rows.toJSON().toLocalIterator():
        print(line)
