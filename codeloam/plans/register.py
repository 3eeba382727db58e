"""Tables, rules and functions under names that SQL can use."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from codeloam.functions import rules
from codeloam.operators import dataflow, structure


class FunctionsIn:
    """``SELECT t.fn_id, f.* FROM t, LATERAL functions_in(t.code, t.lang) f``: one row per function in a text."""

    def eval(self, code: str, lang: str):
        for name, params, begin, end, is_async, _ in dataflow.functions_in(code, lang):
            yield name, params, begin, end, is_async


def register(spark: SparkSession, tables: dict[str, str] | None = None) -> None:
    """Views of ``tables`` (name to Parquet path) and of the rule tables, scalar functions and a table function."""
    for name, path in (tables or {}).items():
        spark.read.parquet(path).createOrReplaceTempView(name)
    prims = [(k, p) for k, p in enumerate(rules.PRIMITIVES)]
    spark.createDataFrame(prims, "ord int, primitive string").createOrReplaceTempView("dim_primitive")
    patterns = [(lang, p, x) for lang, t in {"*": rules.DEFAULT_PATTERNS, **rules.LANGUAGE_PATTERNS}.items() for p, xs in t.items() for x in xs]
    spark.createDataFrame(patterns, "lang string, primitive string, pattern string").createOrReplaceTempView("dim_language_pattern")
    weak = [(k, c, "sink", p) for k, c, s, _ in rules.WEAKNESSES for p in s] + [(k, c, "mitigation", p) for k, c, _, m in rules.WEAKNESSES for p in m]
    spark.createDataFrame(weak, "kind string, cwe string, side string, pattern string").createOrReplaceTempView("dim_weakness")
    spark.createDataFrame([(e, lang) for lang, es in rules.EXTENSIONS.items() for e in es], "ext string, lang string").createOrReplaceTempView("dim_extension")
    spark.udf.register("structural_signature", structure.signature_udf)
    spark.udf.register("tree_similarity", structure.similarity_udf)
    spark.udtf.register("functions_in", F.udtf(FunctionsIn, returnType="name string, params array<string>, start_line int, end_line int, is_async boolean"))
