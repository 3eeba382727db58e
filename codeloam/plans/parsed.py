"""Queries of operators that need a parser or a tree: structure, functions, flow of values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloam.operators import dataflow as df_
from codeloam.operators import detect as dt
from codeloam.operators import embed as em
from codeloam.operators import enriched as en
from codeloam.operators import features as ft
from codeloam.operators import graph as gr
from codeloam.operators import risks as rk
from codeloam.operators import similarity as sm
from codeloam.operators import structure as st
from codeloam.operators import vectors as vx
from codeloam.plans import features as fp
from codeloam.plans import projects as pr
from codeloam.plans import sqltext as sq
from codeloam.plans.core import query
from codeloam.plans.features import _fns
from codeloam.plans.planted import risky
from codeloam.session import cut, table


@query("structural_signatures")
def structural_signatures(spark: SparkSession, d: str) -> DataFrame:
    """Indentation tree of every function as text."""
    return _fns(spark, d).select("fn_id", st.signature_udf("code").alias("signature"))


@query("structural_neighbours")
def structural_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Tree similarity of each function to the next of its project, and to its own reassembly."""
    pairs = gr.next_in_group(_fns(spark, d).select("fn_id", "project", "code"), ["project"], "fn_id", ["fn_id", "code"])
    return pairs.select(F.col("fn_id").alias("first_id"), F.col("fn_id2").alias("second_id"), F.round(st.similarity_udf("code", "code2"), 4).alias("similarity"), F.round(st.similarity_udf("code", st.assembled_udf("code")), 4).alias("round_trip"))


@query("functions_inside")
def functions_inside(spark: SparkSession, d: str) -> DataFrame:
    """Functions found inside every text."""
    return df_.extract_functions(_fns(spark, d))


@query("flow_edges")
def flow_edges(spark: SparkSession, d: str) -> DataFrame:
    """Moves of values between variables, calls and returns."""
    return df_.flow_edges(_fns(spark, d))


@query("flow_measures")
def flow_measures(spark: SparkSession, d: str) -> DataFrame:
    return df_.flow_measures(df_.flow_edges(_fns(spark, d)))


@query("framework_sinks", "SELECT * FROM (VALUES (-21, 3, 'OPEN_REDIRECT', ['target']), (-22, 3, 'LOG_INJECTION', ['text'])) AS t(fn_id, line, kind, sources)")
def framework_sinks(spark: SparkSession, d: str) -> DataFrame:
    """Lines with a redirect, header, log or pattern sink that values of parameters reach."""
    return rk.framework_sinks(_fns(spark, d).select("fn_id", "lang", "code").union(risky(spark)))


@query("error_handling", "SELECT * FROM (VALUES (-24, 'FAILING_OPEN', 2), (-25, 'SWALLOWED', 2), (-26, 'NULL_DEREF', 3), (-28, 'ERROR_LEAK', 2), (-29, 'MISSING_PARAM', 2)) AS t(fn_id, kind, line)")
def error_handling(spark: SparkSession, d: str) -> DataFrame:
    """Mishandled errors in Python functions and documents' Python code."""
    docs = table(spark, d, "documents").where("text is not null").select((-F.col("doc_id") - 1).alias("fn_id"), F.lit("python").alias("lang"), F.col("text").alias("code"))
    return rk.error_handling(_fns(spark, d).select("fn_id", "lang", "code").union(docs).union(risky(spark))).select("fn_id", "kind", "line")


@query("import_depths")
def import_depths(spark: SparkSession, d: str) -> DataFrame:
    """Longest chain of imports from each file stem or module of the corpus."""
    i = gr.imports(gr.units_of(table(spark, d, "function_unit")))
    stem = F.regexp_extract("file", r"([^/\\]+?)(?:\.\w+)?$", 1)
    return rk.layers(i.select(stem.alias("src"), F.regexp_extract("module", r"([^/.]+)(?:\.h)?$", 1).alias("dst")))


_BUCKET = "CASE WHEN hint IS NULL OR trim(hint) = '' THEN 'UNKNOWN' " + " ".join(f"WHEN base = {sq.q(k)} THEN {sq.q(v)}" for k, v in em.BUCKETS.items()) + " WHEN regexp_matches(base, '^[A-Z]') THEN 'CLASS' ELSE 'UNKNOWN' END"
_TYPES = "p0 AS (SELECT fn_id, unnest(params) AS p, generate_subscripts(params, 1) - 1 AS pos FROM (SELECT DISTINCT fn_id, params FROM universal_function)), p1 AS (SELECT fn_id, pos, p.name AS name, p.type_hint AS hint, list_last(string_split(trim(regexp_replace(regexp_replace(regexp_replace(trim(p.type_hint), 'Optional\\[(.*)\\]', '\\1'), 'Union\\[(.*)\\]', '\\1'), '\\[.*\\]', '')), '.')) AS base FROM p0)"


@query("param_types", f"WITH {_TYPES} SELECT fn_id, pos, name, {_BUCKET} AS bucket FROM p1")
def param_types(spark: SparkSession, d: str) -> DataFrame:
    """Type bucket of every parameter."""
    return em.param_types(table(spark, d, "universal_function"))


@query("type_profiles", f"WITH {_TYPES}, n AS (SELECT fn_id, 'TYPE_PROFILE:' || {_BUCKET} AS dim, count(*) AS n FROM p1 GROUP BY ALL) SELECT fn_id, dim, round(n / sqrt(sum(n * n) OVER (PARTITION BY fn_id)), 4) AS value FROM n")
def type_profiles(spark: SparkSession, d: str) -> DataFrame:
    return em.type_profile(em.param_types(table(spark, d, "universal_function")))


def _slot(merged: bool) -> str:
    slot = f"CASE WHEN regexp_matches(dim, '^(?:PARAM|VAR):') THEN split_part(dim, ':', 1) || CASE WHEN regexp_extract(dim, ':ROLE:(\\w+)', 1) IN ({', '.join(map(sq.q, em.ROLE_SLOTS))}) THEN '.role:' || regexp_extract(dim, ':ROLE:(\\w+)', 1) WHEN split_part(dim, ':', 3) IN ({', '.join(map(sq.q, em.TYPE_SLOTS))}) THEN '.type:' || split_part(dim, ':', 3) ELSE '.type:UNKNOWN' END ELSE dim END"
    return f"CASE {slot} {' '.join(f'WHEN {sq.q(k)} THEN {sq.q(v)}' for k, v in em.MERGES.items())} ELSE {slot} END" if merged else slot


def _embedding(name: str, merged: bool) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return em.fixed_embedding(pr._vec(spark, d), merged)

    query(name, f"WITH {pr._VEC}, e AS (SELECT id, {_slot(merged)} AS slot, sum(value) AS v FROM v GROUP BY ALL), n AS (SELECT id, slot AS dim, round(v / sqrt(sum(v * v) OVER (PARTITION BY id)), 6) AS value FROM e) SELECT * FROM n WHERE value <> 0")(run)


_embedding("fixed_embedding", False)
_embedding("merged_embedding", True)


@query("translations")
def translations(spark: SparkSession, d: str) -> DataFrame:
    """A function of each distinct shape in every target language, and the share of primitives its own shape keeps."""
    shapes = dt.with_shape(_fns(spark, d)).select("shape").distinct()
    out = None
    for lang in em.LINES:
        made = em.translated(shapes, lang).select(F.lit(lang).alias("lang"), F.col("shape").alias("wanted"), "code")
        back = dt.with_shape(made).select("lang", "wanted", "code", F.col("shape").alias("got"))
        out = back if out is None else out.union(back)
    a, b = F.split("wanted", ">"), F.split("got", ">")
    return out.select("lang", "wanted", "got", F.round(F.size(F.array_intersect(a, b)) / F.size(a), 2).alias("overlap"), "code")


@query("enriched_vector")
def enriched_vector(spark: SparkSession, d: str) -> DataFrame:
    """The combined vector of every function."""
    return en.enriched(_fns(spark, d), em.param_types(table(spark, d, "universal_function")))


@query("enriched_summary")
def enriched_summary(spark: SparkSession, d: str) -> DataFrame:
    """The four greatest dims of each family of a function's combined vector."""
    return vx.top_per_family(enriched_vector(spark, d), ["fn_id"], 4)


@query("language_clusters")
def language_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Languages grouped by the mean of their functions' primitive vectors."""
    rows = vx.unit_rows(ft.with_tokens(_fns(spark, d).where("lang is not null")), ["fn_id", "lang"], vx.packed(ft.token_primitives(F.col("toks"), F.col("code"))))
    mean = rows.groupBy(F.col("lang").alias("id"), "dim").agg(F.sum("value").alias("value"))
    groups = en.greedy_clusters(mean, 0.97)
    return spark.createDataFrame([(k, x) for k, g in enumerate(groups) for x in g], "cluster int, lang string")


@query("similar_projects")
def similar_projects(spark: SparkSession, d: str) -> DataFrame:
    """Every project against every other one that shares a dim with it, by their composites."""
    composites = cut(pr.project_composite(spark, d))
    return en.similar_projects(composites, composites)


@query("model_similarities")
def model_similarities(spark: SparkSession, d: str) -> DataFrame:
    """Each function against the next of its project by the operation model."""
    df = fp._model(spark, d)
    df = df.select("fn_id", "project", "text", vx.packed(ft.model_dims(F.col("text"), F.col("flow"))).alias("e"))
    p = gr.next_in_group(df, ["project"], "fn_id", ["fn_id", "text", "e"])
    return p.select(F.col("fn_id").alias("first_id"), F.col("fn_id2").alias("second_id"), F.round(sm.model_similarity(F.col("e"), F.col("e2"), F.col("text"), F.col("text2")), 4).alias("similarity"))


@query("flow_similarities")
def flow_similarities(spark: SparkSession, d: str) -> DataFrame:
    """Each function against the next of its project by calls, data edges and primitives."""
    sets = sm.flow_sets(df_.flow_edges(_fns(spark, d)))
    return sm.flow_similarity(pr.neighbour_similarity(spark, d), sets)
