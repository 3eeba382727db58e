"""The combined vector of a function: every producer's dims in long form, metrics of their spread, unit length."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloam.functions import lex
from codeloam.operators import detect as dt
from codeloam.operators import features as ft
from codeloam.operators import vectors as vx

MOST_ITEMS = 500  # items of the greedy clustering, which is sequential by nature


def parts(fns: DataFrame, types: DataFrame) -> DataFrame:
    """(fn_id, dim, value): unnormalised dims of all producers."""
    toks = ft.with_tokens(fns)
    prims = ft.token_primitives(F.col("toks"), F.col("code"))
    text = toks.withColumn("text", lex.stripped(F.col("code")))
    own = vx.exploded(text, ["fn_id"], F.concat(vx.packed(ft.flow_dims(F.col("toks")) | ft.value_ends(F.col("code"))), vx.packed(ft.state_and_control_dims(F.col("toks"), F.col("text")))))
    unit = lambda rows, prefix: rows.select("fn_id", F.concat(F.lit(prefix), "dim").alias("dim"), "value")
    out = unit(vx.unit_rows(toks, ["fn_id"], vx.packed(prims)), "PRIM:")
    out = out.union(unit(vx.unit_rows(ft.with_efficiency(fns), ["fn_id"], vx.packed(ft.efficiency_dims())), "EFF:")).union(own)
    named = lambda rows, prefix: rows.select("fn_id", F.concat(F.lit(prefix), "name").alias("dim"), F.col("score").alias("value"))
    shaped = dt.with_shape(fns)
    out = out.union(named(dt.signatures(shaped, ["fn_id"], dt.rules.ALGORITHMS, 0.5, 0.5, 0.5), "ALG:")).union(named(dt.signatures(shaped, ["fn_id"], dt.rules.PATTERNS, 0.4, 0.6, 0.4), "PAT:"))
    out = out.union(dt.weaknesses(fns, ["fn_id"]).select("fn_id", F.concat(F.lit("VULN:"), "kind"), F.lit(1.0)))
    params = types.groupBy("fn_id", F.concat(F.lit("PARAM:"), "name", F.lit(":"), "bucket").alias("dim")).agg(F.count("*").cast("double").alias("value"))
    return out.union(params).union(types.groupBy("fn_id").agg(F.count("*").cast("double").alias("value")).select("fn_id", F.lit("PARAM_COUNT"), "value"))


def enriched(fns: DataFrame, types: DataFrame) -> DataFrame:
    """(fn_id, dim, value): the combined vector with entropy, spread and skew of its dims, of unit length, 4 decimals."""
    every = parts(fns.select("fn_id", "lang", "code"), types.join(fns.select("fn_id"), "fn_id", "left_semi")).groupBy("fn_id", "dim").agg(F.sum("value").alias("value"))
    fixed = every.where("dim not rlike '^(?:PARAM|VAR):'")
    m = vx.shape_metrics(fixed, ["fn_id"])
    metrics = vx.exploded(m, ["fn_id"], vx.packed({"VAL:SHAPE_ENTROPY": F.col("entropy"), "VAL:SHAPE_SPREAD": F.col("spread"), "VAL:SHAPE_SKEW": F.col("skew")}))
    both = every.union(metrics)
    norm = F.sqrt(F.sum(F.col("value") * F.col("value")).over(Window.partitionBy("fn_id")))
    return both.select("fn_id", "dim", F.round(F.col("value") / norm, 4).alias("value")).where("value <> 0")


def greedy_clusters(vec: DataFrame, least: float = 0.6) -> list[list]:
    """Ids grouped by average link: the first pair of groups, in order, whose mean cosine reaches ``least`` is merged, and
    again from the start. (id, dim, value) must have at most MOST_ITEMS ids, which is checked first."""
    if vec.select("id").distinct().limit(MOST_ITEMS + 1).count() > MOST_ITEMS:
        raise ValueError("too many items for sequential clustering")
    pdf = vec.toPandas().pivot_table(index="id", columns="dim", values="value", fill_value=0.0).sort_index()
    x = pdf.to_numpy()
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    sims = x @ x.T
    groups = [[k] for k in range(len(pdf))]
    while True:
        pair = next(((i, j) for i in range(len(groups)) for j in range(i + 1, len(groups)) if sims[np.ix_(groups[i], groups[j])].mean() >= least), None)
        if pair is None:
            return [[pdf.index[k] for k in g] for g in groups]
        i, j = pair
        groups[i] += groups.pop(j)


def similar_projects(composites: DataFrame, asked: DataFrame) -> DataFrame:
    """(asked, project, cosine) of unit vectors (project, dim, value) against those of the asked projects."""
    a = composites.join(asked.select("project").distinct(), "project", "left_semi").select(F.col("project").alias("asked"), "dim", F.col("value").alias("y"))
    sq = composites.groupBy("project").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("n"))
    dots = composites.join(a, "dim").groupBy("asked", "project").agg(F.sum(F.col("value") * F.col("y")).alias("p"))
    other = sq.select(F.col("project").alias("asked"), F.col("n").alias("m"))
    return dots.join(sq, "project").join(other, "asked").where("asked <> project").select("asked", "project", F.round(F.col("p") / (F.col("n") * F.col("m")), 4).alias("cosine"))


