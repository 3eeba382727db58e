"""Similarity of code: penalised cosines, search for clones, outliers, correlations of dims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloam.functions import rules
from codeloam.session import bounded


def polarity_penalty(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Penalty for opposite operations of two snippets, each pair and direction, up to a limit."""
    hits = sum((((a[x] > 0) & (b[y] > 0)).cast("int") + ((a[y] > 0) & (b[x] > 0)).cast("int") for x, y in rules.OPPOSITES), F.lit(0))
    return F.least(F.lit(rules.OPPOSITE_MOST), hits * rules.OPPOSITE_PENALTY)


_NEAR = ["==", "!=", ">", "<", ">=", "<=", "%", "+", "-", "*", "/"]


def literals_near_operators(toks: Column) -> Column:
    """Sorted distinct numbers right beside an operator."""
    edge = F.array(F.lit(""))
    shifted = F.zip_with(F.concat(edge, toks), F.concat(F.slice(toks, 2, F.greatest(F.size(toks) - 1, F.lit(0))), edge), lambda before, after: F.struct(before.alias("before"), after.alias("after")))
    near = F.zip_with(toks, shifted, lambda t, s: F.when(t.rlike(r"^\d+(?:\.\d+)?$") & (s["before"].isin(*_NEAR) | s["after"].isin(*_NEAR)), t))
    return F.array_sort(F.array_distinct(F.filter(near, lambda x: x.isNotNull())))


def literal_penalty(a: Column, b: Column) -> Column:
    """Penalty where both use numbers beside operators and not the same ones."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0) & (a != b), rules.LITERAL_PENALTY).otherwise(0.0)


def outliers(vec: DataFrame, k: float = 2.0) -> DataFrame:
    """(id, score, is_outlier): distance to the centroid over all dims, missing ones 0; outliers lie beyond mean + k deviations.

    |v - c|^2 is |v|^2 - 2 v.c + |c|^2, so the centroid, one row per dim, joins only the dims that a vector has.
    """
    n = vec.select("id").distinct().agg(F.count("*").alias("n"))
    centre = vec.groupBy("dim").agg((F.sum("value") / F.first(n.scalar())).alias("c"))
    length = centre.agg(F.sum(F.col("c") * F.col("c")).alias("cc"))
    per = vec.join(bounded(centre), "dim").groupBy("id").agg(F.sum(F.col("value") * F.col("value")).alias("vv"), F.sum(F.col("value") * F.col("c")).alias("vc"))
    far = per.select("id", F.sqrt(F.greatest(F.lit(0.0), F.col("vv") - 2 * F.col("vc") + length.scalar())).alias("score"))
    limit = far.agg((F.avg("score") + k * F.stddev_pop("score")).alias("limit"))
    return far.select("id", F.round("score", 6).alias("score"), (F.col("score") > limit.scalar()).alias("is_outlier"))


def correlations(vec: DataFrame, least: float) -> DataFrame:
    """(dim_a, dim_b, r): pairs of dims whose Pearson correlation over all ids, missing dims 0, is at least ``least`` in size."""
    n = vec.select("id").distinct().agg(F.count("*").cast("double").alias("n"))
    one = vec.groupBy("dim").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q")).withColumn("n", n.scalar())
    one = one.select("dim", "s", "n", F.sqrt(F.col("n") * F.col("q") - F.col("s") * F.col("s")).alias("d")).where("d > 0")
    a, b = vec.select("id", F.col("dim").alias("dim_a"), F.col("value").alias("x")), vec.select("id", F.col("dim").alias("dim_b"), F.col("value").alias("y"))
    dots = a.join(b, "id").where("dim_a < dim_b").groupBy("dim_a", "dim_b").agg(F.sum(F.col("x") * F.col("y")).alias("p"))
    l = one.select(F.col("dim").alias("dim_a"), F.col("s").alias("sa"), F.col("d").alias("da"), "n")
    r = one.select(F.col("dim").alias("dim_b"), F.col("s").alias("sb"), F.col("d").alias("db"))
    out = dots.join(l, "dim_a").join(r, "dim_b").select("dim_a", "dim_b", F.round((F.col("n") * F.col("p") - F.col("sa") * F.col("sb")) / (F.col("da") * F.col("db")), 6).alias("r"))
    return out.where(F.abs("r") >= least)


def threshold_sweep(scored: DataFrame, steps: int = 20) -> DataFrame:
    """(threshold, tp, fp, fn, precision, recall, f1) of scores (score in 0..1, truth) at even thresholds; one pass over bins."""
    bins = scored.select(F.least(F.lit(steps), F.floor(F.col("score") * steps + 1e-9)).cast("int").alias("bin"), F.col("truth").cast("int").alias("t")).groupBy("bin").agg(F.sum("t").alias("pos"), F.sum(1 - F.col("t")).alias("neg"))
    ticks = scored.sparkSession.range(steps + 1).select(F.col("id").cast("int").alias("bin"))
    full = ticks.join(bins, "bin", "left").na.fill(0)
    w = Window.orderBy(F.desc("bin"))
    cum = full.select("bin", F.sum("pos").over(w).alias("tp"), F.sum("neg").over(w).alias("fp"), F.sum("pos").over(Window.partitionBy()).alias("all_pos"))
    cum = cum.select(F.round(F.col("bin") / steps, 4).alias("threshold"), "tp", "fp", (F.col("all_pos") - F.col("tp")).alias("fn"))
    return cum.withColumn("precision", F.round(F.try_divide("tp", F.col("tp") + F.col("fp")), 6)).withColumn("recall", F.round(F.try_divide("tp", F.col("tp") + F.col("fn")), 6)).withColumn("f1", F.round(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), 6))

# fixed values: opposite operations of the operation model, and its penalties
MODEL_OPPOSITES = [("P:COMPARE:PRED_GT", "P:COMPARE:PRED_LT"), ("P:COMPARE:PRED_MOD0", "P:COMPARE:PRED_MOD1"), ("P:TRANSFORM:ARITH_ADD", "P:TRANSFORM:ARITH_SUB"), ("P:TRANSFORM:ARITH_MUL", "P:TRANSFORM:ARITH_DIV")]


def model_similarity(a: Column, b: Column, text_a: Column, text_b: Column) -> Column:
    """0.6 cosine with operations twice as heavy plus 0.4 overlap of dims, less penalties for opposites, never below 0.

    ``a`` and ``b`` are entry arrays of the operation model, the texts the normalised code. One counting up where the
    other resets is a penalty of its own; all penalties together are at most 0.5.
    """
    weight = lambda d: F.when(d.startswith("P:"), 2.0).otherwise(1.0)
    mb = F.map_from_entries(b)
    dot = F.aggregate(a, F.lit(0.0), lambda s, e: s + weight(e["dim"]) * e["value"] * F.coalesce(F.try_element_at(mb, e["dim"]), F.lit(0.0)))
    sq = lambda x: F.aggregate(x, F.lit(0.0), lambda s, e: s + weight(e["dim"]) * e["value"] * e["value"])
    cos = F.when((sq(a) > 0) & (sq(b) > 0), dot / F.sqrt(sq(a) * sq(b))).otherwise(0.0)
    da, db = F.transform(a, lambda e: e["dim"]), F.transform(b, lambda e: e["dim"])
    overlap = F.when(F.size(F.array_union(da, db)) == 0, 1.0).otherwise(F.size(F.array_intersect(da, db)) / F.size(F.array_union(da, db)))
    has = lambda s, d: F.array_contains(s, d).cast("int")
    hits = sum((has(da, x) * has(db, y) + has(da, y) * has(db, x) for x, y in MODEL_OPPOSITES), F.lit(0))
    up = lambda t: t.rlike(r"\+=|\+ 1|\+1")
    reset = lambda t: t.rlike("= 0|=0")
    against = (up(text_a) & reset(text_b)) | (reset(text_a) & up(text_b))
    penalty = F.least(F.lit(0.5), 0.25 * hits + F.when(against, 0.3).otherwise(0.0))
    return F.greatest(F.lit(0.0), 0.6 * cos + 0.4 * overlap - penalty)


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all members of two sets; two empty sets are alike."""
    return F.when(F.size(F.array_union(a, b)) == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def flow_sets(edges: DataFrame) -> DataFrame:
    """(fn_id, calls, kinds): the names a text calls, and its data edges with names left out: kind and ends by class."""
    end = lambda c: F.when(F.col(c).startswith("call:"), F.col(c)).when(F.col(c).isin("return", "param"), F.col(c)).otherwise("name")
    return edges.groupBy("fn_id").agg(
        F.array_sort(F.collect_set(F.when(F.col("dst").startswith("call:"), F.col("dst")))).alias("calls"),
        F.array_sort(F.collect_set(F.concat_ws(">", end("src"), "kind", end("dst")))).alias("kinds"),
    )


def flow_similarity(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` (first_id, second_id, base) with ``flow``: 0.3 overlap of calls, 0.3 of data edges, 0.4 of ``base``."""
    a = sets.select(F.col("fn_id").alias("first_id"), F.col("calls").alias("c1"), F.col("kinds").alias("k1"))
    b = sets.select(F.col("fn_id").alias("second_id"), F.col("calls").alias("c2"), F.col("kinds").alias("k2"))
    both = pairs.join(a, "first_id").join(b, "second_id")
    return both.select("first_id", "second_id", F.round(0.3 * jaccard(F.col("c1"), F.col("c2")) + 0.3 * jaccard(F.col("k1"), F.col("k2")) + 0.4 * F.col("base"), 4).alias("flow"))
