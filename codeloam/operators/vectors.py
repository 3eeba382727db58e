"""Sparse vectors in long form (id, dim, value): norms, similarity, metrics, top dims, merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloam.functions.rules import SHAPE_KEYS


def packed(dims: dict[str, Column]) -> Column:
    """Non-zero dims of a row as an array of (dim, value), normalised in the row and without a shuffle."""
    return F.filter(F.array(*[F.struct(F.lit(d).alias("dim"), c.cast("double").alias("value")) for d, c in dims.items()]), lambda e: e["value"] != 0)


def _scaled(df: DataFrame, ids: list[str], entries: Column, norm, digits: int | None) -> DataFrame:
    """(ids, vec): entries over their norm. Entries and norm are columns of their own, so each is computed once a row."""
    df = df.select(*ids, entries.alias("_e"))
    df = df.select(*ids, "_e", norm(F.col("_e")).alias("_n"))
    value = lambda e: F.round(e["value"] / F.col("_n"), digits) if digits is not None else e["value"] / F.col("_n")
    scaled = F.transform("_e", lambda e: F.struct(e["dim"].alias("dim"), value(e).alias("value")))
    return df.select(*ids, F.filter(scaled, lambda e: e["value"] != 0).alias("vec"))


def l2(df: DataFrame, ids: list[str], entries: Column, digits: int | None = 4) -> DataFrame:
    return _scaled(df, ids, entries, lambda x: F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, e: a + e["value"] * e["value"])), digits)


def l1(df: DataFrame, ids: list[str], entries: Column, digits: int = 4) -> DataFrame:
    return _scaled(df, ids, entries, lambda x: F.aggregate(x, F.lit(0.0), lambda a, e: a + e["value"]), digits)


def unit_rows(df: DataFrame, ids: list[str], entries: Column, digits: int | None = 4) -> DataFrame:
    """Long form of :func:`l2`."""
    return exploded(l2(df, ids, entries, digits), ids, F.col("vec"))


def share_rows(df: DataFrame, ids: list[str], entries: Column) -> DataFrame:
    """Long form of :func:`l1`."""
    return exploded(l1(df, ids, entries), ids, F.col("vec"))


def exploded(df: DataFrame, ids: list[str], entries: Column) -> DataFrame:
    """One row per entry. The outer form spares the filter on the size of the array that the optimizer would add to the
    plain one, which would compute the array again; empty arrays are dropped after."""
    return df.select(*ids, F.explode_outer(entries).alias("e")).where("e is not null").select(*ids, "e.dim", "e.value")


def with_top_names(df: DataFrame, name: str, entries: Column, order: list[str], n: int, empty: str = "EMPTY") -> DataFrame:
    """``df`` with the ``n`` greatest dims joined by ``>`` under ``name``; ties keep the vocabulary's order."""
    rank = F.create_map(*[x for k, d in enumerate(order) for x in (F.lit(d), F.lit(k))])
    df = df.withColumn("_e", entries)
    df = df.withColumn("_r", F.array_sort(F.transform("_e", lambda e: F.struct((-e["value"]).alias("v"), rank[e["dim"]].alias("o"), e["dim"].alias("dim")))))
    top = F.when(F.size("_e") > 0, F.array_join(F.transform(F.slice("_r", 1, n), lambda x: x["dim"]), ">")).otherwise(empty)
    return df.withColumn(name, top).drop("_e", "_r")


def cosine_of(a: Column, b: Column) -> Column:
    """Cosine of two entry arrays."""
    lookup = F.map_from_entries(b)
    dot = F.aggregate(a, F.lit(0.0), lambda acc, e: acc + e["value"] * F.coalesce(F.try_element_at(lookup, e["dim"]), F.lit(0.0)))
    sq = lambda x: F.aggregate(x, F.lit(0.0), lambda acc, e: acc + e["value"] * e["value"])
    return F.when((sq(a) > 0) & (sq(b) > 0), dot / F.sqrt(sq(a) * sq(b))).otherwise(0.0)


def top_per_family(vec: DataFrame, ids: list[str], n: int) -> DataFrame:
    """The ``n`` greatest dims of every family, the part of a dim before its colon; ties by name."""
    fam = vec.withColumn("family", F.substring_index("dim", ":", 1))
    w = Window.partitionBy(*ids, "family").orderBy(F.desc("value"), "dim")
    return fam.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def shape_metrics(vec: DataFrame, ids: list[str], keys: int = SHAPE_KEYS) -> DataFrame:
    """Entropy in bits of the dims' shares, share of dims present, and (max - mean) / deviation with absent dims as 0."""
    w = F.abs("value")
    agg = vec.where("value <> 0").groupBy(*ids).agg(F.sum(w).alias("s"), F.sum(w * w).alias("q"), F.max(w).alias("m"), F.sum(w * F.log2(w)).alias("l"), F.count("*").alias("n"))
    mean = F.col("s") / keys
    deviation = F.sqrt(F.greatest(F.col("q") / keys - mean * mean, F.lit(0.0)))
    return agg.select(
        *ids,
        F.round(F.log2("s") - F.col("l") / F.col("s"), 4).alias("entropy"),
        F.round(F.col("n") / keys, 4).alias("spread"),
        F.round(F.when(deviation > 0, (F.col("m") - mean) / deviation).otherwise(0.0), 4).alias("skew"),
    )
