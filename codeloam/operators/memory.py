"""Snapshots over time: latest, bounded history, differences and how far they cascade."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloam.functions import rules
from codeloam.operators.snapshot_diff import plain_target

DIM = "array<struct<dim:string,value:double>>"


def snapshots_of(table: DataFrame) -> DataFrame:
    """Distinct snapshots with plain target and complexity; maps as sorted entries, lists as sorted sets."""
    entries = lambda c: F.array_sort(F.filter(F.transform(F.map_entries(F.coalesce(F.col(c), F.create_map().cast("map<string,double>"))), lambda e: F.struct(e["key"].alias("dim"), F.round(e["value"], 4).alias("value"))), lambda e: e["value"] != 0))
    names = lambda c: F.array_sort(F.array_distinct(F.filter(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: x.isNotNull())))
    growth = F.lower(F.regexp_replace("complexity", r"\s+", ""))
    return table.where("target is not null").select(
        "snapshot_id", "delivery_no", plain_target("target").alias("target"), "loaded_at", growth.alias("complexity"),
        F.when(F.size(entries("enriched")) > 0, entries("enriched")).otherwise(entries("composite")).alias("vec"), entries("type_profile").alias("types"),
        names("algorithms").alias("algorithms"), names("patterns").alias("patterns"), names("vuln_types").alias("vulns"),
        F.coalesce("type_flow.propagations", F.lit(0)).alias("propagations"), F.coalesce("type_flow.type_errors", F.lit(0)).alias("type_errors"),
    ).dropDuplicates(["snapshot_id", "target", "delivery_no", "loaded_at"])


def history(snaps: DataFrame, most: int = rules.HISTORY) -> DataFrame:
    """The last ``most`` snapshots of each target with their place from the end, 1 the latest."""
    w = Window.partitionBy("target").orderBy(F.desc("delivery_no"), F.desc("loaded_at"), F.desc("snapshot_id"))
    return snaps.withColumn("back", F.row_number().over(w)).where(F.col("back") <= most)


def consecutive(snaps: DataFrame) -> DataFrame:
    """Each snapshot with the one of its target before it under ``old``; the first of a target is left out."""
    cols = [c for c in snaps.columns if c != "target"]
    w = Window.partitionBy("target").orderBy("delivery_no", "loaded_at", "snapshot_id")
    return snaps.select("target", *cols, F.lag(F.struct(*cols)).over(w).alias("old")).where("old is not null")


def _changed(old: Column, new: Column) -> tuple[Column, Column]:
    """(changed dims, all dims) of two entry arrays; missing dims are 0."""
    dims = F.array_union(F.transform(old, lambda e: e["dim"]), F.transform(new, lambda e: e["dim"]))
    a, b = F.map_from_entries(old), F.map_from_entries(new)
    deltas = F.transform(dims, lambda d: F.struct(d.alias("dim"), F.coalesce(F.try_element_at(a, d), F.lit(0.0)).alias("old_value"), F.coalesce(F.try_element_at(b, d), F.lit(0.0)).alias("new_value")))
    return F.filter(deltas, lambda x: F.abs(x["new_value"] - x["old_value"]) > 1e-9), dims


def _gained(new: Column, old: Column) -> Column:
    return F.array_sort(F.array_except(new, old))


def direction(old: Column, new: Column) -> Column:
    order = F.array(*[F.lit(c.replace(" ", "").lower()) for c in rules.COMPLEXITIES])
    a, b = F.array_position(order, old), F.array_position(order, new)
    return F.when(old.isNull() | new.isNull() | (old == new) | (a == 0) | (b == 0), "same").when(b < a, "improved").otherwise("degraded")


def diffs(snaps: DataFrame) -> DataFrame:
    """One row per consecutive pair of a target's snapshots: what changed, gains and losses, cascade score and verdict."""
    p = consecutive(snaps)
    changed, dims = _changed(F.col("old.vec"), F.col("vec"))
    types, _ = _changed(F.col("old.types"), F.col("types"))
    p = p.select(
        "target", F.col("old.snapshot_id").alias("old_id"), F.col("snapshot_id").alias("new_id"), changed.alias("changed"), F.size(dims).alias("dims"), F.size(types).alias("type_changes"),
        _gained(F.col("algorithms"), F.col("old.algorithms")).alias("algorithms_gained"), _gained(F.col("old.algorithms"), F.col("algorithms")).alias("algorithms_lost"),
        _gained(F.col("patterns"), F.col("old.patterns")).alias("patterns_gained"), _gained(F.col("old.patterns"), F.col("patterns")).alias("patterns_lost"),
        _gained(F.col("vulns"), F.col("old.vulns")).alias("vulns_gained"), _gained(F.col("old.vulns"), F.col("vulns")).alias("vulns_fixed"),
        (~F.col("old.complexity").eqNullSafe(F.col("complexity"))).alias("complexity_changed"), direction(F.col("old.complexity"), F.col("complexity")).alias("complexity_direction"),
        ((F.col("old.propagations") != F.col("propagations")) | (F.col("old.type_errors") != F.col("type_errors"))).alias("flow_changed"), "type_errors",
    )
    sets = ["algorithms_gained", "algorithms_lost", "patterns_gained", "patterns_lost", "vulns_gained", "vulns_fixed"]
    events = sum((F.size(c) for c in sets), F.lit(0)) + F.when(F.col("complexity_changed"), 2).otherwise(0)
    one = F.lit(1.0)
    score = 0.45 * F.least(F.size("changed") / F.greatest("dims", F.lit(1)), one) + 0.25 * F.least(events / 10.0, one) + 0.2 * F.least(F.col("type_changes") / 8.0, one) + 0.1 * F.when(F.col("flow_changed"), 1.0).otherwise(0.0)
    p = p.withColumn("cascade", F.round(F.round(score, 9), 3))
    verdict = (
        F.when((F.size("changed") == 0) & (events == 0) & (F.col("type_changes") == 0), "none")
        .when(F.size("vulns_gained") > 0, "vulnerable")
        .when(F.col("complexity_direction") != "same", F.col("complexity_direction"))
        .when(F.size("vulns_fixed") > 0, "fixed")
        .when(F.col("type_errors") > 0, "type errors")
        .when(F.col("flow_changed"), "type flow")
        .when(F.col("cascade") > 0.5, "major")
        .when(F.col("cascade") > 0.2, "moderate")
        .otherwise("minor")
    )
    return p.withColumn("verdict", verdict)


def slug(target: Column) -> Column:
    """File name of a target's history: a plain prefix of 40 characters and eight digits of its hash."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(target, r"[^A-Za-z0-9_\-.]", "_"), "_+", "_"), "^_|_$", "")
    return F.concat(F.substring(plain, 1, 40), F.lit("_"), F.substring(F.sha1(target), 1, 8))
