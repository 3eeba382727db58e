"""What changed between full snapshots: Merkle-tree comparison of consecutive deliveries."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloam.session import bounded, cut

FANOUT_BITS = 4  # sixteen children per tree node
LEAF_ROWS = 16  # rows a leaf bucket should hold


def plain_target(col: str) -> Column:
    """Target without surrounding blanks and without a leading ``./``."""
    return F.regexp_replace(F.regexp_replace(F.col(col), r"^\s+|\s+$", ""), r"^\./", "")


def vector_entries(col: str) -> Column:
    """Sorted non-zero (dim, value) entries of a map, values rounded to 4 decimals; null gives no entries."""
    entries = F.transform(F.map_entries(F.col(col)), lambda e: F.struct(e["key"].alias("dim"), F.round(e["value"], 4).alias("value")))
    return F.array_sort(F.filter(F.coalesce(entries, F.array().cast("array<struct<dim:string,value:double>>")), lambda e: e["value"] != 0))


def valid_rows(snapshots: DataFrame, keep: list[Column]) -> DataFrame:
    """One row per (delivery_no, target): the latest ``loaded_at``, the higher ``snapshot_id`` on a tie.

    Rows without target or delivery are no records. ``keep`` is computed before the shuffle so that only it travels.
    """
    names = [f"k{i}" for i in range(len(keep))]
    shown = [str(c._jc.toString()).rsplit(" AS ", 1)[-1] for c in keep]
    rows = snapshots.select(F.col("delivery_no"), plain_target("target").alias("target"), F.struct("loaded_at", "snapshot_id").alias("rank"), *[c.alias(n) for c, n in zip(keep, names)])
    best = rows.where("delivery_no is not null and target is not null").groupBy("delivery_no", "target").agg(F.max_by(F.struct("rank", *names), "rank").alias("r"))
    return best.select("delivery_no", "target", F.col("r.rank.snapshot_id").alias("snapshot_id"), *[F.col(f"r.{n}").alias(s) for n, s in zip(names, shown)])


def content_digest() -> list[Column]:
    """128 bits over enriched, the set of vuln_types and complexity in their plain forms."""
    kinds = F.array_sort(F.array_distinct(F.filter(F.coalesce(F.col("vuln_types"), F.array().cast("array<string>")), lambda x: x.isNotNull())))
    growth = F.coalesce(F.lower(F.regexp_replace("complexity", r"\s+", "")), F.lit("<null>"))
    parts = (vector_entries("enriched"), kinds, growth)
    return [F.xxhash64(F.lit(1), *parts).alias("d1"), F.xxhash64(F.lit(2), *parts).alias("d2")]


def _tree(leaves: DataFrame, depth: int) -> DataFrame:
    """(delivery_no, level, node, digest) of every tree node, the root at level 0.

    A node's digest is the xor over its leaves' (node, digest) hashes, so all levels come from one aggregation that
    combines map-side.
    """
    up = F.explode(F.sequence(F.lit(0), F.lit(depth)))
    nodes = leaves.select("delivery_no", F.xxhash64("node", "digest").alias("h"), "node", up.alias("level"))
    nodes = nodes.withColumn("node", F.expr(f"shiftrightunsigned(node, {FANOUT_BITS} * ({depth} - level))"))
    return nodes.groupBy("delivery_no", "level", "node").agg(F.bit_xor("h").alias("digest"))


def snapshot_changes(snapshots: DataFrame, deliveries: DataFrame, rows_hint: int | None = None) -> DataFrame:
    """(delivery_no, target, change_kind): targets added, removed or changed since the listed delivery before.

    Keys fall into hash ranges, the leaves of a tree of digests per delivery. Trees of consecutive deliveries are
    compared from the root down and only rows of leaves whose digests differ are compared one by one. The tree has
    about ``rows / LEAF_ROWS`` leaves, so digests stay a small share of the input at any size.

    Deliveries not listed are ignored; a listed delivery without rows removes everything. Null or empty maps, null
    lists, explicit zeros, repeated list entries, tails beyond 4 decimals and the spelling of complexity make no
    change; null complexity differs from any text. Superseded and repeated rows are dropped; of equal ``loaded_at``
    the higher ``snapshot_id`` holds. Other columns are ignored. Empty tables give an empty result.
    """
    rows_hint = snapshots.count() if rows_hint is None else rows_hint
    depth = min(8, max(1, round(math.log(max(rows_hint, 1) / LEAF_ROWS + 1, 1 << FANOUT_BITS))))
    listed = deliveries.select("delivery_no").where("delivery_no is not null").distinct()
    steps = listed.select(F.lag("delivery_no").over(Window.orderBy("delivery_no")).alias("before"), F.col("delivery_no").alias("after")).where("before is not null")
    steps = bounded(steps)

    state = valid_rows(snapshots, content_digest()).withColumn("node", F.shiftrightunsigned(F.xxhash64("target"), 64 - FANOUT_BITS * depth))
    state = cut(state.select("delivery_no", "target", "node", "d1", "d2"))
    leaves = state.groupBy("delivery_no", "node").agg(F.bit_xor(F.xxhash64("target", "d1", "d2")).alias("digest"))

    tree = cut(_tree(leaves, depth))
    differing = None
    for level in range(depth + 1):
        at = tree.where(F.col("level") == level)
        after = at.join(steps, at.delivery_no == steps.after).select("after", "node", F.col("digest").alias("new"), F.lit(None).cast("bigint").alias("old"))
        before = at.join(steps, at.delivery_no == steps.before).select("after", "node", F.lit(None).cast("bigint").alias("new"), F.col("digest").alias("old"))
        both = after.union(before)
        if differing is not None:
            up = differing.select("after", F.col("node").alias("up"))
            both = both.withColumn("up", F.shiftrightunsigned("node", FANOUT_BITS)).join(up, ["after", "up"], "left_semi").drop("up")
        differing = cut(both.groupBy("after", "node").agg(F.max("new").alias("new"), F.max("old").alias("old")).where("not (new <=> old)").select("after", "node"))

    # a row of a differing leaf takes part as the new side of its own delivery and as the old side of the next
    sides = F.explode(F.array(F.struct(F.col("to_it").alias("after"), F.lit(True).alias("is_new")), F.struct(F.col("from_it").alias("after"), F.lit(False).alias("is_new"))))
    ways = bounded(listed.join(steps.select(F.col("after").alias("delivery_no"), F.col("after").alias("to_it")), "delivery_no", "left").join(steps.select(F.col("before").alias("delivery_no"), F.col("after").alias("from_it")), "delivery_no", "left"))
    rows = state.join(ways, "delivery_no").select("target", "node", "d1", "d2", sides.alias("side")).select("target", "node", "d1", "d2", "side.after", "side.is_new").where("after is not null")
    rows = rows.join(differing, ["after", "node"], "left_semi")
    digest = F.struct("d1", "d2")
    pairs = rows.groupBy("after", "target").agg(F.max(F.when(F.col("is_new"), digest)).alias("new"), F.max(F.when(~F.col("is_new"), digest)).alias("old")).where("not (new <=> old)")
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed")
    return pairs.select(F.col("after").cast("int").alias("delivery_no"), "target", kind.alias("change_kind"))
