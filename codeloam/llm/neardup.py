"""Near-duplicate records with small edits: an LSH forest over MinHash labels, exact checks, classes of equal records."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloam.operators.components import connected_components
from codeloam.session import cut, drop, spread

TOKEN = re.compile(r"[A-Za-z_][A-Za-z0-9_]*|[0-9]+|\S")
SHINGLE = 3  # consecutive tokens
TREES = 64
DEPTHS = (4, 5, 6)  # label lengths; a region goes deeper while it holds more than CROWD records
CROWD = 256


def shingles(text: str | None, size: int = SHINGLE, words: bool = False) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct runs of ``size`` tokens, or of blank-separated words."""
    t = (text.split() if words else TOKEN.findall(text)) if text else []
    runs = {" ".join(t[k : k + size]) for k in range(len(t) - size + 1)}
    return np.sort(np.fromiter((xxhash.xxh64_intdigest(r) for r in runs), np.uint64, len(runs)))


class Forest:
    """The hash functions of the label orders: ``trees`` sequences of MinHash values, cut at ``depths``."""

    def __init__(self, trees: int, depths: tuple[int, ...]) -> None:
        rng = np.random.default_rng(20310303)
        n = trees * depths[-1]
        self.trees, self.depths = trees, depths
        self.mult = rng.integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.add = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        self.mix = rng.integers(1, 1 << 63, (2, trees, depths[-1]), dtype=np.uint64) | np.uint64(1)

    def labels(self, s: np.ndarray) -> np.ndarray:
        """Keys of the record's prefix in every tree at every depth, depth by depth."""
        low = np.full(len(self.mult), np.iinfo(np.uint64).max, np.uint64)
        for k in range(0, len(s), 512):
            x = s[k : k + 512, None] * self.mult + self.add
            x ^= x >> np.uint64(33)
            np.minimum(low, x.min(axis=0), out=low)
        low = low.reshape(self.trees, self.depths[-1])
        run = np.cumsum((low ^ (low >> np.uint64(29))) * self.mix[0] + self.mix[1], axis=1, dtype=np.uint64)
        keys = run[:, [d - 1 for d in self.depths]].T  # (depth, tree)
        keys = (keys ^ (keys >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) + np.arange(self.trees, dtype=np.uint64)
        return keys.reshape(-1).view(np.int64)


RECORD = "id bigint, c1 bigint, c2 bigint, n int, m0 bigint, m1 bigint, shingles array<bigint>"


def marks(s: np.ndarray) -> np.ndarray:
    """Two words with a bit for each of 128 parts of the hashes, set if an odd number of shingles falls there.

    Sets differ in at least as many shingles as their marks do in bits.
    """
    return np.packbits(np.bincount((s & np.uint64(127)).astype(np.int64), minlength=128).astype(np.uint8) & 1).view(np.int64)


def _records(rows: DataFrame, id_col: str, text_col: str, shingle: int, words: bool) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sets = [shingles(t, shingle, words) for t in pdf["text"]]
            c = [(xxhash.xxh64_intdigest(s.tobytes(), 1), xxhash.xxh64_intdigest(s.tobytes(), 2)) for s in sets]
            c = np.array(c, np.uint64).reshape(-1, 2).view(np.int64)
            m = np.array([marks(s) for s in sets], np.int64).reshape(-1, 2)
            yield pd.DataFrame({"id": pdf["id"], "c1": c[:, 0], "c2": c[:, 1], "n": [len(s) for s in sets], "m0": m[:, 0], "m1": m[:, 1], "shingles": [s.view(np.int64) for s in sets]})

    src = rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    return spread(src, "id").mapInPandas(run, RECORD).where("n > 0")


def _regions(classes: DataFrame, trees: int, depths: tuple[int, ...], d: int) -> DataFrame:
    """(cls, up, key): the class's regions in every tree at depth ``d``, and the regions above that they lie in.

    Labels are made where they are asked for; kept with the classes they would be the largest part of what is written.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forest = Forest(trees, depths)
        for pdf in batches:
            for k in range(0, len(pdf), 1_024):
                part = pdf.iloc[k : k + 1_024]
                labels = np.array([forest.labels(np.asarray(s, np.int64).view(np.uint64)) for s in part["shingles"]]).reshape(len(part), len(depths), trees)
                yield pd.DataFrame({"cls": np.repeat(part["cls"].to_numpy(), trees), "up": labels[:, max(0, d - 1)].reshape(-1), "key": labels[:, d].reshape(-1)})

    return classes.select("cls", "shingles").mapInPandas(run, "cls bigint, up bigint, key bigint")


def _may_reach(least: tuple[int, int]) -> Column:
    """If the sets a and b may reach ``least``, by their sizes and marks; exact in that no pair that does is left out."""
    num, den = least
    differ = "greatest(abs(na - nb), bit_count(a0 ^ b0) + bit_count(a1 ^ b1))"
    return F.expr(f"(na + nb - {differ}) * {num + den} >= {2 * num} * (na + nb)")


def _pairs_on(rows: DataFrame, key: str, marked: DataFrame, least: tuple[int, int]) -> DataFrame:
    """Distinct (a, b), a < b, of the classes in ``rows`` (``key``, cls) that share a key and may reach ``least``."""
    rows = rows.select(key, "cls").join(marked, "cls")
    a, b = (rows.select(key, F.col("cls").alias(c), F.col("n").alias(f"n{c}"), F.col("m0").alias(f"{c}0"), F.col("m1").alias(f"{c}1")) for c in "ab")
    return a.join(b, key).where(F.col("a") < F.col("b")).where(_may_reach(least)).select("a", "b").distinct()


def _candidates(classes: DataFrame, trees: int, depths: tuple[int, ...], least: tuple[int, int]) -> list[DataFrame]:
    """Cut tables of (a, b), a < b, that share a region of some tree and may reach ``least``; crowded regions are split by
    longer labels.

    Splitting may part a pair in every tree, so classes of crowded regions are joined exactly as well.
    """
    marked = classes.select("cls", "n", "m0", "m1")
    rows, last, out = _regions(classes, trees, depths, 0), None, []
    for d in range(len(depths)):
        now = cut(rows.select("cls", "key").withColumn("size", F.count("*").over(Window.partitionBy("key"))).where("size > 1"))
        if last is not None:
            drop(last)
        last, crowd = now, now.where(F.col("size") > CROWD)
        out.append(cut(_pairs_on(now.where(F.col("size") <= CROWD), "key", marked, least)))
        if d == len(depths) - 1 or crowd.isEmpty():
            break
        inside = classes.join(crowd.select("cls").distinct(), "cls", "left_semi")
        if d == 0:
            out.append(cut(_prefix_pairs(inside, least, marked)))
        rows = _regions(inside, trees, depths, d + 1).join(crowd.select(F.col("key").alias("up")).distinct(), "up", "left_semi")
    drop(last)
    return out


def _prefix_pairs(classes: DataFrame, least: tuple[int, int], marked: DataFrame | None = None) -> DataFrame:
    """All (a, b) that may reach ``least``: such a pair shares one of the rarest shingles of either, as many of them as
    may differ, plus one; with ``marked`` sizes and marks are asked as well."""
    num, den = least
    all_of = classes.select("cls", "n", F.explode("shingles").alias("x"))
    rank = all_of.join(all_of.groupBy("x").agg(F.count("*").alias("df")), "x")
    kept = rank.groupBy("cls").agg(F.slice(F.array_sort(F.collect_list(F.struct("df", "x"))), F.lit(1), F.max(F.expr(f"cast(n - ceil(n * {num} / {den}) + 1 as int)"))).alias("rare"))
    prefix = kept.select("cls", F.explode("rare").alias("r")).where("r.df > 1").select("cls", "r.x")
    if marked is not None:
        return _pairs_on(prefix, "x", marked, least)
    a, b = prefix.select("x", F.col("cls").alias("a")), prefix.select("x", F.col("cls").alias("b"))
    return a.join(b, "x").where("a < b").select("a", "b").distinct()


def near_duplicates(rows: DataFrame, id_col: str, text_col: str, least: tuple[int, int] = (3, 5), shingle: int = SHINGLE, words: bool = False, trees: int = TREES, depths: tuple[int, ...] = DEPTHS) -> tuple[DataFrame, DataFrame]:
    """(members, links): members (id, cls) of every record, links (a, b, similarity) between classes.

    Records with the same set of shingles form a class, named by its smallest id, so copies of any number are one
    record from here on. A class has a label per tree, a sequence of MinHash values; classes that share the first
    ``depths[0]`` values in any of ``trees`` orders are candidates. Where more than CROWD share them the region is split by
    longer labels, and its classes are joined exactly. Candidates whose sizes and marks show that they differ too much are
    left out before they are moved; the others are checked on the whole shingle sets: similarity is shared over all
    shingles, kept at ``least`` (numerator, denominator) or more. Tables of finished steps are deleted.

    With the defaults a pair at the limit of 0.6 is missed with probability (1 - 0.6^4)^64 = 0.00014, a nearer one less often.
    Null ids, null texts and texts without a shingle take no part; repeated rows count once; equal texts under other
    ids are members of one class; empty tables give empty results; other columns are ignored.
    """
    records = cut(_records(rows, id_col, text_col, shingle, words))
    ids = records.select("id", "c1", "c2").distinct()
    heads = ids.groupBy("c1", "c2").agg(F.min("id").alias("cls"))
    members = cut(ids.join(heads, ["c1", "c2"]).select("id", "cls"))
    classes = cut(records.join(heads.select(F.col("cls").alias("id")), "id", "left_semi").dropDuplicates(["id"]).select(F.col("id").alias("cls"), "n", "m0", "m1", "shingles"))
    drop(records)
    found = _candidates(classes, trees, depths, least)
    pairs = reduce(DataFrame.union, found).distinct()
    sets = classes.select("cls", "n", "shingles")
    left = sets.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("sb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", F.size(F.array_intersect("sa", "sb")).alias("shared"))
    num, den = least
    kept = both.withColumn("either", F.expr("na + nb - shared")).where(f"shared * {den} >= either * {num}")
    links = cut(kept.select("a", "b", F.expr("shared / either").alias("similarity")))
    drop(classes, *found)
    return members, links


def pairs_of(members: DataFrame, links: DataFrame) -> DataFrame:
    """All (a, b), a < b, of record ids: within classes and across linked ones."""
    m, o = members.select("cls", F.col("id").alias("x")), members.select(F.col("cls").alias("cls2"), F.col("id").alias("y"))
    within = m.join(o, m.cls == o.cls2).where("x < y").select("x", "y")
    across = links.join(m, links.a == m.cls).join(o, F.col("b") == F.col("cls2")).select("x", "y")
    return within.union(across).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def groups_of(members: DataFrame, links: DataFrame) -> DataFrame:
    """(id, class_id, links, group_id) of every record: its class, its class's links and the group they join."""
    parts = connected_components(links)
    degree = links.select(F.explode(F.array("a", "b")).alias("cls")).groupBy("cls").agg(F.count("*").alias("links"))
    out = members.join(degree, "cls", "left").join(parts.withColumnRenamed("node", "cls"), "cls", "left")
    return out.select("id", F.col("cls").alias("class_id"), F.coalesce("links", F.lit(0)).cast("bigint").alias("links"), F.coalesce("component", "cls").alias("group_id"))
