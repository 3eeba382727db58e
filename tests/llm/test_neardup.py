import os
import random

import numpy as np
from pyspark.sql import functions as F

from codeloam.llm import neardup
from codeloam.session import CLEAN, cut

ROWS = "fn_id bigint, full_code string, cls bigint, key bigint, n int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], ROWS)


def sets(rows):
    return {i: set(neardup.shingles(t).tolist()) for i, t in rows if t and i is not None}


def brute(rows, num=3, den=5):
    s = {i: x for i, x in sets(rows).items() if x}
    return {(a, b) for a in s for b in s if a < b and len(s[a] & s[b]) * den >= len(s[a] | s[b]) * num}


def edited(rng, words, n):
    w = list(words)
    for _ in range(n):
        k = rng.randrange(len(w))
        rng.choice([lambda: w.pop(k), lambda: w.insert(k, f"n{rng.random():.5f}"), lambda: w.__setitem__(k, "z")])()
    return " ".join(w)


def test_pairs_against_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for f in range(25):
        base = [f"v{rng.randrange(3000)}" for _ in range(rng.randrange(20, 90))]
        rows += [(len(rows) + k, edited(rng, base, rng.randrange(0, 9))) for k in range(6)]
    rows += [(900, rows[3][1]), (901, rows[3][1]), (901, rows[3][1])]
    members, links = neardup.near_duplicates(table(spark, rows), "fn_id", "full_code")
    got = {(r.a, r.b) for r in neardup.pairs_of(members, links).collect()}
    assert got == brute(rows) and len(got) > 50
    assert {(3, 900), (900, 901)} <= got


def test_crowded_regions_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(neardup, "CROWD", 4)
    rng = random.Random(6)
    base = [f"v{k}" for k in range(60)]
    rows = [(k, edited(rng, base, 2)) for k in range(40)]
    members, links = neardup.near_duplicates(table(spark, rows), "fn_id", "full_code")
    got = {(r.a, r.b) for r in neardup.pairs_of(members, links).collect()}
    want = brute(rows)
    assert got <= want and len(got) >= 0.999 * len(want)


def test_copies_are_one_class(spark):
    rows = [(k, "a b c d e") for k in range(300)] + [(500, "a b c d f"), (501, "quite other text here")]
    members, links = neardup.near_duplicates(table(spark, rows), "fn_id", "full_code", least=(1, 2))
    assert links.count() == 1
    got = {r.id: r for r in neardup.groups_of(members, links).collect()}
    assert {got[k].class_id for k in range(300)} == {0} and got[500].group_id == 0 and got[501].group_id == 501 and got[501].links == 0


def test_odd_rows(spark):
    rows = [(None, "a b c d"), (1, None), (2, ""), (3, "a b"), (4, "a b c"), (5, "a b c"), (6, "x y " * 60_000), (7, "x y " * 60_000 + "z")]
    members, links = neardup.near_duplicates(table(spark, rows), "fn_id", "full_code")
    assert {(r.a, r.b) for r in neardup.pairs_of(members, links).collect()} == {(4, 5), (6, 7)}
    members, links = neardup.near_duplicates(table(spark, []), "fn_id", "full_code")
    assert members.count() == 0 and links.count() == 0 and neardup.groups_of(members, links).count() == 0


def test_similarity_at_the_limit(spark):
    a = " ".join(f"t{k}" for k in range(10))  # 8 shingles; 6 shared of 10 in either is 0.6
    b = " ".join([f"t{k}" for k in range(8)] + ["u1", "u2"])
    members, links = neardup.near_duplicates(table(spark, [(1, a), (2, b)]), "fn_id", "full_code")
    assert [(r.a, r.b, r.similarity) for r in links.collect()] == [(1, 2, 0.6)]


def test_marks_never_differ_more_than_the_sets():
    rng = random.Random(8)
    for _ in range(300):
        a = {rng.randrange(1 << 64) for _ in range(rng.randrange(1, 120))}
        b = set(rng.sample(sorted(a), rng.randrange(len(a) + 1))) | {rng.randrange(1 << 64) for _ in range(rng.randrange(60))}
        x, y = (neardup.marks(np.array(sorted(s), np.uint64)).view(np.uint64).tolist() for s in (a, b))
        assert sum((p ^ q).bit_count() for p, q in zip(x, y)) <= len(a ^ b)


def test_unlike_pairs_of_a_region_are_not_moved_and_only_results_are_kept(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"v{k}" for k in range(80)]
    rows = [(k, edited(rng, base, 12)) for k in range(30)]  # about half of the shingles are shared, 0.9 is asked for
    sizes, made = [], []
    keep = neardup._candidates
    monkeypatch.setattr(neardup, "_candidates", lambda *a: [sizes.append(t.count()) or t for t in keep(*a)])
    monkeypatch.setattr(neardup, "cut", lambda df, *a: made.append(cut(df, *a)) or made[-1])
    members, links = neardup.near_duplicates(table(spark, rows), "fn_id", "full_code", least=(9, 10))
    assert {(r.a, r.b) for r in links.collect()} == brute(rows, 9, 10)
    assert sum(sizes) < 40  # of 435 pairs, nearly all of which share a region
    paths = [f.rsplit("/", 1)[0].removeprefix("file:").replace("///", "/") for t in made for f in t.inputFiles()[:1]]
    assert sum(os.path.exists(p) for p in paths) == 2  # members and links


def test_a_cut_leaves_no_shuffle_files(spark):
    files = lambda: {f for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ").split() if "/shuffle_" in f}
    before = files()
    assert len(cut(spark.range(1_000).groupBy((F.col("id") % 7).alias("k")).count()).inputFiles()) > 0
    assert not files() - before and spark.conf.get(CLEAN, None) is None
