import random

import pytest

from codeloam.llm import packing

CAPS = "capacity_id int, max_tokens int, n_tokens int"
SIZES = "doc_id bigint, n_tokens bigint, cap int, grp int"


def check(spark, sizes, caps, per=20_000):
    s = spark.createDataFrame([(i, n, 1, 1) for i, n in sizes], SIZES)
    rows = packing.pack(s, spark.createDataFrame([(i, c, 9) for i, c in caps], CAPS), per).collect()
    for i, cap in caps:
        mine = [r for r in rows if r.capacity_id == i]
        if cap is None or cap < 1:
            assert not mine
            continue
        fill = {}
        for r in mine:
            fill[r.container_id] = fill.get(r.container_id, 0) + r.n_tokens
        assert all(v <= cap for v in fill.values())
        assert sum(fill.values()) == sum(n for _, n in sizes if n)
        for r in mine:
            whole = [n for d, n in sizes if d == r.doc_id]
            if all(n <= cap for n in whole):
                assert r.piece_no == 0 and r.n_tokens in whole
    return rows


def test_packs_everything_and_splits_only_the_oversized(spark):
    rng = random.Random(5)
    sizes = [(k, rng.choice([0, 1, 7, 30, 60, 100, 101, 350])) for k in range(400)]
    rows = check(spark, sizes, [(1, 100), (2, 37), (3, None), (4, 0)])
    used = len({r.container_id for r in rows if r.capacity_id == 1})
    assert used <= 1.05 * -(-sum(n for _, n in sizes) // 100)
    check(spark, sizes, [(1, 100)], per=50)


def test_pieces_are_contiguous(spark):
    rows = sorted(check(spark, [(1, 250)], [(1, 100)]), key=lambda r: r.piece_no)
    assert [(r.begin_token, r.n_tokens) for r in rows] == [(0, 100), (100, 100), (200, 50)]


def test_rule_places_where_squares_grow_least():
    def brute(sizes, cap):
        boxes, out = [], []
        squares = lambda b: sum(b.count(g) ** 2 for g in set(b) if 0 < g < cap)
        for s in sizes:
            options = []
            for k, g in enumerate(boxes):
                if g >= s and g > 0:
                    options.append((squares([*boxes[:k], g - s, *boxes[k + 1 :]]), 0, g, -k))
            options.append((squares([*boxes, cap - s]), 1, 0, 0))
            v, new, g, k = min(options)
            if new:
                boxes.append(cap - s)
                out.append(cap - s)
            else:
                boxes[-k] -= s
                out.append(boxes[-k])
        return sorted(boxes)

    rng = random.Random(2)
    for _ in range(40):
        sizes = [rng.randrange(1, 13) for _ in range(30)]
        got = packing.sum_of_squares(sizes, 12)
        gaps = {}
        for b, s in zip(got, sizes):
            gaps[b] = gaps.get(b, 12) - s
        assert sorted(gaps.values()) == brute(sizes, 12)


def test_bad_sizes():
    with pytest.raises(ValueError):
        packing.sum_of_squares([13], 12)


def test_nulls_repeats_empty(spark):
    assert len(check(spark, [(1, None), (2, 5), (2, 5), (None, 3)], [(1, 10)])) == 3
    assert check(spark, [], [(1, 10)]) == []
    assert check(spark, [(1, 5)], []) == []


def test_documents(spark):
    docs = spark.createDataFrame([(1, "alpha beta <|endoftext|> gamma", 3), (2, None, 3), (3, "", 3), (4, "word " * 3000, 3)], "doc_id bigint, text string, n_tokens int")
    rows = packing.pack_documents(docs, spark.createDataFrame([(1, 512, 0)], CAPS)).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r.n_tokens)
    assert set(by) == {1, 3, 4} and by[3] == [0] and sum(by[4]) >= 3000 and max(by[4]) == 512
