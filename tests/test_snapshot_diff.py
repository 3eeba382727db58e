from datetime import datetime

from codeloam.operators.components import connected_components
from codeloam.operators.snapshot_diff import snapshot_changes

SNAP = "snapshot_id bigint, delivery_no int, target string, enriched map<string,double>, vuln_types array<string>, complexity string, loaded_at timestamp, node string, after int, digest int"
T = lambda d: datetime(2031, 3, d)


def row(i, no, target, vec, kinds=None, growth="O(n)", day=1):
    return (i, no, target, vec, kinds, growth, T(day), "clash", 7, 7)


def changes(spark, rows, deliveries=(1, 2, 4)):
    got = snapshot_changes(spark.createDataFrame(rows, SNAP), spark.createDataFrame([(d,) for d in deliveries], "delivery_no int"))
    assert got.columns == ["delivery_no", "target", "change_kind"]
    return sorted(map(tuple, got.collect()))


def test_kinds_over_a_gap(spark):
    rows = [
        row(1, 1, "a", {"x": 1.0}), row(2, 1, "b", {"x": 1.0}), row(3, 1, "c", {"x": 1.0}),
        row(4, 2, "a", {"x": 1.0}), row(5, 2, "b", {"x": 2.0}), row(6, 2, "d", None),
        row(7, 4, "a", {"x": 1.0}, ["S"]), row(8, 4, "b", {"x": 2.0}, None, "O(1)"), row(9, 4, "d", {}),
    ]
    assert changes(spark, rows) == [(2, "b", "changed"), (2, "c", "removed"), (2, "d", "added"), (4, "a", "changed"), (4, "b", "changed")]


def test_what_is_no_change(spark):
    rows = [
        row(1, 1, " ./a ", {"x": 0.12341, "y": 0.0}, ["S", "S", "Q"], " O( N )"),
        row(2, 2, "a", {"x": 0.1234, "z": -0.0}, ["Q", "S"], "o(n)"),
        row(3, 1, "b", None, None, None), row(4, 2, "./b", {}, [], None),
    ]
    assert changes(spark, rows, (1, 2)) == []


def test_superseded_repeated_tied_and_null_rows(spark):
    rows = [
        row(1, 1, "a", {"x": 1.0}, day=1), row(2, 1, "a", {"x": 3.0}, day=9), row(2, 1, "a", {"x": 3.0}, day=9),
        row(3, 2, "a", {"x": 3.0}, day=2), row(4, 2, "a", {"x": 4.0}, day=2), row(5, 2, None, {"x": 3.0}), row(6, None, "q", {"x": 3.0}),
    ]
    assert changes(spark, rows, (1, 2)) == [(2, "a", "changed")]  # of equal times the higher id holds


def test_empty_and_unlisted(spark):
    assert changes(spark, []) == []
    assert changes(spark, [row(1, 1, "a", {}), row(2, 3, "b", {})], (1, 2)) == [(2, "a", "removed")]
    assert changes(spark, [row(1, 1, "a", {})], ()) == []


def test_against_brute_force(spark):
    import random

    rng = random.Random(3)
    rows, state = [], {}
    for no in (1, 2, 4):
        state = {t: v for t, v in state.items() if rng.random() > 0.1}
        for _ in range(60):
            state[f"t{rng.randrange(150)}"] = round(rng.random(), 3)
        rows += [row(len(rows) + k, no, t, {"x": v}) for k, (t, v) in enumerate(sorted(state.items()))]
    at = {no: {r[2]: r[3] for r in rows if r[1] == no} for no in (1, 2, 4)}
    want = []
    for a, b in ((1, 2), (2, 4)):
        for t in at[a].keys() | at[b].keys():
            if at[a].get(t) != at[b].get(t):
                want.append((b, t, "added" if t not in at[a] else "removed" if t not in at[b] else "changed"))
    assert changes(spark, rows) == sorted(want)


def test_components(spark):
    edges = [(1, 2), (2, 3), (2, 3), (9, 8), (5, 5), (None, 4), (3, 10), (10, 11), (11, 12)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()))
    assert got == {1: 1, 2: 1, 3: 1, 10: 1, 11: 1, 12: 1, 8: 8, 9: 8}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_components_of_a_star_and_a_path(spark):
    star = [(0, k) for k in range(1, 400)]
    path = [(k, k + 1) for k in range(1000, 1200)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(star + path, "a bigint, b bigint")).collect()))
    assert {got[k] for k in range(400)} == {0} and {got[k] for k in range(1000, 1201)} == {1000}
