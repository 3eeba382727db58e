import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from codeloam.functions import lex, rules
from codeloam.operators import adapters as ad
from codeloam.operators import clones as cl


def counts(spark, lang, code):
    df = ad.prepared(spark.createDataFrame([(1, lang, code)], "fn_id int, lang string, code string"))
    r = df.select(*[c.alias(p) for p, c in ad.adapter_counts(F.col("text"), F.col("code"), F.col("toks"), F.col("adapter")).items()]).first()
    return {p: n for p, n in r.asDict().items() if n}


def test_counts_by_hand(spark):
    got = counts(spark, "python", "def f(a, b):\n    for x in a:\n        if x > b:\n            return a*b\n    return f(b, a)")
    assert got == {"LOOP": 1, "BRANCH": 1, "RETURN": 2, "ARITH_MUL": 1, "COMPARE_GT": 1, "SEARCH": 1, "RECURSE": 1}
    got = counts(spark, "c", "int half(int *p) {\n  printf(\"%d\", *p);\n  return p[0] / 2;\n}")
    assert got == {"WRITE": 1, "RETURN": 1, "ARITH_DIV": 1}


def test_compact_and_spaced_operators_count_alike(spark):
    assert counts(spark, "go", "func f(a int) int { return a+a*a }")["ARITH_ADD"] == counts(spark, "go", "func f(a int) int { return a + a * a }")["ARITH_ADD"] == 1


def test_last_expressions_return(spark):
    assert counts(spark, "rust", "fn add(a: i32, b: i32) -> i32 { a + b }")["RETURN"] == 1
    assert counts(spark, "ruby", "def add(a, b)\n  a + b\nend")["RETURN"] == 1


def test_writes_of_python(spark):
    got = counts(spark, "python", "def f(p):\n    open(p, 'w')\n    db.execute('SELECT 1')\n    db.execute('DELETE x')")
    assert got["WRITE"] == 2 and got["READ"] == 1


def test_calls_add_half_rounded_down(spark):
    code = "def a(x):\n    y = x + x + x\n    return y\n\ndef b(x):\n    return a(a(x))\n"
    r = ad.recursive_counts(spark.createDataFrame([(1, "python", code), (2, "python", "x = 1"), (3, "python", None)], "fn_id int, lang string, code string"), ["fn_id"])
    got = {x.fn_id: dict(zip(rules.PRIMITIVES, x.counts)) for x in r.collect()}
    assert got[1]["ARITH_ADD"] == 4 and got[1]["RETURN"] == 2 and got[1]["ASSIGN"] == 1
    assert got[2]["ASSIGN"] == 1 and sum(got[3].values()) == 0


def test_opposites_are_no_twins(spark):
    rows = [(1, "python", "def f(a, b):\n    return a + b"), (2, "python", "def g(a, b):\n    return a + b"), (3, "python", "def h(a, b):\n    return a - b")]
    df = ad.counted(spark.createDataFrame(rows, "fn_id int, lang string, code string"), ["fn_id"]).withColumn("c", F.transform("counts", lambda x: x.cast("double")))
    got = {r.fn_id: list(r.c) for r in df.collect()}
    pairs = spark.createDataFrame([(got[1], got[2], []), (got[1], got[3], [])], "a array<double>, b array<double>, t array<string>")
    same, other = (r[0] for r in pairs.select(ad.true_similarity(F.col("a"), F.col("b"), F.col("t"), F.col("t"))).collect())
    assert same == 1.0 and other < 0.5


def test_bag_links_against_brute_force(spark):
    codes = [f"def f{k % 7}(a, b):\n" + "".join(f"    {'xyzuvw'[j % (k % 5 + 1)]} = a + {j}\n" for j in range(k % 9)) for k in range(40)] + ["", None, "x"]
    fns = spark.createDataFrame([(k, c) for k, c in enumerate(codes)], "fn_id bigint, code string")
    members, links = cl.bag_links(cl.bags(fns), 0.7)
    bags = {k: Counter(re.findall(lex.BAG_TOKEN, c)) for k, c in enumerate(codes) if c}
    cls = {k: min(j for j in bags if bags[j] == bags[k]) for k in bags}
    assert {r.id: r.cls for r in members.collect()} == cls
    norm = {k: math.sqrt(sum(n * n for n in b.values())) for k, b in bags.items()}
    want = {(a, b) for a in set(cls.values()) for b in set(cls.values()) if a < b and round(sum(n * bags[b][t] for t, n in bags[a].items()) / (norm[a] * norm[b]), 9) >= 0.7}
    assert {(r.a, r.b) for r in links.collect()} == want and want
    assert cl.bag_links(cl.bags(fns.limit(0)), 0.7)[1].count() == 0


def some_bags(n, copies=1):
    rng = random.Random(5)
    one = [Counter({"(": 9, **{rng.choice("abcdefghijklmnop") + str(j % 3): 1 + j for j in range(k % 7)}}) for k in range(n)]
    return {k + n * c: one[k] for c in range(copies) for k in range(n)}


def bag_rows(spark, bags):
    return spark.createDataFrame([(k, t, n) for k, b in bags.items() for t, n in b.items()], "id bigint, token string, n bigint")


def cosine(a, b):
    return sum(n * b[t] for t, n in a.items()) / math.sqrt(sum(n * n for n in a.values()) * sum(n * n for n in b.values()))


@pytest.mark.parametrize("block", [7, 10])
def test_links_over_blocks(spark, block, monkeypatch):
    monkeypatch.setattr(cl, "BLOCK", block)
    monkeypatch.setattr(cl, "ROWS", 3)
    bags = some_bags(60)
    first = [k for k in bags if not any(bags[j] == bags[k] for j in range(k))]
    want = {(a, b): round(cosine(bags[a], bags[b]), 9) for a in first for b in first if a < b and round(cosine(bags[a], bags[b]), 9) >= 0.8}
    got = cl.bag_links(bag_rows(spark, bags), 0.8)[1].collect()
    assert {(r.a, r.b): round(r.cosine, 9) for r in got} == want and len(got) == len(want) > 50


def test_links_and_classes_keep_no_pairs(spark, monkeypatch):
    rows = []
    monkeypatch.setattr(cl, "cut", lambda df, real=cl.cut: rows.append(tuple(df.columns)) or real(df))
    bag = bag_rows(spark, some_bags(30))
    assert cl.bag_links(bag, 0.7)[1].count() > 0
    assert cl.bag_classes(cl.packed_bags(bag)).count() == 30
    assert all("id" in c and "b" not in c for c in rows)


@pytest.mark.parametrize("block", [2048, 7])
def test_nearest_bags_with_copies(spark, block, monkeypatch):
    monkeypatch.setattr(cl, "BLOCK", block)
    bags = some_bags(30, copies=4)
    bags[500] = Counter({"alone": 2})
    asked = [k for k in bags if k % 4 == 0]
    got = {}
    for r in cl.nearest_bags(bag_rows(spark, bags), spark.createDataFrame([(k,) for k in asked], "id bigint"), 5).collect():
        got.setdefault(r.asked_id, {})[r["rank"]] = (r.id, r.cosine)
    want = {a: sorted((-round(c, 6), j) for j in bags if j != a and (c := cosine(bags[a], bags[j])) > 0)[:5] for a in asked if a != 500}
    assert {a: [x[k][0] for k in sorted(x)] for a, x in got.items()} == {a: [j for _, j in x] for a, x in want.items()}


def test_properties_by_hand(spark):
    from codeloam.functions import lex as lx
    from codeloam.operators import features as ft
    from codeloam.operators import properties as pp

    df = ft.with_tokens(spark.createDataFrame([(1, "def f(a, b):\n    a.append(1.5)\n    try:\n        print(a)\n    except E:\n        return b.lower()\n    return {}")], "fn_id int, code string"))
    df = df.withColumn("text", lx.stripped(F.col("code"))).withColumn("methods", pp.methods_of(F.col("toks")))
    r = df.select(*[c.alias(d) for d, c in pp.dims(F.col("toks"), F.col("text"), F.col("methods")).items()]).first().asDict()
    assert {d: n for d, n in r.items() if n} == {"PROP:NUM": 1, "PROP:LIST": 1, "PROP:DICT": 1, "PROP:MUTABLE": 1, "PROP:TRANSFORM": 1, "PROP:HANDLES_ERRORS": 1, "PROP:SIDE_EFFECTS": 1, "PROP:INPUTS": 2, "PROP:OUTPUTS": 2}
    found = spark.createDataFrame([(1, "LOW", 0.3), (1, "HIGH", 0.65), (2, "CRITICAL", 0.9)], "fn_id int, severity string, score double")
    assert {(x.fn_id, x.risk, x.severity) for x in pp.risks(found).collect()} == {(1, 0.7, "HIGH"), (2, 1.0, "CRITICAL")}
