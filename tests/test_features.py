import re

import pytest
from pyspark.sql import functions as F

from codeloam.functions import lex, rules
from codeloam.operators import features as ft
from codeloam.operators import vectors as vx

SNIPPETS = {
    "add": "def plus(a, b):\n    return a + b",
    "total": "def sum_list(nums):\n    total = 0\n    for n in nums:\n        total += n\n    return total",
    "text": 'x = "for sale if needed" # while\ny = a // b\n// note for all\nz = f(1) // 2',
    "quotes": "a = 'it\\'s' + \"x\" /* for */ - `q`\nb = \"open",
    "empty": "",
}


def frame(spark, rows=None):
    rows = rows if rows is not None else list(SNIPPETS.items())
    return spark.createDataFrame(rows, "name string, code string")


def test_tokens_skip_texts_and_comments(spark):
    got = {r.name: r.t for r in frame(spark).select("name", lex.tokens(F.col("code")).alias("t")).collect()}
    assert got["add"] == ["def", "plus", "(", "a", ",", "b", ")", ":", "return", "a", "+", "b"]
    assert got["text"] == ["x", "=", "y", "=", "a", "//", "b", "z", "=", "f", "(", "1", ")", "//", "2"]
    assert got["quotes"] == ["a", "=", "+", "-", "b", "="]
    assert got["empty"] == []


def prims(spark, lang=None):
    df = ft.with_tokens(frame(spark))
    dims = ft.token_primitives(F.col("toks"), F.col("code"))
    return {r.name: {k: v for k, v in r.asDict().items() if k != "name" and v} for r in df.select("name", *[c.alias(k) for k, c in dims.items()]).collect()}


def test_primitives_by_token(spark):
    got = prims(spark)
    assert got["add"] == {"ARITH_ADD": 1, "RETURN": 1}
    assert got["total"] == {"LOOP": 1, "ASSIGN": 2, "RETURN": 1, "AGGREGATE": 3, "STATE": 1}
    assert got["empty"] == {}


def test_shape_ties_keep_the_vocabulary_order(spark):
    df = ft.with_tokens(frame(spark))
    df = vx.with_top_names(df, "shape", vx.packed(ft.token_primitives(F.col("toks"), F.col("code"))), rules.PRIMITIVES, 8)
    got = {r.name: r["shape"] for r in df.collect()}
    assert got["add"] == "ARITH_ADD>RETURN" and got["total"] == "AGGREGATE>ASSIGN>LOOP>RETURN>STATE" and got["empty"] == "EMPTY"


def test_patterns_follow_the_language(spark):
    rows = [("python", "for x in y:\n    print(x)"), ("go", "for i := range x { fmt.Println(i) }"), ("rust", "loop { println!(1) }"), (None, "print(1)")]
    df = spark.createDataFrame(rows, "lang string, code string").withColumn("text", lex.line_stripped(F.col("code")))
    dims = ft.pattern_primitives(F.col("text"), F.col("lang"))
    got = {r.lang: (r.LOOP, r.WRITE) for r in df.select("lang", *[c.alias(k) for k, c in dims.items()]).collect()}
    assert got == {"python": (1, 1), "go": (2, 1), "rust": (1, 1), None: (0, 1)}


def test_unit_vectors_and_shares(spark):
    df = ft.with_tokens(frame(spark))
    e = vx.packed(ft.token_primitives(F.col("toks"), F.col("code")))
    got = {(r.name, r.dim): r.value for r in vx.unit_rows(df, ["name"], e).collect()}
    assert got["add", "RETURN"] == 0.7071 and not any(n == "empty" for n, _ in got)
    shares = vx.share_rows(df, ["name"], e).groupBy("name").agg(F.round(F.sum("value"), 2).alias("s")).collect()
    assert {r.name: r.s for r in shares}["add"] == 1.0


def test_cosine_of_entries(spark):
    df = spark.sql("select array(named_struct('dim','a','value',3D), named_struct('dim','b','value',4D)) x, array(named_struct('dim','b','value',2D)) y, cast(array() as array<struct<dim:string,value:double>>) z")
    r = df.select(vx.cosine_of(F.col("x"), F.col("y")).alias("c"), vx.cosine_of(F.col("x"), F.col("z")).alias("d")).first()
    assert r.c == pytest.approx(0.8) and r.d == 0.0


def test_shape_metrics_by_hand(spark):
    vec = spark.createDataFrame([(1, "a", 1.0), (1, "b", 1.0), (2, "a", 0.5)], "id int, dim string, value double")
    got = {r.id: (r.entropy, r.spread, r["skew"]) for r in vx.shape_metrics(vec, ["id"]).collect()}
    assert got[1] == (1.0, 0.0217, 6.7082) and got[2][0] == 0.0


def test_complexity(spark):
    rows = [
        ("flat", "def f(a):\n    return a"),
        ("one", "def zed(a):\n    for x in a:\n        g.h(x)\n    return a"),
        ("two", "def zed(a):\n    for x in a:\n        for y in a:\n            pass_(x)"),
        ("rec", "def f(n):\n    return f(n - 1)"),
        ("fib", "def fib(n):\n    return fib(n - 1) + fib(n - 2)"),
        ("concat", "def g(a):\n    for x in a:\n        s = s + x\n    return s"),
    ]
    got = {r.name: r.complexity for r in ft.with_efficiency(frame(spark, rows)).collect()}
    assert got == {"flat": "O(1)", "one": "O(n)", "two": "O(n^2)", "rec": "O(n)", "fib": "O(2^n)", "concat": "O(n^2)"}


def test_count_text_is_not_overlapping(spark):
    for part, text in [("aa", "aaaaa"), ("+=", "a+=b+=c"), (" ", "  ")]:
        assert spark.range(1).select(lex.count_text(F.lit(text), part).alias("n")).first().n == text.count(part)


def test_params(spark):
    df = spark.createDataFrame([("def f(a: int, b=3, *c):\n  pass\nfunction g(a, d) {}",)], "code string")
    assert df.select(ft.params_of(F.col("code")).alias("p")).first().p == ["a", "b", "d"]


def test_null_code_gives_nulls(spark):
    df = ft.with_tokens(frame(spark, [("n", None)]))
    assert df.select(F.size("toks").alias("n")).first().n in (-1, None)
    assert vx.unit_rows(df, ["name"], vx.packed(ft.token_primitives(F.col("toks"), F.col("code")))).count() == 0


def test_rules_are_valid_patterns():
    for _, _, sinks, safe in rules.WEAKNESSES:
        for p in (*sinks, *safe):
            re.compile(p)
    assert len(rules.PRIMITIVES) == 23 and set(rules.TOKEN_PRIMITIVES) | {"RECURSE"} == set(rules.PRIMITIVES)
