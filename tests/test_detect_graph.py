from pyspark.sql import functions as F

from codeloam.operators import dataflow as flow
from codeloam.operators import detect as dt
from codeloam.operators import graph as gr
from codeloam.operators import paths
from codeloam.operators import similarity as sim
from codeloam.operators import structure as st


def code(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, code string")


def test_weaknesses_need_a_sink_and_no_mitigation(spark):
    df = code(spark, 'cur.execute("select " + name)', 'cur.execute("select ?", name)', "eval(x)", "ast.literal_eval(x); eval(y)", 'password = "abc"', None, "")
    assert {(r.id, r.kind) for r in dt.weaknesses(df, ["id"]).collect()} == {(0, "SQL_INJECTION"), (2, "EVAL_USE"), (4, "HARDCODED_CRED")}


def test_exploitability_by_hand(spark):
    rows = [("CMD_INJECTION", "def run(req):\n    cmd = req.query['cmd']\n    return os.system('ls ' + cmd)"), ("SQL_INJECTION", "def get_user(name):\n    if validate(name):\n        return db.execute('... name = ?', (name,))")]
    got = {r.kind: (r.score, r.label) for r in dt.exploitability(spark.createDataFrame(rows, "kind string, code string")).collect()}
    assert got == {"CMD_INJECTION": (0.99, "CRITICAL"), "SQL_INJECTION": (0.58, "MEDIUM")}


def test_named_and_pattern_sinks(spark):
    df = code(spark, "run_command(x); save(y)", "s = os.system\ns(cmd)", "if (a) { print(b) }")
    got = {(r.id, r.category, r.sink, r.via_alias) for r in dt.named_sinks(df, ["id"]).collect()}
    assert (0, "CODE_EXEC", "run_command", False) in got and (1, "CODE_EXEC", "s", True) in got and not any(i == 2 for i, *_ in got)
    assert {(r.category, r.sink) for r in dt.pattern_sinks(code(spark, "os.system(a); OS.SYSTEM(b)"), ["id"]).collect()} >= {("CODE_EXEC", "os.system"), ("CODE_EXEC", "OS.SYSTEM")}


def test_hardcoded_lines(spark):
    got = sorted((r.line, r.kind) for r in dt.hardcoded(code(spark, 'a = 1\ntoken = "zzz"\nn = 12345'), ["id"]).collect())
    assert got == [(2, "SECRET"), (2, "SECRET"), (3, "MAGIC_NUMBER")]


def test_algorithms(spark):
    text = "def factorial(n):\n    if n <= 1:\n        return 1\n    return n * factorial(n - 1)"
    assert [(r.name, r.score) for r in dt.algorithms(code(spark, text), ["id"]).collect()] == [("factorial", 1.0)]


def test_bugs(spark):
    df = code(spark, "def f(a):\n    for x in a:\n        return x\n", "unused = 3\nb = 1\nreturn b")
    assert [tuple(r) for r in dt.returns_in_loops(df, ["id"]).collect()] == [(0, 2, 3)]
    assert {(r.id, r["name"]) for r in dt.unused_assignments(df, ["id"]).collect()} == {(1, "unused")}


UNIT = "unit_id bigint, project string, file string, name string, params array<string>, call_sites array<struct<callee:string,args:array<string>,line:int>>, body string, extra int"


def units(spark):
    rows = [
        (1, "p", "a.py", "f", ["x"], [("g", ["1", "2"], 1), ("m.h", ["1"], 2), ("zz", [], 3)], "b", 1),
        (2, "p", "b.py", "g", ["a", "b"], [("f", ["1", "2"], 1)], "b", 1),
        (3, "p", "b.py", "h", ["a"], None, "b", 1),
        (4, "p", "b.py", "<module>", None, [], "import os\nfrom x.y import z\n", 1),
        (5, "q", "c.go", "<module>", None, None, 'import "fmt"\n', 1),
        (5, "q", "c.go", "<module>", None, None, 'import "fmt"\n', 1),
    ]
    return gr.units_of(spark.createDataFrame(rows, UNIT))


def test_calls_resolve_and_mismatch(spark):
    u = units(spark)
    got = {(r.caller, r.callee): r.to_file for r in gr.resolved(u).collect()}
    assert got == {("f", "g"): "b.py", ("f", "m.h"): "b.py", ("f", "zz"): None, ("g", "f"): "a.py"}
    assert [(r.caller, r.callee, r.n_args, r.arity) for r in gr.arity_mismatches(u).collect()] == [("g", "f", 2, 1)]
    assert {r.callee for r in gr.missing_callees(u).collect()} == {"zz", "m.h"}
    assert {r["name"] for r in gr.unused_functions(u).collect()} == {"h"}
    assert {(r.project, r.module) for r in gr.imports(u).collect()} == {("p", "os"), ("p", "x.y"), ("q", "fmt")}


def edges(spark, *pairs):
    return spark.createDataFrame(list(pairs), "src bigint, dst bigint")


def test_graph_measures(spark):
    e = edges(spark, (1, 2), (2, 1), (3, 3), (1, 2), (4, 5))
    assert gr.two_cycles(e).first().cycles == 3
    r = gr.degrees(e.withColumn("k", F.lit(1)), ["k"]).first()
    assert (r.edges, r.nodes, r.max_fan_in, r.max_fan_out) == (4, 5, 1, 1)
    assert not gr.is_acyclic(e) and gr.is_acyclic(edges(spark, (1, 2), (2, 3), (1, 3))) and not gr.is_acyclic(edges(spark, (1, 2), (2, 1)))


def test_hops(spark):
    e = edges(spark, (1, 2), (2, 3), (3, 1), (3, 4), (None, 5))
    seeds = spark.createDataFrame([(1,), (None,)], "node bigint")
    assert {(r.node, r.hops) for r in gr.hops(e, seeds, 9).collect()} == {(1, 0), (2, 1), (3, 2), (4, 3)}
    assert gr.hops(e, seeds, 1).count() == 2


def test_enclosing_takes_the_narrowest(spark):
    spans = spark.createDataFrame([("p", "big", 1, 500), ("p", "small", 60, 70), ("p", "bad", 9, 3), ("q", "far", 1, 99)], "project string, name string, start_line int, end_line int")
    points = spark.createDataFrame([(1, "p", 65), (2, "p", 400), (3, "p", 999), (4, "p", None)], "i int, project string, line int")
    assert {(r.i, r.function, r.width) for r in gr.enclosing(points, spans, ["project"], "i").collect()} == {(1, "small", 10), (2, "big", 499)}


def test_structure():
    a, b = "def f(x):\n    for y in x:\n        total += y\n    return total", "def g(z):\n    for q in z:\n        s += q\n    return s"
    assert st.signature(a) == st.signature(b) == "ROOT(DEF(LOOP(AGGREGATE),RETURN))"
    assert st.similarity(a, b) == 1.0 and 0 < st.similarity(a, "def f(x):\n    return x") < 1 and st.similarity(a, "x = 0") == 0.0
    assert st.signature(st.assembled(a)) == st.signature(a) and st.signature("") == "ROOT" and st.similarity(None, a) is None
    long = "\n".join(f"x{k} = {k}\nif x{k} > 3:\n    f(x{k})" for k in range(3000))
    assert st.similarity(long, long) == 1.0 and 0 < st.similarity(long, long + "\nreturn x") < 1


def test_functions_and_flow(spark):
    rows = [
        (1, "python", "def f(a, b=2):\n    c = a + b\n    os.system(c)\n    return c"),
        (2, "javascript", "async function g(x) {\n  let y = x + 1;\n  run(y);\n  return y;\n}\nconst h = (p) => { return p }"),
        (3, "go", "func k(a int, b string) int {\n\tz := a\n\treturn z\n}"),
        (4, "python", "def broken(:"), (5, None, "x"), (6, "java", None),
    ]
    df = spark.createDataFrame(rows, "fn_id bigint, lang string, code string")
    got = {(r.fn_id, r["name"]): r for r in flow.extract_functions(df).collect()}
    assert set(got) == {(1, "f"), (2, "g"), (2, "h"), (3, "k")} and got[1, "f"].params == ["a", "b"] and got[2, "g"].is_async and got[3, "k"].params == ["a", "b"] and got[2, "g"].end_line == 5
    assert {(r.function, r.hops) for r in paths.return_paths(df).collect()} == {("f", 3), ("g", 3), ("h", 2), ("k", 3)}
    assert {(r.function, r.sink, r.role) for r in paths.sinks_reached(df).collect()} == {("f", "os.system", "CODE_EXEC"), ("g", "run", "CODE_EXEC")}
    assert flow.flow_measures(flow.flow_edges(df)).count() == 4


def test_penalties(spark):
    df = spark.createDataFrame([(1, 0, 0, 1), (1, 1, 1, 1), (0, 0, 0, 0)], "a1 int, s1 int, a2 int, s2 int")
    zero = {x: F.lit(0) for p in sim.rules.OPPOSITES for x in p}
    c = sim.polarity_penalty(zero | {"ARITH_ADD": F.col("a1"), "ARITH_SUB": F.col("s1")}, zero | {"ARITH_ADD": F.col("a2"), "ARITH_SUB": F.col("s2")})
    assert [r[0] for r in df.select(c).collect()] == [0.35, 0.5, 0.0]
    t = spark.createDataFrame([(["n", "%", "2", "==", "0"], ["n", "%", "2", "==", "1"]), (["n", "%", "2"], ["x"])], "a array<string>, b array<string>")
    assert [r[0] for r in t.select(sim.literal_penalty(sim.literals_near_operators(F.col("a")), sim.literals_near_operators(F.col("b")))).collect()] == [0.3, 0.0]


def test_outliers_and_sweep(spark):
    vec = spark.createDataFrame([(i, "a", 1.0) for i in range(20)] + [(99, "b", 5.0)], "id int, dim string, value double")
    assert {r.id for r in sim.outliers(vec).where("is_outlier").collect()} == {99}
    s = spark.createDataFrame([(0.9, True), (0.8, True), (0.7, False), (0.1, False)], "score double, truth boolean")
    best = max(sim.threshold_sweep(s).collect(), key=lambda r: r.f1 or 0)
    assert best.f1 == 1.0 and 0.7 < best.threshold <= 0.8


def test_model_and_flow_similarity(spark):
    e = "array<struct<dim:string,value:double>>"
    df = spark.createDataFrame([([("P:A", 1.0)], [("P:A", 2.0)], "x += 1", "y += 1"), ([("P:A", 1.0)], [("P:A", 1.0)], "x += 1", "y = 0"), ([("P:TRANSFORM:ARITH_ADD", 1.0)], [("P:TRANSFORM:ARITH_SUB", 1.0)], "", ""), ([], [], "", "")], f"a {e}, b {e}, s string, t string")
    got = [round(r[0], 4) for r in df.select(sim.model_similarity(F.col("a"), F.col("b"), F.col("s"), F.col("t"))).collect()]
    assert got == [1.0, 0.7, 0.0, 0.4]
    rows = [(1, "python", "def f(a):\n    b = g(a)\n    return b"), (2, "python", "def h(x):\n    y = g(x)\n    return y"), (3, "python", "def k(x):\n    return x")]
    sets = sim.flow_sets(flow.flow_edges(spark.createDataFrame(rows, "fn_id bigint, lang string, code string")))
    pairs = spark.createDataFrame([(1, 2, 1.0), (1, 3, 0.0)], "first_id bigint, second_id bigint, base double")
    out = {(r.first_id, r.second_id): r.flow for r in sim.flow_similarity(pairs, sets).collect()}
    assert out[1, 2] == 1.0 and 0 < out[1, 3] < 0.3
