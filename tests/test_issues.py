from codeloam.operators import crossfile as cf
from codeloam.operators import issues as iss
from codeloam.operators import libraries as lb
from codeloam.operators import paths as pt
from codeloam.operators import values as vl
from codeloam.plans import planted

CODE = "fn_id bigint, lang string, code string, line int, weakness string"  # names that clash with the results


def texts(spark, *codes, lang="python"):
    return spark.createDataFrame([(k, lang, c, 9, "x") for k, c in enumerate(codes)], CODE)


def found(spark, *codes, lang="python", detectors=("patterns", "aliases")):
    rows = iss.issues(texts(spark, *codes, lang=lang).select("fn_id", "lang", "code"), ["fn_id"]).collect()
    return {(r.fn_id, r.line, r.weakness) for r in rows if r.detector in detectors}


def test_sinks_with_their_lines(spark):
    got = found(
        spark,
        "def a(x):\n    y = 1\n    return eval(x)",
        "def eval(x):\n    return x",
        "def b(x):\n    return ast.literal_eval(eval(x))",
        "password = 'abc'",
        "# text\nclass K:\n    def q(self, name):\n        self.db.execute('SELECT * FROM t WHERE n=' + name)",
        "def q(name):\n    db.execute('SELECT * FROM t WHERE n=?', (name,))",
        None,
        "",
    )
    assert got == {(0, 3, "EVAL_USE"), (3, 1, "HARDCODED_CRED"), (4, 4, "SQL_INJECTION")}


def test_taint_gates_and_guards_above(spark):
    assert found(spark, "def f():\n    logger.info('a' + 'b')") == set()
    assert found(spark, "def f(user):\n    logger.info('a' + user)") == {(0, 2, "LOG_INJECTION")}
    assert found(spark, "def f(user):\n    user = user.replace('a', 'b')\n    logger.info('a' + user)") == set()


def test_other_names_of_dangerous_functions(spark):
    got = found(spark, "def f(c):\n    run = os.system\n    run(c)", "def f(c):\n    g = getattr\n    g(m, 'eval')", "def f(c):\n    g = getattr\n    g(m, 'name')", "run = os.system\n")
    assert got == {(0, 3, "CMD_INJECTION"), (1, 3, "CMD_INJECTION")}


def test_indexes_without_bounds(spark):
    got = found(spark, "def f(xs, i):\n    xs.append(1)\n    return xs[i]", "def f(xs, i):\n    xs.append(1)\n    if i < len(xs):\n        return xs[i]", detectors=("indexes",))
    assert got == {(0, 3, "BUFFER_OVERFLOW")}


def test_enrichment_sets_severity(spark):
    df = texts(spark, "def f(request, c):\n    return os.system('ls ' + c)", "def f():\n    return random.random()").select("fn_id", "lang", "code")
    got = {r.fn_id: r for r in iss.enriched_findings(df, ["fn_id"]).where("detector = 'patterns'").collect()}
    assert got[0].cwe == "CWE-78" and got[0].severity == "CRITICAL" and "source:c" in got[0].tags and got[0].remediation.startswith("Avoid shell")
    assert got[1].cwe == "CWE-330" and got[1].severity == "MEDIUM"
    assert iss.enriched_findings(df.limit(0), ["fn_id"]).count() == 0


def test_verdicts(spark):
    df = spark.createDataFrame([("os.environ", "run(x)", ["os.environ", "run"]), (None, "run(x)", None), ("name", "run(escape(x))", ["name", "run"]), ("name", "run(x)", ["name", "run"])], "source string, code_line string, path array<string>")
    assert [(r.kept, r.reason) for r in iss.verdicts(df).collect()] == [(False, "source is not public"), (False, "no source"), (True, "mitigation near, for review"), (True, "source reaches sink")]


def test_taint_and_its_path():
    code = "def f(name):\n    part = name.strip()\n    sql = 'x' + part\n    other = 3\n    db.execute(sql)"
    assert vl.tainted(code) == {"name": ["PARAM"], "part": ["PARAM"], "sql": ["PARAM"]}  # a constant shows only with its sign of assignment
    assert vl.taint_path(code, "    db.execute(sql)") == ["PARAM", "part", "sql", "db.execute(sql)"]
    assert vl.taint_path("x", "return request.args['a']") == ["REQUEST", "return request.args['a']"]


def test_types_by_hint_and_use():
    got = vl.types_of("def f(a: List[int], b, c, d):\n    b.append(1)\n    x = b[0]\n    y = c.get('k')\n    z = c['k']\n    return d")
    assert got["a"] == "LIST" and got["b"] == "LIST" and got["c"] == "DICT" and got["d"] == "PARAM"
    assert vl.types_of("func f(n int, s string) int {\n}") == {"n": "INT", "s": "STR"}


def test_intents(spark):
    got = iss.dangerous_intents(texts(spark, "def f(c):\n    run(c)\n    run(quote(c))\n    note(c)\n    send('rm -r; ' + c)", "run(x)", None), ["fn_id"]).collect()
    assert [(r.call, r.category) for r in got] == [("run", "CODE_EXEC"), ("send", "CODE_EXEC")]


def test_paths_from_inputs_to_outputs(spark):
    df = texts(spark, "def f(a):\n    b = a\n    send(b)\n    return b", "def broken(:", None).select("fn_id", "lang", "code")
    got = {(r.source, r.sink, r.sink_kind, tuple(r.steps)) for r in pt.in_out_paths(df).collect()}
    assert got == {("a", "call:send", "call", ("IN:PARAM[a]", "FLOW:ASSIGN[b]", "OUT:CALL[send]")), ("a", "return", "return", ("IN:PARAM[a]", "FLOW:ASSIGN[b]", "OUT:RETURN"))}
    d = {r.function: r for r in pt.flow_directions(df).collect()}["f"]
    assert (d.param_to_local, d.local_to_call, d.local_to_return, d.passthrough) == (1, 1, 1, 0)


def test_signatures_ignore_names(spark):
    df = texts(spark, "def f(a):\n    b = a\n    return b", "def g(x):\n    y = x\n    return y", "def h(x):\n    return x").select("fn_id", "lang", "code")
    s = {r.fn_id: r.signatures for r in pt.flow_signatures(df).collect()}
    assert s[0] == s[1] != s[2]


def test_flow_over_files(spark):
    got = cf.cross_file_flows(planted.planted_units(spark)).collect()
    assert [(r.file, r.function, r.param, r.sink, r.sink_line, r.hops) for r in got] == [("b.py", "lookup", "key", "execute", 3, 1)]
    assert cf.cross_file_flows(planted.planted_units(spark).limit(0)).count() == 0


def test_library_calls(spark):
    got = {(r.fn_id, r.weakness) for r in lb.library_weaknesses(lb.planted(spark), lb.planted_libraries(spark)).collect()}
    assert got == {(-101, "DESERIALIZATION"), (-102, "SSRF"), (-103, "SQL_INJECTION")}
