from pyspark.sql import functions as F

from codeloam.operators import embed as em
from codeloam.operators import risks as rk


def test_buckets(spark):
    cases = {"int": "INT", " List[int] ": "LIST", "Optional[str]": "STR", "typing.Dict[str, int]": "DICT", "Callable[[int], str]": "CALLABLE", "User": "CLASS", "": "UNKNOWN", None: "UNKNOWN", "foo": "UNKNOWN", "Any": "UNKNOWN"}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "hint string, want string")
    assert all(r.got == r.want for r in df.select("want", em.bucket_of(F.col("hint")).alias("got")).collect())


def test_profiles(spark):
    schema = "fn_id bigint, params array<struct<name:string,type_hint:string>>, name string, pos int"
    df = spark.createDataFrame([(1, [("a", "int"), ("b", "int"), ("c", None)], "x", 1), (1, [("a", "int"), ("b", "int"), ("c", None)], "x", 1), (2, None, "y", 1), (3, [], "z", 1)], schema)
    got = {(r.fn_id, r.dim): r.value for r in em.type_profile(em.param_types(df)).collect()}
    assert got == {(1, "TYPE_PROFILE:INT"): 0.8944, (1, "TYPE_PROFILE:UNKNOWN"): 0.4472}


def test_embedding_ignores_names(spark):
    rows = [(1, "PARAM:a:LIST", 3.0), (1, "PARAM:b:LIST", 1.0), (1, "VAR:x:ROLE:OUT", 0.0), (1, "PRIM:LOOP", 3.0), (2, "PARAM:z:LIST", 4.0), (2, "PRIM:LOOP", 3.0), (3, "VAR:q:INT", 1.0), (4, "VAL:RISK", 3.0), (4, "VAL:SEVERITY", 1.0)]
    vec = spark.createDataFrame(rows, "id int, dim string, value double")
    got = {}
    for r in em.fixed_embedding(vec).collect():
        got.setdefault(r.id, {})[r.dim] = r.value
    assert got[1] == got[2] == {"PARAM.type:LIST": 0.8, "PRIM:LOOP": 0.6} and got[3] == {"VAR.type:UNKNOWN": 1.0}
    assert {(r.id, r.dim, r.value) for r in em.fixed_embedding(vec, True).where("id = 4").collect()} == {(4, "VAL:SEVERITY", 1.0)}


def test_translation(spark):
    df = spark.createDataFrame([("ASSIGN>LOOP>AGGREGATE>RETURN>SEARCH",), ("EMPTY",)], "shape string")
    got = {r.shape: r.code for r in em.translated(df, "python").collect()}
    assert got["ASSIGN>LOOP>AGGREGATE>RETURN>SEARCH"] == "def fn(nums):\n    total = 0\n    for n in nums:\n        total += n\n    return total"
    go = {r.shape: r.code for r in em.translated(df, "go").collect()}
    assert go["ASSIGN>LOOP>AGGREGATE>RETURN>SEARCH"].startswith("func fn(nums) int {\n") and go["EMPTY"] == "func fn(a, b) []int {\n}"


def test_library_roles(spark):
    libs = spark.createDataFrame([("os", "system", "EXEC"), ("os", "path", "FILE"), ("lib", "", "ANY")], "module string, call string, role string")
    calls = spark.createDataFrame([("os", "system"), ("os", "path.join.x"), ("os", "nice"), ("lib", "q.r"), ("os", "system")], "module string, call string")
    assert sorted((r.call, r.role) for r in em.library_roles(calls, libs).collect()) == [("nice", None), ("path.join.x", "FILE"), ("q.r", "ANY"), ("system", "EXEC"), ("system", "EXEC")]


def test_error_handling(spark):
    code = "try:\n    check_auth(u)\nexcept Exception:\n    pass\ntry:\n    f()\nexcept ValueError:\n    allowed = True\nraise ValueError('bad password ' + p)\n\n\n\n\n\n\n\nx = db.find(1).name\ny = request[k]\n"
    df = spark.createDataFrame([(1, "python", code), (2, "python", "def broken("), (3, "go", code), (4, "python", None), (5, "python", "try:\n    f()\nexcept E:\n    log(1)\n")], "fn_id bigint, lang string, code string")
    got = {(r.fn_id, r.kind, r.line) for r in rk.error_handling(df).collect()}
    assert got == {(1, "SWALLOWED", 1), (1, "FAILING_OPEN", 5), (1, "ERROR_LEAK", 9), (1, "NULL_DEREF", 17), (1, "MISSING_PARAM", 18)}


def test_null_uses_of_names_and_handlers_on_one_line(spark):
    code = "row = db.find(1)\n\n\n\n\n\n\nname = row.name\ntry:\n    f()\nexcept E: granted = 1\n"
    safe = "row = db.find(1)\nif row is None:\n    raise E\nname = row.name\n"
    df = spark.createDataFrame([(1, "python", code), (2, "python", safe)], "fn_id bigint, lang string, code string")
    assert {(r.fn_id, r.kind, r.line) for r in rk.error_handling(df).collect()} == {(1, "NULL_DEREF", 8), (1, "FAILING_OPEN", 9)}


def test_framework_sinks(spark):
    rows = [(1, "python", "def f(url):\n    to = url\n    return redirect(to)"), (2, "python", "def g(url):\n    return redirect('/home')"), (3, "python", "def h(m):\n    logger.info('a' + m)\n    logger.info('a\\n' + m)")]
    got = {(r.fn_id, r.kind, r.line) for r in rk.framework_sinks(spark.createDataFrame(rows, "fn_id bigint, lang string, code string")).collect()}
    assert got == {(1, "OPEN_REDIRECT", 3), (3, "LOG_INJECTION", 3)}


def test_layers(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("x", "y"), ("y", "x"), ("z", "x"), (None, "q")], "src string, dst string")
    assert {(r.node, r.depth) for r in rk.layers(e).collect()} == {("c", 0), ("b", 1), ("a", 2), ("x", 0), ("y", 0), ("z", 1)}
