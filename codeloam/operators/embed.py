"""Types of parameters, rename-invariant embeddings, code made from shapes, library roles of calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# --- fixed values: type buckets by annotation --------------------------------------------------------------------------
BUCKETS = {
    "int": "INT", "float": "FLOAT", "complex": "NUM", "str": "STR", "bool": "BOOL", "list": "LIST", "dict": "DICT", "set": "SET", "frozenset": "SET", "tuple": "TUPLE",
    "bytes": "STR", "bytearray": "STR", "callable": "CALLABLE", "type": "CLASS", "object": "CLASS", "NoneType": "NONE", "None": "NONE", "List": "LIST", "Sequence": "LIST",
    "Iterable": "LIST", "MutableSequence": "LIST", "Dict": "DICT", "Mapping": "DICT", "MutableMapping": "DICT", "DefaultDict": "DICT", "Set": "SET", "FrozenSet": "SET",
    "AbstractSet": "SET", "Tuple": "TUPLE", "Callable": "CALLABLE", "FunctionType": "CALLABLE", "Any": "UNKNOWN",
}
TYPE_SLOTS = ["NUM", "STR", "LIST", "DICT", "CALLABLE", "BOOL", "UNKNOWN", "MIXED"]
ROLE_SLOTS = ["IN", "OUT", "INOUT"]
# --- fixed values: dims that always go together, and what they are merged into -------------------------------------------
MERGES = {
    "VAL:RISK": "VAL:SEVERITY", "PARAM_COUNT": "PROP:INPUTS", "PARAM.role:IN": "PROP:INPUTS", "VAR.role:OUT": "VAR_COUNT", "PROP:SIDE_EFFECTS": "PRIM:WRITE", "GRAPH:DATA_EDGES": "GRAPH:CALLS",
    "GRAPH:MAX_FANOUT": "GRAPH:CALLS", "GRAPH:MAX_FANIN": "GRAPH:CALLS", "GRAPH:RECURSION": "GRAPH:CALLS", "GRAPH:CYCLES": "GRAPH:CALLS", "GRAPH:BRANCHES": "GRAPH:CALLS", "GRAPH:LOOPS": "GRAPH:CALLS",
}
# --- fixed values: lines of code per primitive and language, and heads and ends of functions ------------------------------
LINES = {
    "python": {"LOOP": "for n in nums:", "AGGREGATE": "total += n", "ASSIGN": "total = 0", "RETURN": "return total", "BRANCH": "if a > b:", "COMPARE_GT": "    return a", "ARITH_ADD": "    return a + b", "ARITH_MUL": "    return a * b", "FILTER": "if n % 2 == 0:", "SORT": "return sorted(arr)", "SEARCH": "return arr.index(x)"},
    "go": {"LOOP": "for _, n := range nums {", "AGGREGATE": "total += n", "ASSIGN": "total := 0", "RETURN": "return total", "BRANCH": "if a > b {", "COMPARE_GT": "    return a", "ARITH_ADD": "return a + b", "ARITH_MUL": "return a * b", "FILTER": "if n%2 == 0 {", "SORT": "sort.Ints(arr)\n    return arr", "SEARCH": "return arr[i]"},
    "rust": {"LOOP": "for n in nums {", "AGGREGATE": "total += n;", "ASSIGN": "let mut total = 0;", "RETURN": "total", "BRANCH": "if a > b {", "COMPARE_GT": "    return a;", "ARITH_ADD": "a + b", "ARITH_MUL": "a * b", "FILTER": "if n % 2 == 0 {", "SORT": "arr.sort();\n    arr", "SEARCH": "arr.iter().position(|&x| x == target)"},
    "javascript": {"LOOP": "for (let n of nums) {", "AGGREGATE": "total += n;", "ASSIGN": "let total = 0;", "RETURN": "return total;", "BRANCH": "if (a > b) {", "COMPARE_GT": "    return a;", "ARITH_ADD": "return a + b;", "ARITH_MUL": "return a * b;", "FILTER": "if (n % 2 === 0) {", "SORT": "return arr.sort((a,b) => a-b);", "SEARCH": "return arr.indexOf(x);"},
    "java": {"LOOP": "for (int n : nums) {", "AGGREGATE": "total += n;", "ASSIGN": "int total = 0;", "RETURN": "return total;", "BRANCH": "if (a > b) {", "COMPARE_GT": "    return a;", "ARITH_ADD": "return a + b;", "ARITH_MUL": "return a * b;", "FILTER": "if (n % 2 == 0) {", "SORT": "Arrays.sort(arr);\n    return arr;", "SEARCH": "return Arrays.asList(arr).indexOf(x);"},
}
HEADS = {"python": ("def fn(", "):"), "go": ("func fn(", ") {ret} {"), "rust": ("fn fn(", ") -> {ret} {"), "javascript": ("function fn(", ") {"), "java": ("public static {ret} fn(", ") {")}
RETURNS = {"go": ("int", "[]int"), "rust": ("i32", "Vec<i32>"), "java": ("int", "int[]")}


def _map(table: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def bucket_of(hint: Column) -> Column:
    """Type bucket of an annotation: wrappers and arguments dropped, the last dotted part looked up, capitalised names classes."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(hint), r"Optional\[(.*)\]", "$1"), r"Union\[(.*)\]", "$1")
    base = F.substring_index(F.trim(F.regexp_replace(bare, r"\[.*\]", "")), ".", -1)
    return F.when(hint.isNull() | (F.trim(hint) == ""), "UNKNOWN").otherwise(F.coalesce(_map(BUCKETS)[base], F.when(base.rlike("^[A-Z]"), "CLASS").otherwise("UNKNOWN")))


def param_types(functions: DataFrame) -> DataFrame:
    """(fn_id, pos, name, bucket) of every parameter."""
    rows = functions.select("fn_id", "params").distinct().select("fn_id", F.posexplode("params").alias("pos", "p"))
    return rows.select("fn_id", "pos", F.col("p.name").alias("name"), bucket_of(F.col("p.type_hint")).alias("bucket"))


def type_profile(types: DataFrame) -> DataFrame:
    """(fn_id, dim, value): unit vector of a function's buckets."""
    n = types.groupBy("fn_id", F.concat(F.lit("TYPE_PROFILE:"), "bucket").alias("dim")).agg(F.count("*").alias("n"))
    return n.select("fn_id", "dim", F.round(F.col("n") / F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy("fn_id"))), 4).alias("value"))


def slot_of(dim: Column) -> Column:
    """A dim without its parameter or variable name: ``PARAM.type:T`` or ``PARAM.role:R``; other dims as they are."""
    parts = F.split(dim, ":")
    role, kind = F.regexp_extract(dim, r":ROLE:(\w+)", 1), F.try_element_at(parts, F.lit(3))
    slot = F.when(role.isin(*ROLE_SLOTS), F.concat(F.lit(".role:"), role)).when(kind.isin(*TYPE_SLOTS), F.concat(F.lit(".type:"), kind)).otherwise(".type:UNKNOWN")
    return F.when(dim.rlike("^(?:PARAM|VAR):"), F.concat(parts[0], slot)).otherwise(dim)


def fixed_embedding(vec: DataFrame, merged: bool = False) -> DataFrame:
    """(id, dim, value): unit vectors over dims that renaming does not change, dims that go together merged if asked."""
    dim = slot_of(F.col("dim"))
    dim = F.coalesce(_map(MERGES)[dim], dim) if merged else dim
    sums = vec.groupBy("id", dim.alias("dim")).agg(F.sum("value").alias("v"))
    norm = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy("id")))
    return sums.select("id", "dim", F.round(F.col("v") / norm, 6).alias("value")).where("value <> 0")


def translated(df: DataFrame, language: str) -> DataFrame:
    """``df`` (shape) with ``code``: a function of the shape in ``language``, one line per primitive that has one."""
    table, (before, after) = LINES[language], HEADS[language]
    has = lambda *w: F.col("shape").rlike("|".join(w))
    params = F.when(has("LOOP", "AGGREGATE", "FILTER"), "nums").when(has("BRANCH", "COMPARE"), "a, b").when(has("SORT"), "arr").when(has("SEARCH"), "arr, x").otherwise("a, b")
    one, many = RETURNS.get(language, ("", ""))
    ret = F.when(has("AGGREGATE", "ARITH"), one).otherwise(many)
    prims = F.split("shape", ">")
    loop = F.array_contains(prims, "LOOP")
    kept = F.filter(prims, lambda p: p.isin(*table) & ~(loop & p.isin("SEARCH", "STATE", "FILTER")))
    lines = F.transform(kept, lambda p: F.concat(F.when(p.isin("AGGREGATE", "FILTER") & loop, "        ").otherwise("    "), _map(table)[p]))
    head = F.concat(F.replace(F.lit(before), F.lit("{ret}"), ret), params, F.replace(F.lit(after), F.lit("{ret}"), ret))
    return df.withColumn("code", F.array_join(F.concat(F.array(head), lines, F.array(*([] if language == "python" else [F.lit("}")])).cast("array<string>")), "\n"))


def library_roles(calls: DataFrame, libraries: DataFrame) -> DataFrame:
    """``calls`` (module, call) with the ``role`` of the library table (module, call, role), by the whole call or the
    longest dotted prefix that has one, else by the module alone (an empty call); null without any."""
    parts = F.split("call", r"\.")
    prefixes = F.concat(F.transform(F.sequence(F.size(parts), F.lit(1)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), ".")), F.array(F.lit("")))
    keyed = calls.select("module", "call").distinct().select("module", "call", F.posexplode(prefixes).alias("rank", "key"))
    hit = keyed.join(libraries.select("module", F.col("call").alias("key"), "role"), ["module", "key"]).groupBy("module", "call").agg(F.min_by("role", "rank").alias("role"))
    return calls.join(hit, ["module", "call"], "left")
