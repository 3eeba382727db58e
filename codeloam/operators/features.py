"""Projections of code to features: primitives, intents, operations, efficiency, flow, properties. They shuffle nothing; only ``functions_of`` compares repeated rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloam.functions import lex, rules
from codeloam.operators import vectors
from codeloam.session import without_repeats

LANGUAGE = {"py": "python", "python3": "python", "js": "javascript", "golang": "go"}


def functions_of(table: DataFrame) -> DataFrame:
    """(fn_id, project, file, lang, code) of distinct functions with code; language labels in their plain form."""
    plain = F.lower(F.trim("language"))
    lang = F.coalesce(F.create_map(*[F.lit(x) for kv in LANGUAGE.items() for x in kv])[plain], plain)
    return without_repeats(table.where("fn_id is not null and full_code is not null").select("fn_id", "project", "file", lang.alias("lang"), F.col("full_code").alias("code")), "fn_id")


def with_tokens(df: DataFrame) -> DataFrame:
    return df.withColumn("toks", lex.tokens(F.col("code")))


def token_primitives(toks: Column, code: Column) -> dict[str, Column]:
    """Primitive counts by exact token."""
    out = {p: lex.among(toks, w) for p, w in rules.TOKEN_PRIMITIVES.items()}
    out["RECURSE"] = lex.recursive(code).cast("int")
    return {p: out[p] for p in rules.PRIMITIVES}


def pattern_primitives(text: Column, lang: Column) -> dict[str, Column]:
    """Primitive counts by the patterns of the row's language, on line-stripped text."""
    out = {}
    for p, default in rules.DEFAULT_PATTERNS.items():
        own = {}
        for name, table in rules.LANGUAGE_PATTERNS.items():
            if p in table:
                own.setdefault(tuple(table[p]), []).append(name)
        c = F.when(F.lit(False), F.lit(0))
        for pats, names in own.items():
            c = c.when(lang.isin(*names), lex.count_pattern(text, list(pats)))
        out[p] = c.otherwise(lex.count_pattern(text, default))
    return out


def detected_language(code: Column) -> Column:
    """The language with most hints, the first of equals; ``unknown`` without any."""
    scores = {k: sum((F.contains(code, F.lit(h)).cast("int") for h in hints), F.lit(0)) for k, hints in rules.LANGUAGE_HINTS.items()}
    best = F.greatest(*scores.values())
    return reduce(lambda acc, kv: acc.when(kv[1] == best, kv[0]), scores.items(), F.when(best == 0, "unknown"))


def adapter_language(code: Column) -> Column:
    """The language whose marks stand in the code; first registered first, three specific ones before the others."""
    out = F.when(F.lit(False), "")
    for name, parts in rules.ADAPTER_MARKS.items():
        out = out.when(reduce(lambda a, b: a | b, [F.contains(code, F.lit(m)) for m in parts]), name)
    return out.otherwise("python")


def intents(text: Column, table: dict[str, list[str]]) -> dict[str, Column]:
    return {d: lex.count_texts(text, parts) for d, parts in table.items()}


def type_hints(text: Column) -> dict[str, Column]:
    return {t: sum((F.contains(text, F.lit(p)).cast("int") for p in parts), F.lit(0)) for t, parts in rules.TYPE_HINTS.items()}


def control_flow(text: Column) -> Column:
    """B for branches, L for loops, R for recursion, S for none of them."""
    has = lambda *parts: reduce(lambda a, b: a | b, [F.contains(text, F.lit(p)) for p in parts])
    s = F.concat(F.when(has("if ", "else"), "B").otherwise(""), F.when(has("for ", "while ", "range("), "L").otherwise(""), F.when(has("recurs", "factorial(", "fibonacci("), "R").otherwise(""))
    return F.when(s == "", "S").otherwise(s)


def model_dims(text: Column, flow: Column) -> dict[str, Column]:
    """Operations, type hints and control flow as one vector's dims."""
    return {f"P:{d}": c for d, c in intents(text, rules.OPERATIONS).items()} | {f"T:{t}": c for t, c in type_hints(text).items()} | {f"C:{x}": F.contains(flow, F.lit(x)).cast("int") for x in "BLRS"}


def line_kind(line: Column) -> Column:
    text = F.trim(line)
    out = F.when(F.lit(False), "")
    for kind, pattern in rules.LINE_KINDS:
        out = out.when(text.rlike(pattern), kind)
    return out.otherwise("EXPR")


LOOP_LINE = r"^(?:for|while)\b"
_NO_STEP = r"^(?:for|while|if|else|elif|return|break|continue|import|from)"


def nesting(code: Column) -> Column:
    """Deepest loop nesting: a fold over lines that goes up at a loop, to 0 at a definition and down at a shallow line."""
    blank = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(acc: Column, line: Column) -> Column:
        text = F.regexp_replace(line, r"^\s+|\s+$", "")
        indent = F.length(line) - F.length(F.regexp_replace(line, r"^\s+", ""))
        now = (
            F.when(text.rlike(LOOP_LINE), acc["now"] + 1)
            .when(text.rlike(r"^(?:def|function)"), F.lit(0))
            .when((text != "") & ~text.rlike(_NO_STEP) & (acc["now"] > 0) & (indent <= 4 * (acc["now"] - 1)), acc["now"] - 1)
            .otherwise(acc["now"])
        )
        return F.struct(now.alias("now"), F.greatest(acc["most"], now).alias("most"))

    return F.aggregate(lex.lines(code), blank, step, lambda acc: acc["most"])


def lines_after_loop(code: Column, pattern: str) -> Column:
    """Lines below the first loop line that are no loop lines and match ``pattern``."""
    blank = F.struct(F.lit(False).alias("inside"), F.lit(0).alias("n"))

    def step(acc: Column, line: Column) -> Column:
        text = F.regexp_replace(line, r"^\s+|\s+$", "")
        loop = text.rlike(LOOP_LINE)
        return F.struct((acc["inside"] | loop).alias("inside"), (acc["n"] + F.when(acc["inside"] & ~loop & text.rlike(pattern), 1).otherwise(0)).alias("n"))

    return F.aggregate(lex.lines(code), blank, step, lambda acc: acc["n"])


def efficiency(code: Column) -> dict[str, Column]:
    """Signals of cost: loops, nesting, calls, threads, allocations, recursion, work repeated in loops."""
    return {
        "loops": F.regexp_count(code, F.lit(r"\b(?:for|while)\b")),
        "nesting": nesting(code),
        "method_calls": F.regexp_count(code, F.lit(r"\b\w+\.\w+\s*\(|\b\w+\s*\(")),
        "threaded": lex.matches_any(F.lower(code), rules.THREAD_WORDS),
        "allocations": F.regexp_count(code, F.lit(r"\[\]|\{\}|list\(|dict\(|set\(|new\s+\w+")),
        "recursive": lex.recursive(code, r"(?:def|function)\s+(\w+)\s*\("),
        "repeated": lines_after_loop(code, r"\w+\.\w+\s*\(|\w+\s*\("),
        "concat_in_loop": lines_after_loop(code, r"\w+\s*=\s*\w+\s*\+") > 0,
        "length_in_loop": lines_after_loop(code, r"len\s*\(|count\s*\(|sum\s*\(") > 0,
    }


def with_efficiency(df: DataFrame) -> DataFrame:
    """``df`` with the signals and the complexity class they tell."""
    df = df.withColumns(efficiency(F.col("code")))
    return df.withColumn(
        "complexity",
        F.expr(
            "case when recursive then if(contains(lower(code), 'fib'), 'O(2^n)', 'O(n)') when threaded then if(loops > 0, 'O(n)', 'O(1)') when nesting >= 3 then 'O(n^3)' when nesting = 2 then 'O(n^2)' "
            "when nesting = 1 and (concat_in_loop or length_in_loop) then 'O(n^2)' when nesting = 1 then 'O(n)' else 'O(1)' end"
        ),
    )


def efficiency_dims() -> dict[str, Column]:
    weight = F.create_map(*[F.lit(x) for kv in rules.COMPLEXITY_WEIGHT.items() for x in kv])
    return {
        "EFF_COMPLEXITY": F.coalesce(weight[F.col("complexity")], F.lit(1.0)),
        "EFF_LOOPS": F.col("loops"),
        "EFF_NESTING": F.col("nesting"),
        "EFF_METHOD_CALLS": F.col("method_calls"),
        "EFF_THREADED": F.when(F.col("threaded"), 3.0).otherwise(0.0),
        "EFF_ALLOC": F.col("allocations"),
        "EFF_RECURSION": F.col("recursive").cast("int"),
        "EFF_REPEATED": 2.0 * F.col("repeated"),
    }


def _follows(toks: Column, first: list[str], second: list[str]) -> Column:
    """Does a token among ``first`` stand right before one among ``second``?"""
    pairs = F.zip_with(toks, F.slice(toks, 2, F.greatest(F.size(toks) - 1, F.lit(0))), lambda a, b: a.isin(*first) & F.coalesce(b.isin(*second), F.lit(False)))
    return F.exists(pairs, lambda x: x)


def state_and_control_dims(toks: Column, text: Column) -> dict[str, Column]:
    """Statefulness, data, control, interface and resource dims."""
    has = lambda *w: F.arrays_overlap(toks, F.array(*[F.lit(x) for x in w]))
    one = lambda c: c.cast("int")
    compound = has("+=", "-=", "*=", "/=", "%=", "<<=", ">>=")
    mutates = compound | _follows(toks, ["."], ["append", "add", "update", "extend", "insert", "remove", "pop", "set", "push", "put"])
    io = text.rlike(r"\b(?:open|read|write|print|printf|requests|urlopen|fetch)\s*\(")
    returns = lex.among(toks, ["return", "yield"])
    loops = lex.among(toks, ["for", "while", "foreach", "until", "repeat"])
    params = F.regexp_extract(text, r"(?:def|function|func|fun)\s+\w+\s*\(([^)]*)\)", 1)
    return {
        "STATE:MUTATES": one(mutates),
        "STATE:GLOBAL": one(text.rlike(r"(?m)^\s*(?:global|nonlocal)\s+\w+")),
        "STATE:PURE": one(text.rlike(r"\b(?:def|function|func|fun|fn)\s+\w+\s*\(") & ~mutates & ~io),
        "DATA:NESTED": one(_follows(toks, ["["], ["{", "["]) | _follows(toks, ["{"], ["[", "{"])),
        "DATA:LARGE": one(text.rlike(r"\brange\s*\(\s*\d{3,}|\[\s*\d{3,}")),
        "DATA:TRANSFORM": one(_follows(toks, ["."], ["map", "filter", "reduce"]) | _follows(toks, ["for"], ["in"])),
        "CTRL:CYCLOMATIC": lex.among(toks, ["if", "else", "elif", "switch", "case", "when"]) + loops + returns,
        "CTRL:EARLY_RETURNS": F.when(returns > 1, returns).otherwise(0),
        "CTRL:EXCEPTIONS": one(has("try", "except", "finally", "catch", "throw")),
        "IFACE:ARITY": F.size(F.filter(F.split(params, ","), lambda p: F.trim(p) != "")),
        "IFACE:TYPED": one(F.contains(params, F.lit(":"))),
        "IFACE:DEFAULTS": one(F.contains(params, F.lit("="))),
        "IFACE:RETURN_TYPE": one(has("->")),
        "RES:IO": one(has("open", "read", "readline", "readlines", "write", "readFile", "writeFile", "close", "flush")),
        "RES:MEMORY": one(has("deepcopy", "copy", "list", "buffer", "alloc")),
        "RES:COMPUTE": one(loops >= 2),
        "RES:CONCURRENCY": one(has("thread", "async", "await", "multiprocess", "parallel", "goroutine") | _follows(toks, ["."], ["start", "join", "launch"])),
    }


def flow_dims(toks: Column) -> dict[str, Column]:
    """What is done to values on their way."""
    after_dot = lambda w: F.size(F.filter(F.zip_with(F.concat(F.array(F.lit(".")), toks), toks, lambda a, b: F.coalesce((a == ".") & b.isin(*w), F.lit(False))), lambda x: x))
    return {
        "FLOW:ARITH": lex.among(toks, ["+", "-", "*", "/", "%", "+=", "-=", "*=", "/=", "%="]),
        "FLOW:CONCAT": after_dot(["join"]) + lex.among(toks, ["format"]),
        "FLOW:CAST": lex.among(toks, ["int", "str", "float", "bool", "complex", "Number", "parseInt", "parseFloat", "toString"]),
        "FLOW:AGGREGATE": lex.among(toks, ["sum", "count", "reduce", "len", "min", "max"]),
        "FLOW:FILTER": lex.among(toks, ["filter", "where"]),
        "FLOW:SORT": lex.among(toks, ["sort", "sorted", "orderBy"]),
        "FLOW:SEARCH": lex.among(toks, ["find", "index", "contains", "includes", "search", "indexOf"]),
        "FLOW:MAP": lex.among(toks, ["map"]),
    }


def params_of(code: Column) -> Column:
    """Distinct parameter names of all definitions, without hints and defaults."""
    heads = F.regexp_extract_all(code, F.lit(r"(?:def|function|func|fun)\s+\w+\s*\(([^)]*)\)"), F.lit(1))
    names = F.flatten(F.transform(heads, lambda h: F.transform(F.split(h, ","), lambda p: F.trim(F.split(F.split(p, ":")[0], "=")[0]))))
    return F.array_distinct(F.filter(names, lambda n: n.rlike(r"^[A-Za-z_]")))


def value_ends(code: Column) -> dict[str, Column]:
    """Where values come from (IN) and go to (OUT)."""
    ins = {"IN:PARAM": F.size(params_of(code))} | {f"IN:{k}": code.rlike(p).cast("int") for k, p in rules.VALUE_SOURCES.items()}
    return ins | {f"OUT:{k}": F.regexp_count(code, F.lit(p)) for k, p in rules.VALUE_SINKS.items()}
