"""Queries of the feature operators over universal_function."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloam.functions import lex, rules
from codeloam.operators import features as ft
from codeloam.operators import vectors as vx
from codeloam.plans import sqltext as sq
from codeloam.plans.core import query
from codeloam.session import table

P = rules.PRIMITIVES
_PRIM_SQL = {p: sq.token_primitive(p) for p in P}


def _fns(spark: SparkSession, d: str) -> DataFrame:
    return ft.functions_of(table(spark, d, "universal_function"))


def _prims() -> dict:
    return ft.token_primitives(F.col("toks"), F.col("code"))


@query("prim_counts", f"WITH {sq.TOKS} SELECT fn_id, {', '.join(f'{e} AS {p.lower()}' for p, e in _PRIM_SQL.items())} FROM toks")
def prim_counts(spark: SparkSession, d: str) -> DataFrame:
    """Primitive counts by exact token."""
    return ft.with_tokens(_fns(spark, d)).select("fn_id", *[c.alias(p.lower()) for p, c in _prims().items()])


@query("prim_vector", f"WITH {sq.TOKS} {sq.long_sql('toks', 'fn_id', _PRIM_SQL, 'l2')}")
def prim_vector(spark: SparkSession, d: str) -> DataFrame:
    """Unit vector over the primitives."""
    return vx.unit_rows(ft.with_tokens(_fns(spark, d)), ["fn_id"], vx.packed(_prims()))


@query("shape_signature", f"WITH {sq.TOKS}, s AS ({sq.ranked_sql('toks', 'fn_id', _PRIM_SQL, 8)}) SELECT fn_id, coalesce(shape, 'EMPTY') AS shape FROM toks LEFT JOIN s USING (fn_id)")
def shape_signature(spark: SparkSession, d: str) -> DataFrame:
    """The eight dominant primitives."""
    return vx.with_top_names(ft.with_tokens(_fns(spark, d)), "shape", vx.packed(_prims()), P, 8).select("fn_id", "shape")


_LINE_STRIPPED = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(code, '(^|[^:])//[^\\n]*', '\\1', 'g'), '#[^\\n]*', '', 'g'), '\"[^\"\\\\]*(?:\\\\.[^\"\\\\]*)*\"', '\"\"', 'g'), '''[^''\\\\]*(?:\\\\.[^''\\\\]*)*''', '''''', 'g')"


def _by_language(p: str) -> str:
    whens = "".join(f" WHEN lang = {sq.q(n)} THEN {sq.matches('text', t[p])}" for n, t in rules.LANGUAGE_PATTERNS.items() if p in t)
    return f"CASE WHEN false THEN 0{whens} ELSE {sq.matches('text', rules.DEFAULT_PATTERNS[p])} END"


@query("prim_by_language", f"WITH {sq.FNS}, t AS (SELECT *, {_LINE_STRIPPED} AS text FROM fns) SELECT fn_id, {', '.join(f'{_by_language(p)} AS {p.lower()}' for p in rules.DEFAULT_PATTERNS)} FROM t")
def prim_by_language(spark: SparkSession, d: str) -> DataFrame:
    """Primitive counts by the patterns of each row's language."""
    df = _fns(spark, d).withColumn("text", lex.line_stripped(F.col("code")))
    return df.select("fn_id", *[c.alias(p.lower()) for p, c in ft.pattern_primitives(F.col("text"), F.col("lang")).items()])


_SCORES = {k: " + ".join(f"{sq.holds('code', h)}::INT" for h in hints) for k, hints in rules.LANGUAGE_HINTS.items()}


@query("detected_language", f"WITH {sq.FNS}, s AS (SELECT fn_id, lang, greatest({', '.join(_SCORES.values())}) AS best, {', '.join(f'{e} AS {k}' for k, e in _SCORES.items())} FROM fns) SELECT coalesce(lang, '-') AS labelled, CASE WHEN best = 0 THEN 'unknown' {' '.join(f'WHEN {k} = best THEN {sq.q(k)}' for k in _SCORES)} END AS detected, count(*) AS functions FROM s GROUP BY ALL")
def detected_language(spark: SparkSession, d: str) -> DataFrame:
    """Detected against labelled languages."""
    return _fns(spark, d).select(F.coalesce("lang", F.lit("-")).alias("labelled"), ft.detected_language(F.col("code")).alias("detected")).groupBy("labelled", "detected").agg(F.count("*").alias("functions"))


@query("adapter_language")
def adapter_language(spark: SparkSession, d: str) -> DataFrame:
    """The language whose patterns the code would be read with if it had no label."""
    return _fns(spark, d).groupBy(F.coalesce("lang", F.lit("-")).alias("labelled"), ft.adapter_language(F.col("code")).alias("adapter")).agg(F.count("*").alias("functions"))


def _intent(name: str, rule: dict, top: int) -> None:
    cols = {k: sq.parts("text", v) for k, v in rule.items()}

    def vector(spark: SparkSession, d: str) -> DataFrame:
        df = _fns(spark, d).withColumn("text", lex.normal(F.col("code")))
        return vx.share_rows(df, ["fn_id"], vx.packed(ft.intents(F.col("text"), rule)))

    def shape(spark: SparkSession, d: str) -> DataFrame:
        df = _fns(spark, d).withColumn("text", lex.normal(F.col("code")))
        return vx.with_top_names(df, "shape", vx.packed(ft.intents(F.col("text"), rule)), list(rule), top).select("fn_id", "shape")

    query(f"{name}_vector", f"WITH {sq.TEXTS} {sq.long_sql('texts', 'fn_id', cols, 'l1')}")(vector)
    query(f"{name}_shape", f"WITH {sq.TEXTS}, s AS ({sq.ranked_sql('texts', 'fn_id', cols, top)}) SELECT fn_id, coalesce(shape, 'EMPTY') AS shape FROM texts LEFT JOIN s USING (fn_id)")(shape)


_intent("intent", rules.INTENTS, 4)
_intent("fine_intent", rules.FINE_INTENTS, 5)

_FLOW = "CASE WHEN contains(text, 'if ') OR contains(text, 'else') THEN 'B' ELSE '' END || CASE WHEN contains(text, 'for ') OR contains(text, 'while ') OR contains(text, 'range(') THEN 'L' ELSE '' END || CASE WHEN contains(text, 'recurs') OR contains(text, 'factorial(') OR contains(text, 'fibonacci(') THEN 'R' ELSE '' END"
_MODEL_SQL = {f"P:{k}": sq.parts("text", v) for k, v in rules.OPERATIONS.items()} | {f"T:{t}": " + ".join(f"{sq.holds('text', p)}::INT" for p in v) for t, v in rules.TYPE_HINTS.items()} | {f"C:{x}": f"contains(flow, '{x}')::INT" for x in "BLRS"}
_MODEL = f"{sq.TEXTS}, m AS (SELECT *, CASE WHEN f = '' THEN 'S' ELSE f END AS flow FROM (SELECT *, {_FLOW} AS f FROM texts))"


@query("operation_counts", f"WITH {sq.TEXTS} {sq.long_sql('texts', 'fn_id', {k: sq.parts('text', v) for k, v in rules.OPERATIONS.items()}, 'none')}")
def operation_counts(spark: SparkSession, d: str) -> DataFrame:
    df = _fns(spark, d).withColumn("text", lex.normal(F.col("code")))
    return vx.exploded(df, ["fn_id"], vx.packed(ft.intents(F.col("text"), rules.OPERATIONS)))


def _model(spark: SparkSession, d: str) -> DataFrame:
    df = _fns(spark, d).withColumn("text", lex.normal(F.col("code")))
    return df.withColumn("flow", ft.control_flow(F.col("text")))


@query("model_vector", f"WITH {_MODEL} {sq.long_sql('m', 'fn_id', _MODEL_SQL, 'l2')}")
def model_vector(spark: SparkSession, d: str) -> DataFrame:
    """Unit vector over operations, type hints and control flow."""
    return vx.unit_rows(_model(spark, d), ["fn_id"], vx.packed(ft.model_dims(F.col("text"), F.col("flow"))))


_NEXT = f"{_MODEL}, o AS (SELECT m.*, lead(fn_id) OVER (PARTITION BY project, file ORDER BY fn_id) AS nxt0, lead(fn_id) OVER (PARTITION BY project ORDER BY fn_id) AS nxt FROM m)"


def _compose_sql() -> str:
    dims = _MODEL_SQL
    l = " UNION ALL ".join(f"SELECT fn_id, {sq.q(k)} AS dim, ({e})::DOUBLE AS v FROM m" for k, e in dims.items())
    weight = lambda mode: {"pipe": ("a.v", "b.v"), "branch": ("CASE WHEN dim LIKE 'P:%' THEN a.v / 2 ELSE a.v END", "CASE WHEN dim LIKE 'P:%' THEN b.v / 2 ELSE b.v END"), "nest": ("a.v", "CASE WHEN dim LIKE 'P:%' THEN b.v * 1.5 ELSE b.v END")}[mode]
    rows = " UNION ALL ".join(f"SELECT p.fn_id, p.nxt, '{mode}' AS mode, dim, {weight(mode)[0]} AS v FROM p JOIN l a ON a.fn_id = p.fn_id UNION ALL SELECT p.fn_id, p.nxt, '{mode}', dim, {weight(mode)[1]} FROM p JOIN l b ON b.fn_id = p.nxt" for mode in ("pipe", "branch", "nest"))
    return f"WITH {_NEXT}, p AS (SELECT fn_id, nxt FROM o WHERE nxt IS NOT NULL), l AS (SELECT * FROM ({l}) WHERE v <> 0), r AS ({rows}), s AS (SELECT fn_id, nxt, mode, dim, sum(v) AS v FROM r GROUP BY ALL) SELECT fn_id AS first_id, nxt AS second_id, mode, dim, round(v / sqrt(sum(v * v) OVER (PARTITION BY fn_id, nxt, mode)), 4) AS value FROM s"


@query("composed_vector", _compose_sql())
def composed_vector(spark: SparkSession, d: str) -> DataFrame:
    """Composition of each function with the next of its project: one after the other, as branches, nested."""
    df = _model(spark, d).select("fn_id", "project", vx.packed(ft.model_dims(F.col("text"), F.col("flow"))).alias("e"))
    w = Window.partitionBy("project").orderBy("fn_id")
    pairs = df.select("fn_id", F.lead("fn_id").over(w).alias("second_id"), "e", F.lead("e").over(w).alias("e2")).where("second_id is not null")
    inner = {"pipe": (1.0, 1.0), "branch": (0.5, 0.5), "nest": (1.0, 1.5)}
    scaled = lambda x, f: F.transform(x, lambda e: F.struct(e["dim"].alias("dim"), F.when(e["dim"].startswith("P:"), e["value"] * f).otherwise(e["value"]).alias("value")))
    modes = F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), F.concat(scaled(F.col("e"), a), scaled(F.col("e2"), b)).alias("both")) for m, (a, b) in inner.items()]))
    rows = pairs.select(F.col("fn_id").alias("first_id"), "second_id", modes.alias("m")).select("first_id", "second_id", "m.mode", F.explode("m.both").alias("x"))
    sums = rows.groupBy("first_id", "second_id", "mode", "x.dim").agg(F.sum("x.value").alias("v"))
    return sums.select("first_id", "second_id", "mode", "dim", F.round(F.col("v") / F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy("first_id", "second_id", "mode"))), 4).alias("value"))


@query("token_bag", f"WITH {sq.FNS} SELECT fn_id, t AS token, count(*) AS n FROM (SELECT fn_id, unnest(regexp_extract_all(code, {sq.q(lex.BAG_TOKEN)})) AS t FROM fns) GROUP BY ALL")
def token_bag(spark: SparkSession, d: str) -> DataFrame:
    """Bag of tokens."""
    return _fns(spark, d).select("fn_id", F.explode(lex.bag_tokens(F.col("code"))).alias("token")).groupBy("fn_id", "token").agg(F.count("*").alias("n"))


_KEPT = f"CASE WHEN t IN ({', '.join(map(sq.q, rules.BAG_KEYWORDS))}) OR NOT regexp_full_match(t, '[A-Za-z_][A-Za-z0-9_]*') THEN t ELSE '<id>' END"


@query("structural_bag", f"WITH {sq.FNS} SELECT fn_id, {_KEPT} AS token, count(*) AS n FROM (SELECT fn_id, unnest(regexp_extract_all(code, {sq.q(lex.BAG_TOKEN)})) AS t FROM fns) GROUP BY ALL")
def structural_bag(spark: SparkSession, d: str) -> DataFrame:
    """Bag of tokens with names masked."""
    t = _fns(spark, d).select("fn_id", F.explode(lex.bag_tokens(F.col("code"))).alias("t"))
    kept = F.when(F.col("t").isin(*rules.BAG_KEYWORDS) | ~F.col("t").rlike(r"^[A-Za-z_][A-Za-z0-9_]*$"), F.col("t")).otherwise("<id>")
    return t.groupBy("fn_id", kept.alias("token")).agg(F.count("*").alias("n"))


_LINES = f"{sq.FNS}, ln AS (SELECT fn_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM (SELECT fn_id, string_split(code, chr(10)) AS l FROM fns)), lt AS (SELECT *, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS txt FROM ln), lf AS (SELECT *, {sq.hit('txt', ft.LOOP_LINE)} AS is_loop FROM lt), lo AS (SELECT *, bool_or(is_loop) OVER (PARTITION BY fn_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS inside FROM lf)"
_AFTER = lambda p: f"count(*) FILTER (WHERE inside AND NOT is_loop AND {sq.hit('txt', p)})"


@query(
    "efficiency_signals",
    f"WITH {_LINES}, r AS (SELECT fn_id, {_AFTER(chr(92) + 'w+' + chr(92) + '.' + chr(92) + 'w+' + chr(92) + 's*' + chr(92) + '(|' + chr(92) + 'w+' + chr(92) + 's*' + chr(92) + '(')} AS repeated FROM lo GROUP BY fn_id) "
    f"SELECT fn_id, {sq.matches('code', [r'\b(?:for|while)\b'])} AS loops, {sq.matches('code', [r'\b\w+\.\w+\s*\(|\b\w+\s*\('])} AS method_calls, {sq.any_hit('lower(code)', rules.THREAD_WORDS)} AS threaded, "
    f"{sq.matches('code', [r'\[\]|\{\}|list\(|dict\(|set\(|new\s+\w+'])} AS allocations, {sq.recursive('code', sq.DEF_HEAD)} AS recursive, repeated::INT AS repeated FROM fns JOIN r USING (fn_id)",
)
def efficiency_signals(spark: SparkSession, d: str) -> DataFrame:
    """Signals of cost."""
    e = ft.efficiency(F.col("code"))
    return _fns(spark, d).select("fn_id", *[e[k].alias(k) for k in ("loops", "method_calls", "threaded", "allocations", "recursive", "repeated")])


@query("complexity_classes")
def complexity_classes(spark: SparkSession, d: str) -> DataFrame:
    """Complexity class by nesting, recursion and threads, with the deepest nesting."""
    return ft.with_efficiency(_fns(spark, d)).select("fn_id", "nesting", "complexity")


@query("efficiency_vector")
def efficiency_vector(spark: SparkSession, d: str) -> DataFrame:
    """Unit vector over the signals of cost."""
    return vx.unit_rows(ft.with_efficiency(_fns(spark, d)), ["fn_id"], vx.packed(ft.efficiency_dims()))


@query("unified_vector")
def unified_vector(spark: SparkSession, d: str) -> DataFrame:
    """Primitives and, twice as heavy, signals of cost; each part of unit length before."""
    df = ft.with_efficiency(ft.with_tokens(_fns(spark, d)))
    prims = vx.unit_rows(df, ["fn_id"], vx.packed(_prims())).select("fn_id", F.concat(F.lit("I:"), "dim").alias("dim"), "value")
    cost = vx.unit_rows(df, ["fn_id"], vx.packed(ft.efficiency_dims())).select("fn_id", F.concat(F.lit("E:"), "dim").alias("dim"), (2.0 * F.col("value")).alias("value"))
    return prims.union(cost)


@query("line_kinds", f"WITH {_LINES} SELECT fn_id, CASE {' '.join(f'WHEN {sq.hit("txt", p)} THEN {sq.q(k)}' for k, p in rules.LINE_KINDS)} ELSE 'EXPR' END AS kind, count(*) AS n FROM lt WHERE txt <> '' GROUP BY ALL")
def line_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Lines by kind."""
    rows = _fns(spark, d).select("fn_id", F.explode(lex.lines(F.col("code"))).alias("line")).withColumn("line", F.regexp_replace("line", r"^\s+|\s+$", "")).where("line <> ''")
    return rows.groupBy("fn_id", ft.line_kind(F.col("line")).alias("kind")).agg(F.count("*").alias("n"))


_HAS = lambda *w: f"list_has_any(toks, [{', '.join(map(sq.q, w))}])::INT"
_PARAMS = sq.head_name("text", r"(?:def|function|func|fun)\s+\w+\s*\(([^)]*)\)")
_DIMS_SQL = {
    "CTRL:CYCLOMATIC": " + ".join([sq.words_in("toks", ["if", "else", "elif", "switch", "case", "when"]), sq.words_in("toks", ["for", "while", "foreach", "until", "repeat"]), sq.words_in("toks", ["return", "yield"])]),
    "CTRL:EARLY_RETURNS": f"CASE WHEN {sq.words_in('toks', ['return', 'yield'])} > 1 THEN {sq.words_in('toks', ['return', 'yield'])} ELSE 0 END",
    "CTRL:EXCEPTIONS": _HAS("try", "except", "finally", "catch", "throw"),
    "DATA:LARGE": sq.hit("text", r"\brange\s*\(\s*\d{3,}|\[\s*\d{3,}") + "::INT",
    "IFACE:ARITY": f"len(list_filter(string_split({_PARAMS}, ','), lambda p: trim(p) <> ''))",
    "IFACE:TYPED": f"contains({_PARAMS}, ':')::INT",
    "IFACE:DEFAULTS": f"contains({_PARAMS}, '=')::INT",
    "IFACE:RETURN_TYPE": _HAS("->"),
    "RES:IO": _HAS("open", "read", "readline", "readlines", "write", "readFile", "writeFile", "close", "flush"),
    "RES:MEMORY": _HAS("deepcopy", "copy", "list", "buffer", "alloc"),
    "RES:COMPUTE": f"({sq.words_in('toks', ['for', 'while', 'foreach', 'until', 'repeat'])} >= 2)::INT",
}


@query("interface_dims", f"WITH {sq.TOKS} {sq.long_sql('toks', 'fn_id', _DIMS_SQL, 'none')}")
def interface_dims(spark: SparkSession, d: str) -> DataFrame:
    """Control, interface and resource dims."""
    df = ft.with_tokens(_fns(spark, d)).withColumn("text", lex.stripped(F.col("code")))
    dims = ft.state_and_control_dims(F.col("toks"), F.col("text"))
    return vx.exploded(df, ["fn_id"], vx.packed({k: dims[k] for k in _DIMS_SQL}))


@query("state_dims")
def state_dims(spark: SparkSession, d: str) -> DataFrame:
    """All statefulness, data, control, interface and resource dims."""
    df = ft.with_tokens(_fns(spark, d)).withColumn("text", lex.stripped(F.col("code")))
    return vx.exploded(df, ["fn_id"], vx.packed(ft.state_and_control_dims(F.col("toks"), F.col("text"))))


_ENDS_SQL = {f"IN:{k}": sq.hit("code", p) + "::INT" for k, p in rules.VALUE_SOURCES.items()} | {f"OUT:{k}": sq.matches("code", [p]) for k, p in rules.VALUE_SINKS.items()}


@query("value_ends", f"WITH {sq.FNS} {sq.long_sql('fns', 'fn_id', _ENDS_SQL, 'none')}")
def value_ends(spark: SparkSession, d: str) -> DataFrame:
    """Where values come from and go to."""
    ends = ft.value_ends(F.col("code"))
    return vx.exploded(_fns(spark, d), ["fn_id"], vx.packed({k: ends[k] for k in _ENDS_SQL}))


@query("value_flow_vector")
def value_flow_vector(spark: SparkSession, d: str) -> DataFrame:
    """Sources, flow operations and sinks of values as a unit vector."""
    return vx.unit_rows(ft.with_tokens(_fns(spark, d)), ["fn_id"], vx.packed(ft.value_ends(F.col("code")) | ft.flow_dims(F.col("toks"))))
