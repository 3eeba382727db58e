"""Queries of the detectors over universal_function."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloam.functions import rules
from codeloam.operators import detect as dt
from codeloam.operators import features as ft
from codeloam.plans import sqltext as sq
from codeloam.plans.core import query
from codeloam.plans.features import _PRIM_SQL, _fns
from codeloam.session import table

def _texts(spark: SparkSession, d: str) -> DataFrame:
    """(id, code) of all functions and all documents."""
    docs = table(spark, d, "documents").where("text is not null").select(F.concat(F.lit("doc "), "doc_id").alias("id"), F.col("text").alias("code"))
    return _fns(spark, d).select(F.concat(F.lit("fn "), "fn_id").alias("id"), "code").union(docs)


_TEXTS = f"{sq.FNS}, src AS (SELECT 'fn ' || fn_id AS id, code FROM fns UNION ALL SELECT 'doc ' || doc_id, text FROM documents WHERE text IS NOT NULL)"
_WEAK = " UNION ALL ".join(f"SELECT id, code, {sq.q(k)} AS kind, {sq.q(c)} AS cwe FROM src WHERE {sq.any_hit('code', s)} AND NOT {sq.any_hit('code', m)}" for k, c, s, m in rules.WEAKNESSES)


@query("weaknesses", f"WITH {_TEXTS} SELECT id, kind, cwe FROM ({_WEAK})")
def weaknesses(spark: SparkSession, d: str) -> DataFrame:
    return dt.weaknesses(_texts(spark, d), ["id"])


@query("weakness_signatures", f"""WITH {sq.FNS} SELECT fn_id, coalesce(nullif(concat_ws('>', CASE WHEN contains(code, '+') AND {sq.hit('code', 'execute|system|open|return.*<')} THEN 'CONCAT>DANGEROUS_SINK' END,
    CASE WHEN {sq.hit('code', r'pickle\.loads|eval\s*\(|exec\s*\(')} THEN 'UNSAFE_CALL' END, CASE WHEN {sq.hit('code', r'password\s*=|api_key\s*=|secret\s*=|connect\s*\([^)]*["' + chr(39) + ']')} THEN 'HARDCODED_SECRET' END,
    CASE WHEN {sq.hit('code', r'\[\w+\]')} AND NOT {sq.hit('code', r'if\s+0\s*<=')} THEN 'UNCHECKED_INDEX' END), ''), 'CLEAN') AS signature FROM fns""")
def weakness_signatures(spark: SparkSession, d: str) -> DataFrame:
    return _fns(spark, d).select("fn_id", dt.weakness_signature(F.col("code")).alias("signature"))


_SINKS = " UNION ALL ".join(f"SELECT fn_id, {sq.q(cat)} AS category, substr(trim(m), 1, 40) AS sink, {rules.SINK_IMPACT[cat]}::DOUBLE AS impact FROM (SELECT fn_id, unnest(regexp_extract_all(code, {sq.q('(?i)' + p)})) AS m FROM fns)" for cat, pats in rules.SINK_ROLES.items() for p in pats)


@query("pattern_sinks", f"WITH {sq.FNS} SELECT DISTINCT * FROM ({_SINKS})")
def pattern_sinks(spark: SparkSession, d: str) -> DataFrame:
    return dt.pattern_sinks(_fns(spark, d), ["fn_id"]).distinct()


_NAMED = f"""a AS (SELECT fn_id, code, list_concat(regexp_extract_all(code, {sq.q(dt.PLAIN_ALIAS)}, 1), list_filter(list_transform(range(1, len(regexp_extract_all(code, {sq.q(dt.DOTTED_ALIAS)}, 1)) + 1), lambda k: CASE WHEN regexp_matches(lower(regexp_extract_all(code, {sq.q(dt.DOTTED_ALIAS)}, 2)[k]), {sq.q('|'.join(dt.ALIAS_WORDS))}) THEN regexp_extract_all(code, {sq.q(dt.DOTTED_ALIAS)}, 1)[k] END), lambda x: x IS NOT NULL)) AS al FROM fns),
    c AS (SELECT DISTINCT fn_id, al, unnest(regexp_extract_all(code, '([a-zA-Z_]\\w*)\\s*\\(', 1)) AS sink FROM a),
    k AS (SELECT fn_id, sink, list_contains(al, sink) AS via_alias, CASE WHEN list_contains(al, sink) THEN 'CODE_EXEC' {' '.join('WHEN ' + ' OR '.join(sq.holds('lower(sink)', w) for w in ws) + f' THEN {sq.q(cat)}' for cat, ws in rules.SINK_WORDS.items())} END AS category FROM c WHERE sink NOT IN ({', '.join(map(sq.q, rules.NO_CALLS))}))"""


@query("named_sinks", f"WITH {sq.FNS}, {_NAMED} SELECT * FROM k WHERE category IS NOT NULL")
def named_sinks(spark: SparkSession, d: str) -> DataFrame:
    return dt.named_sinks(_fns(spark, d), ["fn_id"])


_CALLS = f"calls AS (SELECT DISTINCT c.callee AS name FROM (SELECT unnest(call_sites) AS c FROM function_unit) WHERE c.callee IS NOT NULL), w AS (SELECT name, lower(array_to_string(regexp_extract_all(regexp_replace(name, '([A-Z])([A-Z][a-z])', '\\1_\\2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|\\d+'), ' ')) AS text FROM calls)"
_ROLES = {r: " + ".join(f"{sq.holds('text', x)}::INT" for x in w) for r, w in rules.ROLE_WORDS.items()}


@query("sink_roles", f"WITH {_CALLS} SELECT name, text, CASE WHEN best = 0 THEN NULL {' '.join(f'WHEN {r} = best THEN {sq.q(r)}' for r in _ROLES)} END AS role, best AS score FROM (SELECT *, greatest({', '.join(_ROLES)}) AS best FROM (SELECT name, text, {', '.join(f'{e} AS {r}' for r, e in _ROLES.items())} FROM w)) WHERE best > 0")
def sink_roles(spark: SparkSession, d: str) -> DataFrame:
    """Roles of called names by their words."""
    names = table(spark, d, "function_unit").select(F.explode("call_sites.callee").alias("name")).where("name is not null").distinct().withColumn("text", dt.name_words(F.col("name")))
    return names.select("name", "text", dt.role_of(F.col("text")).alias("role"), F.greatest(*dt.role_scores(F.col("text")).values()).alias("score")).where("score > 0")


_HARD = " UNION ALL ".join(f"SELECT fn_id, i AS line, {sq.q(k)} AS kind, substr(trim(m), 1, 40) AS value FROM (SELECT fn_id, i, unnest(regexp_extract_all(text, {sq.q(p)})) AS m FROM ln)" for k, pats in rules.HARDCODED.items() for p in pats)
_LN = f"{sq.FNS}, ln AS (SELECT fn_id, unnest(l) AS text, generate_subscripts(l, 1) AS i FROM (SELECT fn_id, string_split(code, chr(10)) AS l FROM fns))"


@query("hardcoded_values", f"WITH {_LN} {_HARD}")
def hardcoded_values(spark: SparkSession, d: str) -> DataFrame:
    return dt.hardcoded(_fns(spark, d), ["fn_id"])


_EXPL = f"""e AS (SELECT *, CASE kind {' '.join(f"WHEN '{k}' THEN {v}" for k, v in rules.WEAKNESS_IMPACT.items())} ELSE 0.5 END::DOUBLE AS impact,
    CASE WHEN {sq.hit('code', dt.PUBLIC)} THEN 1.0 ELSE 0.3 END::DOUBLE AS public_taint, CASE WHEN {sq.hit('code', dt.SAFE)} THEN 0.0 ELSE 1.0 END::DOUBLE AS mitigated,
    greatest(0.0, 1.0 - 0.1 * {sq.matches('code', [r'\w+\s*=\s*[^;' + chr(10) + ']+'])})::DOUBLE AS directness FROM k),
    s AS (SELECT *, round(least(1.0, 0.4 * impact + 0.3 * public_taint + 0.2 * mitigated + 0.1 * directness), 9) AS raw FROM e)"""


_FOUND = "k AS (SELECT u.unit_id AS id, f.kind, u.body AS code FROM (SELECT DISTINCT project, file, vuln_type AS kind FROM finding WHERE file IS NOT NULL) f JOIN (SELECT DISTINCT project, file, unit_id, body FROM function_unit WHERE body IS NOT NULL) u USING (project, file))"


@query("exploitability", f"WITH {_FOUND}, {_EXPL} SELECT id, kind, impact, public_taint, mitigated, round(directness, 4) AS directness, round(raw, 2) AS score, CASE WHEN raw >= 0.8 THEN 'CRITICAL' WHEN raw >= 0.6 THEN 'HIGH' WHEN raw >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS label FROM s")
def exploitability(spark: SparkSession, d: str) -> DataFrame:
    """Exploitability of the kinds found in a file, in each of its units."""
    kinds = table(spark, d, "finding").where("file is not null").select("project", "file", F.col("vuln_type").alias("kind")).distinct()
    units = table(spark, d, "function_unit").where("body is not null").select("project", "file", F.col("unit_id").alias("id"), F.col("body").alias("code")).distinct()
    found = dt.exploitability(kinds.join(units, ["project", "file"]))
    return found.select("id", "kind", "impact", "public_taint", "mitigated", F.round("directness", 4).alias("directness"), "score", "label")


def _signature_sql(rows: list, a: float, b: float, least: float) -> str:
    out = []
    for name, needs, marks in rows:
        hits = " + ".join(f"{sq.hit('code', '(?i)' + m)}::INT" for m in marks)
        overlap = f"len(list_intersect([{', '.join(map(sq.q, dict.fromkeys(needs)))}], string_split(shape, '>')))::DOUBLE / {len(needs)}"
        out.append(f"SELECT fn_id, {sq.q(name)} AS name, round({a} * ({overlap}) + {b} * least(1.0, ({hits})::DOUBLE / {len(marks)}), 9) AS raw, ({hits}) AS hits FROM sh")
    shape = f"sh AS (SELECT fn_id, code, coalesce(shape, 'EMPTY') AS shape FROM toks LEFT JOIN ({sq.ranked_sql('toks', 'fn_id', _PRIM_SQL, 8)}) USING (fn_id))"
    return f"WITH {sq.TOKS}, {shape} SELECT fn_id, name, round(raw, 2) AS score, hits::INT AS hits FROM ({' UNION ALL '.join(out)}) WHERE hits > 0 AND raw >= {least}"


@query("algorithms", _signature_sql(rules.ALGORITHMS, 0.5, 0.5, 0.5))
def algorithms(spark: SparkSession, d: str) -> DataFrame:
    return dt.algorithms(_fns(spark, d), ["fn_id"])


@query("design_patterns", _signature_sql(rules.PATTERNS, 0.4, 0.6, 0.4))
def design_patterns(spark: SparkSession, d: str) -> DataFrame:
    return dt.design_patterns(_fns(spark, d), ["fn_id"])


@query("algorithm_aware_complexity")
def algorithm_aware_complexity(spark: SparkSession, d: str) -> DataFrame:
    """Complexity of the best known algorithm found, else what the shape tells, and its rank."""
    fns = _fns(spark, d)
    best = dt.algorithms(fns, ["fn_id"]).groupBy("fn_id").agg(F.max_by(F.struct("name", "score"), F.struct("score", F.col("name"))).alias("a"))
    known = F.create_map(*[F.lit(x) for kv in rules.ALGORITHM_COMPLEXITY.items() for x in kv])
    df = ft.with_efficiency(fns).select("fn_id", "complexity").join(best, "fn_id", "left")
    df = df.select("fn_id", F.coalesce(known[F.col("a.name")], F.col("complexity")).alias("complexity"), F.col("a.name").alias("algorithm"), F.coalesce(F.col("a.score"), F.lit(0.5)).alias("confidence"))
    rank = F.array_position(F.array(*[F.lit(c) for c in rules.COMPLEXITIES]), F.col("complexity"))
    return df.withColumn("rank", F.when(rank > 0, rank - 1).otherwise(len(rules.COMPLEXITIES)))


@query("returns_in_loops", f"WITH {_LN}, n AS (SELECT *, len(text) - len(regexp_replace(text, '^\\s+', '')) AS ind FROM ln) SELECT a.fn_id, a.i AS loop_line, b.i AS line FROM n a JOIN n b ON a.fn_id = b.fn_id AND b.i > a.i AND b.ind > a.ind WHERE {sq.hit('a.text', r'^\s*(?:for|while)\b')} AND contains(b.text, 'return')")
def returns_in_loops(spark: SparkSession, d: str) -> DataFrame:
    return dt.returns_in_loops(_fns(spark, d), ["fn_id"])


@query("unused_assignments", f"WITH {sq.FNS}, l AS (SELECT fn_id, regexp_extract_all(regexp_replace(code, '==', '~', 'g'), '\\b([a-zA-Z_]\\w*)\\s*(?:\\+=|-=|\\*=|/=|=)', 1) AS asg, regexp_extract_all(code, '[A-Za-z_]\\w*') AS used FROM fns), n AS (SELECT DISTINCT fn_id, unnest(asg) AS name, asg, used FROM l) SELECT fn_id, name FROM n WHERE len(list_filter(used, lambda x: x = name)) <= len(list_filter(asg, lambda x: x = name))")
def unused_assignments(spark: SparkSession, d: str) -> DataFrame:
    return dt.unused_assignments(_fns(spark, d), ["fn_id"])


_FILES = {"todo": r"(?i)\b(?:todo|fixme)\b", "async": r"\basync\b", "loop": r"\b(?:for|while)\b", "exec": r"\b(?:eval|exec)\s*\(", "docstring": r'"""', "async_await": r"\bawait\b", "index": r"\w+\[\w+\]"}


@query("signal_file_counts", f"WITH {sq.FNS} SELECT project, {', '.join(f'count(DISTINCT file) FILTER (WHERE {sq.hit("code", p)}) AS {k}' for k, p in _FILES.items())} FROM fns GROUP BY project")
def signal_file_counts(spark: SparkSession, d: str) -> DataFrame:
    """Files per project in which each of several signals occurs."""
    return _fns(spark, d).groupBy("project").agg(*[F.count_distinct(F.when(F.col("code").rlike(p), F.col("file"))).alias(k) for k, p in _FILES.items()])


