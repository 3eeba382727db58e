"""Queries of the detectors with places, of values inside texts and of flows over files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloam.functions import security as rules
from codeloam.operators import crossfile as cf
from codeloam.operators import graph as gr
from codeloam.operators import issues as iss
from codeloam.operators import paths as pt
from codeloam.operators import typeflow as tf
from codeloam.plans import sqltext as sq
from codeloam.plans.core import query
from codeloam.plans.features import _fns
from codeloam.plans.planted import planted, planted_units, typed, units_sql
from codeloam.session import cut, table


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """All functions of the table and the planted texts."""
    return _fns(spark, d).select("fn_id", "lang", "code").union(planted(spark))


def _units(spark: SparkSession, d: str) -> DataFrame:
    """All units of the table and the planted ones."""
    return gr.units_of(table(spark, d, "function_unit")).union(planted_units(spark))


def _table(rows: list[tuple], names: list[str]) -> str:
    cell = lambda v: "NULL" if v is None else sq.q(v) if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else str(v)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) AS t({', '.join(names)})"


#: What stands in the planted texts, by hand: id, line, weakness, sink, source, function.
ISSUES = [
    (-1, 2, "SQL_INJECTION", "SELECT id FROM users WHERE name = ' +", "name", "find_user"),
    (-3, 2, "DESERIALIZATION", "pickle.loads", "blob", "load"),
    (-4, 3, "CMD_INJECTION", "go(command)", "command", "<module>"),
    (-6, 2, "INSECURE_RANDOM", "random.randint(", None, "pick"),
    (-7, 2, "XSS", "innerHTML = '<b>' +", "label", "paint"),
    (-10, 2, "WEAK_HASH", "hashlib.md5(", "text", "digest"),
    (-12, 2, "SSRF", "requests.get(address", "address", "fetch"),
]


@query("pattern_issues", _table(ISSUES, ["fn_id", "line", "weakness", "sink", "source", '"function"']))
def pattern_issues(spark: SparkSession, d: str) -> DataFrame:
    """Sinks by pattern and under other names, with line, source and function; guarded and declared ones are none."""
    return iss.issues(_texts(spark, d), ["fn_id"]).where("detector in ('patterns', 'aliases')").select("fn_id", "line", "weakness", "sink", "source", "function")


@query("all_issues")
def all_issues(spark: SparkSession, d: str) -> DataFrame:
    """Findings of every detector, calls by role and unchecked indexes among them, with their paths."""
    return iss.issues(_texts(spark, d), ["fn_id"]).drop("code", "lang")


#: id, weakness id, category, severity: worked out from impact, public input, guards and number of assignments.
KNOWN = [
    (-1, "CWE-89", "A03:2021-Injection", "CRITICAL"),
    (-3, "CWE-502", "A08:2021-Software and Data Integrity Failures", "HIGH"),
    (-4, "CWE-78", "A03:2021-Injection", "HIGH"),
    (-6, "CWE-330", "A02:2021-Cryptographic Failures", "MEDIUM"),
    (-7, "CWE-79", "A03:2021-Injection", "HIGH"),
    (-10, "CWE-327", "A02:2021-Cryptographic Failures", "MEDIUM"),
    (-12, "CWE-918", "A10:2021-Server-Side Request Forgery (SSRF)", "HIGH"),
]


@query("enriched_findings", _table(KNOWN, ["fn_id", "cwe", "owasp", "severity"]))
def enriched_findings(spark: SparkSession, d: str) -> DataFrame:
    """Pattern findings with what is known about their weakness and the severity that their exploitability sets."""
    return iss.enriched_findings(_texts(spark, d), ["fn_id"]).where("detector in ('patterns', 'aliases')").select("fn_id", "cwe", "owasp", "severity")


@query("finding_details")
def finding_details(spark: SparkSession, d: str) -> DataFrame:
    """Every finding with taxonomy, remediation, tags, exploitability and verdict."""
    return iss.verdicts(iss.enriched_findings(_texts(spark, d), ["fn_id"]))


@query("finding_verdicts", _table([(-1, "source reaches sink", True), (-3, "source reaches sink", True), (-4, "source reaches sink", True), (-6, "mitigation near, for review", True), (-7, "source reaches sink", True), (-10, "source reaches sink", True), (-12, "source reaches sink", True)], ["fn_id", "reason", "kept"]))
def finding_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Whether a pattern finding is kept, and why."""
    return iss.verdicts(iss.issues(_texts(spark, d), ["fn_id"]).where("detector in ('patterns', 'aliases')")).select("fn_id", "reason", "kept")


@query("issue_summary")
def issue_summary(spark: SparkSession, d: str) -> DataFrame:
    """Findings by weakness, dimension and detector."""
    return iss.issues(_texts(spark, d), ["fn_id"]).groupBy("weakness", "dimension", "detector").agg(F.count("*").alias("findings"), F.countDistinct("fn_id").alias("texts"))


@query("ranked_findings")
def ranked_findings(spark: SparkSession, d: str) -> DataFrame:
    """The 20 most exploitable findings, best first; ties by id and line."""
    return iss.enriched_findings(_texts(spark, d), ["fn_id"]).orderBy(F.desc("score"), "fn_id", "line", "weakness").limit(20).select("fn_id", "line", "weakness", "score", "label")


@query("dangerous_intents")
def dangerous_intents(spark: SparkSession, d: str) -> DataFrame:
    """Calls that get a derived value and are dangerous by name or argument."""
    return iss.dangerous_intents(_texts(spark, d), ["fn_id"])


_HEAD_PARAMS = "SELECT fn_id, code, trim(split_part(split_part(trim(p), ':', 1), '=', 1)) AS name FROM (SELECT fn_id, code, unnest(string_split(raw, ',')) AS p FROM (SELECT fn_id, code, unnest(regexp_extract_all(code, '(?:def|function|func|fun)\\s+\\w+\\s*\\(([^)]*)\\)', 1)) AS raw FROM texts))"
_ASSIGN = "(\\w+)\\s*=\\s*([^;\\n]+)"
_INPUT = " OR ".join(f"regexp_matches(rhs, {sq.q(p)})" for k, p in rules.INPUTS.items() if k != "PARAM")


@query(
    "derived_names",
    f"""
    WITH RECURSIVE {sq.FNS}, texts AS (SELECT fn_id, code FROM fns),
    params AS (SELECT DISTINCT fn_id, name FROM ({_HEAD_PARAMS}) WHERE regexp_matches(name, '^[a-zA-Z_]')),
    a AS (SELECT fn_id, unnest(regexp_extract_all(code, {sq.q(_ASSIGN)}, 1)) AS name, trim(unnest(regexp_extract_all(code, {sq.q(_ASSIGN)}, 2))) AS rhs, unnest(range(len(regexp_extract_all(code, {sq.q(_ASSIGN)})))) AS nth FROM texts),
    last AS (SELECT DISTINCT ON (fn_id, name) fn_id, name, rhs FROM a WHERE NOT regexp_matches(rhs, '^(?:=|!=|<=|>=)') ORDER BY fn_id, name, nth DESC),
    t(fn_id, name) AS (SELECT fn_id, name FROM params UNION SELECT fn_id, name FROM last WHERE {_INPUT}
      UNION SELECT last.fn_id, last.name FROM last JOIN t ON t.fn_id = last.fn_id AND regexp_matches(last.rhs, '\\b' || regexp_escape(t.name) || '\\b'))
    SELECT DISTINCT fn_id, name FROM t
    """,
)
def derived_names(spark: SparkSession, d: str) -> DataFrame:
    """Names that derive from inputs: a fixed point over each text's assignments."""
    return iss.derived_names(_fns(spark, d), ["fn_id"]).select("fn_id", "name").distinct()


@query("taint_paths")
def taint_paths(spark: SparkSession, d: str) -> DataFrame:
    """The way of inputs into every line that returns."""
    return iss.return_paths(_fns(spark, d), ["fn_id"])


@query("output_kinds")
def output_kinds(spark: SparkSession, d: str) -> DataFrame:
    """How many outputs of every function carry which kinds of input."""
    return iss.output_kinds(_fns(spark, d), ["fn_id"]).select("fn_id", "output", F.explode_outer("kinds").alias("kind")).groupBy("fn_id", "output", "kind").agg(F.count("*").alias("outputs"))


@query("variable_types")
def variable_types(spark: SparkSession, d: str) -> DataFrame:
    """Type of every parameter and assigned name by hint, declaration, right side and use."""
    return iss.variable_types(_fns(spark, d), ["fn_id"])


@query("accesses")
def accesses(spark: SparkSession, d: str) -> DataFrame:
    """Subscripts by the type of what they index."""
    return iss.accesses(_texts(spark, d), ["fn_id"]).groupBy("fn_id", "class", "may_overflow").agg(F.count("*").alias("subscripts"))


@query("in_out_paths")
def in_out_paths(spark: SparkSession, d: str) -> DataFrame:
    """Every way of a value from an input of a function to a call or its return, with the weakness it passes."""
    fns = _texts(spark, d)
    found = iss.enriched_findings(fns, ["fn_id"]).select("fn_id", "line", "weakness", "cwe", "severity")
    return pt.with_issues(pt.in_out_paths(fns), found)


@query("flow_directions")
def flow_directions(spark: SparkSession, d: str) -> DataFrame:
    """Moves of values by the class of their ends."""
    return pt.flow_directions(_fns(spark, d))


@query("flow_intensities")
def flow_intensities(spark: SparkSession, d: str) -> DataFrame:
    """Density, fan-in, fan-out, used parameters and depth of the return."""
    return pt.flow_intensities(_fns(spark, d))


@query("flow_twins")
def flow_twins(spark: SparkSession, d: str) -> DataFrame:
    """Texts whose functions flow alike but for names: the signature's class and its size, for classes of two and more."""
    sig = cut(pt.flow_signatures(_fns(spark, d)).select("fn_id", F.xxhash64("signatures").alias("k"), F.size("signatures").alias("functions")))
    head = sig.groupBy("k").agg(F.min("fn_id").alias("class_id"), F.count("*").alias("texts")).where("texts > 1")
    return sig.join(head, "k").select("fn_id", "class_id", "texts", "functions")


@query("return_paths")
def return_paths(spark: SparkSession, d: str) -> DataFrame:
    """Fewest moves of a parameter's value to the return."""
    return pt.return_paths(_fns(spark, d))


@query("sinks_reached")
def sinks_reached(spark: SparkSession, d: str) -> DataFrame:
    """Calls of a dangerous role that parameters reach."""
    return pt.sinks_reached(_fns(spark, d))


_ALL = f"(SELECT unit_id, project, file, name, params, call_sites, body FROM function_unit UNION ALL {units_sql()})"
_UNITS = f"u AS (SELECT DISTINCT unit_id, project, file, name, params, call_sites, coalesce(body, '') AS body FROM {_ALL} WHERE name IS NOT NULL AND name <> '<module>' AND len(params) > 0)"
_ANY_WORD = lambda words: "(?i)\\b(?:" + "|".join(w.replace("$", "\\$") for w in words) + ")\\b"
_SINK_CASE = "CASE " + " ".join(f"WHEN regexp_matches(lower(line), '\\b{s}\\b') THEN '{s}'" for s in rules.FLOW_SINKS) + " END"
_FLOW_SQL = f"""
    WITH RECURSIVE {_UNITS},
    p AS (SELECT unit_id, project, file, name, call_sites, body, params[k] AS param, k AS pos, regexp_matches(body, {sq.q(_ANY_WORD(rules.FLOW_SOURCES))}) AS entry FROM (SELECT *, unnest(range(1, len(params) + 1)) AS k FROM u) WHERE params[k] IS NOT NULL),
    al AS (SELECT unit_id, param, v AS x FROM (SELECT unit_id, param, unnest(regexp_extract_all(body, '\\b(\\w+)\\s*=\\s*([^;\\n]+)', 1)) AS v, trim(unnest(regexp_extract_all(body, '\\b(\\w+)\\s*=\\s*([^;\\n]+)', 2))) AS rhs FROM p)
      WHERE NOT regexp_matches(rhs, '^(?:=|!=|<=|>=)') AND regexp_matches(rhs, '\\b' || regexp_escape(param) || '\\b') UNION SELECT unit_id, param, param FROM p),
    ln AS (SELECT unit_id, param, n, line, {_SINK_CASE} AS sink FROM (SELECT unit_id, param, unnest(string_split(body, chr(10))) AS line, unnest(range(1, len(string_split(body, chr(10))) + 1)) AS n FROM p)),
    hit AS (SELECT DISTINCT ON (unit_id, param) ln.unit_id, ln.param, n AS sink_line, sink FROM ln JOIN al ON al.unit_id = ln.unit_id AND al.param = ln.param WHERE sink IS NOT NULL AND regexp_matches(line, '\\b' || regexp_escape(x) || '\\b') ORDER BY ln.unit_id, ln.param, n),
    s AS (SELECT p.*, sink, sink_line FROM p LEFT JOIN hit USING (unit_id, param)),
    c AS (SELECT s.project, s.file, s.unit_id, s.param, s.name, site.callee AS callee, unnest(site.args) AS arg, unnest(range(1, len(site.args) + 1)) AS pos FROM (SELECT *, unnest(call_sites) AS site FROM s WHERE sink IS NULL) s),
    e AS (SELECT DISTINCT c.project, c.file, c.name, c.param, c.callee, c.pos FROM c JOIN al ON al.unit_id = c.unit_id AND al.param = c.param WHERE arg IS NOT NULL AND regexp_matches(arg, '\\b' || regexp_escape(x) || '\\b')),
    f AS (SELECT DISTINCT project, name, file, unit_id FROM u),
    r AS (SELECT e.*, coalesce((SELECT min(unit_id) FROM f WHERE f.project = e.project AND f.name = e.callee AND f.file = e.file), (SELECT arg_min(unit_id, (file, unit_id)) FROM f WHERE f.project = e.project AND f.name = e.callee)) AS to_unit FROM e),
    g AS (SELECT DISTINCT r.project, r.name, r.param, r.callee, t.param AS to_param FROM r JOIN s t ON t.unit_id = r.to_unit AND t.pos = r.pos),
    w(project, name, param) AS (SELECT DISTINCT project, name, param FROM s WHERE entry UNION SELECT g.project, g.callee, g.to_param FROM w JOIN g ON g.project = w.project AND g.name = w.name AND g.param = w.param)
    SELECT DISTINCT s.project, s.file, s.sink, s.sink_line FROM s JOIN w USING (project, name, param) WHERE sink IS NOT NULL
"""


@query("cross_file_flows", _FLOW_SQL)
def cross_file_flows(spark: SparkSession, d: str) -> DataFrame:
    """Lines with a sink that inputs reach over calls between functions and files of a project."""
    return cf.cross_file_flows(_units(spark, d)).select("project", "file", "sink", "sink_line")


@query(
    "passed_arguments",
    f"""
    WITH u AS (SELECT DISTINCT unit_id, project, file, name, params, call_sites FROM {_ALL}),
    c AS (SELECT project, file, name AS caller, site.callee AS callee, unnest(site.args) AS arg, unnest(range(1, len(site.args) + 1)) AS pos FROM (SELECT *, unnest(call_sites) AS site FROM u)),
    f AS (SELECT DISTINCT ON (project, name, file) project, name, file, params FROM u WHERE name IS NOT NULL AND name <> '<module>' AND len(params) > 0 ORDER BY project, name, file, unit_id),
    g AS (SELECT DISTINCT ON (project, name) project, name, params FROM f WHERE file IS NOT NULL ORDER BY project, name, file)
    SELECT DISTINCT c.project, c.file, caller, callee, arg, coalesce(f.params, g.params)[pos] AS param
    FROM c JOIN g ON g.project = c.project AND g.name = c.callee LEFT JOIN f ON f.project = c.project AND f.name = c.callee AND f.file = c.file WHERE pos <= len(coalesce(f.params, g.params))
    """,
)
def passed_arguments(spark: SparkSession, d: str) -> DataFrame:
    """Arguments of calls by the parameter they stand for."""
    return cf.passed_arguments(_units(spark, d))


#: By hand: 'a' is no list; k takes the type of n; 4 and rows stand in each other's place.
FLOWS = [
    (-41, "go", 6, "'a'", "xs", "STR", "LIST", False, True, False),
    (-41, "go", 6, "3", "n", "INT", "INT", False, False, False),
    (-41, "go", 7, "rows", "xs", "LIST", "LIST", False, False, False),
    (-41, "go", 7, "k", "n", "INT", "INT", False, False, False),
    (-41, "go", 8, "4", "xs", "INT", "LIST", False, True, True),
    (-41, "go", 8, "rows", "n", "LIST", "INT", False, True, True),
]


@query("type_flow", _table(FLOWS, ["fn_id", "caller", "line", "arg", "param", "arg_type", "param_type", "propagated", "error", "swapped"]))
def type_flow(spark: SparkSession, d: str) -> DataFrame:
    """Types of arguments against those of the parameters they stand for, between the functions of each text."""
    return tf.type_flow(_fns(spark, d).select("fn_id", "lang", "code").union(typed(spark))).drop("callee")


@query("inferred_types")
def inferred_types(spark: SparkSession, d: str) -> DataFrame:
    """Types of the names of Python texts by annotation, value, use and calls."""
    return tf.inferred_types(_fns(spark, d))


@query("type_profiles_inferred")
def type_profiles_inferred(spark: SparkSession, d: str) -> DataFrame:
    """Unit vectors of those types, the same under renaming."""
    return tf.profiles(tf.inferred_types(_fns(spark, d)))
