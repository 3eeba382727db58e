"""Queries of graphs, projects, snapshots over time and similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloam.functions import lex, rules
from codeloam.operators import clones as cl
from codeloam.operators import detect as dt
from codeloam.operators import features as ft
from codeloam.operators import graph as gr
from codeloam.operators import memory as mem
from codeloam.operators import project as pj
from codeloam.operators import similarity as sim
from codeloam.operators import vectors as vx
from codeloam.plans import sqltext as sq
from codeloam.plans.core import query
from codeloam.plans.features import _PRIM_SQL, _fns, _prims
from codeloam.session import table


def _units(spark: SparkSession, d: str) -> DataFrame:
    return gr.units_of(table(spark, d, "function_unit"))


_U = "u AS (SELECT DISTINCT unit_id, project, file, name, params, call_sites, body FROM function_unit), c AS (SELECT project, file, name AS caller, s.callee AS callee, coalesce(len(s.args), -1) AS n_args, s.line AS line FROM (SELECT project, file, name, unnest(call_sites) AS s FROM u)), d AS (SELECT project, name, arg_max(file, (file, unit_id)) AS file, arg_max(coalesce(len(params), -1), (file, unit_id)) AS arity FROM u WHERE name <> '<module>' GROUP BY ALL)"


@query("call_resolution", f"WITH {_U} SELECT project, count(*) AS calls, count(DISTINCT callee) AS callees, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM d WHERE d.project = c.project AND (d.name = c.callee OR d.name = list_last(string_split(c.callee, '.'))))) AS resolved FROM c GROUP BY project")
def call_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Calls per project and how many have a definition in it."""
    return gr.resolved(_units(spark, d)).groupBy("project").agg(F.count("*").alias("calls"), F.count_distinct("callee").alias("callees"), F.count("to_file").alias("resolved"))


@query("call_degrees", f"WITH {_U}, e AS (SELECT DISTINCT project, caller AS src, callee AS dst FROM c), n AS (SELECT project, node, sum(o) AS o, sum(i) AS i FROM (SELECT project, src AS node, 1 AS o, 0 AS i FROM e UNION ALL SELECT project, dst, 0, 1 FROM e) GROUP BY ALL) SELECT project, sum(o)::BIGINT AS edges, count(*) AS nodes, max(i)::BIGINT AS max_fan_in, max(o)::BIGINT AS max_fan_out FROM n GROUP BY project")
def call_degrees(spark: SparkSession, d: str) -> DataFrame:
    """Size and degrees of each project's call graph."""
    e = gr.calls(_units(spark, d)).select("project", F.col("caller").alias("src"), F.col("callee").alias("dst"))
    return gr.degrees(e, ["project"])


@query("missing_callees", f"WITH {_U} SELECT project, callee, count(*) AS calls FROM c WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.project = c.project AND d.name = c.callee) GROUP BY ALL")
def missing_callees(spark: SparkSession, d: str) -> DataFrame:
    return gr.missing_callees(_units(spark, d))


@query("unused_functions", f"WITH {_U} SELECT project, name, file FROM d WHERE name NOT IN ('main', 'Main') AND NOT EXISTS (SELECT 1 FROM c WHERE c.project = d.project AND c.callee = d.name)")
def unused_functions(spark: SparkSession, d: str) -> DataFrame:
    return gr.unused_functions(_units(spark, d))


@query("arity_mismatches", f"WITH {_U} SELECT c.project, c.file, c.caller, c.callee, c.n_args, d.arity FROM c JOIN d ON d.project = c.project AND d.name = c.callee WHERE d.arity >= 0 AND c.n_args <> d.arity AND c.callee <> c.caller")
def arity_mismatches(spark: SparkSession, d: str) -> DataFrame:
    return gr.arity_mismatches(_units(spark, d)).select("project", "file", "caller", "callee", "n_args", "arity")


_EDGES = "e AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem)"


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"))


@query("edge_cycles", f"WITH {_EDGES} SELECT count(*) AS cycles FROM e a JOIN e b ON a.src = b.dst AND a.dst = b.src")
def edge_cycles(spark: SparkSession, d: str) -> DataFrame:
    """Self-loops and mutual pairs of a directed graph over one node space."""
    return gr.two_cycles(_edges(spark, d))


@query("reachable", f"WITH RECURSIVE {_EDGES}, r(node, hops) AS (SELECT 1::BIGINT, 0 UNION SELECT e.dst, r.hops + 1 FROM r JOIN e ON e.src = r.node WHERE r.hops < 3) SELECT node, min(hops) AS hops FROM r GROUP BY node")
def reachable(spark: SparkSession, d: str) -> DataFrame:
    """Nodes within three steps of node 1."""
    return gr.hops(_edges(spark, d), spark.range(1, 2).select(F.col("id").alias("node")), 3)


_SPANS = "SELECT f.finding_id, arg_min(s.name, (s.end_line - s.start_line, -s.start_line, s.name)) AS function, min(s.end_line - s.start_line) AS width FROM (SELECT DISTINCT finding_id, project, line FROM finding WHERE line IS NOT NULL) f JOIN (SELECT DISTINCT fn_id, project, name, start_line, end_line FROM universal_function WHERE name IS NOT NULL) s ON s.project = f.project AND f.line BETWEEN s.start_line AND s.end_line GROUP BY f.finding_id"


@query("enclosing_functions", _SPANS)
def enclosing_functions(spark: SparkSession, d: str) -> DataFrame:
    """The narrowest function of the project around each finding's line."""
    points = table(spark, d, "finding").where("line is not null").select("finding_id", "project", "line").distinct()
    spans = table(spark, d, "universal_function").where("name is not null").select("fn_id", "project", "name", "start_line", "end_line").distinct()
    return gr.enclosing(points, spans, ["project"], "finding_id")


def _imports_sql() -> str:
    ext = {"python": "py", "javascript": "js", "java": "java", "go": "go", "c": "c|h"}
    rows = " UNION ALL ".join(f"SELECT DISTINCT project, file, '{k}' AS lang, unnest(regexp_extract_all(body, {sq.q(p)}, 1)) AS module FROM u WHERE name = '<module>' AND regexp_matches(lower(file), '\\.({ext[k]})$')" for k, p in gr.IMPORTS.items())
    return f"{_U}, i AS (SELECT DISTINCT * FROM ({rows}))"


@query("imports", f"WITH {_imports_sql()} SELECT * FROM i")
def imports(spark: SparkSession, d: str) -> DataFrame:
    return gr.imports(_units(spark, d))


@query("import_shares", f"WITH {_imports_sql()}, m AS (SELECT project, module, count(*) AS files FROM i GROUP BY ALL) SELECT project, module, files, rank FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY files DESC, module) AS rank FROM m) WHERE rank <= 10")
def import_shares(spark: SparkSession, d: str) -> DataFrame:
    """The ten most imported modules of each project."""
    from pyspark.sql import Window

    m = gr.imports(_units(spark, d)).groupBy("project", "module").agg(F.count("*").alias("files"))
    w = Window.partitionBy("project").orderBy(F.desc("files"), "module")
    return m.withColumn("rank", F.row_number().over(w)).where("rank <= 10")


@query("importers", f"WITH {_imports_sql()} SELECT module, count(*) AS files, count(DISTINCT project) AS projects, min(file) AS first_file FROM i GROUP BY module")
def importers(spark: SparkSession, d: str) -> DataFrame:
    """Who imports a module: the reverse of the import table."""
    return gr.imports(_units(spark, d)).groupBy("module").agg(F.count("*").alias("files"), F.count_distinct("project").alias("projects"), F.min("file").alias("first_file"))


_SUMS = ", ".join(f"sum({e})::BIGINT AS {p.lower()}" for p, e in _PRIM_SQL.items())


@query("language_rollup", f"WITH {sq.TOKS}, t AS (SELECT project, coalesce(lang, '-') AS lang, file, {', '.join(f'{e} AS {p.lower()}' for p, e in _PRIM_SQL.items())} FROM toks) SELECT coalesce(project, '*') AS project, CASE WHEN grouping(lang) = 1 THEN '*' ELSE lang END AS lang, count(*) AS functions, count(DISTINCT file) AS files, {', '.join(f'sum({p.lower()})::BIGINT AS {p.lower()}' for p in _PRIM_SQL)} FROM t GROUP BY ROLLUP (project, lang)")
def language_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Functions, files and primitives by project and language, by project, and over all."""
    df = ft.with_tokens(_fns(spark, d)).select("project", F.coalesce("lang", F.lit("-")).alias("lang"), "file", *[c.alias(p.lower()) for p, c in _prims().items()])
    out = df.rollup("project", "lang").agg(F.grouping("lang").alias("g"), F.count("*").alias("functions"), F.count_distinct("file").alias("files"), *[F.sum(p.lower()).alias(p.lower()) for p in rules.PRIMITIVES])
    return out.withColumn("lang", F.when(F.col("g") == 1, "*").otherwise(F.col("lang"))).withColumn("project", F.coalesce("project", F.lit("*"))).drop("g")


@query("project_composite")
def project_composite(spark: SparkSession, d: str) -> DataFrame:
    """Composite vector of every project."""
    units = _units(spark, d)
    connections = gr.calls(units).groupBy("project").agg(F.count("*").alias("n"))
    modules = gr.imports(units).groupBy("project").agg(F.count_distinct("module").alias("n"))
    return pj.composite(_fns(spark, d), connections, modules)


@query("composite_summary")
def composite_summary(spark: SparkSession, d: str) -> DataFrame:
    """The six greatest dims of each family of a project's composite."""
    return vx.top_per_family(project_composite(spark, d), ["project"], 6)


_F = "f AS (SELECT DISTINCT finding_id, project, file, vuln_type, coalesce(upper(trim(severity)), 'MEDIUM') AS severity, line, cwe_id, sink, detector FROM finding), w AS (SELECT *, CASE severity WHEN 'CRITICAL' THEN 1.0 WHEN 'HIGH' THEN 0.7 WHEN 'MEDIUM' THEN 0.4 WHEN 'LOW' THEN 0.2 ELSE 0.4 END::DOUBLE AS weight FROM f)"
_GRADE = "CASE WHEN risk >= 0.8 THEN 'F' WHEN risk >= 0.6 THEN 'D' WHEN risk >= 0.4 THEN 'C' WHEN risk >= 0.2 THEN 'B' WHEN risk > 0 THEN 'A' ELSE 'A+' END"


def _findings(spark: SparkSession, d: str) -> DataFrame:
    return pj.findings_of(table(spark, d, "finding"))


@query("posture", f"WITH {_F} SELECT CASE WHEN grouping(vuln_type) = 0 THEN 'kind' WHEN grouping(severity) = 0 THEN 'severity' WHEN grouping(cwe_id) = 0 THEN 'cwe' WHEN grouping(file) = 0 THEN 'file' ELSE 'all' END AS facet, coalesce(vuln_type, severity, cwe_id, file) AS name, count(*) AS findings, max(weight) AS risk FROM w GROUP BY GROUPING SETS ((vuln_type), (severity), (cwe_id), (file), ())")
def posture(spark: SparkSession, d: str) -> DataFrame:
    return pj.posture(_findings(spark, d))


@query("severity_counts", f"WITH {_F} SELECT project, {', '.join(f'count(*) FILTER (WHERE severity = {sq.q(s)}) AS {sq.q(s)[1:-1]}' for s in rules.SEVERITY_WEIGHT)} FROM f GROUP BY project")
def severity_counts(spark: SparkSession, d: str) -> DataFrame:
    return pj.severities(_findings(spark, d), ["project"])


@query("project_grades", f"WITH {_F}, r AS (SELECT project, count(*) AS findings, round(max(weight), 3) AS risk FROM w GROUP BY project) SELECT *, {_GRADE} AS grade FROM r")
def project_grades(spark: SparkSession, d: str) -> DataFrame:
    return pj.grades(_findings(spark, d), ["project"])


@query("risky_files", f"WITH {_F}, r AS (SELECT project, file, count(*) AS findings, round(max(weight), 3) AS risk FROM w WHERE file IS NOT NULL GROUP BY ALL) SELECT *, {_GRADE} AS grade FROM r ORDER BY risk DESC, findings DESC, project, file LIMIT 10")
def risky_files(spark: SparkSession, d: str) -> DataFrame:
    return pj.risky_files(_findings(spark, d))


@query("remediations", f"WITH {_F}, t AS (SELECT DISTINCT project, file, coalesce(line, -1) AS o, 'L' || coalesce(line::VARCHAR, 'None') || ' ' || vuln_type || ': Review this code path.' AS t FROM f) SELECT project, file, string_agg(t, chr(10) ORDER BY o, t) AS lines FROM t GROUP BY project, file")
def remediations(spark: SparkSession, d: str) -> DataFrame:
    return pj.remediations(_findings(spark, d))


_ENT = lambda c: f"list_sort(list_filter([{{'dim': e.key, 'value': round(e.value, 4)}} FOR e IN map_entries(coalesce({c}, MAP {{}}))], lambda e: e.value <> 0))"
_SET = lambda c: f"list_sort(list_distinct(coalesce({c}, [])))"
_SNAP = f"""s0 AS (SELECT DISTINCT ON (snapshot_id, delivery_no, loaded_at) snapshot_id, delivery_no, regexp_replace(trim(target, E' \\t\\r\\n'), '^\\./', '') AS target, loaded_at, lower(regexp_replace(complexity, '\\s+', '', 'g')) AS complexity,
    {_ENT('enriched')} AS en, {_ENT('composite')} AS co, {_ENT('type_profile')} AS types, {_SET('algorithms')} AS algorithms, {_SET('patterns')} AS patterns, {_SET('vuln_types')} AS vulns,
    coalesce(type_flow.propagations, 0) AS propagations, coalesce(type_flow.type_errors, 0) AS type_errors FROM shape_snapshot WHERE target IS NOT NULL), s AS (SELECT *, CASE WHEN len(en) > 0 THEN en ELSE co END AS vec FROM s0)"""


def _snaps(spark: SparkSession, d: str) -> DataFrame:
    return mem.snapshots_of(table(spark, d, "shape_snapshot"))


@query("snapshot_history", f"WITH {_SNAP} SELECT target, snapshot_id, back FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY delivery_no DESC, loaded_at DESC, snapshot_id DESC) AS back FROM s) WHERE back <= 5")
def snapshot_history(spark: SparkSession, d: str) -> DataFrame:
    """The last five snapshots of each target."""
    return mem.history(_snaps(spark, d)).select("target", "snapshot_id", "back")


_PAIR = f"{_SNAP}, p AS (SELECT *, lag(snapshot_id) OVER w AS old_id, lag(vec) OVER w AS ovec, lag(types) OVER w AS otypes, lag(algorithms) OVER w AS oalg, lag(patterns) OVER w AS opat, lag(vulns) OVER w AS ovul, lag(complexity) OVER w AS ocx, lag(propagations) OVER w AS oprop, lag(type_errors) OVER w AS oerr FROM s WINDOW w AS (PARTITION BY target ORDER BY delivery_no, loaded_at, snapshot_id))"
_DELTA = lambda new, old, name: f"{name} AS (SELECT coalesce(a.i, b.i) AS i, coalesce(a.dim, b.dim) AS dim, coalesce(b.value, 0) AS old_value, coalesce(a.value, 0) AS new_value FROM (SELECT snapshot_id AS i, unnest({new}, recursive := true) FROM p WHERE old_id IS NOT NULL) a FULL JOIN (SELECT snapshot_id AS i, unnest({old}, recursive := true) FROM p WHERE old_id IS NOT NULL) b ON a.i = b.i AND a.dim = b.dim)"


@query("snapshot_dim_changes", f"WITH {_PAIR}, {_DELTA('vec', 'ovec', 'x')} SELECT i AS new_id, dim, old_value::DOUBLE AS old_value, new_value::DOUBLE AS new_value FROM x WHERE abs(new_value - old_value) > 1e-9")
def snapshot_dim_changes(spark: SparkSession, d: str) -> DataFrame:
    """Dims that changed between consecutive snapshots of a target."""
    return mem.diffs(_snaps(spark, d)).select("new_id", F.explode("changed").alias("c")).select("new_id", "c.*")


_DIR = "CASE WHEN ocx IS NULL OR complexity IS NULL OR ocx = complexity OR a IS NULL OR b IS NULL THEN 'same' WHEN b < a THEN 'improved' ELSE 'degraded' END"
_ORD = "[" + ", ".join(sq.q(c.replace(" ", "").lower()) for c in rules.COMPLEXITIES) + "]"


@query(
    "snapshot_cascades",
    f"""WITH {_PAIR}, {_DELTA('vec', 'ovec', 'x')}, {_DELTA('types', 'otypes', 'y')}, n AS (SELECT i, count(*) AS dims, count(*) FILTER (WHERE abs(new_value - old_value) > 1e-9) AS ch FROM x GROUP BY i), m AS (SELECT i, count(*) FILTER (WHERE abs(new_value - old_value) > 1e-9) AS tc FROM y GROUP BY i),
    q AS (SELECT p.*, coalesce(dims, 0) AS dims, coalesce(ch, 0) AS ch, coalesce(tc, 0) AS tc, list_position({_ORD}, ocx) AS a, list_position({_ORD}, complexity) AS b,
      len(list_filter(algorithms, lambda v: NOT list_contains(oalg, v))) + len(list_filter(oalg, lambda v: NOT list_contains(algorithms, v))) + len(list_filter(patterns, lambda v: NOT list_contains(opat, v))) + len(list_filter(opat, lambda v: NOT list_contains(patterns, v))) AS ev,
      len(list_filter(vulns, lambda v: NOT list_contains(ovul, v))) AS vg, len(list_filter(ovul, lambda v: NOT list_contains(vulns, v))) AS vf, (ocx IS DISTINCT FROM complexity) AS cc, (oprop <> propagations OR oerr <> type_errors) AS fc
      FROM p LEFT JOIN n ON n.i = snapshot_id LEFT JOIN m ON m.i = snapshot_id WHERE old_id IS NOT NULL)
    SELECT target, old_id, snapshot_id AS new_id, ch AS changed_dims, vg AS vulns_gained, vf AS vulns_fixed, cc AS complexity_changed, {_DIR} AS complexity_direction,
      round(round(0.45 * least(ch::DOUBLE / greatest(dims, 1), 1) + 0.25 * least((ev + vg + vf + CASE WHEN cc THEN 2 ELSE 0 END) / 10.0::DOUBLE, 1) + 0.2 * least(tc / 8.0::DOUBLE, 1) + 0.1 * fc::INT, 9), 3) AS cascade FROM q""",
)
def snapshot_cascades(spark: SparkSession, d: str) -> DataFrame:
    """How far each change of a target cascades."""
    p = mem.diffs(_snaps(spark, d))
    return p.select("target", "old_id", "new_id", F.size("changed").alias("changed_dims"), F.size("vulns_gained").alias("vulns_gained"), F.size("vulns_fixed").alias("vulns_fixed"), "complexity_changed", "complexity_direction", "cascade")


@query("snapshot_verdicts")
def snapshot_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return mem.diffs(_snaps(spark, d)).groupBy("verdict").agg(F.count("*").alias("changes"), F.round(F.avg("cascade"), 6).alias("mean_cascade"))


@query("target_slugs", f"WITH {_SNAP} SELECT DISTINCT target, substr(regexp_replace(regexp_replace(regexp_replace(target, '[^A-Za-z0-9_\\-.]', '_', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g'), 1, 40) || '_' || substr(sha1(target), 1, 8) AS slug FROM s")
def target_slugs(spark: SparkSession, d: str) -> DataFrame:
    return _snaps(spark, d).select("target").distinct().select("target", mem.slug(F.col("target")).alias("slug"))


_VEC = f"{_SNAP}, v AS (SELECT snapshot_id AS id, unnest(vec, recursive := true) FROM s)"


def _vec(spark: SparkSession, d: str) -> DataFrame:
    return _snaps(spark, d).select(F.col("snapshot_id").alias("id"), F.explode("vec").alias("e")).select("id", "e.dim", "e.value")


@query("shape_metrics", f"WITH {_VEC}, a AS (SELECT id, sum(abs(value)) AS s, sum(value * value) AS q, max(abs(value)) AS m, sum(abs(value) * log2(abs(value))) AS l, count(*) AS n FROM v GROUP BY id), b AS (SELECT *, s / 92 AS mean, sqrt(greatest(q / 92 - (s / 92) * (s / 92), 0)) AS sd FROM a) SELECT id, round(log2(s) - l / s, 4) AS entropy, round(n / 92, 4) AS spread, round(CASE WHEN sd > 0 THEN (m - mean) / sd ELSE 0 END, 4) AS skew FROM b")
def shape_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Entropy, spread and skew of every snapshot's vector."""
    return vx.shape_metrics(_vec(spark, d), ["id"])


@query("family_tops", f"WITH {_VEC} SELECT id, dim, value, family, rank FROM (SELECT *, split_part(dim, ':', 1) AS family, row_number() OVER (PARTITION BY id, split_part(dim, ':', 1) ORDER BY value DESC, dim) AS rank FROM v) WHERE rank <= 4")
def family_tops(spark: SparkSession, d: str) -> DataFrame:
    """The four greatest dims of each family of a snapshot."""
    return vx.top_per_family(_vec(spark, d), ["id"], 4)


@query("shape_outliers", f"WITH {_VEC}, k AS (SELECT dim, sum(value) / (SELECT count(DISTINCT id) FROM v) AS c FROM v GROUP BY dim), d AS (SELECT id, sqrt(greatest(0, sum(value * value) - 2 * sum(value * c) + (SELECT sum(c * c) FROM k))) AS score FROM v JOIN k USING (dim) GROUP BY id) SELECT id, round(score, 6) AS score, score > avg(score) OVER () + 2 * stddev_pop(score) OVER () AS is_outlier FROM d")
def shape_outliers(spark: SparkSession, d: str) -> DataFrame:
    """Distance of every snapshot's vector to the centroid, and which lie far out."""
    return sim.outliers(_vec(spark, d))


@query("dim_correlations", f"WITH {_VEC}, o AS (SELECT dim, sum(value) AS s, sum(value * value) AS q, (SELECT count(DISTINCT id) FROM v)::DOUBLE AS n FROM v GROUP BY dim), p AS (SELECT a.dim AS dim_a, b.dim AS dim_b, sum(a.value * b.value) AS p FROM v a JOIN v b ON a.id = b.id AND a.dim < b.dim GROUP BY ALL), r AS (SELECT dim_a, dim_b, round((x.n * p - x.s * y.s) / (sqrt(x.n * x.q - x.s * x.s) * sqrt(y.n * y.q - y.s * y.s)), 6) AS r FROM p JOIN o x ON x.dim = dim_a JOIN o y ON y.dim = dim_b WHERE x.n * x.q - x.s * x.s > 0 AND y.n * y.q - y.s * y.s > 0) SELECT * FROM r WHERE abs(r) >= 0.3")
def dim_correlations(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of dims that go together."""
    return sim.correlations(_vec(spark, d), 0.3)


@query("participation_ratio", f"WITH {_VEC}, n AS (SELECT count(DISTINCT id)::DOUBLE AS n FROM v), k AS (SELECT dim, sum(value * value) / (SELECT n FROM n) - pow(sum(value) / (SELECT n FROM n), 2) AS var FROM v GROUP BY dim) SELECT count(*) AS dims, round(sum(var) * sum(var) / sum(var * var), 4) AS ratio FROM k")
def participation_ratio(spark: SparkSession, d: str) -> DataFrame:
    """How many dims carry the variance: its sum squared over the sum of its squares."""
    v = _vec(spark, d)
    n = v.agg(F.count_distinct("id").cast("double").alias("n"))
    k = v.groupBy("dim").agg(F.sum(F.col("value") * F.col("value")).alias("q"), F.sum("value").alias("s")).withColumn("n", n.scalar()).select((F.col("q") / F.col("n") - F.pow(F.col("s") / F.col("n"), 2)).alias("var"))
    return k.agg(F.count("*").alias("dims"), F.round(F.sum("var") * F.sum("var") / F.sum(F.col("var") * F.col("var")), 4).alias("ratio"))


_BAG = f"{sq.FNS}, b AS (SELECT fn_id AS id, t AS token, count(*) AS n FROM (SELECT fn_id, unnest(regexp_extract_all(code, {sq.q(lex.BAG_TOKEN)})) AS t FROM fns) GROUP BY ALL), m AS (SELECT id, token, n / sqrt(sum(n * n) OVER (PARTITION BY id)) AS x FROM b)"


@query("clone_search", f"WITH {_BAG}, c AS (SELECT a.id AS asked_id, o.id AS id, round(sum(a.x * o.x), 6) AS cosine FROM m a JOIN m o ON a.token = o.token AND a.id <> o.id WHERE a.id % 50 = 0 GROUP BY ALL) SELECT asked_id, id, cosine, rank FROM (SELECT *, row_number() OVER (PARTITION BY asked_id ORDER BY cosine DESC, id) AS rank FROM c) WHERE rank <= 5")
def clone_search(spark: SparkSession, d: str) -> DataFrame:
    """The five functions nearest by token bag to each function whose id is divisible by 50."""
    fns = _fns(spark, d)
    asked = fns.where("fn_id % 50 = 0").select(F.col("fn_id").alias("id"))
    return cl.nearest_bags(cl.bags(fns), asked, 5).select("asked_id", "id", "cosine", "rank")


_LIT = "list_sort(list_distinct([toks[i] FOR i IN range(1, len(toks) + 1) IF regexp_full_match(toks[i], '\\d+(?:\\.\\d+)?') AND (coalesce(toks[i - 1], '') IN ({0}) OR coalesce(toks[i + 1], '') IN ({0}))]))".format(", ".join(map(sq.q, sim._NEAR)))
_PEN = " + ".join(f"(a.{x.lower()} > 0 AND b.{y.lower()} > 0)::INT + (a.{y.lower()} > 0 AND b.{x.lower()} > 0)::INT" for x, y in rules.OPPOSITES)
_DOT = " + ".join(f"a.{p.lower()} * b.{p.lower()}" for p in rules.PRIMITIVES)
_SQ = lambda t: " + ".join(f"{t}.{p.lower()} * {t}.{p.lower()}" for p in rules.PRIMITIVES)


@query(
    "neighbour_similarity",
    f"""WITH {sq.TOKS}, t AS (SELECT fn_id, project, {_LIT} AS lits, {', '.join(f'({e})::DOUBLE AS {p.lower()}' for p, e in _PRIM_SQL.items())} FROM toks), n AS (SELECT *, lead(fn_id) OVER (PARTITION BY project ORDER BY fn_id) AS nxt FROM t),
    s AS (SELECT a.fn_id AS first_id, b.fn_id AS second_id, CASE WHEN ({_SQ('a')}) > 0 AND ({_SQ('b')}) > 0 THEN ({_DOT}) / sqrt(({_SQ('a')}) * ({_SQ('b')})) ELSE 0 END AS base, least(0.5, 0.35 * ({_PEN}))::DOUBLE AS polarity, CASE WHEN len(a.lits) > 0 AND len(b.lits) > 0 AND a.lits <> b.lits THEN 0.3 ELSE 0.0 END::DOUBLE AS literal FROM n a JOIN t b ON b.fn_id = a.nxt)
    SELECT first_id, second_id, round(base, 4) AS base, polarity, literal, round(greatest(0, base - greatest(polarity, literal)), 4) AS similarity FROM s""",
)
def neighbour_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Each function against the next of its project: cosine of primitives less the penalties for opposites and numbers."""
    df = ft.with_tokens(_fns(spark, d)).select("fn_id", "project", sim.literals_near_operators(F.col("toks")).alias("lits"), F.struct(*[c.cast("double").alias(p) for p, c in _prims().items()]).alias("c"), vx.packed(_prims()).alias("vec"))
    p = gr.next_in_group(df, ["project"], "fn_id", ["fn_id", "lits", "c", "vec"])
    counts = lambda s: {x: F.col(f"{s}.{x}") for x in rules.PRIMITIVES}
    p = p.select(F.col("fn_id").alias("first_id"), F.col("fn_id2").alias("second_id"), vx.cosine_of(F.col("vec"), F.col("vec2")).alias("base"), sim.polarity_penalty(counts("c"), counts("c2")).alias("polarity"), sim.literal_penalty(F.col("lits"), F.col("lits2")).alias("literal"))
    return p.select("first_id", "second_id", F.round("base", 4).alias("base"), "polarity", "literal", F.round(F.greatest(F.lit(0.0), F.col("base") - F.greatest("polarity", "literal")), 4).alias("similarity"))


@query("threshold_sweep")
def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Precision, recall and F1 of the cosine of neighbours as a sign that both have the same shape, by threshold."""
    pairs = neighbour_similarity(spark, d)
    shapes = dt.with_shape(_fns(spark, d)).select("fn_id", "shape")
    a, b = shapes.select(F.col("fn_id").alias("first_id"), F.col("shape").alias("s1")), shapes.select(F.col("fn_id").alias("second_id"), F.col("shape").alias("s2"))
    return sim.threshold_sweep(pairs.join(a, "first_id").join(b, "second_id").select(F.col("base").alias("score"), (F.col("s1") == F.col("s2")).alias("truth")))


@query("growth_slopes", f"WITH {sq.TOKS} SELECT lang, count(*) AS functions, round(regr_slope(ln(len(toks)), ln(len(code))), 6) AS slope FROM toks WHERE lang IS NOT NULL AND len(toks) > 0 GROUP BY lang")
def growth_slopes(spark: SparkSession, d: str) -> DataFrame:
    """Growth of tokens with length on a log-log scale, per language."""
    df = ft.with_tokens(_fns(spark, d)).where("lang is not null and size(toks) > 0")
    return df.groupBy("lang").agg(F.count("*").alias("functions"), F.round(F.regr_slope(F.log(F.size("toks")), F.log(F.length("code"))), 6).alias("slope"))
