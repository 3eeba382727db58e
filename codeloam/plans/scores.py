"""Queries of scores and derived metrics, clone pairs and library calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloam.functions import lex, rules
from codeloam.operators import clones as cl
from codeloam.operators import detect as dt
from codeloam.operators import features as ft
from codeloam.operators import graph as gr
from codeloam.operators import issues as iss
from codeloam.operators import libraries as lb
from codeloam.operators import paths as pt
from codeloam.operators import properties as pp
from codeloam.operators import similarity as sim
from codeloam.operators import vectors as vx
from codeloam.plans import planted as pl
from codeloam.plans import projects as pr
from codeloam.plans import sqltext as sq
from codeloam.plans.core import SQL, query
from codeloam.plans.features import _PRIM_SQL, _fns, _prims
from codeloam.session import cut, table


@query("clone_pairs", f"""
    WITH {sq.FNS}, b AS (SELECT fn_id AS id, token, count(*) AS n FROM (SELECT fn_id, unnest(regexp_extract_all(code, {sq.q(lex.BAG_TOKEN)})) AS token FROM fns) GROUP BY ALL),
    k AS (SELECT id, string_agg(token || chr(1) || n, chr(2) ORDER BY token) AS bag FROM b GROUP BY id), h AS (SELECT bag, min(id) AS cls FROM k GROUP BY bag),
    r AS (SELECT b.id, token, n / sqrt(sum(n * n) OVER (PARTITION BY b.id)) AS x FROM b JOIN h ON h.cls = b.id)
    SELECT a.id AS a, c.id AS b, round(sum(a.x * c.x), 4) AS cosine FROM r a JOIN r c ON a.token = c.token AND a.id < c.id GROUP BY a.id, c.id HAVING round(sum(a.x * c.x), 9) >= 0.7""")  # fmt: skip
def clone_pairs(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of different bags of tokens with a cosine of at least 0.7, between the first functions of each bag."""
    return cl.bag_links(cl.bags(_fns(spark, d)), 0.7, 4)[1]


@query("clone_classes", f"""
    WITH {sq.FNS}, b AS (SELECT fn_id AS id, token, count(*) AS n FROM (SELECT fn_id, unnest(regexp_extract_all(code, {sq.q(lex.BAG_TOKEN)})) AS token FROM fns) GROUP BY ALL),
    k AS (SELECT id, string_agg(token || chr(1) || n, chr(2) ORDER BY token) AS bag FROM b GROUP BY id)
    SELECT id AS fn_id, min(id) OVER (PARTITION BY bag) AS class_id FROM k""")  # fmt: skip
def clone_classes(spark: SparkSession, d: str) -> DataFrame:
    """The class of equal bags that every function belongs to: the members behind the ends of ``clone_pairs``."""
    members = cl.bag_classes(cut(cl.packed_bags(cl.bags(_fns(spark, d))).select("id", "k1", "k2")))
    return members.select(F.col("id").alias("fn_id"), F.col("cls").alias("class_id"))


@query("structural_clone_pairs", f"""
    WITH b AS (SELECT fn_id AS id, token, n FROM ({SQL['structural_bag']})),
    k AS (SELECT id, string_agg(token || chr(1) || n, chr(2) ORDER BY token) AS bag FROM b GROUP BY id), h AS (SELECT bag, min(id) AS cls FROM k GROUP BY bag),
    r AS (SELECT b.id, token, n / sqrt(sum(n * n) OVER (PARTITION BY b.id)) AS x FROM b JOIN h ON h.cls = b.id)
    SELECT a.id AS a, c.id AS b, round(sum(a.x * c.x), 4) AS cosine FROM r a JOIN r c ON a.token = c.token AND a.id < c.id GROUP BY a.id, c.id HAVING round(sum(a.x * c.x), 9) >= 0.95""")  # fmt: skip
def structural_clone_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The same with names masked: bags of structure, between the first functions of each bag."""
    return cl.bag_links(cl.bags(_fns(spark, d), structural=True), 0.95, 4)[1]


@query("bug_scores", f"SELECT fn_id, round(least(1.0, sum(w)), 6)::DOUBLE AS score, count(*) AS bugs FROM (SELECT fn_id, 0.4 AS w FROM ({SQL['returns_in_loops']}) UNION ALL SELECT fn_id, 0.15 FROM ({SQL['unused_assignments']})) GROUP BY fn_id")
def bug_scores(spark: SparkSession, d: str) -> DataFrame:
    """Severity of the bugs of every function that has some: capped weighted sum over returns in loops, unused and undefined names."""
    fns = _fns(spark, d)
    w = rules.BUG_WEIGHT
    rows = dt.returns_in_loops(fns, ["fn_id"]).select("fn_id", F.lit(w["RETURN_IN_LOOP"]).alias("w")).union(dt.unused_assignments(fns, ["fn_id"]).select("fn_id", F.lit(w["UNUSED_ASSIGN"])))
    return rows.groupBy("fn_id").agg(F.round(F.least(F.lit(1.0), F.sum("w")), 6).alias("score"), F.count("*").alias("bugs"))


@query(
    "project_bug_scores",
    f"""
    WITH {pr._U}, miss AS (SELECT project, count(DISTINCT callee) AS n FROM c WHERE callee IS NOT NULL AND NOT EXISTS (SELECT 1 FROM d WHERE d.project = c.project AND d.name = c.callee) GROUP BY project),
    idle AS (SELECT project, count(*) AS n FROM d WHERE name NOT IN ('main', 'Main') AND NOT EXISTS (SELECT 1 FROM c WHERE c.project = d.project AND c.callee = d.name) GROUP BY project)
    SELECT coalesce(miss.project, idle.project) AS project, coalesce(miss.n, 0) AS missing, coalesce(idle.n, 0) AS unused, round(least(1.0, 0.4 * coalesce(miss.n, 0) + 0.2 * coalesce(idle.n, 0)), 6)::DOUBLE AS score FROM miss FULL JOIN idle ON miss.project = idle.project
    """,
)
def project_bug_scores(spark: SparkSession, d: str) -> DataFrame:
    """Severity of missing and unused functions per project, capped at 1."""
    units = gr.units_of(table(spark, d, "function_unit"))
    w = rules.PROGRAM_BUG_WEIGHT
    miss = gr.missing_callees(units).groupBy("project").agg(F.count("*").alias("missing"))
    idle = gr.unused_functions(units).groupBy("project").agg(F.count("*").alias("unused"))
    both = miss.join(idle, "project", "full").na.fill(0, ["missing", "unused"])
    return both.select("project", "missing", "unused", F.round(F.least(F.lit(1.0), w["MISSING_CALLEE"] * F.col("missing") + w["UNUSED_FUNCTION"] * F.col("unused")), 6).alias("score"))


# fixed values: what counts as a function head and as a sign of weakness in the derived metrics
_HEAD = r"(?:def|function|func|fun)\s+\w+\s*\("
_SIGN = r"hashlib\.md5|hashlib\.sha1|password\s*=\s*[\"'][^\"']+[\"']|\beval\s*\(|SELECT.*\+.*\w+"
_SECOND = """
    SELECT project, round(congestion * risk, 3) AS risk_adj_complexity, round(long_fns * coupling, 1) AS maintainability_risk, round(debt, 2) AS security_debt,
      round(coupling * least(1.0, long_fns / 50.0), 3) AS arch_fragility, round(risk + congestion * 0.5 + debt * 0.1, 3) AS overall_risk, round(comment_ratio * 10 - signs * 0.5 - long_fns * 0.01, 3) AS health
"""


@query(
    "derived_metrics",
    f"""
    WITH {sq.FNS}, p AS (SELECT project, sum(len(string_split(code, chr(10))))::DOUBLE AS lines, sum(len(list_filter(string_split(code, chr(10)), lambda l: regexp_matches(l, '^\\s*(?:#|//)'))))::DOUBLE AS comments,
      sum(len(regexp_extract_all(code, {sq.q(_HEAD)})))::DOUBLE AS fns, (count(*) FILTER (WHERE len(string_split(code, chr(10))) > 31 AND regexp_matches(code, {sq.q(_HEAD)})))::DOUBLE AS long_fns, (count(*) FILTER (WHERE regexp_matches(code, {sq.q(_SIGN)})))::DOUBLE AS signs FROM fns GROUP BY project),
    q AS (SELECT *, comments / lines AS comment_ratio, least(1.0, fns / 100.0) AS coupling FROM p), r AS (SELECT *, coupling + least(1.0, long_fns / 100.0) + least(1.0, signs) AS congestion, signs * 0.5 + (1 - comment_ratio) * 0.3 AS risk, signs * (lines / 1000.0) AS debt FROM q)
    {_SECOND} FROM r
    """,
)
def derived_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Second-order metrics and health of projects from lines, comments, functions, long ones and signs of weakness."""
    fns = _fns(spark, d)
    ls = lex.lines(F.col("code"))
    per = fns.select("project", F.size(ls).alias("lines"), F.size(F.filter(ls, lambda x: x.rlike(r"^\s*(?:#|//)"))).alias("comments"), F.regexp_count("code", F.lit(_HEAD)).alias("fns"), F.col("code").rlike(_SIGN).cast("int").alias("sign"))
    sums = per.groupBy("project").agg(*[F.sum(c).cast("double").alias(c) for c in ("lines", "comments", "fns")], F.sum(((F.col("lines") > 31) & (F.col("fns") > 0)).cast("int")).cast("double").alias("long_fns"), F.sum("sign").cast("double").alias("signs"))
    q = sums.withColumns({"comment_ratio": F.col("comments") / F.col("lines"), "coupling": F.least(F.lit(1.0), F.col("fns") / 100.0)})
    q = q.withColumns({"congestion": F.expr("coupling + least(1.0D, long_fns / 100.0) + least(1.0D, signs)"), "risk": F.expr("signs * 0.5D + (1 - comment_ratio) * 0.3D"), "debt": F.expr("signs * (lines / 1000.0D)")})
    return q.selectExpr("project", "round(congestion * risk, 3) as risk_adj_complexity", "round(long_fns * coupling, 1) as maintainability_risk", "round(debt, 2) as security_debt", "round(coupling * least(1.0D, long_fns / 50.0D), 3) as arch_fragility", "round(risk + congestion * 0.5D + debt * 0.1D, 3) as overall_risk", "round(comment_ratio * 10 - signs * 0.5D - long_fns * 0.01D, 3) as health")


@query("mean_contributors", f"""
    WITH {sq.TOKS}, v AS ({sq.long_sql('toks', 'fn_id', _PRIM_SQL, 'l2')}), p AS (SELECT project, count(*) AS n FROM fns GROUP BY project), j AS (SELECT project, dim, value, v.fn_id FROM v JOIN fns USING (fn_id))
    SELECT j.project, dim, round(round(sum(value), 4) / any_value(n), 6) AS mean, list_slice(list_sort(list(fn_id)), 1, 8) AS contributors FROM j JOIN p ON p.project IS NOT DISTINCT FROM j.project GROUP BY j.project, dim""")  # fmt: skip
def mean_contributors(spark: SparkSession, d: str) -> DataFrame:
    """Mean primitive vector of every project over all its functions, and the first eight that contribute to each dim."""
    fns = ft.with_tokens(_fns(spark, d)).select("fn_id", "project", "toks", "code")
    vec = vx.unit_rows(fns, ["project", "fn_id"], vx.packed(_prims()))
    n = _fns(spark, d).groupBy(F.col("project").alias("p")).agg(F.count("*").alias("n"))
    sums = vec.groupBy("project", "dim").agg(F.sum("value").alias("s"))
    w = Window.partitionBy("project", "dim", "salt").orderBy("fn_id")
    few = vec.withColumn("salt", F.pmod(F.xxhash64("fn_id"), F.lit(16))).withColumn("nth", F.row_number().over(w)).where("nth <= 8")
    few = few.groupBy("project", "dim").agg(F.slice(F.array_sort(F.collect_list("fn_id")), 1, 8).alias("contributors"))
    both = sums.join(few.withColumnRenamed("project", "p2").withColumnRenamed("dim", "d2"), F.col("project").eqNullSafe(F.col("p2")) & (F.col("dim") == F.col("d2")))
    return both.join(n, F.col("project").eqNullSafe(F.col("p"))).select("project", "dim", F.round(F.round("s", 4) / F.col("n"), 6).alias("mean"), "contributors")


@query("top_outliers", f"""
    WITH v AS (SELECT fn_id AS id, dim, value FROM ({SQL['prim_vector']})), k AS (SELECT dim, sum(value) / (SELECT count(DISTINCT id) FROM v) AS c FROM v GROUP BY dim),
    d AS (SELECT id, sqrt(greatest(0, sum(value * value) - 2 * sum(value * c) + (SELECT sum(c * c) FROM k))) AS score FROM v JOIN k USING (dim) GROUP BY id),
    o AS (SELECT id, score, score > avg(score) OVER () + 2 * stddev_pop(score) OVER () AS is_outlier FROM d)
    SELECT id AS fn_id, round(round(score, 6), 3) AS score, is_outlier FROM o ORDER BY round(round(score, 6), 3) DESC, id LIMIT 10""")  # fmt: skip
def top_outliers(spark: SparkSession, d: str) -> DataFrame:
    """The ten functions farthest from the centroid of the primitive vectors; ties by id."""
    vec = vx.unit_rows(ft.with_tokens(_fns(spark, d)), ["fn_id"], vx.packed(_prims())).withColumnRenamed("fn_id", "id")
    return sim.outliers(vec).orderBy(F.desc(F.round("score", 3)), "id").limit(10).select(F.col("id").alias("fn_id"), F.round("score", 3).alias("score"), "is_outlier")


@query("ranked_algorithms", f"SELECT fn_id, list(name ORDER BY score DESC, list_position([{', '.join(sq.q(a[0]) for a in rules.ALGORITHMS)}], name)) AS algorithms FROM ({SQL['algorithms']}) GROUP BY fn_id")
def ranked_algorithms(spark: SparkSession, d: str) -> DataFrame:
    """Algorithms of every function by score, best first in an array; ties by table order."""
    order = F.create_map(*[x for k, a in enumerate(rules.ALGORITHMS) for x in (F.lit(a[0]), F.lit(k))])
    found = dt.algorithms(_fns(spark, d), ["fn_id"])
    return found.groupBy("fn_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), order[F.col("name")].alias("o"), "name"))).alias("a")).select("fn_id", F.transform("a", lambda x: x["name"]).alias("algorithms"))


@query("top_changed_dims", f"SELECT * FROM (SELECT new_id, dim, round(new_value - old_value, 6) AS delta, row_number() OVER (PARTITION BY new_id ORDER BY abs(round(new_value - old_value, 6)) DESC, dim) AS rank FROM ({SQL['snapshot_dim_changes']})) WHERE rank <= 8")
def top_changed_dims(spark: SparkSession, d: str) -> DataFrame:
    """The eight dims that changed most between consecutive snapshots of a target; ties by name."""
    moved = pr.snapshot_dim_changes(spark, d).select("new_id", "dim", F.round(F.col("new_value") - F.col("old_value"), 6).alias("delta"))
    w = Window.partitionBy("new_id").orderBy(F.desc(F.abs("delta")), "dim")
    return moved.withColumn("rank", F.row_number().over(w)).where("rank <= 8")


@query("library_sinks", "SELECT * FROM (VALUES (-103, 'db.execute', 'sqlite3', 'SQL', 'SQL_INJECTION'), (-101, 'pickle.loads', 'pickle', 'DESERIALIZE', 'DESERIALIZATION'), (-102, 'requests.get', 'requests', 'NETWORK', 'SSRF')) AS t(fn_id, call, module, role, weakness)")
def library_sinks(spark: SparkSession, d: str) -> DataFrame:
    """Dangerous library calls, other names of modules resolved, with the weakness that a derived argument makes of them."""
    texts = _fns(spark, d).select("fn_id", "lang", "code").union(lb.planted(spark))
    return lb.library_weaknesses(texts, lb.planted_libraries(spark)).select("fn_id", "call", "module", "role", "weakness")


@query("library_roles_used", "SELECT * FROM (VALUES ('python', 'stdlib', 'DESERIALIZE', 1), ('python', 'stdlib', 'SQL', 1), ('python', 'third_party', 'NETWORK', 1)) AS t(lang, source, role, texts)")
def library_roles_used(spark: SparkSession, d: str) -> DataFrame:
    """How many texts use which role of which libraries."""
    texts = _fns(spark, d).select("fn_id", "lang", "code").union(lb.planted(spark))
    return lb.library_calls(texts, lb.planted_libraries(spark)).groupBy("lang", "source", "role").agg(F.count_distinct("fn_id").alias("texts"))


@query(
    "call_graph_vector",
    f"""
    WITH {pr._U}, e AS (SELECT DISTINCT c.project, caller, callee FROM c JOIN d ON d.project = c.project AND d.name = c.callee WHERE caller <> '<module>'),
    fns AS (SELECT project, count(DISTINCT name) AS functions, sum(len(regexp_extract_all(coalesce(body, ''), '\\bif\\b'))) AS branches, sum(len(regexp_extract_all(coalesce(body, ''), '\\b(?:for|while)\\b'))) AS loops FROM u WHERE name IS NOT NULL AND name <> '<module>' GROUP BY project),
    o AS (SELECT project, max(n) AS fan_out FROM (SELECT project, caller, count(*) AS n FROM e GROUP BY ALL) GROUP BY project), i AS (SELECT project, max(n) AS fan_in FROM (SELECT project, callee, count(*) AS n FROM e GROUP BY ALL) GROUP BY project),
    g AS (SELECT project, count(*) AS calls, (count(*) FILTER (WHERE caller = callee)) AS recursive FROM e GROUP BY project)
    SELECT fns.project, functions, coalesce(calls, 0) AS calls, coalesce(recursive, 0) AS recursive, coalesce(fan_out, 0) AS max_fan_out, coalesce(fan_in, 0) AS max_fan_in, branches::BIGINT AS branches, loops::BIGINT AS loops
    FROM fns LEFT JOIN g USING (project) LEFT JOIN o USING (project) LEFT JOIN i USING (project) WHERE fns.project IS NOT NULL
    """,
)
def call_graph_vector(spark: SparkSession, d: str) -> DataFrame:
    """Functions, calls between them, recursion, greatest fan-in and fan-out, branches and loops of every project."""
    units = gr.units_of(table(spark, d, "function_unit"))
    defs = gr.definitions(units).select("project", F.col("name").alias("callee"))
    e = gr.calls(units).where("caller <> '<module>'").join(defs, ["project", "callee"]).select("project", "caller", "callee").distinct()
    fns = units.where("project is not null and name is not null and name <> '<module>'").groupBy("project").agg(F.count_distinct("name").alias("functions"), F.sum(F.regexp_count(F.coalesce("body", F.lit("")), F.lit(r"\bif\b"))).alias("branches"), F.sum(F.regexp_count(F.coalesce("body", F.lit("")), F.lit(r"\b(?:for|while)\b"))).alias("loops"))
    g = e.groupBy("project").agg(F.count("*").alias("calls"), F.count_if(F.col("caller") == F.col("callee")).alias("recursive"))
    o = e.groupBy("project", "caller").agg(F.count("*").alias("n")).groupBy("project").agg(F.max("n").alias("max_fan_out"))
    i = e.groupBy("project", "callee").agg(F.count("*").alias("n")).groupBy("project").agg(F.max("n").alias("max_fan_in"))
    return fns.join(g, "project", "left").join(o, "project", "left").join(i, "project", "left").na.fill(0).select("project", "functions", "calls", "recursive", "max_fan_out", "max_fan_in", "branches", "loops")


def _prop_sql(d: str) -> str:
    if d == "PROP:INPUTS":
        return f"len(list_filter(string_split(regexp_extract(text, {sq.q(pp.HEAD)}, 1), ','), lambda p: trim(p) <> ''))"
    if d in pp.COUNTS:
        return sq.words_in("toks", pp.COUNTS[d])
    seen = []
    if d in pp.TYPE_WORDS:
        seen.append(f"{sq.words_in('toks', pp.TYPE_WORDS[d])} > 0")
    if d in pp.METHODS:
        seen.append(f"len(list_filter(range(1, len(toks)), lambda i: toks[i] = '.' AND toks[i + 1] IN ({', '.join(map(sq.q, pp.METHODS[d]))}))) > 0")
    if d in pp.TEXTS:
        seen.append(sq.hit("text", pp.TEXTS[d]))
    return f"({' OR '.join(seen)})::INT"


_PROPS = {d: _prop_sql(d) for d in [*pp.FLAGS, "PROP:INPUTS", *pp.COUNTS]}


@query("property_dims", f"WITH {sq.TOKS} {sq.long_sql('toks', 'fn_id', _PROPS, 'none')}")
def property_dims(spark: SparkSession, d: str) -> DataFrame:
    """Properties of data, control and effects of every function, and depth, branching and coupling."""
    df = ft.with_tokens(_fns(spark, d)).withColumn("text", lex.stripped(F.col("code"))).withColumn("methods", pp.methods_of(F.col("toks")))
    return vx.exploded(df, ["fn_id"], vx.packed(pp.dims(F.col("toks"), F.col("text"), F.col("methods"))))


@query("text_risks")
def text_risks(spark: SparkSession, d: str) -> DataFrame:
    """Risk and worst severity of every text with findings."""
    return pp.risks(iss.enriched_findings(_fns(spark, d).select("fn_id", "lang", "code").union(pl.planted(spark)), ["fn_id"]))


@query("multi_channel")
def multi_channel(spark: SparkSession, d: str) -> DataFrame:
    """Each function against the next of its project over three channels: primitives 0.4, directions and strength of flow 0.3,
    flow signatures without names 0.3."""
    fns = _fns(spark, d)
    prims = ft.with_tokens(fns).select("fn_id", "project", vx.packed(_prims()).alias("vec"))
    both = pt.flow_directions(fns).join(pt.flow_intensities(fns), ["fn_id", "function"])
    names = [c for c in both.columns if c not in ("fn_id", "function")]
    flow = both.groupBy("fn_id").agg(*[F.sum(c).alias(c) for c in names]).select("fn_id", vx.packed({c: F.col(c) for c in names}).alias("flow"))
    none = F.array().cast("array<struct<dim:string,value:double>>")
    df = prims.join(flow, "fn_id", "left").join(pt.flow_signatures(fns), "fn_id", "left").select("fn_id", "project", "vec", F.coalesce("flow", none).alias("flow"), "signatures")
    p = gr.next_in_group(df, ["project"], "fn_id", ["fn_id", "vec", "flow", "signatures"])
    clone = F.coalesce(pt.signature_similarity(F.col("signatures"), F.col("signatures2")), F.lit(0.0))
    return p.select(F.col("fn_id").alias("first_id"), F.col("fn_id2").alias("second_id"), F.round(0.4 * vx.cosine_of(F.col("vec"), F.col("vec2")) + 0.3 * vx.cosine_of(F.col("flow"), F.col("flow2")) + 0.3 * clone, 4).alias("similarity"))
