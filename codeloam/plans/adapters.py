"""Queries of the language adapters: counts, vectors and shapes, alone and with what the functions of a file call."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloam.functions import lex, rules
from codeloam.operators import adapters as ad
from codeloam.operators import graph as gr
from codeloam.operators import vectors as vx
from codeloam.plans import sqltext as sq
from codeloam.plans.core import SQL, query
from codeloam.plans.features import _LINE_STRIPPED, _fns
from codeloam.session import table

P = rules.PRIMITIVES


def _lang_sql(lang: str, code: str) -> str:
    marks = " ".join(f"WHEN {' OR '.join(sq.holds(code, m) for m in parts)} THEN {sq.q(n)}" for n, parts in rules.ADAPTER_MARKS.items())
    return f"CASE WHEN {lang} IN ({', '.join(map(sq.q, ad.HEADS))}) THEN {lang} {marks} ELSE 'python' END"


def _marks_sql(code: str) -> str:
    marks = " ".join(f"WHEN {' OR '.join(sq.holds(code, m) for m in parts)} THEN {sq.q(n)}" for n, parts in rules.ADAPTER_MARKS.items())
    return f"CASE {marks} ELSE 'python' END"


SQL["adapter_language"] = f"WITH {sq.FNS} SELECT coalesce(lang, '-') AS labelled, {_marks_sql('code')} AS adapter, count(*) AS functions FROM fns GROUP BY ALL"


def _count_sql(p: str) -> str:
    def pats(name: str | None) -> str:
        own = ad.OWN[name].get(p) if name else ad.DEFAULT.get(p)
        return sq.matches("text", own) if own else "0"

    if p == "RECURSE":
        return "CASE " + " ".join(f"WHEN adapter = {sq.q(n)} THEN {sq.recursive('text', h)}::INT" for n, h in ad.HEADS.items()) + " ELSE 0 END"
    base = "CASE " + " ".join(f"WHEN adapter = {sq.q(n)} THEN {pats(n)}" for n in ad.OWN if p in ad.OWN[n]) + f" ELSE {pats(None)} END" if any(p in t for t in ad.OWN.values()) else pats(None)
    if p in ad.ARITHMETIC:
        base = sq.words_in("toks", ad.ARITHMETIC[p])
        if p in ad.PRODUCTS:
            operand = lambda x: f"(regexp_matches({x}, {sq.q(ad.OPERAND)}) AND {x} NOT IN ({', '.join(map(sq.q, ad.NO_OPERANDS))}))"
            base += f" + len(list_filter(range(2, len(toks)), lambda i: toks[i] IN ({', '.join(map(sq.q, ad.PRODUCTS[p]))}) AND {operand('toks[i - 1]')} AND {operand('toks[i + 1]')}))"
    if p == "ARITH_MUL":
        base = f"greatest(0, {base} - {sq.matches('text', [ad.STAR_SELECT])})"
    opens = f"(CASE WHEN adapter = 'python' THEN {sq.matches('code', [ad.WRITE_OPEN])} ELSE 0 END)"
    verbs = lambda v: f"(CASE WHEN adapter = 'python' THEN {sq.matches('code', [v])} ELSE 0 END)"
    if p == "READ":
        base = f"greatest(0, {base} - {opens}) + {verbs(ad.SQL_READ)}"
    if p == "WRITE":
        base = f"{base} + {opens} + {verbs(ad.SQL_WRITE)}"
    return base


COUNTS = {p: _count_sql(p) for p in P}
_ADAPTED = f"{sq.TOKS}, adapted AS (SELECT fn_id, project, code, toks, {_LINE_STRIPPED} AS text, {_lang_sql('lang', 'code')} AS adapter FROM toks)"
_COUNTED = f"{_ADAPTED}, counted AS (SELECT fn_id, {', '.join(f'({e})::DOUBLE AS {p.lower()}' for p, e in COUNTS.items())} FROM adapted)"
_OWN = {p: p.lower() for p in P}


@query("adapter_counts", f"WITH {_ADAPTED} SELECT fn_id, adapter, {', '.join(f'({e})::INT AS {p.lower()}' for p, e in COUNTS.items())} FROM adapted")
def adapter_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts of the primitives by each language's adapter."""
    df = ad.prepared(_fns(spark, d))
    return df.select("fn_id", "adapter", *[c.alias(p.lower()) for p, c in ad.adapter_counts(F.col("text"), F.col("code"), F.col("toks"), F.col("adapter")).items()])


@query("adapter_vector", f"WITH {_COUNTED} {sq.long_sql('counted', 'fn_id', _OWN, 'l2')}")
def adapter_vector(spark: SparkSession, d: str) -> DataFrame:
    """Unit vectors of those counts: the primitive family alone, of unit length."""
    return vx.unit_rows(ad.counted(_fns(spark, d), ["fn_id"]), ["fn_id"], ad.entries(F.col("counts")))


@query("adapter_shape", f"WITH {_COUNTED}, s AS ({sq.ranked_sql('counted', 'fn_id', _OWN, 8)}) SELECT fn_id, coalesce(shape, 'EMPTY') AS shape FROM counted LEFT JOIN s USING (fn_id)")
def adapter_shape(spark: SparkSession, d: str) -> DataFrame:
    """The eight dominant primitives by adapter."""
    return vx.with_top_names(ad.counted(_fns(spark, d), ["fn_id"]), "shape", ad.entries(F.col("counts")), P, 8).select("fn_id", "shape")


@query("recursive_vector")
def recursive_vector(spark: SparkSession, d: str) -> DataFrame:
    """Unit vectors of every text's functions with half of what they call among themselves."""
    return vx.unit_rows(ad.recursive_counts(_fns(spark, d), ["fn_id"]), ["fn_id"], ad.entries(F.col("counts")))


def _parts(spark: SparkSession, d: str) -> DataFrame:
    """Functions of the files of function_unit with their calls and counts; of rows with one id the texts are equal."""
    units = table(spark, d, "function_unit").where("body is not null and name is not null and name <> '<module>'").dropDuplicates(["unit_id"])
    fns = units.select("project", "file", F.col("unit_id").alias("nth"), "name", F.coalesce(F.transform("call_sites", lambda c: c["callee"]), F.array().cast("array<string>")).alias("calls"), gr.language_of_path(F.col("file")).alias("lang"), F.col("body").alias("code"))
    return ad.counted(fns, ["project", "file", "nth", "name", "calls"])


_PATH_LANG = "CASE lower(regexp_extract(file, '\\.(\\w+)$', 1)) WHEN 'py' THEN 'python' WHEN 'js' THEN 'javascript' WHEN 'java' THEN 'java' WHEN 'go' THEN 'go' WHEN 'c' THEN 'c' WHEN 'h' THEN 'c' END"
_UNIT_TOKS = sq.STRIPPED
_FILES = f"""
    u AS (SELECT DISTINCT ON (unit_id) unit_id, project, file, name, call_sites, body AS code, {_PATH_LANG} AS lang FROM function_unit WHERE body IS NOT NULL AND name IS NOT NULL AND name <> '<module>' ORDER BY unit_id),
    t AS (SELECT *, {_LINE_STRIPPED} AS text, regexp_extract_all({_UNIT_TOKS}, {sq.q(lex.TOKEN)}) AS toks, {_lang_sql('lang', 'code')} AS adapter FROM u),
    f AS (SELECT DISTINCT ON (project, file, name) project, file, name, call_sites, {', '.join(f'({e})::BIGINT AS {p.lower()}' for p, e in COUNTS.items())} FROM t ORDER BY project, file, name, unit_id DESC),
    c AS (SELECT project, file, name AS caller, s.callee AS name FROM (SELECT project, file, name, unnest(call_sites) AS s FROM f) WHERE s.callee <> name),
    every AS (SELECT project, file, {', '.join(p.lower() for p in P)} FROM f UNION ALL SELECT f.project, f.file, {', '.join(f'{p.lower()} // 2' for p in P)} FROM c JOIN f ON f.name = c.name AND f.project IS NOT DISTINCT FROM c.project AND f.file IS NOT DISTINCT FROM c.file),
    sums AS (SELECT project, file, {', '.join(f'sum({p.lower()})::DOUBLE AS {p.lower()}' for p in P)} FROM every GROUP BY project, file)
"""


@query("file_shapes", f"WITH {_FILES} SELECT project, file, {', '.join(f'{p.lower()}::BIGINT AS {p.lower()}' for p in P)} FROM sums WHERE project IS NOT NULL AND file IS NOT NULL")
def file_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Counts of every file: its functions and half of what each calls in the file."""
    c = ad.with_calls(_parts(spark, d), ["project", "file"]).where("project is not null and file is not null")
    return c.select("project", "file", *[F.col("counts")[k].alias(p.lower()) for k, p in enumerate(P)])


@query("true_similarity")
def true_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Each function against the next of its project: cosine of the recursive vectors less the larger penalty, and the bare cosine."""
    counts = ad.recursive_counts(_fns(spark, d), ["fn_id"]).withColumn("counts", F.transform("counts", lambda c: c.cast("double")))
    toks = ad.prepared(_fns(spark, d)).select("fn_id", "project", "toks")
    df = toks.join(counts, "fn_id")
    p = gr.next_in_group(df, ["project"], "fn_id", ["fn_id", "counts", "toks"])
    bare = vx.cosine_of(ad.entries(F.col("counts")), ad.entries(F.col("counts2")))
    return p.select(F.col("fn_id").alias("first_id"), F.col("fn_id2").alias("second_id"), F.round(ad.true_similarity(F.col("counts"), F.col("counts2"), F.col("toks"), F.col("toks2")), 4).alias("similarity"), F.round(bare, 4).alias("bare"))
