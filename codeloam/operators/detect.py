"""Detectors: code to rows of weaknesses, sinks, roles, values written into it, algorithms, patterns and bugs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloam.functions import lex, rules
from codeloam.operators import features as ft
from codeloam.operators import vectors as vx


def _rows(df: DataFrame, ids: list[str], cells: list[Column]) -> DataFrame:
    """One row per non-null struct among ``cells``."""
    return df.select(*ids, F.explode_outer(F.array_compact(F.array(*cells))).alias("x")).where("x is not null").select(*ids, "x.*")


def weaknesses(df: DataFrame, ids: list[str]) -> DataFrame:
    """(ids, kind, cwe): rules whose sink occurs and whose mitigation does not."""
    code = F.col("code")
    cells = [F.when(lex.matches_any(code, sinks) & ~lex.matches_any(code, safe), F.struct(F.lit(kind).alias("kind"), F.lit(cwe).alias("cwe"))) for kind, cwe, sinks, safe in rules.WEAKNESSES]
    return _rows(df, ids, cells)


def weakness_signature(code: Column) -> Column:
    parts = [
        F.when(F.contains(code, F.lit("+")) & code.rlike(r"execute|system|open|return.*<"), "CONCAT>DANGEROUS_SINK"),
        F.when(code.rlike(r"pickle\.loads|eval\s*\(|exec\s*\("), "UNSAFE_CALL"),
        F.when(code.rlike(r"password\s*=|api_key\s*=|secret\s*=|connect\s*\([^)]*[\"']"), "HARDCODED_SECRET"),
        F.when(code.rlike(r"\[\w+\]") & ~code.rlike(r"if\s+0\s*<="), "UNCHECKED_INDEX"),
    ]
    s = F.array_join(F.array_compact(F.array(*parts)), ">")
    return F.when(s == "", "CLEAN").otherwise(s)


def pattern_sinks(df: DataFrame, ids: list[str]) -> DataFrame:
    """(ids, category, sink, impact): distinct texts that match a sink pattern of a category, letter case ignored."""

    def of(cat: str, pats: list[str]) -> Column:
        hits = F.flatten(F.array(*[F.regexp_extract_all("code", F.lit(f"(?i){p}"), F.lit(0)) for p in pats]))
        return F.transform(hits, lambda m: F.struct(F.lit(cat).alias("category"), F.substring(F.trim(m), 1, 40).alias("sink"), F.lit(rules.SINK_IMPACT[cat]).alias("impact")))

    found = F.concat(*[of(cat, pats) for cat, pats in rules.SINK_ROLES.items()])
    return df.select(*ids, F.explode_outer(F.array_distinct(found)).alias("x")).where("x is not null").select(*ids, "x.*")


def called_names(code: Column) -> Column:
    """Names before an opening bracket that are no keywords."""
    return F.filter(F.regexp_extract_all(code, F.lit(r"([a-zA-Z_]\w*)\s*\("), F.lit(1)), lambda n: ~n.isin(*rules.NO_CALLS))


def first_category(name: Column, table: dict[str, list[str]]) -> Column:
    """The first category one of whose words the name contains."""
    out = F.when(F.lit(False), "")
    for cat, words in table.items():
        out = out.when(reduce(lambda a, b: a | b, [F.contains(name, F.lit(w)) for w in words]), cat)
    return out


# fixed values: how a function gets another name, and which ones are dangerous
PLAIN_ALIAS, DOTTED_ALIAS = r"(\w+)\s*=\s*(?:os\.)?(?:system|popen|exec|eval)\b", r"(\w+)\s*=\s*(\w+\.\w+)\b"
ALIAS_WORDS = ["system", "exec", "eval", "popen", "query", "execute", "open", "load"]


def named_sinks(df: DataFrame, ids: list[str]) -> DataFrame:
    """(ids, category, sink, via_alias): calls by name, and calls of names that were assigned a dangerous function."""
    targets = F.regexp_extract_all("code", F.lit(DOTTED_ALIAS), F.lit(2))
    dotted = F.zip_with(F.regexp_extract_all("code", F.lit(DOTTED_ALIAS), F.lit(1)), targets, lambda n, t: F.when(lex.matches_any(F.lower(t), ALIAS_WORDS), n))
    alias = F.concat(F.regexp_extract_all("code", F.lit(PLAIN_ALIAS), F.lit(1)), F.array_compact(dotted))
    calls = df.select(*ids, F.array_distinct(called_names(F.col("code"))).alias("names"), alias.alias("aliases"))  # once per text, before the rows fan out
    calls = calls.select(*ids, "aliases", F.explode_outer("names").alias("sink")).where("sink is not null")
    via = F.array_contains("aliases", F.col("sink"))
    cat = F.when(via, "CODE_EXEC").otherwise(first_category(F.lower("sink"), rules.SINK_WORDS))
    return calls.select(*ids, cat.alias("category"), "sink", via.alias("via_alias")).where("category is not null")


def name_words(name: Column) -> Column:
    """A name's words by underscores and camel case, lower case, joined by blanks."""
    return F.array_join(F.transform(F.regexp_extract_all(name, F.lit(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+"), F.lit(0)), lambda w: F.lower(w)), " ")


def role_scores(text: Column) -> dict[str, Column]:
    return {role: sum((F.contains(text, F.lit(w)).cast("int") for w in words), F.lit(0)) for role, words in rules.ROLE_WORDS.items()}


def role_of(text: Column) -> Column:
    """The role with most words in ``text``, the first of equals; null without any."""
    scores = role_scores(text)
    best = F.greatest(*scores.values())
    return reduce(lambda acc, kv: acc.when(kv[1] == best, kv[0]), scores.items(), F.when(best == 0, F.lit(None).cast("string")))


def hardcoded(df: DataFrame, ids: list[str]) -> DataFrame:
    """(ids, line, kind, value): values written into the code, by line; a text that several patterns match counts for each."""
    rows = df.select(*ids, F.posexplode(lex.lines(F.col("code"))).alias("pos", "text"))

    def of(kind: str, p: str) -> Column:
        return F.transform(F.regexp_extract_all("text", F.lit(p), F.lit(0)), lambda m: F.struct(F.lit(kind).alias("kind"), F.substring(F.trim(m), 1, 40).alias("value")))

    found = F.concat(*[of(k, p) for k, pats in rules.HARDCODED.items() for p in pats])
    return rows.select(*ids, (F.col("pos") + 1).alias("line"), F.explode_outer(found).alias("x")).where("x is not null").select(*ids, "line", "x.kind", "x.value")


def _word(w: str) -> str:
    import re

    return r"\b" + re.escape(w) + r"\b"


PUBLIC = "(?i)" + "|".join(_word(w) for w in rules.PUBLIC_SOURCES)
SAFE = "(?i)" + "|".join(_word(w) for w in rules.MITIGATING)


def exploitability(df: DataFrame) -> DataFrame:
    """``df`` (code, kind) with impact, public_taint, mitigated, directness, score and label."""
    impact = F.create_map(*[F.lit(x) for kv in rules.WEAKNESS_IMPACT.items() for x in kv])
    df = df.withColumns(
        {
            "impact": F.coalesce(impact[F.col("kind")], F.lit(0.5)),
            "public_taint": F.when(F.col("code").rlike(PUBLIC), 1.0).otherwise(0.3),
            "mitigated": F.when(F.col("code").rlike(SAFE), 0.0).otherwise(1.0),
            "directness": F.greatest(F.lit(0.0), 1.0 - 0.1 * F.regexp_count("code", F.lit(r"\w+\s*=\s*[^;\n]+"))),
        }
    )
    raw = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.4 * F.col("impact") + 0.3 * F.col("public_taint") + 0.2 * F.col("mitigated") + 0.1 * F.col("directness")))
    df = df.withColumn("raw", F.round(raw, 9))
    return df.withColumn("label", F.expr("case when raw >= 0.8 then 'CRITICAL' when raw >= 0.6 then 'HIGH' when raw >= 0.4 then 'MEDIUM' else 'LOW' end")).withColumn("score", F.round("raw", 2)).drop("raw")


def signatures(df: DataFrame, ids: list[str], table: list, by_prims: float, by_marks: float, least: float) -> DataFrame:
    """(ids, name, score, hits) of signatures: shares of primitives among the eight dominant ones and of marks found."""
    prims = F.split("shape", ">")
    cells = []
    for name, needs, marks in table:
        hits = sum((F.col("code").rlike(f"(?i){m}").cast("int") for m in marks), F.lit(0))
        overlap = F.size(F.array_intersect(F.array(*[F.lit(x) for x in dict.fromkeys(needs)]), prims)) / len(needs)
        score = F.round(by_prims * overlap + by_marks * F.least(F.lit(1.0), hits / len(marks)), 9)
        cells.append(F.when((hits > 0) & (score >= least), F.struct(F.lit(name).alias("name"), F.round(score, 2).alias("score"), hits.alias("hits"))))
    return _rows(df, ids, cells)


def with_shape(df: DataFrame) -> DataFrame:
    """``df`` with its shape: the eight dominant primitives by token."""
    df = ft.with_tokens(df)
    return vx.with_top_names(df, "shape", vx.packed(ft.token_primitives(F.col("toks"), F.col("code"))), rules.PRIMITIVES, 8).drop("toks")


def algorithms(df: DataFrame, ids: list[str]) -> DataFrame:
    return signatures(with_shape(df), ids, rules.ALGORITHMS, 0.5, 0.5, 0.5)


def design_patterns(df: DataFrame, ids: list[str]) -> DataFrame:
    return signatures(with_shape(df), ids, rules.PATTERNS, 0.4, 0.6, 0.4)


def returns_in_loops(df: DataFrame, ids: list[str]) -> DataFrame:
    """(ids, loop_line, line): returns that stand deeper than a loop line above them; both lists stay in the row."""
    indent = lambda s: F.length(s) - F.length(F.regexp_replace(s, r"^\s+", ""))
    numbered = F.transform(lex.lines(F.col("code")), lambda s, k: F.struct((k + 1).alias("line"), indent(s).alias("indent"), s.alias("text")))
    loops = F.filter("ls", lambda x: x["text"].rlike(r"^\s*(?:for|while)\b"))
    rets = F.filter("ls", lambda x: F.contains(x["text"], F.lit("return")))
    df = df.select(*ids, numbered.alias("ls")).select(*ids, loops.alias("loops"), rets.alias("rets"))
    pairs = df.select(*ids, F.explode("loops").alias("l"), "rets").select(*ids, "l", F.explode(F.filter("rets", lambda r: (r["line"] > F.col("l.line")) & (r["indent"] > F.col("l.indent")))).alias("r"))
    return pairs.select(*ids, F.col("l.line").alias("loop_line"), F.col("r.line").alias("line"))


def unused_assignments(df: DataFrame, ids: list[str]) -> DataFrame:
    """(ids, name): names that occur only where they are assigned; counted as text in the row."""
    assigned = F.regexp_extract_all("code", F.lit(r"\b([a-zA-Z_]\w*)\s*(?:\+=|-=|\*=|/=|=(?!=))"), F.lit(1))
    used = lex.words(F.col("code"))
    df = df.select(*ids, assigned.alias("assigned"), used.alias("used"))
    names = df.select(*ids, F.explode(F.array_distinct("assigned")).alias("name"), "assigned", "used")
    n = lambda c: F.size(F.filter(c, lambda x: x == F.col("name")))
    return names.where(n("used") <= n("assigned")).select(*ids, "name")
