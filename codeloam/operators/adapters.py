"""Primitives by language adapter: patterns on line-stripped text, operators by token and neighbours, calls among the functions of one text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloam.functions import lex, rules
from codeloam.operators import dataflow as flow
from codeloam.operators import features as ft
from codeloam.operators import similarity as sm
from codeloam.operators import vectors as vx

# fixed values: what stands before the name of a function, by language
HEADS = {
    "python": r"(?:def|async def)\s+(\w+)\s*\(",
    "javascript": r"(?:function|const\s+\w+\s*=\s*\(|let\s+\w+\s*=\s*\()\s*(\w+)?\s*\(",
    "typescript": r"(?:function|const\s+\w+\s*=\s*\(|let\s+\w+\s*=\s*\()\s*(\w+)?\s*\(",
    "java": r"(?:public|private|protected|static)?\s*(?:\w+\s+)*(\w+)\s*\(",
    "c": r"(?:\w+\s+)+(\w+)\s*\(",
    "cpp": r"(?:\w+\s+)+(\w+)\s*\(",
    "csharp": r"(?:public|private|protected|static)?\s*(?:\w+\s+)*(\w+)\s*\(",
    "go": r"func\s+(\w+)\s*\(",
    "rust": r"fn\s+(\w+)\s*\(",
    "ruby": r"def\s+(\w+)",
    "php": r"(?:public|private|protected|static)?\s*function\s+(\w+)\s*\(",
    "swift": r"func\s+(\w+)\s*\(",
    "kotlin": r"fun\s+(\w+)\s*\(",
}

# fixed values: patterns of each adapter where they differ from the default ones
DEFAULT = {
    "LOOP": [r"\bfor\b", r"\bwhile\b"],
    "BRANCH": [r"\bif\b", r"\belse\b"],
    "RETURN": [r"\breturn\b"],
    "READ": [r"\binput\(", r"\bopen\(", r"\bread\("],
    "WRITE": [r"\bprint\("],
    "ASSIGN": [r"=", r"\+= ", r"-= "],
    "AGGREGATE": [r"\bsum\(", r"\bcount\(", r"\btotal\b"],
    "FILTER": [r"\bfilter\(", r"\bwhere\b"],
    "SORT": [r"\bsort\(", r"\bsorted\("],
    "SEARCH": [r"\bfind\(", r"\bindex\(", r"\bcontains\b", r"\bin\b"],
    "STATE": [r"\+= ", r"-= ", r"\bappend\(", r"\bpush\("],
    "COMPARE_EQ": [r"==|==="],
    "COMPARE_NE": [r"!=|!=="],
    "COMPARE_GT": [r" > "],
    "COMPARE_LT": [r" < "],
    "COMPARE_GE": [r">="],
    "COMPARE_LE": [r"<="],
}
_SWITCH = [r"\bif\b", r"\belse\b", r"\bswitch\b"]
OWN = {
    "python": {
        "BRANCH": [r"\bif\b", r"\belif\b", r"\belse\b"],
        "READ": [r"\binput\(", r"\bopen\(", r"\bread\(", r"\breadline", r"urlopen", r"requests\.get", r"requests\.post", r"\.get\(", r"fetch\(", r"\bget\("],
        "WRITE": [r"\bprint\(", r"\.write\(", r"requests\.post", r"\.send\(", r"\bwrite\(", r"\bemit", r"\boutput"],
    },
    "javascript": {"LOOP": [r"\bfor\b", r"\bwhile\b", r"\.forEach\(", r"\.map\("], "BRANCH": _SWITCH, "WRITE": [r"console\.log", r"\bdocument\.write"]},
    "typescript": {"LOOP": [r"\bfor\b", r"\bwhile\b", r"\.forEach\(", r"\.map\("], "BRANCH": _SWITCH, "WRITE": [r"console\.log", r"\bdocument\.write"]},
    "java": {"LOOP": [r"\bfor\b", r"\bwhile\b", r"\.forEach\("], "BRANCH": _SWITCH, "WRITE": [r"System\.out\.print"], "READ": [r"Scanner", r"\breadLine", r"\bnextInt"]},
    "c": {"LOOP": [r"\bfor\b", r"\bwhile\b", r"\bdo\b"], "BRANCH": _SWITCH, "WRITE": [r"\bprintf"], "READ": [r"\bscanf", r"\bfread", r"\bgetchar"]},
    "cpp": {"LOOP": [r"\bfor\b", r"\bwhile\b", r"\bdo\b"], "BRANCH": _SWITCH, "WRITE": [r"\bprintf"], "READ": [r"\bscanf", r"\bfread", r"\bgetchar"]},
    "csharp": {"LOOP": [r"\bfor\b", r"\bwhile\b", r"\bforeach\b", r"\bdo\b"], "BRANCH": _SWITCH, "WRITE": [r"Console\.Write"], "READ": [r"Console\.ReadLine"]},
    "go": {"LOOP": [r"\bfor\b", r"\brange\b"], "BRANCH": _SWITCH, "WRITE": [r"fmt\.Print"], "READ": [r"\bScan", r"\bReadFile"]},
    "rust": {"LOOP": [r"\bfor\b", r"\bwhile\b", r"\bloop\b"], "BRANCH": [r"\bif\b", r"\belse\b", r"\bmatch\b"], "WRITE": [r"println!", r"\bprint!"], "READ": [r"\bread_line", r"\bread_to_string"]},
    "ruby": {"LOOP": [r"\bfor\b", r"\bwhile\b", r"\.each\b", r"\bdo\b"], "BRANCH": [r"\bif\b", r"\belsif\b", r"\belse\b", r"\bcase\b"], "WRITE": [r"\bputs", r"\bprint"], "READ": [r"\bgets", r"\bFile\.read"]},
    "php": {"LOOP": [r"\bfor\b", r"\bwhile\b", r"\bforeach\b"], "BRANCH": [r"\bif\b", r"\belseif\b", r"\belse\b", r"\bswitch\b"], "WRITE": [r"\becho", r"\bprint"], "READ": [r"\$_GET", r"\$_POST", r"\bfopen"]},
    "swift": {"LOOP": [r"\bfor\b", r"\bwhile\b", r"\.forEach\("], "BRANCH": _SWITCH, "WRITE": [r"\bprint\("], "READ": [r"\breadLine", r"\bread\("]},
    "kotlin": {"LOOP": [r"\bfor\b", r"\bwhile\b", r"\.forEach\("], "BRANCH": [r"\bif\b", r"\belse\b", r"\bwhen\b"], "WRITE": [r"\bprintln"], "READ": [r"\breadLine", r"\breadln"]},
}
# fixed values: last expressions that return without a word; any text over lines is written [\s\S], which Java matches without recursion
TAIL_RETURNS = {
    "ruby": [r"def\s+\w+[^\n]*\n(?:(?![ \t]*end\b).*\n)*?[ \t]*(?![ \t]*(?:return|puts|print|raise)\b)\S+[^\n]*\n[ \t]*end\b"],
    "rust": [
        r"fn\s+\w+[^\n]*\{[ \t]*(?!let\b|return\b|if\b|for\b|while\b|loop\b|match\b|else\b|println!|print!)(?<![;{}:])[^\n;{}]+(?<!;)\}",
        r"fn\s+\w+[^\{]*\{[\s\S]*?\n[ \t]*(?!let\b|return\b|if\b|for\b|while\b|loop\b|match\b|else\b|println!|print!)([^\n;{}]+(?<!;))\n[ \t]*\}",
    ],
}
# fixed values: words that are no operands of a product, and names that are no calls
NO_OPERANDS = ["return", "if", "else", "for", "while", "in", "and", "or", "not", "int", "float", "char", "void", "true", "false", "null", "None", "self", "this", "func", "def", "fn", "let", "var", "const", "new", "sizeof", "static", "public", "switch"]
NO_CALLS = ["if", "for", "while", "return", "print", "range", "len", "sum", "sorted", "open", "int", "str", "list", "set", "dict", "console", "document", "Math", "System", "fmt", "println", "puts", "echo", "printf", "scanf", "malloc", "sizeof", "make", "vec", "File", "Integer", "String", "Array", "List", "Int", "void", "char", "string", "number", "bool", "var", "let", "const", "new"]
ARITHMETIC = {"ARITH_ADD": ["+", "+=", "++"], "ARITH_SUB": ["-", "-=", "--"], "ARITH_MUL": ["*="], "ARITH_DIV": ["/="], "ARITH_MOD": ["%="]}
PRODUCTS = {"ARITH_MUL": ["*"], "ARITH_DIV": ["/", "//"], "ARITH_MOD": ["%"]}
OPERAND = r"^(?:[A-Za-z_][A-Za-z0-9_]*|\d+|[)\]}])$"
WRITE_OPEN = r"open\s*\([^)]*['\"][wa]\b"
SQL_READ, SQL_WRITE = r"(?i)execute\s*\([^)]*SELECT", r"(?i)execute\s*\([^)]*(?:INSERT|UPDATE|DELETE|CREATE|DROP)"
STAR_SELECT = r"(?i)SELECT\s+\*\s+FROM"


def language(lang: Column, code: Column) -> Column:
    """The row's language if it has an adapter, else the one whose marks stand in the code."""
    return F.when(lang.isin(*HEADS), lang).otherwise(ft.adapter_language(code))


def _by_language(lang: Column, of, default: Column) -> Column:
    out = F.when(F.lit(False), default)
    for name in OWN:
        cell = of(name)
        out = out if cell is None else out.when(lang == name, cell)
    return out.otherwise(default)


def _products(toks: Column, marks: list[str]) -> Column:
    """Tokens among ``marks`` with an operand on both sides."""
    n = F.size(toks)
    before = F.concat(F.array(F.lit("")), F.slice(toks, 1, F.greatest(n - 1, F.lit(0))))
    after = F.concat(F.slice(toks, 2, F.greatest(n - 1, F.lit(0))), F.array(F.lit("")))
    operand = lambda t: t.rlike(OPERAND) & ~t.isin(*NO_OPERANDS)
    sides = F.zip_with(before, after, lambda b, a: operand(b) & operand(a))
    return F.size(F.filter(F.zip_with(toks, sides, lambda t, s: t.isin(*marks) & s), lambda x: x))


def adapter_counts(text: Column, code: Column, toks: Column, lang: Column) -> dict[str, Column]:
    """Counts of every primitive: ``text`` is the line-stripped code, ``toks`` the tokens of the raw one.

    Patterns of the row's language, sums and differences by token, products only between operands; Python's opens for
    writing and SQL verbs move between reads and writes; a text that names its first function again recurses.
    """
    out: dict[str, Column] = {}
    for p, pats in DEFAULT.items():
        out[p] = _by_language(lang, lambda name, p=p: lex.count_pattern(text, OWN[name][p]) if p in OWN[name] else None, lex.count_pattern(text, pats))
    out["RETURN"] = out["RETURN"] + _by_language(lang, lambda name: lex.count_pattern(text, TAIL_RETURNS[name]) if name in TAIL_RETURNS else None, F.lit(0))
    for p, marks in ARITHMETIC.items():
        out[p] = lex.among(toks, marks) + (_products(toks, PRODUCTS[p]) if p in PRODUCTS else F.lit(0))
    out["ARITH_MUL"] = F.greatest(F.lit(0), out["ARITH_MUL"] - lex.count_pattern(text, [STAR_SELECT]))
    python = lang == "python"
    opens = F.when(python, lex.count_pattern(code, [WRITE_OPEN])).otherwise(0)
    out["READ"] = F.greatest(F.lit(0), out["READ"] - opens) + F.when(python, lex.count_pattern(code, [SQL_READ])).otherwise(0)
    out["WRITE"] = out["WRITE"] + opens + F.when(python, lex.count_pattern(code, [SQL_WRITE])).otherwise(0)

    def again(head: str) -> Column:
        name = F.regexp_extract(text, head, 1)
        rest = F.regexp_replace(text, r"(?s)\A.*?" + f"(?:{head})", "")
        return ((name != "") & F.contains(rest, name)).cast("int")

    out["RECURSE"] = _by_language(lang, lambda name: again(HEADS[name]), F.lit(0))
    return {p: F.coalesce(out[p].cast("int"), F.lit(0)) for p in rules.PRIMITIVES}


def prepared(fns: DataFrame) -> DataFrame:
    """``fns`` (lang, code) with what the counts read: text, toks, and the adapter's language."""
    df = fns.withColumn("adapter", language(F.col("lang"), F.col("code")))
    return ft.with_tokens(df).withColumn("text", lex.line_stripped(F.col("code")))


def counted(fns: DataFrame, ids: list[str]) -> DataFrame:
    """(ids, counts): the counts of every text as an array in the vocabulary's order."""
    df = prepared(fns)
    return df.select(*ids, F.array(*adapter_counts(F.col("text"), F.col("code"), F.col("toks"), F.col("adapter")).values()).alias("counts"))


def with_calls(parts: DataFrame, ids: list[str]) -> DataFrame:
    """(ids, counts): own counts of the functions (ids, name, calls, counts) of every text, and half of those of the
    functions that each calls, rounded down, a callee counting once per call.

    Calls join the functions of the same text by name, so nothing is walked twice. Of two functions of one name the
    last by order holds, as a later definition replaces an earlier one.
    """
    fns = parts.groupBy(*ids, "name").agg(F.max_by(F.struct("calls", "counts"), "nth").alias("f")).select(*ids, "name", "f.calls", "f.counts")
    sites = fns.select(*ids, F.col("name").alias("caller"), F.explode("calls").alias("name")).where("name <> caller")
    called = sites.join(fns.select(*ids, "name", "counts"), [*ids, "name"]).select(*ids, F.transform("counts", lambda c: F.floor(c * 0.5)).alias("counts"))
    every = fns.select(*ids, F.transform("counts", lambda c: c.cast("bigint")).alias("counts")).union(called)
    n = len(rules.PRIMITIVES)
    return every.groupBy(*ids).agg(*[F.sum(F.col("counts")[k]).alias(f"c{k}") for k in range(n)]).select(*ids, F.array(*[F.col(f"c{k}") for k in range(n)]).alias("counts"))


def recursive_counts(fns: DataFrame, ids: list[str]) -> DataFrame:
    """(ids, counts) of every text (ids, lang, code): see ``with_calls``; a text without functions has its own counts."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fns.select(*ids).schema.fields)
    site = re.compile(r"\b(\w+)\s*\(")
    skip = frozenset(NO_CALLS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for code, lang in zip(pdf["code"], pdf["lang"]):
                lines = (code or "").split("\n")
                rows = []
                for nth, (name, _, b, e, *_) in enumerate(flow.functions_in(code, lang)):
                    rows.append({"nth": nth, "name": name, "code": "\n".join(lines[b - 1 : e]), "calls": [x for x in site.findall("\n".join(lines[b:e])) if x not in skip]})
                found.append(rows or [{"nth": -1, "name": "", "code": code, "calls": []}])
            yield pdf[[*ids, "lang"]].assign(found=found)

    inside = fns.select(*ids, "lang", "code").mapInPandas(run, schema + ", lang string, found array<struct<nth:int,name:string,code:string,calls:array<string>>>")
    inside = inside.select(*ids, "lang", F.explode("found").alias("f")).select(*ids, "lang", "f.*")
    return with_calls(counted(inside, [*ids, "nth", "name", "calls"]), ids)


def entries(counts: Column) -> Column:
    """Non-zero counts as (dim, value)."""
    return vx.packed({p: F.element_at(counts, k + 1) for k, p in enumerate(rules.PRIMITIVES)})


def true_similarity(counts_a: Column, counts_b: Column, toks_a: Column, toks_b: Column) -> Column:
    """Cosine of the unit vectors, rounded to 4 decimals, less the larger penalty of opposite operations and other literals; never below 0."""
    unit = lambda c: F.transform(c, lambda v: F.round(F.coalesce(F.try_divide(v, F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x))), F.lit(0.0)), 4))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    a, b = unit(counts_a), unit(counts_b)
    cos = F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b))), F.lit(0.0))
    named = lambda c: {p: F.element_at(c, k + 1) for k, p in enumerate(rules.PRIMITIVES)}
    penalty = F.greatest(sm.polarity_penalty(named(counts_a), named(counts_b)), sm.literal_penalty(sm.literals_near_operators(toks_a), sm.literals_near_operators(toks_b)))
    return F.greatest(F.lit(0.0), cos - penalty)
