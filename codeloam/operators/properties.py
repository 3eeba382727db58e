"""Properties of data, control and effects, values derived from them, and the risk of what was found in a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloam.functions import lex, rules

# fixed values: tokens, methods and patterns that show a property
TYPE_WORDS = {"PROP:NUM": ["str", "float", "int"], "PROP:LIST": ["list", "tuple", "set", "dict"], "PROP:DICT": ["{"], "PROP:HANDLES_ERRORS": ["try", "except", "finally", "catch", "throw"], "PROP:SIDE_EFFECTS": ["print", "printf", "puts", "echo"]}
METHODS = {
    "PROP:LIST": ["append", "extend", "keys", "values", "items", "get"],
    "PROP:DICT": ["get", "keys", "values", "items"],
    "PROP:MUTABLE": ["append", "add", "insert", "remove", "pop", "extend", "update", "set"],
    "PROP:TRANSFORM": ["upper", "lower", "strip", "replace", "split", "join"],
    "PROP:SIDE_EFFECTS": ["write", "send", "emit", "log"],
}
TEXTS = {"PROP:NUM": r"\b\d+\.\d+\b", "PROP:IO": r"\b(?:open|read|write|requests|urlopen|fetch)\s*\("}
COUNTS = {
    "PROP:BRANCHES": ["if", "else", "elif", "switch", "case", "when"],
    "PROP:LOOPS": ["for", "while", "foreach", "until", "repeat"],
    "PROP:OUTPUTS": ["return"],
    "VAL:FLOW_DEPTH": ["=", "+=", "-=", "*=", "/=", "%="],
    "VAL:BRANCHING": ["if", "elif", "when", "switch", "case"],
    "VAL:COUPLING": ["import", "from", "require", "include", "use"],
}
HEAD = r"(?:def|function|func|fun)\s+\w+\s*\(([^)]*)\)"
FLAGS = ["PROP:NUM", "PROP:LIST", "PROP:DICT", "PROP:MUTABLE", "PROP:TRANSFORM", "PROP:HANDLES_ERRORS", "PROP:SIDE_EFFECTS", "PROP:IO"]


def methods_of(toks: Column) -> Column:
    """Tokens right after a dot."""
    n = F.size(toks)
    after = F.slice(toks, 2, F.greatest(n - 1, F.lit(0)))
    return F.filter(F.zip_with(F.slice(toks, 1, F.greatest(n - 1, F.lit(0))), after, lambda t, a: F.when(t == ".", a)), lambda x: x.isNotNull())


def dims(toks: Column, text: Column, methods: Column) -> dict[str, Column]:
    """PROP flags and counts and VAL counts of a text; ``text`` is the code without comments and quoted texts."""
    out = {}
    for d in FLAGS:
        seen = F.lit(False)
        if d in TYPE_WORDS:
            seen = seen | (lex.among(toks, TYPE_WORDS[d]) > 0)
        if d in METHODS:
            seen = seen | (lex.among(methods, METHODS[d]) > 0)
        if d in TEXTS:
            seen = seen | text.rlike(TEXTS[d])
        out[d] = seen.cast("int")
    params = F.split(F.regexp_extract(text, HEAD, 1), ",")
    out["PROP:INPUTS"] = F.size(F.filter(params, lambda p: F.trim(p) != ""))
    return out | {d: lex.among(toks, words) for d, words in COUNTS.items()}


def risks(found: DataFrame) -> DataFrame:
    """(fn_id, risk, severity): the greatest of a text's findings by weight of severity or exploitability, and its severity."""
    weight = F.coalesce(F.create_map(*[F.lit(x) for kv in rules.SEVERITY_WEIGHT.items() for x in kv])[F.col("severity")], F.lit(0.0))
    w = found.select("fn_id", "severity", F.greatest(weight, F.least(F.lit(1.0), "score")).alias("w"))
    return w.groupBy("fn_id").agg(F.round(F.max("w"), 3).alias("risk"), F.max_by("severity", F.struct("w", "severity")).alias("severity"))
