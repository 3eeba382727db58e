"""Functions inside texts and how values move in them: extraction, flow edges, measures."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FUNCTION = "fn_id bigint, name string, params array<string>, start_line int, end_line int, is_async boolean, n_calls int"
EDGE = "fn_id bigint, function string, src string, dst string, kind string, line int"
_NAME = re.compile(r"[A-Za-z_$][\w$]*")
_QUOTED = re.compile(r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|//[^\n]*|/\*.*?\*/', re.S)
_HEADS = {
    "javascript": re.compile(r"(?P<async>async\s+)?function\s*\*?\s*(?P<name>[\w$]+)\s*\((?P<params>[^)]*)\)[^{;]*\{|(?:const|let|var)\s+(?P<name2>[\w$]+)\s*=\s*(?P<async2>async\s*)?\((?P<params2>[^)]*)\)\s*=>\s*\{"),
    "go": re.compile(r"func\s+(?:\([^)]*\)\s*)?(?P<name>\w+)\s*\((?P<params>[^)]*)\)[^{;]*\{"),
    "java": re.compile(r"(?:(?:public|private|protected|static|final|abstract|synchronized)\s+)*[\w<>\[\], ?.]+?[\s\]>](?P<name>\w+)\s*\((?P<params>[^)]*)\)\s*(?:throws\s+[\w., ]+)?\{"),
    "c": re.compile(r"(?:[\w]+[\s*]+)+?(?P<name>\w+)\s*\((?P<params>[^)]*)\)\s*\{"),
}
_HEADS["typescript"] = _HEADS["javascript"]
_CONTROL = frozenset(("if", "for", "while", "switch", "catch", "return", "else", "do", "new", "sizeof"))


def _blanked(code: str) -> str:
    """Texts in quotes and comments replaced by blanks, line ends kept."""
    return _QUOTED.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), code)


def _closing(code: str, at: int) -> int:
    """Offset behind the brace that closes the one before ``at``."""
    depth = 1
    for m in re.compile(r"[{}]").finditer(code, at):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return m.end()
    return len(code)


def _param_names(raw: str, lang: str) -> list[str]:
    out = []
    for p in raw.split(","):
        words = _NAME.findall(p.split("=")[0].split(":")[0] if lang in ("javascript", "typescript", "python") else p)
        if words:
            out.append(words[0] if lang in ("go", "javascript", "typescript", "python") else words[-1])
    return out


def _python_functions(code: str) -> list[tuple[str, list[str], int, int, bool, ast.AST]]:
    out = []
    for n in ast.walk(ast.parse(code)):
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
            a = n.args
            names = [x.arg for x in (*a.posonlyargs, *a.args, *a.kwonlyargs)] + [x.arg for x in (a.vararg, a.kwarg) if x]
            out.append((n.name, names, n.lineno, n.end_lineno or n.lineno, isinstance(n, ast.AsyncFunctionDef), n))
    return out


def _brace_functions(code: str, lang: str) -> list[tuple[str, list[str], int, int, bool, str]]:
    plain = _blanked(code)
    out, at = [], 0
    for m in _HEADS[lang].finditer(plain):
        if m.start() < at:
            continue  # inside the one before
        g = m.groupdict()
        name = g.get("name") or g.get("name2")
        if name in _CONTROL:
            continue
        at = _closing(plain, m.end())
        raw = g.get("params") or g.get("params2") or ""
        out.append((name, _param_names(raw, lang), plain.count("\n", 0, m.start()) + 1, plain.count("\n", 0, at) + 1, bool(g.get("async") or g.get("async2")), plain[m.end() : at]))
    return out


def functions_in(code: str | None, lang: str | None) -> list[tuple]:
    """(name, params, first line, last line, async, body) of the functions of a text; none where it does not parse."""
    try:
        if not code:
            return []
        return _python_functions(code) if lang == "python" else _brace_functions(code, lang) if lang in _HEADS else []
    except (SyntaxError, ValueError, RecursionError):
        return []


def _python_edges(node: ast.AST) -> Iterator[tuple[str, str, str, int]]:
    names = lambda x: {n.id for n in ast.walk(x) if isinstance(n, ast.Name)}

    def called(c: ast.Call) -> str:
        return "call:" + ast.unparse(c.func)

    for n in ast.walk(node):
        line = getattr(n, "lineno", 0)
        if isinstance(n, ast.Call):
            for a in (*n.args, *(k.value for k in n.keywords)):
                for x in names(a):
                    yield x, called(n), "argument", line
        elif isinstance(n, (ast.Assign, ast.AnnAssign, ast.AugAssign)) and n.value is not None:
            targets = n.targets if isinstance(n, ast.Assign) else [n.target]
            sources = names(n.value) - {x for c in ast.walk(n.value) if isinstance(c, ast.Call) for x in names(c.func)}
            for t in targets:
                for y in sorted(names(t)):
                    for x in sources:
                        yield x, y, "assign", line
                    for c in ast.walk(n.value):
                        if isinstance(c, ast.Call):
                            yield called(c), y, "result", line
        elif isinstance(n, (ast.For, ast.AsyncFor, ast.comprehension)):
            for y in names(n.target):
                for x in names(n.iter):
                    yield x, y, "iterate", getattr(n.iter, "lineno", line)
        elif isinstance(n, ast.Return) and n.value is not None:
            for x in names(n.value):
                yield x, "return", "return", line


_ASSIGN = re.compile(r"(?:^|[\s(;{])(?:(?:const|let|var|final|int|long|double|float|char|String|boolean)\s+\**)?([A-Za-z_$][\w$]*)\s*(?::=|[-+*/%]?=)(?!=)\s*([^;\n]+)")
_CALL = re.compile(r"([A-Za-z_$][\w$.]*)\s*\(([^()]*)\)")
_RETURN = re.compile(r"\breturn\b\s*([^;\n}]+)")


def _line_edges(body: str, first: int) -> Iterator[tuple[str, str, str, int]]:
    for k, line in enumerate(body.split("\n")):
        at = first + k
        called = []
        for m in _CALL.finditer(line):
            if m[1] not in _CONTROL:
                called.append(m[1])
                for x in _NAME.findall(m[2]):
                    yield x, f"call:{m[1]}", "argument", at
        for m in _ASSIGN.finditer(line):
            rhs = [x for x in _NAME.findall(m[2]) if x not in called]
            for x in dict.fromkeys(rhs):
                yield x, m[1], "assign", at
            for c in called:
                if c in m[2]:
                    yield f"call:{c}", m[1], "result", at
        for m in _RETURN.finditer(line):
            for x in dict.fromkeys(_NAME.findall(m[1])):
                yield x, "return", "return", at


def extract_functions(fns: DataFrame) -> DataFrame:
    """(fn_id, name, params, start_line, end_line, is_async, n_calls) of every function inside (fn_id, lang, code)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, lang, code in zip(pdf["fn_id"], pdf["lang"], pdf["code"]):
                for name, params, b, e, is_async, body in functions_in(code, lang):
                    n = sum(isinstance(x, ast.Call) for x in ast.walk(body)) if isinstance(body, ast.AST) else sum(m[1] not in _CONTROL for m in re.finditer(r"([A-Za-z_$][\w$.]*)\s*\(", body))
                    rows.append((i, name, params, b, e, is_async, n))
            yield pd.DataFrame(rows, columns=["fn_id", "name", "params", "start_line", "end_line", "is_async", "n_calls"])

    return fns.select("fn_id", "lang", "code").mapInPandas(run, FUNCTION)


def flow_edges(fns: DataFrame) -> DataFrame:
    """(fn_id, function, src, dst, kind, line): distinct moves of values; kinds assign, argument, result, iterate, return, param.

    A ``param`` edge leads from ``param`` to each parameter. Calls are nodes ``call:name``.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = set()
            for i, lang, code in zip(pdf["fn_id"], pdf["lang"], pdf["code"]):
                for name, params, b, _, _, body in functions_in(code, lang):
                    rows |= {(i, name, "param", p, "param", b) for p in params}
                    found = _python_edges(body) if isinstance(body, ast.AST) else _line_edges(body, b)
                    rows |= {(i, name, *e) for e in found}
            yield pd.DataFrame(sorted(rows), columns=["fn_id", "function", "src", "dst", "kind", "line"])

    return fns.select("fn_id", "lang", "code").mapInPandas(run, EDGE)


def flow_measures(edges: DataFrame) -> DataFrame:
    """Per function: variables, edges, shares of edges by kind, greatest fan-in and fan-out."""
    e = edges.where("kind <> 'param'").select("fn_id", "function", "src", "dst", "kind").distinct()
    sides = F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i"))))
    nodes = e.select("fn_id", "function", sides.alias("s")).groupBy("fn_id", "function", "s.node").agg(F.sum("s.o").alias("o"), F.sum("s.i").alias("i"))
    per = nodes.groupBy("fn_id", "function").agg(F.count("*").alias("nodes"), F.max("o").alias("max_fan_out"), F.max("i").alias("max_fan_in"))
    kinds = e.groupBy("fn_id", "function").agg(F.count("*").alias("edges"), *[F.round(F.count_if(F.col("kind") == k) / F.count("*"), 4).alias(k) for k in ("assign", "argument", "result", "iterate", "return")])
    return per.join(kinds, ["fn_id", "function"])
