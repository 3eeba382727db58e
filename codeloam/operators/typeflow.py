"""Types of names in Python texts by annotation, value, use and calls, and how they flow between the functions of a text."""

from __future__ import annotations

import ast
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloam.operators.embed import BUCKETS
from codeloam.operators.issues import per_text

# --- fixed values: type of a value by its node, of a call by its name, of an attribute by its name --------------------
NODES = {"List": "LIST", "Dict": "DICT", "Set": "SET", "Tuple": "TUPLE", "ListComp": "LIST", "SetComp": "LIST", "DictComp": "DICT", "GeneratorExp": "LIST", "Lambda": "CALLABLE", "BoolOp": "BOOL", "Compare": "BOOL"}
CALLS = {
    "len": "INT", "int": "INT", "float": "FLOAT", "str": "STR", "bool": "BOOL", "list": "LIST", "dict": "DICT", "set": "SET", "tuple": "TUPLE", "sum": "NUM", "abs": "NUM", "round": "NUM", "min": "NUM", "max": "NUM",
    "sorted": "LIST", "reversed": "LIST", "enumerate": "LIST", "zip": "LIST", "range": "LIST", "open": "FILE", "input": "STR", "repr": "STR", "format": "STR", "chr": "STR", "ord": "INT", "hash": "INT", "id": "INT", "isinstance": "BOOL", "hasattr": "BOOL",
}
METHODS = {
    "append": "NONE", "extend": "NONE", "pop": "UNKNOWN", "remove": "NONE", "insert": "NONE", "index": "INT", "count": "INT", "sort": "NONE", "reverse": "NONE", "get": "UNKNOWN", "keys": "LIST", "values": "LIST", "items": "LIST", "update": "NONE", "setdefault": "UNKNOWN",
    "upper": "STR", "lower": "STR", "strip": "STR", "split": "LIST", "join": "STR", "replace": "STR", "startswith": "BOOL", "endswith": "BOOL", "find": "INT", "format": "STR", "add": "NONE", "union": "SET", "read": "STR", "readline": "STR", "readlines": "LIST", "write": "INT",
    "close": "NONE", "flush": "NONE", "seek": "NONE", "filter": "LIST", "all": "LIST", "first": "UNKNOWN", "get_or_create": "UNKNOWN", "objects": "ORM", "query": "ORM", "execute": "UNKNOWN", "commit": "NONE", "fetchone": "UNKNOWN", "fetchall": "LIST", "fetchmany": "LIST",
}
ATTRIBUTES = {"objects": "ORM", "query": "ORM", "text": "STR", "name": "STR", "id": "INT", "count": "INT", "length": "INT", "size": "INT", "status": "INT", "code": "INT", "value": "UNKNOWN", "data": "UNKNOWN", "items": "LIST", "keys": "LIST", "values": "LIST"}
# --- fixed values: what a method tells of the name it is called on, and a function of its argument --------------------
RECEIVERS = [
    ("LIST", "append extend insert pop remove sort reverse index count"),
    ("DICT", "get keys values items setdefault update"),
    ("STR", "upper lower strip split join replace startswith endswith find format"),
    ("SET", "add union intersection difference"),
    ("ORM", "objects query filter all first get_or_create"),
    ("FILE", "read readline readlines write close seek flush"),
]
ARGUMENTS = [("LIST", "len sum sorted list set tuple reversed enumerate zip"), ("NUM", "int float complex"), ("STR", "str"), ("BOOL", "bool")]
_RECEIVER = {m: t for t, ms in RECEIVERS for m in ms.split()}
_ARGUMENT = {m: t for t, ms in ARGUMENTS for m in ms.split()}
NUMBERS = frozenset(("INT", "FLOAT", "NUM"))
ROUNDS = 3  # calls that a type travels back over


def annotated(hint: ast.AST) -> str:
    """Bucket of an annotation: wrappers and arguments dropped, the last dotted part looked up, capitalised names classes."""
    text = re.sub(r"(?:Optional|Union)\[(.*)\]", r"\1", ast.unparse(hint).strip())
    base = re.sub(r"\[.*\]", "", text).strip().split(".")[-1]
    return BUCKETS.get(base) or ("CLASS" if base[:1].isupper() else "UNKNOWN")


def value_type(node: ast.AST | None) -> str | None:
    """Bucket of a value where its form tells it; names and subscripts tell none."""
    name = type(node).__name__
    if name in NODES:
        return NODES[name]
    if isinstance(node, ast.Constant):
        kinds = {type(None): "NONE", bool: "BOOL", int: "INT", float: "FLOAT", str: "STR", bytes: "STR"}
        return kinds.get(type(node.value))
    if isinstance(node, ast.Call):
        if isinstance(node.func, ast.Name):
            return CALLS.get(node.func.id) or ("CLASS" if node.func.id[:1].isupper() else None)
        return METHODS.get(getattr(node.func, "attr", None))
    if isinstance(node, ast.BinOp) and isinstance(node.op, (ast.Add, ast.Sub, ast.Mult, ast.Div, ast.Mod, ast.FloorDiv, ast.Pow)):
        return "STR" if any(isinstance(x, ast.Constant) and isinstance(x.value, str) for x in (node.left, node.right)) else "NUM"
    if isinstance(node, ast.UnaryOp):
        return value_type(node.operand)
    if isinstance(node, ast.Attribute):
        return ATTRIBUTES.get(node.attr)
    if isinstance(node, ast.IfExp):
        return value_type(node.body) or value_type(node.orelse)
    return None


def _text_like(node: ast.AST) -> bool:
    return (isinstance(node, ast.Constant) and isinstance(node.value, str)) or (isinstance(node, ast.Call) and getattr(node.func, "id", None) == "str")


def types_in(tree: ast.AST) -> tuple[dict[str, str], int]:
    """(name -> bucket, how many names a call told): one bucket for all uses of a name in the text.

    What is declared or assigned comes first, what a method tells of its receiver replaces it, all other uses only fill
    names that are not known; then known parameters tell the names passed to them, ROUNDS times.
    """
    nodes = list(ast.walk(tree))
    types: dict[str, str] = {}
    for n in nodes:
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
            for a in n.args.args:
                if a.annotation is not None:
                    types[a.arg] = annotated(a.annotation)
                else:
                    types.setdefault(a.arg, "UNKNOWN")
        elif isinstance(n, ast.Assign):
            for t in n.targets:
                if isinstance(t, ast.Name) and (b := value_type(n.value)):
                    types[t.id] = b
        elif isinstance(n, ast.AnnAssign) and isinstance(n.target, ast.Name):
            types[n.target.id] = annotated(n.annotation)
        elif isinstance(n, ast.AugAssign) and isinstance(n.target, ast.Name) and (b := value_type(ast.BinOp(n.target, n.op, n.value))):
            types[n.target.id] = b
        elif isinstance(n, ast.For) and isinstance(n.target, ast.Name):
            types.setdefault(n.target.id, "UNKNOWN")

    def fill(node: ast.AST, bucket: str) -> None:
        if isinstance(node, ast.Name) and types.get(node.id, "UNKNOWN") == "UNKNOWN":
            types[node.id] = bucket

    for n in nodes:
        if isinstance(n, ast.Call) and isinstance(n.func, ast.Attribute) and isinstance(n.func.value, ast.Name) and n.func.attr in _RECEIVER:
            types[n.func.value.id] = _RECEIVER[n.func.attr]
        elif isinstance(n, ast.Call) and isinstance(n.func, ast.Name) and n.func.id in _ARGUMENT and n.args:
            fill(n.args[0], _ARGUMENT[n.func.id])
        elif isinstance(n, (ast.For, ast.AsyncFor)):
            fill(n.iter, "LIST")
        elif isinstance(n, ast.BinOp):
            for x in (n.left, n.right):
                fill(x, "STR" if _text_like(n.left) or _text_like(n.right) else "NUM")
        elif isinstance(n, ast.Compare):
            for x in (n.left, *n.comparators):
                fill(x, "NUM")

    told = 0
    heads = {n.name: [a.arg for a in n.args.args] for n in nodes if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))}
    sites = [n for n in nodes if isinstance(n, ast.Call) and isinstance(n.func, ast.Name) and n.func.id in heads]
    for _ in range(ROUNDS):
        known = {f: [types.get(p, "UNKNOWN") for p in ps] for f, ps in heads.items()}
        for n in sites:
            for a, bucket in zip(n.args, known[n.func.id]):
                if isinstance(a, ast.Name) and bucket != "UNKNOWN" and types.get(a.id, "UNKNOWN") == "UNKNOWN":
                    types[a.id] = bucket
                    told += 1
    return types, told


def compatible(a: str, b: str) -> bool:
    return a == b or "UNKNOWN" in (a, b) or (a in NUMBERS and b in NUMBERS)


def calls_in(code: str) -> list[dict]:
    """Arguments of calls between the functions of a text: buckets of argument and parameter, whether they agree, and
    whether the arguments of a call are those of the parameters in another order. None where the text does not parse."""
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError, RecursionError):
        return []
    types, _ = types_in(tree)
    defs = [n for n in ast.walk(tree) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))]
    heads = {n.name: [a.arg for a in n.args.args] for n in defs}
    out = []
    for n in ast.walk(tree):
        if not (isinstance(n, ast.Call) and isinstance(n.func, ast.Name) and n.func.id in heads):
            continue
        around = [d for d in defs if d.lineno <= n.lineno <= (d.end_lineno or d.lineno)]
        caller = max(around, key=lambda d: d.lineno).name if around else "<module>"
        params = heads[n.func.id]
        want = [types.get(p, "UNKNOWN") for p in params]
        have = [types.get(a.id, "UNKNOWN") if isinstance(a, ast.Name) else value_type(a) or "UNKNOWN" for a in n.args[: len(params)]]
        swapped = len(have) >= 2 and len(have) == len(params) and "UNKNOWN" not in have + want and have != want and sorted(have) == sorted(want)
        for a, p, h, w in zip(n.args, params, have, want):
            out.append({"caller": caller, "callee": n.func.id, "line": n.lineno, "arg": ast.unparse(a), "param": p, "arg_type": h, "param_type": w, "propagated": h == "UNKNOWN" != w, "error": not compatible(h, w), "swapped": swapped})
    return out


def names_in(code: str) -> list[dict]:
    try:
        types, _ = types_in(ast.parse(code))
    except (SyntaxError, ValueError, RecursionError):
        return []
    return [{"name": n, "type": t} for n, t in types.items()]


def inferred_types(fns: DataFrame) -> DataFrame:
    """(fn_id, name, type) of every name of Python texts that is declared, assigned or used in a telling way."""
    return per_text(fns.where("lang = 'python'"), ["fn_id"], names_in, "name:string,type:string")


def type_flow(fns: DataFrame) -> DataFrame:
    """(fn_id, caller, callee, line, arg, param, arg_type, param_type, propagated, error, swapped) of Python texts."""
    return per_text(fns.where("lang = 'python'"), ["fn_id"], calls_in, "caller:string,callee:string,line:int,arg:string,param:string,arg_type:string,param_type:string,propagated:boolean,error:boolean,swapped:boolean")


def profiles(types: DataFrame) -> DataFrame:
    """(fn_id, dim, value): unit vector of the buckets of a text's names, the same under renaming."""
    n = types.groupBy("fn_id", F.concat(F.lit("TYPE:"), "type").alias("dim")).agg(F.count("*").alias("n"))
    norm = n.groupBy("fn_id").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    return n.join(norm, "fn_id").select("fn_id", "dim", F.round(F.col("n") / F.col("norm"), 4).alias("value"))
