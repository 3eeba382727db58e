"""Values inside one text: parameters, assignments, what derives from inputs, types by hint and use. Plain functions for Arrow batches."""

from __future__ import annotations

import functools
import re

from codeloam.functions import security as rules

ASSIGNED = re.compile(r"(\w+)\s*=\s*([^;\n]+)")
COMPARES = ("=", "!", "<", ">")
_HEAD = re.compile(r"(?:def|function|func|fun)\s+\w+\s*\(([^)]*)\)")


@functools.lru_cache(maxsize=20_000)
def word(name: str, fold: bool = False) -> re.Pattern:
    """``name`` as a whole word."""
    return re.compile(r"\b" + re.escape(name) + r"\b", re.I if fold else 0)


def holds(name: str, text: str, fold: bool = False) -> bool:
    """Whether ``text`` has ``name`` as a whole word; a cheap search of the plain text goes before the pattern."""
    return (name.lower() in text.lower() if fold else name in text) and word(name, fold).search(text) is not None


def params_of(code: str) -> list[str]:
    """Parameter names of the functions in a text, in order, without types and defaults."""
    names = (p.strip().split(":")[0].strip().split("=")[0].strip() for m in _HEAD.finditer(code) for p in m[1].split(","))
    return list(dict.fromkeys(n for n in names if re.match(r"[a-zA-Z_]", n)))


def assignments(code: str) -> dict[str, str]:
    """The last right side of every assigned name; comparisons are none."""
    return {m[1]: m[2].strip() for m in ASSIGNED.finditer(code) if not m[2].strip().startswith(("=", "==", "!=", "<=", ">="))}


def tainted(code: str, params: list[str] | None = None) -> dict[str, list[str]]:
    """name -> kinds of input it derives from: a fixed point over the assignments, in order of discovery."""
    out = {p: ["PARAM"] for p in (params_of(code) if params is None else params)}
    left = {v: rhs for v, rhs in assignments(code).items() if v not in out}
    direct = {v: {k for k, p in rules.INPUTS.items() if k != "PARAM" and re.search(p, rhs)} for v, rhs in left.items()}
    moved = True
    while moved:
        moved = False
        for var in [v for v in left if v not in out]:
            kinds = set(direct[var]).union(*(set(k) for t, k in out.items() if holds(t, left[var])))
            if kinds:
                out[var] = sorted(kinds)
                moved = True
    return out


def ordered_assignments(code: str) -> list[tuple[str, str]]:
    found = (re.match(r"\s*(\w+)\s*=\s*(.+)$", line) for line in code.splitlines())
    return [(m[1], m[2].strip()) for m in found if m and not m[2].startswith(("=", "==", "!=", "<=", ">="))]


def taint_path(code: str, target: str, taint: dict[str, list[str]] | None = None) -> list[str]:
    """The way of an input to the text ``target``: its kinds, the names assigned on the way, the name used, the target.

    Without a name in between the kind found in ``target`` itself stands first, without any the target stands alone.
    """
    taint = tainted(code) if taint is None else taint
    last = target.strip()[:40]
    name = next((v for v in taint if holds(v, target)), None)
    if name is None:
        kind = next((k for k in ("REQUEST", "PARAM", "CONSTANT") if re.search(rules.INPUTS[k], target, re.I)), None)
        return [kind, last] if kind else [last]
    steps = ordered_assignments(code)
    between = []
    for var, _ in steps:
        if var == name:
            break
        if var not in between and any(v != var and holds(var, rhs) for v, rhs in steps):
            between.append(var)
    path = [p for p in [",".join(taint[name]), *between, name, last] if p]
    return path[:1] + path[2:] if len(path) >= 3 and path[0] == path[1] else path


def outputs_of(code: str, taint: dict[str, list[str]]) -> list[tuple[str, list[str]]]:
    """(RETURN or PRINT, kinds of input in it) of every output expression."""
    exprs = [("RETURN", m[1]) for m in re.finditer(r"\breturn\b\s*([^;\n]+)", code)]
    exprs += [("PRINT", m[1] or m[2] or "") for m in re.finditer(r"\bprint\s*\(([^)]*)\)|console\.log\s*\(([^)]*)\)", code)]
    return [(kind, sorted({k for v, ks in taint.items() if holds(v, e) for k in ks})) for kind, e in exprs]


# --- types by hint, declaration, right side and use ---------------------------------------------------------------

# fixed values: words of an annotation and what they mean, in order
HINTS = [
    ("LIST", ["[]", "list", "array", "vec", "slice", "set"]),
    ("DICT", ["map", "dict", "hashmap", "dictionary", "record"]),
    ("STR", ["string", "str", "char*", "&str", "text"]),
    ("INT", ["int", "i32", "i64", "long", "short", "usize", "size_t", "uint", "byte"]),
    ("FLOAT", ["float", "double", "f32", "f64"]),
    ("ORM", ["repo", "model", "query", "entity", "orm"]),
]


def hinted(hint: str | None) -> str | None:
    low = (hint or "").strip().lower()
    return next((t for t, words in HINTS if low and any(w in low for w in words)), None)


def typed_by_text(expr: str) -> str:
    """The first type one of whose texts stands in ``expr``; the texts are compared as they are written."""
    return next((t for t, texts in rules.TYPE_TEXTS.items() if any(x in expr for x in texts)), "UNKNOWN")


def types_of(code: str, params: list[tuple[str, str | None]] | None = None) -> dict[str, str]:
    """name -> LIST, DICT, STR, INT, FLOAT, ORM, PARAM or UNKNOWN.

    Annotated parameters first, then declarations with a type, then right sides; parameters without a type are told by
    their use. ``params`` are (name, hint) pairs if a parser knows them, else they are read from the heads.
    """
    if params is None:
        params = []
        for m in re.finditer(r"(?:def|function|func|fn|fun)\s+\w+\s*\(([^)]*)\)", code):
            for p in m[1].split(","):
                name, _, hint = p.split("=")[0].strip().partition(":" if ":" in p else " ")
                if name.strip():
                    params.append((name.strip(), hint.strip() or None))
    out: dict[str, str] = {}
    for name, hint in params:
        if hint:
            out[name] = hinted(hint) or "PARAM"
        else:
            out.setdefault(name, "PARAM")
    for m in re.finditer(r"^[ \t]*([\w<>\[\]*&]+)\s+([a-zA-Z_]\w*)\s*=\s*[^;\n]+", code, re.M):
        if kind := hinted(m[1]):
            out[m[2]] = kind
    for m in ASSIGNED.finditer(code):
        if out.get(m[1], "PARAM") in ("PARAM", "UNKNOWN"):
            kind = typed_by_text(m[2].strip())
            if kind != "UNKNOWN" or m[1] not in out:
                out[m[1]] = kind
    for name in [n for n, t in out.items() if t == "PARAM"]:
        w = r"\b" + re.escape(name)
        indexed = re.search(w + r"\s*\[[^\]]*\]", code)
        if indexed and re.search(rf"len\s*\(\s*{re.escape(name)}\)|{w}\.append|range\s*\(", code):
            out[name] = "LIST"
        elif indexed and re.search(w + r"\.(?:get|keys|values|items)\s*\(", code):
            out[name] = "DICT"
        elif re.search(w + r"\.(?:objects|query|filter|all|first)\b", code):
            out[name] = "ORM"
    return out


def subscripts(code: str, types: dict[str, str]) -> list[tuple[str, str, str]]:
    """(object, index, class) of every subscript, by the object's type."""
    kind = {"LIST": "LIST_INDEX", "DICT": "DICT_ACCESS", "ORM": "ORM_ACCESS"}
    return [(m[1], m[2].strip(), kind.get(types.get(m[1], "UNKNOWN"), "UNKNOWN_ACCESS")) for m in re.finditer(r"(\w+)\s*\[\s*([^\]]+)\s*\]", code)]


def may_overflow(code: str) -> bool:
    """Whether a list is indexed by a parameter and nothing looks like a check of bounds."""
    types = types_of(code)
    checked = "if 0 <=" in code or ("if " in code and "len(" in code)
    return not checked and any(c == "LIST_INDEX" and types.get(i) == "PARAM" for _, i, c in subscripts(code, types))
