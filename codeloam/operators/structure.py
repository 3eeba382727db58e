"""Indentation trees of code: signatures, reassembly and similarity, by Arrow functions over whole batches."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloam.functions import rules

_KINDS = [(k, re.compile(p)) for k, p in rules.LINE_KINDS]
# fixed values: a line of code per kind of line
TEMPLATES = {
    "DEF": "def fn(nums):", "ASSIGN": "total = 0", "LOOP": "for n in nums:", "AGGREGATE": "total += n", "RETURN": "return total", "BRANCH": "if a > b:", "COMPARE": "return a",
    "ARITH_ADD": "return a + b", "ARITH_MUL": "return a * b", "WRITE": "print(total)", "READ": "data = input()", "SORT": "return sorted(arr)", "SEARCH": "return arr.index(x)",
    "FILTER": "if n % 2 == 0:", "STATE": "out.append(n)", "EXPR": "pass",
}


def kind_of(line: str) -> str:
    text = line.strip()
    return next((k for k, p in _KINDS if p.search(text)), "EXPR")


def tree(code: str) -> tuple[list[str], list[list[int]]]:
    """(kinds, children): node 0 is the root; a line belongs to the last shallower line before it."""
    kinds, children = ["ROOT"], [[]]
    open_nodes: list[tuple[int, int]] = []
    for line in code.split("\n"):
        if not line.strip():
            continue
        indent = len(line) - len(line.lstrip())
        while open_nodes and open_nodes[-1][0] >= indent:
            open_nodes.pop()
        parent = open_nodes[-1][1] if open_nodes else 0
        kinds.append(kind_of(line))
        children.append([])
        children[parent].append(len(kinds) - 1)
        open_nodes.append((indent, len(kinds) - 1))
    return kinds, children


def signature(code: str | None) -> str | None:
    """The tree as nested text, ``A(B,C)``."""
    if code is None:
        return None
    kinds, children = tree(code)
    text = [""] * len(kinds)
    for n in range(len(kinds) - 1, -1, -1):  # children come after their parents
        text[n] = kinds[n] + (f"({','.join(text[c] for c in children[n])})" if children[n] else "")
    return text[0]


def _forms(kinds: list[str], children: list[list[int]], known: dict[tuple, int]) -> list[int]:
    """Number of each node's form: equal subtrees, of either text, have one number; ``known`` holds (kind, forms below)."""
    form = [0] * len(kinds)
    for n in range(len(kinds) - 1, -1, -1):
        form[n] = known.setdefault((kinds[n], tuple(form[c] for c in children[n])), len(known))
    return form


def similarity(a: str | None, b: str | None) -> float | None:
    """Share of children in the best common order, kind by kind and level by level.

    Subtrees are compared once for each pair of their forms, and lists of children row by row, so texts of many
    thousand lines are compared whole.
    """
    if a is None or b is None:
        return None
    known: dict[tuple, int] = {}
    top_a, top_b = _forms(*tree(a), known)[0], _forms(*tree(b), known)[0]
    nodes = list(known)
    memo: dict[tuple[int, int], float] = {}
    todo = [(top_a, top_b, False)]
    while todo:
        x, y, ready = todo.pop()
        if (x, y) in memo:
            continue
        (kx, cx), (ky, cy) = nodes[x], nodes[y]
        if x == y:
            memo[x, y] = 1.0
        elif kx != ky or not cx or not cy:
            memo[x, y] = 0.0
        elif not ready:
            todo.append((x, y, True))
            todo += [(p, q, False) for p in set(cx) for q in set(cy) if (p, q) not in memo]
        else:
            names = sorted(set(cy))
            at = np.searchsorted(names, cy)
            rows = {p: np.array([memo[p, q] for q in names])[at] for p in set(cx)}
            best = np.zeros(len(cy) + 1)
            for p in cx:
                best[1:] = np.maximum.accumulate(np.maximum(best[1:], best[:-1] + rows[p]))
            memo[x, y] = float(best[-1]) / max(len(cx), len(cy))
    return memo[top_a, top_b]


def assembled(code: str | None) -> str | None:
    """Code of the same tree made of one template line per kind."""
    if code is None:
        return None
    kinds, children = tree(code)
    out, todo = [], [(c, 0) for c in reversed(children[0])]
    while todo:
        n, depth = todo.pop()
        out.append("    " * depth + TEMPLATES[kinds[n]])
        todo += [(c, depth + 1) for c in reversed(children[n])]
    return "\n".join(out)


@F.pandas_udf(T.StringType())
def signature_udf(code: pd.Series) -> pd.Series:
    return code.map(signature)


@F.pandas_udf(T.DoubleType())
def similarity_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([similarity(x, y) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(T.StringType())
def assembled_udf(code: pd.Series) -> pd.Series:
    return code.map(assembled)
