"""Pieces of DuckDB SQL for the comparison queries."""

from __future__ import annotations

from codeloam.functions import lex, rules


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def matches(expr: str, patterns: list[str]) -> str:
    return "(" + " + ".join(f"len(regexp_extract_all({expr}, {q(p)}))" for p in patterns) + ")"


def parts(expr: str, texts: list[str]) -> str:
    return "(" + " + ".join(f"((len({expr}) - len(replace({expr}, {q(t)}, ''))) // {len(t)})" for t in texts) + ")"


def hit(expr: str, pattern: str) -> str:
    return f"regexp_matches({expr}, {q(pattern)})"


def any_hit(expr: str, patterns: list[str]) -> str:
    return "(" + " OR ".join(hit(expr, p) for p in patterns) + ")"


def holds(expr: str, text: str) -> str:
    return f"contains({expr}, {q(text)})"


def words_in(toks: str, words: list[str]) -> str:
    return f"len(list_filter({toks}, lambda t: t IN ({', '.join(map(q, words))})))"


LANG = "CASE lower(trim(language)) WHEN 'py' THEN 'python' WHEN 'python3' THEN 'python' WHEN 'js' THEN 'javascript' WHEN 'golang' THEN 'go' ELSE lower(trim(language)) END"
FNS = f"fns AS (SELECT DISTINCT fn_id, project, file, {LANG} AS lang, full_code AS code FROM universal_function WHERE fn_id IS NOT NULL AND full_code IS NOT NULL)"
# texts in quotes first, then comments; the same tokens come out unless a comment holds a lone quote
_T = "code"
for _p in ('"""[\\s\\S]*?"""', "'''[\\s\\S]*?'''", '"(?:\\\\[\\s\\S]|[^"\\\\])*(?:"|\\z)', "'(?:\\\\[\\s\\S]|[^'\\\\])*(?:'|\\z)", "/\\*[\\s\\S]*?\\*/", "#[^\\n]*"):
    _T = f"regexp_replace({_T}, {q(_p)}, ' ', 'g')"
STRIPPED = f"regexp_replace({_T}, '(^|[^A-Za-z0-9._)\\] \\t])([ \\t]*)//[^\\n]*', '\\1 ', 'g')"
TOKS = f"{FNS}, toks AS (SELECT *, {STRIPPED} AS text, regexp_extract_all({STRIPPED}, {q(lex.TOKEN)}) AS toks FROM fns)"
NORMAL = "lower(regexp_replace(code, '\\s+', ' ', 'g'))"
TEXTS = f"{FNS}, texts AS (SELECT *, {NORMAL} AS text FROM fns)"


def head_name(code: str, head: str) -> str:
    return f"regexp_extract({code}, {q(head)}, 1)"


def recursive(code: str, head: str) -> str:
    first = f"regexp_extract({code}, {q(head)}, 0)"
    return f"({head_name(code, head)} <> '' AND contains(substr({code}, instr({code}, {first}) + len({first})), {head_name(code, head)}))"


ANY_HEAD = r"(?:def|function|public\s+\w+\s+\w+|int|void|var)\s+(\w+)\s*\("
DEF_HEAD = r"(?:def|function)\s+(\w+)\s*\("


def token_primitive(p: str) -> str:
    return recursive("code", ANY_HEAD) + "::INT" if p == "RECURSE" else words_in("toks", rules.TOKEN_PRIMITIVES[p])


def long_sql(source: str, ids: str, dims: dict[str, str], scale: str) -> str:
    """Long form of non-zero dims; ``scale`` is l1, l2 or none."""
    rows = " UNION ALL ".join(f"SELECT {ids}, {q(d)} AS dim, ({e})::DOUBLE AS value FROM {source}" for d, e in dims.items())
    value = {"l2": "round(value / sqrt(sum(value * value) OVER (PARTITION BY " + ids + ")), 4)", "l1": "round(value / sum(value) OVER (PARTITION BY " + ids + "), 4)", "none": "value"}[scale]
    return f"SELECT * FROM (SELECT {ids}, dim, {value} AS value FROM ({rows}) WHERE value <> 0) WHERE value <> 0"


def ranked_sql(source: str, ids: str, dims: dict[str, str], n: int) -> str:
    rows = " UNION ALL ".join(f"SELECT {ids}, {q(d)} AS dim, {k} AS ord, ({e})::DOUBLE AS value FROM {source}" for k, (d, e) in enumerate(dims.items()))
    return f"SELECT {ids}, string_agg(dim, '>' ORDER BY r) FILTER (WHERE r <= {n}) AS shape FROM (SELECT *, row_number() OVER (PARTITION BY {ids} ORDER BY value DESC, ord) AS r FROM ({rows}) WHERE value <> 0) GROUP BY {ids}"
