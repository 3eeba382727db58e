"""Findings with their place: sinks by weakness, other names of dangerous functions, calls by role, unchecked indexes; then what is known about each weakness."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloam.functions import rules as words
from codeloam.functions import security as rules
from codeloam.operators import dataflow as flow
from codeloam.operators import detect as dt
from codeloam.operators import values as vl

FINDING = "struct<weakness:string,line:int,sink:string,source:string,dimension:string,code_line:string,function:string,first_line:int,last_line:int,path:array<string>,detector:string>"
CONTEXT = 4  # lines up to the sink in which a mitigation counts
_SINKS = {k: [re.compile(p, re.I) for p in ps] for k, ps in rules.SINKS.items()}
_SAFE = {k: [re.compile(p, re.I) for p in ps] for k, ps in rules.MITIGATIONS.items()}
_DECLARED = re.compile(r"(?:def|function|func|fun)\s*(?:<[^>]*>)?\s*$")
_RAISES_ALONE = re.compile(r"innerHTML\s*(?:=|\+=)|document\.write|\.html\s*\(|v-html")
_NAME = re.compile(r"[A-Za-z_]\w*")


class Text:
    """A text with what its detectors share, each computed once: lines, parameters, derived names, functions."""

    def __init__(self, code: str, lang: str | None) -> None:
        self.code, self.lang = code, lang
        self.lines = code.splitlines()
        self.taint = vl.tainted(code)
        self.any_source = bool(self.taint) or any(vl.holds(s, code, True) for s in rules.TEXT_SOURCES)
        self._functions: list[tuple] | None = None

    def line(self, n: int) -> str:
        return self.lines[n - 1] if 0 < n <= len(self.lines) else ""

    def line_at(self, offset: int) -> int:
        return self.code.count("\n", 0, offset) + 1

    def function_at(self, n: int) -> tuple[str, int, int]:
        """The smallest function around line ``n``, or the whole text."""
        if self._functions is None:
            self._functions = [(name, b, e) for name, _, b, e, *_ in flow.functions_in(self.code, self.lang)]
        around = [f for f in self._functions if f[1] <= n <= f[2]]
        return min(around, key=lambda f: f[2] - f[1]) if around else ("<module>", 1, len(self.lines))

    def source(self, text: str, names: str) -> str | None:
        """The first source word in ``text``, else the first derived name in ``names``."""
        return next((s for s in rules.SOURCES if vl.holds(s, text, True)), None) or next((v for v in self.taint if vl.holds(v, names)), None)

    def finding(self, detector: str, weakness: str, n: int, sink: str, source: str | None, path: list[str], dimension: str | None = None, whole: bool = False) -> dict:
        name, b, e = ("<module>", 1, len(self.lines)) if whole else self.function_at(n)
        return {"weakness": weakness, "line": n, "sink": sink, "source": source, "dimension": dimension or rules.DIMENSIONS.get(weakness, "FLOW:UNKNOWN"), "code_line": self.line(n).strip()[:60], "function": name, "first_line": b, "last_line": e, "path": path, "detector": detector}


def pattern_sinks(t: Text) -> Iterator[dict]:
    """Matches of the sink patterns that are no declarations, without a mitigation in the lines up to them.

    Patterns that end in a bare name, and weaknesses that live from input, count only with a source on the line or in
    the text, or if the sink itself mixes values into its text.
    """
    for weakness, patterns in _SINKS.items():
        for p in patterns:
            for m in p.finditer(t.code):
                if _DECLARED.search(t.code[max(0, m.start() - 40) : m.start()]):
                    continue
                n = t.line_at(m.start())
                context = "\n".join(t.lines[max(0, n - CONTEXT) : n])
                if any(s.search(context) for s in _SAFE.get(weakness, [])):
                    continue
                line, sink = t.line(n), m[0].strip()[:40]
                source = t.source(line, line)
                gated = p.pattern.endswith(r"[a-zA-Z_]\w*") or weakness in ("CSRF", "IDOR") or weakness in rules.NEEDS_TAINT
                alone = "${" in sink or m[0].startswith("f") or (weakness == "XSS" and _RAISES_ALONE.search(sink))
                if gated and not source and not t.any_source and not alone:
                    continue
                yield t.finding("patterns", weakness, n, sink, source, vl.taint_path(t.code, line, t.taint))


def aliased_sinks(t: Text) -> Iterator[dict]:
    """Calls with arguments of names that were assigned a dangerous function; reflective ones only by what they name."""
    names: dict[str, tuple[bool, str]] = {}
    for m in re.finditer(r"\b(\w+)\s*=\s*([A-Za-z_]\w*(?:\.[A-Za-z_]\w*)?)\s*$", t.code, re.M):
        base = m[2].split(".")[-1]
        if m[1] not in ("self", "cls") and (base in rules.ALIASED or base in rules.REFLECTIVE):
            names[m[1]] = (base in rules.ALIASED, rules.ALIASED.get(base, base))
    for name, (plain, weakness) in names.items():
        first = t.line_at(t.code.find(name))
        for m in re.finditer(r"\b" + re.escape(name) + r"\s*\((.*?)\)", t.code):
            n, arg = t.line_at(m.start()), m[1].strip()
            if not arg or n == first:
                continue
            if not plain:
                named = r"(?:eval|exec|compile|system|popen|calls?)\b" if weakness == "getattr" else r"['\"](?:os|subprocess|pty|commands)['\"]"
                if not re.search(named, arg):
                    continue
            kind = weakness if plain else "CMD_INJECTION"
            source = t.source(t.line(n), arg)
            if not source and (kind in rules.NEEDS_TAINT or not t.any_source) and kind not in rules.SELF_TAINTED:
                continue
            yield t.finding("aliases", kind, n, f"{name}({arg[:20]})", source, [source or "?", name], whole=True)


def role_of_call(name: str) -> str | None:
    """The role with most of its words in a name, the first of equals."""
    low = " ".join(w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+", name))
    best, score = None, 0
    for role, parts in words.ROLE_WORDS.items():
        hits = sum(w in low for w in parts)
        if hits > score:
            best, score = role, hits
    return best


def _head_names(code: str) -> set[str]:
    """Parameter names of heads in any language: words before a colon or a default, or the last word of a typed one."""
    out = set()
    for m in re.finditer(r"(?:def|function|func|fun)\s+[\w:]+\s*\(([^)]*)\)", code):
        out |= {re.sub(r"[$@]", "", re.split(r"[:\s=]", p.strip())[0]) for p in m[1].split(",")}
    for m in re.finditer(r"(?m)^\s*(?:(?:public|private|protected|static)\s+)?(\S+)\s+([A-Za-z_]\w*)\s*\(([^)]*)\)", code):
        if m[1].lower() not in _VERBS and m[2].lower() not in _VERBS:
            out |= {p.split()[-1].replace("$", "").replace("*", "") for p in m[3].split(",") if p.split()}
    return {x for x in out if re.fullmatch(r"[A-Za-z_]\w*", x)}


# fixed values: words before a call that make it no head
_VERBS = frozenset("return throw yield await echo print printf new if for while switch catch import from using namespace package require include break continue else elif".split())
_CALL = re.compile(r"([A-Za-z_][\w.]*)\s*\(")


def role_sinks(t: Text) -> Iterator[dict]:
    """Calls whose name has a dangerous role and whose arguments hold a source, a derived name or a parameter."""
    plain = flow._blanked(t.code)
    params = None
    for m in _CALL.finditer(plain):
        name = m[1].split(".")[-1]
        if name in rules.PLAIN_CALLS or _DECLARED.search(plain[max(0, m.start() - 40) : m.start()]):
            continue
        role = role_of_call(name)
        if role not in rules.ROLE_WEAKNESS:
            continue
        depth, e = 1, m.end()
        while e < len(plain) and depth:
            depth += (plain[e] == "(") - (plain[e] == ")")
            e += 1
        args = plain[m.end() : e - 1][:120]
        n = t.line_at(m.start())
        source = t.source(plain[plain.rfind("\n", 0, m.start()) + 1 :].split("\n", 1)[0], args)
        if not source:
            params = _head_names(t.code) if params is None else params
            source = next((p for p in sorted(params) if vl.holds(p, args)), None)
        if source or t.any_source:
            yield t.finding("roles", rules.ROLE_WEAKNESS[role], n, f"{name}({args[:30]})", source, [source or "?", name], f"SHAPE:{role}", whole=True)


_BOUNDS = re.compile(r"if\s+0\s*<=\s*\w+\s*<\s*len|if\s+\w+\s*<\s*len|if\s+\w+\s*<=\s*len")


def unchecked_indexes(t: Text) -> Iterator[dict]:
    """Subscripts of lists and of what is not known by a parameter, or a slice from or to one, without a bounds check."""
    types = vl.types_of(t.code)
    if _BOUNDS.search(t.code):
        return
    for name, index, kind in vl.subscripts(t.code, types):
        if kind not in ("LIST_INDEX", "UNKNOWN_ACCESS"):
            continue
        parts = [p.strip() for p in index.split(":")]
        var = parts[0] if len(parts) == 1 else next((p for p in parts if types.get(p) == "PARAM"), parts[0])
        if types.get(var) == "PARAM":
            m = re.search(re.escape(name) + r"\s*\[", t.code)
            yield t.finding("indexes", "BUFFER_OVERFLOW", t.line_at(m.start()), f"{name}[{index}]", var, [var, f"{name}[{index}]"])


def findings_in(code: str | None, lang: str | None) -> list[dict]:
    """All findings of one text, one per weakness and line for the sinks, then the unchecked indexes."""
    if not code:
        return []
    t = Text(code, lang)
    first: dict[tuple, dict] = {}
    for detector in (pattern_sinks, aliased_sinks, role_sinks):
        for x in detector(t):
            first.setdefault((x["weakness"], x["line"]), x)
    return [*first.values(), *unchecked_indexes(t)]


def issues(df: DataFrame, ids: list[str]) -> DataFrame:
    """(ids, lang, code, finding fields): one row per finding of (ids, lang, code).

    One pass in Arrow batches, no shuffle; the code stays in the row for what is derived from it afterwards. Null and
    empty code has no findings, repeated rows repeat theirs, an empty table gives an empty result.
    """
    keep = [*ids, "lang", "code"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields) + f", found array<{FINDING}>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(found=[findings_in(c, lang) for c, lang in zip(pdf["code"], pdf["lang"])])

    return df.select(*keep).mapInPandas(run, schema).select(*keep, F.explode("found").alias("f")).select(*keep, "f.*")


def _known(column: str, position: int) -> Column:
    """Field of the taxonomy by weakness, the entry for others where it has none."""
    table = {k: v[position] for k, v in rules.TAXONOMY.items()}
    cell = (lambda v: F.array(*[F.lit(x) for x in v]).cast("array<string>")) if isinstance(rules.OTHER[position], list) else F.lit
    return F.coalesce(F.create_map(*[c for k, v in table.items() for c in (F.lit(k), cell(v))])[F.upper(column)], cell(rules.OTHER[position]))


def with_taxonomy(found: DataFrame) -> DataFrame:
    """``found`` (weakness, source, dimension) with cwe, title, owasp, severity, cases, tags, description, remediation."""
    names = ["cwe", "title", "owasp", "base_severity", "cases", "base_tags", "description"]
    found = found.withColumns({n: _known("weakness", k) for k, n in enumerate(names)})
    guide = F.create_map(*[F.lit(x) for kv in rules.GUIDE.items() for x in kv])
    own = F.array_compact(F.array(F.when(F.col("source").isNotNull(), F.concat(F.lit("source:"), "source")), F.when(F.col("dimension").isNotNull(), F.concat(F.lit("shape:"), "dimension"))))
    return found.withColumn("remediation", F.coalesce(guide[F.upper("weakness")], F.lit(rules.OTHER_GUIDE))).withColumn("tags", F.array_sort(F.array_union("base_tags", own))).drop("base_tags")


def enriched_findings(df: DataFrame, ids: list[str]) -> DataFrame:
    """Findings with taxonomy, exploitability and the severity that it sets: CRITICAL from 0.8, HIGH from 0.6, MEDIUM
    from 0.4, else the one of the weakness."""
    found = with_taxonomy(issues(df, ids)).withColumn("kind", F.col("weakness"))
    scored = dt.exploitability(found)
    severity = F.when(F.col("score") >= 0.8, "CRITICAL").when(F.col("score") >= 0.6, "HIGH").when(F.col("score") >= 0.4, "MEDIUM").otherwise(F.col("base_severity"))
    return scored.withColumn("severity", severity).drop("code", "kind", "base_severity")


def verdicts(found: DataFrame) -> DataFrame:
    """``found`` (source, code_line, path) with kept and reason: findings from sources nobody else controls, or without any
    source, are set aside; those near a mitigation stay for review."""
    low = F.lower(F.coalesce("source", F.lit("")))
    private = [F.contains(low, F.lit(w)) for w in rules.PRIVATE_SOURCES]
    near = F.lower(F.concat_ws(" ", "code_line", F.array_join(F.coalesce("path", F.array().cast("array<string>")), " ")))
    by = [F.contains(near, F.lit(w)) for w in rules.PRUNED_BY]
    any_of = lambda cs: F.greatest(*[c.cast("int") for c in cs]) == 1
    nothing = (low == "") & (F.size(F.coalesce("path", F.array().cast("array<string>"))) == 0)
    reason = F.when((low != "") & any_of(private), "source is not public").when(any_of(by), "mitigation near, for review").when(nothing, "no source").otherwise("source reaches sink")
    return found.withColumn("reason", reason).withColumn("kept", ~F.col("reason").isin("source is not public", "no source"))


# --- intent of calls ------------------------------------------------------------------------------------------------

_ARGUMENTS = {k: [re.compile(p, re.I) for p in ps] for k, ps in rules.INTENT_ARGUMENTS.items()}
# fixed values: category of a call by parts of its name, in order
CALL_PARTS = [
    ("CODE_EXEC", ["exec", "system", "eval", "run", "process", "invoke", "spawn", "popen", "compile"]),
    ("SQL", ["query", "select", "insert", "update", "delete", "sql"]),
    ("FILE", ["open", "read", "write", "file"]),
    ("RENDER", ["render", "html", "template"]),
    ("DESERIALIZE", ["load", "deserialize", "unserialize", "parse"]),
]


def first_arguments(code: str, at: int) -> str:
    """Text from the next opening bracket to the first closing one."""
    b = code.find("(", at)
    e = code.find(")", b)
    return code[b + 1 : e] if b >= 0 and e >= 0 else ""


def _harmless(name: str, args: str) -> bool:
    low = name.lower()
    return bool(
        (("subprocess" in low or low in ("run", "call", "popen")) and args.strip().startswith("["))
        or re.search(r"escape\s*\(|basename\s*\(|sanitize|quote\s*\(|replace\s*\(|safe\s*=\s*True|resolve_entities\s*=\s*False", args)
        or ("loads" in low and "json" in args)
    )


def intents_in(code: str | None) -> list[dict]:
    """Calls that get a derived value and are dangerous by name or by argument: category, call, arguments, in order."""
    out = []
    taint = vl.tainted(code) if code else {}
    for m in re.finditer(r"([a-zA-Z_]\w*)\s*\(", code or "") if taint else ():
        name = m[1]
        args = first_arguments(code, m.start()) if name not in rules.NO_CALLS else ""
        if not args or not any(vl.holds(v, args) for v in taint):
            continue
        low = name.lower()
        by_argument = next((k for k, ps in _ARGUMENTS.items() if any(p.search(args) for p in ps)), None)
        if (by_argument or low in rules.INTENT_NAMES or any(x in low for x in rules.INTENT_PARTS)) and not _harmless(name, args):
            category = by_argument or next((k for k, parts in CALL_PARTS if any(x in low for x in parts)), "UNKNOWN")
            out.append({"category": category, "call": name, "args": args.strip()[:40]})
    return out


def per_text(df: DataFrame, ids: list[str], of, fields: str) -> DataFrame:
    """(ids, fields): what the plain function ``of(code)`` yields for each row, in Arrow batches without a shuffle."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*ids).schema.fields) + f", found array<struct<{fields}>>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[ids].assign(found=[of(c) if c else [] for c in pdf["code"]])

    return df.select(*ids, "code").mapInPandas(run, schema).select(*ids, F.explode("found").alias("f")).select(*ids, "f.*")


def dangerous_intents(df: DataFrame, ids: list[str]) -> DataFrame:
    """(ids, category, call, args) of every call that ``intents_in`` names."""
    return per_text(df, ids, intents_in, "category:string,call:string,args:string")


def derived_names(df: DataFrame, ids: list[str]) -> DataFrame:
    """(ids, name, kinds): names that derive from inputs, with the kinds of input."""
    return per_text(df, ids, lambda c: [{"name": n, "kinds": k} for n, k in vl.tainted(c).items()], "name:string,kinds:array<string>")


def return_paths(df: DataFrame, ids: list[str]) -> DataFrame:
    """(ids, line, path): the way of inputs into every line that returns."""

    def of(code: str) -> list[dict]:
        taint = vl.tainted(code)
        return [{"line": k, "path": vl.taint_path(code, s, taint)} for k, s in enumerate(code.splitlines(), 1) if re.search(r"\breturn\b", s)]

    return per_text(df, ids, of, "line:int,path:array<string>")


def output_kinds(df: DataFrame, ids: list[str]) -> DataFrame:
    """(ids, output, kinds): outputs with the kinds of input that flow into them."""
    return per_text(df, ids, lambda c: [{"output": o, "kinds": k} for o, k in vl.outputs_of(c, vl.tainted(c))], "output:string,kinds:array<string>")


def variable_types(df: DataFrame, ids: list[str]) -> DataFrame:
    """(ids, name, type) of every parameter and assigned name."""
    return per_text(df, ids, lambda c: [{"name": n, "type": t} for n, t in vl.types_of(c).items()], "name:string,type:string")


def accesses(df: DataFrame, ids: list[str]) -> DataFrame:
    """(ids, object, index, class, may_overflow) of every subscript."""

    def of(code: str) -> list[dict]:
        risk = vl.may_overflow(code)
        return [{"object": o, "index": i, "class": c, "may_overflow": risk} for o, i, c in vl.subscripts(code, vl.types_of(code))]

    return per_text(df, ids, of, "object:string,index:string,class:string,may_overflow:boolean")
