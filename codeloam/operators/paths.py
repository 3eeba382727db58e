"""Ways of values inside functions, closed in the batch that extracts the edges: in-to-out paths, reach, directions, signatures."""

from __future__ import annotations

import ast
from collections import Counter, defaultdict, deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloam.operators import dataflow as flow
from codeloam.operators import detect as dt

MOST = 15  # hops of a path

# fixed values: parts of a callee's name that make it a sink, and of a source's that make it an outside input
SINK_PARTS = ("execute", "query", "system", "eval", "open", "read", "write", "post", "get")
INPUT_PARTS = ("request", "req", "ctx", "environ", "argv", "input")


def edges_in(code: str | None, lang: str | None) -> Iterator[tuple[str, list[str], list[tuple[str, str, str, int]]]]:
    """(function, parameters, distinct edges in order) of every function of a text."""
    for name, params, first, _, _, body in flow.functions_in(code, lang):
        found = flow._python_edges(body) if isinstance(body, ast.AST) else flow._line_edges(body, first)
        yield name, params, sorted(set(found), key=lambda e: (e[3], e[0], e[1], e[2]))


def sources_of(params: list[str], edges: list[tuple]) -> list[tuple[str, str]]:
    """(name, kind): parameters and names read from outside; without either, names that nothing flows into."""
    out = [(p, "param") for p in params]
    for src, dst, *_ in edges:
        if dst not in params and dst != "return" and not dst.startswith("call:") and any(w in src.lower() for w in INPUT_PARTS):
            out.append((dst, "external_input"))
    if not out:
        into = {e[1] for e in edges}
        out = [(e[0], "variable") for e in edges if e[0] not in into and not e[0].startswith("call:")]
    return list(dict.fromkeys(out))


def _token(dst: str) -> tuple[str, str]:
    if dst == "return":
        return "return", "OUT:RETURN"
    if dst.startswith("call:"):
        kind = "sink" if any(w in dst.lower() for w in SINK_PARTS) else "call"
        return kind, f"OUT:{kind.upper()}[{dst[5:]}]"
    return "assign", f"FLOW:ASSIGN[{dst}]"


def paths_in(params: list[str], edges: list[tuple]) -> Iterator[dict]:
    """Every way from a source to a call or the return, or to where a value ends, of at most MOST hops and without a
    name twice; ways of the same source, end and steps count once."""
    after = defaultdict(list)
    for src, dst, _, line in edges:
        after[src].append((dst, line))
    seen = set()
    for name, kind in sources_of(params, edges):
        todo = [(name, [(name, 0, f"IN:{kind.upper()}[{name}]")])]
        while todo:
            node, hops = todo.pop()
            ends = node == "return" or node.startswith("call:")
            if ends or not after[node]:
                steps = [h[2] for h in hops]
                if len(hops) > 1 and (name, node, *steps) not in seen:
                    seen.add((name, node, *steps))
                    yield {"source": name, "source_kind": kind, "sink": node, "sink_kind": _token(node)[0], "line": hops[-1][1], "lines": [h[1] for h in hops], "steps": steps}
            elif len(hops) < MOST:
                on = {h[0] for h in hops}
                todo += [(dst, [*hops, (dst, line, _token(dst)[1])]) for dst, line in dict.fromkeys(after[node]) if dst not in on]


def reach_in(params: list[str], edges: list[tuple], most: int = MOST) -> dict[str, int]:
    """node -> fewest moves of a parameter's value to it, counted from the parameter, which is one move in."""
    after = defaultdict(set)
    for src, dst, *_ in edges:
        after[src].add(dst)
    got = {p: 1 for p in params}
    todo = deque(params)
    while todo:
        x = todo.popleft()
        if got[x] < most:
            for y in after[x]:
                if y not in got:
                    got[y] = got[x] + 1
                    todo.append(y)
    return got


def _rows(fns: DataFrame, of, fields: str) -> DataFrame:
    """(fn_id, function, fields): what ``of(params, edges)`` yields for every function of every text; no shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [[{"function": f, **x} for f, params, edges in edges_in(c, lang) for x in of(params, edges)] for lang, c in zip(pdf["lang"], pdf["code"])]
            yield pd.DataFrame({"fn_id": pdf["fn_id"], "found": found})

    return fns.select("fn_id", "lang", "code").mapInPandas(run, f"fn_id bigint, found array<struct<function:string,{fields}>>").select("fn_id", F.explode("found").alias("f")).select("fn_id", "f.*")


def in_out_paths(fns: DataFrame) -> DataFrame:
    """(fn_id, function, source, source_kind, sink, sink_kind, line, lines, steps) of every path; see ``paths_in``."""
    return _rows(fns, paths_in, "source:string,source_kind:string,sink:string,sink_kind:string,line:int,lines:array<int>,steps:array<string>").distinct()


def with_issues(paths: DataFrame, found: DataFrame) -> DataFrame:
    """``paths`` with the weakness of the first hop that stands on a line with a finding (fn_id, line, weakness, severity);
    of several findings on a line the last by weakness holds. Found lines are few per text and meet the hops by id."""
    at = found.groupBy("fn_id", "line").agg(F.max(F.struct("weakness", "cwe", "severity")).alias("x")).groupBy("fn_id").agg(F.map_from_entries(F.collect_list(F.struct("line", "x"))).alias("at"))
    both = paths.join(at, "fn_id", "left")
    first = F.get(F.filter(F.transform("lines", lambda n: F.try_element_at("at", n)), lambda x: x.isNotNull()), F.lit(0))
    return both.withColumn("x", first).select(*paths.columns, F.col("x").isNotNull().alias("is_vulnerable"), "x.weakness", "x.cwe", "x.severity")


def reach_of_params(fns: DataFrame, most: int = MOST) -> DataFrame:
    """(fn_id, function, node, hops): what values of parameters reach within ``most`` moves; of functions of one name
    in a text the fewest."""
    got = _rows(fns, lambda params, edges: [{"node": n, "hops": h} for n, h in reach_in(params, edges, most).items()], "node:string,hops:int")
    return got.groupBy("fn_id", "function", "node").agg(F.min("hops").alias("hops"))


def sinks_reached(fns: DataFrame, most: int = MOST) -> DataFrame:
    """(fn_id, function, sink, role, hops): calls of a dangerous role that values of parameters reach."""
    calls = reach_of_params(fns, most).where("node like 'call:%'").withColumn("sink", F.substring("node", 6, 1000))
    return calls.withColumn("role", dt.role_of(dt.name_words(F.substring_index("sink", ".", -1)))).where("role is not null").select("fn_id", "function", "sink", "role", "hops")


def return_paths(fns: DataFrame, most: int = MOST) -> DataFrame:
    """(fn_id, function, hops): the shortest way of a parameter's value to the function's return."""
    return reach_of_params(fns, most).where("node = 'return'").select("fn_id", "function", "hops")


DIRECTIONS = ["PARAM_TO_LOCAL", "LOCAL_TO_CALL", "PARAM_TO_CALL", "LOCAL_TO_RETURN", "PARAM_TO_RETURN", "PASSTHROUGH"]


def directions_in(params: list[str], edges: list[tuple]) -> dict[str, int]:
    """Edges by the class of their ends; a parameter returned without going into a local name passes through."""
    ps = set(params)
    local = {n for e in edges for n in e[:2] if n not in ps and n != "return" and not n.startswith("call:")}
    out = Counter({d: 0 for d in DIRECTIONS})
    for src, dst, kind, _ in edges:
        side = "PARAM" if src in ps else "LOCAL" if src in local else None
        if kind == "assign" and side == "PARAM" and dst in local:
            out["PARAM_TO_LOCAL"] += 1
        elif side and kind in ("argument", "return"):
            out[f"{side}_TO_{'CALL' if kind == 'argument' else 'RETURN'}"] += 1
    kept = {e[0] for e in edges if e[0] in ps and e[1] in local}
    out["PASSTHROUGH"] = sum(e[2] == "return" and e[0] in ps - kept for e in edges)
    return out


def flow_directions(fns: DataFrame) -> DataFrame:
    """(fn_id, function, one column per direction)."""
    of = lambda params, edges: [{d.lower(): n for d, n in directions_in(params, edges).items()}]
    return _rows(fns, of, ",".join(f"{d.lower()}:int" for d in DIRECTIONS))


def intensity_in(params: list[str], edges: list[tuple]) -> dict[str, float]:
    """Density of edges, greatest fan-in and fan-out, share of parameters that flow, moves before the return."""
    into, out = Counter(e[1] for e in edges), Counter(e[0] for e in edges)
    names = set(into) | set(out) | set(params)
    back = defaultdict(set)
    for src, dst, *_ in edges:
        back[dst].add(src)
    depth, front, seen = 0, back["return"], set()
    while front:
        depth, seen = depth + 1, seen | front
        front = {x for v in front for x in back[v]} - seen
    return {"edge_density": round(len(edges) / max(len(names), 1), 3), "max_fan_in": max(into.values(), default=0), "max_fan_out": max(out.values(), default=0), "param_use": round(sum(p in out for p in params) / max(len(params), 1), 3), "return_depth": depth}


def flow_intensities(fns: DataFrame) -> DataFrame:
    """(fn_id, function, edge_density, max_fan_in, max_fan_out, param_use, return_depth)."""
    return _rows(fns, lambda p, e: [intensity_in(p, e)], "edge_density:double,max_fan_in:int,max_fan_out:int,param_use:double,return_depth:int")


def signature_in(params: list[str], edges: list[tuple]) -> list[dict]:
    """What a function's flow looks like without its names: numbers of names, edges and edges by kind."""
    names = {n for e in edges for n in e[:2] if n != "return" and not n.startswith("call:")} | set(params)
    kinds = Counter(e[2] for e in edges)
    return [{"signature": f"{len(names)}|{len(edges)}|" + ",".join(f"{k}={n}" for k, n in sorted(kinds.items()))}]


def flow_signatures(fns: DataFrame) -> DataFrame:
    """(fn_id, signatures): the sorted flow signatures of a text's functions; texts with equal arrays flow alike."""
    return _rows(fns, signature_in, "signature:string").groupBy("fn_id").agg(F.array_sort(F.collect_list("signature")).alias("signatures"))


def signature_similarity(a, b):
    """Share of positions at which two sorted signature arrays agree; 0 where their numbers differ."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x))
    return F.when(F.size(a) == F.size(b), F.when(F.size(a) == 0, 1.0).otherwise(same / F.size(a))).otherwise(0.0)
