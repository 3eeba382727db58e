"""Text sinks over one collected row or a short list: markdown, mermaid, console."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row

MOST_LINES = 50


def markdown(title: str, sections: dict[str, DataFrame]) -> str:
    """A document with one table per section; of a longer one the first MOST_LINES rows and their number; empty sections are left out."""
    out = [f"# {title}", ""]
    for name, df in sections.items():
        rows = df.limit(MOST_LINES + 1).collect()
        if rows:
            out += [f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
            out += ["| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in r) + " |" for r in rows[:MOST_LINES]]
            if len(rows) > MOST_LINES:
                out += ["", f"The first {MOST_LINES} of {df.count()} rows."]
            out.append("")
    return "\n".join(out)


def mermaid(edges: DataFrame, label: str = "calls") -> str:
    """A flow chart of edges (src, dst); of more than MOST_LINES the first ones, and a comment with their number."""
    names: dict[str, str] = {}
    out = ["flowchart LR"]
    every = edges.select("src", "dst").distinct()
    rows = every.orderBy("src", "dst").limit(MOST_LINES + 1).collect()
    if len(rows) > MOST_LINES:
        out.append(f"  %% the first {MOST_LINES} of {every.count()} edges")
    for r in rows[:MOST_LINES]:
        for n in (r.src, r.dst):
            if n not in names:
                names[n] = f"n{len(names)}"
                text = str(n).replace('"', "'")
                out.append(f'  {names[n]}["{text}"]')
        out.append(f"  {names[r.src]} -->|{label}| {names[r.dst]}")
    return "\n".join(out)


def posture_text(facets: list[Row], grade: str) -> str:
    """Console report of a posture (facet, name, findings, risk)."""
    every = next((r for r in facets if r.facet == "all"), None)
    if every is None or not every.findings:
        return "CLEAN: no findings."
    pick = lambda f: sorted((r for r in facets if r.facet == f and r.name is not None), key=lambda r: (-r.findings, r.name))
    lines = [f"Security posture: grade {grade} (risk {every.risk})", f"  {every.findings} findings across {len(pick('file'))} files"]
    lines.append("  by severity: " + ", ".join(f"{r.name}={r.findings}" for r in pick("severity")))
    lines.append("  by type: " + ", ".join(f"{r.name} ({r.findings})" for r in pick("kind")[:8]))
    return "\n".join(lines)
