"""HTML reports with inline SVG charts: no script, no outside files."""

from __future__ import annotations

import math
from html import escape

from pyspark.sql import DataFrame

WIDTH = 640


def bars(items: list[tuple[str, float]]) -> str:
    """Horizontal bars, one a line, with their values."""
    most = max((v for _, v in items), default=0) or 1
    rows = [
        f'<text x="0" y="{22 * k + 15}">{escape(str(n))}</text><rect x="220" y="{22 * k + 3}" width="{round(340 * v / most)}" height="15"/><text x="{228 + round(340 * v / most)}" y="{22 * k + 15}">{v:g}</text>'
        for k, (n, v) in enumerate(items)
    ]
    return f'<svg viewBox="0 0 {WIDTH} {22 * len(items) + 4}" class="bars">{"".join(rows)}</svg>'


def ring(items: list[tuple[str, float]]) -> str:
    """A ring of shares with a legend."""
    total = sum(v for _, v in items) or 1
    out, at = [], 0.0
    for k, (name, v) in enumerate(items):
        share = v / total
        out.append(f'<circle r="60" cx="90" cy="90" class="s{k % 8}" stroke-dasharray="{share * 377:.2f} 377" stroke-dashoffset="{-at * 377:.2f}"/><text x="190" y="{30 + 20 * k}">{escape(str(name))}: {v:g} ({share:.0%})</text>')
        at += share
    return f'<svg viewBox="0 0 {WIDTH} {max(180, 40 + 20 * len(items))}" class="ring">{"".join(out)}</svg>'


def radar(items: list[tuple[str, float]]) -> str:
    """One polygon over as many axes as there are items, scaled to the greatest."""
    most = max((v for _, v in items), default=0) or 1
    angle = [2 * math.pi * k / max(len(items), 1) - math.pi / 2 for k in range(len(items))]
    spot = lambda a, r: f"{150 + r * math.cos(a):.1f},{150 + r * math.sin(a):.1f}"
    axes = "".join(f'<line x1="150" y1="150" x2="{spot(a, 110).split(",")[0]}" y2="{spot(a, 110).split(",")[1]}"/><text x="{spot(a, 125).split(",")[0]}" y="{spot(a, 125).split(",")[1]}">{escape(str(n))}</text>' for a, (n, _) in zip(angle, items))
    return f'<svg viewBox="0 0 {WIDTH} 300" class="radar">{axes}<polygon points="{" ".join(spot(a, 110 * v / most) for a, (_, v) in zip(angle, items))}"/></svg>'


def line(points: list[tuple[str, float]]) -> str:
    """One line over its points, first to last."""
    low, high = min((v for _, v in points), default=0), max((v for _, v in points), default=1)
    step = 560 / max(len(points) - 1, 1)
    xy = [(40 + k * step, 160 - 130 * (v - low) / ((high - low) or 1)) for k, (_, v) in enumerate(points)]
    marks = "".join(f'<circle r="3" cx="{x:.1f}" cy="{y:.1f}"/><text x="{x:.1f}" y="178">{escape(str(n))}</text>' for (x, y), (n, _) in zip(xy, points))
    return f'<svg viewBox="0 0 {WIDTH} 190" class="line"><polyline points="{" ".join(f"{x:.1f},{y:.1f}" for x, y in xy)}"/>{marks}</svg>'


STYLE = (
    "body{font:15px sans-serif;max-width:60em;margin:2em auto;color:#222}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:.2em .6em;text-align:left}svg{width:100%;font-size:12px}rect,.line circle{fill:#3b6ea5}"
    "polyline,.radar line{fill:none;stroke:#3b6ea5}.radar polygon{fill:#3b6ea555;stroke:#3b6ea5}.ring circle{fill:none;stroke-width:30}"
) + "".join(f".s{k}{{stroke:{c}}}" for k, c in enumerate("#3b6ea5 #c2703d #5b9a5b #a05195 #8c8c3d #b94a5b #4aa3a3 #777777".split()))


def table(df: DataFrame, most: int | None = None) -> str:
    """A table of ``df``; with ``most`` only that many rows, and a line that says how many there are."""
    rows = (df if most is None else df.limit(most + 1)).collect()
    cut = most is not None and len(rows) > most
    head = "".join(f"<th>{escape(c)}</th>" for c in df.columns)
    body = "".join("<tr>" + "".join(f"<td>{escape('' if v is None else str(v))}</td>" for v in r) + "</tr>" for r in rows[:most])
    return f"<table><tr>{head}</tr>{body}</table>" + (f"<p>The first {most} of {df.count()} rows.</p>" if cut else "")


def page(title: str, sections: list[tuple[str, str]]) -> str:
    """A whole document; sections without content are left out."""
    body = "".join(f"<h2>{escape(name)}</h2>{content}" for name, content in sections if content)
    return f'<!doctype html><html lang="en"><meta charset="utf-8"><title>{escape(title)}</title><style>{STYLE}</style><h1>{escape(title)}</h1>{body}</html>'
