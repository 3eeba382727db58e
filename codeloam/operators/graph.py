"""Call, import and plain graphs as edge tables: resolution, degrees, cycles, reachability, ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloam.session import cut, without_repeats

SPAN_BITS = 6  # lines of a bucket of the range join: 64


def units_of(table: DataFrame) -> DataFrame:
    """Distinct units with what the graph operators read."""
    return without_repeats(table.select("unit_id", "project", "file", "name", "params", "call_sites", "body"), "unit_id")


def calls(units: DataFrame) -> DataFrame:
    """(project, file, caller, callee, n_args, line) of every call site."""
    return units.select("project", "file", F.col("name").alias("caller"), F.explode("call_sites").alias("c")).select("project", "file", "caller", "c.callee", F.size("c.args").alias("n_args"), "c.line", "c.args")


def definitions(units: DataFrame) -> DataFrame:
    """(project, name, file, arity): one definition per name of a project, the last file by name holding."""
    defs = units.where("name is not null and name <> '<module>'").select("project", "name", F.struct("file", "unit_id").alias("o"), F.size("params").alias("arity"), "file")
    return defs.groupBy("project", "name").agg(F.max_by(F.struct("file", "arity"), "o").alias("d")).select("project", "name", "d.file", "d.arity")


def resolved(units: DataFrame) -> DataFrame:
    """Calls with the file and arity of their callee in the project, by full name or else its last dotted part."""
    defs = definitions(units)
    full = defs.select("project", F.col("name").alias("callee"), F.col("file").alias("f1"), F.col("arity").alias("a1"))
    last = defs.select("project", F.col("name").alias("last"), F.col("file").alias("f2"), F.col("arity").alias("a2"))
    c = calls(units).withColumn("last", F.substring_index("callee", ".", -1))
    return c.join(full, ["project", "callee"], "left").join(last, ["project", "last"], "left").select("project", "file", "caller", "callee", "n_args", "line", F.coalesce("f1", "f2").alias("to_file"), F.when(F.col("f1").isNotNull(), F.col("a1")).otherwise(F.col("a2")).alias("arity"))


def arity_mismatches(units: DataFrame) -> DataFrame:
    return resolved(units).where("arity is not null and arity >= 0 and n_args <> arity and callee <> caller")


def missing_callees(units: DataFrame) -> DataFrame:
    """Called names that their project defines nowhere, with the number of calls."""
    return calls(units).join(definitions(units).select("project", F.col("name").alias("callee")), ["project", "callee"], "left_anti").groupBy("project", "callee").agg(F.count("*").alias("calls"))


def unused_functions(units: DataFrame) -> DataFrame:
    """Defined names that no unit of the project calls."""
    return definitions(units).where("name not in ('main', 'Main')").join(calls(units).select("project", F.col("callee").alias("name")), ["project", "name"], "left_anti").select("project", "name", "file")


def degrees(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Edges, nodes and greatest fan-in and fan-out per key over distinct edges (keys, src, dst)."""
    e = edges.select(*keys, "src", "dst").distinct()
    sides = F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into"))))
    nodes = e.select(*keys, sides.alias("s")).groupBy(*keys, "s.node").agg(F.sum("s.out").alias("out"), F.sum("s.into").alias("into"))
    return nodes.groupBy(*keys).agg(F.sum("out").alias("edges"), F.count("*").alias("nodes"), F.max("into").alias("max_fan_in"), F.max("out").alias("max_fan_out"))


def two_cycles(edges: DataFrame) -> DataFrame:
    """One row: self-loops, plus each direction of a mutual pair, over distinct edges."""
    e = edges.select("src", "dst").distinct()
    both = e.alias("a").join(e.alias("b"), (F.col("a.src") == F.col("b.dst")) & (F.col("a.dst") == F.col("b.src"))).select("a.src", "a.dst")
    return both.agg(F.count("*").alias("cycles"))


def hops(edges: DataFrame, seeds: DataFrame, most: int) -> DataFrame:
    """(node, hops): nodes reachable from ``seeds`` (node) within ``most`` steps, with the fewest steps.

    A step joins the frontier with the edges and drops what was reached before; frontiers are cut from their lineage.
    """
    e = edges.select("src", "dst").where("src is not null and dst is not null").distinct()
    reached = cut(seeds.select("node").where("node is not null").distinct().withColumn("hops", F.lit(0)))
    front = reached
    for k in range(1, most + 1):
        front = cut(front.select(F.col("node").alias("src")).join(e, "src").select(F.col("dst").alias("node")).distinct().join(reached, "node", "left_anti").withColumn("hops", F.lit(k)))
        if front.isEmpty():
            break
        reached = cut(reached.union(front))
    return reached


def is_acyclic(edges: DataFrame) -> bool:
    """Peels nodes without incoming edges until none is left, or none can go; every round but the last drops some."""
    e = cut(edges.select("src", "dst").where("src <> dst").distinct())
    if edges.where("src = dst").limit(1).count():
        return False
    while True:
        left = cut(e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi"))
        a, b = left.count(), e.count()
        if a == 0:
            return True
        if a == b:
            return False
        e = left


def enclosing(points: DataFrame, spans: DataFrame, keys: list[str], point_id: str) -> DataFrame:
    """Each point (keys, point_id, line) with the narrowest span (keys, name, start_line, end_line) around it, if any.

    Spans are cut into buckets of lines, which makes the range join an equal join on keys and bucket; of equal widths the
    later start, then the lesser name holds.
    """
    s = spans.where("start_line <= end_line").withColumn("bucket", F.explode(F.sequence(F.shiftright("start_line", SPAN_BITS), F.shiftright("end_line", SPAN_BITS))))
    p = points.withColumn("bucket", F.shiftright("line", SPAN_BITS))
    both = p.join(s, [*keys, "bucket"]).where("line between start_line and end_line")
    best = F.min(F.struct((F.col("end_line") - F.col("start_line")).alias("width"), (-F.col("start_line")).alias("back"), F.col("name").alias("name")))
    return both.groupBy(point_id).agg(best.alias("b")).select(point_id, F.col("b.name").alias("function"), F.col("b.width").alias("width"))


# fixed values: import statements by language
IMPORTS = {
    "python": r"(?m)^\s*(?:import|from)\s+([\w.]+)",
    "javascript": r"(?:require\(\s*|from\s+|import\s+)['\"]([^'\"]+)['\"]",
    "java": r"(?m)^\s*import\s+(?:static\s+)?([\w.]+)",
    "go": r"(?m)^\s*import\s+\"([^\"]+)\"",
    "c": r"(?m)^\s*#\s*include\s*[<\"]([^>\"]+)[>\"]",
}


def language_of_path(file: Column) -> Column:
    ext = F.lower(F.regexp_extract(file, r"\.(\w+)$", 1))
    return F.create_map(*[F.lit(x) for kv in {"py": "python", "js": "javascript", "java": "java", "go": "go", "c": "c", "h": "c"}.items() for x in kv])[ext]


def imports(units: DataFrame) -> DataFrame:
    """(project, file, lang, module): distinct modules that a file's top-level text imports."""
    mods = F.when(F.lit(False), F.array().cast("array<string>"))
    for lang, pattern in IMPORTS.items():
        mods = mods.when(F.col("lang") == lang, F.regexp_extract_all("body", F.lit(pattern), F.lit(1)))
    top = units.where("name = '<module>' and body is not null").withColumn("lang", language_of_path(F.col("file")))
    return top.select("project", "file", "lang", F.explode(mods).alias("module")).distinct()


def next_in_group(df: DataFrame, keys: list[str], order: str, cols: list[str]) -> DataFrame:
    """Each row with columns of the next row of its group, under names with a 2; ``order`` tells rows apart.

    Only keys and ``order`` are sorted, so a group of a third of all rows moves ids; what the rows hold joins by id.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    ids = df.select(*keys, order).withColumn("_next", F.lead(order).over(w)).where("_next is not null").select(F.col(order).alias("_this"), "_next")
    right = df.select(F.col(order).alias("_other"), *[F.col(c).alias(f"{c}2") for c in cols])
    return df.join(ids, F.col(order) == F.col("_this")).join(right, F.col("_next") == F.col("_other")).drop("_this", "_next", "_other")
