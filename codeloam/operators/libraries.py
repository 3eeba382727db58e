"""Calls of libraries by role: other names of modules resolved, roles joined, arguments that derive from inputs."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloam.functions import security as rules
from codeloam.operators import issues as iss
from codeloam.operators import values as vl
from codeloam.session import bounded

LEAST_DANGER = 0.6
# fixed values: weakness of a library role with a derived argument, and what makes the role safe
ROLE_WEAKNESS = {"NETWORK": "SSRF", "SQL": "SQL_INJECTION", "EXEC": "CMD_INJECTION", "FILE": "PATH_TRAVERSAL", "RENDER": "XSS", "DESERIALIZE": "DESERIALIZATION", "REDIRECT": "OPEN_REDIRECT", "LDAP": "LDAP_INJECTION", "TEMPLATE": "TEMPLATE_INJECTION", "XXE": "XXE", "CRYPTO_WEAK": "WEAK_CRYPTO", "SCRAPE": "SSRF"}
SAFE = {
    "EXEC": [r"subprocess\.run\s*\(\[", r"shlex\.quote", r"shell\s*=\s*False"],
    "NETWORK": [r"startswith\s*\(", r"is_internal", r"allowlist"],
    "FILE": [r"basename\s*\(", r"realpath\s*\("],
    "RENDER": [r"escape\s*\(", r"html\.escape"],
    "SQL": [r"\?\s*\)", r"%s\s*\)", r"execute\s*\([^)]*,"],
    "DESERIALIZE": [r"json\.loads", r"safe_load"],
}
_ALIASES = [
    re.compile(r"(\w+)\s*=\s*([a-zA-Z_]\w*)(?:\.[a-zA-Z_]\w*)+\s*\("),
    re.compile(r"(\w+)\s*=\s*([a-zA-Z_]\w*)\s*$", re.M),
    re.compile(r"(\w+)\s*=\s*([A-Z]\w*)\s*\("),
    re.compile(r"(?:const|let|var)\s+(\w+)\s*=\s*require\s*\(\s*['\"]([^'\"]+)['\"]"),
]
_DOTTED = re.compile(r"([a-zA-Z_]\w*(?:\.[a-zA-Z_]\w*)+)\s*\(")


def calls_in(code: str) -> list[dict]:
    """Dotted calls with their module, by its own name where another one was assigned, and whether an argument derives from an input."""
    names = {m[1]: m[2] for rx in _ALIASES for m in rx.finditer(code)}
    taint = None
    out = []
    for m in re.finditer(r"Runtime\.getRuntime\(\)\.(\w+)\s*\(", code):
        out.append({"call": f"Runtime.getRuntime().{m[1]}", "module": "java.lang", "name": m[1], "derived": True, "fixed_role": "EXEC"})
    for m in _DOTTED.finditer(code):
        module, _, name = m[1].rpartition(".")
        args = iss.first_arguments(code, m.end() - 1)
        taint = vl.tainted(code) if taint is None else taint
        derived = any(vl.holds(s, args, True) for s in rules.SOURCES) or any(vl.holds(v, args) for v in taint)
        out.append({"call": m[1], "module": names.get(module, module), "name": name, "derived": derived, "fixed_role": None})
    return out


def library_calls(texts: DataFrame, libraries: DataFrame) -> DataFrame:
    """(fn_id, lang, call, module, role, source, danger, derived): calls of dangerous roles, by (lang, source, module, call, role, danger).

    A module is looked up whole, then without its last parts; an entry without a call holds for every call of its
    module. The table of libraries is small and checked before it is sent to all executors; else it is joined.
    """
    found = iss.per_text(texts, ["fn_id", "lang"], calls_in, "call:string,module:string,name:string,derived:boolean,fixed_role:string")
    parts = F.split("module", r"\.")
    cuts = F.transform(F.sequence(F.size(parts), F.lit(1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))
    tried = found.distinct().select("*", F.posexplode(cuts).alias("depth", "prefix"))
    libs = libraries.select(F.col("lang").alias("l"), F.col("source"), F.col("module").alias("m"), F.col("call").alias("c"), F.col("role").alias("r"), F.col("danger").alias("g"))
    both = tried.join(bounded(libs), (F.col("lang") == F.col("l")) & (F.col("prefix") == F.col("m")) & ((F.col("name") == F.col("c")) | (F.col("c") == "")), "left")
    w = Window.partitionBy("fn_id", "call", "module", "derived").orderBy(F.col("r").isNull(), F.col("depth"), F.col("c") == "")
    best = both.withColumn("k", F.row_number().over(w)).where("k = 1")
    role = F.coalesce("fixed_role", "r")
    return best.select("fn_id", "lang", "call", "module", role.alias("role"), "source", F.when(F.col("fixed_role").isNotNull(), 1.0).otherwise(F.col("g")).alias("danger"), "derived").where(F.col("danger") >= LEAST_DANGER)


def library_weaknesses(texts: DataFrame, libraries: DataFrame) -> DataFrame:
    """(fn_id, call, module, role, weakness): library calls with a derived argument and nothing safe for the role in the
    text; weak cryptography counts with any argument."""
    safe = F.create_map(*[c for k, ps in SAFE.items() for c in (F.lit(k), F.col("code").rlike("(?i)" + "|".join(ps)))])
    guards = texts.select("fn_id", safe.alias("safe"))
    weak = F.create_map(*[F.lit(x) for kv in ROLE_WEAKNESS.items() for x in kv])
    found = library_calls(texts, libraries).join(guards, "fn_id").withColumn("weakness", weak[F.col("role")])
    counts = (F.col("derived") & ~F.coalesce(F.try_element_at("safe", "role"), F.lit(False))) | (F.col("role") == "CRYPTO_WEAK")
    return found.where(counts & F.col("weakness").isNotNull()).select("fn_id", "call", "module", "role", "weakness").distinct()


def planted(spark: SparkSession) -> DataFrame:
    """Hand-written texts with library calls; the invented tables hold none."""
    rows = [
        (-101, "python", "def load(blob):\n    return pickle.loads(blob)\n"),
        (-102, "python", "def get(address):\n    return requests.get(address)\n"),
        (-103, "python", "def find(name):\n    db = sqlite3.connect('a')\n    return db.execute('SELECT ' + name)\n"),
        (-104, "python", "def fixed():\n    return math.floor(3.5)\n"),
    ]
    return spark.createDataFrame(rows, "fn_id bigint, lang string, code string")


def planted_libraries(spark: SparkSession) -> DataFrame:
    """A small table of libraries; ``sources.files.libraries`` reads a whole one."""
    rows = [
        ("python", "stdlib", "pickle", "loads", "DESERIALIZE", 0.9),
        ("python", "stdlib", "sqlite3", "execute", "SQL", 0.9),
        ("python", "stdlib", "math", "", "COMPUTE", 0.1),
        ("python", "third_party", "requests", "get", "NETWORK", 0.7),
    ]
    return spark.createDataFrame(rows, "lang string, source string, module string, call string, role string, danger double")
