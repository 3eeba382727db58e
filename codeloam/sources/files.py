"""Source trees to rows: recursive scans with the directory, extension, size and count rules of a project walk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloam.functions import rules


def language_of(path: Column) -> Column:
    """Language by extension, the first that fits in the table's order; null for other files."""
    out = F.when(F.lit(False), "")
    for lang, exts in rules.EXTENSIONS.items():
        for e in exts:
            out = out.when(F.endswith(path, F.lit(e)), lang)
    return out


def in_skipped_dir(relative: Column, skipped: list[str] = rules.SKIPPED_DIRS) -> Column:
    parts = F.split(relative, "/")
    return F.arrays_overlap(F.slice(parts, 1, F.size(parts) - 1), F.array(*[F.lit(d) for d in skipped]))


def scan_project(spark: SparkSession, root: str, project: str | None = None, most_chars: int = rules.MOST_CHARS, most_files: int | None = rules.MOST_FILES, skipped: list[str] | None = None, glob: str | None = None) -> DataFrame:
    """(project, path, lang, n_bytes, code) of the source files below ``root``.

    Files in skipped directories, of other extensions, or longer than ``most_chars`` are left out; of the rest the first
    ``most_files`` by path count, a rule of the walk itself (None takes all). Undecodable bytes become replacement
    characters. The size filter and the pruned columns reach the file listing, so large files are never read.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(root).where(F.col("length") <= 4 * most_chars)
    base = root.rstrip("/")
    relative = F.regexp_replace(F.regexp_replace("path", r"^file:/+", "/"), "^" + base.replace("file:", "").replace(".", r"\.") + "/", "")
    df = files.select(F.lit(project or base.rsplit("/", 1)[-1]).alias("project"), relative.alias("path"), F.col("length").alias("n_bytes"), F.col("content"))
    df = df.withColumn("lang", language_of(F.col("path"))).where(F.col("lang").isNotNull() & ~in_skipped_dir(F.col("path"), skipped or rules.SKIPPED_DIRS))
    df = df.select("project", "path", "lang", "n_bytes", _decoded().alias("code")).where(F.length("code") <= most_chars)
    if most_files is None:
        return df
    return df.withColumn("n", F.row_number().over(Window.partitionBy("project").orderBy("path"))).where(F.col("n") <= most_files).drop("n")


def _decoded() -> Column:
    @F.pandas_udf("string")
    def text(content):  # replaces undecodable bytes, which the built-in refuses
        return content.map(lambda b: bytes(b).decode("utf-8", "replace"))

    return text("content")


def per_language(files: DataFrame, most: int = 200) -> DataFrame:
    """The first ``most`` files by path of each language of a project: the cap of the per-language walk."""
    return files.withColumn("n", F.row_number().over(Window.partitionBy("project", "lang").orderBy("path"))).where(F.col("n") <= most).drop("n")


def libraries(spark: SparkSession, path: str) -> DataFrame:
    """(lang, module, call, role) of library tables: JSON files of {language, libraries: {module: {call: role}}}."""
    raw = spark.read.text(path, wholetext=True).select(F.get_json_object("value", "$.language").alias("lang"), F.get_json_object("value", "$.libraries").alias("libs"))
    mods = raw.select("lang", F.explode(F.from_json("libs", "map<string,map<string,string>>")).alias("module", "calls"))
    return mods.select("lang", "module", F.explode("calls").alias("call", "role"))
