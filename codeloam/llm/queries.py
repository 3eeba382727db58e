"""Registered queries of the training-data operators: name -> callable, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloam.llm import clusters, handwritten, knn, leaks, neardup, packing, pii, syntax
from codeloam.llm.vectors import last_vectors
from codeloam.session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


#: Valid rows of the last delivery, shared by the SQL of the vector queries: v(f, id, d, x) with unit x by field.
LAST_VECTORS_SQL = """
    r AS (SELECT regexp_replace(trim(target, E' \\t\\r\\n'), '^\\./', '') AS target, loaded_at, snapshot_id, enriched, composite
      FROM shape_snapshot WHERE target IS NOT NULL AND delivery_no = (SELECT max(delivery_no) FROM shape_snapshot)),
    u AS (SELECT DISTINCT ON (target) * FROM r ORDER BY target, loaded_at DESC NULLS LAST, snapshot_id DESC),
    e AS (SELECT 'enriched' AS f, snapshot_id AS id, unnest(map_entries(enriched)) AS e FROM u
      UNION ALL SELECT 'composite', snapshot_id, unnest(map_entries(composite)) FROM u),
    w AS (SELECT f, id, e.key AS d, round(e.value, 4) AS x FROM e WHERE round(e.value, 4) <> 0),
    v AS (SELECT f, id, d, x / sqrt(sum(x * x) OVER (PARTITION BY f, id)) AS x FROM w)"""


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


@query(
    "p8_found",
    """
    WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents WHERE text IS NOT NULL),
    i AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM eval_item WHERE text IS NOT NULL),
    dw AS (SELECT doc_id, array_to_string(w[p : p + 9], ' ') AS run FROM (SELECT doc_id, w, unnest(range(1, len(w) - 8)) AS p FROM d WHERE len(w) >= 10)),
    iw AS (SELECT DISTINCT item_id, array_to_string(w[p : p + 9], ' ') AS run FROM (SELECT item_id, w, unnest(range(1, len(w) - 8)) AS p FROM i WHERE len(w) >= 10))
    SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (run)
    """,
)
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share at least 10 consecutive words with an item."""
    return leaks.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_item")).where("shared_runs > 0").select("doc_id", "item_id").distinct()


@query("p8_leaks")
def p8_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every leak with its extent: shared and near windows, longest common run, weighted-shingle similarity."""
    return leaks.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_item")).where("shared_runs > 0 or similarity >= 0.8")


@query("p9_found")
def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every occurrence of personal information by source offset."""
    found = pii.mask_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "known_name"), with_text=False)
    return found.select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.begin_at", "s.pii_kind")


@query("p9_masked")
def p9_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text with typed placeholders."""
    done = pii.mask_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "known_name"))
    return done.select("doc_id", "masked", F.size("spans").alias("occurrences"))


@query("p7_containers")
def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every document, or piece of one longer than the capacity, for each capacity."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_capacity"))


@query("p7_fill")
def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per capacity: containers used, the least that any packing needs, and the share of their room that is filled."""
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_capacity"))
    boxes = packed.groupBy("capacity_id", "container_id").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_pieces"))
    caps = table(spark, sf_dir, "pack_capacity").select("capacity_id", "max_tokens")
    per = boxes.groupBy("capacity_id").agg(F.count("*").alias("containers"), F.sum("n_tokens").alias("tokens"), F.sum("n_pieces").alias("pieces"))
    return per.join(caps, "capacity_id").select("capacity_id", "containers", F.ceil(F.col("tokens") / F.col("max_tokens")).alias("least_containers"), "pieces", "tokens", F.round(F.col("tokens") / (F.col("containers") * F.col("max_tokens")), 6).alias("filled"))


@query(
    "p6_found",
    r"""
    WITH f AS (SELECT DISTINCT fn_id, full_code FROM universal_function WHERE fn_id IS NOT NULL AND full_code IS NOT NULL),
    t AS (SELECT fn_id, regexp_extract_all(full_code, '[A-Za-z_][A-Za-z0-9_]*|[0-9]+|[^\s]') AS w FROM f),
    s AS (SELECT DISTINCT fn_id, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS x FROM (SELECT fn_id, w, unnest(range(1, len(w) - 1)) AS p FROM t WHERE len(w) >= 3)),
    n AS (SELECT fn_id, count(*) AS n FROM s GROUP BY fn_id),
    shared AS (SELECT a.fn_id AS a, b.fn_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.fn_id < b.fn_id GROUP BY ALL)
    SELECT a AS fn_id_a, b AS fn_id_b FROM shared JOIN n na ON na.fn_id = a JOIN n nb ON nb.fn_id = b WHERE c * 5 >= 3 * (na.n + nb.n - c)
    """,
)
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of functions whose code has similarity of at least 0.6."""
    members, links = neardup.near_duplicates(table(spark, sf_dir, "universal_function"), "fn_id", "full_code")
    return neardup.pairs_of(members, links).select(F.col("a").alias("fn_id_a"), F.col("b").alias("fn_id_b"))


@query("p6_groups")
def p6_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per function: its class of equal shingle sets, the class's links and the group they form, by body."""
    members, links = neardup.near_duplicates(table(spark, sf_dir, "universal_function"), "fn_id", "body")
    return neardup.groups_of(members, links).withColumnRenamed("id", "fn_id")


@query(
    "p3_found",
    f"""
    WITH {LAST_VECTORS_SQL},
    i AS (SELECT DISTINCT f, id FROM v),
    c AS (SELECT a.f, a.id AS a, b.id AS b, round(sum(a.x * b.x), 9) AS c FROM v a JOIN v b ON a.f = b.f AND a.d = b.d AND a.id <> b.id GROUP BY ALL),
    p AS (SELECT a.f, a.id AS a, b.id AS b, coalesce(c.c, 0) AS c FROM i a JOIN i b ON a.f = b.f AND a.id <> b.id LEFT JOIN c ON c.f = a.f AND c.a = a.id AND c.b = b.id),
    k AS (SELECT a, b FROM p QUALIFY row_number() OVER (PARTITION BY f, a ORDER BY c DESC, b) <= 5)
    SELECT DISTINCT least(a, b) AS snapshot_id_a, greatest(a, b) AS snapshot_id_b FROM k
    """,
)
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of vectors of the last delivery where one is among the 5 most similar to the other, by field."""
    near = None
    for field in ("enriched", "composite"):
        part = knn.most_similar(last_vectors(table(spark, sf_dir, "shape_snapshot"), field), 5)
        near = part if near is None else near.union(part)
    pairs = near.select("id", F.explode("neighbours.id").alias("other"))
    return pairs.select(F.least("id", "other").alias("snapshot_id_a"), F.greatest("id", "other").alias("snapshot_id_b")).distinct()


@query("p3_neighbours")
def p3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 most similar files, with cosine and rank, of every file whose id is divisible by 50."""
    vectors = last_vectors(table(spark, sf_dir, "shape_snapshot"), "enriched")
    near = knn.most_similar(vectors, 10, vectors.where("id % 50 = 0"))
    return near.select("id", F.posexplode("neighbours").alias("rank", "n")).select(F.col("id").alias("snapshot_id"), (F.col("rank") + 1).alias("rank"), F.col("n.id").alias("other_id"), "n.cosine")


@query(
    "p5_found",
    f"""
    WITH RECURSIVE {LAST_VECTORS_SQL},
    l AS (SELECT a.id AS a, b.id AS b FROM v a JOIN v b ON a.f = b.f AND a.d = b.d AND a.id <> b.id WHERE a.f = 'enriched' GROUP BY ALL HAVING round(sum(a.x * b.x), 9) >= 0.9),
    c(id, low) AS (SELECT a, least(a, min(b)) FROM l GROUP BY a UNION SELECT l.b, c.low FROM c JOIN l ON l.a = c.id)
    SELECT min(low) AS cluster_id, id AS snapshot_id FROM c GROUP BY id
    """,
)
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of clusters joined by chains of pairs with cosine of at least 0.9."""
    found = clusters.chain_clusters(last_vectors(table(spark, sf_dir, "shape_snapshot"), "enriched"), 0.9)
    return found.select("cluster_id", F.col("id").alias("snapshot_id"))


@query("p5_clusters")
def p5_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ward clusters of the last delivery with size and most typical members."""
    return clusters.ward_clusters(last_vectors(table(spark, sf_dir, "shape_snapshot"), "enriched"))


@query("p2_found")
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that are generated, minified, vendored or data."""
    return handwritten.not_by_hand(table(spark, sf_dir, "function_unit")).select("project", "file")


@query("p2_kinds")
def p2_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same files with their kind and the evidence for it."""
    return handwritten.not_by_hand(table(spark, sf_dir, "function_unit"))


@query("p4_found")
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions that are not valid in their language: those whose least syntax repair has a cost."""
    return syntax.broken_functions(table(spark, sf_dir, "universal_function"))


@query("p4_repairs")
def p4_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the repair of each broken function tells: cost, kind and first line edited."""
    return syntax.syntax_repairs(table(spark, sf_dir, "universal_function")).where(syntax.broken()).distinct()


@query("p4_rates")
def p4_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of broken functions per project and language."""
    return syntax.error_rates(table(spark, sf_dir, "universal_function"))
