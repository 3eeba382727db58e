import pytest

from codeloam.operators import enriched as en
from codeloam.plans.register import register


def test_enriched_is_of_unit_length(spark):
    fns = spark.createDataFrame([(1, "python", "def plus(a, b):\n    return a + b"), (2, "python", "def plus(x, y):\n    return x + y"), (3, None, "")], "fn_id bigint, lang string, code string")
    types = spark.createDataFrame([(1, 0, "a", "INT"), (1, 1, "b", "INT"), (2, 0, "x", "INT"), (2, 1, "y", "INT"), (9, 0, "q", "INT")], "fn_id bigint, pos int, name string, bucket string")
    got = {}
    for r in en.enriched(fns, types).collect():
        got.setdefault(r.fn_id, {})[r.dim] = r.value
    assert set(got) == {1, 2} and sum(v * v for v in got[1].values()) == pytest.approx(1, abs=2e-3)
    assert "PARAM:a:INT" in got[1] and "VAL:SHAPE_ENTROPY" in got[1] and got[1]["PRIM:RETURN"] > 0
    renamed = lambda v: {k: x for k, x in v.items() if not k.startswith("PARAM:")}
    assert renamed(got[1]) == renamed(got[2])


def test_greedy_clusters(spark, monkeypatch):
    vec = spark.createDataFrame([("a", "x", 1.0), ("b", "x", 2.0), ("c", "y", 1.0), ("d", "y", 1.0), ("d", "x", 0.2)], "id string, dim string, value double")
    assert en.greedy_clusters(vec, 0.6) == [["a", "b"], ["c", "d"]]
    monkeypatch.setattr(en, "MOST_ITEMS", 3)
    with pytest.raises(ValueError):
        en.greedy_clusters(vec)


def test_similar_projects(spark):
    v = spark.createDataFrame([("p", "x", 1.0), ("q", "x", 0.6), ("q", "y", 0.8), ("r", "y", 1.0)], "project string, dim string, value double")
    assert {(r.asked, r.project, r.cosine) for r in en.similar_projects(v, spark.createDataFrame([("p",)], "project string")).collect()} == {("p", "q", 0.6)}


def test_similar_projects_asks_all(spark, monkeypatch):
    from codeloam.plans import parsed

    v = spark.createDataFrame([("p", "x", 1.0), ("q", "x", 0.6), ("q", "y", 0.8), ("r", "y", 1.0)], "project string, dim string, value double")
    functions = spark.createDataFrame([(1, "p"), (2, "p"), (3, "q"), (4, "r")], "fn_id bigint, project string")
    monkeypatch.setattr(parsed.pr, "project_composite", lambda *_: v)
    monkeypatch.setattr(parsed, "_fns", lambda *_: functions)
    got = {(r.asked, r.project, r.cosine) for r in parsed.similar_projects(spark, "").collect()}
    assert got == {("p", "q", 0.6), ("q", "p", 0.6), ("q", "r", 0.8), ("r", "q", 0.8)}


def test_sql_names(spark, tmp_path):
    spark.createDataFrame([(1, "python", "def f(a):\n    return a\ndef g(): pass")], "id int, lang string, code string").write.parquet(str(tmp_path / "t"))
    register(spark, {"snippets": str(tmp_path / "t")})
    rows = spark.sql("SELECT s.id, f.name, size(f.params) n FROM snippets s, LATERAL functions_in(s.code, s.lang) f").collect()
    assert {(r.id, r["name"], r.n) for r in rows} == {(1, "f", 1), (1, "g", 0)}
    assert spark.sql("SELECT structural_signature(code) s, tree_similarity(code, code) x FROM snippets").first()[:] == ("ROOT(DEF(RETURN),DEF)", 1.0)
    assert spark.sql("SELECT count(*) FROM dim_weakness WHERE kind = 'XSS' AND side = 'sink'").first()[0] == 3 and spark.table("dim_primitive").count() == 23
