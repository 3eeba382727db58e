import json

from codeloam import api
from codeloam.plans import html, reports


def test_arguments(tmp_path):
    f = tmp_path / "a.py"
    f.write_text("x = 1\n")
    assert api.file_of(str(f)) == f and api.text_of(str(f)) == "x = 1\n"
    assert api.file_of("x = 1\ny = 2") is None and api.text_of("x = 1") == "x = 1" and api.file_of("a" * 5000) is None


def test_snippet(spark):
    c = api.Codeloam(spark)
    s = c.snippet("def f(a, b):\n    return eval(a + b)", "python")
    assert c.shape(s).first().shape == "ARITH_ADD>RETURN" and [r.weakness for r in c.findings(s).collect()] == ["EVAL_USE"]
    assert [r["name"] for r in c.functions(s).collect()] == ["f"] and c.paths(s).where("is_vulnerable").count() > 0


def test_report(spark, tmp_path):
    root = tmp_path / "p"
    (root / "node_modules").mkdir(parents=True)
    (root / "a.py").write_text("def f(a):\n    return eval(a)\n")
    (root / "b.js").write_text("function g(a) { return a }\n")
    (root / "node_modules" / "c.js").write_text("eval(x)\n")
    got = api.Codeloam(spark).report(str(root), str(tmp_path / "out"))
    data = json.loads(open(got["data"]).read())
    assert data["languages"] == {"javascript": 1, "python": 1} and data["weaknesses"] == {"EVAL_USE": 1}
    page = open(got["html"]).read()
    assert page.count("<svg") == 5 and "EVAL_USE" in page and "node_modules" not in page


def test_charts_and_cut_tables(spark):
    assert "a&lt;b" in html.bars([("a<b", 2)]) and html.line([("x", 1), ("y", 2)]).count("<circle") == 2
    df = spark.range(60)
    assert "The first 50 of 60 rows." in reports.markdown("T", {"R": df}) and "The first 5 of 60 rows." in html.table(df, 5)
