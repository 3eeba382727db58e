from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from codeloam.operators import memory as mem
from codeloam.operators import project as pj
from codeloam.plans import reports
from codeloam.sources import files, store
from codeloam.streaming import snapshots as st

FIND = "finding_id bigint, project string, file string, vuln_type string, severity string, line int, cwe_id string, sink string, detector string, found_at timestamp, loaded_at timestamp"
T0 = datetime(2031, 3, 1)


def findings(spark, rows):
    return spark.createDataFrame([(i, p, f, k, s, l, c, "x", "d", T0 + timedelta(hours=20 * i), T0) for i, (p, f, k, s, l, c) in enumerate(rows)], FIND)


ROWS = [("p", "a", "XSS", "High", 3, "C1"), ("p", "a", "XSS", None, None, None), ("p", "b", "SSRF", "low", 1, "C2"), ("q", None, "XSS", "INFO", 2, None), ("q", "c", "XSS", "critical ", 2, "C1")]


def test_posture(spark):
    f = pj.findings_of(findings(spark, ROWS))
    got = {(r.facet, r["name"]): (r.findings, r.risk) for r in pj.posture(f).collect()}
    assert got["all", None] == (5, 1.0) and got["kind", "XSS"] == (4, 1.0) and got["severity", "MEDIUM"] == (1, 0.4) and got["file", "a"] == (2, 0.7)
    assert {(r.project, r.grade) for r in pj.grades(f, ["project"]).collect()} == {("p", "D"), ("q", "F")}
    assert [(r.project, r.file) for r in pj.risky_files(f, 2).collect()] == [("q", "c"), ("p", "a")]
    row = {r.project: r for r in pj.severities(f, ["project"]).collect()}["p"]
    assert (row.CRITICAL, row.HIGH, row.MEDIUM, row.LOW) == (0, 1, 1, 1)
    assert {r.lines for r in pj.remediations(f).where("file = 'a'").collect()} == {"LNone XSS: Review this code path.\nL3 XSS: Review this code path."}
    text = reports.posture_text(pj.posture(f).collect(), "F")
    assert "grade F" in text and "XSS (4)" in text
    assert pj.posture(f.limit(0)).where("findings > 0").count() == 0 and reports.posture_text([], "A+") == "CLEAN: no findings."


@pytest.mark.parametrize("score,letter", [(0.8, "F"), (0.7, "D"), (0.4, "C"), (0.2, "B"), (0.1, "A"), (0.0, "A+"), (None, "A+")])
def test_grades(spark, score, letter):
    assert spark.createDataFrame([(score,)], "s double").select(pj.grade(F.col("s"))).first()[0] == letter


SNAP = "snapshot_id bigint, delivery_no int, target string, complexity string, enriched map<string,double>, composite map<string,double>, algorithms array<string>, patterns array<string>, vuln_types array<string>, type_profile map<string,double>, type_flow struct<propagations:int,type_errors:int>, loaded_at timestamp"


def snap(i, no, vec, growth="O(n)", algs=None, vulns=None, types=None, flow=None, target="t"):
    return (i, no, target, growth, vec, None, algs, None, vulns, types, flow, T0)


def test_diffs(spark):
    rows = [snap(1, 1, {"a": 1.0, "b": 2.0}), snap(2, 2, {"a": 1.0, "b": 3.0, "c": 1.0}), snap(3, 3, {"a": 1.0, "b": 3.0, "c": 1.0}, "O(n^2)", ["x", "x"], ["V"], {"T": 1.0}, (1, 0)), snap(4, 4, {"a": 1.0, "b": 3.0, "c": 1.0}, " o( N ) ", ["x"], [], {"T": 1.0}, (1, 0)), snap(4, 4, {"a": 1.0, "b": 3.0, "c": 1.0}, " o( N ) ", ["x"], [], {"T": 1.0}, (1, 0))]
    got = {r.new_id: r for r in mem.diffs(mem.snapshots_of(spark.createDataFrame(rows, SNAP))).collect()}
    assert set(got) == {2, 3, 4}
    assert got[2].cascade == 0.3 and {c.dim for c in got[2].changed} == {"b", "c"} and got[2].verdict == "moderate"
    assert got[3].algorithms_gained == ["x"] and got[3].vulns_gained == ["V"] and got[3].complexity_direction == "degraded" and got[3].verdict == "vulnerable"
    assert got[3].cascade == round(0.25 * 0.4 + 0.2 / 8 + 0.1, 3)
    assert got[4].vulns_fixed == ["V"] and got[4].complexity_direction == "improved"


def test_history_and_slug(spark):
    rows = [snap(i, i, {"a": float(i)}) for i in range(1, 9)]
    h = mem.history(mem.snapshots_of(spark.createDataFrame(rows, SNAP)))
    assert sorted(r.snapshot_id for r in h.collect()) == [4, 5, 6, 7, 8]
    s = spark.createDataFrame([("a//b c.py",)], "t string").select(mem.slug(F.col("t"))).first()[0]
    import hashlib

    assert s == "a_b_c.py_" + hashlib.sha1(b"a//b c.py").hexdigest()[:8]
    assert mem.diffs(mem.snapshots_of(spark.createDataFrame([], SNAP))).count() == 0


def test_scan(spark, tmp_path):
    root = tmp_path / "proj.x"
    for name, text in {"a.py": "x = 1", "b.txt": "no", "src/c.js": "y", "vendor/d.py": "z", "src/big.py": "x" * 30_000, "src/tests/e.py": "t", "f.go": "café"}.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text, encoding="utf-8")
    (root / "bad.py").write_bytes(b"a\xff")
    got = {r.path: (r.lang, r.code) for r in files.scan_project(spark, str(root)).collect()}
    assert got == {"a.py": ("python", "x = 1"), "src/c.js": ("javascript", "y"), "f.go": ("go", "café"), "bad.py": ("python", "a�")}
    assert files.scan_project(spark, str(root), most_files=2).count() == 2 and files.per_language(files.scan_project(spark, str(root)), 1).count() == 3
    lib = tmp_path / "lib.json"
    lib.write_text('{"language": "python", "libraries": {"os": {"system": "EXEC", "path.join": "FILE"}}}')
    assert {(r.module, r.call, r.role) for r in files.libraries(spark, str(lib)).collect()} == {("os", "system", "EXEC"), ("os", "path.join", "FILE")}


def test_store(spark, tmp_path):
    path, to = str(tmp_path / "s"), str(tmp_path / "c")
    for k in range(7):
        store.save(spark.createDataFrame([("t", f"2031-01-0{k + 1}", {"a": float(k)})], "target string, timestamp string, enriched map<string,double>"), path)
    (tmp_path / "s" / "other.json").write_text("{broken\n")
    assert store.load_all(spark, path).count() == 7 and store.load_latest(spark, path).first().enriched == {"a": 6.0}
    store.compact(spark, path, to)
    assert sorted(r.timestamp[-1] for r in store.load_all(spark, to).collect()) == list("34567") and store.targets(spark, to).count() == 1
    store.save_reports(spark.createDataFrame([("2031-01-01", "project", "t")], "date string, analysis_type string, target string"), str(tmp_path / "r"))
    assert (tmp_path / "r/date=2031-01-01/analysis_type=project").is_dir()


def test_reports(spark):
    e = spark.createDataFrame([("a", "b"), ("a", 'c"d'), ("a", "b")], "src string, dst string")
    text = reports.mermaid(e)
    assert text.startswith("flowchart LR") and text.count("-->") == 2
    assert "| a | b |" in reports.markdown("T", {"Edges": e, "None": e.limit(0)}) and "None" not in reports.markdown("T", {"None": e.limit(0)})


def test_streams_keep_state_over_batches(spark, tmp_path):
    schema = "target string, delivery_no int, loaded_at timestamp, enriched map<string,double>, vuln_types array<string>, complexity string"
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()

    def arrive(n, *rows):
        spark.createDataFrame([(t, no, T0 + timedelta(days=no), v, None, "O(n)") for t, no, v in rows], schema).coalesce(1).write.parquet(str(src / f"d{n}"))

    def run():
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(src))
        q = st.changes(stream).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()

    arrive(1, ("a", 1, {"x": 1.0}), ("b", 1, {"x": 1.0}))
    run()
    arrive(2, ("a", 2, {"x": 1.0}), ("b", 2, {"x": 2.0}), ("./c", 2, None))
    run()
    arrive(3, ("a", 3, {"x": 5.0}), ("b", 1, {"x": 9.0}))
    run()
    got = sorted((r.target, r.delivery_no, r.change_kind) for r in spark.read.parquet(str(out)).collect())
    assert got == [("a", 1, "added"), ("a", 3, "changed"), ("b", 1, "added"), ("b", 2, "changed"), ("c", 2, "added")]
