"""Files that users exchange, diffs of many texts, long lines, repeated rows and odd inputs."""

import json

import pytest
from pyspark.sql import functions as F

from leaksieve.operators import audit, baseline, bindings, detect, metrics, route
from leaksieve.operators.rules import RULES
from leaksieve.plans import api
from leaksieve.sources import diffs
from leaksieve.sources.lines import snippet_lines
from leaksieve.sources.trees import read_tree

KEY = "AKIA" + "Q7" * 8


@pytest.fixture()
def findings(spark):
    docs = spark.createDataFrame([("1", f"x = '{KEY}'\npassword = 'hunter22x'\nproprietary"), ("2", None), ("3", "")], "id string, text string")
    return detect.rule_findings(snippet_lines(docs, "text", F.col("id"), "py", F.lit("./a.py")))


def documents(path):
    return [json.loads(path.read_text())]


def test_baseline_is_read_back_whole_and_suppresses(spark, findings, tmp_path):
    path = tmp_path / "baseline"
    baseline.write_baseline(findings, str(path))
    (one,) = documents(path)
    assert one["version"] == 1 and one["generated_at"] and one["fingerprints"] == sorted(set(one["fingerprints"]))
    known = baseline.read_baseline(spark, str(path))
    assert known.count() == 3 and baseline.suppress(findings, known).count() == 0
    assert baseline.read_baseline(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "broken").write_text("{no json")
    (tmp_path / "cut").write_text("\n".join(path.read_text().splitlines()[:-2]))
    assert baseline.read_baseline(spark, str(tmp_path / "cut")).count() == 0
    for indent in (None, 2):
        (tmp_path / "other").write_text(json.dumps(one, indent=indent))
        assert baseline.read_baseline(spark, str(tmp_path / "other")).count() == 3
    baseline.write_baseline(findings.where("false"), str(path))
    assert documents(path)[0]["fingerprints"] == [] and baseline.read_baseline(spark, str(path)).count() == 0
    assert baseline.read_baseline(spark, str(tmp_path / "broken")).count() == 0


def test_sarif_log_of_some_and_of_no_findings(findings, tmp_path):
    baseline.write_sarif(findings, str(tmp_path / "s"))
    (log,) = documents(tmp_path / "s")
    run = log["runs"][0]
    assert log["version"] == "2.1.0" and {r["id"] for r in run["tool"]["driver"]["rules"]} == {r["ruleId"] for r in run["results"]}
    assert [r["locations"][0]["physicalLocation"]["artifactLocation"]["uri"] for r in run["results"]] == ["a.py"] * 3
    assert KEY not in json.dumps(log) and "hunter22x" not in json.dumps(log)
    baseline.write_sarif(findings.where("false"), str(tmp_path / "none"))
    (log,) = documents(tmp_path / "none")
    assert log["runs"][0]["results"] == [] and log["runs"][0]["tool"]["driver"]["rules"] == []


def test_documents_of_any_size(spark, tmp_path):
    many = spark.range(200_000).select(
        F.lit("u").alias("unit_id"), F.concat(F.lit("f"), F.col("id") % 977).alias("file"), F.lit("py").alias("ext"), (F.col("id") % 1000).cast("int").alias("line_no"), F.lit("regex").alias("layer"), F.concat(F.lit("r"), F.col("id") % 7).alias("rule_id"),
        F.lit('a "quote" \\').alias("description"), F.lit("s").alias("snippet"), F.concat(F.lit("secret"), F.col("id")).alias("secret"), F.lit("x").alias("redacted"), F.lit(0.9).alias("confidence"), F.lit("T0").alias("tier"), F.lit(False).alias("ai_skipped"), F.lit(0).alias("phase"),
        detect.match_ord(F.lit(0), F.lit(0), F.lit(1)).alias("match_ord"),
    )
    baseline.write_sarif(many, str(tmp_path / "s.json"))
    (log,) = documents(tmp_path / "s.json")
    results = log["runs"][0]["results"]
    places = [(r["locations"][0]["physicalLocation"]["artifactLocation"]["uri"], r["locations"][0]["physicalLocation"]["region"]["startLine"]) for r in results]
    assert len(results) == 200_000 and places == sorted(places) and len(log["runs"][0]["tool"]["driver"]["rules"]) == 7
    baseline.write_baseline(many, str(tmp_path / "b.json"))
    (one,) = documents(tmp_path / "b.json")
    assert len(one["fingerprints"]) == 200_000 and one["fingerprints"] == sorted(one["fingerprints"])
    assert baseline.suppress(many, baseline.read_baseline(spark, str(tmp_path / "b.json"))).count() == 0


def test_findings_are_worked_out_once_for_a_log(spark, findings, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    baseline.write_sarif(findings.mapInArrow(count, findings.schema), str(tmp_path / "s"))
    assert seen.value == 3


def test_audit_log_appends_verifies_and_shows_a_change(spark, findings, tmp_path):
    path = tmp_path / "audit"
    assert audit.verify_log(spark, str(path), b"k").first()["n_entries"] == 0
    for _ in range(2):
        audit.append_log(audit.events_of(findings), str(path), b"k")
    log = audit.read_log(spark, str(path))
    assert [r.seq for r in log.orderBy("line_no").collect()] == list(range(6)) == [r.line_no for r in log.orderBy("line_no").collect()]
    found = audit.verify_log(spark, str(path), b"k").first()
    assert (found.n_entries, found.first_broken) == (6, None)
    assert audit.verify_log(spark, str(path), b"other").first().first_broken == 0
    lines = [x.value for x in spark.read.text(str(path)).collect()]
    assert not any(KEY in x for x in lines)
    whole = tmp_path / "one.jsonl"
    in_order = sorted(lines, key=lambda x: json.loads(x)["seq"])
    whole.write_text("\n".join(in_order[:3] + [in_order[3].replace("BLOCK", "ALLOW").replace("WARN", "ALLOW")] + in_order[4:]) + "\n")
    assert audit.verify_log(spark, str(whole), b"k").first().first_broken in (3, 4)


def test_audit_log_is_chained_range_by_range_whatever_its_names_hold(spark, findings, tmp_path, monkeypatch):
    names = ["a\x1fb", "a\u2028b", "a\u0085\"\\", "é\U0001f511", None, "z"]
    monkeypatch.setattr(audit, "CHUNK", 2)
    many = findings.crossJoin(spark.createDataFrame([(n,) for n in names], "name string")).withColumn("file", F.col("name")).drop("name")
    path = str(tmp_path / "audit")
    for _ in range(2):
        audit.append_log(audit.events_of(many, "t"), path, b"k")
    found = audit.verify_log(spark, path, b"k").first()
    assert (found.n_entries, found.first_broken) == (36, None)
    entries = [r.asDict() for r in audit.read_log(spark, path).orderBy("line_no").collect()]
    order = sorted(many.collect(), key=lambda r: (-r.confidence, r.file is not None, (r.file or "").encode()))
    assert [e["file"] for e in entries] == [r.file for r in order] * 2
    assert [{k: v for k, v in e.items() if k != "line_no"} for e in entries] == audit.append(entries, b"k")
    assert len(list((tmp_path / "audit").glob("part-*"))) > 4


def test_history_report_names_commits(spark):
    log = diffs.COMMIT + f"abc\0Add key\n+++ b/k.py\n@@ -0,0 +1 @@\n+k = '{KEY}'\n"
    found = api.scan_history(spark.createDataFrame([(log,)], "text string"))
    rows = [json.loads(r.value) for r in baseline.history_json_lines(found).collect()]
    assert {(r["commit"], r["subject"], r["file"], r["line"]) for r in rows} == {("abc", "Add key", "k.py", 1)}
    assert "secret" not in rows[0] and "snippet" not in rows[0]


@pytest.mark.parametrize("n", [2, 1000])
def test_diffs_of_many_rows_stay_apart(spark, n):
    one = "+++ b/a.py\n@@ -0,0 +{} @@\n+k = 1 {}\n-x\n+k = 2 {}\n"
    d = spark.createDataFrame([(one.format(i, i, i),) for i in range(1, n + 1)], "text string")
    added = diffs.added_lines(diffs.diff_rows(d)).collect()
    assert len({r.unit_id for r in added}) == n
    assert sorted((r.line_no, r.text) for r in added) == sorted((i + j, f"k = {j + 1} {i}") for i in range(1, n + 1) for j in (0, 1))


def test_a_line_of_2000_hits_keeps_its_order_and_repeated_lines_count_apart(spark):
    line = " ".join([KEY] * 2000) + " proprietary"
    token = "kJ8#mQ2$vX9!pL4&zR7*wT5^bN3@cF6%dG1~hS0"
    docs = spark.createDataFrame([("1", line), ("2", f"x = {token}"), ("2", f"x = {token}")], "id string, text string")
    lines = snippet_lines(docs, "text", F.col("id"), "py")
    found = detect.rule_findings(lines).where("unit_id = '1'").orderBy("match_ord").collect()
    assert [f.match_ord.occurrence for f in found] == [*range(1, 2001), 1]
    assert found[-1].rule_id == "confidentiality_keyword" and {f.match_ord.view for f in found} == {0}
    assert detect.entropy_findings(lines).count() == 2
    both = detect.line_findings(lines, entropy={})
    assert both.where("layer = 'entropy'").count() == 2 and both.where("layer = 'regex'").count() == 2001


def test_one_pass_finds_what_two_find(spark, findings):
    docs = spark.createDataFrame([(str(i), t) for i, t in enumerate(["a = 'kJ8#mQ2$vX9!pL4&zR7*wT5^bN3@cF6%dG1~hS0'", f"k: {KEY}", "x", "", None, "\uff21 = 1"])], "id string, text string")
    lines = snippet_lines(docs, "text", F.col("id"), "py")
    apart = detect.rule_findings(lines).unionByName(detect.entropy_findings(lines))
    assert sorted(map(str, detect.line_findings(lines, entropy={}).collect())) == sorted(map(str, apart.collect()))


def test_columns_of_own_names_stay(spark):
    d = spark.createDataFrame([("u", "f", "py", 1, f"k {KEY}", 5, 6)], "unit_id string, file string, ext string, line_no int, text string, _view int, `a.b` int")
    (h,) = detect.rule_hits(d).collect()
    assert (h["_view"], h["a.b"], h["secret"]) == (5, 6, KEY)


def test_excluded_files_are_not_read(spark, tmp_path):
    for name in ("src/a b+c.py", "node_modules/x.py", "src/y.lock"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("k = 1\n")
    found = read_tree(spark, str(tmp_path), ("node_modules",), ("*.lock",))
    assert [r.path for r in found.collect()] == ["src/a b+c.py"]


def test_what_binds_nothing():
    source = "".join(f"function f{i}(token = '{'x' * 20}') {{}}\nif (secret = '{'y' * 20}') {{}}\n" for i in range(3)) + f"class A {{ secret = '{'z' * 20}'; m(token = '{'z' * 20}') {{ this.token = '{'w' * 20}'; }} }}\n"
    assert [(b.name, b.row) for b in bindings.bindings_in(source, "js")] == [("secret", 1), ("secret", 3), ("secret", 5), ("this.token", 6)]
    assert [b.name for b in bindings.bindings_in(f'@Value(secret = "{"x" * 20}") String token = "{"x" * 20}";', "java")] == ["token"]


def test_percentiles_of_a_hot_group_and_null_groups(spark):
    rows = [("a", float(i % 37)) for i in range(5000)] + [(None, 1.0), (None, 2.0), ("n", None)]
    d = spark.createDataFrame(rows, "k string, v double")
    found = {r.k: (r.p50, r.p95) for r in metrics.nearest_rank(d, "v", {"p50": 0.5, "p95": 0.95}, by="k").collect()}
    a = sorted(v for k, v in rows if k == "a")
    assert found == {"a": (a[round(4999 * 0.5 + 1e-9)], a[round(4999 * 0.95)]), None: (2.0, 2.0)}
    every = sorted(v for _, v in rows if v is not None)
    assert metrics.nearest_rank(d, "v", {"p": 0.5}).first().p == every[int((len(every) - 1) * 0.5 + 0.5)]


def test_ready_and_bench_report(spark):
    from leaksieve.sources.settings import Settings

    assert not Settings().adjudicator_ready() and Settings(model="m").adjudicator_ready() and Settings().adjudicator_ready("key") and not Settings(model="m", adjudicate=False).adjudicator_ready()
    d = spark.createDataFrame([("1", "\n x = 1", "leak", "secret", True), ("2", f"k {KEY}", "clean", None, True), ("3", "", "leak", None, False)], "id string, code string, label string, category string, usable boolean")
    lists = {r.kind: (r["items"], r.more) for r in api.bench_lists(d, most=0 + 10).collect()}
    assert lists == {"missed": ([" x = 1"], 0), "false alarm": ([f"k {KEY}"], 0)}
    times = spark.createDataFrame([(1.0,), (2.0,), (9.0,)], "ms double")
    one = api.bench(d, latencies=times).first()
    assert (one.p50_ms, one.p95_ms, one.skipped, one.fn, one.fp) == (2.0, 9.0, 1, 1, 1)


def test_rules_are_72(spark):
    assert len(RULES) == 72 and route.KEY
