import dataclasses
import json

from pyspark.sql import functions as F

from leaksieve.operators import audit, baseline, detect, metrics
from leaksieve.sources import diffs
from leaksieve.sources.lines import file_lines, read_samples, snippet_lines, without_ignored
from leaksieve.streaming.scan import scan_stream


def findings(spark, text, file="./a.py"):
    docs = spark.createDataFrame([("u", text)], "id string, text string")
    return detect.rule_findings(snippet_lines(docs, "text", F.col("id"), "py", F.lit(file)))


def test_baseline_moves_but_new_secrets_dont(spark):
    old = findings(spark, "x\npassword = 'first-secret'")
    moved, changed = findings(spark, "password = 'first-secret'"), findings(spark, "password = 'other-secret'")
    known = baseline.baseline_of(old)
    assert baseline.suppress(moved, known).count() == 0 and baseline.suppress(changed, known).count() == 1
    assert baseline.suppress(findings(spark, "password = 'first-secret'", "a.py"), known).count() == 1
    assert baseline.suppress(findings(spark, "password = 'first-secret'", "a.py"), baseline.baseline_of(old, True), True).count() == 0


def test_no_sink_holds_the_secret(spark, tmp_path):
    f = findings(spark, "password = 'top-secret-value'")
    out = [*baseline.json_lines(f).collect(), *baseline.sarif_results(f).collect(), *baseline.sarif_rules(f).collect(), *baseline.baseline_of(f).collect()]
    assert out and not any("top-secret-value" in str(r) for r in out)
    baseline.write_baseline(f, str(tmp_path / "b"))
    baseline.write_sarif(f, str(tmp_path / "s"))
    assert not any("top-secret-value" in p.read_text() for p in tmp_path.rglob("*.json"))


def test_read_baseline(spark, tmp_path):
    (tmp_path / "b.json").write_text(json.dumps({"version": 1, "generated_at": "x", "fingerprints": ["a", "b", "a"]}, indent=1))
    assert sorted(r.fingerprint for r in baseline.read_baseline(spark, str(tmp_path / "b.json")).collect()) == ["a", "b"]


def test_redaction_goes_to_the_first_occurrence_in_order(spark):
    text = "# first-secret\npassword = 'first-secret'\npassword = 'other-secret'"
    f = findings(spark, text, "a.py")
    files = spark.createDataFrame([("a.py", text), ("b.py", "clean")], "path string, text string")
    got = {r.path: (r.text, r.n_redacted) for r in baseline.redact_files(files, f).collect()}
    assert got["a.py"] == ("# REDACTED_PASSWORD_IN_CODE_1\npassword = 'first-secret'\npassword = 'REDACTED_PASSWORD_IN_CODE_1'", 2)
    assert got["b.py"] == ("clean", 0)


DIFF = """diff --git a/x.py b/x.py
--- a/x.py
+++ b/src/x.py
@@ -0,0 +11,2 @@
+one
+two
@@ -5,0 +30 @@ def f
-gone
+three
+four # leaksieve:allow
+five
--- a/y.py
+++ b/y.py
@@ -0,0 +1,2 @@
+bad
+# leaksieve:skip-file
--- a/v.js
+++ b/dist/v.js
@@ -0,0 +1 @@
+vendored
--- a/z
+++ b/z.env
@@ -1 +1 @@
 same
+six
"""


def test_diff_numbers(spark):
    d = spark.createDataFrame([(DIFF,), (None,), ("",)], "text string")
    got = sorted((r.file, r.line_no, r.text, r.ext) for r in diffs.added_lines(diffs.diff_rows(d.where("text is not null and text != ''"))).collect())
    assert got == [("src/x.py", 11, "one", "py"), ("src/x.py", 12, "two", "py"), ("src/x.py", 30, "three", "py"), ("src/x.py", 32, "five", "py"), ("z.env", 2, "six", "env")]
    assert diffs.added_lines(diffs.diff_rows(d.where("text is null or text = ''"))).count() == 0


def test_history_is_one_unit_a_commit(spark):
    log = "".join(f"{diffs.COMMIT}sha{i}\0subject {i}\n+++ b/f{i}.py\n@@ -0,0 +1 @@\n+line {i}\n" for i in range(3))
    d = spark.createDataFrame([(log,)], "text string")
    assert sorted((r.unit_id, r.file, r.line_no, r.text) for r in diffs.history_lines(d).collect()) == [(f"sha{i}", f"f{i}.py", 1, f"line {i}") for i in range(3)]
    assert [r.subject for r in diffs.commits(d).orderBy("sha").collect()] == ["subject 0", "subject 1", "subject 2"]


def test_trees(spark):
    files = spark.createDataFrame([("a/b.py", "x\r\ny\n"), ("dist/c.py", "x"), ("dist2/c.py", "z"), ("d.lock", "x"), ("s.py", "x\n# leaksieve:skip-file"), ("m.py", "1\n2 leaksieve:allow\n3"), ("e.py", "")], "path string, text string")
    got = sorted((r.file, r.line_no, r.text) for r in file_lines(files).collect())
    assert got == [("a/b.py", 1, "x"), ("a/b.py", 2, "y"), ("dist2/c.py", 1, "z"), ("m.py", 1, "1"), ("m.py", 3, "3")]
    ignored = spark.createDataFrame([("./a\\b.py",)], "path string")
    assert "a/b.py" not in [r.path for r in without_ignored(files, ignored).collect()]


KEY = b"a key"


def chain(n=4):
    events = [{"timestamp": f"t{i}", "event": "BLOCK", "file": 'a"é.py' if i % 2 else None, "tier": "T0", "layer": "regex", "verdict": "T0", "version": "1" if i else None, "scan_duration_ms": None, "ai_layer": None} for i in range(n)]
    first = audit.append(events[:2], KEY)
    return [*first, *audit.append(events[2:], KEY, first[-1])]


def broken(spark, entries):
    df = spark.createDataFrame([{**e, "line_no": i} for i, e in enumerate(entries)], audit.ENTRY + ", line_no long") if entries else spark.createDataFrame([], audit.ENTRY + ", line_no long")
    r = audit.first_break(df, KEY).first()
    return r.n_entries, r.first_broken


def test_audit_chain(spark):
    good = chain()
    assert [e["seq"] for e in good] == [0, 1, 2, 3]
    assert broken(spark, good) == (4, None) and broken(spark, []) == (0, None)
    assert broken(spark, [*good[:1], {**good[1], "verdict": "ALLOW"}, *good[2:]])[1] == 1
    assert broken(spark, [good[0], good[2], good[3]])[1] == 1
    assert broken(spark, good[:2]) == (2, None)  # cut off at the end: not seen


def test_measures(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"code": "x", "label": "LEAK", "category": "secret"}\n\n{"code": "y", "label": "clean"}\nnot json\n{"code": "z", "label": "odd"}\n{"code": "w", "label": "leak", "extra": 1}\n')
    s = read_samples(spark, str(tmp_path / "c.jsonl"))
    assert s.count() == 5 and s.where("usable").count() == 3
    samples = s.where("usable").select(F.col("code").alias("unit_id"), "label", "category")
    r = metrics.confusion(samples, spark.createDataFrame([("x",), ("x",), ("y",)], "unit_id string")).first()
    assert (r.tp, r.fn, r.fp, r.tn, r.n_secret, r.tp_secret, r.n_ip, r.tp_ip) == (1, 1, 1, 0, 1, 1, 1, 0)
    empty = metrics.confusion(samples.limit(0), samples.select("unit_id").limit(0)).first()
    assert (empty.precision, empty.recall) == (0.0, 0.0)
    for n in (1, 2, 5, 10):
        v = spark.createDataFrame([(float(i * i % 7),) for i in range(n)], "v double")
        ordered = sorted(float(i * i % 7) for i in range(n))
        r = metrics.nearest_rank(v, "v", {"p50": 0.5, "p95": 0.95}).first()
        assert (r.p50, r.p95) == tuple(ordered[int((n - 1) * q + 0.5)] for q in (0.5, 0.95))


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"id": "1", "text": "password = \'hunter22x\'"}\n{"id": "2", "text": "fine"}\n')
    docs = spark.readStream.schema("id string, text string").json(str(tmp_path / "in"))
    seen = []
    q = scan_stream(docs, "id", "text", lambda df, n: seen.extend((r.unit_id, r.rule_id) for r in df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert seen == [("1", "password_in_code")]


def test_rules_are_frozen():
    from leaksieve.operators.rules import RULES

    assert all(dataclasses.is_dataclass(r) for r in RULES)
