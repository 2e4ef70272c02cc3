import json

import pytest
from pyspark.sql import functions as F

from leaksieve.operators import baseline
from leaksieve.plans import api
from leaksieve.sources import diffs, settings
from leaksieve.sources.lines import read_samples
from leaksieve.sources.trees import read_tree


def test_settings(tmp_path):
    s = tmp_path / "s.toml"
    s.write_text('mode = "shadow"\nthreshold = 4.0\nunknown = 1\nallowed_remotes = ["git@*:acme/*"]\n[thresholds]\npy = 5.0\n[[custom_rules]]\nname = "acme key"\npattern = "acme-[0-9]+"\n')
    got = settings.load(str(s))
    assert got.shadow and got.threshold == 4.0 and got.thresholds == {"py": 5.0} and got.exclude_dirs == () and len(got.rules) == 73
    assert got.remote_allowed(None) and got.remote_allowed("git@host:acme/x") and not got.remote_allowed("git@host:other/x")
    with pytest.warns(UserWarning):
        assert settings.load(str(tmp_path / "none.toml")) == settings.Settings()
    (tmp_path / "bad.json").write_text("{")
    with pytest.warns(UserWarning):
        assert settings.load(str(tmp_path / "bad.json")) == settings.Settings()


def test_rule_files_replace_the_catalog(tmp_path):
    (tmp_path / "r.toml").write_text('[[rules]]\nid = "x"\ntier = "T1"\nconfidence = 0.9\npattern = "x(1)"\n')
    assert [(r.id, r.group) for r in settings.rules_of(str(tmp_path / "r.toml"))] == [("x", 1)]
    with pytest.warns(UserWarning):
        assert len(settings.rules_of(str(tmp_path / "none.toml"))) == 72


def test_files_end_to_end(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("password = 'hunter22x'\napi_key = 'abcdefghij1234'\n")
    (tmp_path / "src" / "b.py").write_text("fine = 1\n")
    (tmp_path / "dist").mkdir()
    (tmp_path / "dist" / "c.py").write_text("password = 'hunter22x'\n")
    files = read_tree(spark, str(tmp_path))
    assert sorted(r.path for r in files.collect()) == ["dist/c.py", "src/a.py", "src/b.py"]
    found = api.scan_files(files).cache()
    assert sorted((r.file, r.rule_id) for r in found.collect()) == [("src/a.py", "ast_taint"), ("src/a.py", "password_in_code")]
    assert api.scan_files(files, known=baseline.baseline_of(found)).count() == 0
    docs = {json.loads(r.value)["file"]: json.loads(r.value) for r in baseline.json_documents(files, found).collect()}
    assert docs["src/b.py"]["clean"] and [f["match_type"] for f in docs["src/a.py"]["findings"]] == ["password_in_code", "ast_taint"]
    assert "secret" not in docs["src/a.py"]["findings"][0]


def test_texts_diffs_and_history(spark):
    d = spark.createDataFrame([("1", "password = 'hunter22x'"), ("2", None)], "id string, text string")
    assert [r.unit_id for r in api.scan_texts(d, "id", "text", "py").collect()] == ["1"]
    diff = "+++ b/x.py\n@@ -0,0 +7 @@\n+password = 'hunter22x'\n"
    assert [(r.file, r.line_no) for r in api.scan_diffs(spark.createDataFrame([(diff,)], "text string")).collect()] == [("x.py", 7)]
    log = f"{diffs.COMMIT}abc\0a subject\n{diff}{diffs.COMMIT}def\0other\n+++ b/y.py\n@@ -0,0 +1 @@\n+fine\n"
    assert [(r.sha, r.subject, r.line_no) for r in api.scan_history(spark.createDataFrame([(log,)], "text string")).collect()] == [("abc", "a subject", 7)]


def test_each_diff_is_a_unit(spark):
    secret = "+password = 'hunter22x'\n"
    texts = [f"+++ b/x.py\n@@ -0,0 +7,2 @@\n+fine\n{secret}", f"+++ b/y.py\n@@ -0,0 +30 @@\n{secret}", f"+++ b/z.py\n@@ -0,0 +1,2 @@\n+# leaksieve:skip-file\n{secret}", f"+++ b/dist/v.py\n@@ -0,0 +1 @@\n{secret}", "", None]
    d = spark.createDataFrame([*enumerate(texts), (6, texts[0])], "id long, text string")
    added = sorted((r.file, r.line_no) for r in diffs.added_lines(diffs.diff_rows(d)).collect())
    assert added == [("x.py", 7), ("x.py", 7), ("x.py", 8), ("x.py", 8), ("y.py", 30)]
    found = [(r.unit_id, r.file, r.line_no) for r in api.scan_diffs(d).collect()]
    assert sorted(f[1:] for f in found) == [("x.py", 8), ("x.py", 8), ("y.py", 30)] and len({f[0] for f in found}) == 3
    assert sorted((r.unit_id, r.file, r.line_no) for r in api.scan_diffs(d, id_col="id").collect()) == [("0", "x.py", 8), ("1", "y.py", 30), ("6", "x.py", 8)]


def test_adjudication_on_executors(spark):
    d = spark.createDataFrame([("1", "h = 'a.internal'\nh = 'b.internal'"), ("2", "h = 'c.internal'")], "id string, text string")
    found = api.scan_texts(d, "id", "text", "py").cache()
    labels = api.adjudicate(found, lambda s: "leak: yes" if "a." in s else "clean")
    from leaksieve.operators import route

    assert [(r.unit_id, r.line_no, r.layer) for r in route.routed(found, labels).collect()] == [("1", 1, "semantic")]


def test_bench_over_a_labelled_corpus(spark, tmp_path):
    rows = [("password = 'hunter22x'", "leak", "secret"), ("k = 'AKIA" + "Q7" * 8 + "'", "leak", "secret"), ("x = 'a-internal'", "leak", "ip"), ("plain = 1", "clean", None), ("checksum = 'd41d8cd98f00b204e9800998ecf8427e'", "clean", None), ("nothing to see", "leak", None)]
    (tmp_path / "c.jsonl").write_text("\n".join(json.dumps({"code": c, "label": l, "category": k}) for c, l, k in rows) + "\nbroken\n")
    r = api.bench(read_samples(spark, str(tmp_path / "c.jsonl"))).first()
    assert (r.tp, r.fn, r.fp, r.tn, r.skipped) == (3, 1, 0, 2, 1) and r.secret_recall == 1.0 and r.ip_recall == 0.5


def test_home_made_corpus_meets_the_bounds(spark):
    """Leaks of many kinds and benign look-alikes: recall, precision and false positives within the published bounds."""
    from tests.test_detect import CASES

    leaks = [c[0] for n, c in CASES.items() if n != "confidentiality_keyword"]
    clean = ["def f(x): return x", "sha256: e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855", "id = '01234567-89ab-cdef-0123-456789abcdef'", "hash = '$2b$12$abcdefghijklmnopqrstuv'", "img = 'data:image/png;base64,iVBORw0KGgoAAAANSUhEUg'", "version = '1.2.3-rc.1+build.20240101'", "password = '<YOUR_PASSWORD>'", "api_key = 'your-api-key-goes-here'", "public_key_path = '/etc/ssl/cert.pem'", "see https://example.com/docs/a/b"] * 4
    rows = [(str(i), t, l, None, True) for i, (t, l) in enumerate([*((t, "leak") for t in leaks), *((t, "clean") for t in clean)])]
    r = api.bench(spark.createDataFrame(rows, "id string, code string, label string, category string, usable boolean")).first()
    assert r.recall >= 0.97 and r.precision >= 0.97 and r.fpr <= 0.02
