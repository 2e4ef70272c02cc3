"""Diffs over blocks and splits, commit logs, line diffs of two states."""

import random

import pytest
from pyspark.sql import functions as F

from leaksieve.operators import compare
from leaksieve.plans import api
from leaksieve.sources import diffs


def straight(lines):
    """The format's state machine, line by line: (line, file, kind, line_no, skipped)."""
    file, n, out, first = None, 0, [], 0
    for text in lines:
        kind = "file" if text.startswith("+++ b/") else "hunk" if text.startswith("@@ ") else "added" if text.startswith("+") else "context" if text.startswith(" ") else "other"
        if kind == "file":
            file, n, first = text[6:], 0, len(out)
        elif kind == "hunk":
            digits = text.partition("+")[2]
            digits = digits[: len(digits) - len(digits.lstrip("0123456789"))]
            n = int(digits or 0)
        skipped = kind == "added" and "leaksieve:skip-file" in text
        out.append([text, file, kind, n if kind in ("added", "context") else None, bool(first < len(out) and out[first][4]) and (kind != "file")])
        if skipped:
            for row in out[first:]:
                row[4] = True
        n += kind in ("added", "context")
    return out


def some_diff(rng, n):
    pick = lambda: rng.choices(["+++ b/f%d.py", "@@ -1 +%d,3 @@", "@@ -1 +x @@", "+new %d", " same %d", "-old %d", "+# leaksieve:skip-file", "index", "+++ /dev/null", ""], [2, 4, 1, 30, 5, 8, 1, 1, 1, 1])[0]
    return [t % rng.randrange(100) if "%d" in t else t for t in (pick() for _ in range(n))]


@pytest.mark.parametrize("size", [1, 2, 3, 7, 50])
def test_numbers_don_t_depend_on_blocks(spark, size):
    rng = random.Random(size)
    units = {f"u{k}": some_diff(rng, rng.randint(1, 120)) for k in range(12)}
    rows = [(u, pos // size, pos, t, True) for u, lines in units.items() for pos, t in enumerate(lines)]
    got = diffs.numbered(spark.createDataFrame(rows, "unit_id string, block long, pos long, text string, split boolean")).collect()
    assert len(got) == len(rows)
    want = {(u, pos): row for u, lines in units.items() for pos, row in enumerate(straight(lines))}
    for r in got:
        text, file, kind, line_no, skipped = want[r.unit_id, r.pos]
        assert (r.text, r.file, r.kind, r.skipped) == (text, file, kind, skipped)
        assert line_no is None or r.line_no == line_no


def test_a_large_diff_is_many_tasks_work(spark, tmp_path):
    lines = ["+++ b/big.py", "@@ -0,0 +1,1000000 @@", *[f"+line {i}" for i in range(1_000_000)]]
    (tmp_path / "x.diff").write_text("\r\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(2 << 20))
    try:
        rows = diffs.read_diffs(spark, str(tmp_path))
        assert rows.rdd.getNumPartitions() > 5 and rows.select("block").distinct().count() > 5
        got = diffs.added_lines(rows)
        assert got.where(F.col("text") != F.concat(F.lit("line "), (F.col("line_no") - 1).cast("string"))).count() == 0
        assert got.agg(F.count(F.lit(1)), F.countDistinct("line_no"), F.max("file"), F.max("unit_id")).first()[:3] == (1_000_000, 1_000_000, "big.py")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_texts_over_a_block_are_split(spark, monkeypatch):
    monkeypatch.setattr(diffs, "BLOCK", 4)
    rng = random.Random(9)
    texts = [some_diff(rng, n) for n in (3, 16, 17, 200, 33)]
    d = spark.createDataFrame([(str(k), "\n".join(t) + "\n") for k, t in enumerate(texts)], "id string, text string")
    rows = diffs.diff_rows(d, "text", F.col("id"))
    assert {(r.unit_id, r.split) for r in rows.select("unit_id", "split").distinct().collect()} == {("0", False), ("1", False), ("2", True), ("3", True), ("4", True)}
    got = {(r.unit_id, r.pos): (r.file, r.kind, r.line_no if r.kind in ("added", "context") else None, r.skipped) for r in diffs.numbered(rows).collect()}
    assert got == {(str(k), pos): (f, kind, n, s) for k, t in enumerate(texts) for pos, (_, f, kind, n, s) in enumerate(straight(t))}
    copies = spark.createDataFrame([("+++ b/a\n+x",)] * 5 + [(None,), ("",), ("+++ b/b\n+y",)], "text string")
    assert len({r.unit_id for r in diffs.diff_rows(copies).collect()}) == 6 and diffs.added_lines(diffs.diff_rows(copies)).count() == 6


def test_log_read_in_splits(spark, tmp_path):
    commit = lambda i: f"{diffs.COMMIT}sha{i}\0subject \x01 {i}\n\n+++ b/f{i}.py\n@@ -0,0 +{i} @@\n" + (f"+AKIA{'Q7' * 8}\n" if i % 2 else "-gone\n")
    (tmp_path / "log").write_bytes("".join(commit(i) for i in range(3000)).encode())
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        log = diffs.read_log(spark, str(tmp_path))
        assert log.rdd.getNumPartitions() > 5
        assert {(r.sha, r.subject) for r in log.collect()} == {(f"sha{i}", f"subject \x01 {i}") for i in range(3000)} and log.count() == 3000
        found = api.scan_commits(log).collect()
        assert {(r.sha, r.subject, r.unit_id, r.file, r.line_no) for r in found} == {(f"sha{i}", f"subject \x01 {i}", f"sha{i}", f"f{i}.py", i) for i in range(1, 3000, 2)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def common(a, b):
    """The length of a longest common subsequence, cell by cell."""
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for k, y in enumerate(b):
            row[k + 1] = before[k] + 1 if x == y else max(row[k], before[k + 1])
    return row[-1]


def test_added_lines_are_what_no_common_subsequence_holds():
    rng = random.Random(2)
    for _ in range(3000):
        old, new = ([rng.choice("abcdefgh"[: rng.randint(1, 8)]) for _ in range(rng.randint(0, 14))] for _ in range(2))
        added = set(compare.added_places(old, new))
        kept = [x for k, x in enumerate(new) if k not in added]
        assert len(kept) == common(old, new) == common(old, kept)
    old = [str(rng.randrange(3000)) for _ in range(20000)]
    new = [x for x in old if rng.random() > 0.1]
    for _ in range(500):
        new.insert(rng.randrange(len(new)), "n")
    assert len(compare.added_places(old, new)) == 500
    assert compare.added_places([], ["a"]) == [0] and compare.added_places(["a"], []) == []


def test_two_states(spark):
    schema = "path string, text string, extra int"
    make = lambda d: spark.createDataFrame([(p, t, 1) for p, t in d], schema)
    old = [("same.py", "a\nb\n"), ("a.py", "x\ny\nz\n"), ("end.py", "x"), ("gone.py", "x"), ("bin", "\0a"), ("crlf.py", "a\nb\n"), ("skip.py", "a\n"), ("null.py", None), ("twice.py", "b\n"), ("twice.py", "a\n")]
    new = [("same.py", "a\nb\n"), ("a.py", "x\nnew\nz\nlast"), ("end.py", "x\n"), ("bin", "\0b"), ("crlf.py", "a\r\nb\n"), ("skip.py", "a\nb # leaksieve:skip-file\n"), ("null.py", "n\n"), ("new.py", "1\n2 leaksieve:allow\n\n3"), ("node_modules/x.py", "q"), ("x.lock", "q"), ("twice.py", "a\n"), ("twice.py", "c\n"), ("empty.py", None)]
    got = {(r.file, r.line_no, r.text, r.ext) for r in compare.added_between(make(old), make(new)).collect()}
    assert got == {("a.py", 2, "new", "py"), ("a.py", 4, "last", "py"), ("end.py", 1, "x", "py"), ("crlf.py", 1, "a", "py"), ("null.py", 1, "n", "py"), ("new.py", 1, "1", "py"), ("new.py", 3, "", "py"), ("new.py", 4, "3", "py")}
    everything = compare.added_between(None, make(new))
    assert {(r.file, r.line_no) for r in everything.where("file = 'same.py'").collect()} == {("same.py", 1), ("same.py", 2)}
    assert compare.added_between(make([]), make(new)).count() == everything.count() and compare.added_between(make(new), make([])).count() == 0


def test_texts_in_rows_are_numbered_without_a_shuffle(spark):
    rng = random.Random(4)
    texts = [some_diff(rng, rng.randint(1, 120)) for _ in range(60)] + [["+++ b/", "+x"], ["+++ b/a\r", "+x", "@@ no start", "+y", "@@ -1 +99999999999 @@", " c", "+z"], ["+lost", "@@ +5", "+lost", "+++ b/a.py", "+k # leaksieve:allow", "+m"], ["+++ b/dist/a.py", "+x", "+++ b/y.lock", "+x"]]
    for end in ("\n", "\r\n"):
        d = spark.createDataFrame([(str(k), end.join(t) + end * (k % 2)) for k, t in enumerate(texts)] + [("none", None), ("empty", "")], "id string, text string")
        rows = lambda f: sorted(tuple(r) for r in f.collect())
        added = diffs.text_added_lines(d, "text", F.col("id"))
        want = {(str(k), f, n, x[1:]) for k, t in enumerate(texts[:60]) for x, f, kind, n, skip in straight(t) if kind == "added" and f and not skip}
        got = rows(added)
        assert {(u, f, n, x) for u, f, _, n, x in got if int(u) < 60} == want and len(want) > 300
        assert got == rows(diffs.added_lines(diffs.diff_rows(d, "text", F.col("id"))))
        assert "Exchange" not in added._jdf.queryExecution().executedPlan().toString()
        assert rows(diffs.text_added_lines(d.union(d))) == rows(diffs.added_lines(diffs.diff_rows(d.union(d))))
    log = spark.createDataFrame([("s", "t", "+++ b/a\n@@ -0,0 +1 @@\n+x\n")], "sha string, subject string, text string")
    assert "Exchange" not in diffs.commit_lines(log)._jdf.queryExecution().executedPlan().toString()
