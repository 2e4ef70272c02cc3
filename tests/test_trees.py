"""Ignore rules and the listing of trees."""

import os

import pytest

from leaksieve.sources import ignores, trees
from leaksieve.sources.lines import EXCLUDE_DIRS, EXCLUDE_FILES

#: Ignore files, the paths they are asked about, and which of them are ignored.
CASES = [
    ({"": "*.log\n!keep.log\n/only\nbuild/\n"}, ["a.log", "keep.log", "x/a.log", "x/keep.log", "x/only", "only/f", "build/f", "x/build/f", "x/builds"], ["a.log", "x/a.log", "only/f", "build/f", "x/build/f"]),
    ({"": "a/*/c\ndoc/**/x\n**/t\nd/**\n"}, ["a/b/c", "a/b/d/c", "doc/x", "doc/1/2/x", "t", "q/t/u", "d/e", "z/d/e"], ["a/b/c", "doc/x", "doc/1/2/x", "t", "q/t/u", "d/e"]),
    ({"": "# note\n\n\\#a\n\\!b\nsp\\ \ntrail   \n"}, ["#a", "!b", "sp ", "sp", "trail", "# note"], ["#a", "!b", "sp ", "trail"]),
    ({"": "*.txt\nout/\n", "x": "!a.txt\n/b\n", "out": "!f\n"}, ["a.txt", "x/a.txt", "x/b", "x/y/b", "x/y/a.txt", "out/f", "b"], ["a.txt", "x/b", "out/f"]),
    ({"": "[ab].py\n[!c]?.js\nfile[0-9]\n[]x]\n[open\na+b(c).$\n"}, ["a.py", "c.py", "dd.js", "cd.js", "x/file7", "file77", "]", "x", "[open", "a+b(c).$", "aab(c).$"], ["a.py", "dd.js", "x/file7", "]", "x", "a+b(c).$"]),
    ({"": "*\n!*/\n!*.py\n"}, ["a.py", "a.txt", "x/a.py", "x/y/b.txt"], ["a.txt", "x/y/b.txt"]),
    ({"x": "*\n!keep/\n"}, ["x/a", "x/keep/a", "y/a"], ["x/a", "x/keep/a"]),
    ({"": "été/\n漢*\n"}, ["été/a", "漢字", "a/漢"], ["été/a", "漢字", "a/漢"]),
    ({"": "a\r\nb/\r\n"}, ["a", "b/c", "x/b"], ["a", "b/c"]),
    ({"": "foo/*\n!foo/bar\n"}, ["foo/a", "foo/bar/x", "y/foo/a"], ["foo/a"]),
]


def test_ignore_rules(spark):
    """All cases at once, each in a folder of its own."""
    files, paths, want = [], [], []
    for n, (rules, asked, ignored) in enumerate(CASES):
        at = f"case{n}/"
        files += [(at + (f"{k}/" if k else "") + ".gitignore", v) for k, v in rules.items()]
        paths += [(at + p,) for p in asked]
        want += [at + p for p in ignored]
    rules = ignores.rules_of(spark.createDataFrame(files, "path string, text string"))
    got = [r.path for r in ignores.ignored_paths(spark.createDataFrame(paths, "path string"), rules).collect()]
    assert sorted(got) == sorted(want)


def test_files_left_by_their_own_rules(spark):
    files = [("./.gitignore", "*.log\n"), ("a.log", "x"), ("./b.py", "x"), ("d/.gitignore", "!a.log\n/t\n"), ("d/a.log", "x"), ("d/t", "x"), ("e/.gitignore", None), ("e/t", None)]
    d = spark.createDataFrame([(*f, 1) for f in files], "path string, text string, extra int")
    assert sorted(r.path for r in ignores.without_ignored_files(d).collect()) == ["./.gitignore", "./b.py", "d/.gitignore", "d/a.log", "e/.gitignore", "e/t"]
    more = spark.createDataFrame([(".gitignore", "*.py\n")], "path string, text string")
    assert "./b.py" not in {r.path for r in ignores.without_ignored_files(d, more).collect()}
    assert ignores.without_ignored_files(d.where("false")).count() == 0


def plant(root, files):
    for name, text in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)


FILES = {"x.py": "1", "sub/y z.py": "2", "sub/a+b%20.py": "3", "sub/[q]{1}*?.py": "4", "k=1/z.py": "5", ".env": "6", "build/no.py": "7", "sub/node_modules/no.js": "8", "a.lock": "9", "é/漢.py": "10", "empty.py": "", "_hidden/f.py": "11"}


@pytest.mark.parametrize("above", ["plain", "prework/build", "work", "with space/[a]+b%20", "node_modules/work"])
def test_tree_paths(spark, tmp_path, monkeypatch, above):
    root = tmp_path / above / "work"
    plant(root, FILES)
    want = {n: t for n, t in FILES.items() if not n.startswith("build/") and "node_modules" not in n and n != "a.lock"}
    (root / "link.py").symlink_to(root / "x.py")
    (root / "loop").symlink_to(root, target_is_directory=True)
    (root / "broken").symlink_to(root / "none")
    read = lambda path: {r.path: r.text for r in trees.read_tree(spark, path, EXCLUDE_DIRS, EXCLUDE_FILES).collect()}
    assert read(str(root)) == read(str(root) + "/") == want
    assert {r.path: r.text for r in trees.read_tree(spark, str(root)).collect()} == FILES


def test_relative_root_and_none(spark, tmp_path):
    root = os.path.relpath(tmp_path / "w")
    plant(tmp_path / "w", {"build/x.py": "1", "y/w/y.py": "2"})
    assert {r.path for r in trees.read_tree(spark, root).collect()} == {"build/x.py", "y/w/y.py"}
    assert trees.read_tree(spark, str(tmp_path / "none")).count() == 0


def test_excluded_folders_are_never_listed(spark, tmp_path, monkeypatch):
    plant(tmp_path, {f"target/{n}/f.py": "" for n in range(200)} | {f"src/{n}/f.py": "" for n in range(30)})
    listed = []
    real = trees.Store.names
    monkeypatch.setattr(trees.Store, "names", lambda self, folder: listed.append(folder.getName()) or real(self, folder))
    assert len(trees.list_tree(spark, str(tmp_path), ("target",))) == 30
    assert "target" not in listed and len(listed) == 32
