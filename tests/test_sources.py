import os
import subprocess

import pytest
from pyspark.sql import functions as F

from lantern.functions import languages
from lantern.sources import files, ignore

#: Lines of an ignore file, and files; both in words.
CASES = [
    ("*.log", "one.log two.py sub/three.log sub/four.py"),
    ("*.log !keep.log", "one.log keep.log two.py"),
    ("build/", "build/in.py out.py"),
    ("**/gen/", "gen/in.py sub/gen/deep.py out.py"),
    ("sub/*.py", "sub/in.py sub/deep/out.py other/out.py"),
    ("#comment *.tmp", "one.tmp two.py"),
    ("*.py !sub/keep.py", "one.py sub/keep.py sub/deep/two.py"),
    ("/top.py a?c.py [xy].py docs/**", "top.py sub/top.py abc.py ac.py x.py z.py docs/a.py docs/b/c.py"),
    (r"sub/**/z.py \#odd.py", "sub/z.py sub/a/b/z.py #odd.py z.py"),
]
WANTED = ".log .py .tmp".split()


def git(*args):
    return subprocess.run(["git", *map(str, args)], check=True, text=True, capture_output=True).stdout


def make(root, names, text="x\n"):
    for n in names:
        p = root / n
        os.makedirs(p.parent, exist_ok=True)
        p.write_text(text)


@pytest.mark.parametrize("lines,names", CASES)
def test_rules_as_git(spark, tmp_path, lines, names):
    lines, names = [*lines.split(), "", "trail.py   "], [*names.split(), "trail.py"]
    git("init", tmp_path)
    make(tmp_path, names)
    ignore_file = tmp_path / ".gitignore"
    ignore_file.write_text("".join(x + "\n" for x in lines))
    out = git("-C", tmp_path, *"ls-files -z --cached --others --exclude-standard".split())
    # The folder names that are never indexed are ours, not git's.
    want = sorted(x for x in out.split("\0") if x and x != ".gitignore" and not x.startswith("build/"))
    assert sorted(os.path.relpath(p, os.path.realpath(tmp_path)) for p in files.walk(os.path.realpath(tmp_path), WANTED)) == want
    table = spark.createDataFrame([(n,) for n in names], "path string")
    own = ignore.rules(list(ignore.DEFAULT_DIRS)) + ignore.rules(lines)
    assert sorted(r["path"] for r in table.where(ignore.selected(F.col("path"), own, WANTED)).collect()) == want


def walked(spark, root):
    return sorted(r["path"] for r in files.walk_files(spark, str(root), [".py", ".log"]).collect())


def test_walk(spark, tmp_path):
    tree = tmp_path / "a"
    make(tree, ["src/main.py", "src/gen/x.py", "node_modules/m.py", ".venv/v.py", "dist/d.py", "b.log", "pkg/__init__.py", "pkg/_hidden.py", "p/q/r/s/t/deep.py"])
    (tree / "src/.gitignore").write_text("gen/\n")
    (tree / ".indexignore").write_text("*.log")
    os.symlink(tree / "src/main.py", tree / "link.py")
    os.symlink(tree / "src", tree / "linked")
    assert walked(spark, tree) == ["p/q/r/s/t/deep.py", "pkg/__init__.py", "pkg/_hidden.py", "src/main.py"]
    assert walked(spark, tmp_path / "nothing") == []


def test_rules_above_the_root(spark, tmp_path):
    """Ignore files from the repository's root down apply, those above it don't; nearer ones win; a negation by name takes any suffix back."""
    make(tmp_path, ["r/backend/api/main.py", "r/backend/api/gen.py", "r/backend/api/x.log", "r/backend/api/important.log", "r/backend/api/skip.py", "r/backend/api/note.xyz"])
    (tmp_path / ".gitignore").write_text("main.py\n")
    git("init", tmp_path / "r")
    (tmp_path / "r/.gitignore").write_text("*.log\n*.xyz\n")
    (tmp_path / "r/backend/.gitignore").write_text("gen.py\n")
    (tmp_path / "r/backend/api/.gitignore").write_text("!important.log\n!note.xyz\n")
    (tmp_path / "r/.git/info/exclude").write_text("skip.py\n")
    assert walked(spark, tmp_path / "r/backend/api") == ["important.log", "main.py", "note.xyz"]


def test_read_files(spark, tmp_path):
    make(tmp_path, ["a.py", "b.md", "big.py"])
    (tmp_path / "a.py").write_bytes(b"x = '\xff'\n")
    (tmp_path / "big.py").write_text("#" * 1_000_001)
    got = {r["path"]: r for r in files.read_files(spark, str(tmp_path)).collect()}
    assert list(got) == ["a.py"] and got["a.py"]["text"] == "x = '�'\n" and got["a.py"]["language"] == "python" and got["a.py"]["error"] is None
    assert {r["path"] for r in files.read_files(spark, str(tmp_path), include_text=True).collect()} == {"a.py", "b.md"}
    assert files.ensure_ignored(str(tmp_path)) is False
    (tmp_path / ".gitignore").write_text("x")
    assert files.ensure_ignored(str(tmp_path)) and not files.ensure_ignored(str(tmp_path)) and (tmp_path / ".gitignore").read_text() == "x\n.lantern/\n"
    (tmp_path / "lines.txt").write_text("one\n\n  \ntwo\n")
    assert [r["text"] for r in files.text_lines(spark, str(tmp_path / "lines.txt")).collect()] == ["one", "two"]


def test_languages(spark):
    names = {"a.py": "python", "x/b.TSX": "tsx", "Makefile": None, ".bashrc": None, "a.b.Md": "markdown", "q.R": "r", "dot.": None, "..py": "python", "x.unknown": None}
    assert {n: languages.detect_language(n) for n in names} == names
    rows = spark.createDataFrame([(n,) for n in names], "p string").select("p", languages.language(F.col("p")).alias("l")).collect()
    assert {r["p"]: r["l"] for r in rows} == names
    assert len(languages.LANGUAGES) == 104 and ".md" not in languages.extensions() and ".md" in languages.extensions(True)
