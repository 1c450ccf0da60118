import json
import os
import subprocess

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.sources import config, gitdiff, markdown, tensors, walk


@pytest.mark.parametrize(
    "pattern, path, hit",
    [("logs/", "logs/a.ts", True), ("logs/", "src/logs.ts", False), ("!a.ts", "a.ts", False), ("*.spec.ts", "src/x.spec.ts", True), ("/a.ts", "src/a.ts", True), ("src/*.ts", "src/a.ts", True),
     ("src/*.ts", "src/b/a.ts", False), ("tmp", "src/tmp/a.ts", True), ("src/gen", "src/gen/a.ts", True), ("a.ts", "a.ts", True), ("a?.ts", "x/ab.ts", True)],
)
def test_ignore(spark, pattern, path, hit):
    df = spark.createDataFrame([(path,)], "p string")
    assert df.select(walk.ignored(F.col("p"), [pattern]).alias("x")).first().x is hit


def test_scan(spark, tmp_path):
    files = {"src/a.ts": "x", "src/b.tsx": "y", "node_modules/c.ts": "z", "README.md": "r", "big.go": "g" * (1 << 20) + "g", "edge.go": "g" * (1 << 20), "skip/d.py": "d", "src/UP.GO": "u", "src/_gen/e.py": "e", ".hidden/_f.go": "f", "src/_g.ts": "g", ".git/h.go": "h"}
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / ".gitignore").write_text("# none\n\nskip/\n")
    rows = {r.path: r for r in walk.scan(spark, str(tmp_path), "r", with_content=False).collect()}
    assert set(rows) == {"src/a.ts", "src/b.tsx", "edge.go", "src/_gen/e.py", ".hidden/_f.go", "src/_g.ts"}
    named = walk.read_files(spark, str(tmp_path), "r", spark.createDataFrame([("src/a.ts",), ("src/a.ts",), ("edge.go",)], "path string")).collect()
    assert {(r.path, r.content_hash) for r in named} == {(p, rows[p].content_hash) for p in ("src/a.ts", "edge.go")} and len(named) == 2
    assert {r.path for r in walk.listing(spark, str(tmp_path)).collect()} == set(rows) and walk.skipped(spark, str(tmp_path)) == 3
    assert rows["src/a.ts"].content_hash == "2d711642b726b04401627ca9fbac32f5c8530fb1903cc4db02258717921a4881" and rows["src/b.tsx"].language == "tsx"


def test_sections(spark):
    texts = [(1, "intro\n\n## One\na\n### deep\nb\n## Two"), (2, " \n "), (3, None), (4, "## Only\n"), (5, "no heading")]
    texts += [(6, "## \n## \nx\n## B"), (7, "\n## A\n\n"), (8, "##no\n ## no")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = [(r.doc_id, r.position, r.title, r.content) for r in markdown.sections(df).orderBy("doc_id", "position").collect()]
    assert got == [(1, 0, "", "intro"), (1, 1, "One", "a\n### deep\nb"), (1, 2, "Two", ""), (4, 0, "Only", ""), (5, 0, "", "no heading"),
                   (6, 0, "", "x"), (6, 1, "B", ""), (7, 0, "", ""), (7, 1, "A", ""), (8, 0, "", "##no\n ## no")]


def _raw(*records):
    return "".join(f":100644 100644 abc1234 0000000 {status}\x00" + "".join(f"{p}\x00" for p in paths) for status, *paths in records)


def test_name_status_and_hunks(spark):
    patch = (
        "diff --git a/a.go b/a.go\nindex 1..2 100644\n--- a/a.go\n+++ b/a.go\n@@ -1,2 +3,4 @@ f\n+x\n+++ b/liar.go\r@@ -1 +77 @@\n@@ -9 +8 @@\n+@@ -1 +99 @@\n@@ -5,3 +4,0 @@\n-y\n"
        "diff --git a/gone.go b/gone.go\ndeleted file mode 100644\n--- a/gone.go\n+++ /dev/null\n@@ -1,3 +0,0 @@\n-+++ b/other.go\n"
        "diff --git a/old.go b/new name.go\nsimilarity index 90%\nrename from old.go\nrename to new name.go\n--- a/old.go\n+++ b/new name.go\n@@ -2 +2 @@\n+z\n"
    )
    text = _raw(("M", "a.go"), ("D", "gone.go"), ("R090", "old.go", "new name.go"), ("M", "mode.sh")) + "\x00" + patch
    diffs = spark.createDataFrame([("r", text), ("q", _raw(("A", "a.go")) + "\x00" + "diff --git a/a.go b/a.go\n--- /dev/null\n+++ b/a.go\n@@ -0,0 +1,9 @@\n+a"), ("none", ""), ("null", None)], "repo_name string, text string")
    assert {tuple(r) for r in gitdiff.name_status(diffs).collect()} == {("r", "a.go", "M"), ("r", "gone.go", "D"), ("r", "new name.go", "R090"), ("r", "mode.sh", "M"), ("q", "a.go", "A")}
    assert {tuple(r) for r in gitdiff.hunks(diffs).collect()} == {("r", "a.go", 3, 4), ("r", "a.go", 8, 1), ("r", "new name.go", 2, 1), ("q", "a.go", 1, 9)}
    files, _ = gitdiff.combined(diffs)
    assert {tuple(r) for r in files.collect()} == {("r", "a.go", "M"), ("r", "gone.go", "D"), ("r", "new name.go", "R090"), ("q", "a.go", "A")}


def test_diff_tables(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    git("init", "-q")
    (tmp_path / "a.py").write_text("one\ntwo\nthree\n")
    (tmp_path / "b.py").write_text("b\n")
    (tmp_path / "moved.py").write_text("".join(f"line {i}\n" for i in range(30)))
    git("add", "-A")
    git("commit", "-qm", "x")
    (tmp_path / "a.py").write_text("one\nTWO\nthree\nfour\n")
    os.unlink(tmp_path / "b.py")
    (tmp_path / "nëw file.py").write_text("n\n")
    git("mv", "moved.py", "über.py")
    (tmp_path / "über.py").write_text("".join(f"line {i}\n" for i in range(29)) + "last\n")
    files, hunks = gitdiff.diff_tables(spark, str(tmp_path), "r")
    assert {tuple(r)[1:] for r in files.collect()} == {("a.py", "M"), ("b.py", "D"), ("über.py", "R096")} or {r.file_path for r in files.collect()} == {"a.py", "b.py", "über.py"}
    assert {tuple(r) for r in hunks.collect()} == {("r", "a.py", 2, 1), ("r", "a.py", 4, 1), ("r", "über.py", 30, 1)}
    assert {r.file_path: r.status[0] for r in gitdiff.changed_files(spark, str(tmp_path), "r").collect()} == {"a.py": "M", "b.py": "D", "über.py": "R", "nëw file.py": "A"}
    assert {r.file_path for r in gitdiff.changed_files(spark, str(tmp_path), "r", staged=False).collect()} == {"nëw file.py"}
    assert gitdiff.diff_tables(spark, str(tmp_path / "none"), "r")[0].count() == 0


def _file(head, body=b""):
    text = json.dumps(head).encode()
    return len(text).to_bytes(8, "little") + text + body


def test_tensors():
    half = np.array([0x0000, 0x8000, 0x7C00, 0x7C01, 0x0001], "<u2").tobytes()
    data = _file({"__metadata__": {}, "h": {"dtype": "F16", "shape": [5], "data_offsets": [0, 10]}, "f": {"dtype": "F32", "shape": [1, 2], "data_offsets": [10, 18]}, "i": {"dtype": "I8", "shape": [1], "data_offsets": [0, 1]}, "w": {"dtype": "F32", "shape": [9], "data_offsets": [0, 4]}}, half + np.array([1.5, -2], "<f4").tobytes())
    t = tensors.read_tensors(data)
    h = tensors.float_tensor(t, "h")
    assert h[0] == 0 and np.signbit(h[1]) and np.isinf(h[2]) and np.isnan(h[3]) and 0 < h[4] < 1e-7
    assert tensors.float_tensor(t, "f").tolist() == [[1.5, -2.0]]
    for name in ("i", "w"):
        with pytest.raises(ValueError):
            tensors.float_tensor(t, name)
    for bad in (b"", (1 << 40).to_bytes(8, "little") + b"x", _file({"a": {"dtype": "F32", "shape": [1], "data_offsets": [0, 4]}})):
        with pytest.raises(ValueError):
            tensors.read_tensors(bad)


def test_config(tmp_path, monkeypatch):
    path = tmp_path / "c.yaml"
    path.write_text("repo_name: mine  # yes\ntools: [ping, x]\nunknown: 1\ndebounce_ms: 7\n")
    monkeypatch.setenv("QUARRY_LOG_LEVEL", "debug")
    c = config.load(str(path))
    assert (c.repo_name, c.tools, c.debounce_ms, c.log_level, c.project_root) == ("mine", ("ping", "x"), 7, "debug", ".")
    with pytest.raises(FileNotFoundError):
        config.load(str(tmp_path / "none.yaml"))
