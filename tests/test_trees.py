import os

import pytest

from corpusloom.operators.extract import SKIPPED_FOLDERS
from corpusloom.sources import readers, trees


def tree(root):
    for name in ("x.js", "pages/_app.tsx", ".github/a.json", "a/b/c/d/deep.TS", "a/build/y.js", "node_modules/b/z.ts", "a/node_modules/z.ts", "builds/k.vue", "q.py", "a/vendor.js"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(f"at {name}")
    (root / "big.js").write_bytes(b"x" * 1_000_001)
    (root / "limit.js").write_bytes(b"x" * 1_000_000)
    (root / "bad.html").write_bytes(b"ok \xff\xfe<")
    (root / "empty.js").write_bytes(b"")
    (root / "hollow").mkdir()
    return str(root)


def test_skipped_folders_are_never_opened(spark, tmp_path):
    root = tree(tmp_path / "t")

    def careful(folder):
        if any(f"/{name}" in folder[len(root) :] + "/" and f"/{name}/" in folder[len(root) :] + "/" for name in SKIPPED_FOLDERS):
            raise AssertionError(f"opened {folder}")
        return trees.entries(folder)

    rows = trees.source_tree(spark, root, lister=careful).collect()
    want = {n: f"at {n}" for n in ("x.js", "pages/_app.tsx", ".github/a.json", "a/b/c/d/deep.TS", "builds/k.vue", "a/vendor.js")}
    assert {r.path: r.text for r in rows} == {**want, "limit.js": "x" * 1_000_000, "bad.html": "ok <", "empty.js": ""} and len(rows) == 9
    with pytest.raises(Exception, match="opened .*node_modules"):
        trees.walk(spark, root, skipped=("build",), lister=careful).count()


def test_walk_equals_a_plain_walk(spark, tmp_path):
    root = tree(tmp_path / "t")
    os.symlink(root, tmp_path / "t/a/loop")
    os.symlink(tmp_path / "nowhere", tmp_path / "t/a/dead.js")
    os.symlink(tmp_path / "t/x.js", tmp_path / "t/a/link.js")
    want = set()
    for at, folders, files in os.walk(root):
        inner = os.path.relpath(at, root)
        path = lambda name: name if inner == "." else f"{inner}/{name}"
        want |= {(path(f), True) for f in folders if not os.path.islink(f"{at}/{f}")} | {(path(f), False) for f in files if os.path.exists(f"{at}/{f}")}
        folders[:] = [f for f in folders if f not in SKIPPED_FOLDERS]
    for given in (root, root + "/", "file:" + root):
        got = trees.walk(spark, given).collect()
        assert {(r.path, r.folder) for r in got} == want and len(got) == len(want)


def test_roots(spark, tmp_path):
    (tmp_path / "build").mkdir()
    (tmp_path / "build/x.js").write_text("in")
    assert [tuple(r) for r in readers.source_tree(spark, str(tmp_path / "build")).collect()] == [("x.js", "in")]
    (tmp_path / "none").mkdir()
    assert readers.source_tree(spark, str(tmp_path / "none")).count() == 0
    assert [r.path for r in readers.listed_tree(spark, str(tmp_path / "build")).collect()] == ["x.js"]
    for missing in ("nowhere", "build/x.js"):
        with pytest.raises(FileNotFoundError):
            readers.source_tree(spark, str(tmp_path / missing))


def test_a_file_that_goes(spark, tmp_path):
    (tmp_path / "a.js").write_text("a")
    (tmp_path / "b.js").write_text("b")
    ghost = lambda folder: [*trees.entries(folder), ("gone.js", 3, False)]
    assert sorted(r.path for r in trees.source_tree(spark, str(tmp_path), lister=ghost).collect()) == ["a.js", "b.js"]
