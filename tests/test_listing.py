"""Listing by the executors, without pruned folders."""

import os
import sys

from pyspark import cloudpickle

from grainsieve.functions.paths import PRUNED_VENDORED_DIRS, source_glob
from grainsieve.sources import listing
from grainsieve.sources.corpus import scan_files
from grainsieve.sources.listing import glob_names, list_tree


def tree(base):
    texts = {"a.js": "x", "b.TXT": "note", "src/c.py": "y = 1", "src/deep/er/d.ts": "z", "src/node_modules/m.js": "no", "node_modules/p/q.js": "no", "dist/e.js": "no",
             "src/big.js": "b" * 5000, "src/my dir/ü #%.js": "odd", "empty/.keep": "", "src/distance/f.js": "near"}
    for name, text in texts.items():
        os.makedirs(os.path.dirname(f"{base}/{name}"), exist_ok=True)
        with open(f"{base}/{name}", "w") as file:
            file.write(text)
    return texts


def test_pruned_folders_are_never_listed(spark, tmp_path):
    texts = tree(tmp_path)
    os.symlink(tmp_path / "src", tmp_path / "loop")
    # a listing of a pruned folder would show: each one leads into a folder that lists nothing but itself
    for name in ("node_modules", "src/node_modules", "dist"):
        os.symlink("/proc/self/task", tmp_path / name / "endless")
    listed = {r.path.removeprefix(f"{tmp_path}/"): r["size"] for r in list_tree(spark, str(tmp_path), PRUNED_VENDORED_DIRS).collect()}
    want = {n: len(t.encode()) for n, t in texts.items() if not any(f"/{p}/" in f"/{n}" for p in PRUNED_VENDORED_DIRS)}
    assert listed == want and len(want) == 8
    small = {r.path.removeprefix(f"{tmp_path}/") for r in list_tree(spark, f"{tmp_path}/", PRUNED_VENDORED_DIRS, "*.{js,[tT][xX][tT]}", 100).collect()}
    assert small == {"a.js", "b.TXT", "src/my dir/ü #%.js", "src/distance/f.js"}
    assert list_tree(spark, str(tmp_path / "none")).count() == 0


def test_scanned_files(spark, tmp_path):
    tree(tmp_path)
    with open(tmp_path / "src" / "bad.js", "wb") as file:
        file.write(b"ok \xff end")
    rows = {r.rel_path: r for r in scan_files(spark, str(tmp_path), source_glob()).collect()}
    assert set(rows) == {"a.js", "src/c.py", "src/deep/er/d.ts", "src/big.js", "src/my dir/ü #%.js", "src/distance/f.js", "src/bad.js"}
    assert rows["src/c.py"].language == "python" and rows["src/c.py"].content == "y = 1" and rows["src/big.js"]["size"] == 5000
    assert rows["src/bad.js"].content.startswith("ok ") and rows["src/bad.js"].content.endswith(" end")
    assert "src/node_modules/m.js" in {r.rel_path for r in scan_files(spark, str(tmp_path), prune=()).collect()}


def test_globs():
    assert glob_names(None) is None and glob_names("*.js") == ["*.js"] and glob_names("*.{a,b}{1,2}") == ["*.a1", "*.a2", "*.b1", "*.b2"]


def test_listing_stops_at_pruned_names(spark, tmp_path, monkeypatch):
    """Each folder that a task lists leaves a mark; none lies below a pruned one."""
    tree(tmp_path)
    marks = tmp_path / "marks"
    marks.mkdir()
    real = listing.list_folder

    def marked(path):
        (marks / path.replace("/", "~")).write_text("")
        return real(path)

    monkeypatch.setitem(listing.list_tree.__globals__, "list_folder", marked)
    module = sys.modules["grainsieve.sources.listing"]
    cloudpickle.register_pickle_by_value(module)
    try:
        listing.list_tree(spark, str(tmp_path), PRUNED_VENDORED_DIRS).count()
    finally:
        cloudpickle.unregister_pickle_by_value(module)
    seen = sorted(p.name.replace("~", "/").removeprefix(str(tmp_path)) for p in marks.iterdir())
    assert "/src/deep/er" in seen and not [p for p in seen if "node_modules" in p or "/dist" in p and "distance" not in p]
