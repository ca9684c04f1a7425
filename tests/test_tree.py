"""Trees of many files: listed and read by tasks, and read once."""

import os
import shutil
import zipfile

import pytest

from lodestar.plans import corpus
from lodestar.sources import archive, catalog, files


@pytest.fixture()
def root(tmp_path):
    for i in range(40):
        place = tmp_path / "versions" / "v1" / f"m{i % 3}" / ("deep/er" if i % 2 else "")
        place.mkdir(parents=True, exist_ok=True)
        (place / f"File{i:02d}.plsql").write_text(f"PROCEDURE P{i} IS\n   File{(i + 1) % 40:02d}_API.Get(x_);\n")
    (tmp_path / "versions" / "v1" / "_Hidden.plsql").write_text("x")
    (tmp_path / "versions" / "v1" / "m0" / "notes.txt").write_text("x")
    os.symlink(tmp_path / "nowhere", tmp_path / "versions" / "v1" / "Gone.plsql")
    return str(tmp_path / "versions" / "v1")


def test_tree_is_listed_by_tasks(spark, root):
    tree = files.source_tree(spark, root)
    assert "binaryFile" not in tree._jdf.queryExecution().optimizedPlan().toString()  # whose listing the driver holds
    want = sorted(os.path.relpath(os.path.join(f, n), root) for f, _, names in os.walk(root) for n in names if n.endswith(".plsql") and n != "Gone.plsql")
    rows = tree.collect()
    assert sorted(r.relative_path for r in rows) == want and len(want) == 41
    assert all(r.file_path == f"file:{root}/{r.relative_path}" and r.content == open(f"{root}/{r.relative_path}").read() for r in rows)
    assert [r.relative_path for r in files.source_tree(spark, root, max_files=7).collect()] == want[:7]
    sizes = {r.path: r.size for r in files.file_listing(spark, root).collect()}
    assert len(sizes) == 42 and sizes[f"file:{root}/m0/notes.txt"] == 1
    with pytest.raises(ValueError, match="no \\*.plsql file"):
        files.source_tree(spark, f"{root}/none")


def test_analysis_reads_the_tree_once(spark, root):
    info, edges = corpus.analyse(spark, root)
    shutil.rmtree(root)
    assert info.count() == 41 and edges.count() == 40


def test_files_of_versions_are_counted_by_tasks(spark, root, monkeypatch):
    def walk(*_):
        raise AssertionError("the driver walks a version's folder")

    monkeypatch.setattr(os, "walk", walk)
    data = root.removesuffix("/versions/v1")
    assert [(r.version, r.file_count) for r in catalog.version_table(spark, data).collect()] == [("v1", 41)]
    assert [s.file_count for s in catalog.versions(data)] == [42]  # the driver counts names, with that of the broken link
    assert catalog.version_table(spark, f"{data}/none").collect() == []


def test_directory_is_walked_in_pieces(tmp_path, monkeypatch):
    path = str(tmp_path / "a.zip")
    with zipfile.ZipFile(path, "w") as z:
        for i in range(300):
            z.writestr(f"checkout/m{i % 7}/F{'x' * (i % 50)}{i}.plsql", "x" * i)
        z.writestr(files.VERSION_MEMBER, "# no\n\n 24.2.1 build 7\n")
        want = [(e.filename, e.file_size, e.header_offset) for e in z.infolist()]
    file, size = archive.opened(path)
    with file:
        begin, end, shift = archive.directory_place(file, size)
        for piece in (64, 200, 1 << 20):
            found = list(archive.entries(file, begin, end, shift, piece))
            assert [(e.name, e.size, e.offset) for _, _, e in found] == want and found[-1][1] == end
        with pytest.raises(ValueError, match="damaged"):
            list(archive.entries(file, begin + 1, end, shift))

    def whole(*_):
        raise AssertionError("the driver reads a whole directory")

    monkeypatch.setattr(zipfile, "ZipFile", whole)
    assert files.archive_version(path) == "24.2.1"
