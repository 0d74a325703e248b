from quarry.plans import code_index


def names(index):
    return {r.qualified_name for r in index.symbols.collect()}


def test_lifecycle_of_a_tree(spark, tmp_path):
    """Add, no-op, rename, unreadable file, repair, deletion."""
    (tmp_path / "a.py").write_text("class Service:\n    def run(self):\n        pass\n")
    (tmp_path / "b.py").write_text("def other():\n    pass\n")
    index = code_index.build_index(spark, str(tmp_path), "r")
    assert names(index) == {"Service", "Service.run", "other"}
    index, change = code_index.update_index(spark, str(tmp_path), index)
    assert {r.change for r in change.collect()} == {"unchanged"} and names(index) == {"Service", "Service.run", "other"}
    (tmp_path / "a.py").write_text("class Renamed:\n    pass\n")
    (tmp_path / "c.py").write_text("C = 1\n")
    index, change = code_index.update_index(spark, str(tmp_path), index)
    assert {r.path: r.change for r in change.collect()} == {"a.py": "changed", "b.py": "unchanged", "c.py": "new"} and names(index) == {"Renamed", "other", "C"}
    (tmp_path / "a.py").write_bytes(b"\xff\xfe broken")
    index, _ = code_index.update_index(spark, str(tmp_path), index)
    assert names(index) == {"Renamed", "other", "C"} and {r.relative_path: r.parse_status for r in index.files.collect()}["a.py"] == "stale"
    (tmp_path / "a.py").write_text("class Repaired:\n    pass\n")
    (tmp_path / "b.py").unlink()
    index, change = code_index.update_index(spark, str(tmp_path), index)
    assert names(index) == {"Repaired", "C"} and {r.path: r.change for r in change.collect()}["b.py"] == "deleted"
    assert {r.relative_path for r in index.documents.select("relative_path").distinct().collect()} == {"a.py", "c.py"}
