"""An updated graph and its postings equal those of a fresh build, whatever changed."""

import pytest

from quarry.plans import code_index

TREE = {
    "base.py": "class Base:\n    def run(self, value):\n        return value\n",
    "service.py": "from base import Base\n\n\nclass Service(Base):\n    def run(self, value):\n        return help_it(value)\n\n\ndef help_it(value):\n    return value\n",
    "tests/test_service.py": "from service import Service\n\n\ndef test_service():\n    service = Service()\n    assert service.run(1)\n",
    "api/client.ts": "export function fetchUser(id: string) { return id; }\n",
    "api/index.ts": "export { fetchUser } from './client';\n",
    "api/consumer.ts": "import { fetchUser } from './index';\nexport function useUser(id: string) { return fetchUser(id); }\n",
    "load.py": "import os\n\n\ndef load_url():\n    return os.getenv('API_URL')\n",
    "caller.py": "def call_it():\n    shared()\n    nowhere()\n",
    "first.py": "def shared():\n    pass\n",
}
#: Each step's files: a text, or None for a deletion.
STEPS = [
    {"second.py": "def shared():\n    pass\n", "settings.py": "API_URL = 'x'\n", "base.py": "class Base:\n    def run(self, value, more):\n        return value\n", "api/client.ts": "export function fetchAll(id: string) { return id; }\n", "api/other.ts": "export function fetchUser(id: string) { return id; }\n"},
    {"second.py": None, "base.py": None, "api/index.ts": "export { fetchUser } from './other';\n", "caller.py": b"\xff\xfe"},
]


def lay(root, files):
    for path, text in files.items():
        at = root / path
        if text is None:
            at.unlink()
        else:
            at.parent.mkdir(parents=True, exist_ok=True)
            at.write_bytes(text if isinstance(text, bytes) else text.encode())


def rows(df, *drop):
    return sorted(map(str, df.drop(*drop).collect()))


def test_updates_equal_a_fresh_build(spark, tmp_path):
    lay(tmp_path, TREE)
    index = code_index.build_index(spark, str(tmp_path), "r")
    index.postings = code_index.postings_of(index.documents)
    graph = code_index.build_graph(index)
    same, n = code_index.refresh_graph(graph, index, *code_index.update_index(spark, str(tmp_path), index))
    assert n == 0 and same is graph
    for step in STEPS:
        lay(tmp_path, step)
        after, change = code_index.update_index(spark, str(tmp_path), index)
        graph, n = code_index.refresh_graph(graph, index, after, change)
        index = after
        whole = code_index.build_graph(index)
        assert rows(graph.relationships) == rows(whole.relationships)
        assert rows(graph.diagnostics) == rows(whole.diagnostics)
        assert rows(index.postings) == rows(code_index.postings_of(index.documents))
        assert 0 < n < index.facts.count()


def test_unreadable_folder_protects_its_files(spark, tmp_path, monkeypatch):
    from quarry.sources import scan

    lay(tmp_path, {"kept/a.py": "A = 1\n", "gone/b.py": "B = 1\n"})
    index = code_index.build_index(spark, str(tmp_path), "r")
    lay(tmp_path, {"kept/a.py": None, "gone/b.py": None, "c.py": "C = 1\n"})
    listed = scan.list_tree
    monkeypatch.setattr(scan, "list_tree", lambda root: sorted([*listed(root), ("kept", 0, 0.0, "unreadable")]))
    index, change = code_index.update_index(spark, str(tmp_path), index)
    assert {r.path: r.change for r in change.collect()} == {"kept/a.py": "protected", "gone/b.py": "deleted", "c.py": "new"}
    assert {r.name for r in index.symbols.collect()} == {"A", "C"}


@pytest.mark.parametrize("issue", ["size", "time"])
def test_file_that_changes_during_the_scan_is_an_issue(spark, tmp_path, monkeypatch, issue):
    from quarry.sources import scan

    lay(tmp_path, {"a.py": "A = 1\n"})
    listed = scan.list_tree(str(tmp_path))
    monkeypatch.setattr(scan, "list_tree", lambda root: [(p, n + (issue == "size"), t - (issue == "time"), s) for p, n, t, s in listed])
    assert [(r.relative_path, r.skip) for r in scan.scan(spark, str(tmp_path)).collect()] == [("a.py", "changed_during_scan")]
