import json

import pytest

from quarry.plans import code_index, impact

FILES = {
    "service.py": "class UserModel:\n    name = 1\n\n\ndef get_user(i):\n    return find(i)\n\n\ndef find(i):\n    return i\n",
    "routes.py": "from service import get_user\n\n\n@app.get('/u')\ndef show(i):\n    return get_user(i)\n",
    "tests/test_service.py": "from service import find\n\n\ndef test_find():\n    assert find(1) == 1\n",
}
PATCH = "diff --git a/service.py b/service.py\n--- a/service.py\n+++ b/service.py\n@@ -5,2 +5,2 @@\n def get_user(i):\n-    return find(i)\n+    return find(i + 1)\n"


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("patch")
    for path, text in FILES.items():
        (root / path).parent.mkdir(exist_ok=True)
        (root / path).write_text(text)
    index = code_index.build_index(spark, str(root), "r")
    g = code_index.build_graph(index)
    return index, code_index.Graph(g.relationships.cache(), g.diagnostics.cache())


def names(df):
    return {r.qualified_name for r in df.collect()}


def test_patch(built):
    got = impact.analyze(*built, PATCH, expected=["other.py"])
    assert names(got.changed) == {"get_user"} and names(got.callers) == {"show"} and names(got.tests) == set()
    risks = {(r.code, r.relative_path) for r in got.risks.collect()}
    assert risks == {("missing_regression_test", None), ("unrelated_change", "service.py")}
    two = PATCH + "@@ -9,1 +9,1 @@\n-def find(i):\n+def find(j):\n"
    assert ("analysis_truncated", None) in {(r.code, r.relative_path) for r in impact.analyze(*built, two, max_hunks=1).risks.collect()}


def test_contracts_and_tests(built):
    whole = PATCH.replace("@@ -5,2 +5,2 @@", "@@ -1,2 +1,10 @@") + " x\n" * 8
    got = impact.analyze(*built, whole, expected=["service.py"])
    assert {"UserModel", "get_user", "find"} <= names(got.changed) and names(got.schemas) == {"UserModel"} and names(got.tests) == {"test_find"}
    assert "unrelated_change" not in {r.code for r in got.risks.collect()}
    assert impact.analyze(*built, "").changed.count() == 0


def test_commands(tmp_path):
    (tmp_path / "package.json").write_text(json.dumps({"scripts": {"test": "x", "other": "y"}}))
    (tmp_path / "go.mod").write_text("module x")
    assert impact.validation_commands(str(tmp_path)) == ["npm run test", "go test ./...", "go vet ./..."]
