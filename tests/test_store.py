"""Kept indexes: builds, no-ops, failures and removal, by the command line that a user has."""

import json
import subprocess

from quarry import cli
from quarry.plans import code_index, store


def call(capsys, home, *words):
    code = cli.main(["--home", str(home), *words])
    return code, json.loads(capsys.readouterr().out.strip().splitlines()[-1])


def git(root, *words):
    subprocess.run(["git", "-c", "user.name=a", "-c", "user.email=a@b", *words], cwd=root, check=True, capture_output=True)


def test_commands(spark, tmp_path, capsys, monkeypatch):
    home, root = tmp_path / "home", tmp_path / "tree"
    root.mkdir()
    (root / "billing.py").write_text("def tally(items):\n    return sum(items)\n\n\ndef total(items):\n    return tally(items)\n")
    (root / "test_billing.py").write_text("from billing import tally\n\n\ndef test_tally():\n    assert tally([1]) == 1\n")
    git(root, "init", "-q")
    git(root, "add", ".")
    git(root, "commit", "-qm", "a")
    assert call(capsys, home, "repo", "list") == (5, {"error": "database_not_initialized", "message": f"{home}: run init first"})
    assert call(capsys, home, "init")[0] == 0
    assert call(capsys, home, "search", "tally")[1]["error"] == "repository_not_found"
    own = call(capsys, home, "repo", "add", str(root))[1]
    assert own["active"] and call(capsys, home, "repo", "list")[1] == [own]
    assert call(capsys, home, "search", "tally")[1]["error"] == "database_not_initialized"

    built = call(capsys, home, "index", "build")[1]
    assert (built["parsed"], built["generation"], built["files"]) == (2, 1, 2) and built["relationships"] > 0
    again = call(capsys, home, "index", "build")[1]
    assert (again["parsed"], again["refreshed_facts"], again["generation"]) == (0, 0, 1) and again["relationships"] == built["relationships"]
    assert call(capsys, home, "search", "tally")[1][0]["qualified_name"] == "tally"
    near = call(capsys, home, "graph", "neighbors", "tally", "--direction", "incoming", "--kind", "calls")[1]
    assert {n["qualified_name"] for n in near["nodes"]} == {"tally", "total", "test_tally"}
    assert call(capsys, home, "graph", "neighbors", "tally", "--kind", "no such")[1]["error"] == "graph_query_invalid"

    (root / "billing.py").write_text("def tally(items):\n    return sum(items) + 1\n\n\ndef total(items):\n    return tally(items)\n")
    stale = call(capsys, home, "context", "resolve", "Fix the rounding bug in tally")[1]
    assert stale["next_action"] == "refresh_index" and "index_stale" in [d["code"] for d in stale["diagnostics"]]
    assert [s["relative_path"] for s in stale["snippets"] if s["role"] == "git_diff"] == ["billing.py"]
    seen = [s["content_hash"] for s in stale["snippets"]]
    assert not call(capsys, home, "context", "expand", "Fix the rounding bug in tally", "--no-diff", "--known", seen[0], *[w for h in seen for w in ("--known", h)])[1]["snippets"]
    assert "missing_regression_test" not in [r["code"] for r in call(capsys, home, "impact", "analyze")[1]["risks"]]

    kept = store.Store(spark, f"file://{home}/store")
    monkeypatch.setattr(code_index, "refresh_graph", lambda *_: 1 / 0)
    try:
        kept.build(own["id"], str(root))
    except ZeroDivisionError:
        pass
    monkeypatch.undo()
    status = call(capsys, home, "index", "status")[1]
    assert status["generation"] == 1 and status["last_run"]["state"] == "failed" and status["files"] == 2
    third = call(capsys, home, "index", "build")[1]
    assert third["parsed"] == 1 and third["generation"] == 4 and 0 < third["refreshed_facts"] <= third["facts"]
    assert [(r.generation, r.state) for r in kept.last_runs(own["id"]).orderBy("generation").collect()] == [(1, "ready"), (2, "unchanged"), (3, "failed"), (4, "ready")]
    assert call(capsys, home, "repo", "remove", own["id"])[1] == {"removed": own["id"]}
    assert kept.generation(own["id"]) is None and call(capsys, home, "repo", "list")[1] == []
