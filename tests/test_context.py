import pytest

from quarry.plans import code_index, context

FILES = {
    "billing.py": "class Invoice:\n    def total(self, items):\n        return tally(items)\n\n\ndef tally(items):\n    return sum(items)\n",
    "orders.py": "from billing import Invoice\n\n\ndef close_order(items):\n    invoice = Invoice()\n    return invoice.total(items)\n",
    "tests/test_billing.py": "from billing import tally\n\n\ndef test_tally():\n    assert tally([1]) == 1\n",
}


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("code")
    for path, text in FILES.items():
        (root / path).parent.mkdir(exist_ok=True)
        (root / path).write_text(text)
    index = code_index.build_index(spark, str(root), "r")
    g = code_index.build_graph(index)
    return index, code_index.Graph(g.relationships.cache(), g.diagnostics.cache())


def test_bundle(built):
    got = context.resolve(*built, "Fix the rounding bug in tally", max_tokens=1000)
    assert got.action == "change" and "tally" in got.queries
    assert "tally" in [r["qualified_name"] for r in got.ranked[:3]]
    roles = {(r["qualified_name"], role) for r in got.ranked for role in r["roles"]}
    assert {("Invoice.total", "caller"), ("test_tally", "test"), ("tally", "primary")} <= roles
    b = got.budget
    assert b["reserved"] + b["used"] + b["remaining"] == b["requested"] and b["used"] == sum(s["tokens"] for s in got.snippets)
    assert any("def tally" in s["content"] for s in got.snippets)
    assert len({s["content_hash"] for s in got.snippets}) == len(got.snippets)


def test_bad_requests(built):
    for task, tokens in (("", 1000), ("***", 1000), ("fix tally", 100)):
        with pytest.raises(ValueError):
            context.resolve(*built, task, max_tokens=tokens)


def test_crop_grows_around_the_focus():
    text = "\n".join(f"line {i}" for i in range(100))
    assert context.crop(text, 50, 10_000) == text
    small = context.crop(text, 50, 40)
    assert "line 50" in small and context.tokens(small) <= 40 and "omitted" in small
    assert context.crop("x" * 4000, 0, 10) is None


def test_fill_takes_each_content_once_and_reserves_roles():
    def item(h, role, score, text):
        return {"content_hash": h, "roles": [role], "score": score, "source_text": text, "relative_path": h, "start_line": 1, "end_line": 1, "a": 1, "b": 1}

    items = [item("a", "primary", 0.9, "x" * 400), item("b", "caller", 0.2, "y" * 400), item("c", "dependency", 0.8, "z" * 40_000), item("d", "test", 0.1, "t" * 400)]
    taken, budget = context.fill(items, 1000)
    assert [t["content_hash"] for t in taken] == ["a", "b", "d"] and budget["omitted"] == 1


def test_two_steps_away(spark, built):
    index, g = built
    tally = index.symbols.where("qualified_name = 'tally'").first()["id"]
    rows = context.stage_two(index, g, [tally], depth=2, roles=["caller"]).select("qualified_name", "distance", "role").collect()
    assert {("Invoice.total", 1, "caller"), ("close_order", 2, "caller")} <= {tuple(r) for r in rows}


def test_doubt_widens_once(built):
    """Nothing is called as asked, so the first pass is in doubt; the second one adds only what is new."""
    got = context.resolve(*built, "explain invoice rounding", max_tokens=1000)
    assert got.expansions == 1 and ("widened" in got.reasons or got.status == "accepted") and 0 <= got.initial_confidence < context.THRESHOLD
    assert len({(r["entity_type"], r["entity_id"]) for r in got.ranked}) == len(got.ranked)


def test_without_a_graph(built):
    got = context.resolve(built[0], None, "Fix the rounding bug in tally", max_tokens=1000)
    assert "graph_unavailable" in [d["code"] for d in got.diagnostics] and "retrieval_degraded" in got.reasons and got.status == "degraded"


def judged(value, *reasons):
    return context.Judged(value, list(reasons), [], [])


@pytest.mark.parametrize(
    ("had", "has", "before", "wanted"),
    [
        (["primary", "test"], ["primary"], judged(0.9, "unique_target"), (0.79, "degraded", ["missing_roles", "unique_target"], ["test"])),
        (["primary", "test"], ["primary", "test"], judged(0.7, "missing_roles", "unique_target"), (0.80, "accepted", ["unique_target"], [])),
        (["primary"], ["primary"], judged(0.7, "ambiguous_target"), (0.7, "degraded", ["ambiguous_target"], [])),
        (["primary"], ["primary"], judged(0.95, "unique_target"), (0.95, "accepted", ["unique_target"], [])),
    ],
)
def test_confidence_after_the_choice(had, has, before, wanted):
    value, *rest = context.after_choice(before, [{"roles": had}], [{"roles": has}])
    assert (round(value, 9), *rest) == wanted


def test_next_actions():
    f = context.next_action
    assert f(["missing_primary"], [], "degraded", {"index_stale"}, "a", False) == "refresh_index"
    assert f(["ambiguous_target"], ["test"], "degraded", set(), "a", False) == "manual_fallback"
    assert f([], ["test"], "degraded", set(), "a", False) == "expand" and f([], ["test"], "degraded", set(), None, False) == "manual_fallback"
    assert f([], [], "degraded", set(), "a", True) == "expand" and f([], [], "accepted", set(), "a", True) == "none"
    assert f([], [], "accepted", {"graph_unavailable"}, "a", False) == "manual_fallback"


def test_diagnostics_are_bounded():
    rows = [context.diagnostic("role_missing", f"m{i % 40:02}", "test") for i in range(80)]
    got = context.bounded_diagnostics(rows)
    assert len(got) == context.DIAGNOSTICS and got[0]["message"] == "m00" and got == sorted(got, key=lambda r: r["message"])


def test_discarded_searches_are_told(built):
    many = [f"name_{i}" for i in range(10)]
    parts = context.resolve_task(built[0], "Fix " + " ".join(f"other_{i}" for i in range(6)), many)
    assert len(parts["planned"]) == 12 and parts["discarded"] == 4
    assert context.resolve_task(built[0], "Fix tally", ["tally", "--"])["discarded"] == 1
    got = context.resolve(*built, "Fix the rounding bug in tally", ["tally", "--"], max_tokens=1000)
    assert {"code": "input_discarded", "severity": "info"}.items() <= next(d for d in got.diagnostics if d["code"] == "input_discarded").items()


def test_a_graph_of_another_repository_is_refused(built):
    index, graph = built
    foreign = code_index.Graph(graph.relationships, graph.diagnostics, repository_id="other")
    with pytest.raises(ValueError, match="other"):
        context.resolve(index, foreign, "Fix tally", max_tokens=1000)
