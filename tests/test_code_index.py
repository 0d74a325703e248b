import pytest

from quarry.functions.identity import stable_id
from quarry.functions import targets
from quarry.operators import compress, graph
from quarry.plans import code_index
from quarry.sources import diff, scan
from quarry.sources.extract import extract

FILES = {
    "pkg/__init__.py": "",
    "pkg/base.py": "class Base:\n    def run(self, value):\n        return value\n\n\nclass Contract:\n    pass\n",
    "pkg/service.py": "from pkg.base import Base\n\n\nclass Service(Base):\n    def helper(self, value):\n        return value\n\n    def run(self, value):\n        return self.helper(value)\n",
    "tests/test_service.py": "from pkg.service import Service\n\n\ndef test_service():\n    service = Service()\n    assert service.run(1)\n",
    "src/base.ts": "export class TsBase {}\nexport interface Contract { }\n",
    "src/service.ts": "import { TsBase, Contract } from './base';\nexport class TsService extends TsBase implements Contract {\n  run(value: string): string { return value; }\n}\n",
    "api/client.ts": "export function fetchUser(id: string) { return id; }\n",
    "api/index.ts": "export { fetchUser } from './client';\n",
    "api/consumer.ts": "import { fetchUser } from './index';\nexport function useUser(id: string) { return fetchUser(id); }\n",
    "settings.py": "API_URL = 'x'\n",
    "load.py": "import os\n\n\ndef load_url():\n    return os.getenv('API_URL')\n",
    "first.py": "def shared():\n    pass\n",
    "second.py": "def shared():\n    pass\n",
    "caller.py": "def call_it():\n    shared()\n",
    "routes.py": "class UserCreate:\n    pass\n\n\n@app.post('/u')\ndef create_user(item: UserCreate):\n    return item\n",
    "bad.py": b"\xff\xfe = 1\n",
    "gen.min.js": "var a=1",
    "node_modules/x.js": "function hidden() {}",
    "ignored/a.py": "x = 1\n",
    "ignored/keep.py": "x = 1\n",
    "head.py": "# @generated\n",
    "zero.py": b"a\x00b",
    ".gitignore": "ignored/\n*.tmp.py\n",
}


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for path, text in FILES.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(root)


@pytest.fixture(scope="module")
def index(spark, tree):
    return code_index.build_index(spark, tree, "repo")


@pytest.fixture(scope="module")
def built(index):
    g = code_index.build_graph(index)
    return code_index.Graph(g.relationships.cache(), g.diagnostics.cache())


def test_scan_reasons(spark, tree):
    rows = {r.relative_path: r.skip for r in scan.scan(spark, tree, scan.ignore_layers(tree)).collect()}
    assert rows["node_modules"] == "excluded_directory" and rows["ignored/keep.py"] == "ignored"
    assert rows["gen.min.js"] == rows["head.py"] == "generated" and rows["zero.py"] == "binary" and rows[".gitignore"] == "unsupported"
    assert rows["pkg/base.py"] is None and rows["pkg/__init__.py"] is None


@pytest.mark.parametrize(
    ("lines", "path", "ignored"),
    [(["*.log"], "a/b.log", True), (["/a"], "a/x.py", True), (["/a"], "b/a/x.py", False), (["a/"], "b/a/x.py", True), (["*.py", "!keep.py"], "keep.py", False), (["d/", "!d/keep.py"], "d/keep.py", True), (["**/t/*.py"], "x/t/y.py", True), (["# a", ""], "a", False)],
)
def test_ignore_rules(spark, lines, path, ignored):
    from pyspark.sql import functions as F

    assert spark.range(1).select(scan.is_ignored(F.lit(path), {"": lines}).alias("x")).first()["x"] == ignored


def test_nested_ignore_layers(spark):
    from pyspark.sql import functions as F

    layers = {"": ["*.py"], "sub": ["!a.py"]}
    got = spark.createDataFrame([("a.py",), ("sub/a.py",), ("sub/b.py",)], "p string").select(scan.is_ignored(F.col("p"), layers).alias("x")).collect()
    assert [r.x for r in got] == [True, False, True]


def test_tables(index):
    names = {(r.kind, r.qualified_name) for r in index.symbols.collect()}
    assert {("class", "Service"), ("method", "Service.run"), ("test", "test_service"), ("interface", "Contract"), ("constant", "API_URL"), ("function", "useUser")} <= names
    status = {r.relative_path: r.parse_status for r in index.files.collect()}
    assert status["bad.py"] == "failed" and status["pkg/base.py"] == "parsed"
    row = index.files.where("relative_path = 'load.py'").first()
    assert row.file_id == stable_id("file", "repo", "load.py")
    assert {r.entity_type for r in index.documents.select("entity_type").distinct().collect()} == {"file", "symbol", "chunk", "fact"}


def edge_names(index, built):
    names = {r.id: r.name for r in index.symbols.collect()}
    return {(r.kind, names.get(r.source_symbol), names.get(r.target_symbol)) for r in built.relationships.collect()}


def test_graph(index, built):
    edges = edge_names(index, built)
    assert {("calls", "run", "helper"), ("inherits", "Service", "Base"), ("implements", "TsService", "Contract"), ("tested_by", "run", "test_service"), ("overrides", "run", "run")} <= edges
    assert {("calls", "useUser", "fetchUser"), ("configured_by", "load_url", "API_URL"), ("uses_schema", "create_user", "UserCreate"), ("inherits", "TsService", "TsBase")} <= edges
    assert any(k == "imports" for k, *_ in edges) and ("calls", "call_it", "shared") not in edges
    reasons = {(r.reason, r.normalized_target) for r in built.diagnostics.collect()}
    assert ("ambiguous", "shared") in reasons and any(r == "unresolved" for r, _ in reasons)
    assert built.relationships.count() == built.relationships.select("id").distinct().count()


def test_search_puts_exact_names_first(index):
    rows = code_index.search(index, "Service").collect()
    assert rows[0].qualified_name == "Service" and rows[0].score == 0.5 and any(r.entity_type == "chunk" for r in rows)
    assert code_index.search(index, "strange nothing").count() == 0
    for bad in ("", "***", "x" * 501):
        with pytest.raises(ValueError):
            code_index.search(index, bad)


def test_traverse_is_bounded_and_ends_on_cycles(spark):
    edges = spark.createDataFrame([("a", "b", "calls", "1"), ("b", "a", "calls", "2"), ("b", "c", "calls", "3"), ("c", "d", "imports", "4")], "source string, target string, kind string, edge_id string")
    roots = spark.createDataFrame([("j", "a")], "job string, node string")
    taken, nodes = graph.traverse(edges, roots, depth=5, direction="outgoing")
    assert {(r.node, r.distance) for r in nodes.collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 3)} and taken.count() == 4
    taken, _ = graph.traverse(edges, roots, depth=5, limit=1, direction="outgoing")
    assert taken.count() == 1
    taken, _ = graph.traverse(edges, roots, depth=3, direction="outgoing", kinds=["imports"])
    assert taken.count() == 0
    with pytest.raises(ValueError):
        graph.traverse(edges, roots, depth=6)


def plain_traverse(edges, jobs, depth, limit):
    """(edges by job with level, distances) in both directions, by plain loops."""
    all_taken, all_nodes = set(), {}
    for job, roots in jobs.items():
        distance, used, frontier, full = dict.fromkeys(roots, 0), set(), set(roots), False
        for level in range(1, depth + 1):
            met = sorted({e for e in edges if (e[0] in frontier or e[1] in frontier) and e[3] not in used}, key=lambda e: (e[2], e[0], e[1], e[3]))
            room = limit - len(used)
            full, met = len(met) > room, met[:room]
            used |= {e[3] for e in met}
            all_taken |= {(job, e[3], level) for e in met}
            ends = {b for e in met for a, b in (e[:2], e[1::-1]) if a in frontier}
            frontier = ends - set(distance)
            distance |= dict.fromkeys(frontier, level)
            if full:
                break
        all_nodes |= {(job, node): d for node, d in distance.items()}
    return all_taken, all_nodes


def hubs(spark, monkeypatch):
    """A graph with two hubs, a loop and pairs in both directions, walked by 40 jobs; a node of over 3 jobs is dealt out."""
    monkeypatch.setattr(graph, "JOBS_OF_A_TASK", 3, raising=False)
    pairs = [("h", f"x{i}") for i in range(60)] + [(f"x{i}", "g") for i in range(0, 60, 2)] + [("g", f"y{i}") for i in range(30)] + [("x1", "h"), ("h", "h"), ("g", "h")]
    edges = [(a, b, ["calls", "imports"][i % 2], f"{a}>{b}") for i, (a, b) in enumerate(pairs)]
    jobs = {f"j{i}": [f"x{i}"] if i % 4 else ["h", f"x{i}"] for i in range(40)}
    return edges, jobs, spark.createDataFrame(edges, "source string, target string, kind string, edge_id string"), spark.createDataFrame([(j, n) for j, ns in jobs.items() for n in ns], "job string, node string")


@pytest.mark.parametrize("limit", [3, 25, 500])
def test_traverse_meets_no_more_edges_of_a_hub_than_may_be_taken(spark, monkeypatch, limit):
    edges, jobs, frame, roots = hubs(spark, monkeypatch)
    written = []

    def keep(df, name):
        spark.conf.set("spark.sql.adaptive.enabled", "false")  # so that the plan tells rows of its operators
        try:
            kept, stack = df.collect(), [df._jdf.queryExecution().executedPlan()]
        finally:
            spark.conf.unset("spark.sql.adaptive.enabled")
        while stack:
            node = stack.pop()
            stack += [node.children().apply(i) for i in range(node.children().size())]
            if "Join" in node.nodeName() and node.metrics().contains("numOutputRows"):
                written.append(node.metrics().apply("numOutputRows").value())
        return spark.createDataFrame(kept, df.schema)

    taken, nodes = graph.traverse(frame, roots, depth=3, limit=limit, keep=keep)
    want, distances = plain_traverse(edges, jobs, 3, limit)
    assert {(r.job, r.edge_id, r.level) for r in taken.collect()} == want and {(r.job, r.node): r.distance for r in nodes.collect()} == distances
    if limit == 3:  # 40 jobs, at most 4 nodes each, 4 edges of a node and direction
        assert max(written) <= 40 * 4 * 4


def test_supporting_edges_deal_rows_once(spark, monkeypatch):
    edges, jobs, frame, roots = hubs(spark, monkeypatch)
    taken, nodes = graph.traverse(frame, roots, depth=2, limit=25)
    ids, (want, distances) = {e[3]: e[:2] for e in edges}, plain_traverse(edges, jobs, 2, 25)
    told = {(job, b, distances[job, b], i) for job, i, _ in want for a, b in (ids[i], ids[i][::-1]) if distances[job, b] == distances[job, a] + 1}
    found = graph.supporting_edges(taken, nodes)
    assert sorted(map(tuple, found.collect())) == sorted(told)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    ("language", "text", "expected"),
    [
        ("python", "from .base import Base as B, Other", [("pkg/base.py", "Base", "B"), ("pkg/base.py", "Other", "Other")]),
        ("python", "import a.b as c, d", [("a/b.py", None, "c"), ("d.py", None, "d")]),
        ("javascript", "const x = require('./y')", [("pkg/y.js", None, "x")]),
        ("typescript", "import D, { A as B } from '../m'", [("m.js", "A", "B"), ("m.js", "D", "D")]),
        ("typescript", "import * as ns from './n.ts'", [("pkg/n.ts", None, "ns")]),
        ("dart", "import 'package:app/src/x.dart' as x;", [("lib/src/x.dart", None, "x")]),
    ],
)
def test_imports(spark, language, text, expected):
    _, _, found = normalized(spark, (language, "import", text, "pkg/service.py"))
    assert [(t.candidate_paths[0], t.imported_name, t.alias) for t in found] == expected


def normalized(spark, fact):
    facts = spark.createDataFrame([fact], "language string, kind string, target_text string, relative_path string")
    return tuple(targets.with_targets(facts).select("relation", "reason", "targets").first())


@pytest.mark.parametrize(("text", "expected"), [("Alias().execute", ("execute", "Alias")), ("service?.run", ("run", "service")), (".toString", ("toString", None)), ("[1].toString", ("toString", None)), ("plain_call", ("plain_call", None)), ("a::b(c.d)", ("b", "a"))])
def test_calls(spark, text, expected):
    _, _, found = normalized(spark, ("python", "call", text, "a.py"))
    assert (found[0].value, found[0].qualifier) == expected


@pytest.mark.parametrize(
    ("fact", "expected"),
    [
        (("python", "inherits", "(Base, Mixin)", "f.ts"), {"Base", "Mixin"}),
        (("typescript", "inherits", "extends Base implements Contract", "f.ts"), {"Base"}),
        (("typescript", "implements", "implements Contract, Auditable", "f.ts"), {"Contract", "Auditable"}),
        (("dart", "inherits", "extends Base with Mixin", "f.ts"), {"Base", "Mixin"}),
        (("dart", "inherits", "extends A<B, C<D>> with C, D implements E", "a.dart"), {"A", "C", "D"}),
        (("python", "schema", "models.UserCreate", "a.py"), {"UserCreate"}),
    ],
)
def test_types(spark, fact, expected):
    assert {t.value for t in normalized(spark, fact)[2]} == expected


def test_other_facts(spark):
    of = lambda *fact: normalized(spark, fact)
    assert of("go", "import", 'import "fmt"', "a.go") == (None, "unsupported_import_syntax", [])
    assert of("typescript", "export", "export * from './x'", "a.ts")[2][0].alias == "*"
    relation, _, (named,) = of("typescript", "export", "export { fetchUser as publicFetch } from './api';", "src/index.ts")
    assert (relation, named.imported_name, named.alias) == ("exports", "fetchUser", "publicFetch") and "src/api.ts" in named.candidate_paths
    assert of("typescript", "export", "export function x() {}", "a.ts") == (None, None, []) == of("python", "decorator", "@x", "a.py")
    assert of("python", "configuration", "not ok", "a.py") == (None, "unsupported_configuration_key", [])
    assert of("python", "configuration", "API_URL", "a.py")[2][0].kind == "configuration" and of("dart", "call", "()", "s.dart")[1] == "unsupported_symbol_target"
    assert [(t.value, t.imported_name, t.alias) for t in of("python", "import", "from . import (a as b,\n c)", "p/x.py")[2]] == [(".", "a", "b"), (".", "c", "c")]
    assert [t.alias for t in of("typescript", "import", "import './side'", "a.ts")[2]] == [None] and of("javascript", "import", "import(x)", "a.js")[1] == "unsupported_import_syntax"
    assert of("python", "what", "x", "a.py")[1] == "unsupported_fact_kind" and of("python", "import", "from .a import *", "p/x.py")[2][0].candidate_paths == ["p/a.py", "p/a/__init__.py"]


def test_broken_python_keeps_what_parses():
    got = extract("python", "a.py", b"def ok():\n    return 1\n\ndef broken(:\n    pass\n\nclass Fine:\n    pass\n")
    assert {s["name"] for s in got["symbols"]} == {"ok", "Fine"} and got["error_count"] == 1
    assert next(s for s in got["symbols"] if s["name"] == "Fine")["start_line"] == 7


def test_receiver_type_must_be_the_only_one():
    one = extract("python", "a.py", b"def f():\n    s = Service()\n    s.run()\n")
    two = extract("python", "a.py", b"def f():\n    s = Service()\n    s = Other()\n    s.run()\n")
    of = lambda r: [x["metadata"] for x in r["facts"] if x["target_text"] == "s.run"]
    assert of(one) == [{"receiver_type": "Service"}] and of(two) == [{}]


def test_compress(spark):
    text = "\n".join(["collecting"] * 20 + [f"progress {i}" for i in range(100)] + ["ERROR: broke"] + [f"cleanup {i}" for i in range(30)])
    row = compress.compress(spark.createDataFrame([("a", text), ("b", "")], "id string, text string")).where("id = 'a'").first()
    assert row.repeated == 19 and "ERROR: broke" in row.content and "line(s) omitted" in row.content and row.original_lines == 151
    assert "[previous line repeated 19 time(s)]" in row.content and "progress 50" not in row.content


def test_hunks(spark):
    text = "diff --git a/s.py b/s.py\n--- a/s.py\n+++ b/s.py\n@@ -2,2 +2,3 @@ def f\n a\n-b\n+c\n+d\n@@ -9 +10 @@\n-x\n+y\ndiff --git a/../e b/../e\n--- a/../e\n+++ b/../e\n@@ -1 +1 @@\n-a\n+b\n"
    rows = diff.hunks(spark.createDataFrame([(1, text)], "id int, text string")).orderBy("hunk_no").collect()
    assert [(r.relative_path, r.old_start, r.new_start, r.changed_from, r.changed_to) for r in rows] == [("s.py", 2, 2, 2, 4), ("s.py", 9, 10, 10, 10)]
    assert rows[0].content.startswith("@@ -2,2") and rows[0].content.endswith("+d\n")


def plain_compress(text, max_chars=12_000):
    """Output compression written out as loops over lines."""
    import re

    lines = re.sub(r"\n\Z", "", re.sub(r"\r\n?", "\n", text[: compress.MAX_INPUT])).split("\n")
    shown, repeated = [], 0
    for i, line in enumerate(lines):
        if i and line == lines[i - 1]:
            continue
        n = next((k for k in range(i, len(lines)) if lines[k] != line), len(lines)) - i
        shown.append(line)
        if n > 1:
            shown.append(f"[previous line repeated {n - 1} time(s)]")
            repeated += n - 1
    marked = [bool(re.search(compress.PRIORITY, x)) for x in shown]
    keep = [i for i in range(len(shown)) if len(shown) <= compress.WHOLE or any(marked[max(0, i - 1) : i + 2]) or i < compress.HEAD or i >= len(shown) - compress.TAIL]
    out = []
    for at, i in enumerate(keep):
        gap = i - (keep[at - 1] if at else -1) - 1
        out += [f"[... {gap} line(s) omitted ...]"] if gap else []
        out.append(shown[i])
    content = "\n".join(out)
    if len(content) > max_chars:
        note = "\n[output truncated to configured character budget]"
        content = re.sub(r"\n[^\n]*\Z", "", content[: max_chars - len(note)]) + note
    return content, text.count("\n") + bool(text), repeated


def test_compress_equals_plain_loops(spark):
    import random

    rng = random.Random(7)
    words = ["ok", "step 1", "step 2", "ERROR: x", "warning y", "", "E   assert", "done"]
    texts = ["", "\n", "a", "a\na\na", "x\r\ny\ry\n"] + ["\n".join(rng.choice(words[:3] if rng.random() < 0.9 else words) for _ in range(rng.randint(1, 400))) for _ in range(30)] + ["\n".join(f"line {i} error" for i in range(2000))]
    rows = compress.compress(spark.createDataFrame(list(enumerate(texts)), "id int, text string")).collect()
    assert {r.id: (r.content, r.original_lines, r.repeated) for r in rows} == {i: plain_compress(t) for i, t in enumerate(texts)}
