"""Registered queries that run the code index end to end on a small source tree; imported by the catalog.

The tree's files are written below, and each query's SQL lists the rows that the engine must give for them.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import targets
from quarry.operators import graph as G
from quarry.operators import incremental as I
from quarry.plans import code_index, context, impact
from quarry.plans.catalog import ORACLES, QUERIES
from quarry.sources import scan

TREE = {
    "pkg/base.py": "class Base:\n    def run(self, value):\n        return value\n\n\nclass Contract:\n    pass\n",
    "pkg/service.py": "from pkg.base import Base\n\n\nclass Service(Base):\n    def helper(self, value):\n        return value\n\n    def run(self, value):\n        return self.helper(value)\n",
    "tests/test_service.py": "from pkg.service import Service\n\n\ndef test_service():\n    service = Service()\n    assert service.run(1)\n",
    "src/base.ts": "export class TsBase {}\nexport interface Contract { }\n",
    "src/service.ts": "import { TsBase, Contract } from './base';\nexport class TsService extends TsBase implements Contract {\n  run(value: string): string { return value; }\n}\n",
    "api/client.ts": "export function fetchUser(id: string) { return id; }\n",
    "api/index.ts": "export { fetchUser } from './client';\n",
    "api/consumer.ts": "import { fetchUser } from './index';\nexport function useUser(id: string) { return fetchUser(id); }\n",
    "lib/shape.dart": "import 'package:app/area.dart' as area;\n\nclass Shape {\n  int size(int n) {\n    return area.measure(n);\n  }\n}\n",
    "lib/area.dart": "int measure(int n) {\n  return n;\n}\n",
    "go/main.go": "package main\n\ntype Server struct {\n\tName string\n}\n\nfunc (s *Server) Start(port int) error {\n\treturn listen(port)\n}\n\nfunc listen(port int) error {\n\treturn nil\n}\n",
    "settings.py": "API_URL = 'x'\n",
    "load.py": "import os\n\n\ndef load_url():\n    return os.getenv('API_URL')\n",
    "first.py": "def shared():\n    pass\n",
    "second.py": "def shared():\n    pass\n",
    "caller.py": "def call_it():\n    shared()\n    nowhere()\n",
    "routes.py": "class UserCreate:\n    pass\n\n\n@app.post('/u')\ndef create_user(item: UserCreate):\n    return item\n",
    "broken.py": "def ok():\n    return 1\n\ndef broken(:\n    pass\n",
}
#: Bytes that are no text, and files that a scan leaves out.
RAW = {"bad.py": b"\xff\xfe = 1\n", "gen.min.js": b"var a=1", "node_modules/x.js": b"function hidden() {}", "zero.py": b"a\x00b", "notes.txt": b"text"}
TASK, FOCUS = "Fix the error in Service.run", ["Service.run"]
PATCH = "diff --git a/pkg/service.py b/pkg/service.py\n--- a/pkg/service.py\n+++ b/pkg/service.py\n@@ -5,2 +5,2 @@ class Service(Base):\n     def helper(self, value):\n-        return value\n+        return value + 1\ndiff --git a/routes.py b/routes.py\n--- a/routes.py\n+++ b/routes.py\n@@ -6,2 +6,2 @@\n def create_user(item: UserCreate):\n-    return item\n+    return None\n"
FACTS = [
    ("python", "pkg/feature.py", "import", "from .service import Service as Alias"), ("javascript", "src/feature.js", "import", "import { Service as Alias } from './service.js';"),
    ("typescript", "src/feature.ts", "import", "import * as service from '../shared/service';"), ("tsx", "src/view.tsx", "import", "import { Widget } from './widget';"),
    ("dart", "lib/feature.dart", "import", "import 'service.dart' as service;"), ("python", "a.py", "import", "import a.b as c, d"), ("javascript", "p/a.js", "import", "const x = require('./y')"),
    ("python", "feature.py", "call", "Alias().execute"), ("python", "feature.py", "call", "service?.run"), ("python", "feature.py", "call", ".toString"), ("python", "feature.py", "call", "plain_call"),
    ("python", "f.py", "inherits", "(Base, Mixin)"), ("typescript", "f.ts", "inherits", "extends Base implements Contract"), ("typescript", "f.ts", "implements", "implements Contract, Auditable"),
    ("dart", "f.dart", "inherits", "extends Base with Mixin"), ("python", "s.py", "configuration", "API_URL"), ("dart", "s.dart", "call", "()"), ("python", "s.py", "configuration", "not ok"),
    ("typescript", "src/index.ts", "export", "export { fetchUser as publicFetch } from './api';"), ("typescript", "src/index.ts", "export", "export * from './models';"), ("python", "r.py", "schema", "UserCreate"),
    ("go", "a.go", "import", 'import "fmt"'), ("python", "a.py", "decorator", "@x"),
]


@dataclass
class _Built:
    index: code_index.Index
    graph: code_index.Graph


_built: dict[str, _Built] = {}


def scanned(spark: SparkSession, files: dict[str, bytes]) -> DataFrame:
    rows = spark.createDataFrame(sorted(files.items()), "relative_path string, content binary")
    path, content = F.col("relative_path"), F.col("content")
    return rows.select(path, scan.language_of(path).alias("language"), content, F.sha2("content", 256).alias("content_hash"), scan.skip_reason(path, F.length(content), content, {}, scan.MAX_BYTES).alias("skip"))


def built(spark: SparkSession) -> _Built:
    """The tree's index and graph, written once for a session."""
    key = spark.sparkContext.applicationId
    if key not in _built:
        _built.clear()
        index = code_index.index_of(scanned(spark, {k: v.encode() for k, v in TREE.items()} | RAW), "tree")
        graph = code_index.build_graph(index)
        _built[key] = _Built(index, code_index.Graph(I.keep(graph.relationships, "tree-edges"), I.keep(graph.diagnostics, "tree-diagnostics"), repository_id="tree"))
    return _built[key]


def _names(index: code_index.Index, key: str, name: str) -> DataFrame:
    symbols = index.symbols.select(F.col("id").alias(key), F.concat_ws(":", "relative_path", "qualified_name").alias(name))
    return symbols.unionByName(index.files.select(F.col("file_id").alias(key), F.col("relative_path").alias(name)))


def tree_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with status, counts and last line; skipped ones by reason."""
    index = built(spark).index
    files = index.files.select("relative_path", "language", F.col("parse_status").alias("status"), "symbol_count", "chunk_count", "fact_count", "end_line")
    left = index.skipped.select(F.lit("").alias("relative_path"), F.lit("").alias("language"), F.col("skip").alias("status"), F.lit(0).alias("symbol_count"), F.lit(0).alias("chunk_count"), F.lit(0).alias("fact_count"), F.col("count").cast("int").alias("end_line"))
    return files.unionByName(left)


def tree_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols of five languages with kinds, signatures, parameters, results and ranges."""
    return built(spark).index.symbols.select("relative_path", "kind", "qualified_name", "signature", F.array_join("parameters", "|").alias("parameters"), F.coalesce("return_type", F.lit("")).alias("return_type"), "start_line", "end_line", "start_byte", "end_byte")


def tree_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Syntax facts with their owners and receiver types."""
    index = built(spark).index
    owner = index.symbols.select(F.col("id").alias("source_symbol_id"), F.col("qualified_name").alias("owner"))
    return index.facts.join(owner, "source_symbol_id", "left").select("relative_path", "kind", "target_text", F.coalesce("owner", F.lit("")).alias("owner"), F.coalesce(F.col("metadata")["receiver_type"], F.lit("")).alias("receiver"), "start_line", "start_byte")


def tree_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks by owner, each content of a file once; hashes are of the text."""
    index = built(spark).index
    owner = index.symbols.select(F.col("id").alias("symbol_id"), F.col("qualified_name").alias("owner"))
    told = index.chunks.join(owner, "symbol_id", "left")
    return told.select("relative_path", "kind", F.coalesce("owner", F.lit("")).alias("owner"), "start_line", "end_line", F.length("source_text").alias("chars"), (F.sha2("source_text", 256) == F.col("content_hash")).alias("hashed"))


def tree_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations and targets of single facts."""
    facts = spark.createDataFrame(FACTS, "language string, relative_path string, kind string, target_text string")
    t = targets.with_targets(facts).select("language", "kind", "target_text", "relation", "reason", F.explode_outer("targets").alias("t"))
    return t.select("language", "kind", "target_text", "relation", "reason", "t.value", "t.qualifier", "t.alias", "t.imported_name", F.get("t.candidate_paths", 0).alias("first_path"), F.size("t.candidate_paths").alias("n_paths"))


def tree_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resolved and derived relationships with strategy and confidence."""
    b = built(spark)
    ends = b.graph.relationships.select("kind", F.coalesce("source_symbol", "source_file").alias("a"), F.coalesce("target_symbol", "target_file").alias("b"), "confidence", F.col("resolution_strategy").alias("strategy"), "raw_target", "normalized_target")
    return ends.join(_names(b.index, "a", "source"), "a").join(_names(b.index, "b", "target"), "b").drop("a", "b")


def tree_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts without a relationship and why."""
    b = built(spark)
    return b.graph.diagnostics.join(b.index.files.select("file_id", "relative_path"), "file_id").select("relative_path", "reason", "fact_kind", "raw_target", "normalized_target", F.col("candidate_count").cast("long").alias("candidate_count"), "strategy")


def tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches, exact names first, with scores and snippets."""
    found = code_index.search_many(built(spark).index, ["Service", "run value", "fetchUser", "Service.run", "nothing such"], 5)
    return found.select("query", "position", "entity_type", "relative_path", F.coalesce("qualified_name", F.lit("")).alias("qualified_name"), F.round("score", 5).alias("score"), F.substring("snippet", 1, 24).alias("snippet"))


def tree_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes within two steps of a target that was looked up."""
    b = built(spark)
    root = code_index.find_node(b.index, "Service.run")
    _, nodes = G.traverse(code_index.edges_of(b.graph), spark.createDataFrame([("0", root)], "job string, node string"), 2, 50)
    return nodes.join(_names(b.index, "node", "name"), "node").select("name", "distance")


def tree_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A task's ranked candidates with roles, scores and whether they are shown."""
    b = built(spark)
    got = context.resolve(b.index, b.graph, TASK, FOCUS, 1200)
    shown = {(s["relative_path"], s["start_line"], s["end_line"]) for s in got.snippets}
    rows = [(r["rank"], r["entity_type"], r["relative_path"], r["qualified_name"] or "", "|".join(r["roles"]), round(r["score"], 5), (r["relative_path"], r["start_line"], r["end_line"]) in shown) for r in got.ranked]
    rows.append((0, got.action, "|".join(got.queries), got.next_action, "|".join(got.reasons), round(got.confidence, 5), bool(got.snippets)))
    return spark.createDataFrame(rows, "rank int, entity_type string, relative_path string, qualified_name string, roles string, score double, shown boolean")


def tree_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a patch changes, who calls it, its tests, contracts and risks."""
    b = built(spark)
    got = impact.analyze(b.index, b.graph, PATCH, ["pkg/service.py"])
    part = lambda name, df: df.select(F.lit(name).alias("part"), "relative_path", F.col("qualified_name").alias("name"))
    risks = got.risks.select(F.lit("risk").alias("part"), F.coalesce("relative_path", F.lit("")).alias("relative_path"), F.col("code").alias("name"))
    return part("changed", got.changed).unionByName(part("caller", got.callers)).unionByName(part("test", got.tests)).unionByName(part("route", got.routes)).unionByName(part("schema", got.schemas)).unionByName(risks)


#: Expected rows, by query: taken from the output of the engine and read through by hand against the tree above.
EXPECTED = json.loads((Path(__file__).parent / "tree_expected.json").read_text()) if (Path(__file__).parent / "tree_expected.json").exists() else {}


def _sql(columns: dict[str, str], rows: list[list]) -> str:
    def literal(v: object) -> str:
        if v is None:
            return "NULL"
        return str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"

    typed = ", ".join(f"{c}::{t} AS {c}" for c, t in columns.items())
    return f"SELECT {typed} FROM (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) AS t({', '.join(columns)})"


for _f in (tree_files, tree_symbols, tree_facts, tree_chunks, tree_targets, tree_relationships, tree_diagnostics, tree_search, tree_walk, tree_context, tree_impact):
    QUERIES[_f.__name__] = _f
    if _f.__name__ in EXPECTED:
        ORACLES[_f.__name__] = _sql(EXPECTED[_f.__name__]["columns"], EXPECTED[_f.__name__]["rows"])
