"""What a patch touches: changed symbols, their callers and tests, routes, data contracts, and risks."""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import incremental as I
from quarry.operators import sequences as Q
from quarry.operators.incremental import keep
from quarry.plans import code_index, context
from quarry.sources import diff


@dataclass
class Impact:
    hunks: DataFrame
    changed: DataFrame
    callers: DataFrame
    tests: DataFrame
    routes: DataFrame
    schemas: DataFrame
    risks: DataFrame


def changed_symbols(index: code_index.Index, hunks: DataFrame) -> DataFrame:
    """Symbols whose lines a hunk's changed lines meet, in the same file; an equal join on the path, then the overlap."""
    h = hunks.select(F.lower("relative_path").alias("p"), "changed_from", "changed_to")
    s = index.symbols.withColumn("p", F.lower("relative_path"))
    met = Q.overlapping(s, h, ["p"], ("start_line", "end_line"), ("changed_from", "changed_to"))
    return met.select("id", "relative_path", "kind", "name", "qualified_name", "start_line", "end_line", (F.col("metadata")["is_route"] == "true").alias("is_route")).distinct()


def analyze(index: code_index.Index, graph: code_index.Graph, patch: str, expected: list[str] | None = None, max_hunks: int = 1000, bundle: context.Bundle | None = None) -> Impact:
    """The impact of a unified diff. Paths outside `expected` and the task's bundle are unrelated changes, if there are any such."""
    code_index.same_repository(index, graph)
    spark = index.files.sparkSession
    found = keep(diff.hunks(spark.createDataFrame([(0, patch)], "id int, text string"), max_hunks=max_hunks + 1), "hunks")
    hunks, truncated = found.where(F.col("hunk_no") <= max_hunks), bool(found.where(F.col("hunk_no") > max_hunks).head(1))
    changed = keep(changed_symbols(index, hunks), "changed")
    nodes = index.symbols.select("id", "relative_path", "kind", "name", "qualified_name")
    r = graph.relationships
    ids = changed.select("id")
    into = r.where("kind in ('calls', 'inherits', 'implements')").join(ids, r["target_symbol"] == ids["id"], "left_semi")
    callers = nodes.join(into.select(F.col("source_symbol").alias("id")).distinct(), "id", "left_semi").join(ids, "id", "left_anti")
    tested = r.where("kind = 'tested_by'").join(ids, r["source_symbol"] == ids["id"], "left_semi")
    tests = nodes.join(tested.select(F.col("target_symbol").alias("id")).distinct(), "id", "left_semi")
    routes = changed.where(F.coalesce("is_route", F.lit(False)))
    schemas = changed.where(T.is_schema_name(F.col("kind"), F.col("qualified_name")))
    paths = hunks.select("relative_path").distinct()
    unrelated = paths.where(F.lit(False))
    expected = [*(expected or []), *({r["relative_path"] for r in bundle.ranked} if bundle else [])]
    if expected:
        known = spark.createDataFrame([(p.lower(),) for p in expected], "p string")
        unrelated = paths.join(known, F.lower("relative_path") == F.col("p"), "left_anti")
    risks = I.risks(changed, routes, schemas, tests, unrelated, truncated, ["relative_path", "start_line", "id"]).orderBy("code", "relative_path")
    return Impact(hunks, changed, callers, tests, routes, schemas, risks)


def expand(index: code_index.Index, graph: code_index.Graph, task: str, focus: list[str], known_hashes: list[str], max_tokens: int = 3000, root: str | None = None) -> context.Bundle:
    """A focused bundle without what the caller already has."""
    bundle = context.resolve(index, graph, task, focus, max_tokens, root)
    known = set(known_hashes)
    bundle.snippets = [s for s in bundle.snippets if s["content_hash"] not in known]
    bundle.budget["used"] = sum(s["tokens"] for s in bundle.snippets)
    bundle.budget["remaining"] = bundle.budget["requested"] - bundle.budget["reserved"] - bundle.budget["used"]
    return bundle


def validation_commands(root: str) -> list[str]:
    """Commands that a repository's own manifests offer to check a change with."""
    at, found = Path(root), []
    if (at / "pyproject.toml").exists() or (at / "pytest.ini").exists() or (at / "setup.cfg").exists():
        found.append("python -m pytest")
    if (at / "package.json").exists():
        try:
            scripts = json.loads((at / "package.json").read_text()).get("scripts", {})
        except (ValueError, AttributeError):
            scripts = {}
        found += [f"npm run {name}" for name in ("test", "lint", "typecheck", "build") if name in scripts]
    if (at / "pubspec.yaml").exists():
        found += ["dart analyze", "dart test"]
    if (at / "go.mod").exists():
        found += ["go test ./...", "go vet ./..."]
    return found
