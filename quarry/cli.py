"""Command line over kept indexes: repositories, builds, search, graph, context and impact queries. Prints JSON.

Known repositories and their locks are in --home; tables are in --store, any folder that Spark can reach.
"""

from __future__ import annotations

import argparse
import dataclasses
import json
import os
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import logs
from quarry.settings import EXIT_CODES, EngineError, Registry, describe, load_settings


def _session() -> SparkSession:
    spark = SparkSession.builder.appName("quarry").config("spark.sql.session.timeZone", "UTC").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quarry")
    p.add_argument("--home", default=os.environ.get("QUARRY_HOME", str(Path.home() / ".quarry")), help="folder of known repositories")
    p.add_argument("--store", default=os.environ.get("QUARRY_STORE"), help="folder or address of the tables; below --home if not given")
    p.add_argument("--log-level", default="WARNING", choices=["DEBUG", "INFO", "WARNING", "ERROR"], help="stages and runs are logged at INFO")
    p.add_argument("--log-json", action="store_true", help="log records as JSON")
    p.add_argument("--repository", help="id or path; the active one if not given")
    top = p.add_subparsers(dest="command", required=True)
    top.add_parser("init")
    top.add_parser("doctor")
    repo = top.add_parser("repo").add_subparsers(dest="action", required=True)
    for name in ("add", "use", "remove", "status", "list"):
        c = repo.add_parser(name)
        if name in ("add", "use", "remove"):
            c.add_argument("what")
    index = top.add_parser("index").add_subparsers(dest="action", required=True)
    index.add_parser("build").add_argument("--full", action="store_true")
    index.add_parser("retry-failed")
    index.add_parser("status")
    c = top.add_parser("search")
    c.add_argument("what")
    c.add_argument("--limit", type=int, default=20)
    graph = top.add_parser("graph").add_subparsers(dest="action", required=True)
    for name, depth in (("neighbors", 1), ("traverse", 2)):
        c = graph.add_parser(name)
        c.add_argument("what")
        c.add_argument("--direction", default="both", choices=["incoming", "outgoing", "both"])
        c.add_argument("--kind", action="append", default=[])
        c.add_argument("--limit", type=int, default=50)
        c.add_argument("--depth", type=int, default=depth)
    context = top.add_parser("context").add_subparsers(dest="action", required=True)
    for name in ("resolve", "expand"):
        c = context.add_parser(name)
        c.add_argument("what")
        c.add_argument("--focus", action="append", default=[])
        c.add_argument("--max-tokens", type=int, default=3000)
        c.add_argument("--no-diff", action="store_true", help="leave the working tree's diff out")
        if name == "expand":
            c.add_argument("--known", action="append", default=[], help="hash of a content that the caller has")
    c = top.add_parser("impact").add_subparsers(dest="action", required=True).add_parser("analyze")
    c.add_argument("--patch", help="a file, or - for standard input; the working tree's diff if not given")
    c.add_argument("--expected", action="append", default=[])
    c = top.add_parser("output").add_subparsers(dest="action", required=True).add_parser("compress")
    c.add_argument("source", help="a file, or - for standard input")
    c.add_argument("--max-chars", type=int, default=12_000)
    return p


def _text(source: str) -> str:
    return sys.stdin.read() if source == "-" else Path(source).read_text(encoding="utf-8", errors="replace")


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def walk(index, graph, target: str, depth: int, limit: int, direction: str, kinds: list[str]) -> dict:  # noqa: ANN001
    """Edges (by kind, ends and id) and nodes (by path, line, type and id) around a target."""
    from quarry.operators import graph as G
    from quarry.plans import code_index

    spark = index.files.sparkSession
    known = set(code_index.RELATIONS)
    if not set(kinds) <= known:
        raise EngineError("graph_query_invalid", f"no such relation: {', '.join(sorted(set(kinds) - known))}")
    if not 1 <= depth <= 5 or not 1 <= limit <= 500:
        raise EngineError("graph_query_invalid", "depth is 1 to 5 and limit 1 to 500")
    code_index.same_repository(index, graph)
    root = spark.createDataFrame([("0", code_index.find_node(index, target))], "job string, node string")
    taken, reached = G.traverse(code_index.edges_of(graph), root, depth, limit, direction, kinds)
    symbols = index.symbols.select(F.col("id").alias("node"), F.lit("symbol").alias("node_type"), "relative_path", "qualified_name", "start_line")
    files = index.files.select(F.col("file_id").alias("node"), F.lit("file").alias("node_type"), "relative_path", F.lit(None).cast("string").alias("qualified_name"), F.lit(None).cast("int").alias("start_line"))
    nodes = reached.drop("job").join(symbols.unionByName(files), "node").orderBy("relative_path", F.coalesce("start_line", F.lit(0)), "node_type", "node")
    return {"edges": _rows(taken.drop("job").orderBy(*G.EDGE_ORDER)), "nodes": _rows(nodes)}


def run(args: argparse.Namespace) -> object:
    home = Path(args.home)
    command = (args.command, getattr(args, "action", None))
    if args.command == "init":
        Registry(args.home)
        return {"home": str(home), "settings": describe(load_settings(file=str(home / "settings.toml")))}
    if args.command == "output":
        from quarry.operators.compress import compress

        one = _session().createDataFrame([(0, _text(args.source))], "id int, text string")
        return compress(one, max_chars=args.max_chars).first().asDict()
    if not home.is_dir():
        raise EngineError("database_not_initialized", f"{home}: run init first")
    registry = Registry(args.home)
    if command == ("repo", "list"):
        return registry.list()
    if command == ("repo", "add"):
        return registry.add(args.what)
    if command == ("repo", "use"):
        return registry.activate(args.what)

    from quarry.plans import code_index, context, impact, store
    from quarry.sources import diff

    spark = _session()
    kept = store.Store(spark, args.store or f"file://{home.resolve()}/store")
    if args.command == "doctor":
        return {"spark": spark.version, "languages": code_index.languages(), "settings": describe(load_settings(file=str(home / "settings.toml"))), "repositories": [{"id": r["id"], "path": r["path"], "readable": os.access(r["path"], os.R_OK), "generation": kept.generation(r["id"])} for r in registry.list()]}
    own = registry.get(args.what if command == ("repo", "remove") else args.repository)
    if command == ("repo", "remove"):
        registry.remove(own["id"])
        kept.remove(own["id"])
        return {"removed": own["id"]}
    if command in (("repo", "status"), ("index", "status")):
        return {"repository": own} | kept.status(own["id"])
    if args.command == "index":
        with registry.lock(own["id"]):
            return kept.build(own["id"], own["path"], full=getattr(args, "full", False), retry_failed=args.action == "retry-failed")
    index, graph = kept.read(own["id"])
    if args.command == "search":
        return _rows(code_index.search(index, args.what, args.limit).orderBy("position"))
    if args.command == "graph":
        return walk(index, graph, args.what, args.depth, args.limit, args.direction, args.kind)
    if args.command == "impact":
        patch = _text(args.patch) if args.patch else diff.working_tree(own["path"])
        got = impact.analyze(index, graph, patch, args.expected)
        parts = {f.name: _rows(getattr(got, f.name)) for f in dataclasses.fields(got)}
        return parts | {"validation": impact.validation_commands(own["path"])}
    root = None if args.no_diff else own["path"]
    if args.action == "expand":
        return dataclasses.asdict(impact.expand(index, graph, args.what, args.focus, args.known, args.max_tokens, root))
    return dataclasses.asdict(context.resolve(index, graph, args.what, args.focus, args.max_tokens, root))


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    show = lambda x: print(json.dumps(x, ensure_ascii=False, sort_keys=True, default=str))
    logs.configure(args.log_level, args.log_json)
    try:
        with logs.operation():
            show(run(args))
        return 0
    except ValueError as e:
        code = getattr(e, "code", str(e))
        show({"error": code, "message": str(e)})
        return EXIT_CODES.get(code, 1)


if __name__ == "__main__":
    sys.exit(main())
