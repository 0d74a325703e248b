"""A code index: source tree -> files, symbols, chunks, facts, search documents -> relationship graph, and queries on them."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.functions.targets import with_targets
from quarry.operators import graph as G
from quarry.operators import search as S
from quarry.operators.incremental import affected, changes, keep, protected_below, replace_files
from quarry.settings import EngineError
from quarry.sources import extract, scan

#: Relations; kinds of symbols that are types.
RELATIONS = ["imports", "exports", "calls", "inherits", "implements", "overrides", "tested_by", "uses_schema", "configured_by"]
TYPE_KINDS = ["class", "interface", "enum", "mixin", "extension", "type_alias"]


@dataclass
class Index:
    repository_id: str
    files: DataFrame
    symbols: DataFrame
    chunks: DataFrame
    facts: DataFrame
    documents: DataFrame
    skipped: DataFrame
    postings: DataFrame | None = None


@dataclass
class Graph:
    """Relationships and diagnostics, and what an update needs: the facts' targets, the names that files bind to others,
    and every relationship that a fact gives, before equal ones are united."""

    relationships: DataFrame
    diagnostics: DataFrame
    targets: DataFrame | None = None
    bindings: DataFrame | None = None
    evidence: DataFrame | None = None
    repository_id: str | None = None


def same_repository(index: Index, graph: Graph | None) -> None:
    """Refuses a graph that was built for another repository than the index; one that names none passes."""
    if graph is not None and graph.repository_id not in (None, index.repository_id):
        raise EngineError("path_outside_repository", f"a graph of {graph.repository_id} for an index of {index.repository_id}")


def languages() -> dict[str, str]:
    """How each language is read."""
    return {x: "ast" if x == "python" else "scanner" for x in sorted(set(scan.LANGUAGES.values()))}


def _extract(scanned: DataFrame, repository_id: str) -> DataFrame:
    """Extraction written once, so that every table reads it."""
    return keep(extract.extract_files(scanned).withColumn("file_id", T.stable_id(F.lit("file"), F.lit(repository_id), F.col("relative_path"))), "extracted")


def _tables(extracted: DataFrame, repository_id: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """files, symbols, chunks and facts of extracted files."""
    repo = F.lit(repository_id)
    db = lambda kind, column: T.stable_id(F.lit(f"db-{kind}"), repo, column)
    base = ["file_id", "relative_path", "language"]
    symbols = extracted.select(*base, F.explode("symbols").alias("x")).select(*base, "x.*").withColumn("local_id", F.col("id")).withColumn("id", db("symbol", F.col("local_id")))
    owner = F.when(F.col("x.symbol_id").isNotNull(), db("symbol", F.col("x.symbol_id")))
    chunks = extracted.select(*base, F.explode("chunks").alias("x")).select(*base, "x.*", owner.alias("owner_id")).withColumn("local_id", F.col("id")).withColumn("id", db("chunk", F.col("local_id"))).drop("symbol_id").withColumnRenamed("owner_id", "symbol_id")
    source = F.when(F.col("x.source_symbol_id").isNotNull(), db("symbol", F.col("x.source_symbol_id")))
    facts = extracted.select(*base, F.explode("facts").alias("x")).select(*base, "x.*", source.alias("owner_id")).withColumn("local_id", F.col("id")).withColumn("id", db("fact", F.col("local_id"))).drop("source_symbol_id").withColumnRenamed("owner_id", "source_symbol_id")
    files = extracted.select("file_id", "relative_path", "language", "content_hash", "parse_status", "error_count", F.size("symbols").alias("symbol_count"), F.size("chunks").alias("chunk_count"), F.size("facts").alias("fact_count"), _last_line().alias("end_line"))
    return files, symbols, chunks, facts


def build_index(spark: SparkSession, root: str, repository_id: str) -> Index:
    """Scans and extracts a whole tree and lays out the tables."""
    return index_of(scan.scan(spark, root, scan.ignore_layers(root)), repository_id)


def index_of(scanned: DataFrame, repository_id: str) -> Index:
    """The tables of scanned files (relative_path, language, content, content_hash, skip)."""
    files, symbols, chunks, facts = _tables(_extract(scanned, repository_id), repository_id)
    return Index(repository_id, files, symbols, chunks, facts, search_documents(files, symbols, chunks, facts), scan.skip_counts(scanned))


def update_index(spark: SparkSession, root: str, before: Index, retry_failed: bool = False) -> tuple[Index, DataFrame]:
    """The index after a scan of the same tree, and (path, change): only new and changed files are extracted.

    Rows of deleted files go, but not those that a scan issue may hide (`protected`: an unreadable folder or file, or one
    that changed during the scan). A file that can't be read as text keeps the rows of its last good version and is `stale`.
    The new tables are written, so the old index may be dropped. Postings that were built are maintained.
    """
    scanned = keep(scan.scan(spark, root, scan.ignore_layers(root)), "scanned")
    wanted = scanned.where("skip is null").select(F.col("relative_path").alias("path"), F.col("content_hash").alias("hash"))
    stored = before.files.select(F.col("relative_path").alias("path"), F.col("content_hash").alias("hash"), F.col("parse_status").alias("status"), F.lit(1).alias("version"))
    told = keep(changes(wanted, stored, 1, retry_failed=retry_failed).select("path", "change"), "told")
    issues = scanned.where(F.col("skip").isin(*scan.ISSUES)).select(F.col("relative_path").alias("path"))
    held = protected_below(told.where("change = 'deleted'").select("path"), issues)
    change = keep(told.join(held.withColumn("_held", F.lit(True)), "path", "left").select("path", F.when(F.col("_held"), "protected").otherwise(F.col("change")).alias("change")), "changes")
    todo = scanned.join(change.where("change in ('new', 'changed')").select(F.col("path").alias("relative_path")), "relative_path", "left_semi")
    files, symbols, chunks, facts = _tables(_extract(todo, before.repository_id), before.repository_id)
    ids = before.files.select("file_id", F.col("relative_path").alias("path")).join(change, "path")
    parsed, deleted = files.select("file_id"), ids.where("change = 'deleted'").select("file_id")
    failed = files.where("parse_status = 'failed'").select("file_id").join(before.files.select("file_id"), "file_id", "left_semi")
    new = [keep(replace_files(old, fresh, parsed, deleted, failed), "table") for old, fresh in ((before.files, files), (before.symbols, symbols), (before.chunks, chunks), (before.facts, facts))]
    kept = new[0].join(failed.withColumn("_failed", F.lit(True)), "file_id", "left")
    new[0] = kept.withColumn("parse_status", F.when(F.col("_failed"), "stale").otherwise(F.col("parse_status"))).drop("_failed")
    after = Index(before.repository_id, *new, search_documents(*new), scan.skip_counts(scanned))
    if before.postings is not None:
        touched = parsed.union(deleted).distinct()
        gone = before.documents.join(touched, "file_id", "left_semi").select(_entity_key().alias("key"))
        fresh = S.build_postings(after.documents.join(touched, "file_id", "left_semi").withColumn("key", _entity_key()), "key", FIELDS)
        after.postings = keep(before.postings.join(gone, "key", "left_anti").unionByName(fresh), "postings")
    return after, change


def _entity_key() -> Column:
    return F.concat_ws(":", "entity_type", "entity_id")


def _last_line() -> Column:
    last = lambda c: F.array_max(F.transform(c, lambda x: x["end_line"]))
    return F.coalesce(F.greatest(last("symbols"), last("chunks"), last("facts")), F.lit(1))


def search_documents(files: DataFrame, symbols: DataFrame, chunks: DataFrame, facts: DataFrame) -> DataFrame:
    """One row for each file, symbol, chunk and fact; chunks carry the names of the symbol that owns them."""
    none = F.lit(None).cast("string")
    columns = ["entity_type", "entity_id", "file_id", "language", "kind", "relative_path", "name", "qualified_name", "signature", "body", "start_line", "end_line"]
    file = files.select(F.lit("file").alias("entity_type"), F.col("file_id").alias("entity_id"), "file_id", "language", F.lit("file").alias("kind"), "relative_path", none.alias("name"), none.alias("qualified_name"), none.alias("signature"), F.lit("").alias("body"), F.lit(1).alias("start_line"), "end_line")
    symbol = symbols.select(F.lit("symbol").alias("entity_type"), F.col("id").alias("entity_id"), "file_id", "language", "kind", "relative_path", "name", "qualified_name", "signature", F.coalesce("docstring", F.lit("")).alias("body"), "start_line", "end_line")
    names = symbols.select(F.col("id").alias("symbol_id"), "name", "qualified_name", "signature")
    chunk = chunks.join(names, "symbol_id", "left").select(F.lit("chunk").alias("entity_type"), F.col("id").alias("entity_id"), "file_id", "language", "kind", "relative_path", "name", "qualified_name", "signature", F.col("source_text").alias("body"), "start_line", "end_line")
    fact = facts.select(F.lit("fact").alias("entity_type"), F.col("id").alias("entity_id"), "file_id", "language", "kind", "relative_path", none.alias("name"), none.alias("qualified_name"), none.alias("signature"), F.col("target_text").alias("body"), "start_line", "end_line")
    return reduce(DataFrame.unionByName, [d.select(*columns) for d in (file, symbol, chunk, fact)])


def normalized(facts: DataFrame) -> DataFrame:
    """(fact_id, relation, reason, targets) of every fact."""
    told = with_targets(facts.select(F.col("id").alias("fact_id"), "language", "kind", "target_text", "relative_path"))
    return told.select("fact_id", "relation", "reason", "targets")


def _ends(qualified: Column, wanted: Column) -> Column:
    return (qualified == wanted) | F.endswith(qualified, F.concat(F.lit("."), wanted))


def _targets(index: Index, facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(targets of the facts with what is known of their source, diagnostics of facts that name no target)."""
    told = keep(normalized(facts), "normalized")
    known = facts.select(F.col("id").alias("fact_id"), F.col("kind").alias("fact_kind"), F.col("file_id").alias("source_file"), F.col("source_symbol_id").alias("source_symbol"), F.col("metadata")["receiver_type"].alias("receiver"), "target_text", "relative_path", "start_byte")
    s = index.symbols.select(F.col("id").alias("source_symbol"), F.col("qualified_name").alias("source_qn"), F.col("kind").alias("source_kind"))
    base = told.where("relation is not null").select("fact_id", "relation", F.posexplode("targets").alias("target_no", "t")).select("fact_id", "relation", "target_no", "t.*").join(known, "fact_id")
    text = T.bounded(F.col("target_text"))
    unread = told.where("reason is not null").join(known, "fact_id").select("fact_id", F.col("source_file").alias("file_id"), F.lit("unsupported").alias("reason"), "fact_kind", text.alias("raw_target"), text.alias("normalized_target"), F.lit(0).cast("long").alias("candidate_count"), F.col("reason").alias("strategy"))
    return keep(base.join(s, "source_symbol", "left"), "targets"), unread


def _symbols(index: Index) -> DataFrame:
    """What of a symbol decides how targets resolve."""
    return index.symbols.select(F.col("id").alias("symbol"), F.col("file_id").alias("file"), "name", F.col("qualified_name").alias("qn"), F.col("kind").alias("symbol_kind"), F.size("parameters").alias("n_parameters"))


def build_graph(index: Index) -> Graph:
    """Resolves every fact's targets by tiers, all of them equal joins, and derives tested_by and overrides."""
    targets, unread = _targets(index, index.facts)
    module, bindings = _modules(index, targets)
    evidence, bad = _resolve(index, targets, module, bindings)
    evidence = keep(evidence, "evidence")
    return Graph(_united(evidence), bad.unionByName(unread), targets, bindings, evidence, index.repository_id)


def refresh_graph(graph: Graph, before: Index, index: Index, change: DataFrame) -> tuple[Graph, int]:
    """The graph after update_index, and how many facts were resolved again; equal to build_graph(index).

    Facts of new and changed files are read again, and of the others those whose resolution can differ: a name they mean
    is borne by other symbols than before, a path they import came or went, a name they use is bound otherwise, or
    methods of a type they inherit from may have changed. Which file an import means is looked up for all imports (an
    equal join on paths). Nothing is done if no file changed.
    """
    same_repository(index, graph)
    moved = change.where("change in ('new', 'changed', 'deleted')")
    if not moved.head(1):
        return graph, 0
    old_files, new_files = (x.files.select("file_id", F.col("relative_path").alias("path")).join(moved, "path", "left_semi") for x in (before, index))
    touched = keep(old_files.union(new_files).select("file_id").distinct(), "touched")
    in_touched = lambda df, c: df.join(touched.withColumnRenamed("file_id", c), c, "left_semi")
    fresh, unread = _targets(index, in_touched(index.facts, "file_id"))
    stay = graph.targets.join(touched.withColumnRenamed("file_id", "source_file"), "source_file", "left_anti")
    targets = keep(stay.unionByName(fresh), "targets")
    module, bindings = _modules(index, targets)

    differing = lambda a, b: a.exceptAll(b).union(b.exceptAll(a))
    names = differing(in_touched(_symbols(before), "file"), in_touched(_symbols(index), "file")).select("name").distinct()
    rebound = differing(graph.bindings, bindings).select("at", "alias").union(bindings.join(names.withColumnRenamed("name", "expected"), "expected", "left_semi").select("at", "alias"))
    paths = old_files.join(new_files, "path", "left_anti").select("path").union(new_files.join(old_files, "path", "left_anti").select("path"))
    named = lambda kind, *parts: F.concat_ws("\u0000", F.lit(kind), *parts)
    keys = names.select(named("name", F.col("name")).alias("key")).union(rebound.select(named("bound", F.col("at"), F.col("alias")))).union(paths.select(named("path", F.lower("path"))))
    on = F.flatten(F.array(
        F.array(named("name", F.col("value")), named("bound", F.col("source_file"), F.coalesce("qualifier", "value"))),
        F.coalesce(F.transform("candidate_paths", lambda p: named("path", F.lower(p))), F.array().cast("array<string>")),
    ))
    redo = affected(targets.select("fact_id", on.alias("keys")), "fact_id", "keys", keys, F.lit(False))
    heirs = in_touched(graph.evidence.where("kind in ('inherits', 'implements')"), "target_file").select("fact_id")
    redo = keep(redo.union(heirs).union(fresh.select("fact_id")).distinct(), "redo")

    gone = keep(in_touched(graph.targets, "source_file").select("fact_id").union(redo).distinct(), "gone")
    again = targets.join(redo, "fact_id", "left_semi")
    evidence, bad = _resolve(index, again, module.join(redo, "fact_id", "left_semi"), bindings)
    evidence = keep(graph.evidence.join(gone, "fact_id", "left_anti").unionByName(evidence), "evidence")
    left = graph.diagnostics.join(gone, "fact_id", "left_anti").join(touched, "file_id", "left_anti").select(graph.diagnostics.columns)
    diagnostics = keep(left.unionByName(bad).unionByName(unread), "diagnostics")
    return Graph(_united(evidence), diagnostics, targets, bindings, evidence, index.repository_id), again.select("fact_id").distinct().count()


KEY = ["fact_id", "target_no"]


def _modules(index: Index, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(module targets resolved to files, (at, alias, expected, wild, to): the names that a file binds to another file)."""
    key = KEY
    modules = targets.where("kind = 'module'")
    paths = index.files.select(F.lower("relative_path").alias("p"), F.col("file_id").alias("file"))
    found = modules.select(*key, F.explode("candidate_paths").alias("c")).select(*key, F.lower("c").alias("p")).join(paths, "p").select(*key, F.struct("file", F.lit(None).cast("string").alias("symbol")).alias("endpoint"))
    module = G.resolve_tiers(modules, key, [("module_path", 0.98, found)])
    # names that a file binds to another file, when the module is a single one
    bound = module.where("status = 'resolved' and alias is not null").select("relation", F.col("source_file").alias("at"), "alias", "imported_name", F.col("endpoint.file").alias("to")).distinct()
    imports, exports = bound.where("relation = 'imports'").drop("relation"), bound.where("relation = 'exports'").drop("relation")
    opened = imports.withColumn("expected", F.coalesce("imported_name", "alias")).withColumn("wild", F.col("imported_name").isNull())
    again = exports.select(F.col("at").alias("to"), F.col("alias").alias("as"), F.col("imported_name").alias("inner"), F.col("to").alias("next"))
    # through a named re-export by file and name, through all star re-exports by file
    hop = opened.join(again.withColumn("expected", F.col("as")), ["to", "expected"]).unionByName(opened.join(again.where("as = '*'"), "to").select("to", "expected", "at", "alias", "imported_name", "wild", "as", "inner", "next"), allowMissingColumns=True)
    hop = hop.select("at", "alias", F.coalesce("inner", "expected").alias("expected"), F.col("inner").isNull().alias("wild"), F.col("next").alias("to"))
    return module, keep(opened.select("at", "alias", "expected", "wild", "to").unionByName(hop).distinct(), "bindings")


def _resolve(index: Index, targets: DataFrame, module: DataFrame, bindings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(relationships that the targets give, diagnostics of those that resolve to none or several)."""
    repo, key, s = index.repository_id, KEY, _symbols(index)
    end = F.struct("file", "symbol").alias("endpoint")
    t = targets.where("kind = 'symbol'")
    allowed = ~F.col("relation").isin("inherits", "implements", "uses_schema") | F.col("symbol_kind").isin(TYPE_KINDS)
    by_file = [t["source_file"] == s["file"], t["value"] == s["name"]]
    local = t.join(s, by_file).where(allowed)
    leafless = F.regexp_replace("source_qn", r"\.[^.]*$", "")
    value = lambda *parts: F.concat_ws(".", *parts)
    # a receiver's type is the owner of its members, so names are joined together with the owner's leaf
    owned = s.withColumn("owner", F.regexp_extract("qn", r"([^.]+)\.[^.]+$", 1))
    received = t.where("receiver is not null and qualifier is not null").withColumn("owner_leaf", F.substring_index("receiver", ".", -1))
    typed = received.join(owned, [received["value"] == owned["name"], received["owner_leaf"] == owned["owner"]]).where(allowed & _ends(F.col("qn"), value("receiver", "value")))
    scope = local.where(F.col("qualifier").isin("self", "this", "super") & F.col("source_qn").contains(".") & _ends(F.col("qn"), value(leafless, F.col("value"))))
    member = t.where("qualifier is not null").join(bindings, [t["source_file"] == bindings["at"], t["qualifier"] == bindings["alias"]])
    in_file = s.withColumnRenamed("file", "to")
    member = member.drop(t["alias"]).join(in_file.withColumnRenamed("name", "value"), ["to", "value"]).where(allowed)
    member = member.where(F.col("wild") | (F.col("expected") == F.col("value")) | _ends(F.col("qn"), value("expected", "value"))).withColumn("file", F.col("to"))
    plain = t.where("qualifier is null").join(bindings, [t["source_file"] == bindings["at"], t["value"] == bindings["alias"]]).drop(t["alias"])
    plain = plain.join(in_file.withColumnRenamed("name", "expected"), ["to", "expected"]).where(allowed).withColumn("file", F.col("to"))
    same_qualified = local.where(F.col("qualifier").isNotNull() & _ends(F.col("qn"), value("qualifier", "value")))
    # of a name in the whole repository only the number of its symbols matters, and which one if it is the only one
    is_type = F.col("symbol_kind").isin(TYPE_KINDS)
    names = s.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("file", "symbol")).alias("any"), F.count_if(is_type).alias("n_types"), F.min(F.when(is_type, F.struct("file", "symbol"))).alias("any_type"))
    typed_only = F.col("relation").isin("inherits", "implements", "uses_schema")
    everywhere = t.join(names, t["value"] == names["name"]).select(*key, F.when(typed_only, F.col("any_type")).otherwise(F.col("any")).alias("endpoint"), F.when(typed_only, F.col("n_types")).otherwise(F.col("n")).alias("candidates")).where("candidates > 0")
    tiers = [("typed_receiver", 0.99, typed), ("receiver_scope", 1.0, scope), ("import_alias_member", 0.98, member), ("import_alias_symbol", 0.98, plain), ("same_file_qualified", 0.96, same_qualified), ("same_file_name", 0.92, local)]
    symbol = G.resolve_tiers(t, key, [*[(n, c, d.select(*key, end)) for n, c, d in tiers], ("repository_unique_name", 0.75, everywhere)])

    c = targets.where("kind = 'configuration'")
    constant = s.where("symbol_kind = 'constant'")
    near = c.join(constant, [c["source_file"] == constant["file"], c["value"] == constant["name"]])
    known = constant.groupBy("name").agg(F.count(F.lit(1)).alias("candidates"), F.min(F.struct("file", "symbol")).alias("endpoint"))
    far = c.join(known, c["value"] == known["name"]).select(*key, "endpoint", "candidates")
    usage = c.where("source_symbol is not null").select(*key, F.struct(F.col("source_file").alias("file"), F.col("source_symbol").alias("symbol")).alias("endpoint"))
    settings = G.resolve_tiers(c, key, [("same_file_configuration", 1.0, near.select(*key, end)), ("repository_configuration", 0.85, far), ("configuration_usage", 1.0, usage)])

    resolved = keep(reduce(DataFrame.unionByName, [module, symbol, settings]), "resolved")
    label = T.bounded(F.concat_ws(".", "qualifier", "value"))
    hit = resolved.where("status = 'resolved'").select("fact_id", "fact_kind", F.col("relation").alias("kind"), "source_file", "source_symbol", "source_kind", F.col("endpoint.file").alias("target_file"), F.col("endpoint.symbol").alias("target_symbol"), "confidence", F.col("strategy").alias("resolution_strategy"), T.bounded(F.col("target_text")).alias("raw_target"), label.alias("normalized_target"), "relative_path", "start_byte", "target_no")
    kinds = s.select(F.col("symbol").alias("target_symbol"), F.col("symbol_kind").alias("target_kind"))
    calls = hit.where("fact_kind = 'call' and source_kind = 'test'").join(kinds, "target_symbol").where("target_kind <> 'test'").drop("target_kind")
    tested = G.reversed_edges(calls, "tested_by", [("source_file", "target_file"), ("source_symbol", "target_symbol")])
    own = s.where("symbol_kind = 'method' and contains(qn, '.')").withColumn("owner", F.regexp_replace("qn", r"\.[^.]*$", ""))
    types = s.select(F.col("symbol").alias("type"), F.col("file").alias("type_file"), F.col("qn").alias("type_qn"))
    methods = own.join(types, [own["file"] == types["type_file"], own["owner"] == types["type_qn"]]).select("type", "symbol", "file", "name", "n_parameters", "qn")
    pairs = hit.where("kind in ('inherits', 'implements') and source_symbol is not null and target_symbol is not null").select("fact_id", "fact_kind", "confidence", "relative_path", "start_byte", "target_no", F.col("source_symbol").alias("child"), F.col("target_symbol").alias("parent"), F.col("kind").alias("derived_from"))
    mine = methods.select(F.col("type").alias("child"), F.col("symbol").alias("source_symbol"), F.col("file").alias("source_file"), "name", "n_parameters", F.col("qn").alias("child_qn"))
    parents = methods.select(F.col("type").alias("parent"), "name", "n_parameters", F.col("symbol").alias("target_symbol"), F.col("file").alias("target_file"), F.col("qn").alias("parent_qn"))
    over = G.unique_matches(pairs.join(mine, "child"), parents, ["parent", "name", "n_parameters"])
    overrides = over.select("fact_id", "fact_kind", F.lit("overrides").alias("kind"), "source_file", "source_symbol", F.lit("method").alias("source_kind"), "target_file", "target_symbol", "confidence", F.lit("resolved_parent_method_shape").alias("resolution_strategy"), T.bounded(F.col("child_qn")).alias("raw_target"), T.bounded(F.col("parent_qn")).alias("normalized_target"), "relative_path", "start_byte", "target_no")
    every = hit.unionByName(tested).unionByName(overrides)
    text = lambda c: F.coalesce(c, F.lit(""))
    every = every.withColumn("id", T.stable_id(F.lit("relationship"), F.lit(repo), F.col("source_file"), text("source_symbol"), F.col("target_file"), text("target_symbol"), F.col("kind")))
    bad = resolved.where("status <> 'resolved'").select("fact_id", F.col("source_file").alias("file_id"), F.col("status").alias("reason"), "fact_kind", T.bounded(F.col("target_text")).alias("raw_target"), label.alias("normalized_target"), "candidate_count", "strategy")
    return every.select("id", "fact_id", "source_file", "source_symbol", "target_file", "target_symbol", "kind", "confidence", "resolution_strategy", "raw_target", "normalized_target", "relative_path", "start_byte", "target_no"), bad


def _united(evidence: DataFrame) -> DataFrame:
    """One row for each relationship, from the first fact in order of place."""
    first = evidence.withColumn("_k", F.row_number().over(Window.partitionBy("id").orderBy("relative_path", "start_byte", "fact_id", "target_no"))).where("_k = 1")
    return first.select("id", "fact_id", "source_file", "source_symbol", "target_file", "target_symbol", "kind", "confidence", "resolution_strategy", "raw_target", "normalized_target")


def edges_of(graph: Graph) -> DataFrame:
    """The graph's edges between nodes (symbols, or files where there is none), as the traversal wants them."""
    return graph.relationships.select(F.coalesce("source_symbol", "source_file").alias("source"), F.coalesce("target_symbol", "target_file").alias("target"), "kind", F.col("id").alias("edge_id"))


FIELDS = {"relative_path": 2.0, "name": 8.0, "qualified_name": 6.0, "signature": 4.0, "body": 1.0}
_ORDER = ["relative_path", "start_line", "entity_type", "entity_id"]


def postings_of(documents: DataFrame) -> DataFrame:
    """The inverted index of search documents, written once; a key is the entity's type and id."""
    return keep(S.build_postings(documents.withColumn("key", _entity_key()), "key", FIELDS), "postings")


def search_many(index: Index, queries: list[str], limit: int = 20) -> DataFrame:
    """For each query that has words: exact symbols first, then documents with all its terms, by BM25; `limit` of each query.

    All queries are one job over the inverted index: none reads the documents' texts but for the rows that are shown.
    """
    spark = index.files.sparkSession
    if not 1 <= limit <= 100:
        raise ValueError("search_query_invalid")
    asked = spark.createDataFrame([(i, q.strip()) for i, q in enumerate(queries)], "query_id int, query string")
    asked = asked.withColumn("terms", T.search_terms(F.col("query"))).where(F.size("terms") > 0)
    if index.postings is None:
        index.documents = keep(index.documents, "documents")
        index.postings = postings_of(index.documents)
    docs = index.documents.withColumn("key", _entity_key())
    few = F.broadcast(asked.select("query_id", "query"))  # the caller's queries
    symbols = docs.where("entity_type = 'symbol'")
    named = symbols.withColumn("called", F.explode(F.array_distinct(F.array("name", "qualified_name")))).withColumnRenamed("called", "query").join(few, "query")
    exact = named.select(*docs.columns, *few.columns).withColumn("score", T.exact_score(F.col("query"), F.col("qualified_name"))).withColumn("strength", F.lit(0.0))
    hits = S.bm25_postings(index.postings, S.statistics(index.postings), asked.select("query_id", "terms"))
    place = docs.select("key", *_ORDER).join(hits, "key")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bm25"), *_ORDER))
    top = place.withColumn("_k", best).where(F.col("_k") <= 2 * limit).select("query_id", "key", "bm25")
    text = docs.join(F.broadcast(top), "key").join(few, "query_id").withColumn("score", F.round(T.rank_score(F.col("bm25")), 6)).withColumn("strength", -F.col("bm25")).select(*exact.columns)
    shown = S.exact_then_text(exact, text, ["entity_type", "entity_id"], ["strength", *_ORDER], limit, ["query_id"])
    shown = S.highlights(shown.join(F.broadcast(asked.select("query_id", "terms")), "query_id"), "body", "terms", "marked")
    body = F.when(F.col("phase") == 0, F.col("body")).otherwise(F.col("marked"))
    return shown.select("query_id", "query", "position", "entity_type", "entity_id", "kind", "relative_path", "name", "qualified_name", "start_line", "end_line", "score", T.snippet(body, F.col("signature"), F.col("qualified_name"), F.col("name"), F.col("relative_path")).alias("snippet"))


def search(index: Index, query: str, limit: int = 20) -> DataFrame:
    """search_many for one query, which must have a word and be no longer than allowed."""
    if not index.files.sparkSession.range(1).select(F.size(T.search_terms(F.lit(query))).alias("n")).first()["n"]:
        raise ValueError("search_query_invalid")
    return search_many(index, [query], limit).drop("query_id", "query")


def find_node(index: Index, target: str) -> str:
    """The node that a target names: a symbol by id, else a file by id or path, else the only symbol of that (qualified) name."""
    t = F.lit(target)
    symbols = index.symbols.select("id", "name", "qualified_name").where((F.col("id") == t) | (F.col("name") == t) | (F.col("qualified_name") == t))
    files = index.files.where((F.col("file_id") == t) | (F.col("relative_path") == t)).select(F.col("file_id").alias("id"), F.lit(1).alias("tier"))
    rows = symbols.select("id", F.when(F.col("id") == t, 0).otherwise(2).alias("tier")).unionByName(files)
    first = rows.groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id")).orderBy("tier").limit(1).collect() if target else []
    if not first or first[0]["n"] != 1:
        raise ValueError("graph_query_invalid")
    return first[0]["id"]
