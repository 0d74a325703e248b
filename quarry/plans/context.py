"""From a task in words to a bundle of code snippets within a token budget, on a code index and its graph.

Everything that grows with the index is a Spark plan over it: all planned searches are one job, all graph branches of all
seeds another, ranking and snippet choice work on rows. What is small by its bounds (12 queries, 3 seeds, 200 candidates)
is ordered and packed on the driver, as the order of choice matters there.

If the first pass leaves confidence under the threshold, one second pass goes two steps from the seeds that are in doubt,
for the roles that are missing, and only what was not seen yet is added; then all is ranked and judged anew.
"""

from __future__ import annotations

import hashlib
import subprocess
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.logs import stage_log
from quarry.operators import evidence as E
from quarry.operators.incremental import keep
from quarry.plans import code_index
from quarry.sources import diff

#: Graph branches by role (direction, relations), caps, bounds.
BRANCHES = {
    "caller": ("incoming", ["calls"]),
    "dependency": ("outgoing", ["calls", "imports"]),
    "interface": ("outgoing", ["inherits", "implements", "overrides"]),
    "implementation": ("incoming", ["inherits", "implements", "overrides"]),
    "schema": ("outgoing", ["uses_schema"]),
    "test": ("outgoing", ["tested_by"]),
    "configuration": ("outgoing", ["configured_by"]),
}
CAPS = {"primary": 3, "interface": 6, "implementation": 6, "schema": 6, "configuration": 6, "dependency": 6, "caller": 6, "test": 4, "git_diff": 5}
STAGES = [["primary"], ["interface", "implementation", "schema", "configuration", "dependency"], ["caller"], ["test"], ["git_diff"]]
RESERVED_FIRST = ["primary", "caller", "dependency", "interface", "implementation", "schema", "configuration", "test"]
SEARCH_LIMIT, SEEDS, CANDIDATES, THRESHOLD = 20, 3, 200, 0.80
MARGIN, ENVELOPE = 0.10, 256
HUNKS, DIAGNOSTICS = 5, 32
#: Order of reasons; those that forbid acceptance; diagnostics that cost confidence.
REASONS = ["missing_primary", "ambiguous_target", "low_separation", "missing_roles", "retrieval_degraded", "unique_target", "explicit_focus", "evidence_agreement", "widened"]
BLOCKING = {"missing_primary", "ambiguous_target", "low_separation", "retrieval_degraded"}
UNAVAILABLE, TRUNCATED = {"search_unavailable", "graph_unavailable", "git_unavailable", "index_stale"}, {"git_truncated"}


@dataclass
class Bundle:
    task: str
    action: str
    queries: list[str]
    ranked: list[dict]
    confidence: float
    reasons: list[str]
    missing_roles: list[str]
    snippets: list[dict] = field(default_factory=list)
    budget: dict = field(default_factory=dict)
    next_action: str = "none"
    status: str = "degraded"
    initial_confidence: float = 0.0
    expansions: int = 0
    diagnostics: list[dict] = field(default_factory=list)
    recommended_focus: str | None = None


def diagnostic(code: str, message: str, role: str | None = None, severity: str = "warning") -> dict:
    return {"code": code, "severity": severity, "role": role, "message": message}


def bounded_diagnostics(rows: list[dict]) -> list[dict]:
    """Each once, in order of code, severity, role and message, at most DIAGNOSTICS."""
    return [dict(zip(("code", "severity", "role", "message"), k)) for k in sorted({(r["code"], r["severity"], r["role"] or "", r["message"]) for r in rows})[:DIAGNOSTICS]]


def penalty_of(diagnostics: list[dict]) -> float:
    codes = {d["code"] for d in diagnostics}
    return (E.UNAVAILABLE_PENALTY if codes & UNAVAILABLE else 0.0) + (E.TRUNCATED_PENALTY if codes & TRUNCATED else 0.0)


def tokens(text: str) -> int:
    return max(len(text) // 4, 1, text.count("\n") + 1) if text else 0


def resolve_task(index: code_index.Index, task: str, focus: list[str]) -> dict:
    """The task's parts and its planned searches, by the column functions, on one row."""
    if not task.strip() or len(task) > 4000 or not any(c.isalnum() for c in task) or len(focus) > 10 or any(len(f) > 500 for f in focus):
        raise ValueError("context_request_invalid")
    t = F.col("task")
    one = index.files.sparkSession.createDataFrame([(task.strip(), [f.strip() for f in focus if f.strip()])], "task string, focus array<string>")
    parts = one.select("task", F.array_distinct("focus").alias("focus"), T.qualified_identifiers(t).alias("qualified"), T.identifiers(t).alias("identifiers"), T.path_candidates(t).alias("paths"), T.quoted_phrases(t).alias("phrases"), T.task_action(t).alias("action"))
    told = parts.withColumn("lexical", T.lexical_queries(F.col("qualified"), F.col("phrases"), F.col("identifiers")))
    values = [F.col(c) for c in ("focus", "qualified", "paths", "phrases", "lexical")]
    return told.withColumn("planned", T.planned_queries(*values, t)).withColumn("discarded", T.discarded_inputs(*values)).first().asDict()


def stage_one(index: code_index.Index, queries: list[str]) -> DataFrame:
    """Evidence rows of all searches."""
    rows = code_index.search_many(index, queries, SEARCH_LIMIT)
    named = (F.col("entity_type") == "symbol") & ((F.col("name") == F.col("query")) | (F.col("qualified_name") == F.col("query")))
    kind = F.when(F.coalesce(named, F.lit(False)), "exact").otherwise("lexical")
    return rows.select("entity_type", "entity_id", "relative_path", "name", "qualified_name", "start_line", "end_line", kind.alias("evidence"), "score", F.lit("primary").alias("role"), (F.col("position") - 1 + F.col("query_id") * SEARCH_LIMIT).alias("ordinal"), F.lit(None).cast("string").alias("seed"), F.lit(1).alias("distance"))


def stage_two(index: code_index.Index, graph: code_index.Graph, seeds: list[str], depth: int = 1, roles: list[str] | None = None) -> DataFrame:
    """Evidence rows of the graph branches (all, or those of `roles`) of all seeds, up to `depth` steps away.

    Every step keeps at most the role's cap for each branch, so what is sent to the tasks stays below 3 x 7 x 6 rows a step.
    """
    spark = index.files.sparkSession
    wanted = [(b, role, way, kinds) for b, (role, (way, kinds)) in enumerate(BRANCHES.items()) if roles is None or role in roles]
    jobs = [(s, k * len(BRANCHES) + b, role, way, kinds, CAPS[role], s) for k, s in enumerate(seeds) for b, role, way, kinds in wanted]
    frontier = spark.createDataFrame(jobs, "seed string, job int, role string, way string, kinds array<string>, cap int, node string")
    edges = code_index.edges_of(graph).join(graph.relationships.select(F.col("id").alias("edge_id"), "confidence"), "edge_id")
    symbol = index.symbols.select(F.lit("symbol").alias("entity_type"), F.col("id").alias("entity_id"), "relative_path", "name", "qualified_name", "start_line", "end_line")
    file = index.files.select(F.lit("file").alias("entity_type"), F.col("file_id").alias("entity_id"), "relative_path", F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("qualified_name"), F.lit(1).alias("start_line"), "end_line")
    entities, seen, levels = symbol.unionByName(file), frontier.select("job", F.col("node").alias("entity_id")), []
    job = ["seed", "job", "role", "way", "kinds", "cap"]
    for level in range(1, depth + 1):
        met = []
        for way, near, far in (("outgoing", "source", "target"), ("incoming", "target", "source")):
            from_here = F.broadcast(frontier.where(F.col("way") == way))
            met.append(edges.join(from_here, F.col(near) == F.col("node")).where(F.array_contains("kinds", F.col("kind"))).select(*job, F.col("kind").alias("relation"), F.col(far).alias("entity_id"), "confidence"))
        rows = met[0].unionByName(met[1]).join(seen, ["job", "entity_id"], "left_anti").join(entities, "entity_id")
        place = F.dense_rank().over(Window.partitionBy("job").orderBy("relative_path", "start_line", "entity_type", "entity_id"))
        rows = keep(rows.withColumn("place", place).where(F.col("place") <= F.col("cap")).withColumn("distance", F.lit(level)), "branches")
        levels.append(rows)
        frontier = rows.select(*job, F.col("entity_id").alias("node")).distinct()
        seen = seen.union(rows.select("job", "entity_id")).distinct()
    rows = levels[0]
    for more in levels[1:]:
        rows = rows.unionByName(more)
    kind = F.when(F.col("relation") == "tested_by", "test").otherwise("graph")
    ordinal = F.lit(10_000) * F.col("distance") + F.col("job") * 100 + F.col("place") - 1
    return rows.select("entity_type", "entity_id", "relative_path", "name", "qualified_name", "start_line", "end_line", kind.alias("evidence"), F.col("confidence").alias("score"), "role", ordinal.alias("ordinal"), "seed", "distance")


IDENTITY = ["entity_type", "entity_id", "relative_path", "name", "qualified_name", "start_line", "end_line"]


def ranked(evidence: DataFrame, focus: list[str]) -> DataFrame:
    """Candidates with roles, signals, score and rank."""
    merged = E.merge(evidence, IDENTITY, "ordinal", "role", ["evidence", "ordinal", "score"], kind="evidence", distance="distance")
    merged = merged.orderBy("ordinal", "relative_path", "start_line", "entity_type", "entity_id").limit(CANDIDATES)
    strong = E.signals(evidence, ["entity_type", "entity_id"], kind="evidence", distance="distance")
    in_focus = T.any_of([F.coalesce(F.col(c), F.lit("")).isin(*focus) for c in ("entity_id", "relative_path", "name", "qualified_name")]) if focus else F.lit(False)
    rows = merged.join(strong, ["entity_type", "entity_id"]).withColumn("focus", in_focus).withColumn("score", E.weighted(F.col("focus")))
    priority = F.array_min(F.transform("roles", E.role_priority))
    return E.rank(rows.withColumn("all", F.lit(1)), ["all"], F.desc("score"), F.desc("focus"), priority, F.col("relative_path"), F.col("start_line"), F.col("entity_type"), F.col("entity_id")).drop("all")


@dataclass
class Judged:
    value: float
    reasons: list[str]
    missing: list[str]
    in_doubt: list[str]


def assess(spark: SparkSession, rows: list[dict], evidence: list[dict], action: str, diagnostics: list[dict] = (), widened: bool = False) -> Judged:  # noqa: B006
    """Confidence, reasons, missing roles and the seeds in doubt, of at most CANDIDATES ranked rows."""
    primary = [r for r in rows if "primary" in r["roles"]]
    named = [r for r in primary if r["entity_type"] in ("symbol", "chunk") and (r["qualified_name"] or r["name"])] or primary
    logical: dict[tuple, dict] = {}
    for r in named:
        logical.setdefault((r["relative_path"], r["qualified_name"] or r["name"] or r["entity_id"]), r)
    wanted = E.EXPECTED_ROLES[action]
    present = {role for r in rows for role in r["roles"]}
    missing = [r for r in wanted if r not in present]
    coverage, penalty = (len(wanted) - len(missing)) / len(wanted), penalty_of(diagnostics)
    on = {"missing_roles": bool(missing), "retrieval_degraded": penalty > 0, "widened": widened, "missing_primary": not logical}
    if not logical:
        return Judged(max(E.CONFIDENCE["coverage"] * coverage - penalty, 0.0), [r for r in REASONS if on.get(r)], missing, [])
    first = list(logical.values())
    top, two = first[0], first[:2]
    apart = len(two) == 2 and top["focus"] and not two[1]["focus"]
    families = {e["evidence"] for e in evidence if (e["entity_type"], e["entity_id"]) == (top["entity_type"], top["entity_id"]) or e["seed"] == top["entity_id"]}
    pair = spark.createDataFrame([(0, k, r["score"]) for k, r in enumerate(two[:1] if apart else two)], "request int, k int, score double")
    told = E.separation(pair, ["request"], F.col("k"))
    is_text = F.lit(top["entity_type"] in ("file", "chunk"))
    certain = E.certainty(F.col("ambiguous"), F.lit(top["exact"]), F.lit(bool(top["focus"])), F.lit(top["lexical"]), is_text)
    agree = E.agreement(F.lit(len(families)))
    value = E.confidence(certain, agree, F.col("separation"), F.lit(coverage), F.lit(penalty))
    got = told.select("separation", "ambiguous", value.alias("value"), agree.alias("agree")).first()
    on |= {"ambiguous_target": got["ambiguous"], "unique_target": not got["ambiguous"], "low_separation": len(first) > 1 and got["separation"] < 0.5, "explicit_focus": bool(top["focus"]), "evidence_agreement": got["agree"] >= E.AGREEMENT[2]}
    in_doubt = []
    if got["ambiguous"]:
        in_doubt = [r["entity_id"] for r in first if top["score"] - r["score"] <= E.AMBIGUITY_MARGIN][:SEEDS]
    elif missing or not top["exact"]:
        in_doubt = [top["entity_id"]]
    return Judged(got["value"], [r for r in REASONS if on.get(r)], missing, in_doubt)


def relevant_hunks(index: code_index.Index, patch: str, rows: list[dict], told: list[str]) -> tuple[list[dict], list[str], bool]:
    """(snippets of a diff's hunks in ranked files or files that the task names, all changed paths, whether hunks were left out)."""
    spark = index.files.sparkSession
    all_hunks = diff.hunks(spark.createDataFrame([(0, patch)], "id int, text string"), max_hunks=HUNKS + 1).orderBy("hunk_no").collect()
    best: dict[str, float] = {}
    for r in rows:
        best[r["relative_path"].lower()] = max(best.get(r["relative_path"].lower(), 0.0), r["score"])
    wanted = set(best) | {t.lower() for t in told}
    out = []
    for h in all_hunks[:HUNKS]:
        if h["relative_path"].lower() in wanted and h["content"]:
            out.append({"content_hash": h["content_hash"], "relative_path": h["relative_path"], "start_line": max(h["changed_from"], 1), "end_line": max(h["changed_to"], 1), "source_text": h["content"], "a": max(h["changed_from"], 1), "b": h["changed_to"], "score": best.get(h["relative_path"].lower(), 0.0), "rank": None, "roles": ["git_diff"]})
    return out, [h["relative_path"] for h in all_hunks], len(all_hunks) > HUNKS


def freshness(index: code_index.Index, root: str, path: str | None, changed: list[str]) -> list[dict]:
    """Whether the first target's file is in the diff and differs on disk from what was indexed."""
    if path is None or path not in changed:
        return []
    stored = index.files.where(F.col("relative_path") == path).select("content_hash").first()
    at = Path(root) / path
    now = hashlib.sha256(at.read_bytes()).hexdigest() if at.is_file() else None
    return [] if stored and now == stored["content_hash"] else [diagnostic("index_stale", f"{path} changed since it was indexed", "primary")]


def after_choice(judged: Judged, prepared: list[dict], shown: list[dict]) -> tuple[float, str, list[str], list[str]]:
    """(confidence, status, reasons, missing roles) once snippets were chosen: roles that had snippets but lost them count as
    missing and hold confidence under the threshold; if none did, only blocking reasons keep a bundle from being accepted."""
    had, has = ({role for i in items for role in i["roles"]} - {"primary"} for items in (prepared, shown))
    lost = sorted(had - has, key=E.ROLE_PRIORITY.get)
    if lost:
        reasons = [r for r in REASONS if r in {*judged.reasons, "missing_roles"}]
        return min(judged.value, THRESHOLD - 0.01), "degraded", reasons, lost
    if judged.value >= THRESHOLD or BLOCKING & set(judged.reasons):
        return judged.value, "accepted" if judged.value >= THRESHOLD else "degraded", judged.reasons, []
    return THRESHOLD, "accepted", [r for r in judged.reasons if r != "missing_roles"], []


def next_action(reasons: list[str], missing: list[str], status: str, codes: set[str], focus: str | None, truncated: bool) -> str:
    if "index_stale" in codes:
        return "refresh_index"
    if {"missing_primary", "ambiguous_target"} & set(reasons):
        return "manual_fallback"
    if missing or (truncated and status == "degraded"):
        return "expand" if focus else "manual_fallback"
    return "manual_fallback" if codes & {"search_unavailable", "graph_unavailable"} or status == "degraded" else "none"


def materialize(index: code_index.Index, candidates: DataFrame) -> DataFrame:
    """Each candidate's narrowest chunk: its own, its symbol's, or one that contains it; a file's shortest one."""
    c = candidates.select("entity_type", "entity_id", "relative_path", F.col("start_line").alias("a"), F.col("end_line").alias("b"), "roles", "score", "rank")
    met = c.join(index.chunks.select("id", "symbol_id", "relative_path", "start_line", "end_line", "content_hash", "source_text"), "relative_path")
    fits = F.when((F.col("entity_type") == "chunk") & (F.col("id") == F.col("entity_id")), 0).when(F.col("symbol_id") == F.col("entity_id"), 1).when(F.col("entity_type") == "file", 3)
    fits = fits.when((F.col("start_line") <= F.col("a")) & (F.col("end_line") >= F.col("b")), 2).otherwise(4)
    w = Window.partitionBy("entity_type", "entity_id").orderBy("fit", F.col("end_line") - F.col("start_line"), "start_line", "id")
    best = met.withColumn("fit", fits).where("fit < 4").withColumn("_k", F.row_number().over(w)).where("_k = 1")
    one = best.groupBy("content_hash").agg(F.min_by(F.struct("relative_path", "start_line", "end_line", "source_text", "a", "b", "score", "rank"), "rank").alias("x"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("roles")))).alias("roles"))
    return one.select("content_hash", "x.*", "roles")


def crop(text: str, focus: int, room: int) -> str | None:
    """Lines around the focus line, grown by turns before and after while the estimate fits; None if nothing does."""
    lines = text.split("\n")
    focus = min(max(focus, 0), len(lines) - 1)

    def shown(a: int, b: int) -> str:
        head = [f"... {a} line(s) omitted ..."] if a else []
        tail = [f"... {len(lines) - b} line(s) omitted ..."] if b < len(lines) else []
        return "\n".join([*head, *lines[a:b], *tail])

    a, b = focus, focus + 1
    if tokens(shown(a, b)) > room:
        return None
    grown, before = True, True
    while grown:
        grown = False
        for _ in range(2):
            x, y = (a - 1, b) if before else (a, b + 1)
            before = not before
            if x >= 0 and y <= len(lines) and tokens(shown(x, y)) <= room:
                a, b, grown = x, y, True
    return shown(a, b)


def fill(items: list[dict], requested: int) -> tuple[list[dict], dict]:
    """Snippets within the budget: the best of each role first, then stage by stage, roles of a stage taking turns."""
    reserved = min(requested, int(requested * MARGIN) + ENVELOPE)
    room, used, taken, seen = requested - reserved, 0, [], set()
    items = sorted(items, key=lambda i: (-i["score"], min(E.ROLE_PRIORITY[r] for r in i["roles"]), i["relative_path"], i["start_line"], i["end_line"], i["content_hash"]))
    by = {role: [i for i in items if role in i["roles"]][:cap] for role, cap in CAPS.items()}
    order = [by[r][0] for r in RESERVED_FIRST if by[r]]
    for stage in STAGES:
        for turn in range(max((len(by[r]) for r in stage), default=0)):
            order += [by[r][turn] for r in stage if turn < len(by[r])]
    for i in order:
        if i["content_hash"] in seen or used >= room:
            continue
        content = i["source_text"]
        if tokens(content) > room - used:
            content = crop(content, i["a"] - i["start_line"], room - used)
            if content is None:
                continue
        seen.add(i["content_hash"])
        used += tokens(content)
        role = min(i["roles"], key=E.ROLE_PRIORITY.get)
        taken.append({"relative_path": i["relative_path"], "start_line": i["start_line"], "end_line": i["end_line"], "role": role, "roles": i["roles"], "content": content, "content_hash": i["content_hash"], "tokens": tokens(content), "cropped": content != i["source_text"]})
    before = sum(tokens(i["source_text"]) for i in items)
    return taken, {"requested": requested, "reserved": reserved, "used": used, "remaining": requested - reserved - used, "pre_budget": before, "saved": max(before - used, 0), "omitted": len(items) - len(taken)}


def resolve(index: code_index.Index, graph: code_index.Graph | None, task: str, focus: list[str] | None = None, max_tokens: int = 3000, root: str | None = None) -> Bundle:
    """The bundle of one task; equal inputs give equal bundles.

    With the tree's `root`, hunks of its working diff enter, and an index that is older than the first target's file is told.
    Without a graph only searches count.
    """
    if not 256 <= max_tokens <= 12_000:
        raise ValueError("context_request_invalid")
    code_index.same_repository(index, graph)
    spark = index.files.sparkSession
    with stage_log("task") as counts:
        parts = resolve_task(index, task, focus or [])
        counts["queries"] = len(parts["planned"])
    queries, notes = list(parts["planned"]), []
    if parts["discarded"]:
        notes.append(diagnostic("input_discarded", "some searches that the task asks for were left out by bounds", severity="info"))
    if not queries:
        return Bundle(task, parts["action"], [], [], 0.0, ["missing_primary"], E.EXPECTED_ROLES[parts["action"]], next_action="manual_fallback")
    if graph is None:
        notes.append(diagnostic("graph_unavailable", "there is no graph of the repository"))
    with stage_log("search"):
        found = keep(stage_one(index, queries), "stage-one")
    wanted = [q.lower() for q in queries if len(q) >= 6]
    leaf = F.lower(F.regexp_extract("relative_path", r"([^/]*)$", 1))
    fits = T.any_of([leaf.contains(q) for q in wanted])
    in_focus = T.any_of([F.coalesce(F.col(c), F.lit("")).isin(*parts["focus"]) for c in ("entity_id", "relative_path", "name", "qualified_name")]) if parts["focus"] else F.lit(False)
    each = found.groupBy(*IDENTITY).agg(F.min("ordinal").alias("ordinal"), F.max("score").alias("most"), F.max(F.when(F.col("evidence") == "exact", 1).otherwise(0)).alias("exact"))
    order = [F.desc(in_focus), F.desc(fits), F.desc("exact"), F.desc("most"), F.desc(F.col("entity_type") == "symbol"), "ordinal", "relative_path", "start_line", "entity_type", "entity_id"]
    first = each.orderBy(*order).limit(SEEDS).collect()
    seeds = [r.entity_id for r in first]

    patch = ""
    if root is not None:
        try:
            patch = diff.working_tree(root)
        except (OSError, subprocess.SubprocessError) as e:
            notes.append(diagnostic("git_unavailable", f"no diff of the working tree: {type(e).__name__}", "git_diff"))
        else:
            _, changed, cut = relevant_hunks(index, patch, [], [])
            notes += [diagnostic("git_truncated", "the diff has more hunks than are shown", "git_diff")] if cut else []
            notes += freshness(index, root, first[0].relative_path if first else None, changed)

    def judge(evidence: DataFrame, widened: bool) -> tuple[DataFrame, list[dict], Judged]:
        rows = keep(ranked(evidence, parts["focus"]), "ranked")
        top = [r.asDict() for r in rows.orderBy("rank").collect()]  # CANDIDATES at most
        seen = [r.asDict() for r in evidence.select("entity_type", "entity_id", "evidence", "seed").distinct().limit(CANDIDATES * E.MAX_EVIDENCE).collect()]
        return rows, top, assess(spark, top, seen, parts["action"], notes, widened)

    with stage_log("graph") as counts:
        counts["seeds"] = len(seeds)
        evidence = keep(found.unionByName(stage_two(index, graph, seeds)) if seeds and graph else found, "evidence")
    with stage_log("rank") as counts:
        rows, top, judged = judge(evidence, False)
        counts["candidates"] = len(top)
    initial, expansions = judged.value, 0
    truncated = parts["discarded"] > 0 or evidence.select("entity_type", "entity_id").distinct().count() > CANDIDATES
    if judged.value < THRESHOLD:
        expansions = 1
        with stage_log("widen") as counts:
            if graph and judged.in_doubt:
                known = evidence.select("entity_type", "entity_id").distinct()
                new = stage_two(index, graph, judged.in_doubt, 2, judged.missing or E.EXPECTED_ROLES[parts["action"]]).join(known, ["entity_type", "entity_id"], "left_anti")
                evidence = keep(evidence.unionByName(new), "widened")
            rows, top, judged = judge(evidence, True)
            counts["candidates"] = len(top)

    with stage_log("choose") as counts:
        prepared = [r.asDict() for r in materialize(index, rows).collect()]
        if patch:
            prepared += relevant_hunks(index, patch, top, [*parts["paths"], *parts["focus"]])[0]
        snippets, budget = fill(prepared, max_tokens)
        counts |= {"snippets": len(snippets), "tokens": budget["used"]}
    value, status, reasons, missing = after_choice(judged, prepared, snippets)
    has, meant = {r for s in snippets for r in s["roles"]}, {r for t in top for r in t["roles"]}
    for role in sorted({*missing, *(meant - has)}, key=E.ROLE_PRIORITY.get):
        notes.append(diagnostic("role_missing", "a role has no snippet", role))
    if budget["omitted"]:
        notes.append(diagnostic("budget_omitted", "snippets were left out by caps or budget"))
    lead = next((r for r in top if "primary" in r["roles"]), None)
    recommended = lead and (lead["qualified_name"] or lead["name"] or f"{lead['relative_path']}:{lead['start_line']}")
    notes = bounded_diagnostics(notes)
    action = next_action(reasons, missing, status, {d["code"] for d in notes}, recommended, truncated)
    return Bundle(task, parts["action"], queries, top, value, reasons, missing, snippets, budget, action, status, initial, expansions, notes, recommended)
