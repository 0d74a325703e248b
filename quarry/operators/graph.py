"""Relationship graph: tiered resolution of targets, derived edges, bounded traversal, distances and components of answers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.incremental import keep as written

EDGE_ORDER = ["kind", "source", "target", "edge_id"]
#: Jobs at one node up to which one task joins them with its edges.
JOBS_OF_A_TASK = 500
#: Rows up to which one task sorts what was dealt out by job.
ROWS_OF_A_TASK = 500_000


def resolve_tiers(targets: DataFrame, key: list[str], tiers: list[tuple[str, float, DataFrame]]) -> DataFrame:
    """The first tier that has a candidate decides: one endpoint resolves, several are ambiguous, none is unresolved.

    Each tier is (strategy, confidence, rows of key and endpoint). Adds strategy, confidence, candidate_count, endpoint
    (null unless resolved) and status to every target. The tiers are united and reduced in one aggregation by key.

    A tier whose candidates were counted beforehand has one row for each key, with `candidates`, their number, and any
    one of them: a name that very many symbols bear then costs one row for a target, not all of them.
    """

    def part(i: int, df: DataFrame) -> DataFrame:
        counted = F.col("candidates") if "candidates" in df.columns else F.lit(0)
        return df.select(*key, F.lit(i).alias("tier"), F.col("endpoint"), counted.cast("long").alias("candidates"))

    united = reduce(DataFrame.unionByName, [part(i, df) for i, (_, _, df) in enumerate(tiers)])
    count = F.greatest(F.countDistinct("endpoint"), F.max("candidates"))
    per_tier = united.groupBy(*key, "tier").agg(count.alias("candidate_count"), F.min("endpoint").alias("endpoint"))
    first = per_tier.groupBy(*key).agg(F.min_by(F.struct("tier", "candidate_count", "endpoint"), "tier").alias("x")).select(*key, "x.*")
    names = F.element_at(F.array(*[F.lit(t[0]) for t in tiers]), F.col("tier") + 1)
    sure = F.element_at(F.array(*[F.lit(float(t[1])) for t in tiers]), F.col("tier") + 1)
    joined = targets.join(first, key, "left")
    status = F.when(F.col("tier").isNull(), "unresolved").when(F.col("candidate_count") > 1, "ambiguous").otherwise("resolved")
    return joined.select(
        *targets.columns,
        F.when(F.col("tier").isNotNull(), names).otherwise("no_candidate").alias("strategy"),
        F.when(F.col("tier").isNotNull(), sure).otherwise(0.0).alias("confidence"),
        F.coalesce("candidate_count", F.lit(0)).alias("candidate_count"),
        F.when(F.col("candidate_count") == 1, F.col("endpoint")).alias("endpoint"),
        status.alias("status"),
    )


def reversed_edges(edges: DataFrame, kind: str, ends: list[tuple[str, str]] = [("source", "target")]) -> DataFrame:  # noqa: B006
    """Edges of the other direction, of a new kind: each pair of end columns is exchanged, other columns stay."""
    other = {a: b for pair in ends for a, b in (pair, pair[::-1])}
    return edges.select(*[F.lit(kind).alias(c) if c == "kind" else F.col(other.get(c, c)).alias(c) for c in edges.columns])


def unique_matches(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Left rows with the columns of the only right row of equal values; without one, or with several, a left row goes.

    Right rows are counted by value before the join, so a value that very many rows share costs one row.
    """
    rest = [c for c in right.columns if c not in on]
    once = right.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct(*rest)).alias("_x")).where("_n = 1")
    return left.join(once.select(*on, "_x.*"), on)


def by_job(df: DataFrame, rows: int) -> DataFrame:
    """Rows dealt out by job, to more partitions than usual if there are very many of them."""
    parts = -(-rows // ROWS_OF_A_TASK)
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, "job") if parts > usual else df.repartition("job")


def neighbours(edges: DataFrame, frontier: DataFrame, direction: str, most: int) -> DataFrame:
    """Edges at frontier nodes (job, node) in a direction, with whether their target (`out`) or source (`into`) was reached.

    Of each node the first `most` edges of a direction in canonical order: a node that very many edges meet costs no job
    more. A node of many jobs is dealt out by job, so that its edges do not go to one task.
    """
    nodes = frontier.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / JOBS_OF_A_TASK).cast("int").alias("_shares"))
    jobs = frontier.join(nodes, "node").select("job", "node", F.pmod(F.hash("job"), F.col("_shares")).alias("_share"))

    def met(near: str, is_out: bool) -> DataFrame:
        order = Window.partitionBy("node").orderBy(*[F.asc_nulls_first(c) for c in EDGE_ORDER])
        at = edges.withColumn("node", F.col(near)).join(nodes, "node").withColumn("_r", F.dense_rank().over(order)).where(F.col("_r") <= most)
        dealt = at.select("node", *edges.columns, F.explode(F.sequence(F.lit(0), F.col("_shares") - 1)).alias("_share"))
        return dealt.join(jobs, ["node", "_share"]).select("job", *edges.columns, F.lit(is_out).alias("out"), F.lit(not is_out).alias("into"))

    sides = {"outgoing": [("source", True)], "incoming": [("target", False)], "both": [("source", True), ("target", False)]}[direction]
    return reduce(DataFrame.unionByName, [met(*side) for side in sides])


def traverse(edges: DataFrame, roots: DataFrame, depth: int, limit: int = 500, direction: str = "both", kinds: list[str] | None = None, keep=written) -> tuple[DataFrame, DataFrame]:  # noqa: ANN001
    """Breadth first from roots (job, node) over edges (edge_id, source, target, kind): (edges by job with level, nodes with distance).

    At most `limit` edges for each job, in canonical order within a level; a job stops at the level that exceeds it.
    `keep` cuts lineage between levels, by default through a written table. No kinds, or an empty list, means all.
    """
    if not 1 <= depth <= 5 or not 1 <= limit <= 500:
        raise ValueError("depth is 1 to 5 and limit 1 to 500")
    if kinds:
        edges = edges.where(F.col("kind").isin(*kinds))
    start = roots.select("job", "node").distinct()
    columns, levels, jobs = edges.columns, [], start.select("job").distinct().count()

    def reached() -> DataFrame:
        """Nodes so far with their distance: roots, and the far ends of the edges taken at each level."""
        far = [new.where("fits").select("job", F.explode("reached").alias("node"), "level") for new in levels]
        told = reduce(DataFrame.unionByName, far, start.withColumn("level", F.lit(0)))
        return told.groupBy("job", "node").agg(F.min("level").alias("distance"))

    def taken() -> DataFrame:
        return reduce(DataFrame.unionByName, [new.where("fits").select("job", *columns, "level") for new in levels])

    frontier = start
    for level in range(1, depth + 1):
        # of one node's first limit + 1 edges at most the used ones are known, so one row beyond the room is among them
        met = neighbours(edges, frontier, direction, limit + 1).withColumn("old", F.lit(False))
        if levels:
            met = met.unionByName(taken().select("job", *columns, F.lit(False).alias("out"), F.lit(False).alias("into"), F.lit(True).alias("old")))
        # dealt by job once: what follows stays in its task
        met = by_job(met, jobs * (limit + 1)).groupBy("job", *columns).agg(*[F.max(c).alias(c) for c in ("out", "into", "old")])
        order = Window.partitionBy("job").orderBy(*[F.asc_nulls_first(c) for c in EDGE_ORDER])
        whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        known, fresh = F.col("old").cast("int"), (~F.col("old")).cast("int")
        first = met.withColumn("_room", limit - F.sum(known).over(whole)).withColumn("_r", F.sum(fresh).over(order.rowsBetween(Window.unboundedPreceding, 0)))
        # one row beyond the limit tells that there are more
        new = first.where(~F.col("old") & (F.col("_r") <= F.col("_room") + 1))
        reached_by = F.filter(F.array(F.when(F.col("out"), F.col("target")), F.when(F.col("into"), F.col("source"))), lambda x: x.isNotNull())
        new = new.select("job", *columns, reached_by.alias("reached"), (F.col("_r") <= F.col("_room")).alias("fits"), F.lit(level).alias("level"))
        levels.append(keep(new, f"edges-{level}"))
        frontier = reached().where(F.col("distance") == level).select("job", "node")
        ended = reduce(DataFrame.unionByName, [x.where("not fits").select("job") for x in levels]).distinct()
        frontier = frontier.join(ended, "job", "left_anti")
    return taken(), reached()


def supporting_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """For each reached node the edges that come from a node one step nearer: (job, node, edge_id), by distance."""
    # edges and nodes are dealt by job once; the distance of an edge's ends is then found within the task
    ends = edges.select("job", "edge_id", "source", "target", F.explode(F.array("source", "target")).alias("node"))
    told = ends.withColumn("distance", F.lit(None).cast("int")).unionByName(nodes.select("job", "node", "distance"), allowMissingColumns=True)
    told = by_job(told.where("job is not null and node is not null"), 3 * edges.count())
    told = told.withColumn("distance", F.max("distance").over(Window.partitionBy("job", "node"))).where("source is not null and target is not null")
    at = lambda end: F.max(F.when(F.col("node") == F.col(end), F.col("distance")))
    both = told.groupBy("job", "edge_id", "source", "target").agg(at("source").alias("_s"), at("target").alias("_t"))
    node = F.when(F.col("_s") + 1 == F.col("_t"), F.col("target")).when(F.col("_t") + 1 == F.col("_s"), F.col("source"))
    return both.select("job", node.alias("node"), F.greatest("_s", "_t").alias("distance"), "edge_id").where("node is not null").distinct()
