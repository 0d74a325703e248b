"""Evidence of candidates: merging, ranking, confidence, selection under caps and budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights of evidence, focus boost, priorities of roles, most evidence of a candidate.
WEIGHTS = {"exact": 0.45, "graph": 0.20, "lexical": 0.25, "test": 0.10}
FOCUS_BOOST = 0.05
DEPTH_DECAY = {1: 1.0, 2: 0.5}
ROLE_PRIORITY = {"primary": 0, "interface": 1, "implementation": 2, "schema": 3, "configuration": 4, "dependency": 5, "caller": 6, "test": 7, "git_diff": 8}
MAX_EVIDENCE = 32
#: Parts of confidence, certainty by case, agreement by number of evidence families, margins, penalties.
CONFIDENCE = {"certainty": 0.40, "agreement": 0.25, "separation": 0.20, "coverage": 0.15}
CERTAINTY = {"missing": 0.0, "ambiguous": 0.35, "fallback": 0.40, "lexical": 0.80, "path_lexical": 0.85, "explicit_focus": 0.85, "exact": 0.95, "exact_explicit_focus": 1.0}
AGREEMENT = [0.0, 0.25, 0.65, 0.90, 1.0]
AMBIGUITY_MARGIN, FULL_SEPARATION, LEXICAL_FLOOR = 0.05, 0.20, 0.70
UNAVAILABLE_PENALTY, TRUNCATED_PENALTY = 0.05, 0.025
#: Roles that an action wants.
EXPECTED_ROLES = {
    "diagnose": ["dependency", "caller", "configuration", "test"],
    "change": ["dependency", "caller", "test"],
    "refactor": ["dependency", "caller", "interface", "test"],
    "test": ["dependency", "test"],
    "explain": ["dependency", "caller", "interface"],
    "unknown": ["dependency", "caller", "test"],
}


def role_priority(role: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in ROLE_PRIORITY.items() for x in kv]), role)


def decayed(kind: str, score: str, distance: str | None) -> Column:
    """A signal in [0, 1]; graph and test signals decay with distance."""
    decay = F.lit(1.0) if distance is None else F.when(F.col(kind).isin("graph", "test"), F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in DEPTH_DECAY.items() for x in kv]), F.col(distance)), F.lit(1.0))).otherwise(1.0)
    return F.least(F.greatest(F.col(score) * decay, F.lit(0.0)), F.lit(1.0))


def merge(evidence: DataFrame, identity: list[str], ordinal: str, role: str, key: list[str], kind: str = "kind", score: str = "score", distance: str | None = None, limit: int = MAX_EVIDENCE) -> DataFrame:
    """One row for each identity: least ordinal, sorted distinct roles, and its distinct evidence as structs of `key`, sorted.

    Of more than `limit` items the strongest of each kind stays, and then the first ones in order.
    """
    own = Window.partitionBy(*identity)
    items = evidence.select(*identity, *key, F.col(kind).alias("_kind"), decayed(kind, score, distance).alias("_signal"), (F.lit(0) if distance is None else F.coalesce(distance, F.lit(0))).alias("_distance"))
    items = items.groupBy(*identity, *key, "_kind").agg(F.max("_signal").alias("_signal"), F.min("_distance").alias("_distance"))
    first = F.row_number().over(Window.partitionBy(*identity, "_kind").orderBy(F.desc("_signal"), "_distance", *key)) > 1
    kept = items.withColumn("_later", first).withColumn("_k", F.row_number().over(own.orderBy("_later", *key, "_kind"))).where(F.col("_k") <= limit)
    held = kept.groupBy(*identity).agg(F.array_sort(F.collect_list(F.struct(*key))).alias("evidence"))
    told = evidence.groupBy(*identity).agg(F.min(ordinal).alias("ordinal"), F.array_sort(F.collect_set(role)).alias("roles"))
    same = [told[c].eqNullSafe(held[c]) for c in identity]
    return told.join(held, same).select(*[told[c] for c in identity], "ordinal", "roles", "evidence")


def signals(evidence: DataFrame, identity: list[str], kind: str = "kind", score: str = "score", distance: str | None = None) -> DataFrame:
    """The strongest signal of each kind."""
    bound = decayed(kind, score, distance)
    return evidence.groupBy(*identity).agg(*[F.coalesce(F.max(F.when(F.col(kind) == k, bound)), F.lit(0.0)).alias(k) for k in WEIGHTS])


def weighted(focus: Column | None = None) -> Column:
    """The weighted sum of the signals, boosted a little towards 1 where the candidate is in focus."""
    s = sum((F.col(k) * w for k, w in WEIGHTS.items()), F.lit(0.0))
    s = F.least(F.greatest(s, F.lit(0.0)), F.lit(1.0))
    return s if focus is None else F.when(focus, s + (1 - s) * FOCUS_BOOST).otherwise(s)


def rank(rows: DataFrame, request: list[str], *order: Column) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*request).orderBy(*order)))


def separation(rows: DataFrame, request: list[str], *order: Column, score: str = "score") -> DataFrame:
    """(request, top, second, separation, ambiguous) from the first two rows of each request."""
    w = Window.partitionBy(*request).orderBy(*order)
    first = rows.withColumn("_k", F.row_number().over(w)).where("_k <= 2")
    two = first.groupBy(*request).agg(F.max(F.when(F.col("_k") == 1, F.col(score))).alias("top"), F.max(F.when(F.col("_k") == 2, F.col(score))).alias("second"))
    margin = F.greatest(F.col("top") - F.col("second"), F.lit(0.0))
    return two.withColumn("separation", F.when(F.col("second").isNull(), 1.0).otherwise(F.least(margin / FULL_SEPARATION, F.lit(1.0)))).withColumn("ambiguous", F.coalesce(F.col("top") - F.col("second") <= AMBIGUITY_MARGIN, F.lit(False)))


def certainty(ambiguous: Column, exact: Column, focus: Column, lexical: Column, is_text: Column) -> Column:
    c = {k: F.lit(v) for k, v in CERTAINTY.items()}
    return (
        F.when(ambiguous, c["ambiguous"]).when((exact > 0) & focus, c["exact_explicit_focus"]).when(exact > 0, c["exact"]).when(focus, c["explicit_focus"])
        .when((lexical >= LEXICAL_FLOOR) & is_text, c["path_lexical"]).when(lexical > 0, c["lexical"]).otherwise(c["fallback"])
    )


def agreement(families: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in AGREEMENT]), F.least(families, F.lit(len(AGREEMENT) - 1)).cast("int") + 1)


def confidence(certain: Column, agree: Column, separate: Column, coverage: Column, penalty: Column | None = None) -> Column:
    total = certain * CONFIDENCE["certainty"] + agree * CONFIDENCE["agreement"] + separate * CONFIDENCE["separation"] + coverage * CONFIDENCE["coverage"]
    return F.least(F.greatest(total - (F.lit(0.0) if penalty is None else penalty), F.lit(0.0)), F.lit(1.0))


def capped_round_robin(rows: DataFrame, request: list[str], role: str, caps: Column, role_order: Column, *order: Column) -> DataFrame:
    """The first rows of each role up to its cap, and their `turn` when roles take turns: first of each, second of each, ..."""
    own = rows.withColumn("in_role", F.row_number().over(Window.partitionBy(*request, role).orderBy(*order))).where(F.col("in_role") <= caps)
    return own.withColumn("turn", F.row_number().over(Window.partitionBy(*request).orderBy("in_role", role_order)))


def within_budget(rows: DataFrame, request: list[str], cost: str, budget: int, *order: Column) -> DataFrame:
    """The longest beginning of each request's rows whose costs sum to the budget at most; adds `upto`."""
    w = Window.partitionBy(*request).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("upto", F.sum(cost).over(w)).where(F.col("upto") <= budget)


def greedy_budget(items: DataFrame, request: str, available: int) -> DataFrame:
    """Items (request, position, cost, hash) in order of position, taken while they fit; equal hashes once; adds `used`.

    A later small item may fit where an earlier large one did not, so the state is folded over the ordered items of a
    request (a bounded number, as candidates are capped) with an aggregate expression inside one row.
    """
    one = F.struct("position", F.col("cost").cast("long").alias("cost"), "hash")
    held = items.groupBy(request).agg(F.array_sort(F.collect_list(one)).alias("x"))
    kind = items.select(F.array(one).alias("a")).schema["a"].dataType.simpleString()
    zero = F.struct(F.lit(0).cast("long").alias("used"), F.lit(None).cast(kind).alias("taken"))
    zero = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(kind).alias("taken"))

    def step(state: Column, item: Column) -> Column:
        known = F.exists(state["taken"], lambda t: t["hash"] == item["hash"])
        fits = (state["used"] + item["cost"] <= available) & ~known
        more = F.struct((state["used"] + item["cost"]).alias("used"), F.concat(state["taken"], F.array(item)).alias("taken"))
        return F.when(fits, more).otherwise(state)

    done = held.select(request, F.aggregate("x", zero, step).alias("s"))
    return done.select(request, F.col("s.used").alias("used"), F.explode("s.taken").alias("t")).select(request, "used", "t.*")
