"""More registered queries: scans, targets, sets, small orders and decisions; imported by the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import targets
from quarry.functions import text as T
from quarry.operators import compress as C
from quarry.operators import evidence as E
from quarry.operators import graph as G
from quarry.operators import incremental as I
from quarry.plans.catalog import _EVIDENCE, _SIGNALS, _evidence, _scored, query, table
from quarry.sources import diff, scan

#: Ids of several rows up to which they are sent to every executor.
BROADCAST_IDS = 20_000

_EXT = "['py', 'js', 'go', 'txt', 'min.js', 'g.dart', 'TS'][1 + (page_id % 7)]"
_PATH = f"CASE page_id % 5 WHEN 0 THEN 'node_modules/' WHEN 1 THEN 'src/build_x/' ELSE 'lib/' END || 'p' || page_id || '.' || {_EXT}"


@query(f"""WITH f AS (SELECT page_id, {_PATH} AS path, html FROM pages)
SELECT page_id, path, CASE WHEN list_has_any(string_split(path, '/')[:-2], ['node_modules', 'build']) THEN 'excluded_directory' WHEN page_id % 11 = 3 AND starts_with(path, 'lib/') THEN 'ignored'
 WHEN ends_with(path, '.txt') THEN 'unsupported' WHEN ends_with(path, '.min.js') OR ends_with(path, '.g.dart') THEN 'generated' WHEN strlen(html) > 6000 THEN 'oversized'
 WHEN contains(lower(html[1:512]), 'do not edit') THEN 'generated' END AS skip,
 CASE WHEN ends_with(path, '.py') THEN 'python' WHEN ends_with(path, 'js') THEN 'javascript' WHEN ends_with(path, '.go') THEN 'go' WHEN ends_with(path, '.dart') THEN 'dart' WHEN ends_with(path, '.TS') THEN 'typescript' END AS language FROM f""")
def skip_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a file is not indexed, and its language; ignore rules by layer."""
    i = F.col("page_id")
    ext = F.element_at(F.array(*[F.lit(x) for x in ("py", "js", "go", "txt", "min.js", "g.dart", "TS")]), (i % 7 + 1).cast("int"))
    path = F.concat(F.when(i % 5 == 0, "node_modules/").when(i % 5 == 1, "src/build_x/").otherwise("lib/"), F.lit("p"), i, F.lit("."), ext)
    files = table(spark, sf_dir, "pages").select("page_id", path.alias("path"), F.encode("html", "utf-8").alias("content"))
    # one layer below lib/ ignores every eleventh file by a mark in its name
    marked = files.withColumn("judged", F.when((i % 11 == 3) & F.col("path").startswith("lib/"), F.concat(F.lit("lib/skip_"), F.substring("path", 5, 100))).otherwise(F.col("path")))
    reason = scan.skip_reason(F.col("judged"), F.octet_length("content"), F.col("content"), {"": ["*.log"], "lib": ["skip_*"]}, max_bytes=6000)
    return marked.select("page_id", "path", reason.alias("skip"), scan.language_of(F.col("path")).alias("language"))


@query("""WITH f AS (SELECT event_type || ':' || user_id % 10 AS base, event_id FROM events)
SELECT event_id, row_number() OVER (PARTITION BY base ORDER BY event_id) - 1 AS occurrence FROM f""")
def occurrence_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the how manieth of equal base identities each one is."""
    base = F.concat("event_type", F.lit(":"), F.col("user_id") % 10)
    w = Window.partitionBy("base").orderBy("event_id")
    return table(spark, sf_dir, "events").select("event_id", base.alias("base")).select("event_id", (F.row_number().over(w) - 1).cast("long").alias("occurrence"))


@query("""SELECT code, severity, position FROM (SELECT code, severity, row_number() OVER (ORDER BY code, severity) AS position FROM (SELECT DISTINCT p_brand AS code, p_size % 3 AS severity FROM part)) WHERE position <= 32""")
def diagnostics_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diagnostics once each, in order, 32 at most."""
    each = table(spark, sf_dir, "part").select(F.col("p_brand").alias("code"), (F.col("p_size") % 3).alias("severity")).distinct().orderBy("code", "severity").limit(32)
    return each.withColumn("position", F.row_number().over(Window.orderBy("code", "severity")))


@query("""WITH t AS (SELECT DISTINCT c_mktsegment AS target FROM customer UNION SELECT c_name FROM customer WHERE c_custkey % 10 = 0 UNION SELECT 'nobody' UNION SELECT 'Customer#' || c_custkey FROM customer WHERE c_custkey < 5),
m AS (SELECT target, 0 AS step, c_custkey FROM t JOIN customer ON target = 'Customer#' || c_custkey UNION ALL SELECT target, 1, c_custkey FROM t JOIN customer ON target = c_name UNION ALL SELECT target, 2, c_custkey FROM t JOIN customer ON target = c_mktsegment),
f AS (SELECT target, min(step) AS step FROM m GROUP BY target), k AS (SELECT m.target, count(DISTINCT c_custkey) AS n, min(c_custkey) AS node FROM m JOIN f USING (target, step) GROUP BY m.target)
SELECT t.target, CASE WHEN n IS NULL THEN 'unresolved' WHEN n > 1 THEN 'ambiguous' ELSE 'resolved' END AS status, CASE WHEN n = 1 THEN node END AS node FROM t LEFT JOIN k USING (target)""")
def target_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A target is an id, else a path, else a name that only one has."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    parts = [c.select(F.col("c_mktsegment").alias("target")), c.where("c_custkey % 10 = 0").select("c_name"), spark.createDataFrame([("nobody",)], "target string"), c.where("c_custkey < 5").select(F.concat(F.lit("Customer#"), "c_custkey"))]
    t = parts[0].union(parts[1]).union(parts[2]).union(parts[3]).distinct()
    by = lambda key: t.join(c.withColumn("target", key), "target").select("target", F.col("c_custkey").alias("endpoint"))
    found = G.resolve_tiers(t, ["target"], [("id", 1.0, by(F.concat(F.lit("Customer#"), "c_custkey"))), ("path", 1.0, by(F.col("c_name"))), ("name", 1.0, by(F.col("c_mktsegment")))])
    return found.select("target", "status", F.col("endpoint").alias("node"))


@query("""WITH files AS (SELECT p_partkey AS id, 'src/m' || p_partkey % 500 || CASE p_partkey % 4 WHEN 0 THEN '.js' WHEN 1 THEN '.ts' WHEN 2 THEN '/index.ts' ELSE '.py' END AS path FROM part),
imports AS (SELECT o_orderkey AS fact_id, './m' || o_orderkey % 600 AS module FROM orders),
c AS (SELECT fact_id, unnest([e for e in ['.js', '.jsx', '.mjs', '.cjs', '.ts', '.tsx', '.mts', '.cts', '/index.js', '/index.jsx', '/index.mjs', '/index.cjs', '/index.ts', '/index.tsx', '/index.mts', '/index.cts']]) AS e, module FROM imports),
m AS (SELECT DISTINCT fact_id, id FROM c JOIN files ON path = 'src/' || substr(module, 3) || e)
SELECT fact_id, count(*) AS n, CASE WHEN count(*) = 1 THEN min(id) END AS target FROM m GROUP BY fact_id""")
def module_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Module candidates against file paths; a binding holds if it is the only one."""
    p = F.col("p_partkey")
    files = table(spark, sf_dir, "part").select(p.alias("id"), F.lower(F.concat(F.lit("src/m"), p % 500, F.when(p % 4 == 0, ".js").when(p % 4 == 1, ".ts").when(p % 4 == 2, "/index.ts").otherwise(".py"))).alias("path"))
    # a module is looked up once for all facts that import it, and files are counted by path (each has one path) before they are met
    counted = files.groupBy("path").agg(F.countDistinct("id").alias("n"), F.min("id").alias("t"))
    facts = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("fact_id")).distinct().withColumn("module", F.concat(F.lit("./m"), F.col("fact_id") % 600))
    wanted = facts.select("module").distinct().select("module", F.explode(F.transform(T.javascript_module_paths(F.lit("src/a.ts"), F.col("module")), F.lower)).alias("path"))
    found = wanted.join(counted, "path").groupBy("module").agg(F.sum("n").alias("n"), F.min("t").alias("t"))
    return facts.join(found, "module").select("fact_id", "n", F.when(F.col("n") == 1, F.col("t")).alias("target"))


@query("""WITH n AS (SELECT page_id, regexp_extract_all(replace(replace(regexp_replace(url, '\\([^()]*\\)', '', 'g'), '?.', '.'), '::', '.'), '[A-Za-z_$][A-Za-z0-9_$]*') AS x FROM pages)
SELECT page_id, x[-1] AS value, CASE WHEN len(x) > 1 THEN x[-2] END AS qualifier FROM n""")
def call_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last and last but one name of a call."""
    return table(spark, sf_dir, "pages").select("page_id", targets.names(targets.called(F.col("url"))).alias("n")).select("page_id", F.try_element_at("n", F.lit(-1)).alias("value"), F.try_element_at("n", F.lit(-2)).alias("qualifier"))


@query("""SELECT p_partkey, p_type, (p_size % 2 = 0) AND regexp_matches(lower(split_part(p_name || '.' || ['UserModel', 'x', 'Dto', 'responses'][1 + p_partkey % 4], '.', -1)), '(schema|request|response|model|dto)$') AS is_schema FROM part""")
def schema_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of data contracts among types."""
    leaf = F.element_at(F.array(*[F.lit(x) for x in ("UserModel", "x", "Dto", "responses")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    kind = F.when(F.col("p_size") % 2 == 0, "class").otherwise("function")
    return table(spark, sf_dir, "part").select("p_partkey", "p_type", T.is_schema_name(kind, F.concat("p_name", F.lit("."), leaf)).alias("is_schema"))


@query("""WITH e AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), ' ')) AS x FROM documents)
SELECT CASE WHEN regexp_full_match(x, '[A-Za-z_][A-Za-z0-9_.:-]{0,127}') THEN x END AS key, lower(split_part(x, '.', -1)) AS leaf, count(*) AS n, count(DISTINCT doc_id) AS docs FROM e GROUP BY ALL""")
def configuration_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Well-formed configuration keys and leaves of qualified names among all words: how often, and in how many texts."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    again = d.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("doc_id", F.col("doc_id").alias("again"))
    repeated = again.limit(BROADCAST_IDS + 1).count()
    # a word as told: 1 and the key, or 0 and the leaf; sorted within its text, so that no text moves and the first of equal ones is seen
    told = lambda x: F.when(T.configuration_key(x).isNotNull(), F.concat(F.lit("1"), x)).otherwise(F.concat(F.lit("0"), F.lower(F.substring_index(x, ".", -1))))
    texts = d.join(F.broadcast(again) if repeated <= BROADCAST_IDS else again, "doc_id", "left") if repeated else d.withColumn("again", F.lit(None))
    texts = texts.select("doc_id", "again", F.sort_array(F.transform(F.split(F.coalesce("text", F.lit("")), " "), told)).alias("w"))
    words = texts.select("doc_id", "again", F.explode(F.arrays_zip(F.col("w").alias("x"), F.concat(F.array(F.lit(None).cast("string")), "w").alias("before"))).alias("p"))
    words = words.select("again", F.col("p.x").alias("x"), (~F.col("p.x").eqNullSafe(F.col("p.before")) & F.col("doc_id").isNotNull() & F.col("again").isNull()).alias("first")).where("x is not null")
    # rows that share an id are one text
    docs = F.sum(F.col("first").cast("long")) + (F.countDistinct("again") if repeated else F.lit(0))
    keys = words.groupBy("x").agg(F.count(F.lit(1)).alias("n"), docs.alias("docs"))
    rest, is_key = F.expr("substring(x, 2)"), F.col("x").startswith("1")
    return keys.select(F.when(is_key, rest).alias("key"), F.when(is_key, F.lower(F.substring_index(rest, ".", -1))).otherwise(rest).alias("leaf"), "n", "docs")


@query("""WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), ' ') AS w FROM documents), e AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d),
g AS (SELECT doc_id, x, min(i) FILTER (i % 2 = 1) AS a, min(i) FILTER (i % 2 = 0) AS b FROM e GROUP BY doc_id, x)
SELECT doc_id, count(*) AS either, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS both_, count(*) FILTER (b IS NULL) AS only_a,
 sha256(string_agg(x, ' ' ORDER BY a IS NULL, coalesce(a, b))) AS either_sha, sha256(coalesce(string_agg(x, ' ' ORDER BY a) FILTER (a IS NOT NULL AND b IS NOT NULL), '')) AS both_sha,
 sha256(coalesce(string_agg(x, ' ' ORDER BY a) FILTER (b IS NULL), '')) AS only_a_sha FROM g GROUP BY doc_id""")
def array_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H3-H5: ordered union, intersection and difference of the words at odd and at even places of whole texts."""
    w = F.split(F.coalesce("text", F.lit("")), " ")
    d = table(spark, sf_dir, "documents").select("doc_id", F.filter(w, lambda x, i: i % 2 == 0).alias("a"), F.filter(w, lambda x, i: i % 2 == 1).alias("b"))
    d = d.select("doc_id", F.array_distinct(F.concat("a", "b")).alias("either"), F.array_intersect("a", "b").alias("both_"), F.array_except("a", "b").alias("only_a"))
    sets = ("either", "both_", "only_a")
    return d.select("doc_id", *[F.size(c).cast("long").alias(c) for c in sets], *[F.sha2(F.array_join(c, " "), 256).alias(f"{c.rstrip('_')}_sha") for c in sets])


@query("""WITH o AS (SELECT o_orderkey, o_custkey AS a, o_orderkey % 3 + 1 AS n FROM orders)
SELECT o_orderkey AS id, 'o' || o_orderkey || '.py' AS relative_path, a::INT AS old_start, (a + 1)::INT AS new_start, (a + 1)::INT AS changed_from, (a + 1 + n - 1)::INT AS changed_to FROM o WHERE o_orderkey % 5 <> 0""")
def diff_hunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hunks of diffs with their changed lines; unsafe paths are left out."""
    a, n = F.col("o_custkey"), F.col("o_orderkey") % 3 + 1
    path = F.concat(F.when(F.col("o_orderkey") % 5 == 0, "../").otherwise(""), F.lit("o"), F.col("o_orderkey"), F.lit(".py"))
    text = F.concat(F.lit("diff --git a/x b/x\n--- a/"), path, F.lit("\n+++ b/"), path, F.lit("\n@@ -"), a, F.lit(" +"), a + 1, F.lit(","), n, F.lit(" @@ f\n-old\n"), F.repeat(F.lit("+new\n"), n.cast("int")))
    return diff.hunks(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), text.alias("text"))).select("id", "relative_path", "old_start", "new_start", "changed_from", "changed_to")


@query(f"""WITH {_EVIDENCE}, t AS (SELECT ev.doc_id, role, ev.lang, length(text) // 4 AS tokens FROM ev JOIN documents USING (doc_id))
SELECT lang, role, count(*) AS items, sum(greatest(tokens, 1))::BIGINT AS tokens FROM t GROUP BY lang, role""")
def role_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items and tokens by role."""
    text = table(spark, sf_dir, "documents").select("doc_id", F.greatest(F.floor(F.length("text") / 4), F.lit(1)).alias("tokens"))
    return _evidence(spark, sf_dir).join(text, "doc_id").groupBy("lang", "role").agg(F.count(F.lit(1)).alias("items"), F.sum("tokens").alias("tokens"))


@query(f"""WITH {_SIGNALS}, o AS (SELECT lang, source, row_number() OVER (PARTITION BY lang ORDER BY source <> 'src3', exact = 0, score DESC, source) AS seed FROM ranked) SELECT lang, source, seed FROM o WHERE seed <= 3""")
def seed_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three seeds of each request: focus first, then exact, then score."""
    order = (F.asc(F.col("source") != "src3"), F.asc(F.col("exact") == 0), F.desc("score"), F.col("source"))
    return E.rank(_scored(spark, sf_dir), ["lang"], *order).where("rank <= 3").select("lang", "source", F.col("rank").alias("seed"))


@query(f"""WITH {_EVIDENCE}, p AS (SELECT source, list_sort(list_distinct(list(role))) AS roles FROM ev GROUP BY source),
m AS (SELECT source, list_filter(['dependency', 'caller', 'interface', 'test'], lambda r: NOT list_contains(roles, r)) AS missing FROM p)
SELECT source, missing, CASE WHEN source = 'src1' THEN 'refresh_index' WHEN len(missing) > 0 THEN 'expand' ELSE 'none' END AS next_action, list_filter([CASE WHEN len(missing) > 0 THEN 'missing_roles' END, CASE WHEN source = 'src1' THEN 'index_stale' END], lambda x: x IS NOT NULL) AS reasons FROM m""")
def next_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing roles in order, reasons, and what to do next by precedence."""
    wanted = F.array(*[F.lit(r) for r in E.EXPECTED_ROLES["refactor"]])
    m = _evidence(spark, sf_dir).groupBy("source").agg(F.array_except(wanted, F.collect_set("role")).alias("missing"))
    lacking, stale = F.size("missing") > 0, F.col("source") == "src1"
    action = F.when(stale, "refresh_index").when(lacking, "expand").otherwise("none")
    return m.select("source", "missing", action.alias("next_action"), F.array_compact(F.array(F.when(lacking, "missing_roles"), F.when(stale, "index_stale"))).alias("reasons"))


@query("""WITH ranked AS (SELECT p_partkey, lower(p_brand) AS path, (p_size % 10) / 10.0 AS score FROM part),
h AS (SELECT l_orderkey, l_linenumber, 'BRAND#' || (10 + l_orderkey % 60) AS path FROM lineitem)
SELECT l_orderkey, l_linenumber, max(score)::DOUBLE AS score FROM h JOIN ranked ON lower(h.path) = ranked.path GROUP BY l_orderkey, l_linenumber""")
def hunk_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hunks of ranked paths, with the best score of the path."""
    best = table(spark, sf_dir, "part").groupBy(F.lower("p_brand").alias("path")).agg(F.max((F.col("p_size") % 10) / 10.0).alias("score"))
    hunk = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.lower(F.concat(F.lit("BRAND#"), F.lit(10) + F.col("l_orderkey") % 60)).alias("path"))
    return hunk.join(best, "path").groupBy("l_orderkey", "l_linenumber").agg(F.max("score").alias("score"))


@query("""WITH fresh AS (SELECT o_custkey AS file_id, o_orderkey + 1000000 AS v FROM orders WHERE o_custkey % 10 IN (1, 2)), gone AS (SELECT c_custkey AS f FROM customer WHERE c_custkey % 10 IN (1, 3))
SELECT o_custkey AS file_id, o_orderkey AS v FROM orders WHERE o_custkey NOT IN (SELECT f FROM gone) UNION ALL SELECT file_id, v FROM fresh WHERE file_id % 10 <> 2""")
def replace_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of parsed and deleted files are replaced, failed files keep their last good ones."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("file_id"), F.col("o_orderkey").alias("v"))
    files = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("file_id"))
    fresh = orders.where("file_id % 10 in (1, 2)").select("file_id", (F.col("v") + 1_000_000).alias("v"))
    return I.replace_files(orders, fresh, files.where("file_id % 10 in (1, 2)"), files.where("file_id % 10 = 3"), files.where("file_id % 10 = 2"))


@query("""SELECT doc_id, '{"lang":"' || lang || '","missing":null,"n_chars":' || n_chars || '}' AS json FROM documents""")
def json_emission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as JSON with sorted keys, nulls kept."""
    one = F.struct(F.col("lang").alias("lang"), F.lit(None).cast("string").alias("missing"), F.col("n_chars").alias("n_chars"))
    return table(spark, sf_dir, "documents").select("doc_id", F.to_json(one, {"ignoreNullFields": "false"}).alias("json"))


@query()
def compressed_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole conversations as command outputs, made short: runs collapsed, failures and both ends kept, gaps counted."""
    whole = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: F.coalesce(x["text"], F.lit(""))), "\n").alias("text"))
    return C.compress(whole, key="conv_id").select("conv_id", F.sha2("content", 256).alias("content_sha"), F.col("original_lines").cast("long").alias("original_lines"), "repeated")


@query("""SELECT n_regionkey, n_nationkey, row_number() OVER (ORDER BY n_regionkey = 1 DESC, n_regionkey, n_nationkey) AS position FROM nation""")
def canonical_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active first, then in order; a table of fixed size is numbered in one window."""
    w = Window.orderBy(F.desc(F.col("n_regionkey") == 1), "n_regionkey", "n_nationkey")
    return table(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey", F.row_number().over(w).alias("position"))
