"""The registered queries of the training-data operators, over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import decontaminate, html_extract, langid, media, near_dedup, packing, quality, substring_dedup, token_store, url_filter
from quarry.llm.common import crc_bucket, read

VOCABULARY = "byte_bpe_50k.json"
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = quality.learn(docs, labels.where(crc_bucket("doc_id", 5) != 0))
    told = quality.score(docs.select("doc_id", "text"), model)
    return told.select("doc_id", (crc_bucket("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.remove_repeats(docs, window=35, keep_text=False)


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read(spark, sf_dir, "documents"), threshold=0.8).select("doc_id", "class_id")


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_store.write_tokens(read(spark, sf_dir, "documents"), vocabulary(), end_id=0)
    return token_store.read_tokens(manifest).select("doc_id", "start", "n_tokens", "ids_crc32")


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    sounds = media.store_media(media.to_media(read(spark, sf_dir, "documents").select("doc_id", "text")))
    return media.analyse_media(sounds).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), vocabulary(), room=1024, end_id=2)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = langid.learn(docs.where(crc_bucket("doc_id", 4) != 2))
    told = langid.identify(docs.select("doc_id", "text"), model)
    return told.select("doc_id", (crc_bucket("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(read(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), threshold=0.8)
    return found.select("doc_id", "item_id", "n_shared", "n_shingles", "containment")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "verdict string, host string, path string")
    return url_filter.judge(read(spark, sf_dir, "pages").select("page_id", "url"), rules, default="allow").select("page_id", "host", "path", "rule", "verdict")


QUERIES = {f.__name__: f for f in (op1_quality, op2_substring_dedup, op3_near_dedup, op4_token_store, op5_media, op6_packing, op7_language_id, op8_html_extract, op9_decontamination, op10_url_filter)}

_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

ORACLES = {
    "op2_substring_dedup": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
windows AS (
  SELECT doc_id, i AS pos, sha256(array_to_string(w[i:i + 34], ' ')) AS h
  FROM d, range(1, greatest(len(w) - 33, 1)) AS r(i)),
often AS (SELECT h FROM windows GROUP BY h HAVING count(*) > 1),
gone AS (
  SELECT DISTINCT doc_id, pos + k AS pos FROM windows JOIN often USING (h), range(0, 35) AS o(k)),
words AS (SELECT doc_id, i AS pos, w[i] AS word FROM d, range(1, len(w) + 1) AS r(i)),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS t
  FROM words ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, (len(d.w) - coalesce(kept.n, 0))::BIGINT AS n_removed,
       sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)""",
    "op3_near_dedup": f"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
nodes AS (SELECT text, min(doc_id) AS node, any_value(w) AS w FROM w GROUP BY text),
sh AS (
  SELECT node, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
  FROM nodes),
flat AS (SELECT node, len(s) AS n, unnest(s) AS x FROM sh),
links AS (
  SELECT a.node AS a, b.node AS b FROM flat a JOIN flat b ON a.x = b.x AND a.node <> b.node
  GROUP BY a.node, b.node, a.n, b.n HAVING count(*) >= 0.8 * (a.n + b.n - count(*))),
reach(node, other) AS (SELECT node, node FROM nodes UNION SELECT node, b FROM reach JOIN links ON other = a),
classes AS (SELECT node, min(other) AS class_id FROM reach GROUP BY node)
SELECT doc_id, class_id FROM w JOIN nodes USING (text) JOIN classes USING (node)""",
    "op9_decontamination": f"""
WITH d AS (SELECT DISTINCT doc_id, text, {_WORDS} AS w FROM documents),
i AS (SELECT DISTINCT item_id, text, {_WORDS} AS w FROM benchmark),
ds AS (
  SELECT doc_id, text, unnest(list_distinct(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' ')))) AS s
  FROM d WHERE len(w) >= 5),
ls AS (
  SELECT item_id, text, list_distinct(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' '))) AS l
  FROM i WHERE len(w) >= 5),
s AS (SELECT item_id, text, len(l) AS n, unnest(l) AS s FROM ls)
SELECT doc_id, item_id, count(*) AS n_shared, n AS n_shingles, count(*) / n AS containment
FROM ds JOIN s USING (s) GROUP BY doc_id, ds.text, item_id, s.text, n HAVING count(*) >= 0.8 * n""",
    "op10_url_filter": r"""
WITH rules(verdict, rhost, rpath) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'),
  ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
rest AS (
  SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r
  FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rest),
fits AS (
  SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
  FROM parts JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM parts LEFT JOIN fits USING (page_id)""",
}
