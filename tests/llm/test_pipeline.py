"""Each stage of the pipeline against plain Python on its own input, and the registered queries' columns."""

import os
import random
from collections import Counter

import pytest
from pyspark.sql import Row

import corpus_pipeline
from quarry.llm.queries import ORACLES, QUERIES
from tests.llm.corpus import SCHEMA, documents, prose
from tests.llm.test_dedup import classes, cover, shingles

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    rng = random.Random(11)
    items = [(i, prose(rng, 25)) for i in range(5)]
    rows = documents()
    docs = spark.createDataFrame(rows, SCHEMA).select(COLUMNS)
    more = spark.createDataFrame([(700 + i, f"{prose(rng, 60)} {t} {prose(rng, 60)}", "en", "src1", 5) for i, t in items], docs.schema)
    docs.union(more).coalesce(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def steps(spark, tables, tmp_path_factory):
    """Input and output rows of each stage."""
    folder, docs, out = tmp_path_factory.mktemp("steps"), spark.read.parquet(f"{tables}/documents.parquet"), []
    for name, f in corpus_pipeline.STAGES:
        f(spark, docs, tables).write.parquet(f"{folder}/{name}")
        done = spark.read.parquet(f"{folder}/{name}")
        out.append((name, docs.collect(), done.collect(), done.columns))
        docs = done
    return {name: rest for name, *rest in out}


def test_all_but_the_last_keep_the_columns(steps):
    assert list(steps) == ["language_id", "near_dedup", "substring_dedup", "decontamination", "packing"]
    assert all(steps[n][2] == COLUMNS for n in list(steps)[:-1])


def test_language_stage_rejects_texts_without_language(steps):
    before, after, _ = steps["language_id"]
    assert Counter(after) == Counter(r for r in before if any(c.isalpha() for c in r.text or ""))


def test_one_of_each_class_stays(steps):
    before, after, _ = steps["near_dedup"]
    assert not Counter(after) - Counter(before)
    apart = lambda rows: {c for _, c in classes([Row(doc_id=i, text=r.text) for i, r in enumerate(rows)])}  # noqa: E731  ids may repeat
    assert len(after) == len(apart(after)) == len(apart(before))
    least = {c for (i, c) in classes(before) if c is not None}
    assert least <= {r.doc_id for r in after}


def test_repeated_passages_go(steps):
    before, after, _ = steps["substring_dedup"]
    want = cover(before, 35)
    assert len(before) == len(after)
    gone = {i for i, _, n, _ in want if n}
    assert gone
    texts = {(r.doc_id, r.text) for r in before}  # ids may repeat
    for r in after:
        assert (r.doc_id in gone) or (r.doc_id, r.text) in texts
    left = Counter((i, n - m) for i, n, m, _ in want)
    assert Counter((r.doc_id, len((r.text or "").encode().split())) for r in after) == left
    assert all(r.n_chars == len(r.text) for r in after if r.doc_id in gone)


def test_leaks_go(spark, steps, tables):
    before, after, _ = steps["decontamination"]
    items = [shingles(r.text) for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()]
    bad = [r for r in before if any(len(i & shingles(r.text)) >= 0.8 * len(i) for i in items)]
    assert bad and Counter(after) == Counter(before) - Counter(bad)


def test_packing_holds_every_document(steps):
    before, after, _ = steps["packing"]
    assert Counter(r.doc_id for r in after if r.piece == 0) == Counter(r.doc_id for r in before)
    fill = Counter()
    for r in after:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 1024


def test_run_equals_the_stages(spark, steps, tables):
    key = lambda r: (r.doc_id is None, r.doc_id, r.piece, r.length, r.ids_crc32)
    got = sorted(map(key, corpus_pipeline.run(spark, tables).collect()))
    assert got == sorted(map(key, steps["packing"][1]))


CONTRACT = {
    "op1_quality": "doc_id held_out score predicted",
    "op2_substring_dedup": "doc_id n_words n_removed kept_sha256",
    "op3_near_dedup": "doc_id class_id",
    "op4_token_store": "doc_id start n_tokens ids_crc32",
    "op5_media": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature",
    "op6_packing": "doc_id piece start length ids_crc32 sequence_id offset",
    "op7_language_id": "doc_id held_out lang_pred score",
    "op8_html_extract": "page_id url text n_chars",
    "op9_decontamination": "doc_id item_id",
    "op10_url_filter": "page_id host path rule verdict",
}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", CONTRACT)
def test_queries_return_what_is_agreed(spark, name):
    assert set(QUERIES) == set(CONTRACT) and set(ORACLES) <= set(QUERIES)
    df = QUERIES[name](spark, SF)
    assert set(CONTRACT[name].split()) <= set(df.columns)
    n = spark.read.parquet(f"{SF}/{'pages' if 'page_id' in df.columns else 'documents'}.parquet").count()
    rows = df.count()
    assert rows >= n if name == "op6_packing" else rows > 0 if name == "op9_decontamination" else rows == n
