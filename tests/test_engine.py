import json
import os

import pytest
from pyspark.sql import functions as F

from quarry import logs
from quarry.functions import text as T
from quarry.functions.identity import stable_id
from quarry.operators import evidence, incremental, search
from quarry.settings import EngineError, Registry, load_settings
from quarry.streaming import documents


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("parts", [("file", "r", "a/b.py"), ("é", "", "日本"), ("x",)])
def test_stable_ids_agree(spark, parts):
    assert value(spark, T.stable_id(*[F.lit(p) for p in parts])) == stable_id(*parts)


@pytest.mark.parametrize(("text", "n"), [("", 0), ("abc", 1), ("a" * 40, 10), ("a\nb\nc", 3), ("\n", 2)])
def test_token_estimates(spark, text, n):
    assert value(spark, T.token_estimate(F.lit(text))) == n


TASKS = {
    "Fix Service.run in src/app/main.py": {"action": "change", "qualified": ["Service.run", "main.py"], "paths": ["src/app/main.py", "Service.run"]},
    "Why is the build failing?": {"action": "diagnose"},
    "Add tests for 'parse tree'": {"action": "test", "phrases": ["parse tree"]},
    "explain how fetchUser works": {"action": "explain", "identifiers": ["explain", "fetchUser", "works"]},
    "rename Alpha to Beta": {"action": "refactor"},
    "nothing of note": {"action": "unknown"},
}


@pytest.mark.parametrize("task", TASKS)
def test_tasks(spark, task):
    t = F.lit(task)
    got = {"action": T.task_action(t), "qualified": T.qualified_identifiers(t), "identifiers": T.identifiers(t), "paths": T.path_candidates(t), "phrases": T.quoted_phrases(t)}
    for name, want in TASKS[task].items():
        assert value(spark, got[name]) == want


def test_planned_queries_fall_back_to_words(spark):
    none = F.array().cast("array<string>")
    assert value(spark, T.planned_queries(none, none, none, none, none, F.lit("of the in"))) == ["of the in"]
    assert value(spark, T.planned_queries(F.array(F.lit(" a "), F.lit("***")), none, none, none, none, F.lit("x"))) == ["a"]


@pytest.mark.parametrize(("path", "normal"), [("a/./b/../c", "a/c"), ("../a", "../a"), ("", "."), ("/a/../../b", "/b"), ("a//b/", "a/b")])
def test_paths(spark, path, normal):
    assert value(spark, T.normal_path(F.lit(path))) == normal
    assert value(spark, T.is_safe_path(F.lit("../x"))) is False and value(spark, T.is_safe_path(F.lit("C:/x"))) is False and value(spark, T.is_safe_path(F.lit("a/b"))) is True


def test_module_paths(spark):
    assert value(spark, T.python_module_paths(F.lit("pkg/sub/a.py"), F.lit("..base"))) == ["pkg/base.py", "pkg/base/__init__.py"]
    assert value(spark, T.python_module_paths(F.lit("a.py"), F.lit("x.y"))) == ["x/y.py", "x/y/__init__.py"]
    assert value(spark, T.javascript_module_paths(F.lit("src/a.ts"), F.lit("../m.ts"))) == ["m.ts"]
    assert len(value(spark, T.javascript_module_paths(F.lit("src/a.ts"), F.lit("./m")))) == 16
    assert value(spark, T.javascript_module_paths(F.lit("src/a.ts"), F.lit("react"))) == []
    assert value(spark, T.dart_module_paths(F.lit("lib/a.dart"), F.lit("package:app/b.dart"))) == ["lib/b.dart"]


def test_scan_and_index_give_equal_scores(spark):
    docs = spark.createDataFrame([(1, "alpha beta alpha"), (2, "alphabet soup"), (3, "beta"), (4, None), (5, "")], "id int, body string")
    scan = {r.id: r.bm25 for r in search.bm25_scan(docs, {"body": 1.0}, ["alpha"]).collect()}
    postings = search.build_postings(docs, "id", {"body": 1.0})
    queries = spark.createDataFrame([(0, ["alpha"])], "query_id int, terms array<string>")
    index = {r.key: r.bm25 for r in search.bm25_postings(postings, search.statistics(postings), queries).collect()}
    assert set(scan) == {1, 2} and scan == pytest.approx(index)


def test_order_of_rows_does_not_matter(spark):
    rows = [("r", i % 7, ["exact", "lexical", "graph"][i % 3], i / 50, i % 2 + 1) for i in range(50)]
    a = evidence.signals(spark.createDataFrame(rows, "request string, id long, kind string, score double, distance int"), ["request", "id"], distance="distance")
    b = evidence.signals(spark.createDataFrame(rows[::-1], "request string, id long, kind string, score double, distance int").repartition(5), ["request", "id"], distance="distance")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_exact_evidence_alone(spark):
    one = spark.createDataFrame([("a", "exact", 1.0)], "id string, kind string, score double")
    row = evidence.signals(one, ["id"]).withColumn("s", evidence.weighted()).first()
    assert row.s == pytest.approx(0.45)


def test_greedy_budget_skips_what_does_not_fit(spark):
    items = spark.createDataFrame([("r", 1, 5, "a"), ("r", 2, 9, "b"), ("r", 3, 5, "a"), ("r", 4, 4, "c")], "request string, position int, cost int, hash string")
    got = evidence.greedy_budget(items, "request", 10).collect()
    assert {(r.position, r.used) for r in got} == {(1, 9), (4, 9)}


def test_failed_files_keep_their_rows(spark):
    table = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1), ("d", 1)], "file_id string, v int")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "file_id string")
    fresh = spark.createDataFrame([("a", 2), ("e", 2)], "file_id string, v int")
    got = incremental.replace_files(table, fresh, ids("a", "e", "c"), ids("b"), ids("c"))
    assert sorted(map(tuple, got.collect())) == [("a", 2), ("c", 1), ("d", 1), ("e", 2)]


def test_changes_see_versions_and_retries(spark):
    scanned = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1"), ("d", "2")], "path string, hash string")
    stored = spark.createDataFrame([("a", "1", "parsed", 2), ("b", "1", "parsed", 1), ("c", "1", "failed", 2), ("x", "1", "parsed", 2), ("d", None, "parsed", 2)], "path string, hash string, status string, version int")
    got = lambda **k: {r.path: r.change for r in incremental.changes(scanned, stored, 2, **k).collect()}
    assert got() == {"a": "unchanged", "b": "changed", "c": "unchanged", "x": "deleted", "d": "changed"}
    assert got(retry_failed=True)["c"] == "changed" and set(got(full=True).values()) == {"changed", "deleted"}


def test_settings_order_and_bounds(tmp_path):
    (tmp_path / "s.toml").write_text("max_queries = 5\nmax_candidates = 7\n")
    got = load_settings({"max_candidates": 9}, str(tmp_path / "s.toml"), {"QUARRY_MAX_QUERIES": "6"})
    assert (got.max_queries, got.max_candidates) == (6, 9)
    with pytest.raises(EngineError):
        load_settings({"max_queries": 0}, environment={})


def test_registry(tmp_path):
    r = Registry(str(tmp_path / "data"))
    for name in ("one", "two"):
        os.mkdir(tmp_path / name)
    one, two = r.add(str(tmp_path / "one")), r.add(str(tmp_path / "two"))
    assert r.add(str(tmp_path / "one"))["id"] == one["id"] and r.get()["id"] == one["id"]
    assert r.activate(two["id"])["active"] and [x["active"] for x in r.list()] == [True, False]
    with r.lock(one["id"]), pytest.raises(EngineError):
        r.remove(one["id"])
    r.remove(one["id"])
    with pytest.raises(EngineError):
        r.get(one["id"])
    with pytest.raises(EngineError):
        r.add(str(tmp_path / "none"))


def test_stream_of_documents(spark, tmp_path):
    schema = "doc_id long, text string, ts timestamp"
    rows = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, "b", None)], schema).withColumn("ts", F.timestamp_seconds(F.lit(1000) + F.col("doc_id")))
    rows.write.parquet(str(tmp_path / "in"))
    seen = documents.first_seen(documents.watch(spark, str(tmp_path / "in"), schema), "ts")
    query = documents.append_batches(seen, str(tmp_path / "out"), str(tmp_path / "state"))
    assert query.awaitTermination(60)
    assert sorted(r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]


def test_registered_queries_run_without_training_operators():
    import __spark_entry__ as entry

    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names) and "fts_bm25_topk" in names


def test_highlights_show_the_window_of_most_terms(spark):
    words = " ".join(f"w{i}" for i in range(40))
    cases = [
        ("def run(self, value): return value", ["run", "value"], "def [run](self, [value]): return [value]"),
        (words.replace("w30 ", "run ").replace("w33", "Value"), ["run", "val"], " … w22 w23 w24 w25 w26 w27 w28 w29 [run] w31 w32 [Value] w34 w35 w36 w37 w38 w39"),
        (words.replace("w20", "w20. run"), ["run"], " … w13 w14 w15 w16 w17 w18 w19 w20. [run] w21 w22 w23 w24 w25 w26 w27 w28 w29 … "),
        (words.replace("w10", "w10. w").replace("w15", "run"), ["run"], " … w w11 w12 w13 w14 [run] w16 w17 w18 w19 w20 w21 w22 w23 w24 w25 w26 w27 … "),
        (words.replace("w3 ", "run "), ["run"], "w0 w1 w2 [run] w4 w5 w6 w7 w8 w9 w10 w11 w12 w13 w14 w15 w16 w17 … "),
        (words, ["zz"], "w0 w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12 w13 w14 w15 w16 w17 … "),
        ("École alpha", ["ecole"], "[École] alpha"), ("(x) run", ["run"], "(x) [run]"), ("", ["a"], ""), (None, ["a"], ""), ("...", ["a"], "..."), ("a b", [], "a b"),
    ]
    rows = spark.createDataFrame([(i, t, q) for i, (t, q, _) in enumerate(cases)], "i int, t string, q array<string>")
    assert [r.out for r in search.highlights(rows, "t", "q", "out").orderBy("i").collect()] == [w for _, _, w in cases]


def test_log_records_carry_operation_and_counts(capsys):
    logs.configure("INFO", as_json=True)
    with logs.operation("op-1"), logs.stage_log("rank") as counts:
        counts["candidates"] = 3
    row = json.loads(capsys.readouterr().err)
    assert row["operation"] == "op-1" and row["level"] == "INFO" and row["stage"]["candidates"] == 3 and row["stage"]["duration_ms"] >= 0
    logs.configure()
    with logs.stage_log("rank"):
        pass
    assert not capsys.readouterr().err


def test_postings_are_counted_within_their_row(spark):
    docs = [(1, "b a b Ä", "a c"), (2, None, ""), (3, "", "z z z"), (4, "ab abc", None), (None, "a", "b")]
    frame = spark.createDataFrame(docs, "id int, body string, name string")
    for fields, prefixes in (({"body": 1.0}, None), ({"body": 1.5, "name": 8.0}, None), ({"body": 1.0, "name": 8.0}, ["a", "z"])):
        want = set()
        for key, body, name in docs:
            told = [(t, w) for field, w in fields.items() for t in ((body if field == "body" else name) or "").lower().replace("ä", "a").split()]
            kept = [(t, w) for t, w in told if prefixes is None or t.startswith(tuple(prefixes))]
            want |= {(key, t, len(told), sum(w for x, w in kept if x == t)) for t, _ in kept} or {(key, None, len(told), None)}
        found = search.build_postings(frame, "id", fields, prefixes=prefixes)
        assert sorted(map(repr, map(tuple, found.select("key", "token", "length", "f").collect()))) == sorted(map(repr, want))
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
