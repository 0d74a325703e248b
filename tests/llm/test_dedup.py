import hashlib
import random
from collections import Counter, defaultdict

import pytest

from quarry.llm import near_dedup, substring_dedup
from tests.llm.corpus import SCHEMA, documents, prose


def cover(rows, window):
    words = [(r.text or "").encode().split() for r in rows]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for r, w in zip(rows, words):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((r.doc_id, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("window", [35, 9, 3])
def test_substrings_equal_brute_force(spark, window):
    rows = documents()
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, SCHEMA), window=window)
    assert {"lang", "rest", "block", "node"} <= set(got.columns)
    held = got.collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in held) == cover(rows, window)
    texts = Counter((r.doc_id, r.text) for r in rows)
    for r in held:
        if r.n_removed == 0:
            assert texts[(r.doc_id, r.kept_text)]


def test_substrings_of_an_empty_table(spark):
    assert substring_dedup.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_levels_at_most_double():
    for window in (3, 9, 35, 50, 64):
        found = substring_dedup.levels(window)
        assert found[-1] == window and all(b <= 2 * a for a, b in zip(found, found[1:]))


def shingles(text):
    w = (text or "").encode().split()
    if not w:
        return frozenset()
    return frozenset(b" ".join(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([b" ".join(w)])


def classes(rows, threshold=0.8):
    by_text = defaultdict(list)
    for r in rows:
        by_text[r.text or ""].append(r.doc_id)
    texts = list(by_text)
    sets = [shingles(t) for t in texts]
    parent = list(range(len(texts)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, t in enumerate(texts):
        least[find(i)] += [x for x in by_text[t] if x is not None]
    return Counter((x, min(least[find(i)], default=None)) for i, t in enumerate(texts) for x in by_text[t])


def test_near_duplicates_equal_brute_force(spark):
    rows = documents()
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert Counter((r.doc_id, r.class_id) for r in got) == classes(rows)


def test_large_group_of_near_copies(spark):
    """Copies with up to eight edits of one text, and copies of a far copy: links lie on both sides of the threshold."""
    rng = random.Random(5)
    base = prose(rng, 150).split(" ")

    def edited(words, n):
        words = list(words)
        for _ in range(n):
            words[rng.randrange(len(words))] = prose(rng, 1) + "q"
        return words

    far = edited(base, 9)
    texts = [edited(base, rng.randint(1, 8)) for _ in range(500)] + [edited(far, rng.randint(0, 4)) for _ in range(200)]
    from pyspark.sql import Row

    rows = [Row(doc_id=i, text=" ".join(t)) for i, t in enumerate(texts)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.class_id) for r in got) == classes(rows)


def test_one_of_each_class_stays(spark):
    rows = documents()
    docs = spark.createDataFrame(rows, SCHEMA)
    told = near_dedup.near_duplicates(docs)
    kept = near_dedup.keep_one(docs, told)
    assert kept.columns == docs.columns
    nodes = {r.class_node for r in told.collect()}
    assert kept.count() == len(nodes)
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id in (406, 407)) == [406]


def test_near_duplicates_of_an_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    told = near_dedup.near_duplicates(docs)
    assert told.count() == 0 and near_dedup.keep_one(docs, told).count() == 0


def test_signatures_agree_as_similar():
    import numpy as np

    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 62, 300).astype(np.uint64)
    b = np.concatenate((a[:200], rng.integers(0, 1 << 62, 100).astype(np.uint64)))  # similarity 0.5
    of = np.repeat([0, 1], 300)
    s = near_dedup.dart_minhash(of, np.concatenate((a, b)), 2, 2000)
    assert abs((s[0] == s[1]).mean() - 0.5) < 0.05
    one = near_dedup.dart_minhash(np.array([0, 1]), np.array([7, 7], np.uint64), 2, 96)
    assert (one[0] == one[1]).all()


def test_counted_weights_tell_repeats_apart():
    of, h = near_dedup.shingles([b"a b c d e a b c d e a b c d e"], "count")
    assert len(set(h.tolist())) == len(h) == 11


def test_clashing_and_map_columns_of_substrings(spark):
    docs = spark.createDataFrame([(i, "same words " * 30) for i in range(3)], "doc_id long, text string").selectExpr("*", "1 AS n_words", "'k' AS kept_text", "2 AS n_removed", "'s' AS kept_sha256", "map('a', array(1)) AS pairs")
    got = substring_dedup.remove_repeats(docs, window=35)
    assert sorted(got.columns) == sorted(["doc_id", "pairs", "n_words", "n_removed", "kept_sha256", "kept_text"])
    assert {(r.n_words, r.n_removed) for r in got.collect()} == {(60, 60)}
