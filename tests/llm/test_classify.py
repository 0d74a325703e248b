import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import Row

from quarry.llm import langid, quality
from tests.llm.corpus import LETTERS, SCHEMA, documents, prose


def test_languages_on_held_out_texts(spark):
    rng = random.Random(9)
    rows = [Row(doc_id=i, text=prose(rng, rng.randint(10, 120), lang), lang=lang) for i in range(300) for lang in [list(LETTERS)[i % 3]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(docs.where("doc_id % 4 <> 2"))
    told = langid.identify(docs.where("doc_id % 4 = 2"), model).collect()
    assert sum(r.lang == r.lang_pred for r in told) >= 0.98 * len(told)
    assert all(0 <= r.score <= 1 for r in told)


def test_languages_of_awkward_rows(spark):
    docs = spark.createDataFrame(documents(), SCHEMA)
    told = langid.identify(docs, langid.learn(docs)).collect()
    assert len(told) == docs.count()
    for r in told:
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or ""))
    none = langid.learn(docs.where("false"))
    assert {r.lang_pred for r in langid.identify(docs, none).collect()} == {"und"}
    assert langid.identify(spark.createDataFrame([], SCHEMA), none).count() == 0


def plain_grams(text):
    """n-grams of 1 to 3 of each word's letters, padded by a mark, as the hashes that break ties."""
    words = "".join(c if c.isalpha() else " " for c in text or "").split()
    found = Counter()
    for w in words:
        codes = [1, *[ord(c.lower()) if len(c.lower()) == 1 else ord(c) for c in w], 1]
        for k in (1, 2, 3):
            for i in range(len(codes) - k + 1):
                g = 0
                for c in codes[i : i + k]:
                    g = g << 21 | c
                if k > 1 or codes[i] != 1:
                    found[(g * 0x9E3779B97F4A7C15 % (1 << 64)) >> 20] += 1
    return found


def test_profiles_and_distances_equal_plain_counting(spark):
    docs = spark.createDataFrame(documents(), SCHEMA)
    model = langid.learn(docs)
    total = {}
    for r in documents():
        if r.lang and r.text is not None:
            total.setdefault(r.lang, Counter()).update(plain_grams(r.text))
    order = lambda counts: sorted(counts, key=lambda g: (-counts[g], g))[: langid.RANKS]
    profiles = {k: {g: i for i, g in enumerate(order(v))} for k, v in total.items() if v}
    assert model.languages == sorted(profiles)
    known = set().union(*profiles.values())
    told = {(r.doc_id, r.text): r for r in langid.identify(docs, model).collect()}
    for r in documents():
        counts = plain_grams(r.text)
        mine = sorted(counts, key=lambda g: (-counts[g], g not in known, g))[: langid.RANKS]
        away = [(sum(abs(p[g] - i) if g in p else langid.RANKS for i, g in enumerate(mine)), k) for k, p in sorted(profiles.items())]
        got = told[r.doc_id, r.text]
        assert got.lang_pred == (min(away)[1] if mine else "und")
        if mine:
            near, second = sorted(a for a, _ in away)[:2]
            assert abs(got.score - (1 - near / max(second, 1e-9))) < 1e-9


def test_many_labels_and_long_counts(spark):
    rows = [(i, f"wort{i % 26 * chr(97 + i % 26)} lang{i}", f"label {i}") for i in range(3000)] + [(9000, "ab " * 40_000, "long")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(docs)
    assert len(model.languages) == langid.LANGUAGES
    assert langid.identify(docs, model).where("score between 0 and 1").count() == 3001


def test_grams_equal_plain_counting():
    _, _, n = langid.grams([b"ab a"])
    # _ab_a_: a b a | _a ab b_ _a a_ | _ab ab_ _a_
    assert sorted(n.tolist()) == sorted([2, 1, 2, 1, 1, 1, 1, 1, 1])
    assert all(len(x) == 0 for x in langid.grams([b"", b"12 !"]))


def test_quality_on_held_out_texts(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(600):
        good = i % 4 > 0
        text = ". ".join(prose(rng, 9).capitalize() for _ in range(rng.randint(2, 20))) if good else rng.choice([(prose(rng, 1) + " ") * 50, prose(rng, 60).upper() + "!!", " ".join(w + "###" for w in prose(rng, 60).split())])
        rows.append(Row(doc_id=i, text=text))
        labels.append(Row(doc_id=i, quality=int(good)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    model = quality.learn(docs, known.where("doc_id % 5 <> 0"))
    told = {r.doc_id: r.score for r in quality.score(docs.where("doc_id % 5 = 0"), model).collect()}
    assert all(0 <= s <= 1 for s in told.values())
    assert np.mean([(s >= 0.3) == (i % 4 > 0) for i, s in told.items()]) > 0.97


def test_quality_of_awkward_rows(spark):
    docs = spark.createDataFrame(documents(), SCHEMA)
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (3, 0), (None, 1), (999, 1), (5, 1), (8, 0)], "doc_id long, quality int")
    told = quality.score(docs, quality.learn(docs, labels))
    assert told.count() == docs.count() and told.where("score < 0 or score > 1 or score is null").count() == 0
    assert {r.score for r in quality.score(docs, quality.learn(docs, labels.where("false"))).collect()} == {0.5}
    assert quality.score(docs.where("false"), None).count() == 0


def test_isotonic_is_monotone_and_pools():
    x, y = quality.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]))
    assert (np.diff(y) >= 0).all() and np.interp(2.5, x, y) == 0.5


def test_quality_equals_a_direct_solution(spark):
    rng = random.Random(5)
    rows = [(i, prose(rng, rng.randint(0, 60)) if i % 3 else (prose(rng, 2) + " ") * 20, int(i % 3 > 0)) for i in range(90)]
    docs = spark.createDataFrame([r[:2] for r in rows] + [(4, "a second text of an id"), (7, None)], "doc_id long, text string").selectExpr("*", "0.5 AS score", "1 AS part", "2 AS y")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    texts = dict(r[:2] for r in rows)
    for i, other in ((4, "a second text of an id"), (7, "")):  # of repeated ids the text of least hash
        pair = spark.createDataFrame([(texts[i],), (other,)], "t string").selectExpr("t", "xxhash64(t) AS h").collect()
        texts[i] = min(pair, key=lambda r: r.h).t
    x = quality.statistics([texts[i].encode() for i in range(90)])
    y = np.array([r[2] for r in rows], float)
    part = np.array([zlib.crc32(str(i).encode()) % (1 << 20) % quality.CALIBRATE == 0 for i in range(90)])
    mean, scale = x[~part].mean(0), x[~part].std(0)
    scale[scale <= 1e-9] = 1
    draw = np.random.default_rng(quality.SEED)
    w = draw.standard_normal((x.shape[1], quality.FEATURES)) / np.sqrt(x.shape[1])
    phase = draw.uniform(0, 2 * np.pi, quality.FEATURES)
    z = np.hstack((np.sqrt(2 / quality.FEATURES) * np.cos(np.clip((x - mean) / scale, -5, 5) @ w + phase), np.ones((90, 1))))
    a = z[~part]
    beta = np.linalg.lstsq(np.vstack((a, np.sqrt(quality.RIDGE * len(a) / a.shape[1]) * np.eye(a.shape[1]))), np.concatenate((y[~part], np.zeros(a.shape[1]))), rcond=None)[0]
    model = quality.learn(docs, labels)
    assert np.allclose(z @ beta, model.features(x) @ model.beta, atol=1e-6)
    # the greatest of the least means of all runs that hold a row is the isotonic fit
    raw, own = (z @ beta)[part], y[part]
    order = np.argsort(raw)
    level = [max(min(own[order][i : j + 1].mean() for j in range(k, len(order))) for i in range(k + 1)) for k in range(len(order))]
    assert np.allclose(model.score(x[part][order]), level, atol=1e-6)


def test_statistics_equal_plain_counting():
    texts = ["", "One two, two three. ONE ok!\nx9 é(b)", "  a  a a\t", "word"]
    got = quality.statistics([t.encode() for t in texts])
    for t, row in zip(texts, got, strict=True):
        w = t.encode().split()
        assert np.isclose(row[0], np.log1p(len(t.encode()))) and np.isclose(row[1], np.log1p(len(w)))
        assert np.isclose(row[2], np.mean([len(x) for x in w]) if w else 0) and np.isclose(row[3], np.std([len(x) for x in w]) if w else 0)
        assert np.isclose(row[10], len(set(w)) / max(len(w), 1)) and np.isclose(row[12], max(Counter(w).values(), default=0) / max(len(w), 1))
        pairs = list(zip(w, w[1:], strict=False))
        assert np.isclose(row[13], len(set(pairs)) / max(len(pairs), 1)) and np.isclose(row[15], sum(p == q for p, q in pairs) / max(len(pairs), 1))
