"""Language identification by rank-order profiles of character n-grams.

A language's profile is its most frequent n-grams of 1 to 3 letters (words padded by a mark), by descending count. A
text's own most frequent n-grams are compared to each profile by the out-of-place distance: the sum over the text's
n-grams of how far their ranks lie apart, at most the profile's length each. The nearest profile is the prediction.

Profiles are learnt from all labelled texts: each task counts the n-grams of its own texts by language, Spark adds these
counts, and only the first ranks of each language leave the cluster.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import blobs, lean, small_batches, steps, with_fields

#: n-grams in a profile, and of a text.
RANKS = 400
#: Languages of a model: those with most labelled texts.
LANGUAGES = 1000
#: Counts that a task holds before it hands them on; texts by languages that one step compares.
HELD, CELLS = 500_000, 1 << 21
UNDETERMINED = "und"

_letters: np.ndarray | None = None


def _table() -> np.ndarray:
    """For each code point: the lower-case letter's code point, or 0 if it is no letter."""
    global _letters
    if _letters is None:
        t = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            if (s := chr(c)).isalpha():
                low = s.lower()
                t[c] = ord(low) if len(low) == 1 else c
        _letters = t
    return _letters


def grams(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, n-gram) with counts, by text and n-gram. An n-gram is a number of 63 bits; 1 marks a word's ends."""
    lengths = [len((t or b"").decode("utf-8", "replace")) for t in texts]
    codes = np.frombuffer("\0".join([(t or b"").decode("utf-8", "replace") for t in texts]).encode("utf-32-le") + bytes(4), np.uint32)
    c = _table()[codes].astype(np.uint64)
    own = np.repeat(np.arange(len(texts)), np.array(lengths) + 1)
    # one mark for each run of other characters, and at both ends of every text
    gap = c == 0
    first = np.concatenate(([True], own[1:] != own[:-1]))
    keep = ~gap | np.concatenate(([True], ~gap[:-1])) | first
    c, own = np.where(gap, np.uint64(1), c)[keep], own[keep].astype(np.uint64)
    lead = np.concatenate(([True], own[1:] != own[:-1]))
    at = np.flatnonzero(lead & (c != 1))  # a text that begins with a letter gets a mark before it
    c, own = np.insert(c, at, np.uint64(1)), np.insert(own, at, own[at])
    n = len(c)
    keys, key_own = [], []
    for k in (1, 2, 3):
        m = n - k + 1
        if m <= 0:
            continue
        g = c[:m].copy()
        for j in range(1, k):
            g = (g << np.uint64(21)) | c[j : j + m]
        ok = own[:m] == own[k - 1 :]
        if k == 1:
            ok &= c != 1
        elif k == 2:
            ok &= (c[:m] != 1) | (c[1:] != 1)
        else:
            ok &= c[1 : 1 + m] != 1
        keys.append(g[ok])
        key_own.append(own[:m][ok])
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    g, o = np.concatenate(keys), np.concatenate(key_own)
    # 44 bits of hash and the text's number in one sortable word
    h = g * np.uint64(0x9E3779B97F4A7C15)
    word = (o << np.uint64(44)) | (h >> np.uint64(20))
    word.sort()
    edge = np.flatnonzero(np.concatenate((np.ones(min(1, len(word)), bool), word[1:] != word[:-1])))
    count = np.diff(np.append(edge, len(word)))
    word = word[edge]
    return (word >> np.uint64(44)).astype(np.int64), word & np.uint64((1 << 44) - 1), count


@dataclass
class Model:
    """Languages in order; the hashed n-grams of any profile, ascending; from `at[i]` on the languages and ranks that have n-gram i."""

    languages: list[str]
    known: np.ndarray
    at: np.ndarray
    language: np.ndarray
    rank: np.ndarray


def model_of(top: dict[str, list[int]]) -> Model:
    """A model from the n-grams of each language, most frequent first."""
    languages = sorted(top)
    gram = np.array([g for name in languages for g in top[name]], np.uint64)
    language = np.array([k for k, name in enumerate(languages) for _ in top[name]], np.int64)
    rank = np.array([r for name in languages for r in range(len(top[name]))], np.int64)
    order = np.argsort(gram, kind="stable")
    known, first = np.unique(gram[order], return_index=True)
    return Model(languages, known, np.append(first, len(gram)), language[order], rank[order])


def predict(model: Model, texts: list[bytes | None]) -> tuple[list[str], np.ndarray]:
    """Language and score of each text. The score is 1 - nearest / second nearest distance, in [0, 1]; ties go to the first name."""
    own, g, n = grams(texts)
    if not model.languages or not len(own):
        return [UNDETERMINED] * len(texts), np.zeros(len(texts))
    # by text, count descending, then n-gram (unknown ones last)
    at = np.minimum(np.searchsorted(model.known, g), max(len(model.known) - 1, 0))
    index = np.where(model.known[at] == g, at, len(model.known)) if len(model.known) else np.zeros(len(g), np.int64)
    order = np.lexsort((index, -n, own))
    own, index = own[order], index[order]
    rank = np.arange(len(own)) - np.searchsorted(own, np.arange(len(texts)))[own]
    own, index, rank = own[rank < RANKS], index[rank < RANKS], rank[rank < RANKS]
    used = np.bincount(own, minlength=len(texts))
    # every n-gram is RANKS out of place, but for the profiles that have it
    some = index < len(model.known)
    own, index, rank = own[some], index[some], rank[some]
    many = model.at[index + 1] - model.at[index]
    place = np.repeat(model.at[index] - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
    nearer = RANKS - np.abs(model.rank[place] - np.repeat(rank, many))
    cells = model.language[place] * len(texts) + np.repeat(own, many)
    away = (RANKS * used[None, :] - np.bincount(cells, nearer, len(model.languages) * len(texts)).reshape(len(model.languages), len(texts))).astype(float)
    best = away.argmin(axis=0)
    near = away.min(axis=0)
    rest = np.partition(away, 1, axis=0)[1] if len(away) > 1 else RANKS * np.maximum(used, 1).astype(float)
    score = np.where(used > 0, 1 - near / np.maximum(rest, 1e-9), 0.0).clip(0, 1)
    return [model.languages[b] if u else UNDETERMINED for b, u in zip(best.tolist(), used.tolist(), strict=True)], score


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's n-gram counts by language."""
    names = ["lang", "gram", "n"]
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    size = 0

    def handed() -> Iterator[pa.RecordBatch]:
        for lang, found in held.items():
            gram, turn = np.unique(np.concatenate([g for g, _ in found]), return_inverse=True)
            total = np.bincount(turn, np.concatenate([n for _, n in found])).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram.astype(np.int64)), pa.array(total)], names)
        held.clear()

    for batch in batches:
        langs, texts = batch.column("lang").to_pylist(), blobs(batch.column("text"))
        for lang in sorted(set(langs)):
            own = [t for k, t in zip(langs, texts, strict=True) if k == lang]
            for i, j in steps(own):
                _, g, n = grams([b"\n".join(own[i:j])])
                held.setdefault(lang, []).append((g, n))
                size += len(g)
                if size > HELD:
                    yield from handed()
                    size = 0
    yield from handed()


def learn(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """A model from all rows with language and text, repeated ones as often as they stand; none of them gives a model without languages."""
    small_batches(docs.sparkSession)
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    counts = known.mapInArrow(lean(_counts), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    first = counts.withColumn("k", place).where(F.col("k") <= RANKS)
    # the names with most texts, so that what goes to the driver has a bound whatever stands in the column
    named = docs.where(F.col(lang).isNotNull()).groupBy(F.col(lang).cast("string").alias("lang")).agg(F.count(F.lit(1)).alias("texts")).orderBy(F.desc("texts"), "lang").limit(LANGUAGES)
    top: dict[str, list[int]] = {}
    for r in sorted(first.join(F.broadcast(named), "lang").select("lang", "k", "gram").collect()):
        top.setdefault(r["lang"], []).append(r["gram"])
    return model_of(top)


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds `lang_pred` and `score` to every row; texts that are null or have no letter get `und` and 0.

    Whole texts of any length are read; other columns pass through (own `lang_pred` and `score` columns are replaced);
    repeated rows get equal values; an empty table gives an empty one; a model without languages gives `und`.
    """
    small_batches(docs.sparkSession)
    others = [c for c in docs.columns if c not in ("lang_pred", "score")]
    laid = docs.select(F.col(text).alias("text"), F.struct(*others).alias("rest"))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = blobs(batch.column("text"))
            langs, scores = [], [np.zeros(0)]
            for i, j in steps(texts):
                few = max(1, CELLS // max(1, len(model.languages)))
                for k in range(i, j, few):
                    a, b = predict(model, texts[k : min(k + few, j)])
                    langs += a
                    scores.append(b)
            yield pa.RecordBatch.from_arrays([batch.column("rest"), pa.array(langs, pa.string()), pa.array(np.concatenate(scores), pa.float64())], ["rest", "lang_pred", "score"])

    done = laid.mapInArrow(lean(look), with_fields([laid.schema["rest"]], "lang_pred string, score double"))
    return done.select(*[F.col(f"rest.`{c}`").alias(c) for c in others], "lang_pred", "score")
