"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration.

Statistics of a text (lengths, shares of kinds of characters and words, repetition) are standardised and mapped to cosines
of random projections, whose inner products approximate a Gaussian kernel. The normal equations of ridge regression are
summed by partition and solved once; a monotone step function, fitted on labelled rows that the regression did not see,
turns its output into the share of good texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import Words, blobs, crc_bucket, lean, small_batches, stage, steps, with_fields

#: Labelled texts that are learnt from at most (those of least hash of the id), and every how manieth of them calibrates.
SAMPLE, CALIBRATE = 12_000, 3
#: Random features, ridge penalty for each row, seed of the projections.
FEATURES, RIDGE, SEED = 384, 1e-3, 7
#: Marks that prose uses, other than . and ,
PROSE_MARKS = b";:'\"-?()"

_kind = np.zeros(256, np.uint8)  # 1 small letter or beyond ASCII, 2 capital, 3 digit, 4 stop or comma, 5 prose mark, 6 !, 7 other sign
_kind[33:] = 7
_kind[ord("a") : ord("z") + 1] = 1
_kind[128:] = 1
_kind[ord("A") : ord("Z") + 1] = 2
_kind[ord("0") : ord("9") + 1] = 3
_kind[list(b".,")] = 4
_kind[list(PROSE_MARKS)] = 5
_kind[ord("!")] = 6


def _share(numbers: np.ndarray, of: np.ndarray) -> np.ndarray:
    return numbers / np.maximum(of, 1)


def _distinct(own: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each text: how many distinct hashes, and how often the most frequent one stands."""
    word = (own.astype(np.uint64) << np.uint64(44)) | (h >> np.uint64(20))
    word.sort()
    edge = np.flatnonzero(np.concatenate((np.ones(min(1, len(word)), bool), word[1:] != word[:-1])))
    count = np.diff(np.append(edge, len(word)))
    text = (word[edge] >> np.uint64(44)).astype(np.int64)
    most = np.zeros(n, np.int64)
    np.maximum.at(most, text, count)
    return np.bincount(text, minlength=n), most


def statistics(texts: list[bytes | None]) -> np.ndarray:
    """One row of statistics for each text; a null text is like an empty one."""
    words, n = Words(texts), len(texts)
    a, at = words.bytes, words.text_at
    kind = _kind[a]
    def per_text(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
        return sums[at[1:]] - sums[at[:-1]]

    size = np.diff(at) - 1
    kinds = [per_text(kind == k) for k in range(1, 8)]
    letters, seen = kinds[0] + kinds[1], np.maximum(sum(kinds), 1)
    n_words, own = words.counts(), words.owner()
    length = words.ends - words.starts
    mean = _share(np.bincount(own, length, n), n_words)
    spread = np.sqrt(np.maximum(_share(np.bincount(own, length.astype(float) ** 2, n), n_words) - mean**2, 0))
    distinct, most = _distinct(own, words.hashes, n)
    pairs, inside = words.windows(2)
    pair_own = own[: len(pairs)][inside]
    n_pairs = np.bincount(pair_own, minlength=n)
    two, two_most = _distinct(pair_own, pairs[inside], n)
    same = np.bincount(pair_own, (words.hashes[1:] == words.hashes[:-1])[inside] if len(pairs) else None, n)
    capital = kind[words.starts] == 2
    caps = np.concatenate(([0], np.cumsum(kind == 2)))
    plain = np.concatenate(([0], np.cumsum(kind == 1)))
    shouted = (caps[words.ends] - caps[words.starts] >= 2) & (plain[words.ends] == plain[words.starts])
    signs = np.concatenate(([0], np.cumsum(kind >= 6)))
    marked = signs[words.ends] > signs[words.starts]
    line_ends = per_text(a == 10)
    stops = per_text(a == ord("."))
    out = [
        np.log1p(size), np.log1p(n_words), mean, spread,
        _share(kinds[1], letters), *[k / seen for k in kinds[2:]],
        _share(distinct, n_words), np.log1p(distinct), _share(most, n_words), _share(two, n_pairs), _share(two_most, n_pairs), _share(same, n_pairs),
        _share(np.bincount(own, capital, n), n_words), _share(np.bincount(own, shouted, n), n_words), _share(np.bincount(own, marked, n), n_words),
        np.log1p(_share(n_words, line_ends + 1)), np.log1p(_share(n_words, stops + 1)), _share(size - seen, size),
    ]
    return np.stack(out, axis=1).astype(float)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    phase: np.ndarray
    beta: np.ndarray
    steps_x: np.ndarray
    steps_y: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -5, 5)
        return np.concatenate((np.sqrt(2 / self.w.shape[1]) * np.cos(z @ self.w + self.phase), np.ones((len(z), 1))), axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.features(x) @ self.beta, self.steps_x, self.steps_y).clip(0, 1)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least-squares non-decreasing fit by pooling adjacent violators; ends and level of each step."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # level, weight, first, last
    for a, b in zip(x[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([b, 1.0, a, a])
        while len(blocks) > 1 and (blocks[-2][0] >= blocks[-1][0] or blocks[-2][3] == blocks[-1][2]):
            v, w, _, last = blocks.pop()
            u, t, first, _ = blocks[-1]
            blocks[-1] = [(u * t + v * w) / (t + w), t + w, first, last]
    xs, ys = [], []
    for v, _, first, last in blocks:
        xs += [first, last] if last > first else [first]
        ys += [v, v] if last > first else [v]
    return np.array(xs), np.array(ys)


def _fold(rows: DataFrame, step, size: int) -> np.ndarray:  # noqa: ANN001
    """Sum over partitions of what step makes of a partition's (x, y): some rows of few numbers, added on the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            x = np.array(batch.column("x").to_pylist(), float)
            if len(x):
                total += step(x, np.array(batch.column("y").to_pylist(), float))
        yield pa.RecordBatch.from_pydict({"total": [total.tobytes()]})

    return sum((np.frombuffer(r[0]) for r in rows.mapInArrow(lean(run), "total binary").collect()), np.zeros(size))


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> Model | None:
    """A model from the labelled rows; None if there are none.

    Of repeated labels of an id the largest holds, and of repeated ids the text of least hash (a null text is like an empty
    one); null labels and ids are left out. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("doc_id")).agg(F.max(label).alias("y"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(some), "doc_id")
    rows = rows.groupBy("doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = blobs(batch.column("text"))
            x = [statistics(texts[i:j]) for i, j in steps(texts)]
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("y").cast(pa.float64()), pa.array([r.tolist() for r in np.concatenate(x)] if x else [], pa.list_(pa.float64()))], ["part", "y", "x"])

    # at most SAMPLE rows of some twenty numbers, in eight partitions
    part = (crc_bucket("doc_id", 1 << 20) % CALIBRATE == 0).alias("part")
    seen = stage(rows.select(part, "y", "text").mapInArrow(lean(look), "part boolean, y double, x array<double>").repartition(8), "quality-sample")
    fit, check = seen.where("not part"), seen.where("part")
    d = len(statistics([b""])[0])
    sums = _fold(fit, lambda x, y: np.concatenate((x.sum(0), (x**2).sum(0), [len(x)])), 2 * d + 1)
    if not sums[-1]:
        return None
    mean = sums[:d] / sums[-1]
    scale = np.sqrt(np.maximum(sums[d : 2 * d] / sums[-1] - mean**2, 0))
    scale = np.where(scale > 1e-9, scale, 1.0)
    rng = np.random.default_rng(SEED)
    # kernel width: the root of the number of statistics, a typical distance of standardised rows
    w = rng.standard_normal((d, FEATURES)) / np.sqrt(d)
    model = Model(mean, scale, w, rng.uniform(0, 2 * np.pi, FEATURES), np.zeros(FEATURES + 1), np.zeros(1), np.zeros(1))
    m = FEATURES + 1

    def normal(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = model.features(x)
        return np.concatenate(((z.T @ z).ravel(), z.T @ y, [len(y)]))

    sums = _fold(fit, normal, m * m + m + 1)
    gram = sums[: m * m].reshape(m, m) + RIDGE * sums[-1] / m * np.eye(m)
    model.beta = np.linalg.solve(gram, sums[m * m : m * m + m])
    held = check.collect() or fit.collect()
    x, y = np.array([r["x"] for r in held], float), np.array([r["y"] for r in held], float)
    model.steps_x, model.steps_y = isotonic(model.features(x) @ model.beta, y)
    return model


def score(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """Adds `score`, the calibrated share of good texts like it, to every row; without a model 0.5.

    Null and empty texts get the score of an empty text; other columns pass through (one named score is replaced); whole
    texts of any length are read; an empty table gives an empty one.
    """
    small_batches(docs.sparkSession)
    others = [c for c in docs.columns if c not in ("score", text)]
    laid = docs.select(F.col(text).alias("text"), F.struct(*others).alias("rest") if others else F.lit(0).alias("rest"))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, out = blobs(batch.column("text")), [np.zeros(0)]
            for i, j in steps(texts):
                out.append(np.full(j - i, 0.5) if model is None else model.score(statistics(texts[i:j])))
            yield pa.RecordBatch.from_arrays([batch.column("rest"), batch.column("text"), pa.array(np.concatenate(out))], ["rest", "text", "score"])

    done = laid.mapInArrow(lean(look), with_fields([laid.schema["rest"]], "text string, score double"))
    return done.select(*[F.col(f"rest.`{c}`").alias(c) for c in others], F.col("text").alias(text), "score")
