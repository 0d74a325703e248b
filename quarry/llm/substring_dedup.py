"""Removal of long word passages that occur more than once, by level-wise doubling.

Windows of a short length are counted over the whole corpus; only where both halves of a window of twice the length
were repeated is that window a candidate at the next level, and so on up to the wanted length (9, 18, 35). What is
counted at the last level are fingerprints of over 96 bits; the lower levels use short fingerprints, which can only let a few
more candidates through. Texts are dealt into blocks of a few MB. A block sends the distinct fingerprints of its
candidates (twice if they occur twice in it), packed by bucket, and gets back those that are repeated anywhere, so a
passage that a third of all texts share costs one entry for each block, and no list of places is ever gathered.
"""

from __future__ import annotations

import hashlib
import math
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import Words, blobs, lean_cogroup, lean_group, parts, row_hash, small_batches, steps, text_size, with_fields

#: Bytes of text in a block, and fingerprints in a bucket, on average.
BLOCK_BYTES, BUCKET_ROWS = 4 << 20, 500_000
SENT = "bucket long, block long, data binary"


#: What is sent of a fingerprint beside its bucket: three bytes, at the last level twelve.
FINAL = np.dtype([("low", "<u4"), ("second", "<u8")])


def _dump(rows: np.ndarray) -> bytes:
    return rows.tobytes() if rows.dtype == FINAL else rows.view(np.uint8).reshape(-1, 4)[:, :3].tobytes()


def _load(data: bytes, final: bool) -> np.ndarray:
    if final:
        return np.frombuffer(data, FINAL)
    wide = np.zeros((len(data) // 3, 4), np.uint8)
    wide[:, :3] = np.frombuffer(data, np.uint8).reshape(-1, 3)
    return wide.view("<u4").ravel()


def levels(window: int, least: int = 8) -> list[int]:
    """Window lengths: each at most twice the one before, the last one the wanted one."""
    out = [window]
    while math.ceil(out[0] / 2) >= least:
        out.insert(0, math.ceil(out[0] / 2))
    return out


def _fingerprints(words: Words, length: int, final: bool, buckets: int) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    """For each place: bucket and rest as one number; at the last level, a second number; whether the window lies in one text."""
    h, inside = words.windows(length)
    key = ((h >> np.uint64(32)) % np.uint64(buckets) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF if final else 0xFFFFFF))
    if not final:
        return key, None, inside
    return key, words.windows(length, 1)[0] ^ (h >> np.uint64(32)), inside


def _pack(block: int, keys: list[np.ndarray], seconds: list[np.ndarray] | None) -> pa.Table:
    """Rows for the buckets: each fingerprint once, or twice if it occurs more than once here."""
    key = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
    if seconds is None:
        order, second = None, None
        key = np.sort(key)
        same1 = key[1:] == key[:-1]
    else:
        second = np.concatenate(seconds) if seconds else np.zeros(0, np.uint64)
        order = np.lexsort((second, key))
        key, second = key[order], second[order]
        same1 = (key[1:] == key[:-1]) & (second[1:] == second[:-1])
    third = np.zeros(len(key), bool)
    third[2:] = same1[1:] & same1[:-1]
    key = key[~third]
    bucket = (key >> np.uint64(32)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    at = [0, *cuts.tolist(), len(key)] if len(key) else [0]
    low = key.astype("<u4")
    if second is not None:
        both = np.empty(len(key), dtype=FINAL)
        both["low"], both["second"] = low, second[~third]
        low = both
    return pa.table(
        {
            "bucket": pa.array([int(bucket[i]) for i in at[:-1]], pa.int64()),
            "block": pa.array([block] * (len(at) - 1), pa.int64()),
            "data": pa.array([_dump(low[i:j]) for i, j in zip(at, at[1:], strict=False)], pa.binary()),
        }
    )


def _repeated(table: pa.Table, final: bool) -> pa.Table:
    """Of a bucket's fingerprints, those that occur twice, for each block that sent them."""
    each = [_load(d, final) for d in table.column("data").to_pylist()]
    rows = np.concatenate(each)
    source = np.repeat(np.arange(len(each)), [len(x) for x in each])
    order = np.lexsort((source, rows["second"], rows["low"])) if final else np.lexsort((source, rows))
    rows, source = rows[order], source[order]
    same = rows[1:] == rows[:-1]
    hit = np.zeros(len(rows), bool)
    hit[1:] |= same
    hit[:-1] |= same
    again = np.zeros(len(rows), bool)  # the second entry that one block sent
    again[1:] = same & (source[1:] == source[:-1])
    rows, source = rows[hit & ~again], source[hit & ~again]
    back = np.argsort(source, kind="stable")
    rows, source = rows[back], source[back]
    cuts = np.searchsorted(source, np.arange(len(each) + 1))
    keep = [i for i in range(len(each)) if cuts[i] < cuts[i + 1]]
    blocks, buckets = table.column("block").to_pylist(), table.column("bucket").to_pylist()
    return pa.table(
        {
            "bucket": pa.array([buckets[i] for i in keep], pa.int64()),
            "block": pa.array([blocks[i] for i in keep], pa.int64()),
            "data": pa.array([_dump(rows[cuts[i] : cuts[i + 1]]) for i in keep], pa.binary()),
        }
    )


def _early(table: pa.Table) -> pa.Table:
    return _repeated(table, False)


def _final(table: pa.Table) -> pa.Table:
    return _repeated(table, True)


class _Answer:
    """What came back for a block."""

    def __init__(self, table: pa.Table, final: bool):
        keys, seconds = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
        for bucket, data in zip(table.column("bucket").to_pylist(), table.column("data").to_pylist(), strict=True):
            x = _load(data, final)
            keys.append((x["low"] if final else x).astype(np.uint64) | np.uint64(bucket << 32))
            if final:
                seconds.append(x["second"])
        self.keys, self.seconds = np.concatenate(keys), np.concatenate(seconds) if final else None
        order = np.lexsort((self.seconds, self.keys)) if final else np.argsort(self.keys)
        self.keys = self.keys[order]
        if final:
            self.pairs = set(zip(self.keys.tolist(), self.seconds[order].tolist(), strict=True))

    def has(self, key: np.ndarray, second: np.ndarray | None) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(key), bool)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        found = self.keys[at] == key
        if second is not None:
            for i in np.flatnonzero(found).tolist():
                found[i] = (int(key[i]), int(second[i])) in self.pairs
        return found


def _candidates(table: pa.Table, got: pa.Table | None, level: int, lengths: list[int], buckets: int) -> pa.Table:
    """A block's candidates at a level: all windows at the first, else those whose two halves were repeated."""
    length, final = lengths[level], level == len(lengths) - 1
    answer = None if got is None else _Answer(got, False)
    block = table.column("block")[0].as_py() if table.num_rows else -1
    keys, seconds = [], []
    texts = blobs(table.column("text"))
    for i, j in steps(texts) if answer is None or len(answer.keys) else ():
        words = Words(texts[i:j])
        key, second, wanted = _fingerprints(words, length, final, buckets)
        if answer is not None:
            half, _, inside = _fingerprints(words, lengths[level - 1], False, buckets)
            hit = inside & answer.has(half, None)
            apart = length - lengths[level - 1]
            wanted = wanted & hit[: len(key)] & hit[apart : apart + len(key)]
        keys.append(key[wanted])
        if final:
            seconds.append(second[wanted])
    return _pack(block, keys, seconds if final else None)


def _cover(words: Words, window: int, buckets: int, answer: _Answer) -> np.ndarray:
    """Whether each word lies in a repeated window."""
    key, second, inside = _fingerprints(words, window, True, buckets)
    hit = inside & answer.has(key, second) if len(answer.keys) else np.zeros(len(key), bool)
    edge = np.zeros(len(words.hashes) + 1, np.int64)
    at = np.flatnonzero(hit)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return np.cumsum(edge[:-1]) > 0


def remove_repeats(docs: DataFrame, window: int = 35, text: str = "text", keep_text: bool = True) -> DataFrame:
    """Every row of docs with `n_words`, `n_removed`, `kept_sha256` and, if keep_text, `kept_text` in place of the text.

    A word goes if it lies in a run of `window` words that starts at any other place too, in this row or another; all
    copies go, and windows are judged on the input. Kept words are joined by one space, and their hash is of that; a text
    that loses nothing is its own kept_text, white space and all. A null or empty text has no
    words; rows are told apart by row, so repeated doc_ids or whole rows count as separate texts; other columns pass
    through unchanged, but own ones with the names of the new columns are replaced; an empty table gives an empty one. Texts
    shorter than the window lose nothing.
    """
    spark = docs.sparkSession
    small_batches(spark)
    n, size = text_size(docs, text)
    blocks = max(math.ceil(size / BLOCK_BYTES), parts(spark))
    buckets = max(math.ceil(size / 6 / BUCKET_ROWS), parts(spark))
    lengths = levels(window)
    others = [c for c in docs.columns if c not in (text, "n_words", "n_removed", "kept_sha256", "kept_text")]
    # a block is a function of the row itself: lost executors or retries deal the same way
    row = F.struct(F.col(text).alias("text"), row_hash(docs).alias("of"), F.struct(*others).alias("rest") if others else F.lit(0).alias("rest"))
    laid = docs.select(row.alias("row")).select(F.pmod(F.col("row.of"), F.lit(blocks)).alias("block"), "row.text", "row.rest")

    def ask(level: int, got: DataFrame | None) -> DataFrame:
        if got is None:
            return laid.groupBy("block").applyInArrow(lean_group(lambda t: _candidates(t, None, level, lengths, buckets)), SENT)
        return laid.groupBy("block").cogroup(got.groupBy("block")).applyInArrow(lean_cogroup(lambda t, g: _candidates(t, g, level, lengths, buckets)), SENT)

    got: DataFrame | None = None
    for level in range(len(lengths)):
        got = ask(level, got).groupBy("bucket").applyInArrow(lean_group(_final if level == len(lengths) - 1 else _early), SENT)

    def finish(table: pa.Table, back: pa.Table) -> pa.Table:
        texts, answer = blobs(table.column("text")), _Answer(back, True)
        n_words, n_removed, shas, kept = [], [], [], []
        for i, j in steps(texts):
            words = Words(texts[i:j])
            gone = _cover(words, window, buckets, answer)
            for k in range(j - i):
                a, b = words.first[k], words.first[k + 1]
                own, mask = (texts[i + k] or b"").split(), gone[a:b]
                some = mask.any()
                left = b" ".join(compress(own, (~mask).tolist())) if some else b" ".join(own)
                n_words.append(b - a)
                n_removed.append(int(mask.sum()))
                shas.append(hashlib.sha256(left).hexdigest())
                if keep_text:
                    kept.append(left if some else texts[i + k])
        out = {"rest": table.column("rest"), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(shas, pa.string())}
        if keep_text:
            out["kept_text"] = pa.array(kept, pa.binary()).cast(pa.string())
        return pa.table(out)

    schema = with_fields([laid.schema["rest"]], "n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if keep_text else ""))
    done = laid.groupBy("block").cogroup(got.groupBy("block")).applyInArrow(lean_cogroup(finish), schema)
    return done.select(*([F.col(f"rest.`{c}`").alias(c) for c in others]), *[c for c in done.columns if c != "rest"])
