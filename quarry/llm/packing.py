"""Packing token sequences of at most a given length by a local search that swaps pieces between bins.

Documents are cut only if they are longer than a bin. Pieces are dealt into groups by hash. A group's pieces are laid into
bins in two ways, as they come and by best fit in descending order; from each start moves, one-for-one exchanges and
exchanges of two for one in both directions are made between the underfull bins until none raises the sum of squared fills;
bins that run empty go. The end with fewer bins holds. Groups hold some ten thousand pieces, so the unfilled rest of a
group's last bins is a small part of it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import lean, lean_group, row_hash, small_batches, steps, text_size, with_fields
from quarry.llm.tokens import BATCH, encoder

#: Documents whose pieces are packed together, on average; groups at least.
GROUP_DOCS, LEAST_GROUPS = 12_000, 8


def best_fit(sizes: list[int], room: int) -> list[list[int]]:
    """Bins as lists of places in sizes: each size, the largest first, goes to the bin that it fills most."""
    bins: list[list[int]] = []
    free: list[list[int]] = [[] for _ in range(room + 1)]  # bins by what is left in them
    some = 0  # bit r: a bin has r left
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        s = sizes[i]
        at = some >> s
        if at:
            r = s + (at & -at).bit_length() - 1
            b = free[r].pop()
            if not free[r]:
                some &= ~(1 << r)
            bins[b].append(i)
        else:
            b, r = len(bins), room
            bins.append([i])
        left = r - s
        free[left].append(b)
        some |= 1 << left
    return bins


def next_fit(sizes: list[int], room: int) -> list[list[int]]:
    """Bins filled one after the other with sizes as they come."""
    bins: list[list[int]] = []
    left = 0
    for i, s in enumerate(sizes):
        if s > left:
            bins.append([])
            left = room
        bins[-1].append(i)
        left -= s
    return bins


def packed(sizes: list[int], room: int) -> list[list[int]]:
    """The fewest bins that the search finds from its two starts; of equal numbers those from pieces as they come."""
    return min((local_search(start(sizes, room), sizes, room) for start in (next_fit, best_fit)), key=len)


def local_search(bins: list[list[int]], sizes: list[int], room: int) -> list[list[int]]:
    """Moves and exchanges between underfull bins until none raises the sum of squared fills; bins that run empty go.

    If a bin gains d from a bin of fill c, the sum rises if its own fill plus d is above c. Steps are a piece for nothing,
    one for a larger one, one for two of one bin, and two for one of another bin; the largest d is taken. Pieces of equal
    size are alike. Arrays hold for every size, and for every sum of two pieces of a bin, a lower bound of its holders'
    fills, so all d of one piece or pair are looked at together; what they let through is held against every holder.
    """
    done = [b for b in bins if sum(sizes[i] for i in b) == room]
    open_: list[dict[int, list[int]]] = []  # size: pieces
    for b in bins:
        own: dict[int, list[int]] = {}
        for i in b:
            own.setdefault(sizes[i], []).append(i)
        if b and sum(sizes[i] for i in b) < room:
            open_.append(own)
    fill = [sum(s * len(x) for s, x in own.items()) for own in open_]
    none = 1 << 40
    ones: list[set[int]] = [set() for _ in range(2 * room + 1)]  # size: bins
    twos: list[set[tuple[int, int, int]]] = [set() for _ in range(2 * room + 1)]  # sum: (bin, smaller, larger)
    least_one, least_two = np.full(2 * room + 1, none), np.full(2 * room + 1, none)
    gains = np.arange(room + 1)

    def pairs(b: int) -> list[tuple[int, int]]:
        have = sorted(open_[b])
        return [(s, t) for k, s in enumerate(have) for t in have[k:] if s != t or len(open_[b][s]) > 1]

    def enter(b: int) -> None:
        for s in open_[b]:
            ones[s].add(b)
            least_one[s] = min(least_one[s], fill[b])
        for s, t in pairs(b):
            twos[s + t].add((b, s, t))
            least_two[s + t] = min(least_two[s + t], fill[b])

    def leave(b: int) -> None:
        for s in open_[b]:
            ones[s].discard(b)
        for s, t in pairs(b):
            twos[s + t].discard((b, s, t))

    def best(b: int, given: int, above: int, of_two: bool) -> tuple[int, int, tuple[int, ...]] | None:
        """(d, bin, its sizes) of the largest d over `above` that bin b can gain for pieces of size `given`."""
        least, left = (least_two if of_two else least_one), room - fill[b]
        fits = np.flatnonzero(least[given + above + 1 : given + left + 1] < fill[b] + gains[above + 1 : left + 1])
        for d in (fits[::-1] + above + 1).tolist():
            at = given + d
            low, who = none, None
            for h in twos[at] if of_two else ones[at]:
                c = h[0] if of_two else h
                if c != b and fill[c] < low:
                    low, who = fill[c], h
            own = fill[b] if not of_two and at in open_[b] or of_two and any(h[0] == b for h in twos[at]) else none
            least[at] = min(low, own)
            if low < fill[b] + d:
                return (d, who[0], who[1:]) if of_two else (d, who, (at,))
        return None

    for b in range(len(open_)):
        enter(b)
    changed = True
    while changed:
        changed = False
        for b in sorted(range(len(open_)), key=lambda b: -fill[b]):
            while open_[b] and fill[b] < room:
                d, step = 0, None
                for given, of_two in [((), False), *[((s,), two) for s in sorted(open_[b]) for two in (False, True)], *[(p, False) for p in pairs(b)]]:
                    got = best(b, sum(given), d, of_two)
                    if got:
                        d, step = got[0], (given, got[1], got[2])
                        if d == room - fill[b]:
                            break
                if not step:
                    break
                given, c, taken = step
                leave(b)
                leave(c)
                for which, source, target in ((given, b, c), (taken, c, b)):
                    for s in which:
                        i = open_[source][s].pop()
                        if not open_[source][s]:
                            del open_[source][s]
                        open_[target].setdefault(s, []).append(i)
                fill[b] += d
                fill[c] -= d
                enter(b)
                enter(c)
                changed = True
    return done + [[i for x in own.values() for i in x] for own in open_ if own]


def cut(n: int, room: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; only the first may be short."""
    if n <= room:
        return [(0, n)]
    first = n % room or room
    return [(0, first), *[(at, room) for at in range(first, n, room)]]


def tokenize_pieces(docs: DataFrame, tokenizer: str, room: int = 1024, end_id: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per piece of every document: doc_id, piece, start, length, ids_crc32.

    A null or empty text is the end id alone; texts of any length are encoded whole; repeated rows give repeated pieces;
    other columns are not carried; an empty table gives an empty one.
    """
    small_batches(docs.sparkSession)
    laid = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    id_type = laid.schema["doc_id"].dataType.simpleString()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(tokenizer)
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), [t or "" for t in batch.column("text").to_pylist()]
            rows: list[tuple] = []
            for i, j in steps(texts, BATCH):
                for key, x in zip(ids[i:j], e.encode(texts[i:j]), strict=True):
                    wide = np.append(x, e.kind.type(end_id)).astype("<u4")
                    rows += [(key, k, at, n, zlib.crc32(wide[at : at + n].tobytes())) for k, (at, n) in enumerate(cut(len(wide), room))]
            c = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c[0], batch.schema.field("doc_id").type), pa.array(c[1], pa.int32()), *[pa.array(x, pa.int64()) for x in c[2:]]], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return laid.mapInArrow(lean(make), f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long")


def pack(pieces: DataFrame, n_docs: int, room: int = 1024) -> DataFrame:
    """Adds `sequence_id` and `offset` to rows with a `length` of 1 to room.

    In a sequence, pieces lie one after the other from 0. Rows with equal values are packed as separate pieces; other
    columns pass through; an empty table gives an empty one.
    """
    groups = max(LEAST_GROUPS, -(-n_docs // GROUP_DOCS))
    named = [c for c in pieces.columns if c not in ("sequence_id", "offset", "pack_group")]
    laid = pieces.select(*named, F.pmod(row_hash(pieces, named), F.lit(groups)).alias("pack_group"))

    def fill(table: pa.Table) -> pa.Table:
        group, sizes = table.column("pack_group")[0].as_py(), table.column("length").to_pylist()
        full = [[i] for i, s in enumerate(sizes) if s == room]
        rest = [i for i, s in enumerate(sizes) if s < room]
        small = [sizes[i] for i in rest]
        sequence, offset = [0] * len(sizes), [0] * len(sizes)
        for k, b in enumerate([*full, *[[rest[i] for i in b] for b in packed(small, room)]]):
            at = 0
            for i in b:
                sequence[i], offset[i] = group << 32 | k, at
                at += sizes[i]
        return table.drop_columns(["pack_group"]).append_column("sequence_id", pa.array(sequence, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    schema = with_fields([f for f in laid.schema if f.name != "pack_group"], "sequence_id long, offset long")
    return laid.groupBy("pack_group").applyInArrow(lean_group(fill), schema)


def pack_documents(docs: DataFrame, tokenizer: str, room: int = 1024, end_id: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document's pieces with the sequence and the place in it; see tokenize_pieces and pack."""
    n, _ = text_size(docs, text)
    return pack(tokenize_pieces(docs, tokenizer, room, end_id, doc_id, text), n, room)
