"""Near-duplicate classes by DartMinHash signatures, banded joining and exact verification.

A text is the weighted set of its five-word shingles (weight 1, or the number of times; a text of fewer words is one
shingle). For every element and each unit of its weight, hashed darts fall at hashed ranks with rate one, each on one
of the signature's coordinates; a dart counts if it lies below the element's weight, and the earliest at each coordinate
is kept. Only the darts of the first ranks, some hundred for any text, need to be thrown; if a coordinate got none, more
ranks follow. Two texts agree on a coordinate with the chance of their weighted Jaccard similarity.

Equal texts are one node. Nodes that share a band are candidates. In each bucket every node is compared to the most
central one, its leader (whose bands are shared most), so a group of n near copies costs n comparisons; linked ones are
merged. Rows that then lie outside the main component of a leader's buckets are compared with all rows of these buckets,
in blocks of bounded size whose intersections are matrix products, so no row is made for a pair: no link between two
candidates is lost, and no group meets in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import Words, blobs, lean, lean_group, mix, small_batches, stage, steps

WIDTH = 5
#: 24 bands of 4 coordinates: a pair of similarity 0.8 shares no band with a chance of 3 in a million.
BANDS, ROWS = 24, 4
#: Expected darts for each coordinate: log(coordinates) and so many.
EXTRA = 2.5
#: Rows (of 8 bytes) up to which a counted table is sent to every executor.
BROADCAST_ROWS = 1_000_000
#: Rows on each side of a block comparison, on average; elements that its matrices hold at once.
BLOCK, COLUMNS = 256, 4096


def shingles(texts: list[bytes | None], weights: str = "set") -> tuple[np.ndarray, np.ndarray]:
    """Text and hash of each element: with weights "set" shingles once or more, with "count" each one told apart by its turn."""
    words = Words(texts)
    h, inside = words.windows(WIDTH)
    own = words.owner()
    h, of = h[inside], own[: len(h)][inside]
    short = np.flatnonzero((words.counts() > 0) & (words.counts() < WIDTH))
    if len(short):
        whole = np.array([mix(np.bitwise_xor.accumulate(mix(words.hashes[words.first[k] : words.first[k + 1]], 3) * np.uint64(5))[-1:], int(words.counts()[k]))[0] for k in short], np.uint64)
        h, of = np.concatenate((h, whole)), np.concatenate((of, short))
        order = np.argsort(of, kind="stable")
        h, of = h[order], of[order]
    if weights == "count" and len(h):
        order = np.lexsort((h, of))
        h, of = h[order], of[order]
        new = np.concatenate(([True], (h[1:] != h[:-1]) | (of[1:] != of[:-1])))
        start = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
        h = mix(h + (np.arange(len(h)) - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 11)
    return of, h


def dart_minhash(of: np.ndarray, elements: np.ndarray, n: int, k: int) -> np.ndarray:
    """Signatures (n, k) of n sets given as (set, element) rows; the sets need at least one element to have one.

    An element's darts come in the order of rank: gaps are exponential, made from hashes of element and turn.
    """
    best = np.full(n * k, np.inf)
    kept = np.zeros(n * k, np.uint64)
    size = np.bincount(of, minlength=n)
    level = np.where(size > 0, k * (np.log(k) + EXTRA) / np.maximum(size, 1), 0.0)
    reached = np.zeros(n)
    todo = size > 0
    while todo.any():
        mine = todo[of]
        e, o, rank, turn = elements[mine], of[mine], np.zeros(int(mine.sum())), 0
        while len(e):
            h = mix(e, 1000 + turn)
            rank = rank - np.log(((h >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53))
            ok = rank < level[o]
            e, o, rank, h = e[ok], o[ok], rank[ok], h[ok]
            new = rank >= reached[o]  # darts of earlier ranks are there
            dart = mix(h[new], 77)
            at = o[new] * k + (dart % np.uint64(k)).astype(np.int64)
            r = rank[new]
            np.minimum.at(best, at, r)
            won = best[at] == r
            kept[at[won]] = dart[won]
            turn += 1
        reached = np.where(todo, level, reached)
        todo = todo & np.isinf(best.reshape(n, k)).any(axis=1)
        level = np.where(todo, level * 2, level)
    return kept.reshape(n, k)


def _bands(texts: list[bytes | None], bands: int, rows: int, weights: str) -> list[list[int] | None]:
    of, elements = shingles(texts, weights)
    signature = dart_minhash(of, elements, len(texts), bands * rows)
    some = np.bincount(of, minlength=len(texts)) > 0
    joined = np.zeros((len(texts), bands), np.uint64)
    for j in range(rows):
        joined = mix(joined * np.uint64(0x100000001B3) + signature[:, j::rows], j)
    joined = mix(joined + np.arange(bands, dtype=np.uint64)[None, :], 99).astype(np.int64)
    return [row if ok else None for row, ok in zip(joined.tolist(), some.tolist(), strict=True)]


def _compare(table: pa.Table, threshold: float) -> pa.Table:
    """Links between far rows and rows of other components in each unit; for a far row and another component one is enough.

    Intersections are products of 0/1 matrices over the elements that more than one row has, some thousand at a time.
    """
    unit, far = table.column("unit").to_numpy(), table.column("far").to_numpy(zero_copy_only=False)
    node, comp = table.column("node").to_numpy(), table.column("comp").to_numpy()
    sets = table.column("s").combine_chunks()
    flat, cut = sets.values.to_numpy(), sets.offsets.to_numpy()
    out: list[tuple[int, int]] = []
    order = np.argsort(unit, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(unit[order])) + 1):
        size = cut[rows + 1] - cut[rows]
        where = np.repeat(np.arange(len(rows)), size)
        elements = np.concatenate([flat[cut[r] : cut[r + 1]] for r in rows.tolist()])
        kinds, code, count = np.unique(elements, return_inverse=True, return_counts=True)
        new = np.cumsum(count > 1) - 1
        some = count[code] > 1
        code, where = new[code[some]], where[some]
        a, b = np.flatnonzero(far[rows]), np.flatnonzero(~far[rows])
        if not len(a) or not len(b):
            continue
        both = np.zeros((len(a), len(b)), np.float32)
        by = np.argsort(code, kind="stable")
        code, where = code[by], where[by]
        total = int(new[-1]) + 1 if len(new) else 0
        for at in range(0, total, COLUMNS):
            i, j = np.searchsorted(code, [at, at + COLUMNS])
            part = np.zeros((len(rows), min(COLUMNS, total - at)), np.float32)
            part[where[i:j], code[i:j] - at] = 1
            both += part[a] @ part[b].T
        union = size[a][:, None] + size[b][None, :] - both
        ca, cb = comp[rows][a], comp[rows][b]
        x, y = np.nonzero((both >= threshold * union) & (ca[:, None] != cb[None, :]))
        seen: dict[tuple[int, int], int] = {}
        for p, q in zip(x.tolist(), y.tolist(), strict=True):
            seen.setdefault((p, int(cb[q])), q)
        own = node[rows]
        out += [(int(own[a[p]]), int(own[b[q]])) for (p, _), q in seen.items()]
    return pa.table({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64())})


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def connected(edges: DataFrame) -> DataFrame:
    """(node, comp) of all nodes in edges (a, b), comp the least node, by alternating large and small stars."""
    e = stage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "stars")
    before = None
    while True:
        both = e.union(e.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        e = both.join(least, F.col("a") == F.col("k")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = e.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "k")
        joined = e.join(least, F.col("a") == F.col("k"))
        e = joined.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*").where("a <> b").distinct()
        e = stage(e, "stars")
        now = tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
        if now == before:
            return e.select(F.col("a").alias("node"), F.col("b").alias("comp"))
        before = now


def near_duplicates(docs: DataFrame, threshold: float = 0.8, weights: str = "set", doc_id: str = "doc_id", text: str = "text", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per row of docs: doc_id, `class_id` (the least doc_id of its class), `text_hash` (its node) and `class_node` (the class's).

    A class is a connected component of the texts under links of similarity >= threshold; equal texts are one class,
    null and empty ones too (null counts as empty), and texts without words are like equal texts only. Rows with an equal
    id are separate rows. Other columns are ignored; an empty table gives an empty one.
    """
    small_batches(docs.sparkSession)
    d = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("node", F.xxhash64("text"))
    id_type = d.schema["doc_id"].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, out = blobs(batch.column("text")), []
            for i, j in steps(texts):
                out += _bands(texts[i:j], bands, rows, weights)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("node"), pa.array(out, pa.list_(pa.int64()))], ["doc_id", "node", "bands"])

    signed = stage(d.mapInArrow(lean(sign), f"doc_id {id_type}, node long, bands array<long>"), "near-signed")
    told = signed.select(F.explode("bands").alias("band"), "node").distinct()
    sizes = told.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = stage(told.join(sizes, "band"), "near-buckets")
    central = shared.groupBy("node").agg(F.sum("n").alias("c"))
    led = shared.join(central, "node").groupBy("band").agg(F.max_by("node", F.struct("c", "node")).alias("leader"))
    pairs = stage(shared.join(led, "band").where("node <> leader").select(F.greatest("node", "leader").alias("a"), F.least("node", "leader").alias("b")).distinct(), "near-pairs")

    def elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, out = blobs(batch.column("text")), []
            for i, j in steps(texts):
                of, h = shingles(texts[i:j], weights)
                cuts = np.searchsorted(of, np.arange(j - i + 1))
                out += [np.unique(h[a:b]).view(np.int64) for a, b in zip(cuts, cuts[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(out, pa.list_(pa.int64()))], ["node", "s"])

    involved = stage(shared.select("node").distinct(), "near-nodes")
    n_involved = involved.count()
    texts = d.select("node", "text").join(_small(involved, n_involved), "node", "left_semi")
    sets = stage(texts.mapInArrow(lean(elements), "node long, s array<long>").groupBy("node").agg(F.first("s").alias("s")), "near-sets")

    def verified(some: DataFrame) -> DataFrame:
        x = some.join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
        x = x.where(F.least(F.size("sa"), F.size("sb")) >= threshold * F.greatest(F.size("sa"), F.size("sb")))
        x = x.withColumn("i", F.size(F.array_intersect("sa", "sb")))
        return x.where(F.col("i") >= threshold * (F.size("sa") + F.size("sb") - F.col("i"))).select("a", "b")

    links = stage(verified(pairs), "near-links")
    comps = connected(links)
    # members of a leader's buckets that lie in different components are compared in blocks
    groups = shared.join(led, "band").select("leader", "node").distinct()
    placed = stage(groups.join(comps, "node", "left").select("leader", "node", F.coalesce("comp", "node").alias("comp")), "near-placed")
    sizes = placed.groupBy("leader", "comp").agg(F.count(F.lit(1)).alias("k")).groupBy("leader").agg(F.count(F.lit(1)).alias("comps"), F.sum("k").alias("n"), F.max("k").alias("most"), F.max_by("comp", "k").alias("main")).where("comps > 1")
    sizes = stage(sizes, "near-sizes")
    apart = placed.join(_small(sizes, sizes.count()), "leader")
    blocks_of = lambda n: F.ceil(n / F.lit(BLOCK)).cast("int")
    apart = apart.select("leader", "node", "comp", (F.col("comp") != F.col("main")).alias("far"), blocks_of(F.col("n") - F.col("most")).alias("rows"), blocks_of(F.col("n")).alias("cols"))
    apart = apart.join(sets, "node")
    every = lambda n: F.sequence(F.lit(0), n - 1)
    own = lambda n, seed: F.pmod(F.xxhash64("node", F.lit(seed)), n).cast("int")
    far = apart.where("far").select("leader", "node", "comp", "s", "far", own(F.col("rows"), 1).alias("i"), F.explode(every(F.col("cols"))).alias("j"))
    all_ = apart.select("leader", "node", "comp", "s", F.lit(False).alias("far"), F.explode(every(F.col("rows"))).alias("i"), own(F.col("cols"), 2).alias("j"))
    n_apart = apart.count()
    if n_apart:
        spread = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_apart // BLOCK)
        units = far.unionByName(all_).withColumn("unit", F.xxhash64("leader", "i", "j"))
        new = units.drop("leader", "i", "j").withColumn("deal", F.pmod("unit", F.lit(spread))).groupBy("deal").applyInArrow(lean_group(lambda t: _compare(t, threshold)), "a long, b long")
        comps = connected(links.union(new))

    rows_ = signed.select("doc_id", "node")
    homes = comps.groupBy("node").agg(F.min("comp").alias("comp"))
    least = rows_.groupBy("node").agg(F.min("doc_id").alias("m")).join(homes, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    # written, so that Spark may split the join's other side where a class is large
    first = stage(least.groupBy("comp").agg(F.min("m").alias("class_id")), "near-classes")
    named = least.join(first, "comp").select("node", "class_id", "comp")
    return rows_.join(named, "node").select("doc_id", "class_id", F.col("node").alias("text_hash"), F.col("comp").alias("class_node"))


def keep_one(docs: DataFrame, classes: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Of every class the row of least id (null last; of equal ids the one of least text hash, of equal rows one), with docs' columns."""
    own = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "text_hash")
    first = classes.groupBy("class_node").agg(F.min(own).alias("kept")).select(F.col("kept.doc_id").alias("k"), F.col("kept.text_hash").alias("h"))
    # rows meet what is kept by their own id and text, never by class: a class may hold a third of all rows
    rows = classes.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n"))
    met = rows.join(stage(first, "near-kept"), F.col("doc_id").eqNullSafe(F.col("k")) & (F.col("text_hash") == F.col("h")), "left")
    judged = stage(met.select("doc_id", "text_hash", "n", F.col("h").isNotNull().alias("stays")), "near-judged")
    gone = judged.where("not stays").select(F.col("doc_id").alias("of"), F.col("text_hash").alias("as"))
    counts = judged.agg(F.count_if(~F.col("stays")).alias("gone"), F.max(F.when(F.col("stays"), F.col("n"))).alias("most")).first()
    on = docs[doc_id].eqNullSafe(F.col("of")) & (F.xxhash64(F.coalesce(docs[text], F.lit(""))) == F.col("as"))
    left = docs.join(_small(gone, counts["gone"] or 0), on, "left_anti")
    return left if (counts["most"] or 1) == 1 else left.dropDuplicates([doc_id, text])
