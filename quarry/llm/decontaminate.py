"""Benchmark decontamination: which documents contain a short test item, found by size-partitioned MinHash containment.

DataFrame functions only. Texts become sets of hashed five-word shingles. A MinHash signature with 2**bits coordinates
throws every hash into the coordinate given by its top bits and keeps the least one of each. Documents are partitioned by
size: one with n shingles gets the least power of two of coordinates that is at least BINS * n, so that about nine tenths
of its shingles survive, whatever its length, and long documents don't hide short items. An item has such a signature at
every resolution: a hash stays the least of its coordinate from the number of bits on at which it parts from the hash
before it. Equal hashes in an equal coordinate are a hit, and one hit makes a candidate; an item of which k shingles are
in the document goes unseen with a chance below (1 / (BINS + 1)) ** k. Items whose hits may have fewer than SMALL shared
shingles are searched without loss: a bitmap of their hashes tells which further hashes documents keep. Candidates are
verified on the shingles' own words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import stage

WIDTH = 5
#: Coordinates for each shingle of a document; items that may share fewer shingles than SMALL are searched without loss;
#: places of the bitmap of their hashes.
BINS, SMALL, PLACES = 4, 8, 1 << 16
#: Rows (of some 40 bytes) and bytes of text up to which a table that was counted is sent to every executor.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 16 << 20


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def hashed_shingles(hashes: Column) -> Column:
    """Hashes of the runs of five words, from the words' hashes; empty if there are fewer."""
    n = F.greatest(F.size(hashes) - (WIDTH - 1), F.lit(0))
    return F.transform(F.slice(hashes, F.lit(1), n), lambda x, i: F.xxhash64(x, *[F.get(hashes, i + k) for k in range(1, WIDTH)]))


def spelled_shingles(w: Column) -> Column:
    n = F.greatest(F.size(w) - (WIDTH - 1), F.lit(0))
    return F.array_distinct(F.transform(F.slice(w, F.lit(1), n), lambda x, i: F.concat_ws(" ", x, *[F.get(w, i + k) for k in range(1, WIDTH)])))


def _sets(rows: DataFrame) -> DataFrame:
    """Adds `s`, the ascending distinct shingle hashes of `text`, in place of it."""
    hashed = rows.withColumn("h", F.transform(words(F.col("text")), lambda w: F.xxhash64(w))).drop("text")
    return hashed.withColumn("s", F.sort_array(F.array_distinct(hashed_shingles(F.col("h"))))).drop("h")


def _near(small: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(small) if rows <= BROADCAST_ROWS else small


def search(docs: DataFrame, items: DataFrame, threshold: float = 0.8, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """One row for each document and item of which at least `threshold` of the item's distinct shingles are in the document.

    Columns: doc_id, item_id, n_shared, n_shingles, containment, and text_hash, which tells documents of one id apart. Texts
    that are null or of under five words have no shingles: as documents they contain nothing, as items they are in nothing.
    Rows equal in id and text count once, on both sides; a null id is an id. Other columns are ignored. Empty tables give
    no rows.
    """
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("text_hash"))
    i = items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).distinct()
    sets = stage(_sets(i.withColumn("item_key", F.xxhash64("item_id", "text"))), "decontam-items")
    n_hashes = sets.agg(F.sum(F.size("s"))).first()[0] or 0
    spelled_bytes = WIDTH * (i.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    small = F.ceil(F.size("s") * F.lit(float(threshold))) < SMALL
    place = lambda x: F.pmod(x, F.lit(PLACES))
    marked = {r[0] for r in sets.where(small).select(F.explode("s").alias("h")).select(place(F.col("h"))).distinct().collect()}  # PLACES at most
    bitmap = F.lit("".join("1" if k in marked else "0" for k in range(PLACES))) if marked else None
    # a hash is its coordinate's least from `bits` on: one more than the leading bits that it shares with the one before
    told = sets.select("item_id", "item_key", "s", F.posexplode("s").alias("at", "h"))
    before = F.get("s", F.col("at") - 1)
    signed = told.select("item_id", "item_key", "h", F.when((F.col("at") == 0) | small, 0).otherwise(65 - F.length(F.bin(F.col("h").bitwiseXOR(before)))).alias("bits"))

    # never a condition on what is derived from the arrays: it would be pushed below them and computed for each element
    bits = F.coalesce(F.ceil(F.log2(F.greatest(F.size("s"), F.lit(1)) * F.lit(float(BINS)))).cast("int"), F.lit(0))
    sized = _sets(d).withColumn("class", F.least(bits, F.lit(63)))
    drop = F.lit(64) - F.col("class")
    bin_of = lambda x: F.call_function("shiftright", x, drop)
    least = lambda x, k: (k == 0) | (bin_of(x) != bin_of(F.get("s", k - 1)))
    # the bitmap's text is ASCII, so its places are bytes
    listed = (lambda x: F.substr(bitmap, (place(x) + 1).cast("int"), F.lit(1)) == "1") if marked else (lambda x: F.lit(False))
    minima = F.filter("s", lambda x, k: least(x, k) | listed(x))
    thrown = sized.select("doc_id", "text_hash", "class", F.explode_outer(minima).alias("h"))
    hits = thrown.join(_near(signed, n_hashes), "h").where(F.col("class") >= F.col("bits"))
    pairs = stage(hits.select("doc_id", "text_hash", "item_id", "item_key").distinct(), "decontam-pairs")

    n_pairs = pairs.count()
    some = pairs.select(F.col("doc_id").alias("of"), F.col("text_hash").alias("as")).distinct()
    candidates = d.join(_near(some, n_pairs), F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("text_hash") == F.col("as")), "left_semi").distinct()
    spelled = candidates.withColumn("w", words(F.col("text"))).select("doc_id", "text_hash", F.explode_outer(spelled_shingles(F.col("w"))).alias("shingle"))
    wanted = i.withColumn("item_key", F.xxhash64("item_id", "text")).withColumn("w", words(F.col("text"))).withColumn("of_item", spelled_shingles(F.col("w")))
    wanted = wanted.select("item_key", F.size("of_item").cast("long").alias("n_shingles"), F.explode_outer("of_item").alias("shingle"))
    shared = spelled.join(F.broadcast(wanted) if spelled_bytes <= BROADCAST_BYTES else wanted, "shingle").groupBy("doc_id", "text_hash", "item_key", "n_shingles").agg(F.count(F.lit(1)).alias("n_shared"))
    on = shared["doc_id"].eqNullSafe(pairs["doc_id"]) & (shared["text_hash"] == pairs["text_hash"]) & (shared["item_key"] == pairs["item_key"])
    found = shared.join(_near(pairs, n_pairs), on)
    kept = found.select(shared["doc_id"], "item_id", "n_shared", "n_shingles", (F.col("n_shared") / F.col("n_shingles")).alias("containment"), shared["text_hash"])
    return kept.where(F.col("containment") >= threshold)


def decontaminate(docs: DataFrame, items: DataFrame, threshold: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that contain no item, with their columns; nulls and short texts stay."""
    bad = stage(search(docs, items, threshold, doc_id=doc_id, text=text).select("doc_id", "text_hash").distinct(), "decontam-bad")
    on = docs[doc_id].eqNullSafe(bad["doc_id"]) & (F.xxhash64(docs[text]) == bad["text_hash"])
    return docs.join(_near(bad, bad.count()), on, "left_anti")
