"""URL rules by a sort-merge range join on reversed-host keys.

A host's key is its labels in reverse, each followed by a mark that sorts before all others, so a host and all its
subdomains are one interval of keys. Pages and rules are sorted by key and swept in order with a stack of the hosts whose
interval is still open: nested intervals open and close like brackets. Of the open rules whose path begins the page's path,
the longest (host and path together; then the longer host, then by name) decides.

Rules that were counted few go to every task, which sweeps its own pages batch by batch. More rules are dealt, with the
pages, into ranges of keys: every rule goes to the ranges that its interval meets, and a range with very many pages (those
of one address, say) is split further by a hash of the row.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarry.llm.common import lean, lean_cogroup, parts, row_hash, with_fields

#: Rules up to which, once counted, every task gets them all and no page moves; beyond that both sides are dealt into ranges.
BROADCAST_RULES = 20_000
#: Keys whose order sets the bounds of the ranges, ranges at most, and pages that a task of a range gets, about.
SAMPLE, RANGES, RANGE_ROWS = 40_000, 20_000, 50_000
MARK = "\x01"
Rule = tuple[str, str, str]  # verdict, host, path


def host_and_path(url: F.Column) -> tuple[F.Column, F.Column]:
    """Host: after the first :// up to /, ?, # or the end, A-Z lower-cased. Path: from there to ?, # or the end. Else empty."""
    # (?s): a url may hold line ends; null gives null, and so empty
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), path


def reversed_key(host: F.Column) -> F.Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), MARK), F.lit(MARK))


def _key(host: str) -> str:
    return MARK.join(reversed(host.split("."))) + MARK


def _order(s: str) -> bytes:
    """Spark orders strings by their UTF-8 bytes."""
    return s.encode("utf-8", "surrogatepass")


Opened = tuple[str, str, dict[str, str], list[int]]  # key, host, verdict by path, lengths of the paths, longest first


def by_host(rules: Iterable[Rule]) -> list[Opened]:
    """Rules by host, in order of keys."""
    hosts: dict[str, dict[str, str]] = {}
    for verdict, host, path in rules:
        hosts.setdefault(host, {})[path] = verdict
    return sorted((_key(h), h, paths, sorted({len(p) for p in paths}, reverse=True)) for h, paths in hosts.items())


def sweep(keys: Sequence[str], paths: Sequence[str], rules: list[Opened]) -> list[Rule | None]:
    """The deciding rule of each page, pages in any order of input; both sides are sorted and merged."""
    out: list[Rule | None] = [None] * len(keys)
    stack: list[Opened] = []
    at = 0
    for i in sorted(range(len(keys)), key=keys.__getitem__):
        key, path = keys[i], paths[i]
        while at < len(rules) and rules[at][0] <= key:
            while stack and not rules[at][0].startswith(stack[-1][0]):
                stack.pop()
            stack.append(rules[at])
            at += 1
        while stack and not key.startswith(stack[-1][0]):
            stack.pop()
        fit = [(h, path[:n], own[path[:n]]) for _, h, own, sizes in stack for n in sizes if n <= len(path) and path[:n] in own]
        if fit:
            h, p, verdict = max(fit, key=lambda r: (len(r[0]) + len(r[1]), len(r[0]), r[0] + r[1]))
            out[i] = (verdict, h, p)
    return out


def _judged(table: pa.Table | pa.RecordBatch, rules: list[Opened], default: str) -> list[pa.Array]:
    got = sweep(table.column("key").to_pylist(), table.column("path").to_pylist(), rules)
    told = [pa.array([r and r[1] + r[2] for r in got], pa.string()), pa.array([r[0] if r else default for r in got], pa.string())]
    return [table.column("rest"), table.column("host"), table.column("path"), *told]


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url") -> DataFrame:
    """Adds host, path, rule (`host/path`, null if none fits) and verdict (the rule's, else the default) to every page.

    A null url, or one without ://, has empty host and path; no rule fits it unless a rule is itself empty. Of rules that
    are given twice with different verdicts, `block` holds. Other columns pass through, own columns named host, path, rule
    and verdict are replaced; repeated pages stay; empty tables on either side are fine.
    """
    spark = pages.sparkSession
    named = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    host, path = host_and_path(F.col(url))
    laid = pages.select(F.struct(*named).alias("rest"), host.alias("host"), path.alias("path")).withColumn("key", reversed_key(F.col("host")))
    rules = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # block sorts after allow
    few = rules.select("verdict", "host", "path").limit(BROADCAST_RULES + 1).collect()
    done = _in_place(laid, by_host(tuple(r) for r in few), default) if len(few) <= BROADCAST_RULES else _in_ranges(laid, rules, default, parts(spark))
    return done.select(*[F.col(f"rest.`{c}`").alias(c) for c in named], "host", "path", "rule", "verdict")


def _schema(laid: DataFrame) -> StructType:
    return with_fields([laid.schema["rest"]], "host string, path string, rule string, verdict string")


def _in_place(laid: DataFrame, rules: list[Opened], default: str) -> DataFrame:
    names = ["rest", "host", "path", "rule", "verdict"]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(_judged(batch, rules, default), names)

    return laid.mapInArrow(lean(look), _schema(laid))


def _in_ranges(laid: DataFrame, rules: DataFrame, default: str, least: int) -> DataFrame:
    rules = rules.withColumn("key", reversed_key(F.col("host")))
    # the path spreads a host with very many pages over several ranges
    spread = F.concat("key", F.lit("\x02"), "path")
    n = laid.count()
    keys = laid.select(spread.alias("k")).withColumn("h", F.xxhash64("k")).distinct().orderBy("h", "k").limit(SAMPLE)
    some = sorted(_order(r["k"]) for r in keys.collect())
    n_ranges = max(1, min(RANGES, len(some), max(2 * least, -(-n // RANGE_ROWS))))
    cuts = sorted({some[len(some) * k // n_ranges] for k in range(1, n_ranges)}) if some else []

    def range_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = [bisect_right(cuts, x) for x in batch.column("spread").cast(pa.binary()).to_pylist()]
            yield batch.drop_columns(["spread"]).append_column("range", pa.array(k, pa.int64()))

    hashed = laid.select("rest", "host", "path", "key", row_hash(laid).alias("row"), spread.alias("spread"))
    ranged = hashed.mapInArrow(lean(range_of), with_fields([laid.schema["rest"]], "host string, path string, key string, row long, range long"))
    sizes = {r["range"]: r["n"] for r in ranged.groupBy("range").agg(F.count(F.lit(1)).alias("n")).collect()}  # RANGES at most
    splits = {k: -(-size // RANGE_ROWS) for k, size in sizes.items()}
    spans = laid.sparkSession.createDataFrame(sorted(splits.items()) or [(0, 1)], "range long, splits int")
    ranged = ranged.join(F.broadcast(spans), "range").withColumn("split", F.pmod("row", "splits"))

    def ranges_met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                low = _order(r["key"])
                last = bisect_right(cuts, low[:-1] + b"\x02")  # the first key after the interval
                rows += [(r["host"], r["path"], r["verdict"], k, p) for k in range(bisect_right(cuts, low), last + 1) for p in range(splits.get(k, 0))]
            c = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([*[pa.array(x, pa.string()) for x in c[:3]], *[pa.array(x, pa.int64()) for x in c[3:]]], ["host", "path", "verdict", "range", "split"])

    dealt = rules.mapInArrow(lean(ranges_met), "host string, path string, verdict string, range long, split long")

    def merge(left: pa.Table, right: pa.Table) -> pa.Table:
        own = by_host((r["verdict"], r["host"], r["path"]) for r in right.to_pylist())
        return pa.Table.from_arrays(_judged(left, own, default), ["rest", "host", "path", "rule", "verdict"])

    return ranged.groupBy("range", "split").cogroup(dealt.groupBy("range", "split")).applyInArrow(lean_cogroup(merge), _schema(laid))
