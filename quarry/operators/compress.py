"""Command output made short: repeats collapsed, failures with their neighbours and both ends kept, the rest counted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import sequences as Q

#: What marks a line as worth keeping; bounds.
PRIORITY = r"(?i)(\berror\b|\bfailed?\b|\bfailure\b|\bexception\b|traceback|\bwarning\b|\bsummary\b|\bpassed\b|\bskipped\b|\bexpected\b|\bactual\b|^\s*[EFW]\s+)"
MAX_INPUT, WHOLE, HEAD, TAIL = 200_000, 80, 8, 12


def compress(outputs: DataFrame, key: str = "id", text: str = "text", max_chars: int = 12_000) -> DataFrame:
    """(key, content, original_lines, repeated) of every output; outputs are worked on in parallel, each by its own lines."""
    if not 256 <= max_chars <= 50_000:
        raise ValueError("mcp_request_invalid")
    whole = F.coalesce(F.col(text), F.lit(""))
    bound = F.regexp_replace(F.substring(whole, 1, MAX_INPUT), "\r\n?", "\n")
    original = F.length(whole) - F.length(F.replace(whole, F.lit("\n"), F.lit(""))) + F.when(F.length(whole) > 0, 1).otherwise(0)
    lines = outputs.select(key, F.posexplode(F.split(F.regexp_replace(bound, "\n$", ""), "\n")).alias("at", "line"))
    runs = Q.collapse_runs(lines, [key], ["at"], "line")
    note = F.concat(F.lit("[previous line repeated "), F.col("length") - 1, F.lit(" time(s)]"))
    shown = runs.select(key, "run", F.posexplode(F.when(F.col("length") > 1, F.array(F.col("line"), note)).otherwise(F.array("line"))).alias("sub", "content"))
    kept = Q.context_lines(shown, [key], ["run", "sub"], F.col("content").rlike(PRIORITY), head=HEAD, tail=TAIL, whole=WHOLE)
    marked = kept.withColumn("out", F.when(F.col("skipped") > 0, F.concat(F.lit("[... "), F.col("skipped"), F.lit(" line(s) omitted ...]\n"), F.col("content"))).otherwise(F.col("content")))
    joined = marked.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "out"))), lambda x: x["out"]), "\n").alias("content"))
    repeats = runs.groupBy(key).agg(F.sum(F.col("length") - 1).alias("repeated"))
    suffix = "\n[output truncated to configured character budget]"
    cut = F.regexp_replace(F.substring("content", 1, max_chars - len(suffix)), r"\n[^\n]*\z", "")
    content = F.when(F.length("content") <= max_chars, F.col("content")).otherwise(F.concat(cut, F.lit(suffix)))
    return joined.join(repeats, key).join(outputs.select(key, original.alias("original_lines")), key).select(key, content.alias("content"), "original_lines", "repeated")
