"""Unified diffs as rows of hunks."""

from __future__ import annotations

import subprocess

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T

HEADER = r"^@@ -(\d+)(?:,\d+)? \+(\d+)(?:,\d+)? @@"
#: Where a section of a diff begins: a line of a file or hunk.
SECTION = r"(?<=\n)(?=diff --git |--- |\+\+\+ |@@ -\d+(?:,\d+)? \+\d+(?:,\d+)? @@)"
MAX_BYTES, SECONDS = 256 * 1024, 3


def working_tree(root: str) -> str:
    """The working tree's diff against HEAD, by a fixed command line, bounded in time and size."""
    done = subprocess.run(["git", "diff", "--no-ext-diff", "--no-color", "--unified=3", "HEAD", "--"], cwd=root, capture_output=True, timeout=SECONDS, check=True)
    return done.stdout[:MAX_BYTES].decode("utf-8", "replace")


def hunks(diffs: DataFrame, key: str = "id", text: str = "text", max_hunks: int = 5) -> DataFrame:
    """(key, hunk_no, relative_path, old_start, new_start, content, content_hash, changed_from, changed_to) of every diff.

    A hunk belongs to the last +++ (or, for a deletion, ---) line before it; those without a safe path are left out, and
    of each diff the first max_hunks stay. Each diff is read within its row: cut into sections at its file and hunk lines,
    which are then taken in order.
    """
    known = "struct<new:string,old:string,kept:array<struct<relative_path:string,content:string>>>"
    none = F.lit(None).cast("string")

    def step(done: Column, section: Column) -> Column:
        is_old, is_new = section.startswith("--- "), section.startswith("+++ ")
        clean = F.regexp_replace(F.rtrim(F.regexp_replace(F.split(section, "\n", 2)[0], r"\r+$", "")), r"^(---|\+\+\+) ", "")
        path = F.regexp_replace(F.split(clean, "\t")[0], r"^[ab]/", "")
        named = F.when(path != "/dev/null", path)
        new = F.when(is_old, none).when(is_new, F.coalesce(named, done["new"])).otherwise(done["new"])
        old = F.when(is_old, named).otherwise(done["old"])
        own = F.coalesce(done["new"], done["old"])
        wanted = section.rlike(HEADER) & (F.size(done["kept"]) < max_hunks) & T.is_safe_path(own)
        kept = F.when(wanted, F.concat(done["kept"], F.array(F.struct(own.alias("relative_path"), section.alias("content"))))).otherwise(done["kept"])
        return F.struct(new.alias("new"), old.alias("old"), kept.alias("kept")).cast(known)

    nothing = F.struct(none.alias("new"), none.alias("old"), F.array().alias("kept")).cast(known)
    kept = F.aggregate(F.split(text, SECTION), nothing, step, lambda done: done["kept"])
    rows = diffs.select(key, F.posexplode(kept).alias("at", "hunk")).select(key, (F.col("at") + 1).alias("hunk_no"), "hunk.*")
    old_start, new_start = (F.regexp_extract("content", HEADER, i).cast("int") for i in (1, 2))
    size = F.size(F.filter(F.split("content", "\n"), lambda x: x.rlike(r"^[ +]")))
    return rows.select(key, "hunk_no", F.replace("relative_path", F.lit("\\"), F.lit("/")).alias("relative_path"), old_start.alias("old_start"), new_start.alias("new_start"), "content", T.content_hash(F.col("content")).alias("content_hash"), new_start.alias("changed_from"), (new_start + F.greatest(size - 1, F.lit(0))).alias("changed_to"))
