"""A source tree as rows: files with their bytes, filtered by rules that are all column expressions.

The driver lists paths (Spark's own listing leaves out names that begin with _ or ., as __init__.py); contents are read,
hashed and judged by the executors. Every file gets a `skip` reason or null.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Language by suffix, folders that are never read, names and headers of generated files.
LANGUAGES = {
    ".py": "python", ".pyi": "python", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript",
    ".ts": "typescript", ".mts": "typescript", ".cts": "typescript", ".tsx": "tsx", ".dart": "dart", ".go": "go",
}
EXCLUDED = (
    ".dart_tool .git .hg .mypy_cache .next .nox .nuxt .pytest_cache .ruff_cache .svn .tox .venv "
    "__pycache__ build coverage dist node_modules target vendor venv"
).split()
GENERATED_NAMES = r"\.(freezed\.dart|g\.dart|gen\.dart|generated\.dart|min\.js)$"
GENERATED_HEADERS = r"@generated|generated code|do not edit"
HEADER_BYTES, PROBE_BYTES, MAX_BYTES = 512, 8192, 2_000_000


def language_of(path: Column) -> Column:
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv]), suffix)


def ignore_regex(pattern: str) -> tuple[str, bool] | None:
    """(regex over a path relative to the rules' folder, whether it re-includes) of one ignore line; None for no rule.

    Folders are given with a closing slash. A pattern with a slash that isn't its last sign is anchored.
    """
    line = pattern.rstrip("\n").rstrip("\r")
    line = re.sub(r"(?<!\\) +$", "", line)
    if not line or line.startswith("#"):
        return None
    again = line.startswith("!")
    line = line[1:] if again else line
    line = line[1:] if line.startswith(("\\#", "\\!")) else line
    folder_only = line.endswith("/")
    body = line.rstrip("/")
    anchored = "/" in body
    body = body.lstrip("/")
    out, i = "", 0
    while i < len(body):
        if body.startswith("**/", i):
            out, i = out + r"(?:.*/)?", i + 3
        elif body.startswith("/**", i) and i + 3 == len(body):
            out, i = out + r"/.+", i + 3
        elif body[i] == "*":
            out, i = out + r"[^/]*", i + 1
        elif body[i] == "?":
            out, i = out + r"[^/]", i + 1
        elif body[i] == "[" and "]" in body[i + 2 :]:
            j = body.index("]", i + 2)
            inner = body[i + 1 : j]
            out, i = out + "[" + ("^" + inner[1:] if inner[0] in "!^" else inner) + "]", j + 1
        else:
            out, i = out + re.escape(body[i]), i + 1
    return ("^" if anchored else r"^(?:.*/)?") + out + ("/$" if folder_only else "/?$"), again


def is_ignored(path: Column, layers: dict[str, list[str]]) -> Column:
    """Whether a relative path, or a folder above it, is ignored; layers are ignore lines by folder ('' is the root).

    Deeper layers win over higher ones and later lines over earlier ones. What lies in an ignored folder can't come back.
    """
    rules = []
    for folder in sorted(layers, key=lambda f: f.count("/") + bool(f)):
        for line in layers[folder]:
            if rule := ignore_regex(line):
                prefix = re.escape(folder.rstrip("/") + "/") if folder else ""
                rules.append(("^" + prefix + rule[0].removeprefix("^"), rule[1]))
    if not rules:
        return F.lit(False)

    def judged(p: Column) -> Column:
        found = F.coalesce(*[F.when(p.rlike(regex), F.lit(not again)) for regex, again in reversed(rules)])
        return F.coalesce(found, F.lit(False))

    segments = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(segments) - 1, F.lit(1))), lambda k: F.concat(F.array_join(F.slice(segments, F.lit(1), k), "/"), F.lit("/")))
    folders = F.when(F.size(segments) > 1, above).otherwise(F.array().cast("array<string>"))
    return F.exists(F.concat(folders, F.array(path)), judged)


def skip_reason(path: Column, length: Column, content: Column, layers: dict[str, list[str]] | None = None, max_bytes: int = MAX_BYTES) -> Column:
    """Why a file isn't indexed, or null."""
    folders = F.slice(F.split(path, "/"), F.lit(1), F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    header = F.lower(F.make_valid_utf8(F.substring(content, 1, HEADER_BYTES).cast("string")))
    return (
        F.when(F.arrays_overlap(folders, F.array(*[F.lit(x) for x in EXCLUDED])), "excluded_directory")
        .when(is_ignored(path, layers or {}), "ignored")
        .when(language_of(path).isNull(), "unsupported")
        .when(F.lower(path).rlike(GENERATED_NAMES), "generated")
        .when(length > max_bytes, "oversized")
        .when(F.contains(F.substring(content, 1, PROBE_BYTES), F.lit(b"\x00")), "binary")
        .when(header.rlike(GENERATED_HEADERS), "generated")
    )


#: Skips that say nothing of whether a file is there.
ISSUES = ["unreadable", "changed_during_scan"]


def list_tree(root: str) -> list[tuple[str, int, float, str | None]]:
    """(relative path, bytes, modification time, skip) of every file in order of path; excluded folders aren't entered.

    A folder that can't be listed is a row of its own, `unreadable`; the root must be readable.
    """
    from pyarrow import fs

    system, base = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), os.path.abspath(root))
    local, found, todo = isinstance(system, fs.LocalFileSystem), [], [base]
    while todo:
        folder = todo.pop()
        try:
            inside = system.get_file_info(fs.FileSelector(folder))
        except OSError:
            if folder == base:
                raise
            found.append((folder[len(base) :].lstrip("/"), 0, 0.0, "unreadable"))
            continue
        for x in inside:
            path = x.path[len(base) :].lstrip("/")
            if local and os.path.islink(x.path):
                found.append((path, 0, 0.0, "symlink"))
            elif x.type == fs.FileType.Directory:
                if x.base_name not in EXCLUDED:
                    todo.append(x.path)
                else:
                    found.append((path, 0, 0.0, "excluded_directory"))
            elif x.type == fs.FileType.File:
                found.append((path, x.size, x.mtime.timestamp() if x.mtime else 0.0, None))
    return sorted(found)


def scan(spark: SparkSession, root: str, layers: dict[str, list[str]] | None = None, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(relative_path, language, size_bytes, modified_at, content, content_hash, skip) of every file below a root."""
    listed = list_tree(root)

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), os.path.abspath(root))
        for batch in batches:
            for r in batch.to_pylist():
                content, path = None, f"{base}/{r['relative_path']}"
                if r["listed"] is None and r["size_bytes"] <= max_bytes:
                    try:
                        with system.open_input_file(path) as f:
                            content = f.read()
                        now = system.get_file_info(path)
                        if len(content) != r["size_bytes"] or (now.mtime.timestamp() if now.mtime else 0.0) != r["modified_at"]:
                            content, r["listed"] = None, "changed_during_scan"
                    except OSError:
                        content, r["listed"] = None, "unreadable"
                yield pa.RecordBatch.from_pylist([r | {"content": content}], schema=batch.schema.append(pa.field("content", pa.binary())))

    rows = spark.createDataFrame([(p, n, t, s) for p, n, t, s in listed], "relative_path string, size_bytes long, modified_at double, listed string")
    rows = rows.repartition(max(1, min(len(listed), 8 * spark.sparkContext.defaultParallelism)))
    path = F.col("relative_path")
    # unwanted files are judged by their names before anything is read
    named = F.coalesce("listed", F.when(is_ignored(path, layers or {}), "ignored").when(language_of(path).isNull(), "unsupported"))
    read = rows.withColumn("listed", named).mapInArrow(load, "relative_path string, size_bytes long, modified_at double, listed string, content binary")
    reason = F.coalesce("listed", skip_reason(path, F.col("size_bytes"), F.coalesce("content", F.lit(b"")), layers, max_bytes))
    return read.select("relative_path", language_of(path).alias("language"), "size_bytes", F.timestamp_seconds("modified_at").alias("modified_at"), "content", F.sha2("content", 256).alias("content_hash"), reason.alias("skip"))


def skip_counts(scanned: DataFrame) -> DataFrame:
    return scanned.where("skip is not null").groupBy("skip").count()


def ignore_layers(root: str) -> dict[str, list[str]]:
    """The lines of a tree's ignore files, by folder: some small files that the driver reads."""
    from pyarrow import fs

    system, base = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), os.path.abspath(root))
    out = {}
    for path, _, _, skip in list_tree(root):
        if skip is None and path.rpartition("/")[2] == ".gitignore":
            with system.open_input_file(f"{base}/{path}") as f:
                out[path.rpartition("/")[0]] = f.read().decode("utf-8", "replace").splitlines()
    return out
