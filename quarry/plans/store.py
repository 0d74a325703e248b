"""Indexes and graphs that outlive a session: tables by repository and generation, and the log of the runs that wrote them.

Each run writes a new generation of every table below <base>/<table>/repository_id=<id>/generation=<n> and is over when its
last state, `ready`, is in the log; readers take the last ready generation, so a run that fails or loses its driver changes
nothing for them. The generation before the last one stays for readers that have it open, older ones go.
"""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.logs import log
from quarry.plans import code_index
from quarry.settings import EngineError

#: States of a run in order; it ends as ready, unchanged or failed.
STATES = ["pending", "scanning", "parsing", "building_graph"]
INDEX = ["files", "symbols", "chunks", "facts", "documents", "skipped", "postings"]
GRAPH = ["relationships", "diagnostics", "targets", "bindings", "evidence"]
LOG = "repository_id string, generation long, seq int, state string, at double, error string, counters map<string,long>"


class Store:
    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")

    # --- small files, by the file system that Spark reads the tables with -------------------------------------------

    def _at(self, *parts: str):  # noqa: ANN202
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.base, *parts]))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _put(self, text: str, *parts: str) -> None:
        """A new small file; it is there whole or, under its final name, not at all."""
        part, system = self._at(*parts[:-1], f".{parts[-1]}.part")
        out = system.create(part, True)
        out.write(bytearray(text.encode()))
        out.close()
        if not system.rename(part, self._at(*parts)[0]):
            raise EngineError("repository_locked", f"{'/'.join(parts)} exists")

    def _drop(self, *parts: str) -> None:
        path, system = self._at(*parts)
        system.delete(path, True)

    # --- runs -------------------------------------------------------------------------------------------------------

    def runs(self, repository_id: str) -> DataFrame:
        """One row for each state that a run of the repository reached."""
        path, system = self._at("runs", repository_id)
        if not system.exists(path):
            return self.spark.createDataFrame([], LOG)
        return self.spark.read.schema(LOG).json(str(path))

    def last_runs(self, repository_id: str) -> DataFrame:
        """Each run with its last state."""
        last = F.max_by(F.struct("state", "at", "error", "counters"), "seq").alias("x")
        return self.runs(repository_id).groupBy("repository_id", "generation").agg(last, F.min("at").alias("started_at")).select("repository_id", "generation", "started_at", "x.*")

    def _log(self, repository_id: str, generation: int, seq: int, state: str, error: str | None = None, counters: dict | None = None) -> None:
        row = {"repository_id": repository_id, "generation": generation, "seq": seq, "state": state, "at": time.time(), "error": error, "counters": counters or {}}
        self._put(json.dumps(row), "runs", repository_id, f"{generation:08d}-{seq}-{state}.json")

    def generation(self, repository_id: str) -> int | None:
        """The last ready one."""
        return self.runs(repository_id).where("state = 'ready'").agg(F.max("generation")).first()[0]

    # --- tables -----------------------------------------------------------------------------------------------------

    def _folder(self, table: str, repository_id: str, generation: int) -> str:
        return f"{self.base}/{table}/repository_id={repository_id}/generation={generation}"

    def _write(self, repository_id: str, generation: int, index: code_index.Index, graph: code_index.Graph) -> None:
        for names, owner in ((INDEX, index), (GRAPH, graph)):
            for name in names:
                getattr(owner, name).write.mode("overwrite").parquet(self._folder(name, repository_id, generation))

    def read(self, repository_id: str, generation: int | None = None) -> tuple[code_index.Index, code_index.Graph]:
        """The repository's last index and graph; only its own folders are read, and every table must have been written."""
        generation = self.generation(repository_id) if generation is None else generation
        if generation is None:
            raise EngineError("database_not_initialized", f"{repository_id} has no index")
        table = lambda name: self.spark.read.parquet(self._folder(name, repository_id, generation))
        return code_index.Index(repository_id, *[table(n) for n in INDEX]), code_index.Graph(*[table(n) for n in GRAPH], repository_id=repository_id)

    def build(self, repository_id: str, root: str, full: bool = False, retry_failed: bool = False) -> dict:
        """Scans the tree and writes the next generation: from the last one, or from nothing if there is none or `full`.

        Returns what the run did. If no file changed, no table is written and the generation stays. Callers hold the
        repository's lock (Registry.lock).
        """
        last = self.generation(repository_id)
        known = self.runs(repository_id).agg(F.max("generation")).first()[0]
        number, seq = (known or 0) + 1, 0
        self._log(repository_id, number, seq, STATES[0])

        def enter(state: str, **more) -> None:  # noqa: ANN003
            nonlocal seq
            seq += 1
            log.info("run %s of %s: %s", number, repository_id, state)
            self._log(repository_id, number, seq, state, **more)

        try:
            enter("scanning")
            if last is None or full:
                enter("parsing")
                index = code_index.build_index(self.spark, root, repository_id)
                index.postings = code_index.postings_of(index.documents)
                parsed, deleted, held = index.files.count(), 0, 0
                enter("building_graph")
                graph = code_index.build_graph(index)
                refreshed = index.facts.count()
            else:
                before, old = self.read(repository_id, last)
                enter("parsing")
                index, change = code_index.update_index(self.spark, root, before, retry_failed)
                n = {r["change"]: r["count"] for r in change.groupBy("change").count().collect()}
                parsed, deleted, held = n.get("new", 0) + n.get("changed", 0), n.get("deleted", 0), n.get("protected", 0)
                enter("building_graph")
                graph, refreshed = code_index.refresh_graph(old, before, index, change)
            counters = {"parsed": parsed, "deleted": deleted, "protected": held, "refreshed_facts": refreshed}
            if last is None or full or parsed or deleted:
                self._write(repository_id, number, index, graph)
                written = number
            else:
                written = last
            counters |= self._counts(*self.read(repository_id, written))
            if written == number:
                enter("ready", counters=counters, error="partial_failure" if counters["failed"] or counters["stale"] else None)
                self._clear(repository_id, keep={number, last})
            else:
                enter("unchanged", counters=counters)
            return counters | {"generation": written}
        except Exception as e:
            enter("failed", error=f"{type(e).__name__}: {e}"[:500])
            raise

    @staticmethod
    def _counts(index: code_index.Index, graph: code_index.Graph) -> dict[str, int]:
        files = index.files.selectExpr("count(*) AS files", "coalesce(sum(symbol_count), 0) AS symbols", "coalesce(sum(chunk_count), 0) AS chunks", "coalesce(sum(fact_count), 0) AS facts", "count_if(parse_status = 'failed') AS failed", "count_if(parse_status = 'stale') AS stale").first().asDict()
        bad = {r.reason: r["count"] for r in graph.diagnostics.groupBy("reason").count().collect()}
        return files | {"relationships": graph.relationships.count()} | {k: bad.get(k, 0) for k in ("ambiguous", "unresolved", "unsupported")}

    def status(self, repository_id: str) -> dict:
        """Counts of the last index, what was skipped, and the last run."""
        run = self.last_runs(repository_id).orderBy(F.desc("generation")).limit(1).collect()
        last = self.generation(repository_id)
        told = {"repository_id": repository_id, "generation": last, "last_run": run[0].asDict() if run else None, "ready": last is not None}
        if last is None:
            return told
        index, graph = self.read(repository_id, last)
        return told | self._counts(index, graph) | {"skipped": {r.skip: r["count"] for r in index.skipped.collect()}}

    def _clear(self, repository_id: str, keep: set) -> None:
        for name in INDEX + GRAPH:
            path, system = self._at(name, f"repository_id={repository_id}")
            for x in system.listStatus(path):
                if int(x.getPath().getName().split("=")[1]) not in keep:
                    system.delete(x.getPath(), True)

    def remove(self, repository_id: str) -> None:
        """Everything of one repository, and of no other."""
        for name in INDEX + GRAPH:
            self._drop(name, f"repository_id={repository_id}")
        self._drop("runs", repository_id)
