"""Settings, error codes and the registry of repositories: plain Python around the engine."""

from __future__ import annotations

import fcntl
import json
import os
import tomllib
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass, fields
from pathlib import Path

#: Error codes and their exit status.
EXIT_CODES = {
    "configuration_invalid": 2, "context_budget_invalid": 2, "context_request_invalid": 2, "context_retrieval_failed": 7, "database_not_initialized": 5, "database_unavailable": 5,
    "graph_query_invalid": 2, "index_failed": 7, "internal_error": 1, "invalid_path": 2, "mcp_request_invalid": 2, "parser_unavailable": 6, "patch_impact_failed": 7,
    "path_outside_repository": 2, "repository_locked": 4, "repository_not_found": 3, "search_query_invalid": 2,
}
#: Least and most of each number.
BOUNDS = {"max_file_size_bytes": (1, 100_000_000), "binary_probe_bytes": (1, 1 << 20), "max_candidates": (1, 1000), "max_queries": (1, 50), "max_context_tokens": (256, 100_000), "lock_seconds": (0, 60)}


class EngineError(ValueError):
    """An error with a stable code."""

    def __init__(self, code: str, message: str = ""):
        super().__init__(message or code)
        self.code, self.exit_code = code, EXIT_CODES.get(code, 1)


@dataclass(frozen=True)
class Settings:
    max_file_size_bytes: int = 2_000_000
    binary_probe_bytes: int = 8192
    max_candidates: int = 200
    max_queries: int = 12
    max_context_tokens: int = 12_000
    lock_seconds: float = 0.1

    def __post_init__(self) -> None:
        for name, (low, high) in BOUNDS.items():
            if not low <= getattr(self, name) <= high:
                raise EngineError("configuration_invalid", f"{name} must be {low} to {high}")


def load_settings(overrides: dict | None = None, file: str | None = None, environment: dict[str, str] | None = None) -> Settings:
    """Overrides win over QUARRY_* variables, these over the file's table, that over defaults."""
    kinds = {f.name: type(f.default) for f in fields(Settings)}
    environment = os.environ if environment is None else environment
    found = tomllib.loads(Path(file).read_text()) if file and Path(file).exists() else {}
    found = {k: v for k, v in found.items() if k in kinds}
    found |= {k: environment[f"QUARRY_{k.upper()}"] for k in kinds if f"QUARRY_{k.upper()}" in environment}
    found |= overrides or {}
    try:
        return Settings(**{k: kinds[k](v) for k, v in found.items()})
    except (KeyError, TypeError, ValueError) as e:
        raise EngineError("configuration_invalid", str(e)) from e


class Registry:
    """Known repositories in one JSON file; at most one is active."""

    def __init__(self, folder: str):
        self.folder = Path(folder)
        self.folder.mkdir(parents=True, exist_ok=True)
        self.file = self.folder / "repositories.json"

    def list(self) -> list[dict]:
        rows = json.loads(self.file.read_text()) if self.file.exists() else []
        return sorted(rows, key=lambda r: (not r["active"], r["number"]))

    def _save(self, rows: list[dict]) -> None:
        part = self.file.with_suffix(f".{uuid.uuid4().hex}")
        part.write_text(json.dumps(rows))
        part.replace(self.file)

    def add(self, path: str) -> dict:
        at = os.path.realpath(path)
        if not os.path.isdir(at):
            raise EngineError("invalid_path", path)
        rows = self.list()
        if known := next((r for r in rows if r["path"] == at), None):
            return known
        row = {"id": str(uuid.uuid4()), "path": at, "name": os.path.basename(at), "active": not rows, "number": max((r["number"] for r in rows), default=0) + 1}
        self._save([*rows, row])
        return row

    def get(self, which: str | None = None) -> dict:
        for r in self.list():
            if r["active"] if which is None else which in (r["id"], r["path"]) or os.path.realpath(which) == r["path"]:
                return r
        raise EngineError("repository_not_found", which or "no active repository")

    def activate(self, which: str) -> dict:
        own = self.get(which)
        self._save([r | {"active": r["id"] == own["id"]} for r in self.list()])
        return self.get(which)

    def remove(self, which: str) -> None:
        own = self.get(which)
        with self.lock(own["id"]):
            self._save([r for r in self.list() if r["id"] != own["id"]])

    @contextmanager
    def lock(self, repository_id: str) -> Iterator[None]:
        """Only one build of a repository at a time."""
        with open(self.folder / f"{repository_id}.lock", "w") as f:
            try:
                fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
            except OSError as e:
                raise EngineError("repository_locked", repository_id) from e
            yield


def describe(settings: Settings) -> dict:
    return asdict(settings)
