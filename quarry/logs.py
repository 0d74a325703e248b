"""Logging of operations: an id for each operation, and for each stage its duration and counts, never contents."""

from __future__ import annotations

import json
import logging
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from datetime import UTC, datetime

log = logging.getLogger("quarry")
_operation: ContextVar[str | None] = ContextVar("operation", default=None)


class _WithOperation(logging.Filter):
    def filter(self, record: logging.LogRecord) -> bool:
        record.operation = _operation.get() or "-"
        return True


class _Json(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        row = {"time": datetime.fromtimestamp(record.created, UTC).isoformat(), "level": record.levelname, "logger": record.name, "operation": record.operation, "message": record.getMessage()}
        row |= {"stage": record.stage} if hasattr(record, "stage") else {}
        return json.dumps(row | ({"error": self.formatException(record.exc_info)} if record.exc_info else {}), ensure_ascii=False)


def configure(level: str = "WARNING", as_json: bool = False) -> None:
    """Sends this package's records to standard error, as lines or JSON; other loggers stay as they are."""
    handler = logging.StreamHandler()
    handler.addFilter(_WithOperation())
    handler.setFormatter(_Json() if as_json else logging.Formatter("%(levelname)s %(name)s [%(operation)s] %(message)s"))
    log.handlers, log.propagate = [handler], False
    log.setLevel(level)


@contextmanager
def operation(name: str | None = None) -> Iterator[str]:
    """All records inside carry the operation's id."""
    token = _operation.set(name or uuid.uuid4().hex)
    try:
        yield _operation.get()
    finally:
        _operation.reset(token)


@contextmanager
def stage_log(stage: str) -> Iterator[dict[str, int]]:
    """Logs a stage's milliseconds, and the counts that the block puts into the dictionary it is given."""
    counts: dict[str, int] = {}
    began = time.perf_counter()
    yield counts
    took = round((time.perf_counter() - began) * 1000, 3)
    told = "".join(f" {k}={v}" for k, v in sorted(counts.items()))
    log.info("stage=%s duration_ms=%.3f%s", stage, took, told, extra={"stage": {"name": stage, "duration_ms": took} | counts})
