"""JSON lines on a stdlib logger, with bound context."""

from __future__ import annotations

import json
import logging
import sys
import traceback
from datetime import datetime, timezone


class JsonLines(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        entry = {
            "time": datetime.fromtimestamp(record.created, timezone.utc).isoformat(),
            "level": record.levelname,
            "logger": record.name,
            "message": record.getMessage(),
            **getattr(record, "context", {}),
        }
        if record.exc_info:
            entry["error"] = "".join(traceback.format_exception(*record.exc_info))
        return json.dumps(entry, default=str, ensure_ascii=False)


class ContextLogger(logging.LoggerAdapter):
    """Keyword arguments of a call become fields of its line, after the bound ones."""

    def bind(self, **context) -> ContextLogger:
        return ContextLogger(self.logger, {**self.extra, **context})

    def process(self, msg, kwargs):
        known = {k: kwargs.pop(k) for k in ("exc_info", "stack_info", "stacklevel") if k in kwargs}
        return msg, {**known, "extra": {"context": {**self.extra, **kwargs}}}


def get_logger(name: str, **context) -> ContextLogger:
    logger = logging.getLogger(name)
    if not logger.handlers:
        handler = logging.StreamHandler(sys.stdout)
        handler.setFormatter(JsonLines())
        logger.addHandler(handler)
        logger.setLevel(logging.INFO)
        logger.propagate = False
    return ContextLogger(logger, context)
