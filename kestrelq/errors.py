"""One taxonomy over Spark's own errors."""

from __future__ import annotations

from pyspark.errors import AnalysisException, ArithmeticException, ParseException, PySparkException


class EngineError(Exception):
    """Base of all; `position` is the character at which a syntax error lies, where it is known."""

    def __init__(self, message: str, position: int | None = None):
        super().__init__(message)
        self.position = position


class LexError(EngineError):
    pass


class SyntaxFault(EngineError):
    pass


class BindError(EngineError):
    """Names, scopes and types."""


class ExecutionError(EngineError):
    pass


class StorageError(EngineError):
    pass


class IoError(EngineError):
    pass


def translated(error: Exception, sql: str = "") -> EngineError:
    """The engine's error for one of Spark's."""
    if isinstance(error, EngineError):
        return error
    text = str(error)
    if isinstance(error, ParseException):
        kind = LexError if any(x in text for x in ("UNCLOSED_BRACKETED_COMMENT", "extraneous character", "token recognition")) else SyntaxFault
        return kind(text, _position(error, sql))
    if "PATH_NOT_FOUND" in text or "FileNotFound" in text or isinstance(error, OSError):
        return IoError(text)
    if isinstance(error, ArithmeticException):
        return ExecutionError(text)
    if isinstance(error, AnalysisException):
        return BindError(text)
    if isinstance(error, PySparkException):
        return ExecutionError(text)
    return ExecutionError(text)


def _position(error: Exception, sql: str) -> int | None:
    import re

    m = re.search(r"\(line (\d+), pos (\d+)\)", str(error))
    if not m or not sql:
        return None
    lines = sql.splitlines(keepends=True)
    return sum(map(len, lines[: int(m[1]) - 1])) + int(m[2])
