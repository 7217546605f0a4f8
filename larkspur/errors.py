"""Errors that callers can tell apart; each has a code and an HTTP status."""

from __future__ import annotations


class EngineError(Exception):
    code, status, remedy = "engine_error", 500, ""

    def __init__(self, message: str, **context):
        super().__init__(message)
        self.message, self.context = message, context

    def to_dict(self) -> dict:
        return {"code": self.code, "message": self.message, "remedy": self.remedy, "context": self.context}


class QueryFailed(EngineError):
    code, status = "query_failed", 400


class Unanswerable(EngineError):
    code, status, remedy = "unanswerable", 422, "Ask about a column and a period that the table has."


class AmbiguousQuery(EngineError):
    code, status, remedy = "ambiguous_query", 409, "Name the table that is meant."


class NotFound(EngineError):
    code, status = "not_found", 404


class IngestFailed(EngineError):
    code, status = "ingest_failed", 422


class FileTooLarge(EngineError):
    code, status = "file_too_large", 413


class StorageBusy(EngineError):
    code, status, remedy = "storage_busy", 503, "Try again."
