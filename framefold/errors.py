"""Errors with codes and severities, and the same as rows."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Error names and codes.
CODES = {
    "UNKNOWN_ERROR": "E0000", "INVALID_INPUT": "E0001", "INVALID_CONFIG": "E0002", "INITIALIZATION_FAILED": "E0003",
    "UNSUPPORTED_FORMAT": "E1001", "INVALID_SAMPLE_RATE": "E1002", "INVALID_CHANNELS": "E1003", "AUDIO_CORRUPTION": "E1004",
    "BUFFER_FULL": "E2001", "BUFFER_EMPTY": "E2002", "INSUFFICIENT_DATA": "E2003", "BUFFER_CORRUPTION": "E2004",
    "MODEL_LOAD_FAILED": "E3001", "INFERENCE_FAILED": "E3002", "RESULT_VALIDATION_FAILED": "E3003", "BACKEND_UNAVAILABLE": "E3004",
    "TIMEOUT_ERROR": "E4001", "MEMORY_ERROR": "E4002", "THREAD_ERROR": "E4003", "RESOURCE_EXHAUSTED": "E4004",
    "PROCESSING_FAILED": "E5001", "CLEANUP_FAILED": "E5002", "INVALID_STATE": "E5003",
}
#: Fixed values.
SEVERITIES = ["low", "medium", "high", "critical"]
ERROR_TYPE = "struct<error_code:string,message:string,severity:string,context:map<string,string>,timestamp:timestamp>"


class StreamError(Exception):
    """An error of the engine: a code by its name, a severity and any context."""

    name, severity = "UNKNOWN_ERROR", "medium"

    def __init__(self, message: str, name: str | None = None, severity: str | None = None, **context: object) -> None:
        super().__init__(message)
        self.message, self.context = message, context
        self.name, self.severity = name or self.name, severity or self.severity
        if self.severity not in SEVERITIES:
            raise ValueError(f"severity must be one of {SEVERITIES}")
        self.timestamp = dt.datetime.now(dt.UTC)

    @property
    def code(self) -> str:
        return CODES[self.name]

    def to_dict(self) -> dict:
        return {"error_code": self.code, "message": self.message, "severity": self.severity, "context": self.context, "timestamp": self.timestamp.isoformat()}

    def to_json(self) -> str:
        return json.dumps(self.to_dict(), default=str)


class InputError(StreamError):
    name = "INVALID_INPUT"


class ConfigError(StreamError):
    name = "INVALID_CONFIG"


class FormatError(StreamError):
    name = "UNSUPPORTED_FORMAT"


class BufferFull(StreamError):
    name = "BUFFER_FULL"


class InsufficientData(StreamError):
    name = "INSUFFICIENT_DATA"


class ModelError(StreamError):
    name = "MODEL_LOAD_FAILED"


class BackendUnavailable(StreamError):
    name = "BACKEND_UNAVAILABLE"


class StateError(StreamError):
    name = "INVALID_STATE"


class ProcessingError(StreamError):
    name = "PROCESSING_FAILED"


def error_info(error: BaseException) -> dict:
    """Any exception as a dictionary; foreign ones are unknown errors of medium severity."""
    if isinstance(error, StreamError):
        return error.to_dict()
    return StreamError(str(error), exception_type=type(error).__name__).to_dict()


def error_column(name: str, message: Column, severity: str = "medium", when: Column | None = None) -> Column:
    """The error of a row as a struct, null where when is false."""
    at = F.lit(None).cast("timestamp")
    error = F.struct(F.lit(CODES[name]).alias("error_code"), message.alias("message"), F.lit(severity).alias("severity"), F.lit(None).cast("map<string,string>").alias("context"), at.alias("timestamp"))
    return error.cast(ERROR_TYPE) if when is None else F.when(when, error).cast(ERROR_TYPE)
