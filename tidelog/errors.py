"""The status codes of the API as exceptions; multi-gets carry them as strings instead."""

from __future__ import annotations

OK, NOT_FOUND = "OK", "NotFound"


class LogError(Exception):
    """Any failure of the log's API."""

    code = "Error"


class NotFound(LogError):
    code = NOT_FOUND


class Corruption(LogError):
    code = "Corruption"


class InvalidArgument(LogError):
    code = "InvalidArgument"


class Conflict(LogError):
    """Another writer committed first."""

    code = "Busy"
