"""Statuses of files and requests: the errors a decoder can end with."""

from __future__ import annotations

OK = "ok"
TRUNCATED = "truncated"
INVALID_DATA = "invalid_data"
NOT_WEBP = "not_webp"
UNSUPPORTED = "unsupported"
TOO_LARGE = "too_large"
INVALID_ARGUMENT = "invalid_argument"
BUFFER_TOO_SMALL = "buffer_too_small"
INTERNAL = "internal"
ALL = (OK, TRUNCATED, INVALID_DATA, NOT_WEBP, UNSUPPORTED, TOO_LARGE, INVALID_ARGUMENT, BUFFER_TOO_SMALL, INTERNAL)


class CodecError(Exception):
    """A failure with a status."""

    def __init__(self, status: str, message: str = ""):
        super().__init__(message or status)
        self.status = status


def invalid(message: str) -> CodecError:
    return CodecError(INVALID_DATA, message)
