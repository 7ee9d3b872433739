"""Typed errors."""

from __future__ import annotations

#: Codes that callers match on.
CODES = (
    "NOT_A_GIT_REPO",
    "BRANCH_NOT_FOUND",
    "INVALID_REPO_PATH",
    "GIT_NOT_INSTALLED",
    "GIT_COMMAND_FAILURE",
    "MERGE_BASE_UNAVAILABLE",
    "MALFORMED_DIFF",
    "UNSUPPORTED_REPO_STATE",
    "SHALLOW_REPO_LIMITATION",
    "UNKNOWN",
)


class ScanError(Exception):
    """An error with a code of ``CODES``, a message, and the text of what caused it."""

    def __init__(self, code: str, message: str, cause: object = None) -> None:
        if code not in CODES:
            raise ValueError(f"no such error code: {code}")
        super().__init__(message)
        self.code, self.message = code, message
        self.cause = None if cause is None else str(cause)

    def as_dict(self) -> dict[str, str]:
        return {"code": self.code, "message": self.message} | ({} if self.cause is None else {"cause": self.cause})

    def __reduce__(self):
        return type(self), (self.code, self.message, self.cause)


def is_scan_error(error: object) -> bool:
    return isinstance(error, ScanError)
