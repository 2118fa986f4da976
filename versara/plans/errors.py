"""Errors that planners raise, with the status that a service would answer."""

from __future__ import annotations

#: What went wrong with a reference, and its status.
KINDS = {"syntax": 400, "ambiguous": 400, "unknown_book": 404, "unavailable": 404, "out_of_range": 404}


class BadReference(ValueError):
    """A reference that can't be bound."""

    def __init__(self, message: str, kind: str = "syntax") -> None:
        super().__init__(message)
        self.kind, self.status = kind, KINDS[kind]


class RequestError(ValueError):
    """A request that is refused before any data is read."""

    def __init__(self, message: str, status: int = 400) -> None:
        super().__init__(message)
        self.status = status


def bounded_int(value, default: int, least: int, most: int, label: str) -> int:
    """A whole number within bounds, or the default for None."""
    if value is None:
        return default
    try:
        n = int(str(value).strip())
    except ValueError:
        raise RequestError(f"{label} must be a whole number") from None
    if not least <= n <= most:
        raise RequestError(f"{label} must be between {least} and {most}")
    return n
