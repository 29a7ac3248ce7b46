"""The one exception type of the engine; ``code`` is the machine-readable kind."""

from __future__ import annotations


class ReadloomError(Exception):
    """An error with a code, a message, and optionally detail and a hint."""

    def __init__(self, code: str, message: str, detail: str | None = None, hint: str | None = None):
        super().__init__(f"{code}: {message}")
        self.code, self.message, self.detail, self.hint = code, message, detail, hint


def unimplemented(what: str) -> ReadloomError:
    return ReadloomError("unimplemented", f"{what} is not implemented")
