"""Errors of binding JSON to schemas: exceptions at plan time, and the error column's fields at run time."""

from __future__ import annotations

#: The error column: null where a document is fine.
ERROR_DDL = "struct<kind: string, message: string, offset: int, value: string, target: string, field: string>"


class JsonError(ValueError):
    """Base of all errors here; `kind` is the error column's kind."""

    kind = "json"

    def __init__(self, message: str, offset: int | None = None, value: str | None = None, target: str | None = None, field: str | None = None):
        super().__init__(message)
        self.message, self.offset, self.value, self.target, self.field = message, offset, value, target, field

    def row(self) -> dict:
        return {"kind": self.kind, "message": self.message, "offset": self.offset, "value": self.value, "target": self.target, "field": self.field}


class JsonSyntaxError(JsonError):
    """Malformed or truncated text."""

    kind = "syntax"


class UnexpectedEndError(JsonSyntaxError, EOFError):
    """The text ends inside a value."""


class JsonTypeError(JsonError, TypeError):
    """A value that doesn't fit its target: another JSON type, a fraction or an overflow."""

    kind = "type"

    @classmethod
    def of(cls, value: str, target: str, field: str) -> "JsonTypeError":
        return cls(f"cannot decode {value} into {target}" + (f" at {field}" if field else ""), value=value, target=target, field=field)


class InvalidTargetError(JsonError, TypeError):
    """A destination that can't be decoded into (plan time)."""

    kind = "target"


class UnsupportedTypeError(JsonError, TypeError):
    """A column type that JSON can't hold (plan time)."""

    kind = "unsupported"


class UnsupportedValueError(JsonError):
    """NaN, an infinity, or a year outside 0..9999."""

    kind = "value"


class HookError(JsonError):
    """A registered codec raised."""

    kind = "hook"
