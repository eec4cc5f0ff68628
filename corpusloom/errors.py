"""The four kinds of error, and how a service reports them."""

from __future__ import annotations


class RecordError(Exception):
    """Base of all errors of this package."""

    prefix = ""

    def __str__(self) -> str:
        return f"{self.prefix}{super().__str__()}"


class IoError(RecordError):
    prefix = "record I/O error: "


class XmlError(RecordError):
    prefix = "XML error: "


class DecodeError(RecordError):
    prefix = "record decode error: "


class InvalidConfiguration(RecordError):
    """A wrong option or request, or a record that breaks a limit."""


class NotPrepared(InvalidConfiguration):
    """A preview operation before ``prep``."""


KINDS = {"io": IoError, "xml": XmlError, "decode": DecodeError, "invalid": InvalidConfiguration}


def raise_kind(kind: str, message: str) -> None:
    raise KINDS.get(kind, RecordError)(message)


def status_of(error: Exception) -> tuple[int, str]:
    """HTTP status and code of an error."""
    if isinstance(error, NotPrepared):
        return 409, "corpus_not_prepared"
    if isinstance(error, InvalidConfiguration):
        return 400, "invalid_request"
    return 500, "internal_error"
