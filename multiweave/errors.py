"""What the engine raises, with the SQLSTATE that a client would see."""

from __future__ import annotations


class EngineError(Exception):
    sqlstate = "XX000"


class Unsupported(EngineError):
    sqlstate = "0A000"


class InvalidInput(EngineError):
    sqlstate = "22023"


class LimitExceeded(EngineError):
    sqlstate = "54000"


class DuplicateKey(EngineError):
    sqlstate = "23505"


class NotFound(EngineError):
    sqlstate = "42P01"


class Exists(EngineError):
    sqlstate = "42P07"


class Expired(EngineError):
    """A snapshot or token older than what is kept."""

    sqlstate = "72000"


class Denied(EngineError):
    sqlstate = "42501"
