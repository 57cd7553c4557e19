"""Errors that callers tell apart."""


class SchemaVersionError(RuntimeError):
    """The data's schema version is not the one this code reads."""


class ValidationError(ValueError):
    """Rows or files failed validation; ``problems`` lists what was wrong."""

    def __init__(self, message: str, problems: list | None = None) -> None:
        super().__init__(message)
        self.problems = problems or []
