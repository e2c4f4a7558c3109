"""The four kinds of errors that operators raise."""


class FstError(Exception):
    """Base of all errors of this package."""


class InvalidOperation(FstError, ValueError):
    """The input does not meet the operator's conditions."""


class AlgorithmError(FstError, RuntimeError):
    """No start state, no convergence, a cycle where none may be."""


class FormatError(FstError, ValueError):
    """A file does not hold what its format promises."""


class StorageError(FstError, OSError):
    """A folder cannot be written or read."""
