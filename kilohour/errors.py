"""Failures a caller may want to tell apart."""


class KilohourError(Exception):
    """Base class."""


class ContractViolation(KilohourError):
    """Rows break a table contract."""


class ConflictingDuplicates(KilohourError):
    """One key carries several different values."""


class InsufficientHistory(KilohourError):
    """Not enough contiguous rows."""


class StorageConflict(KilohourError):
    """A stored table disagrees with its own layout or with an expected write."""


class NotFound(KilohourError):
    """A point lookup matched nothing."""
